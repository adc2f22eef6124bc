import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import top_k as T


def brute(rows, k, every):
    """Every row of another id is a candidate, repeated ones each; rows of one id ask together."""
    vectors = [(i, tuple(int(np.floor(np.float64(x) * 256)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, a in sorted(set(vectors)):
        if q % every == 0:
            out.setdefault(q, []).extend((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in vectors if i != q and len(a) == len(b))
    return sorted((q, n + 1, i, -s) for q, found in out.items() for n, (s, i) in enumerate(sorted(found)[:k]))


@pytest.mark.parametrize("blocks", [(1 << 20, 4096), (96, 3)])
def test_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(T, "CANDIDATES", blocks[0])
    monkeypatch.setattr(T, "QUERIES", blocks[1])
    monkeypatch.setattr(T, "SAMPLE", 20)
    monkeypatch.setattr(T, "FIRST_DEPTH", 1)
    rng = random.Random(4)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.0, 0.25]) for _ in range(6)]) for i in range(120)]
    rows += [(i, [0.5] * 6) for i in range(200, 240)]  # ties
    rows += [(None, [1.0] * 6), (300, None), (305, [None] * 6), (310, [float("nan")] * 6), (315, [float("inf")] + [0.0] * 5), (320, [1.0, 2.0]), (325, [3.0, -1.0]), (330, []), (335, [0.0] * 6), (0, rows[0][1]), (5, [2.0] * 6), (10, [-1.0] * 6), (1, rows[1][1]), (0, rows[0][1])] + [(7, [9.0] * 6)] * 3 + [(11, [-9.0] * 6)] * 40
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("other")).withColumn("size", F.lit(1))
    rounded = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(map(tuple, T.top_k(df, F.col("vec_id") % 5 == 0, 5).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute(rounded, 5, 5)


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-3.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, T.top_k(df, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 512 * 256), (0, 2, 2, -768 * 256)]
    assert T.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert T.top_k(df, F.lit(None).cast("boolean")).count() == 0


def test_stops_early():
    """Rows far from the query are never scored once the bound can't beat the k-th score."""
    rng = np.random.default_rng(0)
    rows = rng.integers(-3, 4, (4000, 8))
    rows[:10] = 50
    read = []
    found = list(T.search_block(np.full((1, 8), 2), np.array([-1]), rows, np.arange(4000), 5, read))
    assert [f[1] for f in found] == [0, 1, 2, 3, 4] and read[0] < 200


def test_large_numbers_are_exact():
    rows = np.array([[1 << 40, 1], [1 << 40, 2], [3, 3]])
    found = list(T.search_block(np.array([[1 << 20, 1]]), np.array([-1]), rows, np.array([7, 8, 9]), 2))
    assert [(f[1], f[2]) for f in found] == [(8, (1 << 60) + 2), (7, (1 << 60) + 1)]


def test_repeated_rows_are_each_a_candidate(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, T.top_k(df, F.col("vec_id") == 0).collect()))
    assert got == [(0, 1, 1, 512 * 256), (0, 2, 1, 512 * 256), (0, 3, 2, 256 * 256)]


def plain(queries, rows, k):
    scores = queries @ rows.T
    return [np.lexsort((np.arange(len(rows)), -s))[:k].tolist() for s in scores]


@pytest.mark.parametrize(("clusters", "share"), [(0, 1.0), (400, 0.3)])
def test_share_of_rows_scored(clusters, share):
    """Of independent components none can be passed over; of rows in clusters of few dimensions few are scored. Either is exact."""
    rng = np.random.default_rng(2)
    if clusters:
        centres = rng.integers(200, 900, (clusters, 64)) * np.array([rng.permutation(64) < 3 for _ in range(clusters)])
        rows = centres[rng.integers(0, clusters, 8000)]
        rows = rows + rng.integers(-9, 10, rows.shape) * (rows != 0)
    else:
        rows = rng.integers(-500, 501, (8000, 64))
    queries, read = rows[:60], []
    found: dict = {}
    for n, i, s in T.search_block(queries, np.full(60, -1), rows, np.arange(8000), 5, read):
        assert s == queries[n] @ rows[i]
        found.setdefault(n, []).append(i)
    assert [found[n] for n in range(60)] == plain(queries, rows, 5)
    part = np.mean(read) / 8000
    print(f"share of rows scored, {clusters} clusters: {part:.3f}")
    assert part <= share and (clusters or part == 1)


def test_no_slower_than_a_matrix_product():
    """Where nothing can be pruned the work is a matrix product and the choice of the best, but for a little."""
    import time

    rng = np.random.default_rng(3)
    rows = rng.integers(-500, 501, (16384, 64))
    queries = rng.integers(-500, 501, (1024, 64))
    centres = rng.integers(200, 900, (400, 64)) * np.array([rng.permutation(64) < 3 for _ in range(400)])
    clustered = centres[rng.integers(0, 400, 16384)]
    clustered = clustered + rng.integers(-9, 10, clustered.shape) * (clustered != 0)

    def timed(work):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            work()
            took.append(time.perf_counter() - began)
        return min(took)

    def product(rows, queries):
        x, q = rows.astype(float), queries.astype(float)
        for first in range(0, len(q), 256):
            for s in q[first : first + 256] @ x.T:
                keep = np.flatnonzero(s >= np.partition(s, len(s) - 5)[len(s) - 5])
                keep[np.lexsort((keep, -s[keep]))[:5]]

    for x, q, most in ((rows, queries, 2), (clustered, clustered[:1024], 1)):
        mine, plainly = timed(lambda: list(T.search_block(q, np.full(1024, -1), x, np.arange(16384), 5))), timed(lambda: product(x, q))  # noqa: B023
        print(f"{mine:.2f} s against {plainly:.2f} s")
        assert mine < most * plainly + 0.3
