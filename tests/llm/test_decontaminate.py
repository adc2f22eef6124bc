import random

import pytest
from corpus import DOCS, odd_rows, words

from lanewise.llm import decontaminate as D


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        if item is not None:
            for i in range(len(w) - n + 1 if n else 0):
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                got = windows.get(tuple(w[i : i + n]))
                if got:
                    hit |= set(range(i, i + n))
                    found |= got
        out.append((doc, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=str)


def run(spark, rows, items, **more):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in D.contamination(docs, benchmark, ["doc_id"], **more).collect()), key=str)


def corpus(seed, vocabulary):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["w", "W"]) + str(rng.randrange(vocabulary)) for _ in range(n))
    items = [(i, text(rng.randrange(0, 25))) for i in range(25)] + [(None, text(12)), (3, text(15)), (77, None), (78, "")]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(0, 20))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(w) + 1)
            parts += [" ".join(w[a : a + rng.randrange(1, 25)]), text(rng.randrange(0, 5))]
        rows.append((i, ", ".join(parts), "en", "s"))
    return rows + odd_rows(), items


@pytest.mark.parametrize(("seed", "vocabulary"), [(1, 10_000), (2, 3), (3, 1)])
def test_against_brute_force(spark, seed, vocabulary):
    rows, items = corpus(seed, vocabulary)
    assert run(spark, rows, items) == brute(rows, items)


def test_in_portions(spark):
    rows, items = corpus(4, 50)
    assert run(spark, rows, items, portion_bytes=300) == brute(rows, items)


def test_few_matches_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(D, "MATCHES", 3)
    text = "a b a b a b a b a b a b a b a b"
    bounds, hit, items = D.scan(pa.array([text, "none"]), D.build(["1"], [text]))
    assert hit.tolist() == [True] * 16 + [False] and items == [{0}, set()]


def test_empty_tables_and_clashing_names(spark):
    rows, items = corpus(5, 50)
    assert all(r[2] == 0 for r in run(spark, rows, items[:0] + [(77, None)]))
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "n_hit").withColumnRenamed("source", "items")
    got = D.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), docs.columns, prefix="d_")
    assert got.columns == [*docs.columns, "d_n_words", "d_n_hit", "d_n_items", "d_items", "d_contaminated"]
    assert got.filter("d_contaminated").count() > 0
    assert D.contamination(docs.limit(0), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).count() == 0


@pytest.mark.parametrize("n", [256, 1024, 4096])
def test_words_that_collide_in_polynomial_hashes(spark, n):
    a, b = (("".join("ab"[(i.bit_count() + k) % 2] for i in range(n))) for k in (0, 1))
    items = [(1, a), (2, " ".join([a] * 10))]
    rows = [(1, b, "en", "s"), (2, " ".join([b] * 12), "en", "s"), (3, f"x {a} y", "en", "s")]
    assert run(spark, rows, items) == brute(rows, items)


def test_words_of_equal_hashes_are_compared(monkeypatch):
    """With a hash that takes all words of a length for one, hits are still exact."""
    import numpy as np
    import pyarrow as pa

    from lanewise.llm import _text

    monkeypatch.setattr(_text, "hashes", lambda folded, start, size: size.astype(np.uint64))
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(i, text(rng.randrange(1, 14))) for i in range(8)]
    rows = [(i, text(rng.randrange(0, 60)), "en", "s") for i in range(25)] + [(99, f"c {items[0][1]} c", "en", "s")]
    for most in (5, 1 << 20):
        monkeypatch.setattr(D, "MATCHES", most)
        bounds, hit, found = D.scan(pa.array([r[1] for r in rows]), D.build([str(i) for i, _ in items], [t for _, t in items]))
        got = [(r[0], int(bounds[n + 1] - bounds[n]), int(hit[bounds[n] : bounds[n + 1]].sum()), len(found[n])) for n, r in enumerate(rows)]
        assert sorted(got, key=str) == [r[:4] for r in brute(rows, items)]
