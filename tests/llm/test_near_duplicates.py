import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpus import DOCS, odd_rows, sentence, words
from pyspark.sql import functions as F

from lanewise.llm import near_duplicates as N


def bag(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute(rows, threshold=0.8):
    bags = [bag(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and similarity(bags[i], bags[j]) >= threshold - 1e-9:
                parent[root(i)] = root(j)
    ids = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            ids[root(i)] = min(ids.get(root(i), row[0]), row[0])
    return sorted(((row[0], row[0] if not bags[i] else ids.get(root(i))) for i, row in enumerate(rows)), key=str)


def corpus(seed, groups=12, size=12, length=80):
    """Chains of copies with more and more words changed, and unrelated texts."""
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        text = sentence(rng, length).split()
        for _ in range(rng.randrange(1, size)):
            rows.append(" ".join(text))
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                text[rng.randrange(len(text))] = f"n{rng.randrange(10**6)}"
    rows += [sentence(rng, rng.randrange(1, 60)) for _ in range(25)] + ["a b c", "a b c", "A, b; c!", "a b", "x " * 60, "x " * 59, "x " * 30]
    rng.shuffle(rows)
    return [(i, t, "en", "s") for i, t in enumerate(rows)]


def test_against_brute_force(spark):
    rows = corpus(5)
    got = N.near_duplicate_classes(spark.createDataFrame(rows, DOCS).repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    rows = corpus(6, groups=4, size=60)
    got = N.near_duplicate_classes(spark.createDataFrame(rows, DOCS))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_group_of_many_classes(spark, monkeypatch):
    """A candidate group without a main class, held together by a passage that all share: texts only meet blocks that may hold a partner."""
    monkeypatch.setattr(N, "BLOCK", 8)
    rng = random.Random(11)
    passage, rows = sentence(rng, 30, 10**6), []
    for _ in range(24):
        own = sentence(rng, 45, 10**6).split()
        for _ in range(12):
            copy = list(own)
            copy[rng.randrange(45)] = f"n{rng.randrange(10**6)}"
            rows.append(f"{passage} {' '.join(copy)}")
    rng.shuffle(rows)
    rows = [(i, t, "en", "s") for i, t in enumerate(rows)]
    counts = {}
    real = N.pinned

    def seen(df):
        kept = real(df)
        if {"block", "bytes"} <= {*df.columns}:
            counts["sent"] = kept.count()
        if {"block", "blocks", "bag"} <= {*df.columns}:
            counts["large"] = kept.filter("blocks > 1").count()
        return kept

    monkeypatch.setattr(N, "pinned", seen)
    got = N.near_duplicate_classes(spark.createDataFrame(rows, DOCS).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    large = counts["large"]
    assert large > 200  # else the passage doesn't hold the group together
    # All strays times all blocks would be about large * large / 8.
    assert counts["sent"] <= 14 * large < large * large / 8 / 2


@pytest.mark.parametrize("bytes_", [64 << 20, 4000])
def test_joined_by_shuffles_and_blocks_by_bytes(spark, monkeypatch, bytes_):
    from lanewise.llm import _store

    monkeypatch.setattr(N, "MOST_BROADCAST", 0)
    monkeypatch.setattr(_store, "MOST_BROADCAST", 0)
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "BLOCK_BYTES", bytes_)
    rows = corpus(12, groups=3, size=50) + [(999, "a b c", "en", "s")] * 2
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, N.near_duplicate_classes(df).collect()), key=str) == brute(rows)
    assert {r["doc_id"] for r in N.drop_near_duplicates(df).collect()} == {c for _, c in brute(rows)}


def test_odd_rows(spark):
    df = spark.createDataFrame(odd_rows(), DOCS).withColumnRenamed("lang", "bands").withColumnRenamed("source", "words_key")
    assert sorted(map(tuple, N.near_duplicate_classes(df).collect()), key=str) == brute(odd_rows())
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, None, 7, 8], key=str)
    assert N.near_duplicate_classes(df.limit(0)).count() == 0
    assert N.drop_near_duplicates(df.limit(0)).count() == 0


def test_one_of_each_class_stays(spark):
    rows = corpus(7)
    kept = {r["doc_id"] for r in N.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == {c for _, c in brute(rows)}


@pytest.mark.parametrize("weights", [(1, 1), (3, 1), (7, 5), (40, 33)])
def test_signatures_are_unbiased(weights):
    """Agreement of components over many pairs of bags is close to their weighted Jaccard similarity."""
    rng = np.random.default_rng(8)
    pairs, size = 60, 64
    agree, true = [], []
    for _ in range(pairs):
        common = rng.integers(0, 1 << 63, 30).astype(np.uint64)
        own = rng.integers(0, 1 << 63, 20).astype(np.uint64)
        a = {int(h): weights[0] for h in common} | {int(h): 2 for h in own[:10]}
        b = {int(h): weights[1] for h in common} | {int(h): 2 for h in own[10:]}
        text = np.repeat([0, 1], [len(a), len(b)])
        s = N.signatures(2, text, np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()]), size)
        agree.append((s[0] == s[1]).mean())
        true.append(similarity(Counter(a), Counter(b)))
    assert abs(np.mean(agree) - np.mean(true)) < 4 * np.sqrt(0.25 / (pairs * size))


def test_signature_doesnt_depend_on_the_batch():
    texts = [sentence(random.Random(i), 5 + 40 * i) for i in range(8)]
    together = N.signatures(8, *N.shingles(N.words(pa.array(texts))))
    for i, text in enumerate(texts):
        assert (N.signatures(1, *N.shingles(N.words(pa.array([text])))) == together[i]).all()


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in N.components(df).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in touched}
    assert N.components(df.where(F.lit(False))).count() == 0
