import random
from fractions import Fraction

from corpus import DOCS, odd_rows, sentence
from pyspark.sql import functions as F

from lanewise.llm import mixing as M


def poured(total, capacity, weight):
    """Shares by filling the children step by step."""
    share = {k: Fraction(0) for k in capacity}
    open_ = {k for k in capacity if capacity[k] > 0 and weight[k] > 0}
    left = Fraction(total)
    while open_ and left > 0:
        rate = left / sum(weight[k] for k in open_)
        full = {k for k in open_ if share[k] + rate * weight[k] >= capacity[k]}
        for k in full or open_:
            got = min(rate * weight[k], capacity[k] - share[k])
            share[k] += got
            left -= got
        open_ -= full
        if not full:
            break
    return share


def test_budgets(spark):
    rng = random.Random(1)
    leaves = [(f"d{d}", lang, f"s{s}", rng.choice([0, 5, 100, 3000])) for d in range(3) for lang in ("en", "de", None) for s in range(3)]
    weights = {"domain": {"d0": 5, "d1": 1, "d2": 2}, "language": {"en": 3, "": 2}, "source": {"s0": 0}}
    df = spark.createDataFrame(leaves, "domain string, language string, source string, tokens long")
    for share in (1, 3, 9, 20):
        got = {(r[0], r[1], r[2]): r["budget"] for r in M.allot(df, F.expr(f"sum(tokens) over () * {share} div 10"), weights, 2).collect()}
        w = lambda level, name: weights[level].get(name or "", 1)
        capacity = {x[:3]: x[3] * 2 * (w("source", x[2]) > 0) for x in leaves}
        total = sum(x[3] for x in leaves) * share // 10
        level, expected = {(): total}, {}
        for depth, name in enumerate(M.TREE):
            following = {}
            for parent, purse in level.items():
                children = sorted({k[: depth + 1] for k in capacity if k[:depth] == parent}, key=str)
                room = {c: sum(v for k, v in capacity.items() if k[: depth + 1] == c) for c in children}
                for c, s in poured(purse, room, {c: w(name, c[-1]) for c in children}).items():
                    following[c] = int(s + Fraction(1, 10**9))
            level = following
        expected = level
        assert all(abs(got[k] - expected[k]) <= 1 for k in expected), share
        assert all(got[k] <= capacity[k] for k in got)
        assert sum(got.values()) <= total


def docs(spark, n=300):
    rng = random.Random(2)
    rows = [(i, sentence(rng, rng.randrange(1, 40)), rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "src2", "other", None])) for i in range(n)]
    return rows, spark.createDataFrame(rows, DOCS)


def test_prefixes_of_seeded_epochs(spark):
    rows, df = docs(spark)
    taken = M.mix_sources(df, share=(3, 2), epochs=3).collect()
    again = M.mix_sources(df.repartition(7), share=(3, 2), epochs=3).collect()
    other = M.mix_sources(df, share=(1, 2), seed=18).collect()
    assert sorted(taken) == sorted(again) and len({r["doc_id"] for r in taken}) == len(taken)
    copies = {}
    for r in taken:
        copies.setdefault((r["lang"], r["source"]), []).append(r["copies"])
    assert all(max(c) - min(c) <= 1 and max(c) <= 3 for c in copies.values())
    total = sum(len(r[1].split()) for r in rows)
    got = sum(r["copies"] * len(r["text"].split()) for r in taken)
    assert total * 3 // 2 - 40 <= got <= total * 3 // 2 + 40 * len(copies)
    half = M.mix_sources(df, share=(1, 2)).collect()
    assert {r["doc_id"] for r in half} != {r["doc_id"] for r in other}


def test_odd_rows(spark):
    df = spark.createDataFrame(odd_rows(), DOCS).selectExpr("*", "5 as copies", "'a' as domain", "'b' as tokens", "1 as row", "2 as budget")
    got = M.mix_sources(df, share=(1, 1), epochs=1, copies="times")
    assert got.columns == [*df.columns, "times"]
    assert {r["doc_id"] for r in got.collect()} >= {5, 6, 7, 8, None}
    assert M.mix_sources(df.limit(0)).count() == 0
    assert M.mix_sources(df, weights={"source": {"src0": 0}}, epochs=1, share=(1, 1)).filter("source = 'src0'").count() == 0


def test_joined_by_shuffles(spark, monkeypatch):
    """The same where the plan has more leaves than are broadcast."""
    _, df = docs(spark)
    near = sorted(map(str, M.mix_sources(df, share=(3, 2), epochs=3).collect()))
    monkeypatch.setattr(M, "MOST_BROADCAST", 0)
    assert sorted(map(str, M.mix_sources(df, share=(3, 2), epochs=3).collect())) == near
