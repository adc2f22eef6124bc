import random

from corpus import DOCS, odd_rows, sentence

from lanewise.llm import license_scan as L


def brute(text, templates):
    w = L.template_words(text or "")
    out = []
    for name, template in templates.items():
        k, reach = L.reach_of(template)
        wanted = set(L.shingles_of(template))
        every = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]
        for a in range(0, len(every), reach):
            if len(wanted & set(every[a : a + 2 * reach])) * 5 >= len(wanted) * 4:
                out.append(name)
                break
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(80):
        parts = [sentence(rng, rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            words = rng.choice(list(L.TEMPLATES.values())).split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                words[rng.randrange(len(words))] = "other"
            parts += [rng.choice([str.upper, str])(" ".join(words)), sentence(rng, rng.randrange(0, 30))]
        texts.append(rng.choice([" ", "\n", " — "]).join(parts))
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + odd_rows()
    got = L.scan_licenses(spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "licenses").withColumnRenamed("source", "body"), ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["licenses"] == brute(r["text"], L.TEMPLATES), r["text"]
    assert sum(bool(r["licenses"]) for r in got) > 30


def test_anchors_hit_more_than_a_match_may_lack():
    words = set(L.anchors(L.TEMPLATES))
    for t in L.TEMPLATES.values():
        shingles = L.shingles_of(t)
        missed = sum(not words & {*s.split()} for s in shingles)
        assert missed * 5 < len(shingles) * 4  # those without an anchor alone are no match


def test_empty(spark):
    df = spark.createDataFrame(odd_rows(), DOCS)
    assert L.scan_licenses(df.limit(0), ["doc_id"]).count() == 0
    assert all(r["licenses"] == [] for r in L.scan_licenses(df, ["doc_id"], templates={"none": "..."}).collect())
    assert L.scan_licenses(df, ["doc_id"], templates={"t": "same words here"}).filter("size(licenses) = 1").count() == 3


def test_templates_as_a_table_and_odd_ones(spark):
    """Nulls, repeats and templates without a word are left out; the plan is the same for few templates and many."""
    table = spark.createDataFrame([("a", "one two three four five six"), ("a", "one two three four five six"), (None, "x"), ("n", None), ("none", "...")], "name string, text string")
    df = spark.createDataFrame([(1, "zero ONE two, three four five six seven"), (2, None), (3, "one two")], "doc_id long, text string").selectExpr("*", "'x' as row", "1 as body", "2 as k")
    got = L.scan_licenses(df, ["doc_id", "row", "body", "k"], templates=table)
    assert got.columns == ["doc_id", "row", "body", "k", "licenses"]
    assert {r["doc_id"]: r["licenses"] for r in got.collect()} == {1: ["a"], 2: [], 3: []}
    size = lambda n: len(L.scan_licenses(df, ["doc_id"], templates={f"t{i}": f"one two three four five w{i}" for i in range(n)})._jdf.queryExecution().optimizedPlan().toString())
    assert size(60) < 1.3 * size(3)


def test_joined_by_shuffles(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_BROADCAST", 0)
    texts = [f"before {L.TEMPLATES['mit']} after", L.TEMPLATES["isc"] * 2, "nothing"]
    got = L.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id", "text"]).collect()
    assert all(r["licenses"] == brute(r["text"], L.TEMPLATES) for r in got) and sum(bool(r["licenses"]) for r in got) == 2


def test_recall_of_the_bands(spark):
    """Windows that hold exactly the least share of a template, the rest of them unrelated words: the bands find all of them."""
    rng = random.Random(5)
    rows, expected = [], 0
    for name, template in L.TEMPLATES.items():
        words = L.template_words(template)
        wanted = L.shingles_of(template)
        if len(wanted) < 10:
            continue
        for _ in range(12):
            # Words are replaced from one end until the share would fall under the least.
            spoiled = list(words)
            for i in range(len(words) - 1, -1, -1):
                tried = spoiled[:i] + [f"z{rng.randrange(10**6)}"] + spoiled[i + 1 :]
                if len({*wanted} & {*L.shingles_of(" ".join(tried))}) * 5 < len(wanted) * 4:
                    break
                spoiled = tried
            rows.append((len(rows), f"{sentence(rng, rng.randrange(0, 300), 10**6)} {' '.join(spoiled)} {sentence(rng, rng.randrange(0, 300), 10**6)}", name))
    got = {r["doc_id"]: r["licenses"] for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, name string").repartition(4), ["doc_id"]).collect()}
    pairs = [(i, n) for i, text, _ in rows for n in brute(text, L.TEMPLATES)]
    expected = len(pairs)
    caught = sum(n in got[i] for i, n in pairs)
    print(f"recall of the bands: {caught} of {expected}")
    assert caught >= 0.999 * expected and expected >= len(rows)
    assert all(n in brute(rows[i][1], L.TEMPLATES) for i, names in got.items() for n in names)
