import random

import pyarrow as pa
import pytest
from corpus import DOCS, odd_rows
from pyspark.sql import functions as F

from lanewise.llm import language as L
from lanewise.llm.queries import op5_language_id

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def found(spark):
    return op5_language_id(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()


def test_held_out_accuracy(found):
    held = [r for r in found if r["held_out"]]
    assert 150 < len(held) < 350
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_clean_documents_are_kept(found):
    assert sum(r["rejected"] for r in found) <= 0.005 * len(found)


def test_calibration(found):
    """The mean score is near the share of right answers."""
    assert abs(sum(r["score"] for r in found) / len(found) - sum(r["lang"] == r["lang_pred"] for r in found) / len(found)) < 0.03


def test_odd_rows(spark):
    model = L.train(["the cat sat on the mat and that was that " * 5, "der hund und die katze sind nicht im haus " * 5] * 20, ["en", "de"] * 20)
    df = spark.createDataFrame(odd_rows(), DOCS).withColumnRenamed("lang", "lang_pred").withColumnRenamed("source", "rejected")
    out = L.identify(df, model, df.columns, prefix="p_").collect()
    assert len(out) == len(odd_rows())
    for r in out:
        assert (r["p_lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3, 4)), r
        assert r["p_rejected"] or r["p_lang_pred"] in ("en", "de")
    assert L.identify(df.limit(0), model, ["doc_id"]).count() == 0
    names, score = model.predict(pa.array(["the cat on that mat", "die katze und der hund", "123", None, "ж"]))
    assert names[:4] == ["en", "de", "und", "und"] and names[4] in ("en", "de") and list(score[2:4]) == [0, 0]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame(odd_rows(), DOCS)
    for labelled in (df.limit(0), df.withColumn("lang", F.lit(None).cast("string")), df.withColumn("lang", F.lit("en"))):
        model = L.fit(labelled)
        assert L.identify(df, model, ["doc_id"]).count() == len(odd_rows())


def test_sample_is_bounded_and_doesnt_depend_on_partitions(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "train", lambda texts, labels, seed: seen.append((texts, labels)))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    L.fit(docs, sample=20)
    L.fit(docs.repartition(7), sample=20)
    assert seen[0] == seen[1]
    assert all(seen[0][1].count(x) == 20 for x in set(seen[0][1]))


@pytest.mark.parametrize("size", [2, 5, 10])
def test_every_language_is_trained_and_kept_back(size):
    """Also where the rows run label by label and their number is a multiple of the share that is kept back."""
    names = [chr(ord("a") + i) for i in range(size)]
    own = {x: " ".join(x + y + x for y in "aeioub") + " " for x in names}
    model = L.train([own[x] * 4 for _ in range(40) for x in names], names * 40)
    found, _ = model.predict(pa.array([own[x] for x in names]))
    assert found == names and model.accuracy > 0.9 and model.floor > 0


@pytest.mark.parametrize("languages", [("en", "de"), ("de", "en", "es", "fr")])
def test_foreign_and_shuffled_texts_are_rejected(spark, languages):
    rng = random.Random(1)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter(F.col("lang").isin(*languages) & F.col("text").isNotNull())
    model = L.fit(docs.filter("doc_id % 2 = 0"))
    clean = [r["text"] for r in docs.filter("doc_id % 2 = 1").select("text").collect() if L._letter.search(r["text"])]
    shuffled = ["".join(rng.sample(t[:600], len(t[:600]))) for t in clean if len(t) > 300][:50]
    odd = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)) for _ in range(10)]
    odd += ["Съешь же ещё этих мягких французских булок да выпей чаю", "Pchnąć w tę łódź jeża lub ośm skrzyń fig i dodać do tego trochę mąki"]
    assert model.judge(pa.array(odd))[2].all()
    assert model.judge(pa.array(shuffled))[2].mean() >= 0.95
    assert model.judge(pa.array(clean))[2].mean() <= 0.002


def test_excerpts_come_from_the_whole_of_a_long_text(spark, monkeypatch):
    """No more than MAX_BYTES characters of a text are collected, from places all over it."""
    seen = []
    monkeypatch.setattr(L, "train", lambda texts, labels, seed: seen.extend(texts))
    long = "".join(f"{i:09d} " for i in range(40_000))
    L.fit(spark.createDataFrame([(1, long, "en"), (2, long[: L.MAX_BYTES], "de")], "doc_id long, text string, lang string"))
    assert seen[0] == long[: L.MAX_BYTES]
    excerpts = seen[1].split("\n")
    one, size = L.MAX_BYTES // L.EXCERPTS, len(long) // L.EXCERPTS
    assert [len(x) for x in excerpts] == [one] * L.EXCERPTS
    assert all(i * size <= long.index(x) <= (i + 1) * size - one for i, x in enumerate(excerpts))


def test_training_sees_what_follows_a_long_prefix(spark):
    """Texts of more than 100 000 characters that turn to another spelling after the first 20 000."""
    rng = random.Random(3)
    make = lambda letters, n: " ".join("".join(rng.choices(letters, k=4)) for _ in range(n))
    rows = [(i, make("abc", 4000) + " " + make("uvw" if i % 2 else "xyz", 20_000), "u" if i % 2 else "x") for i in range(40)]
    assert min(len(r[1]) for r in rows) > 100_000
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    assert model.predict(pa.array([make("uvw", 50), make("xyz", 50)]))[0] == ["u", "x"]


def test_many_labels(spark, monkeypatch):
    """More labels than dimensions, each of few rows; beyond LANGUAGES the rarest aren't learned."""
    rng = random.Random(4)
    own = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(1500)]
    rows = [(8 * i + j, " ".join([own[i]] * 8), f"l{i:04d}") for i in range(1500) for j in range(7)]
    seen = []
    real = L.train
    monkeypatch.setattr(L, "train", lambda texts, labels, seed: seen.extend(labels) or real(texts, labels, seed, rounds=1))
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 1500 and len(seen) <= L.ROWS and model.table.shape == (L.DIMENSION, L.BUCKETS)
    names, score = model.predict(pa.array([r[1] for r in rows[:50]] + [None]))
    assert names[-1] == "und" and all(0 <= x <= 1 for x in score) and {*names[:-1]} <= {*model.languages}
    monkeypatch.setattr(L, "LANGUAGES", 3)
    assert L.fit(spark.createDataFrame([*rows, (0, "more", "l0007"), (1, "more", "l0009")], "doc_id long, text string, lang string")).languages == ["l0000", "l0007", "l0009"]


def test_more_languages_than_dimensions_are_told_apart():
    names = [f"l{i:02d}" for i in range(30)]
    rng = random.Random(5)
    own = {x: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzéüßж", k=5)) for _ in range(6)) + " " for x in names}
    model = L.train([own[x] * 6 for _ in range(30) for x in names], names * 30, rounds=6)
    assert model.head is not None and model.predict(pa.array([own[x] * 3 for x in names]))[0] == names


def test_gradients_against_finite_differences():
    import numpy as np

    rng = np.random.default_rng(6)
    mean, linear, bias, target = rng.normal(size=(7, 4)), rng.normal(size=(4, 3)), rng.normal(size=3), rng.integers(0, 3, 7)

    def loss():
        z = mean @ linear + bias
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(7), target]).mean())

    for values, found in zip((mean, linear, bias), L.gradients(mean, linear, bias, target), strict=True):
        for at in np.ndindex(values.shape):
            kept = values[at]
            sides = []
            for step in (1e-6, -1e-6):
                values[at] = kept + step
                sides.append(loss())
            values[at] = kept
            assert abs((sides[0] - sides[1]) / 2e-6 - found[at]) < 1e-6


def test_long_texts_in_slices(monkeypatch):
    model = L.train(["the cat sat on the mat and that was that " * 5, "der hund und die katze sind nicht im haus " * 5] * 20, ["en", "de"] * 20)
    column = pa.array(["the cat and the mat " * 9, None, "", "die katze " * 30, "x", "é"])
    whole = model.logits(column)[0]
    monkeypatch.setattr(L, "LETTERS", 13)
    assert abs(model.logits(column)[0] - whole).max() < 1e-6


def test_held_out_texts_dont_leak(spark, tmp_path):
    """Other texts, languages and sources of held-out documents change no prediction of the rest."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.coalesce(L.fold("doc_id") == 2, F.lit(False))
    other = docs.withColumn("text", F.when(held, F.reverse("text")).otherwise(F.col("text"))).withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    other.write.parquet(str(tmp_path / "documents.parquet"))
    first, second = (op5_language_id(spark, f).filter("not held_out").orderBy("doc_id").collect() for f in ("/root/testdata/sf0.001", str(tmp_path)))
    assert first == second and len(first) > 100


def test_sample_is_full_where_most_texts_are_null_or_keys_alike(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "train", lambda texts, labels, seed: seen.extend(labels))
    rows = [(i, f"text {i}" if i % 100 == 0 else None, "nulls") for i in range(4000)] + [(7, f"same {i}", "alike") for i in range(300)] + [(i, f"few {i}", "few") for i in range(5)]
    L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=20)
    assert {x: seen.count(x) for x in seen} == {"nulls": 20, "alike": 20, "few": 5}


def test_predictions_dont_depend_on_neighbours():
    model = L.train(["the cat sat on the mat and that was that " * 5, "der hund und die katze sind nicht im haus " * 5] * 20, ["en", "de"] * 20)
    texts = ["the cat", None, "", "die katze und", "x", "é", "zq", "the mat the hat"]
    together = model.judge(pa.array(texts))
    for i, text in enumerate(texts):
        alone = model.judge(pa.array([text], pa.string()))
        assert [x[0] for x in alone] == [x[i] for x in together]
