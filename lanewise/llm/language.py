"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is a sequence of letters with one space for each run of anything else; its subwords are the 2, 3 and 4 bytes from each
place on, hashed to BUCKETS. A text's vector is the mean of its subwords' embeddings, its classes the softmax of a linear map of
that. Embeddings and map are trained by stochastic gradient descent in numpy on pieces of labelled texts. As the model is
linear up to the softmax, prediction needs only a table of BUCKETS x languages.

Scores are calibrated with a temperature that fits texts kept back from training; a score under ``floor`` is a rejection.
The floor is such that of the right answers on those texts hardly any is rejected. As the best of few languages always scores high, a
text is rejected too if its subwords are unfamiliar: if their mean log frequency in training lies under a bound. For texts under PIECE
letters that is where 99 % of the pieces kept back lie under with their letters shuffled; for longer ones, whose means vary less, a
quarter of the way from there to where 99 % of the pieces themselves lie over (if these are apart; else there is no bound). Texts
under a quarter of PIECE are judged by score alone, and a language that is spelled much like a learned one isn't told from it.

Training reads a bounded sample of labelled rows: those of the least seeded hash, SAMPLE for each language at most and ROWS in all
(so fewer for each of many languages), of the LANGUAGES most frequent labels. Of a row it reads MAX_BYTES characters: a longer text
gives EXCERPTS excerpts, each from a seeded place in its own part of the whole text, cut out before anything is collected. So the
driver gets ROWS * MAX_BYTES characters at most. Prediction reads whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import map_text, mix, raw

#: Rows sampled for each language and in all, labels that are learned, characters of each row.
SAMPLE = 500
ROWS = 10_000
LANGUAGES = 5000
MAX_BYTES = 2000
#: Parts of a longer text, each of which gives one excerpt.
EXCERPTS = 8
#: Letters whose logits are summed at a time.
LETTERS = 1 << 20
STEPS = 1 << 16
BUCKETS = 1 << 15
ORDERS = (2, 3, 4)
ENDS = max(ORDERS) - 1
DIMENSION = 16
PIECE = 240
UNKNOWN = "und"

_letters = np.zeros(256, np.uint8)
_letters[0x41:0x5B] = np.arange(0x61, 0x7B)
_letters[0x61:0x7B] = np.arange(0x61, 0x7B)
_letters[0x80:] = np.arange(0x80, 0x100)
_letter = re.compile(r"[^\W\d_]")


def stream(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters in lower case, 0 for each run of others, and a 0 at the end of each text; where each text begins, and the end.

    ENDS more 0 follow each text, so that none of its subwords reaches into the next one.
    """
    low = _letters[data]
    if len(data):  # Latin capitals of two bytes
        second = np.zeros(len(data), bool)
        second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[second] += 0x20
    out = np.insert(low, np.repeat(at[1:], ENDS + 1), 0)
    shifted = at + np.arange(len(at)) * (ENDS + 1)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    for i in range(1, ENDS + 2):
        keep[shifted[1:] - i] = True
    sizes = np.add.reduceat(keep, shifted[:-1], dtype=np.int64) if len(out) else np.zeros(0, np.int64)
    return out[keep], np.concatenate([[0], np.cumsum(sizes)])


def subwords(letters: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the ``order`` bytes from each place on; the stream is taken to go on with 0."""
    code = np.zeros(len(letters), np.uint64)
    padded = np.concatenate([letters, np.zeros(order, np.uint8)])
    for i in range(order):
        code = (code << np.uint64(8)) | padded[i : i + len(letters)]
    return (mix(code + np.uint64(order << 40)) >> np.uint64(64 - 15)).astype(np.int32)


@dataclass
class Model:
    """``table`` has a row of BUCKETS numbers for each language, or for each dimension of the embeddings; ``head`` leads from these to languages.

    Numbers of subwords are whole multiples of 1 / STEPS, so that their sums are exact and don't depend on how texts are dealt out.
    """

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    heat: float = 1.0
    floor: float = 0.0
    accuracy: float = field(default=float("nan"))
    common: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))  # log frequency of each subword, 0 if all were alike
    least: float = float("-inf")
    least_short: float = float("-inf")  # for texts under PIECE letters
    head: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.table = np.rint(self.table.astype(np.float64) * STEPS) / STEPS

    def logits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The logits of each text, and whether its subwords are unfamiliar."""
        letters, at = stream(*raw(column))
        # One more column of 0 for the ends of texts, which aren't subwords.
        rows = np.concatenate([np.concatenate([self.table, self.common[None, :]]), np.zeros((len(self.table) + 1, 1))], axis=1)
        total = np.zeros((len(rows), len(column)))
        ends = np.sort((at[1:, None] - np.arange(1, ENDS + 1)).ravel())
        for begin in range(0, len(letters), LETTERS):
            end = min(begin + LETTERS, len(letters))
            first, last = int(np.searchsorted(at, begin, "right")) - 1, int(np.searchsorted(at, end, "left"))
            edges = np.maximum(at[first:last] - begin, 0)
            outside = ends[np.searchsorted(ends, begin) : np.searchsorted(ends, end)] - begin
            for order in ORDERS:
                bucket = subwords(letters[begin : end + order - 1], order)[: end - begin]
                bucket[outside] = BUCKETS
                for i, row in enumerate(rows):
                    total[i, first:last] += np.add.reduceat(row[bucket], edges)
        size = np.diff(at) - ENDS
        total, known = total[:-1], total[-1]
        far = (known / (len(ORDERS) * size) < np.where(size < PIECE, self.least_short, self.least)) & (size >= PIECE // 4)
        mean = (total / (len(ORDERS) * size)).T
        return (mean if self.head is None else mean @ self.head) + self.bias, far

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """A language for each text (``und`` for null, or without a letter) and its calibrated score (then 0)."""
        return self.judge(column)[:2]

    def judge(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """As ``predict``, and whether each text is rejected."""
        z, far = self.logits(column)
        p = softmax(z * self.heat)
        best = p.argmax(axis=1)
        score = p[np.arange(len(p)), best]
        names = [self.languages[i] for i in best]
        data, at = raw(column)
        letters = np.append((_letters[data] != 0) & (data < 0x80), False)
        for i in np.flatnonzero(~np.logical_or.reduceat(letters, at[:-1]) | (np.diff(at) == 0)) if len(column) else ():
            if not _letter.search(column[i].as_py() or ""):
                names[i], score[i] = UNKNOWN, 0.0
        return names, score, far | (score < self.floor) | np.array([x == UNKNOWN for x in names], bool)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def gradients(mean: np.ndarray, linear: np.ndarray, bias: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the mean cross-entropy of a batch with respect to the pieces' vectors, the map and the bias."""
    p = softmax(mean @ linear + bias)
    p[np.arange(len(target)), target] -= 1
    p /= len(target)
    return p @ linear.T, mean.T @ p, p.sum(axis=0)


def train(texts: list[str], labels: list[str], seed: int = 5, rounds: int = 3, rate: float = 0.5) -> Model:
    """A model from labelled texts; every fifth text of each language is kept back for calibration."""
    languages = sorted(set(labels))
    number = {x: i for i, x in enumerate(languages)}
    size = len(languages)
    if size < 2:
        return Model(languages, np.zeros((size, BUCKETS), np.float32), np.zeros(size))
    random, shuffling = np.random.default_rng(seed), np.random.default_rng(seed + 1)
    noise: list[np.ndarray] = []
    pieces: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    classes: tuple[list[int], list[int]] = ([], [])
    seen = dict.fromkeys(languages, 0)
    for text, label in zip(texts, labels, strict=True):
        kept_back = seen[label] % 5 == 4
        seen[label] += 1
        letters = stream(*raw(pa.array([text], pa.large_string())))[0][:-ENDS]
        starts = np.arange(0, len(letters), PIECE)
        if len(starts) * PIECE > MAX_BYTES:
            starts = np.sort(random.choice(starts, MAX_BYTES // PIECE, replace=False))
        for s in starts:
            piece = letters[s : s + int(random.integers(PIECE // 8, PIECE + 1))]
            if (piece != 0).sum() >= 3:
                pieces[kept_back].append(np.concatenate([subwords(piece, order) for order in ORDERS]).astype(np.uint16))
                classes[kept_back].append(number[label])
                if kept_back:
                    noise.append(np.concatenate([subwords(shuffling.permutation(piece), order) for order in ORDERS]))
    if not pieces[0]:
        return Model(languages, np.zeros((size, BUCKETS), np.float32), np.zeros(size))
    embedding = random.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    linear = np.zeros((DIMENSION, size), np.float32)
    bias = np.zeros(size, np.float32)
    target = np.array(classes[0])
    steps, batch = 0, 32
    total = rounds * -(-len(target) // batch)
    for _ in range(rounds):
        order = random.permutation(len(target))
        for first in range(0, len(order), batch):
            take = order[first : first + batch]
            ids = np.concatenate([pieces[0][i] for i in take])
            lengths = np.array([len(pieces[0][i]) for i in take])
            begin = np.cumsum(lengths) - lengths
            mean = np.add.reduceat(embedding[ids], begin, axis=0) / lengths[:, None]
            by_mean, by_linear, by_bias = gradients(mean, linear, bias, target[take])
            step = np.float32(rate * (1 - steps / total))
            # Each piece spreads its gradient over its subwords; the mean makes it small, so embeddings take longer steps.
            spread = by_mean.astype(np.float32) * (step * len(take) / 4)
            np.subtract.at(embedding, ids, np.repeat(spread, lengths, axis=0))
            linear -= step * by_linear.astype(np.float32)
            bias -= step * by_bias.astype(np.float32)
            steps += 1
    if size <= DIMENSION:
        model = Model(languages, np.ascontiguousarray((embedding @ linear).T), bias.astype(np.float64))
    else:
        model = Model(languages, np.ascontiguousarray(embedding.T), bias.astype(np.float64), head=linear.astype(np.float64))
    seen_often = sum((np.bincount(p, minlength=BUCKETS) for p in pieces[0]), np.zeros(BUCKETS)) + 0.5
    model.common = np.rint(np.log(seen_often / seen_often.mean()) * STEPS) / STEPS
    long = [i for i, p in enumerate(pieces[1]) if len(p) >= len(ORDERS) * (PIECE // 8)]
    if long:
        clean, odd = (np.array([model.common[x[i]].mean() for i in long]) for x in (pieces[1], noise))
        low, high = np.quantile(clean, 0.01), np.quantile(odd, 0.99)
        if high < low:
            model.least_short, model.least = float(high), float(high + (low - high) / 4)
    return _calibrated(model, pieces[1], np.array(classes[1], int))


def _calibrated(model: Model, pieces: list[np.ndarray], target: np.ndarray) -> Model:
    if not pieces:
        return model
    z = np.stack([model.table[:, p].mean(axis=1) for p in pieces])
    z = (z if model.head is None else z @ model.head) + model.bias

    def chances(heat: float) -> np.ndarray:
        return softmax(heat * z)

    rows = np.arange(len(target))
    heats = np.geomspace(0.25, 64, 60)
    model.heat = float(heats[np.argmin([-np.log(chances(h)[rows, target] + 1e-12).mean() for h in heats])])
    p = chances(model.heat)
    best = p.argmax(axis=1)
    right = p[rows, best][best == target]
    model.accuracy = float((best == target).mean())
    # Half the score under which one right answer in a thousand lies: a rejection has to be far out.
    model.floor = float(min(0.5, np.quantile(right, 0.001) / 2)) if len(right) else 0.0
    return model


def _spread(text: str, at: str, seed: int) -> Column:
    """A text of up to MAX_BYTES characters, or of a longer one EXCERPTS excerpts, each from a seeded place in its own part of the whole."""
    size, one = f"(length({text}) div {EXCERPTS})", MAX_BYTES // EXCERPTS
    place = f"i * {size} + pmod(xxhash64({seed}, {at}, i), {size} - {one} + 1)"
    excerpts = f"transform(sequence(0, {EXCERPTS - 1}), i -> substring({text}, cast({place} as int) + 1, {one}))"
    return F.expr(f"if(length({text}) <= {MAX_BYTES}, {text}, array_join({excerpts}, '\\n'))")


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample: int = SAMPLE, seed: int = 5) -> Model:
    """A model from at most ``sample`` rows for each label, and ROWS in all; rows with a null text or label are left out.

    Which rows are taken depends on ids and texts alone. Labels beyond the LANGUAGES most frequent ones (of ties the first by name)
    aren't learned. Null keys and repeated rows are rows like others. An empty table gives a model without languages.
    """
    col = lambda c: F.col(f"`{c}`")
    rows = labelled.filter(col(label).isNotNull() & col(text).isNotNull())
    labels = rows.groupBy(col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r["label"]: r["n"] for r in labels.orderBy(F.desc("n"), "label").limit(LANGUAGES).collect()}
    if not counts:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    sample = min(sample, max(1, ROWS // len(counts)))
    at = F.xxhash64(F.lit(seed), col(key))
    by = Window.partitionBy("label").orderBy("at", F.md5("text"))

    def drawn(shares: dict[str, float]) -> pa.Table:
        share = labelled.sparkSession.createDataFrame(list(shares.items()), "label string, share double")
        some = rows.select(col(label).cast("string").alias("label"), col(text).alias("text"), at.alias("at")).join(F.broadcast(share), "label")
        some = some.filter(F.pmod("at", F.lit(1 << 20)) / float(1 << 20) < F.col("share"))
        return some.withColumn("n", F.row_number().over(by)).filter(f"n <= {sample}").select("label", "n", _spread("text", "at", seed).alias("text")).toArrow()

    # A share of hash values that holds about twice the sample; the rest of the way is a window over those few rows.
    table = drawn({name: min(1.0, 2.0 * sample / n) for name, n in counts.items()})
    have = Counter(table["label"].to_pylist())
    short = {name: 1.0 for name, n in counts.items() if have[name] < min(sample, n)}
    if short:  # few of its keys, or unlucky ones
        enough = pa.compute.invert(pa.compute.is_in(table["label"], pa.array(list(short), table.schema.field("label").type)))
        table = pa.concat_tables([table.filter(enough), drawn(short)])
    table = table.sort_by([("n", "ascending"), ("label", "ascending")])
    return train(table["text"].to_pylist(), table["label"].to_pylist(), seed)


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text", prefix: str = "") -> DataFrame:
    """Columns ``keep`` with lang_pred, score (0 to 1) and rejected (``und``, a score under the model's floor, or unfamiliar), named with ``prefix``.

    Null texts and texts without a letter are ``und`` with score 0, and so are all texts if no language was learned. Repeated rows
    each give a row; an empty table gives an empty table. A very long text is read whole, by one task. docs may have any other
    columns; the result's own names should get a ``prefix`` if they are among ``keep``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        model = shared.value

        def compute(column: pa.Array) -> list:
            if not model.languages:
                return [pa.array([UNKNOWN] * len(column)), np.zeros(len(column)), np.ones(len(column), bool)]
            names, score, rejected = model.judge(column)
            return [pa.array(names, pa.string()), score, rejected]

        return compute

    return map_text(docs, text, keep, [T.StructField(f"{prefix}lang_pred", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType()), T.StructField(f"{prefix}rejected", T.BooleanType())], work)


def fold(key: str, folds: int = 4):
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.crc32(F.col(f"`{key}`").cast("string")) % folds
