"""Benchmark decontamination by winnowing.

Every text is cut into words. Of the hashes of k = 5 consecutive words, each window of 6 such hashes (10 words) keeps its
least, the rightmost among equals; two texts that share 10 consecutive words keep the same hash there, so no shared span of
10 words or more goes unseen. The kept hashes of the documents are looked up among those of the benchmark, and each match is
extended to both sides, word by word, to the whole shared span. Items of fewer than 10 words are one window of their own and
are looked up by the hash of all their words.

Hashes only find the spans: the words of each are then compared byte by byte, so no collision of hashes makes a hit.

The benchmark's fingerprints are shared with all tasks only in portions of a bounded size (PORTION_BYTES of text); a larger
benchmark takes several passes over the documents, whose hits are united. The driver holds one portion at a time. Documents are
never shuffled in a single pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import checkpointed, free_name, written
from ._text import fold, grams, map_text, raw, winnow, words

K = 5
WINDOW = 10
#: Bytes of benchmark text whose fingerprints are shared with the tasks at a time.
PORTION_BYTES = 16 << 20
#: Matches that are extended at a time.
MATCHES = 1 << 20
_TOP = np.uint64((1 << 64) - 1)


@dataclass
class Index:
    """Fingerprints of benchmark items, sorted, each with the place (in ``hash``) of its first word."""

    names: list[str]
    hash: np.ndarray
    first: np.ndarray  # of the item that each word is in
    last: np.ndarray
    item: np.ndarray
    prints: np.ndarray
    places: np.ndarray
    sieve: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by number of words: sorted hashes, and the places
    folded: np.ndarray  # the bytes of all items, and where each word is in them
    start: np.ndarray
    size: np.ndarray


def _sieve(prints: np.ndarray) -> np.ndarray:
    sieve = np.zeros(1 << 22, bool)
    sieve[(prints >> np.uint64(42)).astype(np.int64)] = True
    return sieve


def build(names: list[str], texts: list[str]) -> Index:
    column = pa.array(texts, pa.large_string())
    w = words(column, places=True)
    counts = np.diff(w.bounds)
    prints, places = winnow(w.hash, w.text, K, WINDOW)
    order = np.argsort(prints, kind="stable")
    short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in {int(x) for x in counts if 0 < x < WINDOW}:
        at = w.bounds[:-1][counts == n]
        hashes = grams(w.hash, n)[at]
        by = np.argsort(hashes, kind="stable")
        short[n] = (hashes[by], at[by])
    return Index(names, w.hash, w.bounds[w.text], w.bounds[w.text + 1], w.text, prints[order], places[order], _sieve(prints), short, fold(raw(column)[0]), w.start, w.size)


def _pairs(found: np.ndarray, sorted_prints: np.ndarray, places: np.ndarray, at: np.ndarray):
    """(place in the documents, place in the benchmark) of equal hashes, MATCHES or a few more at a time."""
    low, high = np.searchsorted(sorted_prints, found, "left"), np.searchsorted(sorted_prints, found, "right")
    hit = high > low
    low, counts, at = low[hit], (high - low)[hit], at[hit]
    ends = np.cumsum(counts)
    begin = 0
    while begin < len(at):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + MATCHES, "right")))
        n = counts[begin:end]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(at[begin:end], n), places[np.repeat(low[begin:end], n) + offset]
        begin = end


def scan(column: pa.Array, index: Index) -> tuple[np.ndarray, np.ndarray, list[dict[int, None] | set]]:
    """For a column of texts: bounds of the words of each, whether each word is hit, and the items that occur in each text."""
    w = words(column, places=True)
    data = raw(column)[0]
    n = len(w.hash)
    edge = np.zeros(n + 1, np.int64)  # +1 where a hit span begins, -1 after its end
    items: list[set] = [set() for _ in range(len(column))]

    def note(first: np.ndarray, last: np.ndarray, place: np.ndarray, least: int) -> None:
        for begin, end, there in _exact(w, data, index, first, last, place, least):
            np.add.at(edge, begin, 1)
            np.add.at(edge, end, -1)
            for t, i in np.unique(np.stack([w.text[begin], index.item[there]]), axis=1).T.tolist():
                items[t].add(i)

    prints, places = winnow(w.hash, w.text, K, WINDOW)
    maybe = index.sieve[(prints >> np.uint64(42)).astype(np.int64)]
    for d, b in _pairs(prints[maybe], index.prints, index.places, places[maybe]):
        left, right = _extend(w, index, d, b)
        long = right - left >= WINDOW
        # One span is found once for each of its fingerprints.
        spans = np.unique(np.stack([left[long], right[long], (b - d + left)[long]]), axis=1)
        note(spans[0], spans[1], spans[2], WINDOW)
    for size, (hashes, at) in index.short.items():
        g = grams(w.hash, size)
        whole = np.flatnonzero(w.text[: len(g)] == w.text[size - 1 :]) if len(g) else np.zeros(0, np.int64)
        for d, b in _pairs(g[whole], hashes, at, whole):
            note(d, d + size, b, size)
    return w.bounds, np.cumsum(edge[:n]) > 0, items


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each run, one after the other."""
    return np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)


def _exact(w, data: np.ndarray, index: Index, first: np.ndarray, last: np.ndarray, place: np.ndarray, least: int):
    """The parts of the spans whose words are the item's, byte by byte, if they have ``least`` words: (first, end, place), some spans at a time."""
    ends = np.cumsum(last - first)
    begin = 0
    while begin < len(first):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + MATCHES, "right")))
        n = (last - first)[begin:end]
        here, there = _runs(first[begin:end], n), _runs(place[begin:end], n)
        equal = w.size[here] == index.size[there]
        same = np.flatnonzero(equal)
        size = w.size[here[same]]
        bytes_here, bytes_there = data[_runs(w.start[here[same]], size)], index.folded[_runs(index.start[there[same]], size)]
        if len(same):
            equal[same] = np.logical_and.reduceat(fold(bytes_here) == bytes_there, np.cumsum(size) - size)
        if equal.all():
            yield first[begin:end], last[begin:end], place[begin:end]
        else:  # words of equal hashes that differ: the runs between them
            span = np.repeat(np.arange(len(n)), n)
            new = equal & np.concatenate([[True], ~equal[:-1] | (span[1:] != span[:-1])])
            stop = equal & np.concatenate([~equal[1:] | (span[1:] != span[:-1]), [True]])
            start, size = np.flatnonzero(new), np.flatnonzero(stop) - np.flatnonzero(new) + 1
            start, size = start[size >= least], size[size >= least]
            yield here[start], here[start] + size, there[start]
        begin = end


def _extend(w, index: Index, d: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole shared spans around matches of K words: first word and end in the documents."""
    low, high = w.bounds[w.text[d]], w.bounds[w.text[d] + 1]
    left, live = d.copy(), np.arange(len(d))
    while len(live):
        at, there = left[live] - 1, b[live] - d[live] + left[live] - 1
        inside = (at >= low[live]) & (there >= index.first[b[live]])
        live, at, there = live[inside], at[inside], there[inside]
        equal = w.hash[at] == index.hash[there]
        live = live[equal]
        left[live] -= 1
    right, live = d.copy(), np.arange(len(d))
    while len(live):
        at, there = right[live], b[live] - d[live] + right[live]
        inside = (at < high[live]) & (there < index.last[b[live]])
        live, at, there = live[inside], at[inside], there[inside]
        equal = w.hash[at] == index.hash[there]
        live = live[equal]
        right[live] += 1
    return left, right


def portions(benchmark: DataFrame, key: str, text: str, portion_bytes: int) -> Iterator[tuple[int, Index]]:
    """How many indexes there are over the items, and each, of a bounded size; rows whose id or text is null have no part in them.

    An item of more than ``portion_bytes`` is in one whole.
    """
    rows = benchmark.select(benchmark[f"`{key}`"].cast("string").alias("k"), benchmark[f"`{text}`"].alias("t")).filter("k is not null and t is not null")
    size = rows.agg(F.sum(F.octet_length("t")).alias("s")).first()["s"] or 0
    many = -(-2 * size // portion_bytes) if size > portion_bytes else 1
    for part in range(many):
        table = rows.filter(F.pmod(F.xxhash64("k", "t"), F.lit(many)) == part).toArrow().sort_by([("k", "ascending"), ("t", "ascending")])
        yield many, build(table["k"].to_pylist(), table["t"].to_pylist())


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def contamination(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_text: str = "text", item: str = "item_id", portion_bytes: int = PORTION_BYTES, prefix: str = ""
) -> DataFrame:
    """Columns ``keep`` of docs with n_words, n_hit, n_items (long), items (sorted ids as strings) and contaminated, named with ``prefix``.

    A null or empty text has no words. Items that share an id count once. An empty benchmark hits nothing, an empty table of docs
    gives an empty table. Repeated rows of docs each give a row. A very long text is searched whole, by one task. docs may have any
    other columns; the result's own names should get a ``prefix`` if they are among ``keep``.
    """
    session = docs.sparkSession
    kinds = {"n_words": T.LongType(), "n_hit": T.LongType(), "n_items": T.LongType(), "items": T.ArrayType(T.StringType()), "contaminated": T.BooleanType()}
    fields = [T.StructField(f"{prefix}{name}", kind) for name, kind in kinds.items()]
    indexes = portions(benchmark, item, item_text, portion_bytes)
    many, only = next(indexes)
    if many == 1:
        shared = session.sparkContext.broadcast(only)

        def work():
            index = shared.value

            def compute(column: pa.Array) -> list:
                bounds, hit, items = scan(column, index)
                hits = np.add.reduceat(np.append(hit, False), bounds[:-1], dtype=np.int64) * (np.diff(bounds) > 0)
                names = [sorted({index.names[i] for i in x}) for x in items]
                return [np.diff(bounds).astype(np.int64), hits, np.array([len(x) for x in names], np.int64), pa.array(names, pa.list_(pa.string())), hits > 0]

            return compute

        return map_text(docs, text, keep, fields, work)
    # Several portions: each pass gives the places that it finds, and is written before the next portion is built.
    row = free_name(docs, "row")
    rows = checkpointed(docs.withColumn(row, F.monotonically_increasing_id()))
    spans = [T.StructField("words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("found", T.ArrayType(T.StringType()))]
    found = None
    for _, index in chain([(many, only)], indexes):
        shared = session.sparkContext.broadcast(index)

        def work(shared=shared):
            index = shared.value

            def compute(column: pa.Array) -> list:
                bounds, hit, items = scan(column, index)
                places = [np.flatnonzero(hit[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                return [np.diff(bounds).astype(np.int64), pa.array([p.tolist() for p in places], pa.list_(pa.int64())), pa.array([sorted({index.names[i] for i in x}) for x in items], pa.list_(pa.string()))]

            return compute

        part = map_text(rows, text, [row], spans, work)
        part = written(part if found is None else part.filter("size(found) > 0"), "portion")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    del only
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    united = found.groupBy(row).agg(F.max("words").alias("n_words"), F.size(union("spans")).cast("long").alias("n_hit"), union("found").alias("items"))
    united = united.select(row, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))
    left = rows.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), row)
    return left.join(united, row).select("kept.*", *[F.col(c).alias(f"{prefix}{c}") for c in kinds])
