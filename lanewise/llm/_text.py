"""Words of whole Arrow batches with numpy.

A word is a longest run of bytes that are digits, letters, or part of a character beyond ASCII; A-Z count as a-z.
All characters beyond ASCII consist of bytes from 0x80 in UTF-8, so working on bytes gives the same words as the pattern
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` on the lower-cased text. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._store import shipped

#: Bytes of text that are handled at a time; a longer text is handled alone. Its words are found in slices of that size, so what it
#: needs besides itself is about 10 bytes for each of its words (more in operators that keep more for each word).
SLICE_BYTES = 1 << 20
#: Bytes from which a word is hashed on its own.
LONG_WORD = 512

_U = np.uint64
_fold = np.zeros(256, np.uint8)
_fold[0x30:0x3A] = np.arange(0x30, 0x3A)
_fold[0x41:0x5B] = np.arange(0x61, 0x7B)
_fold[0x61:0x7B] = np.arange(0x61, 0x7B)
_fold[0x80:] = np.arange(0x80, 0x100)
_low_bytes = np.array([(1 << 8 * i) - 1 for i in range(9)], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on all input bits."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins, with the end; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """``hash`` of each word; those of text i are ``bounds[i]:bounds[i + 1]``; ``text`` is the text each word is in.

    ``start`` and ``size``, if asked for, are the place of each word in the bytes of all texts, and its bytes.
    """

    hash: np.ndarray
    bounds: np.ndarray
    text: np.ndarray
    start: np.ndarray | None = None
    size: np.ndarray | None = None


def hashes(folded: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each word of folded bytes: eight bytes at a time, with a finaliser after each, so that no sum of them can cancel out."""
    padded = np.zeros(len(folded) + 8, np.uint8)
    padded[: len(folded)] = folded
    eight = np.ndarray((len(folded) + 1,), "<u8", padded.data, strides=(1,))
    out = mix(size.astype(_U) * _U(0x9E6C63D0876A9A47) + _U(1))
    live, at = np.flatnonzero((size > 0) & (size < LONG_WORD)), 0
    while len(live):
        chunk = eight[start[live] + at] & _low_bytes[np.minimum(size[live] - at, 8)]
        out[live] = mix(out[live] ^ chunk)
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size >= LONG_WORD).tolist():
        word = folded[start[i] : start[i] + size[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return out


def fold(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z, and 0 for those that aren't in a word."""
    return _fold[data]


def _cut(data: np.ndarray, fold: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of about SLICE_BYTES that no word reaches out of."""
    begin, n = 0, len(data)
    while begin < n:
        end = min(n, begin + SLICE_BYTES)
        while end < n:
            outside = np.flatnonzero(fold[data[end : end + 4096]] == 0)
            if len(outside):
                end += int(outside[0])
                break
            end = min(n, end + 4096)
        yield begin, end
        begin = end


def words(column: pa.Array, places: bool = False, folding: np.ndarray = _fold) -> Words:
    """All words of a column of texts, in order. ``folding`` has for each byte what it counts as in a word, 0 if it is in none."""
    data, at = raw(column)
    starts, sizes, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    for begin, end in _cut(data, folding):
        folded = folding[data[begin:end]]
        first = np.zeros(end - begin + 1, bool)  # where a text begins
        first[at[np.searchsorted(at, begin) : np.searchsorted(at, end, "right")] - begin] = True
        inside = np.zeros(end - begin + 2, bool)
        inside[1:-1] = folded != 0
        start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
        size = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1 - start
        starts.append(start + begin)
        sizes.append(size)
        codes.append(hashes(folded, start, size))
    start = np.concatenate(starts)
    bounds = np.searchsorted(start, at)
    text = np.repeat(np.arange(len(column)), np.diff(bounds))
    return Words(np.concatenate(codes), bounds, text, *((start, np.concatenate(sizes)) if places else ()))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each on, for all but the last n - 1; the caller drops those that reach into the next text."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, _U)
    factor = 1
    for i in range(n):
        factor = factor * 0xF1357AEA2E62A9C5 % (1 << 64)
        out += words[i : i + count] * _U(factor)
    return mix(out)


def winnow(words: np.ndarray, text: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of k words that are kept, and the place of each one's first word: of each ``window`` words of a text the least, the last among equals."""
    g = grams(words, k)
    span = window - k + 1
    count = len(g) - span + 1
    if count <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    least, at = g[:count].copy(), np.zeros(count, np.int64)
    for i in range(1, span):
        better = g[i : i + count] <= least
        least[better] = g[i : i + count][better]
        at[better] = i
    whole = text[:count] == text[window - 1 : window - 1 + count]
    keep = np.zeros(len(g), bool)
    keep[(np.arange(count) + at)[whole]] = True
    places = np.flatnonzero(keep)
    return g[places], places


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_BYTES of text, or with one longer text."""
    column = batch.column(text)
    if not batch.num_rows:
        return
    _, at = raw(column)
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(at, at[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def map_text(
    df: DataFrame, text: str, keep: list[str], fields: list[T.StructField], work: Callable[[], Callable[[pa.Array], list]]
) -> DataFrame:
    """Columns ``keep`` of df, then ``fields`` computed from column ``text`` by what ``work()`` returns, a slice at a time.

    ``work`` is called once in each task. df may have any other columns; ``text`` may be among ``keep``.
    """
    source = df.select(*[df[f"`{c}`"] for c in keep], df[f"`{text}`"].alias("__text")) if text not in keep else df.select(*[df[f"`{c}`"] for c in keep])
    shipped(df.sparkSession)
    kept = len(keep)
    position = keep.index(text) if text in keep else kept
    schema = T.StructType([*source.schema.fields[:kept], *fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        compute = work()
        for batch in batches:
            for part in slices(batch, position):
                made = compute(part.column(position))
                columns = [*(part.column(i).cast(arrow.field(i).type) for i in range(kept)), *(x if isinstance(x, pa.Array) else pa.array(x) for x in made)]
                columns = [c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return source.mapInArrow(run, schema)
