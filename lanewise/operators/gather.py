"""Gathering values by position, and decoding of dictionary codes.

An index or code without an entry raises an error when the result is computed; a stored null is a value like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import free

#: Bytes of a dictionary up to which it is broadcast (values written out, and 16 for each entry); beyond, Spark picks the join.
MOST_BROADCAST = 64 << 20


def _found(value: str, hit: str, what: str, key: str) -> Column:
    error = F.raise_error(F.concat(F.lit(f"{what} out of range: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return F.when(F.col(hit), F.col(value)).otherwise(error)


def _looked_up(rows: DataFrame, entries: DataFrame, key: str, entry: str, value: str, what: str, small: bool) -> DataFrame:
    names = []
    for stem in ("key", "value", "hit"):
        names.append(free([*rows.columns, *names], stem))
    named = entries.select(F.col(entry).alias(names[0]), F.col(value).alias(names[1]), F.lit(True).alias(names[2]))
    joined = rows.join(F.broadcast(named) if small else named, rows[key] == F.col(names[0]), "left")
    return joined.select(*rows.columns, _found(names[1], names[2], what, key).alias(value))


def take(indices: DataFrame, values: DataFrame, idx: str = "idx", pos: str = "pos", value: str = "value") -> DataFrame:
    """``indices`` with ``value``: that of the row of ``values`` at each index. Indices may be in any order and repeat."""
    return _looked_up(indices, values, idx, pos, value, "index", False)


def _bytes(entries: DataFrame, value: str) -> int:
    written = F.coalesce(F.octet_length(F.col(value).cast("string")), F.lit(0)).cast("bigint") + 16
    return entries.agg(F.sum(written).alias("bytes")).first()["bytes"] or 0


def dict_decode(facts: DataFrame, dictionary: DataFrame, code: str, value: str = "value", entry: str = "code", selection: Column | None = None) -> DataFrame:
    """``facts`` with ``value`` for each code. With a selection only its rows are decoded and returned; codes of others may be invalid."""
    rows = facts if selection is None else facts.where(selection)
    return _looked_up(rows, dictionary, code, entry, value, "code", _bytes(dictionary, value) <= MOST_BROADCAST)


def take_from_array(array: Column, index: Column) -> Column:
    """The element of an array column at an index from 0; an error if there is none."""
    inside = (index >= 0) & (index < F.size(array))
    return F.when(inside, F.get(array, index)).otherwise(F.raise_error(F.lit("index out of range")))
