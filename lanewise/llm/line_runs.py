"""Removal of repeated runs of lines with a suffix array over line ids, built by distributed prefix doubling.

Each document is a sequence of line ids (two 64-bit hashes); lines of white space only are left out, so a run may go on over them.
Lines that occur once in the whole corpus can't be in a repeated run; the rest form segments, runs of neighbouring lines. The rank
of a suffix of a segment by its first line is the number of suffixes with a smaller one. Doubling: the rank by 2 h lines is the
rank by h lines plus the number of suffixes of equal rank whose rank h lines on is smaller. Those numbers are running sums in two
levels, over ranges and within each, of counts that are summed before they are shuffled, so that neither the suffixes of a very
common line, nor its followers, nor the whole array are ever sorted in one task.

Doubling goes on until each suffix has a rank of its own or shares it with equal suffixes only; segments of which that holds stay
behind on the way. Each round keeps what its new ranks are made of (rank, rank h lines on). From these the longest common prefix of
each rank with the one before it is found, from the last round down: where both have the same first half, its lines count and the
second halves are compared, else the first ones.

Neighbours in the array that have ``min_lines`` lines in common form an interval. Every repeated run of that many lines or more is
the union of windows of exactly that many lines, each the beginning of a suffix in such an interval, and each but the first of its
interval (by document, then line) is a later copy. A single line counts as a run if it has ``min_words`` words; its copies are the
intervals with one line in common. Lines in a later copy are deleted; neighbouring ones are reported as maximal runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import near, pinned, removed

MIN_LINES, MIN_WORDS = 2, 5
#: Most ranges (a power of two) whose counts are summed before they are put in order; there are about as many as rows in each.
MOST_RANGES = 20
_BLANK = r" \t\x0B\f\r"
_LINE = ["line", "twin"]


def _range_bits(rows: int) -> int:
    return max(6, min(MOST_RANGES, rows.bit_length() // 2))


def _first_ranks(active: DataFrame, rows: int) -> DataFrame:
    """(line, twin, rank, n): the number of suffixes that begin with a smaller line id, and of those that begin with this one."""
    counts = active.groupBy(*_LINE).agg(F.count(F.lit(1)).alias("n")).withColumn("range", F.shiftright("line", 64 - _range_bits(rows)))
    ranges = counts.groupBy("range").agg(F.sum("n").alias("n"))
    before = ranges.select("range", (F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"))
    inner = Window.partitionBy("range").orderBy(*_LINE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = counts.select(*_LINE, "n", "range", (F.sum("n").over(inner) - F.col("n")).alias("within"))
    return within.join(F.broadcast(before), "range").select(*_LINE, (F.col("before") + F.col("within")).alias("rank"), "n")


def _open(length: int) -> Column:
    """Whether a suffix may yet differ from those that share its rank by ``length`` lines; of one rank all may or none."""
    return (F.col("n") > 1) & (F.col("last") - F.col("at") + 1 >= length)


def _halves(pairs: DataFrame, rows: int) -> DataFrame:
    """(rank, next, new, n, prior): ranks by 2 h lines, made of ranks by h lines, with their suffixes and the ``next`` before in ``rank``."""
    width = max(1, rows >> _range_bits(rows))
    counts = pairs.filter("open").groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).withColumn("range", F.expr(f"next div {width}"))
    outer = Window.partitionBy("rank").orderBy("range")
    so_far = Window.unboundedPreceding, Window.currentRow
    ranges = counts.groupBy("rank", "range").agg(F.sum("n").alias("all"), F.max("next").alias("most"))
    before = ranges.select("rank", "range", (F.sum("all").over(outer.rowsBetween(*so_far)) - F.col("all")).alias("before"), F.lag("most").over(outer).alias("earlier"))
    inner = Window.partitionBy("rank", "range").orderBy("next")
    within = counts.select("rank", "range", "next", "n", (F.sum("n").over(inner.rowsBetween(*so_far)) - F.col("n")).alias("within"), F.lag("next").over(inner).alias("prior"))
    new = F.col("rank") + F.col("before") + F.col("within")
    return within.join(before, ["rank", "range"]).select("rank", "next", new.alias("new"), "n", F.coalesce("prior", "earlier").alias("prior"))


def _common_lines(first: DataFrame, rounds: list[tuple[int, DataFrame]]) -> DataFrame:
    """(rank, lcp): the lines that suffixes of each rank have in common with those of the rank before."""
    pairs = None
    for length, halves in reversed(rounds):
        found = halves.filter("prior is not null").select(F.col("new").alias("at_rank"), F.col("prior").alias("a"), F.col("next").alias("b"), F.lit(length).cast("long").alias("lcp"))
        if pairs is not None:
            split = pairs
            for side in "ab":
                split = split.join(halves.select(F.col("new").alias(side), F.col("rank").alias(f"{side}_first"), F.col("next").alias(f"{side}_next")), side, "left")
            same = F.coalesce("a_first", "a") == F.coalesce("b_first", "b")
            sides = [F.when(same, F.col(f"{side}_next")).otherwise(F.coalesce(f"{side}_first", side)).alias(side) for side in "ab"]
            found = found.union(split.select("at_rank", *sides, F.when(same, F.col("lcp") + length).otherwise(F.col("lcp")).alias("lcp")))
        found = pinned(found)
        if pairs is not None:
            removed(pairs)
        pairs = found
    starts = first.select("rank", F.lit(0).cast("long").alias("lcp"))
    return starts if pairs is None else starts.union(pairs.select("at_rank", "lcp"))


def suffix_array(active: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """The suffixes of the segments in ``active`` (doc, key, at, line, twin, long): (doc, key, at, last, long, rank) and (rank, lcp).

    ``rank`` is the number of smaller suffixes, ``last`` the last line of the suffix and ``lcp`` the number of lines in common with
    the rank before. Equal suffixes share a rank.
    """
    parted = active.withColumn("segment", F.col("at") - F.row_number().over(Window.partitionBy("doc").orderBy("at")))
    segment = Window.partitionBy("doc", "segment")
    ends = parted.withColumn("last", F.max("at").over(segment))
    first = near(_first_ranks(active, rows))
    kept = ["doc", "key", "at", "segment", "last", "long"]
    ranked = pinned(ends.join(first, _LINE).select(*kept, "rank", _open(1).alias("open")))
    tables, settled, rounds, length = [], [], [], 1
    while ranked.filter("open").limit(1).count():
        shifted = ranked.withColumn("next", F.lead("rank", length, -1).over(segment.orderBy("at"))).withColumn("alive", F.max("open").over(segment))
        pairs = pinned(shifted)
        removed(ranked)
        halves = near(_halves(pairs, rows))
        rounds.append((length, halves))
        settled.append(pairs.filter("not alive"))
        tables.append(pairs)
        length *= 2
        joined = pairs.filter("alive").join(halves.select("rank", "next", "new", "n"), ["rank", "next"], "left")
        ranked = pinned(joined.select(*kept, F.coalesce("new", "rank").alias("rank"), F.coalesce(_open(length), F.lit(False)).alias("open")))
    whole = ranked
    for part in settled:
        whole = whole.unionByName(part.select(ranked.columns))
    neighbours = pinned(_common_lines(first, rounds))
    array = pinned(whole.select("doc", "key", "at", "last", "long", "rank"))
    removed(ranked, first, *tables, *[halves for _, halves in rounds])
    return array, neighbours


def _intervals(neighbours: DataFrame, lengths: list[int], rows: int) -> DataFrame:
    """(rank, start<length> for each length): the rank at which the interval of ranks with that many lines in common begins."""
    width = max(1, rows >> _range_bits(rows))
    names = [f"start{n}" for n in lengths]
    marked = neighbours.select("rank", F.expr(f"rank div {width}").alias("range"), *[F.when(F.col("lcp") < n, F.col("rank")).alias(f"start{n}") for n in lengths])
    so_far = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = marked.groupBy("range").agg(*[F.max(c).alias(c) for c in names])
    before = ranges.select("range", *[F.max(c).over(so_far).alias(f"before_{c}") for c in names])
    inner = Window.partitionBy("range").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = marked.select("rank", "range", *[F.max(c).over(inner).alias(c) for c in names])
    return within.join(F.broadcast(before), "range").select("rank", *[F.coalesce(c, f"before_{c}").alias(c) for c in names])


def _later(array: DataFrame, length: int) -> DataFrame:
    """Suffixes of at least ``length`` lines that aren't the first of their interval, with ``copies``, the size of the interval."""
    whole = array.filter(F.col("last") - F.col("at") + 1 >= length).withColumnRenamed(f"start{length}", "start")
    first = whole.groupBy("start").agg(F.min(F.struct("key", "doc", "at")).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("start", "first", "copies")
    return whole.join(near(first), "start").filter((F.col("first.doc") != F.col("doc")) | (F.col("first.at") != F.col("at")))


def later_copies(lines: DataFrame, min_lines: int = MIN_LINES, source: DataFrame | None = None) -> DataFrame:
    """(doc, at, copies) of the lines to delete among ``lines`` (doc, key, at, line, twin, long); documents are in order of key, then doc.

    ``long`` lines are runs of their own; ``copies`` is how often the largest interval that a line's run is in has it. ``source`` is a
    written table that nothing but ``lines`` reads; it is deleted on the way.
    """
    repeated = lines.groupBy(*_LINE).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*_LINE)
    active = pinned(lines.join(near(repeated), _LINE, "left_semi"))
    rows = active.count()
    if source is not None:
        removed(source)
    array, neighbours = suffix_array(active, rows)
    removed(active)
    starts = near(_intervals(neighbours, sorted({1, min_lines}), rows))
    placed = pinned(array.join(starts, "rank"))
    removed(array, neighbours, starts)
    single = _later(placed.filter("long"), 1).select("doc", "at", "copies")
    windows = _later(placed, min_lines).select("doc", F.explode(F.sequence("at", F.col("at") + (min_lines - 1))).alias("at"), "copies")
    return single.union(windows).groupBy("doc", "at").agg(F.max("copies").alias("copies"))


def _numbered_lines(docs: DataFrame, key: str, text: str, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(doc, key, at, line, twin, long) of the lines that aren't blank, and the table that it reads; ``at`` counts these alone. Rows alike are one document."""
    body = F.col(f"`{text}`")
    full = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(f"[^{_BLANK}]"))
    split = docs.filter(body.isNotNull()).select(_identity(key, text).alias("doc"), F.col(f"`{key}`").alias("key"), F.monotonically_increasing_id().alias("row"), F.posexplode(full).alias("at", "body"))
    long = F.col("body").rlike(f"(?:[^{_BLANK}]++[{_BLANK}]++){{{max(min_words, 1) - 1}}}[^{_BLANK}]")
    lines = pinned(split.select("doc", "key", "row", "at", F.xxhash64("body").alias("line"), F.xxhash64(F.lit(1), "body").alias("twin"), long.alias("long")))
    again = lines.filter("at = 0").groupBy("doc").agg(F.min("row").alias("only"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc", "only")
    return lines.join(near(again), "doc", "left").filter("only is null or only = row").drop("row", "only"), lines


def _identity(key: str, text: str) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.col(f"`{text}`"))))


def remove_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of docs, without the lines in later copies of repeated runs.

    Added are ``n_lines`` and ``n_removed`` (long), and ``removed_runs``: (start, length, copies) of the maximal runs of deleted
    lines, start being the run's first line from 0, length its lines that aren't blank, and copies how often at least each window
    in it occurs. Lines end at ``\\n``; lines of white space only are in no run and stay, and runs go on over them. A null text stays null
    and has no lines. Rows alike in key and text are one document; a null key comes first. Copies that overlap count as copies. An
    empty table gives an empty table. A very long text is split whole, by one task. Columns of docs with the added names are
    replaced; others may have any names.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be at least 1")
    docs = docs.drop("n_lines", "n_removed", "removed_runs")
    body = F.col(f"`{text}`")
    lines, source = _numbered_lines(docs, key, text, min_words)
    gone = later_copies(lines, min_lines, source).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", "copies"))).alias("gone"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), body.alias("body"), F.when(body.isNotNull(), _identity(key, text)).alias("doc"))
    left = row.join(gone, "doc", "left")
    # Places among all lines of those that aren't blank; then the pieces between deleted lines.
    full = f"filter(sequence(0, size(p) - 1), i -> p[i] rlike r'[^{_BLANK}]')"
    kept = "array_join(flatten(zip_with(concat(array(-1), g), concat(g, array(size(p))), (a, b) -> slice(p, a + 2, b - a - 1))), '\\n')"
    first, last = (f"filter(transform(z, (x, i) -> if({edge}, i, -1)), i -> i >= 0)" for edge in ("i = 0 or z[greatest(i - 1, 0)].at < x.at - 1", "i = size(z) - 1 or z[least(i + 1, size(z) - 1)].at > x.at + 1"))
    runs = f"transform(array(gone), z -> zip_with({first}, {last}, (a, b) -> struct(g[a] as start, cast(b - a + 1 as long) as length, array_min(transform(slice(z, a + 1, b - a + 1), y -> y.copies)) as copies)))[0]"
    made = f"transform(array(split(body, '\\n', -1)), p -> transform(array({full}), f -> transform(array(transform(gone, x -> f[x.at])), g -> struct({kept} as body, {runs} as runs))[0])[0])[0]"
    none = "cast(array() as array<struct<start:int,length:bigint,copies:bigint>>)"
    built = left.withColumn("made", F.expr(f"if(gone is null, struct(body, {none} as runs), {made})"))
    columns = [F.col("made.body").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns]
    n_lines = F.when(F.col("body").isNull(), 0).otherwise(F.octet_length("body") - F.octet_length(F.replace("body", F.lit("\n"), F.lit(""))) + 1)
    return built.select(*columns, n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.col("made.runs").alias("removed_runs"))
