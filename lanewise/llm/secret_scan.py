"""Secret scan with DataFrame functions only: fixed patterns, and windows of high entropy in candidate strings.

The patterns give base spans (assign, access, hex). Besides, every longest run of WINDOW or more characters of ALPHABET is a
candidate. Passages on the allow-list (placeholders, UUIDs, runs of the alphabet, hashes of nothing) cut a candidate into pieces:
windows that touch such a passage are passed over, those beside it are not. A window slides over each piece one character at a
time; the counts of the characters in it, 5 bits each in a few longs, are kept up to date by one character in and one out, and with
them the sum of c * log2(c), so that the Shannon entropy of each window, log2(WINDOW) minus that sum over WINDOW, costs no new
count. The bound depends on the class of the window's characters: hexadecimal digits, or the wider alphabet (there with letters and
two digits at least). Windows over the bound that touch are one span. Spans inside base spans are left out.

Long pieces are worked on in parts of PART windows, whose spans are joined where they touch, and places are summed up by doubling,
so that the time for a text grows with its length (and its logarithm), not with the square of its number of spans. Sums are kept in
millionths as whole numbers, so results don't depend on the order of additions. All positions are code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")
LEAST_VALUE = 12

WINDOW = 20
#: Hexadecimal digits come first, decimal ones before them.
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"
DIGITS, HEX_DIGITS = 10, 22
CANDIDATE = "[A-Za-z0-9+/_=-]{%d,}" % WINDOW
#: Bits of entropy from which a window counts, for hexadecimal windows and for others.
HEX_BITS, WIDE_BITS = 3.0, 3.8
#: Passages that are no secrets.
ALLOWED = (
    "(?i:example|placeholder|changeme|dummy|your[-_]|0123456789|abcdefghij|d41d8cd98f00b204e9800998ecf8427e|"
    "da39a3ee5e6b4b0d3255bfef95601890afd80709|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
)
#: Windows that are worked on at a time; characters whose counts are in one long.
PART, PACKED = 500, 12


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _running(values: str, op: str = "v + {0}") -> str:
    """SQL: the running sums (or other results of ``op``) of an array, each over all before it and itself, by doubling."""
    before = "acc[i - cast(shiftleft(1, k) as int)]"
    step = f"transform(acc, (v, i) -> if(i >= shiftleft(1, k), {op.format(before)}, v))"
    return f"transform(array({values}), z -> aggregate(sequence(0, cast(ceil(log2(greatest(size(z), 1))) as int)), z, (acc, k) -> {step}))[0]"


def _found(text: str, pattern: str, kind: int, value: str) -> str:
    """SQL: an array of (start, kind, end, value) for all matches; ``value`` is the group whose text is returned."""
    p = _quoted(pattern)
    whole, kept = f"regexp_extract_all({text}, {p}, 0)", f"regexp_extract_all({text}, {p}, {value})"
    empty = "cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)"
    ends = _running(f"zip_with(slice(split({text}, {p}, -1), 1, size(m)), m, (p, x) -> length(p) + length(x))")
    spans = f"zip_with(zip_with({ends}, m, (e, x) -> struct(e - length(x) as start, e as end)), {kept}, (s, v) -> struct(s.start as start, {kind} as kind, s.end as end, v as value))"
    return f"if({text} rlike {p}, transform(array({whole}), m -> {spans})[0], {empty})"


def _pieces(candidate: str) -> str:
    """SQL: (start, value) of the pieces of a candidate between passages of the allow-list that hold a window; start as in the text."""
    p, value = _quoted(ALLOWED), f"{candidate}.value"
    whole = f"array(struct({candidate}.start as start, {value} as value))"
    sizes = f"zip_with(p, concat(array(''), m), (x, y) -> length(x) + length(coalesce(y, '')))"
    cut = f"zip_with({_running(sizes)}, p, (e, x) -> struct({candidate}.start + e - length(x) as start, x as value))"
    split = f"transform(array(split({value}, {p}, -1)), p -> transform(array(regexp_extract_all({value}, {p}, 0)), m -> {cut})[0])[0]"
    return f"if({value} rlike {p}, filter({split}, x -> length(x.value) >= {WINDOW}), {whole})"


def _most(bits: float) -> int:
    """The largest sum of c * log2(c), in millionths, at which a window has that many bits."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * 1_000_000)


SUMS = [0, *(round(c * math.log2(c) * 1_000_000) for c in range(1, WINDOW + 1))]


def _touching(spans: str) -> str:
    """SQL: spans in order of start, those that touch as one."""
    starts = "filter(z, (x, i) -> i = 0 or x.start > z[greatest(i - 1, 0)].end)"
    ends = "filter(z, (x, i) -> i = size(z) - 1 or z[least(i + 1, size(z) - 1)].start > x.end)"
    return f"transform(array({spans}), z -> zip_with({starts}, {ends}, (s, e) -> struct(s.start as start, e.end as end)))[0]"


def _windows(piece: str) -> str:
    """SQL: spans (start, end), from 0 in the piece, of touching windows over the bound.

    ``q`` has the place in ALPHABET of the character that comes and of the one that goes (-1: none yet), ``a`` the counts (PACKED
    in a long, 5 bits each), the sum, the digits and the run of hexadecimal digits so far, with the spans of this part; ``s`` is the
    same after the step.
    """
    codes = f"transform(filter(split({piece}.value, ''), c -> c <> ''), c -> locate(c, '{ALPHABET}') - 1)"
    sums = "array(" + ",".join(f"{x}L" for x in SUMS) + ")"
    none = "cast(array() as array<struct<start:int,end:int>>)"
    begin = f"i - {WINDOW - 1}"
    one = lambda place: f"if(k = {place} div {PACKED}, shiftleft(1L, 5 * ({place} % {PACKED})), 0L)"
    count = lambda place: f"cast(shiftright(a.counts[cast({place} div {PACKED} as int)], 5 * ({place} % {PACKED})) & 31 as int)"
    counts = f"if(q.come = q.gone, a.counts, transform(a.counts, (c, k) -> c + {one('q.come')} - if(q.gone < 0, 0L, {one('q.gone')})))"
    gain = f"{sums}[{count('q.come')} + 1] - {sums}[{count('q.come')}]"
    left = count("greatest(q.gone, 0)")
    loss = f"if(q.gone < 0, 0L, {sums}[{left}] - {sums}[{left} - 1])"
    total = f"if(q.come = q.gone, a.total, a.total + {gain} - {loss})"
    digits = f"a.digits + if(q.come < {DIGITS}, 1, 0) - if(q.gone between 0 and {DIGITS - 1}, 1, 0)"
    hexes = f"if(q.come < {HEX_DIGITS}, a.hexes + 1, 0)"
    hot = f"i >= o + {WINDOW - 1} and s.digits < {WINDOW} and if(s.hexes >= {WINDOW}, s.total <= {_most(HEX_BITS)}L, s.digits >= 2 and s.total <= {_most(WIDE_BITS)}L)"
    spans = f"""case when not ({hot}) then a.spans
        when size(a.spans) > 0 and element_at(a.spans, -1).end >= {begin} then concat(slice(a.spans, 1, size(a.spans) - 1), array(struct(element_at(a.spans, -1).start as start, i + 1 as end)))
        else concat(a.spans, array(struct({begin} as start, i + 1 as end))) end"""
    after = f"transform(array(struct({counts} as counts, {total} as total, {digits} as digits, {hexes} as hexes)), s -> struct(s.counts as counts, s.total as total, s.digits as digits, s.hexes as hexes, {spans} as spans))[0]"
    step = f"transform(array(struct(codes[i] as come, if(i >= o + {WINDOW}, codes[greatest(i - {WINDOW}, 0)], -1) as gone)), q -> {after})[0]"
    first = f"struct(array_repeat(0L, {-(-len(ALPHABET) // PACKED)}) as counts, 0L as total, 0 as digits, 0 as hexes, {none} as spans)"
    part = f"aggregate(sequence(o, least(o + {PART + WINDOW - 2}, size(codes) - 1)), {first}, (a, i) -> {step}, a -> a.spans)"
    parts = f"flatten(transform(sequence(0, size(codes) - {WINDOW}, {PART}), o -> {part}))"
    return f"transform(array({codes}), codes -> {_touching(parts)})[0]"


def scan_secrets(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` with ``base`` and ``spans``: arrays of (start, kind, end, name), by start and then kind.

    kind is the place of the name in KINDS. A null text is an empty one and has no spans; repeated rows each give a row; an empty
    table gives an empty table. A very long text is scanned whole. docs may have other columns of any names; ``base`` and ``spans``
    must not be among ``keep``.
    """
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    plain = "transform({0}, s -> struct(s.start as start, s.kind as kind, s.end as end))"
    assign = f"filter({_found('body', ASSIGN, 0, '2')}, s -> length(s.value) >= {LEAST_VALUE})"
    base = f"array_sort(concat({plain.format(assign)}, {plain.format(_found('body', ACCESS, 1, '0'))}, {plain.format(_found('body', HEX, 2, '0'))}))"
    pieces = f"flatten(transform({_found('body', CANDIDATE, 3, '0')}, c -> {_pieces('c')}))"
    entropy = f"flatten(transform({pieces}, d -> transform({_windows('d')}, w -> struct(d.start + w.start as start, 3 as kind, d.start + w.end as end))))"
    nothing = "cast(array() as array<struct<start:int,kind:int,end:int>>)"
    # In order of start and kind, a fresh span is inside a base span if one up to there ends no earlier.
    reach = _running("transform(y, s -> if(s.kind < 3, s.end, -1))", "greatest(v, {0})")
    kept = f"transform(array({reach}), r -> filter(y, (s, i) -> s.kind < 3 or r[i] < s.end))[0]"
    found = source.withColumn("base", F.expr(base)).withColumn("fresh", F.expr(f"if(body rlike {_quoted(CANDIDATE)}, {entropy}, {nothing})"))
    found = found.withColumn("every", F.expr(f"if(size(fresh) = 0, base, transform(array(array_sort(concat(base, fresh))), y -> {kept})[0])"))
    names = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    named = lambda c: F.expr(f"transform({c}, s -> struct(s.start as start, s.kind as kind, s.end as end, {names}[s.kind] as name))")
    return found.select("kept.*", named("base").alias("base"), named("every").alias("spans"))


def written_out(spans: str) -> Column:
    """``name:start:end`` for each span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat(s.name, ':', s.start, ':', s.end)), ',')")
