"""Near-duplicates of whole texts by BagMinHash over bags of five-word shingles.

Signature. For each shingle of weight w (how often it occurs in the text) the weight axis is cut into the dyadic pieces (0,1],
(1,2], (2,4], (4,8], ... Each piece is a Poisson process whose rate is its length, seeded by shingle and piece alone; a point of
a piece that w only reaches into is thinned by its own uniform level. Points are made in rising order, all texts at a time, and
fall on one of SIZE components; a component keeps its least point. A text stops making points once all its components are filled
by points under its bound, so long texts cost little more than reading their shingles. Two texts agree in a component with the
probability of their weighted Jaccard similarity.

Candidates. Signatures are cut into BANDS bands; texts that share a band are linked to the band's least text (a star, never all
pairs) and connected to candidate groups. Texts of equal words count as one from the start.

Verification. In each candidate group the multiset overlap (sum of minima over sum of maxima) decides. A group is searched breadth
first: a text is compared with those not yet reached that share one of its rarest shingles, and those within the threshold are
reached, which gives exactly the connected classes without listing pairs. A large group is searched in blocks that share a few
pivots. The texts that this leaves unlinked to the largest class then meet each block that holds one of their rarest shingles among
the rarest ones of its own texts: shingles are counted over the whole group (summed by block first) and blocks are found by ids
alone, so bags only travel to blocks that may hold a partner. Only spanning links leave a task. Blocks are bounded in texts and bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import MOST_BROADCAST, near, pinned, released, removed, shipped
from ._text import Words, grams, map_text, mix, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
SIZE = BANDS * ROWS
#: Texts that a task compares at a time, and pivots that the blocks of a larger group share.
BLOCK, PIVOTS = 1024, 4
#: Bytes of bags that a task compares at a time, unless one text alone has more.
BLOCK_BYTES = 64 << 20
_U = np.uint64
_EMPTY = _U((1 << 64) - 1)


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of the distinct shingles of each text, in order of text and hash. Fewer than five words are one shingle."""
    n = np.diff(w.bounds)
    g = grams(w.hash, SHINGLE)
    inside = w.text[: len(g)] == w.text[SHINGLE - 1 :] if len(g) else np.zeros(0, bool)
    text, hashes = w.text[: len(g)][inside], g[inside]
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):
        padded = np.concatenate([w.hash, np.zeros(SHINGLE, _U)])
        at = w.bounds[:-1][few]
        code = n[few].astype(_U)
        for i in range(SHINGLE - 1):
            code = mix(code * _U(0x9E3779B97F4A7C15) + np.where(i < n[few], padded[at + i], _U(0)))
        text, hashes = np.concatenate([text, few]), np.concatenate([hashes, code])
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    if not len(text):
        return text, hashes, np.zeros(0, np.int64)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return text[first], hashes[first], np.diff(np.append(first, len(text)))


def _exponential(bits: np.ndarray) -> np.ndarray:
    return -np.log(((bits >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)


def signatures(texts: int, text: np.ndarray, hashes: np.ndarray, weight: np.ndarray, size: int = SIZE) -> np.ndarray:
    """texts x size: the upper half of each number is the component's least point, the lower half the hash of that point."""
    out = np.full((texts, size), _EMPTY, _U)
    if not len(text):
        return out
    # Pieces: number 0 is (0,1], number j is (2^(j-1), 2^j].
    pieces = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 2))).astype(np.int64) + 1, 1)
    owner = np.repeat(np.arange(len(text)), pieces)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    where, low = text[owner], np.where(piece > 0, 2.0 ** (piece - 1), 0.0)
    length = np.where(piece > 0, low, 1.0)
    top = weight[owner].astype(np.float64)
    state = mix(hashes[owner] + (piece + 1).astype(_U) * _U(0xA24BAED4963EE407))
    point = _exponential(state) / length
    bags = np.bincount(text, weights=weight, minlength=texts)
    bound = size * (np.log(size) + 2.0) / np.maximum(bags, 1)
    flat = out.reshape(-1)
    pool = np.arange(len(owner))
    while len(pool):
        live = pool[point[pool] < bound[where[pool]]]
        while len(live):
            drawn = mix(state[live] ^ _U(0x5851F42D4C957F2D))
            level = low[live] + length[live] * ((drawn & _U(0xFFFF)).astype(np.float64) + 0.5) / 65536.0
            counts = level <= top[live]
            component = ((drawn >> _U(40)) % _U(size)).astype(np.int64)
            key = (point[live].astype(np.float32).view(np.uint32).astype(_U) << _U(32)) | (mix(drawn) >> _U(32))
            np.minimum.at(flat, (where[live] * size + component)[counts], key[counts])
            state[live] = mix(state[live] + _U(0x9E3779B97F4A7C15))
            point[live] += _exponential(state[live]) / length[live]
            live = live[point[live] < bound[where[live]]]
        unfilled = (out == _EMPTY).any(axis=1) & (bags > 0)
        bound[unfilled] *= 2
        pool = pool[unfilled[where[pool]]]
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """texts x BANDS: a hash of each band's components."""
    low = signature & _U(0xFFFFFFFF)
    out = np.empty((len(signature), BANDS), _U)
    for b in range(BANDS):
        code = np.full(len(signature), b + 1, _U)
        for r in range(ROWS):
            code = mix(code * _U(0x9E3779B97F4A7C15) + low[:, b * ROWS + r])
        out[:, b] = code
    return out


def content_keys(w: Words) -> list[bytes | None]:
    """16 bytes that stand for the sequence of words of each text; null without a word."""
    n = np.diff(w.bounds)
    place = (np.arange(len(w.hash)) - np.repeat(w.bounds[:-1], n)).astype(_U)
    sums = []
    for salt in (0x8CB92BA72F3D8DD7, 0xD1B54A32D192ED03):
        terms = mix(w.hash + mix(place * _U(salt) + _U(salt >> 7)))
        sums.append(mix(np.add.reduceat(np.append(terms, _U(0)), w.bounds[:-1]) + n.astype(_U)))
    both = np.stack(sums, axis=1).astype(">u8").tobytes()
    return [both[16 * i : 16 * i + 16] if n[i] else None for i in range(len(n))]


def signed(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Columns ``keep`` with ``words_key`` (16 bytes, null without a word) and ``bands``."""

    def work():
        def compute(column: pa.Array) -> list:
            w = words(column)
            made = bands(signatures(len(column), *shingles(w))).view(np.int64)
            keys = content_keys(w)
            flat = pa.array(made.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1) * BANDS, pa.int32()), flat)
            return [pa.array(keys, pa.binary()), lists]

        return compute

    return map_text(docs, text, keep, [T.StructField("words_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))], work)


def bagged(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Columns ``keep`` with ``words_key`` and ``bag``: sorted hashes of (shingle, how manieth), a set that stands for the multiset."""

    def work():
        def compute(column: pa.Array) -> list:
            w = words(column)
            at, hashes, weight = shingles(w)
            many = np.repeat(np.arange(len(at)), weight)
            nth = (np.arange(len(many)) - np.repeat(np.cumsum(weight) - weight, weight)).astype(_U)
            code = np.where(nth > 0, mix(hashes[many] + nth * _U(0x94D049BB133111EB)), hashes[many]).view(np.int64)
            order = np.lexsort((code, at[many]))
            begin = np.searchsorted(at[many], np.arange(len(column) + 1))
            lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(code[order]))
            return [pa.array(content_keys(w), pa.binary()), lists]

        return compute

    return map_text(docs, text, keep, [T.StructField("words_key", T.BinaryType()), T.StructField("bag", T.ArrayType(T.LongType()))], work)


def _first(size: np.ndarray, similarity: float) -> np.ndarray:
    """Of how many elements, in any common order, two bags within the similarity share one: all but similarity * size, and one more."""
    return size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1


def linked(bags: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that span the connected classes of the graph of all pairs within the similarity, found breadth first.

    Two bags within the similarity share one of the first elements of both in any common order, the first being those of
    ``_first``. In order of rarity these are rare elements, so few bags are ever compared.
    """
    n = len(bags)
    size = np.array([len(b) for b in bags], np.int64)
    values = np.concatenate(bags)
    owner = np.repeat(np.arange(n), size)
    _, element, counts = np.unique(values, return_inverse=True, return_counts=True)
    order = np.lexsort((element, counts[element], owner))
    place = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    head = order[place < np.repeat(_first(size, similarity), size)]
    head = head[counts[element[head]] > 1]
    head_element, head_owner = element[head], owner[head]
    own_begin = np.searchsorted(head_owner, np.arange(n + 1))
    by_element = np.argsort(head_element, kind="stable")
    holders = head_owner[by_element]
    list_begin = np.concatenate([[0], np.cumsum(np.bincount(head_element, minlength=len(counts)))])
    left = np.ones(n, bool)
    links = []
    for start in range(n):
        if not left[start]:
            continue
        left[start] = False
        reach = [start]
        while reach:
            at = reach.pop()
            lists = head_element[own_begin[at] : own_begin[at + 1]]
            if not len(lists):
                continue
            near = np.unique(np.concatenate([holders[list_begin[e] : list_begin[e + 1]] for e in lists]))
            near = near[left[near] & (similarity * size[at] <= size[near] + 1e-9) & (similarity * size[near] <= size[at] + 1e-9)]
            if not len(near):
                continue
            all_of = np.concatenate([bags[i] for i in near])
            found = np.minimum(np.searchsorted(bags[at], all_of), size[at] - 1)
            common = np.add.reduceat((bags[at][found] == all_of).astype(np.int64), np.cumsum(size[near]) - size[near])
            got = near[common >= similarity * (size[at] + size[near] - common) - 1e-9]
            left[got] = False
            links += [(at, int(i)) for i in got]
            reach += got.tolist()
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): the least node of each connected component, by large and small stars.

    Nodes are only joined to least neighbours, so no neighbourhood is gathered. Two rounds that give the same edges end it.
    """
    pairs = pinned(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    shape = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("mark")).first()
    last = shape(pairs)
    while last["n"]:
        # A row for each node. Where they are many they are pinned, so that the hot partitions of the join can be split.
        few = 2 * last["n"] <= MOST_BROADCAST
        for_join = F.broadcast if few else pinned
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = for_join(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        lower = for_join(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        before, pairs = pairs, pinned(small.union(lower.select("a", F.col("m").alias("b"))).distinct())
        now = shape(pairs)
        removed(before, *(() if few else (least, lower)))
        del before, both, least, large, lower, small
        released(pairs.sparkSession)
        if now == last:
            break
        last = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


_LINKS = "a binary, b binary"


def _flat(bags: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all bags, and where each bag begins, with the end."""
    column = bags.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.values.to_numpy(), column.offsets.to_numpy()


def _search(similarity: float):
    """From a group's nodes and bags: links of each node to the least node of its class within the group."""

    def run(table: pa.Table) -> pa.Table:
        keys = table["node"].to_pylist()
        values, begin = _flat(table["bag"])
        bags = {k: values[begin[i] : begin[i + 1]] for i, k in enumerate(keys)}  # a pivot may come twice
        names = list(bags)
        top = {n: n for n in names}

        def root(n: bytes) -> bytes:
            while top[n] != n:
                top[n] = n = top[top[n]]
            return n

        for i, j in linked([bags[n] for n in names], similarity):
            low, high = sorted((root(names[i]), root(names[j])))
            top[high] = low
        links = [(n, root(n)) for n in names if root(n) != n]
        return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})

    return run


def _counted(table: pa.Table) -> pa.Table:
    """(root, block, element, n) of a block: in how many of its bags each element is."""
    values, begin = _flat(table["bag"])
    element, n = np.unique(values[begin[0] : begin[-1]], return_counts=True)
    same = pa.array(np.zeros(len(element), np.int32))
    return pa.table({"root": table["root"].combine_chunks().take(same), "block": table["block"].combine_chunks().take(same), "element": pa.array(element, pa.int64()), "n": pa.array(n, pa.int64())})


def _heads(similarity: float):
    """From a block's (root, block, node, stray, bag) and the (element, total) of its elements that the group has more than once: (root, block,
    node, element) of the rarest elements of each stray, and with a null node those of all the block's texts."""

    def run(block: pa.Table, common: pa.Table) -> pa.Table:
        values, begin = _flat(block["bag"])
        values, size = values[begin[0] : begin[-1]], np.diff(begin).astype(np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        element, total = common["element"].to_numpy(), common["total"].to_numpy()
        order = np.argsort(element, kind="stable")
        element, total = element[order], total[order]
        at = np.minimum(np.searchsorted(element, values), max(len(element) - 1, 0))
        shared = element[at] == values if len(element) else np.zeros(len(values), bool)
        values, owner, at = values[shared], owner[shared], at[shared]
        # Elements that no other text has come first of all.
        many = np.bincount(owner, minlength=len(size))
        left = _first(size, similarity) - (size - many)
        order = np.lexsort((values, total[at], owner))
        place = np.arange(len(values)) - np.repeat(np.cumsum(many) - many, many)
        head = order[place < left[owner]]
        stray = block["stray"].to_numpy(zero_copy_only=False)[owner[head]]
        every = np.unique(values[head])
        nodes = block["node"].combine_chunks().take(pa.array(owner[head][stray])).to_pylist() + [None] * len(every)
        same = pa.array(np.zeros(len(nodes), np.int32))
        columns = {c: block[c].combine_chunks().take(same) for c in ("root", "block")} if block.num_rows else {"root": pa.array([], pa.binary()), "block": pa.array([], pa.int32())}
        return pa.table({**columns, "node": pa.array(nodes, pa.binary()), "element": pa.array(np.concatenate([values[head][stray], every]), pa.int64())})

    return run


def _near(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of so many rows at most, to be broadcast if they are few."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def _verified(members: DataFrame, similarity: float) -> DataFrame:
    """(node, root) for the members (root, node, bag) of candidate groups that are in a class with others: its least node."""
    shipped(members.sparkSession)
    bytes_of = F.size("bag").cast("long") * 8
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(bytes_of).alias("bytes"))
    # One row for each group beyond a block, so many times fewer than members or bytes.
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    beyond = pinned(sizes.filter(blocks > 1).select("root", blocks.alias("blocks")))
    many = beyond.count()
    near = lambda df: _near(df, many)  # noqa: E731  # tables of a row for each such group
    sized = members.join(near(beyond), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    sized = pinned(sized.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    work = lambda df, *by: df.select(*by, "node", "bag").groupBy(*by).applyInArrow(_search(similarity), _LINKS)
    small = sized.filter("blocks = 1")
    done = pinned(work(small, "root").select(F.col("a").alias("node"), F.col("b").alias("root")))
    if not many:
        removed(sized)
        return done
    large = pinned(sized.filter("blocks > 1"))
    removed(sized)
    # Pivots: the least nodes of block 0 .. PIVOTS - 1, one from each, so that no group is gathered to find them.
    least = large.filter(f"block < {PIVOTS}").groupBy("root", "block").agg(F.min("node").alias("node"))
    pivots = large.join(least.select("root", "node"), ["root", "node"]).select("root", "node", "bag", "blocks")
    spread = pivots.select("root", "node", "bag", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    first = pinned(work(large.select("root", "block", "node", "bag").union(spread.select("root", "block", "node", "bag")), "root", "block"))
    classes = pinned(components(first))
    held = large.select("root", "node", "block", "blocks").join(classes.withColumnRenamed("root", "class"), "node", "left").select("root", "node", "block", "blocks", F.coalesce("class", "node").alias("class"))
    counted = held.groupBy("root", "class").agg(F.count(F.lit(1)).alias("n"))
    top = counted.groupBy("root").agg(F.max(F.struct("n", "class"))["class"].alias("main"))
    strays = pinned(held.join(near(top), "root").filter("class <> main").select("root", "node", "blocks"))
    del spread, pivots, counted, top, held
    released(members.sparkSession)
    few = strays.count()
    if not few:
        removed(large)
        return done.union(classes)
    # Texts outside of the largest class meet the blocks that hold one of their rarest shingles, in parts of a bounded size.
    asked = large.join(near(strays.select("root").distinct()), "root", "left_semi")
    marked = asked.join(_near(strays.select("node", F.lit(True).alias("stray")), few), "node", "left")
    marked = pinned(marked.select("root", "block", "node", F.coalesce("stray", F.lit(False)).alias("stray"), "bag"))
    counts = pinned(marked.select("root", "block", "bag").groupBy("root", "block").applyInArrow(_counted, "root binary, block int, element long, n long"))
    common = counts.groupBy("root", "element").agg(F.sum("n").alias("total")).filter("total > 1")
    held = counts.join(common, ["root", "element"]).select("root", "block", "element", "total")
    heads = pinned(marked.groupBy("root", "block").cogroup(held.groupBy("root", "block")).applyInArrow(_heads(similarity), "root binary, block int, node binary, element long"))
    meet = heads.filter("node is not null").drop("block").join(heads.filter("node is null").select("root", "block", "element"), ["root", "element"]).select("root", "node", "block").distinct()
    bags_of_strays = marked.filter("stray").select("node", "bag")
    meet = pinned(meet.join(marked.filter("stray").select("node", bytes_of.alias("bytes")), "node"))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
    number = pinned(meet.groupBy("root", "block").agg(parts.alias("parts")))
    number = _near(number, number.count())
    sent = meet.join(number, ["root", "block"]).select("root", "block", F.pmod(F.xxhash64(F.lit(1), F.col("node")), F.col("parts")).cast("int").alias("part"), "node")
    left = sent.join(bags_of_strays, "node").select("root", "block", "part", "node", "bag")
    right = marked.join(number, ["root", "block"]).select("root", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", "bag")
    second = pinned(work(left.union(right), "root", "block", "part"))
    removed(large, marked, counts, heads, meet)
    return done.union(components(first.union(second)))


def _text_hash(text: str) -> Column:
    """16 bytes that stand for a text; null for null."""
    return F.unhex(F.md5(F.col(f"`{text}`")))


def signed_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A pinned table (id, text_hash, words_key, bands) with a row for each row of docs."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), _text_hash(text).alias("text_hash"), F.col(f"`{text}`").alias("text"))
    return pinned(signed(rows, ["id", "text_hash"], "text"))


def classes(docs: DataFrame, rows: DataFrame, text: str, similarity: float) -> DataFrame:
    """(words_key, class_key) for the distinct contents that have a word; class_key is the least key of the class."""
    marks = pinned(rows.filter("words_key is not null").groupBy("words_key").agg(F.min(F.struct("text_hash", "bands")).alias("m")).select("words_key", "m.*"))
    spread = marks.select("words_key", F.posexplode("bands").alias("band", "code"))
    least = spread.groupBy("band", "code").agg(F.min("words_key").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "code", "b")
    stars = spread.join(near(least), ["band", "code"]).select(F.col("words_key").alias("a"), "b").filter("a <> b").distinct()
    groups = components(stars)
    wanted = pinned(groups.join(marks.select(F.col("words_key").alias("node"), "text_hash"), "node"))
    hashed = docs.select(_text_hash(text).alias("text_hash"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    texts = hashed.join(_near(wanted.select("text_hash").distinct(), wanted.count()), "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))
    bags = bagged(texts, [], "text").filter("words_key is not null")
    members = wanted.join(bags, wanted["node"] == bags["words_key"]).select("root", "node", "bag")
    del spread, least, stars, groups
    released(docs.sparkSession)
    found = _verified(members, similarity)
    return marks.select("words_key").join(found.select(F.col("node").alias("words_key"), F.col("root").alias("class_key")), "words_key", "left").select("words_key", F.coalesce("class_key", "words_key").alias("class_key"))


def near_duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(key, class_id): for each row of docs the least key of its class, the connected texts with a similarity of 0.8 or more.

    Texts of equal words are in one class. Texts without a word (null and empty ones too) are alone: class_id is their own key.
    Null keys are passed over for class_id unless a class has no other. Repeated rows each give a row. An empty table gives an
    empty table. A very long text is one bag, however large: memory for about 100 bytes for each of its words is needed in one task.
    Other columns may have any names.
    """
    rows = signed_rows(docs, key, text)
    found = classes(docs, rows, text, similarity)
    contents = rows.filter("words_key is not null").groupBy("words_key").agg(F.min("id").alias("least"))
    leasts = pinned(contents.join(found, "words_key"))
    ids = leasts.groupBy("class_key").agg(F.min("least").alias("class_id"))
    by_content = leasts.join(ids, "class_key").select("words_key", "class_id")
    out = rows.select("id", "words_key").join(by_content, "words_key", "left")
    return out.select(F.col("id").alias(key), F.when(F.col("words_key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, without all but one of each class: the one with the least key (null first), then text hash.

    Texts without a word are all kept. Of rows with the same key and text in a class one is kept. An empty table gives an empty
    table; columns may have any names; very long texts are as in ``near_duplicate_classes``.
    """
    rows = signed_rows(docs, key, text)
    found = classes(docs, rows, text, similarity)
    worded = rows.filter("words_key is not null").groupBy("words_key", "id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    first = worded.groupBy("words_key").agg(F.min(F.struct("id", "text_hash", "n")).alias("first"))
    kept = found.join(first, "words_key").groupBy("class_key").agg(F.min("first").alias("first")).select("first.*")
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))
    dropped = pinned(worded.alias("w").join(kept.alias("k"), same("w", "k"), "left_anti").select("id", "text_hash").distinct())
    repeated = pinned(kept.filter("n > 1").select("id", "text_hash"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(F.col(f"`{key}`").alias("id"), _text_hash(text).alias("text_hash"), row)
    left = keyed.alias("d").join(_near(dropped, dropped.count()).alias("x"), same("d", "x"), "left_anti")
    twice = repeated.count()
    if not twice:
        return left.select("row.*")
    single = left.alias("d").join(_near(repeated, twice).alias("x"), same("d", "x"), "left_semi").groupBy("id", "text_hash").agg(F.first("row").alias("row"))
    others = left.alias("d").join(_near(repeated, twice).alias("x"), same("d", "x"), "left_anti")
    return others.select("row.*").union(single.select("row.*"))
