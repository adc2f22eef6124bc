"""Exact top-k by inner product with Fagin's threshold algorithm over sorted per-dimension lists.

A floor for each query's k-th best score comes first, from a bounded sample of rows. Then vectors are dealt into blocks; each task
has one block of queries and one of candidates. The candidates are sorted along every dimension. A query reads each of its lists
from the end that its own component favours, to depths that grow step by step; rows that turn up in any list are scored in full.
What a row not yet seen can reach is at most the sum of query component times the last value read in each list. Once that bound is
below the k-th best score (the floor at first) the block is done for this query; equal scores go on, as ties fall to smaller ids.

Lists of dimensions in which the query is 0 aren't read. The bound may fall too slowly to pay: in many nearly independent dimensions
all rows turn up before it gets anywhere. Lists are read until together they have given as many entries as the block has rows. Where
even there the bound exceeds what any row can score (lengths of query and longest row multiplied), or where that depth is reached,
the query scores the whole block in one matrix product with others like it. So the work is that of a matrix product at worst. The best of all blocks are merged by a window that each task cuts to k rows beforehand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import shipped

#: Components in a block of candidates, rows in one of queries, rows in the sample for the floors, queries scored in one product.
CANDIDATES, QUERIES = 1 << 20, 4096
SAMPLE = 2048
TOGETHER = 256
#: Depths of sorted access: the first, and how many times as deep each next one is.
FIRST_DEPTH, DEEPER = 16, 4
_SCHEMA = "query_id long, vec_id long, score long"


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).reshape(size, -1)


def _best(rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of some rows, in order of score and place (places are in order of id)."""
    if len(rows) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= floor
        rows, scores = rows[keep], scores[keep]
    by = np.lexsort((rows, -scores))[:k]
    return rows[by], scores[by]


def search_block(
    queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, read: list[int] | None = None, floors: np.ndarray | None = None
):
    """(query place, id, score) of the k best rows in the block for each query, but rows of the query's own id.

    ``floors`` has for each query a score that its k-th best row in the whole table reaches; rows below may be left out. ``read``
    gets the number of rows scored for each query.
    """
    count, dims = rows.shape
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(dims, 1)
    kind = np.float64 if most < 2.0**52 else object
    x, q = rows.astype(kind), queries.astype(kind)
    own_from, own_to = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    scored = np.full(len(q), count)
    floor = np.full(len(q), -np.inf) if floors is None else floors.astype(float)
    depths = [FIRST_DEPTH]
    while depths[-1] * DEEPER <= count:
        depths.append(depths[-1] * DEEPER)
    lists = np.count_nonzero(q, axis=1)
    deepest = np.searchsorted(np.array(depths) * 1.0, count / np.maximum(lists, 1), "right") - 1
    hard = (deepest < 0) | (count < 2 * FIRST_DEPTH)
    if not hard.all():
        # The values at the deepest places from both ends of each list, without sorting the rest.
        columns = np.ascontiguousarray(x.T)
        rising, falling = np.maximum(q, 0), np.minimum(q, 0)
        least = np.full(len(q), np.inf)
        for step in np.unique(deepest[~hard]).tolist():
            d, those = depths[step], deepest == step
            ends = np.partition(columns, (d - 1, count - d), axis=1)
            least[those] = (rising[those] @ ends[:, count - d] + falling[those] @ ends[:, d - 1]).astype(float)
        # No row scores more than the product of lengths.
        longest = np.sqrt((rows.astype(float) ** 2).sum(axis=1).max(initial=0))
        cap = np.sqrt((queries.astype(float) ** 2).sum(axis=1)) * longest * (1 + 1e-9)
        hard |= (least >= cap) & (least >= floor)
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if not hard.all():
        by_column = np.argsort(columns, axis=1, kind="stable")
        sorted_columns = np.take_along_axis(columns, by_column, axis=1)
        reached = np.stack([rising @ sorted_columns[:, count - d] + falling @ sorted_columns[:, d - 1] for d in depths], axis=1).astype(float)
        for n in np.flatnonzero(~hard).tolist():
            best, scores, seen = np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(count, bool)
            seen[own_from[n] : own_to[n]] = True
            upward, downward, live = np.flatnonzero(q[n] > 0), np.flatnonzero(q[n] < 0), np.flatnonzero(q[n])
            for step, d in enumerate(depths[: deepest[n] + 1]):
                turned_up = np.zeros(count, bool)
                turned_up[by_column[upward, count - d :]] = True
                turned_up[by_column[downward, :d]] = True
                new = np.flatnonzero(turned_up & ~seen)
                seen |= turned_up
                gained = q[n][live] @ columns[live[:, None], new] if 4 * len(live) < dims else x[new] @ q[n]
                best, scores = _best(np.concatenate([best, new]), np.concatenate([scores, gained]), k)
                if reached[n, step] < max(floor[n], float(scores.min()) if len(best) >= k else -np.inf):
                    found[n] = best, scores
                    scored[n] = int(seen.sum())
                    break
            else:
                hard[n] = True
    rest = np.flatnonzero(hard)
    for first in range(0, len(rest), TOGETHER):
        some = rest[first : first + TOGETHER]
        table = q[some] @ x.T
        for row, n in enumerate(some.tolist()):
            scores = table[row]
            a, b = own_from[n], own_to[n]
            others = np.concatenate([np.arange(a), np.arange(b, count)]) if b > a else np.arange(count)
            found[n] = _best(others, scores[others] if b > a else scores, k)
    if read is not None:
        read.extend(scored.tolist())
    for n in range(len(q)):
        for place_of, score in zip(*map(np.ndarray.tolist, found[n]), strict=True):
            yield n, int(ids[place_of]), max(-(1 << 63), min((1 << 63) - 1, int(score)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of the highest inner product of floor(scale * component).

    ``is_query`` is a condition on the column ``key``. Rows with the query's own id aren't its candidates; ties go to smaller
    ids; fewer than k candidates are all returned. Rows whose id or vector is null, or whose vector holds a null or non-finite
    component, take no part; vectors only meet vectors of their own length. Repeated rows are each a candidate, so an id may come
    several times; as queries, all rows of an id share one list of k. An empty table gives an empty table. Very long vectors are
    worked on like others, a block at a time. Other columns may have any names.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    usable = usable.filter("id is not null and v is not null").filter(F.forall("v", finite))
    # Of rows alike no more than k can be among the k best.
    ready = usable.select("id", "asks", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("v")).groupBy("id", "asks", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("copies")).withColumn("size", F.size("v"))
    counts = ready.agg(F.sum("copies").alias("rows"), F.sum(F.col("copies") * F.greatest("size", F.lit(1))).alias("values"), F.count_if("asks").alias("queries")).first()
    shipped(vectors.sparkSession)
    total = counts["rows"] or 0
    q_blocks, c_blocks = max(1, -(-counts["queries"] // QUERIES)), max(1, -(-(counts["values"] or 0) // CANDIDATES))
    dealt = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = ready.filter("asks").select("size", "id", "v", dealt(q_blocks, 1).alias("qb"))
    answering = ready.select("size", "id", "v", F.explode(F.expr("array_repeat(0, cast(copies as int))")).alias("copy")).drop("copy")

    def found_in(queries: pa.Table, rows: pa.Table) -> list:
        if not queries.num_rows or not rows.num_rows:
            return []
        q, x = _matrix(queries["v"], queries.num_rows), _matrix(rows["v"], rows.num_rows)
        names, ids = queries["id"].to_numpy(), rows["id"].to_numpy()
        floors = queries["floor"].fill_null(float("-inf")).to_numpy() if "floor" in queries.column_names else None
        return [(int(names[n]), i, s) for n, i, s in search_block(q, names, x, ids, k, floors=floors)]

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = found_in(queries, rows)
        return pa.table({name: pa.array([f[i] for f in found], pa.int64()) for i, name in enumerate(("query_id", "vec_id", "score"))})

    if c_blocks > 1:
        # The k-th best score in the sample, in the table's own row of a query: several vectors of one id have lists of their own.
        sample = answering.filter(F.pmod(F.xxhash64(F.lit(3), "id", "v"), F.lit(1 << 20)) < (SAMPLE << 20) // total)

        def least(queries: pa.Table, rows: pa.Table) -> pa.Table:
            floor = np.full(queries.num_rows, -np.inf)
            if queries.num_rows and rows.num_rows:
                q, x, names = _matrix(queries["v"], queries.num_rows), _matrix(rows["v"], rows.num_rows), queries["id"].to_numpy()
                scores: dict[int, list[int]] = {}
                for n, _, s in search_block(q, names, x, rows["id"].to_numpy(), k):
                    scores.setdefault(n, []).append(s)
                for n, s in scores.items():
                    floor[n] = min(s) if len(s) == k else -np.inf
            return pa.table({"size": queries["size"], "id": queries["id"], "v": queries["v"], "qb": queries["qb"], "floor": pa.array(floor)})

        asking = asking.groupBy("size", "qb").cogroup(sample.withColumn("qb", every(q_blocks)).groupBy("size", "qb")).applyInArrow(least, "size int, id long, v array<bigint>, qb int, floor double")
    asking = asking.withColumn("cb", every(c_blocks))
    answering = answering.withColumn("cb", dealt(c_blocks, 2)).withColumn("qb", every(q_blocks))
    keys = ["size", "qb", "cb"]
    found = asking.groupBy(*keys).cogroup(answering.groupBy(*keys)).applyInArrow(search, _SCHEMA)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
