"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

The leaves of the tree are domain, language, source. A total of tokens flows down from the root: at each node it is dealt to
the children in proportion to their weights, no child getting more than its leaves can give (their tokens times the most
epochs). What a child can't take goes to its siblings first, still by weight; only what a whole family can't take goes to the
family's own siblings. Each level is one closed-form pass over the children of each node in order of capacity over weight.

Each leaf then takes a prefix of tokens from its seeded epochs: an epoch is a permutation of the leaf's documents by a seeded
hash of epoch and document; whole epochs give each document once, the last epoch gives a prefix, up to the document that
reaches the budget (it is taken whole, together with documents of the same id and text). The prefix of a leaf is a cut in
hash values: summed tokens of RANGES ranges find the range of the cut, and only that range's documents are put in order, so a
leaf that holds a third of all rows is neither sorted nor gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import pinned, removed

#: Ranges of hash values among which a leaf's cut is looked for; order values are below 2 ** 60.
RANGES = 4096
#: Leaves up to which the plan is broadcast; beyond, it is joined by a shuffle.
MOST_BROADCAST = 100_000
TREE = ("domain", "language", "source")


def token_count(text: str) -> Column:
    """Tokens of a text: its longest runs of characters other than ASCII white space. Null has none."""
    return F.coalesce(F.size(F.filter(F.split(F.col(f"`{text}`"), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The default domains: by the number in the source's name, modulo 3; ``other`` without a number."""
    number = F.regexp_extract(source, "([0-9]+)", 1)
    return F.when(F.coalesce(number, F.lit("")) == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), (F.right(number, F.lit(9)).cast("long") % 3).cast("string")))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    named = weights.get(level)
    if not named:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(F.col(level), F.lit(""))), F.lit(1)).cast("long")


def _same(keys: list[str]) -> list[Column]:
    return [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]


def allot(leaves: DataFrame, total: Column, weights: dict[str, dict[str, int]], epochs: int) -> DataFrame:
    """``leaves`` (domain, language, source, tokens) with ``budget`` (long), the tokens that each leaf is to give.

    ``total`` is an expression over the whole table's tokens (``sum("tokens")`` in a window). ``weights`` has, for each level
    of the tree, integer weights of names; other names weigh 1, and a weight of 0 gives nothing. Shares are rounded down. Null
    names are a node of their own.
    """
    usable = F.when(_weight("domain", weights) * _weight("language", weights) * _weight("source", weights) > 0, F.col("tokens")).otherwise(0)
    nodes = leaves.select(*TREE, "tokens", (usable * epochs).alias("capacity"))
    given: DataFrame | None = None
    for depth in range(1, len(TREE) + 1):
        keys, parent = list(TREE[:depth]), list(TREE[: depth - 1])
        level = nodes.groupBy(*keys).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        if given is None:
            level = level.withColumn("purse", total.cast("long"))
        else:
            level = level.alias("a").join(given.alias("b"), _same(parent)).select("a.*", F.col("b.budget").alias("purse"))
        level = level.withColumn("weight", _weight(keys[-1], weights))
        live = F.col("weight") > 0
        useful = F.when(live, F.col("capacity")).otherwise(0)
        family = Window.partitionBy(*parent).orderBy(F.when(live, F.col("capacity") / F.col("weight")).otherwise(0.0), F.col(keys[-1]))
        left = F.col("purse") - F.coalesce(F.sum(useful).over(family.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rest = F.sum("weight").over(family.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        # While children are filled the rate of those after them rises, then it falls: its peak is the rate for all.
        rated = level.select("*", useful.alias("useful"), F.when(live, F.greatest(left, F.lit(0)).cast("double") / rest).alias("rate"))
        peak = F.max("rate").over(Window.partitionBy(*parent))
        share = F.when(live, F.least(F.col("useful"), F.floor(peak * F.col("weight")))).otherwise(0).cast("long")
        given = rated.select(*keys, share.alias("budget"))
    return leaves.alias("a").join(given.alias("b"), _same(list(TREE))).select("a.*", F.col("b.budget").alias("budget"))


def _order(identity: Column, epoch: Column) -> Column:
    """A number below 2 ** 60 for a document in an epoch."""
    return F.conv(F.substring(F.md5(F.concat(identity, F.lit(":"), epoch.cast("string"))), 1, 15), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame,
    share: tuple[int, int] = (4, 5),
    weights: dict[str, dict[str, int]] | None = None,
    epochs: int = 2,
    seed: int = 17,
    names: tuple[str, str, str, str] = ("doc_id", "text", "lang", "source"),
    domain: Column | None = None,
    copies: str = "copies",
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all columns and ``copies`` (int), the epochs that each is taken in.

    The total is the fraction ``share`` of all tokens. Null ids, languages and sources are values like others; null and empty
    texts have no tokens and are taken in the whole epochs of their leaf and where the prefix passes them; repeated rows are
    taken together; an empty table gives an empty table. A very long text counts with all its tokens. A column of docs of that name
    is replaced; others may have any names.
    """
    weights = weights or {}
    key, text, language, source = names
    docs = docs.drop(copies)
    col = lambda c: F.col(f"`{c}`")
    where = domain if domain is not None else domain_of(col(source))
    identity = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(col(key).cast("string"), F.lit("")), F.md5(F.coalesce(col(text), F.lit("")))))
    place = [where.alias("domain"), col(language).cast("string").alias("language"), col(source).cast("string").alias("source")]
    slim = pinned(docs.select(*place, identity.alias("identity"), token_count(text).alias("tokens")))
    leaves = slim.groupBy(*TREE).agg(F.sum("tokens").alias("tokens"))
    # The root's children are few; its window holds the sum of all leaves.
    total = F.expr(f"sum(tokens) over () * {share[0]} div {share[1]}")
    plan = allot(leaves, total, weights, epochs)
    plan = plan.select(*TREE, F.expr("if(tokens > 0, budget div tokens, 0)").alias("whole"), F.expr("if(tokens > 0, budget % tokens, 0)").alias("part"))
    plan = pinned(plan)
    few = plan.count() <= MOST_BROADCAST
    near = F.broadcast if few else lambda x: x
    ordered = slim.alias("a").join(near(plan.filter("part > 0")).alias("b"), _same(list(TREE))).select("a.*", "b.part", _order(F.col("identity"), F.col("b.whole") + 1).alias("at"))
    width = (1 << 60) // RANGES
    ranged = ordered.withColumn("range", F.expr(f"at div {width}"))
    sums = ranged.groupBy(*TREE, "range").agg(F.sum("tokens").alias("tokens"), F.first("part").alias("part"))
    so_far = Window.partitionBy(*TREE).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = sums.withColumn("upto", F.sum("tokens").over(so_far)).filter("upto >= part and upto - tokens < part").select(*TREE, "range", (F.col("part") - F.col("upto") + F.col("tokens")).alias("need"))
    inside = ranged.alias("a").join(near(cuts).alias("b"), [*_same(list(TREE)), F.col("a.range") == F.col("b.range")]).select("a.*", "b.need")
    by_at = Window.partitionBy(*TREE).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("upto", F.sum("tokens").over(by_at)).filter("upto >= need").groupBy(*TREE).agg(F.min("at").alias("last"))
    full = pinned(plan.alias("a").join(last.alias("b"), _same(list(TREE)), "left").select("a.*", "b.last"))
    removed(slim, plan)
    taken = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), *place, identity.alias("identity")).alias("a").join(near(full).alias("b"), _same(list(TREE)))
    extra = F.when(_order(F.col("identity"), F.col("whole") + 1) <= F.col("last"), 1).otherwise(0)
    return taken.select("row.*", (F.col("whole") + extra).cast("int").alias(copies)).filter(F.col(copies) > 0)
