"""Mixing sources to target weights: budgets over a tree of domain, language and source, then a token prefix per leaf.

A node's budget is shared among its children by weight. A child that has less than its share (its tokens times the epochs
allowed) takes what it has, and what is left over goes to its siblings by weight; only what a whole subtree cannot take was
never given to it, as a subtree enters its parent's sharing with the sum of its leaves. A leaf with budget T and A tokens
takes T div A whole epochs, and T mod A tokens of one more epoch in an order seeded by leaf epoch and document.

Everything is DataFrame functions. The prefix is found by radix descent on the order's hash: token sums of 4,096 ranges per
leaf, again of 4,096 ranges of the one where the prefix ends, and a running sum over the rows of that last range only, about
one in 16 million of the leaf.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalrates.operators.joins import hot_keys, left_join
from vitalrates.session import cut_lineage, fits

LEVELS = ("domain", "lang", "source")
WORD = "[^ \\x09-\\x0D]+"


def domain_by_source(column: str = "source") -> Column:
    """Domain of a source by the number it ends with; without one: web; NULL for a NULL source."""
    number = F.regexp_extract(F.col(column), "([0-9]{1,9})$", 1)
    names = F.array(*[F.lit(x) for x in ("web", "books", "code", "forum")])
    place = number.try_cast("int") % 4
    return F.when(number == "", F.lit("web")).when(F.col(column).isNotNull(), F.get(names, place))


def _weight(weights: Mapping[str, float], path: Column) -> Column:
    """Weight of a node by its path such as web/en/src0; 1 where none is given."""
    if not weights:
        return F.lit(1.0)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])[path], F.lit(1.0))


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add `budget` (whole tokens) to siblings with `given` (of the parent), `capacity` and `weight`.

    In order of capacity per weight the siblings that stay below the common level are full and form a prefix; the rest share
    what is left by weight, rounded down. A sibling of weight 0 gets nothing.
    """
    live = children.where((F.col("weight") > 0) & (F.col("capacity") > 0))
    ratio = F.col("capacity") / F.col("weight")
    order = Window.partitionBy(*parent).orderBy("ratio", name) if parent else Window.partitionBy(F.lit(0)).orderBy("ratio", name)
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.col("given") - before) / left
    out = live.withColumn("ratio", ratio).withColumn("level", level)
    common = F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(group)
    budget = F.when(F.col("level") < F.col("ratio"), F.floor(F.col("weight") * F.col("common"))).otherwise(F.col("capacity"))
    return out.withColumn("common", common).withColumn("budget", budget.cast("long")).drop("ratio", "level", "common", "given")


def leaf_budgets(leaves: DataFrame, budget: Column, weights: Mapping[str, float], max_epochs: int) -> DataFrame:
    """domain, lang, source, tokens, budget of every leaf of positive budget, from their token sums."""
    sized = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    top = sized.groupBy("domain").agg(F.sum("capacity").alias("capacity")).withColumn("given", budget)
    top = share_out(top.withColumn("weight", _weight(weights, F.col("domain"))), [], "domain")
    middle = sized.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    middle = middle.join(top.select("domain", F.col("budget").alias("given")), "domain")
    middle = share_out(middle.withColumn("weight", _weight(weights, F.concat_ws("/", "domain", "lang"))), ["domain"], "lang")
    low = sized.join(middle.select("domain", "lang", F.col("budget").alias("given")), ["domain", "lang"])
    low = share_out(low.withColumn("weight", _weight(weights, F.concat_ws("/", *LEVELS))), ["domain", "lang"], "source")
    return low.select(*LEVELS, "tokens", "budget").where("budget > 0")


def _edge(sums: DataFrame, part: str, target: str) -> DataFrame:
    """Per leaf the part where the running token sum passes `target`, and the sum before it."""
    order = Window.partitionBy(*LEVELS).orderBy(part)
    running = F.sum("tokens").over(order)
    rows = sums.withColumn("after", running).withColumn("before", F.col("after") - F.col("tokens"))
    rows = rows.where((F.col("before") < F.col(target)) & (F.col("after") >= F.col(target)))
    return rows.select(*LEVELS, F.col(part).alias("edge"), F.col("before").alias("passed"))


def _at_leaf(rows: DataFrame, leaves: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the columns of their leaf: a broadcast of the stored leaves once measured, else a join with hot sources sliced."""
    if fits(leaves):
        return rows.join(F.broadcast(leaves), list(LEVELS), how)
    by = ["doc_id", "tie"]
    return left_join(rows, leaves, LEVELS, null_safe=False, hot=hot_keys(rows, "source"), spread_by=by, how=how)


def mixture(
    docs: DataFrame, *, weights: Mapping[str, float], share: float = 1.0, max_epochs: int = 4, seed: int = 7,
    domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Chosen rows: doc_id, domain, lang, source, n_tokens, epochs (whole ones), part (tokens of one more), taken.

    The budget is `share` of all tokens (words). NULL language and source are the leaf `none`; texts without words have no
    tokens and are never chosen; rows of one leaf with the same doc_id are ordered by their token count and text hash, a NULL
    doc_id is an id like any other. An empty table gives no rows. Other columns of the input are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (domain if domain is not None else domain_by_source()).alias("domain"),
        F.coalesce(F.col("lang"), F.lit("none")).alias("lang"), F.coalesce(F.col("source"), F.lit("none")).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"), F.xxhash64(text).alias("tie"),
    ).where("n_tokens > 0").withColumn("domain", F.coalesce("domain", F.lit("none")))
    rows = cut_lineage(rows)
    leaves = cut_lineage(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    budgets = leaf_budgets(leaves, F.lit(int(total * share)).cast("long"), weights, max_epochs)
    budgets = cut_lineage(budgets.select(
        *LEVELS, F.expr("budget div tokens").alias("epochs"), (F.col("budget") % F.col("tokens")).alias("rest")
    ))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "epochs", "doc_id"))
    ordered = _at_leaf(rows, budgets).withColumn("key", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    ordered = ordered.withColumn("coarse", F.shiftright("key", 48)).withColumn("fine", F.shiftright("key", 36) % 4096)
    first = ordered.where("rest > 0").groupBy(*LEVELS, "coarse", "rest").agg(F.sum("n_tokens").alias("tokens"))
    first = cut_lineage(_edge(first, "coarse", "rest"))
    near = _at_leaf(ordered, first).where("coarse = edge").withColumn("goal", F.col("rest") - F.col("passed"))
    second = near.groupBy(*LEVELS, "fine", "goal").agg(F.sum("n_tokens").alias("tokens"))
    second = _edge(second, "fine", "goal").withColumnsRenamed({"edge": "edge2", "passed": "passed2"})
    ends = cut_lineage(first.join(second, list(LEVELS)))
    every = _at_leaf(ordered, ends, "left")
    last = (F.col("coarse") == F.col("edge")) & (F.col("fine") == F.col("edge2"))
    inside = (F.col("coarse") < F.col("edge")) | ((F.col("coarse") == F.col("edge")) & (F.col("fine") < F.col("edge2")))
    whole = every.where(~F.coalesce(last, F.lit(False))).withColumn("part", F.when(inside, F.col("n_tokens")).otherwise(F.lit(0)))
    order = Window.partitionBy(*LEVELS).orderBy("key", "doc_id", "n_tokens", "tie")
    cut = every.where(last).withColumn("after", F.sum("n_tokens").over(order))
    room = F.col("rest") - F.col("passed") - F.col("passed2") - (F.col("after") - F.col("n_tokens"))
    cut = cut.withColumn("part", F.greatest(F.lit(0), F.least(F.col("n_tokens"), room)))
    columns = ["doc_id", *LEVELS, "n_tokens", "epochs", F.col("part").cast("long").alias("part")]
    out = whole.select(*columns).union(cut.select(*columns))
    return out.withColumn("taken", F.col("epochs") * F.col("n_tokens") + F.col("part")).where("taken > 0")


def epochs(chosen: DataFrame) -> DataFrame:
    """One row per document and epoch with the tokens to take from its start: the order a training run reads."""
    every = chosen.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    tokens = F.when(F.col("epoch") < F.col("epochs"), F.col("n_tokens")).otherwise(F.col("part"))
    return every.select("doc_id", *LEVELS, "epoch", tokens.alias("tokens")).where("tokens > 0")
