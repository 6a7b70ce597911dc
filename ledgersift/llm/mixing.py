"""Mixing sources to target weights by hierarchical budgeting; DataFrame functions only.

The tree is domain > language > source. A budget of tokens is handed down: a node's
children share it by weight, no child gets more than its leaves can give
(``max_epochs`` times their tokens), and what a child cannot use goes to its siblings by
weight. So a shortage stays among siblings, and reaches the siblings of an ancestor only
where all of its leaves are full. The level that siblings are filled to is found with
window functions over the few rows of the tree.

A leaf with budget b and t tokens yields floor(b / t) whole epochs, and of the next epoch
the longest prefix of its documents, in the seeded order of that epoch, that fits into the
rest. The order is that of an md5 of seed, epoch and id. Prefix sums are in two levels:
each leaf is cut into ranges of the order, the ranges' sums are added up, and only the
range in which the prefix ends is summed document by document. So no leaf is sorted as a
whole, however many rows it has.

Documents without words (null and empty texts too) are never selected. A null id, domain,
language or source is a value of its own, and is null in the result. Weights that are missing are 1; a negative or
zero weight gives a node nothing as long as a sibling has room for it. Repeated rows count
each. An empty table selects nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Documents that a range of a leaf's order holds, about.
RANGE_ROWS = 2000
LEVELS = ("domain", "lang", "source")
#: Stands for a null in the tree.
NONE = "\x00"


def words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != "")).cast("long")


def weight(names: Column, weights: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for name, w in weights.items():
        out = F.when(names == name, F.lit(float(max(w, 0)))).otherwise(out)
    return out


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children (parent, name, w, room) with ``given`` of their parent -> ``budget``.

    Children are ordered by room over weight. Up to some place all are filled; those
    after it share what is left by weight.
    """
    ratio = F.when(F.col("w") > 0, F.col("room") / F.col("w")).otherwise(F.lit(float("inf")))
    by = Window.partitionBy(*parent).orderBy("ratio", name)
    before = F.coalesce(F.sum("room").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = children.withColumn("ratio", ratio).withColumn("before", before).withColumn("after", after)
    level = F.when(F.col("after") > 0, F.greatest(F.col("given") - F.col("before"), F.lit(0.0)) / F.when(F.col("after") > 0, F.col("after")))
    rows = rows.withColumn("level", level)
    water = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(Window.partitionBy(*parent))
    rows = rows.withColumn("water", water)
    fair = F.when(F.col("water").isNull(), F.col("room")).otherwise(F.least("room", F.col("water") * F.col("w")))
    # a weight of zero takes what all others leave
    idle = (F.col("w") <= 0) & (F.col("given") > F.col("before"))
    fair = F.when(idle, F.least("room", F.col("given") - F.col("before"))).otherwise(fair)
    return rows.withColumn("budget", F.least("room", fair)).drop("ratio", "before", "after", "level", "water")


def budgets(leaves: DataFrame, weights: dict[str, dict], default: dict[str, float], total: Column, max_epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens) -> and ``budget``, in tokens."""
    node = leaves.withColumn("room", F.col("tokens") * F.lit(float(max_epochs)))
    given = node.agg(total.cast("double").alias("given"))
    out = None
    for depth, name in enumerate(LEVELS):
        parent = list(LEVELS[:depth])
        level = node.groupBy(*parent, name).agg(F.sum("room").alias("room")).withColumn("w", weight(F.col(name), weights.get(name, {}), default.get(name, 1.0)))
        if out is None:
            level = level.withColumn("one", F.lit(0)).join(given.withColumn("one", F.lit(0)), "one")
            key = ["one"]
        else:
            level, key = level.join(out, parent), parent
        out = share_out(level, key, name).select(*parent, name, F.col("budget").alias("given"))
    return leaves.join(out.withColumnRenamed("given", "budget"), list(LEVELS))


def mix(
    docs: DataFrame,
    domain: Column,
    weights: dict[str, dict],
    default: dict[str, float] | None = None,
    total: Column | None = None,
    max_epochs: int = 4,
    seed: int = 1,
) -> DataFrame:
    """docs (doc_id, text, lang, source) -> doc_id, domain, lang, source, n_tokens, epoch (from 0).

    ``total`` is an aggregate over the leaves; by default half of all tokens.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    shown = lambda c: F.coalesce(c, F.lit(NONE))
    rows = docs.select("doc_id", shown(domain).alias("domain"), shown(F.col("lang")).alias("lang"), shown(F.col("source")).alias("source"), words(F.col("text")).alias("n_tokens"))
    rows = scratch.put(rows.where("n_tokens > 0"), "tokens")
    leaves = scratch.put(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "leaves")
    total = total if total is not None else F.sum("tokens") * 0.5
    plan = budgets(leaves.drop("rows"), weights, default or {}, total, max_epochs)
    whole = F.floor(F.round(F.col("budget"), 6) / F.col("tokens"))
    plan = plan.withColumn("epochs", whole.cast("int")).withColumn("rest", F.floor(F.round(F.col("budget"), 6) - F.col("tokens") * whole + 1e-6))
    plan = scratch.put(plan.select(*LEVELS, "epochs", "rest"), "plan")
    most = leaves.agg(F.max("rows")).first()[0] or 1
    ranges = 1 << max(0, min(24, math.ceil(math.log2(max(1, most / RANGE_ROWS)))))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    # a row for each leaf: Spark broadcasts it only below its own limit
    rows = rows.join(plan, list(LEVELS)).withColumn("order", order)
    rows = rows.withColumn("range", F.shiftright(F.conv(F.substring("order", 1, 7), 16, 10).cast("long") * ranges, 28))
    sums = rows.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("size"), F.first("rest").alias("rest"))
    by = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("size").over(by), F.lit(0))).select(*LEVELS, "range", "size", "before")
    rows = rows.join(sums, [*LEVELS, "range"])
    rest = F.col("rest")
    full = rows.where(F.col("before") + F.col("size") <= rest).select("doc_id", *LEVELS, "n_tokens", "epochs", F.lit(True).alias("extra"))
    none = rows.where((F.col("before") + F.col("size") > rest) & (F.col("before") >= rest)).select("doc_id", *LEVELS, "n_tokens", "epochs", F.lit(False).alias("extra"))
    edge = rows.where((F.col("before") + F.col("size") > rest) & (F.col("before") < rest))
    within = Window.partitionBy(*LEVELS, "range").orderBy("order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("extra", F.col("before") + F.sum("n_tokens").over(within) <= rest).select("doc_id", *LEVELS, "n_tokens", "epochs", "extra")
    every = full.unionByName(none).unionByName(edge)
    copies = F.col("epochs") + F.col("extra").cast("int")
    out = every.where(copies > 0).select("doc_id", *[F.nullif(F.col(c), F.lit(NONE)).alias(c) for c in LEVELS], "n_tokens", F.explode(F.sequence(F.lit(0), copies - 1)).alias("epoch"))
    return out
