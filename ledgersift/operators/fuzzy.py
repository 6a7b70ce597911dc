"""Spelling variants of names, collapsed before entities are counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import norm_key, norm_name, trigrams
from ..names import ident
from .graph import components

THRESHOLD = 0.55


def names_of(df: DataFrame, name: str, identifier: str | None = None) -> DataFrame:
    """scope, name: distinct normalised names, within an identifier if there is one."""
    scope = norm_key(F.col(ident(identifier))) if identifier else F.lit("")
    return df.select(scope.alias("scope"), norm_name(F.col(ident(name))).alias("name")).where("scope IS NOT NULL AND name IS NOT NULL").distinct()


def similar_pairs(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """scope, a, b, similarity (a < b): pairs whose trigram Jaccard similarity is at least the threshold.

    Only pairs that share one of their rarest trigrams can reach it (prefix filter), so
    frequent trigrams never bring names together; what comes together is compared exactly.
    """
    grams = names.withColumn("grams", trigrams(F.col("name"))).withColumn("size", F.size("grams"))
    each = grams.select("scope", "name", "size", F.explode("grams").alias("gram"))
    often = each.groupBy("gram").agg(F.count("*").alias("often"))
    rare = Window.partitionBy("scope", "name").orderBy("often", "gram")
    prefix = F.col("size") - F.ceil(F.lit(threshold) * F.col("size")) + 1
    few = each.join(often, "gram").withColumn("r", F.row_number().over(rare)).where(F.col("r") <= prefix).select("scope", "name", "size", "gram")
    x, y = few.alias("x"), few.alias("y")
    fits = (F.least("x.size", "y.size") >= F.lit(threshold) * F.greatest("x.size", "y.size")) & (F.col("x.name") < F.col("y.name"))
    met = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.scope") == F.col("y.scope")) & fits)
    met = met.select(F.col("x.scope").alias("scope"), F.col("x.name").alias("a"), F.col("y.name").alias("b")).distinct()
    common = F.size(F.array_intersect(trigrams(F.col("a")), trigrams(F.col("b"))))
    union = F.size(F.array_union(trigrams(F.col("a")), trigrams(F.col("b"))))
    return met.withColumn("similarity", common / union).where(F.col("similarity") >= threshold)


def clusters(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """scope, name, cluster: single-link groups of similar names; the cluster is its smallest name."""
    pairs = similar_pairs(names, threshold)
    node = lambda c: F.struct(F.col("scope"), F.col(c).alias("name"))
    roots = components(pairs.select(node("a").alias("a"), node("b").alias("b"))).select("node.scope", "node.name", F.col("root.name").alias("cluster"))
    return names.join(roots, ["scope", "name"], "left").select("scope", "name", F.coalesce("cluster", "name").alias("cluster"))


def conflicts(df: DataFrame, identifier: str, name: str, threshold: float = THRESHOLD) -> DataFrame:
    """key, n_entities, n_names: identifiers of more than one entity, spelling variants counted once."""
    grouped = clusters(names_of(df, name, identifier), threshold)
    return grouped.groupBy(F.col("scope").alias("key")).agg(F.count_distinct("cluster").alias("n_entities"), F.count("*").alias("n_names")).where("n_entities > 1")
