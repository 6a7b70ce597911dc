"""Referential completeness and reconciliation between two datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .duplicate import keyed


def keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.select(keyed(df, key).alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))


def only_left(left: DataFrame, left_key: Sequence[str], right: DataFrame, right_key: Sequence[str]) -> DataFrame:
    """key, n: keys of the left that the right does not have, and their rows. Blank keys are left out."""
    return keys(left, left_key).join(keys(right, right_key), "key", "left_anti")


def _sides(left: DataFrame, left_key: Sequence[str], right: DataFrame, right_key: Sequence[str], amounts: tuple[Column, Column] | None) -> DataFrame:
    """Every key of either side, with the sum of its amounts on each."""
    zero = F.lit(0).cast("decimal(38,4)")
    a, b = (
        df.select(keyed(df, key).alias("key"), (F.coalesce(amounts[i].try_cast("decimal(38,4)"), zero) if amounts else zero).alias("amount")).where("key IS NOT NULL").groupBy("key").agg(F.sum("amount").alias(side), F.lit(1).alias(f"has_{side}"))
        for i, (df, key, side) in enumerate(((left, left_key, "l"), (right, right_key, "r")))
    )
    return a.join(b, "key", "full_outer")


def _differs(tolerance: float) -> Column:
    return F.abs(F.col("l") - F.col("r")) > F.lit(tolerance).cast("decimal(38,4)")


def unmatched(left: DataFrame, left_key: Sequence[str], right: DataFrame, right_key: Sequence[str], amounts: tuple[Column, Column] | None = None, tolerance: float = 0.01) -> DataFrame:
    """key: those of the left that the right doesn't have, or has with another sum."""
    return _sides(left, left_key, right, right_key, amounts).where(F.col("has_l").isNotNull() & (F.col("has_r").isNull() | _differs(tolerance))).select("key")


def reconcile(left: DataFrame, left_key: Sequence[str], right: DataFrame, right_key: Sequence[str], amounts: tuple[Column, Column] | None = None, tolerance: float = 0.01) -> DataFrame:
    """One row: left_keys, right_keys, matched, only_left, only_right, differing.

    With two amount columns, matched keys whose sums differ by more than the tolerance
    are counted as differing. Sums are exact decimals.
    """
    both = _sides(left, left_key, right, right_key, amounts)
    has_l, has_r = F.col("has_l").isNotNull(), F.col("has_r").isNotNull()
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return both.agg(
        count(has_l).alias("left_keys"),
        count(has_r).alias("right_keys"),
        count(has_l & has_r).alias("matched"),
        count(has_l & ~has_r).alias("only_left"),
        count(~has_l & has_r).alias("only_right"),
        count(has_l & has_r & _differs(tolerance)).alias("differing"),
    )
