"""Duplicate identifiers, and identifiers that many different values share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decode_key, encode_columns, encode_key, norm_key, norm_name, whole_numbers
from ..names import ident


def keyed(df: DataFrame, key: Sequence[str], norm=norm_key) -> Column:
    """The normalised key of a row; null if a part of it is null or blank. Whole numbers stay as they are."""
    if whole_numbers(df, key):
        return F.when(_known(key), encode_columns(df, key))
    parts = _parts(df, key, norm)
    if len(parts) == 1:
        return parts[0].cast("string")
    null = parts[0].isNull()
    for p in parts[1:]:
        null = null | p.isNull()
    return F.when(~null, encode_key(*parts))


def _known(key: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in key:
        out = out & F.col(ident(k)).isNotNull()
    return out


def _parts(df: DataFrame, key: Sequence[str], norm=norm_key) -> list[Column]:
    return [F.col(ident(k)) if whole_numbers(df, [k]) else norm(F.col(ident(k))) for k in key]


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, n: keys that more than one row has. Blank keys are left out (count them with ``blanks``)."""
    # grouped as they are typed; only what is found becomes a text
    names = [f"k{i}" for i in range(len(key))]
    rows = df.select(*[p.alias(n) for p, n in zip(_parts(df, key), names)]).dropna()
    found = rows.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1")
    return found.select(encode_columns(found, names).cast("string").alias("key"), "n")


def blanks(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.agg(F.coalesce(F.sum(keyed(df, key).isNull().cast("long")), F.lit(0)).alias("blank"), F.count("*").alias("rows"))


def shared(df: DataFrame, identifier: str, value: str) -> DataFrame:
    """key, n_values, n: identifiers under which more than one distinct value stands."""
    rows = df.select(keyed(df, [identifier]).alias("key"), norm_name(F.col(ident(value))).alias("value")).where("key IS NOT NULL AND value IS NOT NULL")
    # pairs are counted first: a key with very many rows is spread by its values
    pairs = rows.groupBy("key", "value").agg(F.count("*").alias("n"))
    return pairs.groupBy("key").agg(F.count("*").alias("n_values"), F.sum("n").alias("n")).where("n_values > 1")


def flagged_rows(df: DataFrame, key: Sequence[str], flagged: DataFrame) -> DataFrame:
    """The rows whose key is flagged, with the key as ``flag``: the basis of evidence links."""
    if not whole_numbers(df, key):
        mine = df.withColumn("flag", keyed(df, key))
        return mine.join(flagged.select(F.col("key").alias("flag")), "flag", "left_semi")
    # joined as they are typed: only flagged keys are read back from their texts
    part = decode_key(F.col("key"), len(key))
    wanted = flagged.select(*[part[i].cast(df.schema[k].dataType).alias(f"__flag{i}") for i, k in enumerate(key)])
    on = F.lit(True)
    for i, k in enumerate(key):
        on = on & (df[ident(k)] == wanted[f"__flag{i}"])
    found = df.join(wanted, on, "left_semi")
    return found.withColumn("flag", keyed(found, key))
