"""Dataset versions: a content fingerprint and the column layout."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType

from .names import ident


def cell_text(c: Column, kind: DataType) -> Column:
    """A value as text that doesn't depend on session settings; null is told from empty."""
    if isinstance(kind, (DoubleType, FloatType)):
        text = F.hex(F.encode(c.cast("string"), "UTF-8"))
    elif kind.typeName() in ("struct", "array", "map"):
        text = F.to_json(c, {"ignoreNullFields": "false"})
    elif kind.typeName() == "binary":
        text = F.hex(c)
    else:
        text = c.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_hash(text: Column) -> Column:
    """56 bits of SHA-256, as an exact number."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 14), 16, 10).cast("decimal(38,0)")


def fingerprint_of(text: Column) -> Column:
    """Aggregate: ``s56:<rows>:<sum of row hashes>``. The order of rows doesn't matter."""
    return F.concat(F.lit("s56:"), F.count("*").cast("string"), F.lit(":"), F.coalesce(F.sum(row_hash(text)), F.lit(0)).cast("string"))


def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    names = list(columns or df.columns)
    return F.concat_ws("|", *[cell_text(F.col(ident(c)), df.schema[c].dataType) for c in names])


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    """One scan, partial sums in each task."""
    return df.agg(fingerprint_of(row_text(df, columns)).alias("f")).first()["f"]


def layout(df: DataFrame) -> str:
    text = "\x1f".join(f"{f.name}\x1e{f.dataType.simpleString()}" for f in df.schema.fields)
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def version_id(table: str, layout_: str, basis: str) -> str:
    return "v" + hashlib.sha256(f"{table}\x1f{layout_}\x1f{basis}".encode("utf-8", "surrogatepass")).hexdigest()[:16]
