"""What names a row: a declared key, else a unique ``_row_no``, else nothing."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import Code, Refusal
from .names import check_name, ident, need_columns

ROW_NO = "_row_no"


def key_facts(df: DataFrame, keys: Sequence[str]) -> dict[str, int]:
    """Rows, distinct keys, and rows with a null in the key: one aggregation."""
    need_columns(df, keys)
    cols = [F.col(ident(k)) for k in keys]
    null = F.lit(False)
    for c in cols:
        null = null | c.isNull()
    row = df.agg(F.count("*").alias("rows"), F.count_distinct(F.struct(*cols)).alias("distinct"), F.coalesce(F.sum(null.cast("long")), F.lit(0)).alias("nulls")).first()
    return row.asDict()


def is_identity(df: DataFrame, keys: Sequence[str]) -> bool:
    facts = key_facts(df, keys)
    return facts["nulls"] == 0 and facts["distinct"] == facts["rows"]


def resolve(df: DataFrame, declared: Sequence[str] | None) -> list[str]:
    """The columns of the row identity; refused if there are none that are proven."""
    if declared:
        if is_identity(df, declared):
            return list(declared)
        raise Refusal(Code.NO_ROW_IDENTITY, "the declared key is not unique or has nulls")
    if ROW_NO in df.columns and is_identity(df, [ROW_NO]):
        return [ROW_NO]
    raise Refusal(Code.NO_ROW_IDENTITY, "no declared key and no unique _row_no")


def decode(column_text: str, value_text: str) -> dict[str, str]:
    """Key columns and values from the two texts of an evidence link."""
    try:
        columns = json.loads(column_text)
    except ValueError:
        columns = None
    if not isinstance(columns, list):
        return {column_text: value_text}
    return dict(zip(columns, json.loads(value_text)))


def encoded_columns(keys: Sequence[str]) -> str:
    for k in keys:
        check_name(k)
    return keys[0] if len(keys) == 1 else json.dumps(list(keys), ensure_ascii=False)
