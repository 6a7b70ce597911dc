"""Measured facts of columns: counts, shares and ranges leave the scan, never a value."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType, StringType

from ..codes import Code, Refusal
from ..functions import PATTERNS, half_width, number
from ..names import ident, need_columns

#: Columns that are measured in one scan.
BATCH = 60
SIZE_GATE = 2_000_000
#: Below this estimate distinct values are counted exactly: thresholds lie far under it.
EXACT_BELOW = 1000


def _rows_of(plan) -> int | None:
    """An estimate of the rows, from the sizes of the files: no scan."""
    stats = plan.optimizedPlan().stats()
    if stats.rowCount().isDefined():
        return int(str(stats.rowCount().get()))
    return None


def estimated_rows(df: DataFrame) -> int:
    """Rows by Spark's statistics; else counted, which Parquet answers from its footers."""
    found = _rows_of(df._jdf.queryExecution())
    return found if found is not None else df.count()


def size_gate(df: DataFrame, limit: int = SIZE_GATE, allow: bool = False) -> bool:
    """Whether the table may be scanned as a whole."""
    return allow or estimated_rows(df) <= limit


def as_number(df: DataFrame, name: str) -> Column:
    """An exact number of a numeric column, or of a text column."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (NumericType, StringType)):
        raise Refusal(Code.WRONG_COLUMN_TYPE, f"column {name!r} is neither numeric nor text")
    return number(F.col(ident(name)))


def _facts(df: DataFrame, name: str, i: int) -> list[Column]:
    c = F.col(ident(name))
    kind = df.schema[name].dataType
    out = {"nulls": F.coalesce(F.sum(c.isNull().cast("long")), F.lit(0)), "approx_distinct": F.approx_count_distinct(c)}
    if isinstance(kind, (NumericType, StringType)):
        x = number(c)
        out |= {
            "eligible": F.count(x),
            "nonzero": F.coalesce(F.sum((x != 0).cast("long")), F.lit(0)),
            "nonpositive": F.coalesce(F.sum((x <= 0).cast("long")), F.lit(0)),
            "integers": F.coalesce(F.sum((x == F.floor(x)).cast("long")), F.lit(0)),
            "largest": F.max(F.abs(x)).cast("double"),
            "smallest": F.min(F.when(x != 0, F.abs(x))).cast("double"),
        }
    if isinstance(kind, StringType):
        text = F.trim(half_width(c))
        out |= {f"like_{k}": F.coalesce(F.sum((text if k == "email" else F.upper(text)).rlike(p).cast("long")), F.lit(0)) for k, p in PATTERNS.items()}
    return [v.alias(f"{i}:{k}") for k, v in out.items()]


def scan(df: DataFrame, columns: Iterable[str] | None = None, limit: int | None = None, allow_large: bool = False) -> dict[str, dict]:
    """One aggregation for every ``BATCH`` columns; then derived shares. With a limit, a larger table is refused before any scan."""
    names = list(columns if columns is not None else df.columns)
    need_columns(df, names)
    if limit is not None and not size_gate(df, limit, allow_large):
        raise Refusal(Code.TABLE_TOO_LARGE, f"about {estimated_rows(df)} rows; allow a large profile to go on")
    out: dict[str, dict] = {}
    for at in range(0, len(names), BATCH):
        part = names[at : at + BATCH]
        row = df.agg(F.count("*").alias("rows"), *[x for i, n in enumerate(part) for x in _facts(df, n, i)]).first().asDict()
        for i, n in enumerate(part):
            raw = {k.split(":", 1)[1]: v for k, v in row.items() if k.startswith(f"{i}:")}
            out[n] = _derived(row["rows"], raw)
    return out


def _derived(rows: int, raw: dict) -> dict:
    f = {"rows": rows, **raw}
    known = rows - raw["nulls"]
    f["null_rate"] = raw["nulls"] / rows if rows else None
    if "eligible" in raw:
        n = raw["eligible"]
        f["numeric"] = n == known and n > 0
        f["nonpositive_share"] = raw["nonpositive"] / n if n else None
        f["integer_share"] = raw["integers"] / n if n else None
        if raw["nonzero"]:
            f["span"] = math.log10(raw["largest"] / raw["smallest"])
        else:
            f["span"] = 0.0 if n else None
    for k in PATTERNS:
        if f"like_{k}" in raw:
            f[f"{k}_share"] = raw[f"like_{k}"] / known if known else 0.0
    return f


def distinct_count(df: DataFrame, name: str, estimate: int | None = None) -> int:
    """Distinct non-null values; exact near the thresholds, Spark's estimate far above them."""
    if estimate is not None and estimate >= EXACT_BELOW:
        return estimate
    return df.agg(F.count_distinct(F.col(ident(name)))).first()[0]


def value_counts(df: DataFrame, name: str, k: int = 10) -> tuple[int, float | None]:
    """Distinct non-null values, and the share of their rows that the k most frequent hold: one job."""
    c = F.col(ident(name))
    counts = df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n")).limit(k).agg(F.sum("n").alias("top"))
    row = counts.agg(F.count("*").alias("distinct"), F.sum("n").alias("total")).join(F.broadcast(top)).first()  # a row and a row
    return row.distinct, row.top / row.total if row.total else None


def top_share(df: DataFrame, name: str, k: int = 10) -> float | None:
    """Share of the non-null rows that the k most frequent values hold."""
    return value_counts(df, name, k)[1]


def is_unique(df: DataFrame, name: str) -> bool:
    c = F.col(ident(name))
    row = df.agg(F.count(c).alias("n"), F.count("*").alias("rows"), F.count_distinct(c).alias("d")).first()
    return row.rows > 0 and row.n == row.rows == row.d


def facts_of(df: DataFrame, names: list[str], need: set[str] | None = None) -> dict[str, dict]:
    """The facts of some columns, in one scan; then only what is needed besides is measured, one by one."""
    need = need if need is not None else {"distinct", "top10_share", "unique"}
    out = scan(df, names)
    for name, facts in out.items():
        if "top10_share" in need:
            distinct, facts["top10_share"] = value_counts(df, name)
            facts["distinct"] = distinct
        elif "distinct" in need:
            facts["distinct"] = distinct_count(df, name, facts["approx_distinct"])
        if "unique" in need:
            # estimates are off by a few per cent at most: far from it, no exact pass
            facts["unique"] = facts["approx_distinct"] >= 0.8 * facts["rows"] and is_unique(df, name)
    return out


def facts_for(df: DataFrame, name: str, need: set[str] | None = None) -> dict:
    """The facts of one column."""
    return facts_of(df, [name], need)[name]


def _numbers(df: DataFrame, name: str) -> dict[str, Column]:
    """How many values are numbers, not zero, not positive, whole."""
    c = F.col(ident(name))
    if isinstance(df.schema[name].dataType, IntegralType):
        x, whole = c, F.count(c)
    else:
        x = as_number(df, name)
        whole = F.count(F.when(x == F.floor(x), 1))
    return {"eligible": F.count(x), "nonzero": F.count(F.when(x != 0, 1)), "nonpositive": F.count(F.when(x <= 0, 1)), "integers": whole}


def profile_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """The basic facts as rows, one for each column: column, rows, nulls, distinct, eligible, nonzero, nonpositive, integers.

    All but the distinct values come from one scan. These are counted column by column, each
    from a scan of that column alone, as several in one aggregation would multiply all rows.
    """
    need_columns(df, columns)
    aggs, rows, distinct = [F.count("*").alias("rows")], [], None
    for i, n in enumerate(columns):
        c = F.col(ident(n))
        found = {"nulls": F.count(F.when(c.isNull(), 1)), **_numbers(df, n)}
        aggs += [v.alias(f"{k}{i}") for k, v in found.items()]
        rows.append(F.struct(F.lit(i).alias("i"), F.lit(n).alias("column"), F.col("rows"), *[F.col(f"{k}{i}").alias(k) for k in found]))
        one = df.select(c.alias("v")).where("v IS NOT NULL").distinct().agg(F.count("*").alias("distinct")).withColumn("i", F.lit(i))
        distinct = one if distinct is None else distinct.union(one)
    facts = df.agg(*aggs).select(F.inline(F.array(*rows)))
    return facts.join(F.broadcast(distinct), "i").select("column", "rows", "nulls", "distinct", "eligible", "nonzero", "nonpositive", "integers")


def pattern_shares(df: DataFrame, column: str) -> DataFrame:
    """pattern, matches, share: how many values have the shape of each kind of identifier."""
    need_columns(df, [column])
    text = F.trim(half_width(F.col(ident(column))))
    n = F.count(F.col(ident(column)))
    rows = [F.struct(F.lit(k).alias("pattern"), F.col(k).alias("matches"), (F.col(k) / F.when(F.col("n") > 0, F.col("n"))).alias("share")) for k in PATTERNS]
    return df.agg(n.alias("n"), *[F.coalesce(F.sum(text.rlike(p).cast("long")), F.lit(0)).alias(k) for k, p in PATTERNS.items()]).select(F.inline(F.array(*rows)))
