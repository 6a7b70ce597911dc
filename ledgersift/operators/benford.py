"""First-digit conformity to Benford's law."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codes import Verdict
from ..functions import benford_share, first_digit
from ..suitability import Rule, RuleSet, Threshold

#: Nigrini's bands of the mean absolute deviation, first digit.
BANDS = ((0.006, "close"), (0.012, "acceptable"), (0.015, "marginal"))
DEFAULT = "starting value, not validated"


def digits(df: DataFrame, value: Column) -> DataFrame:
    """digit 1..9 with n, observed, expected, deviation. One scan, nine rows; absent digits have n = 0."""
    found = df.select(first_digit(value).alias("digit")).where("digit IS NOT NULL").groupBy("digit").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(1, 10).select(F.col("id").cast("int").alias("digit"))
    rows = every.join(F.broadcast(found), "digit", "left").select("digit", F.coalesce("n", F.lit(0)).alias("n"))
    # nine rows: their total comes by a join, not by a window over all
    total = F.broadcast(rows.agg(F.sum("n").alias("total")))
    rows = rows.crossJoin(total)
    observed = F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(F.lit(0.0))
    expected = benford_share(F.col("digit"))
    return rows.select("digit", "n", observed.alias("observed"), expected.alias("expected"), (observed - expected).alias("deviation"))


def summary(hist: DataFrame) -> DataFrame:
    """One row: n, mad, band, chi2, p_value (8 degrees of freedom), worst_digit."""
    n = F.sum("n")
    expected = F.col("expected")
    gap = F.col("observed") - expected
    out = hist.agg(
        n.alias("n"),
        F.avg(F.abs("deviation")).alias("mad"),
        (n * F.sum(gap * gap / expected)).alias("chi2"),
        F.max_by("digit", F.struct(F.round(F.abs("deviation"), 12), -F.col("digit"))).alias("worst_digit"),
    )
    h = F.col("chi2") / 2
    band = F.lit("nonconforming")
    for limit, name in reversed(BANDS):
        band = F.when(F.col("mad") <= limit, name).otherwise(band)
    # the tail of chi-square with an even number of degrees of freedom is a finite sum
    return out.select("n", "mad", band.alias("band"), "chi2", (F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)).alias("p_value"), "worst_digit")


AMOUNT_WORDS = {"amount", "amt", "balance", "charge", "charges", "cost", "credit", "debit", "fee", "gross", "net", "paid", "payment", "price", "rate", "revenue", "salary", "tax", "total", "value", "wage"}
COUNTER_WORDS = {"count", "id", "idx", "index", "line", "linenumber", "no", "num", "number", "page", "row", "seq", "serial", "sl", "sno", "srno"}


def identifier_like(facts) -> bool:
    """A key, a sensitive id, a unique column of whole numbers, or whole numbers under a counter's name."""
    whole = facts["integer_share"] == 1
    words = set(facts["words"])
    return bool(facts["is_key"] or facts["sensitive"] or whole and facts["unique"] or whole and words & COUNTER_WORDS and not words & AMOUNT_WORDS)


RULES = RuleSet(
    [
        Rule("TOO_FEW_VALUES", Verdict.INSUFFICIENT_DATA, ("nonzero",), lambda f: f["nonzero"] < 300, threshold=Threshold(300, DEFAULT)),
        Rule("IDENTIFIER_LIKE", Verdict.NOT_APPLICABLE, ("is_key", "sensitive", "unique", "integer_share", "words"), identifier_like),
        Rule("FEW_DISTINCT", Verdict.NOT_APPLICABLE, ("distinct",), lambda f: f["distinct"] < 100, threshold=Threshold(100, DEFAULT)),
        Rule("NARROW_RANGE", Verdict.NOT_APPLICABLE, ("span",), lambda f: f["span"] < 2, threshold=Threshold(2, DEFAULT)),
        Rule("FIXED_AMOUNTS", Verdict.NOT_APPLICABLE, ("top10_share",), lambda f: f["top10_share"] > 0.8, threshold=Threshold(0.8, DEFAULT)),
        Rule("MANY_NONPOSITIVE", Verdict.SUPPORTED_WITH_WARNING, ("nonpositive_share",), lambda f: f["nonpositive_share"] > 0.2, threshold=Threshold(0.2, DEFAULT)),
    ]
)
