"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written
as Parquet and read again as the next one's docs. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.llm import decontam, langid, linededup, neardup
from ledgersift.llm.common import Scratch, crc_mod, read_table
from ledgersift.llm.queries import mixed


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only texts without letters (``und``) go; all others stay. ``lang`` is the prediction, always a learnt language."""
    model = langid.fit(docs, crc_mod(F.col("doc_id"), 3) != 1)
    kept = [c for c in docs.columns if c != "doc_id"]
    # by place: columns may have any names
    found = langid.predict_with(docs, model, kept)
    place = {c: f"c{k}" for k, c in enumerate(["doc_id", *kept, None])}
    found = found.toDF(*[f"c{k}" for k in range(len(found.columns))]).where(F.col(place[None]) != "und")
    return found.select(*[F.col(place[None if c == "lang" else c]).alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of like lines the first stays; documents without any line left go."""
    return linededup.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) one document stays."""
    return neardup.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that are nothing else go."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents selected for each epoch, by the weights of domain, language and source."""
    return mixed(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources)]

#: The stages aren't expressible in SQL; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
