"""Where tables come from: files of text, typed tables, databases, and seeded fixtures."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..codes import Code, Refusal
from ..evidence import SCHEMAS, EvidenceStore
from ..identity import ROW_NO
from ..names import check_name
from ..version import fingerprint, layout

KEYS_FILE = "tables.json"


class Case:
    """One folder for each case: ``source`` (never written after ingest) and ``_forensic``."""

    def __init__(self, spark: SparkSession, root: str | None) -> None:
        root = root or os.environ.get("FORENSIC_CASE_ROOT")
        if not root:
            raise Refusal(Code.BAD_CONFIGURATION, "no case is named; none is guessed")
        self.spark, self.root = spark, root.rstrip("/")
        self.evidence = EvidenceStore(spark, f"{self.root}/_forensic")

    def source(self, table: str, schema: str = "source") -> str:
        return f"{self.root}/{check_name(schema)}/{check_name(table)}"

    def table(self, table: str, schema: str = "source") -> DataFrame:
        """A table of the case, read only."""
        path = self.source(table, schema)
        for p in (path, f"{path}.parquet"):
            if _exists(self.spark, p):
                return self.spark.read.parquet(p)
        raise Refusal(Code.NO_SUCH_TABLE, f"table {schema}.{table} does not exist")

    def declared_key(self, table: str, schema: str = "source") -> list[str] | None:
        """The key declared beside the tables, as Parquet has none."""
        path = f"{self.root}/{KEYS_FILE}"
        if not _exists(self.spark, path):
            return None
        text = "\n".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect())
        return json.loads(text).get(f"{schema}.{table}")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def create_case(spark: SparkSession, root: str, keys: dict[str, list[str]] | None = None) -> Case:
    """Folders and empty evidence tables; ``keys``: declared keys, by schema.table."""
    case = Case(spark, root)
    case.evidence.create()
    if keys:
        _write_text(spark, f"{case.root}/{KEYS_FILE}", json.dumps(keys))
    return case


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def verify_store(case: Case) -> dict[str, bool]:
    """What is promised of the evidence store, tried out: its tables are there, an append adds a row and changes no file, and a run without its last row is not seen.

    ``locked``: whether the folder refuses to delete or replace a written file, which only its
    permissions can; a probe file of this check is what is tried.
    """
    spark, store = case.spark, case.evidence
    tables = all(_exists(spark, store.path(t)) for t in SCHEMAS)
    if not tables:
        return {"tables": False, "append_only": False, "locked": False}

    def files() -> dict[str, tuple[int, int]]:
        p = spark._jvm.org.apache.hadoop.fs.Path(store.path("audit_log"))
        found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
        return {str(f.getPath().getName()): (f.getLen(), f.getModificationTime()) for f in found if str(f.getPath().getName()).startswith("part-")}

    before, rows = files(), store.read("audit_log").count()
    store.audit("verified")
    after = files()
    kept = all(after.get(k) == v for k, v in before.items()) and len(after) > len(before) and store.read("audit_log").count() == rows + 1
    probe = f"{store.root}/probe-{uuid.uuid4().hex}"
    _write_text(spark, probe, "x")
    p = spark._jvm.org.apache.hadoop.fs.Path(probe)
    try:
        locked = not p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False)
    except Exception:  # refused by the file system
        locked = True
    return {"tables": tables, "append_only": kept, "locked": locked}


def with_row_numbers(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """A number for each row, in the order of the columns, without one task that sees all rows.

    Rows are numbered within each range of the order, and ranges by the rows before them.
    """
    parts = df.repartitionByRange(*[F.col(f"`{c}`") for c in order]).sortWithinPartitions(*[F.col(f"`{c}`") for c in order])
    marked = parts.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    sizes = marked.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("__before", before)  # a row for each partition
    out = marked.join(F.broadcast(sizes), "__part")
    return out.withColumn(ROW_NO, (F.col("__before") + F.col("__at") - F.col("__first") + 1).cast("long")).drop("__part", "__at", "__n", "__first", "__before")


def read_text_table(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A file with a header: every column is text, blank cells are null, nothing is guessed."""
    head = spark.read.text(path).limit(1).collect()
    if not head:
        raise Refusal(Code.NO_SUCH_TABLE, "the file is empty")
    import csv

    names = next(csv.reader([head[0][0].lstrip("﻿")], delimiter=delimiter))
    for n in names:
        check_name(n)
    schema = StructType([StructField(n, StringType()) for n in names])
    options = {"header": True, "sep": delimiter, "quote": '"', "escape": '"', "multiLine": True, "nullValue": "", "emptyValue": "", "mode": "FAILFAST", "enforceSchema": True}
    return spark.read.options(**options).schema(schema).csv(path)


def ingest(case: Case, path: str, table: str, delimiter: str = ",", sheet: str | None = None) -> dict:
    """Text file or workbook -> source table with ``_row_no``; returns the manifest, which is written beside it too."""
    if path.lower().endswith((".xlsx", ".xlsm")):
        numbered = read_excel(case.spark, path, sheet)
    else:
        df = read_text_table(case.spark, path, delimiter)
        blank = [F.when(F.col(f"`{c}`") == "", None).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns]
        # one pass over a file whose lines may go on: Spark reads it in one task, in order
        numbered = df.select(*blank).withColumn(ROW_NO, F.monotonically_increasing_id() + 1).coalesce(1) if df.rdd.getNumPartitions() == 1 else with_row_numbers(df.select(*blank), df.columns)
    names = [c for c in numbered.columns if c != ROW_NO]
    numbered.write.mode("errorifexists").parquet(case.source(table))
    stored = case.table(table)
    manifest = {"table": table, "rows": stored.count(), "columns": names, "layout": layout(stored), "fingerprint": fingerprint(stored)}
    _write_text(case.spark, f"{case.root}/manifest/{table}.json", json.dumps(manifest, ensure_ascii=False))
    return manifest


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet of a workbook, all cells as text, blank ones null, with ``_row_no``. A task reads it; no row comes to the driver but the header."""
    from . import workbook

    def parsed(head_only: bool):
        def run(batches):
            for batch in batches:
                for data in batch.column("content"):
                    yield from workbook.batches(data.as_py(), sheet, head_only)

        return run

    book = spark.read.format("binaryFile").load(path).select("content")
    schema = f"cells array<string>, {ROW_NO} long"
    head = book.mapInArrow(parsed(True), schema).first()
    if head is None:
        raise Refusal(Code.NO_SUCH_TABLE, "the sheet is empty or does not exist")
    names = [check_name(n or "") for n in head.cells]
    rows = book.mapInArrow(parsed(False), schema)
    return rows.select(*[F.get("cells", i).alias(n) for i, n in enumerate(names)], ROW_NO)


def read_jdbc(spark: SparkSession, url: str, schema: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 32, **options: str) -> DataFrame:
    """A typed table of a database, read in parallel over ranges of a numeric column."""
    quoted = ".".join('"' + check_name(n).replace('"', '""') + '"' for n in (schema, table))
    reader = spark.read.format("jdbc").options(url=url, dbtable=quoted, fetchsize="10000", **options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=check_name(partition_column), lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


def synthetic_pair(spark: SparkSession, rows: int = 20_000, seed: int = 7) -> DataFrame:
    """row_id, conforming (follows Benford's law), fixed_band (does not). Made in parallel, the same each time."""
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    v = (F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return spark.range(rows).select(F.col("id").alias("row_id"), F.pow(F.lit(10.0), u * 5).cast("decimal(18,4)").alias("conforming"), (5000 + v * 4999).cast("decimal(18,4)").alias("fixed_band"))
