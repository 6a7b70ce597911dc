"""The evidence store: five append-only tables and the reviews, as Parquet under a case.

Files cannot forbid changes by themselves: what this module offers only appends, and the
folder's permissions have to do the rest. There are no transactions; a run counts once a
row with status ``completed`` is written, which is the last thing a run writes.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "datasets": "dataset_version string, `table` string, layout string, row_count bigint, table_hash string, notes string, created_at timestamp",
    "test_runs": "run_id string, dataset_version string, method string, method_version string, params map<string,string>, query_text string, status string, at timestamp",
    "findings": "finding_id string, run_id string, class string, summary string, metrics map<string,double>, details_json string, at timestamp",
    "evidence_links": "finding_id string, key_column string, key_value string",
    "audit_log": "at timestamp, event string, actor string, payload_json string",
    "reviews": "finding_id string, reviewer string, state string, note string, at timestamp",
}


def now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def new_id(prefix: str) -> str:
    return f"{prefix}-{uuid.uuid4().hex[:12]}"


class EvidenceStore:
    """Appends and reads; there is no way to change or delete a row."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        if table not in SCHEMAS:
            raise ValueError(f"no evidence table {table!r}")
        return f"{self.root}/{table}"

    def create(self) -> None:
        for table, schema in SCHEMAS.items():
            self.spark.createDataFrame([], schema).write.mode("append").parquet(self.path(table))

    def read(self, table: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[table]).parquet(self.path(table))

    def append(self, table: str, *rows: dict) -> None:
        names = [f.name for f in self.spark.createDataFrame([], SCHEMAS[table]).schema.fields]
        for r in rows:
            if unknown := set(r) - set(names):
                raise ValueError(f"{table} has no {sorted(unknown)}")
        data = [tuple(r.get(n) for n in names) for r in rows]
        self.spark.createDataFrame(data, SCHEMAS[table]).coalesce(1).write.mode("append").parquet(self.path(table))

    def append_links(self, finding_id: str, key_column: str, keys: DataFrame) -> int:
        """Links of all rows (one column of encoded keys), written where they are; none is collected."""
        links = keys.toDF("key_value").select(F.lit(finding_id).alias("finding_id"), F.lit(key_column).alias("key_column"), "key_value")
        links.write.mode("append").parquet(self.path("evidence_links"))
        return self.read("evidence_links").where((F.col("finding_id") == finding_id) & (F.col("key_column") == key_column)).count()

    def audit(self, event: str, actor: str = "engine", **payload) -> None:
        self.append("audit_log", {"at": now(), "event": event, "actor": actor, "payload_json": json.dumps(payload, default=str, ensure_ascii=False)})

    def review(self, finding_id: str, reviewer: str, state: str, note: str = "") -> None:
        self.append("reviews", {"finding_id": finding_id, "reviewer": reviewer, "state": state, "note": note, "at": now()})

    def completed_runs(self) -> DataFrame:
        runs = self.read("test_runs")
        return runs.join(runs.where("status = 'completed'").select("run_id"), "run_id", "left_semi")

    def findings(self) -> DataFrame:
        """Findings of completed runs, with the latest review of each."""
        done = self.read("findings").join(self.completed_runs().select("run_id").distinct(), "run_id", "left_semi")
        latest = Window.partitionBy("finding_id").orderBy(F.desc("at"))
        reviews = self.read("reviews").withColumn("r", F.row_number().over(latest)).where("r = 1").select("finding_id", "reviewer", F.col("state").alias("reviewer_state"), F.col("note").alias("reviewer_note"))
        return done.join(reviews, "finding_id", "left")
