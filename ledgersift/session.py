"""Session settings that results depend on, limits on time, and tables written on the way."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .codes import Code, Refusal

#: What a fingerprint or a comparison of text depends on.
PINS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "true",
    "spark.sql.jsonGenerator.ignoreNullFields": "false",
}
STATEMENT_TIMEOUT_MS = 60_000


@contextmanager
def pinned(spark: SparkSession):
    """PINS hold inside; the session's own settings come back after."""
    before = {k: spark.conf.get(k, None) for k in PINS}
    for k, v in PINS.items():
        spark.conf.set(k, v)
    try:
        yield spark
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def timeout_ms(value: int | str | None = None) -> int:
    """The limit on one statement: an argument, else the environment, else 60 s; 0 is none."""
    raw = os.environ.get("FORENSIC_STATEMENT_TIMEOUT_MS", STATEMENT_TIMEOUT_MS) if value is None else value
    try:
        ms = int(raw)
    except (TypeError, ValueError):
        raise Refusal(Code.BAD_CONFIGURATION, f"not a statement timeout: {raw!r}") from None
    if ms < 0:
        raise Refusal(Code.BAD_CONFIGURATION, "a statement timeout is negative")
    return ms


class StatementTimeout(Exception):
    pass


@contextmanager
def limited(spark: SparkSession, ms: int):
    """Jobs of this thread are cancelled after so many milliseconds, those that start later too; then StatementTimeout is raised."""
    if not ms:
        yield
        return
    sc, tag = spark.sparkContext, f"limit-{uuid.uuid4().hex}"
    fired, left = threading.Event(), threading.Event()

    def watch() -> None:
        if left.wait(ms / 1000):
            return
        fired.set()
        while not left.wait(0.1):
            sc.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    sc.addJobTag(tag)
    watcher.start()
    try:
        yield
    except Exception as e:
        if fired.is_set():
            raise StatementTimeout(f"took over {ms} ms") from e
        raise
    else:
        if fired.is_set():
            raise StatementTimeout(f"took over {ms} ms")
    finally:
        left.set()
        watcher.join()
        sc.removeJobTag(tag)


class Stage:
    """Tables written on the way to the cluster's shared folder, ``spark.checkpoint.dir``; a folder of this machine only where that is unset and all of Spark runs here."""

    def __init__(self, spark: SparkSession) -> None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise Refusal(Code.BAD_CONFIGURATION, "spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="stage-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.root = spark, f"{root.rstrip('/')}/{uuid.uuid4().hex}"

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
