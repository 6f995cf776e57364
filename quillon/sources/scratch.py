"""A folder that driver and executors share, for tables that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.sources.store import place

_OWN: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Only a local session may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="quillon-engine-"))
        root = f"file://{_OWN[0]}"
    return f"{root.rstrip('/')}/quillon-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table written below folder() and read again: what follows plans and computes from there."""
    path = folder(rows.sparkSession, name)
    rows.write.parquet(path)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out._quillon_scratch = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for t in tables:
        if path := getattr(t, "_quillon_scratch", None):
            fs, p = place(t.sparkSession, path)
            fs.delete(p, True)
