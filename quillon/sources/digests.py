"""Digests of a panel's files: written down with the panel, checked before it is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources import commits


class Changed(ValueError):
    """Files are not those that were written down."""


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, file, bytes, sha256) of every file below paths: read and digested by tasks, a row a file."""
    out = None
    for path in paths:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        name = F.element_at(F.split("path", "/"), -1)
        # What a reader passes over is no part of the data.
        rows = rows.where(~name.startswith("_") & ~name.startswith(".")).select(F.lit(path).alias("source"), name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("one path at least is needed")
    return out


def combined(files: DataFrame) -> DataFrame:
    """(source, files, bytes, sha256): one digest for each source, of the digests of its files in order of name."""
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "file", "bytes", "sha256")))
    return files.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.concat_ws("\n", lines), 256).alias("sha256"))


class Manifest:
    """What a panel was made from: digests of its sources, with versions, in a folder beside it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.state = spark, commits.State(spark, folder, {"sources": {}})

    def write(self, paths: dict[str, str], **notes) -> dict:
        """Digest the sources by name and write them down; others that are there stay."""
        found = {r.source: {"path": r.source, "files": r.files, "bytes": r.bytes, "sha256": r.sha256} for r in combined(file_digests(self.spark, list(paths.values()))).collect()}
        lacking = [n for n, p in paths.items() if p not in found]
        if lacking:
            raise FileNotFoundError(f"no files of {lacking}")
        return self.state.update(lambda s: {**s, "sources": {**s["sources"], **{n: found[p] for n, p in paths.items()}}, **notes})

    def differing(self, paths: dict[str, str] | None = None) -> list[str]:
        """Names of sources whose files are not those written down; paths: where they are now, if they moved."""
        kept = self.state.get()["sources"]
        paths = {n: x["path"] for n, x in kept.items()} if paths is None else paths
        unknown = sorted(set(paths) - set(kept))
        if unknown:
            raise KeyError(f"nothing is written down about {unknown}")
        found = {r.source: r.sha256 for r in combined(file_digests(self.spark, list(paths.values()))).collect()} if paths else {}
        return sorted(n for n, p in paths.items() if found.get(p) != kept[n]["sha256"])

    def check(self, paths: dict[str, str] | None = None) -> None:
        """Refuse sources that differ."""
        if wrong := self.differing(paths):
            raise Changed(f"files differ from what the manifest says: {wrong}")
