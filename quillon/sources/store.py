"""Small texts (registries, logs, checkpoints) in the file system that Spark uses, whole or not at all."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def place(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def local(path: str) -> str:
    """The path on this machine, of a path or URL of the local file system."""
    return unquote(urlparse(path).path) if path.startswith("file:") else path


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text at path, None where there is none."""
    fs, p = place(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and renamed over the old text in one step: readers see one or the other, also after a crash."""
    fs, p = place(spark, path)
    beside = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    _, new = place(spark, beside)
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.getScheme() == "file":
        os.replace(local(beside), local(path))
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = getattr(rename, "OVERWRITE")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), conf).rename(new, p, options)


def read_json(spark: SparkSession, path: str, otherwise=None):
    text = read_text(spark, path)
    return otherwise if text is None else json.loads(text)


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, indent=1, sort_keys=True, allow_nan=False))


def read_lines(spark: SparkSession, path: str) -> list[dict]:
    """The rows of a file of one JSON object a line; a last line that was cut off is left out."""
    out = []
    for line in (read_text(spark, path) or "").splitlines():
        try:
            out.append(json.loads(line))
        except ValueError:
            continue
    return out


def write_lines(spark: SparkSession, path: str, rows: Iterable[dict]) -> None:
    write_text(spark, path, "".join(json.dumps(r, sort_keys=True, allow_nan=False) + "\n" for r in rows))


def claim(spark: SparkSession, path: str) -> bool:
    """Whether this caller is the one that made the file: a lock that one of several holds."""
    fs, p = place(spark, path)
    return bool(fs.createNewFile(p))


def release(spark: SparkSession, path: str) -> None:
    fs, p = place(spark, path)
    fs.delete(p, False)


def signature(spark: SparkSession, paths: Iterable[str]) -> list[dict]:
    """Name, size and time of every file below paths: two equal signatures mean that nothing was written in between."""
    out = []
    for path in sorted(paths):
        fs, p = place(spark, path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        files = fs.listFiles(p, True)
        found = []
        while files.hasNext():
            f = files.next()
            found.append([f.getPath().getName(), f.getLen(), f.getModificationTime()])
        out.append({"path": path, "files": sorted(found)})
    return out
