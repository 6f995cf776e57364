"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: white space between words, as the word pattern [^\x20\x09-\x0D]+ leaves out.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_OWN_ROOT: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN_ROOT:
            _OWN_ROOT.append(tempfile.mkdtemp(prefix="quillon-"))
        root = f"file://{_OWN_ROOT[0]}"
    return f"{root.rstrip('/')}/quillon-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stashed tables that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_quillon_path", None):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row however often body names it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text, in order."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


#: Hash buckets of the filters on keys: a table of at most this many numbers, whatever the corpus.
BUCKETS = 1 << 20


def bucket_of(*keys: str | Column) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(77)), F.lit(BUCKETS)).cast("int")


def unused(names: list[str], name: str) -> str:
    """name, or the first of name_, name__, ... that is not among names."""
    while name in names:
        name += "_"
    return name


def split_by_keys(rows: DataFrame, some: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows whose keys may be in some, and rows whose keys are not: told apart without a shuffle.

    The table of buckets that some's keys fall into has at most BUCKETS rows, so it is broadcast. Where some is a small
    share of all keys, the first part is little more than that share; where it is not, it is up to all rows.
    """
    bucket = unused(rows.columns, "_bucket")
    buckets = stash(some.select(bucket_of(*keys).alias(bucket)).distinct(), "buckets")
    rows = rows.withColumn(bucket, bucket_of(*keys))
    near = rows.join(F.broadcast(buckets), bucket, "left_semi").drop(bucket)
    return near, rows.join(F.broadcast(buckets), bucket, "left_anti").drop(bucket)


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys are not in gone; only those in a bucket of gone's keys are shuffled. Keys are not null."""
    near, far = split_by_keys(rows, gone, keys)
    # Both sides grow with the corpus, so neither is broadcast at any size.
    return near.join(gone.select(*keys).hint("merge"), keys, "left_anti").select(*rows.columns).unionByName(far.select(*rows.columns))
