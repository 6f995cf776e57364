"""Sharding by fixed virtual slots, with DataFrame functions only.

Each record hashes into one of a fixed number of virtual slots. Bytes are summed for each slot, and a table
(version, vslot, shard) says which shard holds a slot. The table has one row a slot whatever the input's size, so it
may be broadcast. Rebalancing edits the table and adds a version: records never hash anew.

Defined results: a null text counts as empty, null keys hash like any other value, an empty table gives an empty
result, equal rows share a slot and get successive positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import new_path, stash, text_or_empty

N_SLOTS = 4096


def virtual_slot(keys: list[Column], n_slots: int = N_SLOTS) -> Column:
    """A slot from the first 32 bits of the MD5 of the keys."""
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("?")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n_slots).cast("int")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """id, size in bytes (text and 8 for the id), CRC-32 and virtual slot of each row."""
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
    )
    return rows.withColumn("virtual_slot", virtual_slot([F.col("doc_id"), F.col("text_crc32")], n_slots))


def slot_loads(rows: DataFrame, slot_col: str = "virtual_slot", size_col: str = "size") -> DataFrame:
    """(vslot, bytes, n): at most one row a slot."""
    return rows.groupBy(F.col(slot_col).alias("vslot")).agg(F.sum(size_col).alias("bytes"), F.count(F.lit(1)).alias("n"))


def _folded(slots: DataFrame, state: Column, step, shards_of) -> DataFrame:
    """Fold step over the slots, largest first; the slots are at most as many as virtual slots."""
    ordered = slots.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), *[F.col(c) for c in slots.columns if c != "bytes"]))).alias("slots"))
    return ordered.select(F.explode(shards_of(F.aggregate("slots", state, step))).alias("x")).select("x.*")


def _argmin(loads: Column) -> Column:
    """Zero-based index of the smallest load, the first of equals."""
    return (F.array_position(loads, F.array_min(loads)) - 1).cast("int")


def initial_map(loads: DataFrame, n_shards: int, version: int = 1) -> DataFrame:
    """(version, vslot, shard): slots in order of falling bytes, each to the shard that has least so far."""
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"), F.expr("cast(array() as array<struct<vslot:int,shard:int>>)").alias("out"))

    def step(acc: Column, slot: Column) -> Column:
        to = _argmin(acc["loads"])
        return F.struct(
            F.transform(acc["loads"], lambda x, i: F.when(i == to, x - slot["neg"]).otherwise(x)).alias("loads"),
            F.concat(acc["out"], F.array(F.struct(slot["vslot"].alias("vslot"), to.alias("shard")))).alias("out"),
        )

    return _folded(loads.select("bytes", "vslot"), start, step, lambda acc: acc["out"]).select(F.lit(version).alias("version"), "vslot", "shard")


def rebalanced_map(current: DataFrame, loads: DataFrame, n_shards: int) -> DataFrame:
    """The next version: slots leave shards above the mean for the least loaded shard while that narrows the gap.

    A slot moves only from a shard above the mean to one that stays at or below it, so rebalancing a balanced
    map, or adding shards, moves few slots and sends rows only where there is room.
    """
    slots = loads.join(F.broadcast(current), "vslot").select("bytes", "vslot", "shard", "version")
    total = F.sum("bytes").over(W.partitionBy("version"))
    own = F.sum("bytes").over(W.partitionBy("version", "shard"))
    slots = slots.withColumn("mean", total / n_shards).withColumn("own", own)
    held = slots.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "vslot", "shard"))).alias("slots"),
        F.max("mean").alias("mean"),
        F.max("version").alias("version"),
        F.map_from_entries(F.collect_set(F.struct("shard", "own"))).alias("own"),
    )
    start = F.struct(
        F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda i: F.coalesce(F.element_at("own", i), F.lit(0).cast("long"))).alias("loads"),
        F.expr("cast(array() as array<struct<vslot:int,shard:int>>)").alias("out"),
    )

    def step(acc: Column, slot: Column) -> Column:
        to, size = _argmin(acc["loads"]), -slot["neg"]
        move = (acc["loads"][slot["shard"]] - size >= F.col("mean")) & (acc["loads"][to] + size <= F.col("mean"))
        at = F.when(move, to).otherwise(slot["shard"]).cast("int")
        return F.struct(
            F.transform(acc["loads"], lambda x, i: x + F.when(i == at, size).otherwise(0) - F.when(i == slot["shard"], size).otherwise(0)).alias("loads"),
            F.concat(acc["out"], F.array(F.struct(slot["vslot"].alias("vslot"), at.alias("shard")))).alias("out"),
        )

    return held.select((F.col("version") + 1).cast("int").alias("version"), F.explode(F.aggregate("slots", start, step)["out"]).alias("x")).select("version", "x.vslot", "x.shard")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the table at path; earlier versions stay."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """A version of the stored table, the latest by default."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version).select(F.col("version").cast("int").alias("version"), "vslot", "shard")


def assign(rows: DataFrame, slot_map: DataFrame, order_by: list[str]) -> DataFrame:
    """Adds shard, and slot: the row's place in its shard, gapless from 0.

    A shard's rows are never together in one task: places are counted within each virtual slot and moved by the
    number of rows in the shard's earlier virtual slots.
    """
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    counts = slot_map.join(slot_loads(rows), "vslot").select(F.col("vslot").alias("virtual_slot"), "shard", "n")
    counts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(W.partitionBy("virtual_slot").orderBy(*order_by))
    return rows.withColumn("at", within).join(F.broadcast(counts), "virtual_slot").withColumn("slot", (F.col("start") + F.col("at") - 1).cast("long")).drop("start", "at")


def shard_documents(docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Every document with its shard and place, by a slot table stored at map_path as version 1. Sizes come out near equal."""
    spark = docs.sparkSession
    rows = stash(digests(docs, n_slots=n_slots), "digests")
    path = map_path or new_path(spark, "slot-map")
    store_map(initial_map(slot_loads(rows), n_shards), path)
    spark_map = spark.read.schema("vslot int, shard int, version int").parquet(path).where("version = 1")
    return assign(rows, spark_map.select("version", "vslot", "shard"), ["doc_id", "text_crc32", "size"])


def op9_query(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
