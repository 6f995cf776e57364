"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, SentencePiece pieces.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents; other columns are left out, whatever
their names.

Defined results: null and empty texts are rejected by the quality rules; rows without an id, and rows that share one, are
decided one by one; of rows equal in id and text one stays (near duplicates); ties go to the smallest id, a null one
first, then to the smallest text hash; an empty table gives an empty result; texts are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import line_dedup, mixing, ngram_join, pieces, quality
from quillon.llm.common import split_by_keys, stash, without

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of the words that the mixture takes, each document at most once.
BUDGET_PERCENT, MAX_EPOCHS = 80, 1


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents with _id and _th, which tell rows apart unless they are equal in id and text."""
    return docs.select(*COLUMNS).withColumn("_id", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("_th", F.xxhash64(F.coalesce("text", F.lit(""))))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being good is 1/2 or more and that the base rule does not fail."""
    keyed = _keyed(docs)
    judged = quality.judged(stash(quality.measures(keyed, keep=["_id", "_th"]), "measures"))
    return without(keyed, judged.where("not kept").select("carried.*"), ["_id", "_th"]).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are gone; so are documents that lost every line."""
    out = line_dedup.delete_repeats(docs.select(*COLUMNS)).where("_n_deleted < _n_lines")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with _id, _th and a number _row of each row of its own, stored so that the number stays the same."""
    return stash(_keyed(docs).withColumn("_row", F.monotonically_increasing_id()), "numbered")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id, null ids first. Empty texts are in no group.

    Rows are told apart by their numbers, so rows equal in id and text and rows without an id are in the groups as well.
    """
    rows = _numbered(docs)
    found = ngram_join.similar_documents(rows, "_row").where("component_id != doc_id")
    found = stash(found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("group")), "near-copies")
    # The rest of each group is the row that gave it its number.
    members = stash(found.union(found.select("group", "group").distinct()), "group-members")
    # Both sides grow with the corpus, so neither is broadcast at any size.
    named = members.join(rows.select("_row", "_id", "_th", "lang", "source").hint("merge"), "_row")
    first = named.groupBy("group").agg(F.min(F.struct("_id", "_th", "lang", "source", "_row"))["_row"].alias("_row"))
    gone = stash(members.select("_row").join(first.select("_row").hint("merge"), "_row", "left_anti"), "gone")
    return without(rows, gone, ["_row"]).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's prefix of its shuffled documents; the last document of a leaf is cut where the budget ends.

    Rows are taken, left and cut by their numbers; their order comes from id and text, so null ids spread as well.
    """
    rows = _numbered(docs)
    named = rows.withColumn("doc_id", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), "_th"))
    counts = stash(mixing.token_counts(named, carry=["_row"]), "token-counts")
    taken = stash(mixing.mix(counts.where("n_tokens > 0"), BUDGET_PERCENT, max_epochs=MAX_EPOCHS, carry=["_row"]), "taken")
    left = stash(counts.select("_row").join(taken.select("_row"), "_row", "left_anti"), "left-over")
    # One document of a leaf at most, but leaves may be many: nothing is broadcast but a bounded table of hash buckets.
    cut = stash(taken.where("take < n_tokens").select("_row", F.col("take").alias("_take")), "cut")
    near, far = split_by_keys(without(rows, left, ["_row"]), cut, ["_row"])
    rows = near.join(cut.hint("merge"), "_row", "left").unionByName(far.withColumn("_take", F.lit(None).cast("long")))
    rows = rows.withColumn("text", F.when(F.col("_take").isNotNull(), mixing.first_words(F.col("text"), F.col("_take"))).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, n_bytes, round_trip, ids): each text's pieces."""
    return pieces.encode_column(docs)


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("near duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("pieces", piece_stage)]
#: No SQL: suffix arrays and the piece model are beyond it. Tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
