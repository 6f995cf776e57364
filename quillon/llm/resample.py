"""Importance resampling of documents toward a target set by hashed n-grams.

Texts are cut and counted by Arrow kernels: ascii_lower, split_pattern_regex, list_flatten, dictionary_encode. n-grams are
formed from the dictionary's indices shifted against each other, one distinct pair of indices after the other, so each
distinct n-gram of a batch is spelt and hashed (CRC-32) once. A bucket's gain is the log of its smoothed share in the target over that in the
source; a document's weight is the sum of its features' gains (take and a sum by segment), and a Gumbel draw that
follows from the id alone turns weights into a sample without replacement.

Two passes read the texts: one sums the features of each bucket inside the tasks and sends N_BUCKETS numbers a task, one
adds up gains. The sample is numbered by a sort in ranges, whose sizes, one a partition, are added up beforehand: no task
sees more than its range, however many rows score the same.

Defined results: null and empty texts have no features and weight 0; a null doc_id draws as the id "null" would and comes last
among equal scores, rows equal in score and id in any order; an empty source gives an empty result, an empty target gains
that only favour rare features; every row counts, repeated ones too.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import stash, text_or_empty

#: All code points that are not in words, and the buckets of features.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N_BUCKETS, MAX_N = 10_000, 1
SEED, LEAST_WORDS, PERCENT = 2024, 20, 10
#: Bytes of text that a task works on at once; a longer text is a group of its own.
GROUP = 1 << 22


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    first, total = 0, 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        if k > first and total + n > GROUP:
            yield first, k
            first, total = k, 0
        total += n
    if first < len(texts):
        yield first, len(texts)


def features(texts: pa.Array, max_n: int = MAX_N, n_buckets: int = N_BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, words of each document): a row for each n-gram of 1 to max_n words, repeats and all."""
    split = pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATORS)
    flat, parents = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    parents = parents[real]
    coded = pc.dictionary_encode(flat.filter(pa.array(real)))
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    spelt = [w.encode() for w in coded.dictionary.to_pylist()]
    words = [zlib.crc32(w) for w in spelt]
    docs, buckets = [parents], [np.array(words, np.int64)[index] % n_buckets] if spelt else [np.zeros(0, np.int64)]
    # grams: the code of the n-gram that starts at each place; distinct: its CRC so far.
    grams, distinct = index, np.array(words, np.int64)
    for n in range(2, max_n + 1):
        inside = parents[n - 1 :] == parents[: len(parents) - n + 1]
        pairs = grams[: len(parents) - n + 1] * (len(spelt) + 1) + index[n - 1 :]
        found, grams_of = np.unique(pairs[inside], return_inverse=True)
        distinct = np.array([zlib.crc32(b" " + spelt[p % (len(spelt) + 1)], int(distinct[p // (len(spelt) + 1)])) for p in found.tolist()], np.int64)
        grams = np.full(len(inside), -1, np.int64)
        grams[inside] = grams_of
        docs.append(parents[n - 1 :][inside])
        buckets.append(distinct[grams_of] % n_buckets)
    return np.concatenate(docs).astype(np.int64), np.concatenate(buckets), np.bincount(parents, minlength=len(texts))


def bucket_counts(texts: DataFrame, text_col: str = "text", max_n: int = MAX_N, n_buckets: int = N_BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task sends its own sums: n_buckets rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for first, last in _groups(batch.column(0)):
                sums += np.bincount(features(batch.column(0).slice(first, last - first), max_n, n_buckets)[1], minlength=n_buckets)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(sums[held])], ["bucket", "n"])

    sums = texts.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(n_buckets, np.int64)
    for r in sums.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log of the target's smoothed share over the source's, in thousandths, rounded down."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    """A Gumbel draw in thousandths that follows from the id."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", max_n: int = MAX_N, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document. gain: one number a bucket."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(gain)
        for batch in batches:
            for first, last in _groups(batch.column(1)):
                part = batch.slice(first, last - first)
                doc, bucket, n_words = features(part.column(1), max_n, len(gain))
                won = pc.take(table, pa.array(bucket)).to_numpy(zero_copy_only=False)
                # The sums by document of sorted rows are differences of running sums: whole numbers, so exact.
                order = np.argsort(doc, kind="stable") if max_n > 1 else slice(None)
                running, ends = np.concatenate([[0], np.cumsum(won[order])]), np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(part)))])
                weight = running[ends[1:]] - running[ends[:-1]]
                score = weight + np.array([noise(i, seed) for i in part.column(0).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x.astype(np.int64)) for x in (n_words, np.diff(ends), weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, n_words long, n_features long, weight long, score long")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with name added: 1, 2, 3, ... in order over all of them, which must tell rows apart.

    Rows go to ranges of the order, each sorted in its own task; what the ranges before it hold is one number a range.
    """
    ranged = stash(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    # The number is the partition's times 2^33, plus the row's place in it.
    ranged = ranged.withColumn("_range", F.shiftrightunsigned("_at", 33))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    # One row a partition of the sort: as few as there are tasks.
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("_range", "_before")
    return ranged.join(F.broadcast(sizes), "_range").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_range", "_before", "_at")


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """weighed (stored) with rank: the highest scores among documents of least_words words, percent of their number; else null."""
    able = weighed.where(F.col("n_words") >= least_words).withColumn("_tie", F.monotonically_increasing_id())
    take = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_tie")]
    ranked = numbered(able, order, "rank").withColumn("rank", F.when(F.col("rank") <= take, F.col("rank"))).drop("_tie")
    return ranked.unionByName(weighed.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, max_n: int = MAX_N, n_buckets: int = N_BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document of docs, toward the texts of target."""
    gain = gains(bucket_counts(docs, max_n=max_n, n_buckets=n_buckets), bucket_counts(target, max_n=max_n, n_buckets=n_buckets))
    return draw(stash(weigh(docs, gain, max_n=max_n, seed=seed), "weighed"), percent, least_words)


def op11_query(spark, sf_dir: str) -> DataFrame:
    out = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
