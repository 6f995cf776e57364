"""Removal of repeated line runs by a suffix array over line ids.

The texts' lines form one long sequence, documents in order of id. Prefix doubling ranks its suffixes by their first 1,
2, 4, ... lines: a round joins the rank of each suffix with that of the suffix as many lines on, sorts the distinct
pairs and numbers them in order. Suffixes whose prefix occurs once are dropped at once, as in prefix doubling with
discarding; no run crosses the end of a document. What is left at each round are the intervals of the suffix array
whose common prefix is at least that long. Going back down through the rounds gives each suffix the depth of the
deepest such interval in which it is not the leftmost: the longest run from there on that occurs earlier.

Lines of later copies of runs of MIN_WORDS words or more are deleted; the first copy stays.

Defined results: a null text is empty; a document of which no line is left has the empty text; rows equal in id and
text are one document; null ids come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import forget, split_by_keys, stash, text_or_empty, unused
from quillon.llm.ngram_join import _free

MIN_WORDS = 50
PLACE = ("doc", "th", "i")
#: Keys that hold more than one in HOT_KEYS of all rows, and more than HOT_LEAST, are joined by a broadcast table: there
#: are fewer than HOT_KEYS of them, whatever the corpus. A blank line is one.
HOT_KEYS, HOT_LEAST = 1000, 10_000


def _keys(id_col: str, text_col: str) -> list[Column]:
    """doc and th: the document's place in the order, and a hash of its text that tells documents of equal id apart."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(text_or_empty(text_col)).alias("th")]


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, th, i, h1, h2, before, after): each line's 128-bit hash and the words before it and up to its end.

    Each document once, however often its row is repeated; only repeated rows are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                counts, hashes, words = [], [], []
                for text in part.column(2).to_pylist():
                    lines = text.encode("utf-8", "replace").split(b"\n")
                    counts.append(len(lines))
                    hashes += [hashlib.blake2b(x, digest_size=16).digest() for x in lines]
                    words.append(np.cumsum([0] + [len(x.split()) for x in lines]))
                h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                place = np.concatenate([np.arange(n) for n in counts] + [np.zeros(0, int)])
                repeat = lambda c: pa.array(np.repeat(c.to_numpy(zero_copy_only=False), counts))
                before, after = (np.concatenate([w[a:b] for w in words] + [np.zeros(0, int)]) for a, b in ((0, -1), (1, None)))
                columns = [repeat(part.column(0)), repeat(part.column(1)), pa.array(place, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(before, pa.int64()), pa.array(after, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "th", "i", "h1", "h2", "before", "after"])

    rows = docs.select(*_keys(id_col, text_col), text_or_empty(text_col).alias("text"))
    # Equal rows are one document: a place that is there twice would be squared by the joins of every round.
    repeated = stash(rows.groupBy("doc", "th").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "repeated")
    near, far = split_by_keys(rows, repeated, ["doc", "th"])
    rows = near.dropDuplicates(["doc", "th"]).select(*rows.columns).unionByName(far)
    return rows.mapInArrow(run, "doc long, th long, i int, h1 long, h2 long, before long, after long")


def _met(rows: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with sums (keys, n, more), n being the number of rows of the keys; sums is a stored table.

    Rows of very frequent keys are not shuffled, so no task gets all rows of a line that every document has.
    """
    total, most = sums.agg(F.sum("n"), F.max("n")).first()
    least = max((total or 0) // HOT_KEYS, HOT_LEAST)
    if (most or 0) <= least:
        return rows.join(sums.drop("n"), keys)
    hot = F.broadcast(sums.where(F.col("n") > least).drop("n"))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(sums.where(F.col("n") <= least).drop("n"), keys)
    return rows.join(hot, keys).unionByName(cold)


def _ranked(rows: DataFrame, keys: tuple[str, str]) -> DataFrame:
    """(keys, n, rank) of pairs that occur n > 1 times, numbered in order of the pair."""
    pairs = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return stash(pairs.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """For each power of two (doc, th, i, rank): suffixes whose prefix of so many lines occurs elsewhere, ranked by it."""
    ranks = _ranked(lines, ("h1", "h2"))
    levels = [stash(_met(lines, ranks, ["h1", "h2"]).select(*PLACE, "rank", "before", "after"), "suffixes")]
    forget(ranks)
    while True:
        step, last = 1 << (len(levels) - 1), levels[-1]
        ahead = last.select("doc", "th", (F.col("i") - step).alias("i"), F.col("rank").alias("r2"))
        pairs = stash(last.select(*PLACE, F.col("rank").alias("r1")).join(ahead, list(PLACE)), "suffix-pairs")
        ranks = _ranked(pairs, ("r1", "r2"))
        longer = stash(_met(pairs, ranks, ["r1", "r2"]).select(*PLACE, "rank"), "suffixes")
        forget(pairs, ranks)
        if not longer.limit(1).count():
            forget(longer)
            return levels
        levels.append(longer)


def longest_earlier(levels: list[DataFrame]) -> DataFrame:
    """(doc, th, i, m): the longest run of m > 0 lines from line i on that also starts at an earlier place.

    m grows by falling powers of two. Suffixes that share the m lines found so far and the next 2^j form one interval;
    all but its leftmost place grow. The leftmost of those compared is the leftmost of all: a place with a longer run
    has an earlier place with that run, and the leftmost place of a class is compared though its own m is shorter.
    """
    place = F.struct(*PLACE)
    nobody = F.lit(None).cast("struct<doc:bigint,th:bigint,i:int>")
    found = levels[0].select(*PLACE, F.lit(0).alias("m"), nobody.alias("first"))
    held = None
    for j in range(len(levels) - 1, -1, -1):
        ahead = levels[j].select("doc", "th", F.col("i").alias("at"), "rank")
        # The leftmost place of a class stayed behind with a shorter run: it joins its class again, to be compared with.
        first = found.where("first is not null").select(*[F.col(f"first.{c}").alias(c) for c in PLACE], "m", "first").distinct().withColumn("own", F.lit(False))
        every = found.select(*PLACE, "m", "first", F.lit(True).alias("own")).union(first)
        tried = every.withColumn("at", F.col("i") + F.col("m")).join(ahead, ["doc", "th", "at"]).select(*PLACE, "m", "first", "rank", "own")
        tried = stash(tried.withColumn("shared", F.coalesce("first", F.struct(F.lit(0).cast("long").alias("doc"), F.lit(0).cast("long").alias("th"), F.lit(-1).alias("i")))).drop("first"), "tried")
        least = stash(tried.groupBy("m", "shared", "rank").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "leftmost")
        longer = _met(tried.where("own"), least, ["m", "shared", "rank"]).where(place > F.col("least")).select(*PLACE, F.lit(1 << j).alias("more"), "least")
        joined = found.join(longer, list(PLACE), "left")
        new = stash(joined.select(*PLACE, (F.col("m") + F.coalesce("more", F.lit(0))).alias("m"), F.coalesce("least", "first").alias("first")), "found")
        forget(tried, least, *([held] if held is not None else []))
        found = held = new
    return found.where("m > 0").select(*PLACE, "m")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, th, runs): of each document, the runs (first line, line after the last) that are later copies."""
    lines = stash(line_table(docs, id_col, text_col), "lines")
    levels = suffix_ranks(lines)
    forget(lines)
    _free(docs.sparkSession)
    runs = longest_earlier(levels)
    start = levels[0].select(*PLACE, "before")
    end = levels[0].select("doc", "th", F.col("i").alias("end"), "after")
    runs = runs.join(start, list(PLACE)).withColumn("end", F.col("i") + F.col("m") - 1).join(end, ["doc", "th", "end"])
    runs = runs.where(F.col("after") - F.col("before") >= min_words)
    # A run that only lacks the first line of the one before it adds nothing.
    runs = runs.groupBy("doc", "th").agg(F.array_sort(F.collect_list(F.struct("i", (F.col("end") + 1).alias("stop")))).alias("runs"))
    return stash(runs.select("doc", "th", F.filter("runs", lambda x, k: (k == 0) | (F.get(F.col("runs"), k - 1)["stop"] < x["stop"])).alias("runs")), "runs")


def delete_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with later copies of repeated runs deleted from text_col, and _n_lines, _n_deleted added (or put in the place
    of columns of these names); other columns stay as they are.

    Only documents that may hold such runs are shuffled: the others are told apart by a bounded table of
    hash buckets.
    """
    docs = docs.drop("_n_lines", "_n_deleted")
    found = repeated_runs(docs, min_words, id_col, text_col)
    doc, th, runs, left = (unused(docs.columns, c) for c in ("_doc", "_th", "_runs", "_left"))
    keyed = docs.withColumns(dict(zip((doc, th), _keys(id_col, text_col))))
    found = found.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("runs").alias(runs))
    touched, clean = split_by_keys(keyed, found, [doc, th])
    clean = clean.withColumn(runs, F.lit(None).cast("array<struct<i:int,stop:int>>"))
    # Both sides grow with the corpus, so neither is broadcast at any size.
    both = touched.join(found.hint("merge"), [doc, th], "left").select(*clean.columns).unionByName(clean)
    lines = F.split(text_or_empty(text_col), "\n")
    kept = F.filter(lines, lambda x, k: ~F.exists(F.coalesce(runs, F.expr("cast(array() as array<struct<i:int,stop:int>>)")), lambda r: (r["i"] <= k) & (k < r["stop"])))
    both = both.withColumn("_n_lines", F.size(lines).cast("long")).withColumn(left, F.when(F.col(runs).isNotNull(), kept))
    both = both.withColumn("_n_deleted", F.when(F.col(left).isNull(), 0).otherwise(F.col("_n_lines") - F.size(left)).cast("long"))
    return both.withColumn(text_col, F.coalesce(F.array_join(left, "\n"), text_or_empty(text_col))).drop(doc, th, runs, left)


def op8_query(spark, sf_dir: str) -> DataFrame:
    out = delete_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_deleted").alias("n_deleted"), "text")
