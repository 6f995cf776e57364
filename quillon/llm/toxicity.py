"""Toxic passages by maximum-scoring segments of token log-odds.

Token log-odds between toxic and other labelled texts are shrunk by a Dirichlet prior made of the background counts;
tokens whose log-odds do not stand out score zero, and a drift is taken from every token so that ordinary text loses.
A scan in linear time finds all maximal-scoring segments of a text, each one's significance follows from the
extreme-value law of such maxima, and a one-variable logistic fit turns the summed evidence into a probability.

The classifier is fitted on at most MAX_LABELLED labelled rows (those of smallest CRC-32); every token of those that
stands out is in the model, and every text is scored whole. Training and scoring cut texts by the same function.

Defined results: a null or empty text has no segments and gets the score of no evidence; without labelled rows of both
classes every score is below 1e-20; equal rows get equal scores. The chance of a segment is taken as 1e-300 at least and a text's
evidence as 1000 at most: beyond that the probability does not change.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import forget, stash, text_or_empty

MAX_LABELLED = 20_000
#: Weight of the prior, as a share of all counts.
PRIOR_SHARE = 0.05
Z_LEAST, DRIFT, STEM = 2.6, 0.5, 5
SIGNIFICANT = 0.01
_ASCII, _TOKEN = re.compile("[a-z]+"), regex.compile(r"[\p{L}\p{M}]+")
PASSAGES = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))


def tokens_of(text: str) -> list[str]:
    """Runs of letters and the marks on them, in lower case."""
    low = text.lower()
    return (_ASCII if low.isascii() else _TOKEN).findall(low)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), start included and end not, in one pass.

    Candidates wait on a stack with the sum to their left and to their right. A new one is joined to the nearest
    earlier candidate with a smaller left sum if its own right sum is larger, along with all between.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, left sum, right sum, nearest with a smaller left sum
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        start, left = i, total
        total += s
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= left:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= total:
                stack.append((start, i + 1, left, total, k))
                break
            start, left = stack[k][0], stack[k][2]
            del stack[k:]
    return [(a, b, r - l) for a, b, l, r, _ in stack]


class Model:
    """Scores of tokens and stems, and the constants of calibration. Everything but the two tables is a number."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.rate, self.scale = 1.0, 0.1
        self.weight, self.offset = 0.0, -50.0
        self.known: dict[str, float] = {}

    def token(self, word: str) -> float:
        s = self.words.get(word)
        if s is None:
            s = self.stems.get(word[:STEM], 0.0) if len(word) > STEM else 0.0
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[word] = s - DRIFT
        return s - DRIFT

    def scan(self, text: str) -> tuple[list[tuple[int, int, float]], list[str], list[float]]:
        words = tokens_of(text)
        get, slow = self.known.get, self.token
        scores = [slow(w) if (s := get(w)) is None else s for w in words]
        return segments(scores) if scores and max(scores) > 0 else [], words, scores

    def evidence(self, found: list, n: int) -> tuple[float, int]:
        """Minus the log of the chance that a clean text of n tokens holds such segments, and how many are significant."""
        total, count = 0.0, 0
        for _, _, s in found:
            expected = self.scale * n * math.exp(-self.rate * min(s, 600 / self.rate))
            p = -math.expm1(-expected)
            if p < SIGNIFICANT:
                count += 1
                total -= math.log(max(p, 1e-300))
        return min(total, 1000.0), count

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.weight * math.log1p(evidence) + self.offset))))

    def calibrate(self, clean_scores: dict[float, int], clean_maxima: list[tuple[int, float]]) -> None:
        """rate solves sum p(s) exp(rate s) = 1 over clean tokens; scale is the likeliest for the clean texts' maxima."""
        total = sum(clean_scores.values())
        gain = lambda x: sum(n * math.exp(min(700.0, x * s)) for s, n in clean_scores.items()) / total - 1
        if total and max(clean_scores) > 0 > sum(s * n for s, n in clean_scores.items()):
            low, high = 0.0, 1.0
            while gain(high) < 0 and high < 64:
                low, high = high, 2 * high
            low = max(low, 1e-6)
            for _ in range(60):
                mid = (low + high) / 2
                low, high = (mid, high) if gain(mid) < 0 else (low, mid)
            self.rate = (low + high) / 2
        weight = sum(n * math.exp(-self.rate * m) for n, m in clean_maxima)
        if weight > 0:
            self.scale = max(1e-6, len(clean_maxima) / weight)

    def fit(self, evidence: np.ndarray, labels: np.ndarray) -> None:
        """Logistic fit of log(1 + evidence), with one clean and one toxic text of prior weight."""
        x = np.concatenate([np.log1p(evidence), [0.0, np.log1p(evidence).max(initial=1.0)]])
        y = np.concatenate([labels, [0.0, 1.0]])
        w, b = 1.0, -1.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(w * x + b, -30, 30)))
            g = np.array([((p - y) * x).sum() + 0.01 * w, (p - y).sum()])
            v = p * (1 - p)
            h = np.array([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            w, b = w - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        self.weight, self.offset = float(w), float(b)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most MAX_LABELLED labelled rows that are not held out."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.crc32(F.concat(F.lit("pick"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(MAX_LABELLED)
    # MAX_LABELLED rows of two numbers at most: small enough to broadcast.
    return docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(stash(ids, "toxic-ids")), "doc_id").select("text", "toxic")


def _token_counts(sample: DataFrame) -> pd.DataFrame:
    """The tokens and stems ("~" before) that stand out, with log-odds; the rest is left on the cluster.

    What comes to the driver is bounded by the words of MAX_LABELLED texts that at least three of them hold.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(tokens_of(t))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.string()))], ["toxic", "found"])

    # Each text once, each of its tokens once: copies and words that one text repeats say little.
    words = sample.dropDuplicates(["text", "toxic"]).select("text", "toxic").mapInArrow(listed, "toxic int, found array<string>")
    words = words.select("toxic", F.explode("found").alias("w")).groupBy("toxic", "w").agg(F.count(F.lit(1)).alias("n"))
    stems = words.where(F.length("w") > STEM).select("toxic", F.concat(F.lit("~"), F.substring("w", 1, STEM)).alias("w"), "n")
    both = words.select("toxic", "w", "n").union(stems).groupBy("w").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("good"))
    both = stash(both, "token-counts")
    total = both.where("w not like '~%'").agg(F.sum("bad"), F.sum("good")).first()
    n_bad, n_good = float(total[0] or 0), float(total[1] or 0)
    if not n_bad or not n_good:
        return pd.DataFrame({"w": [], "odds": []})
    prior, mass = PRIOR_SHARE * (F.col("bad") + F.col("good")), PRIOR_SHARE * (n_bad + n_good)
    odds = F.ln((F.col("bad") + prior) / (n_bad + mass)) - F.ln((F.col("good") + prior) / (n_good + mass))
    z = odds / F.sqrt(1 / (F.col("bad") + prior) + 1 / (F.col("good") + prior))
    out = both.withColumn("odds", odds).withColumn("z", z).where((F.abs("z") >= Z_LEAST) & (F.col("bad") + F.col("good") >= 3))
    out = out.select("w", "odds").toPandas()
    forget(both)
    return out


def train(docs: DataFrame, labels: DataFrame) -> Model:
    sample = stash(_labelled(docs, labels), "toxic-sample")
    table = _token_counts(sample)
    words = {w: float(s) for w, s in zip(table["w"], table["odds"]) if not w.startswith("~")}
    # A stem speaks for words that were not seen; only clear toxic stems do.
    stems = {w[1:]: float(s) for w, s in zip(table["w"], table["odds"]) if w.startswith("~") and s > 2}
    model = Model(words, stems)
    if not words:
        return model

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, tokens = Model(words, stems), {}
        for pdf in batches:
            rows = []
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                found, listed, scores = own.scan(text)
                rows.append((int(toxic), len(listed), [s for _, _, s in found]))
                if not toxic:
                    for s in scores:
                        tokens[round(s, 2)] = tokens.get(round(s, 2), 0) + 1
            yield pd.DataFrame(rows, columns=["toxic", "n", "found"])
        yield pd.DataFrame([(-1, n, [s]) for s, n in tokens.items()], columns=["toxic", "n", "found"])

    seen = sample.mapInPandas(digest, "toxic int, n long, found array<double>").toPandas()
    forget(sample)
    counts: dict[float, int] = {}
    for n, s in zip(seen["n"][seen["toxic"] == -1], seen["found"][seen["toxic"] == -1]):
        counts[s[0]] = counts.get(s[0], 0) + n
    texts = seen[seen["toxic"] >= 0]
    clean = texts[texts["toxic"] == 0]
    model.calibrate(counts, [(n, max(f)) for n, f in zip(clean["n"], clean["found"]) if len(f)] or [(1, 0.0)])
    evidence = np.array([model.evidence([(0, 0, s) for s in f], n)[0] for n, f in zip(texts["n"], texts["found"])])
    model.fit(evidence, texts["toxic"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_passages: bool = True) -> DataFrame:
    """(doc_id, score, n_passages, passages): passages are significant segments (first and last token's place, score, text)."""
    constants = (model.rate, model.scale, model.weight, model.offset)
    tables = docs.sparkSession.sparkContext.broadcast((model.words, model.stems))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*tables.value)
        own.rate, own.scale, own.weight, own.offset = constants
        for batch in batches:
            scores, counts, passages = [], [], []
            for text in batch.column(1).to_pylist():
                found, words, _ = own.scan(text)
                evidence, count = own.evidence(found, len(words))
                scores.append(own.probability(evidence))
                counts.append(count)
                passages.append([{"first": a, "last": b - 1, "score": s, "text": " ".join(words[a:b])} for a, b, s in found if own.evidence([(a, b, s)], len(words))[1]] if with_passages and count else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(passages, PASSAGES)], ["doc_id", "score", "n_passages", "passages"])

    schema = f"doc_id {id_type}, score double, n_passages long, passages array<struct<first:int,last:int,score:double,text:string>>"
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def op5_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model, with_passages=False)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_passages")
