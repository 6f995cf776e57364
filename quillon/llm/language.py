"""Language identification by string kernels.

A text is the set of the 1- to 3-letter pieces of its words, a mark of each word's edge among them (blended spectrum, presence only); the kernel
of two texts is the size of their sets' common part over the root of the product of their sizes. A few landmark texts of
each language give Nystroem features, one-versus-rest ridge regressions on them are solved from sums that tasks return, and
texts are scored block by block as a matrix of presence times a matrix of weights. Landmarks' kernel values times the
regressions' weights and that product are the same, since matrix products may be bracketed as one likes.

The classifier is fitted on at most PER_LANG texts, each once, of each of the MAX_LANGS most frequent languages, with at most LANDMARKS
landmarks of at most LANDMARK_CHARS characters and MAX_GRAMS pieces; every text is scored whole.

Defined results: null texts and those without a letter are "und" with score 0, and so is every text where nothing could be
learnt; rows with a null lang are not learnt from; a null doc_id is not held out and not learnt from; a text none of whose
pieces is known gets the most frequent language and an even score; equal texts get equal results; ties go to the more
frequent language. Scores are rounded to six digits.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import forget, stash

PER_LANG, MAX_LANGS = 500, 100
LANDMARKS, LANDMARK_CHARS, MAX_GRAMS = 192, 4_000, 1 << 16
LONGEST, RIDGE = 3, 1e-3
#: Entries of the table that finds pieces; larger alphabets are searched.
TABLE = 1 << 22
#: Texts and bytes of a block; a longer text is a block of its own.
BLOCK, GROUP = 256, 1 << 20
NONE = "und"


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    first, total = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if k > first and (total + n > GROUP or k - first >= BLOCK):
            yield first, k
            first, total = k, 0
        total += n
    if first < len(texts):
        yield first, len(texts)


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, text of each): the lower-case texts, each with a space before and behind and a 0 at its end.

    What is no letter is a space.
    """
    low = [t.lower().replace("\0", " ") for t in texts]
    points = np.frombuffer("".join(f" {t} \0" for t in low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(low)), [len(t) + 3 for t in low])
    return np.where(_letters()[points] | (points == 0), points, 32), owner


def pieces(points: np.ndarray) -> np.ndarray:
    """Numbers of the distinct pieces of one coded text: of one letter, of two, and of three around a letter."""
    a, b, c = points[:-2], points[1:-1], points[2:]
    return np.unique(np.concatenate([points[points > 32], ((a << 21) | b)[(a > 0) & (b > 0) & (a + b > 64)], ((a << 42) | (b << 21) | c)[(a > 0) & (b > 32) & (c > 0)]]))


class Spectrum:
    """Turns texts into rows of presence over known pieces, given as sorted numbers."""

    def __init__(self, known: np.ndarray):
        self.known, self.n = known, len(known)
        parts = [known & (2**21 - 1), (known >> 21) & (2**21 - 1), known >> 42]
        letters = np.unique(np.concatenate([*parts, np.array([0, 32])]))
        letters = letters[letters != 0]
        # Letters that occur in known pieces are numbered from 1; all others are 0, and so is the end of a text.
        self.number = np.zeros(0x110000, np.int64)
        self.number[letters] = np.arange(1, len(letters) + 1)
        self.base = len(letters) + 1
        c, b, a = (self.number[x] for x in parts)
        key = (a * self.base + b) * self.base + c
        # A table from number to piece while it is small, else a search.
        self.table = None
        if self.base**3 <= TABLE:
            self.table = np.full(self.base**3, -1, np.int32)
            self.table[key] = np.arange(self.n)
        else:
            order = np.argsort(key)
            self.keys, self.at = key[order], order

    def _find(self, key: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.at[at], -1)

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(known pieces of each text as 0 and 1, whether each text has a letter)."""
        points, owner = coded(texts)
        out = np.zeros((len(texts), self.n), np.uint8)
        has = np.bincount(owner[points > 32], minlength=len(texts)) > 0
        if self.n:
            x = self.number[points]
            for n in range(1, LONGEST + 1):
                key = x[: len(x) - n + 1]
                for k in range(1, n):
                    key = np.where((key > 0) & (x[k : len(x) - n + 1 + k] > 0), key * self.base + x[k : len(x) - n + 1 + k], 0)
                found = self._find(key)
                here = (found >= 0) & (key > 0)
                out[owner[: len(key)][here], found[here]] = 1
        return out, has


class Model:
    def __init__(self, langs: list[str], known: np.ndarray, weights: np.ndarray):
        self.langs, self.known, self.weights = langs, known, weights


def _sample(docs: DataFrame) -> tuple[list[str], DataFrame | None]:
    """Languages, the most frequent first, and (lang, place, text) of at most PER_LANG texts of each, picked by hash."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    usable = usable.select("lang", "text", F.xxhash64("text", F.lit(5)).alias("h"))
    langs = usable.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.col("n").desc(), "lang").limit(MAX_LANGS).collect()
    if not langs:
        return [], None
    # Hashes up to a share that gives more than PER_LANG texts, so that what is ordered within a language is bounded.
    cuts = [(r.lang, min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, (1.5 * PER_LANG + 100) / max(1, r.n))))) for r in langs]
    table = F.broadcast(docs.sparkSession.createDataFrame(cuts, "lang string, cut long"))
    near = usable.join(table, "lang").where("h <= cut").groupBy("lang", "h").agg(F.min("text").alias("text"))
    near = near.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("place") <= PER_LANG)
    return [r.lang for r in langs], stash(near.select("lang", "place", "text").repartition(8, "lang", "place"), "language-sample")


def train(docs: DataFrame) -> Model:
    langs, sample = _sample(docs)
    none = np.zeros(0, np.int64)
    if sample is None:
        return Model([], none, np.zeros((0, 0)))
    each = max(1, LANDMARKS // len(langs))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pieces(coded([t])[0]) for t in batch.column(0).to_pylist()], pa.list_(pa.int64()))], ["grams"])

    marks = sample.where(F.length("text") <= LANDMARK_CHARS)
    marks = marks.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("place"))).where(F.col("k") <= each)
    sets = [np.array(r.grams, np.int64) for r in marks.orderBy("lang", "k").select("text").mapInArrow(grams, "grams array<long>").collect()]
    found, counts = np.unique(np.concatenate([*sets, none]), return_counts=True)
    known = np.sort(found[np.lexsort((found, -counts))[:MAX_GRAMS]])
    if not len(known):
        return Model(langs, none, np.zeros((0, len(langs))))
    land = np.zeros((len(known), len(sets)), np.float32)
    for j, s in enumerate(sets):
        land[np.searchsorted(known, s[np.isin(s, known)]), j] = 1 / np.sqrt(max(1, len(s)))
    shared = docs.sparkSession.sparkContext.broadcast((known, land))
    number = {x: i for i, x in enumerate(langs)}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        spectrum, m = Spectrum(names), matrix.shape[1]
        inner, outer, n = np.zeros((m, m)), np.zeros((m, len(number))), 0
        for batch in batches:
            for first, last in _blocks(batch.column(1)):
                texts = batch.column(1).slice(first, last - first).to_pylist()
                there, _ = spectrum.presence(texts)
                size = np.array([len(pieces(coded([t])[0])) for t in texts])
                kernel = (there.astype(np.float32) @ matrix).astype(float) / np.sqrt(np.maximum(size, 1))[:, None]
                y = np.zeros((len(there), len(number)))
                y[np.arange(len(y)), [number[x] for x in batch.column(0).slice(first, last - first).to_pylist()]] = 1
                inner, outer, n = inner + kernel.T @ kernel, outer + kernel.T @ y, n + len(y)
        yield pa.RecordBatch.from_arrays([pa.array([inner.tobytes()]), pa.array([outer.tobytes()]), pa.array([n], pa.int64())], ["inner", "outer", "n"])

    m, c = len(sets), len(langs)
    parts = sample.select("lang", "text").coalesce(8).mapInArrow(sums, "inner binary, outer binary, n long").collect()
    inner = sum(np.frombuffer(bytes(r.inner)).reshape(m, m) for r in parts)
    outer = sum(np.frombuffer(bytes(r.outer)).reshape(m, c) for r in parts)
    n = sum(r.n for r in parts)
    forget(sample)
    # Nystroem: features are the landmarks' kernel values times the inverse root of the landmarks' own kernel.
    values, vectors = np.linalg.eigh(land.T.astype(float) @ land)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    solved = np.linalg.solve(root @ inner @ root + RIDGE * n * np.eye(m), root @ outer)
    return Model(langs, known, land @ (root @ solved))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every text."""
    id_type, spark = docs.schema[id_col].dataType.simpleString(), docs.sparkSession
    shared = spark.sparkContext.broadcast((model.langs, model.known, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, known, weights = shared.value
        spectrum, names = Spectrum(known), np.array([*langs, NONE], object)
        weights = weights.astype(np.float32)
        for batch in batches:
            for first, last in _blocks(batch.column(1)):
                part = batch.slice(first, last - first)
                there, has = spectrum.presence(["" if t is None else t for t in part.column(1).to_pylist()])
                if langs:
                    # The root of a text's own size would divide all its margins alike: shares do not change.
                    margin = np.maximum(there.astype(np.float32) @ weights, 0).astype(float)
                    total = margin.sum(axis=1, keepdims=True)
                    share = np.where(total > 0, margin / np.where(total > 0, total, 1), 1 / len(langs))
                    best = np.where(has, share.argmax(axis=1), len(langs))
                    score = np.where(has, np.round(share.max(axis=1), 6), 0.0)
                else:
                    best, score = np.zeros(len(part), np.int64), np.zeros(len(part))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def op13_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
