"""Periodic runs of words: every maximal stretch that repeats with a smallest period, whatever the period.

Periods up to SHORT are found by comparing the words with themselves at each lag. Longer ones are taken scale by scale,
P to 2P - 1 at a time: of every window of P / 2 stretches of P / 2 words the least hash is kept (a minimizer, found by
content alone), and inside a run of period q the same window, so the same minimizer, comes again q words later. Pairs of
equal minimizers at a distance of the scale are extended to both sides word by word.

Why nothing is lost: the first q words of a run hold a whole window. Its least stretch that is not itself of a short
period comes again q words later, and such stretches start at least P / 4 words apart, so each meets at most seven others
within the scale. Only if those q words are all of one short period d is there none; then both halves of the run lie in
two runs of period d that touch, and every period that such a pair allows is tried at the place where they touch.

Documents are cut into groups of some hundred thousand words inside a task; a document is never cut. Memory grows with
the longest document. Defined results: a null or empty text has no words and no runs; a null doc_id has no injected
repeats; repeated rows get a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import text_or_empty

LEAST_WORDS = 12
#: Periods up to this one are scanned lag by lag. A power of two of 16 or more: minimizers must not be shorter than LEAST_WORDS.
SHORT = 32
#: Characters of the texts that a task works on at once; a longer text is a group of its own.
GROUP = 1 << 21
_SPACES = r"[\x20\x09-\x0D]+"


def words_of_batch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, offsets, words): the texts' words as numbers into words; text k's are offsets[k] to offsets[k + 1]."""
    split = pc.split_pattern_regex(texts, _SPACES)
    flat, parents = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(flat.filter(pa.array(real)))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(parents[real], minlength=len(texts)))])
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets, coded.dictionary


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two columns of hashes."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C15) + (a << np.uint64(6)) + (a >> np.uint64(2)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """pick over each size neighbouring values, by doubling."""
    out, done = values, 1
    while done < size:
        step = min(done, size - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def _equal_ahead(words: np.ndarray, i: int, j: int) -> int:
    """How many words from i on equal those from j on (i < j)."""
    n, size, got = len(words), 32, 0
    while j + got < n:
        m = min(size, n - j - got)
        differ = words[i + got : i + got + m] != words[j + got : j + got + m]
        at = int(differ.argmax())
        if differ[at]:
            return got + at
        got, size = got + m, size * 2
    return got


def _equal_before(words: np.ndarray, i: int, j: int) -> int:
    """How many words before i equal those before j."""
    size, got = 32, 0
    while i - got > 0:
        m = min(size, i - got)
        differ = (words[i - got - m : i - got] != words[j - got - m : j - got])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return got + at
        got, size = got + m, size * 2
    return got


class _Finder:
    """Runs among the words of several documents that stand one after the other, with a number of its own after each."""

    def __init__(self, words: np.ndarray, longest: int):
        self.words, self.longest = words, longest
        #: (start, length) of every stretch found so far, with its smallest period.
        self.found: dict[tuple[int, int], int] = {}

    def keep(self, start: int, length: int, q: int) -> None:
        if length >= max(LEAST_WORDS, 2 * q):
            self.found[start, length] = min(q, self.found.get((start, length), q))

    def lags(self) -> None:
        w = self.words
        for q in range(1, min(SHORT, self.longest // 2 + 1) + 1):
            same = np.concatenate([[False], w[:-q] == w[q:], [False]])
            edges = np.flatnonzero(same[1:] != same[:-1])
            starts, sizes = edges[::2], edges[1::2] - edges[::2]
            for k in np.flatnonzero(sizes >= max(LEAST_WORDS - q, q)):
                self.keep(int(starts[k]), int(sizes[k]) + q, q)

    def extend(self, seeds: Iterator[tuple[int, int]]) -> None:
        """The stretches around seeds (q, i), words i and i + q equal, in order; seeds inside the last stretch are over."""
        last, end = 0, -1
        for q, i in seeds:
            if q == last and i < end:
                continue
            start = i - _equal_before(self.words, i, i + q)
            end, last = i + _equal_ahead(self.words, i, i + q), q
            self.keep(start, end - start + q, q)

    def periodic(self, k: int) -> np.ndarray:
        """Whether each stretch of k words has a period of at most k / 2."""
        marks = np.zeros(len(self.words) + 1, np.int32)
        for (start, length), q in self.found.items():
            if 2 * q <= k <= length:
                marks[start] += 1
                marks[start + length - k + 1] -= 1
        return np.cumsum(marks[: len(self.words) - k + 1]) > 0

    def scale(self, least: int, hashes: np.ndarray) -> None:
        """Periods least to 2 * least - 1, by hashes of the stretches of least / 2 words."""
        k = window = least // 2
        usable = np.where(self.periodic(k), np.iinfo(np.uint64).max, hashes)
        low = _sliding(usable, window, np.minimum)
        # The largest of the minima of the windows over a place; a place that is a minimum of one of them equals it.
        top = np.zeros(window - 1, np.uint64)
        best = _sliding(np.concatenate([top, low, top]), window, np.maximum)
        at = np.flatnonzero((usable == best) & (usable != np.iinfo(np.uint64).max))
        at = at[np.argsort(hashes[at], kind="stable")]
        h, qs, starts, r = hashes[at], [], [], 1
        while r < len(at):
            gap = at[r:] - at[:-r]
            near = (h[r:] == h[:-r]) & (gap < 2 * least)
            if not near.any():
                break
            keep = near & (gap >= least)
            qs.append(gap[keep])
            starts.append(at[:-r][keep])
            r += 1
        if qs:
            q, i = np.concatenate(qs), np.concatenate(starts)
            q, i = q[self.words[i] == self.words[i + q]], i[self.words[i] == self.words[i + q]]
            order = np.lexsort((i, q))
            self.extend(zip(q[order].tolist(), i[order].tolist()))

    def junctions(self) -> None:
        """Runs of long periods made of two touching runs of one shorter period."""
        by_period: dict[int, list[tuple[int, int]]] = {}
        for (start, length), d in self.found.items():
            if length > SHORT:
                by_period.setdefault(d, []).append((start, start + length))
        for d, spans in by_period.items():
            spans.sort()
            for (a, a_end), (b, b_end) in zip(spans, spans[1:]):
                if b > a_end:
                    continue
                # q with the words of the first run, carried on, equal to those of the second: one residue of d at most.
                block, back = self.words[b : b + d].tobytes(), self.words[a : a + 2 * d - 1].tobytes()
                size = self.words.itemsize
                place = back.find(block)
                while place >= 0 and place % size:
                    place = back.find(block, place + 1)
                if place < 0:
                    continue
                residue = (b - a - place // size) % d
                first = residue + (max(SHORT + 1, 2 * d) - residue + d - 1) // d * d
                for q in range(first, min(a_end - a, b_end - b) + 1, d):
                    # Where one run ends and the other, moved by q, goes on, the words differ; only equal ends may go further.
                    start, end = max(a, b - q), min(a_end, b_end - q)
                    start -= _equal_before(self.words, start, start + q) if a == b - q else 0
                    end += _equal_ahead(self.words, end, end + q) if a_end == b_end - q else 0
                    self.keep(start, end - start + q, q)

    def run(self) -> list[tuple[int, int, int]]:
        """(start, length, period) in order of start and period."""
        self.lags()
        hashes, size, least = _mixed(self.words.astype(np.uint64), np.ones(len(self.words), np.uint64)), 1, SHORT
        while 2 * least <= self.longest:
            while size < least // 2:
                hashes, size = _mixed(hashes[:-size], hashes[size:]), 2 * size
            # A scale must know every run of a shorter period; those that touch may make longer ones, which may touch again.
            known = -1
            while known != len(self.found):
                known = len(self.found)
                self.junctions()
            self.scale(least, hashes)
            least *= 2
        return sorted((start, length, q) for (start, length), q in self.found.items())


def runs_of(words: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, start, length, period) of each run, in order; words are numbers of 0 and more."""
    sizes = np.diff(offsets)
    if not len(sizes) or sizes.max() < LEAST_WORDS:
        return []
    out: list[tuple[int, int, int, int]] = []
    # Documents of one order of size together: long scales then look at long documents only.
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] >= LEAST_WORDS]
    classes = np.maximum(np.ceil(np.log2(sizes[order])).astype(int), int(np.log2(2 * SHORT)))
    for c in np.unique(classes):
        members = order[classes == c]
        n = sizes[members]
        starts = np.concatenate([[0], np.cumsum(n + 1)])
        joined = np.empty(starts[-1], np.int64)
        places = np.arange(starts[-1]) - np.repeat(starts[:-1], n + 1)
        ends = starts[1:] - 1
        inside = np.ones(starts[-1], bool)
        inside[ends] = False
        joined[inside] = words[(np.repeat(offsets[members], n + 1) + places)[inside]]
        joined[ends] = -1 - np.arange(len(members))
        found = _Finder(joined, int(n.max())).run()
        docs = np.searchsorted(starts, [x[0] for x in found], "right") - 1 if found else []
        out += [(int(members[d]), s - int(starts[d]), length, q) for d, (s, length, q) in zip(docs, found)]
    return sorted(out, key=lambda x: (x[0], x[1], x[3]))


def injected(codes: np.ndarray, offsets: np.ndarray, ids: list) -> np.ndarray:
    """codes with the repeats that a document's id asks for: a tenth of them repeats a stretch up to its end."""
    out = codes
    for k, i in enumerate(ids):
        if i is None:
            continue
        h = zlib.crc32(str(i).encode())
        n = int(offsets[k + 1] - offsets[k])
        if h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        if out is codes:
            out = codes.copy()
        base = int(offsets[k])
        out[base + a : base + n] = codes[base + a + np.arange(n - a) % p]
    return out


def _groups(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of texts of about GROUP characters together."""
    first, total = 0, 0
    for k, n in enumerate(lengths.tolist()):
        if k > first and total + n > GROUP:
            yield first, k
            first, total = k, 0
        total += n
    if first < len(lengths):
        yield first, len(lengths)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _collapsed(codes: np.ndarray, offsets: np.ndarray, dictionary: pa.Array, runs: list) -> pa.Array:
    """Each text's words joined by one space, without the words after a run's first period."""
    marks = np.zeros(len(codes) + 1, np.int64)
    for d, start, length, q in runs:
        marks[offsets[d] + start + q] += 1
        marks[offsets[d] + start + length] -= 1
    kept = np.cumsum(marks[:-1]) == 0
    ends = np.concatenate([[0], np.cumsum(kept)])[offsets]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), dictionary.take(pa.array(codes[kept]))), " ")


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", inject: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): all runs (start, length, period), and the text without their repeats.

    inject: repeats planted by id, for tests of what is found (see injected).
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in _groups(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False)):
                part = batch.slice(first, last - first)
                codes, offsets, dictionary = words_of_batch(part.column(1))
                if inject:
                    codes = injected(codes, offsets, part.column(0).to_pylist())
                runs = runs_of(codes, offsets)
                docs_of = np.array([x[0] for x in runs], np.int64)
                ends = np.searchsorted(docs_of, np.arange(len(part) + 1))
                struct = pa.StructArray.from_arrays([pa.array([x[j] for x in runs], pa.int64()) for j in (1, 2, 3)], ["start", "length", "period"])
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)
                collapsed = _collapsed(codes, offsets, dictionary, runs)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets), pa.int64()), listed, collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """The longest run of each document, and digests of all its runs and of the collapsed text."""
    order = "(a, b) -> case when a.length <> b.length then if(a.length > b.length, -1, 1) when a.start <> b.start then if(a.start < b.start, -1, 1) else if(a.period < b.period, -1, 1) end"
    best = found.withColumn("_best", F.expr(f"get(array_sort(runs, {order}), 0)"))
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_query(spark, sf_dir: str) -> DataFrame:
    return digests(find_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), inject=True))

