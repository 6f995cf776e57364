"""Nearest neighbours by learned partitions.

On a bounded sample of vectors (about SAMPLE, those of smallest hash) the graph of nearest neighbours is cut into
balanced parts, and a small classifier learns in which parts a vector's neighbours lie. The number of parts grows with
the table, up to PARTS; beyond that each part is cut again in the same way, on a bounded sample of its own rows, so no
task and no model grows with the table. Every vector is indexed under its most probable leaf; a query goes to several
most probable leaves, and what is found there is ranked again by exact inner products in double precision.

How many leaves a query goes to is measured: the neighbours of HELD_OUT vectors of the sample, which the classifier has
not seen, are found by brute force over the whole index, and as many leaves are probed as reach TARGET of them.

Equal vectors are indexed once with their smallest ids, as many as an answer can hold, so a vector that a third of all
rows share weighs no more than another. Leaves that lie together are searched in one task, in blocks of bounded size,
each query block against each candidate block of its leaves.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite numbers, and rows
with a null id, take no part; ties go to the smaller id; a query meets every candidate but those of its own id; of
several vectors of one query id the smallest is asked; a table too small to cut is searched whole; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import forget, stash

SAMPLE, HELD_OUT, NEIGHBOURS, TARGET = 8192, 256, 10, 0.93
#: Rows of a leaf of a small table, parts of the first cut, and rows of a part above which it is cut again, into how many.
LEAF_ROWS, PARTS, CUT_AGAIN, SUB_PARTS, SUB_SAMPLE = 48, 1024, 4096, 64, 4096
CANDIDATE_BLOCK, QUERY_BLOCK = 16384, 512
SHARPNESS, EPOCHS, SEED = 8.0, 6, 11


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of each row by inner product, itself not counted."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        g = x[at : at + 1024] @ x.T
        g[np.arange(len(g)), np.arange(at, at + len(g))] = -np.inf
        out[at : at + 1024] = np.argpartition(-g, k - 1, axis=1)[:, :k]
    return out


def _edges(graph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, k = graph.shape
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    return np.concatenate([a, b]), np.concatenate([b, a])


def balanced_parts(graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each node: halves cut at the median of a smooth vector, again and again, then moved by neighbours' votes."""
    n = len(graph)
    rng = np.random.RandomState(SEED)
    part = np.zeros(n, np.int64)
    a, b = _edges(graph)
    for _ in range(int(np.log2(parts))):
        inside = part[a] == part[b]
        ia, ib = a[inside], b[inside]
        degree = np.bincount(ia, minlength=n) + 1e-9
        sizes = np.bincount(part)
        v = rng.randn(n)
        for _ in range(60):
            v = 0.5 * v + 0.5 * np.bincount(ia, v[ib], n) / degree
            v -= (np.bincount(part, v) / sizes)[part]
            v /= np.sqrt(np.bincount(part, v * v) / sizes + 1e-30)[part]
        order = np.lexsort((v, part))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        part = 2 * part + (place >= (sizes // 2)[part])
    room = int(np.ceil(1.1 * n / parts))
    for _ in range(rounds):
        votes = np.bincount(a * parts + part[b], minlength=n * parts).reshape(n, parts)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        load, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if load[best[i]] < room:
                load[part[i]] -= 1
                load[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A softmax classifier that gives each part's share of a vector's neighbours."""

    def __init__(self, w: np.ndarray, b: np.ndarray):
        self.w, self.b = w, b

    @property
    def parts(self) -> int:
        return len(self.b)

    def log_share(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.w + self.b
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    @classmethod
    def fit(cls, x: np.ndarray, share: np.ndarray) -> Router:
        """Begins at the parts' mean vectors; a few rounds of Adam on cross-entropy follow."""
        rng = np.random.RandomState(SEED)
        scale = np.sqrt((x * x).sum(axis=1).mean()) + 1e-300
        means = share.T @ x
        length = np.sqrt((means * means).sum(axis=1, keepdims=True))
        w = [SHARPNESS / scale * (means / np.where(length > 0, length, 1)).T, np.where(share.sum(axis=0) > 0, 0.0, -30.0)]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 1024)):
                p = np.exp(cls(*w).log_share(x[rows]))
                d = (p - share[rows]) / len(rows)
                t += 1
                for i, g in enumerate((x[rows].T @ d, d.sum(axis=0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.99 * v[i] + 0.01 * g * g
                    w[i] = w[i] - (0.05 / scale if i == 0 else 0.05) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-12)
        return cls(*w)


def learn(x: np.ndarray, parts: int) -> Router:
    """Cut the neighbour graph of x into parts (a power of two) and learn to route."""
    if parts < 2 or len(x) < 2 * parts:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1))
    graph = neighbour_graph(x, min(NEIGHBOURS, len(x) - 1))
    part = balanced_parts(graph, parts)
    share = np.zeros((len(x), parts))
    np.add.at(share, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1)
    share[np.arange(len(x)), part] += graph.shape[1] / 2
    return Router.fit(x, share / share.sum(axis=1, keepdims=True))


@dataclass
class Tree:
    """The classifier of the first cut and one for each part that was cut again into sub leaves."""

    top: Router
    subs: dict[int, Router]
    sub: int = 1
    #: Parts of the first cut, and leaves, that a query goes to.
    top_probes: int = 1
    probes: int = 1

    @property
    def leaves(self) -> int:
        return self.top.parts * self.sub

    def home(self, x: np.ndarray) -> np.ndarray:
        """The most probable leaf of each vector."""
        part = self.top.log_share(x).argmax(axis=1)
        out = part * self.sub
        for p in np.unique(part) if self.sub > 1 else ():
            rows = np.flatnonzero(part == p)
            out[rows] += self.subs[int(p)].log_share(x[rows]).argmax(axis=1)
        return out

    def ordered(self, x: np.ndarray, parts: int) -> np.ndarray:
        """The leaves of the most probable parts of each vector, by falling probability."""
        share = self.top.log_share(x)
        best = np.argsort(-share, axis=1, kind="stable")[:, :parts]
        if self.sub == 1:
            return best
        out = np.repeat(np.take_along_axis(share, best, axis=1), self.sub, axis=1)
        for p in np.unique(best):
            rows, at = np.nonzero(best == p)
            out[rows[:, None], at[:, None] * self.sub + np.arange(self.sub)] += self.subs[int(p)].log_share(x[rows])
        leaves = (best[:, :, None] * self.sub + np.arange(self.sub)).reshape(len(x), -1)
        return np.take_along_axis(leaves, np.argsort(-out, axis=1, kind="stable"), axis=1)

    def probed(self, x: np.ndarray) -> np.ndarray:
        return self.ordered(x, self.top_probes)[:, : self.probes]


@dataclass
class Index:
    """rows (v, ids, leaf) of the distinct vectors, their numbers by leaf, and what was measured on held-out vectors."""

    rows: DataFrame
    tree: Tree
    size: int
    keep: int
    counts: dict[int, int]
    recall: float = 1.0
    #: Share of the index that a query is compared with.
    share: float = 1.0


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(sound)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def _with_leaf(rows: DataFrame, tree: Tree, size: int) -> DataFrame:
    """rows (v, ids) with the leaf of each."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = shared.value.home(_matrix(batch.column(0), size)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves.astype(np.int32))], [*batch.schema.names, "leaf"])

    return rows.select("v", "ids").mapInArrow(run, f"v {dict(rows.dtypes)['v']}, ids array<long>, leaf int")


def _sample(rows: DataFrame, n: int, size: int) -> np.ndarray:
    """About SAMPLE of n distinct vectors, by hash: at most so many come to the driver, whatever the table."""
    share = min(1.0, SAMPLE / max(1, n))
    got = rows.select("v").where(F.pmod(F.xxhash64("v", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).collect()
    x = np.array(sorted(r.v for r in got), float).reshape(len(got), size)
    return x[np.random.RandomState(SEED).permutation(len(x))]


def _sub_routers(rows: DataFrame, size: int, sub: int) -> dict[int, Router]:
    """For each part, numbered by leaf in rows, a classifier learnt from at most SUB_SAMPLE of its rows."""
    order = F.row_number().over(W.partitionBy("leaf").orderBy(F.xxhash64("v", F.lit(6)), "ids"))
    some = rows.withColumn("at", order).where(F.col("at") <= SUB_SAMPLE).select("leaf", "v")

    def run(table: pa.Table) -> pa.Table:
        x = np.unique(_matrix(table.column("v"), size), axis=0)
        got = learn(x[np.random.RandomState(SEED).permutation(len(x))], min(sub, 1 << max(0, (len(x) // 16).bit_length() - 1)))
        return pa.table({"leaf": table.column("leaf")[:1], "w": pa.array([got.w.ravel().tolist()], pa.list_(pa.float64())), "b": pa.array([got.b.tolist()], pa.list_(pa.float64()))})

    out = {}
    for r in some.groupBy("leaf").applyInArrow(run, "leaf int, w array<double>, b array<double>").collect():
        w, b = np.zeros((size, sub)), np.full(sub, -1e9)
        w[:, : len(r.b)], b[: len(r.b)] = np.array(r.w).reshape(size, -1), r.b
        out[r.leaf] = Router(w, b)
    return out


def _nearest_leaves(index: DataFrame, held: np.ndarray, k: int) -> dict[int, list[int]]:
    """The leaves of the k nearest of all indexed vectors to each of held, itself left out, by brute force."""
    size = held.shape[1]
    shared = index.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        square = (own * own).sum(axis=1)
        best, leaf = np.full((len(own), k), -np.inf), np.zeros((len(own), k), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column(0), size)
                g = own @ x.T
                # A held vector meets itself where product and lengths agree; only such few pairs are compared in full.
                for r, c in zip(*np.nonzero((np.abs(g - square[:, None]) <= 1e-6 * square[:, None]) & (np.abs((x * x).sum(axis=1) - square[:, None]) <= 1e-6 * square[:, None]))):
                    if (own[r] == x[c]).all():
                        g[r, c] = -np.inf
                g = np.concatenate([best, g], axis=1)
                leaves = np.concatenate([leaf, np.broadcast_to(part.column(1).to_numpy().astype(np.int64), (len(own), len(x)))], axis=1)
                top = np.argpartition(-g, k - 1, axis=1)[:, :k]
                best, leaf = np.take_along_axis(g, top, axis=1), np.take_along_axis(leaves, top, axis=1)
        ok = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(ok)[0].astype(np.int32)), pa.array(leaf[ok].astype(np.int32)), pa.array(best[ok])], ["h", "leaf", "score"])

    near = index.select("v", "leaf").mapInArrow(run, "h int, leaf int, score double")
    near = near.withColumn("at", F.row_number().over(W.partitionBy("h").orderBy(F.col("score").desc(), "leaf"))).where(F.col("at") <= k)
    out: dict[int, list[int]] = {}
    for r in near.select("h", "leaf").collect():
        out.setdefault(r.h, []).append(r.leaf)
    return out


def _leaf_counts(rows: DataFrame) -> dict[int, int]:
    """At most PARTS times SUB_PARTS rows."""
    return {r.leaf: r["count"] for r in rows.groupBy("leaf").count().collect()}


def build(vectors: DataFrame, k: int) -> Index:
    """The index of vectors (vec_id, v) for searches of the k nearest."""
    most = vectors.groupBy(F.size("v").alias("size")).count().orderBy(F.col("count").desc(), "size").first()
    size, keep = (most.size if most else 1), k + 1
    # Equal vectors once, with the smallest ids that an answer can need.
    numbered = vectors.where(F.size("v") == size).withColumn("at", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("at") <= keep)
    distinct = stash(numbered.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "ann-vectors")
    n = distinct.count()
    x = _sample(distinct, n, size)
    held, base = np.split(x, [min(HELD_OUT, len(x) // 6)])
    parts = min(PARTS, 1 << max(0, min(n // LEAF_ROWS, len(base) // 6).bit_length() - 1))
    tree = Tree(learn(base, parts), {})
    rows = stash(_with_leaf(distinct, tree, size), "ann-index")
    if n > tree.top.parts * CUT_AGAIN:
        tree.sub = min(SUB_PARTS, 1 << (-(-n // (tree.top.parts * CUT_AGAIN)) - 1).bit_length())
        tree.subs = _sub_routers(rows, size, tree.sub)
        missing = Router(np.zeros((size, tree.sub)), np.where(np.arange(tree.sub) == 0, 0.0, -1e9))
        tree.subs = {p: tree.subs.get(p, missing) for p in range(tree.top.parts)}
        forget(rows)
        rows = stash(_with_leaf(distinct, tree, size), "ann-index")
    forget(distinct)
    index = Index(rows, tree, size, keep, _leaf_counts(rows))
    tree.top_probes, tree.probes = tree.top.parts, tree.leaves
    if tree.leaves > 1 and len(held):
        _measure(index, held, k)
    return index


def _measure(index: Index, held: np.ndarray, k: int) -> None:
    """Sets how many parts and leaves are probed, by the true neighbours of held vectors."""
    tree, near = index.tree, _nearest_leaves(index.rows, held, k)
    who = np.repeat(list(near), [len(v) for v in near.values()])
    leaf = np.concatenate([np.array(v) for v in near.values()])

    def ranks(order: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        place = np.full((len(order), int(order.max()) + 1), order.shape[1])
        np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
        return place[who, np.minimum(wanted, place.shape[1] - 1)]

    part_ranks = np.sort(ranks(np.argsort(-tree.top.log_share(held), axis=1, kind="stable"), leaf // tree.sub))
    at = lambda sorted_ranks, share: int(sorted_ranks[min(len(sorted_ranks) - 1, int(np.ceil(share * len(sorted_ranks))) - 1)]) + 1
    tree.top_probes = min(tree.top.parts, at(part_ranks, TARGET if tree.sub == 1 else (1 + TARGET) / 2))
    order = tree.ordered(held, tree.top_probes)
    leaf_ranks = np.sort(ranks(order, leaf))
    tree.probes = min(order.shape[1], at(leaf_ranks, TARGET))
    index.recall = float((leaf_ranks < tree.probes).mean())
    rows = np.zeros(tree.leaves)
    rows[list(index.counts)] = list(index.counts.values())
    index.share = float(rows[order[:, : tree.probes]].sum(axis=1).mean() / max(1, rows.sum()))


def _bins(counts: dict[int, int], leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """The first bin of each leaf and its number of bins: small leaves share one, large ones are cut into several."""
    first, n = np.zeros(leaves, np.int64), np.zeros(leaves, np.int64)
    at, held = 0, 0
    for leaf in sorted(counts):
        size = counts[leaf]
        if held and held + size > CANDIDATE_BLOCK:
            at, held = at + 1, 0
        first[leaf], n[leaf] = at, max(1, -(-size // CANDIDATE_BLOCK))
        if n[leaf] > 1:
            at, held = at + int(n[leaf]), 0
        else:
            held += size
    return first, n


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of the index found for each of queries (vec_id, v)."""
    spark = queries.sparkSession
    size, keep = index.size, index.keep
    first, n_bins = _bins(index.counts, index.tree.leaves)
    # As long as there are leaves: PARTS times SUB_PARTS numbers at most.
    shared = spark.sparkContext.broadcast((index.tree, first, n_bins))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, first_bin, bins = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                chosen = tree.probed(_matrix(part.column(0), size))
                row, leaf, where = [], [], []
                for r, leaves in enumerate(chosen):
                    leaves = np.repeat(leaves, bins[leaves])
                    to = first_bin[leaves]
                    # The bins of a leaf that was cut follow one another.
                    to = to + np.arange(len(leaves)) - np.concatenate([[0], np.flatnonzero(np.diff(leaves)) + 1])[np.cumsum(np.concatenate([[0], np.diff(leaves) != 0])).astype(int)] if len(leaves) else to
                    order = np.argsort(to, kind="stable")
                    cuts = np.flatnonzero(np.diff(to[order])) + 1
                    for piece in np.split(order, cuts) if len(order) else ():
                        row.append(r)
                        where.append(to[piece[0]])
                        leaf.append(leaves[piece].astype(np.int32))
                taken = part.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(where, pa.int32()), pa.array(leaf, pa.list_(pa.int32()))], [*taken.schema.names, "bin", "leaves"])

    asked = queries.where(F.size("v") == size).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")).select("v", "query_id")
    asked = stash(asked.mapInArrow(route, f"v {dict(queries.dtypes)['v']}, query_id long, bin int, leaves array<int>"), "ann-queries")
    blocks = stash(asked.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("n_q")), "ann-blocks")
    places = F.broadcast(spark.createDataFrame([(p, int(first[p]), int(n_bins[p])) for p in sorted(index.counts)] or [(-1, 0, 1)], "leaf int, first int, n int"))
    left = index.rows.join(places, "leaf").withColumn("bin", (F.col("first") + F.pmod(F.xxhash64("ids"), F.col("n"))).cast("int")).select("v", "ids", "leaf", "bin")
    left = left.join(blocks, "bin").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)))
    # Read again: plans that share columns cannot be grouped together.
    right = asked.join(spark.read.schema(blocks.schema).parquet(blocks._quillon_path), "bin").withColumn("q", F.pmod(F.xxhash64("query_id"), F.col("n_q")).cast("int"))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if a.num_rows and b.num_rows:
            a = a.sort_by("leaf")
            x, y = _matrix(a.column("v"), size), _matrix(b.column("v"), size)
            ids, asking = a.column("ids").to_pylist(), b.column("query_id").to_pylist()
            there, starts = np.unique(a.column("leaf").to_numpy(), return_index=True)
            wanted = b.column("leaves").combine_chunks()
            who = np.repeat(np.arange(len(y)), wanted.value_lengths().to_numpy())
            leaves = wanted.flatten().to_numpy()
            order = np.argsort(leaves, kind="stable")
            leaves, who = leaves[order], who[order]
            g = np.full((len(y), len(x)), -np.inf)
            for leaf, s, e in zip(there, starts, [*starts[1:], len(x)]):
                asks = who[np.searchsorted(leaves, leaf) : np.searchsorted(leaves, leaf, "right")]
                g[asks, s:e] = y[asks] @ x[s:e].T
            n = min(keep, len(x))
            slack = 1e-9 * (1 + np.abs(g[np.isfinite(g)]).max(initial=0.0))
            least = np.partition(g, len(x) - n, axis=1)[:, len(x) - n] - slack
            for r, query in enumerate(asking):
                near = np.flatnonzero((g[r] >= least[r]) & (g[r] > -np.inf))
                # The sum runs in the same order for every vector, so equal vectors tie exactly.
                scores = (x[near] * y[r]).sum(axis=1)
                found = sorted((-s, i) for s, j in zip(scores.tolist(), near) for i in ids[j] if i != query)[:k]
                rows += [(query, i, -s) for s, i in found]
        columns = list(zip(*rows)) or [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    found = left.groupBy("bin", "q").cogroup(right.groupBy("bin", "q")).applyInArrow(compare, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_query(spark, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(build(rows, 20), rows.where("vec_id % 20 = 0"), 20)
