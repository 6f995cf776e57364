"""N-gram Jaccard join by PartEnum signatures.

A document's set is its distinct 5-word shingles; two documents link when |A and B| / |A or B| is at least 0.8.

Signatures. Linked sets differ in at most (|A| + |B|) / 9 elements. The domain of elements is cut by a hash into parts,
as many as fit a band of sizes (powers of two; a set within 0.8 of the next band also joins that one). Of the parts
that either of two linked sets reaches, taken in order, the differing elements touch at most k, so among the first
k + 1 at least one holds the same elements in both. A set therefore emits one signature for each of the first k + 1
parts it reaches, k being the most that any partner of its size allows: sets that link share a signature. A set that
reaches too few parts emits a common signature of its band besides, so none is lost.

Equal sets are merged first and stand for one another. Sharing a signature only makes a candidate; candidates are
compared on whole texts. Each set is first compared with the smallest id that shares most of its signatures. Groups of
one signature whose sets are not all connected by then are joined by their smallest ids into clusters, and in each the
sets outside its largest component are compared with all others through an index of shingles. Pairs already connected
need no comparison, and no pairs are written down but those that link. Clusters too large are cut again by signatures
of a second, independent family, which linked sets share as well, and what is still large is compared block by block.

Defined results: a null or empty text has an empty set and links with nothing; with fewer than five words the whole
sequence is the only element; equal texts link; rows with a null id link with nothing and get a null component.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import forget, split_by_keys, stash, text_or_empty

WORDS = 5
#: 0.8 as a fraction of whole numbers.
NUM, DEN = 4, 5
SALTS = 16
#: Shingles of a block of sets that are compared in one task, and of a cluster that is cut again before.
BLOCK, LARGE = 1 << 21, 1 << 24
STAR_ROWS = 400
#: Rows of one signature that one task takes, and how far a hash bucket of signatures is above the average then.
HOT, HOT_TIMES = 1 << 20, 8

_U = np.uint64
_TABLE = np.random.RandomState(12345).randint(0, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_P, _Q = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = [np.cumprod(np.concatenate([[_U(1)], np.full(63, _P)]), dtype=_U)]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, A-Z in lower case."""
    data = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, _U)
    lengths = ends - starts
    keep = inside[1:-1]
    at = np.flatnonzero(keep)
    place = at - np.repeat(starts, lengths)
    longest = int(lengths.max())
    if longest > len(_POWERS[0]):
        _POWERS[0] = np.cumprod(np.concatenate([[_U(1)], np.full(longest, _P)]), dtype=_U)
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return _mix(np.add.reduceat(_TABLE[data[at]] * _POWERS[0][place], firsts) + lengths.astype(_U))


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the 5-word shingles, or of the whole sequence of fewer words."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(WORDS, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, _U)
    for i in range(k):
        h = h * _Q + w[i : i + n]
    return np.unique(_mix(h))


def _bands(n: int) -> list[int]:
    own = n.bit_length() - 1
    return [own, own + 1] if DEN * n >= NUM << (own + 1) else [own]


def _parts(band: int) -> int:
    """Parts of a band: about 2.6 elements each for the largest sets, more parts than elements for tiny ones."""
    return 256 if band <= 3 else 64 if band == 4 else (10 << (band + 1)) // 26


def _first_parts(parts: np.ndarray, k: int, tag: int) -> np.ndarray:
    """Signatures of the first k + 1 parts given; one for all sets besides where there are no more than k."""
    out = _mix(parts[: k + 1] + _mix(np.array([tag], _U)))
    return np.concatenate([out, _mix(np.array([tag + 1], _U))]) if len(parts) <= k else out


def signatures(s: np.ndarray, family: int = 0) -> np.ndarray:
    """Signatures of a set; linked sets share one of each family.

    Parts that hold a single element of a set say little and are passed over; whether one is, depends only on what it
    holds, so the argument stands for the parts left. A set left with too few of them emits as if none were passed over,
    for the sake of partners in the same case.
    """
    n, out = len(s), []
    for band in _bands(n) if n else []:
        parts, most = _parts(band), (2 << band) - 1
        k = (n + min(n * DEN // NUM, most)) // 9
        h = _mix(s + _U(1000003 * (band + 1) + 7919 * family))
        part = (h >> _U(33)) % _U(parts)
        order = np.argsort(part, kind="stable")
        part = part[order]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        held = np.diff(np.append(starts, n))
        ids = np.add.reduceat(_mix(h[order] + _U(1)), starts) + _mix(part[starts] + _U(1 << 20))
        tag = (band + 1) << 8 | family << 16
        full = ids[held > 1] if band > 4 else ids[:0]
        if len(full) > k:
            out.append(_first_parts(full, k, tag))
        else:
            out += [_mix(full + _mix(np.array([tag], _U))), _first_parts(ids, k, tag + 2)]
    return np.unique(np.concatenate(out)) if out else np.zeros(0, _U)


def jaccard_links(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= 80 * (len(a) + len(b) - shared) and shared > 0


def _signed(docs: DataFrame, family: int = 0) -> DataFrame:
    """(doc_id, n, fp1, fp2, sigs) of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                n, fp1, fp2, sigs = [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle_set(text)
                    n.append(len(s))
                    fp1.append(_mix(s + _U(11)).sum(dtype=_U) + _U(len(s)))
                    fp2.append(_mix(s + _U(23)).sum(dtype=_U))
                    sigs.append(signatures(s, family))
                ends = np.cumsum([0, *map(len, sigs)])
                flat = np.concatenate([*sigs, np.zeros(0, _U)]).view(np.int64)
                longs = lambda x: pa.array(np.array(x, _U).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), longs(fp1), longs(fp2), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["doc_id", "n", "fp1", "fp2", "sigs"])

    return docs.mapInArrow(run, "doc_id long, n long, fp1 long, fp2 long, sigs array<long>")


def _free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans now. It does so when their plans are collected, and asks the
    driver's JVM for a collection itself, but only every spark.cleaner.periodicGC.interval (half an hour)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def verify(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Of candidate edges (a, b), distinct and a < b, those that link.

    The text of b travels to a. What travels is only the texts of candidates; a hub with many partners is copied to
    several tasks, each of which streams its partners, so no group must fit into memory.
    """
    counts = stash(edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).cast("int").alias("salts")), "hubs")
    sent = edges.join(counts, "a").select(F.col("b").alias("doc_id"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    sent = sent.union(counts.select(F.col("a"), F.col("a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1))))
    sent = stash(sent, "sent")
    texts = _texts_of(sent, docs)
    # Both sides grow with the corpus, so neither is broadcast at any size.
    rows = sent.select("doc_id", "hub", "salt").join(texts.hint("merge"), "doc_id").withColumn("member", F.col("doc_id") != F.col("hub"))
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member").select("hub", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            a, b = [], []
            for h, d, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = shingle_set(text)
                if h == d:
                    hub, own = h, s
                elif h == hub and jaccard_links(own, s):
                    a.append(h)
                    b.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    out = stash(rows.mapInArrow(run, "a long, b long").distinct(), "links")
    forget(counts, sent)
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, label): for each id in links (a, b), the smallest id it is connected with.

    Each round takes the smallest label among neighbours and then the label of that label, so chains halve.
    """
    both = stash(links.select("a", "b").union(links.select("b", "a")).distinct(), "neighbours")
    labels = stash(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        better = labels.join(heard, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("l"))
        up = labels.select(F.col("id").alias("l"), F.col("label").alias("up"))
        new = stash(better.join(up, "l", "left").select("id", "old", F.least("l", F.coalesce("up", "l")).alias("label")), "labels")
        done = new.where("label != old").limit(1).count() == 0
        forget(labels)
        labels = new.select("id", "label")
        labels._quillon_path = new._quillon_path
        if done:
            forget(both)
            return labels


def _shared_signatures(sets: DataFrame) -> DataFrame:
    """(sig, id, n, h, first, k) of signatures that k > 1 rows of sets (doc_id, n, fp1, sigs) have, of two ids or more.

    h tells a row from all others of its signature. Signatures are counted in hash buckets first, all of them. Those of
    ordinary buckets meet in one window each; those of a bucket far above the average, where one signature may hold a
    large share of all rows, are summed up before they are shuffled, and their rows are joined with the sums by salts,
    as many as keep a task below HOT rows.
    """
    n_buckets = 1 << min(20, max(10, (sets.count() // 4).bit_length()))
    rows = sets.select(F.col("doc_id").alias("id"), "n", F.xxhash64("doc_id", "fp1").alias("h"), F.explode("sigs").alias("sig"))
    bucket = F.pmod(F.xxhash64("sig", F.lit(5)), F.lit(n_buckets)).cast("int").alias("bucket")
    counts = stash(rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("k")), "signature-counts")
    # At most 2^20 rows.
    hot = counts.where(F.col("k") > F.greatest(F.lit(HOT), F.lit(HOT_TIMES * (counts.agg(F.avg("k")).first()[0] or 0)))).select("bucket", F.ceil(F.col("k") / HOT).cast("int").alias("salts"))
    names = ["sig", "id", "n", "h", "first", "k"]
    group = lambda e: F.expr(f"{e} over (partition by sig)")
    cold = rows
    if is_hot := hot.limit(1).count() > 0:
        cold = rows.withColumn("bucket", bucket).join(F.broadcast(hot), "bucket", "left_anti").drop("bucket")
    out = cold.withColumn("first", group("min(id)")).withColumn("last", group("max(id)")).withColumn("k", group("count(1)")).where("first < last").select(*names)
    if is_hot:
        some = rows.withColumn("bucket", bucket).join(F.broadcast(hot), "bucket")
        sums = some.groupBy("sig", "salts").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("k")).where("first < last")
        sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("last", "salts")
        out = out.unionByName(some.withColumn("salt", F.pmod("h", F.col("salts")).cast("int")).join(sums.hint("merge"), ["sig", "salt"]).select(*names))
    out = stash(out, "shared")
    forget(counts)
    return out


def _different_groups(shared: DataFrame) -> DataFrame:
    """One of all groups that hold the same rows, with their number as weight."""
    groups = shared.groupBy("sig").agg(F.expr("bit_xor(h)").alias("g1"), F.expr("bit_xor(xxhash64(h, 3))").alias("g2"), F.min("k").alias("k"), F.min("first").alias("f"))
    groups = groups.groupBy("g1", "g2", "k", "f").agg(F.min("sig").alias("sig"), F.count(F.lit(1)).alias("weight"))
    groups = groups.select("sig", "weight", F.explode(F.sequence(F.lit(0), F.ceil(F.col("k") / HOT).cast("int") - 1)).alias("salt"))
    rows = shared.withColumn("salt", F.pmod(F.col("h"), F.ceil(F.col("k") / HOT)).cast("int"))
    out = stash(rows.join(stash(groups, "groups"), ["sig", "salt"]).select("sig", "id", "n", "first", "weight"), "shared")
    forget(shared)
    return out


def _open_clusters(rows: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Of rows (key, id, n), each once and with its label, those of clusters that hold more than one component."""
    rows = rows.select("key", "id", "n").distinct() if labels is not None else rows
    if labels is not None:
        rows = stash(rows.join(labels, "id", "left").select("key", "id", "n", F.coalesce("label", "id").alias("label")), "cluster-rows")
    sizes = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("n").alias("size")).where("lo < hi")
    return rows.join(stash(sizes.select("key", "size"), "cluster-sizes"), "key")


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """docs without most of those whose id is not in ids."""
    return split_by_keys(docs, ids, ["doc_id"])[0].select("doc_id", "text")


def _cut_again(rows: DataFrame, docs: DataFrame, family: int) -> DataFrame:
    """Clusters cut by signatures of another family: sets that link stay together in at least one of the new ones."""
    more = _signed(_texts_of(rows.select(F.col("id").alias("doc_id")), docs), family).select(F.col("doc_id").alias("id"), F.explode("sigs").alias("sig"))
    more = stash(rows.join(more, "id").select("key", "id", "n", "label", "sig"), "cut")
    first = more.groupBy("key", "sig").agg(F.min("id").alias("first"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key", "sig", "first")
    out = more.join(stash(first, "cut-groups"), ["key", "sig"]).select(F.xxhash64("key", "first").alias("key"), "id", "n", "label").distinct()
    return stash(out, "cut-clusters")


class _Block:
    """Sets as one index from shingle to sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        elements = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(elements, kind="stable")
        self.elements, self.owner = elements[order], owner[order]

    def links(self, s: np.ndarray) -> np.ndarray:
        """Places of the sets that link with s."""
        lo, hi = np.searchsorted(self.elements, s, "left"), np.searchsorted(self.elements, s, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero((shared > 0) & (100 * shared >= 80 * (len(s) + self.sizes - shared)))


def compare_clusters(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between different components of the clusters (key, id, n, label), one for each set and component.

    A cluster's largest component needs no comparison in itself: only sets outside it look for partners. Both sides come
    in blocks of about BLOCK shingles, so no task holds more than two of those.
    """
    counts = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"))
    main = stash(counts.groupBy("key").agg(F.max(F.struct("k", "label"))["label"].alias("main")), "main")
    rows = stash(rows.join(main, "key").withColumn("seeks", F.col("label") != F.col("main")).drop("main"), "to-compare")
    blocks = rows.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("n_all"), F.ceil(F.sum(F.when(F.col("seeks"), F.col("n")).otherwise(0)) / BLOCK).cast("int").alias("n_seek"))
    rows = rows.join(stash(blocks, "blocks"), "key")
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(9)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    seek = rows.where("seeks").withColumn("s", own("n_seek")).withColumn("a", every("n_all")).withColumn("side", F.lit(1))
    found = rows.withColumn("a", own("n_all")).withColumn("s", every("n_seek")).withColumn("side", F.lit(2))
    names = ["key", "s", "a", "id", "label"]
    # side 3: in one task on both sides, so the text travels once.
    sent = stash(seek.select(*names, "side").union(found.select(*names, "side")).groupBy(*names).agg(F.sum("side").cast("int").alias("side")).withColumnRenamed("id", "doc_id"), "sent")
    moved = sent.join(_texts_of(sent, docs).hint("merge"), "doc_id").repartition("key", "s", "a").sortWithinPartitions("key", "s", "a")
    moved = moved.select("key", "s", "a", "doc_id", "label", "side", "text")

    def matched(ids: list[int], labels: list[int], sides: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        there = [i for i, side in enumerate(sides) if side & 2]
        if not there:
            return
        block, label = _Block([sets[i] for i in there]), np.array([labels[i] for i in there])
        for i, side in enumerate(sides):
            if side & 1:
                near = block.links(sets[i])
                near = near[label[near] != labels[i]]
                for j in near[np.unique(label[near], return_index=True)[1]]:
                    yield ids[i], ids[there[j]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = np.array(pairs, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        now, held = None, ([], [], [], [])
        for batch in batches:
            pairs = []
            for key, s, a, doc, label, side, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, s, a) != now:
                    pairs += matched(*held)
                    now, held = (key, s, a), ([], [], [], [])
                for column, value in zip(held, (doc, label, side, shingle_set(text))):
                    column.append(value)
            yield out(pairs)
        yield out(list(matched(*held)))

    links = stash(moved.mapInArrow(run, "a long, b long").distinct(), "cluster-links")
    forget(sent)
    return links


def _set_groups(members: DataFrame) -> DataFrame:
    """(fp1, fp2, n, rep, k, salt) of sets that k > 1 documents have: once for each salt, for joins with all of them."""
    named = members.where("n > 0 and doc_id is not null")
    groups = named.groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _without_copies(signed: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of signed of the smallest document of each set, each once. Only rows in a copy's hash bucket are shuffled."""
    salted = members.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS)))
    copies = stash(salted.join(_set_groups(members), ["fp1", "fp2", "n", "salt"]).where("doc_id != rep").select("doc_id", "fp1").distinct(), "copies")
    # Rows equal in id and set are one: the smallest document's own repetitions go as well.
    counts = members.where("n > 0 and doc_id is not null").groupBy("doc_id", "fp1").agg(F.count(F.lit(1)).alias("k"))
    repeated = counts.where("k > 1").select("doc_id", "fp1")
    near, far = split_by_keys(signed, copies.union(repeated), ["doc_id", "fp1"])
    # Both sides grow with the corpus, so neither is broadcast at any size.
    near = near.dropDuplicates(["doc_id", "fp1"]).join(copies.hint("merge"), ["doc_id", "fp1"], "left_anti")
    return near.select(*signed.columns).unionByName(far.select(*signed.columns))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    signed = stash(_signed(docs), "signed")
    named = signed.where("n > 0 and doc_id is not null")
    members = stash(signed.select("doc_id", "n", "fp1", "fp2"), "members")
    # Read for the count, the buckets' counts and the rows themselves: the anti join runs once.
    single = stash(_without_copies(named, members), "single")
    shared = _different_groups(_shared_signatures(single))
    forget(signed, single)
    _free(spark)

    # Each set with the hub that shares most of its signatures.
    votes = shared.where("first != id").groupBy("id", "first").agg(F.sum("weight").alias("k"))
    tried = stash(votes.groupBy("id").agg(F.max(F.struct(F.col("k"), -F.col("first"))).alias("x")).select((-F.col("x.col2")).alias("a"), F.col("id").alias("b")), "star")
    links = verify(tried, docs)
    labels = components(links)
    _free(spark)

    # The sets of one cluster have a signature in common with its smallest: all groups with that smallest id.
    left = stash(_open_clusters(shared.withColumnRenamed("first", "key"), labels), "clusters")
    small = left.where(F.col("size") <= LARGE).drop("size")
    large = left.where(F.col("size") > LARGE).drop("size")
    if large.limit(1).count():
        small = small.union(_open_clusters(_cut_again(large, docs, 1)).drop("size"))
    links = stash(links.union(compare_clusters(small, docs)), "links")
    _free(spark)
    labels = stash(components(links).select(F.col("id").alias("rep"), F.col("label").alias("component")), "components")
    return _membership(members, labels)


def _membership(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's component: that of the smallest document with an equal set. A hot set's rows are salted."""
    named = members.where("n > 0 and doc_id is not null")
    groups = named.groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("k"))
    groups = stash(groups.join(labels, "rep", "left").select("fp1", "fp2", "n", F.coalesce("component", "rep").alias("component"), "k", (F.col("component").isNotNull()).alias("linked")), "set-groups")
    groups = stash(groups.where("k > 1 or linked"), "joined-groups")
    # Most rows are in no such group; they are told apart without a shuffle.
    near, _ = split_by_keys(members.where("n > 0 and doc_id is not null"), groups, ["fp1", "fp2", "n"])
    groups = groups.withColumn("salt", F.explode(F.when(F.col("k") > 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))))
    both = near.withColumn("salt", F.explode(F.array(F.lit(-1), F.pmod(F.hash("doc_id"), F.lit(SALTS)))))
    found = both.join(groups.select("fp1", "fp2", "n", "salt", "component").hint("merge"), ["fp1", "fp2", "n", "salt"])
    found = stash(found.groupBy("doc_id").agg(F.min("component").alias("component")), "found-components")
    rest = members.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    near, far = split_by_keys(rest, found.select(F.col("doc_id").alias("key")), ["key"])
    near = near.join(found.withColumnRenamed("doc_id", "key").hint("merge"), "key", "left").select("doc_id", "n", "component")
    every = near.unionByName(far.select("doc_id", "n", F.lit(None).cast("long").alias("component")))
    return every.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op4_query(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
