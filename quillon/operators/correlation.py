"""Correlation of factors that stand side by side in one table, and the library that admits by it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.rules import finite
from quillon.plans.expression import factors, parse, symbols_of
from quillon.sources import commits, store

THRESHOLD = 0.75
#: Pairs whose sums one pass over the table carries.
PAIRS_AT_ONCE = 250
#: What a sum of squares must exceed, as a share of what it was taken from, to count as spread.
FLAT = 1e-13
VERSION, METHOD = 1, "pooled_pearson"


def scaled(wide: DataFrame, names: list[str]) -> DataFrame:
    """names divided by their largest absolute value, so that squares of large scales do not overflow. One row of maxima."""
    top = wide.agg(*[F.max(F.abs(finite(F.col(c)))).alias(f"_s{i}") for i, c in enumerate(names)])
    rows = wide.join(F.broadcast(top), F.lit(True), "cross")
    return rows.select(*[c for c in wide.columns if c not in names], *[F.when(F.col(f"_s{i}") > 0, finite(F.col(c)) / F.col(f"_s{i}")).otherwise(finite(F.col(c))).alias(c) for i, c in enumerate(names)])


def pearson(wide: DataFrame, pairs: list[tuple[str, str]], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, f1, f2, n, rho) of pairs of columns, over the rows finite in both; rho is missing below 3 rows or without spread.

    One pass of partial sums for PAIRS_AT_ONCE pairs: nothing is joined or exploded, and only sums are shuffled.
    """
    names = sorted({c for p in pairs for c in p})
    rows = scaled(wide, names)
    out = None
    for at in range(0, len(pairs), PAIRS_AT_ONCE):
        some = list(enumerate(pairs[at : at + PAIRS_AT_ONCE]))
        sums = []
        for i, (a, b) in some:
            ok = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = F.when(ok, F.col(a)), F.when(ok, F.col(b))
            sums += [F.count(x).alias(f"n{i}"), F.covar_pop(x, y).alias(f"c{i}"), F.stddev_pop(x).alias(f"x{i}"), F.stddev_pop(y).alias(f"y{i}")]
        found = [F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"n{i}").alias("n"), F.col(f"c{i}").alias("c"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i, (a, b) in some]
        part = rows.groupBy(*by).agg(*sums).select(*by, F.inline(F.array(*found)))
        ok = (F.col("n") >= 3) & (F.col("x") > 0) & (F.col("y") > 0)
        rho = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c") / (F.col("x") * F.col("y"))))
        part = part.select(*by, "f1", "f2", "n", F.when(ok, rho).alias("rho"))
        out = part if out is None else out.unionByName(part)
    return out


#: Factors of a tile, and rows of a batch that one product takes.
TILE, ROWS_AT_ONCE = 128, 4096
#: Tasks whose tiles one task sums at most, before the next sums theirs.
MERGED = 16


def gram(wide: DataFrame, names: list[str], by: str | None = None) -> DataFrame:
    """(by, f1, f2, n, rho) as pearson gives for all pairs of names, by products of whole tiles.

    With X the values (0 where missing) and M whether they are there, the sums of all pairs' common rows are entries of
    M'M, X'M, (X*X)'M and X'X. Each task adds these up from Arrow batches, tile by tile of TILE factors, and sends each
    pair of tiles once, and equal pairs are summed MERGED tasks at a time. So passes and products grow with pairs of tiles, not of factors.
    Columns are centred and scaled first, so that sums of squares lose no digits.
    by: an integer column; its values are kept apart.
    """
    names = sorted(names)
    ends = wide.agg(*[x for i, c in enumerate(names) for x in (F.avg(finite(F.col(c))).alias(f"m{i}"), F.max(F.abs(finite(F.col(c)))).alias(f"s{i}"))]).first()
    mean = np.array([ends[f"m{i}"] if ends[f"m{i}"] is not None and np.isfinite(ends[f"m{i}"]) else 0.0 for i in range(len(names))])
    scale = np.array([ends[f"s{i}"] or 1.0 for i in range(len(names))])
    tiles = [(at, min(at + TILE, len(names))) for at in range(0, len(names), TILE)]
    pairs = [(i, j) for i in range(len(tiles)) for j in range(i, len(tiles))]
    rows = wide.select(F.col(by).cast("int").alias("_by") if by else F.lit(0).alias("_by"), *[finite(F.col(c)).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    if by:
        rows = rows.repartition("_by").sortWithinPartitions("_by")

    def added(sums: dict, x: np.ndarray) -> None:
        m = np.isfinite(x)
        x = np.where(m, x / scale - mean / scale, 0.0)
        m = m.astype(float)
        for i, j in pairs:
            a, b = slice(*tiles[i]), slice(*tiles[j])
            xa, xb, ma, mb = x[:, a], x[:, b], m[:, a], m[:, b]
            found = np.stack([ma.T @ mb, xa.T @ mb, ma.T @ xb, (xa * xa).T @ mb, ma.T @ (xb * xb), xa.T @ xb])
            sums[i, j] = sums[i, j] + found if (i, j) in sums else found

    def sent(key: int, sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key] * len(sums), pa.int32()), pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["_by", "i", "j", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, key = {}, None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            for first, last in zip(cuts[:-1], cuts[1:]):
                if first == last:
                    continue
                if key is not None and keys[first] != key:
                    yield sent(key, sums)
                    sums = {}
                key = int(keys[first])
                for at in range(first, last, ROWS_AT_ONCE):
                    part = batch.slice(at, min(ROWS_AT_ONCE, last - at))
                    added(sums, np.stack([part.column(k + 1).to_numpy(zero_copy_only=False).astype(float) for k in range(len(names))], axis=1))
        if key is not None:
            yield sent(key, sums)

    def merged(table: pa.Table) -> pa.Table:
        total = None
        for v in table.column("sums"):
            one = np.frombuffer(v.as_buffer())
            total = one.copy() if total is None else total + one
        return pa.table({"_by": table.column("_by")[:1], "i": table.column("i")[:1], "j": table.column("j")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    def correlations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, i, j, v in zip(*(batch.column(k).to_pylist() for k in range(4))):
                (a, a_end), (b, b_end) = tiles[i], tiles[j]
                n, sa, sb, saa, sbb, sab = np.frombuffer(v).reshape(6, a_end - a, b_end - b)
                left, right = np.meshgrid(np.arange(a, a_end), np.arange(b, b_end), indexing="ij")
                keep = (left < right) & (n > 0)
                count = np.maximum(n, 1)
                va, vb, cov = saa - sa * sa / count, sbb - sb * sb / count, sab - sa * sb / count
                # Below what rounding leaves of a constant, there is no spread.
                ok = (n >= 3) & (va > FLAT * np.maximum(saa, FLAT)) & (vb > FLAT * np.maximum(sbb, FLAT))
                rho = np.clip(cov / np.sqrt(np.where(ok, va * vb, 1.0)), -1, 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(keep.sum(), key), pa.int32()), pa.array([names[k] for k in left[keep]], pa.string()), pa.array([names[k] for k in right[keep]], pa.string()), pa.array(n[keep].astype(np.int64)), pa.array(rho[keep], pa.float64(), mask=~ok[keep])], ["_by", "f1", "f2", "n", "rho"])

    kind = "_by int, i int, j int, sums binary"
    sums = rows.mapInArrow(run, kind)
    if not by:
        # A pair's tiles come from every task.
        sums = sums.withColumn("_some", F.floor(F.spark_partition_id() / MERGED)).groupBy("_by", "i", "j", "_some").applyInArrow(merged, kind)
    sums = sums.groupBy("_by", "i", "j").applyInArrow(merged, kind)
    out = sums.mapInArrow(correlations, "_by int, f1 string, f2 string, n long, rho double")
    return out.withColumnRenamed("_by", by) if by else out.drop("_by")


def matrix(wide: DataFrame, names: list[str]) -> DataFrame:
    """The correlations of all pairs of names: partial sums in one pass while they are few, else products of tiles."""
    if len(names) * (len(names) - 1) // 2 > PAIRS_AT_ONCE:
        return gram(wide, names)
    return pearson(wide, list(combinations(sorted(names), 2)))


def with_row(known: DataFrame, wide: DataFrame, names: list[str], candidate: str) -> DataFrame:
    """A matrix with the candidate's row added: only its own pairs are computed."""
    row = pearson(wide, [tuple(sorted((candidate, n))) for n in names if n != candidate])
    return known.where((F.col("f1") != candidate) & (F.col("f2") != candidate)).unionByName(row)


def block_matrix(wide: DataFrame, names: list[str], size: int = 60) -> DataFrame:
    """(f1, f2, block, n, rho) over full blocks of size days; the tail goes."""
    days = wide.select("t").distinct().withColumn("block", F.floor((F.row_number().over(W.partitionBy(F.lit(1)).orderBy("t")) - 1) / size).cast("int"))
    days = days.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("block"))).where(F.col("_n") == size).select("t", "block")
    rows = wide.join(F.broadcast(days), "t")
    if len(names) * (len(names) - 1) // 2 > PAIRS_AT_ONCE:
        return gram(rows, names, "block").where("rho is not null")
    return pearson(rows, list(combinations(sorted(names), 2)), ("block",)).where("rho is not null")


def exposures(panel: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """(t, code) with a column for each expression."""
    return factors(panel, expressions, shared=False).select("t", "code", *expressions)


def as_wide(long: DataFrame, names: list[str]) -> DataFrame:
    """(t, code) with a column for each of names, from (factor_id, t, code, x)."""
    return long.groupBy("t", "code").pivot("factor_id", names).agg(F.first("x"))


def violations(found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return found.where(F.abs("rho") >= threshold)


def expression_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def described(spark, factors: dict[str, str], files: dict[str, str]) -> dict:
    """What a stored matrix depends on: the expressions, and the files of the symbols they read (c with each)."""
    return {
        "version": VERSION,
        "method": METHOD,
        "factors": [{"name": n, "hash": expression_hash(x), "data": store.signature(spark, [files[s] for s in sorted({*symbols_of(x), "c"})])} for n, x in sorted(factors.items())],
    }


@dataclass(frozen=True)
class Admission:
    admitted: bool
    already_present: bool
    violations: tuple[tuple[str, float], ...] = ()


class StoredLibrary:
    """Admitted factors in a folder, and the matrix of their correlations with what it was computed from.

    The registry is a versioned state: of two callers that admit at once, the slower one judges its factor again, beside
    the other's. The matrix is a versioned table whose notes say what it holds.
    """

    def __init__(self, spark, folder: str, threshold: float = THRESHOLD):
        self.spark, self.folder, self.threshold = spark, folder.rstrip("/"), threshold
        self.registry = commits.State(spark, f"{self.folder}/registry", {"schema_version": 1, "batch_version": 0, "factors": []})
        self.table = commits.Table(spark, f"{self.folder}/matrix")

    @staticmethod
    def _named(registry: dict) -> dict[str, str]:
        return {x["factor_name"]: x["expression"] for x in registry["factors"]}

    def factors(self) -> dict[str, str]:
        return self._named(self.registry.get())

    def valid(self, files: dict[str, str]) -> bool:
        """Whether the stored matrix is that of these factors and of these files as they are now."""
        kept, found = self.factors(), self.table.log.read()
        return bool(kept) and found is not None and found["described"] == described(self.spark, kept, files)

    def matrix(self, panel: DataFrame, files: dict[str, str]) -> DataFrame:
        """The stored matrix, computed again if it is not valid."""
        return self._matrix(self.factors(), panel, files)

    def _matrix(self, kept: dict[str, str], panel: DataFrame, files: dict[str, str]) -> DataFrame:
        wanted, found = described(self.spark, kept, files), self.table.log.read()
        if found is None or found["described"] != wanted:
            new = matrix(exposures(panel, kept), list(kept)) if len(kept) > 1 else self.spark.createDataFrame([], "f1 string, f2 string, n long, rho double")
            return self.table.read(self.table.replace(new, described=wanted))
        return self.table.read()

    def admit(self, name: str, expression: str, panel: DataFrame, files: dict[str, str], **notes) -> Admission:
        """Admit a factor unless it is too like a member: only its own row is computed; registry first, then the matrix.

        The same name and expression again change nothing; the same name with another expression is an error, and so is
        a factor whose correlation with a member is not defined.
        """
        name, expression = name.strip(), expression.strip()
        if not name:
            raise ValueError("a factor needs a name")
        parse(expression)
        outcome: dict = {}

        def step(registry: dict) -> dict | None:
            kept = self._named(registry)
            outcome.clear()
            if name in kept:
                if kept[name] != expression:
                    raise ValueError(f"{name} is there with another expression")
                outcome["admission"] = Admission(False, True)
                return None
            row = [r.asDict() for r in pearson(exposures(panel, kept | {name: expression}), [tuple(sorted((name, k))) for k in sorted(kept)]).collect()] if kept else []
            if any(r["rho"] is None for r in row):
                raise ValueError(f"{name} is constant or shares fewer than three cells with a member")
            close = tuple(sorted((r["f2"] if r["f1"] == name else r["f1"], r["rho"]) for r in row if abs(r["rho"]) >= self.threshold))
            if close:
                outcome["admission"] = Admission(False, False, close)
                return None
            number = max((x["number"] for x in registry["factors"]), default=0) + 1
            registry["factors"].append({"number": number, "factor_name": name, "expression": expression, "required_symbols": symbols_of(expression), **notes})
            outcome.update(admission=Admission(True, False), kept=kept, row=row)
            return registry | {"factor_count": len(registry["factors"]), "batch_version": registry["batch_version"] + 1}

        self.registry.update(step)
        if outcome["admission"].admitted:
            known = self._matrix(outcome["kept"], panel, files) if outcome["kept"] else self.spark.createDataFrame([], "f1 string, f2 string, n long, rho double")
            row = self.spark.createDataFrame([(r["f1"], r["f2"], r["n"], r["rho"]) for r in outcome["row"]], "f1 string, f2 string, n long, rho double")
            self.table.replace(known.unionByName(row), described=described(self.spark, outcome["kept"] | {name: expression}, files))
        return outcome["admission"]
