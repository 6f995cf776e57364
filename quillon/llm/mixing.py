"""Mixing sources to target weights by budgets handed down a tree of domains, languages and sources.

A budget of tokens goes from the root to domains, from each domain to its languages and from each language to its
sources, in proportion to weights. What a node lacks (its tokens times the epochs allowed are less than its share) goes
to its siblings first; only what a whole subtree lacks goes to the siblings of its parent. Each leaf then gives a prefix
of its stream of tokens: seeded epochs, each a permutation of its documents of its own.

Tokens are words. Defined results: null texts have no tokens, null domains, languages and sources are leaves of their
own named "?", an empty table gives an empty result, equal rows count each. Shares are whole tokens, rounded down.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import WORD, stash, text_or_empty

LEVELS = ("domain", "lang", "source")
#: Weights by name at each level; names that are not listed weigh 1.
WEIGHTS = {"domain": {"web": 5, "books": 3, "reference": 2}, "lang": {"en": 6, "de": 2, "fr": 2}, "source": {}}
SEED, MAX_EPOCHS, BUDGET_PERCENT = 20240607, 2, 60
#: Leaves up to which their budgets are broadcast; beyond, rows and budgets meet by salts.
BROADCAST_LEAVES, SALTS = 100_000, 32


def domain_of(source: Column) -> Column:
    """The domain that a source belongs to, by the number at the end of its name."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(n == "", "?").when(n.cast("int") < 10, "web").when(n.cast("int") < 15, "books").otherwise("reference")


def domain_by(table: dict[str, str]) -> Callable[[Column], Column]:
    """A domain function for token_counts from a table of sources; those not in it are "?"."""
    listed = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair]) if table else None
    return lambda source: F.lit("?") if listed is None else F.coalesce(listed[F.coalesce(source, F.lit(""))], F.lit("?"))


def token_counts(docs: DataFrame, carry: list[str] | None = None, domain: Callable[[Column], Column] = domain_of) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens) of each document. domain: a source's domain (see domain_by)."""
    named = [F.coalesce(F.col(c), F.lit("?")).alias(c) for c in ("lang", "source")]
    return docs.select("doc_id", F.coalesce(domain(F.col("source")), F.lit("?")).alias("domain"), *named, F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("long").alias("n_tokens"), *(carry or []))


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def budgets(supply: DataFrame, budget: Column, weights: dict = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(domain, lang, source, supply, tokens) from (domain, lang, source, supply), a table of one row a leaf.

    At each node the children are sorted by capacity over weight. Those that cannot use their share of what is left are
    filled; the others share the rest by weight. All in whole numbers. Documents are summed up by leaf before this, and a
    task sorts the children of one node at most.
    """
    nodes = supply.withColumn("cap", F.col("supply") * max_epochs)
    # One row of sums.
    sums = nodes.agg(F.sum("supply").alias("all_tokens"), F.sum("cap").alias("all_cap"))
    nodes = nodes.join(F.broadcast(sums), F.lit(True), "cross").withColumn("given", F.least(budget, F.col("all_cap")).cast("long"))
    for k, level in enumerate(LEVELS):
        above, path = list(LEVELS[:k]), list(LEVELS[: k + 1])
        level_nodes = nodes.groupBy(*path).agg(F.sum("cap").alias("cap"), F.max("given").alias("given")).withColumn("w", _weight(level, weights))
        order = W.partitionBy(*(above or [F.lit(1)])).orderBy(F.col("cap") / F.col("w"), level)
        before = order.rowsBetween(W.unboundedPreceding, -1)
        whole = W.partitionBy(*(above or [F.lit(1)]))
        level_nodes = level_nodes.withColumn("left", F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        level_nodes = level_nodes.withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        full = F.col("cap") * F.col("w_left") <= F.col("left") * F.col("w")
        level_nodes = level_nodes.withColumn("full", full)
        level_nodes = level_nodes.withColumn("rest", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col(level), F.col("left").alias("left"), F.col("w_left").alias("w_left")))).over(whole))
        share = F.expr("case when full then cap else (rest.left * w) div rest.w_left end")
        got = level_nodes.select(*path, share.cast("long").alias("given"))
        nodes = nodes.drop("given").join(got, path)
    return nodes.select(*LEVELS, "supply", F.col("given").alias("tokens"))


def _with_budgets(counts: DataFrame, leaves: DataFrame) -> DataFrame:
    """counts with supply and tokens of each row's leaf. A leaf may hold a third of all rows, leaves may be many."""
    if leaves.count() <= BROADCAST_LEAVES:
        return counts.join(F.broadcast(leaves), list(LEVELS))
    salted = leaves.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return counts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [*LEVELS, "salt"]).drop("salt")


def select_prefix(counts: DataFrame, leaves: DataFrame, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """Rows (doc_id, leaf, epoch, start, n_tokens, take, carry): each leaf's prefix of its seeded epochs.

    start is the document's place in its epoch's stream. Places are summed within 65,536 ranges of the sort key, over the
    256 ranges of each wider one, and over the 256 wider ones, so no leaf is sorted or summed in one task.
    """
    rows = _with_budgets(counts, leaves.where("tokens > 0"))
    rows = rows.withColumn("epoch", F.explode(F.expr("sequence(0, cast((tokens - 1) div supply as int))")))
    rows = rows.withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")))))
    rows = rows.withColumn("range", F.substring("key", 1, 4))
    part = [*LEVELS, "epoch"]

    def summed(by: list[str], at: str) -> Column:
        return F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    ranges = rows.groupBy(*part, "range").agg(F.sum("n_tokens").alias("n")).withColumn("wide", F.substring("range", 1, 2))
    wide = ranges.groupBy(*part, "wide").agg(F.sum("n").alias("n")).withColumn("base", summed(part, "wide")).drop("n")
    ranges = ranges.withColumn("inside", summed([*part, "wide"], "range")).join(wide, [*part, "wide"])
    ranges = ranges.select(*part, "range", (F.col("base") + F.col("inside")).alias("base"))
    within = W.partitionBy(*part, "range").orderBy("key", "doc_id", "n_tokens", *(carry or [])).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(ranges, [*part, "range"]).withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    take = F.least(F.col("n_tokens"), F.col("tokens") - F.col("epoch") * F.col("supply") - F.col("start"))
    return rows.withColumn("take", take).where("take > 0").select("doc_id", *LEVELS, "epoch", "start", "n_tokens", "take", *(carry or []))


def mix(counts: DataFrame, budget_percent: int = BUDGET_PERCENT, weights: dict = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """select_prefix of budgets for a budget in percent of all tokens. counts is read twice: give it a stored table."""
    supply = counts.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply")).where("supply > 0")
    budget = F.expr(f"(all_tokens * {budget_percent}) div 100")
    return select_prefix(counts, stash(budgets(supply, budget, weights, max_epochs), "leaf-budgets"), seed, carry)


def op7_query(spark, sf_dir: str) -> DataFrame:
    return mix(stash(token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")), "token-counts"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1)), 1, n.cast("int")), "")
