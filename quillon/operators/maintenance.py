"""Keeping panels and tables of results: merging increments, flags that carry forward, intervals, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.texts import GROWTH, NORTH, is_special_name, starts_with, to_day
from quillon.operators.intervals import interval_join
from quillon.sources import commits
from quillon.sources.panel import checked_codes, unique_cells, write_panel


def upsert(table: DataFrame, news: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of news in place of those of equal keys."""
    return table.join(news.select(*keys).distinct(), keys, "left_anti").unionByName(news, allowMissingColumns=True)


def limit_ratio(rows: DataFrame) -> DataFrame:
    """Adds ratio: by the first figures of the code; none in the first five traded days of a code listed after day 0."""
    code = F.col("code")
    base = F.when(starts_with(code, GROWTH), 0.2).when(starts_with(code, NORTH), 0.3).otherwise(0.1)
    traded = F.count("c").over(W.partitionBy("code").orderBy("t").rowsBetween(W.unboundedPreceding, 0))
    listed = F.min(F.when(F.col("c").isNotNull(), F.col("t"))).over(W.partitionBy("code"))
    new = (listed > F.lit(0)) & F.col("c").isNotNull() & (traded <= 5)
    return rows.withColumn("ratio", F.when(~F.coalesce(new, F.lit(False)), base))


def carried_status(observed: DataFrame, name: str = "status", value: str = "observed") -> DataFrame:
    """Adds the last observation of each code up to each day; false before the first."""
    so_far = W.partitionBy("code").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    return observed.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(so_far), F.lit(False)))


def special_from_limits(rows: DataFrame, change: str) -> DataFrame:
    """Adds observed: a day's limits of 3.5 to 6.5 percent on main-board codes mean special, 8.5 to 11.5 mean not.

    Holds for days before change; an event of the same day (event, a code 1 to 7) goes before what the limits say.
    """
    width = (F.col("limit_up") / F.col("pre_close") - 1) * 100
    main = ~starts_with(F.col("code"), (*GROWTH, "4", "8"))
    seen = F.when(main & (F.col("day") < F.lit(change).cast("date")) & width.between(3.5, 6.5), True).when(main & (F.col("day") < F.lit(change).cast("date")) & width.between(8.5, 11.5), False)
    return rows.withColumn("observed", F.when(F.col("event").isNotNull(), F.col("event") != 1).otherwise(seen))


def status_intervals(events: DataFrame, begin: int, end: int, cutoff: str) -> DataFrame:
    """(code, start, stop) from (code, state, start): from each begin event to the code's next end event, or to cutoff."""
    order = W.partitionBy("code").orderBy("start")
    rows = events.where(F.col("state").isin(begin, end)).withColumn("next", F.lead("start").over(order))
    return rows.where(F.col("state") == begin).select("code", "start", F.coalesce(F.date_sub("next", 1), F.lit(cutoff).cast("date")).alias("stop"))


def interval_days(intervals: DataFrame, calendar: DataFrame) -> DataFrame:
    """(day, code) for each calendar day in each interval, each once.

    Days and intervals meet in buckets (see interval_join): what is shuffled does not grow with the intervals' lengths.
    """
    found = interval_join(F.broadcast(calendar.select("day").distinct()), intervals.select("code", "start", "stop"), "day", "start", "stop")
    return found.select("day", "code").distinct()


def boundary_of(old: DataFrame, new: DataFrame, last_day=None) -> DataFrame:
    """(code, old_close, pre_close, adj): each code's last close before the increment, and what the increment's first day says of it."""
    old_close = old.where(F.col("c").isNotNull()).groupBy("code").agg(F.max_by("c", "day").alias("old_close"), F.max("day").alias("_last"))
    if last_day is not None:
        old_close = old_close.where(F.col("_last") <= F.lit(last_day).cast("date"))
    first = new.where(F.col("pre_close").isNotNull()).groupBy("code").agg(F.min_by(F.struct("pre_close", "adj"), "day").alias("x"))
    return old_close.join(first, "code").select("code", "old_close", F.col("x.pre_close").alias("pre_close"), F.coalesce("x.adj", F.lit(1.0)).alias("adj"))


def rebased_merge(old: DataFrame, new: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """old and new rows of (day, code, o, h, l, c, vol, amt); old prices are moved to the new base.

    boundary has (code, old_close, pre_close, adj): old prices are multiplied by pre_close * adj / old_close. Without it,
    it is taken from old and new, which then has pre_close and adj. New rows of suspended codes carry nulls; vwap is the
    middle of high and low, and the limit follows from the code. Days that both sides hold are an error.
    """
    overlap = new.select("day").distinct().join(old.select("day").distinct(), "day", "left_semi")
    if overlap.limit(1).count():
        raise ValueError("the increment overlaps days that are there already")
    boundary = boundary_of(old, new) if boundary is None else boundary
    new = new.drop("pre_close", "adj")
    ratio = F.when((F.col("old_close") != 0) & (F.col("pre_close") > 0), F.col("pre_close") * F.col("adj") / F.col("old_close"))
    moved = old.join(boundary.select("code", ratio.alias("_k")), "code", "left")
    moved = moved.withColumns({c: F.col(c) * F.coalesce("_k", F.lit(1.0)) for c in ("o", "h", "l", "c")}).drop("_k")
    priced = new.withColumns({c: F.when(~F.col("suspended"), F.col(c)) for c in ("o", "h", "l", "c")}).drop("suspended")
    return moved.unionByName(priced).withColumn("vwap", (F.col("h") + F.col("l")) / 2)


class RebasedPrices:
    """Prices in increments that are never written again, moved to the newest base when they are read.

    An increment's rows are added to a versioned table as they come; its boundary adds a step to the table of factors:
    from its first day on, older prices of a code are multiplied by the step. A scan joins each row with the product
    of all later steps of its code: a row belongs to the increment of its day, and products are one row a code and increment.
    """

    def __init__(self, spark: SparkSession, folder: str):
        folder = folder.rstrip("/")
        self.spark, self.prices, self.steps = spark, commits.Table(spark, f"{folder}/prices"), commits.Table(spark, f"{folder}/steps")

    def days(self) -> list:
        """The first day of each increment, in order."""
        found = self.prices.log.read()
        return found["first_days"] if found else []

    def add(self, new: DataFrame, boundary: DataFrame | None = None) -> int:
        """Add rows (day, code, o, h, l, c, vol, amt, suspended) of later days than all before. boundary: as for rebased_merge.

        Prices and their days are committed last: a scan of the version before does not see half of an increment.
        """
        on, days = self.prices.version(), self.days()
        ends = new.agg(F.min("day").cast("string").alias("lo"), F.max("day").cast("string").alias("hi")).first()
        if ends.lo is None:
            raise ValueError("the increment has no rows")
        if on:
            newest = self.prices.read(on).agg(F.max("day").cast("string")).first()[0]
            if ends.lo <= newest:
                raise ValueError("the increment overlaps days that are there already")
            boundary = boundary_of(self.scan(), new) if boundary is None else boundary
            ratio = F.when((F.col("old_close") != 0) & (F.col("pre_close") > 0), F.col("pre_close") * F.col("adj") / F.col("old_close"))
            self.steps.append(boundary.select("code", F.lit(len(days)).alias("increment"), ratio.alias("k")).where("k is not null"))
        rows = new.drop("pre_close", "adj")
        flag = F.coalesce("suspended", F.lit(False)) if "suspended" in rows.columns else F.lit(False)
        rows = rows.withColumns({c: F.when(~flag, F.col(c)) for c in ("o", "h", "l", "c")} | {"increment": F.lit(len(days))}).drop("suspended")
        data = self.prices._write(rows.repartitionByRange("code").sortWithinPartitions("code", "day"), "zstd")
        old = self.prices.log.read(on) if on else None
        return self.prices.log.commit({"folders": [*(old["folders"] if old else []), data], "first_days": [*days, ends.lo]}, on)

    def scan(self) -> DataFrame:
        """(day, code, o, h, l, c, vol, amt, vwap) of all increments on the newest base."""
        rows, known = self.prices.read(), len(self.days())
        if self.steps.version():
            # Steps of increments that were not committed are passed over. One row a code and increment.
            steps = self.steps.read().where(F.col("increment") < known).dropDuplicates(["code", "increment"])
            later = steps.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("increment", "k"))).alias("steps"))
            rows = rows.join(later, "code", "left")
            k = F.aggregate(F.coalesce("steps", F.expr("cast(array() as array<struct<increment:int,k:double>>)")), F.lit(1.0), lambda acc, s: F.when(s["increment"] > F.col("increment"), acc * s["k"]).otherwise(acc))
            rows = rows.withColumn("_k", k).withColumns({c: F.col(c) * F.col("_k") for c in ("o", "h", "l", "c")})
        return rows.select("day", "code", "o", "h", "l", "c", "vol", "amt", ((F.col("h") + F.col("l")) / 2).alias("vwap"))


def market_cap_cells(source: DataFrame, axes: DataFrame, zone: str | None = None) -> DataFrame:
    """(day, code, cap) for each cell of axes (day, code) from a long table (day, code, values).

    A cell given twice, and a value that is negative or infinite, are errors; cells outside axes go, cells without a value are missing.
    """
    rows = checked_codes(source.select(to_day(F.col("day"), zone).alias("day"), F.col("code").cast("string").alias("code"), F.col("values").cast("double").alias("cap")))
    unique_cells(rows, "market cap")
    rows = rows.withColumn("cap", F.when(~F.isnan("cap"), F.col("cap")))
    if rows.where((F.col("cap") < 0) | (F.abs("cap") == float("inf"))).limit(1).count():
        raise ValueError("market caps must be finite and not negative")
    return axes.select("day", "code").distinct().join(rows, ["day", "code"], "left")


def true_cells(source: DataFrame, flag: str, axes: DataFrame, zone: str | None = None) -> DataFrame:
    """(day, code, flag) of a table that may only hold true rows, each cell once, within the days and codes of axes."""
    missing = {"day", "code", flag} - set(source.columns)
    if missing:
        raise ValueError(f"no columns {sorted(missing)}")
    rows = checked_codes(source.select(to_day(F.col("day"), zone).alias("day"), F.col("code").cast("string").alias("code"), F.col(flag).cast("boolean").alias(flag)))
    if rows.where(F.col(flag).isNull() | ~F.col(flag)).limit(1).count():
        raise ValueError(f"{flag} may hold true rows only")
    unique_cells(rows, flag)
    for c in ("day", "code"):
        if rows.join(axes.select(c).distinct(), c, "left_anti").limit(1).count():
            raise ValueError(f"{flag} has a {c} that the panel does not have")
    return rows


def repaired_tail(history: DataFrame, market: DataFrame, names: DataFrame, change: str) -> DataFrame:
    """(day, code, status): true rows of history with the days of market (as for special_from_limits) judged anew.

    The state of each code is carried on from history's last day before market's. names (code, name) are those of the
    last day: a name that says special where the state does not is an error.
    """
    begin = market.agg(F.min("day").alias("_begin"))
    before = history.join(F.broadcast(begin), F.col("day") < F.col("_begin")).drop("_begin")
    edge = before.agg(F.max("day").alias("_edge"))
    seed = before.join(F.broadcast(edge), F.col("day") == F.col("_edge")).select("day", "code", F.lit(True).alias("observed"))
    rows = special_from_limits(market, change).select("day", "code", "observed")
    carried = carried_status(seed.unionByName(rows).withColumn("t", F.col("day")))
    new = carried.join(F.broadcast(begin), F.col("day") >= F.col("_begin")).drop("_begin", "t", "observed")
    last = new.agg(F.max("day").alias("_last"))
    wrong = new.join(F.broadcast(last), F.col("day") == F.col("_last")).where(~F.col("status")).join(names, "code").where(is_special_name(F.col("name")))
    found = [r.code for r in wrong.select("code").orderBy("code").limit(20).collect()]
    if found:
        raise ValueError(f"names say special where the state does not: {found}")
    return before.select("day", "code", F.lit(True).alias("status")).unionByName(new.where("status").select("day", "code", "status"))


def upsert_csv(news: DataFrame, path: str, keys: list[str]) -> None:
    """A table of results as CSV with header: rows of news take the place of those of equal keys, ordered by keys.

    Results are small, a row a factor, so one file holds them; the old one is read whole before the new takes its place.
    """
    spark = news.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        old = spark.read.csv(path, header=True)
        news = upsert(old, news.select(*[F.col(c).cast("string").alias(c) for c in news.columns]), keys)
    write_panel(news.orderBy(*keys).coalesce(1), path, kind="csv")


def unique_records(records: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Records without exact repeats; two values for one cell are an error."""
    out = records.dropDuplicates([*keys, value])
    if out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError("records disagree about a cell")
    return out


def same_axes(a: DataFrame, b: DataFrame, column: str) -> bool:
    """Whether two panels hold the same days or codes."""
    x, y = a.select(column).distinct(), b.select(column).distinct()
    return not x.exceptAll(y).unionAll(y.exceptAll(x)).limit(1).count()


def coverage(rows: DataFrame) -> DataFrame:
    """(industry, first_day, last_day, n_codes, n) of the cells of each industry."""
    return rows.where(F.col("industry").isNotNull() & F.col("c").isNotNull()).groupBy("industry").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.countDistinct("code").alias("n_codes"), F.count(F.lit(1)).alias("n"))


def holding_references(securities: DataFrame, aliases: DataFrame, industries: DataFrame) -> DataFrame:
    """(code, name, industry, industry_name): securities (code, name) with names from aliases (code, name) where they have none.

    A code given twice on either side is an error; industries (code, industry, industry_name) that are not known stay missing.
    """
    for frame, what in ((securities, "securities"), (aliases, "aliases"), (industries, "industries")):
        if frame.groupBy("code").count().where("count > 1").limit(1).count():
            raise ValueError(f"{what} name a code twice")
    out = securities.join(aliases.select("code", F.col("name").alias("_alias")), "code", "full")
    out = out.select("code", F.coalesce(F.when(F.trim("name") != "", F.trim("name")), F.trim("_alias")).alias("name"))
    return out.join(industries.select("code", "industry", "industry_name"), "code", "left")


def latest(rows: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """The last row of each key by order, ties by the larger tie."""
    at = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc(), F.col(tie).desc()))
    return rows.withColumn("_at", at).where("_at = 1").drop("_at")


def timing_report(runs: DataFrame) -> DataFrame:
    """(stage, runs, total, middle, p95, slowest) of (stage, seconds)."""
    return runs.groupBy("stage").agg(F.count(F.lit(1)).alias("runs"), F.sum("seconds").alias("total"), F.percentile("seconds", F.lit(0.5)).alias("middle"), F.percentile("seconds", F.lit(0.95)).alias("p95"), F.max("seconds").alias("slowest"))
