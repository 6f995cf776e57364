"""The questions that a service asks of its tables of runs, tags and holdings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.texts import normalized_tag, tag_key


def page(rows: DataFrame, keep: Column, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of the rows that keep holds for. The filter reaches the scan; only the page is brought together."""
    return rows.where(keep).orderBy(*order).offset(offset).limit(limit)


def holdings_page(held: DataFrame, day, names: DataFrame, industries: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of one day's holdings by position, with the code's name and the industry's: looked up for the page alone."""
    some = page(held, F.col("day") == F.lit(day).cast("date"), [F.col("position")], offset, limit)
    out = some.join(names.select("code", "name"), "code", "left")
    return out.join(industries.select("industry", "industry_name"), "industry", "left")


def tagged(tags: DataFrame, wanted: list[str], match: str = "all") -> DataFrame:
    """(factor) of (factor, tag) that have all, or any, of the wanted tags."""
    if match not in ("all", "any"):
        raise ValueError("match must be all or any")
    names = sorted({normalized_tag(w) for w in wanted} - {""})
    # The form of a tag is found once for each distinct tag, then joined back.
    forms = tags.select("tag").distinct().withColumn("_key", tag_key(F.col("tag"))).where(F.col("_key").isin(names))
    hits = tags.join(forms, "tag").groupBy("factor").agg(F.countDistinct("_key").alias("n"))
    return hits.where(F.col("n") >= (len(names) if match == "all" else 1)).select("factor")


ENDED = ("succeeded", "failed", "cancelled", "skipped")


def job_status(runs: DataFrame) -> DataFrame:
    """(job, n, n_ended, n_failed, status) of (job, status): running or queued while any run is, then failed, cancelled, succeeded."""
    n = lambda *s: F.sum(F.col("status").isin(*s).cast("long"))
    out = runs.groupBy("job").agg(F.count(F.lit(1)).alias("n"), n(*ENDED).alias("n_ended"), n("failed").alias("n_failed"), n("cancelled").alias("c"), n("running").alias("r"), n("queued").alias("q"))
    status = F.when(F.col("r") > 0, "running").when(F.col("q") > 0, "queued").when(F.col("n_failed") > 0, "failed").when(F.col("c") > 0, "cancelled").otherwise("succeeded")
    return out.select("job", "n", "n_ended", "n_failed", status.alias("status"))


def next_run(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """The queued run that comes first, of jobs that are queued or running: the oldest. Looks only; commits.Queue claims it."""
    open_jobs = jobs.where(F.col("status").isin("queued", "running")).select("job")
    return runs.where("status = 'queued'").join(open_jobs, "job", "left_semi").orderBy("created", "run").limit(1)


def compared(metrics: DataFrame, runs: list[str]) -> DataFrame:
    """(metric, one column for each run) of (run, metric, value)."""
    return metrics.where(F.col("run").isin(runs)).groupBy("metric").pivot("run", runs).agg(F.first("value"))


def cumulative_ic(daily: DataFrame) -> DataFrame:
    """(run, t, total) of (run, t, ic): running sums, for comparing runs."""
    return daily.select("run", "t", F.sum("ic").over(W.partitionBy("run").orderBy("t").rowsBetween(W.unboundedPreceding, 0)).alias("total"))


def timeline(panel: DataFrame) -> DataFrame:
    """The panel's days in order: reads one column."""
    return panel.select("day").distinct().orderBy("day")


def clipped_periods(periods: DataFrame, first, last) -> DataFrame:
    """Periods (name, start, stop) cut to the days from first to last; those outside go."""
    lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
    return periods.where((F.col("start") <= hi) & (F.col("stop") >= lo)).select("name", F.greatest("start", lo).alias("start"), F.least("stop", hi).alias("stop"))
