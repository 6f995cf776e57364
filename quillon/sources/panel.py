"""Panels: one row for every day of a calendar and every code, missing cells null."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from quillon.functions.texts import normalized_code, to_day
from quillon.sources.store import place

EPOCH = "1995-01-02"
NUMBERS = ("c", "o", "h", "l", "vol", "amt", "vwap", "cap", "limit")
FLAGS = ("st", "delisting")
COLUMNS = ("t", "day", "code", *NUMBERS, *FLAGS, "industry")
#: Compressed bytes of lines a task, some 450,000 lines.
BYTES_A_TASK = 8 * 2**20


def numbered_days(cells: DataFrame) -> DataFrame:
    """(t, day): the days that occur, numbered from 0 without gaps. One small row a day, whatever the number of codes."""
    days = cells.select("day").distinct()
    return days.select((F.row_number().over(W.partitionBy(F.lit(1)).orderBy("day")) - 1).cast("int").alias("t"), "day")


def densify(cells: DataFrame) -> DataFrame:
    """Every day that occurs with every code that occurs; cells that are missing get null numbers and false flags.

    The calendar has one row a day and is broadcast; the result is distributed by code. t counts days that occur, so
    windows of rows and lags never see a gap.
    """
    codes = cells.select("code").distinct()
    grid = codes.join(F.broadcast(numbered_days(cells)), F.lit(True), "cross")
    dense = grid.join(cells.drop("t"), ["day", "code"], "left")
    return dense.withColumns({f: F.coalesce(f, F.lit(False)) for f in FLAGS if f in cells.columns}).select(*[c for c in COLUMNS if c == "t" or c in cells.columns])


def tasks_for(spark: SparkSession, path: str) -> int:
    """Tasks over which a table is dealt: one for BYTES_A_TASK of its files, so that none holds more when it grows."""
    fs, p = place(spark, path)
    return max(spark.sparkContext.defaultParallelism, -(-fs.getContentSummary(p).getLength() // BYTES_A_TASK))


def weekly_panel(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """A panel with suppliers as codes and weeks as days, from the lineitem, supplier and nation tables.

    Lines go to their code's task once, beside an empty one for every code and day, and are summed there: cells, missing
    cells and all windows over a code follow without another shuffle. Supplier keys have six figures at most, as codes do.
    """
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 0").select(
        F.floor(F.datediff("l_shipdate", F.lit(EPOCH).cast("date")) / 7).cast("int").alias("week"),
        normalized_code(F.col("l_suppkey")).alias("code"),
        "l_suppkey", "l_quantity", "l_extendedprice",
        ((F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.08)).alias("st"),
        ((F.col("l_linestatus") == "F") & (F.col("l_tax") == 0) & (F.col("l_discount") == 0)).alias("delisting"),
        F.lit(True).alias("line"),
    )
    weeks = lines.select("week").distinct().withColumn("t", (F.row_number().over(W.partitionBy(F.lit(1)).orderBy("week")) - 1).cast("int"))
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    suppliers = suppliers.select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal", F.when(F.col("s_nationkey") % 11 != 0, F.col("n_regionkey").cast("string")).alias("industry"))
    # What is known of a supplier comes with its empty lines: suppliers meet codes, not lines or cells.
    empty = lines.select("code", "l_suppkey").distinct().join(suppliers, "l_suppkey", "left").join(F.broadcast(weeks), F.lit(True), "cross")
    rows = lines.where("week is not null and code is not null").unionByName(empty, allowMissingColumns=True).repartition(tasks_for(spark, f"{sf_dir}/lineitem.parquet"), "code")
    cells = rows.groupBy("week", "code", "l_suppkey").agg(
        F.max(price).alias("h"),
        F.min(price).alias("l"),
        (F.sum(price.cast("decimal(24,9)")).cast("double") / F.count("line")).alias("o"),
        money("l_quantity").alias("vol"),
        money("l_extendedprice").alias("amt"),
        F.coalesce(F.max("st"), F.lit(False)).alias("st"),
        F.coalesce(F.max("delisting"), F.lit(False)).alias("delisting"),
        (F.count("line") > 0).alias("there"),
        *[F.max(c).alias(c) for c in ("t", "s_acctbal", "industry")],
    )
    cells = cells.withColumn("c", F.col("amt") / F.col("vol"))
    panel = cells.select(
        "t",
        F.date_add(F.lit(EPOCH).cast("date"), F.col("week") * 7).alias("day"),
        "code", "c", "o", "h", "l", "vol", "amt",
        ((F.col("h") + F.col("l")) / 2).alias("vwap"),
        (F.col("s_acctbal") * F.col("c")).alias("cap"),
        F.when(F.col("there"), 0.1 * (F.col("l_suppkey") % 3 + 1)).alias("limit"),
        "st", "delisting",
        F.when(F.col("there"), F.col("industry")).alias("industry"),
    )
    return panel.select(*[c for c in COLUMNS if c in columns or c in ("t", "day", "code")])


def checked_codes(rows: DataFrame, column: str = "code") -> DataFrame:
    """rows with codes filled to six digits; codes of anything but one to six digits are an error."""
    if rows.where(F.col(column).isNull() | ~F.trim(F.col(column).cast("string")).rlike(r"^\d{1,6}$")).limit(1).count():
        raise ValueError(f"{column} must hold codes of one to six digits")
    return rows.withColumn(column, normalized_code(F.col(column)))


def duplicate_cells(cells: DataFrame) -> DataFrame:
    """Cells that occur more than once: none is what every source must have."""
    return cells.groupBy("day", "code").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique_cells(cells: DataFrame, what: str) -> DataFrame:
    if duplicate_cells(cells).limit(1).count():
        raise ValueError(f"{what} has more than one row for a day and code")
    return cells


def long_to_wide(rows: DataFrame, value: str) -> DataFrame:
    """(day, part, cells): rows of (day, code, value) in the wide form for any number of codes.

    A column for each code makes a plan that grows with the codes. Here a day has a row for each part, the codes that
    differ in their last three figures only, and cells maps them to their values, missing ones too. A code given twice
    on a day is an error.
    """
    part = F.expr("substring(code, 1, length(code) - 3)").alias("part")
    return rows.where("code is not null").groupBy("day", part).agg(F.map_from_entries(F.collect_list(F.struct("code", value))).alias("cells"))


def wide_to_long(wide: DataFrame, value: str = "values") -> DataFrame:
    """(day, code, value) from a table with a column for each code, or with a map cells (see long_to_wide)."""
    if "cells" in wide.columns and isinstance(wide.schema["cells"].dataType, MapType):
        return wide.select("day", F.explode("cells").alias("code", value))
    return wide.unpivot("day", [c for c in wide.columns if c != "day"], "code", value)


INDUSTRY_LONG = ("trade_date", "security_code", "industry_l1_code")


def industry_cells(frame: DataFrame, zone: str | None = None) -> DataFrame:
    """(day, code, industry) of a long table (trade_date, security_code, industry_l1_code) or of a wide one (see wide_to_long).

    Classifications hold for their own day only; blank ones are missing; a cell given twice is an error.
    """
    if set(INDUSTRY_LONG) <= set(frame.columns):
        rows = frame.select(F.col(INDUSTRY_LONG[0]).alias("day"), F.col(INDUSTRY_LONG[1]).cast("string").alias("code"), F.col(INDUSTRY_LONG[2]).cast("string").alias("industry"))
    else:
        plain = any(isinstance(f.dataType, MapType) for f in frame.schema.fields)
        texts = frame if plain else frame.select(*[F.col(f"`{c}`") if c == "day" else F.col(f"`{c}`").cast("string").alias(c) for c in frame.columns])
        rows = wide_to_long(texts, "industry").withColumn("industry", F.col("industry").cast("string"))
    rows = unique_cells(checked_codes(rows.withColumn("day", to_day(F.col("day"), zone))), "industry")
    return rows.withColumn("industry", F.trim("industry")).where("industry <> ''")


def read_panel(spark: SparkSession, files: dict[str, str], symbols: list[str]) -> DataFrame:
    """A panel from one parquet file for each symbol, long (day, code, values) or with a column for each code.

    Only the files of symbols, c and o are read. The days and codes of c are the panel's; other symbols are joined to
    them, flags absent mean false. Symbols without a file, codes that are none and cells given twice are errors.
    """
    wanted = list(dict.fromkeys(["c", "o", *symbols]))
    unknown = [s for s in wanted if s not in (*NUMBERS, *FLAGS, "industry") or s not in files]
    if unknown:
        raise ValueError(f"no file for {unknown}")

    def cells(s: str) -> DataFrame:
        kind = "boolean" if s in FLAGS else "string" if s == "industry" else "double"
        rows = spark.read.parquet(files[s])
        if s == "industry" and "values" not in rows.columns:
            return industry_cells(rows)
        rows = rows if "values" in rows.columns else wide_to_long(rows)
        rows = rows.select(to_day(F.col("day")).alias("day"), F.col("code").cast("string").alias("code"), F.col("values").cast(kind).alias(s))
        return unique_cells(checked_codes(rows), s)

    close = cells("c")
    panel = close.select("code").distinct().join(F.broadcast(numbered_days(close)), F.lit(True), "cross").join(close, ["day", "code"], "left")
    for s in wanted[1:]:
        panel = panel.join(cells(s), ["day", "code"], "left")
        if s in FLAGS:
            panel = panel.withColumn(s, F.coalesce(s, F.lit(False)))
    return panel


def write_panel(rows: DataFrame, path: str, codec: str = "zstd", kind: str = "parquet") -> None:
    """Write a table to a folder beside, which then takes the place of the old one, if there is one.

    A reader finds a first table whole or not at all. For one that is overwritten while others read, commits.Table has
    versions and no moment without one.
    """
    spark = rows.sparkSession
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex[:12]}"
    if kind == "csv":
        rows.write.csv(staged, header=True)
    else:
        rows.write.parquet(staged, compression=codec)
    p, jvm = path.rstrip("/"), spark.sparkContext._jvm
    here, new, old = (jvm.org.apache.hadoop.fs.Path(x) for x in (p, staged, f"{staged}-old"))
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = fs.exists(here)
    if there:
        fs.rename(here, old)
    if not fs.rename(new, here):
        if there:
            fs.rename(old, here)
        raise OSError(f"could not put {staged} in the place of {path}")
    if there:
        fs.delete(old, True)
