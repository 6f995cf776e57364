"""Texts, days and metric maps."""

from __future__ import annotations

import datetime
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What a code's first figures say about its board, and how a specially treated security's name begins.
GROWTH, NORTH = ("30", "68"), ("4", "8", "92")
SPECIAL_NAME = r"(?i)^(?:\*?ST|S)"


def normalized_code(code: Column) -> Column:
    """Codes are trimmed and filled to six digits."""
    return F.lpad(F.trim(code.cast("string")), 6, "0")


def starts_with(code: Column, firsts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for f in firsts:
        out = out | code.startswith(f)
    return out


def is_special_name(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike(SPECIAL_NAME)


def to_day(value: Column, zone: str | None = None) -> Column:
    """The day of a date, a text or a time; zone: where times of a known zone (as Spark stores them, in UTC) are read."""
    return (F.from_utc_timestamp(value, zone) if zone else value).cast("date")


def as_day(value: str | datetime.date | datetime.datetime, zone: str | None = None) -> datetime.date:
    """A boundary given by a caller as a day; a time with a zone is moved to zone first, one without is taken as it is."""
    if isinstance(value, str):
        value = datetime.datetime.fromisoformat(value.strip())
    if isinstance(value, datetime.datetime):
        if value.tzinfo is not None and zone is not None:
            from zoneinfo import ZoneInfo

            value = value.astimezone(ZoneInfo(zone))
        return value.date()
    if not isinstance(value, datetime.date):
        raise ValueError(f"not a day: {value!r}")
    return value


def normalized_tag(tag: str | None) -> str | None:
    """Tags are compared trimmed, in compatibility form and without case."""
    return None if tag is None else unicodedata.normalize("NFKC", tag).strip().casefold()


@F.pandas_udf(StringType())
def tag_key(tags: pd.Series) -> pd.Series:
    """normalized_tag of a column: Spark has no compatibility form. Meant for distinct tags, which are few."""
    return tags.map(normalized_tag, na_action="ignore")


def metric_map(columns: list[str]) -> Column:
    """The named columns of a row as one JSON text; missing and non-finite numbers are left out."""
    parts = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"))) for c in columns]
    kept = F.filter(F.array(*parts), lambda x: x.isNotNull() & ~x["v"].isin("NaN", "Infinity", "-Infinity"))
    return F.to_json(F.map_from_entries(kept))


def metric_of(text: Column, name: str) -> Column:
    """One number of a metric map."""
    return F.from_json(text, "map<string,string>")[name].cast("double")
