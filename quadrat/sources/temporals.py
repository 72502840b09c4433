"""Numbers to dates and times by the formats of the statistical packages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days from 1970-01-01 back to the epochs: SAS and Stata 1960-01-01, SPSS 1582-10-14.
DAYS_1960, DAYS_1582 = 3653, 141_428

SAS_DATES = ("DATE", "DDMMYY", "MMDDYY", "YYMMDD", "E8601DA", "B8601DA", "WEEKDATE", "MONYY", "JULIAN", "WORDDATE", "YYMON")
SAS_STAMPS = ("DATETIME", "E8601DT", "B8601DT", "DATEAMPM", "MDYAMPM")
SAS_TIMES = ("TIME", "HHMM", "HOUR", "MMSS", "E8601TM", "B8601TM", "TOD")
SPSS_DATES = ("DATE", "ADATE", "EDATE", "JDATE", "SDATE", "QYR", "MOYR", "WKYR")
SPSS_STAMPS = ("DATETIME", "YMDHMS")
SPSS_TIMES = ("TIME", "DTIME", "MTIME")


def _name(fmt: str | None) -> str:
    return re.sub(r"[\d.]+$", "", (fmt or "").upper())


def _stamp(seconds: Column) -> Column:
    return F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint"))


def _coerced(df: DataFrame, formats: dict[str, str], dates, stamps, times, date, stamp) -> DataFrame:
    out = {}
    for c, fmt in formats.items():
        if c not in df.columns or dict(df.dtypes)[c] not in ("double", "float", "int", "bigint"):
            continue
        n = _name(fmt)
        if n in stamps:
            out[c] = stamp(F.col(c))
        elif n in dates:
            out[c] = date(F.col(c))
        elif n in times:
            out[c] = F.col(c).cast("bigint")  # seconds of the day
    return df.withColumns(out) if out else df


def coerce_sas_temporals(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Days and seconds since 1960."""
    day = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c).cast("int") - DAYS_1960)
    return _coerced(df, formats, SAS_DATES, SAS_STAMPS, SAS_TIMES, day, lambda c: _stamp(c - DAYS_1960 * 86_400))


def coerce_stata_temporals(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """%td days and %tc milliseconds since 1960."""
    out = {}
    for c, fmt in formats.items():
        if c not in df.columns:
            continue
        if fmt.startswith(("%td", "%d")):
            out[c] = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c).cast("int") - DAYS_1960)
        elif fmt.startswith(("%tc", "%tC")):
            out[c] = _stamp(F.col(c) / 1000 - DAYS_1960 * 86_400)
    return df.withColumns(out) if out else df


def coerce_spss_temporals(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Seconds since the start of the Gregorian calendar."""
    day = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c / 86_400).cast("int") - DAYS_1582)
    return _coerced(df, formats, SPSS_DATES, SPSS_STAMPS, SPSS_TIMES, day, lambda c: _stamp(c - DAYS_1582 * 86_400.0))


def force_utc(df: DataFrame, columns=None, zone: str = "UTC") -> DataFrame:
    names = [c for c, t in df.dtypes if t.startswith("timestamp") and (columns is None or c in columns)]
    return df.withColumns({c: F.to_utc_timestamp(c, zone) for c in names}) if names else df


adjust_tz = force_utc
