"""Frequency codes: resolution and period lookup, for plain strings and for columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelith.constants import ANCHORED, FREQ_TO_PERIOD, FREQ_TO_PERIODS, MOST_PERIODS, SEASONS

#: Seconds between rows, by base frequency; of business days, months, quarters and years the mean or a round number, since it only sizes buckets.
SECONDS = {"S": 1, "T": 60, "H": 3600, "D": 86400, "B": 86400, "W": 604800, "M": 2629800, "Q": 7889400, "A": 31557600, "Y": 31557600}
#: Frequency codes that a panel may have at most: their dimension is collected and broadcast.
MOST_CODES = 10_000


def resolve_freq(freq: str) -> str:
    """The table's code for a pandas-style frequency: upper case, MIN as T, no anchor, one-letter period ends."""
    code = freq.upper().replace("MIN", "T").partition("-")[0]
    hit = next((s for s in ANCHORED if code.endswith(s)), None)
    return code[: -len(hit)] + hit[0] if hit else code


def _lookup(code: str, entries: dict, default):
    """The entry of the code, or of the longest key that it ends in."""
    keys = [k for k in entries if code.endswith(k)]
    return entries[max(keys, key=len)] if keys else default


def period_of(freq: str) -> int:
    return _lookup(resolve_freq(freq), FREQ_TO_PERIOD, 1)


def periods_of(freq: str) -> list[int]:
    return list(_lookup(resolve_freq(freq), FREQ_TO_PERIODS, []))


def season_of(freq: str) -> int:
    """The season by which evaluations scale errors: that of the base frequency, divided by its multiple; 1 if that doesn't divide it."""
    code = resolve_freq(freq)
    digits = code[: len(code) - len(code.lstrip("0123456789"))]
    season, many = _lookup(code, SEASONS, 1), int(digits or 1) or 1
    return season // many if season % many == 0 else 1


def reach_of(freq: str) -> int:
    """Rows of the longest period that counts, times the most periods: what a forecast of this frequency looks back at most."""
    return MOST_PERIODS * max([1, period_of(freq), *periods_of(freq)])


def seconds_of(freq: str) -> int:
    """Seconds between two rows; 1 for unknown codes."""
    code = resolve_freq(freq)
    digits = code[: len(code) - len(code.lstrip("0123456789"))]
    return _lookup(code, SECONDS, 1) * (int(digits or 1) or 1)


def dimension(codes: DataFrame, default: str = "") -> DataFrame:
    """(freq, period, periods, season, reach, seconds) of the codes in the first column of a table, with a row for null, which stands for the default.

    The codes are collected, MOST_CODES at most (more are an error), so that the dimension is small whatever the panel's size.
    """
    found = [r[0] for r in codes.distinct().limit(MOST_CODES + 1).collect()]
    if len(found) > MOST_CODES:
        raise ValueError(f"more than {MOST_CODES} frequency codes")
    rows = []
    for code in {*found, None}:
        own = default if code is None else code
        rows.append((code, period_of(own), periods_of(own), season_of(own), reach_of(own), seconds_of(own)))
    return codes.sparkSession.createDataFrame(rows, "freq string, period int, periods array<int>, season int, reach long, seconds long")


def with_dimension(rows: DataFrame, freq: str, default: str = "") -> DataFrame:
    """rows with _reach and _seconds of their codes."""
    small = dimension(rows.select(F.col(freq)), default).select(F.col("freq").alias("_code"), F.col("reach").alias("_reach"), F.col("seconds").alias("_seconds"))
    return rows.join(F.broadcast(small), F.col(freq).eqNullSafe(F.col("_code")), "left").drop("_code")


def resolved(freq: Column) -> Column:
    """resolve_freq of a column."""
    code = F.split_part(F.replace(F.upper(freq), F.lit("MIN"), F.lit("T")), F.lit("-"), F.lit(1))
    out = code
    for s in reversed(ANCHORED):
        out = F.when(code.endswith(s), F.concat(F.substring(code, F.lit(1), F.length(code) - 2), F.lit(s[0]))).otherwise(out)
    return out


def _looked_up(code: Column, entries: dict, value, default: Column) -> Column:
    out = default
    for k in sorted(entries, key=len):
        out = F.when(code.endswith(k), value(entries[k])).otherwise(out)
    return out


def period_column(freq: Column) -> Column:
    return _looked_up(resolved(freq), FREQ_TO_PERIOD, lambda p: F.lit(p), F.lit(1))


def periods_column(freq: Column) -> Column:
    ints = lambda v: F.array(*map(F.lit, v)).cast("array<int>")
    return _looked_up(resolved(freq), FREQ_TO_PERIODS, ints, ints([]))


def season_column(freq: Column) -> Column:
    """season_of a column."""
    code = resolved(freq)
    many = F.greatest(F.coalesce(F.regexp_extract(code, "^([0-9]+)", 1).try_cast("int"), F.lit(1)), F.lit(1))
    season = _looked_up(code, SEASONS, lambda v: F.lit(v), F.lit(1))
    return F.when(season % many == 0, F.floor(season / many).cast("int")).otherwise(1)


def inferred(rows: DataFrame, series: str = "series_id", ts: str = "ts") -> DataFrame:
    """(series, gap, freq): the least gap between different times of a series, in seconds, and the code that it stands for.

    Gaps of seconds, minutes and hours give '10S', 'T', '15T', '2H' and so on, of days 'D', '2D'; weeks have the day that they are labelled by ('W-SUN'); months, quarters and years say whether their
    times are all first or last days ('MS', 'ME', 'QS-OCT', 'QE-DEC', 'YS', 'YE'; else 'M', 'Q', 'Y'). Null for series with under two times. Only distinct times are shuffled.
    """
    w = Window.partitionBy(series).orderBy(ts)
    times = rows.select(series, F.col(ts).cast("timestamp_ntz").alias(ts)).filter(F.col(ts).isNotNull()).distinct()
    second = lambda c: F.unix_seconds(c.cast("timestamp"))
    times = times.withColumn("_gap", second(F.col(ts)) - second(F.lag(ts).over(w)))
    day = F.to_date(F.col(ts))
    facts = times.groupBy(series).agg(F.min("_gap").alias("gap"), F.bool_and(F.dayofmonth(day) == 1).alias("_first"), F.bool_and(day == F.last_day(day)).alias("_last"), F.min(F.date_format(ts, "EEE")).alias("_day"), F.max(F.struct(F.col(ts), F.date_format(ts, "MMM").alias("m")))["m"].alias("_month"))
    gap, days = F.col("gap"), F.floor(F.col("gap") / 86400)
    many = lambda unit, code: F.concat(F.when(gap > unit, (F.floor(gap / unit)).cast("string")).otherwise(""), F.lit(code))
    ends = lambda code: F.when(F.col("_first"), f"{code}S").when(F.col("_last"), f"{code}E").otherwise(code)
    month = F.upper("_month")
    code = (
        F.when(days.between(364, 366), ends("Y")).when(days.between(89, 92), F.concat(ends("Q"), F.lit("-"), month)).when(days.between(28, 31), ends("M"))
        .when(gap == 604800, F.concat(F.lit("W-"), F.upper("_day"))).when(gap % 86400 == 0, many(86400, "D")).when(gap % 3600 == 0, many(3600, "H")).when(gap % 60 == 0, many(60, "T")).otherwise(many(1, "S"))
    )
    return facts.select(series, "gap", F.when(gap.isNotNull(), code).alias("freq"))
