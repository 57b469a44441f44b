"""Mergeable sketches kept per day: quantiles, distinct members and their overlaps for any range of days.

A day's rows are read once, when the day is stored; reports over any days merge the stored sketches and touch no
row again. The exact reports (`profile`, `upkeep`) stay for whoever needs the last digit.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KLL_K = 400  # entries of a quantile sketch at its top level
LG_HLL = 14  # base-2 logarithm of the registers of a distinct count
LG_THETA = 14  # base-2 logarithm of the sampled members of a set sketch


def rank_error(k: int = KLL_K) -> float:
    """Rank error that a quantile of a KLL sketch with `k` entries keeps to in 99 of 100 cases."""
    return 2.446 / k ** 0.9433


def distinct_error(lg: int = LG_HLL, deviations: float = 3.0) -> float:
    """Relative error of an HLL estimate at so many standard deviations."""
    return deviations * 1.04 / math.sqrt(2 ** lg)


def set_error(lg: int = LG_THETA, deviations: float = 3.0) -> float:
    """Error of a theta estimate as a share of the union, at so many standard deviations."""
    return deviations / math.sqrt(2 ** lg - 1)


def sketch_days(log: DataFrame, event_time: str, keys: Sequence[str], value: str, member: str) -> DataFrame:
    """One row per day and key: rows (n) and sketches of the values (kll) and of the members (hll, theta).

    Tasks combine sketches of fixed size before the shuffle, so a hot key costs no more than any other. Null values and
    members are left out of the sketches and counted in n; rows without a time belong to no day.
    """
    rows = log.where(F.col(event_time).isNotNull())
    return rows.groupBy(F.to_date(event_time).alias("day"), *keys).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("kll"),
        F.hll_sketch_agg(F.col(member).cast("string"), LG_HLL).alias("hll"), F.theta_sketch_agg(F.col(member).cast("string"), LG_THETA).alias("theta"))


def rows_of_days(log: DataFrame, event_time: str, days: Sequence[dt.date]) -> DataFrame:
    """Rows of some days, by bounds on the time that reach the scan; a column `day` of the log prunes its folders too."""
    wanted = F.lit(False)
    for d in days:
        wanted = wanted | ((F.col(event_time) >= F.lit(dt.datetime.combine(d, dt.time()))) & (F.col(event_time) < F.lit(dt.datetime.combine(d + dt.timedelta(1), dt.time()))))
    rows = log.where(wanted)
    return rows.where(F.col("day").isin(list(days))) if "day" in log.columns else rows


def store_days(log: DataFrame, path: str, event_time: str, keys: Sequence[str], value: str, member: str, days: Sequence[dt.date] | None = None) -> None:
    """Write the sketches of the given days (None: of all), replacing those days alone; a repeated run gives the same rows."""
    rows = log if days is None else rows_of_days(log, event_time, days).drop("day")
    (sketch_days(rows, event_time, keys, value, member).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day").parquet(path))


def stored_days(spark: SparkSession, path: str, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """Stored sketches of a range of days, both ends included; folders of other days are not read."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where(F.col("day") >= F.lit(first))
    return df if last is None else df.where(F.col("day") <= F.lit(last))


def merge_days(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key over all given days, with the columns of `sketch_days`."""
    return days.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("kll").alias("kll"),
                                   F.hll_union_agg("hll", True).alias("hll"), F.theta_union_agg("theta", LG_THETA).alias("theta"))


def quantile(q: float) -> Column:
    return F.kll_sketch_get_quantile_double("kll", F.lit(q))


def members() -> Column:
    return F.hll_sketch_estimate("hll")


def shared_members(a: str, b: str) -> Column:
    """Members that two theta columns have in common."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))
