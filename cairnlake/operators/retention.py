"""Which snapshots a retention policy keeps: the newest ones, and the newest of each of the latest calendar periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Start of the calendar period of a time; weeks are ISO weeks.
PERIODS = {"daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}


def keep_last(snapshots: DataFrame, n: int, ts: str = "ts", name: str = "name") -> DataFrame:
    """The newest n by (ts, name); a negative n keeps all."""
    return snapshots.select(ts, name) if n < 0 else snapshots.select(ts, name).orderBy(F.desc(ts), F.desc(name)).limit(n)


def keep_period(snapshots: DataFrame, unit: str, n: int, ts: str = "ts", name: str = "name") -> DataFrame:
    """The newest of each of the latest n periods. Periods are aggregated first, so only their maxima are sorted."""
    newest = snapshots.groupBy(F.date_trunc(unit, ts).alias("period")).agg(F.max(F.struct(ts, name)).alias("top"))
    newest = newest if n < 0 else newest.orderBy(F.desc("period")).limit(n)
    return newest.select("top.*")


def retain(snapshots: DataFrame, last: int = 0, daily: int = 0, weekly: int = 0, monthly: int = 0, yearly: int = 0, ts: str = "ts", name: str = "name") -> DataFrame:
    """snapshots with a boolean `keep`: the union of all policies given."""
    kept = keep_last(snapshots, last, ts, name)
    for policy, n in (("daily", daily), ("weekly", weekly), ("monthly", monthly), ("yearly", yearly)):
        if n:
            kept = kept.unionByName(keep_period(snapshots, PERIODS[policy], n, ts, name))
    return snapshots.join(kept.distinct().withColumn("_kept", F.lit(True)), [ts, name], "left").withColumn("keep", F.coalesce("_kept", F.lit(False))).drop("_kept")


def iso_week(ts: Column) -> Column:
    """Year of the ISO week and its number, as in 202053."""
    return F.extract(F.lit("YEAROFWEEK"), ts) * 100 + F.weekofyear(ts)
