"""How far a table's daily counts follow the seasonality that was declared for it."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seasonality import calendar_frame, to_date, weekly

WEIGHTS = {"density": 0.35, "weekly": 0.20, "events": 0.20, "trend": 0.15, "cross_table": 0.10}
LEAST_DENSITY, LEAST_WEEKLY, LEAST_OVERLAP = 0.7, 0.6, 0.6


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson's r; 0 where it isn't defined."""
    x, y = F.when(y.isNotNull(), x.cast("double")), F.when(x.isNotNull(), y.cast("double"))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))  # corr() itself raises on a constant
    return F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))


def daily_counts(df: DataFrame, anchor: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """day and n; with a range every day of it, days without rows at 0."""
    counts = df.where(F.col(f"`{anchor}`").isNotNull()).groupBy(F.col(f"`{anchor}`").cast("date").alias("day")).agg(F.count("*").alias("n"))
    if start is None or end is None:
        return counts
    days = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def date_span(df: DataFrame, anchor: str) -> DataFrame:
    """first and last day of a date column."""
    day = F.col(f"`{anchor}`").cast("date")
    return df.agg(F.min(day).alias("first"), F.max(day).alias("last"))


def weekday_means(daily: DataFrame) -> DataFrame:
    """weekday (Monday 1) and the mean count of its days."""
    return daily.groupBy((F.weekday("day") + 1).alias("weekday")).agg(F.avg("n").alias("mean_n"))


def trend_slope(daily: DataFrame) -> DataFrame:
    """slope of the counts over days since the first."""
    x = F.datediff("day", F.lit(dt.date(1970, 1, 1))).cast("double")
    return daily.agg(F.regr_slope(F.col("n").cast("double"), x).alias("slope"))


def event_ratio(daily: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """inside (mean of the window's days), median of all days, and their ratio."""
    within = F.col("day").between(F.lit(start), F.lit(end))
    out = daily.agg(F.avg(F.when(within, F.col("n"))).alias("inside"), F.median("n").alias("median"))
    return out.withColumn("ratio", F.coalesce(F.try_divide("inside", "median"), F.lit(0.0)))


def top_days(daily: DataFrame, k: int = 10) -> DataFrame:
    """The k days with most rows, ties to the earlier day."""
    return daily.orderBy(F.desc("n"), F.asc("day")).limit(k).select("day")


def top_day_overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """jaccard of two tables' k busiest days."""
    x, y = (top_days(d, k).withColumn(c, F.lit(1)) for d, c in ((a, "x"), (b, "y")))
    both = x.join(y, "day", "full")
    return both.agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1).otherwise(0)), F.count("*")), F.lit(0.0)).alias("jaccard"))


def _check(category: str, name: str, value: float, passed: bool) -> dict:
    return {"category": category, "name": name, "value": value, "passed": bool(passed)}


def season_report(df: DataFrame, anchor: str, factor: dict, start: Any, end: Any, skip_undeclared_week: bool = False, parent: tuple[DataFrame, str] | None = None) -> dict:
    """Checks, score (0 to 100) and daily curve of one table.

    A table without declared weekdays fails the weekly check unless skip_undeclared_week. `parent` is a table
    with a seasonality of its own and its anchor: their busiest days must be alike, or their curves.
    """
    start, end = to_date(start), to_date(end)
    daily = daily_counts(df, anchor, start, end).cache()
    try:
        expected = calendar_frame(df.sparkSession, factor, start, end)
        checks = []
        r = daily.join(expected, "day").agg(safe_corr(F.col("n"), F.col("weight")).alias("r")).first()["r"]
        checks.append(_check("density", "expected and observed days", r, r >= LEAST_DENSITY))
        if factor.get("weekly") or not skip_undeclared_week:
            own = [(i + 1, weekly(factor, dt.date(2024, 1, 1 + i))) for i in range(7)]
            w = df.sparkSession.createDataFrame(own, "weekday int, weight double")
            r = weekday_means(daily).join(w, "weekday").agg(safe_corr(F.col("mean_n"), F.col("weight")).alias("r")).first()["r"]
            checks.append(_check("weekly", "weekdays", r, r >= LEAST_WEEKLY))
        for e in factor.get("events") or ():
            got = event_ratio(daily, to_date(e["start"]), to_date(e["end"])).first()["ratio"]
            checks.append(_check("events", e.get("name", "event"), got, got >= max(1.0, 0.5 * float(e.get("multiplier", 1.0)))))
        growth = float((factor.get("trend") or {}).get("annual_growth", 0.0))
        if growth:
            slope = trend_slope(daily).first()["slope"] or 0.0
            checks.append(_check("trend", "growth", slope, (slope > 0) == (growth > 0)))
        if parent:
            other = daily_counts(parent[0], parent[1], start, end)
            overlap = top_day_overlap(daily, other).first()["jaccard"]
            r = daily.join(other.withColumnRenamed("n", "m"), "day").agg(safe_corr(F.col("n"), F.col("m")).alias("r")).first()["r"]
            checks.append(_check("cross_table", "parent's days", max(overlap, r), overlap >= LEAST_OVERLAP or r >= LEAST_DENSITY))
        curve = daily.orderBy("day").collect()  # the days of the declared range
    finally:
        daily.unpersist()
    by: dict[str, list[bool]] = {}
    for c in checks:
        by.setdefault(c["category"], []).append(c["passed"])
    total = sum(WEIGHTS[k] for k in by)
    return {"checks": checks, "score": round(100 * sum(WEIGHTS[k] * sum(v) / len(v) for k, v in by.items()) / total, 2), "daily": [(r["day"], r["n"]) for r in curve]}


def preview_curve(factor: dict, start: Any, end: Any, points: int = 120) -> list[tuple[dt.date, float]]:
    """At most `points` days and their weights, at even strides."""
    from ..functions.seasonality import day_weights, days_between

    days = list(zip(days_between(to_date(start), to_date(end)), day_weights(factor, to_date(start), to_date(end)), strict=True))
    return days[:: max(1, -(-len(days) // points))]
