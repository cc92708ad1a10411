"""Seasonality: a day's weight is the product of trend, yearly, monthly, weekly, holiday and event factors.

A factor is a dict as the dataset spec gives it. The weights of a range of days are computed once, on the
driver, over at most some thousand days; columns look them up by day.
"""

from __future__ import annotations

import calendar
import datetime as dt
import math
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SpecError

WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def to_date(x: Any) -> dt.date:
    return x if isinstance(x, dt.date) and not isinstance(x, dt.datetime) else dt.date.fromisoformat(str(x)[:10])


def days_between(start: dt.date, end: dt.date) -> list[dt.date]:
    return [start + dt.timedelta(k) for k in range((end - start).days + 1)]


def trend(factor: dict, day: dt.date, start: dt.date) -> float:
    cfg = factor.get("trend")
    if not cfg:
        return 1.0
    growth, years = float(cfg.get("annual_growth", 0.0)), (day - start).days / 365.25
    kind = cfg.get("kind", "linear")
    if kind == "exponential":
        value = (1 + growth) ** years
    elif kind == "logarithmic":
        value = 1 + growth * math.log1p(max(years, 0.0))
    else:
        value = 1 + growth * years
    return max(value, 0.01)


def nearest_distance(day: dt.date, month: int, of_month: int) -> int:
    """Days to the nearest yearly return of a date; 29 February falls on the 28th in other years."""
    found = []
    for year in (day.year - 1, day.year, day.year + 1):
        last = calendar.monthrange(year, month)[1]
        found.append(abs((day - dt.date(year, month, min(of_month, last))).days))
    return min(found)


def yearly(factor: dict, day: dt.date) -> float:
    cfg = factor.get("yearly")
    if not cfg:
        return 1.0
    phase = day.timetuple().tm_yday + float(cfg.get("phase_days", 0.0))
    value = 1 + float(cfg.get("amplitude", 0.0)) * math.sin(2 * math.pi * phase / 365.25)
    for peak in cfg.get("peaks") or ():
        width = max(float(peak.get("width_days", 3)), 0.5)
        gap = nearest_distance(day, int(peak["month"]), int(peak.get("day", 15)))
        value *= 1 + (float(peak.get("strength", 1.5)) - 1) * math.exp(-0.5 * (gap / width) ** 2)
    return max(value, 0.0)


def monthly(factor: dict, day: dt.date) -> float:
    cfg = factor.get("monthly")
    if not cfg:
        return 1.0
    if cfg.get("weights_by_day"):
        own = {int(k): float(v) for k, v in cfg["weights_by_day"].items()}
        return own.get(day.day, 1.0)
    last = calendar.monthrange(day.year, day.month)[1]
    through = (day.day - 1) / max(last - 1, 1)
    strength = float(cfg.get("strength", 0.5))
    return {"month_start": 1 + strength * (1 - through), "month_end": 1 + strength * through}.get(cfg.get("shape", "uniform"), 1.0)


def weekly(factor: dict, day: dt.date) -> float:
    own = {str(k).strip().lower()[:3]: float(v) for k, v in (factor.get("weekly") or {}).items()}
    return own.get(WEEKDAYS[day.weekday()], 1.0)


def holiday_dates(cfg: dict | None, start: dt.date, end: dt.date) -> list[dt.date]:
    """Explicit dates, or a country's calendar where the optional library is installed."""
    if not cfg:
        return []
    if cfg.get("dates"):
        return sorted(d for d in map(to_date, cfg["dates"]) if start <= d <= end)
    if cfg.get("country"):
        try:
            import holidays
        except ImportError as e:
            raise SpecError("country holidays need the `holidays` package; list the dates instead") from e
        own = holidays.country_holidays(cfg["country"], subdiv=cfg.get("subdiv"), years=range(start.year, end.year + 1))
        return sorted(d for d in own if start <= d <= end)
    return []


def events(factor: dict, day: dt.date) -> float:
    value = 1.0
    for e in factor.get("events") or ():
        if "date" in e:
            at, around = to_date(e["date"]), int(e.get("window_days", 0))
            first, last = at - dt.timedelta(around), at + dt.timedelta(around)
        else:
            first, last = to_date(e["start"]), to_date(e["end"])
        if first <= day <= last:
            value *= float(e.get("multiplier", 1.0))
    return value


def multipliers(factor: dict, start: dt.date, end: dt.date) -> list[float]:
    """The factor on every day of a range; not normalised, never negative."""
    if end < start:
        raise SpecError("a range must not end before it starts")
    cfg = factor.get("holidays")
    festive = holiday_dates(cfg, start - dt.timedelta(400), end + dt.timedelta(400)) if cfg else []
    around = int((cfg or {}).get("window_days", 0))
    near = {d + dt.timedelta(k) for d in festive for k in range(-around, around + 1)}
    raised = max(1.0, float((cfg or {}).get("strength", 1.5)))
    origin = to_date(factor["_start"]) if factor.get("_start") else start
    out = []
    for day in days_between(start, end):
        w = float(factor.get("base", 1.0)) * trend(factor, day, origin) * yearly(factor, day) * monthly(factor, day) * weekly(factor, day)
        w *= (raised if day in near else 1.0) * events(factor, day)
        out.append(max(w, 0.0))
    return out


def day_weights(factor: dict, start: dt.date, end: dt.date) -> list[float]:
    """Weights that sum to 1; equal where all are zero."""
    w = multipliers(factor, start, end)
    total = sum(w)
    return [x / total for x in w] if total > 0 else [1.0 / len(w)] * len(w)


def hour_weights(factor: dict) -> list[float]:
    w = [max(float(x), 0.0) for x in ((factor.get("daily") or {}).get("hour_weights") or [1.0] * 24)]
    total = sum(w)
    return [x / total for x in w] if total > 0 else [1 / 24] * 24


def multiplier_at(anchor: Column, factor: dict, start: dt.date, end: dt.date) -> Column:
    """The factor on the anchor's day; days outside of the range count as its nearest end. Null stays null."""
    values = multipliers(factor, start, end)
    place = F.greatest(F.lit(0), F.least(F.lit(len(values) - 1), F.datediff(anchor.cast("date"), F.lit(start))))
    return F.when(anchor.isNotNull(), F.get(F.lit(values), place))


def calendar_frame(spark: SparkSession, factor: dict, start: dt.date, end: dt.date) -> DataFrame:
    """day, multiplier and weight of every day of a range."""
    rows = list(zip(days_between(start, end), multipliers(factor, start, end), day_weights(factor, start, end), strict=True))
    return spark.createDataFrame(rows, "day date, multiplier double, weight double")
