"""Calendar attributes of a date, as columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

SEASONS = ("Winter", "Spring", "Summer", "Autumn")
#: part -> spec type
PARTS = {
    "day_of_week": "int", "is_weekend": "bool", "week": "int", "month": "int", "quarter": "int", "year": "int", "fiscal_month": "int",
    "fiscal_quarter": "int", "fiscal_year": "int", "season": "string", "is_holiday": "bool", "is_business_day": "bool",
}


def is_in(day: Column, dates: list[dt.date]) -> Column:
    """Whether a day is one of the dates; null stays null."""
    return day.isin([F.lit(d) for d in dates]) if dates else F.when(day.isNotNull(), F.lit(False))


def calendar_part(anchor: Column, part: str, fiscal_start: int = 1, hemisphere: str = "north", holidays: list[dt.date] | None = None) -> Column:
    """Days count from Monday = 1; a fiscal year is named by the year it starts in; winter is December to February in the north."""
    day = anchor.cast("date")
    weekday = F.weekday(day)
    month = F.month(day)
    fiscal_month = F.pmod(month - fiscal_start, F.lit(12)) + 1
    if part == "day_of_week":
        out = weekday + 1
    elif part == "is_weekend":
        out = weekday >= 5
    elif part == "week":
        out = F.weekofyear(day)
    elif part == "month":
        out = month
    elif part == "quarter":
        out = F.quarter(day)
    elif part == "year":
        out = F.year(day)
    elif part == "fiscal_month":
        out = fiscal_month
    elif part == "fiscal_quarter":
        out = F.floor((fiscal_month - 1) / 3) + 1
    elif part == "fiscal_year":
        out = F.year(day) - F.when(month < fiscal_start, 1).otherwise(0)
    elif part == "season":
        shift = 6 if hemisphere == "south" else 0
        out = F.get(F.array(*[F.lit(s) for s in SEASONS]), F.floor(F.pmod(month + shift, F.lit(12)) / 3).cast("int"))
    elif part == "is_holiday":
        out = is_in(day, holidays or [])
    elif part == "is_business_day":
        out = (weekday < 5) & ~is_in(day, holidays or [])
    else:
        raise ValueError(f"unknown calendar part {part!r}")
    return out.cast("int") if PARTS[part] == "int" else out
