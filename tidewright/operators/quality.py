"""Quality rules from metadata: all rules of a table in one aggregate, references by anti join, a weighted score."""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException, ArithmeticException, DateTimeException, NumberFormatException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import Reference

#: What a rule that doesn't fit its column's type or values raises.
UNEVALUABLE = (AnalysisException, ArithmeticException, DateTimeException, NumberFormatException)
WEIGHTS = {"integrity": 0.35, "completeness": 0.25, "validity": 0.25, "consistency": 0.15}
CATEGORY = {"unique": "integrity", "foreign_key": "integrity", "not_null": "completeness", "range": "validity", "accepted_values": "consistency"}


def _rule(kind: str, column: str, **params: Any) -> dict:
    return {"rule_type": kind, "category": CATEGORY[kind], "params": {"column": column, **params}}


def derive_rules(profile: dict, references: list[Reference], primary_key: str | None = None, confidence: dict | None = None) -> list[dict]:
    """Rules for a table from its profile and references (of confidence 0.6 or more, 1 where not given)."""
    table = profile["table"]
    key = primary_key or profile.get("primary_key")
    own = [r for r in references if r.child == table and (confidence or {}).get((r.child, r.column), 1.0) >= 0.6]
    children = {r.column for r in references if r.child == table}
    out = []
    for c in profile["columns"]:
        name = c["name"]
        if name == key:
            out += [_rule("unique", name), _rule("not_null", name, tolerance=0.0)]
        elif c.get("null_ratio", 1.0) < 0.01:
            out.append(_rule("not_null", name, tolerance=0.02))
        low, high = c.get("min"), c.get("max")
        if name != key and name not in children and c["dtype"] in ("int", "float") and low is not None and high is not None:
            slack = 0.1 * (abs(float(high) - float(low)) or 1.0)
            out.append(_rule("range", name, min=float(low) - slack, max=float(high) + slack, tolerance=0.01))
        if c["dtype"] == "string" and c.get("top_values") and 0 < c.get("distinct", 99) <= 20:
            out.append(_rule("accepted_values", name, values=[t["value"] for t in c["top_values"]], tolerance=0.05))
    return out + [_rule("foreign_key", r.column, parent_table=r.parent, parent_column=r.parent_column) for r in own]


def not_null_ratio(c: Column) -> Column:
    """Share of null values, 0 for an empty table."""
    return F.coalesce(F.avg(F.when(c.isNull(), 1.0).otherwise(0.0)), F.lit(0.0))


def uniqueness(c: Column) -> Column:
    return F.coalesce(F.try_divide(F.count_distinct(c), F.count(c)), F.lit(1.0))


def out_of_range(c: Column, low: float, high: float) -> Column:
    x = c.cast("double")
    return F.coalesce(F.avg(F.when(x.isNotNull(), ((x < low) | (x > high)).cast("double"))), F.lit(0.0))


def not_accepted(c: Column, values: list) -> Column:
    x = c.cast("string")
    return F.coalesce(F.avg(F.when(x.isNotNull(), (~x.isin([str(v) for v in values])).cast("double"))), F.lit(0.0))


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose key no parent row has; null keys are no orphans. Keys compare as text."""
    keys = parent.select(F.col(f"`{parent_column}`").cast("string").alias("__k")).where("__k is not null").distinct()
    c = F.col(f"`{column}`").cast("string")
    return child.where(F.col(f"`{column}`").isNotNull()).withColumn("__k", c).join(keys, "__k", "left_anti").drop("__k")


def evaluate(df: DataFrame, rules: list[dict], parents: dict[str, DataFrame] | None = None) -> list[dict]:
    """Each rule with passed and evidence. A missing column fails; a parent that isn't given passes; an unknown rule passes.
    A rule that can't be evaluated on the column's values fails with the reason; other errors, such as lost executors, are raised.

    One aggregate for all rules of one table, and one anti join for each reference.
    """
    aggs: dict[str, Column] = {}
    for i, r in enumerate(rules):
        p = r["params"]
        if p["column"] not in df.columns:
            continue
        c = F.col(f"`{p['column']}`")
        kind = r["rule_type"]
        if kind == "not_null":
            aggs[f"r{i}"] = not_null_ratio(c).alias(f"r{i}")
        elif kind == "unique":
            aggs[f"r{i}"] = uniqueness(c).alias(f"r{i}")
        elif kind == "range":
            aggs[f"r{i}"] = out_of_range(c, p["min"], p["max"]).alias(f"r{i}")
        elif kind == "accepted_values":
            aggs[f"r{i}"] = not_accepted(c, p["values"]).alias(f"r{i}")
    got: dict[str, Any] = {}
    failed: dict[str, str] = {}
    try:
        got = df.agg(*aggs.values()).first().asDict() if aggs else {}
    except UNEVALUABLE:  # some rule's: each by itself, so that the others stand
        for name, agg in aggs.items():
            try:
                got[name] = df.agg(agg).first()[0]
            except UNEVALUABLE as e:
                failed[name] = str(e)[:300]
    out = []
    for i, r in enumerate(rules):
        p, kind = r["params"], r["rule_type"]
        if p["column"] not in df.columns:
            out.append(r | {"passed": False, "evidence": f"column {p['column']!r} missing"})
        elif kind == "foreign_key":
            if p["parent_table"] not in (parents or {}):
                out.append(r | {"passed": True, "evidence": "parent out of scope"})
            else:
                n = orphans(df, p["column"], parents[p["parent_table"]], p["parent_column"]).count()
                out.append(r | {"passed": n == 0, "evidence": f"{n} orphans"})
        elif kind not in CATEGORY:
            out.append(r | {"passed": True, "evidence": "unknown rule"})
        elif f"r{i}" in failed:
            out.append(r | {"passed": False, "evidence": failed[f"r{i}"]})
        else:
            v = got[f"r{i}"]
            passed = v >= 1.0 if kind == "unique" else v <= p.get("tolerance", 0.0)
            out.append(r | {"passed": passed, "evidence": f"{kind}: {v:.6f}"})
    return out


def score(results: list[dict], weights: dict[str, float] = WEIGHTS) -> float:
    """Weighted share of rules passed, by category, over the categories that occur; 100 without rules."""
    by: dict[str, list[bool]] = {}
    for r in results:
        by.setdefault(r["category"], []).append(r["passed"])
    total = sum(weights[k] for k in by)
    return round(100 * sum(weights[k] * sum(v) / len(v) for k, v in by.items()) / total, 2) if total else 100.0


def ingestion_warnings(profile: dict, duplicates: int | None = None) -> list[dict]:
    """Warnings about a new source: {code, column, severity, detail}."""
    rows, out = profile["rows"], []

    def warn(code: str, severity: str, column: str | None = None, detail: Any = None) -> None:
        out.append({"code": code, "severity": severity, "column": column, "detail": detail})

    if not rows:
        warn("empty_table", "high")
        return out
    if duplicates:
        warn("duplicate_rows", "warning" if duplicates < 0.1 * rows else "high", detail=duplicates)
    for c in profile["columns"]:
        share = 100 * c["null_ratio"]
        if share >= 50:
            warn("high_null", "high", c["name"], share)
        elif share >= 5:
            warn("some_null", "warning", c["name"], share)
        if c["distinct"] == 1 and c["count"] > 1:
            warn("constant_column", "info", c["name"])
        if c["dtype"] == "string" and rows > 100 and c["uniqueness"] >= 0.9 and not c["name"].lower().endswith(("id", "key")):
            warn("high_cardinality", "info", c["name"], c["distinct"])
        if c["dtype"] in ("int", "float") and c["count"] > 1 and c.get("std") == 0:
            warn("no_variance", "info", c["name"])
    return out
