"""Sizing of a generation plan: bytes, partitions, file layout, warnings. Arithmetic on the driver."""

from __future__ import annotations

from ..functions.seasonality import to_date
from ..functions.samplers import END, START
from ..plans.generate import Plan, TablePlan

#: Bytes of a value, about, by sampler.
WIDTH = {
    "sequence": 8, "uuid": 36, "choice": 12, "full_name": 16, "email": 28, "phone": 16, "address": 34, "city": 9, "country": 9, "lognormal": 8, "normal": 8, "uniform_int": 8,
    "poisson": 8, "bool": 1, "date": 4, "datetime": 8, "seasonal_date": 4, "seasonal_datetime": 8, "template": 16, "words": 14, "null": 8, "key": 36,
}
ROWS_IN_FILE, MOST_PARTITIONS = 1_000_000, 2000
TARGET_BYTES = 256 << 20


def row_bytes(t: TablePlan) -> int:
    return sum(WIDTH.get(c.sampler, 16) for c in t.columns) + sum(12 * len(f.inherit) for f in t.foreign_keys)


def size_class(rows: int) -> str:
    return "small" if rows < 1_000_000 else "medium" if rows < 10_000_000 else "large" if rows < 100_000_000 else "xlarge"


def months_between(start, end) -> int:
    """Months that a span of days touches, one at least."""
    a, b = to_date(start), to_date(end)
    return max(1, 12 * (b.year - a.year) + b.month - a.month + 1)


def partition_advice(t: TablePlan) -> dict:
    """What to part files by: the seasonal anchor or else a date, by the months of its span, or a column of at most 50 values."""
    by = next((c for c in t.columns if c.sampler.startswith("seasonal_")), None) or next((c for c in t.columns if c.sampler in ("date", "datetime")), None)
    parts, kind = (months_between(by.params.get("start") or START, by.params.get("end") or END), "month") if by else (1, None)
    if by is None:
        by = next((c for c in t.columns if c.sampler == "choice" and len(c.params["values"]) <= 50), None)
        parts, kind = (len(by.params["values"]), "value") if by else (1, None)
    warnings = []
    if by and t.rows / parts < ROWS_IN_FILE:
        warnings.append(f"{t.name}: fewer than {ROWS_IN_FILE} rows a partition")
    if parts > MOST_PARTITIONS:
        warnings.append(f"{t.name}: more than {MOST_PARTITIONS} partitions")
    return {"table": t.name, "column": by.name if by else None, "kind": kind, "partitions": parts, "warnings": warnings}


#: What a column's values cost, by how they come about: all stay in generated code, none needs another row.
COSTS = {"draw": "one hash a row", "text": "several hashes and a concatenation a row", "lookup": "one hash and a search in sorted weights a row", "formula": "an expression over the row", "parent": "the parent's expression at a drawn row"}
_TEXT = frozenset("uuid full_name email phone address template words".split())
_LOOKUP = frozenset("choice poisson seasonal_date seasonal_datetime".split())
LARGE_ROWS = 10_000_000


def complexity(plan: Plan) -> dict:
    """For each table its rows, joins and what each column costs; warnings for what weighs on tables of LARGE_ROWS or more."""
    tables, warnings = [], []
    for t in plan.tables:
        keys = {f.column for f in t.foreign_keys}
        costs = {c.name: "parent" if c.name in keys else "formula" if c.derive else "text" if c.sampler in _TEXT else "lookup" if c.sampler in _LOOKUP else "draw" for c in t.columns}
        # a parent's column that SQL text derives is the only thing that is joined in
        joins = [f.parent_table for f in t.foreign_keys if any((c := next((c for c in plan.table(f.parent_table).columns if c.name == a), None)) is not None and c.derive for a in (f.parent_column, *(x for x, _ in f.inherit)))]
        tables.append({"table": t.name, "rows": t.rows, "columns": len(t.columns), "foreign_keys": len(t.foreign_keys), "joins": joins, "costs": costs})
        if t.rows >= LARGE_ROWS:
            heavy = [c for c, k in costs.items() if k == "text"]
            warnings += [f"{t.name}: {len(heavy)} text columns over {t.rows} rows ({', '.join(heavy[:4])})"] if heavy else []
            warnings += [f"{t.name}: joins {p} for a derived column" for p in joins]
            warnings += [f"{t.name}: {len(c.derive['values_by']['mapping'])} cases for each value of {c.name}" for c in t.columns if c.derive.get("values_by")]
    return {"costs": COSTS, "tables": tables, "warnings": warnings}


def sizing_report(plan: Plan, cores: int = 8, executor_bytes: int = 4 << 30) -> dict:
    """Rows, bytes, tasks and advice for each table; nothing is held across rows, so memory is one task's batch."""
    tables, warnings = [], []
    for t in plan.tables:
        size = row_bytes(t) * t.rows
        tasks = max(1, min(4096, -(-t.rows // 500_000)))
        advice = partition_advice(t)
        warnings += advice["warnings"]
        if t.rows >= 10_000_000:
            warnings.append(f"{t.name}: {t.rows} rows")
        tables.append({"table": t.name, "rows": t.rows, "class": size_class(t.rows), "row_bytes": row_bytes(t), "bytes": size, "tasks": tasks, "files": max(1, -(-size // TARGET_BYTES)), "format": "parquet" if t.rows >= 1_000_000 else "csv", "cost": round(t.rows * len(t.columns) / 1e6, 2), "advice": advice})
    dominant = max(tables, key=lambda t: t["bytes"], default=None)
    task_bytes = max((t["row_bytes"] * min(t["rows"], 10_000) for t in tables), default=0)
    return {"tables": tables, "bytes": sum(t["bytes"] for t in tables), "dominant": dominant and dominant["table"], "task_bytes": task_bytes, "fits": task_bytes * cores < executor_bytes, "complexity": complexity(plan), "warnings": warnings}
