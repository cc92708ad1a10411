"""Reports as Markdown, CSV and JSON: quality, seasonality, ingestion. Small results only; nothing here reads data."""

from __future__ import annotations

import csv
import io
import json
import time
from typing import Any

from pyspark.sql import types as T

from .insights import source_queries


def quality_markdown(table: str, results: list[dict], score: float) -> str:
    lines = [f"# Quality of {table}", "", f"Score: {score:g} of 100", "", "| rule | column | passed | evidence |", "|-|-|-|-|"]
    lines += [f"| {r['rule_type']} | {r['params']['column']} | {'yes' if r['passed'] else 'no'} | {r['evidence']} |" for r in results]
    return "\n".join(lines) + "\n"


def season_markdown(table: str, report: dict) -> str:
    lines = [f"# Seasonality of {table}", "", f"Score: {report['score']:g} of 100", "", "| check | value | passed |", "|-|-|-|"]
    lines += [f"| {c['category']}: {c['name']} | {c['value']:.4g} | {'yes' if c['passed'] else 'no'} |" for c in report["checks"]]
    return "\n".join(lines) + "\n"


def daily_csv(report: dict) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(("day", "n"))
    w.writerows(report["daily"])
    return out.getvalue()


def view_ddl(table: str, path: str, fmt: str) -> str:
    return f"CREATE OR REPLACE TEMPORARY VIEW `{table}` USING {fmt} OPTIONS (path '{path}')"


def ctas_ddl(table: str, path: str, fmt: str) -> str:
    return f"CREATE TABLE `{table}` AS SELECT * FROM {fmt}.`{path}`"


def ingestion_report(table: str, path: str, fmt: str, schema: T.StructType, profile: dict, warnings: list[dict], duplicates: int | None, sample: list[dict]) -> dict[str, Any]:
    """What is known about a new source, ready for json.dumps(default=str)."""
    native = fmt in ("csv", "json", "parquet", "orc")
    return {
        "table": table, "path": path, "format": fmt, "created": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "schema": json.loads(schema.json()), "rows": profile["rows"], "duplicates": duplicates, "profile": profile,
        "warnings": warnings, "sample": sample[:100], "queries": source_queries(table, schema), "view": view_ddl(table, path, fmt) if native else None, "ctas": ctas_ddl(table, path, fmt) if native else None,
    }
