"""Governed read-only SQL over registered tables: guard, row cap, scan guard, timeout, audit log, export."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections import defaultdict
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryTimeoutError, TidewrightError, UnsafeSqlError
from ..types import kind_of

# Words and functions that a query may not hold.
FORBIDDEN_WORDS = (
    "insert update delete drop alter create truncate grant revoke copy attach detach call merge replace vacuum pragma set reset install load export import checkpoint use"
).split()
FORBIDDEN_CALLS = (
    "read_csv read_csv_auto read_parquet read_json read_json_auto read_ndjson read_text read_blob parquet_scan csv_scan glob httpfs read_parquet_mr delta_scan iceberg_scan read_files java_method reflect try_reflect input_file_name"
).split()
SAFE_NODES = re.compile(r"(?i)\b(?:parquet|csv|json|orc|text|avro|delta|binaryfile|jdbc)\s*\.\s*[`'\"]")
ROW_CAP, SCAN_LIMIT, TIMEOUT_S = 10_000, 50_000_000, 30.0
#: How often jobs of a late query are cancelled, 0.2 s apart, before its thread is left behind.
LAST_TRIES = 50
_analysis = threading.Lock()


def bare(sql: str) -> str:
    """The text without comments and with its string literals emptied."""
    return re.sub(r"'(?:[^'\\]|\\.|'')*'|--[^\n]*|/\*.*?\*/", lambda m: "''" if m[0][0] == "'" else " ", sql, flags=re.S)


def guard_select(sql: str) -> str:
    """One SELECT or WITH statement without forbidden words, or UnsafeSqlError."""
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise UnsafeSqlError("The statement is empty.")
    if ";" in text:
        raise UnsafeSqlError("Only one statement is allowed.")
    head = re.match(r"\(*\s*(\w*)", text)[1].lower()
    if head not in ("select", "with"):
        raise UnsafeSqlError(f"Only SELECT is allowed, not {head!r}.", "The explorer is read-only.")
    plain = bare(text)
    word = re.search(rf"(?i)\b({'|'.join(FORBIDDEN_WORDS)})\b(?!\s*\()", plain) or re.search(r"(?i)\b(copy|attach|load|call)\b", plain)
    if word:
        raise UnsafeSqlError(f"The word {word[1]!r} is not allowed.", "The explorer is read-only.")
    call = re.search(rf"(?i)\b({'|'.join(FORBIDDEN_CALLS)})\s*\(", plain)
    if call or SAFE_NODES.search(plain):
        raise UnsafeSqlError("Files are reached through registered tables only.")
    return text


def parse_guard(spark: SparkSession, sql: str) -> None:
    """Refuses what Spark's own parser takes for more than a query."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise UnsafeSqlError(f"The statement can't be parsed: {str(e)[:300]}") from e
    root = plan.nodeName()
    if "Command" in plan.getClass().getName() or root.startswith(("Create", "Insert", "Drop", "Set", "Alter", "Delete", "Update", "Merge")):
        raise UnsafeSqlError(f"Only queries are allowed, not {root}.")


def capped(df: DataFrame, cap: int) -> DataFrame:
    """One row more than the cap shows that something was cut."""
    return df.limit(cap + 1)


def _each(seq):
    return (seq.apply(i) for i in range(seq.size()))


def _rows(leaf, known: dict) -> int:
    """Rows of a plan's leaf: as counted where it belongs to a registered table, else by the plan's own statistics."""
    own = leaf.canonicalized()
    for other, rows in known.get(own.hashCode(), ()):
        if own.equals(other):
            return rows
    stats = leaf.stats()
    count = stats.rowCount()
    if count.isDefined():
        return int(str(count.get()))
    width = max(1, sum(a.dataType().defaultSize() for a in _each(leaf.output())))
    return int(str(stats.sizeInBytes())) // width


def _paired(node, known: dict) -> list[int]:
    """For every join of a physical plan that has no equal keys, the product of the most rows of either side."""
    out = []
    for child in _each(node.children()):
        out += _paired(child, known)
    if node.nodeName().startswith(("CartesianProduct", "BroadcastNestedLoopJoin")):
        product = 1
        for side in (node.left(), node.right()):
            link = side.logicalLink()
            product *= max([1, *(_rows(x, known) for x in _each(link.get().collectLeaves()))]) if link.isDefined() else 1
        out.append(product)
    return out


@dataclass
class Result:
    columns: list[str]
    rows: list[tuple]
    truncated: bool
    elapsed_ms: float


@dataclass
class Explorer:
    """Tables by dataset, with their schemas and row counts; queries against them."""

    spark: SparkSession
    row_cap: int = ROW_CAP
    scan_limit: int = SCAN_LIMIT
    timeout_s: float = TIMEOUT_S
    export_dir: str | None = None
    tables: dict[str, dict[str, dict]] = field(default_factory=lambda: defaultdict(dict))
    log: list[dict] = field(default_factory=list)

    def register(self, dataset: str, name: str, df: DataFrame, rows: int | None = None) -> None:
        """A table under dataset; its rows are counted once, for the scan guard, unless given."""
        view = f"{dataset}__{name}"
        df.createOrReplaceTempView(view)
        self.tables[dataset][name] = {"view": view, "frame": df, "schema": df.schema, "rows": df.count() if rows is None else rows}

    def list_datasets(self) -> list[str]:
        return sorted(self.tables)

    def list_tables(self, dataset: str) -> list[str]:
        return sorted(self.tables[dataset])

    def _table(self, dataset: str, name: str) -> dict:
        if name not in self.tables.get(dataset, {}):
            raise TidewrightError(f"{dataset!r} has no table {name!r}.")
        return self.tables[dataset][name]

    def describe(self, dataset: str, name: str) -> list[dict]:
        return [{"name": f.name, "type": f.dataType.simpleString(), "kind": kind_of(f.dataType), "nullable": f.nullable} for f in self._table(dataset, name)["schema"].fields]

    def ddl(self, dataset: str, name: str) -> str:
        cols = ",\n".join(f"  `{f.name}` {f.dataType.simpleString()}" for f in self._table(dataset, name)["schema"].fields)
        return f"CREATE TABLE `{name}` (\n{cols}\n)"

    def row_count(self, dataset: str, name: str) -> int:
        return self._table(dataset, name)["rows"]

    def preview(self, dataset: str, name: str, n: int = 50) -> list[tuple]:
        return [tuple(r) for r in self._table(dataset, name)["frame"].limit(min(max(n, 1), 200)).collect()]

    def frame(self, dataset: str, sql: str) -> DataFrame:
        """The guarded query as a lazy DataFrame over the dataset's tables; files can't be named in it."""
        text = guard_select(sql)
        parse_guard(self.spark, text)
        for name, t in self.tables.get(dataset, {}).items():
            t["frame"].createOrReplaceTempView(name)
        with _analysis:  # names are resolved here, so the setting matters no longer than this
            before = self.spark.conf.get("spark.sql.runSQLOnFiles")
            self.spark.conf.set("spark.sql.runSQLOnFiles", "false")
            try:
                return self.spark.sql(text)
            finally:
                self.spark.conf.set("spark.sql.runSQLOnFiles", before)

    def scanned_rows(self, dataset: str, df: DataFrame) -> int:
        """The most rows that a leaf of the query's optimised plan reads, or that a join without equal keys pairs."""
        known = {}
        for t in self.tables.get(dataset, {}).values():
            for leaf in _each(t["frame"]._jdf.queryExecution().optimizedPlan().collectLeaves()):
                known.setdefault(leaf.canonicalized().hashCode(), []).append((leaf.canonicalized(), t["rows"]))
        execution = df._jdf.queryExecution()
        return max([_rows(leaf, known) for leaf in _each(execution.optimizedPlan().collectLeaves())] + _paired(execution.sparkPlan(), known), default=0)

    def _guard_scan(self, dataset: str, df: DataFrame) -> None:
        rows = self.scanned_rows(dataset, df)
        if rows > self.scan_limit:
            raise UnsafeSqlError(f"The query would scan or pair {rows} rows, more than {self.scan_limit}.", "Filter or aggregate first.")

    def explain(self, dataset: str, sql: str) -> dict:
        df = self.frame(dataset, sql)
        return {"plan": df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")), "rows": self.scanned_rows(dataset, df)}

    def _audit(self, dataset: str, sql: str, status: str, began: float, rows: int = 0, truncated: bool = False, error: str = "") -> None:
        self.log.append({"dataset": dataset, "sql": sql[:4000], "status": status, "rows": rows, "truncated": truncated, "elapsed_ms": 1000 * (time.time() - began), "error": error[:2000]})

    def audit_frame(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(x.values()) for x in self.log], "dataset string, sql string, status string, rows bigint, truncated boolean, elapsed_ms double, error string")

    def execute(self, dataset: str, sql: str, sample: bool = False, params: dict[str, Any] | None = None) -> Result:
        """At most row_cap rows. With `sample`, a hash-ordered sample of a result that exceeds the cap, else its first rows."""
        began = time.time()
        try:
            df = self.frame(dataset, sql)
            self._guard_scan(dataset, df)
        except UnsafeSqlError as e:
            self._audit(dataset, sql, "rejected", began, error=str(e))
            raise
        except Exception as e:
            self._audit(dataset, sql, "error", began, error=str(e))
            raise
        try:
            rows = self._within_time(lambda: capped(df, self.row_cap).collect())
            truncated = len(rows) > self.row_cap
            if truncated and sample:
                order = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])
                rows = self._within_time(lambda: df.orderBy(order).limit(self.row_cap).collect())
        except QueryTimeoutError as e:
            self._audit(dataset, sql, "timeout", began, error=str(e))
            raise
        except Exception as e:
            self._audit(dataset, sql, "error", began, error=str(e))
            raise
        rows = rows[: self.row_cap]
        self._audit(dataset, sql, "ok", began, len(rows), truncated)
        return Result(df.columns, [tuple(r) for r in rows], truncated, 1000 * (time.time() - began))

    def _within_time(self, action):
        """Runs an action in a thread and a job group of its own; behind the limit the group's jobs end, and those that it starts later."""
        sc, group, got, failed = self.spark.sparkContext, f"explorer-{uuid.uuid4().hex}", [], []

        def work() -> None:
            try:
                sc.setJobGroup(group, "explorer", interruptOnCancel=True)
                got.append(action())
            except BaseException as e:  # raised again below
                failed.append(e)

        thread = InheritableThread(target=work, daemon=True)
        thread.start()
        thread.join(self.timeout_s)
        if not thread.is_alive():
            if failed:
                raise failed[0]
            return got[0]
        for _ in range(LAST_TRIES):  # planning itself can't be stopped: what it submits afterwards is
            sc._jsc.sc().cancelJobGroupAndFutureJobs(group, "the query took too long")
            thread.join(0.2)
            if not thread.is_alive():
                break
        raise QueryTimeoutError(f"The query took more than {self.timeout_s:g} s.") from (failed[0] if failed else None)

    def export(self, dataset: str, sql: str, filename: str, fmt: str = "parquet") -> str:
        """Writes the whole result below export_dir; the name may not leave it."""
        if fmt not in ("csv", "parquet", "json", "ndjson"):
            raise TidewrightError(f"unknown export format {fmt!r}")
        if not self.export_dir or Path(filename).name != filename or filename in ("", ".", ".."):
            raise TidewrightError("An export needs an export folder and a plain file name.")
        df = self.frame(dataset, sql)
        self._guard_scan(dataset, df)
        path = f"{self.export_dir}/{filename}"
        w = df.write.mode("overwrite")
        self._within_time(lambda: (w.option("header", True).csv if fmt == "csv" else w.parquet if fmt == "parquet" else w.json)(path))
        return path
