"""Loads: replace, append, merge and delete+insert on plain files, in waves along the references."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LoadError
from ..graph import waves
from ..plans.spec import Reference

STRATEGIES = ("replace", "append", "merge", "delete+insert")


def within(df: DataFrame, key: str | None, start: Any = None, end: Any = None) -> DataFrame:
    """Rows whose incremental key lies in [start, end)."""
    if key and start is not None:
        df = df.where(F.col(f"`{key}`") >= F.lit(start))
    if key and end is not None:
        df = df.where(F.col(f"`{key}`") < F.lit(end))
    return df


def _without(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows whose keys no source row has; null keys are equal."""
    have = source.select(*[F.col(f"`{k}`").alias(f"__{i}") for i, k in enumerate(keys)]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)])
    return target.join(have, same, "left_anti")


def merge(target: DataFrame, source: DataFrame, keys: list[str], latest: str | None = None) -> DataFrame:
    """Target rows that the source doesn't have by key, and the source's rows; null keys are equal.

    Of equal keys in the source the row with the largest `latest` stays, else and among those the one with the
    largest hash: a rerun gives the same table.
    """
    rest = [c for c in source.columns if c not in keys]
    order = F.struct(*([F.col(f"`{latest}`")] if latest else []), F.xxhash64(*[F.col(f"`{f.name}`") for f in source.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]))
    if rest:
        one = source.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("__row"))
        one = one.select(*[F.col(f"`{c}`") if c in keys else F.col("__row")[c].alias(c) for c in source.columns])
    else:
        one = source.distinct()
    return _without(target, source, keys).select(*[F.col(f"`{c}`") for c in target.columns]).unionByName(one.select(*[F.col(f"`{c}`") for c in target.columns]))


def delete_insert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Target rows outside of the incremental key values that the source holds, and the source's rows; nulls are equal."""
    return _without(target, source, [key]).unionByName(source.select(*[F.col(f"`{c}`") for c in target.columns]))


def mask(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Masks columns by hash, redact, trim or null."""
    how: dict[str, Callable] = {"hash": lambda c: F.sha2(c.cast("string"), 256), "redact": lambda c: F.mask(c.cast("string")), "trim": lambda c: F.trim(c), "null": lambda c: F.lit(None).cast("string")}
    for name, kind in columns.items():
        if kind not in how:
            raise LoadError(f"unknown mask {kind!r}")
        df = df.withColumn(name, how[kind](F.col(f"`{name}`")))
    return df


@dataclass
class TableLoad:
    name: str
    strategy: str = "replace"
    keys: list[str] = field(default_factory=list)
    incremental_key: str | None = None
    start: Any = None
    end: Any = None
    partition_by: list[str] = field(default_factory=list)

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise LoadError(f"unknown strategy {self.strategy!r}")
        if self.strategy == "merge" and not self.keys:
            raise LoadError(f"{self.name}: merge needs a key")
        if self.strategy == "delete+insert" and not self.incremental_key:
            raise LoadError(f"{self.name}: delete+insert needs an incremental key")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def recover(spark: SparkSession, path: str) -> None:
    """Puts back the table that a load moved aside before it was lost; removes what such loads left beside a table."""
    p, fs = _path(spark, path)
    for kind in ("old", "new"):
        found = fs.globStatus(_path(spark, f"{path.rstrip('/')}.{kind}-*")[0])
        for k in range(len(found or ())):
            left = found[k].getPath()
            if kind == "old" and not fs.exists(p):
                fs.rename(left, p)
            else:
                fs.delete(left, True)


def load_table(source: DataFrame, path: str, spec: TableLoad) -> None:
    """Writes a table at path by its strategy. One writer at a time.

    A rewrite goes beside the table first; then the table moves aside, the new one in its place, and the old one goes.
    If a load is lost between the two moves, the next one finds the old table and puts it back.
    """
    spark = source.sparkSession
    source = within(source, spec.incremental_key, spec.start, spec.end)
    recover(spark, path)
    p, fs = _path(spark, path)
    exists = fs.exists(p)
    if spec.strategy == "append":
        source.write.mode("append").partitionBy(*spec.partition_by).parquet(path)
        return
    out = source
    if exists and spec.strategy != "replace":
        target = spark.read.parquet(path)
        out = merge(target, source, spec.keys, spec.incremental_key) if spec.strategy == "merge" else delete_insert(target, source, spec.incremental_key)
    beside, aside = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    out.write.partitionBy(*spec.partition_by).parquet(beside)
    if exists and not fs.rename(p, _path(spark, aside)[0]):
        raise LoadError(f"can't move {path} aside")
    if not fs.rename(_path(spark, beside)[0], p):
        if exists:
            fs.rename(_path(spark, aside)[0], p)
        raise LoadError(f"can't move {beside} to {path}")
    if exists:
        fs.delete(_path(spark, aside)[0], True)


def plan_load(tables: list[TableLoad], references: list[Reference]) -> list[list[TableLoad]]:
    """Tables in waves, parents before children."""
    by = {t.name: t for t in tables}
    return [[by[n] for n in wave] for wave in waves(by, [(r.child, r.parent) for r in references])]


def run_load(frames: dict[str, DataFrame], base: str, tables: list[TableLoad], references: list[Reference], parallel: int = 4, gate: Callable[[], float] | None = None, least_score: float = 95.0) -> list[dict]:
    """Loads wave by wave, the tables of a wave side by side; stops behind the first wave with a failure.

    `gate` gives a quality score; below least_score nothing is loaded.
    """
    if gate is not None and (got := gate()) < least_score:
        raise LoadError(f"quality score {got:g} is below {least_score:g}")
    report: list[dict] = []

    def one(t: TableLoad) -> dict:
        began = time.time()
        try:
            load_table(frames[t.name], f"{base}/{t.name}", t)
            return {"table": t.name, "status": "ok", "seconds": time.time() - began}
        except Exception as e:
            return {"table": t.name, "status": "failed", "error": str(e)[:500], "seconds": time.time() - began}

    for k, wave in enumerate(plan_load(tables, references)):
        with ThreadPoolExecutor(max_workers=max(1, min(parallel, 8))) as pool:
            done = list(pool.map(one, wave))
        report += [d | {"wave": k} for d in done]
        if any(d["status"] == "failed" for d in done):
            break
    return report


def partition_hint(columns: dict[str, str], rows: int | None, strategy: str) -> str | None:
    """The date column to split a large extract by: an update or creation time first; none for replace or small tables."""
    if strategy == "replace" or rows is not None and rows < 1_000_000:
        return None
    dates = [c for c, t in columns.items() if t in ("date", "datetime")]
    for part in ("updated", "modified", "created", "date", "ts"):
        found = next((c for c in dates if part in c.lower()), None)
        if found:
            return found
    return dates[0] if dates else None
