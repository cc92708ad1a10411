"""One object for the usual path: scan or declare tables, profile, generate, check, query, load, document."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .errors import TidewrightError
from .operators import insights, load, profile, quality, reports, season_report, semantic, sizing
from .operators.explorer import Explorer, Result
from .plans.generate import Generator, Plan, plan_dataset, plan_from_profiles
from .plans.spec import Dataset, Reference, load_spec
from .sources import readers, sinks
from .sources.detect import detect, table_name
from .types import fingerprint


class Workspace:
    """Tables are lazy DataFrames; profiles, references, rules and descriptions are small and can be saved as JSON."""

    def __init__(self, spark: SparkSession, dataset: str = "main", **explorer: Any):
        self.spark, self.dataset = spark, dataset
        self.frames: dict[str, DataFrame] = {}
        self.profiles: dict[str, dict] = {}
        self.references: list[Reference] = []
        self.confidence: dict[tuple[str, str], float] = {}
        self.descriptions: dict[str, str] = {}
        self.spec: Dataset | None = None
        self.explorer = Explorer(spark, **explorer)

    # tables

    def add(self, name: str, df: DataFrame, rows: int | None = None) -> DataFrame:
        self.frames[name] = df
        self.explorer.register(self.dataset, name, df, rows)
        return df

    def table(self, name: str) -> DataFrame:
        if name not in self.frames:
            raise TidewrightError(f"no table {name!r}")
        return self.frames[name]

    def ingest(self, path: str, name: str | None = None, format: str | None = None, exact: bool = True, **options: Any) -> dict:
        """Registers a source, profiles it and returns its report; duplicates are counted at every size."""
        d = detect(path, format)
        name = name or table_name(path)
        df = self.add(name, readers.read(self.spark, path, format, **options))
        p = self.profile(name, exact=exact)
        duplicates = profile.duplicate_rows(df).first()["duplicates"] if not any(t.startswith("map") for _, t in df.dtypes) else None
        sample = [r.asDict(recursive=True) for r in df.limit(100).collect()]
        return reports.ingestion_report(name, path, d.format, df.schema, p, quality.ingestion_warnings(p, duplicates), duplicates, sample)

    def search(self, text: str) -> list[tuple[str, str | None]]:
        """(table, column) whose name or description holds a text; column is None for the table itself."""
        low = text.lower()
        out: list[tuple[str, str | None]] = [(t, None) for t in self.frames if low in t.lower() or low in self.descriptions.get(t, "").lower()]
        return out + [(t, c) for t, f in self.frames.items() for c in f.columns if low in c.lower() or low in self.descriptions.get(f"{t}.{c}", "").lower()]

    def fingerprint(self) -> str:
        return fingerprint({n: f.schema for n, f in self.frames.items()})

    # knowledge

    def profile(self, name: str, sample_rows: int | None = None, exact: bool = True) -> dict:
        """Exact at every size, unless the caller says otherwise; keys and uniqueness near 1 are always exact, see profile_table."""
        self.profiles[name] = profile.profile_table(self.table(name), name, exact, sample_rows)
        return self.profiles[name]

    def keys(self) -> dict[str, str | None]:
        return {n: p.get("primary_key") for n, p in self.profiles.items()}

    def relate(self, *references: Reference) -> None:
        """States references; what is stated is certain."""
        for r in references:
            self.references = [x for x in self.references if (x.child, x.column) != (r.child, r.column)] + [r]
            self.confidence[r.child, r.column] = 1.0

    def infer_references(self) -> list[tuple[Reference, float]]:
        """References by name, confirmed by values; stated ones stay."""
        out = []
        for r in profile.reference_candidates({n: self.frames[n].columns for n in self.profiles}, self.keys()):
            if self.confidence.get((r.child, r.column)) == 1.0:
                continue
            got = profile.confirm_reference(self.table(r.child), r, self.table(r.parent))
            if got > self.confidence.get((r.child, r.column), 0.0):
                self.references = [x for x in self.references if (x.child, x.column) != (r.child, r.column)] + [r]
                self.confidence[r.child, r.column] = got
            out.append((r, got))
        return out

    # generation

    def apply_spec(self, source: str | Path | dict) -> Dataset:
        self.spec = load_spec(source)
        self.relate(*self.spec.references)
        return self.spec

    def plan(self, rows: int | dict[str, int] = 1000, seed: int = 42, calendar: dict | None = None) -> Plan:
        """From the spec, or else after the profiled tables."""
        if self.spec:
            return plan_dataset(self.spec, rows, seed, calendar)
        if not self.profiles:
            raise TidewrightError("nothing to plan from", "Apply a spec or profile tables.")
        sure = [r for r in self.references if self.confidence.get((r.child, r.column), 0.0) >= 0.5]
        counts = {n: rows.get(n, p["rows"]) if isinstance(rows, dict) else rows for n, p in self.profiles.items()}
        return plan_from_profiles(list(self.profiles.values()), sure, counts, seed)

    def generate(self, plan: Plan, path: str | None = None, format: str = "parquet") -> dict[str, DataFrame]:
        """The plan's tables, registered; with a path written there first and read again."""
        out = {}
        for name, df in Generator(self.spark, plan).frames().items():
            if path:
                sinks.write(df, f"{path}/{name}", format, table=name)
                df = readers.read(self.spark, f"{path}/{name}", format) if format in ("parquet", "csv", "orc", "ndjson") else df
            out[name] = self.add(name, df, plan.table(name).rows)
        return out

    def sizing(self, plan: Plan) -> dict:
        return sizing.sizing_report(plan)

    def generate_and_load(self, plan: Plan, base: str, least_score: float | None = None) -> list[dict]:
        """Generates and loads wave by wave; with least_score nothing is loaded below that quality."""
        frames = Generator(self.spark, plan).frames()
        for n, f in frames.items():
            self.add(n, f, plan.table(n).rows)
        refs = [Reference(t.name, f.column, f.parent_table, f.parent_column) for t in plan.tables for f in t.foreign_keys]
        gate = (lambda: min(self.quality(n)["score"] for n in frames)) if least_score is not None else None
        return load.run_load(frames, base, [load.TableLoad(n) for n in frames], refs, gate=gate, least_score=least_score or 0.0)

    # checks and questions

    def quality(self, name: str) -> dict:
        p = self.profiles.get(name) or self.profile(name)
        rules = quality.derive_rules(p, self.references, p.get("primary_key"), self.confidence)
        got = quality.evaluate(self.table(name), rules, self.frames)
        return {"results": got, "score": quality.score(got)}

    def seasonality(self, name: str, anchor: str, factor: dict, start: Any, end: Any, **options: Any) -> dict:
        return season_report.season_report(self.table(name), anchor, factor, start, end, **options)

    def query(self, sql: str, sample: bool = False) -> Result:
        return self.explorer.execute(self.dataset, sql, sample)

    def explain(self, sql: str) -> dict:
        return self.explorer.explain(self.dataset, sql)

    def suggestions(self) -> list[dict]:
        return insights.suggest({n: f.schema for n, f in self.frames.items()})

    def ask(self, question: str) -> dict:
        """A first query for a question in words: by the tables and columns it names, never by a remote model."""
        return insights.answerable(question, {n: f.schema for n, f in self.frames.items()})

    def question(self, question: str, model: Callable[[str, str], str] = insights.offline_model) -> dict:
        """A checked query for a question, by a model of the caller's (prompt, question) -> reply; offline without one."""
        return insights.question_to_sql(question, {n: f.schema for n, f in self.frames.items()}, model, self.profiles, self.references)

    def model(self) -> dict:
        return semantic.build_model({n: f.schema for n, f in self.frames.items()}, self.references, {n: None for n in self.frames} | self.keys())

    def measures(self, entity: str, measures: list[str], by: list[str]) -> DataFrame:
        return semantic.query(self.model(), self.frames, entity, measures, by)

    def dictionary(self) -> str:
        return semantic.data_dictionary({n: f.schema for n, f in self.frames.items()}, self.profiles)

    # state

    def save(self, path: str | Path) -> None:
        state = {"profiles": self.profiles, "references": [asdict(r) for r in self.references], "confidence": [[*k, v] for k, v in self.confidence.items()], "descriptions": self.descriptions}
        Path(path).write_text(json.dumps(state, default=str, indent=1))

    def restore(self, path: str | Path) -> None:
        state = json.loads(Path(path).read_text())
        self.profiles, self.descriptions = state["profiles"], state["descriptions"]
        self.references = [Reference(**(r | {"inherit": [tuple(x) for x in r["inherit"]]})) for r in state["references"]]
        self.confidence = {(a, b): v for a, b, v in state["confidence"]}
