"""A semantic model of tables: entities, dimensions, measures and joins that can be run and rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spec import Reference
from .insights import roles

MEASURES = {"count": lambda c: F.count(F.lit(1)), "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct, "count_distinct_approx": F.approx_count_distinct}


def measure_kind(column: str) -> str:
    """Rates and prices are averaged, other numbers summed."""
    low = column.lower()
    return "avg" if any(w in low for w in ("rate", "price", "ratio", "pct", "percent", "age", "score", "discount")) else "sum"


def build_model(schemas: dict[str, T.StructType], references: list[Reference], keys: dict[str, str | None]) -> dict:
    """Entities (a fact where it refers to others or holds more measures than dimensions), and joins along references."""
    children = {r.child for r in references}
    entities = {}
    for t, s in schemas.items():
        r = roles(s)
        by = {k: [c for c, v in r.items() if v == k] for k in ("dimension", "time", "measure", "id")}
        fact = t in children and bool(by["measure"]) or t.startswith("fact") or len(by["measure"]) > len(by["dimension"]) + 1
        measures = {"count": {"kind": "count", "column": None}} | {f"{measure_kind(c)}_{c}": {"kind": measure_kind(c), "column": c} for c in by["measure"]}
        if keys.get(t):
            measures[f"distinct_{keys[t]}"] = {"kind": "count_distinct", "column": keys[t]}
        entities[t] = {"kind": "fact" if fact else "dimension", "key": keys.get(t), "dimensions": by["dimension"], "times": by["time"], "measures": measures}
    joins = [{"from": r.child, "to": r.parent, "on": (r.column, r.parent_column), "relationship": r.kind} for r in references]
    return {"entities": entities, "joins": joins}


def measure(model: dict, entity: str, name: str) -> Column:
    m = model["entities"][entity]["measures"][name]
    return MEASURES[m["kind"]](F.col(f"`{m['column']}`") if m["column"] else None).alias(name)


def query(model: dict, frames: dict[str, DataFrame], entity: str, measures: list[str], by: list[str]) -> DataFrame:
    """Measures of an entity by dimensions of it or of what it refers to ("parent.column")."""
    df = frames[entity]
    for parent in dict.fromkeys(c.split(".")[0] for c in by if "." in c):
        j = next((j for j in model["joins"] if j["from"] == entity and j["to"] == parent), None)
        if j is None:
            raise ValueError(f"{entity!r} has no join to {parent!r}")
        own, other = j["on"]
        taken = [c.split(".")[1] for c in by if c.startswith(f"{parent}.")]
        p = frames[parent].select(F.col(f"`{other}`").alias("__key"), *[F.col(f"`{c}`").alias(f"{parent}__{c}") for c in taken if c != other])
        df = df.join(p, df[own] == p["__key"], "left").drop("__key")
    groups = [F.col(c.replace(".", "__")).alias(c.replace(".", "_")) for c in by]
    return df.groupBy(*groups).agg(*[measure(model, entity, m) for m in measures])


def render_yaml(model: dict, style: str = "generic") -> str:
    """The model as YAML, or in the layout of cube files."""
    import yaml

    if style == "generic":
        return yaml.safe_dump({"entities": model["entities"], "joins": [j | {"on": list(j["on"])} for j in model["joins"]]}, sort_keys=False)
    cubes = []
    for t, e in model["entities"].items():
        cubes.append(
            {
                "name": t, "sql_table": t,
                "dimensions": [{"name": c, "sql": c, "type": "string"} for c in e["dimensions"]] + [{"name": c, "sql": c, "type": "time"} for c in e["times"]] + ([{"name": e["key"], "sql": e["key"], "type": "string", "primary_key": True}] if e["key"] else []),
                "measures": [{"name": n, "type": m["kind"], **({"sql": m["column"]} if m["column"] else {})} for n, m in e["measures"].items()],
                "joins": [{"name": j["to"], "relationship": j["relationship"], "sql": f"{{CUBE}}.{j['on'][0]} = {{{j['to']}}}.{j['on'][1]}"} for j in model["joins"] if j["from"] == t],
            }
        )
    return yaml.safe_dump({"cubes": cubes}, sort_keys=False)


def data_dictionary(schemas: dict[str, T.StructType], profiles: dict[str, dict] | None = None) -> str:
    """Tables and columns as Markdown."""
    lines = ["# Data dictionary"]
    for t, s in schemas.items():
        own = {c["name"]: c for c in (profiles or {}).get(t, {}).get("columns", [])}
        lines += ["", f"## {t}", "", "| column | type | role | nulls | distinct | personal data |", "|-|-|-|-|-|-|"]
        r = roles(s)
        lines += [f"| {f.name} | {f.dataType.simpleString()} | {r[f.name]} | {own.get(f.name, {}).get('nulls', '')} | {own.get(f.name, {}).get('distinct', '')} | {own.get(f.name, {}).get('pii', {}).get('level', '')} |" for f in s.fields]
    return "\n".join(lines) + "\n"
