"""Column roles, suggested queries, insights from results, and whether a question can be answered."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TidewrightError
from ..types import kind_of
from .explorer import bare, guard_select

# An id by its name.
ID = re.compile(r"(?i)(^|_)(id|key|uuid|guid|code|no|number)$|key$|_id$")


def roles(schema: T.StructType) -> dict[str, str]:
    """id, time, measure or dimension, for each column."""
    out = {}
    for f in schema.fields:
        kind = kind_of(f.dataType)
        out[f.name] = "id" if ID.search(f.name) else "time" if kind in ("date", "datetime") else "measure" if kind in ("int", "float") else "dimension"
    return out


def suggest(tables: dict[str, T.StructType]) -> list[dict]:
    """Queries to start with, in Spark SQL; equal texts once."""
    out: list[dict] = []
    role = {t: roles(s) for t, s in tables.items()}

    def add(kind: str, table: str, sql: str) -> None:
        if all(x["sql"] != sql for x in out):
            out.append({"kind": kind, "table": table, "sql": sql})

    for t, r in role.items():
        first = {k: next((c for c, v in r.items() if v == k), None) for k in ("time", "measure", "dimension")}
        add("count", t, f"SELECT count(*) AS n FROM `{t}`")
        if first["time"] and first["measure"]:
            add("monthly", t, f"SELECT date_trunc('month', `{first['time']}`) AS month, sum(`{first['measure']}`) AS total FROM `{t}` GROUP BY 1 ORDER BY 1")
        if first["dimension"] and first["measure"]:
            add("top", t, f"SELECT `{first['dimension']}`, sum(`{first['measure']}`) AS total FROM `{t}` GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
        if first["dimension"]:
            add("distribution", t, f"SELECT `{first['dimension']}`, count(*) AS n FROM `{t}` GROUP BY 1 ORDER BY 2 DESC, 1")
    names = sorted(tables)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            shared = [c for c in role[a] if role[a][c] == "id" and role[b].get(c) == "id"]
            if shared:
                add("join", a, f"SELECT * FROM `{a}` JOIN `{b}` USING (`{shared[0]}`) LIMIT 100")
    return out


def result_stats(df: DataFrame) -> DataFrame:
    """column, nulls, sum, mean, min, max and whether an outlier stands out (the maximum beyond five means), for numbers."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    aggs = []
    for i, c in enumerate(numbers):
        x = F.col(f"`{c}`").cast("double")
        aggs += [(F.count(F.lit(1)) - F.count(x)).alias(f"z{i}"), F.sum(x).alias(f"s{i}"), F.avg(x).alias(f"a{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"z{i}").alias("nulls"), F.col(f"s{i}").alias("total"), F.col(f"a{i}").alias("mean"), F.col(f"l{i}").alias("least"), F.col(f"h{i}").alias("most"), F.coalesce((F.col(f"a{i}") > 0) & (F.col(f"h{i}") > 5 * F.col(f"a{i}")), F.lit(False)).alias("outlier")) for i, c in enumerate(numbers)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def monotonic(df: DataFrame, order: str, value: str) -> DataFrame:
    """ups, downs, n and trend (increasing, decreasing or mixed) of a short ordered result."""
    before = F.lag(F.col(f"`{value}`")).over(Window.partitionBy(F.lit(0)).orderBy(order))
    x = df.select((F.col(f"`{value}`") > before).alias("up"), (F.col(f"`{value}`") < before).alias("down"))
    out = x.agg(F.coalesce(F.sum(F.col("up").cast("int")), F.lit(0)).alias("ups"), F.coalesce(F.sum(F.col("down").cast("int")), F.lit(0)).alias("downs"), F.count("*").alias("n"))
    return out.withColumn("trend", F.when((F.col("n") > 2) & (F.col("ups") >= F.col("n") - 2), "increasing").when((F.col("n") > 2) & (F.col("downs") >= F.col("n") - 2), "decreasing").otherwise("mixed"))


def explain_result(df: DataFrame) -> list[str]:
    """Sentences about a result's numbers, twelve at most."""
    out = []
    for r in result_stats(df).collect():  # a row for each column
        if r["mean"] is None:
            continue
        out.append(f"{r['column']}: {r['total']:g} in all, {r['mean']:g} on average, from {r['least']:g} to {r['most']:g}.")
        if r["outlier"]:
            out.append(f"{r['column']}: the largest value is more than five times the average.")
        if r["nulls"]:
            out.append(f"{r['column']}: {r['nulls']} values are missing.")
    return out[:12]


def follow_ups(sql: str, schema: T.StructType) -> list[str]:
    """At most three queries on top of a result."""
    r = roles(schema)
    inner = sql.strip().rstrip(";")
    measure = next((c for c, v in r.items() if v == "measure"), None)
    dimension = next((c for c, v in r.items() if v == "dimension"), None)
    out = [f"SELECT count(*) AS n FROM ({inner}) AS q"]
    if measure:
        out.append(f"SELECT * FROM ({inner}) AS q ORDER BY `{measure}` DESC LIMIT 10")
    if dimension:
        out.append(f"SELECT `{dimension}`, count(*) AS n FROM ({inner}) AS q GROUP BY 1 ORDER BY 2 DESC LIMIT 10")
    return out[:3]


def answerable(question: str, tables: dict[str, T.StructType]) -> dict:
    """Whether a question names a table or a column, and a first query for it."""
    words = set(re.findall(r"[a-z_]+", question.lower()))
    words |= {w.rstrip("s") for w in words}
    for t, s in tables.items():
        parts = set(re.findall(r"[a-z]+", t.lower())) | {t.lower()} | {p.rstrip("s") for p in re.findall(r"[a-z]+", t.lower())}
        if words & (parts | {f.name.lower() for f in s.fields}):
            return {"answerable": True, "table": t, "sql": f"SELECT * FROM `{t}` LIMIT 100"}
    return {"answerable": False, "table": None, "sql": None}


def source_queries(table: str, schema: T.StructType) -> dict[str, str]:
    """Preview, count, distribution, aggregate, measure by category, monthly, null counts and duplicates for a new source."""
    r = roles(schema)
    d, m, t = (next((c for c, v in r.items() if v == k), None) for k in ("dimension", "measure", "time"))
    cols = [f.name for f in schema.fields]
    out = {"preview": f"SELECT * FROM `{table}` LIMIT 100", "count": f"SELECT count(*) AS n FROM `{table}`"}
    if d:
        out["distribution"] = f"SELECT `{d}`, count(*) AS n FROM `{table}` GROUP BY 1 ORDER BY 2 DESC"
    if m:
        out["aggregate"] = f"SELECT sum(`{m}`) AS total, avg(`{m}`) AS mean, min(`{m}`) AS least, max(`{m}`) AS most FROM `{table}`"
    if d and m:
        out["by_category"] = f"SELECT `{d}`, sum(`{m}`) AS total FROM `{table}` GROUP BY 1 ORDER BY 2 DESC"
    if t:
        out["monthly"] = f"SELECT date_trunc('month', `{t}`) AS month, count(*) AS n FROM `{table}` GROUP BY 1 ORDER BY 1"
    out["nulls"] = "SELECT " + ", ".join(f"count(*) FILTER (WHERE `{c}` IS NULL) AS `{c}`" for c in cols) + f" FROM `{table}`"
    out["duplicates"] = f"SELECT coalesce(sum(n - 1), 0) AS duplicates FROM (SELECT count(*) AS n FROM `{table}` GROUP BY {', '.join(f'`{c}`' for c in cols)})"
    every = ", ".join(f"`{c}`" for c in cols)
    out["repeats"] = f"SELECT {every} FROM (SELECT {every}, row_number() OVER (PARTITION BY {every} ORDER BY {every}) AS place FROM `{table}`) AS q WHERE place > 1"
    return out


# questions in words

PROMPT = "Answer with one JSON object: sql (a single SELECT over the tables below), explanation, confidence (0 to 1), tables_used (their names)."


def schema_prompt(tables: dict[str, T.StructType], profiles: dict[str, dict] | None = None, references: list | None = None, most_tables: int = 30) -> str:
    """Tables, columns and joins for a model to read: names, kinds and marks for keys and personal data, never a value."""
    lines = []
    for name in sorted(tables)[:most_tables]:
        known = {c["name"]: c for c in (profiles or {}).get(name, {}).get("columns", [])}
        key = (profiles or {}).get(name, {}).get("primary_key")
        cells = []
        for f in tables[name].fields:
            marks = ["key"] if f.name == key else []
            marks += ["personal"] if known.get(f.name, {}).get("pii", {}).get("level", "none") != "none" else []
            cells.append(f"{f.name} {kind_of(f.dataType)}" + (f" ({', '.join(marks)})" if marks else ""))
        lines.append(f"{name}: " + "; ".join(cells))
    lines += [f"{r.child}.{r.column} refers to {r.parent}.{r.parent_column}" for r in references or () if r.child in tables and r.parent in tables]
    return "\n".join(lines)


def parse_reply(reply: str) -> dict:
    """The first JSON object in a model's reply, in a code fence or among words. TidewrightError if there is none."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", reply):
        try:
            got, _ = decoder.raw_decode(reply, m.start())
        except ValueError:
            continue
        if isinstance(got, dict):
            return got
    raise TidewrightError("The reply holds no JSON object.", "Ask again, or ask in other words.")


def offline_model(prompt: str, question: str) -> str:
    """Stands for a model where there is none: the first ten rows of the table that the question names, else of the first one."""
    names = [line.split(":")[0] for line in prompt.splitlines() if ":" in line and " refers to " not in line]
    words = question.lower()
    table = next((n for n in names if n.lower() in words or n.lower().rstrip("s") in words), names[0] if names else "")
    return json.dumps({"sql": f"SELECT * FROM {table} LIMIT 10", "explanation": f"The first rows of {table}.", "confidence": 0.1, "tables_used": [table]})


def question_to_sql(question: str, tables: dict[str, T.StructType], model: Callable[[str, str], str] = offline_model, profiles: dict[str, dict] | None = None, references: list | None = None) -> dict:
    """sql, explanation, confidence and tables_used from a model's reply; refused if it isn't one plain query over known tables."""
    if not tables:
        raise TidewrightError("There are no tables to ask about.")
    got = parse_reply(model(f"{PROMPT}\n{schema_prompt(tables, profiles, references)}", question))
    sql = guard_select(str(got.get("sql") or ""))
    used = [str(t) for t in got.get("tables_used") or []]
    own = {str(a or b).lower() for a, b in re.findall(r"(?i)(?:`(\w+)`|\b(\w+))\s+AS\s*\(", bare(sql))}  # names that WITH defines
    named = [(a or b) for a, b in re.findall(r"(?i)\b(?:from|join)\s+(?:`([^`]+)`|(\w+))", bare(sql))]
    unknown = sorted({t for t in [*used, *(n for n in named if n.lower() not in own)] if t.lower() not in {n.lower() for n in tables}})
    if unknown:
        raise TidewrightError(f"The reply uses tables that don't exist: {', '.join(unknown)}.", "Ask again, or register them.")
    try:
        confidence = min(1.0, max(0.0, float(got.get("confidence") or 0.0)))
    except (TypeError, ValueError):
        confidence = 0.0
    return {"sql": sql, "explanation": str(got.get("explanation") or ""), "confidence": confidence, "tables_used": used}
