"""Profiles: one pass for a table's statistics, one for its most frequent values; keys, personal data and references."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spec import Reference
from ..types import kind_of

TOP, PK_UNIQUENESS, INCLUSION, PII_SHARE = 10, 0.999, 0.95, 0.6
#: From this estimate on (six times its error of 5 % below 1), a column's distinct values are counted exactly.
NEARLY_UNIQUE = 0.7
# Patterns that decide what counts as personal data.
PII_NAMES = {
    "email": r"e?[-_]?mail",
    "phone": r"phone|mobile|cell",
    "name": r"(^|_)(first|last|full|middle|customer|patient|user)?_?name$",
    "ssn": r"ssn|social_sec",
    "dob": r"dob|birth",
    "address": r"address|street|zip|postal",
    "credit_card": r"card_?(number|num|no)|cc_?num",
    "ip_address": r"ip_?addr",
}
PII_VALUES = {
    "email": r"^[\w.+-]+@[\w-]+\.[\w.]+$",
    "phone": r"^\+?[\d\s().-]{7,17}$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "credit_card": r"^\d{13,19}$",
    "ip_address": r"^\d{1,3}(\.\d{1,3}){3}$",
}
NOT_PERSONS = r"(product|item|company|brand|store|file|table|column|category|plan|model)_?name$"
DATE_SHAPE = r"^\d{4}-\d{2}-\d{2}([ T].*)?$"
#: What str.strip() takes off.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _simple(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]


#: percentile_approx of this accuracy brackets a median: ranks are right to within 1 / ACCURACY of all values.
ACCURACY = 10_000


def _counted(df: DataFrame, fields: list[T.StructField], wanted: list[int], bounds: dict[int, tuple[float, float]]) -> DataFrame | None:
    """i, side, x, n, values: how often each column's values occur, what lies below (-1) and above (1) its bounds as one row.

    One unpivoted (column, value) -> count for all columns of a kind: integers and what they can stand for, doubles,
    texts. Columns without bounds are one row (side 0, x null). None if none of the columns has such a kind.
    """
    kinds: dict[str, list] = {"bigint": [], "double": [], "string": []}
    scales: dict[int, float] = {}
    for i in wanted:
        f, c = fields[i], F.col(f"`{fields[i].name}`")
        if isinstance(f.dataType, T.DecimalType) and f.dataType.precision <= 15:  # exact in a double, so that dividing gives the value again
            scales[i] = 10.0**f.dataType.scale
            kinds["bigint"].append((i, (c * F.lit(10**f.dataType.scale).cast("decimal(16,0)")).cast("bigint")))
        elif isinstance(f.dataType, T.IntegralType):
            kinds["bigint"].append((i, c.cast("bigint")))
        elif isinstance(f.dataType, T.BooleanType):
            kinds["bigint"].append((i, c.cast("int").cast("bigint")))
        elif isinstance(f.dataType, T.DateType):
            kinds["bigint"].append((i, F.unix_date(c).cast("bigint")))
        elif isinstance(f.dataType, T.TimestampType):
            kinds["bigint"].append((i, F.unix_micros(c)))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            kinds["double"].append((i, c.cast("double") + 0.0))
        elif isinstance(f.dataType, T.BinaryType):
            kinds["string"].append((i, F.hex(c)))
        elif isinstance(f.dataType, (T.StringType, T.DecimalType, T.TimestampNTZType)):
            kinds["string"].append((i, c.cast("string")))
    known = [(i, *bounds.get(i, (None, None)), scales.get(i, 1.0)) for i in wanted]
    limits = F.broadcast(df.sparkSession.createDataFrame(known, "i int, low double, high double, scale double"))  # a row for each column
    out = None
    for columns in kinds.values():
        if not columns:
            continue
        long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in columns])).alias("p")).select("p.*").where("v is not null")
        x = F.col("v").cast("double") / F.col("scale")
        side = F.when(F.col("low").isNull(), 0).when(x < F.col("low"), -1).when(x > F.col("high"), 1).otherwise(0)
        counted = long.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).join(limits, "i").select("i", "n", side.alias("side"), F.when((side == 0) & F.col("low").isNotNull(), x).alias("x"))
        counted = counted.groupBy("i", "side", "x").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("values"))
        out = counted if out is None else out.unionByName(counted)
    return out


def _distincts_and_medians(df: DataFrame, fields: list[T.StructField], wanted: list[int], bounds: dict[int, tuple[float, float]]) -> tuple[dict[int, int], dict[int, float]]:
    """Exact numbers of distinct values, and medians of the columns with bounds, which must hold their middle values."""
    counted = _counted(df, fields, wanted, bounds)
    distinct: dict[int, int] = dict.fromkeys(wanted, 0)
    medians: dict[int, float] = {}
    if counted is not None:
        ordered = Window.partitionBy("i").orderBy("side", "x")  # what lies within the bounds, and two rows
        reach = F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
        every = Window.partitionBy("i").orderBy("side", "x").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ranked = counted.withColumns({"reach": reach, "total": F.sum("n").over(every), "distinct": F.sum("values").over(every)})
        low, high = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
        held = [((F.col("reach") - F.col("n") < r) & (F.col("reach") >= r)) for r in (low, high)]
        for r in ranked.where(held[0] | held[1]).select("i", "side", "x", "distinct", *[h.alias(k) for h, k in zip(held, ("first", "second"), strict=True)]).collect():  # two rows for each column
            distinct[r["i"]] = r["distinct"]
            if r["x"] is not None:
                medians.setdefault(r["i"], []).extend([r["x"]] * (r["first"] + r["second"]))
    done = {i: (v[0] + v[1]) / 2 for i, v in medians.items() if len(v) == 2}
    for i in wanted:
        f = fields[i].dataType
        if isinstance(f, (T.StructType, T.ArrayType)) or not isinstance(f, (T.NumericType, T.BooleanType, T.DatetimeType, T.BinaryType, T.StringType)):
            distinct[i] = df.agg(F.count_distinct(F.col(f"`{fields[i].name}`"))).first()[0]
    return distinct, done


def column_stats(df: DataFrame, exact: bool = True, looks: bool = False) -> DataFrame:
    """A row for each column: count, nulls, distinct, uniqueness, min, max, mean, std, median.

    Two jobs: one aggregate for what partial aggregates can hold, and, for exact distinct counts and medians, counts
    of all columns' values, of which only those around the middle are ranked. With exact=False both are estimates.
    min and max are text; mean, std and median are of numbers only. An empty table has null_ratio 0. With looks=True
    there is a column of that name: for text columns, the counts of value_counts over all values.
    """
    fields = _simple(df)
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    numbers = [i for i, f in enumerate(fields) if isinstance(f.dataType, T.NumericType)]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count(c).alias(f"c{i}"))
        if not exact:
            aggs.append(F.approx_count_distinct(c).alias(f"d{i}"))
        ordered = not isinstance(f.dataType, (T.StructType, T.ArrayType, T.BinaryType))
        aggs += [(F.min(c) if ordered else F.lit(None)).cast("string").alias(f"lo{i}"), (F.max(c) if ordered else F.lit(None)).cast("string").alias(f"hi{i}")]
        if looks and isinstance(f.dataType, T.StringType):
            aggs.append(F.create_map(*[x for k, n in value_counts(c).items() for x in (F.lit(k), n)]).alias(f"p{i}"))
        if i in numbers:
            x = c.cast("double")
            around = F.array(F.lit(0.5 - 2 / ACCURACY), F.lit(0.5), F.lit(0.5 + 2 / ACCURACY))
            aggs += [F.avg(x).alias(f"m{i}"), F.coalesce(F.stddev_samp(x), F.when(F.count(x) > 0, F.lit(0.0))).alias(f"s{i}"), F.percentile_approx(x, around, ACCURACY).alias(f"q{i}")]
    got = df.agg(*aggs).first()
    if exact:
        every = list(range(len(fields)))
        bounds = {i: (got[f"q{i}"][0], got[f"q{i}"][2]) for i in numbers if got[f"q{i}"]}
        distinct, medians = _distincts_and_medians(df, fields, every, bounds)
        missed = [i for i in bounds if i not in medians]  # with NaN among the values the bounds may be off
        if missed:
            medians |= _distincts_and_medians(df, fields, missed, dict.fromkeys(missed, (float("-inf"), float("nan"))))[1]
    else:
        distinct = {i: got[f"d{i}"] for i in range(len(fields))}
        medians = {i: got[f"q{i}"][1] for i in numbers if got[f"q{i}"]}
    rows = []
    for i, f in enumerate(fields):
        n, count, number = got["n"], got[f"c{i}"], i in numbers
        row = [f.name, kind_of(f.dataType), n, count, n - count, distinct[i], distinct[i] / count if count else 0.0, got[f"lo{i}"], got[f"hi{i}"], got[f"m{i}"] if number else None, got[f"s{i}"] if number else None, medians.get(i)]
        rows.append((*row, *([got[f"p{i}"] if isinstance(f.dataType, T.StringType) else None] if looks else []), (n - count) / n if n else 0.0))
    schema = "column string, dtype string, rows bigint, count bigint, nulls bigint, distinct bigint, uniqueness double, min string, max string, mean double, std double, median double"
    return df.sparkSession.createDataFrame(rows, schema + (", looks map<string,bigint>" if looks else "") + ", null_ratio double")


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = TOP) -> DataFrame:
    """column, value, count, rank: the k most frequent values of each column, ties to the smaller value; nulls don't count.

    One pass: columns are unpivoted, and only their counts are ranked.
    """
    columns = columns or [f.name for f in _simple(df) if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.BinaryType))]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    counted = df.select(pairs.alias("p")).select("p.*").where("value is not null").groupBy("column", "value").count()
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def entropy(df: DataFrame, columns: list[str] | None = None, k: int = TOP) -> DataFrame:
    """column, entropy: in bits, over the counts of the k most frequent values."""
    top = top_values(df, columns, k)
    share = F.col("count") / F.sum("count").over(Window.partitionBy("column"))
    return top.select("column", share.alias("p")).groupBy("column").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """rows, duplicates: how many rows repeat an earlier one; equal nulls are equal."""
    counted = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    return counted.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates"))


def pk_candidates(df: DataFrame) -> DataFrame:
    """column, is_candidate: no nulls, rows, and nearly all values distinct."""
    s = column_stats(df)
    return s.select("column", ((F.col("nulls") == 0) & (F.col("rows") > 0) & (F.col("uniqueness") >= PK_UNIQUENESS)).alias("is_candidate"))


def luhn_ok(c: Column) -> Column:
    digits = F.regexp_replace(c, "[^0-9]", "")
    return (F.length(digits) >= 13) & F.call_function("luhn_check", digits)


def classify_pii(name: str, values: list[str], numeric: bool = False) -> tuple[str, str | None, float]:
    """(none | possible | likely, category, confidence) from a column's name and values."""
    some = [v.strip() for v in values if v] if not numeric else []
    hits = {k: sum(bool(re.match(p, v)) for v in some) for k, p in (PII_VALUES | {"date": DATE_SHAPE}).items()}
    return classify_counts(name, hits | {"values": len(some), "luhn": sum(map(_luhn, some))})


def classify_counts(name: str, counts: dict[str, int]) -> tuple[str, str | None, float]:
    """(none | possible | likely, category, confidence) from a column's name and the counts of value_counts; none without values."""
    by_name = next((k for k, p in PII_NAMES.items() if re.search(p, name, re.I)), None)
    if by_name == "name" and re.search(NOT_PERSONS, name, re.I):
        by_name = None
    by_value, share, n = None, 0.0, counts.get("values", 0)
    if n and counts["date"] < PII_SHARE * n:
        for kind in PII_VALUES:
            share = counts[kind] / n
            if share >= PII_SHARE and (kind != "credit_card" or counts["luhn"] >= 0.5 * n):
                by_value = kind
                break
    if by_value:
        return "likely", by_value, min(0.99, 0.7 + 0.3 * share) if by_name else 0.6 + 0.3 * share
    return ("possible", by_name, 0.5) if by_name else ("none", None, 0.9)


def _luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()]
    if len(digits) < 13:
        return False
    doubled = [d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def value_counts(c: Column) -> dict[str, Column]:
    """Aggregates over a text column: values (neither null nor empty), and how many of them look like each kind of personal data, like a date (date) or have a card's check digit (luhn)."""
    v = F.when(c != "", F.btrim(c, F.lit(WHITE)))
    tests = {k: v.rlike("(?U)" + p) for k, p in (PII_VALUES | {"date": DATE_SHAPE}).items()} | {"luhn": luhn_ok(v)}
    return {"values": F.count(v)} | {k: F.count_if(F.coalesce(t, F.lit(False))) for k, t in tests.items()}


def pii_shares(df: DataFrame, column: str) -> DataFrame:
    """category, hits, values: how many non-null values look like each kind of personal data, over the whole column."""
    counts = value_counts(F.col(f"`{column}`").cast("string"))
    aggs = [n.alias(k) for k, n in counts.items()]
    rows = F.array(*[F.struct(F.lit(k).alias("category"), F.col(k).alias("hits"), F.col("values").alias("values")) for k in PII_VALUES])
    return df.agg(*aggs).select(F.inline(rows))


def find_in_text(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """matches and rows of a pattern anywhere in a text column."""
    hits = F.regexp_count(F.col(f"`{column}`"), F.lit(pattern))
    return df.agg(F.coalesce(F.sum(hits), F.lit(0)).cast("bigint").alias("matches"), F.sum(F.when(hits > 0, 1).otherwise(0)).cast("bigint").alias("rows"))


def profile_table(df: DataFrame, table: str, exact: bool = True, sample_rows: int | None = None) -> dict[str, Any]:
    """The profile document: statistics, frequent values, entropy, personal data and the primary key.

    Three jobs, whatever the number of columns. sample_rows bounds them to a hash-ordered sample. With
    exact=False medians are approximate, and distinct counts of columns that can't be nearly unique; a fourth
    job counts the others exactly.
    """
    if sample_rows is not None:
        df = deterministic_sample(df, sample_rows)
    stats = [r.asDict() for r in column_stats(df, exact, looks=True).collect()]  # a row for each column
    near = [s for s in stats if not exact and s["uniqueness"] >= NEARLY_UNIQUE]
    if near:
        fields = _simple(df)
        counted, _ = _distincts_and_medians(df, fields, [i for i, f in enumerate(fields) if f.name in {s["column"] for s in near}], {})
        by = {fields[i].name: n for i, n in counted.items()}
        for s in near:
            s["distinct"], s["uniqueness"] = by[s["column"]], by[s["column"]] / s["count"]
    tops: dict[str, list[dict]] = {}
    for r in top_values(df).orderBy("column", "rank").collect():  # TOP rows for each column
        tops.setdefault(r["column"], []).append({"value": r["value"], "count": r["count"]})
    out = []
    for s in stats:
        name = s.pop("column")
        counts = [t["count"] for t in tops.get(name, [])]
        total = sum(counts)
        import math

        bits = -sum(c / total * math.log2(c / total) for c in counts) if total else 0.0
        level, category, confidence = classify_counts(name, s.pop("looks") or {})
        out.append({"name": name, **s, "null_ratio": round(s["null_ratio"], 6), "top_values": tops.get(name, []), "entropy": bits, "pii": {"level": level, "category": category, "confidence": confidence}, "pk_candidate": s["nulls"] == 0 and s["rows"] > 0 and s["uniqueness"] >= PK_UNIQUENESS})
    for c in out:
        if c["dtype"] in ("int", "float"):
            c["min"], c["max"] = (None if c[k] is None else float(c[k]) for k in ("min", "max"))
    return {"table": table, "rows": stats[0]["rows"] if stats else 0, "columns": out, "primary_key": next((c["name"] for c in out if c["pk_candidate"]), None)}


def deterministic_sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows by the order of a hash: the same ones however the table is parted."""
    h = F.xxhash64(F.lit(seed), *[F.col(f"`{f.name}`") for f in _simple(df)])
    return df.withColumn("__h", h).orderBy("__h").limit(n).drop("__h")


# references between tables


def singular(word: str) -> str:
    for end, new in (("ies", "y"), ("ses", "s"), ("xes", "x"), ("s", "")):
        if word.endswith(end) and not word.endswith("ss") and len(word) > len(end) + 1:
            return word[: -len(end)] + new
    return word


def entity(table: str) -> str:
    return singular(re.sub(r"^(dim|fact|stg|raw|src|tbl)_", "", table.lower()))


def reference_candidates(tables: dict[str, list[str]], keys: dict[str, str | None]) -> list[Reference]:
    """References by name: <entity>_id, <entity>id, <entity>_key or the parent's own key name; confidence 0.6."""
    out = []
    for child, columns in tables.items():
        for c in columns:
            for parent, key in keys.items():
                if parent == child or not key or c == keys.get(child):
                    continue
                e, low = entity(parent), c.lower()
                if low in (f"{e}_id", f"{e}id", f"{e}_key", f"{e}key") or low == key.lower() and low not in ("id", "key"):
                    out.append(Reference(child, c, parent, key))
    return out


def inclusion(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """values, found, ratio: the share of the child's distinct values that the parent holds; keys compare as text."""
    a = child.select(F.col(f"`{column}`").cast("string").alias("k")).where("k is not null").distinct()
    b = parent.select(F.col(f"`{parent_column}`").cast("string").alias("k")).where("k is not null").distinct().withColumn("hit", F.lit(1))
    return a.join(b, "k", "left").agg(F.count("*").alias("values"), F.count("hit").alias("found")).withColumn("ratio", F.coalesce(F.try_divide("found", "values"), F.lit(0.0)))


def confirm_reference(child: DataFrame, r: Reference, parent: DataFrame) -> float:
    """Confidence of a reference: 0.6 by name, up to 0.99 where values are included."""
    ratio = inclusion(child, r.column, parent, r.parent_column).first()["ratio"]
    return min(0.99, 0.7 + 0.29 * ratio) if ratio >= INCLUSION else 0.6
