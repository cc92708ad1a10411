"""Queries whose answers are laws: what generated tables and samplers must obey, and texts that the library emits, run."""

from __future__ import annotations

import datetime as dt
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import samplers
from .functions.random import Draw
from .operators import insights, profile, season_report
from .operators.explorer import Explorer
from .plans.generate import Generator, plan_dataset
from .plans.spec import load_spec
from .registry import SPEC, query, sq, t
from .sources import readers, sinks
from .sources.detect import Detection
from .storage import shared_dir


def values(names: str, *rows: tuple) -> str:
    """SQL for a few stated rows; whole numbers are BIGINT, as counts are."""

    def one(x) -> str:
        return "TRUE" if x is True else "FALSE" if x is False else "CAST(NULL AS BIGINT)" if x is None else f"CAST({x} AS BIGINT)" if isinstance(x, int) else f"'{x}'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({names})"


def frames(spark: SparkSession) -> dict[str, DataFrame]:
    return Generator(spark, plan_dataset(load_spec(SPEC))).frames()


# generated tables


@query(values("table_name, n, keys, nulls", ("dim_customer", 2000, 2000, 0), ("fact_orders", 20000, 20000, 0), ("loyalty_card", 1500, 1500, 0)))
def generated_keys(spark, sf_dir):
    """Keys are as many as rows, and none is null."""
    out = None
    for name, key in (("dim_customer", "customer_id"), ("fact_orders", "order_id"), ("loyalty_card", "card_id")):
        one = frames(spark)[name].agg(F.lit(name).alias("table_name"), F.count("*").alias("n"), F.count_distinct(key).alias("keys"), F.count_if(F.col(key).isNull()).alias("nulls"))
        out = one if out is None else out.unionByName(one)
    return out


@query(values("table_name, orphans, inherited_wrong, parents_twice", ("fact_orders", 0, 0, None), ("loyalty_card", 0, None, 0)))
def generated_references(spark, sf_dir):
    """No orphans; what a child inherits is what its parent has; one-to-one keys come once."""
    f = frames(spark)
    parent = f["dim_customer"].select("customer_id", F.col("segment").alias("theirs"))
    orders = f["fact_orders"].join(parent, "customer_id", "left")
    cards = f["loyalty_card"].join(parent, "customer_id", "left")
    a = orders.agg(F.lit("fact_orders").alias("table_name"), F.count_if(F.col("theirs").isNull()).alias("orphans"), F.count_if(F.col("theirs") != F.col("customer_segment")).alias("inherited_wrong"), F.lit(None).cast("bigint").alias("parents_twice"))
    b = cards.agg(F.lit("loyalty_card").alias("table_name"), F.count_if(F.col("theirs").isNull()).alias("orphans"), F.lit(None).cast("bigint").alias("inherited_wrong"), (F.count("*") - F.count_distinct("customer_id")).alias("parents_twice"))
    return a.unionByName(b)


@query(values("column_name, near", ("country", True), ("customer_segment", True), ("segment", True), ("status", True)))
def generated_shares(spark, sf_dir):
    """Total variation between declared and drawn shares: at most 0.03 (0.05 where a column is inherited by few parents)."""
    f, out = frames(spark), None
    for table, column, shares, most in (
        ("dim_customer", "segment", {"consumer": 0.70, "business": 0.25, "vip": 0.05}, 0.03), ("dim_customer", "country", {"India": 0.8, "Ghana": 0.2}, 0.03),
        ("fact_orders", "status", {"completed": 0.85, "returned": 0.10, "pending": 0.05}, 0.03), ("fact_orders", "customer_segment", {"consumer": 0.70, "business": 0.25, "vip": 0.05}, 0.05),
    ):
        c = F.col(column)
        gap = sum(F.abs(F.avg((c == v).cast("double")) - p) for v, p in shares.items())
        one = f[table].agg(F.lit(column).alias("column_name"), ((0.5 * gap <= most) & F.coalesce(F.bool_and(c.isin(list(shares))), F.lit(True))).alias("near"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 0 AS foreign_cities, 0 AS bad_codes, TRUE AS codes_missing")
def generated_values_by(spark, sf_dir):
    """Cities are their country's; codes have their format, and about 0.7 of them are missing."""
    ok = ((F.col("country") == "India") & F.col("city").isin("Pune", "Delhi")) | ((F.col("country") == "Ghana") & F.col("city").isin("Accra", "Kumasi"))
    code = F.col("referral_code")
    return frames(spark)["dim_customer"].agg(
        F.count_if(~ok).cast("int").alias("foreign_cities"), F.count_if(code.isNotNull() & ~code.rlike(r"^R-\d{4}-[A-Z]{2}$")).cast("int").alias("bad_codes"), F.avg(code.isNull().cast("double")).between(0.66, 0.74).alias("codes_missing")
    )


@query("SELECT 0 AS out_of_order, 0 AS out_of_reach, 0 AS wrongly_null, 0 AS derived_wrong, 0 AS below_least")
def generated_rules(spark, sf_dir):
    """Temporal order, its reach, null_unless, error of derived columns, least values."""
    late = F.timestamp_diff("MINUTE", F.col("order_ts"), F.col("returned_ts"))
    return frames(spark)["fact_orders"].agg(
        F.count_if(F.col("returned_ts") < F.col("order_ts")).cast("int").alias("out_of_order"), F.count_if(~late.between(60, 2880)).cast("int").alias("out_of_reach"), F.count_if(F.col("returned_ts").isNull() == (F.col("status") == "returned")).cast("int").alias("wrongly_null"),
        F.count_if(F.abs(F.col("total") - F.col("unit_price") * F.col("quantity")) > 1e-6).cast("int").alias("derived_wrong"), F.count_if((F.col("quantity") < 1) | (F.col("unit_price") < 10)).cast("int").alias("below_least"),
    )


@query("SELECT 0 AS parts_wrong, TRUE AS weekend_peaks, TRUE AS event_peaks, TRUE AS grows, TRUE AS revenue_scales")
def generated_season_laws(spark, sf_dir):
    """Calendar parts are their anchor's; days follow the declared week, event and trend; scaled values their own trend."""
    f = frames(spark)["fact_orders"].withColumn("day", F.col("order_ts").cast("date"))
    wrong = (F.col("order_day_of_week") != F.weekday("day") + 1) | (F.col("order_is_weekend") != (F.weekday("day") >= 5)) | (F.col("order_quarter") != F.quarter("day"))
    event = F.col("day").between(F.lit(dt.date(2024, 11, 28)), F.lit(dt.date(2024, 11, 30)))
    first = F.year("day") == 2024
    return f.agg(
        F.count_if(wrong).cast("int").alias("parts_wrong"), (F.count_if(F.weekday("day") == 5) > 2 * F.count_if(F.weekday("day") == 1)).alias("weekend_peaks"), (F.count_if(event) / 3 > 2.5 * F.count_if(first & ~event) / 363).alias("event_peaks"),
        (F.count_if(~first) > 1.15 * F.count_if(first)).alias("grows"), (F.avg(F.when(~first, F.col("revenue"))) > 1.5 * F.avg(F.when(first, F.col("revenue")))).alias("revenue_scales"),
    )


_YEAR = {"start": "2024-01-01", "end": "2024-12-31"}
N = 20_000


def _all(c) -> F.Column:
    return F.bool_and(F.coalesce(c, F.lit(False)))


def laws() -> dict[str, tuple[dict, F.Column]]:
    """Parameters of each sampler, and what a column x of N values must obey."""
    x = F.col("x")
    every_day = F.count_distinct(x.cast("date")) == 366
    within = _all(x.cast("date").between(F.lit(dt.date(2024, 1, 1)), F.lit(dt.date(2024, 12, 31))))
    number = x.cast("double")
    return {
        "sequence": ({}, (F.min(x) == 1) & (F.max(x) == N) & (F.count_distinct(x) == N)),
        "uuid": ({}, (F.count_distinct(x) == N) & _all(x.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-a[0-9a-f]{3}-[0-9a-f]{12}$"))),
        "choice": ({"values": ["a", "b"], "weights": [3, 1]}, F.avg((x == "a").cast("double")).between(0.73, 0.77) & _all(x.isin("a", "b"))),
        "full_name": ({}, _all(x.rlike(r"^\S+ \S+$"))),
        "email": ({}, _all(x.rlike(profile.PII_VALUES["email"]))),
        "phone": ({}, _all(x.rlike(r"^\+1-\d{3}-\d{3}-\d{4}$"))),
        "address": ({}, _all(x.rlike(r"^\d+ .+, .+$"))),
        "city": ({}, _all(x.isin(samplers.CITIES)) & (F.count_distinct(x) == len(set(samplers.CITIES)))),
        "country": ({}, _all(x.isin(samplers.COUNTRIES)) & (F.count_distinct(x) == len(set(samplers.COUNTRIES)))),
        "lognormal": ({"mean": 100.0, "sigma": 0.6}, F.avg(number).between(97, 103) & (F.min(x) > 0) & F.stddev(F.log(number)).between(0.58, 0.62)),
        "normal": ({"mean": 5.0, "std": 2.0, "min": 0, "max": 10}, F.avg(number).between(4.9, 5.1) & F.stddev(number).between(1.9, 2.1) & (F.min(x) >= 0) & (F.max(x) <= 10)),
        "uniform_int": ({"min": 3, "max": 7}, (F.min(x) == 3) & (F.max(x) == 7) & F.avg(number).between(4.95, 5.05) & F.variance(number).between(1.9, 2.1)),
        "poisson": ({"lam": 3.0}, F.avg(number).between(2.9, 3.1) & F.variance(number).between(2.8, 3.2) & (F.min(x) == 0)),
        "bool": ({"p_true": 0.3}, F.avg(x.cast("int")).between(0.28, 0.32)),
        "date": (_YEAR, within & every_day),
        "datetime": (_YEAR, within & every_day & (F.count_distinct(F.hour(x)) == 24)),
        "seasonal_date": ({"factor": {"weekly": {"Sat": 3.0, "Sun": 3.0}}} | _YEAR, within & F.avg((F.weekday(x) >= 5).cast("int")).between(0.52, 0.57)),
        "seasonal_datetime": ({"factor": {"daily": {"hour_weights": [0] * 12 + [1] * 12}}} | _YEAR, within & every_day & (F.min(F.hour(x)) == 12) & (F.max(F.hour(x)) == 23)),
        "template": ({"pattern": "A-##-?"}, _all(x.rlike("^A-[0-9]{2}-[A-Z]$")) & (F.count_distinct(x) > 2500)),
        "words": ({"k": 3}, _all(x.rlike(r"^\S+ \S+ \S+$"))),
    }


@query(values("sampler, holds", *((name, True) for name in sorted(samplers.SAMPLERS))))
def sampler_laws(spark, sf_dir):
    """Each sampler's values obey its law."""
    out = None
    for name, (params, law) in laws().items():
        drawn = spark.range(N).select(samplers.sample(name, Draw(42, "laws", name, F.col("id")), **params).alias("x"))
        one = drawn.agg(law.alias("holds")).select(F.lit(name).alias("sampler"), "holds")
        out = one if out is None else out.unionByName(one)
    return out


@query(values("sampler, same", *((name, True) for name in sorted(samplers.SAMPLERS))))
def sampler_partitions(spark, sf_dir):
    """Values don't depend on how rows are parted."""
    columns = {name: samplers.sample(name, Draw(42, "laws", name, F.col("id")), **params) for name, (params, _) in laws().items()}
    sums = [spark.range(0, 5000, 1, n).agg(*[F.sum(F.xxhash64(F.col("id"), c.cast("string")).cast("decimal(38,0)")).alias(name) for name, c in columns.items()]) for n in (1, 7)]
    both = sums[0].select(F.struct("*").alias("a")).join(sums[1].select(F.struct("*").alias("b")))
    return both.select(F.inline(F.array(*[F.struct(F.lit(n).alias("sampler"), (F.col("a")[n] == F.col("b")[n]).alias("same")) for n in columns])))


# governed SQL and sources


@query("SELECT o_orderkey, o_totalprice, TRUE AS truncated FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 100")
def explorer_execute(spark, sf_dir):
    """Explorer.execute over its row cap."""
    e = Explorer(spark, row_cap=100)
    e.register("shop", "orders", t(spark, sf_dir, "orders"))
    r = e.execute("shop", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey")
    return spark.createDataFrame([(*row, r.truncated) for row in r.rows], "o_orderkey bigint, o_totalprice double, truncated boolean")


@query("SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer WHERE c_custkey % 2 = 1")
def csv_union_by_name(spark, sf_dir):
    """read_csv over files with different columns."""
    base = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    customer = t(spark, sf_dir, "customer")
    sinks.write(customer.where("c_custkey % 2 = 0").select("c_custkey", "c_name"), f"{base}/a", "csv")
    sinks.write(customer.where("c_custkey % 2 = 1").select("c_mktsegment", "c_custkey"), f"{base}/b", "csv")
    out = readers.read_csv(spark, Detection(base, "local", "csv"), {"union_by_name": True, "header": True})
    return out.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_mktsegment")


WORD = "[!-~]+"


@query(" UNION ALL ".join(f"SELECT '{k}' AS category, COUNT(*) FILTER (WHERE regexp_matches(v, '{p}')) AS hits, COUNT(*) AS checked FROM (SELECT unnest(regexp_extract_all(text, '{WORD}')) AS v FROM documents)" for k, p in profile.PII_VALUES.items()))
def pii_value_shares(spark, sf_dir):
    """The patterns of personal data over all words of all documents."""
    words = t(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(f"({WORD})"))).alias("v"))
    return profile.pii_shares(words, "v").withColumnRenamed("values", "checked")


@query("SELECT CAST(MIN(l_shipdate) AS DATE) AS first, CAST(MAX(l_shipdate) AS DATE) AS last FROM lineitem")
def date_span(spark, sf_dir):
    return season_report.date_span(t(spark, sf_dir, "lineitem"), "l_shipdate")


# texts that the library emits: each is run as it is

_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "timestamp_ntz": T.TimestampNTZType()}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(c.split()[0], _TYPES[c.split()[1]]) for c in text.split(", ")])


_TABLE = {
    "orders": _schema("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
    "customer": _schema("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
    "documents": _schema("doc_id bigint, text string, lang string, source string, n_chars bigint"),
    "labels": _schema("doc_id bigint, quality int, toxic int"),
}


def emitted(name: str, sql: str, columns: dict[str, str], where: str = "") -> None:
    """Registers an emitted text as a query over `columns`: how each of its columns is compared (as is, as a type, or to so many digits)."""

    def picked(ansi: bool) -> str:
        def one(c: str, how: str) -> str:
            own = f'"{c}"' if ansi else f"`{c}`"
            return f"{own if not how else f'CAST({own} AS {how})' if how.isalpha() else sq(own, int(how))} AS {own}"

        text = sql.replace("`", '"') if ansi else re.sub("`(" + "|".join(_TABLE) + ")`", r"{\1}", sql)
        return f"SELECT {', '.join(one(c, h) for c, h in columns.items())} FROM ({text}) AS emitted{where}"

    used = [n for n in _TABLE if f"`{n}`" in sql]

    def run(spark, sf_dir):
        return spark.sql(picked(False), **{n: t(spark, sf_dir, n) for n in used})

    run.__name__ = name
    query(picked(True))(run)


def _register_texts() -> None:
    found = insights.source_queries("orders", _TABLE["orders"])
    every = dict.fromkeys(_TABLE["orders"].fieldNames(), "")
    emitted("emitted_count", found["count"], {"n": ""})
    emitted("emitted_distribution", found["distribution"], {"o_orderstatus": "", "n": ""})
    emitted("emitted_aggregate", found["aggregate"], {"total": "2", "mean": "4", "least": "2", "most": "2"})
    emitted("emitted_by_category", found["by_category"], {"o_orderstatus": "", "total": "2"})
    emitted("emitted_monthly", found["monthly"], {"month": "DATE", "n": ""})
    emitted("emitted_nulls", found["nulls"], every)
    emitted("emitted_duplicates", found["duplicates"], {"duplicates": "BIGINT"})
    repeated = found["repeats"].replace("FROM `orders`", "FROM (SELECT * FROM `orders` UNION ALL SELECT * FROM `orders` WHERE o_orderkey % 7 = 0) AS twice")
    emitted("emitted_repeats", repeated, every)
    for s in insights.suggest({n: _TABLE[n] for n in ("customer", "orders")}):
        columns = {"count": {"n": ""}, "monthly": {"month": "DATE", "total": "2"}, "top": {"total": "2"}, "distribution": {"n": ""}}[s["kind"]]
        group = re.match(r"SELECT `(\w+)`", s["sql"])
        emitted(f"suggested_{s['kind']}_{s['table']}", s["sql"], ({group[1]: ""} if group else {}) | columns)
    join = next(s["sql"] for s in insights.suggest({n: _TABLE[n] for n in ("documents", "labels")}) if s["kind"] == "join")
    emitted("suggested_join", join.removesuffix(" LIMIT 100"), {"doc_id": "", "lang": "", "quality": "", "toxic": ""})
    for k, sql in enumerate(insights.follow_ups("SELECT o_orderstatus, o_totalprice FROM `orders` WHERE o_totalprice > 1000", _schema("o_orderstatus string, o_totalprice double"))):
        emitted(f"follow_up_{k + 1}", sql, {"n": ""} if k == 0 else {"o_orderstatus": "", "o_totalprice": "2"} if k == 1 else {"o_orderstatus": "", "n": ""})


_register_texts()
