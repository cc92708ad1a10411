"""Queries of the library's own operators over the driver's tables, and SQL that must give the same rows."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.calendar import calendar_part
from .functions.seasonality import calendar_frame, multiplier_at
from .operators import insights, load, profile, quality, season_report, semantic
from .plans import analytics
from .plans.generate import Generator, plan_dataset
from .plans.spec import Reference, load_spec
from .sources.readers import flatten
from .storage import shared_dir
from .streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query under its name, with the SQL that checks it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(c, digits: int = 6):
    """Rounded half up on a grid, as the SQL does."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def sq(x: str, digits: int = 6) -> str:
    return f"FLOOR(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def union_of(columns, one: Callable[[str], str]) -> str:
    return " UNION ALL ".join(one(c) for c in columns)


# profiles

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(union_of(NUMBERS, lambda c: f"SELECT '{c}' AS \"column\", COUNT({c}) AS n, COUNT(DISTINCT {c}) AS distinct_values, {sq(f'AVG({c})', 4)} AS mean, {sq(f'stddev_samp({c})', 4)} AS std, MIN({c}) AS lo, MAX({c}) AS hi FROM lineitem"))
def profile_numeric(spark, sf_dir):
    s = profile.column_stats(t(spark, sf_dir, "lineitem").select(*NUMBERS))
    return s.select("column", F.col("count").alias("n"), F.col("distinct").alias("distinct_values"), q(F.col("mean"), 4).alias("mean"), q(F.col("std"), 4).alias("std"), F.col("min").cast("double").alias("lo"), F.col("max").cast("double").alias("hi"))


ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query(union_of(ORDERS, lambda c: f"SELECT '{c}' AS \"column\", COUNT(*) AS n, COUNT(*) - COUNT({c}) AS nulls, COUNT(DISTINCT {c}) AS distinct_values, {sq(f'COUNT(DISTINCT {c}) * 1e0 / COUNT({c})')} AS uniqueness FROM orders"))
def profile_nulls_distinct(spark, sf_dir):
    s = profile.column_stats(t(spark, sf_dir, "orders"))
    return s.select("column", F.col("rows").alias("n"), "nulls", F.col("distinct").alias("distinct_values"), q(F.col("uniqueness")).alias("uniqueness"))


@query(
    "SELECT * FROM (SELECT \"column\", value, n, ROW_NUMBER() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS place FROM ("
    + union_of(("o_orderpriority", "o_orderstatus", "o_custkey"), lambda c: f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, COUNT(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 2")
    + ")) WHERE place <= 10"
)
def profile_top_values(spark, sf_dir):
    out = profile.top_values(t(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"])
    return out.select("column", "value", F.col("count").alias("n"), F.col("rank").cast("bigint").alias("place"))


@query(
    f"SELECT \"column\", {sq('-SUM(p * log2(p))')} AS entropy FROM (SELECT \"column\", n * 1e0 / SUM(n) OVER (PARTITION BY \"column\") AS p FROM (SELECT \"column\", n, ROW_NUMBER() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS k FROM ("
    + union_of(("l_returnflag", "l_linestatus", "l_quantity"), lambda c: f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, COUNT(*) AS n FROM lineitem GROUP BY 2")
    + ")) WHERE k <= 10) GROUP BY 1"
)
def profile_entropy(spark, sf_dir):
    return profile.entropy(t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_quantity"]).select("column", q(F.col("entropy")).alias("entropy"))


@query(union_of(NUMBERS, lambda c: f"SELECT '{c}' AS \"column\", {sq(f'median({c})', 4)} AS median FROM lineitem"))
def profile_median(spark, sf_dir):
    return profile.column_stats(t(spark, sf_dir, "lineitem").select(*NUMBERS)).select("column", q(F.col("median"), 4).alias("median"))


@query()
def summarize_approx(spark, sf_dir):
    return profile.column_stats(t(spark, sf_dir, "orders"), exact=False)


REPEATED = "SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 10 = 0"


@query(f"SELECT CAST(SUM(n) AS BIGINT) AS total_rows, CAST(SUM(n - 1) AS BIGINT) AS duplicates FROM (SELECT COUNT(*) AS n FROM ({REPEATED}) GROUP BY ALL)".replace("SELECT COUNT(*) AS n FROM (", "SELECT COUNT(*) AS n FROM (").replace("GROUP BY ALL", "GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"))
def duplicate_rows(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem")
    return profile.duplicate_rows(rows.unionByName(rows.where("l_orderkey % 10 = 0"))).select(F.col("rows").alias("total_rows"), "duplicates")


CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(union_of(CUSTOMER, lambda c: f"SELECT '{c}' AS \"column\", COUNT(*) = COUNT({c}) AND COUNT(DISTINCT {c}) >= 0.999 * COUNT(*) AS is_candidate FROM customer"))
def pk_candidates(spark, sf_dir):
    return profile.pk_candidates(t(spark, sf_dir, "customer"))


EMAIL = "[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.]+"


@query(f"SELECT CAST(SUM(len(regexp_extract_all(text, '{EMAIL}'))) AS BIGINT) AS matches, COUNT(*) FILTER (WHERE regexp_matches(text, '{EMAIL}')) AS docs FROM documents")
def pii_email(spark, sf_dir):
    return profile.find_in_text(t(spark, sf_dir, "documents"), "text", EMAIL).select("matches", F.col("rows").alias("docs"))


PHONE = "[+][0-9][0-9 ().-]{6,16}"


@query(f"SELECT CAST(SUM(len(regexp_extract_all(text, '{PHONE}'))) AS BIGINT) AS matches, COUNT(*) FILTER (WHERE regexp_matches(text, '{PHONE}')) AS docs FROM documents")
def pii_phone(spark, sf_dir):
    return profile.find_in_text(t(spark, sf_dir, "documents"), "text", PHONE).select("matches", F.col("rows").alias("docs"))


@query("SELECT COUNT(*) AS candidates, COUNT(*) FILTER (WHERE list_sum([CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(c), i, 1) AS INT) ELSE (2 * CAST(substr(reverse(c), i, 1) AS INT)) // 10 + (2 * CAST(substr(reverse(c), i, 1) AS INT)) % 10 END for i in range(1, length(c) + 1)]) % 10 = 0) AS cards FROM (SELECT unnest(regexp_extract_all(text, '[0-9]{13,19}')) AS c FROM documents)")
def pii_luhn(spark, sf_dir):
    found = t(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([0-9]{13,19})"))).alias("c"))
    return found.agg(F.count("*").alias("candidates"), F.coalesce(F.sum(profile.luhn_ok(F.col("c")).cast("int")), F.lit(0)).cast("bigint").alias("cards"))


# quality, on injected faults

DIRTY = "SELECT CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey END AS o_orderkey, o_custkey, CASE WHEN o_orderkey % 17 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders"


def dirty(spark, sf_dir) -> DataFrame:
    return spark.sql(DIRTY.replace("FROM orders", "FROM {orders}"), orders=t(spark, sf_dir, "orders"))


@query(f"SELECT {sq('AVG(CASE WHEN o_orderkey IS NULL THEN 1e0 ELSE 0e0 END)')} AS null_ratio FROM ({DIRTY})")
def quality_not_null(spark, sf_dir):
    return dirty(spark, sf_dir).agg(q(quality.not_null_ratio(F.col("o_orderkey"))).alias("null_ratio"))


@query(f"SELECT {sq('COUNT(DISTINCT o_orderkey) * 1e0 / COUNT(o_orderkey)')} AS by_order, {sq('COUNT(DISTINCT o_custkey) * 1e0 / COUNT(o_custkey)')} AS by_customer FROM ({DIRTY})")
def quality_unique(spark, sf_dir):
    return dirty(spark, sf_dir).agg(q(quality.uniqueness(F.col("o_orderkey"))).alias("by_order"), q(quality.uniqueness(F.col("o_custkey"))).alias("by_customer"))


@query(f"SELECT {sq('AVG(CASE WHEN CAST(o_totalprice AS DOUBLE) < 20000 OR CAST(o_totalprice AS DOUBLE) > 300000 THEN 1e0 ELSE 0e0 END)')} AS outside FROM ({DIRTY}) WHERE o_totalprice IS NOT NULL")
def quality_range(spark, sf_dir):
    return dirty(spark, sf_dir).agg(q(quality.out_of_range(F.col("o_totalprice"), 20000, 300000)).alias("outside"))


@query(f"SELECT {sq('AVG(CASE WHEN CAST(o_orderstatus AS VARCHAR) NOT IN (' + chr(39) + 'F' + chr(39) + ',' + chr(39) + 'O' + chr(39) + ',' + chr(39) + 'P' + chr(39) + ') THEN 1e0 ELSE 0e0 END)')} AS unknown FROM ({DIRTY}) WHERE o_orderstatus IS NOT NULL")
def quality_accepted_values(spark, sf_dir):
    return dirty(spark, sf_dir).agg(q(quality.not_accepted(F.col("o_orderstatus"), ["F", "O", "P"])).alias("unknown"))


@query("SELECT COUNT(*) AS orphans FROM lineitem WHERE l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)")
def fk_orphans(spark, sf_dir):
    return quality.orphans(t(spark, sf_dir, "lineitem"), "l_orderkey", t(spark, sf_dir, "orders"), "o_orderkey").agg(F.count("*").alias("orphans"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 7 <> 0)")
def fk_orphans_injected(spark, sf_dir):
    return quality.orphans(t(spark, sf_dir, "orders"), "o_custkey", t(spark, sf_dir, "customer").where("c_custkey % 7 <> 0"), "c_custkey").select("o_orderkey", "o_custkey")


@query(f"SELECT COUNT(*) AS keys, COUNT(*) FILTER (WHERE hit) AS found, {sq('COUNT(*) FILTER (WHERE hit) * 1e0 / COUNT(*)')} AS ratio FROM (SELECT DISTINCT doc_id, doc_id IN (SELECT doc_id FROM labels) AS hit FROM documents)")
def fk_inclusion_ratio(spark, sf_dir):
    out = profile.inclusion(t(spark, sf_dir, "documents"), "doc_id", t(spark, sf_dir, "labels"), "doc_id")
    return out.select(F.col("values").alias("keys"), "found", q(F.col("ratio")).alias("ratio"))


RULES = [
    quality._rule("unique", "o_orderkey"), quality._rule("not_null", "o_orderkey", tolerance=0.0), quality._rule("not_null", "o_custkey", tolerance=0.02),
    quality._rule("range", "o_totalprice", min=0.0, max=1e9, tolerance=0.01), quality._rule("accepted_values", "o_orderstatus", values=["F", "O", "P"], tolerance=0.05),
    quality._rule("foreign_key", "o_custkey", parent_table="customer", parent_column="c_custkey"),
]


@query(f"""WITH d AS ({DIRTY}), r AS (
    SELECT 'unique' AS rule, 'integrity' AS category, COUNT(DISTINCT o_orderkey) = COUNT(o_orderkey) AS passed FROM d
    UNION ALL SELECT 'not_null_key', 'completeness', AVG(CASE WHEN o_orderkey IS NULL THEN 1e0 ELSE 0e0 END) <= 0 FROM d
    UNION ALL SELECT 'not_null_customer', 'completeness', AVG(CASE WHEN o_custkey IS NULL THEN 1e0 ELSE 0e0 END) <= 0.02 FROM d
    UNION ALL SELECT 'range', 'validity', AVG(CASE WHEN o_totalprice < 0 OR o_totalprice > 1e9 THEN 1e0 ELSE 0e0 END) <= 0.01 FROM d
    UNION ALL SELECT 'accepted', 'consistency', AVG(CASE WHEN o_orderstatus NOT IN ('F', 'O', 'P') THEN 1e0 ELSE 0e0 END) <= 0.05 FROM d
    UNION ALL SELECT 'fk', 'integrity', COUNT(*) = 0 FROM d WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)),
  c AS (SELECT category, AVG(CASE WHEN passed THEN 1e0 ELSE 0e0 END) AS share, CASE category WHEN 'integrity' THEN 0.35e0 WHEN 'consistency' THEN 0.15e0 ELSE 0.25e0 END AS weight FROM r GROUP BY category)
  SELECT {sq('100e0 * SUM(share * weight) / SUM(weight)', 2)} AS score FROM c""")
def quality_score(spark, sf_dir):
    got = quality.evaluate(dirty(spark, sf_dir), RULES, {"customer": t(spark, sf_dir, "customer")})
    return spark.createDataFrame([(quality.score(got),)], "score double")


@query("SELECT c_mktsegment AS segment, COUNT(*) AS customers FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 5000) GROUP BY 1")
def leak_semi_join(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey"))
    return t(spark, sf_dir, "customer").join(s, "c_nationkey", "left_semi").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("customers"))


@query(f"WITH a AS (SELECT o_orderpriority AS k, COUNT(*) * 1e0 / SUM(COUNT(*)) OVER () AS p FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1), b AS (SELECT o_orderpriority AS k, COUNT(*) * 1e0 / SUM(COUNT(*)) OVER () AS p FROM orders WHERE year(o_orderdate) = 1997 AND o_orderpriority NOT LIKE '5%' GROUP BY 1) SELECT {sq('0.5e0 * SUM(ABS(COALESCE(a.p, 0) - COALESCE(b.p, 0)))')} AS tvd FROM a FULL JOIN b ON a.k = b.k")
def tvd_full_join(spark, sf_dir):
    orders = t(spark, sf_dir, "orders")

    def shares(df, name):
        n = df.groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n"))
        return n.crossJoin(n.agg(F.sum("n").alias("total"))).select("k", (F.col("n") / F.col("total")).alias(name))

    a, b = shares(orders.where("year(o_orderdate) = 1996"), "p"), shares(orders.where("year(o_orderdate) = 1997 and o_orderpriority not like '5%'"), "q")
    gap = F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))
    return a.join(b, "k", "full").agg(q(0.5 * F.sum(gap)).alias("tvd"))


# calendar and seasonality

FISCAL = 4


@query(f"""SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(isodow(o_orderdate) AS INT) AS day_of_week, isodow(o_orderdate) >= 6 AS is_weekend, CAST(week(o_orderdate) AS INT) AS week,
    CAST(month(o_orderdate) AS INT) AS month, CAST(quarter(o_orderdate) AS INT) AS quarter, CAST(year(o_orderdate) AS INT) AS year, CAST((month(o_orderdate) + 12 - {FISCAL}) % 12 + 1 AS INT) AS fiscal_month,
    CAST(((month(o_orderdate) + 12 - {FISCAL}) % 12) // 3 + 1 AS INT) AS fiscal_quarter, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < {FISCAL} THEN 1 ELSE 0 END AS INT) AS fiscal_year,
    CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) <= 5 THEN 'Spring' WHEN month(o_orderdate) <= 8 THEN 'Summer' ELSE 'Autumn' END AS season FROM orders""")
def calendar_parts(spark, sf_dir):
    days = t(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    parts = ("day_of_week", "is_weekend", "week", "month", "quarter", "year", "fiscal_month", "fiscal_quarter", "fiscal_year", "season")
    return days.select("day", *[calendar_part(F.col("day"), p, FISCAL).alias(p) for p in parts])


HOLIDAYS = [dt.date(1996, 1, 1), dt.date(1996, 12, 25), dt.date(1997, 1, 1), dt.date(1997, 7, 4), dt.date(1997, 12, 25)]
_H = ", ".join(f"DATE '{d}'" for d in HOLIDAYS)


@query(f"SELECT CAST(o_orderdate AS DATE) IN ({_H}) AS is_holiday, isodow(o_orderdate) < 6 AND CAST(o_orderdate AS DATE) NOT IN ({_H}) AS is_business_day, COUNT(*) AS orders FROM orders GROUP BY 1, 2")
def holiday_business_day(spark, sf_dir):
    day = F.col("o_orderdate")
    parts = [calendar_part(day, p, holidays=HOLIDAYS).alias(p) for p in ("is_holiday", "is_business_day")]
    return t(spark, sf_dir, "orders").groupBy(*parts).agg(F.count("*").alias("orders"))


START, END = dt.date(1996, 1, 1), dt.date(1997, 12, 31)
FACTOR = {
    "base": 1.0, "trend": {"kind": "linear", "annual_growth": 0.2}, "yearly": {"amplitude": 0.1, "phase_days": 10, "peaks": [{"month": 11, "day": 28, "strength": 2.0, "width_days": 3}]},
    "weekly": {"Sat": 1.6, "Sunday": 1.4, "mon": 0.5}, "events": [{"name": "sale", "start": "1996-06-10", "end": "1996-06-20", "multiplier": 3.0}],
}
_DAYS = """SELECT CAST(range AS DATE) AS day FROM range(TIMESTAMP '1996-01-01', TIMESTAMP '1998-01-01', INTERVAL 1 DAY)"""
_FACTOR = """(1 + 0.2e0 * date_diff('day', DATE '1996-01-01', day) / 365.25e0) * (1 + 0.1e0 * sin(2 * pi() * (dayofyear(day) + 10) / 365.25e0))
    * (1 + 1e0 * exp(-0.5e0 * pow(least(abs(date_diff('day', make_date(year(day) - 1, 11, 28), day)), abs(date_diff('day', make_date(year(day), 11, 28), day)), abs(date_diff('day', make_date(year(day) + 1, 11, 28), day))) / 3e0, 2)))
    * CASE isodow(day) WHEN 6 THEN 1.6e0 WHEN 7 THEN 1.4e0 WHEN 1 THEN 0.5e0 ELSE 1e0 END * CASE WHEN day BETWEEN DATE '1996-06-10' AND DATE '1996-06-20' THEN 3e0 ELSE 1e0 END"""


@query(f"WITH d AS ({_DAYS}), w AS (SELECT day, {_FACTOR} AS m FROM d) SELECT day, {sq('m')} AS multiplier, {sq('m / SUM(m) OVER ()', 8)} AS weight FROM w")
def day_weights(spark, sf_dir):
    return calendar_frame(spark, FACTOR, START, END).select("day", q(F.col("multiplier")).alias("multiplier"), q(F.col("weight"), 8).alias("weight"))


@query(f"WITH d AS ({_DAYS}), w AS (SELECT day, {_FACTOR} AS m FROM d) SELECT o_orderkey, {sq('m')} AS multiplier FROM orders JOIN w ON CAST(o_orderdate AS DATE) = day")
def seasonal_multiplier(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").where(F.col("o_orderdate").cast("date").between(F.lit(START), F.lit(END)))
    return rows.select("o_orderkey", q(multiplier_at(F.col("o_orderdate"), FACTOR, START, END)).alias("multiplier"))


@query(f"""WITH d AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY 1), w AS (SELECT isodow(day) AS wd, AVG(n) AS m FROM d GROUP BY 1)
    SELECT {sq('COALESCE(corr(m, CASE WHEN wd >= 6 THEN 2e0 ELSE wd END), 0)')} AS r, {sq('SUM(m)', 4)} AS total FROM w""")
def weekday_profile_corr(spark, sf_dir):
    means = season_report.weekday_means(season_report.daily_counts(t(spark, sf_dir, "events"), "ts"))
    declared = F.when(F.col("weekday") >= 6, 2.0).otherwise(F.col("weekday").cast("double"))
    return means.agg(q(season_report.safe_corr(F.col("mean_n"), declared)).alias("r"), q(F.sum("mean_n"), 4).alias("total"))


@query(f"WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n FROM orders GROUP BY 1) SELECT {sq('regr_slope(n, date_diff(' + chr(39) + 'day' + chr(39) + ', DATE ' + chr(39) + '1970-01-01' + chr(39) + ', day))', 9)} AS slope FROM d")
def trend_slope(spark, sf_dir):
    return season_report.trend_slope(season_report.daily_counts(t(spark, sf_dir, "orders"), "o_orderdate")).select(q(F.col("slope"), 9).alias("slope"))


@query(f"WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n FROM orders GROUP BY 1) SELECT {sq('AVG(CASE WHEN day BETWEEN DATE ' + chr(39) + '1996-06-10' + chr(39) + ' AND DATE ' + chr(39) + '1996-06-20' + chr(39) + ' THEN n END)')} AS inside, {sq('median(n)')} AS median, {sq('AVG(CASE WHEN day BETWEEN DATE ' + chr(39) + '1996-06-10' + chr(39) + ' AND DATE ' + chr(39) + '1996-06-20' + chr(39) + ' THEN n END) / median(n)')} AS ratio FROM d")
def event_spike_ratio(spark, sf_dir):
    out = season_report.event_ratio(season_report.daily_counts(t(spark, sf_dir, "orders"), "o_orderdate"), dt.date(1996, 6, 10), dt.date(1996, 6, 20))
    return out.select(*[q(F.col(c)).alias(c) for c in ("inside", "median", "ratio")])


@query(f"""WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, day LIMIT 10), b AS (SELECT CAST(l_shipdate AS DATE) AS day, COUNT(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, day LIMIT 10)
    SELECT {sq('COUNT(*) FILTER (WHERE a.day IS NOT NULL AND b.day IS NOT NULL) * 1e0 / COUNT(*)')} AS jaccard FROM a FULL JOIN b ON a.day = b.day""")
def topk_day_jaccard(spark, sf_dir):
    a, b = season_report.daily_counts(t(spark, sf_dir, "orders"), "o_orderdate"), season_report.daily_counts(t(spark, sf_dir, "lineitem"), "l_shipdate")
    return season_report.top_day_overlap(a, b).select(q(F.col("jaccard")).alias("jaccard"))


# insights and semantics

_MONTHS = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders GROUP BY 1"


def months(spark, sf_dir) -> DataFrame:
    return spark.sql(_MONTHS.replace("FROM orders", "FROM {orders}"), orders=t(spark, sf_dir, "orders"))


@query(f"WITH m AS ({_MONTHS}), x AS (SELECT revenue - LAG(revenue) OVER (ORDER BY month) AS d FROM m) SELECT COUNT(*) FILTER (WHERE d > 0) AS ups, COUNT(*) FILTER (WHERE d < 0) AS downs, COUNT(*) AS n, CASE WHEN COUNT(*) FILTER (WHERE d > 0) >= COUNT(*) - 2 THEN 'increasing' WHEN COUNT(*) FILTER (WHERE d < 0) >= COUNT(*) - 2 THEN 'decreasing' ELSE 'mixed' END AS trend FROM x")
def monotonic_trend(spark, sf_dir):
    return insights.monotonic(months(spark, sf_dir), "month", "revenue").select(F.col("ups").cast("bigint").alias("ups"), F.col("downs").cast("bigint").alias("downs"), "n", "trend")


@query(f"WITH m AS ({_MONTHS}) SELECT 'revenue' AS \"column\", COUNT(*) - COUNT(revenue) AS nulls, {sq('SUM(revenue)', 2)} AS total, {sq('AVG(revenue)', 2)} AS mean, {sq('MIN(revenue)', 2)} AS least, {sq('MAX(revenue)', 2)} AS most, MAX(revenue) > 5 * AVG(revenue) AS outlier FROM m")
def result_insights(spark, sf_dir):
    s = insights.result_stats(months(spark, sf_dir))
    return s.select("column", "nulls", *[q(F.col(c), 2).alias(c) for c in ("total", "mean", "least", "most")], "outlier")


@query()
def role_classification(spark, sf_dir):
    rows = [(n, c, r) for n in ("customer", "orders", "lineitem", "events") for c, r in insights.roles(t(spark, sf_dir, n).schema).items()]
    return spark.createDataFrame(rows, "table_name string, column_name string, role string")


@query("SELECT c_mktsegment AS customer_c_mktsegment, o_orderstatus, COUNT(*) AS count, CAST(COUNT(DISTINCT o_orderkey) AS BIGINT) AS distinct_o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def semantic_measures(spark, sf_dir):
    frames = {n: t(spark, sf_dir, n) for n in ("orders", "customer")}
    model = semantic.build_model({n: f.schema for n, f in frames.items()}, [Reference("orders", "o_custkey", "customer", "c_custkey")], {"orders": "o_orderkey", "customer": "c_custkey"})
    return semantic.query(model, frames, "orders", ["count", "distinct_o_orderkey"], ["customer.c_mktsegment", "o_orderstatus"])


# rows and nested data


@query("SELECT DISTINCT l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS day FROM lineitem")
def dedupe_rows(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_shipdate").cast("date").alias("day")).dropDuplicates()


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract_props(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT event_id, event_type AS \"user.kind\", CAST(json_extract(props, '$.k') AS BIGINT) AS \"user.props.k\" FROM events")
def flatten_json(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("event_id", F.struct(F.col("event_type").alias("kind"), F.from_json("props", "k bigint").alias("props")).alias("user"))
    return flatten(rows)


# loads: the first rows are the table, the later ones with changed prices the source

_SOURCE = "SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'"
_TARGET = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'"


def halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    source = rows.where("o_orderdate >= timestamp_ntz'1997-01-01'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return rows.where("o_orderdate < timestamp_ntz'1998-01-01'"), source


@query(f"WITH s AS ({_SOURCE}), x AS ({_TARGET}) SELECT * FROM x WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s) UNION ALL SELECT * FROM s")
def merge_upsert(spark, sf_dir):
    return load.merge(*halves(spark, sf_dir), ["o_orderkey"])


@query(f"WITH s AS ({_SOURCE}), x AS ({_TARGET}) SELECT * FROM x WHERE o_orderdate NOT IN (SELECT o_orderdate FROM s) UNION ALL SELECT * FROM s")
def delete_insert(spark, sf_dir):
    return load.delete_insert(*halves(spark, sf_dir), "o_orderdate")


@query(f"WITH s AS ({_SOURCE}), x AS ({_TARGET}) SELECT * FROM x UNION ALL SELECT * FROM s WHERE o_orderdate < TIMESTAMP '1999-01-01'")
def append_window(spark, sf_dir):
    target, source = halves(spark, sf_dir)
    return target.unionByName(load.within(source, "o_orderdate", None, dt.datetime(1999, 1, 1)))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark, sf_dir):
    stream = windows.file_stream(spark, sf_dir, pattern="events.parquet")
    counts = windows.windowed_counts(stream, "ts", ["event_type"], "1 day")
    # state must be where all executors reach it
    return windows.drain(counts, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


# generation: rows only; tests hold the invariants

SPEC = """
tables:
  - name: dim_customer
    rows: 2000
    columns:
      - {name: customer_id, type: uuid, primary_key: true}
      - {name: full_name, type: string}
      - {name: email, type: string}
      - {name: segment, values: {consumer: 70, business: 25, vip: 5}}
      - {name: country, values: {India: 80, Ghana: 20}}
      - {name: city, values_by: {column: country, mapping: {India: {Pune: 60, Delhi: 40}, Ghana: {Accra: 90, Kumasi: 10}}}}
      - {name: referral_code, type: string, format: "R-####-??", null_ratio: 0.7}
  - name: fact_orders
    rows: 20000
    seasonality: {anchor: order_ts, trend: {annual_growth: 0.6}, weekly: {Sat: 2.5, Sun: 2.0, Mon: 0.5}, events: [{name: peak, start: 2024-11-28, end: 2024-11-30, multiplier: 6}]}
    columns:
      - {name: order_id, type: int, primary_key: true}
      - {name: customer_id, type: uuid, references: dim_customer.customer_id, inherit: segment as customer_segment}
      - {name: order_ts, type: datetime, start: 2024-01-01, end: 2025-12-31}
      - {name: quantity, type: int, mean: 3, min: 1}
      - {name: unit_price, type: float, mean: 900, std: 700, min: 10}
      - {name: total, type: float, expr: unit_price * quantity}
      - {name: status, values: {completed: 85, returned: 10, pending: 5}}
      - {name: returned_ts, type: datetime, after: {column: order_ts, min_minutes: 60, max_minutes: 2880}, null_unless: "status = 'returned'"}
      - {name: cal, calendar: {anchor: order_ts, prefix: order, parts: [day_of_week, is_weekend, quarter, season]}}
      - {name: revenue, type: float, mean: 1000, std: 150, seasonal_scale: {anchor: order_ts, trend: {annual_growth: 2.0}}}
  - name: loyalty_card
    rows: 1500
    columns:
      - {name: card_id, type: int, primary_key: true}
      - {name: customer_id, type: uuid}
joins:
  - {left: loyalty_card.customer_id, right: dim_customer.customer_id, relationship: one_to_one}
"""


def generated(spark: SparkSession, table: str) -> DataFrame:
    return Generator(spark, plan_dataset(load_spec(SPEC))).frame(table)


@query()
def generate_choice(spark, sf_dir):
    return generated(spark, "dim_customer").groupBy("segment", "country", "city").agg(F.count("*").alias("n"))


@query()
def generate_fk_chain(spark, sf_dir):
    return generated(spark, "fact_orders").join(generated(spark, "dim_customer"), "customer_id").where("customer_segment = segment").groupBy("segment").agg(F.count("*").alias("n"))


@query()
def generate_seasonal(spark, sf_dir):
    return season_report.daily_counts(generated(spark, "fact_orders"), "order_ts", dt.date(2024, 1, 1), dt.date(2025, 12, 31))


@query()
def generate_derives(spark, sf_dir):
    return generated(spark, "fact_orders")


@query()
def generate_one_to_one(spark, sf_dir):
    return generated(spark, "loyalty_card")


def _analytic(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.run(spark, sf_dir, name)


def queries() -> dict[str, Query]:
    from . import registry_laws  # noqa: F401  adds its own

    return {name: partial(_analytic, name) for name in analytics.PACK} | QUERIES


def oracle_sql() -> dict[str, str]:
    from . import registry_laws  # noqa: F401

    return {name: analytics.oracle(name) for name in analytics.PACK} | ORACLES
