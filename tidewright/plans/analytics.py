"""The analytic SQL pack: one text for each query, run by Spark over lazily read tables.

`{orders}` and the like name tables. A text keeps to SQL that Spark and other engines read alike: sums of money
are decimal and then double, ratios are quantised by floor, and every ordered cut has a total order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def _money(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


def _q(x: str, digits: int = 4) -> str:
    return f"FLOOR(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def _pct(part: str, whole: str) -> str:
    return _q(f"100.0e0 * ({part}) / NULLIF({whole}, 0)")


MONTH = "CAST(date_trunc('month', o_orderdate) AS DATE)"
#: Net price, exact in decimals.
NET = "CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE)"

PACK: dict[str, str] = {
    "monthly_revenue": f"""
        SELECT {MONTH} AS month, COUNT(DISTINCT o_orderkey) AS orders, {_money("o_totalprice")} AS revenue,
               CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS delivered
        FROM {{orders}} WHERE o_orderdate >= DATE '1995-01-01' GROUP BY 1 ORDER BY 1""",
    "monthly_aov": f"""
        SELECT {MONTH} AS month, {_money("o_totalprice")} AS revenue, {_q("AVG(CAST(o_totalprice AS DECIMAL(18,2)))", 2)} AS aov, COUNT(*) AS orders
        FROM {{orders}} GROUP BY 1 ORDER BY 1""",
    "yoy_growth_pivot": f"""
        WITH y AS (SELECT CAST(year(o_orderdate) AS INT) AS yr, CAST(month(o_orderdate) AS INT) AS mon, {_money("o_totalprice")} AS revenue
                   FROM {{orders}} WHERE o_orderstatus <> 'P' GROUP BY 1, 2)
        SELECT mon, MAX(CASE WHEN yr = 1996 THEN revenue END) AS r1996, MAX(CASE WHEN yr = 1997 THEN revenue END) AS r1997,
               MAX(CASE WHEN yr = 1998 THEN revenue END) AS r1998,
               {_q("100.0e0 * (MAX(CASE WHEN yr = 1998 THEN revenue END) - MAX(CASE WHEN yr = 1997 THEN revenue END)) / NULLIF(MAX(CASE WHEN yr = 1997 THEN revenue END), 0)")} AS yoy_pct
        FROM y GROUP BY mon ORDER BY mon""",
    "category_mix_pct": f"""
        SELECT p_type AS category, {NET} AS revenue, {_q(f"100.0e0 * {NET} / SUM({NET}) OVER ()")} AS pct, COUNT(*) AS lines
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey GROUP BY p_type ORDER BY p_type""",
    "category_revenue": f"""
        SELECT p_brand AS category, {NET} AS revenue, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS units
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey GROUP BY p_brand ORDER BY 2 DESC, 1""",
    "region_segment_perf": f"""
        SELECT r_name AS region, c_mktsegment AS segment, COUNT(DISTINCT o_orderkey) AS orders, {_money("o_totalprice")} AS revenue,
               {_q("AVG(CAST(o_totalprice AS DECIMAL(18,2)))", 2)} AS aov
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
        GROUP BY r_name, c_mktsegment ORDER BY 1, 2""",
    "segment_value": f"""
        SELECT c_mktsegment AS segment, COUNT(DISTINCT c_custkey) AS customers, COUNT(DISTINCT o_orderkey) AS orders, {_money("o_totalprice")} AS revenue,
               {_q(f"{_money('o_totalprice')} / NULLIF(COUNT(DISTINCT c_custkey), 0)", 2)} AS revenue_per_customer
        FROM {{customer}} JOIN {{orders}} ON o_custkey = c_custkey GROUP BY c_mktsegment ORDER BY 1""",
    "payment_mix": f"""
        SELECT l_returnflag AS method, COUNT(*) AS payments, {_money("l_extendedprice")} AS amount, {_q("AVG(CAST(l_extendedprice AS DECIMAL(18,2)))", 2)} AS avg_ticket
        FROM {{lineitem}} GROUP BY l_returnflag ORDER BY 1""",
    "top_customers_ltv": f"""
        SELECT c_custkey, c_name, c_mktsegment, COUNT(*) AS orders, {_money("o_totalprice")} AS ltv
        FROM {{customer}} JOIN {{orders}} ON o_custkey = c_custkey GROUP BY 1, 2, 3 ORDER BY ltv DESC, c_custkey LIMIT 10""",
    "priority_share": f"""
        SELECT o_orderpriority AS priority, COUNT(*) AS orders, {_q("100.0e0 * COUNT(*) / SUM(COUNT(*)) OVER ()")} AS pct
        FROM {{orders}} GROUP BY 1 ORDER BY 1""",
    "status_distribution": f"""
        SELECT o_orderstatus AS status, COUNT(*) AS orders, {_q("100.0e0 * COUNT(*) / SUM(COUNT(*)) OVER ()")} AS pct, {_money("o_totalprice")} AS value
        FROM {{orders}} GROUP BY 1 ORDER BY 1""",
    "return_rate_by_category": f"""
        SELECT p_type AS category, COUNT(*) AS lines, CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned,
               {_pct("SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)", "COUNT(*)")} AS return_pct
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey GROUP BY 1 ORDER BY 1""",
    "arpu_by_tier": f"""
        SELECT CASE WHEN c_acctbal >= 7500 THEN 'gold' WHEN c_acctbal >= 2500 THEN 'silver' ELSE 'bronze' END AS tier,
               COUNT(DISTINCT c_custkey) AS customers, {_money("o_totalprice")} AS revenue, {_q(f"{_money('o_totalprice')} / COUNT(DISTINCT c_custkey)", 2)} AS arpu
        FROM {{customer}} JOIN {{orders}} ON o_custkey = c_custkey GROUP BY 1 ORDER BY 1""",
    "mom_growth_lag": f"""
        WITH m AS (SELECT {MONTH} AS month, {_money("o_totalprice")} AS revenue FROM {{orders}} GROUP BY 1)
        SELECT month, revenue, LAG(revenue) OVER (ORDER BY month) AS previous,
               {_q("100.0e0 * (revenue - LAG(revenue) OVER (ORDER BY month)) / NULLIF(LAG(revenue) OVER (ORDER BY month), 0)")} AS growth_pct
        FROM m ORDER BY month""",
    "delivery_days_extract": f"""
        SELECT l_returnflag AS flag, COUNT(*) AS lines, {_q("AVG(CAST(EXTRACT(DAY FROM (l_shipdate - o_orderdate)) AS INT))")} AS avg_days,
               CAST(MIN(EXTRACT(DAY FROM (l_shipdate - o_orderdate))) AS INT) AS min_days, CAST(MAX(EXTRACT(DAY FROM (l_shipdate - o_orderdate))) AS INT) AS max_days
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey WHERE l_shipdate IS NOT NULL GROUP BY 1 ORDER BY 1""",
    "event_attribution": f"""
        SELECT event_type, COUNT(*) AS events, {_q("100.0e0 * COUNT(*) / SUM(COUNT(*)) OVER ()")} AS pct, COUNT(DISTINCT user_id) AS users
        FROM {{events}} GROUP BY 1 ORDER BY 1""",
    "category_month_top20": f"""
        SELECT p_brand AS category, {MONTH} AS month, {NET} AS revenue
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{part}} ON l_partkey = p_partkey
        GROUP BY 1, 2 ORDER BY revenue DESC, category, month LIMIT 20""",
    "segment_demographics": f"""
        SELECT c_mktsegment AS segment, COUNT(*) AS customers, COUNT(DISTINCT CASE WHEN c_acctbal < 0 THEN c_custkey END) AS overdrawn,
               {_q("100.0e0 * COUNT(*) / SUM(COUNT(*)) OVER ()")} AS pct, {_q("AVG(CAST(c_acctbal AS DECIMAL(18,2)))", 2)} AS avg_balance
        FROM {{customer}} GROUP BY 1 ORDER BY 1""",
    "risk_tier_case": f"""
        SELECT CASE WHEN c_acctbal < 0 THEN 'critical' WHEN c_acctbal < 2500 THEN 'high' WHEN c_acctbal < 6000 THEN 'medium' ELSE 'low' END AS tier,
               COUNT(*) AS customers, {_q("100.0e0 * COUNT(*) / SUM(COUNT(*)) OVER ()")} AS pct
        FROM {{customer}} WHERE c_acctbal IS NOT NULL GROUP BY 1 ORDER BY 1""",
    "top_parts": f"""
        SELECT p_partkey, p_name, COUNT(DISTINCT l_orderkey) AS orders, COUNT(*) AS lines, {_q("AVG(CAST(l_quantity AS DECIMAL(18,2)))", 2)} AS avg_quantity
        FROM {{part}} JOIN {{lineitem}} ON l_partkey = p_partkey GROUP BY 1, 2 ORDER BY lines DESC, p_partkey LIMIT 10""",
    "flag_status_rates": f"""
        SELECT l_returnflag AS flag, l_linestatus AS status, COUNT(*) AS lines,
               {_pct("SUM(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)", "COUNT(*)")} AS discounted_pct, {_pct("SUM(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)", "COUNT(*)")} AS bulk_pct
        FROM {{lineitem}} GROUP BY 1, 2 ORDER BY lines DESC, flag, status LIMIT 12""",
    "order_adjudication": f"""
        SELECT o_orderstatus AS status, COUNT(*) AS orders, {_money("o_totalprice")} AS billed,
               CAST(SUM(CAST(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice ELSE 0 END AS DECIMAL(18,2))) AS DOUBLE) AS urgent
        FROM {{orders}} GROUP BY 1 ORDER BY 1""",
    "supplier_performance": f"""
        SELECT s_suppkey, s_name, COUNT(*) AS lines, {NET} AS revenue, {_pct("SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)", "COUNT(*)")} AS return_pct
        FROM {{supplier}} JOIN {{lineitem}} ON l_suppkey = s_suppkey GROUP BY 1, 2 ORDER BY 4 DESC, 1 LIMIT 15""",
    "payer_mix": f"""
        SELECT n_name AS nation, COUNT(DISTINCT o_orderkey) AS orders, {_money("o_totalprice")} AS billed,
               {_q("CAST(SUM(CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END AS DECIMAL(18,2))) AS DOUBLE) / NULLIF(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 0)")} AS paid_ratio
        FROM {{nation}} JOIN {{customer}} ON c_nationkey = n_nationkey JOIN {{orders}} ON o_custkey = c_custkey GROUP BY 1 ORDER BY 1""",
    "event_abnormality": f"""
        SELECT event_type, COUNT(*) AS events, CAST(SUM(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS high, {_pct("SUM(CASE WHEN value > 50 THEN 1 ELSE 0 END)", "COUNT(*)")} AS high_pct
        FROM {{events}} GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 10""",
    "size_bucket_prevalence": f"""
        SELECT CASE WHEN p_size < 10 THEN '01-09' WHEN p_size < 20 THEN '10-19' WHEN p_size < 30 THEN '20-29' WHEN p_size < 40 THEN '30-39' ELSE '40+' END AS bucket,
               COUNT(*) AS parts, {_q("AVG(CAST(p_retailprice AS DECIMAL(18,2)))", 2)} AS avg_price
        FROM {{part}} GROUP BY 1 ORDER BY 1""",
    "priority_status_mix": """
        SELECT o_orderpriority AS priority, o_orderstatus AS status, COUNT(*) AS orders FROM {orders} GROUP BY 1, 2 ORDER BY 1, 2""",
    "geographic_distribution": f"""
        SELECT r_name AS region, n_name AS nation, c_mktsegment AS segment, COUNT(DISTINCT c_custkey) AS customers, COUNT(DISTINCT o_orderkey) AS orders
        FROM {{customer}} JOIN {{orders}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
        GROUP BY 1, 2, 3 ORDER BY orders DESC, region, nation, segment LIMIT 15""",
    "order_trend_rates": f"""
        SELECT {MONTH} AS month, COUNT(*) AS orders, {_pct("SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)", "COUNT(*)")} AS open_pct,
               {_pct("SUM(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END)", "COUNT(*)")} AS large_pct
        FROM {{orders}} GROUP BY 1 ORDER BY 1""",
    "customer_360": f"""
        WITH o AS (SELECT o_custkey, COUNT(*) AS orders, {_money("o_totalprice")} AS spent FROM {{orders}} GROUP BY o_custkey),
             l AS (SELECT o_custkey, COUNT(*) AS lines, CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned
                   FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey GROUP BY o_custkey)
        SELECT c_custkey, c_name || ' (' || c_mktsegment || ')' AS who, COALESCE(orders, 0) AS orders, spent, COALESCE(lines, 0) AS lines,
               {_q("100.0e0 * returned / NULLIF(lines, 0)")} AS return_pct
        FROM {{customer}} LEFT JOIN o ON c_custkey = o.o_custkey LEFT JOIN l ON c_custkey = l.o_custkey
        ORDER BY spent DESC NULLS LAST, c_custkey LIMIT 10""",
    "bench_group_by": f"""
        SELECT event_type AS region, COUNT(*) AS n, {_money("value")} AS total FROM {{events}} GROUP BY 1""",
    "bench_filter_limit": """
        SELECT event_id, event_type, value FROM {events} WHERE value > 90 ORDER BY event_id LIMIT 1000""",
    "daily_counts": """
        SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM {events} GROUP BY 1 ORDER BY 1""",
    "union_by_name": """
        SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, CAST(NULL AS BIGINT) AS suppkey FROM {customer}
        UNION ALL SELECT s_name, s_nationkey, NULL, s_suppkey FROM {supplier}""",
    "set_operations": """
        SELECT c_nationkey AS nation FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier} EXCEPT SELECT n_nationkey FROM {nation} WHERE n_regionkey = 0""",
    "gov_capped_select": """
        SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 101""",
    "grouping_sets_rollup": f"""
        SELECT r_name AS region, n_name AS nation, COUNT(*) AS customers, {_money("c_acctbal")} AS balance
        FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""",
}


def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The query over lazily read parquet; filters and columns reach the scans."""
    sql = PACK[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(sql)})


def oracle(name: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", PACK[name])
