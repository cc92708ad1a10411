import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewright.errors import SpecError
from tidewright.functions import samplers
from tidewright.functions.expressions import names, safe_sql
from tidewright.functions.random import Draw, permuted, weighted_index
from tidewright.graph import topological, waves
from tidewright.plans.generate import Generator, Plan, infer_sampler, plan_dataset, with_dense_row
from tidewright.plans.spec import load_spec
from tidewright.registry import SPEC


@pytest.fixture(scope="module")
def gen(spark):
    return Generator(spark, plan_dataset(load_spec(SPEC)))


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_independent_of_partitions_and_seeded(spark, gen):
    assert same(gen.frame("fact_orders", 2), gen.frame("fact_orders", 7))
    other = Generator(spark, plan_dataset(load_spec(SPEC), seed=43))
    assert not same(gen.frame("dim_customer"), other.frame("dim_customer"))
    assert same(Generator(spark, Plan.from_json(gen.plan.to_json())).frame("fact_orders"), gen.frame("fact_orders"))


def test_keys_and_inherited_columns(gen):
    f, c, card = gen.frame("fact_orders"), gen.frame("dim_customer"), gen.frame("loyalty_card")
    assert f.join(c, "customer_id", "left_anti").isEmpty() and f.select("order_id").distinct().count() == 20000
    assert f.join(c, "customer_id").where("customer_segment <> segment").isEmpty()
    assert card.select("customer_id").distinct().count() == 1500 and card.join(c, "customer_id", "left_anti").isEmpty()
    assert f.columns[:3] == ["order_id", "customer_id", "customer_segment"]


def test_distributions(gen):
    c = gen.frame("dim_customer")
    r = c.agg(F.avg((F.col("segment") == "vip").cast("int")).alias("vip"), F.avg(F.col("referral_code").isNull().cast("int")).alias("nulls"), F.bool_and(F.coalesce(F.col("referral_code").rlike(r"^R-\d{4}-[A-Z]{2}$"), F.lit(True))).alias("shape")).first()
    assert 0.03 < r.vip < 0.07 and 0.65 < r.nulls < 0.75 and r.shape
    assert c.where("(country = 'India' and city not in ('Pune', 'Delhi')) or (country = 'Ghana' and city not in ('Accra', 'Kumasi'))").isEmpty()
    assert c.where("not customer_id rlike '^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-a[0-9a-f]{3}-[0-9a-f]{12}$'").isEmpty()


def test_derived_columns(gen):
    f = gen.frame("fact_orders")
    assert f.where("abs(total - unit_price * quantity) > 1e-6 or (status = 'returned') <> (returned_ts is not null)").isEmpty()
    assert f.where("timestampdiff(MINUTE, order_ts, returned_ts) not between 60 and 2880").isEmpty()
    assert f.where("order_day_of_week <> weekday(order_ts) + 1 or order_is_weekend <> (weekday(order_ts) >= 5)").isEmpty()


def test_seasonality_shows(gen):
    f = gen.frame("fact_orders")
    n = {r.d: r.n for r in f.groupBy(F.weekday("order_ts").alias("d")).agg(F.count("*").alias("n")).collect()}
    assert n[5] > 2 * n[0]
    y = {r.y: (r.n, r.m) for r in f.groupBy(F.year("order_ts").alias("y")).agg(F.count("*").alias("n"), F.avg("revenue").alias("m")).collect()}
    assert y[2025][0] > y[2024][0] and y[2025][1] > 1.3 * y[2024][1]
    days = [r.n for r in f.groupBy(F.to_date("order_ts").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()]
    peak = f.where("date(order_ts) between '2024-11-28' and '2024-11-30'").count() / 3
    assert peak >= 3 * sorted(days)[len(days) // 2]


def test_rows_override_and_errors():
    spec = load_spec(SPEC)
    assert plan_dataset(spec, {"fact_orders": 300}).table("fact_orders").rows == 300
    with pytest.raises(SpecError):
        plan_dataset(spec, {"loyalty_card": 5000})
    for bad in (
        "tables: [{name: a, columns: []}]", "tables: [{name: a, nope: 1, columns: [{name: x}]}]", "tables: [{name: a, columns: [{name: x, null_ratio: 0.99}]}]", "tables: [{name: a, columns: [{name: x, references: b}]}]",
        "tables: [{name: a, columns: [{name: x, inherit: y as z}]}]", "tables: [{name: a, columns: [{name: x, references: b.c}]}]", "tables: [{name: a, seasonality: {anchor: q}, columns: [{name: x}]}]", "tables: [{name: a, columns: [{name: x, type: timestamp}]}]",
    ):
        with pytest.raises(SpecError):
            load_spec(bad + "\n")


def test_three_ways_to_join():
    base = "tables: [{name: p, columns: [{name: id, type: int, primary_key: true}]JOIN}, {name: c, columns: [{name: cid, type: int, primary_key: true}, {name: pid, type: int REF}]}]TOP\n"

    def refs(join="", ref="", top=""):
        return [(r.child, r.column, r.parent, r.parent_column, r.kind) for r in load_spec(base.replace("JOIN", join).replace(" REF", ref).replace("TOP", top)).references]

    want = [("c", "pid", "p", "id", "many_to_one")]
    assert refs(ref=", references: p.id") == want
    assert refs(join=', joins: [{name: c, relationship: one_to_many, sql: "{TABLE.id} = {c.pid}"}]') == want
    assert refs(top="\njoins: [{left: p.id, right: c.pid, relationship: one_to_many}]") == want
    assert refs(join=', joins: [{name: c, relationship: one_to_one, sql: "{CUBE}.id = {c}.pid"}]')[0][4] == "one_to_one"


def test_inference_order():
    assert infer_sampler("id", "int", None, True)[0] == "sequence" and infer_sampler("id", "string", {"format": "##"}, True)[0] == "uuid"
    assert infer_sampler("code", "string", {"format": "A-#"})[0] == "template" and infer_sampler("email", "string")[0] == "email"
    assert infer_sampler("x", "int", {"values": {"5": 3, "4": 1}})[1]["values"] == [5, 4]
    assert infer_sampler("unit_price", "float", {"mean": 10, "std": 5})[0] == "lognormal" and infer_sampler("x", "float", {"mean": 1})[0] == "normal" and infer_sampler("x", "other")[0] == "words"


def test_every_sampler_runs(spark):
    params = {"choice": {"values": [1, 2], "weights": [1, 0]}, "template": {"pattern": "A-##?#"}, "seasonal_date": {"factor": {"weekly": {"sat": 5}}}, "seasonal_datetime": {"factor": {"noise": {"sigma": 0.1}}}}
    df = spark.range(200)
    cols = [samplers.sample(n, Draw(1, "t", n, F.col("id")), **params.get(n, {})).alias(n) for n in samplers.SAMPLERS]
    rows = df.select(*cols).collect()
    assert all(v is not None for r in rows for v in r) and {r.choice for r in rows} == {1}
    for lam, low, high in ((3.0, 2.6, 3.4), (500.0, 495, 505)):
        m = spark.range(3000).agg(F.avg(samplers.poisson(Draw(1, "t", "p", F.col("id")), lam))).first()[0]
        assert low < m < high


def test_weights_and_permutation(spark):
    got = {r.i: r.n for r in spark.range(40000).groupBy(weighted_index(Draw(3, "t", "w", F.col("id")), [5, 0, 3, 2]).alias("i")).agg(F.count("*").alias("n")).collect()}
    assert set(got) == {0, 2, 3} and abs(got[0] / 40000 - 0.5) < 0.02
    for n in (1, 2, 10, 997, 1000):
        assert spark.range(n).select(permuted(F.col("id"), n, 17).alias("p")).distinct().where(f"p between 0 and {n - 1}").count() == n


def test_expressions():
    assert names("price * quantity - 1") == {"price", "quantity"}
    assert safe_sql("a / (b - c) / d", set("abcd")) == "`a` / NULLIF ( ( `b` - `c` ) , 0 ) / NULLIF ( `d` , 0 )"
    for bad in ("a; drop", "java_method(a)", "a + missing", "(select 1)", "a || b"):
        with pytest.raises(SpecError):
            safe_sql(bad, {"a", "b"})


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0), (4, 2)], "a bigint, b bigint")
    assert [r[0] for r in df.select(F.expr(safe_sql("a / b", {"a", "b"}))).collect()] == [None, 2.0]


def test_graph():
    assert waves("abc", [("b", "a"), ("c", "b")]) == [["a"], ["b"], ["c"]]
    assert topological("ab", [("a", "b"), ("b", "a")])[0] == "a" and topological("a", [("a", "a"), ("a", "z")]) == ["a"]


def test_dense_rows(spark):
    df = with_dense_row(spark.range(1000).withColumn("x", F.col("id") % 7), ["id"], block=100)
    assert sorted(r.row_idx for r in df.collect()) == list(range(1000))


def test_holidays_and_fiscal_parts(spark):
    from tidewright.functions.calendar import calendar_part
    from tidewright.functions.seasonality import day_weights, multipliers

    df = spark.createDataFrame([(dt.date(2025, 11, 29),), (dt.date(2025, 3, 10),), (None,)], "d date")
    got = [tuple(r) for r in df.select(*[calendar_part(F.col("d"), p, 4, "south", [dt.date(2025, 3, 10)]) for p in ("day_of_week", "is_weekend", "quarter", "fiscal_quarter", "fiscal_year", "season", "is_business_day")]).collect()]
    assert got == [(6, True, 4, 3, 2025, "Spring", False), (1, False, 1, 4, 2024, "Autumn", False), (None,) * 7]
    start, end = dt.date(2024, 2, 28), dt.date(2024, 3, 1)
    assert multipliers({"holidays": {"dates": ["2024-02-29"], "strength": 3, "window_days": 0}}, start, end) == [1.0, 3.0, 1.0]
    assert day_weights({"base": 0}, start, end) == [1 / 3] * 3
    assert multipliers({"monthly": {"shape": "month_end", "strength": 1.0}}, dt.date(2024, 1, 1), dt.date(2024, 1, 31))[-1] == 2.0


def test_plan_has_no_shuffle_and_no_python(gen):
    for t in gen.plan.tables:
        plan = gen.frame(t.name)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan


def test_parent_with_sql_text_is_joined(spark):
    spec = load_spec("""
tables:
  - name: p
    rows: 50
    columns: [{name: id, type: int, primary_key: true}, {name: a, type: int, min: 1, max: 9}, {name: twice, type: int, expr: a * 2}]
  - name: c
    rows: 400
    columns: [{name: cid, type: int, primary_key: true}, {name: pid, type: int, references: p.id, inherit: twice as p_twice}]
""")
    g = Generator(spark, plan_dataset(spec))
    assert g.frame("c").join(g.frame("p"), F.col("pid") == F.col("id")).where("p_twice = twice and twice = a * 2").count() == 400
