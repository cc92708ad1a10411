import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tidewright.errors import LoadError, MissingDependencyError, QueryTimeoutError, TidewrightError, UnsafeSqlError
from tidewright.operators import insights, load, profile, quality, season_report, semantic, sizing
from tidewright.operators.explorer import Explorer, guard_select
from tidewright.plans.generate import Generator, plan_dataset, plan_from_profiles
from tidewright.plans.spec import Reference, load_spec
from tidewright.registry import SPEC
from tidewright.types import fingerprint, normalize_dtype

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shop(spark):
    g = Generator(spark, plan_dataset(load_spec(SPEC), {"fact_orders": 3000}))
    return {"customers": g.frame("dim_customer").cache(), "orders": g.frame("fact_orders").cache()}


def test_profile_and_new_data_after_it(spark, shop):
    p = {n: profile.profile_table(df, n) for n, df in shop.items()}
    own = {c["name"]: c for c in p["customers"]["columns"]}
    assert p["customers"]["primary_key"] == "customer_id" and own["email"]["pii"]["level"] == "likely" and own["city"]["pii"]["level"] == "none"
    assert own["segment"]["distinct"] == 3 and own["segment"]["top_values"][0]["value"] == "consumer" and 0 < own["segment"]["entropy"] < 1.6
    refs = profile.reference_candidates({n: df.columns for n, df in shop.items()}, {n: x["primary_key"] for n, x in p.items()})
    assert [(r.child, r.column, r.parent, r.parent_column) for r in refs] == [("orders", "customer_id", "customers", "customer_id")]
    assert profile.confirm_reference(shop["orders"], refs[0], shop["customers"]) > 0.9
    plan = plan_from_profiles(list(p.values()), refs, {"customers": 500, "orders": 2000}, seed=1)
    g = Generator(spark, plan)
    assert g.frame("orders").join(g.frame("customers"), "customer_id", "left_anti").isEmpty()
    assert g.frame("customers").join(shop["customers"], "email", "left_semi").count() < 5
    rules = quality.derive_rules(p["orders"], refs)
    got = quality.evaluate(shop["orders"], rules, {"customers": shop["customers"]})
    assert quality.score(got) >= 95 and all(r["passed"] for r in got if r["rule_type"] == "foreign_key")


def test_profile_of_nothing(spark):
    df = spark.createDataFrame([], "a int, b string, c array<int>, d double")
    s = {r["column"]: r for r in profile.column_stats(df).collect()}
    assert s["a"]["rows"] == 0 and s["a"]["null_ratio"] == 0 and s["d"]["mean"] is None
    assert profile.top_values(df).count() == 0 and profile.duplicate_rows(df).first()["duplicates"] == 0
    assert quality.ingestion_warnings(profile.profile_table(df, "t"))[0]["code"] == "empty_table"


def test_pii_levels():
    assert profile.classify_pii("contact", ["a@b.org", "c.d@e.com"])[:2] == ("likely", "email")
    assert profile.classify_pii("email", ["a@b.org"])[2] == 0.99
    assert profile.classify_pii("when", ["2024-01-02", "2024-01-03"])[0] == "none" and profile.classify_pii("phone", [], True)[:2] == ("possible", "phone")
    assert profile.classify_pii("product_name", ["x"])[0] == "none" and profile.classify_pii("full_name", ["x"])[0] == "possible"
    # up to 17 digits look like a phone number first
    assert profile.classify_pii("n", ["4111111111111111"])[1] == "phone" and profile.classify_pii("n", ["6304000000000000000"])[1] == "credit_card" and profile.classify_pii("n", ["6304000000000000001"])[1] is None


def test_quality_failures(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 5.0, "z"), (None, 900.0, "a")], "id int, x double, k string")
    rules = [quality._rule("unique", "id"), quality._rule("not_null", "x", tolerance=0.1), quality._rule("range", "x", min=0, max=10, tolerance=0.1), quality._rule("accepted_values", "k", values=["a"], tolerance=0.1), quality._rule("not_null", "gone"), quality._rule("foreign_key", "id", parent_table="p", parent_column="id"), {"rule_type": "odd", "category": "validity", "params": {"column": "x"}}]
    got = quality.evaluate(df, rules, {"p": df.where("id is not null").limit(0)})
    assert [r["passed"] for r in got] == [False, False, False, False, False, False, True]
    assert [r["passed"] for r in quality.evaluate(df, rules[5:6])] == [True]
    assert quality.score([]) == 100.0


def test_season_report(spark):
    plan = plan_dataset(load_spec(SPEC))
    f = Generator(spark, plan).frame("fact_orders")
    c = next(c for c in plan.table("fact_orders").columns if c.name == "order_ts")
    factor = c.params["factor"]
    r = season_report.season_report(f, "order_ts", factor, "2024-01-01", "2025-12-31", parent=(f, "order_ts"))
    assert r["score"] >= 70 and {x["category"] for x in r["checks"]} == {"density", "weekly", "events", "trend", "cross_table"} and len(r["daily"]) == 731
    flat = season_report.season_report(f, "order_ts", {}, "2024-01-01", "2024-12-31")
    assert not next(x for x in flat["checks"] if x["category"] == "weekly")["passed"]
    assert len(season_report.preview_curve(factor, "2024-01-01", "2025-12-31")) <= 120


@pytest.mark.parametrize("sql", ["", "DROP TABLE t", "SELECT 1; SELECT 2", "INSERT INTO t VALUES (1)", "WITH x AS (SELECT 1) DELETE FROM t", "SELECT * FROM read_csv('x')", "SELECT * FROM parquet.`/etc`", "COPY t TO 'x'", "SELECT java_method('java.lang.System', 'exit', 0)", "SET a = 1", "EXPLAIN SELECT 1"])
def test_guard_refuses(sql):
    with pytest.raises(UnsafeSqlError):
        guard_select(sql)


@pytest.mark.parametrize("sql", ["SELECT 1", "  with a as (select 1) select * from a;", "SELECT replace(name, 'a', 'b') FROM t", "SELECT 'drop; table' AS x, updated_at FROM t".replace(";", "")])
def test_guard_accepts(sql):
    assert guard_select(sql)


PAIRS = "SELECT sum(sqrt(a.id * b.id)) FROM range(3000000) a, range(300000) b"


@pytest.mark.parametrize("limit", [0.0, 0.05, 2.0])
def test_late_queries_end(spark, limit):
    e = Explorer(spark, timeout_s=limit, scan_limit=10**18)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", "mine")
    # the main job of the second statement starts after that of its broadcast
    for sql in (PAIRS, "SELECT /*+ BROADCAST(b) */ sum(sqrt(a.id * b.k)) FROM range(3000000) a JOIN (SELECT id % 9 AS k, count(*) AS n FROM range(3000000) GROUP BY 1) b ON a.id > b.k CROSS JOIN range(200000)"):
        began = time.time()
        with pytest.raises(QueryTimeoutError):
            e.execute("shop", sql)
        assert time.time() - began < limit + 20
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == "mine"
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert e.log[-1]["status"] == "timeout" and spark.range(10).count() == 10
    deadline = time.time() + 20
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() < deadline:
        time.sleep(0.1)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_scan_guard_reads_the_plan(spark):
    e = Explorer(spark, scan_limit=100_000)
    e.register("shop", "orders", spark.read.parquet(f"{DIR}/orders.parquet"))
    e.register("shop", "customer", spark.read.parquet(f"{DIR}/customer.parquet"))
    assert e.execute("shop", "SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey").rows == [(1500,)]
    for sql in ("SELECT count(*) FROM range(100001)", "SELECT count(*) FROM orders a, orders b", "SELECT count(*) FROM orders a JOIN orders b ON a.o_totalprice < b.o_totalprice"):
        with pytest.raises(UnsafeSqlError):
            e.execute("shop", sql)
    assert e.scanned_rows("shop", e.frame("shop", "SELECT 1 FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey")) == 1500
    with pytest.raises(Exception, match="UNSUPPORTED_DATASOURCE_FOR_DIRECT_QUERY|TABLE_OR_VIEW_NOT_FOUND"):
        e.execute("shop", "SELECT * FROM `org.apache.spark.sql.parquet`.`/root/testdata/sf0.001/orders.parquet`")
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_explorer(spark, tmp_path):
    e = Explorer(spark, row_cap=10, export_dir=str(tmp_path))
    e.register("shop", "orders", spark.read.parquet(f"{DIR}/orders.parquet"))
    r = e.execute("shop", "SELECT o_orderkey FROM orders ORDER BY 1")
    assert r.truncated and len(r.rows) == 10 and e.execute("shop", "SELECT count(*) FROM orders").rows == [(1500,)]
    assert len(e.execute("shop", "SELECT o_orderkey FROM orders", sample=True).rows) == 10
    for bad in ("DELETE FROM orders", "SELECT ("):
        with pytest.raises(UnsafeSqlError):
            e.execute("shop", bad)
    e.scan_limit = 100
    with pytest.raises(UnsafeSqlError):
        e.execute("shop", "SELECT * FROM orders")
    e.scan_limit = 10**9
    with pytest.raises(UnsafeSqlError):
        e.execute("shop", PAIRS)
    e.scan_limit, e.timeout_s = 10**18, 0.3
    with pytest.raises(QueryTimeoutError):
        e.execute("shop", PAIRS)
    assert [x["status"] for x in e.log] == ["ok", "ok", "ok", "rejected", "rejected", "rejected", "rejected", "timeout"] and e.audit_frame().count() == 8
    e.timeout_s, e.scan_limit = 60, 10**9
    assert spark.read.parquet(e.export("shop", "SELECT * FROM orders", "out.parquet")).count() == 1500
    for name in ("../x", "a/b", ""):
        with pytest.raises(TidewrightError):
            e.export("shop", "SELECT 1", name)
    assert e.describe("shop", "orders")[0]["name"] == "o_orderkey" and "CREATE TABLE" in e.ddl("shop", "orders") and e.explain("shop", "SELECT * FROM orders")["rows"] == 1500
    with pytest.raises(TidewrightError):
        e.preview("shop", "nope")


def test_loads(spark, tmp_path):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, v string, day int")
    b = spark.createDataFrame([(2, "B", 2), (3, "C", 3), (3, "C", 3)], "id int, v string, day int")

    def now(name):
        return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}").collect())

    for strategy, want in (("replace", 3), ("append", 5), ("merge", 3), ("delete+insert", 4)):
        t = load.TableLoad(strategy.replace("+", "_"), strategy, ["id"], "day")
        path = f"{tmp_path}/{t.name}"
        load.load_table(a, path, load.TableLoad(t.name))
        load.load_table(b, path, t)
        assert len(now(t.name)) == want, strategy
        if strategy == "merge":
            load.load_table(b, path, t)
            assert now(t.name) == [(1, "a", 1), (2, "B", 2), (3, "C", 3)]
    frames = {"p": a, "c": b}
    refs = [Reference("c", "id", "p", "id")]
    r = load.run_load(frames, str(tmp_path / "w"), [load.TableLoad("c"), load.TableLoad("p")], refs)
    assert [(x["table"], x["status"], x["wave"]) for x in r] == [("p", "ok", 0), ("c", "ok", 1)]
    r = load.run_load({"c": b}, str(tmp_path / "x"), [load.TableLoad("c"), load.TableLoad("p")], refs)
    assert [x["status"] for x in r] == ["failed"]
    with pytest.raises(LoadError):
        load.run_load(frames, str(tmp_path), [], [], gate=lambda: 90.0)
    for bad in (("x", "odd"), ("x", "merge"), ("x", "delete+insert")):
        with pytest.raises(LoadError):
            load.TableLoad(*bad)
    assert load.within(b, "day", 3).count() == 2 and load.partition_hint({"a": "int", "created_at": "datetime"}, None, "merge") == "created_at" and load.partition_hint({"d": "date"}, 10, "merge") is None
    assert load.mask(a, {"v": "hash"}).first().v != "a"


def test_streams(spark, tmp_path):
    from tidewright.streaming import windows

    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 5), "a"), (2, dt.datetime(2024, 1, 1, 0, 40), "a"), (2, dt.datetime(2024, 1, 1, 0, 41), "a"), (3, dt.datetime(2024, 1, 1, 2, 0), "b")], "id int, ts timestamp, k string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = windows.file_stream(spark, f"{tmp_path}/in", 1)
    got = windows.drain(windows.windowed_counts(stream, "ts", ["k"], "1 hour"), f"{tmp_path}/c1")
    assert sorted((r.k, r.n) for r in got.collect()) == [("a", 3), ("b", 1)]
    assert sorted(r.n for r in windows.session_counts(rows, "ts", ["k"], "30 minutes").collect()) == [1, 1, 2]
    got = windows.drain(windows.deduplicated(windows.file_stream(spark, f"{tmp_path}/in"), "ts", ["id"], "1 day"), f"{tmp_path}/c2", "append")
    assert sorted(r.id for r in got.collect()) == [1, 2, 3] and windows.deduplicated(rows, "ts", ["id"], "1 day").count() == 3
    q = windows.merge_stream(windows.file_stream(spark, f"{tmp_path}/in", 1), f"{tmp_path}/out", load.TableLoad("t", "merge", ["id"]), f"{tmp_path}/c3")
    q.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3] and windows.progress(q)["batchId"] >= 0


def test_insights_and_model(spark):
    frames = {n: spark.read.parquet(f"{DIR}/{n}.parquet") for n in ("orders", "customer", "lineitem")}
    schemas = {n: f.schema for n, f in frames.items()}
    for n, f in frames.items():
        f.createOrReplaceTempView(n)
    for s in insights.suggest(schemas):
        assert spark.sql(s["sql"]).limit(1).count() == 1
    for sql in insights.source_queries("orders", schemas["orders"]).values():
        assert spark.sql(sql).limit(1).count() == 1
    for sql in insights.follow_ups("SELECT * FROM orders", schemas["orders"]):
        assert spark.sql(sql).limit(1).count() == 1
    assert insights.answerable("how many orders are there", schemas)["table"] == "orders" and not insights.answerable("weather", schemas)["answerable"]
    assert any("on average" in x for x in insights.explain_result(frames["orders"].select("o_totalprice")))
    up = spark.createDataFrame([(i, float(i)) for i in range(6)], "k int, v double")
    assert insights.monotonic(up, "k", "v").first()["trend"] == "increasing"
    m = semantic.build_model(schemas, [Reference("orders", "o_custkey", "customer", "c_custkey")], {"orders": "o_orderkey", "customer": "c_custkey", "lineitem": None})
    assert m["entities"]["orders"]["kind"] == "fact" and m["entities"]["customer"]["kind"] == "dimension"
    assert "cubes:" in semantic.render_yaml(m, "cube") and "entities:" in semantic.render_yaml(m) and "## orders" in semantic.data_dictionary(schemas)
    with pytest.raises(ValueError):
        semantic.query(m, frames, "customer", ["count"], ["lineitem.l_returnflag"])


def test_sizing():
    r = sizing.sizing_report(plan_dataset(load_spec(SPEC), {"fact_orders": 20_000_000}))
    assert r["dominant"] == "fact_orders" and r["fits"] and any("20000000" in w for w in r["warnings"])
    assert next(t for t in r["tables"] if t["table"] == "fact_orders")["advice"]["column"] == "order_ts" and sizing.size_class(10**8) == "xlarge"


def test_types(spark):
    assert [normalize_dtype(x) for x in ("BIGINT", "decimal(3,1)", "timestamp_ntz", "date", "varchar(3)", "blob", "interval", "boolean")] == ["int", "float", "datetime", "date", "string", "other", "int", "bool"]
    a, b = spark.range(1).schema, spark.range(1).withColumn("x", F.lit(1)).schema
    assert fingerprint({"t": a}) == fingerprint({"t": a}) != fingerprint({"t": b})


def test_keys_of_configurations():
    from tidewright.types import normalize_keys

    assert normalize_keys({"maxRows": 1, "a-b": [{"C d": 2}], "x_y": {"zZ": 3}}) == {"max_rows": 1, "a_b": [{"c_d": 2}], "x_y": {"z_z": 3}}


def test_approximate_profile_is_near(spark):
    df = spark.read.parquet(f"{DIR}/lineitem.parquet")
    a, b = ({r["column"]: r for r in profile.column_stats(df, e).collect()} for e in (True, False))
    assert all(abs(a[c]["distinct"] - b[c]["distinct"]) <= 0.1 * a[c]["distinct"] + 1 for c in a) and all(a[c]["count"] == b[c]["count"] for c in a)


def test_personal_data_is_judged_by_all_values(spark):
    df = spark.range(0, 2000, 1, 3).selectExpr(
        "id", "if(id < 1500, null, concat('u', id, '@example.org')) as contact", "if(id < 1500, null, '6304000000000000000') as ref", "if(id < 900, '', '10.0.0.1\n') as origin", "if(id < 300, '123-45-6789', 'free text') as remark", "if(id < 1500, null, '2024-01-02') as due"
    )
    got = {c["name"]: (c["pii"]["level"], c["pii"]["category"]) for c in profile.profile_table(df, "t")["columns"]}
    assert got == {"id": ("none", None), "contact": ("likely", "email"), "ref": ("likely", "credit_card"), "origin": ("likely", "phone"), "remark": ("none", None), "due": ("none", None)}
    assert {r.category: (r.hits, r["values"]) for r in profile.pii_shares(df, "contact").collect()}["email"] == (500, 500)


def test_exact_profiles_need_neither_expand_nor_value_maps(spark):
    """Distincts and medians of odd columns, against plain Python; only plain partial aggregates in the plan."""
    import decimal
    import statistics

    rng = __import__("random").Random(4)
    rows = []
    for i in range(3000):
        d = decimal.Decimal(rng.randint(-500, 500)) / 100
        rows.append((i, rng.choice([None, 1, 2, 3]), rng.choice([0.0, -0.0, 1.5, float(rng.randint(-9, 9)), None]), d, rng.choice(["a", "b", "", None]), i % 2 == 0, dt.date(2024, 1, 1 + i % 28), dt.datetime(2024, 1, 1, i % 24), b"x" * (i % 3), [i % 5], (1 << 62) + i % 7))
    df = spark.createDataFrame(rows, "k bigint, few int, x double, d decimal(9,2), s string, b boolean, day date, at timestamp, raw binary, arr array<int>, big bigint")
    got = {r["column"]: r for r in profile.column_stats(df).collect()}
    for at, name in enumerate(df.columns):
        values = [r[at] for r in rows if r[at] is not None]
        assert got[name]["distinct"] == len({tuple(v) if isinstance(v, list) else v for v in values}), name
        if name in ("k", "few", "x", "d"):
            assert got[name]["median"] == pytest.approx(float(statistics.median(values))), name
    fields = profile._simple(df)
    plan = profile._counted(df, fields, list(range(len(fields))), {0: (1.0, 2.0)})._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "median" not in plan and "percentile" not in plan and "ObjectHashAggregate" not in plan
    nan = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,), (float("nan"),), (float("nan"),)], "x double")
    assert profile.column_stats(nan).first()["distinct"] == 3
    none = {r["column"]: r for r in profile.column_stats(df.where("false")).collect()}
    assert none["k"]["distinct"] == 0 and none["k"]["median"] is None and none["k"]["null_ratio"] == 0.0 and none["k"]["uniqueness"] == 0.0


def test_a_rule_that_does_not_fit_leaves_the_others(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    rules = [quality._rule("range", "s", min=0.0, max=1.0, tolerance=0.0), quality._rule("not_null", "id"), quality._rule("unique", "id")]
    got = quality.evaluate(df, rules)
    assert [r["passed"] for r in got] == [False, True, True]

    class Lost(Exception):
        pass

    class Broken:
        columns = ["id"]

        def agg(self, *_):
            raise Lost

    with pytest.raises(Lost):
        quality.evaluate(Broken(), rules[1:])


def test_merge_with_null_keys_and_ties(spark, tmp_path):
    a = spark.createDataFrame([(1, "a", 1), (None, "n", 1)], "id int, v string, day int")
    b = spark.createDataFrame([(None, "N", 2), (2, "x", 1), (2, "y", 3), (2, "z", 2)], "id int, v string, day int")
    want = [(1, "a", 1), (2, "y", 3), (None, "N", 2)]
    once = load.merge(a, b, ["id"], "day")
    assert sorted(map(tuple, once.collect()), key=str) == want and sorted(map(tuple, load.merge(once, b, ["id"], "day").collect()), key=str) == want
    kept = {load.merge(a, b.repartition(n), ["id"]).where("id = 2").first().v for n in (1, 3, 7)}
    assert len(kept) == 1
    assert load.delete_insert(a, b, "id").where("id is null").count() == 1
    # a load that was lost between its two moves
    path = f"{tmp_path}/t"
    load.load_table(a, path, load.TableLoad("t"))
    import os

    os.rename(path, f"{path}.old-x")
    os.mkdir(f"{path}.new-y")
    load.load_table(b, path, load.TableLoad("t", "merge", ["id"], "day"))
    assert sorted((tuple(r) for r in spark.read.parquet(path).collect()), key=str) == want and sorted(os.listdir(tmp_path)) == ["t"]


def test_destinations(spark, tmp_path, monkeypatch):
    from tidewright.operators import destinations as dest

    monkeypatch.setenv("OUT", str(tmp_path))
    config = {
        "pipeline": {"sink": {"address": "file://${OUT}/a", "table": "x_", "incremental-strategy": "merge", "options": {"primary-key": "id", "schemaNaming": "snake_case"}}},
        "pipelines": [{"name": "db", "source": {"address": "file://${OUT}/in", "table": "in"}, "sink": {"uri": "duckdb://${OUT}/w.duckdb", "dest_table": "main.orders", "batchsize": 7}}],
        "workflows": [{"name": "w", "sinks": [{"uri": "derby://memory:d"}, {"uri": "csv://${OUT}/c"}]}],
    }
    got = dest.destinations(config)
    assert [(d.name, d.incremental_strategy, d.primary_key, d.target("orders")) for d in got] == [("default", "merge", ["id"], "x_orders"), ("db", "replace", [], "main.orders"), ("w_1", "replace", [], "orders"), ("w_2", "replace", [], "orders")]
    assert got[1].source.table == "in" and got[1].options == {"batchsize": 7}
    a = spark.createDataFrame([(1, " a ", 1.5)], "id int, `firstName` string, x double")
    assert dest.write_to(a, got[0], "t") == f"{tmp_path}/a/x_t"
    dest.write_to(spark.createDataFrame([(1, "b", "new"), (2, "c", None)], "id int, `firstName` string, more string"), got[0], "t")
    rows = {r.id: r for r in spark.read.parquet(f"{tmp_path}/a/x_t").collect()}
    assert rows[1].first_name == "b" and rows[1].more == "new" and rows[2].x is None
    b = dest.Destination("n", f"file://{tmp_path}/b", columns="key:bigint:id,firstName::firstName,x:decimal(9,2)", mask={"firstName": "hash"}, trim_whitespace=True)
    assert dest.shaped(a, b).dtypes == [("key", "bigint"), ("firstName", "string"), ("x", "decimal(9,2)")]
    more = spark.createDataFrame([(1, None), (2, "q")], "id int, z string")
    have = spark.createDataFrame([], "id int, y string")
    for contract, n, columns in (("evolve", 2, {"id", "y", "z"}), ("discard_row", 1, {"id", "y"}), ("discard_value", 2, {"id", "y"})):
        out = dest.shaped(more, dest.Destination("n", "file:///x", schema_contract=contract), have)
        assert out.count() == n and set(out.columns) == columns
    with pytest.raises(LoadError):
        dest.shaped(more, dest.Destination("n", "file:///x", schema_contract="freeze"), have)
    duck = dest.Destination("d", f"duckdb://{tmp_path}/w.duckdb", incremental_strategy="merge", primary_key="id")
    for rows in ([(1, "a"), (2, "b")], [(2, "B"), (3, "c")]):
        dest.write_to(spark.createDataFrame(rows, "id int, v string"), duck, "t")
    import duckdb

    with duckdb.connect(f"{tmp_path}/w.duckdb") as con:
        assert con.execute("SELECT * FROM t ORDER BY 1").fetchall() == [(1, "a"), (2, "B"), (3, "c")]
    # database to database, with the driver that Spark ships
    spark.range(5).selectExpr("cast(id as int) as id", "concat('v', id) as v").write.format("jdbc").option("url", f"jdbc:derby:{tmp_path}/src;create=true").option("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver").option("dbtable", "t").save()
    live = dest.Destination("l", f"derby://{tmp_path}/out?create=true", source=dest.Source(f"derby://{tmp_path}/src", sql="SELECT * FROM t WHERE \"id\" < 4"))
    dest.replicate(spark, live, "t")
    up = dest.Destination("l", f"derby://{tmp_path}/out", incremental_strategy="merge", primary_key="id", source=dest.Source(f"derby://{tmp_path}/src", "t"))
    dest.replicate(spark, up, "t")
    assert dest.read_source(spark, dest.Source(f"derby://{tmp_path}/out", "t"), "t").count() == 5
    assert dest.catalog(spark, f"derby://{tmp_path}/src")["T"] == [("id", "INTEGER"), ("v", "CLOB")]
    assert dest.sample_source(spark, f"derby://{tmp_path}/src", "T", 3).count() == 3
    for bad in ("t; DROP TABLE t", "nope"):
        with pytest.raises(LoadError):
            dest.sample_source(spark, f"derby://{tmp_path}/src", bad)
    with pytest.raises(MissingDependencyError):
        dest.write_to(a, dest.Destination("p", "postgresql://u:p@h/db"), "t")
    with pytest.raises(LoadError):
        dest.write_to(a, dest.Destination("p", "nowhere://x"), "t")
    for bad in ({"pipeline": {"name": "x"}}, {"pipeline": {"sink": {"table": "t"}}}, {"pipelines": [{"name": "a", "sink": {"uri": "csv://x"}}, {"name": "a", "sink": {"uri": "csv://x"}}]}):
        with pytest.raises(LoadError):
            dest.destinations(bad)
    assert dest.jdbc_options("mssql://u:p%40@h:1433/db?x=1") == {"url": "jdbc:sqlserver://h:1433;databaseName=db;x=1", "driver": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "user": "u", "password": "p@"}


def test_questions_to_sql(spark):
    from pyspark.sql import types as T

    from tidewright.operators import insights

    tables = {"orders": T.StructType.fromDDL("id bigint, total double, mail string"), "customer": T.StructType.fromDDL("id bigint")}
    profiles = {"orders": {"primary_key": "id", "columns": [{"name": "mail", "pii": {"level": "likely"}, "top_values": [{"value": "a@b.c"}]}]}}
    prompt = insights.schema_prompt(tables, profiles, [Reference("orders", "id", "customer", "id")])
    assert "mail string (personal)" in prompt and "id int (key)" in prompt and "a@b.c" not in prompt and "orders.id refers to customer.id" in prompt
    assert insights.question_to_sql("how many orders?", tables)["sql"] == "SELECT * FROM orders LIMIT 10"

    def says(text):
        return lambda prompt, question: text

    got = insights.question_to_sql("q", tables, says('Sure: ```json\n{"sql": "WITH x AS (SELECT id FROM orders) SELECT count(*) FROM x", "confidence": 7, "tables_used": ["orders"]}\n```'))
    assert got["confidence"] == 1.0 and got["tables_used"] == ["orders"]
    for bad in ("no json", '{"sql": "DROP TABLE orders"}', '{"sql": "SELECT * FROM nope"}', '{"sql": "SELECT 1", "tables_used": ["nope"]}', "{not json}", '{"sql": null}'):
        with pytest.raises(TidewrightError):
            insights.question_to_sql("q", tables, says(bad))


def test_partitions_follow_the_span():
    assert sizing.months_between("2024-01-31", "2024-02-01") == 2 and sizing.months_between("2020-01-01", "2025-12-31") == 72 and sizing.months_between("2024-05-01", "2024-01-01") == 1
    r = sizing.sizing_report(plan_dataset(load_spec(SPEC), {"fact_orders": 20_000_000}))
    assert next(t for t in r["tables"] if t["table"] == "fact_orders")["advice"]["partitions"] == 24
    c = {t["table"]: t for t in r["complexity"]["tables"]}
    assert c["fact_orders"]["costs"]["customer_id"] == "parent" and c["fact_orders"]["costs"]["total"] == "formula" and c["dim_customer"]["costs"]["email"] == "text" and not r["complexity"]["warnings"]


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from tidewright.storage import shared_dir

    for master, set_to in (("spark://h:7077", None), ("yarn", None), ("k8s://x", "s3a://b/c")):
        spark = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None, v=set_to: v or d), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
        if set_to:
            assert shared_dir(spark) == set_to
        else:
            with pytest.raises(RuntimeError):
                shared_dir(spark)
