import json

import pytest

from tidewright.errors import LoadError, TidewrightError
from tidewright.operators import reports
from tidewright.plans.spec import Reference
from tidewright.registry import SPEC
from tidewright.workspace import Workspace


def test_from_files_to_new_data(spark, tmp_path):
    (tmp_path / "customers.csv").write_text("customer_id,email,city\n" + "\n".join(f"{i},u{i}@example.org,{'AB'[i % 2]}" for i in range(1, 101)))
    (tmp_path / "orders.csv").write_text("order_id,customer_id,total_amount,status\n" + "\n".join(f"{i},{i % 100 + 1},{i * 1.25},{('done', 'open')[i % 2]}" for i in range(1, 501)))
    w = Workspace(spark)
    r = w.ingest(str(tmp_path / "customers.csv"))
    assert r["rows"] == 100 and r["format"] == "csv" and json.dumps(r, default=str) and r["duplicates"] == 0
    w.ingest(str(tmp_path / "orders.csv"))
    assert [(x.child, x.parent, c > 0.9) for x, c in w.infer_references()] == [("orders", "customers", True)]
    assert w.search("EMAIL") == [("customers", "email")] and ("orders", None) in w.search("order")
    assert w.quality("orders")["score"] >= 95 and w.query("SELECT count(*) FROM orders JOIN customers USING (customer_id)").rows == [(500,)]
    assert {r.city: r["count"] for r in w.measures("orders", ["count"], ["customers.city"]).withColumnRenamed("customers_city", "city").collect()} == {"A": 250, "B": 250}
    assert w.ask("how many orders")["table"] == "orders" and w.suggestions() and "## orders" in w.dictionary() and len(w.fingerprint()) == 64
    w.save(tmp_path / "state.json")
    again = Workspace(spark)
    again.restore(tmp_path / "state.json")
    assert again.references == w.references and again.confidence == w.confidence
    new = Workspace(spark, "new")
    new.restore(tmp_path / "state.json")
    plan = new.plan({"customers": 50, "orders": 400})
    out = new.generate(plan, str(tmp_path / "out"))
    assert out["orders"].count() == 400 and out["orders"].join(out["customers"], "customer_id", "left_anti").isEmpty()
    with pytest.raises(TidewrightError):
        Workspace(spark).plan()
    with pytest.raises(TidewrightError):
        w.table("nope")


def test_spec_generate_load_and_reports(spark, tmp_path):
    w = Workspace(spark)
    w.apply_spec(SPEC)
    plan = w.plan({"fact_orders": 2000, "dim_customer": 300, "loyalty_card": 200})
    got = w.generate_and_load(plan, str(tmp_path / "base"), 90.0)
    assert [r["table"] for r in got][0] == "dim_customer" and all(r["status"] == "ok" for r in got)
    q = w.quality("fact_orders")
    assert "Score" in reports.quality_markdown("fact_orders", q["results"], q["score"])
    s = w.seasonality("fact_orders", "order_ts", {"weekly": {"sat": 2.5, "sun": 2.0, "mon": 0.5}}, "2024-01-01", "2025-12-31")
    assert "Seasonality" in reports.season_markdown("fact_orders", s) and reports.daily_csv(s).startswith("day,n\n2024-01-01,")
    assert w.sizing(plan)["dominant"] == "fact_orders"
    w.relate(Reference("fact_orders", "order_id", "loyalty_card", "card_id"))
    assert w.confidence["fact_orders", "order_id"] == 1.0
    with pytest.raises(LoadError):
        w.generate_and_load(plan, str(tmp_path / "base2"), 100.5)


def test_keys_of_large_tables_are_exact(spark, tmp_path):
    n = 20_000
    wide = spark.range(n).selectExpr(*[f"id * {2 * k + 3} + {k} as true_{k}" for k in range(8)], *[f"greatest(id, 60) * {2 * k + 3} as near_{k}" for k in range(8)], "id % 7 as few", "if(id % 3 = 0, null, id) as some")
    w = Workspace(spark)
    w.add("wide", wide, rows=6_000_000)
    for p in (w.profile("wide"), w.profile("wide", exact=False)):
        got = {c["name"]: c for c in p["columns"]}
        assert [c["name"] for c in p["columns"] if c["pk_candidate"]] == [f"true_{k}" for k in range(8)]
        assert all(got[f"near_{k}"]["distinct"] == n - 60 for k in range(8)) and got["some"]["uniqueness"] == 1.0 and got["few"]["distinct"] == 7
    spark.range(5_000_001).selectExpr("id div 2 as v").write.parquet(str(tmp_path / "twice"))
    assert w.ingest(str(tmp_path / "twice"), exact=False)["duplicates"] == 2_500_000
