import gzip
import json
import sqlite3
import zipfile

import duckdb
import pyarrow as pa
import pyarrow.feather as feather
import pytest

from tidewright.errors import MissingDependencyError, SourceError
from tidewright.operators.explorer import Explorer
from tidewright.sources import sinks
from tidewright.sources.detect import detect, format_of, scheme_of, sniff, table_name
from tidewright.sources.readers import database_tables, read, register_folder

ROWS = [(i, ("NA", "EU", "APAC")[i % 3], i * 1.5, f"2025-01-{i % 27 + 1:02d}") for i in range(60)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id bigint, region string, amount double, order_date string")


def text(sep=","):
    return "\n".join([sep.join(("id", "region", "amount", "order_date"))] + [sep.join(map(str, r)) for r in ROWS]) + "\n"


def test_detection(tmp_path):
    (tmp_path / "a.csv").write_text(text(";"))
    d = detect(str(tmp_path / "a.csv"))
    assert (d.format, d.delimiter, d.header, d.scheme) == ("csv", ";", True, "local")
    assert sniff(b"1,2\n3,4\n")[:2] == (",", False) and sniff("n\xe9e,b\n1,2\n".encode("latin-1"))[2] == "latin-1" and sniff(b"") == (",", True, "utf-8")
    assert [scheme_of(x) for x in ("s3a://b/k", "gs://b", "abfss://c@x/y", "https://x", "/a", "hdfs://x")] == ["s3", "gcs", "azure", "http", "local", "hdfs"]
    assert format_of("x.ndjson.gz") == ("ndjson", "gzip") and format_of("x.parquet") == ("parquet", None) and format_of("x") == (None, None)
    assert [table_name(x) for x in ("/a/My File-1.csv.gz", "2024.parquet", "/x/dir/")] == ["my_file_1", "t_2024", "dir"]
    for bad in (str(tmp_path / "none.csv"), str(tmp_path)[:-1] + "*.zzz"):
        with pytest.raises(SourceError):
            detect(bad)


def test_delimited_files(spark, tmp_path):
    for name, sep in (("a.csv", ","), ("a.tsv", "\t"), ("b.csv", "|")):
        (tmp_path / name).write_text(text(sep))
        out = read(spark, str(tmp_path / name))
        assert out.count() == 60 and out.columns == ["id", "region", "amount", "order_date"] and dict(out.dtypes)["amount"] == "double", name
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write(text())
    assert read(spark, str(tmp_path / "c.csv.gz")).count() == 60
    with zipfile.ZipFile(tmp_path / "d.csv.zip", "w") as z:
        z.writestr("d.csv", text())
    assert read(spark, str(tmp_path / "d.csv.zip")).where("region = 'EU'").count() == 20
    (tmp_path / "parts").mkdir()
    (tmp_path / "parts" / "x.csv").write_text("a,b\n1,2\n")
    (tmp_path / "parts" / "y.csv").write_text("a,c\n3,4\n")
    out = read(spark, str(tmp_path / "parts"), union_by_name=True)
    assert sorted(out.columns) == ["a", "b", "c"] and out.count() == 2
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n3\n")
    assert read(spark, str(tmp_path / "bad.csv"), ignore_errors=True).count() <= 2


def test_json(spark, tmp_path):
    data = [{"id": 1, "customer": {"name": "x", "geo": {"city": "P"}}, "total": 2.0}, {"id": 2, "customer": {"name": "y", "geo": {"city": "Q"}}, "total": 3.0}]
    (tmp_path / "a.json").write_text(json.dumps(data))
    (tmp_path / "b.ndjson").write_text("\n".join(map(json.dumps, data)))
    (tmp_path / "c.json").write_text(json.dumps({"meta": 1, "data": {"rows": data}}))
    assert dict(read(spark, str(tmp_path / "a.json")).dtypes)["customer"].startswith("struct")
    assert sorted(read(spark, str(tmp_path / "a.json"), flatten=True).columns) == ["customer.geo.city", "customer.name", "id", "total"]
    assert "customer_geo" in read(spark, str(tmp_path / "b.ndjson"), flatten=True, sep="_", max_level=1).columns
    assert read(spark, str(tmp_path / "c.json"), record_path="data.rows").count() == 2


def test_parquet_orc_arrow(spark, df, tmp_path):
    sinks.write(df, str(tmp_path / "hive"), partition_by=["region"])
    d = detect(str(tmp_path / "hive"))
    assert d.format == "parquet" and d.hive_keys == ["region"]
    out = read(spark, str(tmp_path / "hive")).where("region = 'EU'")
    assert out.count() == 20 and "PartitionFilters: [isnotnull(region" in out._jdf.queryExecution().executedPlan().toString()
    sinks.write(df, str(tmp_path / "a.orc"), "orc")
    assert read(spark, str(tmp_path / "a.orc"), "orc").count() == 60
    feather.write_feather(pa.table({"a": [1, 2]}), str(tmp_path / "a.feather"))
    assert read(spark, str(tmp_path / "a.feather")).count() == 2


def test_databases(spark, df, tmp_path):
    con = sqlite3.connect(tmp_path / "a.sqlite")
    con.execute("CREATE TABLE t (id INTEGER, name TEXT, x REAL)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, f"n{i}", i / 2) for i in range(100)])
    con.commit()
    con.close()
    out = read(spark, str(tmp_path / "a.sqlite"), partitions=3)
    assert out.count() == 100 and dict(out.dtypes) == {"id": "bigint", "name": "string", "x": "double"} and out.selectExpr("sum(id)").first()[0] == 4950
    sinks.write(df, str(tmp_path / "a.duckdb"), "duckdb", "orders")
    assert database_tables(str(tmp_path / "a.duckdb"), "duckdb") == ["orders"] and duckdb.connect(str(tmp_path / "a.duckdb"), read_only=True).execute("SELECT count(*) FROM orders").fetchall() == [(60,)]
    assert read(spark, str(tmp_path / "a.duckdb"), table="orders").where("amount > 30").count() == 39
    with pytest.raises(SourceError):
        read(spark, str(tmp_path / "a.sqlite"), table="nope")


def test_pg_dump(spark, tmp_path):
    (tmp_path / "d.sql").write_text("SET x;\nCOPY public.t (id, \"name\") FROM stdin;\n1\ta\n2\t\\N\nwrong\n3\tc\td\n\\.\nCOPY u (id) FROM stdin;\n9\n\\.\n")
    assert sorted(tuple(r) for r in read(spark, str(tmp_path / "d.sql")).collect()) == [("1", "a"), ("2", None)]


def test_missing_formats(spark, tmp_path):
    (tmp_path / "a.avro").write_bytes(b"x")
    for fmt in ("avro", "delta", "iceberg", "snowflake", "trino"):
        with pytest.raises(MissingDependencyError):
            read(spark, str(tmp_path / "a.avro"), fmt)
    with pytest.raises(SourceError):
        read(spark, str(tmp_path / "a.avro"), "nonsense")


def test_sql_script(spark, df, tmp_path):
    rows = df.limit(7).selectExpr("id", "region || '''' AS region", "CASE WHEN id > 2 THEN amount END AS amount", "id > 3 AS big")
    sinks.write(rows.coalesce(1), str(tmp_path / "out"), "sql", "t")
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT, region VARCHAR, amount DOUBLE, big BOOLEAN)")
    for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect():
        con.execute(r[0])
    assert con.execute("SELECT count(*), count(amount), count(*) FILTER (WHERE big), min(right(region, 1)) FROM t").fetchall() == [(7, 4, 3, "'")]
    assert sinks.insert_statements(df.coalesce(1), "t", 25).count() == 3
    with pytest.raises(SourceError):
        sinks.write(df, str(tmp_path / "z"), "xml")


def test_register_folder(spark, df, tmp_path):
    sinks.write(df, str(tmp_path / "orders"))
    (tmp_path / "orders.csv").write_text(text())
    (tmp_path / "people.csv").write_text("a,b\n1,x\n")
    (tmp_path / "broken.parquet").write_text("not parquet")
    e = Explorer(spark)
    errors = register_folder(spark, e, "shop", str(tmp_path))
    assert e.list_tables("shop") == ["orders", "people"] and e.row_count("shop", "orders") == 60 and list(errors) == ["broken.parquet"]
