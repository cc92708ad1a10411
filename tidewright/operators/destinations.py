"""Destinations: where loads go besides plain files, from configuration blocks, with the changes that columns take on the way."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LoadError, MissingDependencyError
from ..sources import readers, sinks
from ..sources.detect import detect
from ..types import normalize_keys, snake_case
from . import load

#: Schemes of databases with a JDBC driver: the URL's start, and the driver's class.
JDBC = {
    "postgresql": ("jdbc:postgresql", "org.postgresql.Driver"),
    "postgres": ("jdbc:postgresql", "org.postgresql.Driver"),
    "redshift": ("jdbc:redshift", "com.amazon.redshift.jdbc42.Driver"),
    "mysql": ("jdbc:mysql", "com.mysql.cj.jdbc.Driver"),
    "mssql": ("jdbc:sqlserver", "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "synapse": ("jdbc:sqlserver", "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "snowflake": ("jdbc:snowflake", "net.snowflake.client.jdbc.SnowflakeDriver"),
    "clickhouse": ("jdbc:clickhouse", "com.clickhouse.jdbc.ClickHouseDriver"),
    "trino": ("jdbc:trino", "io.trino.jdbc.TrinoDriver"),
    "databricks": ("jdbc:databricks", "com.databricks.client.jdbc.Driver"),
    "athena": ("jdbc:athena", "com.amazon.athena.jdbc.AthenaDriver"),
    "cratedb": ("jdbc:postgresql", "org.postgresql.Driver"),
    "starrocks": ("jdbc:mysql", "com.mysql.cj.jdbc.Driver"),
    "derby": ("jdbc:derby", "org.apache.derby.iapi.jdbc.AutoloadedDriver"),
}
#: Schemes that Spark writes through a connector: its format, and the class that tells whether it is there.
CONNECTORS = {
    "bigquery": ("bigquery", "com.google.cloud.spark.bigquery.BigQueryRelationProvider"),
    "cassandra": ("org.apache.spark.sql.cassandra", "org.apache.spark.sql.cassandra.DefaultSource"),
    "elasticsearch": ("org.elasticsearch.spark.sql", "org.elasticsearch.spark.sql.DefaultSource15"),
    "mongodb": ("mongodb", "com.mongodb.spark.sql.connector.MongoTableProvider"),
    "iceberg": ("iceberg", "org.apache.iceberg.spark.source.IcebergSource"),
    "dynamodb": ("dynamodb", "com.audienceproject.spark.dynamodb.datasource.DefaultSource"),
    "maxcompute": ("maxcompute", "org.apache.spark.sql.odps.MaxcomputeTableProvider"),
}
#: Schemes of plain files, and how Spark's file systems name them.
FILES = {"file": "file", "s3": "s3a", "s3a": "s3a", "gs": "gs", "gcs": "gs", "adls": "abfss", "abfss": "abfss", "onelake": "abfss", "fabric": "abfss", "hdfs": "hdfs"}
CONTRACTS = ("evolve", "freeze", "discard_row", "discard_value")
NAMINGS = ("direct", "snake_case")


@dataclass
class Source:
    """A live source to replicate from."""

    uri: str
    table: str | None = None
    sql: str | None = None
    incremental_key: str | None = None
    options: dict[str, Any] = field(default_factory=dict)


@dataclass
class Destination:
    """uri may hold ${NAME} for variables of the environment. tables: names there by table; else table_prefix and the name.

    columns: "name:type", "name:type:source" or "name::source", comma-separated or a list. mask: see load.mask.
    """

    name: str
    uri: str
    table_prefix: str = ""
    tables: dict[str, str] = field(default_factory=dict)
    incremental_strategy: str = "replace"
    primary_key: list[str] = field(default_factory=list)
    incremental_key: str | None = None
    source: Source | None = None
    columns: str | list[str] | None = None
    mask: dict[str, str] = field(default_factory=dict)
    trim_whitespace: bool = False
    schema_contract: str = "evolve"
    schema_naming: str = "direct"
    partition_by: list[str] = field(default_factory=list)
    options: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if "://" not in self.uri:
            raise LoadError(f"{self.name}: {self.uri!r} is no URI")
        if self.schema_contract not in CONTRACTS or self.schema_naming not in NAMINGS:
            raise LoadError(f"{self.name}: schema_contract is one of {CONTRACTS}, schema_naming one of {NAMINGS}")
        if isinstance(self.primary_key, str):
            self.primary_key = [k.strip() for k in self.primary_key.split(",")]

    def target(self, table: str) -> str:
        return self.tables.get(table) or f"{self.table_prefix}{table}"


def _flat(block: dict) -> dict:
    """An endpoint's settings, those under `options` among them, in snake case."""
    out = normalize_keys(block)
    inner = out.pop("options", None)
    return out | (inner if isinstance(inner, dict) else {})


def _destination(name: str, source: dict | None, sink: Any) -> Destination:
    if not isinstance(sink, dict):
        raise LoadError(f"pipeline {name!r} needs a sink")
    own = _flat(sink)
    uri = own.pop("address", None) or own.pop("uri", None)
    if not uri:
        raise LoadError(f"pipeline {name!r}: the sink needs an address")
    known = {}
    table = own.pop("dest_table", None) or own.pop("table", None)
    if table and "." in str(table):
        known["tables"] = {str(table).rsplit(".", 1)[-1]: str(table)}
    elif table:
        known["table_prefix"] = str(table)
    for key in Destination.__dataclass_fields__:
        if key in own and key not in ("name", "uri", "source", "options"):
            known[key] = own.pop(key)
    if isinstance(known.get("mask"), str):
        known["mask"] = dict(x.split(":", 1) for x in known["mask"].split(","))
    live = None
    if source:
        s = _flat(source)
        address = s.pop("address", None) or s.pop("uri", None)
        if not address:
            raise LoadError(f"pipeline {name!r}: the source needs an address")
        live = Source(address, s.pop("table", None) or s.pop("source_table", None), s.pop("sql", None), s.pop("incremental_key", None), s)
    return Destination(name, uri, source=live, options=own, **known)


def destinations(config: dict) -> list[Destination]:
    """The destinations of a configuration: `destinations`, `pipeline`, `pipelines`, and the `sinks` of `workflows`, in this order."""
    raw = normalize_keys(config)
    out = [_destination(str(d.get("name") or f"destination_{i + 1}"), d.get("source"), d) for i, d in enumerate(raw.get("destinations") or [])]
    single = [raw["pipeline"]] if "pipeline" in raw else []
    for i, p in enumerate([*single, *(raw.get("pipelines") or [])]):
        if not isinstance(p, dict):
            raise LoadError("a pipeline is a mapping")
        out.append(_destination(str(p.get("name") or ("default" if i < len(single) else f"pipeline_{i + 1 - len(single)}")), p.get("source"), p.get("sink")))
    flows = raw.get("workflows") or ([raw["workflow"]] if "workflow" in raw else [])
    for i, w in enumerate(flows):
        name = str(w.get("name") or f"workflow_{i + 1}")
        sinks_ = w.get("sinks") or ([w["sink"]] if "sink" in w else [])
        out += [_destination(name if len(sinks_) == 1 else f"{name}_{k + 1}", w.get("source"), s) for k, s in enumerate(sinks_)]
    names = [d.name for d in out]
    if len(set(names)) < len(names):
        raise LoadError("destinations share a name")
    return out


def resolved(uri: str) -> str:
    """The URI with ${NAME} replaced from the environment; LoadError for a name that isn't set."""

    def value(m: re.Match) -> str:
        if m[1] not in os.environ:
            raise LoadError(f"{m[1]} is not set in the environment")
        return os.environ[m[1]]

    return re.sub(r"\$\{(\w+)\}", value, uri)


def shaped(df: DataFrame, d: Destination, existing: DataFrame | None = None) -> DataFrame:
    """Columns as the destination wants them: renamed and retyped, masked, trimmed, named; then its contract with a table that exists."""
    parts = d.columns.split(",") if isinstance(d.columns, str) else d.columns or []
    parts = re.split(r",(?![^(]*\))", d.columns) if isinstance(d.columns, str) else parts
    for part in parts:
        name, _, rest = part.strip().partition(":")
        kind, _, source = rest.partition(":")
        source = source or name
        if source not in df.columns:
            raise LoadError(f"{d.name}: no column {source!r}")
        c = F.col(f"`{source}`")
        c = c.try_cast({"json": "string", "uuid": "string"}.get(kind, kind)) if kind else c
        df = df.select(*[c.alias(name) if x == source else F.col(f"`{x}`") for x in df.columns])
    if d.mask:
        df = load.mask(df, d.mask)
    if d.trim_whitespace:
        df = df.select(*[F.trim(f"`{n}`").alias(n) if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes])
    if d.schema_naming == "snake_case":
        df = df.select(*[F.col(f"`{c}`").alias(snake_case(c)) for c in df.columns])
    if existing is None:
        return df
    extra = [c for c in df.columns if c not in existing.columns]
    if d.schema_contract == "freeze" and extra:
        raise LoadError(f"{d.name}: the table has no columns {extra}")
    if d.schema_contract == "discard_row" and extra:
        none = F.lit(True)
        for c in extra:
            none = none & F.col(f"`{c}`").isNull()
        df = df.where(none)
    if d.schema_contract in ("discard_row", "discard_value"):
        df = df.drop(*extra)
    missing = [f for f in existing.schema.fields if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def jdbc_options(uri: str) -> dict[str, str]:
    """Spark's options for a database URI: url, driver, user and password."""
    at = urlsplit(uri)
    start, driver = JDBC[at.scheme]
    place = f"//{at.hostname}{f':{at.port}' if at.port else ''}"
    url = f"{start}:{place};databaseName={at.path.lstrip('/')}" if at.scheme in ("mssql", "synapse") else f"{start}:{at.netloc}{at.path}" if at.scheme == "derby" else f"{start}:{place}{at.path}"
    out = {"url": url + (f"{';' if at.scheme in ('mssql', 'synapse', 'derby') else '?'}{at.query}" if at.query else ""), "driver": driver}
    return out | ({"user": unquote(at.username)} if at.username else {}) | ({"password": unquote(at.password)} if at.password else {})


def _have(spark: SparkSession, name: str, what: str) -> None:
    try:
        spark._jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(name)
    except Exception as e:
        raise MissingDependencyError(f"{what} needs {name}.", "Add its package to spark.jars.packages.") from e


def catalog(spark: SparkSession, uri: str) -> dict[str, list[tuple[str, str]]]:
    """The tables of a database, system ones aside, and each one's (column, type), as its driver tells them."""
    uri = resolved(uri)
    scheme = urlsplit(uri).scheme
    if scheme not in JDBC:
        raise LoadError(f"{scheme}:// is no database")
    _have(spark, JDBC[scheme][1], scheme)
    options, jvm = jdbc_options(uri), spark._jvm
    properties = jvm.java.util.Properties()
    for k in ("user", "password"):
        if k in options:
            properties.setProperty(k, options[k])
    con = jvm.java.sql.DriverManager.getConnection(options["url"], properties)
    try:
        kinds = spark.sparkContext._gateway.new_array(jvm.java.lang.String, 2)
        kinds[0], kinds[1] = "TABLE", "VIEW"
        found, out = con.getMetaData().getTables(None, None, "%", kinds), {}
        while found.next():
            out[found.getString("TABLE_NAME")] = []
        columns = con.getMetaData().getColumns(None, None, "%", "%")
        while columns.next():
            if columns.getString("TABLE_NAME") in out:
                out[columns.getString("TABLE_NAME")].append((columns.getString("COLUMN_NAME"), columns.getString("TYPE_NAME")))
        return dict(sorted(out.items()))
    finally:
        con.close()


def sample_source(spark: SparkSession, uri: str, table: str, rows: int = 1000) -> DataFrame:
    """At most `rows` rows of a database's table, cut where the database reads them. The name must be one that catalog() gives."""
    if table not in catalog(spark, uri):
        raise LoadError(f"the database has no table {table!r}")
    return read_source(spark, Source(uri, f'"{table}"' if urlsplit(uri).scheme not in ("mysql", "starrocks") else f"`{table}`"), table).limit(rows)


def read_source(spark: SparkSession, source: Source, table: str) -> DataFrame:
    """A live source's table or query: databases through JDBC, files by their format."""
    uri = resolved(source.uri)
    scheme = urlsplit(uri).scheme
    if scheme in JDBC:
        _have(spark, JDBC[scheme][1], scheme)
        what = {"query": source.sql} if source.sql else {"dbtable": source.table or table}
        return readers.read_jdbc(spark, None, jdbc_options(uri) | what | {k: str(v) for k, v in source.options.items()})
    if source.sql:
        raise LoadError(f"{scheme}: a query needs a database")
    path = _file(uri) if scheme in FILES else uri.split("://", 1)[1]
    if scheme in ("sqlite", "duckdb"):
        return readers.READERS[scheme](spark, detect(path, scheme), {"table": source.table or table})
    return readers.read(spark, path, None if scheme in FILES else scheme)


def _file(uri: str) -> str:
    scheme, _, rest = uri.partition("://")
    return rest if scheme == "file" else f"{FILES[scheme]}://{rest}"


def write_to(df: DataFrame, d: Destination, table: str) -> str:
    """Writes one table to a destination and says where. Files, DuckDB files and databases take every strategy: a database's
    table is merged beside itself and then written anew. Connectors replace and append."""
    spark, uri, name = df.sparkSession, resolved(d.uri), d.target(table)
    scheme = urlsplit(uri).scheme
    strategy = d.incremental_strategy
    spec = load.TableLoad(name, strategy, d.primary_key, d.incremental_key, partition_by=d.partition_by)
    if scheme in FILES:
        path = f"{_file(uri).rstrip('/')}/{name}"
        p, fs = load._path(spark, path)
        existing = spark.read.parquet(path) if strategy != "replace" and fs.exists(p) else None
        df = shaped(df, d, existing)
        if existing is not None and set(df.columns) - set(existing.columns):  # evolved: the table is written anew with its new columns
            if strategy == "append":
                spec = load.TableLoad(name, "replace", partition_by=d.partition_by)
                df = existing.unionByName(df, allowMissingColumns=True)
            else:
                wide = existing.unionByName(df.limit(0), allowMissingColumns=True)
                df = load.merge(wide, df, d.primary_key, d.incremental_key) if strategy == "merge" else load.delete_insert(wide, df, d.incremental_key)
                spec = load.TableLoad(name, "replace", partition_by=d.partition_by)
        load.load_table(df, path, spec)
        return path
    if scheme == "csv":
        return sinks.write(shaped(df, d), uri.split("://", 1)[1], "csv", mode="append" if strategy == "append" else "overwrite")
    if scheme == "duckdb":
        path = uri.split("://", 1)[1]
        existing = None
        if strategy != "replace" and os.path.exists(path) and name in readers.database_tables(path, "duckdb"):
            existing = readers.READERS["duckdb"](spark, detect(path, "duckdb"), {"table": name})
        df = shaped(df, d, existing)
        if existing is not None and strategy in ("merge", "delete+insert"):
            import duckdb

            keys = d.primary_key if strategy == "merge" else [d.incremental_key]
            one = load.merge(df.limit(0), df, keys, d.incremental_key) if strategy == "merge" else df
            table_, beside = readers.quoted(name), readers.quoted(f"{name}__new")
            sinks.write_duckdb(one, path, f"{name}__new")  # the file takes one connection: the tables are merged inside it
            same = " AND ".join(f"o.{readers.quoted(k)} IS NOT DISTINCT FROM n.{readers.quoted(k)}" for k in keys)
            with duckdb.connect(path) as con:
                kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE {beside}").fetchall()}
                con.execute("BEGIN")
                for c in df.columns:
                    if c not in existing.columns:
                        con.execute(f"ALTER TABLE {table_} ADD COLUMN {readers.quoted(c)} {kinds[c]}")
                con.execute(f"DELETE FROM {table_} AS o WHERE EXISTS (SELECT 1 FROM {beside} AS n WHERE {same})")
                con.execute(f"INSERT INTO {table_} BY NAME SELECT * FROM {beside}")
                con.execute(f"DROP TABLE {beside}")
                con.execute("COMMIT")
        else:
            sinks.write_duckdb(df, path, name, append=strategy == "append")
        return f"{path}#{name}"
    if scheme in JDBC:
        _have(spark, JDBC[scheme][1], scheme)
        options = jdbc_options(uri) | {k: str(v) for k, v in d.options.items()}
        url = options.pop("url")
        if strategy in ("merge", "delete+insert"):
            existing = readers.read_jdbc(spark, None, options | {"url": url, "dbtable": name})
            df = shaped(df, d, existing)
            merged = load.merge(existing, df, d.primary_key, d.incremental_key) if strategy == "merge" else load.delete_insert(existing, df, d.incremental_key)
            sinks.write_jdbc(merged, url, f"{name}__new", "overwrite", **options)  # complete beside the table before the table is touched
            df = readers.read_jdbc(spark, None, options | {"url": url, "dbtable": f"{name}__new"})
            sinks.write_jdbc(df, url, name, "overwrite", truncate="true", **options)
        else:
            sinks.write_jdbc(shaped(df, d), url, name, "append" if strategy == "append" else "overwrite", **options)
        return f"{scheme}:{name}"
    if scheme in CONNECTORS:
        kind, needed = CONNECTORS[scheme]
        _have(spark, needed, scheme)
        w = shaped(df, d).write.format(kind).mode("append" if strategy == "append" else "overwrite")
        for k, v in d.options.items():
            w = w.option(k, v)
        w.save(name)
        return f"{scheme}:{name}"
    raise LoadError(f"unknown destination {scheme}://")


def replicate(spark: SparkSession, d: Destination, table: str) -> str:
    """Copies one table of a destination's live source to it; with an incremental key of the source, by delete+insert on it."""
    if d.source is None:
        raise LoadError(f"{d.name} has no source")
    df = read_source(spark, d.source, table)
    return write_to(df, d, table)
