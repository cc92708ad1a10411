"""Lazy readers for every detected format; what Spark lacks is a Python data source, read on the executors."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import MissingDependencyError, SourceError
from .detect import Detection, detect, table_name


@dataclass
class Range(InputPartition):
    start: int
    end: int


class _DbReader(DataSourceReader):
    """Rows of a database file by ranges of rowid, so that tasks share a table."""

    def __init__(self, options: dict, schema: T.StructType, connect: Callable):
        self.path, self.table = options["path"], options["table"]
        self.parts, self.names, self.connect = int(options.get("partitions", 4)), [f.name for f in schema.fields], connect

    def partitions(self) -> list[Range]:
        con = self.connect(self.path)
        low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        con.close()
        if low is None:
            return [Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Range(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        con = self.connect(self.path)
        cols = ", ".join(quoted(n) for n in self.names)
        cursor = con.execute(f"SELECT {cols} FROM {quoted(self.table)} WHERE rowid >= ? AND rowid < ?", [partition.start, partition.end])
        while rows := cursor.fetchmany(10_000):
            yield from map(tuple, rows)
        con.close()


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _sqlite(path: str):
    import sqlite3

    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _duckdb(path: str):
    import duckdb

    return duckdb.connect(path, read_only=True)


def _spark_type(name: str) -> T.DataType:
    low = name.upper()
    m = re.match(r"DECIMAL\((\d+),\s*(\d+)\)", low)
    if m:
        return T.DecimalType(int(m[1]), int(m[2]))
    for parts, t in ((("INT", "SERIAL"), T.LongType()), (("DOUBLE", "FLOAT", "REAL"), T.DoubleType()), (("BOOL",), T.BooleanType()), (("TIMESTAMP", "DATETIME"), T.TimestampNTZType()), (("DATE",), T.DateType()), (("BLOB", "BYTEA"), T.BinaryType())):
        if any(p in low for p in parts):
            return t
    return T.StringType()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidewright_sqlite"

    def schema(self) -> T.StructType:
        con = _sqlite(self.options["path"])
        rows = con.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        con.close()
        # dates are text in this format
        kinds = [(r[1], T.StringType() if re.search("DATE|TIME", (r[2] or "").upper()) else _spark_type(r[2] or "TEXT")) for r in rows]
        return T.StructType([T.StructField(n, t) for n, t in kinds])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _DbReader(self.options, schema, _sqlite)


class DuckDbSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidewright_duckdb"

    def schema(self) -> T.StructType:
        con = _duckdb(self.options["path"])
        rows = con.execute(f"DESCRIBE {quoted(self.options['table'])}").fetchall()
        con.close()
        return T.StructType([T.StructField(r[0], _spark_type(r[1])) for r in rows])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _DbReader(self.options, schema, _duckdb)


def database_tables(path: str, kind: str) -> list[str]:
    con = {"sqlite": _sqlite, "duckdb": _duckdb}[kind](path)
    sql = "SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name" if kind == "sqlite" else "SELECT table_name FROM information_schema.tables ORDER BY table_name"
    out = [r[0] for r in con.execute(sql).fetchall()]
    con.close()
    return out


def list_files(spark: SparkSession, path: str) -> list[str]:
    """All files below a path or that a pattern matches, on any storage, in order; hidden ones and markers aside."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, out = p.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for status in fs.globStatus(p) or ():
        found = fs.listFiles(status.getPath(), True)
        while found.hasNext():
            f = found.next().getPath()
            inner = f.toString()[len(status.getPath().toString()) :]
            if not any(part.startswith(("_", ".")) for part in inner.split("/")):
                out.append(f.toString())
    return sorted(out)


def first_lines(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Each file's first line; compressed files by their codec. Empty files are left out."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def one(f: str) -> tuple[str, str | None]:
        p = jvm.org.apache.hadoop.fs.Path(f)
        stream = p.getFileSystem(conf).open(p)
        try:
            codec = codecs.getCodec(p)
            return f, jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8")).readLine()
        finally:
            stream.close()

    with ThreadPoolExecutor(16) as pool:
        return [(f, line) for f, line in pool.map(one, list_files(spark, path)) if line is not None]


def read_csv(spark: SparkSession, d: Detection, options: dict) -> DataFrame:
    r = spark.read.option("inferSchema", str(options.get("infer_schema", True)).lower()).option("sep", options.get("delimiter") or d.delimiter or ",")
    header = options.get("header", True if d.header is None else d.header)
    r = r.option("header", str(bool(header)).lower()).option("encoding", options.get("encoding") or d.encoding or "utf-8")
    r = r.option("mode", "DROPMALFORMED" if options.get("ignore_errors") else "PERMISSIVE").option("enforceSchema", "false" if header else "true")
    if options.get("union_by_name"):
        # files of one header are one read, however many they are
        by: dict[str, list[str]] = {}
        for f, line in first_lines(spark, d.path):
            by.setdefault(line, []).append(f)
        if not by:
            raise SourceError(f"no files in {d.path!r}")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r.csv(files) for files in by.values()])
    return r.option("recursiveFileLookup", str(d.is_folder and not d.hive_keys).lower()).csv(d.path)


def flatten(df: DataFrame, sep: str = ".", max_level: int | None = None) -> DataFrame:
    """Structs become columns named by their path; arrays and maps stay values."""

    def walk(fields: list[T.StructField], path: list[str], level: int) -> Iterator:
        for f in fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType) and (max_level is None or level < max_level):
                yield from walk(f.dataType.fields, here, level + 1)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here))

    return df.select(*walk(df.schema.fields, [], 0))


def read_json(spark: SparkSession, d: Detection, options: dict) -> DataFrame:
    df = spark.read.option("multiLine", str(d.format == "json").lower()).json(d.path)
    for step in [p for p in (options.get("record_path") or "").split(".") if p]:
        df = df.select(F.col(f"`{step}`"))
        if isinstance(df.schema.fields[0].dataType, T.ArrayType):
            df = df.select(F.explode(F.col(f"`{step}`")).alias(step))
        if isinstance(df.schema.fields[0].dataType, T.StructType):
            df = df.select(f"`{step}`.*")
    return flatten(df, options.get("sep", "."), options.get("max_level")) if options.get("flatten") else df


def read_parquet(spark: SparkSession, d: Detection, options: dict) -> DataFrame:
    nested = d.is_folder and not d.hive_keys and "*" not in d.path
    return spark.read.option("recursiveFileLookup", str(nested).lower()).option("mergeSchema", str(bool(options.get("union_by_name"))).lower()).parquet(d.path)


def read_pg_dump(spark: SparkSession, d: Detection, options: dict) -> DataFrame:
    """The first COPY block of a dump: all columns text, \\N is null, rows of another width are left out.

    Lines are read in parallel, from any storage: a line's place is where its split starts and its number in it.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.option("lineSep", "\n").text(d.path).select(F.regexp_replace("value", "\r$", "").alias("v"), place.alias("at"))
    start = lines.where(F.col("v").rlike(r"(?i)^COPY .* FROM stdin;\s*$")).agg(F.min(F.struct("at", "v")).alias("first")).first()["first"]
    if not start:
        raise SourceError("the dump has no COPY block")
    m = re.match(r"(?i)^COPY\s+(\S+)\s*\(([^)]*)\)\s+FROM stdin;", start["v"])
    if not m:
        raise SourceError("the COPY block names no columns")
    names = [c.strip().strip('"') for c in m[2].split(",")]

    def at(r) -> F.Column:
        return F.struct(F.lit(r["split"]).cast("bigint").alias("split"), F.lit(r["line"]).cast("bigint").alias("line"))

    block = lines.where(F.col("at") > at(start["at"]))
    end = block.where(F.col("v") == "\\.").agg(F.min("at").alias("last")).first()["last"]
    if end:
        block = block.where(F.col("at") < at(end))
    cells = F.split("v", "\t", -1)
    return block.select(cells.alias("c")).where(F.size("c") == len(names)).select(*[F.when(F.col("c")[i] != "\\N", F.col("c")[i]).alias(n) for i, n in enumerate(names)])


def read_arrow(spark: SparkSession, d: Detection, options: dict) -> DataFrame:
    import pyarrow.feather as feather

    return spark.createDataFrame(feather.read_table(d.path))


def read_excel(spark: SparkSession, d: Detection, options: dict) -> DataFrame:
    import pandas as pd

    try:
        pdf = pd.read_excel(d.path, sheet_name=options.get("sheet", 0), header=0 if options.get("header", True) else None)
    except ImportError as e:
        raise MissingDependencyError("Excel files need openpyxl.", "Install it, or save the sheet as CSV.") from e
    pdf.columns = [str(c) for c in pdf.columns]
    return spark.createDataFrame(pdf)


def read_orc(spark: SparkSession, d: Detection, options: dict) -> DataFrame:
    return spark.read.orc(d.path)


def _external(fmt: str, hint: str) -> Callable:
    def read(spark: SparkSession, d: Detection, options: dict) -> DataFrame:
        try:
            return spark.read.format(fmt).load(d.path)
        except Exception as e:
            raise MissingDependencyError(f"{fmt} is not on the class path.", hint) from e

    return read


def _database(kind: str) -> Callable:
    def read(spark: SparkSession, d: Detection, options: dict) -> DataFrame:
        names = database_tables(d.path, kind)
        name = options.get("table") or (names[0] if names else None)
        if name not in names:
            raise SourceError(f"{d.path} has no table {name!r}")
        source = SqliteSource if kind == "sqlite" else DuckDbSource
        spark.dataSource.register(source)
        return spark.read.format(source.name()).option("path", os.path.abspath(d.path)).option("table", name).option("partitions", options.get("partitions", 4)).load()

    return read


def read_jdbc(spark: SparkSession, d: Detection, options: dict) -> DataFrame:
    """options: url, dbtable or query, and Spark's own (partitionColumn, lowerBound, upperBound, numPartitions, driver)."""
    r = spark.read.format("jdbc")
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


READERS: dict[str, Callable[[SparkSession, Detection, dict], DataFrame]] = {
    "csv": read_csv, "tsv": read_csv, "json": read_json, "ndjson": read_json, "parquet": read_parquet, "orc": read_orc, "arrow": read_arrow, "excel": read_excel, "pg_dump": read_pg_dump,
    "sqlite": _database("sqlite"), "duckdb": _database("duckdb"), "avro": _external("avro", "Add the spark-avro package."), "delta": _external("delta", "Add the delta-spark package."),
    "iceberg": _external("iceberg", "Add the Iceberg runtime."), "jdbc": read_jdbc,
}
#: Sources that are known and not read.
PLACEHOLDERS = ("snowflake", "trino", "bigquery")


def read(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """A source as a lazy DataFrame, by what it is or by the format named."""
    if format in PLACEHOLDERS:
        raise MissingDependencyError(f"{format} needs its own connector.", "Read it with format('jdbc') and its driver.")
    d = Detection("", "jdbc", "jdbc") if format == "jdbc" else detect(path, format)
    if d.compression == "zip":
        return read_zip(spark, d, options)
    if d.format not in READERS:
        raise SourceError(f"unknown format {d.format!r}")
    return READERS[d.format](spark, d, options)


def read_zip(spark: SparkSession, d: Detection, options: dict) -> DataFrame:
    """Delimited or JSON lines members of a zip archive: members are unpacked where they are read."""
    from .detect import sniff

    def members(it):
        import io
        import zipfile

        import pandas as pd

        for pdf in it:
            for data in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for n in z.namelist():
                        with z.open(n) as f:
                            lines = io.TextIOWrapper(f, encoding="utf-8", errors="replace", newline="")
                            while part := list(_take(lines, 10_000)):
                                yield pd.DataFrame({"value": [x.rstrip("\r\n") for x in part]})

    lines = spark.read.format("binaryFile").load(d.path).select("content").mapInPandas(members, "value string")
    if d.format in ("json", "ndjson"):
        return spark.read.json(lines.select("value").rdd.map(lambda r: r[0]))
    import zipfile

    with zipfile.ZipFile(d.path) as z, z.open(z.namelist()[0]) as f:
        delimiter, header, _ = sniff(f.read(16 * 1024))
    return spark.read.option("header", str(options.get("header", header)).lower()).option("inferSchema", "true").option("sep", options.get("delimiter", delimiter)).csv(lines.rdd.map(lambda r: r[0]))


def _take(lines, n: int):
    for _, x in zip(range(n), lines, strict=False):
        yield x


def register_folder(spark: SparkSession, explorer, dataset: str, path: str) -> dict[str, str]:
    """Registers what lies in a folder: sub-folders first, then files, parquet before json before csv; errors by name."""
    errors: dict[str, str] = {}
    rank = {"parquet": 0, "orc": 1, "ndjson": 2, "json": 3, "csv": 4, "tsv": 4}
    from .detect import format_of

    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = {s.getPath().getName(): s.isDirectory() for s in base.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(base)}
    entries = sorted(found, key=lambda n: (not found[n] and format_of(n)[0] != "parquet", rank.get(format_of(n)[0] or "", 9), n))
    for n in entries:
        name = table_name(n)
        if n.startswith((".", "_")) or name in explorer.tables.get(dataset, {}) or not found[n] and format_of(n)[0] not in rank:
            continue
        try:
            explorer.register(dataset, name, read(spark, f"{path}/{n}"))
        except Exception as e:
            errors[n] = str(e)[:300]
    return errors
