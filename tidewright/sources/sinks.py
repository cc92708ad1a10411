"""Writers: parquet, CSV, JSON lines, INSERT scripts, databases, database files; all but the last write in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SourceError
from .readers import quoted

INSERT_ROWS = 500


def sql_literal(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.NumericType,)):
        text = c.cast("string")
    elif isinstance(t, T.BooleanType):
        text = F.upper(c.cast("string"))
    else:
        text = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def insert_statements(df: DataFrame, table: str, rows: int = INSERT_ROWS) -> DataFrame:
    """One INSERT of at most `rows` rows for each batch; batches are cut inside partitions, so nothing is shuffled."""
    values = F.concat(F.lit("("), F.concat_ws(", ", *[sql_literal(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]), F.lit(")"))
    start = f"INSERT INTO {quoted(table)} ({', '.join(quoted(c) for c in df.columns)}) VALUES\n"

    def batches(it):
        import pandas as pd

        left: list[str] = []
        for pdf in it:
            left += pdf["v"].tolist()
            while len(left) >= rows:
                yield pd.DataFrame({"value": [start + ",\n".join(left[:rows]) + ";"]})
                left = left[rows:]
        if left:
            yield pd.DataFrame({"value": [start + ",\n".join(left) + ";"]})

    return df.select(values.alias("v")).mapInPandas(batches, "value string")


def write(df: DataFrame, path: str, format: str = "parquet", table: str | None = None, partition_by: list[str] | None = None, mode: str = "overwrite") -> str:
    """csv, parquet (zstd), json, orc or sql in parallel parts; duckdb through Arrow batches into one file."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if format == "parquet":
        w.option("compression", "zstd").parquet(path)
    elif format == "csv":
        w.option("header", True).csv(path)
    elif format in ("json", "ndjson"):
        w.json(path)
    elif format == "orc":
        w.orc(path)
    elif format == "sql":
        insert_statements(df, table or "data").write.mode(mode).text(path)
    elif format == "duckdb":
        write_duckdb(df, path, table or "data")
    else:
        raise SourceError(f"unknown format {format!r}")
    return path


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    """Into a database through its driver, in parallel by partition; options are Spark's (driver, batchsize, numPartitions)."""
    w = df.write.format("jdbc").mode(mode).option("url", url).option("dbtable", table)
    for k, v in options.items():
        w = w.option(k, v)
    w.save()


def write_duckdb(df: DataFrame, path: str, table: str, batch: int = 100_000, append: bool = False) -> None:
    """One database file on the driver: executors pack rows into Arrow batches, which come to the driver one at a time."""
    import duckdb
    import pyarrow as pa

    def pack(batches):
        for b in batches:
            for i in range(0, b.num_rows, batch):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, b.schema) as w:
                    w.write_batch(b.slice(i, batch))
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["batch"])

    con = duckdb.connect(path)
    try:
        if not append:
            con.execute(f"DROP TABLE IF EXISTS {quoted(table)}")
        con.register("__batch", df.limit(0).toArrow())
        con.execute(f"CREATE TABLE IF NOT EXISTS {quoted(table)} AS SELECT * FROM __batch")
        con.unregister("__batch")
        for r in df.mapInArrow(pack, "batch binary").toLocalIterator(prefetchPartitions=True):
            con.register("__batch", pa.ipc.open_stream(bytes(r["batch"])).read_all())
            con.execute(f"INSERT INTO {quoted(table)} BY NAME SELECT * FROM __batch")
            con.unregister("__batch")
    finally:
        con.close()
