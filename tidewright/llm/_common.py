"""What the operators of this subpackage share: table access, shared storage, Arrow mapping."""

from __future__ import annotations

import gc
import os
import re
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import shared_dir

#: A-Z to a-z and nothing else; lower() would also change other alphabets.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Share of the heap that the driver may take, beyond which its garbage is collected between two steps.
HEAP_SHARE = 0.5


def trim(spark: SparkSession) -> bool:
    """Gives the system back what the driver's native allocator has freed but kept; False where the JVM has no such command.

    The threads of hundreds of stages each have pools of it, which grow with the number of steps, beyond the heap's size.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    named = jvm.java.lang.Class.forName
    kinds, given = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = named(kind)
    try:
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        named("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(server, given)
    except Py4JError:
        return False
    return True


def tidy(spark: SparkSession) -> None:
    """Collects the driver's garbage where its heap has grown beyond HEAP_SHARE: plans, broadcasts and shuffles that
    nothing holds go, and the heap shrinks again. Left alone it grows with the number of steps, up to its bound. Then
    freed native memory goes back to the system, which no bound of the heap holds down."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        gc.collect()
        spark._jvm.java.lang.System.gc()
    trim(spark)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage and survives lost executors.

    The table goes by discard(), or when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    tidy(spark)
    return out


def discard(*written: DataFrame) -> None:
    """Deletes tables of materialise() whose last reader is done."""
    for df in written:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads, by their listing."""
    spark = df.sparkSession
    total = 0
    for f in df.inputFiles():
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        total += p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
    return total


#: A table is broadcast up to this many bytes as rows in memory, and joined otherwise; the driver holds each several times over.
BROADCAST_BYTES = 4 << 20


def row_bytes(df: DataFrame) -> int:
    """Bytes that the rows of a table take in a hash relation, about: what is stored may be compressed many times over."""
    width = F.lit(24)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width += F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif isinstance(f.dataType, T.ArrayType):
            width += 8 * F.greatest(F.size(c), F.lit(0)) + 24
        else:
            width += 8
    return df.agg(F.coalesce(F.sum(width.cast("bigint")), F.lit(0))).first()[0]


def is_small(written: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether a written table may be broadcast; its rows are only read where its files are small."""
    return stored_bytes(written) <= most and row_bytes(written) <= most


def broadcast_if_small(df: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """df for a join: broadcast if it, or the written table that it renames, is small."""
    return F.broadcast(df) if is_small(df if written is None else written) else df


#: Rows and bytes of an Arrow batch between Spark and Python, at most; whole texts make Spark's own bounds too large.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch bounds to BATCH_ROWS and BATCH_BYTES; lower ones stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub(r"\D", "", spark.conf.get(key) or "") or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def ship_package(spark: SparkSession) -> None:
    """Python workers find this package where the driver does, wherever they start."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in (root, *paths) if p)


def map_slices(df: DataFrame, start: Callable[[], Callable[[dict], dict]], schema: str | T.StructType, rows: int = 256) -> DataFrame:
    """Runs a function over slices of at most `rows` rows, so that what Python holds stays small.

    start() is called once a task and returns a function from {column: list} to {column: list}; the
    lists that it returns may be shorter or longer than those it got.
    """
    bound_batches(df.sparkSession)
    ship_package(df.sparkSession)
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    # ints of fixed width, strings and binaries only: what Arrow needs is fixed here once
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for b in batches:
            if f is None:
                f = start()
            for i in range(0, b.num_rows, rows):
                part = b.slice(i, rows)
                got = f({n: part.column(k).to_pylist() for k, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[x.name], type=x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def fold_case(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def held_out(c: Column, folds: int = 5) -> Column:
    """True where crc32 of the key as text is divisible by the number of folds."""
    return F.crc32(c.cast("string").cast("binary")) % folds == 0
