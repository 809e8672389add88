"""Small helpers that the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch that goes to a Python worker, which holds one batch at a time.
BATCH_ROWS = 1500


def bounded_batches(spark: SparkSession) -> None:
    """Keeps batches for Python workers small; a setting that differs from Spark's default is left alone."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def trim() -> None:
    """Gives unused memory of this Python process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library can trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``kernel``, which gives unused memory back at the end of a partition: Python workers outlive their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            trim()

    return run


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset and all runs in one process, a temporary one."""
    bounded_batches(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


#: Share of its bound beyond which the driver's heap is collected between steps.
HEAP_SHARE = 0.4
#: Seconds from one relief of the driver to the next, at least.
RELIEF_S = 2
_relieved = -math.inf


def relieve(spark: SparkSession) -> None:
    """Has the driver give back memory that it holds but doesn't use.

    Plans and jobs of many small steps leave garbage.  Java lets its heap grow for it rather than collect it, and keeps
    what its compiler had, so that a driver's memory grows with the number of steps and not with the data.
    """
    global _relieved
    if time.monotonic() - _relieved < RELIEF_S:
        return
    trim()
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        jvm.System.gc()
    _trim_java(spark)
    _relieved = time.monotonic()


def _trim_java(spark: SparkSession) -> bool:
    """What ``jcmd System.trim_native_heap`` does to the driver's Java; False where there is no such command (before 17.0.9, or not Linux)."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    of = jvm.java.lang.Class.forName
    try:
        kinds = array(jvm.java.lang.Class, 4)
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = of(name)
        given = array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # The server's own class isn't open to callers, its interface is.
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return True


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    relieve(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables written to a folder of their own in the shared folder, and deleted when they are no longer needed.

    Unlike a checkpoint a table is compressed and read by column.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        relieve(self.spark)
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps, which it does when the driver collects its garbage.

    What the first collection finds is let go by another thread; the second then finds what that held.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def semi_by_size(left: DataFrame, right: DataFrame, on: str | list[str], how: str, most_rows: int) -> DataFrame:
    """A join that broadcasts ``right`` only if it has at most ``most_rows`` rows, and else shuffles both sides.

    ``right`` has to be checkpointed (it is counted first) and its rows have to be narrow.
    """
    return left.join(F.broadcast(right) if right.count() <= most_rows else right, on, how)


#: Rows of one key that a task of a join takes; more are dealt to several.
HOT_ROWS = 20_000
#: Hot keys (16 bytes each) that may be broadcast.
BROADCAST_KEYS = 500_000


def hot_keys(left: DataFrame, key: str, rows: int | None = None) -> DataFrame | None:
    """``key, _salts``: keys of more than ``rows`` (HOT_ROWS) rows and the tasks they are dealt to; None if there are none."""
    counted = left.groupBy(key).agg(F.ceil(F.count("*") / (rows or HOT_ROWS)).cast("int").alias("_salts")).where("_salts > 1")
    hot = checkpointed(counted)
    return hot if hot.limit(1).count() else None


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """The inner join of ``left`` with the one row of each key of ``right``, which goes to all tasks of a hot key."""
    if hot is None:
        return left.join(right, key)
    dealt = semi_by_size(left, hot, key, "left", BROADCAST_KEYS)
    dealt = dealt.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    spread = semi_by_size(right, hot, key, "left", BROADCAST_KEYS)
    spread = spread.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(spread, [key, "_salt"]).drop("_salt")


def extended(docs: DataFrame, inputs: list, fields: list[T.StructField], kernel: Callable[[list[pa.Array]], list[pa.Array]], drop: tuple[str, ...] = ()) -> DataFrame:
    """All columns of ``docs`` but ``drop``, and the ``fields`` that ``kernel`` makes from the ``inputs`` of a batch.

    Inputs are columns as strings go, by name; what is kept and read as well travels once.  Columns of ``docs`` with the
    names of new fields are replaced.  Rows stay where they are: nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    names = {f.name.lower() for f in fields} | set(drop)
    kept = [c for c in docs.columns if c.lower() not in names]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("_"))
    shared = lambda x: isinstance(x, str) and x in kept and docs.schema[x].dataType == T.StringType()
    more = [F.col(f"`{x}`").cast("string") if isinstance(x, str) else x for x in inputs if not shared(x)]
    given = docs.select(row.alias("_row"), *[x.alias(f"_in{i}") for i, x in enumerate(more)])
    order, at = [], 0
    for x in inputs:
        order.append((0, kept.index(x)) if shared(x) else (1, at))
        at += not shared(x)
    labels = ["_row", *[f.name for f in fields]]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = kernel([batch.column(1 + i) if own else batch.column(0).field(i) for own, i in order])
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], labels)

    out = given.mapInArrow(tidy(of), T.StructType([given.schema["_row"], *fields]))
    return out.select(*([f"_row.`{c}`" for c in kept]), *[f"`{f.name}`" for f in fields])
