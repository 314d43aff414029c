"""Column helpers and shared-folder staging that the operators use."""

from __future__ import annotations

import ctypes
import gc
import string
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other code point stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sql_let(value: str, name: str, body: str) -> str:
    """The same as `let` in SQL text."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset,
    as in local tests, a temporary folder of this process is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="pricelark-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def staging(spark: SparkSession, scope: str) -> str:
    return f"{shared_root(spark)}/pricelark-{spark.sparkContext.applicationId}/{scope}"


def stage(df: DataFrame, scope: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    A lost executor costs only the tasks it ran, since later steps read files that
    every machine sees.
    """
    spark = df.sparkSession
    path = f"{staging(spark, scope)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Shuffle files of a finished query are deleted.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_freed(df: DataFrame, scope: str) -> DataFrame:
    """`stage`, and the shuffle files that writing needed are deleted at once, not when the driver next collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_FREED, None)
    conf.set(_FREED, "true")
    try:
        return stage(df, scope)
    finally:
        conf.unset(_FREED) if before is None else conf.set(_FREED, before)


def release(spark: SparkSession, scope: str) -> None:
    """Delete what `stage` wrote under ``scope``.  Call it once the results built on it are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staging(spark, scope))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """A broadcast hint if a count shows at most ``max_rows`` rows, else ``df`` for a shuffled join.

    Callers pass narrow tables (a key and a few numbers), so the bound is a few MB.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of a batch between the JVM and a Python worker.  Whole texts of ten thousand rows, Spark's own bound, are a task's whole input, and both sides hold them.
BATCH = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have at most ``BATCH`` rows, or fewer where fewer are set; what tasks see of their rows stays the same."""
    now = int(spark.conf.get(_BATCH))
    if not 0 < now <= BATCH:
        spark.conf.set(_BATCH, str(BATCH))


def give_back() -> None:
    """Return what a Python worker has freed to the system; freed pages else stay with a worker that Spark uses again."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass
