"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folder of this run's tables, by application; removed when the session's process ends.
_runs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where a
    local session (tests, one machine) names none, an own one is set; on a cluster
    that is an error, since executors would write where nobody else can read."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it goes at exit, if the session still stands then, or by clean()."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{shared_dir(spark)}/millrace/{app}"
        atexit.register(lambda: spark.sparkContext._jsc is not None and clean(spark))
    return _runs[app]


def clean(spark: SparkSession) -> None:
    """Deletes the stored tables of this application; results that were not written yet are lost with them."""
    app = spark.sparkContext.applicationId
    if app in _runs:
        path = spark._jvm.org.apache.hadoop.fs.Path(_runs.pop(app))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder (in a folder for each value of
    `by`) and reads it back: lineage ends there, and a lost executor costs a
    re-read instead of a recomputation."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 100_000, most_bytes: int = 64_000_000) -> DataFrame:
    """Broadcasts a stored df only if it holds at most so many rows, and so many
    bytes of text in them; beyond that the join shuffles."""
    sized = [F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.simpleString() in ("string", "binary") else F.lit(8) for f in df.schema]
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(reduce(lambda a, b: a + b, sized)), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= most_bytes else df


def unit(*cols) -> "F.Column":
    """Uniform number in [0, 1) that depends on the given values alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


#: What a Python worker keeps between tasks, by operator: how to drop it.
_kept: dict[str, Callable[[], None]] = {}


def worker_turn(operator: str, drop: Callable[[], None] | None = None) -> None:
    """Called where a task begins in a Python worker. Workers outlive stages, so
    what other operators keep there is dropped, and free memory goes back."""
    if drop is not None:
        _kept[operator] = drop
    others = [k for k in _kept if k != operator]
    for k in others:
        _kept.pop(k)()
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass
