"""What the training-data operators share: the shared scratch folder, tables written to cut lineage, hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What goes to a Python worker at once: the JVM and the worker hold a batch several times, for each core.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only where the session names none (tests)."""
    found = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{SHARED} is not set; on a cluster it must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="riskweave-")
        spark.conf.set(SHARED, found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    for paths in _collecting:
        paths.append(path)
    return path


_collecting: list[list[str]] = []


@contextlib.contextmanager
def collecting(paths: list[str]) -> Iterator[None]:
    """Notes in paths the scratch tables that are begun meanwhile, for a caller who knows when their results have been used."""
    _collecting.append(paths)
    try:
        yield
    finally:
        _collecting[:] = [x for x in _collecting if x is not paths]


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Removes the scratch tables noted in paths, which is emptied."""
    while paths:
        _remove(spark, paths.pop())


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder's owner cleans up
        return


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small_batches(spark: SparkSession):
    """Jobs that run meanwhile send batches of about BATCH_BYTES to Python."""
    return setting(spark, BATCH, str(BATCH_BYTES))


class Tables:
    """Tables in the shared folder that a computation drops itself as soon as it needs them no more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table; a table of the same name is forgotten but stays until the driver's Python ends."""
        path = scratch(self.spark, name)
        with setting(self.spark, CLEANUP, "true"), small_batches(self.spark):  # Spark removes the shuffle files of this write at its end
            df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _remove(self.spark, self.paths.pop(name))


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read from a table in the shared folder: cuts lineage, survives lost executors, computes once."""
    return Tables(df.sparkSession).write(df, name)


PART_ROWS = 500


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = PART_ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: f gets batches of at most that many rows, and what the task has freed goes back to the system at its end, since the
    worker process stays for other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batch.slice(k, rows) for batch in batches for k in range(0, batch.num_rows, rows))
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or with underscores in front so that it clashes with no column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def utf8(text):
    return F.encode(text, "UTF-8")
