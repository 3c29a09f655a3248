"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.workers import attach  # noqa: F401 - the operators have it from here

#: White space of the word rule, for use inside a character class of a Java pattern.
SPACE = r"\x20\x09-\x0D"
#: Settings of the runs that write scratch tables: shuffle files go with their run, and Arrow batches are bounded by
#: bytes, since the JVM and the worker each hold a batch (and Spark's bound of 10000 rows is 40 MB and more of text).
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once and binds it in body, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names that none of df's columns has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]):
    """What a worker remembers between tasks, made on first use. It keeps one thing at a time, so that operators that
    follow each other in a worker do not add up."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def freed(made=None):
    """made, after what this worker no longer uses has gone back to the system. Executors count their idle workers too."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):  # blocks of 4 MB and more (M_MMAP_THRESHOLD) go back at once from now on
        libc.mallopt(-3, 4 << 20)
        libc.malloc_trim(0)
    return made


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run for mapInArrow, with the worker's memory given back before and after."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freed()
        yield from run(batches)
        freed()

    return lean_run


class Scratch:
    """Tables written to the shared folder that the session names in spark.checkpoint.dir; a local folder only where
    that setting is absent, as in tests. A written table cuts lineage, and its files outlive lost executors."""

    _made: list[tuple[SparkSession, str]] = []

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = "file://" + tempfile.gettempdir()
        self.spark, self.base, self.n = spark, f"{base.rstrip('/')}/lamina-{uuid.uuid4().hex}", 0
        Scratch._made.append((spark, self.base))

    def save(self, df: DataFrame) -> DataFrame:
        """Writes df and returns what was written. The shuffle files of the run are deleted with its end: what was
        written does not need them."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        before = {k: self.spark.conf.get(k, None) for k in SETTINGS}
        for k, v in SETTINGS.items():
            self.spark.conf.set(k, v)
        try:
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v) if v else self.spark.conf.unset(k)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes a saved table that is no longer needed."""
        for f in {os.path.dirname(f) for f in df.inputFiles()}:
            _delete(self.spark, f)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in Scratch._made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, PERF203 - that session has ended; the folder's owner clears it
            continue
