"""What the operators of this package share: the shared folder, written tables and small helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a Java character class: the complement of a word character.
SPACES = "[ \\x09-\\x0D]"

_OWN_DIR = "/tmp/pactum-shared"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and one machine runs all, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found or _OWN_DIR


def new_path(spark: SparkSession, name: str) -> str:
    """A path not used before, below the shared folder. It is deleted when this process ends."""
    if not _written:
        atexit.register(_delete_written)
    path = f"{shared_dir(spark).rstrip('/')}/pactum-{uuid.uuid4().hex}/{name}"
    _written.append((spark, path.rpartition("/")[0]))
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _delete_written() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the session may have gone first; the folder is then left to the cluster's cleaning
            return


#: Rows of a few numbers that make a file worth writing.
ROWS_PER_FILE = 250_000


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: this cuts lineage and outlives lost executors.

    rows: how many rows of a few numbers df has at most, where that is known: a small table then makes few files.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What this process keeps between tasks, and for which operator a worker did so last.
_tables: dict[tuple, object] = {}
_working: list[str | None] = [None]


def kept(key: tuple, make: Callable[[], object]):
    """What make() gave when this process first asked for key."""
    if key not in _tables:
        _tables[key] = make()
    return _tables[key]


def give_back() -> None:
    """Return to the system what the allocators hold and nobody uses. Where the C library cannot, it stays with them."""
    pa.default_memory_pool().release_unused()
    if os.name == "posix" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def task(of: str):
    """For functions of mapInArrow: a worker keeps the tables of one operator, `of`, and between tasks no more than those.

    Workers go from one stage of a pipeline to the next, and idle ones stand beside the JVM's joins: the tables of stages
    that are over, and the memory that freed objects leave behind, would add up. Results do not depend on what is kept.
    """

    def wrap(f):
        @wraps(f)
        def run(*args) -> Iterator[pa.RecordBatch]:
            if _working[0] != of:
                _working[0] = of
                _tables.clear()
                gc.collect()
            yield from f(*args)
            give_back()

        return run

    return wrap


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes to be no column of df."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def checked_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows, else df as it is, so that the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
