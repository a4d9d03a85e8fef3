"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakSet

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a session with a local master may lack that setting; it then gets a fresh
    temporary folder. On a cluster a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing was written to; it ends with ``name``."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: what reads it often
    computes it once, and a lost executor costs at most the tasks after the write."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _STAGED.add(out)
    return out


def stage_columns(df: DataFrame, columns: Iterable[str], name: str) -> DataFrame:
    """Some columns as a staged table; of what ``stage`` returned it is only a choice."""
    chosen = df.select(*dict.fromkeys(columns))
    return chosen if df in _STAGED else stage(chosen, name)


#: The tables that ``stage`` returned.
_STAGED: WeakSet[DataFrame] = WeakSet()
#: Where this thread's innermost scope lists the tables that it stages.
_SCOPE: ContextVar[list[str] | None] = ContextVar("staged tables", default=None)


@contextmanager
def staging_scope() -> Iterator[list[str]]:
    """Lists the paths of the tables that this thread stages inside, but for those of scopes
    within. Give the list to ``remove_tables`` once nothing reads them any more."""
    paths: list[str] = []
    token = _SCOPE.set(paths)
    try:
        yield paths
    finally:
        _SCOPE.reset(token)


def remove_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread stages inside are removed at the end: write or collect a
    result inside, not after."""
    with staging_scope() as paths:
        try:
            yield
        finally:
            remove_tables(spark, paths)


def settle(step: Callable[[], DataFrame], name: str) -> tuple[DataFrame, list[str]]:
    """Stage what ``step`` returns, and remove the tables that it staged on the way. Gives
    the table and its own paths."""
    with staging_scope() as used:
        df = step()
        with staging_scope() as own:
            out = stage(df, name)
    remove_tables(df.sparkSession, used)
    return out, own
