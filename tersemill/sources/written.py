"""Tables written in the folder that all executors share, to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master may leave it unset, as its executors are this very machine."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tersemill-")
        sc.setCheckpointDir(root)
    return root


#: Rows that go to a Python worker at a time while a table is written, so that batches of long texts stay small.
BATCH = 1024

#: Tables written since each open scratch() of this thread or task.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows at most, in what runs inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    most = int(before)
    spark.conf.set(name, str(rows if most <= 0 else min(rows, most)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/tersemill/{uuid.uuid4().hex}-{tag}"


def materialize(df: DataFrame, tag: str, batch: int = BATCH) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    with arrow_batches(spark, batch):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tersemill_path = path
    for tables in _open.get():
        tables.append(path)
    return out


def discard(df: DataFrame | str) -> None:
    """Remove a table of materialize() that nothing reads any more."""
    path = df if isinstance(df, str) else getattr(df, "_tersemill_path", None)
    if path:
        sc = SparkSession.getActiveSession().sparkContext if isinstance(df, str) else df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch() -> Iterator[Callable[..., None]]:
    """Tables written inside are removed at the end, but those given to keep(...). For use where what they made is
    itself written by then."""
    tables: list[str] = []
    kept: set[str] = set()
    mark = _open.set((*_open.get(), tables))

    def keep(*dfs: DataFrame) -> None:
        kept.update(df._tersemill_path for df in dfs)

    try:
        yield keep
    finally:
        _open.reset(mark)
        for path in tables:
            if path not in kept:
                discard(path)
