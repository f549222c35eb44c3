"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.written import BATCH, arrow_batches, discard, materialize, scratch, shared_folder  # noqa: F401  used by the operators

#: Rows turned into Python objects at a time, so that a batch of very long texts never is as a whole.
SLICE = 128

#: Word characters of the corpus contracts: anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, by whatever path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of at most BATCH rows and scans of SCAN, for a job whose results are written elsewhere,
    by whoever called for them. It holds for the session: plans are made when that happens."""
    for name, rows in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH), ("spark.sql.parquet.columnarReaderBatchSize", SCAN)):
        most = int(spark.conf.get(name))
        if not 0 < most <= rows:
            spark.conf.set(name, str(rows))


#: Rows that a scan of long texts reads at a time, beyond which the JVM's buffers are what fills an executor.
SCAN = 512

#: Columns put beside those of a table of any columns.
OWN_ID, OWN_KEY = "_tersemill_id", "_tersemill_key"

#: Most ids that are broadcast; beyond, rows are joined by shuffling.
FEW_IDS = 500_000


#: Most bytes, as written, of a table that is broadcast.
FEW_BYTES = 32 << 20


def written_bytes(df: DataFrame) -> int:
    """Bytes of the files of a table of materialize(); of others, none is known."""
    path = getattr(df, "_tersemill_path", None)
    if path is None:
        return 0
    sc = df.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def hinted(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it has few rows and bytes."""
    return F.broadcast(df) if written_bytes(df) <= FEW_BYTES and df.count() <= FEW_IDS else df


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def trim() -> None:
    """Give memory that is no longer used back to the system; Python workers are kept between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with trim() at a task's end."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole


class Memo(dict):
    """A bounded memo in two generations: what is used while the young one fills stays, the rest goes."""

    def __init__(self, make, size: int, longest: int):
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key: str):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
            if len(key) > self.longest:
                return got
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got
