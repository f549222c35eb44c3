"""A stored phrase log as a data source of Spark: summaries of events, appended commit by commit, read in parallel.

    register(spark)
    append_events(events, folder)           # df.write.format("tersemill_phrase_log").mode("append").save(folder)
    read_log(spark, folder)                 # the log as phrase_log() of all events so far would give it

Each task writes a file; a commit lists its files in one small manifest with the next number, so half-written appends
are never read, and a failed one leaves nothing. Commits of two writers at once are both kept, in order of number and
name. Every file is a partition of a read. Overwriting starts an empty log of the new summaries (a reset).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.scans import folded, phrase_summaries

NAME = "tersemill_phrase_log"
SUMMARY = "phrase string, part long, a long, r long, ts timestamp, last struct<toggles:bigint,on:int,best:array<bigint>>"
#: What a stored summary has: its commit's place beside it.
STORED = "commit string, " + SUMMARY
FILE = pa.schema(
    [
        ("phrase", pa.string()),
        ("part", pa.int64()),
        ("a", pa.int64()),
        ("r", pa.int64()),
        ("ts", pa.timestamp("us", "UTC")),
        ("last", pa.struct([("toggles", pa.int64()), ("on", pa.int32()), ("best", pa.list_(pa.int64()))])),
    ]
)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, whatever it is that pyarrow reaches, and the folder there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def manifests(path: str) -> list[str]:
    at, root = opened(path)
    found = at.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.endswith(".json"))


@dataclass
class File(InputPartition):
    commit: str
    name: str


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[File]:
        at, root = opened(self.path)
        out = []
        for m in manifests(self.path):
            with at.open_input_stream(f"{root}/commits/{m}") as f:
                out += [File(m.removesuffix(".json"), name) for name in json.loads(f.read())]
        return out

    def read(self, file: File | None) -> Iterator[pa.RecordBatch]:
        if file is None:  # an empty log
            return
        at, root = opened(self.path)
        for batch in pq.ParquetFile(at.open_input_file(f"{root}/data/{file.name}")).iter_batches():
            yield pa.RecordBatch.from_arrays([pa.array([file.commit] * batch.num_rows), *batch.columns], names=["commit", *batch.schema.names])


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> Written:
        at, root = opened(self.path)
        name, out, held = f"{uuid.uuid4().hex}.parquet", None, []

        def send() -> None:
            nonlocal out
            if out is None:
                at.create_dir(f"{root}/data", recursive=True)
                out = pq.ParquetWriter(f"{root}/data/{name}", FILE, filesystem=at)
            out.write_batch(pa.RecordBatch.from_pylist(held, FILE))
            held.clear()

        for row in rows:
            x = row.asDict(recursive=True)
            held.append({c: x[c] for c in FILE.names} | {"ts": x["ts"].astimezone() if x["ts"] else None})
            if len(held) >= 10_000:
                send()
        if held:
            send()
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        at, root = opened(self.path)
        before = manifests(self.path)
        number = int(before[-1].split("-")[0]) + 1 if before else 0
        at.create_dir(f"{root}/commits", recursive=True)
        name = f"{number:012d}-{uuid.uuid4().hex}.json"
        with at.open_output_stream(f"{root}/commits/{name}.part") as f:
            f.write(json.dumps([m.name for m in messages if m and m.name]).encode())
        at.move(f"{root}/commits/{name}.part", f"{root}/commits/{name}")
        if self.overwrite:
            for old in before:
                at.delete_file(f"{root}/commits/{old}")

    def abort(self, messages: list[Written | None]) -> None:
        at, root = opened(self.path)
        for m in messages:
            if m and m.name:
                at.delete_file(f"{root}/data/{m.name}")


class PhraseLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return STORED

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PhraseLogSource)


def append_events(events: DataFrame, folder: str, mode: str = "append") -> None:
    """Adds events that came after all those in the log. mode overwrite: they are all there is from now on."""
    rows = phrase_summaries(events).withColumn("commit", F.lit("")).select("commit", "phrase", "part", "a", "r", "ts", "last")
    rows.write.format(NAME).mode(mode).save(folder)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return folded(spark.read.format(NAME).load(folder), "commit", "part")
