"""Results of compression that outlive a run: a table by version of the settings and key of the text.

A run computes only texts whose key the table of its settings doesn't have, and appends them. Other settings, or
other dictionaries, are another version, so nothing stale is ever read; clear() removes versions that are not wanted
any more. Two runs at once may both compute a text; a reader takes one result of each key.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import phrases, rewriting
from .compression import MULTI, multi_pass_once

ENTRY = f"cache_key string, m {MULTI}, cached_at timestamp"


def version(preset: str, excluded: frozenset[str] = frozenset()) -> str:
    """Names all that a result depends on beside the text."""
    preset = rewriting.preset_of(preset)
    entries = [(e.kind, e.phrase, e.replacement, e.confidence, e.category) for es in phrases.ENTRIES.values() for e in es]
    all_ = [preset, rewriting.PRESETS[preset], sorted(excluded), entries]
    return hashlib.sha256(json.dumps(all_).encode()).hexdigest()[:16]


def entries(spark: SparkSession, path: str, of: str) -> DataFrame:
    """(cache_key, m, cached_at) of a version, each key once."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version={of}")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], ENTRY)
    stored = spark.read.schema(ENTRY).parquet(f"{path}/version={of}")
    return stored.groupBy("cache_key").agg(F.max_by(F.struct("m", "cached_at"), "cached_at").alias("e")).select("cache_key", "e.*")


def keyed(docs: DataFrame, preset: str, text: str) -> DataFrame:
    return docs.withColumn("cache_key", C.cache_key(F.lit(rewriting.preset_of(preset)), F.coalesce(F.col(text), F.lit(""))))


def compute_new(docs: DataFrame, path: str, preset: str = "balanced", *, text: str = "text", excluded: frozenset[str] = frozenset()) -> int:
    """Computes and stores what the table doesn't have of docs; how many texts that were. A text that many rows have is
    met once: rows are told by key, with partial sums, before any text is compressed."""
    spark, of = docs.sparkSession, version(preset, excluded)
    known = entries(spark, path, of).select("cache_key")
    new = keyed(docs, preset, text).groupBy("cache_key").agg(F.first(text).alias("text")).join(known, "cache_key", "left_anti")
    made = new.select("cache_key", multi_pass_once(F.coalesce("text", F.lit("")), preset, excluded).alias("m"), F.current_timestamp().alias("cached_at"))
    before = known.count()
    made.write.mode("append").parquet(f"{path}/version={of}")
    return entries(spark, path, of).count() - before


def compress_cached(docs: DataFrame, key: str, path: str, preset: str = "balanced", *, text: str = "text", excluded: frozenset[str] = frozenset()) -> DataFrame:
    """key, result, passes, changed, final_tokens of each row, from the table, after what it lacked was computed. Null
    texts have an empty result."""
    compute_new(docs, path, preset, text=text, excluded=excluded)
    rows = keyed(docs.select(key, text), preset, text).select(key, "cache_key")
    stored = entries(docs.sparkSession, path, version(preset, excluded))
    return rows.join(stored, "cache_key").select(key, "m.result", "m.passes", "m.changed", "m.final_tokens")


def clear(spark: SparkSession, path: str, but: tuple[str, ...] = ()) -> None:
    """Removes all versions but some."""
    sc = spark.sparkContext
    root = sc._jvm.org.apache.hadoop.fs.Path(path)
    at = root.getFileSystem(sc._jsc.hadoopConfiguration())
    if at.exists(root):
        for status in at.listStatus(root):
            if status.getPath().getName().removeprefix("version=") not in but:
                at.delete(status.getPath(), True)
