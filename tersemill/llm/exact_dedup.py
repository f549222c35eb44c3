"""Exact deduplication with a heavy-hitter split (operator 3).

Each text becomes its SHA-256 digest. Misra-Gries summaries, one per partition and merged, name every digest
that has more than a 1/counters share of the rows; an exact count verifies them, and the winners (at most
`counters` rows, whatever the input) are broadcast, so their rows are resolved where they are read. What is
left has no group above that share, is counted with partial sums and goes through an ordinary shuffle of
digests; texts are never shuffled.

Defined results: a null text counts as empty; of equal texts the row with the largest id stays, null being
less than any; rows that repeat an id together with its text are one document and are all marked kept or not
alike; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN_ID, OWN_KEY, hinted, materialize, table

COUNTERS = 4096


def add_counts(into: Counter, more: Counter, k: int) -> None:
    """Merge two Misra-Gries summaries: add, then take off what the (k+1)th has."""
    into.update(more)
    if len(into) > k:
        off = sorted(into.values(), reverse=True)[k]
        for key in [x for x, n in into.items() if n <= off]:
            del into[key]
        for key in into:
            into[key] -= off


def heavy_candidates(keys: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(key, n) of at most `counters` keys, among them each that more than rows / (counters + 1) rows have."""
    name = keys.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            counted = batch.column(0).value_counts()
            add_counts(held, Counter(dict(zip(counted.field(0).to_pylist(), counted.field(1).to_pylist(), strict=True))), counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), batch_type), pa.array(list(held.values()), pa.int64())], names=[name, "n"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(keys.schema[0].dataType)
    parts = keys.mapInArrow(run, f"`{name}` {keys.schema[0].dataType.simpleString()}, n long")
    return parts.groupBy(name).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), name).limit(counters)


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256."""
    digests = materialize(docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha")), "digests")
    rows = digests.count()
    found = heavy_candidates(digests.select("sha"), counters).select("sha")
    winners = digests.join(F.broadcast(found), "sha").groupBy("sha").agg(F.max("id").alias("heavy_id"), F.count(F.lit(1)).alias("heavy_n"))
    winners = materialize(winners.filter((F.col("heavy_n") > 1) & (F.col("heavy_n") * counters > rows)), "winners")
    heavy = digests.join(F.broadcast(winners), "sha").select("id", "sha", F.col("heavy_id").alias("keep"), F.col("heavy_n").alias("n"))
    rest = digests.join(F.broadcast(winners), "sha", "left_anti")
    light = rest.join(rest.groupBy("sha").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")), "sha").select("id", "sha", "keep", "n")
    return heavy.unionByName(light).select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each text: that with the largest id; of rows that repeat it, any one."""
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    found = exact_dedup(docs, id_col=id_col, text_col=text_col)
    gone = materialize(found.filter("not kept").select(F.col(id_col).alias(OWN_ID), F.col("text_sha256").alias(OWN_KEY)), "copies")
    again = materialize(found.filter("kept").groupBy("keep_id", "text_sha256").count().filter("count > 1").select(F.col("keep_id").alias(OWN_ID), F.col("text_sha256").alias(OWN_KEY)), "repeated")
    same = F.col(id_col).eqNullSafe(F.col(OWN_ID)) & (sha == F.col(OWN_KEY))
    kept = docs.join(hinted(gone), same, "left_anti")
    if not again.take(1):
        return kept
    once = kept.withColumn("_tersemill_again", sha).join(hinted(again), same, "left_semi").dropDuplicates([id_col, "_tersemill_again"]).select(*docs.columns)
    return kept.join(hinted(again), same, "left_anti").unionByName(once)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
