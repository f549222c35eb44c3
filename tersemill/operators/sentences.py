"""Sentence operators over a table of texts: similarity, deduplication, scores.

What compares the sentences of one text is done text by text in one Arrow stage: no row is shuffled, the table is
read once, and a text's terms are never joined with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import rewriting
from ..functions.rewriting import CONSTRAINTS, SIMILAR, TECHNICAL


#: Rows of terms from which they leave a task, whatever the number of texts they are of.
ROWS = 20_000


def sentence_rows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, i, sentence, words)"""
    rows = docs.select(key, F.posexplode(C.sentences(F.col(text))).alias("i", "sentence"))
    return rows.withColumn("words", C.terms(F.col("sentence")))


def weights(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, i, term, tf, idf, w) of each sentence's terms within its text."""

    schema = T.StructType([docs.schema[key], *(T.StructField(n, t()) for n, t in (("i", T.IntegerType), ("term", T.StringType), ("tf", T.DoubleType), ("idf", T.DoubleType)))])
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []

            def made() -> pa.RecordBatch:
                at, *columns = (pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True))  # noqa: B023
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), *columns], names=schema.names)  # noqa: B023

            for k in range(batch.num_rows):
                words, idf = rewriting.sentence_terms(rewriting.split_sentences(batch.column(1)[k].as_py() or ""))
                for i, own in enumerate(words):
                    rows += [(k, i, w, tf, idf[w]) for w, tf in rewriting.frequencies(own).items()]
                    if len(rows) >= ROWS:
                        yield made()
                        rows = []
            if rows:
                yield made()

    rows = docs.select(key, F.col(text)).mapInArrow(run, schema)
    return rows.withColumn("w", F.col("tf") * F.col("idf"))


def similar_pairs(docs: DataFrame, key: str, text: str = "text", least: float = SIMILAR) -> DataFrame:
    """(key, i, j, sim) of the sentences of one text with a cosine of at least `least`."""

    @F.pandas_udf("array<struct<i:int,j:int,sim:double>>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict]:
            return [{"i": i, "j": j, "sim": c} for i, j, c in rewriting.Similar(rewriting.split_sentences(t or ""), least).pairs()]

        return pd.Series([one(t) for t in texts], index=texts.index, dtype=object)

    return docs.select(key, F.explode(run(F.col(text))).alias("x")).select(key, "x.*")


def dedup_sentences(docs: DataFrame, key: str, text: str = "text", least: float = SIMILAR, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry, text, removed, merges): pairs in order drop the less dense sentence, the later of equals, unless
    either is gone. merges: what stayed, what went, how similar."""

    @F.pandas_udf("struct<text:string,removed:long,merges:array<struct<kept:string,dropped:string,similarity:double>>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            out, merges = rewriting.dedup_sentences(t, least) if t is not None else (None, [])
            rows.append({"text": out, "removed": len(merges), "merges": [{"kept": a, "dropped": b, "similarity": s} for a, b, s in merges]})
        return pd.DataFrame(rows, index=texts.index, columns=["text", "removed", "merges"])

    return docs.select(key, *carry, run(F.col(text)).alias("_d")).select(key, *carry, "_d.*")


def sentence_scores(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, i, n, sentence, score) with the text as one paragraph."""
    rows = docs.withColumn("_s", C.sentences(F.col(text))).select(key, F.size("_s").alias("n"), F.posexplode("_s").alias("i", "sentence")).withColumn("words", C.terms(F.col("sentence")))
    low = F.lower("sentence")
    marked = F.lit(False)
    for word in CONSTRAINTS:
        marked = marked | F.contains(low, F.lit(word))
    score = C.density(F.col("words"))
    for factor, holds in ((1.2, (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)), (1.1, F.size("words") < 5), (1.3, F.arrays_overlap("words", F.array(*map(F.lit, sorted(TECHNICAL))))), (1.5, marked), (1.5, F.contains("sentence", F.lit("?")))):
        score = score * F.when(holds, factor).otherwise(1.0)
    return rows.select(key, "i", "n", "sentence", score.alias("score"))


def keep_flags(docs: DataFrame, key: str, share: float, text: str = "text") -> DataFrame:
    """(key, i, sentence, score, kept): the first floor(n * share) sentences in order that score at most the cutoff and hold no question or constraint go."""
    rows = sentence_scores(docs, key, text)
    whole = Window.partitionBy(key)
    k = F.floor(F.col("n") * share).cast("int")
    place = F.row_number().over(whole.orderBy("score")) - 1
    free = ~F.contains("sentence", F.lit("?")) & ~F.col("sentence").rlike(r"(?i)(?<![A-Za-z0-9_])(?:must|should|never|only)(?![A-Za-z0-9_])")
    rows = rows.withColumn("k", k).withColumn("place", place)
    cutoff = F.max(F.when(F.col("place") == F.least(F.col("k"), F.col("n") - 1), F.col("score"))).over(whole)
    rows = rows.withColumn("may", (F.col("score") <= cutoff) & free)
    rank = F.sum(F.col("may").cast("int")).over(whole.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(key, "i", "sentence", "score", (~(F.col("may") & (rank <= F.col("k")))).alias("kept"))


def with_subjects(kept: DataFrame, key: str) -> DataFrame:
    """keep_flags() -> (key, i, sentence, subject, resolved): of a kept sentence that begins with a pronoun and follows a
    dropped one, the pronoun gives way to that one's subject."""
    w = Window.partitionBy(key).orderBy("i")
    rows = kept.withColumn("subject", C.subject(F.col("sentence")))
    rows = rows.withColumn("_gone", F.lag(~F.col("kept"), 1, False).over(w)).withColumn("_subject", F.lag("subject").over(w))
    due = F.col("kept") & F.col("_gone") & F.col("_subject").isNotNull()
    resolved = F.when(due, C.resolved(F.col("sentence"), F.col("_subject"))).otherwise(F.col("sentence"))
    return rows.select(key, "i", "sentence", "kept", "subject", resolved.alias("resolved"))
