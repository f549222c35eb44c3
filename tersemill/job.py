"""From a table of texts to what became of each: one run of the engine.

    python -m tersemill.job texts.parquet doc_id folder --settings settings.json

A run reads the phrases that earlier runs have excluded, compresses the texts, takes each reader's choice where there
is one, writes results and decisions below the folder, and adds to the stored log what was accepted or reverted.
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import phrases
from .operators import feedback
from .operators.compression import compress_pipeline
from .settings import Settings, read_settings
from .sources import phrase_log


def excluded_phrases(spark: SparkSession, folder: str) -> frozenset[str]:
    """Phrases of the dictionaries that the log excludes; others have no effect, so there are at most as many as entries."""
    known = [e.phrase.lower() for entries in phrases.ENTRIES.values() for e in entries]
    log = phrase_log.read_log(spark, f"{folder}/log")
    return frozenset(r["phrase"] for r in log.filter(F.col("excluded") & F.col("phrase").isin(known)).select("phrase").collect())


def run(texts: DataFrame, key: str, folder: str, settings: Settings = Settings(), *, text: str = "text", choices: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """key, delivered (the text), decision, tier, escalate, tokens before and after. choices(key, choice: compressed, original
    or reject, delivered: could it be handed over?) has what readers of a preview chose; who isn't in it takes the
    compressed text. A key of several rows shares its choice among them."""
    spark = texts.sparkSession
    phrase_log.register(spark)
    made = compress_pipeline(texts, key, settings.preset, text=text, target=settings.target, cloud=settings.cloud_fallback, consent=settings.disclosure_seen, excluded=excluded_phrases(spark, folder), keep_original=True)
    if choices is not None:
        made = made.join(choices.select(key, "choice", "delivered").dropDuplicates([key]), key, "left")
    else:
        made = made.withColumns({"choice": F.lit(None).cast("string"), "delivered": F.lit(None).cast("boolean")})
    shown = F.lit(settings.tier0_preview) & F.col("changed")
    decision = C.decision(shown, F.coalesce("choice", F.lit("compressed")), F.coalesce("delivered", F.lit(True)))
    number = len(phrase_log.manifests(f"{folder}/log"))
    path = f"{folder}/runs/{number:06d}"
    rows = made.withColumns({"decision": decision, "seq": F.monotonically_increasing_id(), "ts": F.current_timestamp()})
    handed = F.when(F.col("decision") == "accepted", F.col("result")).otherwise(F.col("original_text"))
    rows.select(key, handed.alias("delivered"), "decision", "tier", "escalate", "original_tokens", "compressed_tokens", "removals", "seq", "ts").write.parquet(path)
    out = spark.read.parquet(path)
    phrase_log.append_events(feedback.feedback_of(out.select("seq", "ts", "removals", "decision")), f"{folder}/log")
    return out.drop("removals", "seq", "ts")


def summary(out: DataFrame) -> DataFrame:
    """The run's statistics, by decision."""
    used = out.select("decision", F.col("original_tokens").alias("input_tokens"), F.when(F.col("decision") == "accepted", F.col("compressed_tokens")).otherwise(F.col("original_tokens")).alias("output_tokens"), F.col("escalate").alias("used_cloud"))
    return feedback.session_stats(used, "decision")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("table")
    parser.add_argument("key")
    parser.add_argument("folder")
    parser.add_argument("--text", default="text")
    parser.add_argument("--settings")
    given = parser.parse_args()
    spark = SparkSession.builder.getOrCreate()
    settings = read_settings(Path(given.settings).read_text() if given.settings else None)
    summary(run(spark.read.parquet(given.table), given.key, given.folder, settings, text=given.text)).show(truncate=False)


if __name__ == "__main__":
    main()
