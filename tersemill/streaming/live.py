"""The same operators on streams."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import heuristic_tokens, whole_percent
from ..operators.feedback import DEFAULT_LIMITS, LIMITS, REST, TIMEOUT_REST, TIMEOUTS, Quota
from ..sources.written import new_path


def token_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """events(ts, text): tokens by window of event time; what comes later than `late` is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("texts"), F.sum(heuristic_tokens(F.col("text"))).alias("tokens"))


def admit_live(requests: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """requests(id, provider, ts_ms, tokens): admission with the quota of each provider as keyed state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = None
        if state.exists:
            day, n, tokens, at, each = state.get
            held = {"window": list(zip(at, each, strict=True)), "day": day, "requests": n, "tokens": tokens}
        quota = Quota(limits.get(key[0], DEFAULT_LIMITS), held)
        for b in batches:
            b = b.sort_values(["ts_ms", "id"])
            got = [quota.ask(int(t), float(n)) for t, n in zip(b["ts_ms"], b["tokens"], strict=True)]
            yield pd.DataFrame({"id": b["id"], "provider": key[0], "admitted": [x for x, _ in got], "wait_ms": [x for _, x in got]})
        s = quota.state()
        state.update((s["day"], s["requests"], float(s["tokens"]), [t for t, _ in s["window"]], [float(n) for _, n in s["window"]]))

    return requests.groupBy("provider").applyInPandasWithState(run, "id long, provider string, admitted boolean, wait_ms long", "day long, requests long, tokens double, at array<long>, each array<double>", "append", "NoTimeout")


def sessions(runs: DataFrame, *by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """runs(ts, input_tokens, output_tokens, used_cloud): the statistics of each session, which ends when nothing
    came for `gap`. On a stream a session is given out when nothing that isn't late can belong to it any more."""
    counted = runs.filter("input_tokens > 0").withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *by)
    saved = F.greatest(F.lit(0.0), (F.col("input_tokens") - F.col("output_tokens")) / F.col("input_tokens"))
    out = counted.agg(F.count(F.lit(1)).alias("runs"), F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"), F.sum(F.col("used_cloud").cast("long")).alias("api_calls"), F.max(saved).alias("best"))
    kept = F.greatest(F.lit(0), F.col("tokens_in") - F.col("tokens_out"))
    return out.select(F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), *by, "runs", "tokens_in", "tokens_out", "api_calls", kept.alias("saved"), whole_percent(kept, F.col("tokens_in")).alias("avg_percent"), F.floor(F.col("best") * 100 + 0.5).cast("long").alias("best_percent"))


def decided_within(results: DataFrame, decisions: DataFrame, on: str, within: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """results(on, ts, result_id) with the decisions(on, ts, decision_id) made on them in the time after. Each side keeps
    as state only what the other's watermark leaves a chance."""
    r = results.select(F.col(on).alias("_on"), F.col("ts").alias("result_ts"), "result_id").withWatermark("result_ts", late)
    d = decisions.select(on, F.col("ts").alias("decision_ts"), "decision_id").withWatermark("decision_ts", late)
    met = (F.col(on) == F.col("_on")) & (F.col("decision_ts") >= F.col("result_ts")) & (F.col("decision_ts") <= F.col("result_ts") + F.expr(f"interval {within}"))
    return r.join(d, met).select(on, "result_id", "decision_id", "result_ts", "decision_ts")


class Rests(StatefulProcessor):
    """One provider's state. A rest ends by a timer, not by the next outcome; clock: processing, or event for that of the rows."""

    def __init__(self, clock: str, rest: dict[str, int], timeouts: int, timeout_rest: int):
        self.clock, self.rest, self.most, self.timeout_rest = clock, rest, timeouts, timeout_rest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "until long, timeouts int, exhausted boolean, misconfigured boolean, resting boolean")

    def row(self, provider: str, event: str, at: int, held: tuple) -> tuple:
        until, timeouts, exhausted, misconfigured = held
        return provider, event, at, until, timeouts, exhausted, misconfigured, not exhausted and not misconfigured and until <= at

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until, timeouts, exhausted, misconfigured, resting = self.state.get() if self.state.exists() else (0, 0, False, False, False)
        told = sorted(((int(t), int(s), o) for b in rows for t, s, o in zip(b["ts_ms"], b["seq"], b["outcome"], strict=True)))
        out = []
        for t, _, outcome in told:
            now = t if self.clock == "event" else timerValues.getCurrentProcessingTimeInMs()
            if resting and until <= now:  # over before the timer's turn
                out.append(self.row(key[0], "rested", until, (until, timeouts, exhausted, misconfigured)))
                resting = False
            if until <= now and timeouts >= self.most:
                timeouts = 0
            timeouts = 0 if outcome == "success" else timeouts + (outcome == "timeout")
            rest = self.rest.get(outcome, self.timeout_rest if outcome == "timeout" and timeouts >= self.most else None)
            until, resting = (until, resting) if rest is None else (now + rest, True)
            exhausted, misconfigured = exhausted or outcome == "exhausted", misconfigured or outcome == "misconfigured"
            out.append(self.row(key[0], outcome, now, (until, timeouts, exhausted, misconfigured)))
        self.state.update((until, timeouts, exhausted, misconfigured, resting))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if resting:
            self.handle.registerTimer(until)
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = tuple(self.state.get())[:4]
        self.state.update((*held, False))
        yield pd.DataFrame([self.row(key[0], "rested", held[0], held)], columns=COLUMNS)

    def close(self) -> None:
        pass


STATES = "provider string, event string, at_ms long, cooling_down_until long, consecutive_timeouts int, credit_exhausted boolean, misconfigured boolean, available boolean"
COLUMNS = [c.split()[0] for c in STATES.split(", ")]


def provider_rests(outcomes: DataFrame, *, clock: str = "processing", late: str = "1 minute", rest: dict[str, int] = REST, timeouts: int = TIMEOUTS, timeout_rest: int = TIMEOUT_REST) -> DataFrame:
    """outcomes(seq, provider, ts, outcome) -> a row for each outcome with the provider's state after it, and one when a
    rest is over, once. The state store must be RocksDB's (rocksdb())."""
    rows = outcomes.withWatermark("ts", late) if clock == "event" else outcomes
    rows = rows.select("seq", "provider", "ts", F.unix_millis("ts").alias("ts_ms"), "outcome")
    mode = "eventTime" if clock == "event" else "processingTime"
    return rows.groupBy("provider").transformWithStateInPandas(Rests(clock, rest, timeouts, timeout_rest), STATES, "append", mode)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_to_end(out: DataFrame, tag: str) -> DataFrame:
    """All that a stream gives for what there is now, written in the shared folder and read from there."""
    spark = out.sparkSession
    path = new_path(spark, tag)
    out.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(out.schema).parquet(path)
