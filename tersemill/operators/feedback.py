"""Feedback, sessions, history, quotas and providers over event tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import whole_percent
from .scans import DAY, MINUTE, anchored_days, phrase_log, window_usage  # noqa: F401  part of this module's interface

#: Requests and tokens a minute and a day.
LIMITS = {"first": (30.0, 12_000.0, 1_000.0, 100_000.0), "second": (30.0, 60_000.0, float("inf"), 1_000_000.0), "third": (40.0, float("inf"), float("inf"), float("inf"))}
DEFAULT_LIMITS = (30.0, float("inf"), float("inf"), float("inf"))


def session_stats(runs: DataFrame, *by: str) -> DataFrame:
    """runs(input_tokens, output_tokens, used_cloud): totals and whole percentages; runs without input don't count."""
    saved = F.greatest(F.lit(0), F.sum("input_tokens") - F.sum("output_tokens"))
    best = F.max(F.greatest(F.lit(0.0), (F.col("input_tokens") - F.col("output_tokens")) / F.col("input_tokens")))
    out = runs.filter("input_tokens > 0").groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"), F.sum(F.col("used_cloud").cast("long")).alias("api_calls"), saved.alias("saved"), best.alias("best"))
    return out.select(*by, "runs", "tokens_in", "tokens_out", "api_calls", "saved", whole_percent(F.col("saved"), F.col("tokens_in")).alias("avg_percent"), F.floor(F.col("best") * 100 + 0.5).cast("long").alias("best_percent"))


def without_excluded(dictionary: DataFrame, log: DataFrame) -> DataFrame:
    """Entries whose phrase isn't excluded; swaps always stay."""
    gone = log.filter("excluded").select(F.col("phrase").alias("_p"))
    kept = dictionary.filter("kind <> 'swap'").join(gone, F.lower("phrase") == F.col("_p"), "left_anti")
    return kept.unionByName(dictionary.filter("kind = 'swap'"))


def newest(history: DataFrame, most: int = 10) -> DataFrame:
    """The last entries, newest first."""
    return history.orderBy(F.desc("id")).limit(most)


class Quota:
    """Admission of one provider's requests, in order. Days are anchored at the first request."""

    def __init__(self, limits: tuple[float, float, float, float], state: dict | None = None):
        self.rpm, self.tpm, self.rpd, self.tpd = limits
        self.window: list[tuple[int, float]] = list(state["window"]) if state else []
        self.day, self.requests, self.tokens = (state["day"], state["requests"], state["tokens"]) if state else (None, 0, 0)

    def state(self) -> dict:
        return {"window": self.window, "day": self.day, "requests": self.requests, "tokens": self.tokens}

    def ask(self, now: int, tokens: float) -> tuple[bool, int]:
        """(admitted, milliseconds to wait; -1: not today). An empty window never makes one wait for it."""
        if self.day is None or now - self.day > DAY:
            self.day, self.requests, self.tokens = now, 0, 0
        self.window = [x for x in self.window if x[0] > now - MINUTE]
        if len(self.window) >= self.rpm or sum(t for _, t in self.window) + tokens > self.tpm:
            return False, max(self.window[0][0] + MINUTE - now, 1000) if self.window else 1000
        if self.requests >= self.rpd or self.tokens + tokens > self.tpd:
            return False, -1
        self.window.append((now, tokens))
        self.requests += 1
        self.tokens += tokens
        return True, 0


def admit(requests: DataFrame, limits: dict[str, tuple[float, float, float, float]] = LIMITS) -> DataFrame:
    """requests(id, provider, ts_ms, tokens) -> with admitted and wait_ms. A provider's requests are one sequence by
    nature; they stream through in order, and only the last minute is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quotas: dict[str, Quota] = {}
        for b in batches:
            got = [quotas.setdefault(p, Quota(limits.get(p, DEFAULT_LIMITS))).ask(int(t), float(n)) for p, t, n in zip(b["provider"], b["ts_ms"], b["tokens"], strict=True)]
            yield b.assign(admitted=[x for x, _ in got], wait_ms=[x for _, x in got])

    ordered = requests.select("id", "provider", "ts_ms", "tokens").repartition("provider").sortWithinPartitions("provider", "ts_ms", "id")
    return ordered.mapInPandas(run, "id long, provider string, ts_ms long, tokens long, admitted boolean, wait_ms long")


def rate_stats(requests: DataFrame, now_ms: int, limits: dict[str, tuple[float, float, float, float]] = LIMITS) -> DataFrame:
    """A row per provider at a time: requests and tokens used of the last minute and of its day, with their limits.
    Sums come from partial aggregates, the day from anchored_days()."""
    known = F.create_map(*[x for p, v in limits.items() for x in (F.lit(p), F.array(*map(F.lit, v)))])
    limit = F.coalesce(known[F.col("provider")], F.array(*map(F.lit, DEFAULT_LIMITS)))
    past = anchored_days(requests.filter(F.col("ts_ms") <= now_ms))
    recent = F.col("ts_ms") > now_ms - MINUTE
    last = F.max(F.struct("ts_ms", "id", "day", "day_requests", "day_tokens"))
    out = past.groupBy("provider").agg(F.sum(recent.cast("long")).alias("rpm_used"), F.sum(F.when(recent, F.col("tokens")).otherwise(0)).alias("tpm_used"), last.alias("x"))
    today = F.lit(now_ms) - F.col("x.day") <= DAY
    out = out.select("provider", "rpm_used", "tpm_used", F.when(today, F.col("x.day_requests")).otherwise(0).alias("rpd_used"), F.when(today, F.col("x.day_tokens")).otherwise(0).alias("tpd_used"))
    return out.select("*", *(limit[i].alias(f"{n}_limit") for i, n in enumerate(("rpm", "tpm", "rpd", "tpd"))))


def pick_provider(state: DataFrame, now_ms: int, skipped: tuple[str, ...] = ()) -> DataFrame:
    """The first provider in order that has a key, credit and a valid model and isn't cooling down."""
    ready = F.col("has_key") & ~F.col("credit_exhausted") & ~F.col("misconfigured") & (F.col("cooling_down_until") <= now_ms) & ~F.col("provider").isin(*skipped)
    return state.filter(ready).orderBy("position").limit(1)


# Milliseconds of rest after an outcome, and after so many timeouts in a row.
REST = {"rate-limited": 300_000, "unknown": 60_000}
TIMEOUTS, TIMEOUT_REST = 3, 600_000


def after_outcomes(state: DataFrame, outcomes: DataFrame, now_ms: int) -> DataFrame:
    """state(provider, has_key, cooling_down_until, consecutive_timeouts, credit_exhausted, misconfigured, ...) after one
    outcome each: outcomes(provider, outcome), success or an error's class. Other columns stay."""
    s = state.join(outcomes.select("provider", F.col("outcome").alias("_o")), "provider", "left")
    o = F.coalesce("_o", F.lit(""))
    over = F.col("cooling_down_until") <= now_ms  # a rest that is over makes timeouts count anew
    before = F.when(over & (F.col("consecutive_timeouts") >= TIMEOUTS), 0).otherwise(F.col("consecutive_timeouts"))
    times = F.when(o == "success", 0).when(o == "timeout", before + 1).otherwise(before)
    rest = F.create_map(*[F.lit(x) for kv in REST.items() for x in kv])[o]
    rest = F.coalesce(rest, F.when((o == "timeout") & (times >= TIMEOUTS), TIMEOUT_REST))
    new = {"cooling_down_until": F.coalesce(F.lit(now_ms) + rest, F.col("cooling_down_until")).cast("long"), "consecutive_timeouts": times.cast(state.schema["consecutive_timeouts"].dataType), "credit_exhausted": F.col("credit_exhausted") | (o == "exhausted"), "misconfigured": F.col("misconfigured") | (o == "misconfigured")}
    return s.withColumns(new).select(*state.columns)


def with_keys(state: DataFrame, keys: DataFrame) -> DataFrame:
    """state(..., renewable) after keys(provider, has_key) were set: the configuration is read anew, so all start afresh,
    but credit that can't be renewed stays exhausted."""
    s = state.join(keys.select("provider", F.col("has_key").alias("_k")), "provider", "left")
    new = {"has_key": F.coalesce("_k", "has_key"), "cooling_down_until": F.lit(0).cast("long"), "consecutive_timeouts": F.lit(0).cast(state.schema["consecutive_timeouts"].dataType), "misconfigured": F.lit(False), "credit_exhausted": F.col("credit_exhausted") & ~F.col("renewable")}
    return s.withColumns(new).select(*state.columns)


def with_credit(state: DataFrame, *providers: str) -> DataFrame:
    """state after the exhaustion of some providers, or of all, is cleared."""
    cleared = F.col("provider").isin(*providers) if providers else F.lit(True)
    return state.withColumn("credit_exhausted", F.col("credit_exhausted") & ~cleared)


def provider_listing(config: DataFrame, state: DataFrame, now_ms: int) -> DataFrame:
    """config(provider, position, model, renewable, has_key) with each one's state, in order; keys themselves are never in it."""
    own = state.select("provider", *(c for c in ("cooling_down_until", "consecutive_timeouts", "credit_exhausted", "misconfigured")))
    s = config.select("provider", "position", "model", "renewable", "has_key").join(own, "provider", "left").fillna({"cooling_down_until": 0, "consecutive_timeouts": 0, "credit_exhausted": False, "misconfigured": False})
    ready = F.col("has_key") & ~F.col("credit_exhausted") & ~F.col("misconfigured") & (F.col("cooling_down_until") <= now_ms)
    return s.withColumn("available", ready).orderBy("position")


LOG = "phrase string, applied long, reverted long, confidence double, excluded boolean, last_updated timestamp"


def empty_log(spark) -> DataFrame:
    """The phrase log after a reset."""
    return spark.createDataFrame([], LOG)


def removal_events(compressed: DataFrame, action: str, ts: Column) -> DataFrame:
    """compressed(seq, removals) -> an event of the action for each removal, for phrase_log()."""
    if action not in ("apply", "revert"):
        raise ValueError(f"no action {action!r} on removals")
    rows = compressed.select("seq", F.explode("removals").alias("r"))
    return rows.select("seq", ts.alias("ts"), F.col("r.phrase").alias("phrase"), F.lit(action).alias("action"))


def toggle_events(spark, phrases: dict[str, bool], seq: int, ts) -> DataFrame:
    """Events that set or lift the exclusion of phrases."""
    return spark.createDataFrame([(seq, ts, p, "toggle_on" if on else "toggle_off") for p, on in phrases.items()], "seq long, ts timestamp, phrase string, action string")


def excluded_phrases(log: DataFrame) -> DataFrame:
    return log.filter("excluded").select("phrase")


def feedback_of(decisions: DataFrame) -> DataFrame:
    """decisions(seq, ts, removals, decision): what was accepted counts as applied, what was reverted or undone as reverted."""
    action = F.when(F.col("decision") == "accepted", "apply").when(F.col("decision").isin("reverted", "undone"), "revert")
    rows = decisions.withColumn("action", action).filter("action is not null")
    return rows.select("seq", "ts", "action", F.explode("removals").alias("r")).select("seq", "ts", F.col("r.phrase").alias("phrase"), "action")


def undone(decisions: DataFrame) -> DataFrame:
    """The last accepted decision, as one that is undone; empty if there is none."""
    return decisions.filter("decision = 'accepted'").orderBy(F.desc("seq")).limit(1).withColumn("decision", F.lit("undone"))


def recover(history: DataFrame, id_: int) -> DataFrame:
    """The text of an entry among the newest; empty if it isn't there."""
    return newest(history).filter(F.col("id") == id_).select("text")


def with_entry(history: DataFrame, entry: DataFrame, most: int = 10) -> DataFrame:
    return newest(history.unionByName(entry), most)


def cleared(history: DataFrame) -> DataFrame:
    return history.limit(0)
