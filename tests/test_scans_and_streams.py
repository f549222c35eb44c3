import datetime
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tersemill.operators import cache, feedback, scans
from tersemill.sources import phrase_log as stored
from tersemill.streaming import live

START = datetime.datetime(2024, 1, 1)


def plain_log(events):
    """Event by event, as a log that is kept in memory does it."""
    log = {}
    for _, ts, phrase, action in sorted(events, key=lambda e: (e[1], e[0])):
        x = log.setdefault(phrase.strip().lower(), [0, 0, False, ts])
        if action == "toggle_on" or action == "toggle_off":
            x[2] = action == "toggle_on"
        else:
            x[action == "revert"] += 1
            if x[0] + x[1] >= 5 and x[1] / (x[0] + x[1]) >= 0.6:
                x[2] = True
        x[3] = ts
    return {p: (a, r, a / (a + r) if a + r else 0.5, x, ts) for p, (a, r, x, ts) in log.items()}


def some_events(seed, n, phrases):
    r = random.Random(seed)
    kinds = ["apply"] * r.choice([1, 4, 6]) + ["revert"] * r.choice([1, 4, 6]) + ["toggle_on"] * r.choice([0, 1]) + ["toggle_off"] * r.choice([0, 1])
    return [(i, START + datetime.timedelta(seconds=r.randint(0, n // 2)), r.choice(phrases), r.choice(kinds)) for i in range(n)]


EVENT = "seq long, ts timestamp, phrase string, action string"


@pytest.mark.parametrize(("seed", "n", "phrases", "ranges"), [(1, 400, ["hot"], 7), (2, 300, ["A ", "a", "b", "c", "d", "e", "f", "g"], 5), (3, 60, [f"p{i}" for i in range(20)], 9), (4, 500, ["x", "y"], 1), (5, 500, ["x", "y", "z"], 16)])
def test_phrase_log_of_ranges_equals_event_by_event(spark, seed, n, phrases, ranges):
    for k in range(3):
        events = some_events(10 * seed + k, n, phrases)
        out = scans.phrase_log(spark.createDataFrame(events, EVENT), ranges)
        assert {x.phrase: (x.applied, x.reverted, x.confidence, x.excluded, x.last_updated) for x in out.collect()} == plain_log(events)


def test_a_hot_phrase_is_spread_over_ranges(spark):
    events = spark.range(5000).select(F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"), F.lit("hot").alias("phrase"), F.lit("apply").alias("action"))
    parts = scans.phrase_summaries(events, 8).select("part", "a").collect()
    assert len(parts) == 8 and sum(x.a for x in parts) == 5000 and max(x.a for x in parts) < 1500


def test_empty_events_and_requests(spark):
    assert scans.phrase_log(spark.createDataFrame([], EVENT)).count() == 0
    none = spark.createDataFrame([], "id long, provider string, ts_ms long, tokens long")
    assert scans.window_usage(none).count() == 0 and scans.anchored_days(none).count() == 0


def some_requests(seed, n, span):
    r = random.Random(seed)
    return [(i, r.choice(["p", "p", "q", None]), r.randint(-span // 3, span), r.randint(0, 50)) for i in range(n)]


REQUEST = "id long, provider string, ts_ms long, tokens long"


@pytest.mark.parametrize(("n", "span", "width"), [(400, 1_500_000, 60_000), (300, 300_000, 600_000), (200, 30_000_000, 90_001)])
def test_minutes_of_ranges_equal_going_through_all(spark, n, span, width):
    requests = some_requests(n, n, span)
    got = sorted(map(tuple, scans.window_usage(spark.createDataFrame(requests, REQUEST), width).collect()), key=str)
    want = []
    for _, p, t, k in requests:
        minute = [m for _, q, u, m in requests if q == p and t - scans.MINUTE < u <= t]
        want.append((p, t, k, len(minute), sum(minute)))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize(("n", "span", "width"), [(300, 20 * scans.DAY, 3_600_000), (60, 200 * scans.DAY, 600_000), (200, 3 * scans.DAY, 5 * scans.DAY)])
def test_days_by_doubling_equal_one_after_the_other(spark, n, span, width):
    requests = [x for x in some_requests(n + 1, n, span) if x[1]]
    got = {x.id: (x.day, x.day_requests, x.day_tokens) for x in scans.anchored_days(spark.createDataFrame(requests, REQUEST), width).collect()}
    held, want = {}, {}
    for i, p, t, k in sorted(requests, key=lambda x: (x[2], x[0])):
        if p not in held or t - held[p][0] > scans.DAY:
            held[p] = [t, 0, 0]
        held[p][1] += 1
        held[p][2] += k
        want[i] = tuple(held[p])
    assert got == want


def frames(df):
    """The frames of all windows of a plan; only those that begin with the first row are summed up in one reading."""
    found = re.findall(r"specifiedwindowframe\(([^()]*(?:\(\)[^()]*)*)\)", df._jdf.queryExecution().optimizedPlan().toString())
    assert found
    return found


def test_minutes_need_one_reading_of_a_range(spark):
    assert all("unboundedpreceding" in f for f in frames(scans.window_usage(spark.createDataFrame(some_requests(1, 50, 900_000), REQUEST))))
    # nulls aren't tokens: a minute without any has no sum, one with some has theirs
    rows = [(0, "p", 0, 5), (1, "p", 60_000, None), (2, "p", 70_000, None), (3, "p", 80_000, 7)]
    got = {x.ts_ms: (x.minute_requests, x.minute_tokens) for x in scans.window_usage(spark.createDataFrame(rows, REQUEST)).collect()}
    assert got == {0: (1, 5), 60_000: (1, None), 70_000: (2, None), 80_000: (3, 7)}


def test_days_need_one_reading_of_a_range(spark):
    times = spark.createDataFrame(some_requests(2, 50, 3 * scans.DAY), REQUEST).select("provider", "ts_ms").distinct()
    assert all("unboundedpreceding" in f for f in frames(scans.next_days(times, scans.RANGE)))


def test_stored_log_equals_all_events_and_reads_in_parallel(spark, tmp_path):
    stored.register(spark)
    folder, events = f"file://{tmp_path}/log", some_events(7, 300, ["x", "y", "z", "w"])
    events.sort(key=lambda e: (e[1], e[0]))
    assert stored.read_log(spark, folder).count() == 0
    times = sorted({e[1] for e in events})
    bounds = [times[0], times[len(times) // 3], times[len(times) // 2], times[-1] + datetime.timedelta(seconds=1)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        stored.append_events(spark.createDataFrame([e for e in events if a <= e[1] < b], EVENT), folder)
    got = {x.phrase: (x.applied, x.reverted, x.confidence, x.excluded, x.last_updated) for x in stored.read_log(spark, folder).collect()}
    assert got == plain_log(events)
    files = list((tmp_path / "log" / "data").iterdir())
    assert spark.read.format(stored.NAME).load(folder).rdd.getNumPartitions() == len(files) > 2
    # what fails leaves nothing, and a reset starts anew
    bad = scans.phrase_summaries(spark.createDataFrame(events, EVENT)).withColumn("commit", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        bad.select("commit", "phrase", "part", "a", "r", "ts", "last").write.format(stored.NAME).mode("append").save(folder)
    assert stored.read_log(spark, folder).count() == len(got) and len(stored.manifests(folder)) == 3
    stored.append_events(spark.createDataFrame(events[:40], EVENT), folder, "overwrite")
    assert {x.phrase: x.applied for x in stored.read_log(spark, folder).collect()} == {p: v[0] for p, v in plain_log(events[:40]).items()}


def test_cache_outlives_runs_and_settings(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    rows = [(1, "I basically need it in order to win. " * 3), (2, None), (3, ""), (4, "I basically need it in order to win. " * 3), (5, "Due to the fact that we go, we go. " * 3)]
    docs = spark.createDataFrame(rows, "id int, text string")
    assert cache.compute_new(docs.filter("id < 5"), path, "safe") == 2
    assert [cache.compute_new(docs, path, "safe"), cache.compute_new(docs, path, "safe")] == [1, 0]
    got = {x.id: x.result for x in cache.compress_cached(docs, "id", path, "safe").collect()}
    from tersemill.functions import rewriting

    assert got == {i: rewriting.multi_pass(t or "", "safe")["result"] for i, t in rows}
    one = frozenset({"basically"})
    assert cache.version("safe") != cache.version("safe", one) != cache.version("max", one) and cache.version("nonsense") == cache.version("balanced")
    assert cache.compute_new(docs, path, "safe", excluded=one) == 3  # other settings, other results
    kept = {x.id: x.result for x in cache.compress_cached(docs, "id", path, "safe", excluded=one).collect()}
    assert "basically" in kept[1] and "basically" not in got[1]
    cache.clear(spark, path, but=(cache.version("safe"),))
    assert cache.compute_new(docs, path, "safe") == 0 and cache.compute_new(docs, path, "safe", excluded=one) == 3


def fed(spark, tmp_path, schema):
    """A stream, and a function that adds rows to it."""
    source = tmp_path / "in"
    source.mkdir()
    count = iter(range(1000))

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"made{(k := next(count))}"))
        (part,) = (tmp_path / f"made{k}").glob("part*")
        part.rename(source / f"{k:04d}.parquet")

    return spark.readStream.schema(schema).parquet(str(source)), add


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def test_sessions_end_by_the_watermark_and_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp, who string, input_tokens long, output_tokens long, used_cloud boolean"
    stream, add = fed(spark, tmp_path, schema)
    on_time = [(at(0), "a", 100, 50, True), (at(20), "a", 100, 70, False), (at(5), "b", 10, 20, False), (at(300), "a", 40, 10, False), (at(10), "b", 0, 5, True)]
    add(on_time)
    query = live.sessions(stream, "who").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    add([(at(30), "a", 1000, 0, True), (at(290), "b", 8, 4, True), (at(900), "c", 1, 1, False)])  # the first one is over an hour late
    query.processAllAvailable()
    query.stop()
    got = {(x.start_at, x.who): (x.end_at, x.runs, x.tokens_in, x.tokens_out, x.api_calls, x.saved, x.avg_percent, x.best_percent) for x in spark.table("sessions").collect()}
    assert got == {
        (at(0), "a"): (at(50), 2, 200, 120, 1, 80, 40, 50),
        (at(5), "b"): (at(35), 1, 10, 20, 0, 0, 0, 0),
        (at(300), "a"): (at(330), 1, 40, 10, 0, 30, 75, 75),
        (at(290), "b"): (at(320), 1, 8, 4, 1, 4, 50, 50),
    }
    batch = {(x.start_at, x.who): x.runs for x in live.sessions(spark.createDataFrame(on_time, schema), "who").collect()}
    assert batch == {(at(0), "a"): 2, (at(5), "b"): 1, (at(300), "a"): 1}


def test_decisions_meet_results_in_time(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "d").mkdir()
    results, add_results = fed(spark, tmp_path / "r", "ts timestamp, who string, result_id long")
    decisions, add_decisions = fed(spark, tmp_path / "d", "ts timestamp, who string, decision_id long")
    second = lambda s: START + datetime.timedelta(seconds=s)
    add_results([(second(0), "a", 1), (second(10), "a", 2), (second(0), "b", 3)])
    add_decisions([(second(5), "a", 10), (second(30), "a", 11), (second(41), "a", 12), (second(-1), "b", 13)])
    query = live.decided_within(results, decisions, "who").writeStream.format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    add_results([(second(1000), "c", 4)])
    add_decisions([(second(1000), "c", 14)])
    query.processAllAvailable()
    add_decisions([(second(20), "b", 15)])  # too late: its result's state is gone
    query.processAllAvailable()
    query.stop()
    assert {(x.result_id, x.decision_id) for x in spark.table("decided").collect()} == {(1, 10), (1, 11), (2, 11), (4, 14)}


def plain_rests(outcomes, watermark):
    held, resting = defaultdict(lambda: [0, 0, False, False]), {}
    out = []

    def rested(p):
        x = held[p]
        out.append((p, "rested", x[0], *x, not x[2] and not x[3]))
        resting[p] = False

    for seq, p, ts, o in sorted(outcomes, key=lambda x: (x[2], x[0])):
        now, x = int(ts.replace(tzinfo=datetime.UTC).timestamp() * 1000), held[p]
        if resting.get(p) and x[0] <= now:
            rested(p)
        if x[0] <= now and x[1] >= 3:
            x[1] = 0
        x[1] = 0 if o == "success" else x[1] + (o == "timeout")
        rest = {"rate-limited": 300_000, "unknown": 60_000}.get(o, 600_000 if o == "timeout" and x[1] >= 3 else None)
        if rest is not None:
            x[0], resting[p] = now + rest, True
        x[2], x[3] = x[2] or o == "exhausted", x[3] or o == "misconfigured"
        out.append((p, o, now, *x, not x[2] and not x[3] and x[0] <= now))
    for p in [p for p, is_ in resting.items() if is_ and held[p][0] <= watermark]:
        rested(p)
    return out


OUTCOME = "seq long, provider string, ts timestamp, outcome string"


def test_provider_states_by_event_time_equal_brute_force(spark, tmp_path):
    r = random.Random(8)
    outcomes = [(i, r.choice("pqrst"), at(r.randint(0, 600) / 7), r.choice(["success", "rate-limited", "timeout", "timeout", "timeout", "unknown", "bad"] + ["exhausted"] * (i > 150))) for i in range(160)]
    outcomes = [(i, p, ts.replace(microsecond=0), o) for i, p, ts, o in outcomes] + [(999, "z", at(95), "success")]
    stream, add = fed(spark, tmp_path, OUTCOME)
    add(outcomes)
    with live.rocksdb(spark):
        query = live.provider_rests(stream, clock="event").writeStream.format("memory").queryName("rests").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()
    watermark = int(at(94).replace(tzinfo=datetime.UTC).timestamp() * 1000)
    assert sorted(map(tuple, spark.table("rests").collect())) == sorted(plain_rests(outcomes, watermark))


def test_a_rest_ends_by_its_timer_without_another_row(spark, tmp_path):
    stream, add = fed(spark, tmp_path, OUTCOME)
    add([(1, "p", at(0), "rate-limited"), (2, "q", at(0), "success")])
    with live.rocksdb(spark):
        query = live.provider_rests(stream, rest={"rate-limited": 1500}).writeStream.format("memory").queryName("timed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
        try:
            until = time.time() + 120
            while time.time() < until and not spark.table("timed").filter("event = 'rested'").count():
                time.sleep(0.5)
            add([(3, "p", at(0), "exhausted")])
            while time.time() < until and spark.table("timed").count() < 4:
                time.sleep(0.5)
        finally:
            query.stop()
    got = {x.event: x for x in spark.table("timed").collect()}
    assert set(got) == {"rate-limited", "success", "rested", "exhausted"} and got["rested"].available and not got["rate-limited"].available
    assert got["rested"].at_ms == got["rate-limited"].cooling_down_until == got["rate-limited"].at_ms + 1500 and not got["exhausted"].available


def test_rate_stats_of_ranges(spark):
    requests = [(i, "first", i * 1000, 5) for i in range(100)]
    got = feedback.rate_stats(spark.createDataFrame(requests, REQUEST), 99_000).first()
    assert (got.rpm_used, got.tpm_used, got.rpd_used, got.tpd_used, got.rpm_limit) == (60, 300, 100, 500, 30.0)


def test_a_job_goes_from_texts_to_decisions_and_learns(spark, tmp_path):
    from tersemill import job
    from tersemill.settings import Settings

    folder = f"file://{tmp_path}/job"
    long = "We basically need it in order to win, and that is all there is to say about it. "
    texts = spark.createDataFrame([(i, f"{long}{i}") for i in range(6)] + [(6, None), (7, "short")], "id int, text string")
    choices = spark.createDataFrame([(i, "original", True) for i in range(5)] + [(5, "reject", True), (5, "reject", True)], "id int, choice string, delivered boolean")
    shown = Settings(preset="balanced", tier0_preview=True)
    first = {x.id: x for x in job.run(texts, "id", folder, shown, choices=choices).collect()}
    assert {i: first[i].decision for i in range(8)} == {**dict.fromkeys(range(5), "reverted"), 5: "rejected", 6: "accepted", 7: "accepted"}
    assert all(first[i].delivered == f"{long}{i}" for i in range(6)) and first[6].delivered is None and first[7].delivered == "short"
    # five reverts exclude the phrases, so the next run leaves them in
    gone = job.excluded_phrases(spark, folder)
    assert "basically" in gone
    second = job.run(texts, "id", folder, Settings(preset="balanced"))
    again = {x.id: x for x in second.collect()}
    assert all("basically" in again[i].delivered and again[i].decision == "accepted" for i in range(6))
    assert {x.decision: x.runs for x in job.summary(second).collect()} == {"accepted": 7}
    assert job.run(texts.limit(0), "id", folder).count() == 0
