import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tersemill import settings
from tersemill.functions import columns as C
from tersemill.functions import exact_tokens, rewriting, segments
from tersemill.operators import compression, failover, feedback
from tersemill.operators import sentences as S
from tersemill.sources import tables
from tersemill.streaming import live

N = 100_000
LONG = {
    "dividers": "---\n" * (N // 4) + "end",
    "dividers apart": ("---   " + "\n") * (N // 7),
    "blanks": "a" + " " * N + "b.",
    "tabs": "x\t" * (N // 2),
    "newlines": "- a" + "\n" * N + "b",
    "repeats": "word " * (N // 5),
    "comma repeats": "go, " * (N // 4),
    "signs": "!" * N + "a",
    "marks": ", . ; " * (N // 6),
    "digits": "1" * N,
    "bullets": "- a\n\n" * (N // 5),
    "headings": "#" * N + " x",
    "sentences": "A b. " * (N // 5),
    "questions": "also and? " * (N // 10),
    "keys": "-----BEGIN " * (N // 11) + "password = " * 10,
    "entities": "<&>" * (N // 3),
    "letters": "ab" * (N // 2),
}


def test_no_pattern_fails_on_long_texts(spark):
    df = spark.createDataFrame(list(LONG.items()), "name string, t string").repartition(8)
    t = F.col("t")
    made = [C.heuristic_tokens(t), C.word_tokens(t), C.minify(t), C.trim_markdown(t), C.merge_punctuation(t), C.collapse_repeats(t), F.size(C.sentences(t)), F.size(C.terms(t)), C.subject(t), C.resolved(t, F.lit("s")), C.constraints_first(t), F.size(C.secrets(t)), C.escape_html(t), C.output_verdict(t, t), C.error_class(F.lit(1), F.lit("x"), t)]
    began = time.time()
    got = {r["name"]: r for r in df.select("name", *(c.alias(f"c{i}") for i, c in enumerate(made))).collect()}
    assert time.time() - began < 60
    assert got["dividers"]["c3"] == "---\nend" and got["dividers apart"]["c3"] == "---\n"
    assert got["repeats"]["c5"] == "word " * 4 and got["comma repeats"]["c5"] == "go, "
    assert got["blanks"]["c6"] == 1 and got["sentences"]["c6"] == N // 5
    for name, text in LONG.items():
        assert got[name]["c0"] == rewriting.count_tokens(text), name
        assert got[name]["c3"] == rewriting.trim_markdown(text), name


def plain_collapse(text):
    """A run of one to four words said again right after itself, by looking at words only."""
    return re.sub(r"(?<![A-Za-z0-9_])([A-Za-z][A-Za-z']*(?:\s+[A-Za-z][A-Za-z']*){0,3})(?![A-Za-z0-9_])(?:\s*,?\s+\1(?![A-Za-z0-9_]))+", r"\1", text, flags=re.I | re.A)


def test_collapse_repeats_equals_the_plain_pattern(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["the ", "The ", "cat ", "a b ", ", ", "it's ", "x1 ", "\n", "the, the", ". "]) for _ in range(r.randint(1, 20))) for _ in range(500)]
    got = [x["t"] for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(C.collapse_repeats(F.col("t")).alias("t")).collect()]
    assert got == [plain_collapse(t) for t in texts] == [rewriting.collapse_repeats(t) for t in texts]


def test_time_of_rewriting_grows_with_the_text():
    for name in ("repeats", "sentences", "bullets", "digits", "marks", "blanks"):
        began = time.time()
        rewriting.compress(LONG[name])
        assert time.time() - began < 15, name
    began = time.time()
    parts = segments.parse_segments("12 ab " * 16_000)
    assert time.time() - began < 5 and "".join(p.content for p in parts) == "12 ab " * 16_000


def test_segments_of_each_kind():
    text = "See `x y` and http://a.b/c?d, \"a quote\" or 'one more' with abc12345 for 12.5px.\n```\ncode\n```\nfunction f() {\n  return 1;\n}\nEnd here."
    got = [(s.type, s.content) for s in segments.parse_segments(text) if s.protected]
    assert got == [
        ("inline_code", "`x y`"),
        ("url", "http://a.b/c?d"),
        ("quoted", '"a quote"'),
        ("quoted", "'one more'"),
        ("alphanumeric_token", "abc12345"),
        ("number", "12.5px"),
        ("code_block", "```\ncode\n```"),
        ("code_block", "function f() {\n  return 1;\n}"),
    ]
    assert [s.type for s in segments.parse_segments('"' + "x" * 300 + '"')] == ["editable"]


def test_similar_sentences_equal_all_pairs():
    r = random.Random(9)
    for least in (0.05, 0.3, 0.65, 0.9):
        for _ in range(40):
            sentences = [" ".join(r.choice("aa bb cc dd ee ff gg hh ii jj kk".split()) for _ in range(r.randint(0, 7))) for _ in range(r.randint(0, 14))]
            x = rewriting.Similar(sentences, least)
            every = [(i, j) for i in range(len(sentences)) for j in range(i + 1, len(sentences)) if x.vectors[i] and x.vectors[j] and x.cosine(i, j) >= least]
            assert [(i, j) for i, j, _ in x.pairs()] == every


def test_dedup_keeps_merges_and_reads_the_table_once(spark):
    df = spark.createDataFrame([(1, "The cat sat on the mat. A dog ran. The cat sat on the mat!"), (2, None), (3, ""), (4, "One.")], "id int, text string")
    out = S.dedup_sentences(df, "id")
    got = {r["id"]: r for r in out.collect()}
    assert got[1]["text"] == "The cat sat on the mat. A dog ran." and got[1]["removed"] == 1
    assert [(m["kept"], m["dropped"], m["similarity"]) for m in got[1]["merges"]] == [("The cat sat on the mat.", "The cat sat on the mat!", 1.0)]
    assert got[2]["text"] is None and got[3]["text"] == "" and got[4]["text"] == "One."
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_pipeline_of_hot_and_blank_texts(spark):
    long = "I basically need it. " * 5
    rows = [(i, long if i % 2 else None if i % 3 else "  ") for i in range(60)] + [(60, long + "x"), (61, "short")]
    out = compression.compress_pipeline(spark.createDataFrame(rows, "id int, text string"), "id", "safe")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1 and plan.count("Scan") == 1  # one scan, no shuffle
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == 62
    for i, t in rows:
        if t and len(t) > 20:
            assert got[i]["result"] == rewriting.multi_pass(t, "safe")["result"] and got[i]["tier"] == "multi-pass"
        else:
            assert got[i]["result"] == t and got[i]["tier"] == "0" and not got[i]["escalate"]


def plain_admit(requests, limits):
    """Every rule by going through all that was admitted."""
    out, admitted = {}, {}
    day = {}
    for i, p, now, n in sorted(requests, key=lambda x: (x[1], x[2], x[0])):
        rpm, tpm, rpd, tpd = limits.get(p, feedback.DEFAULT_LIMITS)
        if p not in day or now - day[p] > feedback.DAY:
            day[p] = now
            admitted[p, "day"] = []
        minute = [(t, m) for t, m in admitted.get(p, []) if t > now - feedback.MINUTE]
        today = admitted[p, "day"]
        if len(minute) >= rpm or sum(m for _, m in minute) + n > tpm:
            out[i] = (False, max(minute[0][0] + feedback.MINUTE - now, 1000) if minute else 1000)
        elif len(today) >= rpd or sum(today) + n > tpd:
            out[i] = (False, -1)
        else:
            out[i] = (True, 0)
            admitted.setdefault(p, []).append((now, n))
            today.append(n)
    return out


def random_requests():
    r = random.Random(5)
    return [(i, r.choice(["first", "second", "third", "other"]), r.randrange(0, 3 * feedback.DAY) // 7 if i % 3 else r.randrange(0, 300_000), r.randrange(1, 3000)) for i in range(1500)]


def test_admission_equals_the_rules(spark):
    rows = random_requests()
    limits = {"first": (3.0, 5000.0, 60.0, 90_000.0), "second": (5.0, 4000.0, float("inf"), 200_000.0)}
    got = {r["id"]: (r["admitted"], r["wait_ms"]) for r in feedback.admit(spark.createDataFrame(rows, "id long, provider string, ts_ms long, tokens long"), limits).collect()}
    want = plain_admit(rows, limits)
    assert got == want and {x[1] for x in want.values()} >= {0, -1, 1000}


def test_live_admission_and_token_windows(spark, tmp_path):
    rows = random_requests()[:300]
    schema = "id long, provider string, ts_ms long, tokens long"
    tables.write(spark.createDataFrame(rows, schema), f"{tmp_path}/in")
    stream = tables.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
    q = tables.write_stream(live.admit_live(stream), f"{tmp_path}/out", f"{tmp_path}/ckpt")
    q.processAllAvailable()
    q.stop()
    got = {r["id"]: (r["admitted"], r["wait_ms"]) for r in tables.read(spark, f"{tmp_path}/out").collect()}
    assert got == plain_admit(rows, feedback.LIMITS)
    texts = [(f"2024-01-01 0{h}:10:00", "a b c") for h in (1, 1, 2)]
    tables.write(spark.createDataFrame(texts, "ts string, text string").select(F.col("ts").cast("timestamp").alias("ts"), "text"), f"{tmp_path}/texts")
    events = tables.read_stream(spark, f"{tmp_path}/texts", tables.read(spark, f"{tmp_path}/texts").schema)
    q = live.token_windows(events).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["window"]["start"].hour, r["texts"], r["tokens"]) for r in spark.table("windows").collect()) == [(1, 2, 10), (2, 1, 5)]


@pytest.mark.parametrize("form", ["csv", "json", "orc", "parquet"])
def test_formats(spark, tmp_path, form):
    df = spark.createDataFrame([(1, "a"), (2, "b, c")], "id int, text string")
    tables.write(df, f"{tmp_path}/{form}", form)
    assert sorted(tables.read(spark, f"{tmp_path}/{form}", form, df.schema).collect()) == sorted(df.collect())
    assert tables.write_or_keep(df, f"{tmp_path}/{form}", f"{tmp_path}/spare", form) == "spare: AnalysisException"
    assert tables.read(spark, f"{tmp_path}/spare", form, df.schema).count() == 2
    assert tables.write_or_keep(df, f"{tmp_path}/new", f"{tmp_path}/unused") == "success"


def test_failover(spark):
    clock = [0.0]
    said = {("a", False): "rate-limited", ("b", False): "overcompressed", ("b", True): "expanded", ("c", False): "ok"}
    asked = []

    def call(p, text, again):
        asked.append((p, again))
        return said[p, again], text.upper(), 7

    chain = failover.Chain(["a", "b", "c"], lambda: clock[0])
    assert failover.rewrite("x", chain, call) == {"result": "X", "provider": "c", "tokens_used": 7, "success": True, "attempts": 3}
    assert asked == [("a", False), ("b", False), ("b", True), ("c", False)]
    asked.clear()
    failover.rewrite("x", chain, call)
    assert ("a", False) not in asked and ("b", False) in asked  # a rests; b was skipped for one text only
    clock[0] = 300_000
    asked.clear()
    failover.rewrite("x", chain, call)
    assert asked[0] == ("a", False)
    # three timeouts in a row rest ten minutes, credit and configuration are out for good, and the text stays
    chain = failover.Chain(["t", "e"], lambda: clock[0])
    got = failover.rewrite("x", chain, lambda p, t, again: ("timeout" if p == "t" else "exhausted", None, 0))
    assert got == {"result": "x", "provider": "fallback", "tokens_used": 0, "success": False, "attempts": 4}
    assert chain.rests == {"t": clock[0] + 600_000} and chain.out == {"e"}
    df = spark.createDataFrame([(1, "one"), (2, None)], "id long, text string")
    rows = {r["id"]: r for r in failover.rewrite_remotely(df, "id", ["p"], lambda p, t, again: ("ok", t + "!", 1)).collect()}
    assert rows[1]["result"] == "one!" and rows[2]["result"] == "!" and rows[1]["provider"] == "p"


def test_provider_state(spark):
    schema = "provider string, position int, has_key boolean, cooling_down_until long, consecutive_timeouts int, credit_exhausted boolean, misconfigured boolean, renewable boolean, note string"
    rows = [("a", 0, False, 0, 0, False, False, True, "x"), ("b", 1, True, 0, 2, False, False, True, "x"), ("c", 2, True, 0, 0, True, True, False, "x"), ("d", 3, True, 0, 0, True, False, True, "x")]
    state = spark.createDataFrame(rows, schema)
    assert feedback.pick_provider(state, 10).first()["provider"] == "b"
    after = feedback.after_outcomes(state, spark.createDataFrame([("b", "timeout")], "provider string, outcome string"), 10)
    assert after.columns == state.columns and feedback.pick_provider(after, 10).count() == 0
    assert after.filter("provider = 'b'").first()["cooling_down_until"] == 600_010
    assert feedback.pick_provider(after, 600_010).first()["provider"] == "b"
    fresh = {r["provider"]: r for r in feedback.with_keys(after, spark.createDataFrame([("a", True)], "provider string, has_key boolean")).collect()}
    assert fresh["a"]["has_key"] and fresh["b"]["cooling_down_until"] == 0 and fresh["c"]["credit_exhausted"] and not fresh["c"]["misconfigured"] and not fresh["d"]["credit_exhausted"]
    assert feedback.with_credit(after).filter("credit_exhausted").count() == 0 and feedback.with_credit(after, "c").filter("credit_exhausted").count() == 1
    config = state.select("provider", "position", "renewable", "has_key").withColumn("model", F.lit("m"))
    listing = feedback.provider_listing(config, state.filter("provider <> 'b'"), 10)
    assert [(r["provider"], r["available"]) for r in listing.collect()] == [("a", False), ("b", True), ("c", False), ("d", False)]


def test_feedback_history_and_undo(spark):
    t = F.timestamp_seconds(F.lit(5))
    done = spark.createDataFrame([(1, [("um", "", "um")], "accepted"), (2, [("so", "", "so"), ("so", "", "So")], "accepted"), (3, [("well", "", "well")], "rejected")], "seq long, removals array<struct<phrase:string,replacement:string,original:string>>, decision string").withColumn("ts", t)
    back = feedback.undone(done)
    assert [(r["seq"], r["decision"]) for r in back.collect()] == [(2, "undone")]
    log = feedback.phrase_log(feedback.feedback_of(done.unionByName(back)))
    assert {r["phrase"]: (r["applied"], r["reverted"]) for r in log.collect()} == {"um": (1, 0), "so": (2, 2)}
    events = feedback.removal_events(done, "apply", t)
    assert events.count() == 4
    log = feedback.phrase_log(events.unionByName(feedback.toggle_events(spark, {"um": True}, 9, __import__("datetime").datetime(2024, 1, 1))))
    assert [r["phrase"] for r in feedback.excluded_phrases(log).collect()] == ["um"]
    words = spark.createDataFrame([("filler", "Um"), ("swap", "um"), ("filler", "so")], "kind string, phrase string")
    assert sorted(map(tuple, feedback.without_excluded(words, log).collect())) == [("filler", "so"), ("swap", "um")]
    assert feedback.empty_log(spark).columns == log.columns
    history = spark.createDataFrame([(i, f"t{i}") for i in range(12)], "id long, text string")
    assert feedback.recover(history, 5).first()["text"] == "t5" and feedback.recover(history, 1).count() == 0
    more = feedback.with_entry(history, spark.createDataFrame([(99, "n")], "id long, text string"))
    assert more.count() == 10 and more.first()["id"] == 99 and feedback.cleared(history).count() == 0
    with pytest.raises(ValueError):
        feedback.removal_events(done, "toggle_on", t)


def test_settings_and_providers():
    s = settings.read_settings(None)
    assert s == settings.Settings() and settings.read_settings(s.with_(target=0.3).to_json()).target == 0.3
    assert settings.read_settings("{broken").preset == "balanced" and settings.read_settings('{"aggressiveness": 2}').preset == "balanced"
    assert settings.read_settings('{"aggressiveness": 1}').preset == "safe" and settings.read_settings('{"aggressiveness": 5, "preset": "max", "other": 1}').preset == "max"
    for bad in ({"preset": "none"}, {"target": 0.95}, {"cloud_fallback": 1}):
        with pytest.raises(ValueError):
            settings.read_settings(json.dumps(bad))
    p = settings.Provider("a", "http://a", "m", key="secret")
    assert settings.read_providers(settings.write_providers([p]), []) == [p]
    assert settings.read_providers("[1]", [p]) == [p] and settings.read_providers(None, [p]) == [p]
    assert settings.provider_rows([p]) == [("a", 0, "m", True, True)]


def test_exact_tokens(spark):
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    path = P.path("byte_bpe_50k.json")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello, world! 123", "", None, "é漢😀  x\n\n", "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("ids", exact_tokens.tokenize(F.col("t"), path))
    for r in df.select("i", "ids", exact_tokens.count_tokens(F.col("t"), path).alias("n"), exact_tokens.detokenize(F.col("ids"), path).alias("back")).collect():
        t = texts[r["i"]] or ""
        assert r["ids"] == own.encode_ordinary(t) and r["n"] == len(r["ids"]) and r["back"] == t
    r = df.select(exact_tokens.count_tokens(F.col("t")).alias("n"), exact_tokens.tokenize(F.col("t")).alias("ids"), exact_tokens.detokenize(F.col("ids")).alias("back")).orderBy("n").collect()
    assert [x["n"] for x in r] == sorted(rewriting.count_tokens(t) for t in texts) and r[0]["ids"] == [] and r[-1]["ids"] is None and r[-1]["back"] is None


def test_sql_functions_and_remote_stage(spark):
    compression.register(spark)
    assert spark.sql("SELECT count_tokens('a b'), minify_text('x  \n\n\n\ny'), compress_text('I basically need it.')").first()[:] == (3, "x\n\ny", rewriting.compress("I basically need it.")["result"])
    got = spark.sql("SELECT s.type, s.content FROM VALUES ('see `x` now') AS v(t), LATERAL text_segments(t) AS s").collect()
    assert [tuple(r) for r in got] == [("editable", "see "), ("inline_code", "`x`"), ("editable", " now")]
    assert [tuple(r) for r in spark.sql("SELECT i, sentence, density FROM text_sentences('Aa bb. Cc cc!')").collect()] == [(0, "Aa bb.", 1.0), (1, "Cc cc!", 0.5)]
    df = spark.createDataFrame([(1, "a"), (2, "bad")], "id int, text string")

    def call(t):
        if t == "bad":
            raise RuntimeError("no")
        return t + t

    assert sorted(map(tuple, compression.map_remote(df, "id", call).collect())) == [(1, "aa", None), (2, None, "no")]


def test_presets_equal_their_passes(spark):
    texts = ["I basically need it in order to go. " * 4 + "The cat is here. The cat is here. Must be done. It is fine, i think. " * 2, "plain words only and nothing else to say here at all today"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for name, (level, hedging, most, local, share) in rewriting.PRESETS.items():
        got = {r["id"]: r for r in compression.compress_pipeline(df, "id", name).collect()}
        for i, t in enumerate(texts):
            now, left, k = t, rewriting.count_tokens(t), 0
            for k in range(1, most + 1):
                now = rewriting.compress(now, level, frozenset(), hedging)["result"]
                now = rewriting.compress_local(now, share or 0.2)[0] if local else now
                before, left = left, rewriting.count_tokens(now)
                if before - left < 5:
                    break
            assert (got[i]["result"], got[i]["passes"], got[i]["compressed_tokens"]) == (now, k, left)
    assert rewriting.preset_of("x") == rewriting.preset_for_level(3) == "balanced" and rewriting.preset_for_level(1) == "safe" and rewriting.preset_for_level(5) == "aggressive"
