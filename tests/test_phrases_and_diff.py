import random
import time

import pyarrow.parquet as pq

from tersemill.functions import diff, phrases, rewriting
from tersemill.functions.automaton import WORDS, PhraseAutomaton
from tersemill.operators import compression
from tersemill.sources.tables import spread

D = "/root/testdata/sf0.001"


def texts_with_phrases(n, seed):
    r = random.Random(seed)
    known = [e.phrase for es in phrases.ENTRIES.values() for e in es]
    odd = ["word", "x, y", ". ", ",", "(or 1)", "\n\n", "- a\n", "12px", "é", "..", "?", "nonbasically", "re-utilization"]
    out = []
    for _ in range(n):
        p = lambda: r.choice([str, str.title, str.upper])(r.choice(known))
        out.append("".join((p() if r.random() < 0.4 else r.choice(odd)) + r.choice([" ", " ", "  ", "", "\n", "."]) for _ in range(r.randint(1, 25))))
    return out


def one_by_one(text, entries, put):
    for e in entries:
        if e.phrase in text.lower():
            text = put(text, e)
    return text


def test_automaton_equals_looking_for_each_phrase():
    texts = texts_with_phrases(600, 1) + pq.read_table(f"{D}/documents.parquet").column("text").to_pylist()
    for level in (1, 3, 5):
        lists, made = rewriting.dictionaries(level, True, frozenset()), rewriting.replacers(level, True, frozenset())
        for t in texts:
            gone, want_gone = [], []

            def drop(x, e, want_gone=want_gone):
                x, more = rewriting.drop_phrase(x, e)
                want_gone += more
                return x

            assert made[0].drop(t, gone) == one_by_one(t, lists[0], drop) and gone == want_gone
            for k in (1, 2):
                assert made[k].shorten(t) == one_by_one(t, lists[k], rewriting.put_short)


def test_failure_links_find_every_phrase():
    r = random.Random(2)
    for _ in range(300):
        listed = list({" ".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 12))}) + ["!"]
        words = [r.choice("abcd") for _ in range(r.randint(0, 30))]
        want = {i for i, p in enumerate(listed) if not WORDS.search(p) or f" {p} " in f" {' '.join(words)} "}
        assert PhraseAutomaton(listed).present(" ".join(words)) == want


def test_diff_is_shortest_and_rebuilds_both_texts(spark):
    r = random.Random(3)
    for _ in range(400):
        x = [r.choice("abcdef") for _ in range(r.randint(0, 60))]
        y = [c for c in x if r.random() < 0.8] if r.random() < 0.5 else [r.choice("abcdef") for _ in range(r.randint(0, 60))]
        found = diff.matches(list(map(ord, x)), list(map(ord, y)))
        assert all(x[i] == y[j] for i, j in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))
        row = [0] * (len(y) + 1)
        for a in x:
            new = [0]
            for j, b in enumerate(y):
                new.append(row[j] + 1 if a == b else max(row[j + 1], new[j]))
            row = new
        assert len(found) == row[-1]
        old, new = " ".join(x) + "\n", "  ".join(y)
        got = diff.word_diff(old, new)
        assert "".join(v for op, v in got if op != "insert") == old and "".join(v for op, v in got if op != "delete") == new
    assert diff.word_diff(None, None) == [] and diff.word_diff("a b", None) == [("delete", "a b")] and diff.word_diff("a b c", "a c") == [("equal", "a "), ("delete", "b "), ("equal", "c")]
    rows = spark.createDataFrame([("a b", "a c"), (None, "x"), ("", "")], "a string, b string").select(compression.word_diff("a", "b").alias("d")).collect()
    assert [[tuple(p) for p in x.d] for x in rows] == [[("equal", "a "), ("delete", "b"), ("insert", "c")], [("insert", "x")], []]


def test_diff_of_long_texts_is_fast():
    r = random.Random(4)
    words = [f"w{r.randint(0, 3000)}" for _ in range(20_000)]
    began = time.process_time()
    diff.word_diff(" ".join(words), " ".join(w for w in words if r.random() < 0.7))
    diff.word_diff(" ".join(words), " ".join(f"w{r.randint(0, 3000)}" for _ in range(20_000)))
    assert time.process_time() - began < 8  # about two seconds on an idle machine


def test_restructure_is_linear_and_keeps_repeats():
    assert rewriting.restructure("Go on. Must stay. Go on. Must stay.") == "CONSTRAINTS: Must stay. Must stay.\n\nGo on. Go on."
    text = " ".join(f"Must do {i}. Plain {i}." for i in range(20_000))
    began = time.process_time()
    rewriting.restructure(text)
    assert time.process_time() - began < 1


def test_only_small_scans_are_dealt_over_the_cores(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "one"))
    assert "RoundRobin" in spread(spark.read.parquet(str(tmp_path / "one")).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    spark.range(0, 1000, 1, 8).write.parquet(str(tmp_path / "many"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")
    try:
        assert "RoundRobin" not in spread(spark.read.parquet(str(tmp_path / "many")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_claims_by_a_sweep_equal_the_parser(spark):
    from pyspark.sql import functions as F

    from tersemill.functions import segments

    odd = ["See `x 12` and http://a.b/c?d=12, \"a 12 quote\" 'or `one` more' abc12345 12.5px\n```\ncode 12 'q'\n```\nfunction f() {\n  return 12;\n}\nEnd.", "", None, "'12' \"www.x.y 'z1234567'\" `a`b`c`"]
    texts = odd + texts_with_phrases(40, 5) + [x["html"] for x in spark.read.parquet(f"{D}/pages.parquet").select("html").collect()] + pq.read_table(f"{D}/documents.parquet").column("text").to_pylist()
    got = {}
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "id int, text string, type string, level int")
    for x in compression.claimed(rows.select("id", F.col("text")), "id").collect():
        got.setdefault(x.id, []).append((x.start, x.end, x.type))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == [(s.start, s.end, s.type) for s in segments.parse_segments(t or "") if s.protected]
