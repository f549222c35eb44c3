import functools
import hashlib
import json
import random
import re
import time
import tracemalloc
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tersemill.llm import bpe_codec, embedding_dedup, exact_dedup, html_extract, jaccard_join, mixing, pii, token_counts, toxicity, url_filter

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, h double"


def frame(spark, texts, sources=None):
    """Documents with columns whose names clash with inner ones."""
    rows = [(i, t, "en", sources[i] if sources else "s", 0, "x", 7, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGE = [None, "", " ", "a", "a b c d e f g", "a b c d e f g", "word " * 20_000, "x" * 50_000, "é漢😀\n\t▁", "<|endoftext|>A b", "a b c d e f g"]


def rows(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_token_counts(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = rows(token_counts.count_tokens(frame(spark, EDGE), path))
    for i, t in enumerate(EDGE):
        n = len(sp.encode(t or ""))
        assert got[i] == {"doc_id": i, "n_bytes": len((t or "").encode()), "n_tokens": n, "over_limit": n > 4096}
    assert token_counts.count_tokens(frame(spark, []), path).count() == 0
    r = random.Random(2)
    words = ["the", "▁x", "é", "漢字", "😀", " ", "  ", "\n", "\t", "1234", "a" * 50, "Ünïcode", "\u00a0", "\ufb01", "<s>", "ＡＢ", "e\u0301"]
    texts = ["".join(r.choice(words) for _ in range(r.randint(1, 30))) for _ in range(300)]
    texts += [x["text"] for x in spark.read.parquet(f"{D}/documents.parquet").select("text").collect()]
    got = rows(token_counts.count_tokens(frame(spark, texts), path))
    assert [got[i]["n_tokens"] for i in range(len(texts))] == [len(sp.encode(t or "")) for t in texts]


def test_bpe_codec(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    r = random.Random(4)
    texts = EDGE + ["".join(r.choice("aaabBC  '.s0é<|>") for _ in range(r.randint(1, 80))) for _ in range(200)]
    got = rows(bpe_codec.bpe_codec(frame(spark, texts), path, full=True))
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids) and got[i]["decoded"] == decoded
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_bpe_automaton():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok, codec = Tokenizer.from_file(path), bpe_codec.BpeCodec(open(path, encoding="utf-8").read())
    r = random.Random(11)
    vocabulary = [t.removesuffix("</w>") for t in tok.get_vocab()]
    made = (lambda: "".join(r.choice(vocabulary) for _ in range(r.randint(1, 4))), lambda: "".join(r.choice("aeinstrhlo") for _ in range(r.randint(1, 14))), lambda: r.choice("ab") * r.randint(1, 40))
    for k in range(6000):
        w = made[k % 3]()
        assert codec.encode(w) == tok.encode(w, add_special_tokens=False).ids, w
    # the table by its definition: two tokens may follow each other if merging their letters gives them back
    auto = codec.automaton
    bare = [i for t, i in tok.get_vocab().items() if not t.endswith("</w>") and t.isascii() and t.isalpha()]
    for _ in range(3000):
        a, b = r.choice(bare), r.choice(bare)
        text = auto.label[a] + auto.label[b]
        assert auto.arc(a, b) == (read(auto, text)[-1:] == [b] and read(auto, text) == [a, b]), text
    with pytest.raises(ValueError):
        auto.encode("a b")


def read(auto, text):
    """The tokens of text as the beginning of a word, by merging pairs in order of rank."""
    rank = read.rank or read.rank.update({p: k for k, p in enumerate(merges())}) or read.rank
    parts = list(text)
    while True:
        best = min(((rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
        if best is None:
            return [ids()[p] for p in parts]
        a, b = parts[best[1] : best[1] + 2]
        k, out = 0, []
        while k < len(parts):
            if parts[k : k + 2] == [a, b]:
                out.append(a + b)
                k += 2
            else:
                out.append(parts[k])
                k += 1
        parts = out


read.rank = {}


@functools.cache
def tokenizer_file():
    return json.load(open(P.path("word_bpe_49k.json"), encoding="utf-8"))["model"]


def merges():
    return [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in tokenizer_file()["merges"]]


def ids():
    return tokenizer_file()["vocab"]


def test_exact_dedup(spark):
    texts = EDGE + ["hot"] * 300 + ["pair", "pair"]
    got = rows(exact_dedup.exact_dedup(frame(spark, texts), counters=4))
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(ids), len(ids), i == max(ids))
            assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_mixing(spark, monkeypatch):
    r = random.Random(1)
    sources = [r.choice(["a", "a", "a", "b", "c", None, ""]) for _ in range(600)] + ["tiny", "none"]
    texts = ["w " * r.randint(0, 40) for _ in range(600)] + ["w w", None]
    df = mixing.mix(frame(spark, texts, sources), shards=8)
    got = rows(df)
    assert got == rows(mixing.mix(frame(spark, texts, sources), shards=8))
    size = {s: sum(got[i]["size"] for i in got if sources[i] == s) for s in set(sources)}
    total = sum(size.values())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:  # share, cap, share again
        rest = total - sum(3 * size[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * size[s] if s in capped else rest * weight[s] / w for s in order}
        over = {s for s in order if target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    for s in order:
        own = [got[i] for i in got if sources[i] == s]
        assert all(abs(x["target"] - target[s]) < 1e-6 * max(1, total) and x["source_size"] == size[s] for x in own)
        assert abs(sum(x["taken"] for x in own) - target[s]) <= 41
        assert all(x["taken"] == x["size"] * len(x["shards"]) <= 3 * x["size"] for x in own)
    assert mixing.draws(df).count() == sum(len(x["shards"]) for x in got.values())
    # units are dealt evenly: shards differ by the size of their blocks only
    monkeypatch.setattr(mixing, "SMALL", 2)  # only frequent sources are broadcast; nothing else may change
    assert rows(mixing.mix(frame(spark, texts, sources), shards=8)) == got
    monkeypatch.setattr(mixing, "GROUP", 3)  # other draws of the tree, but what a source gives stays
    other = rows(mixing.mix(frame(spark, texts, sources), shards=8))
    plain = lambda x: {i: (r["size"], r["target"], r["taken"], len(r["shards"])) for i, r in x.items()}
    assert plain(other) == plain(got) and other != got
    assert mixing.mix(frame(spark, [])).count() == 0


def test_shards_are_even_at_any_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COARSE", 4)
    monkeypatch.setattr(mixing, "BLOCKS", 64)
    rows_ = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"))
    for shards in (4, 32, 128):
        df = mixing.mix(rows_, shards=shards)
        sizes = [x["count"] for x in mixing.draws(df).groupBy("shard").count().collect()]
        assert len(sizes) == shards and max(sizes) <= 2 * sum(sizes) / shards
        # whatever the shards, the mixture takes the same
        taken = df.agg(F.sum("taken"), F.sum(F.xxhash64("doc_id", "taken").cast("decimal(38,0)"))).first()
        assert shards == 4 or taken == before
        before = taken


def test_tables_of_many_bytes_are_not_broadcast(spark, monkeypatch):
    from tersemill.llm import common

    df = common.materialize(spark.range(2000).select("id", F.expr("sha2(cast(id as string), 256)").alias("s")), "t")
    assert "ResolvedHint" in common.hinted(df)._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(common, "FEW_BYTES", 1000)
    assert "ResolvedHint" not in common.hinted(df)._jdf.queryExecution().analyzed().toString()
    common.discard(df)


def test_mixing_tree_splits_quotas_exactly(spark):
    quotas = [[7, 0, 12], [3, 30, 1]]
    df = spark.createDataFrame(list(enumerate(quotas)), "g int, q array<long>")
    for part in (df, df.limit(1)):
        want = [q for g, q in enumerate(quotas) if part is df or g == 0]
        total = sum(map(sum, want))
        leaves = mixing.split_quotas(part, 4, 1).collect()
        assert len(leaves) == 4 * len(want)
        for g, q in enumerate(want):
            assert [sum(x) for x in zip(*(r["q"] for r in leaves if r["g"] == g), strict=True)] == q
        sizes = [sum(sum(r["q"]) for r in leaves if r["shard"] == k) for k in range(4)]
        assert sum(sizes) == total and max(sizes) - min(sizes) <= 1
    # what shards get of a source has the variance of the hypergeometric distribution
    hits = [r["q"][0] for r in mixing.split_quotas(spark.range(1).selectExpr("0 as g", "array(256L, 768L) as q"), 64, 3).collect()]
    assert np.mean(hits) == 4 and 1.5 < np.var(hits) < 5


def test_html():
    page = html_extract.Page("<html><body><nav>menu</nav><div class='cookie-notice'>no</div><article><h1>T &amp; U</h1><p>one <b>two</b>\n three<p>four<script>var t='</p>'</script><ul><li>x<li>y</ul><div class=comments><p>no</p></div></article><footer>f</footer>")
    assert page.text(None) == "T & U\none two three\nfour\nx\ny"
    assert html_extract.Page("").text(None) == "" and html_extract.Page("<p").text(None) == ""


@pytest.mark.parametrize("page", ["<a '", "<div>", "<a '>'", "<!", "<", "<a \"<b '", "<i>", "<p>", "<div class='"])
@pytest.mark.parametrize("end", ["", "</b>", "<h1></h1>", "</section>", "'>", "</script"])
def test_html_of_odd_pages_is_linear(page, end):
    n = 100_000
    text = page * (n // len(page)) + "<script>" * (end == "</script") + (end * (n // len(end)) if end else "") + "<p>last"
    began = time.time()
    html_extract.Page(text).text("/html/body")
    assert time.time() - began < 2
    tracemalloc.start()
    html_extract.Page(text).text(None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20


def test_html_references():
    for text, want in (("&#" + "9" * 5000 + ";", "\ufffd"), ("&#" + "0" * 5000 + "65;", "A"), ("&amp;lt; &eacute &#x41;", "&lt; é A")):
        assert html_extract.Page(f"<p>{text}</p>").text(None) == want


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "http://a/1", "<div class=m1><p>long text here</p></div>"), (2, None, None), (3, "http://a/2", "<div class=m2><p>other text</p></div><div class=z><p>a</p></div>")], "page_id long, url string, html string")
    got = rows(html_extract.extract_html(pages), "page_id")
    assert [got[i]["text"] for i in (1, 2, 3)] == ["long text here", "", "other text"]
    assert rows(html_extract.extract_html(pages, hosts=0), "page_id") == got
    assert html_extract.extract_html(pages.limit(0)).count() == 0


URLS = [None, "", "x", "http://a.net", "http://a.net/", "HTTP://X.Example.NET/en/a?b", "http://example.com/de/", "http://b.org/fr/x#y", "http://b.org/FR/", "http://z.com/casino/1", "http://net/q", "http://anet/"]


def test_url_filter(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = rows(url_filter.filter_urls(pages, url_filter.RULES), "page_id")
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(len(URLS))] == [(None, "allow")] * 4 + [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "block"), ("net/", "block"), (None, "allow")]
    assert rows(url_filter.filter_urls(pages, url_filter.RULES, inline=1), "page_id") == got
    assert got[5]["host"] == "x.example.net" and got[5]["path"] == "/en/a"
    # with many rules, each URL meets those alone that its tokens fetch
    made = [url_filter.host_rule(f"h{i}.com/p{i % 7}/", ("block", "allow")[i % 2]) for i in range(300)] + [url_filter.word_rule(f"w{i}", "block") for i in range(40)]
    places = [f"http://{s}h{i % 310}.com/p{i % 7 if i % 3 else 1}/{w}" for i in range(600) for s in ("a.",) for w in (f"w{i % 60}",)]
    pages = spark.createDataFrame(list(enumerate(places)), "page_id long, url string")
    for inline in (1000, 1):
        got = rows(url_filter.filter_urls(pages, made, inline=inline), "page_id")
        for i, url in enumerate(places):
            place = url.split("://")[1]
            hits = [r for r in made if re.search(r.regex.replace("(?i)", ""), place)]
            best = max(hits, key=lambda r: (r.length, r.verdict), default=None)
            assert (got[i]["rule"], got[i]["verdict"]) == ((best.name, best.verdict) if best else (None, "allow")), url


def test_toxicity(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    make = lambda bad: ". ".join(" ".join(r.choice(words) for _ in range(8)) + (" vileword" if bad and k == 1 else "") for k in range(4))
    y = [int(r.random() < 0.3) for _ in range(400)]
    docs = frame(spark, [make(b) for b in y] + [None, ""])
    labels = spark.createDataFrame(list(enumerate(y)) + [(3, None)], "doc_id long, toxic int")
    got = rows(toxicity.toxicity(docs, labels))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i in held) and sum(x["held_out"] for x in got.values()) >= len(held)
    assert np.mean([got[i]["predicted"] == y[i] for i in held]) > 0.97
    assert all(len(got[i]["offending"]) == 1 for i in held if y[i] and got[i]["predicted"])
    assert got[400]["score"] == got[401]["score"] == 0
    assert toxicity.toxicity(docs, labels.limit(0)).filter("score <> 0").count() == 0


def test_pii():
    r = random.Random(5)
    for _ in range(3000):
        s = "".join(r.choice("aZ.@-+ 01") for _ in range(20))
        assert pii.email_spans(s) == [m.span() for m in pii.EMAIL.finditer(s)]
    text = "x 4111 1111 1111 1111, 1.2.3.4 1.2.3.999 +1 (918) 555-4124 a.b@c.d"
    assert [(k, text[a:b]) for k, a, b in pii.base_spans(text)] == [("email", "a.b@c.d"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (918) 555-4124")]
    ids, tags = pii.training_set(["the quick brown fox jumps over the lazy dog again and again " * 20], 900)
    model = pii.BiLstmCrf().fit(ids, tags, steps=400)
    held, want = pii.training_set(["some other words that the model has not seen before in text " * 20], 300, seed=9)
    got = model.decode(held.T).T
    inside = want > 0  # most characters are outside of spans
    assert (got == want)[inside].mean() > 0.85 and (got == want)[~inside].mean() > 0.98
    found, every = pii.PiiFinder(model).find(["call +1 (918) 555-4124 or mail a.b@c.d please", ""])[0]
    assert [k for k, _, _ in found] == ["email", "phone"] and set(found) <= set(every)


def test_toxicity_fit_climbs_the_noisy_or_likelihood():
    r = np.random.default_rng(4)
    sentences, words, documents, features = 60, 12, 15, 20
    rows_, cols = np.repeat(np.arange(sentences), 4), r.integers(0, words, sentences * 4)
    owner, y = np.sort(r.integers(0, documents, sentences)), r.integers(0, 2, documents).astype(float)
    word, feature = np.repeat(np.arange(words), 2), r.integers(0, features, words * 2)
    share = np.full(documents, 1 / documents)
    bag = toxicity.Bags(rows_, cols, owner, words)

    def likelihood(w, bias):
        """Sentence by sentence, document by document."""
        total = 0.0
        for k in range(documents):
            none = 1.0
            for s in np.flatnonzero(owner == k):
                z = bias + sum(w[f] for c in cols[rows_ == s] for f in feature[word == c])
                none *= 1 - 1 / (1 + np.exp(-z))
            total += share[k] * np.log(1 - none if y[k] else none) if (owner == k).any() else 0
        return total

    w, bias = r.standard_normal(features) * 0.1, -2.0
    up, bias_up = toxicity.NoisyOr.ascend(bag, word, feature, y, share, w, bias, 1, 1e-3, 0.0)
    for f in range(features):
        e = np.eye(features)[f] * 1e-5
        slope = (likelihood(w + e, bias) - likelihood(w - e, bias)) / 2e-5
        assert abs(slope) < 1e-6 or np.sign(up[f] - w[f]) == np.sign(slope)
    slope = (likelihood(w, bias + 1e-5) - likelihood(w, bias - 1e-5)) / 2e-5
    assert np.sign(bias_up - bias) == np.sign(slope)
    fitted, b = toxicity.NoisyOr.ascend(bag, word, feature, y, share, w, bias, 200, 0.1, 0.0)
    assert likelihood(fitted, b) > likelihood(w, bias) + 0.1


def test_toxicity_score_is_the_noisy_or_of_its_sentences():
    model = toxicity.NoisyOr({"bad": 3.0, "vile": 4.0, "fine": -1.0}, -3.0)
    for text in ("", "...", "bad day. fine vile thing!", "x\ny bad. bad. bad"):
        none = 1.0
        for s in re.findall(r"[^.!?\n]+", text):
            own = set(re.findall(r"\w+", s))
            if own:
                none *= 1 - 1 / (1 + np.exp(3.0 - sum(model.weights.get(w, 0.0) for w in own)))
        assert abs(model.score(text)[0] - (1 - none)) < 1e-9
    text = "fine day. bad vile thing! more"
    assert [text[a:b] for a, b, _ in model.score(text)[1]] == [" bad vile thing"]


def plain_base(text):
    """The contract's patterns as they stand."""
    luhn = lambda d: sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (c > "4") for k, c in enumerate(reversed(d))) % 10 == 0
    only = lambda s: "".join(c for c in s if c in "0123456789")
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(only(s)) <= 19 and luhn(only(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(only(s)) <= 15),
    ]
    return [(kind, *m.span()) for kind, pattern, holds in kinds for m in re.finditer(pattern, text) if holds(m[0])]


def test_pii_base_columns_equal_the_patterns(spark):
    r = random.Random(15)
    pieces = ["4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.1", "1.2.3.4.5", "256.1.1.1", "00001.2.3.4", "+1 (918) 555-4124", "+12", "a.b@c.d", "@", "é", " ", "-", ".", "7", "+", "x", "5555555555554444", "a@b..c", "😀"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(1, 12))) for _ in range(1500)] + EDGE
    for t in texts:
        assert pii.base_spans(t or "") == plain_base(t or ""), t
    got = rows(pii.find_pii(frame(spark, texts), pii.BiLstmCrf()))  # whatever an unfitted model adds, these columns stay
    for i, t in enumerate(texts):
        base = plain_base(t or "")
        assert [got[i]["n_" + k] for k in pii.KINDS] == [sum(x == k for x, _, _ in base) for k in pii.KINDS]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(got[i]["spans"].split(","))


def test_pii_network_finds_what_the_patterns_miss_and_nothing_else():
    import pyarrow.parquet as pq

    prose = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() if t and len(t) > 400]
    finder = pii.PiiFinder(pii.BiLstmCrf().fit(*pii.training_set([t[:4000] for t in prose[:300]])))
    r = np.random.default_rng(77)
    texts, want = [], []
    while len(texts) < 900:
        span, kind = pii.planted(r)
        t = prose[int(r.integers(300, len(prose)))]
        at = int(r.integers(0, len(t) - 300))
        cut = t.find(" ", at + 120, at + 290) + 1 or at + 150
        text = t[at:cut] + span + " " + t[cut : at + 300]
        made = (kind, cut - at, cut - at + len(span)) if kind else None
        if not any(a < cut - at + len(span) and b > cut - at for _, a, b in pii.base_spans(text)):  # only what no pattern sees
            texts.append(text)
            want.append(made)
    got = [set(every) - set(base) for at in range(0, len(texts), 100) for base, every in finder.find(texts[at : at + 100])]
    for kind in ("email", "card", "phone"):
        own = [i for i, w in enumerate(want) if w and w[0] == kind]
        assert len(own) > 20 and np.mean([want[i] in got[i] for i in own]) > 0.9, kind
    extra = [s for g, w in zip(got, want, strict=True) for s in g - {w}]
    assert len(extra) <= 0.01 * len(texts), extra


def test_gradient():
    model = pii.BiLstmCrf()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    r = np.random.default_rng(0)
    ids, tags = r.integers(0, pii.CLASSES, (5, 2)), r.integers(0, 2, (5, 2))

    def loss():
        em = model.emissions(ids)[0].astype(np.float64)
        A = model.p["A"] + model.barred
        total = 0.0
        for b in range(2):
            a = em[0, b]
            for t in range(1, 5):
                m = a[:, None] + A
                a = em[t, b] + m.max(0) + np.log(np.exp(m - m.max(0)).sum(0))
            gold = sum(em[t, b, tags[t, b]] for t in range(5)) + sum(A[tags[t, b], tags[t + 1, b]] for t in range(4))
            total += a.max() + np.log(np.exp(a - a.max()).sum()) - gold
        return total / 2

    g = model.gradient(ids, tags)
    for k in ("O", "Wf", "wb", "E"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        keep = model.p[k][at]
        model.p[k][at] = keep + 1e-3
        up = loss()
        model.p[k][at] = keep - 1e-3
        assert abs((up - loss()) / 2e-3 - g[k][at]) < 2e-2 * max(1, abs(g[k][at])), k
        model.p[k][at] = keep


def test_components(spark):
    from tersemill.llm.components import components

    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(500, 560)] + [(1000, i) for i in range(700, 900)] + [(i, 2000) for i in range(850, 950)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x["id"]: x["component"] for x in components(df).collect()}
    assert got == {x["id"]: x["component"] for x in components(df, few=0).collect()}
    assert got[560] == 500 and got[1000] == got[2000] == 700


def brute_components(sets, link):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and link(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_join(spark, monkeypatch, small):
    if small:  # lists in several parts and cells, joins over several parts, nothing but the most frequent sets broadcast
        monkeypatch.setattr(jaccard_join, "PART", 8)
        monkeypatch.setattr(jaccard_join, "SHARE", 3)
        monkeypatch.setattr(jaccard_join, "IDS", 0)
    r = random.Random(6)
    base = [f"t{i}" for i in range(60)]
    texts = list(EDGE)
    for _ in range(40):
        words = list(base)
        for _ in range(r.randint(0, 3)):
            words[r.randrange(60)] = f"u{r.randrange(999)}"
        texts.append(" ".join(words))
    texts += [" ".join(r.choice(base) for _ in range(30)) for _ in range(20)]
    sets = []
    for t in texts:
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", (t or "").lower())]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    got = rows(jaccard_join.jaccard_join(frame(spark, texts)))
    want = brute_components(sets, lambda a, b: 100 * len(a & b) >= 75 * len(a | b))
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    if not small:
        assert jaccard_join.jaccard_join(frame(spark, [])).count() == 0


def random_lists(r, count):
    """Index entries of random sets with many near copies; the sets by node."""
    sets = {}
    for _ in range(count):
        base = np.unique(np.array([r.randrange(1 << 40) for _ in range(r.randint(8, 60))], np.uint64) << np.uint64(8))
        for _ in range(r.randint(1, 9)):
            s = base.copy()
            for _ in range(r.randint(0, len(s) // 4)):
                s[r.randrange(len(s))] = r.randrange(1 << 62)
            s = np.unique(s)
            sets[jaccard_join.node_of(s)] = s
    rows = []
    for node, s in sets.items():
        n = len(s)
        p = n - -(-75 * n // 100) + 1
        e = np.empty(p, jaccard_join.ENTRY)
        key = s & jaccard_join.LOW
        e["key"], e["node"], e["n"], e["at"] = np.sort(key)[:p], node, n, np.arange(p)
        rows.append(e)
    return np.concatenate(rows), sets


@pytest.mark.parametrize("parts", [1, 4])
def test_jaccard_skipping_and_derived_answers_lose_no_link(parts):
    r = random.Random(parts)
    e, sets = random_lists(r, 150)
    link = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))
    split = np.full(64, parts, np.uint64)
    found = jaccard_join.probe_leads(e, split)
    leads = jaccard_join.probe_leads(found.leads, None)
    assert found.skipped > 0 and (parts == 1) == (len(found.leads) == 0)
    pairs = set(zip(found.a.tolist(), found.b.tolist(), strict=True)) | set(zip(leads.a.tolist(), leads.b.tolist(), strict=True))
    order = lambda a, b: (a, b) if jaccard_join.rank(np.array([a]))[0] < jaccard_join.rank(np.array([b]))[0] else (b, a)
    assert all(order(a, b) == (a, b) for a, b in pairs)
    # all links are among the pairs with leads, or between entries that are left, where no answer is derived amiss
    nodes = list(sets)
    links = {order(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if link(a, b)}
    best = {}
    for a, b in pairs:
        o = len(np.intersect1d(sets[a], sets[b]))
        for x, y in ((b, a), (a, b)):
            best[x] = max(best.get(x, (-1, 0)), (o, y))
    left, settled, seen = found.left, 0, set()
    for key in np.unique(left["key"]):
        own = left[left["key"] == key]
        own = own[np.lexsort((own["node"], own["at"], own["n"]))]
        node = own["node"]
        at = [best.get(int(x), (-1, 0)) for x in node]
        sig = np.stack([np.frombuffer(jaccard_join.signature(sets[int(x)]), np.uint64) for x in node])
        cell = jaccard_join.Cell(node, own["n"], own["at"], np.zeros(len(node), int), node, np.array([y for _, y in at]), np.array([o for o, _ in at]), np.array([len(sets[y]) if y in sets else 0 for _, y in at]), sig)
        got = jaccard_join.derive(cell, False, False)
        settled += got.settled
        for i, j, known in zip(got.a, got.b, got.known, strict=True):
            pair = order(int(node[i]), int(node[j]))
            assert not known or pair in links
            seen.add(pair)
    assert settled > 0
    assert len(links) > 300 and links <= pairs | seen, len(links - pairs - seen)
    assert len(pairs | seen) < len(sets) ** 2 / 8


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "PART", 20)
    r = np.random.default_rng(3)
    centres = r.standard_normal((20, 32))
    x = [c + r.standard_normal(32) * 0.25 for c in centres for _ in range(6)]
    x += [x[0]] * 30
    # near copies: two tight groups about the threshold's angle apart, whose members link in part
    for k in range(6):
        u, w = np.linalg.qr(r.standard_normal((32, 2)))[0].T
        for angle in (0, 17 + 2 * k):
            at = np.cos(np.radians(angle)) * u + np.sin(np.radians(angle)) * w
            x += [at + r.standard_normal(32) * 0.012 for _ in range(7)]
    vectors = [[float(v) for v in np.float32(y)] for y in x] + [None, [], [0.0] * 32, [float("nan")] * 32, [None] * 32, [1.0, 0.0]]
    labels = [i // 60 for i in range(120)] + [0] * 30 + [1] * 84 + [0] * 6
    labels[5] = None
    df = spark.createDataFrame([(i, v, lab, "x") for i, (v, lab) in enumerate(zip(vectors, labels, strict=True))], "vec_id long, embedding array<float>, label int, id string")
    got = rows(embedding_dedup.embedding_dedup(df), "vec_id")
    ok = [v is not None and len(v) > 0 and labels[i] is not None and all(y is not None and np.isfinite(y) for y in v) and any(v) for i, v in enumerate(vectors)]
    cos = lambda a, b: np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) if len(a) == len(b) else 0
    links = [[j for j in range(len(vectors)) if j != i and ok[i] and ok[j] and labels[i] == labels[j] and cos(vectors[i], vectors[j]) >= 0.93] for i in range(len(vectors))]
    found = sum(got[i]["n_links"] for i in got)
    assert found <= sum(map(len, links)) and found >= 0.98 * sum(map(len, links)) and found > 100
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(len(vectors)) if not ok[i])
    # where no link was missed all counts are right; none is ever made up
    assert np.mean([got[i]["n_links"] == len(links[i]) for i in got]) > 0.97 and all(got[i]["n_links"] <= len(links[i]) for i in got)
    tight = range(150, 234)
    assert any(0 < len(links[i]) - 6 < 7 for i in tight) and any(len(links[i]) == 13 for i in tight) and any(len(links[i]) == 6 for i in tight)
    reps = df.filter("vec_id between 150 and 233").select(F.col("vec_id").alias("id"), "label", "embedding")
    led = {x["id"]: x["leader"] for x in embedding_dedup.clusters(reps, 0.93).collect()}
    assert len(led) == 84 and len(set(led.values())) < 30
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0
    assert [embedding_dedup.tables_for(n, 0.93)[0] for n in (1, 10**6, 10**9, 10**12)] == [3, 13, 23, 32]


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{D}/documents.parquet")
    names = docs.columns
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, D)
        assert docs.columns == names
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    got = cp.STAGES[-1][1](spark, docs, D)
    assert got.count() == docs.count() > 100


def test_sql(spark):
    from tersemill.llm import catalog

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    for name in ("op3_exact_dedup", "op7_url_filter", "op10_embedding_dedup", "op11_suffix_dedup", "op12_collocations", "op13_prefix_trie"):
        got, want = catalog.QUERIES[name](spark, D).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
        cols = sorted(got.columns)
        plain = lambda df: sorted(str([None if x != x else int(x) if isinstance(x, float) and x == int(x) else x for x in r]) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None))  # noqa: B023, E731
        assert plain(got) == plain(want), name


def test_taken_stretches_equal_going_through_all():
    r = random.Random(4)
    for _ in range(200):
        spans = [(a, a + r.randint(1, 6)) for a in (r.randint(0, 60) for _ in range(r.randint(0, 6)))]
        taken = pii.Taken(spans)
        for _ in range(20):
            a = r.randint(0, 66)
            b = a + r.randint(1, 6)
            free = all(b <= x or a >= y for x, y in spans)
            assert taken.free(a, b) == free
            if free:
                taken.add(a, b)
                spans.append((a, b))


def test_toxicity_fit_edge_cases():
    assert toxicity.NoisyOr.fit(["a b"], [1], [1.0]).score("a b")[0] == 0  # labels of one kind only
    assert toxicity.NoisyOr.fit([], [], []).score("")[0] == 0
    empty = toxicity.NoisyOr.fit(["", "."], [0, 1], [1.0, 1.0])  # no words at all
    assert empty.weights == {} and 0 <= empty.score("some words. more")[0] <= 1
    texts = [f"fine words number {i}. all is well" for i in range(40)] + [f"fine words number {i}. you vile wretch" for i in range(40)]
    model = toxicity.NoisyOr.fit(texts, [0] * 40 + [1] * 40, [1.0] * 80)
    assert model.score("all is well")[0] < 0.3 <= model.score("number 3. you vile wretch. all is well")[0]


def test_pii_of_texts_with_many_spans_and_an_empty_or_null_table(spark):
    many = "a1@b.org 10.0.0.1 x " * 3000
    rows = [(1, many), (2, None), (3, ""), (3, "")]
    got = {r["doc_id"]: r for r in (lambda d: pii.find_pii(d, pii.fit_pii(d)))(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_email"], got[1]["n_ip"]) == (3000, 3000)
    assert got[2]["spans"] == got[3]["spans"] == ""
    empty = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert pii.find_pii(empty, pii.fit_pii(empty)).head()["n_email"] == 0


def test_html_keeps_what_is_beside_the_largest_part():
    r = random.Random(7)
    words = lambda n: " ".join(r.choice(("river", "stone", "lamp", "under", "seven")) for _ in range(n))
    nav = "<ul>" + "".join(f"<li><a href=/{i}>link number {i}</a></li>" for i in range(8)) + "</ul>"
    around = [("<article>", "</article>"), ("<main class=w-1/2>", "</main>"), ("<main><article>", "</article></main>"), ("<div id=wrap>", "</div>"), ("<div><div class=page>", "</div></div>")]
    for k in range(200):
        start, end = around[k % len(around)]
        head, lead, last = words(r.randint(1, 8)), words(r.randint(1, 40)), words(r.randint(1, 40))
        body = [words(r.randint(20, 80)) for _ in range(r.randint(1, 9))]
        depth = r.randint(1, 5)
        inner = "<div class=body>" * depth + "".join(f"<p>{b}</p>" for b in body) + "</div>" * depth
        page = f"<html><body><div>{nav}</div>{start}<h1>{head}</h1><p>{lead}</p>{inner}<section><p>{last}</p></section>{end}<div>© 2020 All rights reserved</div><div>{nav}</div></body></html>"
        assert html_extract.Page(page).text(None) == "\n".join([head, lead, *body, last]), page


def test_html_host_path_keeps_what_single_pages_have_beside_it(spark):
    body = "<div class=body><p>" + "many words of the body " * 20 + "</p></div>"
    pages = [(i, f"http://a/{i}", f"<html><body><div class=page>{body}</div></body></html>") for i in range(3)]
    pages.append((3, "http://a/3", f"<html><body><div class=page><p>a lead</p>{body}</div></body></html>"))
    got = rows(html_extract.extract_html(spark.createDataFrame(pages, "page_id long, url string, html string")), "page_id")
    assert got[3]["path"] == "/html/body/div.page/div.body"
    assert got[3]["text"] == "a lead\n" + got[0]["text"]


def test_html_layout_wrappers_are_not_ruled_out_by_their_classes():
    text = "<p>" + "words of the article " * 20 + "</p>"
    want = " ".join(text[3:-4].split())
    beside = "<div class='sidebar-left'><p>no</p></div><div id=cookieNotice>no</div><div class='ad-slot-1'>no</div><div class='post__comments'>no</div><div class=page hidden>no</div>"
    for mark in ("class='content-sidebar-wrap'", "class='page has-sidebar'", "class='post share-enabled'", "id=login-free-content", "class=widget", "id=page-widget", "class='social search-left'"):
        for start, end in (("", ""), ("<article>", "</article>"), ("<div class=popup><main>", "</main></div>")):
            page = f"<html><body>{beside}<div {mark}>{start}{text}{beside}{end}</div></body></html>"
            assert html_extract.Page(page).text(None) == want, page
    assert html_extract.Page(f"<body><article><h1>T</h1><div class='body widget'>{text}</div></article>").text(None) == "T\n" + want
    # comments and teasers with more text than the article stay out
    more = "<article class=comment>" + text * 9 + "</article>"
    for start, end in (("<article>", "</article>"), ("<div>", "</div>")):
        assert html_extract.Page(f"<body>{start}{text}{end}<div class=comments>{more}</div>").text(None) == want
    assert html_extract.Page(f"<body><article>{text}</article><div class=related><article>{text * 9}</article></div>").text(None) == want
    assert html_extract.Page(f"<body><div class=page-widget><article>{text}</article><div class=related><article>{text}</article></div></div>").text(None) == want


class Lowercase:
    """Decodes as e-mail each run of lowercase letters, dots and at signs, with blanks beside an at sign, as far as the window shows it."""

    signs = "@.+-() "

    def decode(self, ids):
        at, dot, blank = (3 + self.signs.index(c) for c in "@. ")
        tags = np.zeros(ids.shape, np.int8)
        for j in range(ids.shape[1]):
            x = [-1, *ids[:, j], -1]
            inside = [c in (1, at, dot) or (c == blank and at in (x[t], x[t + 2])) for t, c in enumerate(x[1:-1])]
            for t in np.flatnonzero(inside):
                tags[t, j] = 2 if t and inside[t - 1] else 1
        return tags


def test_pii_spans_over_several_windows_are_found_at_every_offset():
    finder, k = pii.PiiFinder(Lowercase()), 0
    for n in range(34, 81):
        for local in (5, n // 2, n - 12):
            host = (("abcdefg." * 10)[: n - local - 7] + "x.com").replace(".x", "yx")
            span = "q" * local + [" @", "@ "][k % 2] + host
            k += 1
            texts = ["X" * offset + " " + span + " " + "Y" * 70 for offset in range(63, 63 + pii.WINDOW)] + [span]
            for text, (base, every) in zip(texts, finder.find(texts), strict=True):
                a = text.index(span)
                assert base == [] and every == [("email", a, a + len(span))], (text, [text[x:y] for _, x, y in every])


def test_pii_of_a_span_longer_than_several_windows():
    span = "q" * 30 + " @ " + "abcdefg." * 60 + "com"
    text = "A " + span + " B " + "Y" * 5000 + " " + span
    got = pii.PiiFinder(Lowercase()).find([text])[0][1]
    assert [text[a:b] for _, a, b in got] == [span, span]


def test_pipeline_run_equals_a_plain_version(spark, tmp_path, monkeypatch):
    import corpus_pipeline as cp

    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(300)]
    sentence = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    texts = [". ".join(sentence(9) for _ in range(5)) for _ in range(160)]
    texts = [t + ". you vileword " + sentence(6) if i % 4 == 0 else t for i, t in enumerate(texts)]
    texts += [texts[i] for i in range(1, 40, 2)] + [None, "", ""]
    texts += [texts[i] + f" last{k}" for i in range(41, 80, 2) for k in range(2)]
    sources = [("a", "a", "b", None)[r.randrange(4)] for _ in texts]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, (t, s) in enumerate(zip(texts, sources, strict=True))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = {}
    keep = cp.materialize
    monkeypatch.setattr(cp, "materialize", lambda df, name: stages.setdefault(name, keep(df, name)))
    got = cp.run(spark, str(tmp_path)).collect()
    ids = {name: sorted(x["doc_id"] for x in df.collect()) for name, df in stages.items() if name != "mixed"}

    # toxic texts are those with the bad word
    want = [i for i, t in enumerate(texts) if "vileword" not in (t or "")]
    assert ids["toxicity"] == want
    # of equal texts the largest id stays
    want = sorted({texts[i] or "": i for i in want}.values())
    assert ids["exact_dedup"] == want
    # of near copies the smallest
    words = [(texts[i] or "").lower().split() for i in want]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    component = brute_components(sets, lambda a, b: 100 * len(a & b) >= 75 * len(a | b))
    assert any(c != k for k, c in enumerate(component))
    want = [i for k, i in enumerate(want) if component[k] == k]
    assert ids["jaccard_join"] == want
    # each source by weight, no source above three times its size (a text is no longer than 60 words)
    size = {s: sum(len((texts[i] or "").split()) for i in want if sources[i] == s) for s in set(sources)}
    weight, total, capped = {"a": 5, "b": 2, None: 1}, sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        target = {s: 3 * size[s] if s in capped else rest * weight[s] / sum(weight[x] for x in size if x not in capped) for s in size}
        over = {s for s in size if target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    assert set(ids["mixing"]) <= set(want) and max(map(ids["mixing"].count, want)) <= 3
    for s in size:
        taken = sum(len((texts[i] or "").split()) for i in ids["mixing"] if sources[i] == s)
        assert abs(taken - target[s]) <= 60
    # a row for each one drawn, with the library's ids
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert sorted(x["doc_id"] for x in got) == ids["mixing"]
    for x in got:
        own = tok.encode(texts[x["doc_id"]] or "", add_special_tokens=False).ids
        assert (x["n_tokens"], x["ids_sha256"]) == (len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest())


@pytest.mark.parametrize("few", [500_000, 0])
def test_pipeline_stages_with_nulls_ties_repeated_ids_and_no_rows(spark, tmp_path, monkeypatch, few):
    import corpus_pipeline as cp

    from tersemill.llm import common

    monkeypatch.setattr(common, "FEW_IDS", few)  # joins by broadcast, and by shuffling

    text = "one two three four five six seven eight nine ten eleven twelve"
    plain = "other words of another document that stand alone"
    ids_ = [(1, text, "a"), (1, text, "a"), (2, text, "a"), (None, text, "a"), (None, "null id", None), (None, "null id", None), (3, None, None), (4, "", "b"), (5, text + " more", "a"), (5, plain, "b"), (6, text + " less", "b"), (7, "x " * 30_000, "b")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, _id string, sha string, node string, shards string, size string"
    docs = spark.createDataFrame([(i, t, "en", s, 0, *["x"] * 6) for i, t, s in ids_], schema)
    names = docs.columns
    spark.createDataFrame([(1, 1, 0), (1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
        seen[name] = docs.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
    pairs = lambda name: sorted([(r["doc_id"], r["text"]) for r in seen[name]], key=str)
    assert len(seen["toxicity"]) == len(ids_)
    # of equal texts one row: the largest id's, a repeated one once; the null and the empty text are equal
    assert pairs("exact_dedup") == sorted([(2, text), (None, "null id"), (4, ""), (5, text + " more"), (5, plain), (6, text + " less"), (7, "x " * 30_000)], key=str)
    # near copies of 2 go, but not the other text that has the id of one
    assert pairs("jaccard_join") == sorted([(2, text), (None, "null id"), (4, ""), (5, plain), (7, "x " * 30_000)], key=str)
    assert {r["text"] for r in seen["mixing"]} <= {t for _, t in pairs("jaccard_join")}
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(seen["mixing"])
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0


CLASH = ", id string, label string, n string, h string, node string, leader string, host string, path string, text_hash string, _id string"


def test_operators_on_empty_tables_and_clashing_columns(spark):
    import public_tokenizers as P

    extra = tuple("x" for _ in range(10))
    docs = [(1, "some words here, for all of them", "s"), (2, None, None), (2, "some words here, for all of them", "s"), (None, "", "s")]
    schema = "doc_id long, text string, source string" + CLASH
    pages = [(1, "http://a.net/x", "<article><p>words of the page</p></article>"), (2, None, None), (None, "x", "")]
    vectors = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (2, None, None), (None, [1.0, 0.0], 1)]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    runs = [
        (docs, schema, lambda d: token_counts.count_tokens(d, P.path("piece_bpe_32k.model"))),
        (docs, schema, lambda d: toxicity.toxicity(d, labels)),
        (docs, schema, exact_dedup.exact_dedup),
        (docs, schema, lambda d: pii.find_pii(d, pii.BiLstmCrf())),
        (docs, schema, lambda d: mixing.mix(d, shards=4)),
        (pages, "page_id long, url string, html string" + CLASH.replace(", host string, path string", ", hosts string, paths string"), html_extract.extract_html),
        (pages, "page_id long, url string, html string" + CLASH, lambda d: url_filter.filter_urls(d, url_filter.RULES)),
        (docs, schema, lambda d: bpe_codec.bpe_codec(d, P.path("word_bpe_49k.json"))),
        (docs, schema, jaccard_join.jaccard_join),
        (vectors, "vec_id long, embedding array<float>, label long" + CLASH.replace(", label string", ", labels string"), embedding_dedup.embedding_dedup),
    ]
    for made, schema, run in runs:
        df = spark.createDataFrame([(*r, *extra) for r in made], schema)
        assert run(df).count() == len(made)
        assert run(df.limit(0)).count() == 0


def test_written_tables_are_removed_but_for_what_is_read(spark):
    import os

    from tersemill.llm import common

    folder = common.shared_folder(spark).removeprefix("file://") + "/tersemill"
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    out = jaccard_join.jaccard_join(frame(spark, EDGE))
    left = set(os.listdir(folder)) - before
    assert {x.split("-", 1)[1] for x in left} == {"scan", "named"} and out.count() == len(EDGE)
    with common.scratch() as keep:
        a, b = common.materialize(spark.range(3), "a"), common.materialize(spark.range(3), "b")
        keep(b)
    assert b.count() == 3 and not os.path.exists(a._tersemill_path.removeprefix("file:"))
    common.discard(b)
    assert not os.path.exists(b._tersemill_path.removeprefix("file:"))
