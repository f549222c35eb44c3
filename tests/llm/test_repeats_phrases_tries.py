import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tersemill.llm import collocations, prefix_trie, suffix_dedup

CLASH = "doc_id long, text string, lang string, row string, key long, start long, n long, runs int, phrase string, sha string, id int, h int"


def docs(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else "en", "r", 1, 2, 3, 4, "p", "s", 5, 6) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASH)


def plain_removal(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((sum(gone), spans, bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("length", "group", "small"), [(40, 20_000, 1 << 20), (40, 3, 0)])
def test_suffix_dedup_equals_brute_force(spark, length, group, small):
    """Also where each key is more than a task may have, and runs are joined by shuffling."""
    r = random.Random(length + group)
    passages = ["".join(r.choice("ab c") for _ in range(r.randint(10, 3 * length))) for _ in range(8)]
    texts = [None, "", "x" * 7 * length, "xy" * 2 * length, "é" * length, "z" * (length - 1), "z" * (length - 1)]
    for _ in range(100):
        parts = []
        for _ in range(r.randint(1, 5)):
            p = r.choice(passages) if r.random() < 0.4 else "".join(r.choice("abcdefgh é") for _ in range(r.randint(0, length)))
            parts.append(p[r.randint(0, len(p) // 2) :])
        texts.append("".join(parts))
    texts += texts[-6:]
    got = {x.doc_id: x for x in suffix_dedup.suffix_dedup(docs(spark, texts), length=length, group=group, small=small, full=True).collect()}
    data = [(t or "").encode() for t in texts]
    for i, (removed, spans, kept) in enumerate(plain_removal(data, length)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept), got[i].kept_sha256) == (len(data[i]), removed, spans, kept, hashlib.sha256(kept).hexdigest()), i


def test_suffix_dedup_edges(spark):
    same, long_ = "q" * 150 + "w" * 100, "".join(chr(97 + i * i % 23) + str(i) for i in range(40_000))
    rows = [(None, same), (None, same), (7, long_), (7, "zz" + long_[100_000:100_199]), (8, "yy" + long_[100_300:100_500] + "y")]
    got = {(x.doc_id, x.n_bytes): x for x in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[None, 250].n_removed, got[None, 250].n_spans, got[7, len(long_)].n_removed, got[7, 201].n_removed, got[8, 203].n_removed] == [250, 1, 200, 0, 200]
    empty = suffix_dedup.suffix_dedup(docs(spark, []))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_deep_shallow_sorts():
    r = random.Random(5)
    for alphabet in ("ab", "a", "abcdefghij"):
        head = "".join(r.choice(alphabet) for _ in range(60))
        strings = [(head[: r.choice([0, 20, 60])] + "".join(r.choice(alphabet) for _ in range(r.randint(0, 90)))).encode() for _ in range(400)]
        strings += strings[:50] + [b"", b"\0", b"\0\0"]
        want = sorted(strings)
        for known in (0, 13, 60):
            assert [strings[i] for i in suffix_dedup.deep_shallow(strings, list(range(len(strings))), known)] == want
        assert [strings[i] for i in suffix_dedup.blind_trie(strings, list(range(len(strings))))] == want


def test_anchors_of_equal_windows_are_at_equal_offsets():
    r = random.Random(6)
    shared = bytes(r.choice(b"abc d") for _ in range(500))
    texts = [bytes(r.choice(b"abcdef") for _ in range(r.randint(0, 700))) + shared + bytes(300) for _ in range(4)]
    for length in (40, 200):
        found = suffix_dedup.Anchors(texts, length)
        starts = [0, *found.ends[:-1].tolist()]
        offsets = defaultdict(dict)
        for _, _, at, x, y, doc, _ in found.parts:
            for a, b, e, d in zip(at.tolist(), x.tolist(), y.tolist(), doc.tolist(), strict=True):
                for i in range(b, e):
                    assert a - i - starts[d] not in offsets[d]
                    offsets[d][a - i - starts[d]] = i
        for d, t in enumerate(texts):
            assert sorted(offsets[d]) == list(range(len(t) - length + 1))  # each window has one anchor
        for k in range(500 - length + 1):
            assert len({offsets[d][texts[d].index(shared) + k] for d in range(4)}) == 1


def plain_phrases(rows, support, subsumed, top):
    counts, total = defaultdict(Counter), Counter()
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)} | {c: "." for c in ",;:!?\n\v\f\r"})
    for text, lang in rows:
        for piece in (text or "").translate(fold).split("."):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            total[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    counts[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= support}
        inside = defaultdict(int)
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        scores = []
        for p, a in cand.items():
            if 100 * inside[p] < subsumed * a:
                s, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                scores.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)


def odd_texts(r, n):
    w = ["the", "The", "a", "b", "é", "C3", "x.y", " ", "\x1c", "end.", "end,", "\t", "\n", "stop!", "漢"]
    return ["".join(r.choice(w) + r.choice([" ", " ", "  ", "\t"]) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_collocations_equal_brute_force(spark):
    r = random.Random(9)
    texts = [None, "", ".", "a " * 3000, *odd_texts(r, 300)]
    langs = [r.choice(["en", "fr", None, "und"]) for _ in texts]
    for support, top in ((30, 2000), (5, 7), (10_000, 5)):
        got = collocations.collocations(docs(spark, texts, langs), support=support, top=top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == plain_phrases(zip(texts, langs, strict=True), support, 80, top)
    assert collocations.collocations(docs(spark, [])).count() == 0


def test_shards_keep_all_words_and_phrases_across_them(monkeypatch):
    import pyarrow as pa

    r = random.Random(10)
    texts, langs = odd_texts(r, 60), [r.choice("xyz") for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"lang": langs, "text": texts})
    want = Counter()
    for t, lang in zip(texts, langs, strict=True):
        w = [x for some in collocations.words(t.encode()) for x in some]
        want.update((lang, tuple(w[i : i + k])) for k in (2, 3, 4) for i in range(len(w) - k + 1) if b"." not in w[i : i + k])
    for shard, held, read in ((1 << 16, 1 << 19, 1 << 20), (7, 40, 5), (1, 1, 1)):
        monkeypatch.setattr(collocations, "SHARD", shard)
        monkeypatch.setattr(collocations, "HELD", held)
        monkeypatch.setattr(collocations, "READ", read)
        got = Counter()
        for lang, stream, size in collocations.shards(iter([batch])):
            import numpy as np

            stream = stream + [b"."] * 2
            plain = np.array([w != b"." for w in stream])
            pairs, triples = plain[:-1] & plain[1:], plain[:-2] & plain[1:-1] & plain[2:]
            counts = {}
            collocations.mine(stream, size, pairs, triples, counts)
            got.update({(lang, tuple(p.split(b" "))): n for p, n in counts.items()})
        assert got == want


def test_bitmaps():
    r = random.Random(11)
    import numpy as np

    at = np.array(sorted(r.sample(range(1000), 300)))
    codes = np.array([0] * 280 + [1] * 19 + [3])
    r.shuffle(codes)
    made = collocations.bitmaps(codes, at, 4)
    sets = [set(at[codes == c].tolist()) for c in range(4)]
    assert [type(m) for m in made] == [int, list, list, list] and list(map(collocations.popcount, made)) == [280, 19, 0, 1]
    seen = collocations.positions_seen(made[0] << 1, 1001)
    assert {p for p in range(1001) if seen[p]} == {p + 1 for p in sets[0]}
    assert set(collocations.both(made[0] << 1, made[1], lambda: seen)) == {p + 1 for p in sets[0]} & sets[1]
    assert collocations.popcount(collocations.both(made[0] << 1, made[0], lambda: seen)) == len({p + 1 for p in sets[0]} & sets[0])


@pytest.mark.parametrize("sparse", [0, 3, 32])
def test_phrases_of_many_and_of_few_bits_are_counted_alike(monkeypatch, sparse):
    import numpy as np

    monkeypatch.setattr(collocations, "SPARSE", sparse)
    r = random.Random(12)
    for _ in range(60):
        stream = [r.choice([b"a", b"a", b"b", b"c", b"d", b"."]) for _ in range(r.randint(3, 200))]
        size = r.randint(1, len(stream))
        plain = np.array([w != b"." for w in stream])
        pairs, triples = plain[:-1] & plain[1:], plain[:-2] & plain[1:-1] & plain[2:]
        rare = r.choice([b"a b", b"c d", b"none"])  # what can't be frequent isn't extended
        pairs &= np.array([b" ".join(stream[i : i + 2]) != rare for i in range(len(stream) - 1)])
        triples &= pairs[:-1] & pairs[1:]
        want = Counter()
        for i in range(size):
            for k in (2, 3, 4):
                if i + k <= len(stream) and all(pairs[i : i + k - 1]):
                    want[b" ".join(stream[i : i + k])] += 1
        counts = {}
        collocations.mine(stream, size, pairs, triples, counts)
        assert counts == want


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    node = defaultdict(lambda: {"members": [], "ends": []})
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + ts[h:])
        for d in range(len(path) + 1):
            node[path[:d]]["members"].append(c)
        node[path]["ends"].append(c)
    out = []
    for path, x in node.items():
        under = [p for p in node if p[: len(path)] == path]
        kids = {p for p in under if len(p) == len(path) + 1}
        leaves = sum(not any(q[: len(p)] == p and len(q) > len(p) for q in under) for p in under)
        saved = sum((len(node[p]["members"]) - 1) * len(p[-1][1].encode()) for p in under if p)
        ends = hashlib.sha256(",".join(map(str, sorted(x["ends"]))).encode()).hexdigest()
        out.append((len(path), min(x["members"]), min(node[path[:-1]]["members"]) if path else None, len(x["members"]), len(kids), leaves, saved, ends))
    return sorted(out, key=lambda t: t[:2])


@pytest.mark.parametrize(("fan", "held", "hub"), [(16, 100_000, 1000), (2, 5, 2)])
def test_prefix_trie_equals_brute_force(spark, monkeypatch, fan, held, hub):
    """Also with tiny partial tries, a conversation of a third of all turns, and ancestors met by broadcast."""
    monkeypatch.setattr(prefix_trie, "HUB", hub)
    r = random.Random(3)
    rows = [(None, 1, "u", "x")] * 3
    for c in [*range(-12, 60), 10**12 + 5]:
        if c % 35:
            for _ in range(r.choice([1, 2, 3, 8, 12]) if c != 50 else 150):
                rows.append((c, r.choice([None, 1, 2, 3, 4, 5]), r.choice([None, "", "u"]), r.choice([None, "", "x", "yé"]) if c % 2 else r.choice(["x", None])))
    rows = [(*x, 1, b"k", 2, 3) for x in rows]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int, key binary, depth int, pos int").repartition(5)
    got = [tuple(x) for x in prefix_trie.prefix_trie(df, fan=fan).select("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert sorted(got, key=lambda t: t[:2]) == plain_trie([x[:4] for x in rows])
    assert prefix_trie.prefix_trie(df.filter("false")).count() == 0


def test_running_sums_go_over_ranges(spark):
    df = spark.range(3000).select((F.col("id") % 7 == 0).cast("long").alias("k"), F.col("id").alias("t"), F.lit(1).alias("s"))
    got = prefix_trie.running(df, "k", ["t"], at=F.lit(1), sum=F.col("t")).collect()
    seen = defaultdict(lambda: [0, 0])
    for x in sorted(got, key=lambda x: x.t):
        seen[x.k][0] += 1
        seen[x.k][1] += x.t
        assert [x.at, x.sum] == seen[x.k]
