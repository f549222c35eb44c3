"""Personal data by a character BiLSTM with a CRF, beside exact patterns (operator 4).

Base spans come from patterns, leftmost and non-overlapping per kind, with length and checksum tests. A
bidirectional LSTM over character classes with CRF transitions, trained in numpy from labelled spans, adds
spans that the patterns miss (numbers without a plus, other separators).

Labelled spans: the training text is text of a bounded sample of documents (SAMPLE rows) in which the patterns'
spans are labelled, and into which spans of each kind and decoys (dates, versions, prices, keys) are planted
by a fixed generator.

Texts are read in overlapping windows (WINDOW, STEP). A span that passes its kind's test has a digit or an at
sign, so windows with one are run, and from there the ones before and after for as long as a run reaches a
window's edge; runs that could begin only in windows without either would fail the test. A run cut by an
edge is continued by the run of its kind that it meets in a window beyond, over any number of windows. Of runs
that overlap, that whose ends lie most inside their windows is taken, cut ones last. An added span must pass its
kind's test and may not touch a base span.

Defined results: a null text counts as empty and has no spans; repeated rows give repeated rows, an empty
table an empty one (the model is then fitted on planted text alone); other columns are ignored. The counts and
the digest are of base spans; spans has all.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import spread
from .common import slices, table

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive and from a run's first digit on: the same matches, without trying each digit of a long run
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SAMPLE, WINDOW, STEP = 400, 64, 32
HIDDEN, EMBED, STEPS, BATCH, EXAMPLES = 16, 10, 600, 48, 6000
#: Tags: outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
TRIGGER = re.compile(r"[0-9@]")


def digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def email_spans(text: str) -> list[tuple[int, int]]:
    """What EMAIL.finditer finds. Looked for around each at sign, as the pattern alone is quadratic on long runs of letters."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        m = EMAIL.match(text, a) if a < at else None
        if m:
            out.append(m.span())
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in email_spans(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(at_most_255, m[0].split(".")))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


def char_class(c: str) -> int:
    """Character classes keep digits, signs and letters' cases apart."""
    signs = "@.+-() :/_%#=\"',\n"
    if c in signs:
        return 3 + signs.index(c)
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 + len(signs)


CLASSES = 4 + len("@.+-() :/_%#=\"',\n")
CLASS_OF = np.array([char_class(chr(i)) for i in range(0x250)], np.int64)


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < len(CLASS_OF), CLASS_OF[np.minimum(points, len(CLASS_OF) - 1)], 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BiLstmCrf:
    """Two LSTMs over embedded character classes, one linear layer, one transition matrix."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": init(CLASSES, EMBED), "O": init(2 * HIDDEN, TAGS), "o": np.zeros(TAGS, np.float32), "A": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {"W" + d: init(EMBED + HIDDEN, 4 * HIDDEN), "w" + d: np.zeros(4 * HIDDEN, np.float32)}
            self.p["w" + d][HIDDEN : 2 * HIDDEN] = 1
        # an inside tag follows its own kind's begin or inside only
        self.barred = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(KINDS)):
            for t in range(TAGS):
                if t not in (1 + 2 * k, 2 + 2 * k):
                    self.barred[t, 2 + 2 * k] = -1e4

    def lstm(self, x: np.ndarray, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """x: time, batch, EMBED."""
        n, b, _ = x.shape
        W, w, H = self.p["W" + d], self.p["w" + d], HIDDEN
        given = x @ W[:EMBED] + w
        h = c = np.zeros((b, H), np.float32)
        out, tape = np.empty((n, b, H), np.float32), []
        for t in range(n) if d == "f" else reversed(range(n)):
            z = given[t] + h @ W[EMBED:]
            s = sigmoid(z[:, : 3 * H])
            i, f, o, g = s[:, :H], s[:, H : 2 * H], s[:, 2 * H :], np.tanh(z[:, 3 * H :])
            last_c, last_h = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                tape.append((t, i, f, o, g, last_c, last_h, tc))
        return out, tape

    def emissions(self, ids: np.ndarray, keep: bool = False):
        x = self.p["E"][ids]
        hf, tf = self.lstm(x, "f", keep)
        hb, tb = self.lstm(x, "b", keep)
        h = np.concatenate([hf, hb], 2)
        return h @ self.p["O"] + self.p["o"], x, h, tf, tb

    def gradient(self, ids: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        """Of the negative log-likelihood; ids and tags: time, batch."""
        em, x, h, tf, tb = self.emissions(ids, True)
        n, b, k = em.shape
        A = self.p["A"] + self.barred
        lse = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[0] = em[0]
        for t in range(1, n):
            alpha[t] = em[t] + lse(alpha[t - 1][:, :, None] + A, 1)
        for t in range(n - 2, -1, -1):
            beta[t] = lse(A + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        d_em = np.exp(alpha + beta - z[:, None])
        pair = np.exp(alpha[:-1][:, :, :, None] + A + (em[1:] + beta[1:])[:, :, None, :] - z[:, None, None])
        dA = pair.sum((0, 1))
        np.subtract.at(dA, (tags[:-1].ravel(), tags[1:].ravel()), 1)
        d_em[np.arange(n)[:, None], np.arange(b), tags] -= 1
        d_em /= b
        g = {"A": dA / b, "o": d_em.sum((0, 1)), "O": h.reshape(-1, 2 * HIDDEN).T @ d_em.reshape(-1, k)}
        dh = d_em @ self.p["O"].T
        dx = np.zeros_like(x)
        for d, tape, part in (("f", tf, dh[:, :, :HIDDEN]), ("b", tb, dh[:, :, HIDDEN:])):
            W = self.p["W" + d]
            gW, dz_all, back_h, back_c = np.zeros_like(W), np.empty((n, b, 4 * HIDDEN), np.float32), 0, 0
            for t, i, f, o, cand, last_c, last_h, tc in reversed(tape):
                dht = part[t] + back_h
                dc = dht * o * (1 - tc * tc) + back_c
                dz = np.concatenate([dc * cand * i * (1 - i), dc * last_c * f * (1 - f), dht * tc * o * (1 - o), dc * i * (1 - cand * cand)], 1)
                gW[EMBED:] += last_h.T @ dz
                dz_all[t] = dz
                back_h, back_c = dz @ W[EMBED:].T, dc * f
            flat = dz_all.reshape(-1, 4 * HIDDEN)
            gW[:EMBED] = x.reshape(-1, EMBED).T @ flat
            dx += dz_all @ W[:EMBED].T
            g |= {"W" + d: gW, "w" + d: flat.sum(0)}
        gE = np.zeros_like(self.p["E"])
        np.add.at(gE, ids.ravel(), dx.reshape(-1, EMBED))
        return g | {"E": gE}

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int = STEPS, seed: int = 3) -> BiLstmCrf:
        """Adam; ids and tags: examples, time."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            at = r.integers(0, len(ids), BATCH)
            g = self.gradient(ids[at].T, tags[at].T)
            scale = min(1.0, 5 / (1e-6 + np.sqrt(sum(float((x * x).sum()) for x in g.values()))))
            rate = 0.02 * min(1, step / 20) * (1 - 0.9 * step / steps)
            for k, x in g.items():
                x = x * scale
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The likeliest tags; ids: time, batch."""
        em = self.emissions(ids)[0]
        n, b, k = em.shape
        A = self.p["A"] + self.barred
        best, back = em[0], np.empty((n, b, k), np.int8)
        for t in range(1, n):
            s = best[:, :, None] + A
            back[t] = s.argmax(1)
            best = s.max(1) + em[t]
        tags = np.empty((n, b), np.int8)
        tags[-1] = best.argmax(1)
        for t in range(n - 1, 0, -1):
            tags[t - 1] = back[t][np.arange(b), tags[t]]
        return tags


def planted(r: np.random.Generator) -> tuple[str, str | None]:
    """A made-up span and its kind, or a decoy and None."""
    num = lambda n: "".join(map(str, r.integers(0, 10, n)))
    name = lambda n: "".join(chr(97 + x) for x in r.integers(0, 26, n))
    pick = lambda *x: x[r.integers(0, len(x))]
    which = r.integers(0, 10)
    if which < 2:
        dot, at = pick(".", ".", "_", "-", ""), pick("@", "@", "@", " @ ", "@ ")
        return name(r.integers(2, 8)) + dot + pick(num(2), name(4)) + at + name(r.integers(3, 7)) + pick(num(1), "") + "." + pick("example.com", "com", "org", "net", "example.org"), "email"
    if which == 2:
        return ".".join(str(x) for x in r.integers(1, 256, 4)), "ip"
    if which == 3:
        body = "4" + num(14)
        full = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        sep = pick("", " ", "-", ".")
        return sep.join(full[i : i + 4] for i in range(0, 16, 4)), "card"
    if which < 7:
        a, b, c = str(r.integers(2, 10)) + num(2), num(3), num(4)
        return pick(f"+{r.integers(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"001 {a} {b} {c}", f"{a} {b} {c}", f"+{r.integers(1, 99)} {a} {b} {c}", f"+{r.integers(1, 99)}{a}{b}{c}"), "phone"
    low = "0123456789abcdef"
    return pick(num(r.integers(1, 6)), num(4) + "-" + num(2) + "-" + num(2), f"{num(1)}.{num(1)}", f"{num(1)}.{num(1)}.{num(2)}", f"{num(2)}:{num(2)}", f"${num(3)}.{num(2)}", num(1) + "," + num(3) + "," + num(3), 'token = "' + "".join(low[x] for x in r.integers(0, 16, 40)) + '"', "password=" + "".join(low[x] for x in r.integers(0, 16, 18)), "AKIA" + "".join(pick(*"ABCDEFGHIJ0123456789") for _ in range(16)), f"Version {num(1)}.0", f"({num(4)})", f"{num(4)}-{num(4)}", num(8), f"{num(3)} {num(3)}", f"@{name(6)}", f"{name(4)}@{name(4)}"), None


def tagged(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(len(text), np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        out[a:b], out[a] = 2 + 2 * k, 1 + 2 * k
    return out


def training_set(texts: list[str], examples: int = EXAMPLES, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows of classes and tags: planted spans and decoys in the sample's own prose."""
    r = np.random.default_rng(seed)
    prose = [t for t in texts if len(t) > 2 * WINDOW] or ["the of and in that is for it with as was on be by this " * 8]
    ids, tags = [], []
    for _ in range(examples):
        t = prose[r.integers(0, len(prose))]
        at = int(r.integers(0, len(t) - WINDOW))
        piece = t[at : at + 2 * WINDOW]
        spans = [] if r.random() < 0.3 else [planted(r)]
        cut = piece.find(" ", int(r.integers(0, WINDOW))) + 1
        head, text, found = piece[:cut], piece[:cut], base_spans(piece[:cut])
        for s, kind in spans:
            lead = head and r.random() < 0.9
            text = head + s + (" " if lead else ". ")
            found += [(kind, len(head), len(head) + len(s))] if kind else []
        text += piece[cut:]
        found += [(k, a, b) for k, a, b in base_spans(text) if a >= len(text) - len(piece) + cut]
        shift = int(r.integers(0, max(1, min(len(head), len(text) - WINDOW))))
        row, tag = classes(text), tagged(text, found)
        if len(row) < shift + WINDOW:
            continue
        piece_tags = tag[shift : shift + WINDOW].copy()
        if piece_tags[0] and piece_tags[0] % 2 == 0:  # a span that began before the window begins in it
            piece_tags[0] -= 1
        ids.append(row[shift : shift + WINDOW])
        tags.append(piece_tags)
    return np.array(ids), np.array(tags)


VALID = {
    "email": lambda s: bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", s)),
    "ip": lambda s: len(p := s.split(".")) == 4 and all(x.isascii() and x.isdigit() and at_most_255(x) for x in p),
    "card": lambda s: bool(re.fullmatch(r"[0-9](?:[ .-]?[0-9])+", s)) and 13 <= len(digits(s)) <= 19 and luhn(digits(s)),
    "phone": lambda s: bool(re.fullmatch(r"[+(]?[0-9][ ().0-9-]*[0-9]", s)) and 9 <= len(digits(s)) <= 15 and len(re.findall("[0-9]+", s)) >= 3,
}


class Taken:
    """Disjoint stretches of a text in order, so that a long text with many spans is not gone through for each."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, a)
        return (i == 0 or self.ends[i - 1] <= a) and (i == len(self.starts) or b <= self.starts[i])

    def add(self, a: int, b: int) -> None:
        """A free stretch."""
        i = bisect_right(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


class PiiFinder:
    def __init__(self, model: BiLstmCrf):
        self.model = model

    def windows(self, text: str) -> list[int]:
        """Starts of the windows with what every span has."""
        starts: set[int] = set()
        for m in TRIGGER.finditer(text):
            k = m.start() // STEP
            starts |= {k * STEP, max(0, (k - 1) * STEP)}
        return sorted(starts)

    def find(self, texts: list[str]) -> list[tuple[list, list]]:
        """Base spans and all spans of each text."""
        base = [base_spans(t) for t in texts]
        jobs = [(i, a) for i, t in enumerate(texts) for a in self.windows(t)]
        votes: dict[int, dict[int, np.ndarray]] = {}
        while jobs:
            beyond: set[tuple[int, int]] = set()
            coded: dict[int, np.ndarray] = {}
            for at in range(0, len(jobs), 512):
                part = jobs[at : at + 512]
                ids = np.full((WINDOW, len(part)), CLASSES - 1)
                for j, (i, a) in enumerate(part):
                    if i not in coded:
                        coded = {i: classes(texts[i])}
                    row = coded[i][a : a + WINDOW]
                    ids[: len(row), j] = row
                tags = self.model.decode(ids)
                for j, (i, a) in enumerate(part):
                    got = votes.setdefault(i, {})
                    got[a] = tags[:, j].copy()
                    if got[a][0] and a:
                        beyond.add((i, a - STEP))
                    if got[a][-1] and a + WINDOW < len(texts[i]):
                        beyond.add((i, a + STEP))
            jobs = sorted((i, a) for i, a in beyond if a not in votes[i])
        return [(b, self.reconcile(texts[i], b, votes[i]) if i in votes else b) for i, b in enumerate(base)]

    def runs(self, text: str, votes: dict[int, np.ndarray]) -> list[tuple]:
        """(whole, inside, length, kind, start, end) of each window's runs, and of those that they make up over several windows."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for a, tags in votes.items():
            t = 0
            while t < WINDOW:
                if tags[t]:
                    k, e = (int(tags[t]) - 1) // 2, t + 1
                    while e < WINDOW and tags[e] == 2 + 2 * k:
                        e += 1
                    found.setdefault(a, []).append((k, t, e))
                    t = e
                else:
                    t += 1
        # start and end of each run with what continues it, how far inside their windows these are, and whether an edge cuts it there
        left: dict[tuple, tuple[int, int, bool]] = {}
        right: dict[tuple, tuple[int, int, bool]] = {}
        for a in sorted(found):
            for k, t, e in found[a]:
                own = left[a, k, t] = (a + t, t, t == 0 < a)
                if own[2]:
                    left[a, k, t] = next((left[b, k, u] for b in (a - STEP, a - 2 * STEP) for j, u, v in found.get(b, ()) if j == k and b + u < a <= b + v), own)
        for a in sorted(found, reverse=True):
            for k, t, e in found[a]:
                own = right[a, k, t] = (a + e, WINDOW - e, e == WINDOW and a + WINDOW < len(text))
                if own[2]:
                    right[a, k, t] = next((right[b, k, u] for b in (a + STEP, a + 2 * STEP) for j, u, v in found.get(b, ()) if j == k and b + u <= a + e < b + v), own)
        out = set()
        for a in found:
            for k, t, e in found[a]:
                cut = (t == 0 < a) or (e == WINDOW and a + WINDOW < len(text))
                out.add((not cut, min(t, WINDOW - e), e - t, KINDS[k], a + t, min(a + e, len(text))))
                if cut:
                    (x, into, open_left), (y, rest, open_right) = left[a, k, t], right[a, k, t]
                    out.add((not open_left and not open_right, min(into, rest), y - x, KINDS[k], x, min(y, len(text))))
        return sorted(out, reverse=True)

    def reconcile(self, text: str, base: list, votes: dict[int, np.ndarray]) -> list:
        """One span for each run of spans that touch: the one most inside its windows, if it holds."""
        out, taken = list(base), Taken((a, b) for _, a, b in base)
        for _, _, _, kind, a, b in self.runs(text, votes):
            while a < b and text[a] in " .,;:":
                a += 1
            while b > a and text[b - 1] in " .,;:(-":
                b -= 1
            if taken.free(a, b) and VALID[kind](text[a:b]) and not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum()):
                out.append((kind, a, b))
                taken.add(a, b)
        return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def fit_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> BiLstmCrf:
    """Fits on at most SAMPLE texts, those with the smallest hashes of their ids, and at most 4000 characters of each."""
    rows = docs.select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("t")).filter("t is not null")
    # hashes first, so that no task sends the driver texts that aren't chosen
    last = rows.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).head()[0]
    chosen = rows.filter(F.col("h") <= last).select("h", F.substring("t", 1, 4000).alias("t")) if last is not None else rows
    rows = chosen.orderBy("h", "t").limit(SAMPLE).collect()
    return BiLstmCrf().fit(*training_set([r["t"] for r in rows]))


def find_pii(docs: DataFrame, model: BiLstmCrf, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    finder = docs.sparkSession.sparkContext.broadcast(PiiFinder(model))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = finder.value.find(batch.column(1).to_pylist())
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in got], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got], pa.string()), pa.array([joined(every) for _, every in got], pa.string())], names=schema.names)

    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return find_pii(docs, fit_pii(docs))
