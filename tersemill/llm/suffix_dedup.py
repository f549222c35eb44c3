"""Removal of repeated byte strings by deep-shallow sorting of suffixes (operator 11).

A byte goes if a string of `length` bytes that covers it also starts anywhere else, in its own text or another.
Sorting every suffix of a corpus would move it many times over, so suffixes are sorted at anchors only, to both
sides. The anchor of a window of `length` bytes is its leftmost 8-gram of least hash; equal windows have their
anchors at the same offset, and each window has one. About every 97th byte is an anchor, and the windows of one
anchor start at a run of offsets before it.

1. Texts that repeat as wholes are told by digests; one of each stays for what follows, all of them go.
2. Anchors are keyed by hashes of the bytes that all their windows have in common (the offsets are dealt in
   two ranges for that; each has a key). Keys are counted with partial sums; what is unique can't repeat.
3. Anchors with a key met again are shuffled by it, with their contexts. For each key the strings to the right
   of the anchors, and those to the left read backwards, are sorted by deep-shallow sorting: multikey quicksort
   down to a shallow depth, blind tries for the groups that still agree there. Windows at an offset are equal
   exactly where the strings agree far enough to both sides, so they are told from neighbours in both orders.
4. Runs of repeated windows are united text by text.

Hashes only choose what is sorted: bytes decide. A key with over `group` anchors is never one task's: contexts
that are equal inside a chunk are decided there and one goes on; then the range of offsets is halved, which gives
longer keys, again and again while a key is that frequent. A range of one offset is a window itself, which is counted.

Defined results: a null text is empty; texts shorter than `length` stay as they are; rows that repeat a text
are copies of each other, whatever their ids, and go as a whole if they have `length` bytes; null ids stay; an
empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hinted, materialize, scratch, slices, table, trimmed

LENGTH, GRAM = 200, 8
#: Most anchors of a key that are sorted in one task.
GROUP = 20_000
#: Windows looked at together, and bytes of texts, or records, held together by a task.
BLOCK, PACK, TOGETHER = 1 << 15, 1 << 22, 30_000
#: Bytes that multikey quicksort looks at beyond a key before blind tries take over, and at a time.
SHALLOW, STEP = 32, 8
#: Most bytes of removed runs that are broadcast to the texts.
SMALL = 32 << 20

MIX, SPREAD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)

RECORD = "key long, lo int, hi int, x int, y int, ctx binary, row binary, at long, hot boolean, sure boolean"


def ranges_of(length: int) -> list[tuple[int, int]]:
    n = length - GRAM + 1
    return [(0, (n + 1) // 2), ((n + 1) // 2, n)]


class Anchors:
    """The anchors of texts that lie in one buffer: at, and for each range of offsets lo to hi the offsets x to y
    that its windows have, with the key of that range."""

    def __init__(self, texts: list[bytes], length: int):
        self.length, self.buf = length, b"".join(texts)
        self.ends = np.cumsum([len(t) for t in texts])
        self.u = np.ndarray((len(self.buf) + length,), "<u8", self.buf + bytes(length + GRAM), strides=(1,))
        at, first, last = self.windows()
        self.parts = []
        for lo, hi in ranges_of(length):
            x, y = np.maximum(at - last, lo), np.minimum(at - first + 1, hi)
            some = x < y
            a = at[some]
            self.parts.append((lo, hi, a, x[some], y[some], np.searchsorted(self.ends, a, "right"), self.keys(a, lo, hi)))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors and the first and last window of each, cut at the ends of blocks."""
        wide, n = self.length - GRAM + 1, len(self.buf)
        power = 1 << (wide.bit_length() - 1)
        places = np.arange(BLOCK + wide, dtype=np.uint64)
        found = []
        starts = np.r_[0, self.ends[:-1]]
        for s in range(0, n, BLOCK):
            m = min(BLOCK, n - s)
            low = self.u[s : s + m + wide - 1] * SPREAD
            low &= HIGH
            low |= places[: len(low)]
            span = 1
            while span < power:
                low = np.minimum(low[:-span], low[span:])
                span *= 2
            q = (np.minimum(low[:m], low[wide - power : wide - power + m]) & LOW).astype(np.int64)
            ok = np.ones(m, bool)
            for k in range(int(np.searchsorted(self.ends, s, "right")), len(self.ends)):
                if self.ends[k] - self.length >= s + m:
                    break
                ok[max(int(starts[k]), int(self.ends[k]) - self.length + 1, s) - s : max(0, int(self.ends[k]) - s)] = False
            p = np.flatnonzero(ok)
            if len(p):
                q = q[p]
                turn = np.flatnonzero(np.diff(q))
                found.append((q[np.r_[0, turn + 1]] + s, p[np.r_[0, turn + 1]] + s, p[np.r_[turn, len(p) - 1]] + s))
        return tuple(np.concatenate([f[i] for f in found] or [np.empty(0, np.int64)]) for i in range(3))

    def keys(self, at: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """A hash of what all windows with offsets of lo to hi share."""
        size, start = lo + self.length - hi + 1, at - lo
        acc = np.full(len(at), lo + 1, np.uint64)
        for o in (*range(0, size - 8, 8), size - 8):
            acc = (acc ^ self.u[start + o]) * MIX
            acc ^= acc >> np.uint64(29)
        return acc.view(np.int64)


def packs(batches: Iterator[pa.RecordBatch], column: int, most: int = PACK) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about `most` bytes together; one at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def common(a: bytes, b: bytes) -> int:
    """Bytes that a and b have in common at their beginnings."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


class Branching:
    """A node of a blind trie: where its strings branch, and what hangs from the byte there. A leaf is the list of
    the items with one string; -1 stands for the end of a string."""

    __slots__ = ("depth", "arcs")

    def __init__(self, depth: int, arcs: dict):
        self.depth, self.arcs = depth, arcs


def byte(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


def blind_trie(strings: list[bytes], items: list[int]) -> list[int]:
    """items in the order of their strings: each goes down the trie by the branching bytes alone, and is compared
    once, with the leaf that it comes to; what they have in common tells where it belongs."""
    root = Branching(0, {byte(strings[items[0]], 0): [items[0]]})
    for item in items[1:]:
        s = strings[item]
        node, path = root, []
        while isinstance(node, Branching):
            path.append(node)
            down = node.arcs.get(byte(s, node.depth))
            node = next(iter(node.arcs.values())) if down is None else down
        held = strings[node[0]]
        same = common(s, held)
        if same == len(s) == len(held):
            node.append(item)
            continue
        at = [n for n in path if n.depth <= same][-1]
        if at.depth == same:
            at.arcs[byte(s, same)] = [item]
        else:
            arc = byte(s, at.depth)
            at.arcs[arc] = Branching(same, {byte(held, same): at.arcs[arc], byte(s, same): [item]})
    out: list[int] = []
    stack: list = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, Branching):
            stack.extend(node.arcs[b] for b in sorted(node.arcs, reverse=True))
        else:
            out.extend(node)
    return out


def deep_shallow(strings: list[bytes], items: list[int], known: int) -> list[int]:
    """items in the order of their strings. The first `known` bytes, most often all alike, are one symbol of the
    multikey quicksort, then STEP bytes are; what agrees SHALLOW bytes beyond goes to a blind trie."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(items, 0)]
    while stack:
        items, depth = stack.pop()
        if len(items) < 2 or depth < 0:  # depth -1: equal strings
            out.extend(items)
        elif depth >= known + SHALLOW:
            out.extend(blind_trie(strings, items))
        else:
            end = depth + STEP if depth else max(known, STEP)
            symbols = [strings[i][depth:end] for i in items]
            pivot = sorted((symbols[0], symbols[len(items) // 2], symbols[-1]))[1]
            less, same, more = [], [], []
            for i, symbol in zip(items, symbols, strict=True):
                (same if symbol == pivot else less if symbol < pivot else more).append(i)
            stack += [(more, depth), (same, end if len(pivot) == end - depth else -1), (less, depth)]
    return out


def repeated(records: dict[str, list], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of records sorted by key, all of a range of offsets lo to hi: (record, first, last) for runs of windows,
    counted from a record's first one, that another record of its key has too."""
    key, x, y = np.array(records["key"], np.int64), np.array(records["x"]), np.array(records["y"])
    lo, hi = records["lo"][0], records["hi"][0]
    n = len(key)
    cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, n].tolist()
    sides = ([c[b - 1 :] for c, b in zip(records["ctx"], records["y"], strict=True)], [c[b - 2 :: -1] if b > 1 else b"" for c, b in zip(records["ctx"], records["y"], strict=True)])
    orders, agree = [], []
    for side, known in zip(sides, (length - hi + 1, lo), strict=True):
        order = [i for a, b in zip(cuts, cuts[1:], strict=False) for i in deep_shallow(side, list(range(a, b)), known)]
        # bytes that neighbours have in common; none across keys
        sizes = np.array([len(side[i]) for i in order])
        flat = np.zeros((n, length), np.uint8)
        flat[np.arange(length) < sizes[:, None]] = np.frombuffer(b"".join([side[i] for i in order]), np.uint8)
        differ = flat[1:] != flat[:-1]
        lcp = np.where(differ.any(1), differ.argmax(1), length)
        lcp = np.minimum(lcp, np.minimum(sizes[1:], sizes[:-1]))
        order = np.array(order)
        lcp[key[order[1:]] != key[order[:-1]]] = -1
        orders.append(order)
        agree.append(lcp)
    hit = np.zeros((n, hi - lo + 2), bool)  # a column for each offset, between empty ones
    (right, left), (lcp_r, lcp_l) = orders, agree
    cls_r, cls_l = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(lo, hi):
        cls_r[right[1:]] = np.cumsum(lcp_r < length - i)
        cls_l[left[1:]] = np.cumsum(lcp_l < i)
        cls_r[right[0]] = cls_l[left[0]] = 0
        on = np.flatnonzero((x <= i) & (i < y))
        if len(on) > 1:
            code = cls_r[on] * n + cls_l[on]
            by = np.argsort(code, kind="stable")
            same = np.diff(code[by]) == 0
            hit[on[by[np.r_[False, same] | np.r_[same, False]]], i - lo + 1] = True
    edge = np.diff(hit.astype(np.int8), axis=1)
    item, start = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    # offsets start + lo to stop + lo - 1, which are windows y - 1 - offset
    return item, y[item] - lo - stop, y[item] - 1 - lo - start


def texts_of(docs: DataFrame, text_col: str) -> DataFrame:
    """(text, row): row is half of the text's SHA-256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(text.alias("text")).withColumn("row", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))


def keys_in(texts: DataFrame, length: int) -> DataFrame:
    """(key, doc, n): how often a text has a key; doc is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in packs(batches, 0):
            doc = pack.column(1).to_numpy()
            found = Anchors(pack.column(0).cast(pa.binary()).to_pylist(), length).parts
            key, of = np.concatenate([p[6] for p in found]), np.concatenate([p[5] for p in found])
            by = np.lexsort((key, of))
            key, of = key[by], of[by]
            first = np.flatnonzero(np.r_[len(key) > 0, (np.diff(key) != 0) | (np.diff(of) != 0)][: len(key)])
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(doc[of[first]]), pa.array(np.diff(np.r_[first, len(key)]), pa.int64())], names=["key", "doc", "n"])

    return texts.select("text", F.xxhash64("text").alias("doc")).mapInArrow(trimmed(run), "key long, doc long, n long")


def contexts(wanted: DataFrame, length: int) -> DataFrame:
    """Of (text, row, keys, hot): a record for each anchor with one of the keys. Those of a pack of texts with equal
    contexts are decided here (key null: windows from `at` on, y - x of them, repeat) and one goes on, as sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in packs(batches, 0):
            rows, keys, hots = pack.column(1).to_pylist(), pack.column(2).to_pylist(), [set(h) for h in pack.column(3).to_pylist()]
            found = Anchors(pack.column(0).cast(pa.binary()).to_pylist(), length)
            starts, buf = np.r_[0, found.ends[:-1]], found.buf
            mine = np.unique(np.array([k for ks in keys for k in ks], np.int64))
            out: dict = {}
            done = []
            for lo, hi, at, x, y, doc, key in found.parts:
                some = np.flatnonzero(np.isin(key, mine))
                for a, b, e, d, k in zip(at[some].tolist(), x[some].tolist(), y[some].tolist(), doc[some].tolist(), key[some].tolist(), strict=True):
                    at_ = a - e + 1
                    ctx = buf[at_ : a - b + length]
                    got = (rows[d], at_ - int(starts[d]), k in hots[d])
                    held = out.get((lo, b, e, ctx))
                    if held is None:
                        out[lo, b, e, ctx] = [k, hi, got, False]
                    else:
                        if not held[3]:
                            done.append((*held[2][:2], b, e))
                            held[3] = True
                        done.append((*got[:2], b, e))
            recs = [(k, lo, hi, b, e, ctx, *got, sure) for (lo, b, e, ctx), (k, hi, got, sure) in out.items()]
            recs += [(None, None, None, b, e, None, r, a, False, True) for r, a, b, e in done]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*recs, strict=True) if recs else [[]] * 10, ARROW, strict=True)], names=NAMES)

    return wanted.mapInArrow(trimmed(run), RECORD)


NAMES = [c.split()[0] for c in RECORD.split(", ")]
ARROW = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[c.split()[1]] for c in RECORD.split(", ")]


def sort_groups(records: DataFrame, length: int) -> DataFrame:
    """(row, start, stop): bytes in repeated windows, of records of keys of at most a group's size."""

    def found(held: dict[str, list]) -> pa.RecordBatch:
        item, first, last = repeated(held, length)
        rows = [held["row"][i] for i in item.tolist()]
        at = np.array(held["at"], np.int64)[item]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(at + first), pa.array(at + last + length)], names=["row", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lo", "hi", "key", "x", "y", "ctx", "row", "at"]
        held: dict[str, list] = {c: [] for c in names}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                more = {c: batch.column(c).slice(at, 2048).to_pylist() for c in names}
                i, n = 0, len(more["key"])
                while i < n:
                    # on with the same range of offsets, and with whole keys
                    j = i
                    while j < n and (not held["key"] or more["lo"][j] == held["lo"][0] and more["hi"][j] == held["hi"][0]) and (len(held["key"]) < TOGETHER or more["key"][j] == held["key"][-1]):
                        for c in names:
                            held[c].append(more[c][j])
                        j += 1
                    if j < n:
                        yield found(held)
                        held = {c: [] for c in names}
                    i = j
        if held["key"]:
            yield found(held)

    dealt = records.repartition("lo", "hi", "key").sortWithinPartitions("lo", "hi", "key")
    return dealt.mapInArrow(trimmed(run), "row binary, start long, stop long")


def halves(records: DataFrame, length: int) -> DataFrame:
    """Records of frequent keys: equal ones of a chunk are decided, one of them goes on with each half of its offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in packs(batches, 5):
            out: dict = {}
            done = []
            for _, lo, hi, x, y, ctx, row, at, _, sure in zip(*(pack.column(c).to_pylist() for c in NAMES), strict=True):
                held = out.get((lo, hi, x, y, ctx))
                if held is None:
                    out[lo, hi, x, y, ctx] = [row, at, sure]
                    continue
                if not held[2]:
                    done.append((None, None, None, x, y, None, held[0], held[1], False, True))
                    held[2] = True
                if not sure:
                    done.append((None, None, None, x, y, None, row, at, False, True))
            for (lo, hi, x, y, ctx), (row, at, sure) in out.items():
                mid = (lo + hi) // 2
                for a, b in ((lo, mid), (mid, hi)):
                    i, j = max(x, a), min(y, b)
                    if i < j:
                        part = ctx[y - j : len(ctx) - (i - x)]
                        key = xxhash.xxh3_64_intdigest(part[j - 1 - a : j - 1 + length - b + 1], a << 16 | b) - (1 << 63)
                        done.append((key, a, b, i, j, part, row, at + y - j, False, sure))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 10, ARROW, strict=True)], names=NAMES)

    return records.mapInArrow(trimmed(run), RECORD)


def decided(records: DataFrame, length: int) -> DataFrame:
    """Bytes in windows that are known to repeat."""
    return records.filter("key is null").select("row", F.col("at").alias("start"), (F.col("at") + F.col("y") - F.col("x") - 1 + length).alias("stop"))


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, start, stop) with lists of runs in any order: those that overlap or touch as one."""
    for batch in slices(batches):
        starts, stops = [], []
        for start, stop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            start, stop = np.array(start), np.array(stop)
            by = np.argsort(start, kind="stable")
            start, reach = start[by], np.maximum.accumulate(stop[by])
            first = np.r_[True, start[1:] > reach[:-1]]
            starts.append(start[first])
            stops.append(reach[np.r_[first[1:], True]])
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, kind), pa.array(stops, kind)], names=["row", "start", "stop"])


def repeats(texts: DataFrame, length: int, group: int) -> DataFrame:
    """(row, start, stop) of runs in texts (text, row), each there once."""
    long_ = texts.filter(F.octet_length("text") >= length)
    found = keys_in(long_, length)
    counts = found.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    again = found.select("key", "doc").join(counts, "key").groupBy("doc").agg(F.collect_list("key").alias("keys"), F.collect_list(F.when(F.col("n") > group, F.col("key"))).alias("hots"))
    records = materialize(contexts(long_.withColumn("doc", F.xxhash64("text")).join(again, "doc").select("text", "row", "keys", "hots"), length), "contexts")
    out = [decided(records, length), sort_groups(records.filter("key is not null and not hot"), length)]
    hot = records.filter("hot")
    while hot.take(1):
        split = materialize(halves(hot, length), "halves")
        out.append(decided(split, length))
        split = split.filter("key is not null")
        whole = split.filter("hi - lo = 1")  # a window each: as often as it is there
        times = whole.groupBy("ctx").agg(F.count(F.lit(1)).alias("n"))
        out.append(whole.filter("not sure").join(times.filter("n > 1"), "ctx").select("row", F.col("at").alias("start"), (F.col("at") + length).alias("stop")))
        keyed = split.filter("hi - lo > 1").drop("hot").join(split.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key")
        split = materialize(keyed.withColumn("hot", F.col("n") > group).select(*NAMES), "split")
        out.append(sort_groups(split.filter("not hot"), length))
        hot = split.filter("hot")
    runs = out[0]
    for more in out[1:]:
        runs = runs.unionByName(more)
    return runs


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP, small: int = SMALL, full: bool = False) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256, and with full what is kept: kept (binary)."""
    with scratch() as keep:
        return _suffix_dedup(docs, id_col, text_col, length, group, small, full, keep)


def _suffix_dedup(docs: DataFrame, id_col: str, text_col: str, length: int, group: int, small: int, full: bool, keep: Callable[..., None]) -> DataFrame:
    texts = texts_of(docs, text_col)
    copies = materialize(texts.filter(F.octet_length("text") >= length).groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("row"), "copies")
    keep(copies)
    copies = hinted(copies)
    once = materialize(texts.join(copies, "row", "left_semi").groupBy("row").agg(F.first("text").alias("text")).select("text", "row"), "once")
    runs = repeats(texts.join(copies, "row", "left_anti").unionByName(once), length, group)
    # copies go as wholes anyway
    runs = runs.join(copies, "row", "left_anti").groupBy("row").agg(F.collect_list("start").alias("start"), F.collect_list("stop").alias("stop"))
    runs = materialize(runs.mapInArrow(united, "row binary, start array<long>, stop array<long>"), "runs")
    keep(runs)
    size = runs.agg(F.sum(F.size("start") * 16 + 64)).first()[0] or 0

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"), text.alias("text")).withColumn("row", F.unhex(F.substring("sha", 1, 32)))
    gone = rows.join(copies, "row", "left_semi").select(F.col("id").alias(id_col), "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), *[F.lit(b"").alias("kept")] * full)
    rest = rows.join(copies, "row", "left_anti").join(F.broadcast(runs) if size <= small else runs, "row", "left")
    if not full:  # a text that nothing is taken from isn't read again
        rest = rest.withColumn("text", F.when(F.col("start").isNotNull(), F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for sha, text, start, stop in zip(*(part.column(i).to_pylist() for i in range(2, 6)), strict=True):
                data = (text or "").encode()
                if start is None:
                    out.append((0, 0, sha, data))
                    continue
                left = b"".join(data[a:b] for a, b in zip([0, *stop], [*start, len(data)], strict=True))
                out.append((sum(stop) - sum(start), len(start), hashlib.sha256(left).hexdigest(), left))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns][: 5 + full], names=names[: 5 + full])

    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * full
    return gone.unionByName(rest.select("id", "n_bytes", "sha", "text", "start", "stop").mapInArrow(trimmed(run), schema))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


#: Brute force over hexadecimal digits, two a byte.
OP11_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 400)) AS s FROM t, unnest(range(n - 199)) AS u(p) WHERE n >= 200),
r AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM (SELECT *, count(*) OVER (PARTITION BY s) AS c FROM w) WHERE c > 1),
g AS (SELECT doc_id, p, sum((before IS NULL OR p - before > 200)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM r),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM g GROUP BY doc_id, k),
kept AS (SELECT doc_id, coalesce(lag(b) OVER v, 0) AS x, a AS y FROM runs WINDOW v AS (PARTITION BY doc_id ORDER BY a)),
left_ AS (SELECT doc_id, x, y FROM kept UNION ALL SELECT doc_id, max(b), NULL FROM runs GROUP BY doc_id),
cut AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (coalesce(y, n) - x)), '' ORDER BY x) AS h FROM left_ JOIN t USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(coalesce(unhex(cut.h), encode(text))) AS kept_sha256
FROM t LEFT JOIN sums USING (doc_id) LEFT JOIN cut USING (doc_id)
"""
