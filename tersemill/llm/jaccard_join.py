"""N-gram Jaccard join with set-relation skipping (operator 9).

A document's set is its distinct word shingles, as 64-bit hashes. A node is a set, named by a 64-bit hash of
its members, so equal sets are one node from the start.

Index. A count sketch over the whole corpus (a fixed number of counters) orders shingles from rare to frequent,
ties by hash; any order that all documents share keeps prefix filtering exact. Of n shingles the first
n - ceil(3n/4) + 1 are indexed, each with its position, and dealt out by shingle. The sketch also tells which
lists may be long: those are dealt over several parts by node, so no list is bound to one task.

Skipping by position. A list's entries lie in blocks of one set size, ordered by position. A set that probes
the list looks at each block once: if the sizes don't fit, or if what follows the probing position can't make
up the overlap that both sizes ask for, the whole block is skipped; else the block is read up to the last
position from which that overlap can still be reached, and no further.

Answers from a similar set. The set with the least hash among those of about one size leads a list (or a part
of it; then the leads of the parts meet in turn) and is the only one that probes at first: its exact overlaps
with the others are its answers, and their number is linear in the index. The answers of the others are
derived from them. From the overlaps x and y of two sets with their leader, of l members, follows that theirs
is at least x + y - l, and at most min(x, y) and the lesser of what the two have outside of it. That settles
most pairs, as linked or as apart, without reading a set; pairs inside one component need no answer. Only
lists with several components left are gone through again, first by some members of each list's largest
component, then by all pairs between components. So every pair that can link two components is decided.

Pairs that the bounds leave open meet a parity signature of each set (the symmetric difference has at least as
many members as two signatures have different bits, which is exact), then the sets themselves.

Defined results: null and empty texts and those without words have an empty set and link with nothing; rows
that repeat an id with its text are one document; with another text, each has the component of its own text;
rows without an id link with nothing and have no component; an empty table gives an empty one; other columns
are ignored. Ids are integers.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN_ID, OWN_KEY, hinted, materialize, scratch, slices, table, trimmed
from .components import components
from .shingles import Shingler, scatter

#: The link: NUM of overlap against DEN of union.
NUM, DEN = 75, 100
COUNTERS, SLICE_BITS = 1 << 24, 13
SIGNATURE = 1024
#: Members of a list's largest component that each set outside of it meets before all are gone through.
SOME = 6
#: Index entries a task, and entries gathered before they are dealt.
ENTRIES, GATHER = 200_000, 200_000
#: Entries of a list in one part, pairs of one set in one part of a join, most rows that are broadcast.
PART, SHARE, IDS = 8192, 2048, 500_000
#: Pairs of sets that go to a Python worker at a time.
COMPARED = 128
ENTRY = np.dtype([("key", "u8"), ("node", "i8"), ("n", "i4"), ("at", "i4")])
LEVEL, LOW = np.uint64(58), np.uint64((1 << 58) - 1)
BIG = 1 << 32


def counter_of(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - 24)).astype(np.int64)


def signature(s: np.ndarray) -> bytes:
    odd = np.bincount((s & np.uint64(SIGNATURE - 1)).astype(np.int64), minlength=SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def node_of(s: np.ndarray) -> int:
    return int(scatter(s + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64))


def least_overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The smallest overlap with which sets of n and m members link."""
    return -(-NUM * (np.asarray(n, np.int64) + m) // (NUM + DEN))


def rank(node: np.ndarray) -> np.ndarray:
    """A fixed random order of nodes: of a pair the first comes first, of a list it leads."""
    return scatter(node.view(np.uint64) + np.uint64(12345))


def scan(docs: DataFrame, width: int) -> DataFrame:
    """A row per document (id, text_hash, n, node), and rows of the count sketch (slice, counts)."""
    shingler = Shingler(width)
    names = ["id", "text_hash", "n", "node", "slice", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int32)
        for batch in slices(batches):
            n, node = [], []
            for s in shingler.many(batch.column(1).to_pylist()):
                np.add.at(counts, counter_of(s), 1)
                n.append(len(s))
                node.append(node_of(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=names)
        slots = counts.reshape(-1, 1 << SLICE_BITS)
        for at in range(0, len(slots), 256):
            parts = [(at + i, zlib.compress(x.astype(np.uint8) if x.max() < 256 else x, 1)) for i, x in enumerate(slots[at : at + 256]) if x.any()]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(parts), pa.int64()) for _ in range(4)), pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=names)

    return docs.mapInArrow(trimmed(run), "id long, text_hash long, n long, node long, slice int, counts binary")


def step_of(mean: float) -> float:
    """How far above the mean a counter goes by chance."""
    return 3 * np.sqrt(mean) + 2


def levels(counts: np.ndarray, mean: float) -> np.ndarray:
    """0 for what is no more frequent than chance fills a counter, then a step for each doubling."""
    return np.ceil(np.log2(np.maximum((counts - mean) / step_of(mean), 1))).clip(0, 60).astype(np.uint8)


def parts_of(mean: float) -> np.ndarray:
    """The parts that a list is dealt over, by its shingle's level: about PART entries each at most."""
    parts = np.minimum(step_of(mean) * 2.0 ** np.arange(64) / PART, 2.0**40)
    parts[0] = 1  # no more frequent than chance fills a counter
    return np.maximum(1, parts).astype(np.uint64)


def sketch(scanned: DataFrame, mean: float) -> np.ndarray:
    """The level of each counter, from the sums over all documents; mean: of the counters. COUNTERS bytes come
    to the driver and go to the workers, whatever the input. A task ships what it counted, at most its own
    distinct shingles, in COUNTERS >> SLICE_BITS slices, and adds up slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in slices(batches):
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = zlib.decompress(x.as_buffer())
                x = np.frombuffer(x, np.uint8 if len(x) == 1 << SLICE_BITS else np.int32)
                sums[i] = sums[i] + x if i in sums else x.astype(np.int64)
        packed = [zlib.compress(levels(x, mean).tobytes(), 1) for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "counts"])

    parts = scanned.filter("slice is not null").select("slice", "counts").repartition("slice").mapInArrow(trimmed(run), "slice int, counts binary").collect()
    out = np.zeros((COUNTERS >> SLICE_BITS, 1 << SLICE_BITS), np.uint8)
    for r in parts:
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return out.ravel()


def index(docs: DataFrame, width: int, level, same: dict[int, int], split: np.ndarray, parts: int) -> DataFrame:
    """(bucket, entries): the index entries of all documents, packed. level: a broadcast; same: of sets that very
    many documents have, the one document that is indexed."""
    shingler = Shingler(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = level.value
        gathered: list[np.ndarray] = []
        size = 0

        def deal() -> pa.RecordBatch:
            e = np.concatenate(gathered)
            bucket = (scatter(e["key"] + part_of(e, split)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            e, bucket = e[order], bucket[order]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(e)]])
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]], pa.int32()), pa.array([e[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["bucket", "entries"])

        for batch in slices(batches):
            for i, s in zip(batch.column(0).to_pylist(), shingler.many(batch.column(1).to_pylist()), strict=True):
                n = len(s)
                if not n:
                    continue
                node = node_of(s)
                if same.get(node, i) != i:
                    continue
                p = n - -(-NUM * n // DEN) + 1
                e = np.empty(p, ENTRY)
                key = (levels[counter_of(s)].astype(np.uint64) << LEVEL) | (s & LOW)
                e["key"] = np.sort(np.partition(key, p - 1)[:p] if p < n else key)
                e["node"], e["n"], e["at"] = node, n, np.arange(p)
                gathered.append(e)
                size += p
                if size >= GATHER:
                    yield deal()
                    gathered, size = [], 0
        if gathered:
            yield deal()

    return docs.mapInArrow(trimmed(run), "bucket int, entries binary")


def part_of(e: np.ndarray, split: np.ndarray) -> np.ndarray:
    return rank(np.ascontiguousarray(e["node"])) % split[(e["key"] >> LEVEL).astype(np.int64)]


class Blocks(NamedTuple):
    """Entries sorted by list, set size and position, in blocks of one list and size."""

    list: np.ndarray
    n: np.ndarray
    start: np.ndarray
    end: np.ndarray
    #: of each entry its block and position as one ascending number
    place: np.ndarray

    @classmethod
    def of(cls, lists: np.ndarray, n: np.ndarray, at: np.ndarray) -> Blocks:
        first = np.concatenate([[True], (lists[1:] != lists[:-1]) | (n[1:] != n[:-1])]) if len(n) else np.empty(0, bool)
        start = np.flatnonzero(first)
        return cls(lists[start], n[start].astype(np.int64), start, np.append(start[1:], len(n)), (np.cumsum(first) - 1) * BIG + at)

    def upto(self, blocks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many entries of each block have at most this position."""
        return np.searchsorted(self.place, blocks * BIG + np.maximum(at, -1), "right") - self.start[blocks]

    def reach(self, blocks: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many entries of each block a set of n members, at its position `at`, has to look at. 0: skipped."""
        m = self.n[blocks]
        need = least_overlap(n, m)
        fits = (NUM * np.maximum(n, m) <= DEN * np.minimum(n, m)) & (n - at >= need)
        return np.where(fits, self.upto(blocks, m - need), 0)

    def mutual(self) -> np.ndarray:
        """Which entries any other entry of their list has to look at, found from pairs of blocks."""
        most = self.upto(np.arange(len(self.n)), self.n - least_overlap(self.n, self.n))
        most[most < 2] = 0
        i, step = np.arange(len(self.n)), 1
        while len(i := i[i + step < len(self.n)]):
            j = i + step
            near = (self.list[i] == self.list[j]) & (NUM * self.n[j] <= DEN * self.n[i])  # sizes ascend: past the first that doesn't fit none does
            i, j = i[near], j[near]
            need = least_overlap(self.n[i], self.n[j])
            x, y = self.upto(i, self.n[i] - need), self.upto(j, self.n[j] - need)
            both = (x > 0) & (y > 0)
            most[i[both]] = np.maximum(most[i[both]], x[both])
            most[j[both]] = np.maximum(most[j[both]], y[both])
            step += 1
        keep = np.zeros(len(self.place), bool)
        keep[spans(self.start, most)] = True
        return keep


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All of start[i] .. start[i] + length[i], one after another."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())


class Found(NamedTuple):
    """a, b: pairs to compare, a before b by rank; left: entries of lists that pairs with leads don't settle;
    leads: entries that lead a part of a list; skipped: probes of blocks that were skipped as a whole."""

    a: np.ndarray
    b: np.ndarray
    left: np.ndarray
    leads: np.ndarray
    skipped: int


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    if len(a):
        keep = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        a, b = a[keep], b[keep]
    return a, b


def probe_leads(e: np.ndarray, split: np.ndarray | None) -> Found:
    """What the leads of index lists find. split None: lists are whole."""
    part = part_of(e, split) if split is not None else np.zeros(len(e), np.uint64)
    order = np.lexsort((e["node"], e["at"], e["n"], part, e["key"]))
    e, part = e[order], part[order]
    if len(e):
        # equal sets are one entry
        keep = np.concatenate([[True], (e["key"][1:] != e["key"][:-1]) | (e["node"][1:] != e["node"][:-1])])
        e, part = e[keep], part[keep]
    several = split[(e["key"] >> LEVEL).astype(np.int64)] > 1 if split is not None else np.zeros(len(e), bool)
    new = np.concatenate([[True], (e["key"][1:] != e["key"][:-1]) | (part[1:] != part[:-1])]) if len(e) else np.empty(0, bool)
    lists = np.cumsum(new) - 1
    many = np.bincount(lists, minlength=1)[lists] if len(e) else np.empty(0, np.int64)
    use = (many > 1) | several
    e, lists, several = e[use], lists[use], several[use]
    none = np.empty(0, np.int64)
    if not len(e):
        return Found(none, none, e, e, 0)
    blocks = Blocks.of(lists, e["n"], e["at"])
    # sets whose sizes lie within 4/3 of each other: the first of them by rank leads
    size = np.floor(np.log(e["n"]) / np.log(DEN / NUM) + 1e-9).astype(np.int64)
    first = np.concatenate([[True], (lists[1:] != lists[:-1]) | (size[1:] != size[:-1])])
    group = np.cumsum(first) - 1
    by_rank = np.lexsort((rank(np.ascontiguousarray(e["node"])), group))
    lead = by_rank[np.flatnonzero(np.concatenate([[True], np.diff(group[by_rank]) > 0]))]
    every, own = np.arange(len(blocks.n)), group[blocks.start]
    # a block is probed by its own lead, and by those of the next smaller and the next larger sets
    beside = [np.flatnonzero((0 <= own + d) & (own + d < len(lead))) for d in (-1, 1)]
    beside = [x[(lists[lead[own[x] + d]] == blocks.list[x]) & (size[lead[own[x] + d]] == size[blocks.start[x]] + d)] for x, d in zip(beside, (-1, 1), strict=True)]
    probing, probed = np.concatenate([lead[own], lead[own[beside[0]] - 1], lead[own[beside[1]] + 1]]), np.concatenate([every, *beside])
    take = blocks.reach(probed, e["n"][probing].astype(np.int64), e["at"][probing].astype(np.int64))
    x, y = e["node"][np.repeat(probing, take)], e["node"][spans(blocks.start[probed], take)]
    x, y = x[x != y], y[x != y]
    swap = rank(x) > rank(y)
    a, b = distinct_pairs(np.where(swap, y, x), np.where(swap, x, y))
    # leads are through; of the others, those remain that look at each other
    rest = ~several
    rest[lead] = False
    rest = np.flatnonzero(rest)
    rest = rest[Blocks.of(lists[rest], e["n"][rest], e["at"][rest]).mutual()]
    return Found(a, b, np.concatenate([e[several], e[rest]]), e[lead[several[lead]]], int((take == 0).sum()))


def lead_pairs(indexed: DataFrame, tasks: int, split: np.ndarray) -> DataFrame:
    """kind 0: pairs (a, b). 1: entries (key, a, n, at) of lists that may need another look. 2: entries of leads of parts."""
    names = ["kind", "a", "b", "key", "n", "at"]

    def rows(kind: int, e: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(e), 50_000):
            x = e[i : i + 50_000]
            k = len(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), pa.array(np.ascontiguousarray(x["node"])), pa.nulls(k, pa.int64()), pa.array(np.ascontiguousarray(x["key"]).view(np.int64)), pa.array(np.ascontiguousarray(x["n"])), pa.array(np.ascontiguousarray(x["at"]))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = np.frombuffer(b"".join([x for batch in batches for x in batch.column(1).to_pylist()]), ENTRY)
        found = probe_leads(e, split)
        del e
        for i in range(0, len(found.a), 50_000):
            a, b = found.a[i : i + 50_000], found.b[i : i + 50_000]
            k = len(a)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), pa.array(a), pa.array(b), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32())], names=names)
        yield from rows(1, found.left)
        yield from rows(2, found.leads)

    return indexed.repartition(tasks, "bucket").mapInArrow(trimmed(run), "kind int, a long, b long, key long, n int, at int")


def part_leads(leads: DataFrame) -> DataFrame:
    """Pairs (a, b) of the leads of the parts of a list: they meet as a list of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), schema) if (batches := list(batches)) else None
        e = np.empty(got.num_rows if got else 0, ENTRY)
        if got:
            e["key"], e["node"], e["n"], e["at"] = got["key"].to_numpy().view(np.uint64), got["a"].to_numpy(), got["n"].to_numpy(), got["at"].to_numpy()
        found = probe_leads(e, None)
        yield pa.RecordBatch.from_arrays([pa.array(found.a), pa.array(found.b)], names=["a", "b"])

    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("n", pa.int32()), ("at", pa.int32())])
    return leads.select("key", "a", "n", "at").repartition("key").mapInArrow(run, "a long, b long")


class Cell(NamedTuple):
    """Entries of a list, or of two parts of one (side 0 meets side 1), sorted by size and position."""

    node: np.ndarray
    n: np.ndarray
    at: np.ndarray
    side: np.ndarray
    component: np.ndarray
    leader: np.ndarray
    overlap: np.ndarray
    lead_n: np.ndarray
    sig: np.ndarray


class Derived(NamedTuple):
    """a, b: places in the cell of pairs that may link; known: those that do, by their leader. Counts: blocks
    skipped, and pairs that a leader settled either way."""

    a: np.ndarray
    b: np.ndarray
    known: np.ndarray
    skipped: int
    settled: int


def derive(cell: Cell, cross: bool, some: bool) -> Derived:
    """The pairs between components that neither blocks, signatures nor leaders rule out. some: those outside of
    the cell's largest component meet SOME of its members; else all pairs are gone through."""
    names, owner = np.unique(cell.component, return_inverse=True)
    main = names[np.bincount(owner).argmax()]
    outside = np.flatnonzero(cell.component != main)
    n, at = cell.n.astype(np.int64), cell.at.astype(np.int64)
    blocks = Blocks.of(np.zeros(len(n), np.int64), n, at)
    every = np.arange(len(blocks.n))
    skipped = settled = 0
    out = []
    for i in outside:
        take = blocks.reach(every, n[i], at[i])
        skipped += int((take == 0).sum())
        js = spans(blocks.start, take)
        # of two outside of the largest component the later one in order probes
        js = js[(cell.component[js] != cell.component[i]) & ((cell.component[js] == main) | (js < i))]
        if cross:
            js = js[cell.side[js] != cell.side[i]]
        if some:
            js = js[cell.component[js] == main]
            js = js[scatter(js.astype(np.uint64) + np.uint64(int(cell.node[i]) % 1009)).argsort()[:SOME]]
        need = least_overlap(n[i], n[js])
        apart = np.bitwise_count(cell.sig[i] ^ cell.sig[js]).sum(1, dtype=np.int64)
        near = n[i] + n[js] - apart >= 2 * need
        js, need = js[near], need[near]
        # inside the leader two share at least x + y - l and at most the smaller; outside of it at most the smaller rest
        one = (cell.leader[i] == cell.leader[js]) & (cell.overlap[i] >= 0) & (cell.overlap[js] >= 0)
        x, y = cell.overlap[i], cell.overlap[js]
        known = one & (x + y - cell.lead_n[i] >= need)
        may = ~one | (np.minimum(x, y) + np.minimum(n[i] - x, n[js] - y) >= need)
        settled += int(known.sum() + (~may).sum())
        out.append((np.full(may.sum(), i), js[may], known[may]))
    if not out:
        none = np.empty(0, np.int64)
        return Derived(none, none, np.empty(0, bool), 0, 0)
    a, b, known = (np.concatenate(x) for x in zip(*out, strict=True))
    return Derived(a, b, known, skipped, settled)


CELL = "key long, c long, d long, side int, node long, n int, at int, component long, leader long, overlap long, lead_n long, sig binary"


def derived_pairs(entries: DataFrame, some: bool) -> DataFrame:
    """Of cells: pairs (a, b, known)."""
    names = [x.split()[0] for x in CELL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        got = pa.Table.from_batches(held)
        col = {x: got[x].to_numpy().astype(np.int64) for x in names[:-1]}
        sig = np.frombuffer(b"".join(got["sig"].to_pylist()), np.uint64).reshape(-1, SIGNATURE // 64)
        del got, held
        order = np.lexsort((col["node"], col["at"], col["n"], col["d"], col["c"], col["key"]))
        key, c, d = (col[x][order] for x in ("key", "c", "d"))
        cut = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])) + 1, [len(key)]])
        out, size = [], 0
        for s, t in zip(cut[:-1], cut[1:], strict=True):
            o = order[s:t]
            x = derive(Cell(*(col[k][o] for k in ("node", "n", "at", "side", "component", "leader", "overlap", "lead_n")), sig[o]), c[s] != d[s], some)
            out.append((o[x.a], o[x.b], x.known))
            size += len(x.a)
            if size > 500_000:
                yield batch_of(out, col)
                out, size = [], 0
        yield batch_of(out, col)

    def batch_of(out: list, col: dict[str, np.ndarray]) -> pa.RecordBatch:
        i, j, known = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
        swap = rank(col["node"][i]) > rank(col["node"][j])
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        a, b = col["node"][i], col["node"][j]
        order = np.lexsort((~known, b, a))
        a, b, known = a[order], b[order], known[order]
        keep = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (a, b, known)], names=["a", "b", "known"])

    dealt = entries.select(*names).repartition("key", "c", "d")
    return dealt.mapInArrow(trimmed(run), "a long, b long, known boolean").groupBy("a", "b").agg(F.max("known").alias("known"))


def with_sets(rows: DataFrame, side: str, other: str, sets: DataFrame, *columns: str, pairs: DataFrame | None = None) -> DataFrame:
    """rows, with columns of the set of one side. A set of more than SHARE pairs (given without other columns, as counting
    them is cheap) goes to several parts, and its pairs are dealt over them."""
    often = materialize((pairs or rows).groupBy(side).count().filter(F.col("count") > SHARE).select(F.col(side).alias("_n"), F.ceil(F.col("count") / SHARE).cast("long").alias("_parts")), "often")
    n = often.count()
    own = sets.select(F.col("node").alias(side), *(F.col(c).alias(c + "_" + side) for c in columns))
    if not n:
        return rows.join(own, side)
    few = F.broadcast(often) if n <= IDS else often
    zero = F.lit(0).cast("long")
    dealt = rows.join(few, F.col(side) == F.col("_n"), "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(other), F.col("_parts")), zero)).drop("_n", "_parts")
    own = own.join(few, F.col(side) == F.col("_n"), "left").withColumn("_part", F.explode(F.sequence(zero, F.coalesce(F.col("_parts"), F.lit(1).cast("long")) - 1))).drop("_n", "_parts")
    return dealt.join(own, [side, "_part"]).drop("_part")


def near_signatures(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose signatures allow a link."""
    x = with_sets(with_sets(pairs, "b", "a", sets, "n", "sig"), "a", "b", sets, "n", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, SIGNATURE // 64) for i in (4, 5))
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(n + m - apart >= 2 * least_overlap(n, m)))

    return x.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(trimmed(run), "a long, b long")


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, overlap) of pairs, from the sets."""
    pairs = materialize(pairs.select("a", "b"), "to-compare")
    n = pairs.count()
    ids = pairs.select(F.col("a").alias("node")).distinct()
    first = sets.join(F.broadcast(ids), "node", "left_semi") if n <= IDS else sets
    # few pairs go to the sets of their second sides, so that these are shuffled once, to those of the first
    second = sets.select(F.col("node").alias("b"), F.col("members").alias("members_b")).join(F.broadcast(pairs), "b") if n <= IDS else with_sets(pairs, "b", "a", sets, "members")
    x = with_sets(second, "a", "b", first, "members", pairs=pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            last, x = None, np.empty(0, np.uint64)
            for a, ma, mb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, x = a, np.frombuffer(ma.as_buffer(), np.uint64)
                y = np.frombuffer(mb.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                rows.append((len(x), len(y), int((both[1:] == both[:-1]).sum())))
            cols = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(cols[:, i]) for i in range(3))], names=["a", "b", "na", "nb", "overlap"])

    return x.select("a", "b", "members_a", "members_b").mapInArrow(trimmed(run), "a long, b long, na long, nb long, overlap long")


def linked():
    return DEN * F.col("overlap") >= NUM * (F.col("na") + F.col("nb") - F.col("overlap"))


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, text_hash (xxhash64 of the text, null as empty)."""
    with scratch() as keep:
        return _join(docs, id_col, text_col, width, keep)


def _join(docs: DataFrame, id_col: str, text_col: str, width: int, keep: Callable[..., None]) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext
    small = lambda df, n: F.broadcast(df) if n <= IDS else df
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    scanned = materialize(scan(rows, width), "scan")
    every = scanned.filter("slice is null").select("id", "text_hash", "n", "node")
    live = every.filter("n > 0 and id is not null")
    total = live.agg(F.count(F.lit(1)), F.sum("n")).first()
    mean = (total[1] or 0) / COUNTERS
    split = parts_of(mean)
    level = sc.broadcast(sketch(scanned, mean))

    # of equal sets the smallest id stands for all; those of more than a 2000th of all rows, at most 2000, are known everywhere
    nodes = live.groupBy("node", "id").agg(F.count(F.lit(1)).alias("rows")).groupBy("node").agg(F.min("id").alias("first"), F.sum("rows").alias("rows"), F.max("rows").alias("repeats"))
    nodes = materialize(nodes, "nodes")
    often = (F.col("rows") > 16) & (F.col("rows") * 2000 >= (total[0] or 0))
    same = {r["node"]: r["first"] for r in nodes.filter(often).select("node", "first").collect()}

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((total[1] or 0) * 0.27 / ENTRIES) + 1)
    texts = rows.filter("id is not null")
    found = materialize(lead_pairs(index(texts, width, level, same, split, 4 * tasks), tasks, split), "pairs-and-lists")
    level.destroy()
    pairs = found.filter("kind = 0").select("a", "b")
    if found.filter("kind = 2").take(1):
        pairs = pairs.unionByName(part_leads(found.filter("kind = 2")))
    pairs = materialize(pairs.dropDuplicates(["a", "b"]), "pairs")
    left = found.filter("kind = 1").select("key", F.col("a").alias("node"), "n", "at")

    # the sets of those that take part
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(left.select("node")).distinct().join(nodes, "node")
    wanted = materialize(wanted.select(F.col("first").alias("id")), "wanted")
    shingler = Shingler(width)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = list(shingler.many(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(map(node_of, got), pa.int64()), pa.array(map(len, got), pa.int64()), pa.array([signature(s) for s in got], pa.binary()), pa.array([s.tobytes() for s in got], pa.binary())], names=["node", "n", "sig", "members"])

    sets = texts.join(small(wanted.distinct(), wanted.count()), "id", "left_semi").select("id", "text").mapInArrow(trimmed(members), "node long, n long, sig binary, members binary")
    if nodes.filter("repeats > 1").take(1):  # rows that repeat an id and its text give a set each
        sets = sets.groupBy("node").agg(F.min(F.struct("n", "sig", "members")).alias("s")).select("node", "s.*")
    sets = materialize(sets, "sets")
    checked = materialize(compare(near_signatures(pairs, sets), sets), "checked", COMPARED)
    done = [checked]
    links = checked.filter(linked()).select("a", "b")
    led = checked.select(F.col("b").alias("node"), F.struct("overlap", F.col("a").alias("leader"), F.col("na").alias("lead_n")).alias("m")).unionByName(checked.select(F.col("a").alias("node"), F.struct(F.col("na").alias("overlap"), F.col("a").alias("leader"), F.col("na").alias("lead_n")).alias("m")))
    led = materialize(led.groupBy("node").agg(F.max("m").alias("m")).select("node", "m.*"), "leaders")
    n_sets = sets.count()
    for some in (True, False):
        label = components(links)
        of_component = sets.select("node").join(label.withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        now = left.join(small(of_component, n_sets), "node")
        now = materialize(now, "lists")
        several = materialize(now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("m")).filter("x <> y").select("key", F.ceil(F.col("m") / PART).cast("long").alias("blocks")), "several")
        k = several.count()
        if k:
            now = now.join(small(several, k), "key").join(small(led, n_sets), "node", "left").join(sets.select("node", "sig"), "node")
            now = now.withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            now = now.withColumns({"c": F.least("own", "other"), "d": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int"), "leader": F.coalesce("leader", F.lit(0)), "overlap": F.coalesce("overlap", F.lit(-1)), "lead_n": F.coalesce("lead_n", F.lit(0))})
            more = derived_pairs(now, some)
            for x in done:
                more = more.join(x.select("a", "b"), ["a", "b"], "left_anti")
            more = materialize(more, "derived")
            known = more.filter("known").select("a", "b")
            compared = materialize(compare(more.filter("not known"), sets), "checked", COMPARED)
            done.append(compared)
            links = links.unionByName(known).unionByName(compared.filter(linked()).select("a", "b"))
    label = components(links).withColumnRenamed("id", "node")
    # the smallest id of a component; a component that very many nodes share meets them by broadcast, as a set that very many rows share does
    inside = materialize(nodes.join(label, "node", "left").select("node", "first", F.coalesce("component", "node").alias("c"), often.alias("hot")), "inside")
    least = inside.groupBy("c").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    least = materialize(least.withColumn("large", F.col("size") * 2000 >= (total[0] or 0)), "components")
    large = F.broadcast(least.filter("large").select("c", "component"))
    named = inside.join(large, "c").unionByName(inside.join(large, "c", "left_anti").join(least.filter("not large").select("c", "component"), "c", "left"), allowMissingColumns=True)
    named = materialize(named.select("node", F.coalesce("component", "first").alias("component"), "hot"), "named")
    keep(scanned, named)
    hot = F.broadcast(named.filter("hot").drop("hot"))
    plain = F.col("id").isNull() | (F.col("n") == 0)
    linkable = every.filter(~plain)
    out = linkable.join(hot, "node").unionByName(linkable.join(hot, "node", "left_anti").join(named.filter("not hot").drop("hot"), "node"))
    out = out.select("id", "text_hash", "n", "component").unionByName(every.filter(plain).select("id", "text_hash", "n", F.col("id").alias("component")))
    kind = docs.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("component").cast(kind).alias("component_id"), "text_hash")


def without_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their component, and those without an id."""
    found = jaccard_join(docs, id_col=id_col, text_col=text_col)
    gone = materialize(found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(OWN_ID), F.col("text_hash").alias(OWN_KEY)), "near-copies")
    same = (F.col(id_col) == F.col(OWN_ID)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(OWN_KEY))
    return docs.join(hinted(gone), same, "left_anti")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("text_hash")


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: hash(w[i:i + 4])) WHEN len(w) > 0 THEN [hash(w)] ELSE [] END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id GROUP BY 1, 2
"""
