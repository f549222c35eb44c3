"""Phrase collocations by position bitmaps (operator 12).

Texts become streams of words, with a mark where a piece ends, dealt into shards of positions. In a shard each word
has a compressed bitmap of its positions (a list of them where they are few, bits where they are many). A phrase's
bitmap has the positions of its last word; a word extends it by shifting that bitmap by one and ANDing it with the word's, and
the popcount is the number of its occurrences. Phrases are extended depth-first up to four words. Marks belong to no
word, so no phrase crosses them; each shard is followed by the next three words, and phrases belong to the shard in
which they begin. Popcounts are summed over a task's shards, then over all.

What can't be frequent is not extended: words, then pairs, then triples of words are counted by hashes, 32 bits in
blocks that number as the words do, and those that reach the support set a bit of a table that goes to all
tasks. The table has at most MOST_BITS bits; phrases that share one only cost time, since popcounts of words themselves
decide. So does a table that is too small for its keys: it lets more through.

Defined results: null texts are empty, a null language is `und`; rows that repeat count as often as they are there;
languages without frequent phrases give no rows, as does an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, table, trimmed

SUPPORT, SUBSUMED, TOP = 30, 80, 2000
#: Positions of a shard, words held by a task over all languages, bytes of a text read at a time.
SHARD, HELD, READ = 1 << 14, 1 << 19, 1 << 20
SPARSE = 32
#: Bits of a table: so many a key, and at most.
BITS, MOST_BITS = 32, 1 << 28
#: Hashes that a task gathers before it sends them, those of a block, most counters a task holds.
GATHER, IN_BLOCK, COUNTERS = 1 << 21, 1 << 21, 300_000
#: Distinct words that a task remembers for each language, and languages.
MEMO, LANGS = 150_000, 8

#: Lower-cases A-Z and makes all ends of pieces full stops.
FOLD = bytes(46 if c in b".,;:!?\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b"."
ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text and END where a piece ends, some at a time."""
    at = 0
    while at < len(text):
        to = len(text)
        if to - at > READ:
            ends = [x for x in (text.find(b" ", at + READ), text.find(b"\t", at + READ), text.find(b"\n", at + READ)) if x >= 0]
            to = min(ends, default=to)
        yield text[at:to].translate(FOLD).replace(END, b" . ").split()
        at = to


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], int]]:
    """Of (lang, text): (lang, words, n), n positions of one language and up to three that follow them."""
    held: dict[str, list[bytes]] = defaultdict(list)
    total = 0

    def cut(lang: str, to: int) -> Iterator[tuple[str, list[bytes], int]]:
        stream, at = held[lang], 0
        while len(stream) - at >= to:
            yield lang, stream[at : at + SHARD + 3], min(SHARD, len(stream) - at)
            at += SHARD
        held[lang] = stream[at:]

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang = lang.as_py()
            stream = held[lang]
            for some in words(text.as_buffer().to_pybytes()):
                stream += some
                total += len(some)
                if len(stream) >= SHARD + 3:
                    total -= len(stream)
                    yield from cut(lang, SHARD + 3)
                    stream = held[lang]
                    total += len(stream)
            stream.append(END)
            total += 1
            if total > HELD:  # many languages: the longest stream goes
                lang = max(held, key=lambda x: len(held[x]))
                total -= len(held[lang])
                yield from cut(lang, 1)
                del held[lang]
    for lang in list(held):
        yield from cut(lang, 1)


class Bits:
    """Which hashes may be frequent."""

    def __init__(self, bits: np.ndarray, log: int):
        self.bits, self.shift = bits, np.uint64(64 - log)
        self.down, self.plain = 64 - log, bits.tobytes()

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def has_one(self, h: int) -> int:
        at = h >> self.down
        return self.plain[at >> 3] >> (at & 7) & 1


def bit_table(keys: DataFrame) -> Bits:
    """Of (h): at most MOST_BITS bits, put together in blocks of 2^16 by tasks."""
    most = MOST_BITS.bit_length() - 1
    log = min(most, max(16, (keys.count() * BITS).bit_length()))
    at = keys.select(F.shiftrightunsigned("h", 64 - log).alias("at"))
    at = at.select(F.shiftright("at", 16).alias("block"), F.col("at").bitwiseAND(65535).cast("int").alias("bit")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bits in batch.column(1):
                row = np.zeros(65536, np.uint8)
                row[bits.values.to_numpy()] = 1
                out.append(np.packbits(row, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["block", "bits"])

    table_ = np.zeros(1 << (log - 3), np.uint8)
    for block, bits in at.groupBy("block").agg(F.collect_list("bit").alias("bits")).mapInArrow(run, "block long, bits binary").collect():
        table_[block << 13 : (block + 1) << 13] = np.frombuffer(bits, np.uint8)
    return Bits(table_, log)


class Codes(dict):
    """Words by number, in order of appearance; 0 is all that can't be frequent. hashes has their hashes."""

    def __init__(self, lang: str, bits: Bits):
        super().__init__()
        self.seed, self.has = xxhash.xxh3_64_intdigest(lang), bits.has_one
        self.hashes, self.n = np.zeros(1024, np.uint64), 1
        self[END] = 0

    def __missing__(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w, self.seed) | 1
        if not self.has(h):
            self[w] = 0
            return 0
        if self.n == len(self.hashes):
            self.hashes = np.concatenate((self.hashes, np.zeros(self.n, np.uint64)))
        self.hashes[self.n] = h
        self[w] = code = self.n
        self.n += 1
        return code


class Hashes:
    """Hashes of the words, pairs and triples of a shard; 0 where they can't be frequent."""

    def __init__(self, tables: list):
        self.tables, self.codes = tables, {}

    def words(self, lang: str, stream: list[bytes]) -> np.ndarray:
        codes = self.codes.get(lang)
        if codes is None or len(codes) > MEMO:
            if len(self.codes) >= LANGS:
                self.codes.clear()
            codes = self.codes[lang] = Codes(lang, self.tables[0].value)
        found = np.array(list(map(codes.__getitem__, stream)), np.int64)
        return codes.hashes[found]

    def of(self, lang: str, stream: list[bytes]) -> list[np.ndarray]:
        """Hashes of words, pairs, triples, as far as there are tables for what they consist of; each zero if any part is infrequent."""
        h = self.words(lang, stream)
        out = [h]
        for k in range(len(self.tables)):
            last = out[-1]
            if k:
                last[~self.tables[k].value.has(last)] = 0
            both = (last[:-1] != 0) & (last[1:] != 0)
            longer = last[:-1] * ONE + h[k + 1 :] * TWO
            longer ^= longer >> np.uint64(32)
            out.append(np.where(both, (longer * ONE) | np.uint64(1), np.uint64(0)))
        return out


def frequent(docs: DataFrame, tables: list, blocks: int, support: int) -> DataFrame:
    """(h): hashes of phrases one word longer than there are tables, that occur `support` times or share their bits
    with others. A block's hashes go as 32 bits each; more than `support` equal ones of a task aren't needed."""
    log = blocks.bit_length() - 1
    down, low = np.uint64(64 - log), np.uint64(32 - log)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = Hashes(tables), [], 0

        def send() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            h = h[np.arange(len(h)) - np.repeat(start, np.diff(np.r_[start, len(h)])) < support]
            block = (h >> down).astype(np.int64) if log else np.zeros(len(h), np.int64)
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            keys = (h >> low).astype("<u4")  # the bits below the block's
            parts = [keys[a:b].tobytes() for a, b in zip(first, [*first[1:], len(keys)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(parts, pa.binary())], names=["block", "keys"])

        for lang, stream, size in shards(batches):
            h = hashes.of(lang, stream)[-1][:size]
            held.append(h[h != 0])
            n += len(held[-1])
            if n >= GATHER:
                yield send()
                held, n = [], 0
        if n:
            yield send()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = None

        def found() -> pa.RecordBatch:
            keys, n = np.unique(np.frombuffer(b"".join(held), "<u4"), return_counts=True)
            h = keys[n >= support].astype(np.uint64) << low
            if log:
                h |= np.uint64(now) << down
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

        for batch in batches:
            for block, keys in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != now:
                    if held:
                        yield found()
                    held, now = [], block
                held.append(keys.as_buffer().to_pybytes())
        if held:
            yield found()

    dealt = docs.mapInArrow(trimmed(gather), "block long, keys binary").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(trimmed(count), "h long")


#: Positions as a list where there are at most SPARSE, else as the bits of a number.
Bitmap = list[int] | int


def popcount(bitmap: Bitmap) -> int:
    return bitmap.bit_count() if type(bitmap) is int else len(bitmap)


def positions_seen(bitmap: int, size: int) -> bytes:
    """A byte for each position, to look single ones up."""
    return np.unpackbits(np.frombuffer(bitmap.to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little").tobytes()


def bitmaps(codes: np.ndarray, at: np.ndarray, n: int) -> list[Bitmap]:
    """The bitmaps of n codes, of the ascending positions `at` that have them."""
    # numbers of 16 bits are sorted by their digits
    by = np.argsort(codes.astype(np.uint16) if n <= 1 << 16 else codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=n)).tolist()
    at = at[by]
    listed, out, start = at.tolist(), [], 0
    for end in ends:
        if end - start <= SPARSE:
            out.append(listed[start:end])
        else:
            row = np.zeros(listed[end - 1] + 1, np.uint8)
            row[at[start:end]] = 1
            out.append(int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little"))
        start = end
    return out


def both(ends: int, word: Bitmap, seen: Callable[[], bytes]) -> Bitmap:
    """Bits and a word's bitmap; seen() spreads the bits out, for words of few positions."""
    if type(word) is int:
        met = ends & word
        if met.bit_count() > SPARSE:
            return met
        out = []
        while met:
            out.append((met & -met).bit_length() - 1)
            met &= met - 1
        return out
    at = seen()
    return [p for p in word if at[p]]


def mine(stream: list[bytes], size: int, pairs: np.ndarray, triples: np.ndarray, counts: dict[bytes, int]) -> None:
    """Adds to counts the popcounts of phrases of two to four words that begin at the first `size` positions. pairs and
    triples tell where those begin that may be frequent.

    A bitmap of many bits is shifted and ANDed with the bitmap of each word that may follow. One of few positions is
    shifted and ANDed with all words at once, by looking at the word after each."""
    codes: dict[bytes, int] = {}
    used = np.zeros(len(stream) + 1, bool)
    used[: len(pairs)] |= pairs
    used[1 : len(pairs) + 1] |= pairs
    at = np.flatnonzero(used)
    code = np.zeros(len(stream), np.int64)
    code[at] = [codes.setdefault(stream[i], len(codes)) for i in at.tolist()]
    names, n, wide = list(codes), len(codes), len(stream) + 1
    bitmap = bitmaps(code[at], at, n)
    begins = at[at < size]
    begin = bitmaps(code[begins], begins, n)
    next_word = code.tolist()[1:]
    # may the word at a place go on as the second, and as the third or fourth of a phrase?
    get = counts.get
    second, onward = pairs.tobytes() + b"\0\0", b"\0" + triples.tobytes() + b"\0\0"
    # what follows the frequent beginnings, for those of many bits
    after, then = defaultdict(list), defaultdict(list)
    xy = code[:-1] * n + code[1:]
    pair, times = np.unique(xy[pairs], return_counts=True)
    for w in pair.tolist():
        if type(begin[w // n]) is int:
            after[w // n].append(w % n)
    often = triples & np.isin(xy[: len(triples)], pair[times > SPARSE])
    for w, z in {*zip(xy[: len(triples)][often].tolist(), code[2:][often].tolist(), strict=True)}:
        then[w].append(z)

    def extend(phrase: bytes, last: int, ends: Bitmap, flags: bytes, more: list[int], left: int) -> None:
        if type(ends) is list:
            if len(ends) == 1:  # one occurrence goes on as far as it may
                p = ends[0]
                while left and flags[p]:
                    phrase += b" " + names[next_word[p]]
                    counts[phrase] = get(phrase, 0) + 1
                    p, left, flags = p + 1, left - 1, onward
                return
            found: dict[int, Bitmap] = {}
            for p in ends:
                if flags[p]:
                    w = next_word[p]
                    if w in found:
                        found[w].append(p + 1)
                    else:
                        found[w] = [p + 1]
        else:
            spread: list[bytes] = []
            ends <<= 1

            def seen() -> bytes:
                if not spread:
                    spread.append(positions_seen(ends, wide))
                return spread[0]

            found = {w: got for w in more if (got := both(ends, bitmap[w], seen))}
        for w, got in found.items():
            longer = phrase + b" " + names[w]
            few = type(got) is list
            counts[longer] = get(longer, 0) + (len(got) if few else got.bit_count())
            if left > 1 and (not few or len(got) > 1 or onward[got[0]]):
                extend(longer, w, got, onward, then.get(last * n + w, ()), left - 1)

    for x, m in enumerate(begin):
        if m:
            extend(names[x], x, m, second, after.get(x, ()), 3)


def word_counts(docs: DataFrame, support: int) -> DataFrame:
    """(lang, phrase, n) of words that occur `support` times; phrase null: all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def send() -> pa.RecordBatch:
            rows = [(lang, w.decode(), n) for lang, c in held.items() for w, n in c.items() if w != END]
            rows += [(lang, None, sum(c.values()) - c[END]) for lang, c in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "phrase", "n"])

        for lang, stream, size in shards(batches):
            held[lang].update(stream[:size])
            if sum(map(len, held.values())) > COUNTERS:
                yield send()
        if held:
            yield send()

    counts = docs.mapInArrow(trimmed(run), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("phrase").isNull() | (F.col("n") >= support))


def phrase_counts(docs: DataFrame, tables: list, support: int) -> DataFrame:
    """(lang, phrase, n) of phrases of two to four words that occur `support` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = Hashes(tables), defaultdict(dict)

        def send() -> pa.RecordBatch:
            rows = [(lang, p.decode(), n) for lang, c in held.items() for p, n in c.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "phrase", "n"])

        for lang, stream, size in shards(batches):
            if len(stream) < 3:
                stream = stream + [END] * 2
            h = hashes.of(lang, stream)
            mine(stream, size, h[1] != 0, h[2] != 0, held[lang])
            if sum(map(len, held.values())) > COUNTERS:
                yield send()
        if any(held.values()):
            yield send()

    counts = docs.mapInArrow(trimmed(run), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= support)


def joined(words_: Column, first: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice(words_, first, size), " ")


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, subsumed: int = SUBSUMED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first `top` phrases of each language."""
    with scratch() as keep:
        read = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        singles = materialize(word_counts(read, support), "words")
        sc = docs.sparkSession.sparkContext
        totals = singles.filter("phrase is null").select("lang", F.col("n").alias("total"))
        size = totals.agg(F.sum("total")).first()[0] or 0
        blocks = 1 << min(31, (size // IN_BLOCK).bit_length())
        tables = [sc.broadcast(bit_table(hashed_words(singles.filter("phrase is not null"))))]
        for _ in range(2):
            keys = materialize(frequent(read, tables, blocks, support), "frequent")
            tables.append(sc.broadcast(bit_table(keys)))
        phrases = materialize(phrase_counts(read, tables, support), "phrases")
        out = materialize(scored(singles.filter("phrase is not null"), phrases, totals, subsumed, top), "collocations")
        keep(out)
        return out


def hashed_words(singles: DataFrame) -> DataFrame:
    """(h) of (lang, phrase) of single words, as the tasks hash them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [xxhash.xxh3_64_intdigest(w, xxhash.xxh3_64_intdigest(lang)) | 1 for lang, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64))], names=["h"])

    return singles.select("lang", "phrase").mapInArrow(run, "h long")


def scored(singles: DataFrame, phrases: DataFrame, totals: DataFrame, subsumed: int, top: int) -> DataFrame:
    """Candidates with their lowest-scoring cut, without those that a longer one subsumes, ranked in each language."""
    known = singles.unionByName(phrases)
    cand = phrases.withColumn("w", F.split("phrase", " "))
    size = F.size("w")
    longer = cand.filter(size > 2)
    parts = longer.select("lang", "n", F.explode(F.array(joined(F.col("w"), 1, size - 1), joined(F.col("w"), 2, size - 1))).alias("phrase"))
    above = parts.groupBy("lang", "phrase").agg(F.max("n").alias("above"))
    left = cand.join(above, ["lang", "phrase"], "left").filter(F.col("above").isNull() | (F.col("above") * 100 < F.col("n") * subsumed))
    cuts = left.select("lang", "phrase", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.col("w"), F.lit(1), F.col("k")).alias("first"), joined(F.col("w"), F.col("k") + 1, size - F.col("k")).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    # occurrences times two million may pass 64 bits
    cuts = cuts.withColumn("score", F.expr("cast((cast(2000000 as decimal(8,0)) * cast(a as decimal(20,0))) div cast(l + r as decimal(20,0)) as long)"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM w, unnest(range(1, len(ws) + 1)) AS u(i), unnest([1, 2, 3, 4]) AS v(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 30),
above AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(f) AS top FROM c, unnest([2, 3]) AS v(m), unnest([1, 2, 3]) AS u(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN above USING (lang, phrase) WHERE top IS NULL OR 100 * top < 80 * f),
cuts AS (SELECT lang, phrase, f AS a, x, array_to_string(ws[1:x], ' ') AS one, array_to_string(ws[x + 1:k], ' ') AS two FROM kept, unnest([1, 2, 3]) AS u(x) WHERE x < k),
scores AS (SELECT cuts.lang, cuts.phrase, a, x, l.f AS l, r.f AS r, (2000000 * a::HUGEINT) // (l.f + r.f) AS score FROM cuts JOIN g AS l ON l.lang = cuts.lang AND l.phrase = one JOIN g AS r ON r.lang = cuts.lang AND r.phrase = two),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, x) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
