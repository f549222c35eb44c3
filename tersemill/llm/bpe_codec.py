"""BPE encoding and decoding by a tokenization automaton (operator 8).

The merges are compiled into a deterministic automaton over tokens, once, on the driver. It starts with all
arcs: each token leads to a state of its own from every state. Each merge (u, v) -> w, in order of rank, adds a
gadget: where u then v could be read the arc of v is taken away, as an arc of w leads there now; this holds for
u and for all that end with u by later merges, and for v and all that begin with v by later merges. The
sequences of tokens that the finished automaton reads are those that merging makes, one for each word.

The finished table has, for each state, the stretches of tokens whose arcs are gone (tokens are numbered so
that a gadget takes one stretch from one stretch of states). A second table, of symbols, tells which tokens
end where. A word is read symbol by symbol: among the tokens that end there, the one with an arc from the state
in which it begins is the only one, and names the state. Nothing is read twice, and no transition is decided
but by the tables. Decoding emits the labels of the arcs.

Defined results: null and empty texts have no tokens and decode to the empty text; repeated rows give
repeated rows, an empty table an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import spread
from .common import Memo, slices, table, trimmed

def byte_letters() -> list[str]:
    """The letter of each byte: itself where it prints, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in plain else chr(free))
        free += b not in plain
    return out


class Tree(NamedTuple):
    """Tokens numbered so that a token comes after its children, which come in order of their ranks: those of a
    rank or more, with all below them and with the token itself, are one stretch."""

    place: np.ndarray
    #: of each token the ranks of its children, ascending, and where the stretch from each child on begins
    ranks: list[list[int]]
    begins: list[list[int]]

    @classmethod
    def of(cls, parent: dict[int, int], rank: dict[int, int], size: int) -> Tree:
        """parent: by token, the part that it has in the tree's direction; rank: that of its merge."""
        children: list[list[int]] = [[] for _ in range(size)]
        for t in sorted(parent, key=rank.__getitem__):
            children[parent[t]].append(t)
        place, begins = np.zeros(size, np.int64), [[] for _ in range(size)]
        n = 0
        for root in range(size):
            if root in parent:
                continue
            stack = [(root, 0)]
            while stack:
                t, k = stack.pop()
                if k < len(children[t]):
                    begins[t].append(n)
                    stack += [(t, k + 1), (children[t][k], 0)]
                else:
                    place[t] = n
                    n += 1
        return cls(place, [[rank[c] for c in x] for x in children], begins)

    def stretch(self, token: int, rank: int) -> tuple[int, int]:
        """The token, and all that it became a part of by merges of this rank or later."""
        k = bisect_left(self.ranks[token], rank)
        return (self.begins[token][k] if k < len(self.begins[token]) else int(self.place[token])), int(self.place[token]) + 1


class TokenAutomaton:
    """The automaton of a merge list: states and arcs' labels are token ids; one more state is the start."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.suffix, self.size = suffix, max(vocab.values(), default=-1) + 1
        self.label = {i: t for t, i in vocab.items()}
        left, right, rank = {}, {}, {}
        for r, (a, b) in enumerate(merges):
            w = vocab[a[: len(a) - len(suffix)] + b if suffix and a.endswith(suffix) else a + b]
            if w in rank:
                raise ValueError("a token that two merges make isn't supported")
            left[w], right[w], rank[w] = vocab[a], vocab[b], r
        self.gadgets(left, right, rank)
        self.reader(vocab, rank)

    def gadgets(self, left: dict[int, int], right: dict[int, int], rank: dict[int, int]) -> None:
        """At first every state has an arc of every token. The gadget of a merge (u, v) takes the arcs of v, and of
        the tokens that begin with it by later merges, from u and from the states of the tokens that end with it by
        later merges. In the two numberings below both are stretches: a gadget takes one rectangle."""
        states, arcs = Tree.of(right, rank, self.size), Tree.of(left, rank, self.size)
        # of a token with itself the leftmost pair is joined: a token that this very merge made keeps its arcs, but has none before it
        boxes = np.array([(*states.stretch(left[w], r + 1), *arcs.stretch(right[w], r)) for w, r in rank.items()], np.int64).reshape(-1, 4)
        wide = boxes[:, 1] - boxes[:, 0]
        state = np.repeat(boxes[:, 0] - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())
        start, end = np.repeat(boxes[:, 2], wide), np.repeat(boxes[:, 3], wide)
        order = np.lexsort((start, state))
        state, start, end = state[order], start[order], end[order]
        # stretches of one state that touch become one
        reach = np.maximum.accumulate(state * (self.size + 1) + end)
        new = np.concatenate([[True], state[1:] * (self.size + 1) + start[1:] > reach[:-1]]) if len(state) else np.empty(0, bool)
        first = np.flatnonzero(new)
        state, start, end = state[first], start[first], reach[np.append(first[1:], len(reach))[: len(first)] - 1] - state[first] * (self.size + 1)
        # of each state, where its taken stretches begin and end, in turn
        self.cuts = array("i", np.stack([start, end], 1).astype(np.int32).tobytes())
        bounds = np.concatenate([[0], np.cumsum(np.bincount(state, minlength=self.size)) * 2])
        self.low = array("i", np.append(bounds[states.place], 0).astype(np.int32).tobytes())
        self.high = array("i", np.append(bounds[states.place + 1], 0).astype(np.int32).tobytes())
        self.place = array("i", arcs.place.astype(np.int32).tobytes())

    def arc(self, state: int, token: int) -> bool:
        """Does an arc of the token leave the state? Within a taken stretch an odd number of cuts lies before it."""
        low = self.low[state]
        return not (bisect_right(self.cuts, self.place[token], low, self.high[state]) - low) & 1

    def reader(self, vocab: dict[str, int], rank: dict[int, int]) -> None:
        """What reads symbols: a state for each beginning of a token, a table of (state, symbol) -> state, for each
        state the token that it is, the state of its longest proper ending, and that of its longest ending that is a token."""
        known = {i: [*t[: -len(self.suffix) - 1], t[-len(self.suffix) - 1 :]] if self.suffix and t.endswith(self.suffix) and t != self.suffix else [*t] for t, i in vocab.items()}
        single = {s[0] for i, s in known.items() if len(s) == 1}
        self.symbols = {s: k for k, s in enumerate(sorted(single))}
        self.width = len(self.symbols)
        self.move: dict[int, int] = {}
        self.token, self.fail, self.next, self.length = array("i", [-1]), array("i", [0]), array("i", [0]), array("i", bytes(4 * self.size))
        depth: list[list[tuple[int, int, int]]] = []
        for t, s in known.items():
            if (len(s) > 1 and t not in rank) or not single.issuperset(s):
                continue  # a token that no merge makes is never read
            node = 0
            for d, x in enumerate(s):
                key = node * self.width + self.symbols[x]
                if key not in self.move:
                    if d == len(depth):
                        depth.append([])
                    self.move[key] = len(self.token)
                    depth[d].append((node, self.symbols[x], len(self.token)))
                    for a, v in ((self.token, -1), (self.fail, 0), (self.next, 0)):
                        a.append(v)
                node = self.move[key]
            self.token[node], self.length[t] = t, len(s)
        for level in depth:
            for above, x, node in level:
                if above:
                    self.fail[node] = self.step(self.fail[above], x)
                self.next[node] = self.fail[node] if self.token[self.fail[node]] >= 0 else self.next[self.fail[node]]

    def step(self, node: int, symbol: int) -> int:
        while (to := self.move.get(node * self.width + symbol)) is None:
            if not node:
                return 0
            node = self.fail[node]
        return to

    def encode(self, word: str) -> list[int]:
        """The tokens of a pre-split word. After each symbol the automaton is in one state, as every beginning of a
        word has one reading: that whose last token ends there and has an arc from the state before it."""
        n, symbols = len(word), self.symbols
        try:
            read = [symbols[c] for c in word[:-1]] + [symbols[word[-1] + self.suffix]] if n else []
        except KeyError:
            raise ValueError("the vocabulary lacks a base symbol") from None
        move, width, token, fail, after, length, cuts, place, low, high = self.move, self.width, self.token, self.fail, self.next, self.length, self.cuts, self.place, self.low, self.high
        states = [self.size]
        node = 0
        for k, x in enumerate(read, 1):
            while (to := move.get(node * width + x)) is None:
                node = fail[node]
            at = node = to
            if token[at] < 0:
                at = after[at]
            while True:
                t = token[at]
                from_ = states[k - length[t]]
                a = low[from_]
                if not (bisect_right(cuts, place[t], a, high[from_]) - a) & 1:
                    break
                at = after[at]
            states.append(t)
        out = []
        while n:
            out.append(states[n])
            n -= length[states[n]]
        return out[::-1]


#: Characters that the two engines of patterns take differently.
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")


class BpeCodec:
    """Texts to ids and back, as the tokenizers library does with such a file (no truncation, no padding, nothing added)."""

    MEMO, LONGEST = 100_000, 48

    def __init__(self, text: str):
        d = json.loads(text)
        model, norm, pre = d["model"], d["normalizer"], d["pre_tokenizer"]
        if [x["type"] for x in norm["normalizers"]] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in pre["pretokenizers"]] != ["Split", "ByteLevel"] or d["decoder"] or d["post_processor"] or model["continuing_subword_prefix"]:
            raise ValueError("this form of tokenizer file isn't supported")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = TokenAutomaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {x["content"]: x["id"] for x in d["added_tokens"]}
        self.label = self.automaton.label | {i: t for t, i in self.special.items()}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.squeeze, self.blank = norm["normalizers"][1]["pattern"]["Regex"], norm["normalizers"][1]["content"]
        self.pattern = pre["pretokenizers"][0]["pattern"]["Regex"]
        self.ready()

    def ready(self) -> None:
        self.words = regex.compile(self.pattern)
        self.spaces = regex.compile(self.squeeze)
        # white space that no word takes needn't be squeezed; plain texts are read by the faster engine
        blanks = [chr(i) for i in range(0x3001) if self.spaces.fullmatch(chr(i))]
        self.squeezes = any(self.words.search(c) for c in blanks)
        self.plain = re.compile(self.pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9"))
        self.letters = byte_letters()
        self.memo = Memo(self.word, self.MEMO, self.LONGEST)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "spaces", "squeezes", "plain", "letters", "memo")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.ready()

    def word(self, word: str) -> tuple[bytes, str]:
        # letters of ASCII stand for themselves, and a pre-split word has no blanks
        ids = self.automaton.encode(word if word.isalpha() and word.isascii() else "".join([self.letters[b] for b in word.encode()]))
        return struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)

    def lower(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.squeezes:
            text = self.spaces.sub(self.blank, text)
        # letter by letter: a capital sigma doesn't depend on its place
        return text.replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        """The words of a text between special tokens."""
        low = self.lower(text)
        return (self.plain if low.isascii() and not CONTROL.search(low) else self.words).findall(low)

    def pieces(self, text: str) -> list[tuple[bytes, str]]:
        memo = self.memo
        if not self.cuts or not self.cuts.search(text):
            return [memo[w] for w in self.split(text)]
        out = []
        for part in self.cuts.split(text):
            if part in self.special:
                out.append((struct.pack("<I", self.special[part]), part))
            else:
                out += [memo[w] for w in self.split(part)]
        return out

    def packed(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian 32-bit integers, and their decoded text."""
        got = self.pieces(text)
        return b"".join([a for a, _ in got]), " ".join([b for _, b in got])

    def encode(self, text: str) -> list[int]:
        ids = self.packed(text)[0]
        return list(struct.unpack(f"<{len(ids) // 4}I", ids))

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.label[i] for i in ids])


def bpe_codec(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, ids_sha256, decoded_sha256, and with full the ids
    (array<int>) and the decoded text. The automaton is compiled on the driver and broadcast; its size is the
    vocabulary's."""
    codec = docs.sparkSession.sparkContext.broadcast(BpeCodec(Path(tokenizer_path).read_text(encoding="utf-8")))
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if full:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = codec.value.packed
        for batch in slices(batches):
            rows = [packed(t) for t in batch.column(1).to_pylist()]
            cols = [batch.column(0), pa.array([len(a) // 4 for a, _ in rows], pa.int64()), pa.array([hashlib.sha256(a).hexdigest() for a, _ in rows], pa.string()), pa.array([hashlib.sha256(b.encode()).hexdigest() for _, b in rows], pa.string())]
            if full:
                cols += [pa.array([struct.unpack(f"<{len(a) // 4}I", a) for a, _ in rows], pa.list_(pa.int32())), pa.array([b for _, b in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(trimmed(run), schema)


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_codec(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"))
