"""Token counts by heap-and-linked-list byte-pair merging (operator 1).

The symbols of a text form a doubly linked list; a heap holds the adjacent pairs whose concatenation is a
piece, ordered by rank and then by position. Each pop merges a pair, so the count is the number of initial
symbols less the number of merges, and no identifier is ever made.

No piece of the vocabulary has a word's character followed by the blank marker, so no merge crosses such a
place: texts are cut there, and each distinct chunk is merged once per worker (a bounded memo). Should a
vocabulary have such a piece, whole texts are merged instead.

Defined results: null and empty texts have 0 bytes and 0 tokens; null ids stay; repeated rows give repeated
rows; an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import spread
from .common import Memo, slices, table

MARK = "▁"


class PieceCounter:
    """Counts the tokens of texts under a sentencepiece BPE model."""

    #: Chunks in the memo, and the longest chunk that is kept there.
    MEMO, LONGEST = 400_000, 64

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        if spec.model_type != 2 or not spec.byte_fallback or norm.precompiled_charsmap or spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback and the identity normalizer is needed")
        if norm.remove_extra_whitespaces or any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("models that squeeze blanks or have user-defined or unused pieces aren't supported")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        # a higher score is a lower rank; equal scores share a rank and go by position
        order = {x: i for i, x in enumerate(sorted({-p.score for p in proto.pieces if p.type == 1}))}
        self.rank = {p.piece: order[-p.score] for p in proto.pieces if p.type == 1}
        self.symbols = {p for p in self.rank if len(p) == 1}
        self.cut = not any(MARK in p.lstrip(MARK) for p in self.rank)
        self.chunks = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.memo = Memo(self.merged, self.MEMO, self.LONGEST)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "memo"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.memo = Memo(self.merged, self.MEMO, self.LONGEST)

    def merged(self, text: str) -> int:
        """A symbol is text[i:end[i]]; the next one starts at end[i], the one before at before[i]. A heap entry
        is one integer: rank, start, end of the pair."""
        rank, n = self.rank.get, len(text)
        bits = n.bit_length()
        low = (1 << bits) - 1
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r << bits | i) << bits | i + 2 for i in range(n - 1) if (r := rank(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        # an unknown character stands for its bytes
        odd = {} if self.symbols.issuperset(text) else {i: k - 1 for i, c in enumerate(text) if c not in self.symbols and (k := len(c.encode())) > 1}
        count = n + sum(odd.values())
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            pair = pop(heap)
            i, e = pair >> bits & low, pair & low
            m = end[i]
            if not 0 < m < e or end[m] != e:
                continue
            count -= 1
            if odd:
                count -= odd.pop(i, 0) + odd.pop(m, 0)
            end[i], end[m] = e, 0
            if e < n:
                before[e] = i
                if (r := rank(text[i : (f := end[e])])) is not None:
                    push(heap, (r << bits | i) << bits | f)
            h = before[i]
            if h >= 0 and (r := rank(text[h:e])) is not None:
                push(heap, (r << bits | h) << bits | e)
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = self.prefix + text.replace(" ", MARK)
        if not self.cut:
            return self.merged(text)
        memo = self.memo
        return sum([memo[chunk] * times for chunk, times in Counter(self.chunks.findall(text)).items()])


def count_tokens(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_tokens, over_limit (n_tokens > limit). The model is read on
    the driver and broadcast; its size is the vocabulary's, whatever the input's."""
    kind = docs.schema[id_col].dataType
    counter = docs.sparkSession.sparkContext.broadcast(PieceCounter(Path(model_path).read_bytes()))
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter.value.count
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            n = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=schema.names)

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(run, schema)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("piece_bpe_32k.model"))
