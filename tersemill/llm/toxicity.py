"""Toxicity by multiple-instance learning (operator 2).

A document is a bag of sentences. Each sentence has a logistic score over its distinct words and their first
letters; the document's score is their noisy-or, 1 - prod(1 - p). Only documents are labelled, so the weights are fitted to the noisy-or, and
the sentence scores that come of it locate the offending sentences.

The model is fitted on the driver in numpy, on at most TRAIN_DOCS labelled documents of each label with at most
TRAIN_CHARS characters, those with the smallest hashes of their ids (of texts that repeat an id, one), weighted
back to the labels' true shares. Longer documents are scored like all others, only not learned from.
It knows at most VOCAB words, whatever the input, and is broadcast. Labels, languages, sources and ids never
enter a score.

Defined results: a null or empty text scores as a bag without sentences, 0; labels other than 0 and 1 and
null labels are not learned from; of repeated labels of a document, any 1 makes it 1; without labels of both
kinds every score is 0; repeated rows give repeated rows, an empty table an empty one; other columns are
ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from math import exp, log1p
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import spread
from .common import Memo, slices, table, trimmed

TRAIN_DOCS, TRAIN_CHARS, VOCAB, LEAST_DF = 3000, 20_000, 60_000, 5
STEMS = (4, 5, 6)
THRESHOLD, OFFENDING = 0.3, 0.5

SENTENCE = re.compile(r"[^.!?\n]+")
TOKEN = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """A word and its beginnings, which are marked as such."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) >= n]]


def bags(text: str) -> list[set[str]]:
    return [words for s in SENTENCE.findall(text.lower()) if (words := set(TOKEN.findall(s)))]


class Bags(NamedTuple):
    """Sentences of all documents: entry i is word cols[i] of sentence rows[i], sentence j is of document owner[j]."""

    rows: np.ndarray
    cols: np.ndarray
    owner: np.ndarray
    words: int


class NoisyOr:
    """Sentence weights fitted to document labels."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.words = Memo(self.word, 50_000, 40)

    def __getstate__(self) -> tuple:
        return self.weights, self.bias

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def word(self, word: str) -> float:
        return sum([self.weights.get(f, 0.0) for f in features(word)])

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], importance: list[float], *, steps: int = 120, rate: float = 0.2, l1: float = 3e-4) -> NoisyOr:
        if not {0, 1} <= set(labels):
            return cls({}, float("-inf"))
        # words and features as numbers: a sentence has its words, and only a distinct word has its features
        words, names, of_word = {}, {}, []
        cols, lengths, owner, df = array("i"), array("i"), array("i"), Counter()
        for k, text in enumerate(texts):
            seen = set()
            for s in bags(text):
                for w in s:
                    at = words.setdefault(w, len(words))
                    if at == len(of_word):
                        of_word.append([names.setdefault(f, len(names)) for f in features(w)])
                    cols.append(at)
                    seen.add(at)
                lengths.append(len(s))
                owner.append(k)
            df.update({f for w in seen for f in of_word[w]})
        vocab = sorted(((f, df[i]) for f, i in names.items() if df[i] >= LEAST_DF), key=lambda x: (-x[1], x[0]))[:VOCAB]
        place = np.full(len(names), -1)
        place[[names[f] for f, _ in vocab]] = np.arange(len(vocab))
        word = np.repeat(np.arange(len(of_word)), [len(f) for f in of_word])
        feature = place[np.array([i for f in of_word for i in f], np.int64)]
        word, feature = word[feature >= 0], feature[feature >= 0]
        bag = Bags(np.repeat(np.arange(len(owner)), np.array(lengths, np.int64)), np.array(cols, np.int64), np.array(owner, np.int64), len(of_word))
        del words, names, of_word, df, cols, lengths, owner
        y = np.array(labels, float)
        share = np.array(importance, float)
        share /= share.sum()
        w, bias = np.zeros(len(vocab)), -np.log(max(2.0, len(bag.owner) / len(texts))) - 2
        # first the shrunken fit chooses the features, then those alone are fitted without it
        w, bias = cls.ascend(bag, word, feature, y, share, w, bias, steps, rate, l1)
        kept = np.flatnonzero(w)
        place = np.full(len(w), -1)
        place[kept] = np.arange(len(kept))
        held = place[feature] >= 0
        w[kept], bias = cls.ascend(bag, word[held], place[feature[held]], y, share, w[kept], bias, 2 * steps, rate, 0.0)
        return cls({f: float(x) for (f, _), x in zip(vocab, w) if abs(x) > 1e-6}, float(bias))

    @staticmethod
    def ascend(bag: Bags, word: np.ndarray, feature: np.ndarray, y: np.ndarray, share: np.ndarray, w: np.ndarray, bias: float, steps: int, rate: float, l1: float) -> tuple[np.ndarray, float]:
        """Adaptive steps up the likelihood, with the shrinkage to zero taken as a proximal step."""
        g2, b2 = np.full(len(w), 1e-8), 1e-8
        for _ in range(steps):
            z = bias + np.bincount(bag.rows, np.bincount(word, w[feature], bag.words)[bag.cols], len(bag.owner))
            p = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-12, 1 - 1e-9)
            doc = np.clip(-np.expm1(np.bincount(bag.owner, np.log1p(-p), len(y))), 1e-12, 1)
            step = p * (np.where(y == 1, (1 - doc) / doc, -1.0) * share)[bag.owner]
            g, gb = np.bincount(feature, np.bincount(bag.cols, step[bag.rows], bag.words)[word], len(w)), step.sum()
            g2, b2 = 0.95 * g2 + 0.05 * g * g, 0.95 * b2 + 0.05 * gb * gb
            each = rate / np.sqrt(g2)
            w = w + each * g
            w = np.sign(w) * np.maximum(np.abs(w) - each * l1, 0)
            bias += (0.2 if l1 else 1.0) * rate * gb / np.sqrt(b2)
            rate *= 1 - 4 / steps
        return w, float(bias)

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and its offending sentences as (start, end, score)."""
        none, found, known, bias = 0.0, [], self.words, self.bias
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        for m in SENTENCE.finditer(low):
            own = set(TOKEN.findall(m[0]))
            if not own:
                continue
            z = bias + sum([known[w] for w in own])
            p = 1 / (1 + exp(-z)) if z > -700 else 0.0
            none += log1p(-min(p, 1 - 1e-9))
            if p >= OFFENDING:
                found.append((m.start(), m.end(), p))
        return -float(np.expm1(none)) + 0.0, found


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> NoisyOr:
    """Learns from labelled rows that are not held out."""
    known = labels.filter(F.col(label_col).isin(0, 1) & ~F.coalesce(held_out(id_col), F.lit(True))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    # several rows of one label each: their counts are two numbers, their samples bounded
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCS) for y in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") <= TRAIN_CHARS).join(F.broadcast(sample), "id")
    # of rows that repeat an id one text, that with the least hash: no more rows come to the driver than the sample has
    rows = rows.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")).collect()
    rows = sorted((r["id"], r["text"], r["y"]) for r in rows)
    seen = Counter(y for _, _, y in rows)
    return NoisyOr.fit([t for _, t, _ in rows], [y for _, _, y in rows], [counts[y] / seen[y] for _, _, y in rows])


def score_toxicity(docs: DataFrame, model: NoisyOr, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id_col, held_out, score, predicted, offending (array of start, end, score in characters)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("offending", spans)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = held.value.score
        for batch in slices(batches):
            got = [score(t) for t in batch.column(2).to_pylist()]
            found = [[{"start": a, "end": b, "score": p} for a, b, p in f] for _, f in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s for s, _ in got], pa.float64()), pa.array([int(s >= threshold) for s, _ in got], pa.int32()), pa.array(found, kind)], names=schema.names)

    rows = docs.select(F.col(id_col), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(trimmed(run), schema)


def without_toxic(docs: DataFrame, model: NoisyOr, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns; nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = held.value.score
        for batch in slices(batches):
            yield batch.filter(pa.array([score(t or "")[0] < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs, fit_toxicity(docs, labels))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
