"""Compression of a table of texts. One Arrow stage a call; texts that repeat are the cache's business."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import diff, phrases, rewriting, segments

REMOVALS = "array<struct<phrase:string,replacement:string,original:string>>"


MULTI = f"struct<result:string,passes:int,changed:boolean,tier0_result:string,removals:{REMOVALS},final_tokens:int>"


def per_text(make: Callable, kind: str):
    """An Arrow-batched UDF of a function of one text."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([make(t) for t in texts], index=texts.index, dtype=object)

    @F.pandas_udf(kind)
    def rows(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([make(t) for t in texts], index=texts.index)

    return rows if kind.startswith("struct") else run


def compress(text: Column, level: float = 3, excluded: frozenset[str] = frozenset(), hedging: bool = True) -> Column:
    kind = f"struct<result:string,removals:{REMOVALS},changed:boolean,original_length:int,compressed_length:int>"

    def one(t: str | None) -> dict:
        out = rewriting.compress(t, level, excluded, hedging)
        return out | {"removals": [{"phrase": p, "replacement": r, "original": o} for p, r, o in out["removals"]]}

    return per_text(one, kind)(text)


def removals(text: Column, level: float = 3, excluded: frozenset[str] = frozenset(), hedging: bool = True) -> Column:
    """The removals of compress(), without the rest of its work."""

    def one(t: str | None) -> list[dict]:
        return [{"phrase": p, "replacement": r, "original": o} for p, r, o in rewriting.removed(t, level, excluded, hedging)]

    return per_text(one, REMOVALS)(text)


def multi_pass(text: Column, preset: str = "balanced", excluded: frozenset[str] = frozenset()) -> Column:
    def one(t: str | None) -> dict:
        out = rewriting.multi_pass(t, preset, excluded)
        return out | {"removals": [{"phrase": p, "replacement": r, "original": o} for p, r, o in out["removals"]]}

    return per_text(one, MULTI)(text)


def parse_segments(text: Column) -> Column:
    kind = "array<struct<type:string,content:string,start:int,end:int,protected:boolean>>"
    return per_text(lambda t: [vars(s) for s in segments.parse_segments(t or "")], kind)(text)


def claimed(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, type, start, end) of the protected segments, as an interval join: candidates are rows, and level by level
    those stay that meet none of the ranges taken by then, which the nearest ones to both sides tell in a sweep."""
    every = per_text(lambda t: [dict(zip(("level", "type", "start", "end"), c, strict=True)) for c in segments.candidates(t or "")], "array<struct<level:int,type:string,start:int,end:int>>")
    rows = docs.select(key, F.explode(every(F.col(text))).alias("c")).select(key, "c.*").withColumn("taken", F.col("level") == 0)
    w = Window.partitionBy(key).orderBy("start", "end")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    for level in range(1, segments.LEVELS):
        left, right = F.max(F.when(F.col("taken"), F.col("end"))).over(before), F.min(F.when(F.col("taken"), F.col("start"))).over(after)
        rows = rows.withColumns({"_left": left, "_right": right})
        free = (F.coalesce("_left", "start") <= F.col("start")) & (F.coalesce("_right", "end") >= F.col("end"))
        rows = rows.withColumn("taken", F.col("taken") | ((F.col("level") == level) & free)).drop("_left", "_right")
    return rows.filter("taken").select(key, "type", "start", "end")


def word_diff(old: Column, new: Column) -> Column:
    """array<struct<op, value>>: equal, delete and insert runs of words and blanks; both texts can be put together again."""

    @F.pandas_udf("array<struct<op:string,value:string>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"op": op, "value": v} for op, v in diff.word_diff(x, y)] for x, y in zip(a, b, strict=True)], index=a.index, dtype=object)

    return run(old, new)


class Recent(dict):
    """What was made of texts seen lately, as long as they and the results have few characters together."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, text: str):
        got = self.make(text)
        self.held += 2 * len(text)
        if self.held > self.most:
            self.clear()
            self.held = 2 * len(text)
        self[text] = got
        return got


#: Characters that a task keeps of texts it has compressed, and their results.
KEPT = 8_000_000


def multi_pass_once(text: Column, preset: str, excluded: frozenset[str] = frozenset()) -> Column:
    """multi_pass(), nothing for null. A task compresses a text that it meets again only once, however often that is,
    so texts that very many rows have need neither a shuffle nor a task of their own."""

    def one(t: str) -> dict:
        out = rewriting.multi_pass(t, preset, excluded)
        return out | {"removals": [{"phrase": p, "replacement": r, "original": o} for p, r, o in out["removals"]]}

    @F.pandas_udf(MULTI)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        recent = Recent(one, KEPT)
        empty = dict.fromkeys(("result", "passes", "changed", "tier0_result", "removals", "final_tokens"))
        for texts in batches:
            yield pd.DataFrame([empty if t is None else recent[t] for t in texts], index=texts.index, columns=list(empty), dtype=object)

    return run(text)


#: What the pipeline knows of a text: its tokens, and of one that was due what multi_pass() makes of it, and its tokens.
COUNTED = f"struct<result:string,passes:int,changed:boolean,removals:{REMOVALS},before:long,after:long>"
REMOVAL = pa.struct([(x, pa.string()) for x in ("phrase", "replacement", "original")])
COUNTED_ARROW = pa.struct([("result", pa.string()), ("passes", pa.int32()), ("changed", pa.bool_()), ("removals", pa.list_(REMOVAL)), ("before", pa.int64()), ("after", pa.int64())])
ASCII_SPACE = " \t\n\r\f\v"


def counted(text: str | None, preset: str, excluded: frozenset[str], least: int) -> tuple:
    """The fields of COUNTED. Tokens are those of columns.heuristic_tokens(), counted beside the passes: that takes a
    fraction of what Catalyst's functions of arrays take for them."""
    before = rewriting.ascii_tokens(text)
    if text is None or before < least or not text.strip(ASCII_SPACE):
        return None, None, None, None, before, None
    m = rewriting.multi_pass(text, preset, excluded, None if rewriting.UNICODE_SPACE.search(text) else before)
    after = rewriting.ascii_tokens(m["result"]) if rewriting.UNICODE_SPACE.search(m["result"]) else m["final_tokens"]
    return m["result"], m["passes"], m["changed"], [{"phrase": p, "replacement": r, "original": o} for p, r, o in m["removals"]], before, after


def counted_once(text: Column, preset: str, excluded: frozenset[str], least: int) -> Column:
    """counted() of each row; like multi_pass_once(), a task compresses a text that it meets again only once."""

    @F.arrow_udf(COUNTED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        recent = Recent(lambda t: counted(t, preset, excluded, least), KEPT)
        empty = counted(None, preset, excluded, least)
        for texts in batches:
            columns = zip(*[empty if t is None else recent[t] for t in texts.to_pylist()], strict=True)
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COUNTED_ARROW, strict=True)], fields=list(COUNTED_ARROW)) if len(texts) else pa.array([], COUNTED_ARROW)

    return run(text)


def compress_pipeline(
    docs: DataFrame,
    key: str,
    preset: str = "balanced",
    *,
    text: str = "text",
    target: float = 0.5,
    least: int = 10,
    cloud_least: int = 200,
    cloud: bool = False,
    consent: bool = False,
    available: bool = True,
    excluded: frozenset[str] = frozenset(),
    keep_original: bool = False,
) -> DataFrame:
    """One row per text: result, tier, changed, tokens before and after, and whether the cloud pass is due, in one
    scan without a shuffle; with keep_original also original_text. Blank texts and those of under `least` tokens pass
    through."""
    secret = F.size(C.secrets(F.col(text))) > 0
    out = docs.select(key, F.col(text).alias("original_text"), secret.alias("secret"), counted_once(F.col(text), preset, excluded, least).alias("m"))
    out = out.select(key, "original_text", "secret", "m.*")
    out = out.withColumns({"original_tokens": F.col("before"), "compressed_tokens": F.coalesce("after", "before")})
    return out.select(
        key,
        *["original_text"] * keep_original,
        F.coalesce("result", "original_text").alias("result"),
        F.when(F.col("result").isNull(), "0").otherwise("multi-pass").alias("tier"),
        F.coalesce("changed", F.lit(False)).alias("changed"),
        F.coalesce("removals", F.array().cast(REMOVALS)).alias("removals"),
        "original_tokens",
        "compressed_tokens",
        F.coalesce("passes", F.lit(0)).alias("passes"),
        escalate(F.col("original_tokens"), F.col("compressed_tokens"), F.col("secret"), target=target, least=cloud_least, allowed=cloud and consent and available).alias("escalate"),
    )


def escalate(before: Column, after: Column, secret: Column, *, target: float = 0.5, least: int = 200, allowed: bool = True) -> Column:
    """Is a further pass by a remote model due? If the target was missed, the text is long enough and holds no
    secret, and the cloud is on, consented to and available. Never of a text without tokens."""
    return F.coalesce((F.try_divide(before - after, before) < target) & (before > least) & ~secret & F.lit(allowed), F.lit(False))


def dictionary(spark) -> DataFrame:
    rows = [(e.kind, e.seq, e.phrase, e.replacement, e.confidence, e.category) for entries in phrases.ENTRIES.values() for e in entries]
    return spark.createDataFrame(rows, "kind string, seq int, phrase string, replacement string, confidence double, category string")


class TextSegments:
    """Table function: the segments of a text as rows."""

    def eval(self, text: str):
        for s in segments.parse_segments(text or ""):
            yield s.type, s.content, s.start, s.end, s.protected


class TextSentences:
    """Table function: the sentences of a text as rows, with their density."""

    def eval(self, text: str):
        for i, s in enumerate(rewriting.split_sentences(text or "")):
            yield i, s, rewriting.density(rewriting.terms(s))


def register(spark) -> None:
    """SQL functions and table functions of the same names."""
    spark.udtf.register("text_segments", F.udtf(TextSegments, returnType="type string, content string, start_at int, end_at int, protected boolean"))
    spark.udtf.register("text_sentences", F.udtf(TextSentences, returnType="i int, sentence string, density double"))
    spark.udf.register("count_tokens", per_text(rewriting.count_tokens, "long"))
    spark.udf.register("compress_text", per_text(lambda t: rewriting.compress(t)["result"], "string"))
    spark.udf.register("minify_text", per_text(lambda t: None if t is None else rewriting.minify(t), "string"))


def map_remote(docs: DataFrame, key: str, call: Callable[[str], str], text: str = "text") -> DataFrame:
    """A remote rewriter as a stage: call is pluggable, errors become their message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for t in b["text"]:
                try:
                    got.append((call(t), None))
                except Exception as e:  # noqa: BLE001  the connector's error is a value here
                    got.append((None, str(e)))
            yield pd.DataFrame({key: b[key], "output": [x for x, _ in got], "error": [x for _, x in got]})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).alias("text")).mapInPandas(run, f"`{key}` {kind}, output string, error string")
