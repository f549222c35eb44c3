"""Connected components by alternating large-star and small-star rounds.

Every round is a few joins and grouped minima over the edges, cut off by a written table; no component then
meets in one task as a whole, and nothing but counts comes to the driver. A node with a thousandth of all edges
(there are at most 2000) meets its edges by broadcast, so none is bound to one task. The rounds number about the
logarithm of the longest path. Up to FEW edges, a number that is checked, one task joins them instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


FEW, HUB = 1_000_000, 1000


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over at most FEW edges; the smaller root stays the root."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    got = [(x, r) for x in list(root) if (r := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([r for _, r in got], pa.int64())], names=["id", "component"])


def stars(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """edges(u, v), each once, about `rows` of them. Large: each node ties its larger neighbours to the smallest one around it.
    Small: its smaller neighbours and itself."""
    if large:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
    hubs = F.broadcast(least.filter(F.col("n") * HUB >= rows).select("u", "m"))
    tied = sides.join(hubs, "u").unionByName(sides.join(hubs, "u", "left_anti").join(least.select("u", "m"), "u"))
    least = least.drop("n")
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").dropDuplicates(["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """(id, component): every node of an edge but the smallest of its component, with that smallest one."""
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").dropDuplicates(), "edges")
    rows = now.count()
    if rows <= few:
        return materialize(now.coalesce(1).mapInArrow(joined, "id long, component long"), "components")
    mark = None
    while True:
        after = materialize(stars(stars(now, True, rows), False, rows), "edges")
        seen = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if tuple(seen) == mark or not seen[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        mark, rows = tuple(seen), seen[0]
