"""Embedding near-duplicates by randomised-rotation binary codes (operator 10).

A vector is scaled to length one, turned by a random rotation and coded as the signs of its coordinates, with
one stored factor: the inner product f of the code (scaled to length one) and the vector. For another vector q,
turned alike, <code, q> / f is an unbiased estimate of their inner product, and its error exceeds
eps * sqrt((1 - f^2) / (f^2 (dim - 1))) with a chance that falls as exp(-eps^2) does. A pair whose estimate
plus that bound is under the threshold, from either side, is dropped; the others are computed again exactly,
in double precision, from the vectors.

Near copies are represented by a leader. Vectors within half the threshold's angle of one vector all link with
each other, so such a cluster needs no pairs inside; between two clusters the angle of the leaders and the
clusters' radii tell whether all members link or none do, and only where they leave it open are the members'
own angles computed. So links are counted exactly, and the pairs handled don't grow with the square of a group.

Which pairs are estimated at all: other random rotations give each vector a bucket in each of several tables
(the signs of some coordinates); clusters of one label with members in one bucket are. The number of signs
follows the number of clusters of the largest label, and the number of tables follows from it, so that a pair
right at the threshold is missed with a chance of MISS at most. Equal vectors are one from the start. A bucket
of more than BLOCK entries is dealt out as pairs of blocks, all of them; there is no cap.

Defined results: vectors that are null, empty or zero or have null or non-finite components, and rows with a null
label, link with nothing and are their own component; vectors of different lengths don't link; ids are taken
as keys; an empty table gives an empty one; other columns are ignored. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos, ceil, cos, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hinted, materialize, scratch, table, trimmed
from .components import components
from .shingles import scatter

THRESHOLD, MISS, EPS = 0.93, 0.002, 3.5
BLOCK, HOT = 2048, 100_000
#: Tables in which leaders are looked for, rounds of it, entries of a bucket with one leader, and room for rounding.
STAR, ROUNDS, PART, SAFE = 8, 2, 50_000, 1e-7
SEED = 20240511


def rotation(dim: int, number: int) -> np.ndarray:
    """The number-th random rotation; 0 is the codes', the others are the tables'."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def tables_for(rows: int, threshold: float) -> tuple[int, int]:
    """Signs a bucket, and tables, for a label of so many rows."""
    agree = 1 - acos(threshold) / pi
    bits = max(3, min(32, ceil(log2(max(1, rows) / 128))))
    return bits, ceil(log(MISS) / log(1 - agree**bits))


def units(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rank(ids: np.ndarray) -> np.ndarray:
    """A fixed random order of ids."""
    return scatter(ids.view(np.uint64) + np.uint64(SEED))


CODE = "label long, place long, id long, r double, f double, scale double, q binary"


def code(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """vectors(label, leader, r, of_leader, embedding) -> entries for each table: (label, place, id, r, f, scale, q): the place
    is the vector's own, all else its leader's, q being the rotated leader in signed bytes, whose signs are the code.
    A task gives each place of a cluster once."""
    names = [x.split()[0] for x in CODE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, list[np.ndarray]] = {}
        seen: set[tuple[int, int, int]] = set()
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                labels, leaders, rs, of_leader, vectors = (batch.column(i).to_pylist() for i in range(5))
                dims = np.array([len(v) for v in vectors], np.int64)
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    x = units([vectors[i] for i in at])
                    if dim not in turns:
                        turns[dim] = [rotation(int(dim), k) for k in range(1 + ceil(bits * tables / int(dim)))]
                    q = units([of_leader[i] for i in at]) @ turns[dim][0].T
                    f = np.abs(q).sum(1) / np.sqrt(dim)
                    # bytes round the size of a coordinate, never its sign
                    scaled = np.where(q < 0, -1, 1) * np.maximum(1, np.rint(np.abs(q) * 127 / np.abs(q).max(1, keepdims=True))).astype(np.int16)
                    scale = np.abs(q).max(1) / 127
                    signs = np.concatenate([x @ r.T for r in turns[dim][1:]], 1)[:, : bits * tables] > 0
                    places = signs.reshape(len(x), tables, bits) @ (1 << np.arange(bits)) + (np.arange(tables) << bits) + (int(dim) << 48)
                    packed = [row.tobytes() for row in scaled.astype(np.int8)]
                    new = []
                    for k, i in enumerate(at):
                        for p in places[k].tolist():
                            key = (labels[i], p, leaders[i])
                            if key not in seen:
                                seen.add(key)
                                new.append((labels[i], p, leaders[i], rs[i], float(f[k]), float(scale[k]), packed[k]))
                    if len(seen) > 1_000_000:
                        seen.clear()
                    cols = list(zip(*new, strict=True)) or [[]] * 7
                    types = [pa.int64()] * 3 + [pa.float64()] * 3 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return vectors.select("label", "leader", "r", "of_leader", "embedding").mapInArrow(trimmed(run), CODE)


def bucket_groups(got: pa.Table, *keys: str) -> Iterator[np.ndarray]:
    """Rows of each bucket, in order of side and id."""
    cols = np.stack([got.column(k).to_numpy() for k in keys], 1)
    order = np.lexsort((got.column("id").to_numpy(), got.column("side").to_numpy(), *cols.T))
    cols = cols[order]
    cut = np.concatenate([[0], np.flatnonzero((cols[1:] != cols[:-1]).any(1)) + 1, [len(order)]])
    for s, t in zip(cut[:-1], cut[1:], strict=True):
        if t - s > 1:
            yield order[s:t]


def decoded(got: pa.Table, at: np.ndarray) -> np.ndarray:
    q, scale = got.column("q"), got.column("scale").to_numpy()
    return np.stack([np.frombuffer(q[int(i)].as_buffer(), np.int8) for i in at]).astype(np.float32) * scale[at, None].astype(np.float32)


def surviving(x: np.ndarray, fx: np.ndarray, y: np.ndarray, fy: np.ndarray, least: np.ndarray | float) -> np.ndarray:
    """Which pairs may have an inner product of `least`, by both estimates and their bounds."""
    dim = x.shape[1]
    root = np.sqrt(dim)
    keep = np.ones((len(x), len(y)), bool)
    for code, f, other in ((x, fx, y), (y, fy, x)):
        est = (np.where(code < 0, -1, 1).astype(np.float32) @ other.T) / (root * f[:, None])
        # half a step of rounding in each coordinate, at most
        slack = EPS * np.sqrt(np.maximum(0, 1 - f * f) / (f * f * max(1, dim - 1))) + 0.5 * root / 127 * np.abs(other).max() / f
        up = est + slack[:, None]
        keep &= (up if code is x else up.T) >= least
    return keep


def leads(entries: DataFrame, tight: float) -> DataFrame:
    """entries(label, place, part, ...) -> (a, b): a leads a part of a bucket, b is in it and may lie within `tight`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        got = pa.Table.from_batches(held).combine_chunks()
        ids, f = got.column("id").to_numpy(), got.column("f").to_numpy()
        out = []
        for at in bucket_groups(got, "label", "place", "part"):
            at = at[np.argsort(rank(ids[at]), kind="stable")]
            x = decoded(got, at)
            near = np.flatnonzero(surviving(x[:1], f[at[:1]], x[1:], f[at[1:]], tight)[0]) + 1
            out.append(np.stack([np.full(len(near), ids[at[0]]), ids[at[near]]], 1))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    dealt = entries.withColumn("side", F.lit(0)).repartition("label", "place", "part").select("label", "place", "part", "side", "id", "f", "scale", "q")
    return dealt.mapInArrow(trimmed(run), "a long, b long").dropDuplicates(["a", "b"])


def estimates(entries: DataFrame, threshold: float) -> DataFrame:
    """entries(label, place, c, d, side, ...) -> pairs (a, b) of clusters, some of whose members the bounds let link. A
    bucket that is not dealt out has c = d = side = 0."""
    theta = acos(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        got = pa.Table.from_batches(held).combine_chunks()
        side, ids, f, r, c, d = (got.column(k).to_numpy() for k in ("side", "id", "f", "r", "c", "d"))
        for at in bucket_groups(got, "label", "place", "c", "d"):
            # a cluster may have come from several tasks
            at = at[np.concatenate([[True], (ids[at[1:]] != ids[at[:-1]]) | (side[at[1:]] != side[at[:-1]])])]
            x = decoded(got, at)
            first = int((side[at] == 0).sum())
            cross = c[at[0]] != d[at[0]]
            for a in range(0, first if cross else len(at), 512):
                e = min(a + 512, first if cross else len(at))
                lo = first if cross else a
                least = np.cos(np.minimum(pi, theta + r[at[a:e], None] + r[at[None, lo:]]))
                i, j = np.nonzero(surviving(x[a:e], f[at[a:e]], x[lo:], f[at[lo:]], least))
                i, j = ids[at[a:e]][i], ids[at[lo:]][j]
                apart = i != j
                pairs = np.unique(np.stack([np.minimum(i, j)[apart], np.maximum(i, j)[apart]], 1), axis=0)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return entries.repartition("label", "place", "c", "d").select("label", "place", "c", "d", "side", "id", "r", "f", "scale", "q").mapInArrow(trimmed(run), "a long, b long").dropDuplicates(["a", "b"])


def cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs(a, b) with their cosines in double precision."""
    x = pairs.select("a", "b").join(vectors.select(F.col("id").alias("a"), F.col("embedding").alias("x")), "a").join(vectors.select(F.col("id").alias("b"), F.col("embedding").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                out = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    u, v = x.values.to_numpy().astype(np.float64), y.values.to_numpy().astype(np.float64)
                    out.append(float(u @ v / np.sqrt((u @ u) * (v @ v))))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "cosine"])

    return x.select("a", "b", "x", "y").mapInArrow(trimmed(run), "a long, b long, cosine double")


def clusters(reps: DataFrame, threshold: float) -> DataFrame:
    """(id, leader, angle) of each of reps(id, label, embedding), within half the threshold's angle of its leader."""
    tight = cos(acos(threshold) / 2 - SAFE)
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, _ = tables_for(largest, threshold)
    own = reps.select("label", F.col("id").alias("leader"), F.lit(0.0).alias("r"), F.col("embedding").alias("of_leader"), "embedding")
    entries = materialize(code(own, bits, STAR), "first-codes")
    leading = reps.select("id")
    found: list[DataFrame] = []
    for _ in range(ROUNDS):
        if found:
            leading = leading.join(hinted(found[-1].select(F.col("b").alias("id"))), "id", "left_anti")
        now = entries.join(leading, "id", "left_semi") if found else entries
        many = materialize(now.groupBy("label", "place").count().filter(F.col("count") > PART).select("label", "place", F.ceil(F.col("count") / PART).cast("long").alias("parts")), "parts")
        now = now.join(hinted(many), ["label", "place"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)))
        near = cosines(leads(now, tight), reps).filter(F.col("cosine") >= tight)
        found.append(materialize(near.groupBy("b").agg(F.max(F.struct("cosine", F.col("a"))).alias("x")).select("b", F.col("x.a").alias("a")), "followers"))
    follow = found[0]
    for more in found[1:]:
        follow = follow.unionByName(more)
    follow = materialize(follow, "follow")  # each follows one other, of lower rank
    # who follows a follower asks that one's own leader, a few times
    for _ in range(3):
        up = follow.select(F.col("b").alias("a"), F.col("a").alias("_up"))
        follow = materialize(follow.join(hinted(materialize(up, "up")), "a", "left").select("b", F.coalesce("_up", "a").alias("a")), "follow")
    ends = follow.join(hinted(materialize(follow.select(F.col("b").alias("a")), "inner")), "a", "left_anti")
    held = cosines(ends, reps).filter(F.col("cosine") >= tight)
    held = materialize(held.select(F.col("b").alias("id"), F.col("a").alias("leader"), F.acos(F.least(F.col("cosine"), F.lit(1.0))).alias("angle")), "held")
    out = reps.select("id").join(held, "id", "left")
    return materialize(out.select("id", F.coalesce("leader", "id").alias("leader"), F.coalesce("angle", F.lit(0.0)).alias("angle")), "clusters")


def embedding_dedup(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: id_col, n_links, component_id, kept."""
    with scratch() as keep:
        return _dedup(rows, id_col, vector_col, label_col, threshold, keep)


def _dedup(rows: DataFrame, id_col: str, vector_col: str, label_col: str, threshold: float, keep: Callable[..., None]) -> DataFrame:
    kind = rows.schema[id_col].dataType
    v = F.col(vector_col)
    sound = v.isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    every = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.when(F.coalesce(sound, F.lit(False)), v).alias("embedding"))
    # equal vectors of a label are one, by a digest of their components
    every = every.withColumn("same", F.sha2(F.array_join(F.transform("embedding", lambda x: (x + F.lit(0.0).cast("float")).cast("string")), ","), 256))
    every = materialize(every, "vectors")
    live = every.filter("embedding is not null")
    groups = live.groupBy("label", "same").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("copies"))
    groups = materialize(groups, "groups")
    reps = live.join(groups.select("label", "same", F.col("rep").alias("id"), "copies"), ["label", "same", "id"]).dropDuplicates(["id"]).select("id", "label", "embedding", "copies")
    reps = materialize(reps, "representatives")

    theta = acos(threshold)
    of = clusters(reps, threshold)
    members = materialize(reps.join(of, "id"), "members")
    # each cluster: its radius, its weight in rows, and its smallest id
    groups_of = members.groupBy("leader", "label").agg(F.max("angle").alias("r"), F.sum("copies").alias("weight"), F.min("id").alias("first"))
    groups_of = materialize(groups_of, "cluster-sizes")
    of_leader = members.filter("id = leader").select("leader", F.col("embedding").alias("of_leader"))
    largest = groups_of.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(largest, threshold)
    told = groups_of.select("leader", "r").join(of_leader, "leader")
    single = members.filter("id = leader").select("leader", "label", "embedding").join(told, "leader")
    others = members.filter("id <> leader").select("leader", "label", "embedding").join(hinted(materialize(told.join(members.filter("id <> leader").select("leader").distinct(), "leader", "left_semi"), "leaders")), "leader")
    entries = materialize(code(single.unionByName(others), bits, tables), "codes")
    hot = materialize(entries.groupBy("label", "place").count().filter(F.col("count") > BLOCK).select("label", "place", F.ceil(F.col("count") / BLOCK).cast("long").alias("blocks")), "hot")
    n_hot = hot.count()
    if n_hot:
        e = entries.join(F.broadcast(hot) if n_hot <= HOT else hot, ["label", "place"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("id"), F.col("blocks"))
        e = e.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        e = e.withColumn("c", F.least("own", "other")).withColumn("d", F.greatest("own", "other")).withColumn("side", (F.col("own") > F.col("other")).cast("int"))
    else:
        zero = F.lit(0).cast("long")
        e = entries.withColumn("c", zero).withColumn("d", zero).withColumn("side", F.lit(0))
    leaders = of_leader.select(F.col("leader").alias("id"), F.col("of_leader").alias("embedding"))
    pairs = materialize(cosines(estimates(e, threshold), leaders), "pairs")
    size = groups_of.select("leader", "r", "weight", "first")
    pairs = pairs.join(size.select(F.col("leader").alias("a"), F.col("r").alias("ra"), F.col("weight").alias("wa"), F.col("first").alias("fa")), "a").join(size.select(F.col("leader").alias("b"), F.col("r").alias("rb"), F.col("weight").alias("wb"), F.col("first").alias("fb")), "b")
    angle, wide = F.acos(F.greatest(F.least(F.col("cosine"), F.lit(1.0)), F.lit(-1.0))), F.col("ra") + F.col("rb")
    every_one = F.when(wide == 0, F.col("cosine") >= threshold).otherwise(angle + wide <= theta - SAFE)
    none = F.when(wide == 0, F.col("cosine") < threshold).otherwise(angle - wide > theta + SAFE)
    pairs = materialize(pairs.withColumn("how", F.when(every_one, "all").when(none, "none").otherwise("some")), "decided")

    # all members of both, or those whose own cosines say so
    whole = pairs.filter("how = 'all'")
    by_cluster = whole.select(F.col("a").alias("leader"), F.col("wb").alias("w")).unionByName(whole.select(F.col("b").alias("leader"), F.col("wa").alias("w"))).groupBy("leader").agg(F.sum("w").alias("whole"))
    some = pairs.filter("how = 'some'").select("a", "b")
    own = members.select("leader", "id")
    some = some.join(own.select(F.col("leader").alias("a"), F.col("id").alias("x")), "a").join(own.select(F.col("leader").alias("b"), F.col("id").alias("y")), "b")
    some = materialize(cosines(some.select(F.col("x").alias("a"), F.col("y").alias("b")), members).filter(F.col("cosine") >= threshold), "links")
    copies = members.select("id", "copies")
    by_member = some.select("a", "b").unionByName(some.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(copies.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("single"))
    of_first = members.join(groups_of.select("leader", "first"), "leader").select("id", "first")
    between = some.select("a", "b").join(of_first.select(F.col("id").alias("a"), F.col("first").alias("fa")), "a").join(of_first.select(F.col("id").alias("b"), F.col("first").alias("fb")), "b").select("fa", "fb")
    label = components(whole.select("fa", "fb").unionByName(between.distinct()), "fa", "fb")
    named = members.select("id", "leader").join(groups_of.select("leader", "weight", "first"), "leader").join(by_cluster, "leader", "left").join(by_member, "id", "left")
    named = named.join(label.select(F.col("id").alias("first"), "component"), "first", "left")
    named = named.select(F.col("id").alias("rep"), (F.col("weight") - 1 + F.coalesce("whole", F.lit(0)) + F.coalesce("single", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "first").alias("component"))
    named = materialize(named, "named")
    keep(every, groups, named)
    out = every.join(groups.join(named, "rep").select("label", "same", "n_links", "component"), ["label", "same"], "left")
    sound = F.col("embedding").isNotNull()
    out = out.select("id", F.when(sound, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.coalesce(F.when(sound, F.col("component")), "id").alias("component_id"))
    return out.select(F.col("id").cast(kind).alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id),
n AS (SELECT a, count(*) AS n FROM p GROUP BY 1), m AS (SELECT id, min(c) AS c FROM r GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN m ON m.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
