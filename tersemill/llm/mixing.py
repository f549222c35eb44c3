"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 5, native).

Sizes are words. A source's target is its share by weight of all words, at most `most` times its size; what is
above is shared again by weight. A source is drawn in passes: whole ones as long as they fit its target, then a
part of one. The documents of a source lie in blocks (hashes of their ids) in a permuted order; the part ends
at a cut in that order, found by sums over blocks, then over the sub-blocks of one block, then over the
documents of one sub-block, so no task ever orders a whole source.

Each pass of a block is a unit. How many units of each source an output shard gets is drawn by a tree: a
node's quotas are split between its two halves by sampling its units without replacement, which is a
multivariate hypergeometric draw, so quotas stay exact. Many sources are split in groups: first a draw over
the groups, then one inside each, which is the same distribution. Shards then take disjoint runs of each
source's permuted units, and a hash of shard, document and pass orders them within the shard. What a document
gives to the mixture is the units drawn of its block. The tree has at most COARSE leaves, so that each has many
blocks of every source that has many; where more shards are wanted, a leaf's documents are dealt on by hash.

Sources are numbered and shared out by prefix sums over ranges of them, so no task goes through all sources;
one row has the groups' quotas, GROUP times fewer than there are sources. Documents meet what is known of
their source by broadcast where it has many of them.

Defined results: a null text has size 0; the null source is a source of its own, the last; a source without
words has target 0; rows that repeat an id and size are drawn alike; a table without words takes nothing, an
empty one gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import OWN_ID, OWN_KEY, WORD, hinted, materialize, scratch, table

WEIGHTS = (5.0, 2.0, 1.0)
BLOCKS, SUB_BLOCKS, SHARDS = 4096, 4096, 64
#: Shards that the tree deals blocks to. More are made of each by hashes of what lies in it, so that shards can be as many as rows ask for.
COARSE = 64
#: Up to so many sources, what is known of each source is broadcast; beyond, only of those (no more) with a share of so much.
SMALL = 2000
#: Sources whose quotas are drawn together.
GROUP = 512


def before_each(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """df with the sums of what comes before each row in an order without ties: within ranges, and of the ranges before."""
    named = df.withColumns({f"_{n}": c for n, c in sums.items()}).withColumns({f"_o{i}": c for i, c in enumerate(order)})
    keys = [F.col(f"_o{i}") for i in range(len(order))]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(named.repartitionByRange(ranges, *keys).withColumn("_p", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("_p").agg(*(F.sum(f"_{n}").alias(f"_t_{n}") for n in sums))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = totals.select("_p", *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_t_{n}") for n in sums))
    inside = Window.partitionBy("_p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(F.broadcast(totals), "_p")
    return out.select(*df.columns, *((F.col(f"_t_{n}") + F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0))).alias(n) for n in sums))


def share(sources: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """sources(src, source, words, ...) with idx and target."""
    s = before_each(sources, [F.col("source").isNull(), F.col("source"), F.col("src")], idx=F.lit(1)).withColumn("idx", (F.col("idx") + 1).cast("int"))
    cycle = F.array(*map(F.lit, weights))
    s = s.withColumn("weight", F.element_at(cycle, ((F.col("idx") - 1) % len(weights) + 1).cast("int")))
    # those that reach their cap first come first; a source is capped if it is above its cap with all before it capped
    s = materialize(before_each(s, [F.col("words") / F.col("weight"), F.col("idx")], capped=F.col("words"), gone=F.col("weight")), "shares")
    total = s.agg(F.sum("words"), F.sum("weight")).first()
    level = (F.lit(total[0]) - most * F.col("capped")) / (F.lit(total[1]) - F.col("gone"))
    s = s.withColumn("level", level)
    free = s.filter(F.col("weight") * F.col("level") <= most * F.col("words"))
    found = free.agg(F.min(F.struct(F.col("words") / F.col("weight"), F.col("idx"), F.col("level").alias("level")))["level"]).first()[0]
    target = F.col("weight") * found if found is not None else F.lit(float(most)) * F.col("words")
    return s.withColumn("target", F.least(F.lit(float(most)) * F.col("words"), target)).drop("level", "capped", "gone")


class Sources:
    """What is known of each source, joined to rows without a task for each source."""

    def __init__(self, sources: DataFrame):
        self.hot = None
        if sources.count() > SMALL:
            self.hot = F.broadcast(sources.filter("hot").select("src"))

    def join(self, rows: DataFrame, info: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
        if self.hot is None:
            return rows.join(F.broadcast(info), keys, how)
        many = rows.join(self.hot, "src", "left_semi").join(F.broadcast(info.join(self.hot, "src", "left_semi")), keys, how)
        return many.unionByName(rows.join(self.hot, "src", "left_anti").join(info, keys, how))


def cuts(rows: DataFrame, sources: DataFrame, known: Sources) -> DataFrame:
    """Where the part of a pass ends: (src, cut), cut being the key of the last document taken; null if none."""
    part = sources.select("src", "part").filter("part > 0")
    at = part.withColumn("before", F.lit(0).cast("long"))
    inside = rows
    for keys in (["k1", "b1"], ["k2", "b2"]):
        inside = known.join(inside, at, ["src"])
        sums = inside.groupBy("src", "part", "before", *keys).agg(F.sum("size").alias("size"))
        w = Window.partitionBy("src").orderBy(*keys)
        sums = sums.withColumn("until", F.col("before") + F.sum("size").over(w))
        # the block in which the part ends: the first that reaches it
        ends = sums.filter("until >= part").groupBy("src").agg(F.min(F.struct(*keys, (F.col("until") - F.col("size")).alias("before"), "part")).alias("e")).select("src", "e.*")
        inside = known.join(inside.drop("part", "before"), ends, ["src", *keys])
        if keys[0] == "k1":
            inside = inside.drop("part", "before")
            at = ends.select("src", "part", "before")
    w = Window.partitionBy("src").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(w), F.lit(0)))
    key = F.struct("k1", "b1", "k2", "b2", "h", "id", "size")
    # a document is taken if at least half of it lies before the end; if not even the first one is, the cut is just before it
    taken = F.col("start") * 2 + F.col("size") <= F.col("part") * 2
    return inside.groupBy("src").agg(F.max(F.when(taken, key)).alias("last"), F.min(key).alias("first")).select("src", F.coalesce("last", "first").alias("cut"), F.col("last").isNotNull().alias("closed"))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas: a row for each group of sources, (g, q), with q, array<long> of each source's units. Gives (shard, g, q)."""

    add = lambda q: F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x)

    def left(node: Column, q: Column, room: Column) -> Column:
        total = add(q)
        units = lambda n: F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<long>"))

        def draw(s: Column, _: Column) -> Column:
            u = F.pmod(F.xxhash64(F.lit(seed), node, s["rest"]), F.lit(1 << 52)) / F.lit(float(1 << 52))
            go = (u * s["rest"] < s["room"]).cast("long")
            return F.struct((s["rest"] - 1).alias("rest"), (s["room"] - go).alias("room"), (s["hits"] + go).alias("hits"))

        def source(a: Column, n: Column) -> Column:
            end = F.aggregate(units(n), F.struct(a["rest"].alias("rest"), a["room"].alias("room"), F.lit(0).cast("long").alias("hits")), draw)
            return F.transform(F.array(end), lambda e: F.struct(e["rest"].alias("rest"), e["room"].alias("room"), F.concat(a["out"], F.array(e["hits"])).alias("out")))[0]

        start = F.struct(total.alias("rest"), room.alias("room"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(q, start, source, lambda a: a["out"])

    def halves(nodes: DataFrame, *keys: str) -> DataFrame:
        one = F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("q"))
        two = F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", "l", lambda a, b: a - b).alias("q"))
        return nodes.select(*keys, F.explode(F.array(one, two)).alias("x")).select(*keys, "x.*")

    nodes = quotas.select("g", F.lit(1).cast("long").alias("node"), "q")
    several = quotas.count() > 1
    if several:
        top = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("g", add(F.col("q")).alias("n")))), lambda x: x["n"]).alias("q")).select(F.lit(1).cast("long").alias("node"), "q")
    width = 1
    while width < shards:
        if several:
            top = top.withColumn("l", left(F.col("node"), F.col("q"), F.floor(add(F.col("q")) / 2)))
            nodes = nodes.join(top.select("node", F.posexplode("l").alias("g", "room")), ["node", "g"])
            nodes = nodes.withColumn("l", left(F.xxhash64("node", "g"), F.col("q"), F.col("room")))
            top, nodes = materialize(halves(top), "tree"), materialize(halves(nodes, "g"), "tree")
        else:  # one group has what the whole node has
            nodes = halves(nodes.withColumn("l", left(F.col("node"), F.col("q"), F.floor(add(F.col("q")) / 2))), "g")
        width *= 2
    return nodes.select((F.col("node") - width).alias("shard"), "g", "q")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = 3, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target, taken, shards (array<long>: where each copy
    goes, in order of the passes). draws() makes the mixture of it. shards is a power of two."""
    with scratch() as keep:
        return _mix(docs, id_col, text_col, source_col, weights, most, shards, seed, keep)


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], most: int, shards: int, seed: int, keep: Callable[..., None]) -> DataFrame:
    # what tells two rows of a source apart is their id; its hash is their place
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), h.alias("h"))
    src = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    rows = materialize(rows.select("id", "source", "size", src.alias("src"), "h"), "sizes")
    keyed = rows.withColumns({"b1": F.pmod(F.col("h"), F.lit(BLOCKS)), "b2": F.pmod(F.shiftright("h", 20), F.lit(SUB_BLOCKS))})
    keyed = keyed.withColumns({"k1": F.xxhash64(F.lit(seed), "src", "b1"), "k2": F.xxhash64(F.lit(seed + 1), "src", "b2")})

    sources = rows.groupBy("src", "source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    sources = share(sources.withColumn("hot", F.col("n") * SMALL >= rows.count()).drop("n"), weights, most)
    take = F.floor(F.col("target") + 0.5).cast("long")
    sources = sources.withColumn("passes", F.when(F.col("words") > 0, F.floor(take / F.col("words"))).otherwise(0).cast("long")).withColumn("part", take - F.col("passes") * F.col("words"))
    sources = materialize(sources, "sources")
    known = Sources(sources)
    ends = materialize(cuts(keyed.select("src", "id", "size", "h", "b1", "b2", "k1", "k2"), sources, known), "cuts")
    plan = materialize(sources.join(ends, "src", "left"), "plan")

    # units of each source in their permuted order: whole passes, then the blocks of the part
    blocks = keyed.groupBy("src", "k1", "b1").agg(F.count(F.lit(1)).alias("n"))
    blocks = blocks.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("k1", "b1"))).withColumn("blocks", F.count(F.lit(1)).over(Window.partitionBy("src")))
    blocks = known.join(blocks, plan.select("src", "idx", "passes", "part", "cut"), ["src"])
    in_part = F.coalesce(F.struct("k1", "b1") <= F.struct(F.col("cut.k1"), F.col("cut.b1")), F.lit(False)) & (F.col("part") > 0)
    blocks = materialize(blocks.withColumn("passes", F.col("passes") + in_part.cast("long")).select("src", "idx", "b1", "place", "blocks", "passes"), "blocks")
    # idx counts the sources from 1 without a gap
    own = blocks.groupBy("idx").agg(F.sum("passes").alias("n")).withColumn("g", F.floor((F.col("idx") - 1) / GROUP).cast("int"))
    quotas = own.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "n"))), lambda x: x["n"]).alias("q"))
    coarse = min(shards, COARSE)
    leaves = split_quotas(quotas, coarse, seed).select("shard", "g", F.posexplode("q").alias("i", "n")).select("shard", (F.col("g") * GROUP + F.col("i") + 1).alias("idx"), "n")
    until = F.sum("n").over(Window.partitionBy("idx").orderBy("shard"))
    runs = leaves.withColumn("until", until).filter("n > 0").select("idx", "shard", F.explode(F.sequence(F.col("until") - F.col("n") + 1, F.col("until"))).alias("unit"))
    units = blocks.filter("passes > 0").select("src", "idx", "b1", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), lambda e: F.struct(e.alias("pass"), (e * F.col("blocks") + F.col("place")).alias("unit")))).alias("u")).select("src", "idx", "b1", "u.*")
    where = units.join(runs, ["idx", "unit"]).groupBy("src", "b1").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("places"))

    where = materialize(where, "where")
    keep(rows, sources, plan, where)
    out = known.join(keyed, plan.select("src", F.col("words").alias("source_size"), "target", "cut", "closed"), ["src"])
    out = known.join(out, where, ["src", "b1"], "left")
    # a document is in the units drawn of its block; in the block where the part ends, the last unit goes only as far as the cut
    key = F.struct("k1", "b1", "k2", "b2", "h", "id", "size")
    drawn = F.coalesce("places", F.array().cast("array<long>"))
    beyond = F.when(F.col("closed"), key > F.col("cut")).otherwise(key >= F.col("cut")) & (F.struct("k1", "b1") == F.struct(F.col("cut.k1"), F.col("cut.b1")))
    drawn = F.when(F.coalesce(beyond, F.lit(False)), F.slice(drawn, F.lit(1), F.greatest(F.size(drawn) - 1, F.lit(0)))).otherwise(drawn)
    if shards > coarse:
        drawn = F.transform(drawn, lambda s, i: s * (shards // coarse) + F.pmod(F.xxhash64(F.lit(seed + 2), "id", "size", i), F.lit(shards // coarse)))
    out = out.withColumn("shards", drawn)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def place_of(shard: Column, id_: Column, pass_: Column, seed: int = 0) -> Column:
    """The local shuffle: copies lie in their shard in the order of this number."""
    return F.xxhash64(F.lit(seed), shard, id_, pass_)


def draws(mixed: DataFrame, *, id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """The mixture itself: (shard, place, id_col, pass); shuffled within each shard by place."""
    return mixed.select(id_col, F.posexplode("shards").alias("pass", "shard")).select("shard", place_of(F.col("shard"), F.col(id_col), F.col("pass"), seed).alias("place"), id_col, "pass")


PASS, OUT = "_tersemill_pass", "_tersemill_shard"


def mixture(docs: DataFrame, *, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """A row of docs for each copy that the mixture takes, dealt to its shard and shuffled there."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    mixed = mix(docs, id_col=id_col, text_col=text_col, shards=shards, seed=seed).filter(F.size("shards") > 0)
    # rows that repeat an id and a size are drawn alike
    mixed = materialize(mixed.select(F.col(id_col).alias(OWN_ID), F.col("size").alias(OWN_KEY), F.col("shards").alias("_tersemill_shards")).dropDuplicates([OWN_ID, OWN_KEY]), "mixed")
    drawn = docs.join(hinted(mixed), F.col(id_col).eqNullSafe(F.col(OWN_ID)) & (size == F.col(OWN_KEY)))
    drawn = drawn.select(*docs.columns, F.posexplode("_tersemill_shards").alias(PASS, OUT))
    return drawn.repartition(OUT).sortWithinPartitions(OUT, place_of(F.col(OUT), F.col(id_col), F.col(PASS), seed)).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    # where each copy goes, and its place in the local shuffle there
    copies = F.transform("shards", lambda s, i: F.concat_ws(":", s.cast("string"), place_of(s, F.col("doc_id"), i).cast("string")))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.array_join(copies, ",").alias("shards"))
