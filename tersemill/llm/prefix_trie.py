"""A prefix trie of conversations by mergeable partial tries (operator 13).

A conversation may be rebuilt from the first turns of a base conversation and its own turns after those. A node is
a sequence of first turns; it is known by its depth and four 32-bit sums, over its turns, of hashes of place and
turn. Sums up to each turn come from ranges of the sorted turns and what lies before each range, so no task goes
through a whole conversation.

Each partition combines its turns to a partial trie, a table of nodes with members and lists of the conversations
that end there. The tables are merged as a tree, FAN partitions of a key at a time. Nodes of a single conversation
need no more; over the others sums of whole subtrees go up by doubling: in round k a node has the sums of what is
less than 2^k below it, and gives them to its ancestor 2^k above. The rounds number as the depth's logarithm.
The ids that end at a node are sorted in ranges and hashed from pieces of text, in order and as a stream.

Defined results: rows without a conv_id belong to no conversation and are left out; null roles and texts are empty;
turns are in order of their number, null first, those that repeat one in order of a digest of role and text;
repeated rows are turns of their own; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, table, trimmed

#: Turns that are borrowed at most, and the ids that share a base.
LEND, BASE = 8, 5
#: Partial tries merged at a time; nodes and ends that a partial trie holds before it is sent.
FAN, NODES, ENDS = 16, 100_000, 200_000
#: Ids of a piece of text; an ancestor with so much of all pointers meets them by broadcast.
PIECE, HUB = 8192, 1000


def running(df: DataFrame, by: str, order: list[str], **sums: Column) -> DataFrame:
    """df with sums over its rows of `by` up to each one in order. What a range adds to the next is broadcast: only
    values of `by` that go over ranges have it, fewer than there are ranges."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = df.withColumns({f"_{n}": c for n, c in sums.items()})
    parts = materialize(own.repartitionByRange(ranges, by, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(by, "_p").agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in sums))
    before = totals.select(by, "_p", *(F.sum(f"_{n}").over(earlier).alias(f"_before_{n}") for n in sums)).filter(" and ".join(f"_before_{n} is not null" for n in sums))
    inside = Window.partitionBy("_p", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(F.broadcast(before), [by, "_p"], "left")
    return out.select(*df.columns, *((F.sum(f"_{n}").over(inside) + F.coalesce(F.col(f"_before_{n}"), F.lit(0))).alias(n) for n in sums))


def turns_of(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, pos, sha, size): each turn's place from 1, digest of role and text, bytes of text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    sha = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), sha.alias("sha"), F.octet_length(text).cast("long").alias("size"))
    return running(rows, "conv", ["turn", "sha"], pos=F.lit(1).cast("long")).drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, length) and their turns (conv, depth, sha, size), rebuilt: the first h turns of the base
    conv - conv % 5, then the conversation's own after its first h, with h the conv's crc32 modulo 9."""
    own = turns.groupBy("conv").agg(F.max("pos").alias("own"))
    first = turns.filter(F.col("pos") <= LEND).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "sha", "size"))).alias("lent"))
    convs = own.withColumn("h", (F.crc32(F.col("conv").cast("string")) % (LEND + 1)).cast("int")).withColumn("base", F.col("conv") - F.col("conv") % BASE)
    convs = convs.join(first.withColumnRenamed("conv", "base"), "base", "left")
    lent = F.slice(F.coalesce("lent", F.array().cast("array<struct<pos:bigint,sha:binary,size:bigint>>")), F.lit(1), F.col("h"))
    convs = materialize(convs.select("conv", "own", "h", lent.alias("lent")), "convs")
    begun = convs.select("conv", F.explode("lent").alias("t")).select("conv", F.col("t.pos").alias("depth"), "t.sha", "t.size")
    known = convs.filter("own > h").select("conv", "h", F.size("lent").alias("m"))
    rest = turns.join(known, "conv").filter("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "sha", "size")
    length = F.size("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return convs.select("conv", length.cast("long").alias("length")), begun.unionByName(rest)


def node_key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *(s.cast("string") for s in sums))))


def paths(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(key, parent, depth, size, conv): each conversation's nodes, the root among them."""
    h = [F.xxhash64(F.lit(i), F.col("depth"), F.col("sha")) for i in (1, 2)]
    own = [x for y in h for x in (F.shiftrightunsigned(y, 32), y.bitwiseAND(0xFFFFFFFF))]
    turns = turns.withColumns({f"h{i}": x for i, x in enumerate(own)})
    turns = running(turns, "conv", ["depth"], **{f"s{i}": F.col(f"h{i}") for i in range(4)})
    sums, before = [F.col(f"s{i}") for i in range(4)], [F.col(f"s{i}") - F.col(f"h{i}") for i in range(4)]
    below = turns.select(node_key(F.col("depth"), sums).alias("key"), node_key(F.col("depth") - 1, before).alias("parent"), "depth", "size", "conv")
    zero = F.lit(0).cast("long")
    return below.unionByName(convs.select(node_key(zero, [zero] * 4).alias("key"), F.lit(None).cast("binary").alias("parent"), zero.alias("depth"), zero.alias("size"), "conv"))


def partial_tries(nodes: DataFrame) -> DataFrame:
    """(part, key, parent, depth, size, conv, n, ends): nodes combined inside a partition; nodes has length beside its
    columns, and a conversation ends where its length is the depth."""
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    names = ["part", "key", "parent", "depth", "size", "conv", "n", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        part, ends = 0, 0

        def send() -> pa.RecordBatch:
            rows = [(part, key, *row) for key, row in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for key, parent, depth, size, conv, length, part in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                node = held.get(key)
                if node is None:
                    held[key] = node = [parent, depth, size, conv, 0, []]
                node[4] += 1
                node[3] = min(node[3], conv)
                if length == depth:
                    node[5].append(conv)
                    ends += 1
                if len(held) >= NODES or ends >= ENDS:
                    yield send()
                    held, ends = {}, 0
        if held:
            yield send()

    read = nodes.select("key", "parent", "depth", "size", "conv", "length", F.spark_partition_id().alias("part"))
    return read.mapInArrow(trimmed(run), "part int, key binary, parent binary, depth long, size long, conv long, n long, ends array<long>")


def merged(tries: DataFrame, fan: int) -> DataFrame:
    """(key, parent, depth, size, conv, n): the partial tries as one, by a tree of merges."""
    parts = (tries.agg(F.max("part")).first()[0] or 0) + 1
    now = tries.drop("ends")
    while True:
        parts = -(-parts // fan)
        now = now.groupBy("key", F.floor(F.col("part") / fan).alias("part")).agg(*(F.first(c).alias(c) for c in ("parent", "depth", "size")), F.min("conv").alias("conv"), F.sum("n").alias("n"))
        if parts == 1:
            return now.drop("part")


def end_hashes(tries: DataFrame) -> DataFrame:
    """(key, ends_sha256) of nodes at which conversations end."""
    ranges = int(tries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = tries.filter(F.size("ends") > 0).select("key", F.explode("ends").alias("conv"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def piece() -> tuple:
            return now, held[0], ",".join(map(str, held))

        for batch in batches:
            out = []
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (key != now or len(held) >= PIECE):
                    out.append(piece())
                    held = []
                now = key
                held.append(conv)
            if out:
                yield texts(out)
        if held:
            yield texts([piece()])

    def texts(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["key", "conv", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], names=["key", "ends_sha256"])

        for batch in batches:
            out = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != now:
                    if sha:
                        out.append((now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield rows(out)
        if sha:
            yield rows([(now, sha.hexdigest())])

    sorted_ = ends.repartitionByRange(ranges, "key", "conv").sortWithinPartitions("key", "conv")
    cut = sorted_.mapInArrow(trimmed(pieces), "key binary, conv long, ids string")
    return cut.repartition(ranges, "key").sortWithinPartitions("key", "conv").mapInArrow(trimmed(hashed), "key binary, ends_sha256 string")


def with_parent(nodes: DataFrame, by: str, known: DataFrame, counts: DataFrame, rows: int) -> DataFrame:
    """nodes with the columns of known (its key is named as `by`); what has a HUBth of all rows meets them by broadcast."""
    hubs = F.broadcast(counts.filter(F.col("n") * HUB >= rows).select(by))
    hot = F.broadcast(known.join(hubs, by, "left_semi"))
    return nodes.join(hubs, by, "left_semi").join(hot, by).unionByName(nodes.join(hubs, by, "left_anti").join(known, by, "left"))


def rollup(shared: DataFrame) -> DataFrame:
    """(key, leaves, saved) over whole subtrees, of nodes (key, up, leaves, saved) with the parent in up."""
    now, rows = shared, shared.count()
    while now.filter("up is not null").take(1):
        given = materialize(now.filter("up is not null").groupBy("up").agg(F.sum("leaves").alias("more"), F.sum("saved").alias("gain"), F.count(F.lit(1)).alias("n")), "given")
        grown = now.join(given.select(F.col("up").alias("key"), "more", "gain"), "key", "left")
        grown = grown.select("key", "up", *((F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("leaves", "more"), ("saved", "gain"))))
        above = now.select(F.col("key").alias("up"), F.col("up").alias("next"))
        now = materialize(with_parent(grown, "up", above, given, rows).select("key", F.col("next").alias("up"), "leaves", "saved"), "rollup")
    return now.drop("up")


def prefix_trie(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    with scratch() as keep:
        return _prefix_trie(conversations, conv_col, turn_col, role_col, text_col, fan, keep)


def _prefix_trie(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, fan: int, keep: Callable[..., None]) -> DataFrame:
    turns = materialize(turns_of(conversations, conv_col, turn_col, role_col, text_col), "turns")
    convs, own = rebuilt(turns)
    nodes = paths(convs, own)
    tries = materialize(partial_tries(nodes.join(convs, "conv")), "tries")
    trie = materialize(merged(tries, fan), "trie")
    rows = trie.count()
    # what hangs below each node: children, and those that lead to one leaf of a single conversation
    below = trie.filter("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("single"))
    below = materialize(below, "below")
    counted = trie.join(below.select(F.col("parent").alias("key"), F.col("n").alias("children"), "single"), "key", "left")
    counted = materialize(counted.withColumns({"children": F.coalesce("children", F.lit(0)), "single": F.coalesce("single", F.lit(0))}), "counted")
    own_leaves = F.col("single") + (F.col("children") == 0).cast("long")
    sums = rollup(counted.filter("n > 1").select("key", F.col("parent").alias("up"), own_leaves.alias("leaves"), ((F.col("n") - 1) * F.col("size")).alias("saved")))
    named = trie.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv"))
    out = with_parent(counted, "parent", named, below, rows).join(sums, "key", "left").join(end_hashes(tries), "key", "left")
    out = materialize(
        out.select(
            F.col("conv").alias("conv_id"),
            "depth",
            F.col("parent_conv").alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            F.col("children").alias("n_children"),
            F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),
            F.coalesce("saved", F.lit(0).cast("long")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        ),
        "prefix-trie",
    )
    keep(out)
    return out


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: A node is the digests of its turns; crc32 bit by bit.
OP13_SQL = """
WITH t AS (SELECT conv_id AS c, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS s, strlen(coalesce(text, '')) AS z FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, s, z, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, s) AS pos FROM t),
convs AS (SELECT c, count(*) AS n, c - c % 5 AS b, xor(list_reduce([4294967295]::BIGINT[] || flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 9 AS h FROM own GROUP BY c),
lent AS (SELECT convs.c, own.pos AS d, s, z FROM convs JOIN own ON own.c = b AND own.pos <= h),
m AS (SELECT convs.c, h, count(lent.c) AS m FROM convs LEFT JOIN lent USING (c) GROUP BY convs.c, h),
seq AS (SELECT * FROM lent UNION ALL SELECT own.c, pos - h + m, s, z FROM own JOIN m USING (c) WHERE pos > h),
p AS (SELECT c, d, z, string_agg(s, ',') OVER (PARTITION BY c ORDER BY d) AS k FROM seq UNION ALL SELECT c, 0, 0, '' FROM convs),
path AS (SELECT c, d, z, sha256(k) AS k, lag(sha256(k)) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS last FROM p),
node AS (SELECT d, k, any_value(up) AS up, any_value(z) AS z, min(c) AS c, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '') AS ends FROM path GROUP BY d, k),
kids AS (SELECT up AS k, count(*) AS kids FROM node WHERE up IS NOT NULL GROUP BY up),
full_ AS (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kids USING (k)),
sums AS (SELECT path.k, sum((f.kids = 0)::INT) AS leaves, sum((f.n - 1) * f.z) AS saved FROM full_ AS f JOIN path ON path.c = f.c AND path.d <= f.d GROUP BY path.k)
SELECT f.c AS conv_id, f.d AS depth, u.c AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ AS f JOIN sums USING (k) LEFT JOIN node AS u ON u.k = f.up
"""
