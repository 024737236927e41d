"""The prefix trie of conversations, rolled up by pointer jumping.

A node is a sequence of first turns that some conversation has. Plan: (1) turns get their place from a
distributed sort: counts of a conversation's rows in the sorted partitions before a row's own, so that a
conversation that holds a third of all turns isn't one task's. (2) Each turn becomes a digest; the digest of
every prefix comes from doubling rounds, in which the digest of the last 2^k turns meets that of the 2^k before
them. Which digests meet depends on the place only, so equal prefixes have equal digests. (3) Prefixes are
grouped to nodes; the digest of the prefix one shorter is the edge to the parent. (4) Leaf counts and savings go
up in doubling rounds: after round k a node has the sums of its subtree down to 2^k levels, and adds those of
the nodes 2^k levels below it, which a jump pointer of that length leads to it. A jump comes from the digests of a
node's smallest conversation, whose keys (conversation, turn) are unique: to compose pointers by node would join
all children of a common first turn on one key. So rounds are logarithmic in the longest conversation and
no join has a hot key; sums are made partially before each shuffle.

The identifiers of the conversations that end at a node are sorted by a distributed sort and joined to stretches
in parallel; only the SHA-256 itself reads a node's stretches one after the other, as it must.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.llm.common import keep

WORDS = r"[^\x20\x09-\x0D]+"
STRETCH = 1 << 16


def placed(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """``df`` with ``place``, the number of a row, from 1, in its group by ``order``, ``n``, the rows of the group, and
    ``part``. No task has the rows of a group: the table is sorted as a whole, and what lies in partitions before
    counts as sums. Rows of one group and part are bounded by a partition of the sort."""
    rows = keep(df.sort(group, *order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    counts = rows.groupBy(group, "part").agg(F.count("*").alias("here"))
    of = Window.partitionBy(group)
    counts = counts.select(group, "part", (F.sum("here").over(of.orderBy("part")) - F.col("here")).alias("ahead"), F.sum("here").over(of).alias("n"))
    within = F.row_number().over(Window.partitionBy(group, "part").orderBy("at"))
    return rows.withColumn("within", within).join(counts, [group, "part"]).withColumn("place", F.col("ahead") + F.col("within")).drop("at", "within", "ahead")


def turns_of(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, part, place, n, digest, words: the turns in order (a null turn first, equal ones by role and text),
    null roles and texts as empty ones, rows without a conversation left out."""
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), *(F.coalesce(F.col(c), F.lit("")).alias(name) for name, c in (("role", role_col), ("text", text_col)))).where("conv_id is not null")
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    rows = rows.select("conv_id", "turn", "role", F.unhex(F.sha2(said.cast("binary"), 256)).alias("digest"), "text", F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"))
    return keep(placed(rows, "conv_id", F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")).select("conv_id", "part", "place", "n", "digest", "words"))


def shared_heads(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) rebuilt: each conversation c begins with the first h turns of c - c % every
    (fewer if that has fewer), h the CRC-32 of its decimal modulo ``most``, and goes on with its own after its
    first h."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    parts = keep(turns.select("conv_id", "part", "n").distinct())
    convs = parts.select("conv_id", "n").distinct().withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    counts = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    heads = convs.join(counts, "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0))))
    heads = keep(heads.select("conv_id", "base", "h", "m", (F.greatest(F.col("n") - F.col("h"), F.lit(0)) + F.col("m")).alias("n")))
    first = turns.where((F.col("place") < most) & (F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("base"), "place", "digest", "words")
    head = heads.join(first, "base").where("place <= m").select("conv_id", "place", "n", "digest", "words")
    shift = parts.select("conv_id", "part").join(heads.select("conv_id", "h", "m", "n"), "conv_id")
    own = turns.drop("n").join(shift, ["conv_id", "part"]).where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("m")).alias("place"), "n", "digest", "words")
    return head.unionByName(own), heads.select("conv_id")


def prefixes(turns: DataFrame, longest: int) -> DataFrame:
    """conv_id, place, n, digest: of the first ``place`` turns of each conversation. Doubling rounds; a conversation
    takes part until its length is reached."""
    now, reach, done = turns.select("conv_id", "place", "n", "digest"), 1, []
    while reach < longest:
        done.append(now.where(F.col("n") <= reach))
        live = now.where(F.col("n") > reach)
        ahead = live.select("conv_id", (F.col("place") + reach).alias("place"), F.col("digest").alias("ahead"))
        both = F.unhex(F.sha2(F.concat("ahead", "digest"), 256))
        now = keep(live.join(ahead, ["conv_id", "place"], "left").select("conv_id", "place", "n", F.when(F.col("ahead").isNull(), F.col("digest")).otherwise(both).alias("digest")))
        reach *= 2
    return reduce(DataFrame.unionByName, [*done, now])


def root_key() -> Column:
    return F.lit(b"")


def key(digest: str, place: str) -> Column:
    """A node's key: its depth and its digest, so that digests of different depths can't meet."""
    return F.concat(F.hex(F.col(place)).cast("binary"), F.lit(b":"), digest)


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) rows to joined identifiers of one node, about ``STRETCH`` of them at most."""
    node, ids, rows = None, [], []
    for batch in batches:
        for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if n != node or len(ids) >= STRETCH:
                if ids:
                    rows.append((node, ids[0], ",".join(map(str, ids))))
                node, ids = n, []
            ids.append(c)
        yield pa.RecordBatch.from_pylist([dict(zip(("node", "first", "ids"), r, strict=True)) for r in rows], pa.schema({"node": pa.binary(), "first": pa.int64(), "ids": pa.string()}))
        rows = []
    if ids:
        yield pa.RecordBatch.from_pydict({"node": [node], "first": [ids[0]], "ids": [",".join(map(str, ids))]}, pa.schema({"node": pa.binary(), "first": pa.int64(), "ids": pa.string()}))


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted stretches to one hash of each node, with a stretch in memory at a time."""
    node, state, done = None, None, []
    schema = pa.schema({"node": pa.binary(), "ends_sha256": pa.string()})
    for batch in batches:
        for n, ids in zip(batch.column("node"), batch.column("ids"), strict=True):
            n = n.as_py()
            if n != node:
                if state:
                    done.append({"node": node, "ends_sha256": state.hexdigest()})
                node, state = n, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_py().encode())
        yield pa.RecordBatch.from_pylist(done, schema)
        done = []
    if state:
        yield pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": state.hexdigest()}], schema)


def ends(last: DataFrame) -> DataFrame:
    """node, ends_sha256 of (node, conv_id): the hash of the ascending identifiers joined with commas."""
    parts = last.select("node", "conv_id").sort("node", "conv_id").mapInArrow(stretches, "node binary, first long, ids string")
    dealt = parts.repartition("node").sortWithinPartitions("node", "first").select("node", "ids")
    return dealt.mapInArrow(hashed, "node binary, ends_sha256 string")


def rolled_up(nodes: DataFrame, path: DataFrame, deepest: int) -> DataFrame:
    """node, n_leaves, saved_tokens: sums over subtrees. ``path``: conv_id, place, node of every prefix. A node takes
    part as long as it has ancestors or descendants as far away as the round reaches."""
    columns = ["node", "conv_id", "depth", "height", "n_leaves", "saved_tokens"]
    sums = nodes.select("node", "conv_id", "depth", "height", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    jump, done = 1, []
    while jump <= deepest:
        far = (F.col("depth") >= jump) | (F.col("height") >= jump)
        done.append(sums.where(~far))
        live = sums.where(far)
        up = live.where(F.col("depth") >= jump).select("conv_id", (F.col("depth") - jump).alias("place"), "n_leaves", "saved_tokens")
        to_root = up.where("place = 0").select(root_key().alias("node"), "n_leaves", "saved_tokens")
        inner = up.where("place > 0").join(path, ["conv_id", "place"]).select("node", "n_leaves", "saved_tokens")
        more = to_root.unionByName(inner).groupBy("node").agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
        sums = keep(live.join(more, "node", "left").select(*columns[:4], plus("n_leaves", "more_leaves"), plus("saved_tokens", "more_saved")))
        jump *= 2
    return reduce(DataFrame.unionByName, [*done, sums]).select("node", "n_leaves", "saved_tokens")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: conv_id (the smallest of its conversations), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, place (from 1, without gaps), n (turns of the conversation), digest (of the turn), words (in it), as ``turns_of`` makes
    them; ``convs``: the conversations (conv_id), those without turns too, which end at the root. A turn is as long as it
    may be: only its digest takes part. ``saved_tokens`` sums over the subtree the words of each node's last
    turn, times its conversations but one: what a cache of prefixes needn't process again. Edge cases: without
    conversations there are no nodes; a conversation without turns is a member of the root, which is a leaf if
    there is no turn at all; equal conversations end at one node.
    """
    turns = keep(turns.select("conv_id", "place", "n", "digest", "words"))
    longest = turns.agg(F.max("place")).first()[0] or 0
    path = keep(prefixes(turns, longest).select("conv_id", "place", "n", key("digest", "place").alias("node")))
    rows = path.join(turns.select("conv_id", "place", "words"), ["conv_id", "place"])
    whole = convs.select(F.col("conv_id").cast("long")).distinct()
    inner = rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("place").alias("depth"), F.count("*").alias("n_convs"), F.max("words").alias("words"), (F.max("n") - F.max("place")).alias("height"))
    root = whole.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(root_key().alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"), F.lit(longest).cast("long").alias("height"))
    edge = path.select("conv_id", (F.col("place") + 1).alias("depth"), F.col("node").alias("parent"))
    inner = inner.withColumn("depth", F.col("depth").cast("long")).join(edge, ["conv_id", "depth"], "left").withColumn("parent", F.coalesce("parent", root_key()))
    edges = keep(inner.unionByName(root.withColumn("parent", F.lit(None).cast("binary"))))
    children = edges.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = keep(edges.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")))
    sums = rolled_up(nodes, path.drop("n"), longest)
    last = whole.join(path.where("place = n").select("conv_id", "node"), "conv_id", "left").select("conv_id", F.coalesce("node", root_key()).alias("node"))
    parents = edges.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, "node").join(ends(last), "node", "left").join(parents, "parent", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
