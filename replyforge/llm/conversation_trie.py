"""Conversation prefix trie: sorted shards finish their own nodes, the nodes on splitter paths are reduced over shards."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replyforge.llm.common import sql_words
from replyforge.llm.conversation_repair import SQL_CRC_TABLE, arrow_schema, sql_crc, streamed, written
from replyforge.session import materialise

if TYPE_CHECKING:
    import pyarrow as pa

# Bytes of a turn's digest: a path is one binary value, and its order is the order of the sequences.
TURN = 16
# Turns of a splitter: a longer one is cut to a prefix, which splits as well.
SPLITTER_TURNS = 256
SAMPLE_PER_SHARD = 20
MOST_SHARDS = 2_000
LEAST_ID = -(1 << 63)


class Skeleton:
    """The trie of all splitter paths: at most MOST_SHARDS * SPLITTER_TURNS nodes, numbered in preorder from the root 0."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.children: dict[tuple[int, bytes], int] = {}
        self.parents, self.lasts = [-1], [0]
        # Splitters come in order of their paths, so new nodes are met in preorder.
        for path, _ in splitters:
            node = 0
            for at in range(0, len(path), TURN):
                key = (node, path[at : at + TURN])
                if key not in self.children:
                    self.children[key] = len(self.parents)
                    self.parents.append(node)
                    self.lasts.append(self.children[key])
                node = self.children[key]
        for node in range(len(self.parents) - 1, 0, -1):
            parent = self.parents[node]
            self.lasts[parent] = max(self.lasts[parent], self.lasts[node])

    def shard(self, path: bytes, conv: int) -> int:
        return bisect_right(self.splitters, (path, conv))


def _sequence_splitters(sequences: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """Splitters (path, conv) that cut the sorted sequences into about equal shards; equal paths are cut by conv.

    Taken from a sample of about SAMPLE_PER_SHARD sequences a shard, chosen by a hash of the id. The sample
    decides how even the shards are and nothing else.
    """
    rows = sequences.count()
    share = min(1.0, SAMPLE_PER_SHARD * shards / max(rows, 1))
    picked = sequences.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    most = SPLITTER_TURNS * TURN
    sample = sorted(
        (bytes(path), conv if length <= most else LEAST_ID)
        for path, length, conv in picked.select(F.substring("path", 1, most), F.octet_length("path"), "conv_id").collect()
    )
    cuts = (sample[len(sample) * i // shards] for i in range(1, shards)) if sample else ()
    return sorted(set(cuts))


class _Node:
    """One open node of the current path within a shard."""

    __slots__ = ("skeleton", "words", "conv", "convs", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, skeleton: int | None, words: int):
        self.skeleton, self.words = skeleton, words
        self.conv, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends = None
        # Finished children that need the smallest member of this node.
        self.waiting: list[tuple] = []


NODE, PARTIAL, END = 0, 1, 2
PART = (
    "kind int, skeleton int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, words bigint, ends_sha256 string"
)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _closed(stack: list[_Node]) -> Iterator[tuple]:
    """Close the deepest open node: hand its sums to its parent, and give out what is final."""
    node, depth = stack.pop(), len(stack)
    parent = stack[-1] if stack else None
    if node.skeleton is None:
        node.leaves = node.leaves or 1
        node.saved += (node.convs - 1) * node.words
        for child in node.waiting:
            yield (NODE, None, *child[:2], node.conv, *child[2:])
        row = (node.conv, depth, node.convs, node.children, node.leaves, node.saved, None, node.ends.hexdigest() if node.ends else EMPTY_SHA)
        parent.children += 1
        if parent.skeleton is None:
            parent.waiting.append(row)
        else:
            yield (NODE, parent.skeleton, *row[:2], None, *row[2:])
    else:
        yield PARTIAL, node.skeleton, node.conv, depth, None, node.convs, node.children, node.leaves, node.saved, node.words, None
    if parent is not None:
        parent.conv = node.conv if parent.conv is None else min(parent.conv, node.conv)
        parent.convs += node.convs
        parent.leaves += node.leaves
        parent.saved += node.saved


def _shared_turns(a: bytes, b: bytes) -> int:
    n, at = min(len(a), len(b)), 0
    while at < n and a[at : at + TURN] == b[at : at + TURN]:
        at += TURN
    return at // TURN


def _shard_parts(sequences: Iterable[tuple[bytes, list[int], int]], skeleton: Skeleton) -> Iterator[tuple]:
    """Rows of PART from one shard's sequences in order of (path, conv). Open nodes are those of one path."""
    stack, before = [_Node(0, 0)], b""
    for path, words, conv in sequences:
        common = _shared_turns(before, path) if path != before else len(path) // TURN
        while len(stack) - 1 > common:
            yield from _closed(stack)
        for depth in range(common, len(path) // TURN):
            above = stack[-1].skeleton
            digest = path[depth * TURN : (depth + 1) * TURN]
            stack.append(_Node(None if above is None else skeleton.children.get((above, digest)), words[depth]))
        top, before = stack[-1], path
        top.convs += 1
        top.conv = conv if top.conv is None else min(top.conv, conv)
        if top.skeleton is not None:
            yield END, top.skeleton, conv, *[None] * 8
        elif top.ends is None:
            top.ends = hashlib.sha256(b"%d" % conv)
        else:
            top.ends.update(b",%d" % conv)
    while stack:
        yield from _closed(stack)


def _finish_shards(shared, schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            stream = streamed(batches, ["shard", "path", "words", "conv_id"])
            for _, own in groupby(stream, key=lambda r: r[0]):
                yield from _shard_parts((r[1:] for r in own), shared.value)

        return written(rows(), schema)

    return run


def _hash_ends(schema):
    def run(batches):
        def rows():
            for node, own in groupby(streamed(batches, ["skeleton", "conv_id"]), key=lambda r: r[0]):
                total = hashlib.sha256()
                for i, (_, conv) in enumerate(own):
                    total.update((b",%d" if i else b"%d") % conv)
                yield node, total.hexdigest()

        return written(rows(), schema)

    return run


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences (conv_id, path, words).

    ``path`` holds TURN bytes for each turn and ``words`` a number for each; conv_id is distinct and not null.

    Splitters of (path, conv_id) deal the sequences out to shards. A node whose members lie in more than one
    shard is a prefix of a splitter between them. So a shard, sorted and read as a stream, finishes
    every node that is not on a splitter path, and adds up its share of those that are: the
    skeleton, which is broadcast. The shares are summed by node; sums over a subtree that count
    skeleton nodes themselves follow from their preorder numbers. Equal sequences are cut by id like others, so no
    group of copies is one task. Open at once are the nodes of one path.

    An empty table gives no rows.
    """
    spark = sequences.sparkSession
    shards = max(1, min(MOST_SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    skeleton = Skeleton(_sequence_splitters(sequences, shards))
    shared = spark.sparkContext.broadcast(skeleton)

    @F.pandas_udf("int")
    def shard(path: pd.Series, conv: pd.Series) -> pd.Series:
        return pd.Series([shared.value.shard(bytes(p), c) for p, c in zip(path, conv, strict=True)], dtype="int32")

    dealt = sequences.withColumn("shard", shard("path", "conv_id")).repartition(shards, "shard").sortWithinPartitions("shard", "path", "conv_id")
    parts = dealt.mapInArrow(_finish_shards(shared, arrow_schema(spark, PART)), PART)
    parts = materialise(parts, "trie-parts")

    ends = parts.where(F.col("kind") == END).select("skeleton", "conv_id").repartition("skeleton").sortWithinPartitions("skeleton", "conv_id")
    hashed = ends.mapInArrow(_hash_ends(arrow_schema(spark, "skeleton int, ends string")), "skeleton int, ends string")
    summed = parts.where(F.col("kind") == PARTIAL).groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("words").alias("words"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    shape = spark.createDataFrame(list(zip(range(len(skeleton.parents)), skeleton.parents, skeleton.lasts, strict=True)), "skeleton int, parent int, last int")
    # All that follows is as long as the skeleton.
    inner = shape.where("parent >= 0").groupBy(F.col("parent").alias("skeleton")).agg(F.count(F.lit(1)).alias("inner"))
    nodes = summed.join(shape, "skeleton").join(inner, "skeleton", "left").withColumn("n_children", F.col("n_children") + F.coalesce("inner", F.lit(0)))
    nodes = nodes.withColumn("own_saved", (F.col("n_convs") - 1) * F.col("words")).withColumn("own_leaf", (F.col("n_children") == 0).cast("bigint"))
    running = Window.orderBy("skeleton").rowsBetween(Window.unboundedPreceding, 0)
    nodes = materialise(nodes.select("*", *[F.sum(f"own_{c}").over(running).alias(f"until_{c}") for c in ("saved", "leaf")]), "trie-skeleton")
    until = nodes.select(F.col("skeleton").alias("last"), F.col("until_saved").alias("saved_to"), F.col("until_leaf").alias("leaf_to"))
    above = nodes.select(F.col("skeleton").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    through = nodes.join(F.broadcast(until), "last").join(F.broadcast(above), "parent", "left").join(hashed, "skeleton", "left")
    kept = parts.where(F.col("kind") == NODE)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    through = through.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("n_leaves") + F.col("leaf_to") - F.col("until_leaf") + F.col("own_leaf")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("saved_to") - F.col("until_saved") + F.col("own_saved")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
    found = above.withColumnRenamed("parent", "skeleton").withColumnRenamed("parent_conv_id", "above")
    local = kept.join(F.broadcast(found), "skeleton", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return local.select(*columns).unionByName(through.select(*columns))


# --- sequences of conversations -------------------------------------------------------


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, n_words) of every turn, places from 0.

    Turns go by their number, missing ones first, then by digest. A missing role or text is empty; rows
    without an id belong to no conversation and are left out. Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    bare = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    words = F.when(bare == "", 0).otherwise(F.size(F.split(bare, " +")))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.md5(name).alias("digest"), words.alias("n_words"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "digest")) - 1
    return turns.select("conv_id", place.alias("place"), "digest", "n_words")


def sequences_of(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, path, words) of every id in ``ids``, also of those without turns in ``turns``.

    One conversation is one value of 20 bytes a turn: a conversation of some tens of millions of turns would
    outgrow a task.
    """
    none = ids.select("conv_id", F.lit(-1).alias("place"), F.lit("").alias("digest"), F.lit(0).alias("n_words"))
    held = F.array_sort(F.collect_list(F.struct("place", "digest", "n_words")))
    every = turns.unionByName(none).groupBy("conv_id").agg(held.alias("turns"))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    words = F.slice(F.transform("turns", lambda t: t["n_words"]), F.lit(2), F.size("turns"))
    return every.select("conv_id", path.alias("path"), words.alias("words"))


def _borrowed(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % 4


def rebuilt(turns: DataFrame) -> DataFrame:
    """Sequences of the registered query: each conversation begins with turns of the one at the last multiple of 20."""
    turns = materialise(turns, "trie-turns")
    ids = turns.where("place = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), _borrowed(F.col("conv_id")).alias("h"))
    heads = turns.where("conv_id % 20 = 0 AND place < 3").select(F.col("conv_id").alias("base"), "place", "digest", "n_words")
    first = ids.where("h > 0").join(heads, "base").where("place < h").select("conv_id", "place", "digest", "n_words")
    rest = turns.where(F.col("place") >= _borrowed(F.col("conv_id")))
    return sequences_of(first.unionByName(rest), ids)


def digest(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, one row per node."""
    return prefix_trie(materialise(rebuilt(numbered_turns(conversations)), "trie-sequences"))


SQL = rf"""WITH {SQL_CRC_TABLE},
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id AS c, {sql_crc("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
rebuilt AS (SELECT c, place, digest, text FROM ids JOIN turns ON conv_id = c - c % 20 AND place < h
    UNION ALL SELECT c, place, digest, text FROM ids JOIN turns ON conv_id = c AND place >= h),
paths AS (SELECT c, coalesce(string_agg(digest, '' ORDER BY place), '') AS path, list(len({sql_words("text")}) ORDER BY place) AS words, count(digest) AS n
    FROM ids LEFT JOIN rebuilt USING (c) GROUP BY c),
steps AS (SELECT c, n, words, path, unnest(range(n + 1)) AS depth FROM paths),
nodes AS (SELECT left(path, 32 * depth) AS prefix, depth, min(c) AS conv_id, count(*) AS n_convs, max(CASE WHEN depth > 0 THEN words[depth] ELSE 0 END) AS w,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256 FROM steps GROUP BY ALL),
counted AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND left(k.prefix, 32 * n.depth) = n.prefix) AS n_children
    FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = left(n.prefix, 32 * p.depth)),
below AS (SELECT left(prefix, 32 * up) AS prefix, sum((n_convs - 1) * w) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
    FROM (SELECT *, unnest(range(depth + 1)) AS up FROM counted) GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM counted JOIN below USING (prefix)"""
