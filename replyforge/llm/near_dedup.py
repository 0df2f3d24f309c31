"""Near-duplicate documents by SetSketch registers: banding, joint likelihood, exact check, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyforge.llm.common import free_names
from replyforge.llm.components import connected_components
from replyforge.llm.repeats import LAST_ID, keyed
from replyforge.llm.words import WordTable, mix, portions, text_bytes
from replyforge.session import materialise

# Registers hold truncated logarithms of minima to this base; near 1 they keep more of each minimum.
REGISTER_BASE = 1.2
BANDS, BAND_REGISTERS = 48, 7
REGISTERS = BANDS * BAND_REGISTERS
OFFSET = 20
# Estimates this far below the threshold still go to the exact check: more than five standard deviations.
MARGIN = 0.13
# Sets that can only be linked with an equal set have no registers.
SMALL = 3
# Buckets up to this size are compared by a join; a row meets no more than these.
MOST_PAIRED = 32
BLOCK_MEMBERS = 2000
STEP = np.uint64(0x9E3779B97F4A7C15)
LOW_64 = (1 << 64) - 1


@dataclass(frozen=True)
class Likeness:
    """Shingle length in words, and the percentage of the union that two sets must share."""

    words: int = 5
    percent: int = 80


class Shingles:
    """Distinct shingle hashes of a batch of texts: ``values`` by text, from ``starts``."""

    def __init__(self, texts: list[bytes], k: int):
        # bytes.lower() changes A-Z alone.
        table = WordTable([t.lower() for t in texts])
        words, starts = table.hashes(), table.starts
        counts = np.diff(starts)
        chain = words.copy()
        for j in range(1, k):
            chain[: len(words) - j] = mix(chain[: len(words) - j] * STEP + words[j:])
        owner = np.repeat(np.arange(len(texts)), counts)
        whole = np.arange(len(words)) + k <= starts[1:][owner]
        value, owner = chain[whole], owner[whole]
        # A text shorter than a shingle is one shingle of all its words.
        for i in np.flatnonzero((counts > 0) & (counts < k)):
            own = words[starts[i] : starts[i + 1]]
            one = own[:1]
            for w in own[1:]:
                one = mix(one * STEP + w)
            value, owner = np.append(value, one), np.append(owner, i)
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        self.values, self.owner = value[new], owner[new]
        self.sizes = np.bincount(self.owner, minlength=len(texts))
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))

    def names(self) -> list[bytes]:
        """128 bits that name the set of each text: sums do not depend on the order."""
        out = []
        for salt in (1, 2):
            sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(self.values + np.uint64(salt * int(STEP) & LOW_64)), dtype=np.uint64)))
            out.append(mix(sums[self.starts[1:]] - sums[self.starts[:-1]] + self.sizes.astype(np.uint64)))
        return [a.tobytes() + b.tobytes() for a, b in zip(*out, strict=True)]


def registers(shingles: Shingles) -> np.ndarray:
    """SetSketch registers, a row of REGISTERS bytes for each text; zero for sets of SMALL or fewer.

    Each element throws points at growing distances (exponential spacings), every point at a random
    register; a register keeps the smallest distance, as the whole part of its logarithm. Distances
    that can no longer lower a register are not made: beyond a bound every register is full.
    """
    n = len(shingles.sizes)
    lowest = np.full(n * REGISTERS, np.inf)
    use = shingles.sizes > SMALL
    bound = np.where(use, (math.log(REGISTERS) + 6) / np.maximum(shingles.sizes, 1), 0.0)
    at = np.flatnonzero(use[shingles.owner])
    value, owner = shingles.values[at], shingles.owner[at]
    waiting: list[tuple[np.ndarray, ...]] = []
    distance, turn = np.zeros(len(at)), np.zeros(len(at), np.uint64)
    while True:
        while len(value):
            draw = mix(value + turn * STEP)
            turn = turn + np.uint64(1)
            distance = distance - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / REGISTERS
            register = (mix(draw) % np.uint64(REGISTERS)).astype(np.int64)
            near = distance <= bound[owner]
            np.minimum.at(lowest, owner[near] * REGISTERS + register[near], distance[near])
            # An element beyond the bound waits with its next point, in case the bound must grow.
            waiting.append((value[~near], owner[~near], distance[~near], turn[~near], register[~near]))
            value, owner, distance, turn = value[near], owner[near], distance[near], turn[near]
        open_ = np.isinf(lowest.reshape(n, REGISTERS)).any(axis=1) & use
        if not open_.any():
            break
        bound[open_] *= 1.5
        value, owner, distance, turn, register = (np.concatenate(x) for x in zip(*waiting, strict=True))
        mine = open_[owner]
        value, owner, distance, turn, register = value[mine], owner[mine], distance[mine], turn[mine], register[mine]
        near = distance <= bound[owner]
        np.minimum.at(lowest, owner[near] * REGISTERS + register[near], distance[near])
        waiting = [(value[~near], owner[~near], distance[~near], turn[~near], register[~near])]
        value, owner, distance, turn = value[near], owner[near], distance[near], turn[near]
    full = np.where(np.isinf(lowest), 1.0, lowest)
    whole = np.clip(np.floor(1 - np.log(full) / math.log(REGISTER_BASE)) + OFFSET, 0, 255)
    return np.where(np.isinf(lowest), 0, whole).astype(np.uint8).reshape(n, REGISTERS)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A hash of each band of registers, the band's number included."""
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(regs), 1))
    parts = regs.reshape(len(regs), BANDS, BAND_REGISTERS).astype(np.uint64)
    for j in range(BAND_REGISTERS):
        key = mix(key * STEP + parts[:, :, j])
    return key.view(np.int64)


def likely(n_a: np.ndarray, regs_a: np.ndarray, n_b: np.ndarray, regs_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of each pair, from its counts of larger, smaller and equal registers."""
    more, less = (regs_a > regs_b).sum(axis=1), (regs_a < regs_b).sum(axis=1)
    same = REGISTERS - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    chance = lambda x: -np.log(1 - np.maximum(x, 0) * (REGISTER_BASE - 1) / REGISTER_BASE) / math.log(REGISTER_BASE)
    p, q = chance(u - v * j), chance(v - u * j)
    tiny = 1e-12
    fit = more[:, None] * np.log(p + tiny) + less[:, None] * np.log(q + tiny) + same[:, None] * np.log(np.maximum(1 - p - q, tiny))
    return j[np.arange(len(j)), fit.argmax(axis=1)]


def least_same(j: float) -> float:
    """Six standard deviations below the equal registers to expect of two sets with similarity ``j``."""
    chance = -math.log(1 - (1 - j) / 2 * (REGISTER_BASE - 1) / REGISTER_BASE) / math.log(REGISTER_BASE)
    same = 1 - 2 * chance
    return REGISTERS * same - 6 * math.sqrt(REGISTERS * same * (1 - same))


SKETCHED = "id bigint, fp bigint, n int, node binary, bands array<bigint>, regs binary"


def _sketcher(k: int):
    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in portions(frames):
            shingles = Shingles([text_bytes(t) for t in part["text"]], k)
            regs = registers(shingles)
            bands = list(band_keys(regs))
            for i in np.flatnonzero(shingles.sizes <= SMALL):
                bands[i] = np.zeros(0, np.int64)
            yield pd.DataFrame(
                {
                    "id": part["id"],
                    "fp": part["fp"],
                    "n": shingles.sizes.astype(np.int32),
                    "node": shingles.names(),
                    "bands": bands,
                    "regs": [r.tobytes() for r in regs],
                }
            )

    return sketch


def _set_maker(k: int):
    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in portions(frames):
            s = Shingles([text_bytes(t) for t in part["text"]], k)
            own = [s.values[a:b].view(np.int64) for a, b in zip(s.starts[:-1], s.starts[1:], strict=True)]
            yield pd.DataFrame({"nid": part["nid"], "shingles": own})

    return sets


def _estimator(least: float):
    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                table = lambda c: np.frombuffer(b"".join(f[c]), np.uint8).reshape(len(f), REGISTERS)  # noqa: B023, E731
                guess = likely(f["n_a"].to_numpy(float), table("regs_a"), f["n_b"].to_numpy(float), table("regs_b"))
                yield f.loc[guess >= least, ["a", "b"]]

    return near


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, like: Likeness) -> DataFrame:
    """The ``pairs`` (a, b) of nodes that are linked: likely by their registers, then sure by their sets."""
    side = lambda s: nodes.select(F.col("nid").alias(s), F.col("n").alias("n_" + s), F.col("regs").alias("regs_" + s))
    fits = 100 * F.least("n_a", "n_b") >= like.percent * F.greatest("n_a", "n_b")
    probable = materialise(
        pairs.join(side("a"), "a").join(side("b"), "b").where(fits)
        .mapInPandas(_estimator(like.percent / 100 - MARGIN), "a bigint, b bigint"),
        "near-probable",
    )
    asked = probable.select(F.col("a").alias("nid")).union(probable.select("b")).distinct()
    texts = rows.select("id", "fp", "text").join(nodes.select("nid", "id", "fp").join(asked, "nid"), ["id", "fp"])
    sets = texts.dropDuplicates(["nid"]).select("nid", "text").mapInPandas(_set_maker(like.words), "nid bigint, shingles array<bigint>")
    sets = materialise(sets, "near-sets")
    side = lambda s: sets.select(F.col("nid").alias(s), F.col("shingles").alias("set_" + s))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    linked = probable.join(side("a"), "a").join(side("b"), "b").where(100 * shared >= like.percent * union)
    return materialise(linked.select("a", "b"), "near-links")


def _links(nodes: DataFrame, rows: DataFrame, like: Likeness) -> DataFrame:
    """Links that join all nodes reachable from one another, from the bands that nodes share.

    Every node of a bucket is compared with the bucket's first, which joins most of a group. Wherever a
    bucket then still holds several components, its members are compared across components, so no
    pair of a bucket that could join two is left out. Members of small buckets meet in a join, those of
    large ones in blocks, where only links leave the task.
    """
    places = nodes.where(F.col("n") > SMALL).select("nid", F.explode("bands").alias("band"))
    firsts = places.groupBy("band").agg(F.min("nid").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = materialise(places.join(firsts, "band").select("band", "nid", "a"), "near-buckets")
    pairs = buckets.where("a <> nid").select("a", F.col("nid").alias("b")).distinct()
    links = _verified(pairs, nodes, rows, like)
    components = materialise(connected_components(links).withColumnRenamed("node", "nid"), "near-first")
    named = buckets.join(components, "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    mixed = named.groupBy("band").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")
    )
    mixed = mixed.where("low < high").select("band", "size")
    # The first of a bucket is compared with all others already.
    open_ = materialise(named.where("a <> nid").join(mixed, "band").select("band", "size", "nid", "component"), "near-open")
    few = open_.where(F.col("size") <= MOST_PAIRED)
    one = few.select("band", F.col("nid").alias("a"), F.col("component").alias("ca"))
    other = few.select("band", F.col("nid").alias("b"), F.col("component").alias("cb"))
    across = one.join(other, "band").where("ca < cb").select("a", "b").distinct()
    links = links.unionByName(_verified(across, nodes, rows, like))
    return links.unionByName(_block_links(open_.where(F.col("size") > MOST_PAIRED), nodes, rows, like))


MEMBER = "band bigint, low int, high int, block int, nid bigint, component bigint, n int, regs binary, shingles array<bigint>"


def _block_links(members: DataFrame, nodes: DataFrame, rows: DataFrame, like: Likeness) -> DataFrame:
    """Links (a, b) across components inside large buckets.

    A bucket is cut into blocks of about ``BLOCK_MEMBERS``; each pair of blocks is one group, so a
    bucket with a third of all rows is spread over many tasks and none holds more than two blocks.
    """
    asked = materialise(members.select("nid").distinct(), "near-asked")
    texts = rows.select("id", "fp", "text").join(nodes.select("nid", "id", "fp").join(asked, "nid"), ["id", "fp"])
    sets = texts.dropDuplicates(["nid"]).select("nid", "text").mapInPandas(_set_maker(like.words), "nid bigint, shingles array<bigint>")
    full = nodes.select("nid", "n", "regs").join(sets, "nid")
    blocks = F.ceil(F.col("size") / BLOCK_MEMBERS).cast("int")
    dealt = (
        members.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("band", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "nid", "component")
    )
    wide = dealt.join(full, "nid").select(*[c.split()[0] for c in MEMBER.split(", ")])
    found = wide.groupBy("band", "low", "high").applyInPandas(_block_comparer(like.percent), "a bigint, b bigint")
    return materialise(found.distinct(), "near-block-links")


def _block_comparer(percent: int):
    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        """Links that join components, each joining two that no earlier one has joined."""
        k = len(frame)
        n, block = frame["n"].to_numpy(np.int64), frame["block"].to_numpy()
        between = frame["low"].iloc[0] != frame["high"].iloc[0]
        regs = np.frombuffer(b"".join(frame["regs"]), np.uint8).reshape(k, REGISTERS)
        # A bit for each shingle that two members have.
        owner = np.repeat(np.arange(k), n)
        values, column, counts = np.unique(np.concatenate(list(frame["shingles"])), return_inverse=True, return_counts=True)
        shared = counts > 1
        number = np.cumsum(shared) - 1
        used = shared[column]
        width = -(-int(shared.sum()) // 64) * 8
        bits = np.zeros((k, width), np.uint8)
        at = number[column[used]]
        np.bitwise_or.at(bits, (owner[used], at >> 3), np.left_shift(1, at & 7).astype(np.uint8))
        bits = bits.view(np.uint64)
        names, group = np.unique(frame["component"].to_numpy(), return_inverse=True)
        nid = frame["nid"].to_numpy()
        out = []
        for i in range(k):
            js = np.arange(i + 1, k)
            fits = (group[js] != group[i]) & (100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i]))
            js = js[fits & (block[js] != block[i])] if between else js[fits]
            if len(js) == 0:
                continue
            # Far too few equal registers: no need to look at the sets.
            js = js[(regs[js] == regs[i]).sum(axis=1) >= least_same(percent / 100)]
            both = np.bitwise_count(bits[i] & bits[js]).sum(axis=1, dtype=np.int64)
            for j in js[100 * both >= percent * (n[i] + n[js] - both)]:
                if group[j] != group[i]:
                    out.append((min(nid[i], nid[j]), max(nid[i], nid[j])))
                    group[group == group[j]] = group[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return compare


def near_groups(docs: DataFrame, like: Likeness | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, fp, n_shingles, component_id, kept).

    Texts are lower-cased in A-Z and cut at ASCII white space; a document's set holds its distinct
    shingles of ``like.words`` words, or all its words as one shingle when it has fewer. Documents whose
    sets share ``like.percent`` of their union or more are linked; ``component_id`` is the smallest
    doc_id that links lead to, and the document with it is kept.

    Equal sets are one node from the start, so thousands of copies cost one. Candidates come from
    ``BANDS`` bands of ``BAND_REGISTERS`` registers: a pair exactly at 0.8 is missed with a chance of
    about 2 in a million, a nearer one less often. Registers give the most likely similarity from the
    exact set sizes; pairs not clearly below the threshold are checked on the full sets.

    A text without words (null, empty, blank) has an empty set, is linked with nothing and kept. Rows
    equal in id and text are one document. A missing id is the largest and stays missing. An empty
    table gives no rows. Further columns are not read.
    """
    return _grouped(docs, like or Likeness(), id_col, text_col).select(
        "doc_id",
        "fp",
        F.col("n").cast("bigint").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _grouped(docs: DataFrame, like: Likeness, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, id, fp, n, component_id, first): ``first`` is the (id, fp) of the component's first document."""
    rows = keyed(docs, id_col, text_col)
    sketched = materialise(rows.select("id", "fp", "text").mapInPandas(_sketcher(like.words), SKETCHED), "near-sketches")
    first = sketched.where("n > 0").groupBy("node").agg(F.min(F.struct("id", "fp")).alias("first"))
    nodes = (
        sketched.join(first, "node")
        .where(F.struct("id", "fp") == F.col("first"))
        .dropDuplicates(["node"])
        .select(F.monotonically_increasing_id().alias("nid"), "node", "id", "fp", "n", "bands", "regs")
    )
    nodes = materialise(nodes, "near-nodes")
    components = connected_components(_links(nodes, rows, like))
    # The first document of a component, then of each node, then of each row.
    joined = nodes.select("nid", "node", "id", "fp").join(components.withColumnRenamed("node", "nid"), "nid", "left")
    joined = joined.withColumn("component", F.coalesce("component", "nid"))
    heads = joined.groupBy("component").agg(F.min(F.struct("id", "fp")).alias("first"))
    by_node = joined.select("node", "component").join(heads, "component").select("node", "first")
    return sketched.select("id", "fp", "n", "node").join(by_node, "node", "left").select(
        _missing(F.col("id")).alias("doc_id"),
        "id",
        "fp",
        "n",
        _missing(F.when(F.col("n") > 0, F.col("first.id")).otherwise(F.col("id"))).alias("component_id"),
        F.when(F.col("n") > 0, F.col("first")).otherwise(F.struct("id", "fp")).alias("first"),
    )


def _missing(id_: Column) -> Column:
    return F.when(id_ != LAST_ID, id_)


def keep_one(docs: DataFrame, like: Likeness | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that come first in their component, all columns as they are; of repeated rows one.

    Rows without words all stay.
    """
    grouped = _grouped(docs, like or Likeness(), id_col, text_col)
    i, f, n, key_id, key_fp = free_names(docs, "id", "fp", "n", "key_id", "key_fp")
    stay = grouped.where(F.struct("id", "fp") == F.col("first")).select(F.col("id").alias(i), F.col("fp").alias(f), F.col("n").alias(n))
    stay = stay.dropDuplicates([i, f])
    keys = docs.withColumns({key_id: F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID)), key_fp: F.xxhash64(text_col)})
    kept = keys.join(stay, (F.col(key_id) == F.col(i)) & (F.col(key_fp) == F.col(f)))
    # Of rows with words that share id and text one stays; dropDuplicates leaves the others alone.
    bare = kept.where(F.col(n) == 0)
    worded = kept.where(F.col(n) > 0).dropDuplicates([key_id, key_fp])
    return worded.unionByName(bare).select(*[F.col(c) for c in docs.columns])
