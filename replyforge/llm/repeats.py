"""Anchored blocks: an exact way to find repeated windows without a row for each window.

A window is a fixed number of consecutive symbols (bytes or words) of one document. Inside each window
one short run of symbols, the one with the smallest hash, is its anchor. Equal windows have equal
anchors at equal distances, wherever they stand. Neighbouring windows mostly share their anchor; those
of one anchor form a block. So

* a window can only be repeated if the hash of its anchor occurs at two places,
* windows of blocks that are equal as a whole, anchor place included, are repeated together,
* only where blocks share an anchor but differ must single windows be compared.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyforge.llm.common import chosen
from replyforge.llm.words import WordTable, mix, portions, text_bytes
from replyforge.session import materialise, small_batches

# Odd multipliers of the two polynomial hashes and their inverses modulo 2**64.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(m, -1, 1 << 64) for m in MULTIPLIERS)
LAST_ID = (1 << 63) - 1
# Characters at once: each symbol takes up to 200 bytes while blocks are found.
SYMBOL_BATCH = 250_000
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1), kept for the next batch."""
    if len(_powers.get(base, ())) < n:
        factors = np.full(n, np.uint64(base))
        factors[:1] = 1
        _powers[base] = np.cumprod(factors, dtype=np.uint64)
    return _powers[base][:n]


class Rolling:
    """Hash of any stretch of a symbol array, in constant time each; equal stretches have equal hashes."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        self.base, self.inverse = MULTIPLIERS[which], INVERSES[which]
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * _power(self.base, len(symbols)), out=self.sums[1:])

    def of(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        return (self.sums[starts + lengths] - self.sums[starts]) * _power(self.inverse, len(self.sums))[starts]

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * _power(self.inverse, len(self.sums))[:n]


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, in about log2(width) passes."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


class Blocks:
    """Blocks of a batch of documents whose symbols stand one after the other.

    ``doc`` is a block's document, ``low`` its first window (in that document) and ``n`` how many
    windows it has; ``gram`` is the hash of its anchor, ``x1`` and ``x2`` those of all its symbols.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray, starts: np.ndarray, window: int, gram: int):
        empty = np.zeros(0, np.int64)
        self.doc = self.low = self.n = empty
        self.gram = self.x1 = self.x2 = empty.astype(np.uint64)
        if len(first) < window:
            return
        one, two = Rolling(first, 0), Rolling(second, 1)
        grams = mix(one.grams(gram))
        # Hash and place in one number: the minimum is the anchor, the leftmost of equal hashes.
        order = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
        anchor = (sliding_minimum(order, window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # Windows that reach into the next document do not count.
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(anchor)]
        inside = np.arange(len(anchor)) + window <= starts[1:][owner]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1] | (owner[1:] != owner[:-1])
        low = np.flatnonzero(new & inside)
        last = np.ones(len(anchor), bool)
        last[:-1] = new[1:] | ~inside[1:]
        high = np.flatnonzero(last & inside)
        self.doc, self.n = owner[low], high - low + 1
        self.low = low - starts[self.doc]
        at = anchor[low]
        self.gram = grams[at]
        length = self.n + window - 1
        shape = mix(((at - low).astype(np.uint64) << np.uint64(32)) ^ length.astype(np.uint64))
        self.x1 = mix(one.of(low, length) ^ shape)
        self.x2 = mix(two.of(low, length) + shape)


# --- symbols --------------------------------------------------------------------------

_random = np.random.Generator(np.random.PCG64(20_240_229))
BYTE_CODES = _random.integers(0, 1 << 64, size=(2, 256), dtype=np.uint64)


def byte_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two random codes for every byte of the texts, and where each text starts."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    return BYTE_CODES[0][raw], BYTE_CODES[1][raw], starts


def word_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes for every word of the texts, and where each text starts."""
    table = WordTable(texts)
    return table.hashes(0), table.hashes(1), table.starts


Symbols = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Scheme:
    """What is a symbol, how many make a window, and how many an anchor."""

    symbols: Symbols
    window: int
    gram: int

    def blocks(self, texts: list[bytes]) -> Blocks:
        return Blocks(*self.symbols(texts), self.window, self.gram)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, id, fp, text): ``id`` is the doc_id, a missing one the largest, for use in Arrow batches."""
    return chosen(docs, id_col=id_col, text_col=text_col).withColumn("id", F.coalesce("doc_id", F.lit(LAST_ID)))


# --- count-min sketch of anchors ------------------------------------------------------

CELL_BITS = 27
BLOCK_BITS = 21
ROWS = 2


def cells(grams: np.ndarray) -> list[np.ndarray]:
    """The cell of each hash in each row of the sketch."""
    shift = np.uint64(64 - CELL_BITS)
    return [(mix(grams + np.uint64(r)) >> shift).astype(np.int64) + (r << CELL_BITS) for r in range(ROWS)]


def _parts(once: np.ndarray, more: np.ndarray) -> pd.DataFrame:
    """Sorted cells seen once and seen more often, cut into blocks of the sketch."""
    rows = []
    for block in np.unique(np.concatenate((once, more)) >> BLOCK_BITS):
        low, high = block << BLOCK_BITS, (block + 1) << BLOCK_BITS
        own = [(a[np.searchsorted(a, low) : np.searchsorted(a, high)] - low).astype(np.uint32).tobytes() for a in (once, more)]
        rows.append((int(block), *own))
    return pd.DataFrame(rows, columns=["block", "once", "more"])


def _sketcher(scheme: Scheme):
    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The sketch of one partition, which holds only the cells it met: counts above one are one number."""
        found = [b.gram for part in portions(frames, most=SYMBOL_BATCH) if len((b := scheme.blocks([text_bytes(t) for t in part["text"]])).gram)]
        if found:
            met, counts = np.unique(np.concatenate(cells(np.concatenate(found))), return_counts=True)
            yield _parts(met[counts == 1], met[counts > 1])

    return sketch


def _merged(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cells of one block seen once and seen more often, over all parts of it."""
    once = np.frombuffer(b"".join(frame["once"]), np.uint32)
    more = np.unique(np.frombuffer(b"".join(frame["more"]), np.uint32))
    met, counts = np.unique(once, return_counts=True)
    more = np.union1d(more, met[counts > 1])
    return np.setdiff1d(met[counts == 1], more, assume_unique=True), more


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    """Sum of sketches of one block, still with all counts above one as one number."""
    once, more = _merged(frame)
    return pd.DataFrame({"block": frame["block"].iloc[:1], "once": [once.tobytes()], "more": [more.tobytes()]})


def _bits(frame: pd.DataFrame) -> pd.DataFrame:
    """The block's cells above one as one bit a cell."""
    bits = np.zeros(1 << BLOCK_BITS, np.uint8)
    bits[_merged(frame)[1]] = 1
    return pd.DataFrame({"block": frame["block"].iloc[:1], "bits": [zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)]})


class Sketch:
    """Which cells of the merged sketch are above one: a bit each, 32 MB whatever the data."""

    def __init__(self, rows: list):
        self.packed = {r["block"]: bytes(r["bits"]) for r in rows}
        self._bits: np.ndarray | None = None

    def maybe_repeated(self, grams: np.ndarray) -> np.ndarray:
        """False only for a hash that occurs once: the smallest of its counts is one."""
        if self._bits is None:
            size = (1 << BLOCK_BITS) >> 3
            self._bits = np.zeros((ROWS << CELL_BITS) >> 3, np.uint8)
            for block, packed in self.packed.items():
                self._bits[block * size : (block + 1) * size] = np.frombuffer(zlib.decompress(packed), np.uint8)
        hits = [(self._bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 for at in cells(grams)]
        return reduce(np.logical_and, hits, np.ones(len(grams), bool))

    def __getstate__(self):
        return {"packed": self.packed, "_bits": None}


def count_min(rows: DataFrame, scheme: Scheme) -> Broadcast:
    """Count-min sketch of all anchors of ``rows``, merged from the sketches of the partitions.

    Sketches are merged by block of cells and in two steps, so that no task sees those of all
    partitions. The driver gets the bits of the cells above one by block of cells, 32 MB at most.
    """
    merged = "block int, once binary, more binary"
    parts = rows.select("text").mapInPandas(_sketcher(scheme), merged)
    share = max(1, int(rows.rdd.getNumPartitions() ** 0.5))
    parts = parts.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(share)))
    first = parts.groupBy("block", "share").applyInPandas(_merge, merged)
    last = first.groupBy("block").applyInPandas(_bits, "block int, bits binary")
    return rows.sparkSession.sparkContext.broadcast(Sketch(last.collect()))


# --- blocks, classes ------------------------------------------------------------------

BLOCK_ROWS = "id bigint, fp bigint, low int, n int, gram bigint, x1 bigint, x2 bigint"


def _finder(scheme: Scheme, sketch: Broadcast):
    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in portions(frames, most=SYMBOL_BATCH):
            b = scheme.blocks([text_bytes(t) for t in part["text"]])
            keep = sketch.value.maybe_repeated(b.gram)
            yield pd.DataFrame(
                {
                    "id": part["id"].to_numpy()[b.doc[keep]],
                    "fp": part["fp"].to_numpy()[b.doc[keep]],
                    "low": b.low[keep].astype(np.int32),
                    "n": b.n[keep].astype(np.int32),
                    "gram": b.gram[keep].view(np.int64),
                    "x1": b.x1[keep].view(np.int64),
                    "x2": b.x2[keep].view(np.int64),
                }
            )

    return find


def candidate_blocks(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """Blocks of ``rows`` (id, fp, text) whose anchor the sketch counts more than once; loses none that is repeated."""
    with small_batches(rows.sparkSession):
        found = rows.select("id", "fp", "text").mapInPandas(_finder(scheme, count_min(rows, scheme)), BLOCK_ROWS)
        return materialise(found, "repeat-blocks")


def place(*columns: str) -> Column:
    return F.struct(*columns)


def block_classes(blocks: DataFrame) -> DataFrame:
    """Classes of equal blocks: (gram, x1, x2, n, first, last).

    ``first`` and ``last`` are the smallest and largest place (id, fp, low), the same for a block that
    stands once.
    """
    where = place("id", "fp", "low")
    classes = blocks.groupBy("gram", "x1", "x2").agg(F.max("n").alias("n"), F.min(where).alias("first"), F.max(where).alias("last"))
    return materialise(classes, "repeat-classes")


def mixed_classes(classes: DataFrame) -> DataFrame:
    """``classes`` whose anchor has several, with their number and how many of them stand once (``single``).

    Written without the hashes; anchors with one class need nothing more.
    """
    once = F.col("first") == F.col("last")
    grams = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("classes"), F.count(F.when(once, 1)).alias("single"))
    found = classes.join(grams.where("classes > 1"), "gram")
    return materialise(found.select("gram", "n", "first", "classes", "single"), "repeat-mixed")


def repeated_blocks(blocks: DataFrame, classes: DataFrame, but_first: bool) -> DataFrame:
    """(id, fp, low, n) of the blocks that stand at another place too, without the first of each class if asked."""
    more = classes.where(F.col("first") != F.col("last")).select("gram", "x1", "x2", "first")
    found = blocks.join(more, ["gram", "x1", "x2"])
    if but_first:
        found = found.where(place("id", "fp", "low") != F.col("first"))
    return found.select("id", "fp", "low", "n")


def per_document(ranges: DataFrame, *more: str) -> DataFrame:
    """(id, fp, low, n, further columns): the distinct rows of each document as one array a column, as many as its length allows.

    Plain arrays of numbers reach Python as numpy arrays; an array of rows would be an object a row.
    """
    held = ranges.groupBy("id", "fp").agg(F.collect_set(F.struct("low", "n", *more)).alias("ranges"))
    return held.select("id", "fp", *[F.col(f"ranges.{c}").alias(c) for c in ("low", "n", *more)])


# --- single windows -------------------------------------------------------------------

WINDOW_ROWS = "id bigint, fp bigint, low int, h1 bigint, h2 bigint"


def _windows(scheme: Scheme):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in portions(frames, most=SYMBOL_BATCH):
            first, second, starts = scheme.symbols([text_bytes(t) for t in part["text"]])
            one, two = Rolling(first, 0), Rolling(second, 1)
            doc = np.repeat(np.arange(len(part)), part["low"].map(len))
            low, n = (np.concatenate(part[c].to_list()).astype(np.int64) for c in ("low", "n"))
            # All windows of all ranges, each once.
            at = np.unique(np.repeat(starts[doc] + low - np.cumsum(n) + n, n) + np.arange(n.sum()))
            doc = np.searchsorted(starts, at, "right") - 1
            yield pd.DataFrame(
                {
                    "id": part["id"].to_numpy()[doc],
                    "fp": part["fp"].to_numpy()[doc],
                    "low": (at - starts[doc]).astype(np.int32),
                    "h1": mix(one.of(at, scheme.window)).view(np.int64),
                    "h2": mix(two.of(at, scheme.window)).view(np.int64),
                }
            )

    return rows


def repeated_windows(rows: DataFrame, ranges: DataFrame, scheme: Scheme, but_first: bool) -> DataFrame:
    """(id, fp, low, n = 1) of the windows in ``ranges`` (id, fp, low, n) that stand at another place in them too.

    Windows are grouped exactly, on 128 bits, with the smallest place of each group taken inside the
    tasks first; a window that a third of the corpus holds is one row of each task.
    """
    wanted = rows.select("id", "fp", "text").join(per_document(ranges), ["id", "fp"])
    with small_batches(rows.sparkSession):
        windows = materialise(wanted.mapInPandas(_windows(scheme), WINDOW_ROWS), "repeat-windows")
    where = place("id", "fp", "low")
    groups = windows.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.max(where).alias("last"))
    found = windows.join(groups.where(F.col("first") != F.col("last")), ["h1", "h2"])
    if but_first:
        found = found.where(where != F.col("first"))
    return found.select("id", "fp", "low", F.lit(1).alias("n"))


def covered(low: np.ndarray | None, n: np.ndarray | None, window: int, length: int) -> np.ndarray:
    """Whether each symbol of a text lies in a window of the ranges of ``n`` windows from ``low`` on."""
    if low is None or len(low) == 0:
        return np.zeros(length, bool)
    edges = np.zeros(length + 1, np.int64)
    np.add.at(edges, low, 1)
    np.add.at(edges, low.astype(np.int64) + n + window - 1, -1)
    return np.cumsum(edges[:-1]) > 0
