"""Suffix-array dedup: byte strings that occur at another place are removed, by prefix doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyforge.llm.repeats import (
    BYTE_CODES,
    SYMBOL_BATCH,
    Rolling,
    Scheme,
    block_classes,
    byte_symbols,
    candidate_blocks,
    covered,
    keyed,
    mixed_classes,
    per_document,
    repeated_blocks,
    repeated_windows,
)
from replyforge.llm.words import mix, portions, text_bytes
from replyforge.session import materialise, small_batches

WINDOW_BYTES = 200
ANCHOR_BYTES = 32
FIRST_BYTES = 25
# Anchors with more classes than this are ranked over all tasks, the others each in one.
MOST_CLASSES = 3_000
# Positions ranked at once, at up to 200 bytes each; an anchor with more of them is ranked alone.
MOST_POSITIONS = 400_000

STRETCHES = "gram bigint, id bigint, fp bigint, low int, n int, bytes binary"
KEPT = "doc_id string, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _cut_out(window: int):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The bytes of all windows of each range."""
        for part in portions(frames, most=SYMBOL_BATCH):
            rows = []
            for id_, fp, text, *ranges in zip(*[part[c] for c in ("id", "fp", "text", "gram", "low", "n")], strict=True):
                raw = text_bytes(text)
                rows.extend((gram, id_, fp, low, n, raw[low : low + n + window - 1]) for gram, low, n in zip(*ranges, strict=True))
            yield pd.DataFrame(rows, columns=["gram", "id", "fp", "low", "n", "bytes"])

    return cut


def double(raw: list[bytes], grams: np.ndarray, window: int) -> np.ndarray:
    """Which positions start a string of ``window`` bytes that starts at another position too.

    ``raw`` are stretches one after the other, ``grams`` the anchor of each; strings of different
    anchors are never equal windows and are kept apart. Positions are ranked by their first
    ``FIRST_BYTES`` bytes, then by pairs of ranks at growing offsets, which doubles the length that a
    rank stands for. A position whose rank is its own alone is out for good.
    """
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    end = np.repeat(np.cumsum(lengths), lengths)
    total = len(end)
    size = min(FIRST_BYTES, window)
    at = np.flatnonzero(np.arange(total) + size <= end)
    first = Rolling(BYTE_CODES[0][np.frombuffer(b"".join(raw), np.uint8)]).of(at, size)
    at, rank = _rerank(at, mix(first ^ np.repeat(mix(grams), lengths)[at]), total)
    while size < window:
        step = min(size, window - size)
        at = at[at + step + size <= end[at]]
        # Both halves must have kept a rank.
        at = at[rank[at + step] >= 0]
        at, rank = _rerank(at, (rank[at] << 32) | rank[at + step], total)
        size += step
    starts_repeated = np.zeros(total, bool)
    starts_repeated[at] = True
    return starts_repeated


def _rerank(at: np.ndarray, keys: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose key is not theirs alone, and the rank of every position along the sorted keys, -1 without one."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)
    places = at[order][shared]
    rank = np.full(total, -1, np.int64)
    rank[places] = number[shared]
    return np.sort(places), rank


def whole_anchors(frames: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """The rows of ``frames``, sorted by anchor, in pieces of whole anchors with ``most`` bytes at most; a longer anchor is a piece of its own.

    A stretch that comes twice, from rows equal in id and text, is taken once.
    """
    kept = pd.DataFrame()
    for frame in frames:
        if len(frame) == 0:
            continue
        kept = pd.concat([kept, frame]) if len(kept) else frame
        kept = kept.drop_duplicates(["gram", "id", "fp", "low"], ignore_index=True)
        gram = kept["gram"].to_numpy()
        size = np.fromiter(map(len, kept["bytes"]), np.int64, len(kept)).cumsum()
        # The last anchor may go on in the next frame.
        ends = np.flatnonzero(gram[1:] != gram[:-1]) + 1
        start = 0
        while len(ends):
            floor = size[start - 1] if start else 0
            fit = max(1, int(np.searchsorted(size[ends - 1], floor + most, "right")))
            yield kept.iloc[start : ends[fit - 1]].reset_index(drop=True)
            start, ends = ends[fit - 1], ends[fit:]
        kept = kept.iloc[start:]
    if len(kept):
        yield kept.reset_index(drop=True)


def _doubler(window: int):
    def of(gram: np.ndarray, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raw = list(frame["bytes"])
        hit = double(raw, gram, window)
        edges = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        # Runs of neighbouring positions inside a stretch.
        change = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
        cut = np.zeros(len(hit) + 1, bool)
        cut[edges] = True
        on = np.flatnonzero((change == 1) | (cut & np.append(hit, False) & np.append(False, hit)))
        off = np.flatnonzero((change == -1) | (cut & np.append(hit, False) & np.append(False, hit)))
        owner = np.searchsorted(edges, on, "right") - 1
        yield pd.DataFrame(
            {
                "id": frame["id"].to_numpy()[owner],
                "fp": frame["fp"].to_numpy()[owner],
                "low": (frame["low"].to_numpy()[owner] + on - edges[owner]).astype(np.int32),
                "n": (off - on).astype(np.int32),
            }
        )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Stretches come sorted by anchor; whole anchors are ranked together, many at a time."""
        for whole in whole_anchors(frames, MOST_POSITIONS):
            yield from of(whole["gram"].to_numpy().view(np.uint64), whole)

    return run


def _remover(window: int):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in portions(frames):
            rows = []
            for doc_id, text, low, n in zip(part["doc_id"], part["text"], part["low"], part["n"], strict=True):
                raw = text_bytes(text)
                gone = covered(low, n, window, len(raw))
                if gone.any():
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    rows.append((doc_id, len(raw), int(gone.sum()), spans, kept))
                else:
                    rows.append((doc_id, len(raw), 0, 0, raw))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return cut


def dedup_suffixes(docs: DataFrame, window: int = WINDOW_BYTES, anchor: int = ANCHOR_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_bytes, n_removed, n_spans, kept), ``kept`` in bytes.

    Each byte covered by a string of ``window`` bytes that starts at any other place too is removed,
    also inside one document; the first place is no exception. Strings are judged on the input.

    Ranks grow with the length they stand for. First every window is ranked by its anchor, a run of
    ``anchor`` bytes; those alone under their rank are out (the sketch of :mod:`replyforge.llm.repeats`
    finds most of them before any shuffle). Then blocks of windows around equal anchors are ranked by
    (anchor, all their bytes): blocks equal as a whole are repeated as a whole. Where an anchor still
    has blocks that stand alone, one block of each rank is opened and its positions are ranked by
    prefix doubling, see :func:`double`, in a task that holds the anchor's blocks. Anchors with more
    than ``MOST_CLASSES`` ranks are ranked over all tasks instead, window by window.

    A null text counts as empty. Rows equal in id and text are one document, so they do not remove
    each other. An empty table gives no rows. Further columns are not read.
    """
    scheme = Scheme(byte_symbols, window, anchor)
    rows = keyed(docs, id_col, text_col)
    blocks = candidate_blocks(rows, scheme)
    classes = block_classes(blocks)
    mixed = mixed_classes(classes).where("single > 0").select("gram", "classes", "first.*", "n")
    few = mixed.where(F.col("classes") <= MOST_CLASSES)
    many = materialise(mixed.where(F.col("classes") > MOST_CLASSES).select("id", "fp", "low", "n"), "suffix-hot")
    stretches = rows.select("id", "fp", "text").join(per_document(few, "gram"), ["id", "fp"]).mapInPandas(_cut_out(window), STRETCHES)
    ranked = stretches.repartition("gram").sortWithinPartitions("gram").mapInPandas(
        _doubler(window), "id bigint, fp bigint, low int, n int"
    )
    gone = repeated_blocks(blocks, classes, False).unionByName(ranked)
    if many.limit(1).count():
        gone = gone.unionByName(repeated_windows(rows, many, scheme, False))
    # Written, so that the shuffles that found them are gone before the texts are shuffled.
    with small_batches(docs.sparkSession):
        gone = materialise(per_document(gone), "suffix-gone")
    joined = rows.join(gone, ["id", "fp"], "left")
    out = joined.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "low", "n").mapInPandas(_remover(window), KEPT)
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
