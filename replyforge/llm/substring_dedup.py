"""Substring dedup: word windows that occur earlier in the corpus are removed, found behind a count-min sketch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyforge.llm.repeats import (
    Scheme,
    block_classes,
    candidate_blocks,
    covered,
    keyed,
    mixed_classes,
    per_document,
    repeated_blocks,
    repeated_windows,
    word_symbols,
)
from replyforge.llm.words import portions, text_bytes
from replyforge.session import materialise

WINDOW_WORDS = 20
ANCHOR_WORDS = 8

KEPT = "doc_id string, n_words bigint, n_removed bigint, kept string"


def _cutter(window: int):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in portions(frames):
            rows = []
            for doc_id, text, low, n in zip(part["doc_id"], part["text"], part["low"], part["n"], strict=True):
                words = text_bytes(text).split()
                gone = covered(low, n, window, len(words))
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
                rows.append((doc_id, len(words), int(gone.sum()), b" ".join(kept).decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept"])

    return cut


def dedup_substrings(docs: DataFrame, window: int = WINDOW_WORDS, anchor: int = ANCHOR_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, n_removed, kept); ``kept`` has one blank between words.

    Each word covered by a window of ``window`` words that also starts earlier is removed: in a
    document with a smaller doc_id, or in the same one. Windows are judged on the input.

    First pass: a count-min sketch of the windows' anchors, merged over the partitions. It counts
    too much, never too little, so what it counts once cannot be repeated. Second pass: only windows
    that it counts twice or more are grouped, exactly; those that stay together in blocks as one
    row, see :mod:`replyforge.llm.repeats`. The sketch has a fixed size: on a corpus far beyond
    its 2**27 cells a row it lets more through, which costs shuffle and changes no result.

    A null text counts as empty; texts with fewer words than a window stay whole. Rows equal in id
    and text are one document; rows with one id and different texts follow in the order of a hash of
    their text. A missing id is the largest. An empty table gives no rows. Further columns are not read.
    """
    scheme = Scheme(word_symbols, window, anchor)
    rows = keyed(docs, id_col, text_col)
    blocks = candidate_blocks(rows, scheme)
    classes = block_classes(blocks)
    # Where an anchor has blocks of several classes, one of each is opened.
    mixed = mixed_classes(classes).select("first.*", "n")
    gone = repeated_blocks(blocks, classes, True).unionByName(repeated_windows(rows, mixed, scheme, True))
    # Written, so that the shuffles that found them are gone before the texts are shuffled.
    gone = materialise(per_document(gone), "substring-gone")
    joined = rows.join(gone, ["id", "fp"], "left")
    out = joined.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "low", "n").mapInPandas(_cutter(window), KEPT)
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
