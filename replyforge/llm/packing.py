"""Packing of documents into token sequences by non-negative least squares over length combinations."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replyforge.llm.common import chosen
from replyforge.llm.words import WordTable, laid_out, portions, text_bytes
from replyforge.operators.joins import fetch_rows
from replyforge.session import materialise

WINDOW = 2048
BIN = 8
DEPTH = 3
END_ID = 1
MOST_CACHED = 300_000
# Punctuation that may be cut from the end of a word: runs of it are split from letters in any case.
TAIL = b".,!?;:#*$%&"
MIXED = -1

PREPARED = (
    "doc_id string, tokens bigint, full_crcs array<bigint>, rest int, rest_crc bigint, rest_ids binary"
)


def default_tokenizer() -> str:
    """Path of the vocabulary file; the package that holds it is installed with the libraries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of whole texts, with each distinct run of letters encoded once.

    Valid for a vocabulary whose normaliser composes and lower-cases, that never joins text across white
    space, splits letters from what follows them and marks the ends of letter runs, as word_bpe_49k.json does.

    Known parts of words lie in one array of ids; a part is a number, with its place there in ``begins`` and
    ``lengths``. Part 0 is empty.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        # Texts of the tokens that are found before lower-casing.
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Whether an id ends a run of letters.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        # A body that is not letters only is MIXED: its words are parts of their own in ``wholes``.
        self.bodies: dict[bytes, int] = {b"": 0}
        self.tails: dict[bytes, int] = {b"": 0}
        self.wholes: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.lengths = np.zeros(1, np.int64)
        self.begins = np.zeros(1, np.int64)

    def _alone(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts one after the other, and how many each has."""
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter(chain.from_iterable(encoded), np.uint32, int(lengths.sum())), lengths

    def _letters(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for parts that are letters only: encoded as one text, which costs half, and cut at the word ends."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, np.uint32)
        edges = np.flatnonzero(self.ends[ids]) + 1
        if len(edges) != len(parts) or edges[-1] != len(ids):
            return self._alone(parts)
        return ids, np.diff(edges, prepend=0)

    def _learn(self, known: dict[bytes, int], parts: list[bytes], encode) -> None:
        """Give the ``parts`` numbers and append their ids."""
        if not parts:
            return
        ids, lengths = encode([p.decode("utf-8", "replace") for p in parts])
        known.update(zip(parts, range(len(self.lengths), len(self.lengths) + len(parts)), strict=True))
        self.begins = np.append(self.begins, len(self.ids) + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.ids = np.append(self.ids, ids)

    def _parts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the body and of the tail of each word; a word that is a part of its own has no tail."""
        bodies = [w.rstrip(TAIL) for w in words]
        unseen = list(set(bodies) - self.bodies.keys())
        # Lower case can turn a letter into a letter and a mark, which is no letter.
        letters = [b for b in unseen if b.decode("utf-8", "replace").lower().isalpha()]
        self.bodies.update(dict.fromkeys(unseen, MIXED))
        self._learn(self.bodies, letters, self._letters)
        body = np.fromiter(map(self.bodies.__getitem__, bodies), np.int64, len(words))
        tail = np.zeros(len(words), np.int64)

        mixed = np.flatnonzero(body == MIXED).tolist()
        whole = [words[i] for i in mixed]
        self._learn(self.wholes, list(set(whole) - self.wholes.keys()), self._alone)
        body[mixed] = [self.wholes[w] for w in whole]

        sizes = np.fromiter(map(len, words), np.int64, len(words)) - np.fromiter(map(len, bodies), np.int64, len(words))
        sizes[mixed] = 0
        tailed = np.flatnonzero(sizes).tolist()
        ends = [words[i][len(bodies[i]) :] for i in tailed]
        self._learn(self.tails, list(set(ends) - self.tails.keys()), self._alone)
        tail[tailed] = [self.tails[e] for e in ends]
        return body, tail

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        table = WordTable([lowered(t, self.marks) for t in texts])
        words = list(table.words)
        if not words:
            return [np.array([END_ID], np.uint32) for _ in texts]
        if len(self.bodies) + len(self.wholes) + len(self.tails) > MOST_CACHED:
            self._forget()
        # Ids of the distinct words first; all words are then laid out by one gather from these.
        body, tail = self._parts(words)
        flat, ends = laid_out(self.ids, self.begins, self.lengths, np.column_stack((body, tail)).ravel())
        lengths = self.lengths[body] + self.lengths[tail]
        ids, ends = laid_out(flat, ends[1::2] - lengths, lengths, table.codes)
        edge = np.concatenate(([0], ends))[table.starts]
        return [np.append(ids[a:b], np.uint32(END_ID)) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def lowered(text: bytes, marks: list[bytes]) -> bytes:
    """``text`` with A-Z in lower case, unless the vocabulary would then compose it otherwise or find one of the ``marks``."""
    low = text.lower()
    if low == text or any(m in low for m in marks):
        return text
    if low.isascii():
        return low
    composed = all(unicodedata.is_normalized("NFC", t.decode("utf-8", "surrogatepass")) for t in (text, low))
    return low if composed else text


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of a Python worker: its tasks share what it has learned, at most ``MOST_CACHED`` parts and those of a batch."""
    return Encoder(path)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _preparer(path: str, window: int):
    def prepare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in portions(frames):
            rows = []
            for doc_id, ids in zip(part["doc_id"], encoder(path).encode([text_bytes(t) for t in part["text"]]), strict=True):
                cut = len(ids) // window * window
                rest = ids[cut:]
                full = [crc32(ids[i : i + window]) for i in range(0, cut, window)]
                rows.append((doc_id, len(ids), full, len(rest), crc32(rest), rest.astype("<u4").tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "tokens", "full_crcs", "rest", "rest_crc", "rest_ids"])

    return prepare


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _cutter(window: int, base: int):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            rows = []
            for r in part.itertuples():
                ids = np.frombuffer(r.rest_ids, "<u4")
                # A rest is shorter than a window, so it is cut once.
                first = window - r.at % window
                for a, b in ((0, first), (first, len(ids))):
                    at = r.at + a
                    rows.append((r.doc_id, r.tokens - len(ids) + a, b - a, crc32(ids[a:b]), r.tokens, base + at // window, at % window))
            yield pd.DataFrame(rows, columns=PIECE)

    return cut


def non_negative_least_squares(matrix: np.ndarray, target: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 that makes ``matrix @ x`` nearest to ``target``, by an active set of columns."""
    x = np.zeros(matrix.shape[1])
    active = np.zeros(matrix.shape[1], dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0.0)))
    for _ in range(rounds):
        gain = matrix.T @ (target - matrix @ x)
        gain[active] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= tolerance:
            break
        active[best] = True
        while True:
            use = np.flatnonzero(active)
            solved = np.linalg.lstsq(matrix[:, use], target, rcond=None)[0]
            if solved.min() > 0:
                break
            # Back to where the first of them reaches zero, which leaves the set.
            low = solved <= 0
            step = np.min(x[use][low] / np.maximum(x[use][low] - solved[low], 1e-300))
            x[use] += step * (solved - x[use])
            active[use[x[use] <= tolerance]] = False
            x[~active] = 0.0
            if not active.any():
                break
        if active.any():
            x[:] = 0.0
            x[use] = solved
    return x


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """All multisets of up to ``depth`` bin lengths that fill a window of ``bins`` exactly."""
    found = [(bins,)] if depth >= 1 else []
    for size in range(2, depth + 1):
        for head in combinations_with_replacement(range(1, bins), size - 1):
            last = bins - sum(head)
            if last >= head[-1]:
                found.append((*head, last))
    return found


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Combinations with whole repeat counts; ``histogram[b]`` pieces have length b bins, b from 1.

    The least-squares counts are rounded down to what is there; what is left over is filled
    greedily, combination by combination.
    """
    bins = len(histogram) - 1
    options = [c for c in combinations(bins, depth) if all(histogram[b] > 0 for b in c)]
    if not options:
        return []
    matrix = np.zeros((bins + 1, len(options)))
    for j, c in enumerate(options):
        for b in c:
            matrix[b, j] += 1
    wanted = non_negative_least_squares(matrix, histogram.astype(float))
    left = histogram.astype(np.int64).copy()
    counts = np.zeros(len(options), np.int64)
    order = np.argsort(-wanted, kind="stable")
    for limit in (np.floor(wanted + 1e-6).astype(np.int64), np.full(len(options), np.iinfo(np.int64).max)):
        for j in order:
            used, times = np.unique(options[j], return_counts=True)
            n = min(int(limit[j]), int((left[used] // times).min()))
            left[used] -= n * times
            counts[j] += n
    return [(options[j], int(counts[j])) for j in range(len(options)) if counts[j]]


def _slots(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(bin, first rank, end rank, pieces of that bin in a sequence, first sequence), by bin.

    The pieces of a bin are numbered; each combination takes the next stretch of numbers.
    """
    at: dict[int, int] = {}
    rows, sequence = [], 0
    for combination, n in planned:
        for b, times in zip(*np.unique(combination, return_counts=True), strict=True):
            start = at.get(int(b), 0)
            rows.append((int(b), start, start + n * int(times), int(times), sequence))
            at[int(b)] = start + n * int(times)
        sequence += n
    return rows


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document's ids are those of ``tokenizer`` and a final ``END_ID``. Whole windows of a document
    are sequences of their own. The rests, counted by length in bins of ``BIN`` ids, are packed whole:
    combinations of up to ``DEPTH`` bins that fill a window are enumerated, their repeat counts solved
    by non-negative least squares against the histogram, rounded, and topped up greedily. Rests that
    no combination takes are laid end to end and cut at the window, so only the last sequence of all
    and the rounding inside bins leave padding.

    The driver holds the histogram and the plan, whose sizes depend on the window alone. Pieces are
    numbered by (task, row) counts, so no task sees all pieces of a length.

    A null text counts as empty; an empty text is its final id alone. Repeated rows are packed each.
    An empty table gives no rows. Further columns are not read.
    """
    rows = chosen(docs, id_col=id_col, text_col=text_col).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    prepared = rows.mapInPandas(_preparer(tokenizer or default_tokenizer(), window), PREPARED)
    # Numbers given while writing are fixed by the table, also for tasks that are repeated later.
    prepared = materialise(
        prepared.withColumns(
            {
                "part": F.spark_partition_id(),
                "row": F.monotonically_increasing_id(),
                "bin": F.ceil(F.col("rest") / BIN).cast("int"),
                "doc_id": F.col("doc_id").cast("bigint"),
            }
        ),
        "packing-tokens",
    )
    narrow = prepared.withColumn("full", F.size("full_crcs").cast("bigint")).drop("rest_ids", "full_crcs")

    counts = materialise(narrow.groupBy("part", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")), "packing-counts")
    by_bin = {r["bin"]: r["n"] for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    histogram = np.array([0] + [by_bin.get(b, 0) for b in range(1, -(-window // BIN) + 1)], dtype=np.int64)
    planned = plan(histogram)
    n_full = counts.agg(F.coalesce(F.sum("full"), F.lit(0)).cast("bigint")).first()[0]
    n_planned = sum(n for _, n in planned)

    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")

    # Whole windows: numbered along the rows of a part, after those of earlier parts.
    fulls = counts.groupBy("part").agg(F.sum("full").alias("n"))
    fulls = fulls.select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), zero).alias("base"))
    own = F.coalesce(F.sum("full").over(before.partitionBy("part").orderBy("row")), zero)
    whole = (
        prepared.select("doc_id", "tokens", "part", "row", "full_crcs", F.size("full_crcs").cast("bigint").alias("full"))
        .where("full > 0")
        .withColumn("own", own)
        .join(fulls, "part")
        .select("doc_id", "tokens", (F.col("base") + F.col("own")).alias("first"), F.posexplode("full_crcs").alias("k", "crc"))
        .select(
            "doc_id",
            (F.col("k") * F.lit(window)).cast("bigint").alias("start"),
            F.lit(window).cast("bigint").alias("length"),
            F.col("crc").alias("ids_crc32"),
            F.col("tokens").alias("doc_tokens"),
            (F.col("first") + F.col("k")).alias("sequence_id"),
            zero.alias("offset"),
        )
    )

    # Rests: numbered within their bin, then matched with the stretch of the plan that holds the number.
    ranks = counts.where("bin > 0").select(
        "part", "bin", F.coalesce(F.sum("n").over(before.partitionBy("bin").orderBy("part")), zero).alias("base")
    )
    rank = F.row_number().over(Window.partitionBy("part", "bin").orderBy("row")) - 1
    rests = (
        narrow.where("rest > 0")
        .withColumn("own", rank)
        .join(ranks, ["part", "bin"])
        .withColumn("rank", F.col("base") + F.col("own"))
        .select("doc_id", "tokens", "part", "row", "bin", "rest", "rest_crc", "rank")
    )
    spark = docs.sparkSession
    slots = _slots(planned)
    stretches: dict[int, list] = {}
    for b, low, high, times, first in slots:
        stretches.setdefault(b, []).append((low, high, times, first))
    table = spark.createDataFrame(
        [(b, s) for b, s in stretches.items()], "bin int, stretches array<struct<low:bigint,high:bigint,times:int,first:bigint>>"
    )
    # At most one row per bin and, over all rows, DEPTH stretches per combination: bounded by the window.
    rests = rests.join(F.broadcast(table), "bin", "left").withColumn(
        "slot", F.get(F.filter("stretches", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"])), F.lit(0))
    )
    rests = materialise(rests.drop("stretches"), "packing-rests")
    sequence = F.lit(n_full) + F.col("slot.first") + F.floor((F.col("rank") - F.col("slot.low")) / F.col("slot.times"))
    place = Window.partitionBy("sequence_id").orderBy(F.desc("rest"), "row")
    combined = (
        rests.where("slot is not null")
        .withColumn("sequence_id", sequence.cast("bigint"))
        .select(
            "doc_id",
            (F.col("tokens") - F.col("rest")).cast("bigint").alias("start"),
            F.col("rest").cast("bigint").alias("length"),
            F.col("rest_crc").alias("ids_crc32"),
            F.col("tokens").alias("doc_tokens"),
            "sequence_id",
            F.coalesce(F.sum("rest").over(place.rowsBetween(Window.unboundedPreceding, -1)), zero).cast("bigint").alias("offset"),
        )
    )

    # What is left is one stream, cut at the window.
    left = rests.where("slot is null")
    sums = left.groupBy("part").agg(F.sum("rest").alias("n"))
    sums = sums.select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), zero).alias("base"))
    stream = (
        left.withColumn("own", F.coalesce(F.sum("rest").over(before.partitionBy("part").orderBy("row")), zero))
        .join(sums, "part")
        .withColumn("at", (F.col("base") + F.col("own")).cast("bigint"))
        .select("doc_id", "tokens", "row", "rest", "rest_crc", "at")
    )
    stream = materialise(stream, "packing-stream")
    crosses = F.floor(F.col("at") / window) != F.floor((F.col("at") + F.col("rest") - 1) / window)
    base = n_full + n_planned
    uncut = stream.where(~crosses).select(
        "doc_id",
        (F.col("tokens") - F.col("rest")).cast("bigint").alias("start"),
        F.col("rest").cast("bigint").alias("length"),
        F.col("rest_crc").alias("ids_crc32"),
        F.col("tokens").alias("doc_tokens"),
        (F.lit(base) + F.floor(F.col("at") / window)).cast("bigint").alias("sequence_id"),
        F.pmod("at", F.lit(window)).cast("bigint").alias("offset"),
    )

    crossing = stream.where(crosses).select("row", "at")
    ids = prepared.select("row", F.col("doc_id").cast("string").alias("doc_id"), "tokens", "rest_ids")
    pieces = fetch_rows(crossing, ids, ["row"], ["row"]).select("doc_id", "tokens", "rest_ids", "at").mapInPandas(
        _cutter(window, base), "doc_id string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    )
    pieces = pieces.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return whole.unionByName(combined).unionByName(uncut).unionByName(pieces)
