"""SentencePiece encoding and decoding: batched Viterbi over words of equal length, in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyforge.llm.common import chosen
from replyforge.llm.words import laid_out, mix, portions

# Fixed values of the model format: the blank's stand-in, piece kinds, and the penalty of an unknown character.
BLANK = "▁"
NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = 1, 2, 4, 5, 6
UNKNOWN_PENALTY = 10.0
# A word begins with its blanks; no piece of the model crosses from a character to a blank after it.
WORDS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
MOST_CACHED = 300_000
# Characters of text taken at once: each word of them is a string of its own.
BATCH_CHARACTERS = 1_500_000
MOST_CELLS = 500_000
SEEN_BITS = 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _hash(points: np.ndarray) -> np.uint64:
    code = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in points:
            code = code * BASE + np.uint64(p) + np.uint64(1)
    return code


class PieceTable:
    """Pieces of a model file as sorted hash keys with ids and scores; small, of the vocabulary's size."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = np.array([p.type for p in model.pieces])
        self.add_blank = model.normalizer_spec.add_dummy_prefix
        usable = [i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER_DEFINED) and p.piece]
        points = [np.array(list(map(ord, self.pieces[i])), np.uint64) for i in usable]
        sizes = np.fromiter(map(len, points), np.uint64, len(points))
        keys = mix(np.array([_hash(p) for p in points], np.uint64) ^ sizes)
        order = np.argsort(keys)
        self.keys = keys[order]
        assert (np.diff(self.keys) > 0).all(), "two pieces have one hash"
        self.ids = np.array(usable, np.int64)[order]
        self.scores = np.array([model.pieces[i].score for i in usable])[order]
        # One bit per hash prefix: most substrings are no piece, and this tells without a search.
        self.seen = np.zeros(1 << SEEN_BITS, bool)
        self.seen[self.keys >> np.uint64(64 - SEEN_BITS)] = True
        self.longest = max(map(len, points), default=1)
        self.unknown_id = int(np.flatnonzero(self.kinds == UNKNOWN)[0])
        self.unknown_score = float(self.scores.min(initial=0.0)) - UNKNOWN_PENALTY
        # Ids of the byte pieces, by byte; without them an unknown character is the unknown id.
        self.bytes = np.full(256, -1, np.int64)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.bytes[int(self.pieces[i][1:-1], 16)] = i
        # In decoding each id is a run of bytes.
        self.decoded = [
            bytes([int(p[1:-1], 16)]) if k == BYTE else p.replace(BLANK, " ").encode() if k in (NORMAL, USER_DEFINED) else b""
            for p, k in zip(self.pieces, self.kinds, strict=True)
        ]

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key among the sorted ones, -1 where it is none."""
        places = np.full(keys.shape, -1, np.int64)
        likely = self.seen[keys >> np.uint64(64 - SEEN_BITS)]
        wanted = keys[likely]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        places[likely] = np.where(self.keys[at] == wanted, at, -1)
        return places


def viterbi(table: PieceTable, words: list[str]) -> list[np.ndarray]:
    """Best segmentation of each word into ids: the highest sum of scores; of equal ones the longest last piece."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for length in np.unique(lengths):
        if length == 0:
            continue
        same = order[np.searchsorted(lengths[order], length) : np.searchsorted(lengths[order], length, "right")]
        step = max(1, MOST_CELLS // int(length))
        for at in range(0, len(same), step):
            _advance(table, words, same[at : at + step], int(length), out)
    return out


def _advance(table: PieceTable, words: list[str], rows: np.ndarray, length: int, out: list[np.ndarray]) -> None:
    """All words of one length step through their characters together."""
    n = len(rows)
    text = "".join(words[i] for i in rows)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length).astype(np.uint64)
    # Hash of characters [i, j) from two prefix hashes.
    prefix = np.zeros((n, length + 1), np.uint64)
    power = np.cumprod(np.append(np.uint64(1), np.full(table.longest, BASE)), dtype=np.uint64)
    for j in range(length):
        prefix[:, j + 1] = prefix[:, j] * BASE + points[:, j] + np.uint64(1)
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0.0
    back = np.zeros((n, length + 1), np.int32)
    piece = np.full((n, length + 1), -1, np.int64)
    for end in range(1, length + 1):
        sizes = np.arange(min(end, table.longest), 0, -1)
        starts = end - sizes
        codes = prefix[:, end, None] - prefix[:, starts] * power[sizes]
        found = table.look_up(mix(codes ^ sizes.astype(np.uint64)))
        scores = np.where(found >= 0, table.scores[found], -np.inf)
        # A single character that is no piece stands as unknown.
        scores[:, -1] = np.where(found[:, -1] >= 0, scores[:, -1], table.unknown_score)
        total = best[:, starts] + scores
        pick = total.argmax(axis=1)
        chosen_rows = np.arange(n)
        best[:, end] = total[chosen_rows, pick]
        back[:, end] = starts[pick]
        hit = found[chosen_rows, pick]
        piece[:, end] = np.where(hit >= 0, table.ids[hit], -1)
    # Back along all words at once; -2 stands where a word is through.
    end, every, steps = np.full(n, length), np.arange(n), []
    while (end > 0).any():
        steps.append(np.where(end > 0, piece[every, end], -2))
        end = np.where(end > 0, back[every, end], 0)
    walked = np.array(steps[::-1]).T
    used = walked != -2
    edges = np.concatenate(([0], used.sum(axis=1).cumsum()))
    flat = walked[used]
    unknown = (walked == -1).any(axis=1)
    for k, i in enumerate(rows):
        ids = flat[edges[k] : edges[k + 1]]
        out[i] = _with_unknown(table, words[i], ids) if unknown[k] else ids


def _with_unknown(table: PieceTable, word: str, ids: np.ndarray) -> np.ndarray:
    """``ids`` with each -1, a character without a piece, replaced by its byte pieces or the unknown id."""
    whole, at = [], 0
    for i in ids.tolist():
        if i >= 0:
            whole.append(i)
            at += len(table.pieces[i])
        else:
            own = table.bytes[list(word[at].encode("utf-8", "surrogatepass"))]
            whole.extend(own.tolist() if (own >= 0).all() else [table.unknown_id])
            at += 1
    return np.array(whole, np.int64)


class Codec:
    """Encodes and decodes texts; distinct words are segmented once as long as the cache holds them.

    Known words are numbers; their ids lie in one array, at ``begins``.
    """

    def __init__(self, table: PieceTable):
        self.table = table
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.begins = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        found = viterbi(self.table, words)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.begins = np.append(self.begins, len(self.ids) + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.ids = np.append(self.ids, np.concatenate(found).astype(np.int32))

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        marked = text.replace(" ", BLANK)
        return WORDS.findall(BLANK + marked if self.table.add_blank else marked)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > MOST_CACHED:
            self._forget()
        split = [self._words(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.fromiter(chain.from_iterable(split), object, int(counts.sum()))
        del split
        if not len(flat):
            return [np.zeros(0, np.int32) for _ in texts]
        codes, distinct = pd.factorize(flat)
        del flat
        self._learn([w for w in distinct if w not in self.known])
        own = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        ids, ends = laid_out(self.ids, self.begins, self.lengths, own[codes])
        edges = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        pieces = self.table.decoded
        ids = np.asarray(ids)
        known = ids[(ids >= 0) & (ids < len(pieces))]
        raw = b"".join(map(pieces.__getitem__, known.tolist()))
        if self.table.add_blank and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def _shared(spark: SparkSession, model: str | None) -> Broadcast:
    """The piece table on every executor: as large as the vocabulary file, whatever the data."""
    return spark.sparkContext.broadcast(PieceTable(model or default_model()))


_worker: dict = {}


def _codec(shared: Broadcast) -> Codec:
    """The codec of this Python worker for a table: its tasks share the words that are segmented."""
    table = shared.value
    if _worker.get("table") is not table:
        _worker.update(table=table, codec=Codec(table))
    return _worker["codec"]


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, text, ids), ``ids`` an array of piece ids.

    The segmentation of each word is the one with the highest sum of piece scores, the unigram rule
    of the format; a model file of another type is read as its pieces and scores. Characters without a
    piece become byte pieces, or the unknown piece where the model has none.

    A null text has null ids, an empty one an empty array. Texts may be of any length. Repeated
    rows are encoded each. An empty table gives no rows. Further columns are not read.
    """
    shared = _shared(docs.sparkSession, model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared)
        for part in portions(frames, most=BATCH_CHARACTERS):
            ids = codec.encode([t if isinstance(t, str) else "" for t in part["text"]])
            ids = [a if isinstance(t, str) else None for a, t in zip(ids, part["text"], strict=True)]
            yield pd.DataFrame({"doc_id": part["doc_id"], "text": part["text"], "ids": ids})

    rows = chosen(docs, id_col=id_col, text_col=text_col).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id string, text string, ids array<int>").withColumn("doc_id", F.col("doc_id").cast("bigint"))


def decode(encoded: DataFrame, model: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of its ids; null where the ids are null.

    Ids outside the vocabulary and control pieces give nothing; bytes that are no UTF-8 give the
    replacement character.
    """
    shared = _shared(encoded.sparkSession, model)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(shared.value)
        for ids in batches:
            yield pd.Series([None if x is None else codec.decode(x) for x in ids], dtype=object)

    return encoded.withColumn("decoded", text_of(F.col(ids_col)))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def digest(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_pieces, ids, decoded_sha256, round_trip) of encoded and decoded rows."""
    return encoded.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_pieces"),
        "ids",
        F.sha2(F.coalesce("decoded", F.lit("")), 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )
