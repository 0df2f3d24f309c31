"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyforge.llm.common import chosen
from replyforge.llm.words import mix, portions

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def _grams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, owner) of the n-grams of distinct words, each word between two blanks."""
    padded = [" " + w + " " for w in words]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(padded)), lengths)
    at = np.arange(len(points))
    buckets, owners = [], []
    code = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        shifted = np.zeros_like(points)
        shifted[: len(points) - n + 1] = points[n - 1 :]
        code = code * np.uint64(1_114_129) + shifted
        if n in ORDERS:
            inside = at + n <= ends
            if n == 1:
                inside &= points != 32
            buckets.append((mix(code[inside] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
            owners.append(owner[inside])
    return np.concatenate(buckets), np.concatenate(owners)


def _word_counts(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word number) of every word, and the distinct lower-case words."""
    split = [LETTERS.findall(t.lower()) if isinstance(t, str) else [] for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.empty(counts.sum(), dtype=object)
    at = 0
    for words in split:
        flat[at : at + len(words)] = words
        at += len(words)
    codes, words = pd.factorize(flat)
    return np.repeat(np.arange(len(split)), counts), codes, words


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """N-gram counts by language over one partition, in an array of a fixed size per language."""
    totals: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for part in portions(frames):
        for lang, own in part.groupby("lang", sort=False):
            rows[lang] = rows.get(lang, 0) + len(own)
            total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
            _, codes, words = _word_counts(own["text"])
            if len(words):
                buckets, owner = _grams(words)
                times = np.bincount(codes, minlength=len(words))
                total += np.bincount(buckets, weights=times[owner], minlength=BUCKETS).astype(np.int64)
    for lang, total in totals.items():
        used = np.flatnonzero(total)
        # Bucket -1 holds the number of documents.
        yield pd.DataFrame({"lang": lang, "bucket": np.append(used, -1), "n": np.append(total[used], rows[lang])})


class Model:
    """Log probabilities of languages: ``weights`` is a matrix of BUCKETS rows and a column per language."""

    def __init__(self, langs: list[str], weights: np.ndarray, prior: np.ndarray):
        self.langs, self.weights, self.prior = langs, weights, prior

    def predict(self, texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Language number and its posterior probability for each text."""
        at, codes, words = _word_counts(texts)
        scores = np.tile(self.prior, (len(texts), 1))
        if len(words):
            buckets, owner = _grams(words)
            by_word = np.zeros((len(words), len(self.langs)))
            for j in range(len(self.langs)):
                by_word[:, j] = np.bincount(owner, weights=self.weights[buckets, j], minlength=len(words))
                scores[:, j] += np.bincount(at, weights=by_word[codes, j], minlength=len(texts))
        best = scores.argmax(axis=1)
        shifted = np.exp(scores - scores.max(axis=1, keepdims=True))
        return best, 1.0 / shifted.sum(axis=1)


def train(labelled: DataFrame) -> Model:
    """A model from all rows of ``labelled`` (lang, text).

    Counts are taken per task and summed by (language, bucket); what reaches the driver is
    one number for each of BUCKETS buckets of each language, however many documents there are.
    """
    counted = labelled.mapInPandas(_count, "lang string, bucket int, n bigint")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    weights, prior = np.zeros((BUCKETS, len(langs))), np.zeros(len(langs))
    for j, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        counts = np.full(BUCKETS, SMOOTHING)
        grams = own[own["bucket"] >= 0]
        counts[grams["bucket"].to_numpy()] += grams["n"].to_numpy()
        weights[:, j] = np.log(counts / counts.sum())
        prior[j] = own.loc[own["bucket"] < 0, "n"].sum()
    return Model(langs, weights, np.log(prior / prior.sum()) if len(langs) else prior)


def _predictor(shared: Broadcast):
    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Model = shared.value
        for part in portions(frames):
            lang, score = np.full(len(part), UNKNOWN, dtype=object), np.zeros(len(part))
            known = part["has_letter"].to_numpy(dtype=bool)
            if model.langs and known.any():
                best, value = model.predict(part.loc[known, "text"])
                lang[known] = np.array(model.langs, dtype=object)[best]
                score[known] = value
            yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "lang_pred": lang, "score": score})

    return predict


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: (doc_id, held_out, lang_pred, score).

    The model learns from the text and label of all documents that are not held out and have both;
    a prediction sees the text alone. Words are runs of letters in lower case; the n-grams of each
    distinct word of a batch are scored once and weighted by how often the word occurs.

    A null text or one without a letter gives ``und`` with score 0, and so does every text when there
    is nothing to learn from. A missing id is not held out. Ties go to the first language in
    alphabetical order. Repeated rows have equal results. Further columns are not read.
    """
    rows = chosen(docs, F.col(lang_col).cast("string").alias("lang"), id_col=id_col, text_col=text_col)
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    model = train(rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # Ids travel as text: a batch with a missing one would turn integers into floats.
    texts = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "held_out", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    predicted = texts.mapInPandas(_predictor(shared), "doc_id string, held_out boolean, lang_pred string, score double")
    return predicted.withColumn("doc_id", F.col("doc_id").cast("bigint"))
