"""What several corpus operators share: column choice, word splitting, document keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed by the contracts: ASCII white space and what is left between it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SPACE_CHARACTERS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def chosen(docs: DataFrame, *more: str | Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as (doc_id, fp, text, further columns), so that other columns cannot clash.

    ``fp`` is a hash of the text: rows that share an id but not a text stay apart, and rows equal
    in both are one document wherever documents are joined.
    """
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.xxhash64(text_col).alias("fp"),
        F.col(text_col).cast("string").alias("text"),
        *more,
    )


def same_document(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on (doc_id, fp) that also matches missing ids."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["fp"] == right["fp"])


def with_per_document(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``found`` (one row per document at most), null where it has none."""
    right = found.select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"), *[c for c in found.columns if c not in ("doc_id", "fp")])
    on = docs["doc_id"].eqNullSafe(right["_id"]) & (docs["fp"] == right["_fp"])
    return docs.join(right, on, "left").drop("_id", "_fp")


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """``names`` with as many leading underscores as it takes to be none of the columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    head = "_"
    while any(head + n in taken for n in names):
        head += "_"
    return [head + n for n in names]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A column used inside a lambda is otherwise computed again for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


SCAN_CHUNK = 256


def scanned(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element of an integer array, ``zero`` combined with all elements before it.

    An array grows by copying, so the scan goes in chunks: their totals first, then each chunk from its own start.
    """

    def fold(part: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda state, x: F.struct(combine(state["at"], x).alias("at"), F.array_append(state["out"], state["at"]).alias("out"))
        return F.aggregate(part, begin, step, lambda state: state["out"])

    def of(values: Column) -> Column:
        chunk = lambda c: F.slice(values, c * SCAN_CHUNK + 1, F.lit(SCAN_CHUNK))
        chunks = F.sequence(F.lit(0), F.ceil(F.size(values) / SCAN_CHUNK).cast("int") - 1)
        totals = F.transform(chunks, lambda c: F.aggregate(chunk(c), zero, combine))
        starts = let(totals, lambda t: fold(t, zero))
        whole = let(starts, lambda s: F.flatten(F.transform(chunks, lambda c: fold(chunk(c), F.get(s, c)))))
        return F.when(F.size(values) > 0, whole).otherwise(F.array().cast("array<int>"))

    return let(values, of)


def without_space(text: Column) -> Column:
    """``text`` without its ASCII white space; six literal replacements are cheaper than one pattern."""
    for c in SPACE_CHARACTERS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def sql_words(text: str) -> str:
    """The words of a text in the checking SQL."""
    return rf"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
