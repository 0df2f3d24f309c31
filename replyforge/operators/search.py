"""Similarity search inside collections, and the checks around it.

Scores are rounded to ``SCORE_DIGITS`` before ranking: stored vectors are single
precision, so digits beyond that are noise, and equal texts must tie exactly for
the id to decide.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyforge.functions.text import is_blank, list_repr, similar_names
from replyforge.operators.joins import in_named_partitions, lookup_join
from replyforge.session import materialise

if TYPE_CHECKING:
    import pyarrow as pa

SCORE_DIGITS = 6
BLOCK_ROWS = 32_768
BLOCK_BYTES = 64 << 20
SCORES_AT_ONCE = 4 << 20
SPREAD_ROWS = 1_000_000


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; a missing one is a zero row, and a shorter one ends in zeros."""
    vectors = column.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(vectors), width)
    rows = np.zeros((len(vectors), width))
    rows[np.arange(width) < lengths[:, None]] = flat
    return rows


def _fitted(queries: np.ndarray, width: int) -> np.ndarray:
    """Unit query rows cut or filled with zeros to the width of the stored vectors."""
    if queries.shape[1] == width:
        return queries
    fitted = np.zeros((len(queries), width))
    common = min(width, queries.shape[1])
    fitted[:, :common] = queries[:, :common]
    return _unit_rows(fitted)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in place; a zero row stays zero and scores 0 against all."""
    length = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    np.divide(m, length, out=m, where=length > 0)
    m[~(length[:, 0] > 0)] = 0.0
    return m


def _scored(queries: np.ndarray, rows: np.ndarray, take: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_best_rows`` for few queries, all products in full."""
    units = np.rint(queries @ rows.T * 10**SCORE_DIGITS).astype(np.int64)
    # One integer per pair orders by score, then by place: no ties left.
    at = np.argpartition(place - units * len(rows), take - 1, axis=1)[:, :take]
    return at, np.take_along_axis(units, at, axis=1)


def _best_rows(queries: np.ndarray, rows: np.ndarray, k: int, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the ``k`` best rows of each query; on equal scores the first row, or that of least ``place``, wins.

    Both sides are unit rows. Scores are whole numbers of the last kept digit. The product is made in strips, so that
    no strip has more than ``SCORES_AT_ONCE`` entries: in single precision first, then in full for the rows that are
    no further from the k-th than its error. Queries with many such rows get all products in full.
    """
    queries = _fitted(queries, rows.shape[1])
    n, (m, width) = len(queries), rows.shape
    take, step = min(k, m), max(1, SCORES_AT_ONCE // m)
    place = np.arange(m) if place is None else place
    best, scores = np.empty((n, take), dtype=np.int64), np.empty((n, take), dtype=np.int64)
    # Twice the largest error of a single-precision product of unit rows, and one step of the last kept digit.
    slack = 2 * (width + 4) * 2.0**-23 + 2 * 10.0**-SCORE_DIGITS
    most = 4 * take + 8
    rough = rows.astype(np.float32) if m > 2 * most and n >= 4 else None
    for start in range(0, n, step):
        strip = queries[start : start + step]
        full = np.arange(len(strip))
        if rough is not None:
            near = strip.astype(np.float32) @ rough.T
            floor = np.partition(near, m - take, axis=1)[:, m - take] - np.float32(slack)
            query, row = np.nonzero(near >= floor[:, None])
            counts = np.bincount(query, minlength=len(strip))
            few = (counts >= take) & (counts <= most)
            full = np.flatnonzero(~few)
            query, row = query[few[query]], row[few[query]]
            units, pairs = np.empty(len(query), np.int64), max(1, SCORES_AT_ONCE // width)
            for at in range(0, len(query), pairs):
                some = slice(at, at + pairs)
                units[some] = np.rint(np.einsum("ij,ij->i", strip[query[some]], rows[row[some]]) * 10**SCORE_DIGITS)
            order = np.lexsort((place[row], -units, query))
            counts = counts[few]
            chosen = order[(np.cumsum(counts) - counts)[:, None] + np.arange(take)]
            best[start + np.flatnonzero(few)], scores[start + np.flatnonzero(few)] = row[chosen], units[chosen]
        # Of many queries with ties no more are scored at once than a strip holds.
        if len(full):
            best[start + full], scores[start + full] = _scored(strip[full], rows, take, place)
    return best, scores


def _pairs(group: dict, query_ids: pa.Array, kb_ids: np.ndarray, scores: np.ndarray) -> dict:
    """Result columns for all queries of one group; ``kb_ids`` and ``scores`` have one row per query."""
    import pyarrow as pa

    n, taken = kb_ids.shape
    return {
        **{key: pa.repeat(value, n * taken) for key, value in group.items()},
        "query_id": query_ids.take(pa.array(np.repeat(np.arange(n), taken))),
        "kb_id": pa.array(kb_ids.ravel()),
        "score": pa.array(scores.ravel() / 10**SCORE_DIGITS),
    }


class _Groups:
    """A table cut by its keys: per group its ids and unit vectors, rows in id order."""

    def __init__(self, table: pa.Table, keys: Sequence[str], row_id: str):
        import pyarrow as pa

        table = table.combine_chunks()
        code = table.select(list(keys)).to_pandas().groupby(list(keys), dropna=False).ngroup().to_numpy()
        ids = table[row_id].to_numpy() if row_id == "kb_id" else np.arange(table.num_rows)
        order = np.lexsort((ids, code))
        # Ordered and normalised once; a group is a slice.
        table, code = table.take(pa.array(order)), code[order]
        vectors, row_ids = _unit_rows(_matrix(table["vector"])), table[row_id].combine_chunks()
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        ends = np.append(starts[1:], len(code))[: len(starts)]
        self.members = {}
        for start, end in zip(starts, ends, strict=True):
            group = {key: table[key][int(start)] for key in keys}
            name = tuple(value.as_py() for value in group.values())
            self.members[name] = group, row_ids.slice(start, end - start), vectors[start:end]


def _best_of_block(keys: Sequence[str], k: int):
    """For one block of queries and one block of rows: the ``k`` best rows of each query."""

    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        import pyarrow as pa

        names = [*keys, "query_id", "kb_id", "score"]
        if queries.num_rows == 0 or rows.num_rows == 0:
            kinds = [*[queries.schema.field(c).type for c in (*keys, "query_id")], rows.schema.field("kb_id").type, pa.float64()]
            return pa.table([pa.array([], kind) for kind in kinds], names=names)
        rows = rows.sort_by("kb_id")
        at, scores = _best_rows(_unit_rows(_matrix(queries["vector"])), _unit_rows(_matrix(rows["vector"])), k)
        group = {key: queries[key][0] for key in keys}
        ids = rows["kb_id"].to_numpy()
        return pa.table(_pairs(group, queries["query_id"].combine_chunks(), ids[at], scores)).select(names)

    return best


def _search_small_rows(small, keys: Sequence[str], k: int):
    """Over partitions of queries: all rows are at hand, so each query gets its final rows."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        rows = _Groups(small.value, keys, "kb_id").members
        for batch in batches:
            asked = _Groups(pa.Table.from_batches([batch]), keys, "query_id").members
            for name, (group, query_ids, vectors) in asked.items():
                if name in rows:
                    _, kb_ids, stored = rows[name]
                    at, scores = _best_rows(vectors, stored, k)
                    yield pa.RecordBatch.from_pydict(_pairs(group, query_ids, kb_ids.to_numpy()[at], scores))

    return search


def _search_small_queries(small, keys: Sequence[str], k: int):
    """Over partitions of rows: all queries are at hand and keep their best rows of the partition."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        asked = _Groups(small.value, keys, "query_id").members
        kept: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for name, (_, kb_ids, stored) in _Groups(pa.Table.from_batches([batch]), keys, "kb_id").members.items():
                if name not in asked:
                    continue
                at, scores = _best_rows(asked[name][2], stored, k)
                ids = kb_ids.to_numpy()[at]
                if name in kept:
                    ids, scores = np.hstack([kept[name][0], ids]), np.hstack([kept[name][1], scores])
                    order = np.lexsort((ids, -scores), axis=1)[:, :k]
                    ids, scores = np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)
                kept[name] = ids, scores
        for name, (ids, scores) in kept.items():
            yield pa.RecordBatch.from_pydict(_pairs(asked[name][0], asked[name][1], ids, scores))

    return search


def candidates(
    queries: DataFrame, kb: DataFrame, k: int, keys: Sequence[str] = ("collection",), block_rows: int = BLOCK_ROWS, prune: bool = False
) -> DataFrame:
    """Rows among which are the ``k`` best of every query within its group (``keys``).

    ``queries``: keys, query_id, vector. ``kb``: keys, kb_id, vector.

    A side that has no more than ``block_rows`` rows is sent to the tasks and the other
    side is scanned where it lies, without a shuffle. Otherwise each side of a group is
    cut by id hash into blocks of about ``block_rows`` rows, and every query block meets
    every row block in one task. Either way a task multiplies matrices of at most a
    block, however large the group is; pairs are never written as rows. With ``prune`` two large
    sides are searched by cells instead, see ``cells.pruned_topk``.
    """
    keys = list(keys)
    spark = queries.sparkSession
    # One row per group that has both queries and rows; counting combines map-side.
    asked = materialise(queries.groupBy(*keys).agg(F.count(F.lit(1)).alias("_queries")), "asked")
    kb = in_named_partitions(kb, asked, "collection")
    stored = kb.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    grid = materialise(asked.join(stored, keys), "grid")
    query_count, row_count = grid.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("_queries", "_rows")]).first()

    def in_grid(df: DataFrame, row_id: str) -> DataFrame:
        """Rows whose group is in the grid. Aliases give both sides their own attributes when they stem from one table."""
        gridded = lookup_join(df, grid, keys, [row_id]).where(F.col("_rows").isNotNull())
        return gridded.select(
            *[F.col(c).alias(c) for c in (*keys, row_id)],
            F.col("vector").cast("array<float>").alias("vector"), "_queries", "_rows",
        )

    left, right = in_grid(queries, "query_id"), in_grid(kb, "kb_id")
    schema = T.StructType(
        [left.schema[c] for c in (*keys, "query_id")] + [right.schema["kb_id"], T.StructField("score", T.DoubleType())]
    )
    asked_side, stored_side = [*keys, "query_id", "vector"], [*keys, "kb_id", "vector"]

    def dealt(df: DataFrame, count: int, row_id: str) -> DataFrame:
        """Rows few enough to lie in one file, and so in one task, are dealt out to all cores."""
        return df.repartition(spark.sparkContext.defaultParallelism, row_id) if count < SPREAD_ROWS else df

    # Wide vectors make blocks of fewer rows: a block is never more than about BLOCK_BYTES of single-precision numbers.
    width = kb.select(F.size("vector").alias("n")).first()
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (4 * max(1, width["n"] if width and width["n"] else 1))))

    # Of two small sides the smaller one is sent.
    if row_count <= min(block_rows, query_count):
        small = spark.sparkContext.broadcast(right.select(*stored_side).toArrow())
        scanned = dealt(left.select(*asked_side), query_count, "query_id")
        return scanned.mapInArrow(_search_small_rows(small, keys, k), schema)
    if query_count <= block_rows:
        small = spark.sparkContext.broadcast(left.select(*asked_side).toArrow())
        scanned = dealt(right.select(*stored_side), row_count, "kb_id")
        return scanned.mapInArrow(_search_small_queries(small, keys, k), schema)

    if prune:
        from replyforge.operators.cells import pruned_topk

        largest = grid.agg(F.max("_rows")).first()[0]
        return pruned_topk(left.select(*asked_side), right.select(*stored_side), k, -(-largest // block_rows), block_rows)

    def place(df: DataFrame, row_id: str, own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
        """Own block by id hash, once for each block of the other side."""

        def blocks(count: str) -> Column:
            return F.ceil(F.col(count) / block_rows).cast("int")

        return df.select(
            *keys,
            row_id,
            "vector",
            F.pmod(F.xxhash64(row_id), blocks(own[0])).cast("int").alias(own[1]),
            F.explode(F.sequence(F.lit(0), blocks(other[0]) - 1)).alias(other[1]),
        )

    by_query, by_row = ("_queries", "_query_block"), ("_rows", "_row_block")
    block_keys = [*keys, by_query[1], by_row[1]]
    asked_blocks = place(left, "query_id", by_query, by_row).groupBy(*block_keys)
    row_blocks = place(right, "kb_id", by_row, by_query).groupBy(*block_keys)
    return asked_blocks.cogroup(row_blocks).applyInArrow(_best_of_block(keys, k), schema)


def rank_hits(found: DataFrame, k: int) -> DataFrame:
    """``rank`` 1..k per query; the window limit runs before the shuffle as well."""
    order = Window.partitionBy("collection", "query_id").orderBy(F.desc("score"), F.asc("kb_id"))
    ranked = found.select("collection", "query_id", "kb_id", "score", F.row_number().over(order).alias("rank"))
    return ranked.where(F.col("rank") <= k)


def exact_topk(queries: DataFrame, kb: DataFrame, k: int = 1, block_rows: int = BLOCK_ROWS, prune: bool = True) -> DataFrame:
    """Exact top ``k`` rows by cosine inside each query's collection.

    ``queries``: collection, query_id, vector. ``kb``: collection, kb_id, vector.
    Returns collection, query_id, kb_id, score, rank. When both sides are large, queries only visit the blocks of rows
    that can still hold a better one; ``prune=False`` makes every block of one side meet every block of the other.
    """
    return rank_hits(candidates(queries, kb, k, ("collection",), block_rows, prune), k)


def searchable(kb: DataFrame) -> DataFrame:
    """Knowledge-base rows without the placeholders of empty sheets."""
    if "is_placeholder" in kb.columns:
        return kb.where(~F.col("is_placeholder"))
    return kb


# --- checks before and after a search -------------------------------------------------


def collection_schemas(kb_fields: DataFrame) -> DataFrame:
    """One row per collection with its field names in schema order.

    A list here is as long as a sheet is wide.
    """
    return kb_fields.groupBy("collection").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "field"))), lambda x: x["field"]).alias("fields")
    )


def with_schema(df: DataFrame, kb_fields: DataFrame, spread: Sequence[str]) -> DataFrame:
    """``df`` with ``fields`` of its collection, NULL when there is no such collection."""
    return lookup_join(df, collection_schemas(kb_fields), ["collection"], spread)


def missing_collection_error(collection: Column, fields: Column) -> Column:
    return F.when(fields.isNull(), F.concat(F.lit("Collection '"), collection, F.lit("' not found.")))


def missing_field_error(collection: Column, field: Column, fields: Column) -> Column:
    text = F.concat(
        F.lit("Field '"), field, F.lit("' not found in collection '"), collection,
        F.lit("'. Available fields: "), list_repr(fields),
    )
    return F.when(~F.array_contains(fields, field), text)


def no_match_error(collection: Column, field: Column) -> Column:
    return F.concat(
        F.lit("No matching records found in collection '"), collection, F.lit("' for field '"), field, F.lit("'.")
    )


def resolve_field(wanted: Column, fields: Column) -> Column:
    """Field meant by a name: itself, else by letter case, else the first that overlaps; NULL when blank or none."""
    by_case = F.filter(fields, lambda f: F.lower(f) == F.lower(wanted))
    found = F.coalesce(
        F.when(F.array_contains(fields, wanted), wanted),
        F.get(by_case, F.lit(0)),
        F.get(similar_names(wanted, fields), F.lit(0)),
    )
    return F.when(wanted != "", found)


def named_cell(field: Column, cells: Column, subject: Column, body: Column, kb_id: Column) -> Column:
    """Value of the column named by ``field``: a status cell or one of the columns every sheet has."""
    return (
        F.when(field == "subject", subject)
        .when(field == "email_body", body)
        .when(field == "id", kb_id.cast("string"))
        .otherwise(F.try_element_at(cells, field))
    )


def blank_hit_message(subject: Column, body: Column) -> Column:
    """Fixed text when the best hit has neither subject nor body."""
    return F.when(is_blank(subject) & is_blank(body), "Subject and email body are empty for this result.")


def envelopes(asked: DataFrame, hits: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """One nested result per query, also where a check failed or nothing matched.

    ``asked``: query_id, collection, query_subject, query_body, status_field, top_k and the ``error`` of a
    failed check. ``hits``: query_id, rank, id, distance, status, fields; a list holds at most ``top_k``
    results. A query with an error has no results; one without error and hits says so in ``error``.
    """
    result = F.struct("rank", "id", "distance", "status", "fields")
    # Maps cannot be compared, so the list is ordered by rank alone.
    ordered = F.array_sort(F.collect_list(result), lambda a, b: a["rank"] - b["rank"])
    joined = asked.join(hits.groupBy("query_id").agg(ordered.alias("found")), "query_id", "left")
    error = F.coalesce("error", F.when(F.col("found").isNull(), no_match_error(F.col("collection"), F.col("status_field"))))
    results = F.when(F.col("error").isNull(), F.col("found"))
    stamp = F.lit(None).cast("string") if timestamp is None else timestamp
    return joined.select(
        "query_id",
        error.alias("error"),
        F.struct(
            "collection", "query_subject", "query_body", "status_field", "top_k",
            stamp.alias("timestamp"), F.coalesce(F.size(results), F.lit(0)).alias("results_count"),
        ).alias("metadata"),
        results.alias("results"),
    )


def degraded_status(failed: DataFrame, kb_rows: DataFrame) -> DataFrame:
    """For searches that could not run (query_id, collection, status_field): that cell of the collection's first row.

    Opt-in: the answer has nothing to do with the question. NULL where the collection has no such column.
    """
    first = kb_rows.groupBy("collection").agg(F.min_by(F.struct("kb_id", "subject", "email_body", "fields"), "kb_id").alias("row"))
    row = lambda c: F.col(f"row.{c}")
    cell = named_cell(F.col("status_field"), row("fields"), row("subject"), row("email_body"), row("kb_id"))
    return lookup_join(failed, first, ["collection"], ["query_id"]).select("query_id", cell.alias("status"))


def top_status(hits: DataFrame) -> DataFrame:
    """The status of the best hit of each query, NULL when it is empty."""
    return hits.where(F.col("rank") == 1).select("query_id", F.nullif(F.col("status"), F.lit("")).alias("status"))
