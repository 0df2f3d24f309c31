"""Cell index for similarity search: the rows of each collection grouped around centres of their own.

``nprobe`` cells alone give the usual approximate answer; how many a collection needs for a wanted recall is
measured when the index is built. With ``exact`` a second pass visits every cell that could still hold a
better row, by an angle bound, so the answer equals the full search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyforge.operators.joins import fetch_rows, in_named_partitions, lookup_join
from replyforge.operators.search import (
    BLOCK_BYTES,
    BLOCK_ROWS,
    SCORE_DIGITS,
    SCORES_AT_ONCE,
    _best_rows,
    _fitted,
    _matrix,
    _unit_rows,
    candidates,
    exact_topk,
    rank_hits,
)
from replyforge.session import materialise
from replyforge.sources import store
from replyforge.sources.writers import write_collections

if TYPE_CHECKING:
    import pyarrow as pa

# A collection has about the square root of its rows in cells. Its centres are trained on no more than
# MOST_CELLS * TRAINED_ROWS of its rows, chosen by hash; every row is indexed.
MOST_CELLS = 1024
TRAINED_ROWS = 32
ROUNDS = 10
# Centres up to this size are sent to the tasks; larger ones meet their rows in a shuffle.
CENTRE_BYTES = 64 << 20
# Rows per collection, by hash, whose full answer sets the number of probed cells.
TUNING_ROWS = 128
RECALL = 0.95
TUNED_K = 10
SPREAD = 1 << 30


@dataclass
class CellIndex:
    """``rows``: collection, cell, kb_id, vector. ``cells``: collection, cell, centre, reach, members, nprobe.

    ``reach`` is the least similarity of a row to its centre, ``nprobe`` the cells that a search of the collection visits.
    """

    rows: DataFrame
    cells: DataFrame


def _by_hash(most: Column, rows: Column) -> Column:
    """Whether a row is among about ``most`` of the ``rows`` rows of its collection, by a hash of its id."""
    return F.pmod(F.xxhash64("kb_id"), F.lit(SPREAD)) < F.least(F.lit(1.0), most / rows) * SPREAD


def kmeans(unit: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """At most ``cells`` unit centres of unit rows by cosine; an empty cell takes the row that lies farthest out."""
    rng = np.random.default_rng(seed)
    centres = unit[np.sort(rng.choice(len(unit), min(cells, len(unit)), replace=False))]
    for _ in range(ROUNDS):
        similarity = unit @ centres.T
        cell = similarity.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, unit)
        empty = np.flatnonzero(np.bincount(cell, minlength=len(centres)) == 0)
        if len(empty):
            sums[empty] = unit[np.argsort(similarity[np.arange(len(unit)), cell], kind="stable")[: len(empty)]]
        centres = _unit_rows(sums)
    return centres


def _train(seed: int):
    def train(sample: pa.Table) -> pa.Table:
        import pyarrow as pa

        sample = sample.sort_by("kb_id")
        unit = _unit_rows(_matrix(sample["vector"]))
        directed = unit[(unit * unit).sum(axis=1) > 0]
        # Rows without a direction alone make one cell with a zero centre.
        centres = kmeans(directed, sample["wanted"][0].as_py(), seed) if len(directed) else unit[:1]
        n = len(centres)
        return pa.table(
            {"collection": pa.repeat(sample["collection"][0], n), "cell": pa.array(range(n), pa.int32()), "centre": list(centres.astype(np.float32))}
        )

    return train


def _with_cells(rows: DataFrame, row_id: str, cells: DataFrame, columns: list[str], work: Callable, schema: T.StructType) -> DataFrame:
    """``work`` over rows and the cells of their collection, as Arrow tables of one collection at a time.

    The cells are sent to the tasks when their size allows it, and meet salted parts of the rows in a shuffle otherwise.
    """
    spark = rows.sparkSession
    asked = cells.select("collection", *columns)
    width = sum(8 * (F.size(c) if isinstance(asked.schema[c].dataType, T.ArrayType) else F.lit(1)) for c in columns)
    size = asked.agg(F.sum(width)).first()[0] or 0
    if size <= CENTRE_BYTES:
        shared = spark.sparkContext.broadcast(asked.toArrow())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow as pa
            import pyarrow.compute as pc

            table = shared.value
            known = {c: table.filter(pc.equal(table["collection"], c)) for c in table["collection"].unique().to_pylist()}
            for batch in batches:
                part = pa.Table.from_batches([batch])
                for collection in part["collection"].unique().to_pylist():
                    if collection in known:
                        yield from work(part.filter(pc.equal(part["collection"], collection)), known[collection]).to_batches()

        return rows.mapInArrow(scan, schema)
    counts = rows.groupBy("collection").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_parts"))
    counts = materialise(counts, "parts")
    salted = lookup_join(rows, counts, ["collection"], [row_id]).withColumn("_part", F.pmod(F.xxhash64(row_id), F.col("_parts")).cast("int"))
    copied = asked.join(counts, "collection").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")

    def meet(part: pa.Table, own: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        if part.num_rows == 0 or own.num_rows == 0:
            return to_arrow_schema(schema).empty_table()
        return work(part.drop_columns(["_parts", "_part"]), own.drop_columns(["_part"]))

    return salted.groupBy("collection", "_part").cogroup(copied.groupBy("collection", "_part")).applyInArrow(meet, schema)


def _centre_rows(cells: pa.Table) -> tuple[pa.Table, np.ndarray]:
    cells = cells.sort_by("cell")
    return cells, _matrix(cells["centre"])


def _assigned(part: pa.Table, cells: pa.Table) -> pa.Table:
    import pyarrow as pa

    cells, centres = _centre_rows(cells)
    unit = _fitted(_unit_rows(_matrix(part["vector"])), centres.shape[1])
    similarity = unit @ centres.T
    cell = similarity.argmax(axis=1)
    near = similarity[np.arange(len(cell)), cell]
    # A zero vector has no direction: a reach of -1 keeps its cell in every search.
    near = np.where((unit * unit).sum(axis=1) > 0, near, -1.0)
    return pa.table(
        {"collection": part["collection"], "cell": cells["cell"].take(pa.array(cell)), "kb_id": part["kb_id"], "vector": part["vector"], "near": near}
    )


def build_index(kb: DataFrame, nlist: int | None = None, seed: int = 7, recall: float | None = RECALL, block_rows: int = BLOCK_ROWS) -> CellIndex:
    """Index over ``kb`` (collection, kb_id, vector).

    ``nlist`` cells per collection, by default the square root of its rows. All collections are trained in one
    grouped job, each from a bounded sample of its rows; then every row is put into the cell of its nearest centre.
    With ``recall`` the cells to probe are measured, see ``tuned_probes``; without it all are probed.
    """
    plain = kb.select("collection", "kb_id", F.col("vector").cast("array<float>").alias("vector"))
    counts = plain.groupBy("collection").agg(F.count(F.lit(1)).alias("_rows"))
    wanted = F.floor(F.sqrt("_rows")) if nlist is None else F.lit(nlist)
    counts = materialise(counts.withColumn("wanted", F.greatest(F.lit(1), F.least(F.lit(MOST_CELLS), wanted)).cast("int")), "cell-counts")
    counted = lookup_join(plain, counts, ["collection"], ["kb_id"])
    sample = counted.where(_by_hash(F.col("wanted") * TRAINED_ROWS, F.col("_rows"))).drop("_rows")
    collection = plain.schema["collection"]
    trained = T.StructType([collection, T.StructField("cell", T.IntegerType()), T.StructField("centre", T.ArrayType(T.FloatType()))])
    centres = materialise(sample.groupBy("collection").applyInArrow(_train(seed), trained), "centres")
    schema = T.StructType([collection, T.StructField("cell", T.IntegerType()), *plain.schema.fields[1:], T.StructField("near", T.DoubleType())])
    placed = materialise(_with_cells(plain, "kb_id", centres, ["cell", "centre"], _assigned, schema), "cells")
    reach = placed.groupBy("collection", "cell").agg(F.min("near").alias("reach"), F.count(F.lit(1)).alias("members"))
    every = F.count(F.lit(1)).alias("nprobe")
    cells = centres.join(reach, ["collection", "cell"])
    cells = materialise(cells.join(cells.groupBy("collection").agg(every), "collection"), "reach")
    index = CellIndex(placed.drop("near"), cells)
    if recall is None:
        return index
    probes = tuned_probes(plain, counts, index, recall, block_rows=block_rows)
    tuned = cells.withColumnRenamed("nprobe", "_all").join(probes, "collection", "left")
    return CellIndex(index.rows, materialise(tuned.withColumn("nprobe", F.coalesce("nprobe", "_all")).drop("_all"), "reach"))


def tuned_probes(kb: DataFrame, counts: DataFrame, index: CellIndex, recall: float = RECALL, k: int = TUNED_K, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(collection, nprobe): the nearest cells that hold ``recall`` of the best ``k`` rows of sample queries.

    The sample is about TUNING_ROWS rows of each collection, chosen by hash and asked about against all rows.
    """
    chosen = _by_hash(F.lit(TUNING_ROWS), F.col("_rows"))
    asked = lookup_join(kb, counts, ["collection"], ["kb_id"]).where(chosen).select("collection", F.col("kb_id").cast("string").alias("query_id"), "vector")
    asked = materialise(asked, "tuning")
    hits = exact_topk(asked, kb, k, block_rows, prune=False).select("collection", "query_id", "kb_id")
    held = fetch_rows(hits, index.rows.select("collection", "kb_id", "cell"), ["collection", "kb_id"], ["query_id"])
    places = _planned(asked, index, None).select("collection", "query_id", F.posexplode("probes").alias("place", "p"))
    places = places.select("collection", "query_id", "place", F.col("p.cell").alias("cell"))
    found = held.join(places, ["collection", "query_id", "cell"])
    return found.groupBy("collection").agg((F.ceil(F.percentile("place", F.lit(recall))) + 1).cast("bigint").alias("nprobe"))


def _probes_of(part: pa.Table, cells: pa.Table) -> pa.Table:
    """Queries with all cells of their collection, nearest first, and the best score each could hold."""
    import pyarrow as pa

    cells, centres = _centre_rows(cells)
    unit = _fitted(_unit_rows(_matrix(part["vector"])), centres.shape[1])
    similarity, reach = unit @ centres.T, cells["reach"].to_numpy()
    directed = (unit * unit).sum(axis=1) > 0
    apart = np.arccos(np.clip(similarity, -1, 1)) - np.arccos(np.clip(reach, -1, 1))
    bound = np.where(directed[:, None], np.cos(np.maximum(apart, 0.0)), 1.0)
    nearest_first = np.argsort(-similarity, axis=1, kind="stable")
    n, m = similarity.shape
    cell = np.broadcast_to(cells["cell"].to_numpy(), (n, m))
    flat = [np.take_along_axis(x, nearest_first, axis=1).ravel() for x in (cell, bound)]
    entries = pa.StructArray.from_arrays([pa.array(flat[0], pa.int32()), pa.array(flat[1])], names=["cell", "bound"])
    probes = pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m), pa.int32()), entries)
    return pa.table(
        {"collection": part["collection"], "query_id": part["query_id"], "vector": part["vector"], "probes": probes, "nprobe": pa.repeat(cells["nprobe"][0], n)}
    )


def _planned(queries: DataFrame, index: CellIndex, nprobe: int | None) -> DataFrame:
    """Queries (collection, query_id, vector) with ``probes`` (cell, bound), nearest first, and ``nprobe``."""
    asked = queries.select("collection", "query_id", F.col("vector").cast("array<float>").alias("vector"))
    probe = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("bound", T.DoubleType())])
    schema = T.StructType([*asked.schema.fields, T.StructField("probes", T.ArrayType(probe)), T.StructField("nprobe", T.LongType())])
    planned = _with_cells(asked, "query_id", index.cells, ["cell", "centre", "reach", "nprobe"], _probes_of, schema)
    return planned if nprobe is None else planned.withColumn("nprobe", F.lit(nprobe).cast("bigint"))


NOT_SEEN = -2 * 10**SCORE_DIGITS


def _best_of_cells(queries: np.ndarray, rows: np.ndarray, cells: pa.Table, members: list[np.ndarray], k: int, nprobe: int | None, exact: bool):
    """(query, row, score) of the ``k`` best rows of each query among the cells it visits; rows in id order.

    Only products of queries with the rows of visited cells are made; scores are whole numbers of the last kept digit.
    """
    cells, centres = _centre_rows(cells)
    directed = (queries * queries).sum(axis=1) > 0
    similarity = _fitted(queries, centres.shape[1]) @ centres.T
    n, m = len(queries), len(rows)
    visits = min(len(centres), nprobe or int(cells["nprobe"][0].as_py()))
    place = np.argsort(np.argsort(-similarity, axis=1, kind="stable"), axis=1, kind="stable")
    units = np.full((n, m), NOT_SEEN, np.int64)

    def visit(open_: np.ndarray) -> None:
        for c in np.flatnonzero(open_.any(axis=0)):
            asked = np.flatnonzero(open_[:, c])
            units[np.ix_(asked, members[c])] = np.rint(queries[asked] @ rows[members[c]].T * 10**SCORE_DIGITS)

    def best() -> tuple[np.ndarray, np.ndarray]:
        take = min(k, m)
        at = np.argpartition(np.arange(m) - units * m, take - 1, axis=1)[:, :take]
        return at, np.take_along_axis(units, at, axis=1)

    seen = place < visits
    visit(seen)
    at, scores = best()
    if exact:
        floor = np.where((scores > NOT_SEEN).sum(axis=1) >= k, scores.min(axis=1) / 10**SCORE_DIGITS, -2.0)
        apart = np.arccos(np.clip(similarity, -1, 1)) - np.arccos(np.clip(cells["reach"].to_numpy(), -1, 1))
        bound = np.where(directed[:, None], np.cos(np.maximum(apart, 0.0)), 1.0)
        visit(~seen & (bound + 10.0**-SCORE_DIGITS >= floor[:, None]))
        at, scores = best()
    query, column = np.nonzero(scores > NOT_SEEN)
    return query, at[query, column], scores[query, column]


def _search_small_index(small_rows, small_cells, k: int, nprobe: int | None, exact: bool):
    """Over partitions of queries, with the whole index at hand."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import pyarrow.compute as pc

        table, cells = small_rows.value, small_cells.value
        known = {}
        for batch in batches:
            part = pa.Table.from_batches([batch])
            for collection in part["collection"].unique().to_pylist():
                if collection not in known:
                    own = table.filter(pc.equal(table["collection"], collection)).sort_by("kb_id")
                    ours = cells.filter(pc.equal(cells["collection"], collection)).sort_by("cell")
                    cell = own["cell"].to_numpy()
                    members = [np.flatnonzero(cell == c) for c in ours["cell"].to_pylist()]
                    known[collection] = own["kb_id"].to_numpy(), _unit_rows(_matrix(own["vector"])) if own.num_rows else None, ours, members
                ids, rows, ours, members = known[collection]
                if rows is None:
                    continue
                asked = part.filter(pc.equal(part["collection"], collection)).combine_chunks()
                unit = _fitted(_unit_rows(_matrix(asked["vector"])), rows.shape[1])
                step = max(1, SCORES_AT_ONCE // len(rows))
                for start in range(0, len(unit), step):
                    query, row, score = _best_of_cells(unit[start : start + step], rows, ours, members, k, nprobe, exact)
                    chosen = asked.slice(start, step).take(pa.array(query))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "collection": chosen["collection"].combine_chunks(), "query_id": chosen["query_id"].combine_chunks(),
                            "kb_id": pa.array(ids[row]), "score": pa.array(score / 10**SCORE_DIGITS),
                        }
                    )

    return search


# What a query needs to know of the cells of its collection.
SHELVED = ["cell", "centre", "reach", "nprobe", "shelf"]


def _on_shelves(cells: DataFrame, shelf_rows: int) -> DataFrame:
    """``cells`` with ``shelf``: neighbours by number that hold about ``shelf_rows`` rows; a larger cell has its own."""
    before = Window.partitionBy("collection").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    held = cells.withColumn("_before", F.floor(F.coalesce(F.sum("members").over(before), F.lit(0)) / shelf_rows))
    return held.withColumn("shelf", (F.dense_rank().over(Window.partitionBy("collection").orderBy("_before")) - 1).cast("int")).drop("_before")


def _opened_schema(asked: DataFrame) -> T.StructType:
    """Queries with the cells they visit, as a list where it is short and as bits by cell number, and the shelves of these."""
    numbers = T.ArrayType(T.IntegerType())
    return T.StructType([*asked.schema.fields, T.StructField("cells", numbers), T.StructField("open", T.BinaryType()), T.StructField("shelves", numbers)])


def _lists(mask: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """For each row the ``values`` of its true columns."""
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum(mask.sum(axis=1))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[np.nonzero(mask)[1]], pa.int32()))


def _opened(part: pa.Table, cells: pa.Table, mask: np.ndarray, listed: bool) -> pa.Table:
    import pyarrow as pa

    number, shelf = cells["cell"].to_numpy(), cells["shelf"].to_numpy()
    bits = np.zeros((len(mask), int(number.max(initial=0)) + 1), bool)
    bits[:, number] = mask
    shelves, at = np.unique(shelf, return_inverse=True)
    touched = np.zeros((len(mask), len(shelves)), bool)
    for i in range(len(shelves)):
        touched[:, i] = mask[:, at == i].any(axis=1)
    return pa.table(
        {
            "collection": part["collection"], "query_id": part["query_id"], "vector": part["vector"],
            "cells": _lists(mask, number) if listed else pa.nulls(len(mask), pa.list_(pa.int32())),
            "open": pa.array([row.tobytes() for row in np.packbits(bits, axis=1)], pa.binary()), "shelves": _lists(touched, shelves),
        }
    )


def _nearest(nprobe: int | None):
    """Queries with their nearest cells."""

    def nearest(part: pa.Table, cells: pa.Table) -> pa.Table:
        cells, centres = _centre_rows(cells)
        similarity = _fitted(_unit_rows(_matrix(part["vector"])), centres.shape[1]) @ centres.T
        visits = min(len(centres), nprobe or int(cells["nprobe"][0].as_py()))
        mask = np.zeros(similarity.shape, bool)
        np.put_along_axis(mask, np.argsort(-similarity, axis=1, kind="stable")[:, :visits], True, axis=1)
        return _opened(part, cells, mask, visits <= len(np.unique(cells["shelf"].to_numpy())))

    return nearest


def _visited(part: pa.Table, numbers: np.ndarray) -> np.ndarray:
    """For each query whether it visits the cells ``numbers``."""
    bits = part["open"].combine_chunks().to_pylist()
    width = max(map(len, bits))
    packed = np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), width)
    return np.unpackbits(packed, axis=1)[:, numbers].astype(bool)


def _left_open(part: pa.Table, cells: pa.Table) -> pa.Table:
    """Queries with the cells not yet visited (``open``) that could hold a row at least as good as ``floor``."""
    cells, centres = _centre_rows(cells)
    unit = _fitted(_unit_rows(_matrix(part["vector"])), centres.shape[1])
    apart = np.arccos(np.clip(unit @ centres.T, -1, 1)) - np.arccos(np.clip(cells["reach"].to_numpy(), -1, 1))
    bound = np.where((unit * unit).sum(axis=1)[:, None] > 0, np.cos(np.maximum(apart, 0.0)), 1.0)
    floor = part["floor"].fill_null(-2.0).to_numpy()
    mask = ~_visited(part, cells["cell"].to_numpy()) & (bound + 10.0**-SCORE_DIGITS >= floor[:, None])
    return _opened(part, cells, mask, False)


def _best_of_shelf(k: int):
    """For one block of queries and one shelf: the ``k`` best rows of each query among the cells it visits."""

    def best(asked: pa.Table, rows: pa.Table) -> pa.Table:
        import pyarrow as pa

        kinds = {"collection": asked.schema.field("collection").type, "query_id": asked.schema.field("query_id").type,
                 "kb_id": rows.schema.field("kb_id").type, "score": pa.float64()}
        if asked.num_rows == 0 or rows.num_rows == 0:
            return pa.table({name: pa.array([], kind) for name, kind in kinds.items()})
        rows = rows.sort_by([("cell", "ascending"), ("kb_id", "ascending")])
        ids, unit = rows["kb_id"].to_numpy(), _unit_rows(_matrix(rows["vector"]))
        numbers, starts = np.unique(rows["cell"].to_numpy(), return_index=True)
        ends = np.append(starts[1:], len(ids))
        # On equal scores the lower id wins; one integer per pair orders by score, then by id.
        place, m, take = np.argsort(np.argsort(ids, kind="stable"), kind="stable"), len(ids), min(k, len(ids))
        queries, visits = _fitted(_unit_rows(_matrix(asked["vector"])), unit.shape[1]), _visited(asked, numbers)
        step = max(1, SCORES_AT_ONCE // m)
        everywhere = np.flatnonzero(visits.all(axis=1))
        at, scores = _best_rows(queries[everywhere], unit, k, place)
        found = [(np.repeat(everywhere, take), at.ravel(), scores.ravel())]
        some = np.flatnonzero(~visits.all(axis=1))
        for start in range(0, len(some), step):
            asked_now = some[start : start + step]
            strip, visited = queries[asked_now], visits[asked_now]
            units = np.full((len(strip), m), NOT_SEEN, np.int64)
            for c in np.flatnonzero(visited.any(axis=0)):
                at = np.flatnonzero(visited[:, c])
                at = slice(None) if len(at) == len(strip) else at
                units[at, starts[c] : ends[c]] = np.rint(strip[at] @ unit[starts[c] : ends[c]].T * 10**SCORE_DIGITS)
            best = np.argpartition(place - units * m, take - 1, axis=1)[:, :take]
            scores = np.take_along_axis(units, best, axis=1)
            query, column = np.nonzero(scores > NOT_SEEN)
            found.append((asked_now[query], best[query, column], scores[query, column]))
        query, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
        chosen = asked.select(["collection", "query_id"]).take(pa.array(query))
        return chosen.append_column("kb_id", pa.array(ids[row], kinds["kb_id"])).append_column("score", pa.array(score / 10**SCORE_DIGITS))

    return best


def _search_shelves(opened: DataFrame, rows: DataFrame, shelved: DataFrame, k: int, shelf_rows: int) -> DataFrame:
    """Rows among which are the ``k`` best of the cells that each query visits.

    A query is copied once for each shelf with such a cell, a row once for each block of queries of its collection; a
    task holds one shelf and one block. A shelf that a large cell makes too big is cut by id hash.
    """
    asked = materialise(opened.groupBy("collection").agg(F.ceil(F.count(F.lit(1)) / max(1, shelf_rows // 4)).cast("int").alias("_blocks")), "asked")
    shelves = shelved.groupBy("collection", "shelf").agg(F.ceil(F.sum("members") / (2 * shelf_rows)).cast("int").alias("_parts"))
    shelves = materialise(shelves.join(asked, "collection"), "grid")
    cells = shelved.select("collection", "cell", "shelf").join(shelves, ["collection", "shelf"])
    once = opened.select("collection", "query_id", "vector", "open", F.explode("shelves").alias("shelf"))
    left = lookup_join(once, shelves, ["collection", "shelf"], ["query_id"]).select(
        "collection", "shelf", "query_id", "vector", "open",
        F.pmod(F.xxhash64("query_id"), "_blocks").cast("int").alias("_block"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"),
    )
    stored = lookup_join(in_named_partitions(rows, asked, "collection"), cells, ["collection", "cell"], ["kb_id"]).where(F.col("_blocks").isNotNull())
    right = stored.select(
        *[F.col(c).alias(c) for c in ("collection", "shelf", "cell", "kb_id", "vector")],
        F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), F.pmod(F.xxhash64("kb_id"), "_parts").cast("int").alias("_part"),
    )
    schema = T.StructType([left.schema["collection"], left.schema["query_id"], right.schema["kb_id"], T.StructField("score", T.DoubleType())])
    groups = ["collection", "shelf", "_part", "_block"]
    return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(_best_of_shelf(k), schema)


def cell_topk(
    queries: DataFrame,
    index: CellIndex,
    k: int = 1,
    nprobe: int | None = None,
    exact: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Top ``k`` rows by cosine inside each query's collection, from the ``nprobe`` nearest cells.

    Without ``nprobe`` each collection's own number counts. Returns collection, query_id, kb_id, score, rank like
    the full search.
    """
    keys = ["collection", "cell"]
    spark = queries.sparkSession
    members, width = index.cells.agg(F.coalesce(F.sum("members"), F.lit(0)), F.coalesce(F.max(F.size("centre")), F.lit(1))).first()
    if members <= min(block_rows, BLOCK_BYTES // (4 * max(1, width))):
        # The index tells how many rows it has, so a small one is sent to the queries without a count.
        small = [spark.sparkContext.broadcast(df.toArrow()) for df in (index.rows.select(*keys, "kb_id", "vector"), index.cells)]
        asked = queries.select("collection", "query_id", F.col("vector").cast("array<float>").alias("vector"))
        schema = T.StructType([*asked.schema.fields[:2], index.rows.schema["kb_id"], T.StructField("score", T.DoubleType())])
        dealt = asked.repartition(spark.sparkContext.defaultParallelism, "query_id")
        return rank_hits(dealt.mapInArrow(_search_small_index(*small, k, nprobe, exact), schema), k)
    asked = queries.select("collection", "query_id", F.col("vector").cast("array<float>").alias("vector"))
    shelf_rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * max(1, width))))
    shelved = materialise(_on_shelves(index.cells, shelf_rows), "shelves")
    probed = materialise(_with_cells(asked, "query_id", shelved, SHELVED, _nearest(nprobe), _opened_schema(asked)), "probes")
    # A query goes once to a shelf and not once to a cell, where it visits more cells than there are shelves.
    own = F.max("nprobe") if nprobe is None else F.lit(nprobe)
    sizes = shelved.groupBy("collection").agg(
        F.count("cell").alias("cells"), (F.max("shelf") + 1).alias("shelves"), F.least(F.count("cell"), own).alias("visits")
    )
    copied, unseen = sizes.agg(F.bool_or(F.expr("visits > shelves")), F.bool_or(F.expr("visits < cells"))).first()
    if not copied:
        found = candidates(probed.select("collection", F.explode("cells").alias("cell"), "query_id", "vector"), index.rows, k, keys, block_rows)
    else:
        found = _search_shelves(probed, index.rows, shelved, k, shelf_rows)
    first = rank_hits(found, k)
    # No second pass where the first saw every cell.
    if not (exact and unseen):
        return first
    first = materialise(first, "first")
    # The score to beat; a query with fewer than k rows so far has none.
    beaten = first.groupBy("collection", "query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("floor")
    )
    unbeaten = probed.select("collection", "query_id", "vector", "open").join(beaten, ["collection", "query_id"], "left")
    opened = _with_cells(unbeaten, "query_id", shelved, SHELVED, _left_open, _opened_schema(asked))
    second = _search_shelves(opened, index.rows, shelved, k, shelf_rows)
    return rank_hits(first.drop("rank").unionByName(second), k)


# --- stored indexes -------------------------------------------------------------------

STORED_ROWS = "cell int, kb_id bigint, vector array<float>, collection string"
STORED_CELLS = "cell int, centre array<float>, reach double, members bigint, nprobe bigint, collection string"


def save_index(index: CellIndex, path: str) -> None:
    """Store the index; the collections it holds replace those of an earlier one, all at once."""
    spark = index.rows.sparkSession
    before = store.read_state(spark, path)
    part = store.new_part()
    index.rows.hint("rebalance", "collection", "cell").write.partitionBy("collection").parquet(store.folder(path, "rows", part))
    write_collections(index.cells, store.folder(path, "cells", part))
    names = sorted(r[0] for r in index.cells.select("collection").distinct().collect())
    kept = before.without(names)
    store.publish(spark, path, store.State(before.version, [*kept, store.Part(part, names)], None, []))


def load_index(spark: SparkSession, path: str) -> CellIndex:
    state = store.read_state(spark, path)
    return CellIndex(store.read_table(spark, path, "rows", STORED_ROWS, state), store.read_table(spark, path, "cells", STORED_CELLS, state))


def pruned_topk(queries: DataFrame, kb: DataFrame, k: int, nlist: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows among which are the ``k`` best for two large sides: rows in cells of about a block, each query visiting
    those its bound leaves open.

    With as many cells as there are blocks, a query is copied as often as a grid of blocks would copy it when the bound
    leaves all of them open, and less where it does not.
    """
    index = build_index(kb, min(MOST_CELLS, nlist), recall=None)
    return cell_topk(queries, index, k, nprobe=1, exact=True, block_rows=block_rows).drop("rank")
