import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from replyforge.functions import vectors as vec
from replyforge.operators import cells, joins, search
from replyforge.sources import writers

ROWS = "collection string, kb_id long, vector array<float>"
QUERIES = "collection string, query_id string, vector array<float>"


def random_sides(seed=3, dim=8, hot=400):
    """One collection with most rows, small ones, equal vectors, zero vectors, a collection without queries."""
    rng = np.random.default_rng(seed)

    def vector():
        return rng.normal(size=dim).astype("float32").tolist()

    rows = [("hot", i, vector()) for i in range(hot)] + [("small", i, vector()) for i in range(7)] + [("unasked", 1, vector())]
    rows += [("hot", 1000 + i, rows[5][2]) for i in range(5)] + [("hot", 2000, [0.0] * dim), ("small", 8, [0.0] * dim)]
    queries = [("hot", f"q{i}", vector()) for i in range(60)] + [("small", f"s{i}", vector()) for i in range(3)]
    queries += [("hot", "same", rows[5][2]), ("hot", "zero", [0.0] * dim), ("missing", "m", vector())]
    return rows, queries


def brute_force(rows, queries, k):
    answer = []
    for collection, query, v in queries:
        scored = []
        for c, kb_id, w in rows:
            if c == collection:
                a, b = np.array(v, dtype=float), np.array(w, dtype=float)
                length = np.linalg.norm(a) * np.linalg.norm(b)
                scored.append((-round(float(a @ b / length), 6) if length else 0.0, kb_id))
        answer += [(collection, query, kb_id, -s + 0.0, rank) for rank, (s, kb_id) in enumerate(sorted(scored)[:k], 1)]
    return sorted(answer)


def collected(df):
    return sorted((r.collection, r.query_id, r.kb_id, r.score + 0.0, r.rank) for r in df.collect())


@pytest.fixture(scope="module")
def sides(spark):
    rows, queries = random_sides()
    return rows, queries, spark.createDataFrame(rows, ROWS), spark.createDataFrame(queries, QUERIES)


@pytest.mark.parametrize(("k", "block_rows"), [(1, 32768), (5, 100), (5, 50), (10, 16), (1000, 100), (1000, 32768)])
def test_exact_topk_is_brute_force(sides, k, block_rows):
    rows, queries, kb, asked = sides
    assert collected(search.exact_topk(asked, kb, k, block_rows)) == brute_force(rows, queries, k)


@pytest.mark.parametrize("k", [1, 4])
def test_more_queries_than_rows(spark, sides, k):
    rows, queries, _, asked = sides
    few = [r for r in rows if r[0] != "hot" or r[1] % 20 == 0]
    assert len(few) < len(queries)
    assert collected(search.exact_topk(asked, spark.createDataFrame(few, ROWS), k)) == brute_force(few, queries, k)


def test_only_asked_collections_are_read(spark, sides, tmp_path, capsys):
    """The full search over a stored knowledge base reads the partitions of the asked collections."""
    rows, _, kb, asked = sides
    writers.write_collections(kb, str(tmp_path / "kb"))
    stored = spark.read.schema("kb_id long, vector array<float>, collection string").parquet(str(tmp_path / "kb"))
    few = asked.where("collection = 'small'")
    search.exact_topk(few, stored, 2).explain()
    assert re.search(r"PartitionFilters: \[[^\]]*(= small|IN \(small)", capsys.readouterr().out)
    pruned = joins.in_named_partitions(stored, few, "collection")
    files = pruned.select(F.col("_metadata.file_path").alias("f")).distinct().collect()
    assert files and all("/collection=small/" in r.f for r in files)
    assert joins.in_named_partitions(stored, asked, "collection", most=1) is stored


def test_nothing_to_search(sides):
    _, _, kb, asked = sides
    assert search.exact_topk(asked.where("collection = 'missing'"), kb, 3).count() == 0
    assert search.exact_topk(asked, kb.where("kb_id < 0"), 3).count() == 0


def test_hot_collection_is_cut_into_blocks(spark, sides, monkeypatch):
    """No task gets more than a block of either side."""
    _, _, kb, asked = sides
    seen = spark.sparkContext.accumulator(0)

    def watched(keys, k):
        inner = original(keys, k)

        def best(queries, rows):
            if queries.num_rows > 60 or rows.num_rows > 120:
                seen.add(1)
            return inner(queries, rows)

        return best

    original = search._best_of_block
    monkeypatch.setattr(search, "_best_of_block", watched)
    assert search.candidates(asked, kb, 1, block_rows=50).count() > 0
    assert seen.value == 0


@pytest.mark.parametrize("k", [1, 10])
def test_cells_with_bound_are_exact(sides, k):
    rows, queries, kb, asked = sides
    index = cells.build_index(kb, nlist=12)
    assert collected(cells.cell_topk(asked, index, k, nprobe=2, exact=True, block_rows=40)) == brute_force(rows, queries, k)


def test_all_cells_probed_is_exact(sides):
    rows, queries, kb, asked = sides
    index = cells.build_index(kb, nlist=12)
    assert collected(cells.cell_topk(asked, index, 5, nprobe=12)) == brute_force(rows, queries, 5)


def clustered(collections, seed=5, dim=16, tight=0.05):
    """Rows around a few directions, and queries near them."""
    rng = np.random.default_rng(seed)
    rows, queries = [], []
    for name, n in collections.items():
        middles = rng.normal(size=(12, dim))
        near = lambda i: (middles[i % 12] + tight * rng.normal(size=dim)).astype("float32").tolist()  # noqa: B023, E731
        rows += [(name, i, near(i)) for i in range(n)]
        queries += [(name, f"{name}{i}", near(i)) for i in range(n // 3)]
    return rows, queries


def test_every_collection_has_cells_of_its_own(spark):
    rows, queries = clustered({"large": 900, "small": 40, "one": 1})
    rows += [("zero", i, [0.0] * 16) for i in range(3)]
    queries += [("zero", "z", [1.0] * 16), ("one", "o", [0.0] * 16)]
    kb, asked = spark.createDataFrame(rows, ROWS), spark.createDataFrame(queries, QUERIES)
    index = cells.build_index(kb)
    sizes = {r["collection"]: r["n"] for r in index.cells.groupBy("collection").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {"large": 30, "small": 6, "one": 1, "zero": 1}
    probes = {r["collection"]: r["nprobe"] for r in index.cells.collect()}
    assert probes["large"] < 10
    assert {(r["collection"], r["kb_id"]) for r in index.rows.collect()} == {r[:2] for r in rows}
    got, want = collected(cells.cell_topk(asked, index, 10)), brute_force(rows, queries, 10)
    assert len({x[:3] for x in got} & {x[:3] for x in want}) / len(want) >= 0.9
    assert collected(cells.cell_topk(asked, index, 10, nprobe=30)) == want
    # Cells met in a shuffle give what a sent index gives, with and without the bound.
    assert collected(cells.cell_topk(asked, index, 10, block_rows=60)) == got
    assert collected(cells.cell_topk(asked, index, 10, nprobe=2, exact=True)) == want


def test_centres_too_large_to_send(spark, sides, monkeypatch):
    rows, queries, kb, asked = sides
    monkeypatch.setattr(cells, "CENTRE_BYTES", 0)
    monkeypatch.setattr(cells, "BLOCK_ROWS", 50)
    index = cells.build_index(kb, nlist=9)
    assert collected(cells.cell_topk(asked, index, 4, nprobe=2, exact=True)) == brute_force(rows, queries, 4)


def test_two_large_sides_visit_few_cells(spark, monkeypatch):
    """With blocks forced, queries meet the rows of few cells, and the answer is the full one."""
    rows, queries = clustered({"a": 600, "b": 300})
    kb, asked = spark.createDataFrame(rows, ROWS), spark.createDataFrame(queries, QUERIES)
    visits = []
    real = cells.candidates

    def counted(entries, index_rows, *rest):
        sizes = index_rows.groupBy("collection", "cell").agg(F.count(F.lit(1)).alias("n"))
        visits.append(entries.join(sizes, ["collection", "cell"]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        return real(entries, index_rows, *rest)

    monkeypatch.setattr(cells, "candidates", counted)
    assert collected(search.exact_topk(asked, kb, 5, block_rows=25)) == brute_force(rows, queries, 5)
    grid = sum(len([r for r in rows if r[0] == c]) * len([q for q in queries if q[0] == c]) for c in "ab")
    assert 0 < sum(visits) < grid / 3


@pytest.mark.parametrize(("exact", "nprobe", "shelf"), [(False, 12, 32768), (True, 5, 32768), (True, 5, 60), (False, 12, 20)])
def test_a_query_goes_once_to_a_shelf_of_cells(sides, monkeypatch, exact, nprobe, shelf):
    """Not once to each cell that it visits; shelves of many cells, of a few and of parts of a large cell."""
    rows, queries, kb, asked = sides
    index = cells.build_index(kb, nlist=12, recall=None)
    monkeypatch.setattr(cells, "BLOCK_ROWS", shelf)
    copies, real = [], cells.candidates
    monkeypatch.setattr(cells, "candidates", lambda entries, *rest: (copies.append(entries.count()), real(entries, *rest))[1])
    assert collected(cells.cell_topk(asked, index, 5, nprobe=nprobe, exact=exact, block_rows=40)) == brute_force(rows, queries, 5)
    assert sum(copies) <= len(queries)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_few_products_are_made_in_full(monkeypatch, k):
    """Single precision finds the rows near the k-th score; ties, zero vectors and values that are no numbers included."""
    rng = np.random.default_rng(4)
    unit = lambda m: search._unit_rows(m.copy())
    rows, queries = rng.normal(size=(3000, 48)), rng.normal(size=(90, 48))
    rows[200:400] = rows[7]
    rows[500:503] = rows[11]
    rows[900], queries[4] = 0.0, 0.0
    queries[5], queries[6] = rows[7], rows[11]
    queries[7] = rows[11] + 1e-7
    rows, queries = unit(rows), unit(queries)
    in_full, real = [], search._scored
    monkeypatch.setattr(search, "_scored", lambda q, *rest: (in_full.append(len(q)), real(q, *rest))[1])
    monkeypatch.setattr(search, "SCORES_AT_ONCE", 3000 * 20)
    at, scores = search._best_rows(queries, rows, k)
    units = np.rint(queries @ rows.T * 10**search.SCORE_DIGITS).astype(np.int64)
    want = np.lexsort((np.broadcast_to(np.arange(3000), units.shape), -units), axis=1)[:, :k]
    for i in range(90):
        assert set(at[i]) == set(want[i]) and sorted(scores[i]) == sorted(units[i, want[i]])
    # The zero query and the one with two hundred equal rows.
    assert sum(in_full) == 2


def test_index_round_trip(spark, sides, tmp_path):
    rows, queries, kb, asked = sides
    path = str(tmp_path / "index")
    cells.save_index(cells.build_index(kb, nlist=6), path)
    # A later index of one collection replaces that one alone.
    cells.save_index(cells.build_index(kb.where("collection = 'hot'"), nlist=4), path)
    index = cells.load_index(spark, path)
    assert index.cells.groupBy("collection").count().where("count = 4 AND collection = 'hot'").count() == 1
    assert collected(cells.cell_topk(asked, index, 3, nprobe=1, exact=True)) == brute_force(rows, queries, 3)


def test_placeholders_are_not_searched(spark):
    kb = spark.createDataFrame([("c", 1, False), ("c", 2, True)], "collection string, kb_id long, is_placeholder boolean")
    assert [r.kb_id for r in search.searchable(kb).collect()] == [1]


def test_normalise_and_fit(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    unit = [r[0] for r in df.select(vec.l2_normalise(F.col("v"))).collect()]
    assert unit == [[0.6, 0.8], [0.0, 0.0]]
    fitted = df.select(vec.fit_dim(F.col("v"), 3).alias("a"), vec.fit_dim(F.col("v"), 1).alias("b"), vec.fit_dim(F.col("v")).alias("c")).first()
    assert (fitted.a, fitted.b, len(fitted.c)) == ([3.0, 4.0, 0.0], [3.0], 384)


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(vec.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0
    assert df.select(vec.match_percent(vec.cosine(F.col("a"), F.col("a")))).first()[0] == 100.0


def test_embedding_is_whole_text_and_unit_length(spark):
    long_text = "word " * 30000 + "last"
    df = spark.createDataFrame([("a b",), (long_text,), ("  ",), (None,)], "t string")
    vectors = [r.v for r in vec.embed_hashed(df, "t", "v").select("v").collect()]
    assert [round(float(np.linalg.norm(v)), 6) for v in vectors] == [1.0, 1.0, 0.0, 0.0]
    assert sum(x != 0 for x in vectors[1]) == 2


@pytest.mark.parametrize(
    ("wanted", "found"),
    [("Status", "Status"), ("status", "Status"), ("stat", "Status"), ("my_loan_id_x", "loan_id"), ("zzz", None), ("", None)],
)
def test_fuzzy_field(spark, wanted, found):
    df = spark.createDataFrame([(wanted, ["pk", "Status", "loan_id", "status_2"])], "w string, f array<string>")
    assert df.select(search.resolve_field(F.col("w"), F.col("f"))).first()[0] == found


def test_fuzzy_field_prefers_schema_order(spark):
    df = spark.createDataFrame([("STATUS", ["my_status", "Status", "sTATUS"])], "w string, f array<string>")
    assert df.select(search.resolve_field(F.col("w"), F.col("f"))).first()[0] == "Status"


def test_envelopes_for_every_query(spark):
    asked = spark.createDataFrame(
        [(1, "c", "s", "b", "f", 3, None), (2, "c", "s", "b", "f", 3, "failed"), (3, "c", "s", "b", "f", 3, None)],
        "query_id long, collection string, query_subject string, query_body string, status_field string, top_k int, error string",
    )
    schema = "query_id long, rank int, id string, distance double, status string, fields map<string,string>"
    hits = spark.createDataFrame([(q, r, str(r), 1.0 / r, "x", {"f": "x"}) for q in (1, 2) for r in (3, 1, 2)], schema)
    found = {e.query_id: e for e in search.envelopes(asked, hits, F.lit("now")).collect()}
    assert found[1].metadata.results_count == 3 and [r.rank for r in found[1].results] == [1, 2, 3] and found[1].error is None
    assert found[2].error == "failed" and found[2].results is None and found[2].metadata.timestamp == "now"
    assert found[3].error == "No matching records found in collection 'c' for field 'f'." and found[3].metadata.results_count == 0


def test_top_status_is_null_when_empty(spark):
    hits = spark.createDataFrame([(1, 1, ""), (2, 1, "s"), (2, 2, "t")], "query_id int, rank int, status string")
    assert sorted(tuple(r) for r in search.top_status(hits).collect()) == [(1, None), (2, "s")]


def test_missing_and_narrow_vectors():
    import pyarrow as pa

    column = pa.chunked_array([pa.array([[1.0, 0.0, 0.0], None, [0.0, 2.0]], pa.list_(pa.float32()))])
    rows = search._unit_rows(search._matrix(column))
    assert rows.tolist() == [[1, 0, 0], [0, 0, 0], [0, 1, 0]]
    at, scores = search._best_rows(search._unit_rows(np.array([[3.0, 4.0]])), rows, 2)
    assert at.tolist() == [[2, 0]] and scores.tolist() == [[800000, 600000]]
