"""The store changes as a whole or not at all."""

import pytest
from pyspark.sql import functions as F

from replyforge.operators import catalog
from replyforge.plans import ingest
from replyforge.sources import store, writers


def sheet(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.csv").write_text("t\nSubject,Email Body,X\n" + "".join(line + "\n" for line in lines))


def seen(spark, path):
    now = ingest.read_store(spark, path)
    rows = sorted((r.collection, r.kb_id, r.subject, r.fields.get("x")) for r in now.rows.collect())
    fields = sorted((r.collection, r.ordinal, r.field) for r in now.fields.collect())
    report = sorted((r.collection, r.state, r.stored, r.intact) for r in now.report.collect())
    return rows, fields, report


@pytest.fixture
def stored(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "store")
    sheet(source, "A", "a,b,1", "c,d,2")
    sheet(source, "B c", "e,f,3")
    ingest.ingest_sheets(spark, str(source), path)
    return path


def test_an_ingest_that_stops_leaves_the_old_state(spark, tmp_path, stored, monkeypatch):
    before = seen(spark, stored)
    assert before[0] == [("a", 1, "a", "1"), ("a", 2, "c", "2"), ("b_c", 1, "e", "3")]
    assert before[2] == [("a", "ok", 2, True), ("b_c", "ok", 1, True)]
    sheet(tmp_path / "more", "A", "new,b,9")
    for stop in ("write_collections", "verify_content"):
        calls = []

        def fail(*args, real=getattr(ingest, stop), calls=calls):
            calls.append(args)
            # The first table is written, the second is not.
            if len(calls) == 2 or stop == "verify_content":
                raise OSError("stopped")
            return real(*args)

        with monkeypatch.context() as m:
            m.setattr(ingest, stop, fail)
            with pytest.raises(OSError):
                ingest.ingest_sheets(spark, str(tmp_path / "more"), stored)
        assert seen(spark, stored) == before
    ingest.ingest_sheets(spark, str(tmp_path / "more"), stored)
    rows, fields, report = seen(spark, stored)
    assert rows == [("a", 1, "new", "9"), ("b_c", 1, "e", "3")]
    assert report == [("a", "ok", 1, True)] and {f[0] for f in fields} == {"a", "b_c"}


def test_a_drop_is_whole(spark, stored, monkeypatch):
    before = seen(spark, stored)
    with monkeypatch.context() as m:
        m.setattr(store, "publish", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            store.drop(spark, stored, ["a"])
    assert seen(spark, stored) == before

    def stop():
        raise OSError("stopped before the folders were removed")

    with pytest.raises(OSError):
        store.drop(spark, stored, ["a", "never there"], published=stop)
    rows, fields, report = seen(spark, stored)
    assert {r[0] for r in rows} == {f[0] for f in fields} == {r[0] for r in report} == {"b_c"}
    store.drop(spark, stored)
    assert seen(spark, stored) == ([], [], [])


def test_two_writers_do_not_overwrite_each_other(spark, stored):
    mine = store.read_state(spark, stored)
    store.drop(spark, stored, ["a"])
    with pytest.raises(RuntimeError, match="changed"):
        store.publish(spark, stored, mine)
    assert store.read_state(spark, str(stored) + "/nothing") == store.State()


def test_content_check_sees_one_cell(spark):
    schema = "collection string, kb_id long, subject string, email_body string, fields map<string,string>"
    rows = [("a", i, f"s{i}", None, {"x": "1", "y": None}) for i in range(20)] + [("b", 1, "s", "t", {}), ("c", 1, "s", "t", {}), ("c", 1, "s", "t", {})]
    sent = spark.createDataFrame(rows, schema)
    stored = sent.repartition(7).withColumn("fields", F.when((F.col("collection") == "a") & (F.col("kb_id") == 7), F.create_map(F.lit("x"), F.lit("2"), F.lit("y"), F.lit(None))).otherwise(F.col("fields")))
    sheets = sent.groupBy("collection").agg(F.count(F.lit(1)).alias("expected"))
    found = {r.collection: (r.complete, r.intact) for r in catalog.verify_content(stored, sent, sheets).collect()}
    assert found == {"a": (True, False), "b": (True, True), "c": (True, True)}
    once = stored.dropDuplicates(["collection", "kb_id"])
    found = {r.collection: (r.complete, r.intact) for r in catalog.verify_content(once, sent, sheets).collect()}
    assert found["c"] == (False, False) and found["b"] == (True, True)


def test_a_long_list_of_collections_is_no_literal(spark, stored, tmp_path, monkeypatch):
    """Its names are joined: the plan stays small, and replaced and dropped collections stay away."""
    sheet(tmp_path / "more", "A", "new,b,9")
    ingest.ingest_sheets(spark, str(tmp_path / "more"), stored)
    before = seen(spark, stored)
    monkeypatch.setattr(store, "MOST_NAMES", 1)
    kb = store.read_table(spark, stored, "kb", ingest.STORED_KB)
    assert "b_c" not in kb._jdf.queryExecution().analyzed().toString()
    assert kb.columns == spark.createDataFrame([], ingest.STORED_KB).columns
    assert seen(spark, stored) == before and before[0] == [("a", 1, "new", "9"), ("b_c", 1, "e", "3")]
    store.drop(spark, stored, ["a", "never there"])
    assert seen(spark, stored) == ([("b_c", 1, "e", "3")], [f for f in before[1] if f[0] == "b_c"], [])


def test_small_collections_are_written_by_many_tasks(spark, tmp_path):
    """One file each is much work for few bytes: one task wrote all of them."""
    rows = spark.range(400).select(F.col("id").alias("kb_id"), F.concat(F.lit("c"), (F.col("id") % 40).cast("string")).alias("collection"))
    writers.write_collections(rows, str(tmp_path / "kb"))
    back = spark.read.parquet(str(tmp_path / "kb"))
    tasks = back.select(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)).distinct().count()
    assert back.count() == 400 and len(back.inputFiles()) == 40 and tasks > 1
