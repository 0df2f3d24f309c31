import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from replyforge.operators import catalog
from replyforge.plans import batch, ingest
from replyforge.sources import readers, records, writers
from replyforge.streaming import replies as stream


def test_tickets_are_text_and_words_for_missing_are_null(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        'Ticket ID,ticket_id,data_from,Loan Status,repayment_status,new\n007,,IM,NaN,null,"A,""b"""\n8,9,NA,CLOSED,, C \n'
    )
    rows = readers.read_tickets(spark, str(tmp_path)).orderBy("src_order").collect()
    assert [(r.ticket, r.alt_ticket, r.data_from, r.loan_status, r.repayment_status, r.lr_status, r.category_raw) for r in rows] == [
        ("007", None, "IM", None, None, "", 'A,"b"'), ("8", "9", None, "CLOSED", None, "", " C "),
    ]


def test_batch_needs_its_columns(spark, tmp_path):
    (tmp_path / "ok.csv").write_text('Ticket ID,subject,email_body\n1,"two\nlines",\n2,s, b \n3,x,y\n')
    (tmp_path / "bad.csv").write_text("Ticket ID,subject\n1,x\n")
    rows = readers.read_batch(spark, str(tmp_path / "ok.csv"), head=2).collect()
    assert [(r.ticket, r.subject, r.email_body) for r in rows] == [("1", "two\nlines", ""), ("2", "s", " b ")]
    with pytest.raises(ValueError, match="email_body"):
        readers.read_batch(spark, str(tmp_path / "bad.csv"))


def test_envelopes_of_every_dialect(spark, tmp_path):
    hit = {"rank": 1, "id": 459, "distance": 1.0000001, "fields": {"subject": "s", "improcessing": "wait"}}
    meta = {"collection": "c", "query_subject": "q", "query_body": "b", "top_k": 1, "results_count": 1}
    (tmp_path / "a.json").write_text(json.dumps({"metadata": meta, "results": [hit]}, indent=2))
    other = {"metadata": {"collection": "c", "timestamp": "2025-07-12T21:20:28", "results_count": 1, "status_field": "f"},
             "results": [{"status": "Under Review", "rank": 1, "fields": {"loan_amount": "50,000"}, "id": "12", "distance": 0.9}]}
    (tmp_path / "b.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(other, indent=2).encode())
    (tmp_path / "c.json").write_text(json.dumps({"error": "Field 'x' not found in collection 'c'."}))
    read = readers.read_envelopes(spark, str(tmp_path)).withColumn("n", F.coalesce(F.size("results"), F.lit(-1)))
    rows = sorted((r.n, r.results[0].id if r.results else None, r.error) for r in read.collect())
    assert rows[0][1:] == (None, "Field 'x' not found in collection 'c'.")
    assert rows[1:] == [(1, "12", None), (1, "459", None)]
    assert {r[0] for r in read.where("n > 0").select(F.col("results")[0]["status"]).collect()} == {None, "Under Review"}


def test_templates_are_whole_files_by_collection_name(spark, tmp_path):
    for name in ("loan_help", "data_erasure_request__", "Two Words"):
        (tmp_path / f"{name}.html").write_text(f"<p>\n{name}\n</p>\n")
    rows = {r.collection: r.html for r in readers.read_templates(spark, str(tmp_path)).collect()}
    # The name is put into collection form, so a trailing underscore does not hide a template.
    assert rows == {
        "loan_help": "<p>\nloan_help\n</p>\n",
        "data_erasure_request": "<p>\ndata_erasure_request__\n</p>\n",
        "two_words": "<p>\nTwo Words\n</p>\n",
    }


RESULT = ("1", 1, "s", "b", "r", "used search", "search", None)


def test_results_appear_when_there_are_some(spark, tmp_path):
    path = str(tmp_path / "results")
    assert readers.read_results(spark, path).count() == 0
    row = spark.createDataFrame([RESULT], readers.RESULTS)
    writers.append_results(row, path)
    writers.append_results(row.withColumn("ticket", F.lit("2")), path)
    assert sorted(r.ticket for r in readers.read_results(spark, path).collect()) == ["1", "2"]
    writers.export_csv(readers.read_results(spark, path), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_reply_texts(spark, tmp_path):
    writers.write_reply_texts(spark.createDataFrame([("a\nb\n",)], "reply string"), str(tmp_path / "r"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "r")).collect()) == ["", "a", "b"]


KB = "kb_id long, subject string, collection string"


def test_replace_and_drop_collections(spark, tmp_path):
    kb = spark.createDataFrame([(1, "x", "a"), (2, "y", "a"), (1, "z", "b'c"), (1, "w", "d")], KB)
    path = str(tmp_path / "kb")
    writers.write_collections(kb, path)
    writers.write_collections(spark.createDataFrame([(9, "new", "a")], KB), path)
    assert sorted(tuple(r) for r in spark.read.schema(KB).parquet(path).collect()) == [(1, "w", "d"), (1, "z", "b'c"), (9, "new", "a")]

    spark.sql(f"CREATE DATABASE kbtest LOCATION '{tmp_path}/db'")
    try:
        writers.save_collections(kb, "kbtest.kb")
        writers.drop_collection(spark, "kbtest.kb", "b'c")
        writers.drop_collection(spark, "kbtest.kb", "never there")
        assert sorted(r.collection for r in spark.table("kbtest.kb").collect()) == ["a", "a", "d"]
        writers.drop_all_collections(spark, "kbtest.kb")
        writers.drop_all_collections(spark, "kbtest.kb")
        assert not spark.catalog.tableExists("kbtest.kb")
    finally:
        spark.sql("DROP DATABASE kbtest CASCADE")


@pytest.fixture(scope="module")
def sheets(tmp_path_factory):
    folder = tmp_path_factory.mktemp("sheets")
    (folder / "Loan Help.csv").write_text(
        'Help for loans,,,\nSubject,Email  Body,IMClosed,IM+ Closed\nclose it,"two\nlines",Closed.,\nempty cells,,,nan\n'
    )
    (folder / "No Body.csv").write_text("t,\nSubject,Mail Body\nx,y\n")
    (folder / "Twins.csv").write_text("t,,,\nSubject,Email Body,a b,a-b\nx,y,1,2\n")
    (folder / "Empty.csv").write_text("t,,\nSubject,Email Body,IM Closed\n")
    (folder / "Wide.csv").write_text("t\nSubject,Email Body," + ",".join(f"c{i}" for i in range(20)) + "\nx,y\n")
    return str(folder)


def test_sheets_as_they_come(spark, tmp_path):
    (tmp_path / "Blank Header.csv").write_text("t,,,\nSubject,Email Body,,Reply\na,b,KEEP,d\n")
    (tmp_path / "Equal.csv").write_text("t,,,\nSubject,Email Body,Reply,Reply\na,b,c,d\n")
    (tmp_path / "No Title.csv").write_text("\nSubject,Email Body,X\na,b,c\n")
    names = [f"c{i}" for i in range(400)]
    (tmp_path / "Broad.csv").write_text("t\nSubject,Email Body," + ",".join(names) + "\na,b," + ",".join(f"v{i}" for i in range(400)) + "\n")
    read = readers.read_sheets(spark, str(tmp_path))
    assert {r.state for r in read.report.collect()} == {"ok"}
    rows = {r.collection: (r.subject, r.email_body, r.fields) for r in read.rows.collect()}
    assert rows["blank_header"] == ("a", "b", {"unnamed_2": "KEEP", "reply": "d"})
    assert rows["equal"] == ("a", "b", {"reply": "c", "reply_1": "d"})
    assert rows["no_title"] == ("a", "b", {"x": "c"})
    assert rows["broad"][2] == {f"c{i}": f"v{i}" for i in range(400)}


def test_hard_sheets(spark, tmp_path):
    (tmp_path / "Broken Headers.csv").write_text('t\nSubject,"Email\nBody",Im Closed,"Im\nRejected"\na,"b\r\nc",1,2\n\nd,"say ""x"", y",3\n')
    (tmp_path / "Commas.csv").write_text('t\nSubject,Email Body,X\na,"' + "," * 5000 + '",c\n')
    (tmp_path / "Open.csv").write_text('t\nSubject,Email Body\na,b\nc,"never closed\nd,e\n')
    (tmp_path / "Bytes.csv").write_bytes(b"t\nSubject,Email Body\na,\xff\xfe\n")
    (tmp_path / "Nothing.csv").write_text("")
    (tmp_path / "Title.csv").write_text("only a title\n")
    (tmp_path / "Mark.csv").write_bytes(b"\xef\xbb\xbf\nSubject,Email Body\nx,y\n")
    (tmp_path / "Literal.csv").write_text('t\nSubject,Email Body,Size\na,b,5" pipe\nc,d,"6"" pipe"\n')
    read = readers.read_sheets(spark, str(tmp_path))
    rows = sorted((r.collection, r.kb_id, r.subject, r.email_body, r.fields) for r in read.rows.collect())
    assert rows == [
        ("broken_headers", 1, "a", "b\nc", {"im_closed": "1", "im_rejected": "2"}),
        ("broken_headers", 2, "d", 'say "x", y', {"im_closed": "3", "im_rejected": ""}),
        ("commas", 1, "a", "," * 5000, {"x": "c"}),
        ("literal", 1, "a", "b", {"size": '5" pipe'}),
        ("literal", 2, "c", "d", {"size": '6" pipe'}),
        ("mark", 1, "x", "y", {}),
    ]
    assert {r.collection: r.state for r in read.report.collect() if r.state != "ok"} == {
        "open": "unreadable: a quote is not closed",
        "bytes": "unreadable: not UTF-8 text",
        "nothing": "no header line",
        "title": "no header line",
    }


def test_a_sheet_in_many_splits(spark, tmp_path):
    lines = "".join(f'{i},"body {i}\nsecond line, {"x" * (i % 90)}",{i}\n' for i in range(500))
    (tmp_path / "Long.csv").write_text("t\nSubject,Email Body,N\n" + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = sorted((r.kb_id, r.subject, r.email_body, r.fields["n"]) for r in readers.read_sheets(spark, str(tmp_path)).rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == [(i + 1, str(i), f"body {i}\nsecond line, {'x' * (i % 90)}", str(i)) for i in range(500)]


def test_sheets_are_read_in_one_scan(spark, sheets):
    read = readers.read_sheets(spark, sheets)
    rows = sorted((r.collection, r.kb_id, r.subject, r.email_body, tuple(sorted(r.fields.items()))) for r in read.rows.collect())
    assert rows == [
        ("loan_help", 1, "close it", "two\nlines", (("im_closed", ""), ("imclosed", "Closed."))),
        ("loan_help", 2, "empty cells", "", (("im_closed", ""), ("imclosed", ""))),
        ("wide", 1, "x", "y", tuple(sorted((f"c{i}", "") for i in range(20)))),
    ]
    fields = sorted((r.ordinal, r.field) for r in read.fields.where("collection = 'loan_help'").collect())
    assert [f for _, f in fields] == ["id", "embedding", "subject", "email_body", "imclosed", "im_closed"]
    report = {r.collection: (r.state, r.similar, r.expected) for r in read.report.collect()}
    assert report["no_body"] == ("missing columns: email_body", "mail_body", 1)
    assert report["wide"][0] == "ok"
    assert report["twins"][0] == "two columns have the same name"
    assert report["empty"] == ("ok", "", 0)


def test_ingest(spark, sheets, tmp_path):
    target = str(tmp_path / "kb")
    first = ingest.ingest_sheets(spark, sheets, target)
    report = {r.collection: (r.state, r.expected, r.stored, r.complete) for r in first.report.collect()}
    assert report["empty"] == ("ok", 0, 0, True)
    assert report["no_body"][0].startswith("missing") and report["no_body"][3] is None
    kb = {(r.collection, r.kb_id): r for r in first.rows.collect()}
    placeholder = kb[("empty", 0)]
    assert placeholder.is_placeholder and placeholder.subject == "" and set(placeholder.vector) == {0.0}
    # A second ingest of one sheet leaves the other collections alone.
    again = tmp_path / "again"
    again.mkdir()
    (again / "Empty.csv").write_text("t,,\nSubject,Email Body,IM Closed\nnow,filled,Closed.\n")
    second = ingest.ingest_sheets(spark, str(again), target)
    assert [(r.collection, r.stored) for r in second.report.collect()] == [("empty", 1)]
    counts = {r.collection: r["rows"] for r in catalog.collection_counts(second.rows).collect()}
    assert counts == {"loan_help": 2, "empty": 1, "wide": 1}


def test_catalog_of_empty_collections(spark):
    fields = spark.createDataFrame([("a", "subject", 0), ("a", "email_body", 1), ("b", "z", 1), ("b", "id", 0)], "collection string, field string, ordinal int")
    assert {r.collection: r.fields for r in catalog.fields_text(fields).collect()} == {"a": "(none)", "b": "id, z"}


def test_numbering_over_many_partitions(spark):
    names = [f"c{i:04d}" for i in range(500)]
    df = spark.createDataFrame([(n,) for n in reversed(names)] * 3, "collection string").repartition(7)
    assert [(r.number, r.collection) for r in catalog.list_collections(df).orderBy("number").collect()] == list(enumerate(names, 1))


def test_verify_finds_lost_rows(spark):
    kb = spark.createDataFrame([("a", 1), ("c", 1)], "collection string, kb_id long")
    expected = spark.createDataFrame([("a", 2), ("b", 1)], "collection string, expected long")
    rows = {r.collection: (r.expected, r.stored, r.complete) for r in catalog.verify_ingest(kb, expected).collect()}
    assert rows == {"a": (2, 1, False), "b": (1, 0, False), "c": (0, 1, False)}


def test_streamed_replies(spark, tmp_path):
    from test_status import SCHEMA, ticket

    inbox, results, checkpoint = (tmp_path / n for n in ("inbox", "results", "checkpoint"))
    inbox.mkdir()
    tickets = spark.createDataFrame([ticket(1, "IM", "CLOSED", category="loans")], SCHEMA)

    def load():
        rows = spark.createDataFrame([("loans", 1, "close", "it", {"imclosed": "Closed."})], "collection string, kb_id long, subject string, email_body string, fields map<string,string>")
        fields = spark.createDataFrame([("loans", "imclosed", 4)], "collection string, field string, ordinal int")
        return batch.Knowledge(rows, fields, spark.createDataFrame([("x", "y")], "collection string, html string"))

    def run():
        emails = stream.read_email_stream(spark, str(inbox))
        query = stream.start_replies(emails, tickets, load, str(results), str(checkpoint))
        query.awaitTermination()

    def answers():
        told = [(r.ticket, r.src_order, r.outcome, r.response_generated) for r in readers.read_results(spark, str(results)).collect()]
        return sorted(told, key=lambda r: r[1])

    (inbox / "1.csv").write_text("ticket,src_order,subject,email_body\n1,1,close,it\n")
    run()
    assert answers() == [("1", 1, "search", "Closed.")]
    (inbox / "2.csv").write_text("ticket,src_order,subject,email_body\n1,2,again,it\n5,3,lost,x\n,4,none,y\n,5,none,z\n")
    run()
    run()
    assert sorted((a[1], a[2]) for a in answers()) == [(1, "search"), (3, "not_found"), (4, "not_found"), (5, "not_found")]
    (inbox / "3.csv").write_text("ticket,src_order,subject,email_body\n,6,none,y\n6,7,lost,x\n")
    run()
    assert sorted(a[1] for a in answers()) == [1, 3, 4, 5, 7]


def test_streamed_replies_know_results_of_other_runs(spark, tmp_path):
    inbox, other, results, checkpoint = (tmp_path / n for n in ("inbox", "other", "results", "checkpoint"))
    inbox.mkdir()
    tickets = spark.createDataFrame([], "ticket string, alt_ticket string, src_order long, data_from string, loan_status string, repayment_status string, lr_status string, category_raw string")
    rows = spark.createDataFrame([], "collection string, kb_id long, subject string, email_body string, fields map<string,string>")
    fields = spark.createDataFrame([], "collection string, field string, ordinal int")
    known = batch.Knowledge(rows, fields, spark.createDataFrame([], "collection string, html string"))
    writers.append_results(spark.createDataFrame([("8", *RESULT[1:])], readers.RESULTS), str(other))

    def run():
        emails, earlier = stream.read_email_stream(spark, str(inbox)), stream.read_result_stream(spark, str(other))
        stream.start_replies(emails, tickets, lambda: known, str(results), str(checkpoint), earlier=earlier).awaitTermination()
        return sorted(r.ticket for r in readers.read_results(spark, str(results)).collect())

    (inbox / "1.csv").write_text("ticket,src_order,subject,email_body\n8,1,a,b\n9,2,a,b\n10,3,a,b\n")
    assert run() == ["10", "9"]
    writers.append_results(spark.createDataFrame([("11", *RESULT[1:])], readers.RESULTS), str(other))
    (inbox / "2.csv").write_text("ticket,src_order,subject,email_body\n8,4,a,b\n11,5,a,b\n12,6,a,b\n")
    assert run() == ["10", "12", "9"]


def test_a_resume_leaves_earlier_results_where_they_lie(spark, tmp_path, capsys):
    spark.sql(f"CREATE DATABASE resume LOCATION '{tmp_path}/db'")
    try:
        done = [(str(i), i, "s", "b", "r", "l", "error" if i % 5 == 0 else "search", None) for i in range(0, 60, 2)] + [(None, *RESULT[1:])]
        writers.append_bucketed(spark.createDataFrame(done[:20], readers.RESULTS), "resume.results", 8)
        writers.append_bucketed(spark.createDataFrame(done[20:], readers.RESULTS), "resume.results", 8)
        emails = spark.createDataFrame([(str(i % 70), i) for i in range(140)] + [(None, 900)], "ticket string, src_order long")
        earlier = spark.table("resume.results")
        for retry in (False, True):
            left = {r.src_order for r in batch.not_done(emails, earlier, retry).collect()}
            assert left == {i for i in range(140) if (i % 70) % 2 or i % 70 >= 60 or (retry and (i % 70) % 5 == 0)}
        asked = emails.withColumn("ticket_key", writers.ticket_key(F.col("ticket"))).select("ticket_key").distinct()
        asked.join(earlier.select("ticket_key").hint("merge"), "ticket_key", "left_anti").explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan
        # The last exchange lies above the emails, which come before the results under the join.
        below = plan[plan.rindex("Exchange") :]
        assert below.index("ExistingRDD") < below.index("FileScan") and "Bucketed: true" in below
    finally:
        spark.sql("DROP DATABASE resume CASCADE")


def test_order_by_file_name_and_position(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Ticket ID,subject,email_body\n1,a,x\n2,b,y\n")
    (tmp_path / "b.csv").write_text("Ticket ID,subject,email_body\n" + "".join(f"{i},{'long ' * 9},z\n" for i in range(3, 60)))
    read = readers.read_batch(spark, str(tmp_path)).orderBy("src_order").collect()
    assert [r.ticket for r in read] == [str(i) for i in range(1, 60)]


def test_split_files_keep_their_order(spark, tmp_path):
    for name, ids in (("a", range(0, 400)), ("b", range(400, 403)), ("c", range(403, 900))):
        (tmp_path / f"{name}.csv").write_text("Ticket ID,subject,email_body,n\n" + "".join(f"{i},{'s' * (i % 40)},b,{i}\n" for i in ids))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        read = readers.read_batch(spark, str(tmp_path), multi_line=False)
        assert read.rdd.getNumPartitions() > 5
        rows = read.orderBy("src_order").collect()
        first = readers.read_batch(spark, str(tmp_path), head=7, multi_line=False).collect()
        ordered = readers.read_batch(spark, str(tmp_path), order="n", multi_line=False).where("src_order = 7").first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.ticket for r in rows] == [str(i) for i in range(900)]
    assert [r.ticket for r in first] == [str(i) for i in range(7)] and ordered.ticket == "7"


def test_records_of_long_lines_leave_in_small_batches():
    """Batches are bounded by characters as well as by cells."""
    lines = [b"x" * 50_000 + b",1"] * 2_000
    sent = [pa.RecordBatch.from_pydict({"file": ["f"] * len(lines), "value": pa.array(lines, pa.binary())})]
    got = list(records._cut(iter(sent)))
    assert sum(b.num_rows for b in got) == 2_000 and max(b.nbytes for b in got) < 3 * records.BATCH_CHARACTERS
    assert [n for b in got for n in b.column("line").to_pylist()] == list(range(2_000))
