import dataclasses
import time

import pytest
from pyspark.sql import functions as F
from test_status import SCHEMA as TICKETS
from test_status import ticket

from replyforge.functions.vectors import embed_hashed
from replyforge.operators import cells, embeddings, joins, replies
from replyforge.plans import batch

EMAILS = "ticket string, src_order long, subject string, email_body string"


@pytest.fixture(scope="module")
def world(spark):
    tickets = spark.createDataFrame(
        [
            ticket(1, "IM", "CLOSED", category="loans"), ticket(2, "IM", "REJECTED", category="loans"),
            ticket(3, "IM", "CLOSED", category="other_kyc_issues"), ticket(4, "IM", "CLOSED", category=""),
            ticket(5, "IM", "CLOSED", category="nowhere"), ticket(6, "IM", "CLOSED", category="empty"),
            ticket(7, "IM", "EXPIRED", category="loans"), ticket(8, "IM", "CLOSED", category="bare"),
        ],
        TICKETS,
    )
    emails = spark.createDataFrame(
        [
            ("1", 1, "close my loan", "please"), ("1", 2, "close my loan", "please"), ("1", 3, "other words", " "),
            ("2", 4, "why", "rejected"), ("3", 5, "kyc", "x"), ("4", 6, "a", "b"), ("5", 7, "a", "b"), ("6", 8, "a", "b"),
            ("7", 9, "blank cell", "x"), ("99", 10, "a", "b"), (None, 11, "a", "b"), ("1", 12, " ", None), ("8", 13, "a", "b"),
        ],
        EMAILS,
    )
    rows = spark.createDataFrame(
        [
            ("loans", 1, "close my loan", "please", {"imclosed": "Closed it.", "imexpired": ""}),
            ("loans", 2, "other words", "entirely", {"imclosed": "Other.", "imexpired": ""}),
            ("loans", 3, "blank cell", "x", {"imclosed": "", "imexpired": ""}),
            ("bare", 1, "a", None, {}),
        ],
        "collection string, kb_id long, subject string, email_body string, fields map<string,string>",
    )
    base = ["id", "embedding", "subject", "email_body"]
    names = {"loans": [*base, "imclosed", "imexpired"], "empty": [*base, "imclosed"], "bare": base}
    fields = spark.createDataFrame(
        [(c, f, i) for c, fs in names.items() for i, f in enumerate(fs)], "collection string, field string, ordinal int"
    )
    templates = spark.createDataFrame([("loans", "<p>loans</p>"), ("nowhere", "<p>never</p>")], "collection string, html string")
    return emails, tickets, batch.Knowledge(rows, fields, templates)


WANTED = {
    1: ("search", "Closed it."), 2: ("search", "Closed it."), 3: ("search", "Other."),
    4: ("template_fallback", "<p>loans</p>"), 5: ("skipped", "Skipped search for category: other_kyc_issues"),
    6: ("empty_category", "Failed at category check: Category is empty. Cannot run search."),
    7: ("generic_fallback", replies.GENERIC_REPLY), 8: ("generic_fallback", replies.GENERIC_REPLY),
    9: ("search", replies.GENERIC_REPLY), 10: ("not_found", replies.GENERIC_REPLY), 11: ("not_found", replies.GENERIC_REPLY),
    12: ("no_query_text", "At least one of subject or body must be provided."), 13: ("generic_fallback", replies.GENERIC_REPLY),
}


def outcomes(results):
    return {r.src_order: (r.outcome, r.response_generated) for r in results.collect()}


def test_one_row_for_every_email(world):
    emails, tickets, knowledge = world
    results = batch.reply_to_batch(emails, tickets, knowledge)
    assert results.columns == batch.RESULT_COLUMNS
    assert results.count() == emails.count()
    assert outcomes(results) == WANTED
    errors = {r.src_order: r.error for r in results.collect()}
    assert errors[4].startswith("Field 'imrejected' not found in collection 'loans'. Available fields: ['id', 'embedding'")
    assert errors[7] == "Collection 'nowhere' not found."
    assert errors[8] == "No matching records found in collection 'empty' for field 'imclosed'."
    assert errors[10] == "Collection 'not_found' not found."
    labels = {r.src_order: r.template_referred for r in results.collect()}
    assert [labels[i] for i in (1, 4, 5, 7, 10, 12)] == ["used search", "used fallback", "", "used fallback", "used fallback", "unknown"]


def test_the_cell_index_gives_the_same_replies(world):
    emails, tickets, k = world
    index = cells.build_index(batch.embed_rows(k.rows), nlist=2)
    indexed = batch.Knowledge(k.rows, k.fields, k.templates, index=index, nprobe=1)
    assert outcomes(batch.reply_to_batch(emails, tickets, indexed)) == WANTED


def test_a_text_is_embedded_once(spark, world, tmp_path):
    emails, tickets, k = world
    stored = dataclasses.replace(k, vectors=str(tmp_path / "vectors"))
    asked = spark.sparkContext.accumulator(0)

    def embed(df, text, out):
        def counted(batches):
            for batch_rows in batches:
                asked.add(len(batch_rows))
                yield batch_rows

        return embed_hashed(df.mapInPandas(counted, df.schema), text, out)

    assert outcomes(batch.reply_to_batch(emails, tickets, stored, embed=embed)) == WANTED
    texts = embeddings.read_vectors(spark, stored.vectors)
    first = asked.value
    assert texts.count() == texts.select("text_key").distinct().count() == first
    assert outcomes(batch.reply_to_batch(emails, tickets, stored, embed=embed)) == WANTED
    assert asked.value == first
    more = k.rows.unionByName(spark.createDataFrame([("loans", 9, "new", "row", {"imclosed": "N"})], k.rows.schema))
    again = dataclasses.replace(stored, rows=more)
    assert outcomes(batch.reply_to_batch(emails, tickets, again, embed=embed)) == WANTED
    assert asked.value == first + 1


def test_generator_errors_stay_in_their_row(world):
    def echo():
        def answer(prompt):
            if "<p>loans</p>" in prompt:
                raise ValueError("no template today")
            return "Email Body:\n" + prompt.split("- imclosed: ")[-1].split("\n")[0]

        return answer

    emails, tickets, knowledge = world
    got = outcomes(batch.reply_to_batch(emails, tickets, knowledge, generator=echo, retries=2, delay=0.0))
    assert got[1] == ("search", "Closed it.") and got[3] == ("search", "Other.")
    assert got[4] == ("error", "Error: Failed after 2 attempts: no template today")
    assert {k: got[k] for k in (5, 6, 7, 10)} == {k: WANTED[k] for k in (5, 6, 7, 10)}


def test_a_stopped_run_is_resumed(spark, tmp_path):
    """The second chunk fails before it asks; the next run asks the rest, and no prompt twice."""
    path, log, stop = str(tmp_path / "answers"), tmp_path / "log", tmp_path / "stop"
    prompts = spark.createDataFrame([(i, f"p{i % 40}") for i in range(80)], "src_order long, prompt string")

    def opened():
        def answer(prompt):
            with open(log, "a") as f:
                f.write(prompt + "\n")
            if prompt == "p7" and stop.exists():
                raise ValueError("not now")
            return prompt.upper()

        if stop.exists() and log.exists() and log.stat().st_size and sum(1 for _ in open(log)) >= 10:
            raise RuntimeError("the service is gone")
        return answer

    stop.touch()
    with pytest.raises(Exception, match="the service is gone"):
        replies.generate(prompts, opened, ["src_order"], retries=1, answers=path, chunk=10)
    kept = replies.read_answers(spark, path).where("generated IS NOT NULL").count()
    assert 0 < kept < 40
    stop.unlink()
    done = replies.generate(prompts, opened, ["src_order"], retries=1, answers=path, chunk=10).collect()
    assert sorted((r.src_order, r.generated, r.generation_error) for r in done) == [(i, f"P{i % 40}", None) for i in range(80)]
    asked = log.read_text().split()
    assert sorted(set(asked)) == sorted(f"p{i}" for i in range(40))
    assert len(asked) - len(set(asked)) <= 1 and all(p == "p7" for p in asked if asked.count(p) > 1)


def test_calls_keep_the_rate(spark, tmp_path):
    log = str(tmp_path / "log")

    def opened():
        def answer(prompt):
            with open(log, "a") as f:
                f.write(f"{time.time()}\n")
            return prompt

        return answer

    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "src_order long, prompt string")
    replies.generate(prompts, opened, ["src_order"], answers=str(tmp_path / "a"), per_second=20.0, chunk=40).collect()
    times = sorted(float(x) for x in open(log).read().split())
    assert len(times) == 40
    # A core starts a call every 8 / 20 seconds; some cores have more than 40 / 8 of the prompts.
    assert max(sum(t <= x < t + 1 for x in times) for t in times) <= 30 and times[-1] - times[0] > 1.2


def test_prompts_are_generated_once_and_retried(spark, tmp_path):
    log = str(tmp_path / "log")

    def opened():
        tries = {}

        def answer(prompt):
            tries[prompt] = tries.get(prompt, 0) + 1
            with open(log, "a") as f:
                f.write(f"{prompt}\n")
            if tries[prompt] < 3:
                raise TimeoutError("busy")
            return f"answer {prompt}"

        return answer

    df = spark.createDataFrame([(i, "same" if i < 50 else None) for i in range(60)], "id int, prompt string")
    got = replies.generate(df, opened, ["id"], retries=5, delay=0.0).collect()
    assert sorted((r.id, r.generated) for r in got) == [(i, "answer same" if i < 50 else None) for i in range(60)]
    assert open(log).read().split() == ["same"] * 3


def test_resume_adds_nothing(world):
    emails, tickets, knowledge = world
    first = batch.reply_to_batch(emails, tickets, knowledge)
    assert batch.not_done(emails, first).count() == 0
    assert batch.not_done(emails, first.where("ticket is not null")).count() == emails.where("ticket is null").count()
    again = first.withColumn("outcome", F.when(F.col("ticket") == "2", "error").otherwise(F.col("outcome")))
    assert [r.ticket for r in batch.not_done(emails, again, retry_errors=True).collect()] == ["2"]
    assert batch.append_results(first, first.drop("error")).count() == 2 * emails.count()


def test_no_broadcast_and_every_key_hot(spark, world, monkeypatch):
    """The other way of every join: nothing is small, and each repeated key is cut into parts."""
    emails, tickets, knowledge = world
    original = joins.hot_keys
    monkeypatch.setattr(joins, "fits_broadcast", lambda *_: False)
    monkeypatch.setattr(joins, "hot_keys", lambda df, keys, _: original(df, keys, 1))
    copies = emails.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(39))))
    many = copies.withColumn("src_order", F.col("src_order") + F.col("copy") * 100).drop("copy")
    results = batch.reply_to_batch(many, tickets, knowledge)
    got = results.groupBy(F.pmod("src_order", F.lit(100)).alias("n"), "outcome", "response_generated").count().collect()
    assert {(r.n, r.outcome, r.response_generated, r["count"]) for r in got} == {(n, *w, 40) for n, w in WANTED.items()}


def test_batches_without_emails_or_searches(world):
    emails, tickets, knowledge = world
    assert batch.reply_to_batch(emails.where("src_order < 0"), tickets, knowledge).count() == 0
    unsearched = batch.reply_to_batch(emails.where("ticket in ('3', '5', '99')"), tickets, knowledge)
    assert outcomes(unsearched) == {k: WANTED[k] for k in (5, 7, 10)}


def test_single_ticket_uses_subject_for_a_blank_body(spark, world):
    _, tickets, knowledge = world
    row = batch.reply_to_ticket(spark, "1", "other words", " ", tickets, knowledge).first()
    assert (row.outcome, row.response_generated) == ("search", "Other.")


def test_escape_changes_the_stored_text(spark, world):
    _, tickets, knowledge = world
    emails = spark.createDataFrame([("1", 1, 'a "b" $', None)], EMAILS)
    row = batch.reply_to_batch(emails, tickets, knowledge, escape=True).first()
    assert (row.subject, row.email_body) == ('a \\"b\\" \\$', "")


def test_default_label(spark):
    df = spark.createDataFrame([("1", None), ("2", "used search")], "ticket string, template_referred string")
    assert [r[1] for r in batch.label_missing(df).orderBy("ticket").collect()] == ["unknown", "used search"]


def test_status_naming_a_base_column(spark, world):
    _, _, knowledge = world
    tickets = spark.createDataFrame([ticket(1, None, lr="subject", category="loans"), ticket(2, None, lr="id", category="loans")], TICKETS)
    emails = spark.createDataFrame([("1", 1, "close my loan", "please"), ("2", 2, "other words", None)], EMAILS)
    assert outcomes(batch.reply_to_batch(emails, tickets, knowledge)) == {1: ("search", "close my loan"), 2: ("search", "2")}
    got = outcomes(batch.reply_to_batch(emails, tickets, knowledge, generator=lambda: str.strip))
    assert {o for o, _ in got.values()} == {"search"}
