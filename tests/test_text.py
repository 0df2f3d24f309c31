import pytest
from pyspark.sql import functions as F

from replyforge.functions import text as tx
from replyforge.operators import replies


def value(spark, expression, **columns):
    schema = ", ".join(f"{name} string" for name in columns) or "x string"
    row = tuple(columns.values()) or (None,)
    return spark.createDataFrame([row], schema).select(expression.alias("v")).first()["v"]


def C():
    return F.col("c")


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("  Email  Body ", "email_body"), ("IM+ Closed!", "im_closed"), ("__a--b__", "a_b"), ("Ünï", "n"), ("", "")],
)
def test_sanitize_name(spark, raw, clean):
    assert value(spark, tx.sanitize_name(C()), c=raw) == clean


def test_sanitize_field_keeps_case(spark):
    assert value(spark, tx.sanitize_field(C()), c="_IM Closed--X_") == "IM_Closed_X"


def test_sanitize_collection_is_one_for_one(spark):
    assert value(spark, tx.sanitize_collection(C()), c="im+ -x") == "im___x"


def test_escape(spark):
    assert value(spark, tx.escape_text(C()), c='a"b`c$d') == 'a\\"b\\`c\\$d'
    assert value(spark, tx.escape_text(C()), c=None) == ""


@pytest.mark.parametrize(
    ("raw", "clean"), [(" NaN ", None), (" \t", None), ("", None), (None, None), (" x ", "x"), ("nano", "nano")]
)
def test_nullish(spark, raw, clean):
    assert value(spark, tx.nullish(C()), c=raw) == clean


def test_strip_takes_what_python_takes(spark):
    spaces = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
    assert value(spark, tx.strip(C()), c=f"{spaces}a b{spaces}") == "a b"
    assert set(spaces) == set(tx.WHITESPACE)


@pytest.mark.parametrize(
    ("subject", "body", "text"),
    [(" a ", " b ", "a b"), ("a", "  ", "a"), (None, "b", "b"), (" ", None, None)],
)
def test_query_text(spark, subject, body, text):
    assert value(spark, tx.query_text(F.col("s"), F.col("b")), s=subject, b=body) == text


def test_kb_text_keeps_the_joint(spark):
    assert value(spark, tx.kb_text(F.col("s"), F.col("b")), s=None, b="b") == " b"


def test_body_or_subject(spark):
    assert value(spark, tx.body_or_subject(F.col("s"), F.col("b")), s="s", b=" ") == "s"


def test_list_repr(spark):
    assert value(spark, tx.list_repr(tx.names_of(["id", "a"]))) == "['id', 'a']"


def test_cut_text_at_the_limit(spark):
    assert len(value(spark, tx.cut_text(C()), c="x" * 70000)) == 65535


def test_preview(spark):
    assert value(spark, tx.preview(C(), 3), c="abcd") == "abc... [truncated]"
    assert value(spark, tx.preview(C(), 4), c="abcd") == "abcd"


@pytest.mark.parametrize(
    ("raw", "clean"),
    [(" Email Body: \t\n\nDear\n", "Dear"), ("EMAIL BODY:Dear", "Dear"), ("My email body: x", "My email body: x"), ("\n", "")],
)
def test_clean_reply(spark, raw, clean):
    assert value(spark, tx.clean_reply(C()), c=raw) == clean


@pytest.mark.parametrize(
    ("output", "reply"),
    [
        ('log\n{"status": "success", "email_response": " Email body:\\n Hi "}', " Hi"),
        ('{"status": "error", "error": "boom"}', "Error: boom"),
        ('{"status": "error"}', "Error: Unknown error"),
        ("nothing here", "Error: Could not find JSON in output"),
        ("{broken", "Error: Could not parse output"),
    ],
)
def test_parse_output(spark, output, reply):
    assert value(spark, replies.parse_output(C()), c=output) == reply


def test_collection_from_error(spark):
    error = "Field 'x' not found in collection 'abc'. Available fields: ['id']"
    assert value(spark, replies.collection_from_error(C()), c=error) == "abc"
    assert value(spark, replies.collection_from_error(C()), c="Collection 'abc' not found.") is None


@pytest.mark.parametrize(
    ("error", "named"),
    [
        ("Field 'x' not found in collection 'abc'. Available fields: []", "abc"),
        ("No matching records found in collection 'abc' for field 'x'.", "meta"),
        (None, "meta"),
    ],
)
def test_reply_collection(spark, error, named):
    assert value(spark, replies.reply_collection(C(), F.lit("meta")), c=error) == named


def test_printed_reply(spark):
    text = value(spark, replies.printed_reply(F.col("t"), F.col("s"), F.col("b")), t="7", s="", b="Hi")
    assert text == "=== GENERATED EMAIL ===\n\nTicket ID: 7\nSubject: Re: Your Inquiry\n\nHi\n\n=== END OF EMAIL ===\n"
    assert "Ticket ID" not in value(spark, replies.printed_reply(F.col("t"), F.col("s"), F.col("b")), t="", s="S", b="Hi")


def test_ticket_prompt_blank_context(spark):
    prompt = replies.ticket_prompt(F.lit("7"), F.lit("why"), F.lit("  "), F.lit("general"))
    answer = value(spark, prompt)
    assert replies.NO_KNOWLEDGE in answer["user"] and "- Ticket ID: 7\n" in answer["user"]


def test_reply_prompts(spark):
    search, template = (value(spark, p(C()), c="MATERIAL") for p in (replies.search_prompt, replies.template_prompt))
    assert "Relevant Information:\nMATERIAL\n" in search and "based on the search results" in search
    assert "Relevant Information (Template):\nMATERIAL\n" in template and "based on the template" in template
    assert "{" not in search


def test_knowledge_context_without_results(spark):
    shape = "metadata struct<collection string, status_field string, results_count int>, results array<struct<status string, fields map<string, string>>>"
    rows = [(None, None), (("c", None, 0), []), ((None, "f", 1), [("S", {"b": "2", "a": "1", "Embedding": "x", "e": ""})])]
    df = spark.createDataFrame(rows, shape)
    texts = [r[0] for r in df.select(replies.knowledge_context(F.col("metadata"), F.col("results"))).collect()]
    head = "Here are the relevant details from our system:\n\n"
    assert texts == [
        replies.NO_RECORDS,
        head + "Search Context:\n- Collection: c\n- Found 0 results\n\n",
        head + "Search Context:\n- Status Field: f\n- Found 1 results\n\nResult 1:\n- Status: S\n- a: 1\n- b: 2\n\n",
    ]
