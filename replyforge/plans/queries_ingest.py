"""Registered queries: sheet files written from the documents, then scanned and ingested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyforge.operators import catalog
from replyforge.plans import ingest
from replyforge.plans.fixtures import STATUS_FIELDS
from replyforge.plans.registry import over, query
from replyforge.session import scratch_path
from replyforge.sources import readers, store

C = F.col

# A sheet holds the rows of one source and of one thousand document numbers.
SHEET_IDS = 1000
SHEET_NAME = r"sheet=([^/]+)/"
QUOTED = {"quote": '"', "escape": '"', "quoteAll": "true"}


def _by_kind(build) -> Column:
    return F.coalesce(*[F.when(C("kind") == kind, build(kind)) for kind in STATUS_FIELDS])


# Hard sheets by source: an open quote, a body of many commas, blank and twin headers, many columns, line breaks
# in headers, no body column, two headers of one name.
OPEN, COMMAS, TWINS, BROAD, BROKEN, BODILESS, CLASHING = (f"src{n}" for n in range(13, 20))
BAD = f"('{OPEN}', '{BODILESS}', '{CLASHING}')"
MORE_COLUMNS, MORE_COMMAS = 400, 5000
MORE_NAMES = [f"c_{i:03d}" for i in range(MORE_COLUMNS)]


def write_sheets(fx, kb: DataFrame | None = None) -> str:
    """Sheets as CSV files with a title line and a header line, some of them hard to read (see above)."""
    number = F.substring("collection", 4, 3).cast("int")
    rows = (fx.kb if kb is None else kb).withColumn("kind", number % 3).withColumn(
        "sheet", F.concat(C("collection"), F.lit(" Sheet "), F.floor(C("kb_id") / SHEET_IDS).cast("string"))
    )
    body = F.coalesce("email_body", F.lit(""))
    rows = rows.withColumn("email_body", F.when(C("collection") == COMMAS, F.concat(body, F.repeat(F.lit(","), F.lit(MORE_COMMAS)))).otherwise(body))

    def cells(kind: int) -> Column:
        texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("subject", "email_body", *STATUS_FIELDS[kind])]
        return F.to_csv(F.struct(*texts), QUOTED)

    own_id = C("kb_id").cast("string")
    more = F.transform(F.sequence(F.lit(0), F.lit(MORE_COLUMNS - 1)), lambda i: F.concat(F.lit(",v"), i.cast("string"), F.lit(" "), own_id))
    more_cells = F.when(C("collection") == BROAD, F.array_join(more, "")).when(C("collection") == TWINS, F.concat(F.lit(",blank "), own_id, F.lit(",one,two")))
    line = F.concat(_by_kind(cells), F.coalesce(more_cells, F.lit("")))

    def header(kind: int) -> Column:
        names = ["Subject", " Email  Body ", *[f.replace("_", " ").upper() for f in STATUS_FIELDS[kind]]]
        text = F.lit(",".join(f'"{n}"' for n in names))
        return (
            F.when(C("collection") == BODILESS, F.replace(text, F.lit(" Email  Body "), F.lit("Mail")))
            .when(C("collection") == CLASHING, F.replace(text, F.lit(" Email  Body "), F.lit("subject!")))
            .when(C("collection") == BROKEN, F.replace(text, F.lit(" "), F.lit("\n")))
            .when(C("collection") == TWINS, F.concat(text, F.lit(',,"Reply","Reply"')))
            .when(C("collection") == BROAD, F.concat(text, F.lit("," + ",".join(n.upper().replace("_", " ") for n in MORE_NAMES))))
            .otherwise(text)
        )

    lines = rows.select("sheet", (C("kb_id") + 2).alias("at"), line.alias("line"))
    heads = rows.select("sheet", "collection", "kind").distinct()

    def added(at: int, text: Column) -> DataFrame:
        return heads.select("sheet", F.lit(at).cast("bigint").alias("at"), text.alias("line"))

    first = added(0, F.concat(F.lit('"'), C("sheet"), F.lit('"')))
    last = added((1 << 63) - 1, F.lit('never closed,"open')).where(C("sheet").startswith(f"{OPEN} "))
    path = scratch_path(fx.spark, "sheets")
    (
        first.unionByName(added(1, _by_kind(header))).unionByName(lines).unionByName(last)
        .repartition("sheet").sortWithinPartitions("sheet", "at")
        .select("line", "sheet").write.partitionBy("sheet").text(path)
    )
    return path


def _flat(cells: Column) -> Column:
    """A field map as text in name order."""
    entries = F.transform(F.array_sort(F.map_entries(cells)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(entries, ";")


def _own_cells_sql() -> str:
    # Field names in collection form: "im__closed" arrives as "IM  CLOSED" and becomes "im_closed".
    def flat(kind: int) -> str:
        pairs = sorted((f.replace("__", "_"), f) for f in STATUS_FIELDS[kind])
        return " || ';' || ".join(f"'{name}=' || {column}" for name, column in pairs)

    own = "CASE CAST(substring(collection, 4, 3) AS INT) % 3 " + " ".join(f"WHEN {k} THEN {flat(k)}" for k in STATUS_FIELDS) + " END"
    more = f"list_transform(range({MORE_COLUMNS}), lambda i: 'c_' || lpad(i::VARCHAR, 3, '0') || '=v' || i || ' ' || kb_id || ';')"
    return (
        f"CASE WHEN collection = '{BROAD}' THEN array_to_string({more}, '') ELSE '' END || {own} || "
        f"CASE WHEN collection = '{TWINS}' THEN ';reply=one;reply_1=two;unnamed_8=blank ' || kb_id ELSE '' END"
    )


SHEETS_SQL = f"""sheets AS (SELECT *, collection || '_sheet_' || CAST(kb_id // {SHEET_IDS} AS VARCHAR) AS sheet FROM fx_kb)"""
ROWS_SQL = f"""SELECT sheet AS collection, row_number() OVER (PARTITION BY sheet ORDER BY kb_id) AS kb_id, subject,
       coalesce(email_body, '') || CASE WHEN collection = '{COMMAS}' THEN repeat(',', {MORE_COMMAS}) ELSE '' END AS email_body, {_own_cells_sql()} AS cells
     FROM sheets WHERE collection NOT IN {BAD}"""
# Fields after those of the kind, by source.
MORE_FIELDS = {BROAD: MORE_NAMES, TWINS: ["unnamed_8", "reply", "reply_1"]}


@query("s1_sheet_folder", over("fx_kb", SHEETS_SQL) + ROWS_SQL)
def s1(fx) -> DataFrame:
    """All files of a folder (S1), header on the second line (S2)."""
    sheets = readers.read_sheets(fx.spark, write_sheets(fx), name_pattern=SHEET_NAME)
    return sheets.rows.select("collection", "kb_id", "subject", "email_body", _flat(C("fields")).alias("cells"))


@query(
    "s2_sheet_headers",
    over("fx_kb", SHEETS_SQL, f"names AS (SELECT DISTINCT sheet, collection AS source, CAST(substring(collection, 4, 3) AS INT) % 3 AS kind FROM sheets WHERE collection NOT IN {BAD})")
    + " UNION ALL ".join(
        [
            f"SELECT sheet AS collection, '{f.replace('__', '_')}' AS field, {i} AS ordinal FROM names WHERE kind = {kind}"
            for kind, own in STATUS_FIELDS.items()
            for i, f in enumerate(["id", "embedding", "subject", "email_body", *own])
        ]
        + [
            f"SELECT sheet, field, CAST(9 + ordinal AS INT) FROM names, (SELECT unnest({own}) AS field, generate_subscripts({own}, 1) AS ordinal) WHERE source = '{source}'"
            for source, own in MORE_FIELDS.items()
        ]
    ),
)
def s2(fx):
    return readers.read_sheets(fx.spark, write_sheets(fx), name_pattern=SHEET_NAME).fields


@query(
    "q5_required_columns",
    over("fx_kb", SHEETS_SQL)
    + f"""SELECT DISTINCT sheet AS collection, CASE collection WHEN '{BODILESS}' THEN 'missing columns: email_body'
           WHEN '{CLASHING}' THEN 'two columns have the same name' WHEN '{OPEN}' THEN 'unreadable: a quote is not closed'
           ELSE 'ok' END AS state FROM sheets""",
)
def q5(fx):
    return readers.read_sheets(fx.spark, write_sheets(fx), name_pattern=SHEET_NAME).report.select("collection", "state")


@query(
    "q12_ingest_report",
    over("fx_kb", SHEETS_SQL)
    + f"""SELECT sheet AS collection, collection NOT IN {BAD} AS good, count(*) AS expected,
           CASE WHEN collection NOT IN {BAD} THEN count(*) END AS stored,
           CASE WHEN collection NOT IN {BAD} THEN TRUE END AS complete,
           CASE WHEN collection NOT IN {BAD} THEN TRUE END AS intact FROM sheets GROUP BY sheet, collection""",
)
def q12(fx):
    """A whole ingest: one bad sheet does not stop the others."""
    target = scratch_path(fx.spark, "ingest")
    report = ingest.ingest_sheets(fx.spark, write_sheets(fx), target, name_pattern=SHEET_NAME).report
    return report.select("collection", (C("state") == "ok").alias("good"), "expected", "stored", "complete", "intact")


def _stored(fx, dropped: list[str] | None):
    """Knowledge base, fields and report of a whole ingest after a drop."""
    path = scratch_path(fx.spark, "ingest")
    ingest.ingest_sheets(fx.spark, write_sheets(fx), path, name_pattern=SHEET_NAME)
    store.drop(fx.spark, path, dropped)
    left = ingest.read_store(fx.spark, path)
    return left.rows, left.fields, left.report


@query(
    "s7_replace_ingested",
    over("fx_kb", SHEETS_SQL)
    + f"""SELECT sheet AS collection, CASE WHEN collection IN ('src3', 'src4') THEN 'again ' ELSE '' END || subject AS subject,
           row_number() OVER (PARTITION BY sheet ORDER BY kb_id) AS kb_id FROM sheets WHERE collection NOT IN {BAD}""",
)
def s7_replace(fx):
    """A second ingest of two sources replaces their collections as a whole and leaves the others (S7)."""
    path = scratch_path(fx.spark, "ingest")
    sheets = write_sheets(fx)
    ingest.ingest_sheets(fx.spark, sheets, path, name_pattern=SHEET_NAME)
    two = fx.kb.where(C("collection").isin("src3", "src4")).withColumn("subject", F.concat(F.lit("again "), C("subject")))
    ingest.ingest_sheets(fx.spark, write_sheets(fx, two), path, name_pattern=SHEET_NAME)
    return ingest.read_store(fx.spark, path).rows.select("collection", "subject", "kb_id")


@query(
    "c8_content_check",
    over("fx_kb", SHEETS_SQL)
    + f"""SELECT sheet AS collection, count(*) AS expected, count(*) AS stored, TRUE AS complete,
           max(CASE WHEN kb_id % 997 = 5 THEN 1 ELSE 0 END) = 0 AS intact FROM sheets WHERE collection NOT IN {BAD} GROUP BY sheet""",
)
def c8_content(fx):
    """Stored rows compared with the delivered ones cell by cell: one altered cell in a collection is reported (C8)."""
    sheets = readers.read_sheets(fx.spark, write_sheets(fx), name_pattern=SHEET_NAME)
    # The same table again with one cell of some rows changed, as a faulty write would leave it.
    own = C("subject").rlike(r" Entry \d+$") & (F.regexp_extract("subject", r"(\d+)$", 1).cast("bigint") % 997 == 5)
    some = F.element_at(F.map_keys("fields"), 1)
    changed = F.transform_values("fields", lambda k, v: F.when(k == some, F.concat(v, F.lit("!"))).otherwise(v))
    stored = sheets.rows.withColumn("fields", F.when(own, changed).otherwise(C("fields")))
    return catalog.verify_content(stored, sheets.rows, sheets.report.where("state = 'ok'").select("collection", "expected"))


@query(
    "s8_drop_collection",
    over("fx_kb", SHEETS_SQL)
    + f"""SELECT sheet AS collection, count(*) AS "rows",
           CAST(10 + CASE collection WHEN '{BROAD}' THEN {MORE_COLUMNS} WHEN '{TWINS}' THEN 3 ELSE 0 END AS BIGINT) AS fields, 'ok' AS state FROM sheets
         WHERE collection NOT IN {BAD} AND sheet NOT IN ('src3_sheet_0', 'src5_sheet_0') GROUP BY sheet, collection""",
)
def s8(fx):
    kb, fields, report = _stored(fx, ["src3_sheet_0", "src5_sheet_0", "not stored"])
    rows = kb.groupBy("collection").agg(F.count(F.lit(1)).alias("rows"))
    named = fields.groupBy("collection").agg(F.count(F.lit(1)).alias("fields"))
    said = report.where(C("state") == "ok").select("collection", "state")
    return rows.join(named, "collection", "full").join(said, "collection", "full")


@query(
    "s9_drop_all_collections",
    "SELECT 'kb' AS stored, 0 AS \"rows\" UNION ALL SELECT 'fields', 0 UNION ALL SELECT 'report', 0",
)
def s9(fx):
    counts = [
        table.agg(F.count(F.lit(1)).cast("int").alias("rows")).select(F.lit(name).alias("stored"), "rows")
        for name, table in zip(("kb", "fields", "report"), _stored(fx, None), strict=True)
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
