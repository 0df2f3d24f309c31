"""Readers for tickets, email batches, knowledge-base sheets, envelopes, templates and results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from replyforge.functions.text import as_text, names_of, sanitize_name, similar_names
from replyforge.operators.joins import lookup_join
from replyforge.session import materialise
from replyforge.sources.records import listed_files, read_records
from replyforge.sources.schemas import BATCH_COLUMNS, ENVELOPE, MISSING_WORDS, RESULTS, SHEET_COLUMNS, TICKET_COLUMNS

# Delivered header -> column name.
RENAMES = {"Ticket ID": "ticket"}

CSV_OPTIONS = {
    "multiLine": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def rename_columns(df: DataFrame, names: Mapping[str, str] = RENAMES) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def all_text(df: DataFrame) -> DataFrame:
    """Every column as text, missing as ''."""
    return df.select(*[as_text(F.col(f"`{c}`")).alias(c) for c in df.columns])


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}. Columns found: {df.columns}")
    return df


def known(c: Column) -> Column:
    """The value, or NULL when it is one of the words for missing."""
    return F.when(~c.isin(MISSING_WORDS), c)


def decoded(path: Column) -> Column:
    """A file path or name without its URL escapes."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


# Bits of a row number inside one task.
POSITION_BITS = 33


def _read_csv(spark: SparkSession, path: str | Sequence[str], order: str | None, multi_line: bool) -> tuple[DataFrame, Column]:
    """CSV rows and their order: the order column, else file name and position in the file.

    With ``multi_line`` cells may hold line breaks and one task reads a file. Without it files are split, and a
    row's position is the start of its split in the file and its place in the split.
    """
    raw = spark.read.csv(path, header=True, **{**CSV_OPTIONS, "multiLine": multi_line})
    if order:
        return raw, F.col(f"`{order}`").cast("bigint")
    columns = raw.columns
    placed = raw.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        # Rows of one split are numbered in order, whichever other splits share their task.
        F.monotonically_increasing_id().bitwiseAND((1 << POSITION_BITS) - 1).alias("_at"),
    )
    # One row per split: a file of some hundred megabytes.
    splits = placed.select("_file", "_block").distinct()
    ranked = splits.withColumn("_rank", F.row_number().over(Window.orderBy("_file", "_block")).cast("bigint") - 1)
    numbered = lookup_join(placed, ranked, ["_file", "_block"], ["_at"])
    position = F.shiftleft("_rank", POSITION_BITS) + F.col("_at")
    return numbered.select(position.alias("_position"), *[F.col("_row").getField(c).alias(c) for c in columns]), F.col("_position")


def read_tickets(spark: SparkSession, path: str | Sequence[str], order: str | None = None, multi_line: bool = True) -> DataFrame:
    """Ticket CSV with all values as text; absent columns are NULL, or '' where '' has a meaning of its own."""
    raw, position = _read_csv(spark, path, order, multi_line)
    blank_when_absent = ("lr_status", "category_raw")
    columns = [
        known(F.col(f"`{header}`")).alias(name)
        if header in raw.columns
        else F.lit("" if name in blank_when_absent else None).cast("string").alias(name)
        for header, name in TICKET_COLUMNS.items()
    ]
    return raw.select(position.alias("src_order"), *columns)


def read_batch(
    spark: SparkSession, path: str | Sequence[str], order: str | None = None, head: int | None = None, multi_line: bool = True
) -> DataFrame:
    """Email CSV: ticket, src_order, subject, email_body. Without its columns it is an error of the whole batch."""
    raw, position = _read_csv(spark, path, order, multi_line)
    raw = require_columns(rename_columns(raw), BATCH_COLUMNS)
    batch = raw.select(
        F.col("ticket"), position.alias("src_order"), *[as_text(F.col(c)).alias(c) for c in ("subject", "email_body")]
    )
    return batch if head is None else batch.orderBy("src_order").limit(head)


def read_envelopes(spark: SparkSession, path: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """Search result files of every dialect, with or without a byte order mark; ids as text."""
    return spark.read.schema(ENVELOPE).json(path, multiLine=multi_line)


def read_templates(spark: SparkSession, path: str | Sequence[str], name_pattern: str = r"([^/]+)\.html?$") -> DataFrame:
    """One row per template file; its name in collection form is the key."""
    files = spark.read.text(path, wholetext=True).select("value", decoded(F.col("_metadata.file_path")).alias("file"))
    name = sanitize_name(F.regexp_extract("file", name_pattern, 1))
    return files.select(name.alias("collection"), F.col("value").alias("html"))


def read_results(spark: SparkSession, path: str, partitions: str | None = None) -> DataFrame:
    """Earlier result rows, or none when there is no such table yet."""
    schema = RESULTS if partitions is None else f"{RESULTS}, {partitions}"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@dataclass
class Sheets:
    """Read knowledge-base sheets. ``rows`` holds the good ones only, ``report`` one row per sheet."""

    rows: DataFrame
    fields: DataFrame
    report: DataFrame


def _delivered_names(cells: Column, width: Column) -> Column:
    """The header cells over the whole width; a column without one is named after its position."""
    every = F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1)
    return F.transform(every, lambda i: F.coalesce(F.nullif(F.trim(F.get(cells, i)), F.lit("")), F.concat(F.lit("Unnamed: "), i.cast("string"))))


def _numbered_twin(names: Column, name: Column, i: Column) -> Column:
    """``name``, with a number when it stands before in ``names`` too."""
    before = F.size(F.filter(F.slice(names, F.lit(1), i), lambda x: x == name))
    return F.when(before > 0, F.concat(name, F.lit("."), before.cast("string"))).otherwise(name)


def read_sheets(
    spark: SparkSession, path: str | Sequence[str], name_pattern: str = r"([^/]+)\.csv$"
) -> Sheets:
    """A folder of sheets as CSV: record 1 a title, record 2 the header, one collection per file.

    Records are cut with quotes honoured, so headers and cells may hold line breaks, and each sheet has its own
    width. A column without a header is named after its position, equal headers are numbered, and an
    empty first line counts as the title. A sheet is bad when it cannot be read, has no header, lacks a required
    column or has two different headers with the same name in collection form; it is reported and left out.
    """
    name = decoded(F.col("_metadata.file_path"))
    collection = sanitize_name(F.regexp_extract("file", name_pattern, 1))
    # Written once: the checks, the header and the rows all read it.
    numbered = materialise(read_records(spark, path, name), "sheets")
    whole = numbered.where(F.col("line") >= 0)
    unread = numbered.where(F.col("line") < 0).select("file", "problem")
    widths = whole.where(F.col("line") > 0).groupBy("file").agg(F.max(F.size("cells")).alias("width"))
    # One row per file; written, so that the checks read names and do not derive them again.
    named = (
        whole.where(F.col("line") == 1)
        .join(widths, "file")
        .withColumn("delivered", _delivered_names(F.col("cells"), F.col("width")))
        .withColumn("delivered", F.transform("delivered", lambda x, i: _numbered_twin(F.col("delivered"), x, i)))
        .withColumn("header", F.transform("delivered", lambda x, i: F.struct(sanitize_name(x).alias("name"), i.alias("at"))))
        .select("file", "header")
        .withColumn("titles", F.transform("header", lambda h: h["name"]))
    )
    files = listed_files(spark, path).select(decoded(F.col("path")).alias("file"))
    files = files.join(named, "file", "left").join(unread, "file", "left")
    headers = materialise(files.select("file", collection.alias("collection"), "header", "titles", F.col("problem").alias("unread")), "headers")
    titles = F.col("titles")
    absent = F.array_except(names_of(SHEET_COLUMNS), titles)
    problem = (
        F.when(F.col("unread").isNotNull(), F.col("unread"))
        .when(titles.isNull(), "no header line")
        .when(F.size(F.array_distinct(titles)) < F.size(titles), "two columns have the same name")
        .when(F.size(absent) > 0, F.concat(F.lit("missing columns: "), F.array_join(absent, ", ")))
    )
    hints = F.array_join(F.flatten(F.transform(absent, lambda w: similar_names(w, titles))), ", ")
    # Two files of one collection: the later file name replaces the earlier, as a later ingest would.
    checked = headers.select("file", "collection", "header", "titles", problem.alias("problem"), hints.alias("similar"))
    winner = checked.where(F.col("problem").isNull()).groupBy("collection").agg(F.max("file").alias("file"))
    state = checked.join(winner.withColumn("kept", F.lit(True)), ["collection", "file"], "left").withColumn(
        "problem", F.coalesce("problem", F.when(F.col("kept").isNull(), "replaced by a later file"))
    )
    good = state.where(F.col("problem").isNull()).select("file", "collection", "header", "titles")
    data = lookup_join(whole.where(F.col("line") > 1), good, ["file"], ["line"]).where(F.col("header").isNotNull())
    cells = F.transform("header", lambda h: F.coalesce(known(F.get("cells", h["at"])), F.lit("")))
    everything = data.select("collection", (F.col("line") - 1).alias("kb_id"), F.map_from_arrays("titles", cells).alias("all"))
    rows = everything.select(
        "collection", "kb_id",
        *[F.try_element_at("all", F.lit(c)).alias(c) for c in SHEET_COLUMNS],
        F.map_filter("all", lambda k, _: ~k.isin(SHEET_COLUMNS)).alias("fields"),
    )
    schema_names = F.concat(names_of(["id", "embedding"]), F.col("titles"))
    kept = state.where(F.col("problem").isNull())
    fields = kept.select("collection", F.posexplode(schema_names).alias("ordinal", "field")).select("collection", "field", "ordinal")
    delivered = whole.where(F.col("line") > 1).groupBy("file").agg(F.count(F.lit(1)).alias("delivered"))
    report = state.join(delivered, "file", "left").select(
        "collection", "file", F.coalesce("problem", F.lit("ok")).alias("state"), F.coalesce("similar", F.lit("")).alias("similar"),
        F.coalesce("delivered", F.lit(0)).alias("expected"),
    )
    return Sheets(rows, fields, report)
