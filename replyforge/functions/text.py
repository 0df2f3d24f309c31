"""Column expressions over text: cleaning, names, query texts, reply clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
MAX_TEXT = 65535


def strip(c: Column) -> Column:
    """Both-side strip of every Unicode space, not only U+0020 as plain ``trim`` does."""
    return F.trim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def nullish(c: Column) -> Column:
    """Stripped text; NULL when it is missing, blank or the word ``nan`` in any case."""
    s = strip(c)
    return F.when(~F.lower(s).isin("", "nan"), s)


def sanitize_name(c: Column) -> Column:
    """Lower-case identifier with single inner underscores."""
    joined = F.regexp_replace(F.lower(strip(c)), "[^a-z0-9_]+", "_")
    return F.trim(F.regexp_replace(joined, "_+", "_"), F.lit("_"))


def sanitize_field(c: Column) -> Column:
    """Identifier with single inner underscores, letter case kept."""
    joined = F.regexp_replace(c, "[^a-zA-Z0-9_]", "_")
    return F.trim(F.regexp_replace(joined, "_+", "_"), F.lit("_"))


def sanitize_collection(c: Column) -> Column:
    """One underscore for each foreign character; nothing collapsed or stripped."""
    return F.regexp_replace(c, "[^a-zA-Z0-9_]", "_")


def escape_text(c: Column) -> Column:
    """Backslash before double quote, backtick and dollar; NULL becomes ''."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), '(["`$])', r"\\$1")


def as_text(c: Column) -> Column:
    """Any column as text, missing as ''."""
    return F.coalesce(c.cast("string"), F.lit(""))


def cut_text(c: Column, limit: int = MAX_TEXT) -> Column:
    """Text cut to the longest value a collection stores."""
    return F.substring(c, 1, limit)


def kb_text(subject: Column, body: Column) -> Column:
    """The text a knowledge-base row is embedded from."""
    return F.concat(F.coalesce(subject, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))


def query_text(subject: Column, body: Column) -> Column:
    """Non-blank parts joined by a space; NULL when neither is there."""
    parts = F.concat_ws(" ", F.nullif(strip(subject), F.lit("")), F.nullif(strip(body), F.lit("")))
    return F.nullif(parts, F.lit(""))


def body_or_subject(subject: Column, body: Column) -> Column:
    return F.when(is_blank(body), subject).otherwise(body)


def list_repr(names: Column) -> Column:
    """An array of names as ``['a', 'b']``."""
    inner = F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", ")
    return F.concat(F.lit("["), inner, F.lit("]"))


def contains_either_way(a: Column, b: Column) -> Column:
    """Case-insensitive: one name is part of the other."""
    la, lb = F.lower(a), F.lower(b)
    return F.contains(la, lb) | F.contains(lb, la)


def similar_names(wanted: Column, present: Column) -> Column:
    """Names of the array ``present`` that contain, or are part of, ``wanted``."""
    return F.filter(present, lambda name: contains_either_way(name, wanted))


def names_of(columns: Sequence[str]) -> Column:
    return F.array(*[F.lit(c) for c in columns])


def preview(c: Column, limit: int, marker: str = "... [truncated]") -> Column:
    """Display form: the first ``limit`` characters and a marker when there are more."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(marker))).otherwise(c)


def clean_reply(c: Column) -> Column:
    """Stripped reply without a leading ``Email Body:`` label."""
    return F.regexp_replace(strip(c), r"(?i)^(email body:)[ \t]*\n*", "")
