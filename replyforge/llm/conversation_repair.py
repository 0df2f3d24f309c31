"""Conversation structure repair: weighted CYK parsing of turn roles, from single rows up to whole conversations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from replyforge.llm.common import WORD
from replyforge.session import materialise

if TYPE_CHECKING:
    import pyarrow as pa

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5

# --- the grammar ----------------------------------------------------------------------
#
# A whole conversation derives (s?(ua)+)?. The other symbols derive the parts such a text can be cut
# into: EMPTY, the lone s, and what starts with one role and ends with one ("ua" is u, ua u a, ...).
# Every text of two or more roles splits at every place into two of them, so the rules
# X -> Y Z below are a Chomsky normal form in which a span needs one split only.
EMPTY = ""
SYMBOLS = (EMPTY, "s", "uu", "ua", "au", "aa", "su", "sa")
WHOLE = (EMPTY, "ua", "sa")
NEXT = {"s": "u", "u": "a", "a": "u"}


def _rules() -> tuple[tuple[int, int, int], ...]:
    """(left, right, whole) numbers of the symbols of every rule."""
    found = []
    for i, y in enumerate(SYMBOLS):
        for j, z in enumerate(SYMBOLS):
            whole = y + z if EMPTY in (y, z) else y[0] + z[-1] if NEXT[y[-1]] == z[0] else None
            if whole is not None:
                found.append((i, j, SYMBOLS.index(whole)))
    return tuple(found)


RULES = _rules()
Cell = tuple[tuple[int, str] | None, ...]
NOTHING: Cell = ((0, ""), *[None] * (len(SYMBOLS) - 1))


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans: the least (cost, audit) of each symbol over all rules.

    Of two audits of the same rows at the same cost none begins with the other, since more letters would be
    insertions and cost more. So the lesser part always gives the lesser whole, and one entry a symbol is enough.
    """
    best: list[tuple[int, str] | None] = [None] * len(SYMBOLS)
    for i, j, whole in RULES:
        y, z = left[i], right[j]
        if y is not None and z is not None:
            cost, now = y[0] + z[0], best[whole]
            if now is None or cost <= now[0]:
                entry = (cost, y[1] + z[1])
                if now is None or entry < now:
                    best[whole] = entry
    return tuple(best)


def _lesser(a: Cell, b: Cell) -> Cell:
    return tuple(min((x for x in pair if x is not None), default=None) for pair in zip(a, b, strict=True))


def _only(symbol: str, cost: int, audit: str) -> Cell:
    return tuple((cost, audit) if s == symbol else None for s in SYMBOLS)


def closed(cell: Cell) -> Cell:
    """``cell`` with any number of inserted turns before and after its rows."""
    inserted = _lesser(_only("uu", COST[INSERT], INSERT), _only("aa", COST[INSERT], INSERT))
    while True:
        more = _lesser(cell, _lesser(combined(cell, inserted), combined(inserted, cell)))
        if more == cell:
            return cell
        cell = more


@lru_cache(maxsize=None)
def leaf(code: str) -> Cell:
    """The cell of one row, given its code (see ``row_code``), with insertions around it."""
    cell = _only(EMPTY, COST[DELETE], DELETE)
    role = code.lower()
    if role in CODES:
        extra = TRUNCATED if code != role else 0
        for new in ("u", "a"):
            cell = _lesser(cell, _only(new + new, COST[REROLE] + extra, REROLE))
        if role != OTHER:
            cell = _lesser(cell, _only(role if role == "s" else role + role, COST[KEEP] + extra, KEEP))
    return closed(cell)


# Codes of rows by the first letter of their role; capitals are truncated rows, digits must be deleted.
OTHER = "x"
CODES = ("s", "u", "a", OTHER)
LEGAL = ("su", "ua", "au")


def initials(codes: str) -> str:
    return "".join(CODES[int(c)] if c.isdigit() else c.lower() for c in codes)


def illegal_pairs(roles: str) -> int:
    return sum(roles[i : i + 2] not in LEGAL for i in range(len(roles) - 1))


def reduced(cells: list[Cell]) -> Cell:
    """Neighbouring spans are combined until one is left, each level doubling their length."""
    while len(cells) > 1:
        paired = [combined(cells[i], cells[i + 1]) for i in range(0, len(cells) - 1, 2)]
        cells = paired + cells[len(paired) * 2 :]
    return cells[0] if cells else NOTHING


@lru_cache(maxsize=50_000)
def _short(codes: str) -> Cell:
    return reduced([leaf(c) for c in codes])


# Rows of one remembered span: conversations repeat the same few role patterns.
SPAN = 8


def parse(codes: str) -> Cell:
    """The cell of a run of rows."""
    return reduced([_short(codes[i : i + SPAN]) for i in range(0, len(codes), SPAN)])


def answer(cell: Cell) -> tuple[int, str]:
    """The cheapest (cost, audit) of a whole conversation."""
    return min(cell[SYMBOLS.index(s)] for s in WHOLE if cell[SYMBOLS.index(s)] is not None)


# --- rows -----------------------------------------------------------------------------


def chosen_turns(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, key): ids as text, ``key`` a digest of the text; other columns cannot clash."""
    text = F.col("text").cast("string")
    return conversations.select(
        F.col("conv_id").cast("string").alias("conv"),
        F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"),
        text.alias("text"),
        F.unhex(F.md5(text)).alias("key"),
    )


ORDER = ("turn", "role", "key")


def row_code(role: Column, deleted: Column, truncated: Column) -> Column:
    """One letter for what the parser needs of a row."""
    first = F.substring(role, 1, 1)
    letter = F.coalesce(F.when(first.isin(*[c for c in CODES if c != OTHER]), first), F.lit(OTHER))
    digit = F.translate(letter, "".join(CODES), "".join(str(i) for i in range(len(CODES))))
    return F.when(deleted, digit).when(truncated, F.upper(letter)).otherwise(letter)


def flagged(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, key, fault, code) of every row, without its text."""
    bare = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    narrow = turns.select(
        "conv", "turn", "role", "key",
        (~F.coalesce(F.col("text").rlike(WORD), F.lit(False))).alias("blank"),
        F.coalesce(~F.right(bare, F.lit(1)).isin(".", "!", "?"), F.lit(False)).alias("cut"),
    )
    # Equal rows of a conversation are narrow here, and only the first in turn order is no duplicate.
    again = F.row_number().over(Window.partitionBy("conv", "role", "key").orderBy("turn")) > 1
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("cut"), "truncated")
    rows = narrow.withColumn("again", again).select("conv", *ORDER, F.coalesce(fault, F.lit("")).alias("fault"))
    gone = F.col("fault").isin("blank", "duplicate")
    return rows.withColumn("code", row_code(F.col("role"), gone, F.col("fault") == "truncated"))


CELL = "costs array<bigint>, audits array<string>"
PIECE = f"conv string, piece int, roles string, illegal bigint, {CELL}"


def streamed(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns], strict=True)


def written(rows: Iterable[tuple], schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    import pyarrow as pa

    names, held = schema.names, []
    for row in rows:
        held.append(dict(zip(names, row, strict=True)))
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _cell_columns(cell: Cell) -> tuple[list, list]:
    return [e and e[0] for e in cell], [e and e[1] for e in cell]


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _parse_pieces(schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            rows = streamed(batches, ["conv", "piece", "code"])
            for (conv, piece), own in groupby(rows, key=lambda r: r[:2]):
                codes = "".join(r[2] for r in own)
                roles = initials(codes)
                yield conv, piece, roles[0] + roles[-1], illegal_pairs(roles), *_cell_columns(parse(codes))

        return written(pieces(), schema)

    return run


def _join_pieces(schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole():
            for conv, pieces in streamed(batches, ["conv", "pieces"]):
                cells = [
                    tuple(None if c is None else (c, a) for c, a in zip(p["costs"], p["audits"], strict=True)) for p in pieces
                ]
                seams = sum(a["roles"][1] + b["roles"][0] not in LEGAL for a, b in zip(pieces, pieces[1:], strict=False))
                yield conv, sum(p["illegal"] for p in pieces) + seams, *answer(reduced(cells))

        return written(whole(), schema)

    return run


def parse_conversations(rows: DataFrame) -> DataFrame:
    """(conv, illegal, cost, audit) of every conversation in ``rows`` (conv, turn, role, key, code).

    Rows are sorted over range partitions, so a long conversation lies in several of them. Each task
    parses its piece into one cell; the cells of a conversation, one for each partition at most, are
    combined in order. What grows with a conversation is its audit, a letter a row.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange("conv", *ORDER).sortWithinPartitions("conv", *ORDER)
    placed = placed.select("conv", F.spark_partition_id().alias("piece"), "code")
    pieces = placed.mapInArrow(_parse_pieces(arrow_schema(spark, PIECE)), PIECE)
    held = F.array_sort(F.collect_list(F.struct("piece", "roles", "illegal", "costs", "audits")))
    schema = "conv string, illegal bigint, cost bigint, audit string"
    return (
        pieces.groupBy("conv").agg(held.alias("pieces"))
        .mapInArrow(_join_pieces(arrow_schema(spark, schema)), schema)
    )


def _fault_counts(rows: DataFrame) -> DataFrame:
    """(conv, n_rows, gaps, blank, duplicate, truncated); turns are counted once without a set for each conversation."""
    kinds = ("blank", "duplicate", "truncated")
    by_turn = rows.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("fault") == k).alias(k) for k in kinds])
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return by_turn.groupBy("conv").agg(
        F.sum("n").alias("n_rows"), F.coalesce(gaps, F.lit(0)).alias("gaps"), *[F.sum(k).alias(k) for k in kinds]
    )


# --- repaired turns -------------------------------------------------------------------

TURN = "conv string, place bigint, role string, text string, edit string"


def _edited(schema):
    """Over (conv, kind, audit, role, text) with the audit of a conversation before its rows."""

    def turns(batches):
        for conv, own in groupby(streamed(batches, ["conv", "audit", "role", "text"]), key=lambda r: r[0]):
            _, audit, _, _ = next(own)
            place, before = 0, None
            for edit in audit:
                if edit == INSERT:
                    row_role, text = None, ""
                else:
                    _, _, row_role, text = next(own)
                    if edit == DELETE:
                        continue
                if edit == KEEP and row_role[0] == "s":
                    role, before = row_role, "s"
                else:
                    before = NEXT[before] if before else "u"
                    role = row_role if edit == KEEP else {"u": "user", "a": "assistant"}[before]
                yield conv, place, role, text, edit
                place += 1

    return lambda batches: written(turns(batches), schema)


def repaired_turns(turns: DataFrame, parsed: DataFrame) -> DataFrame:
    """(conv, place, role, text, edit) of every turn left or inserted, conversations together and in order.

    The audit of a conversation travels before its rows in one sorted stream, so a task holds
    one audit and one batch of texts, however long a conversation is.
    """
    spark = turns.sparkSession
    none = F.lit(None).cast("string")
    heads = parsed.select(
        "conv", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), none.alias("role"),
        F.lit(None).cast("binary").alias("key"), none.alias("text"), "audit",
    )
    rows = turns.select("conv", F.lit(1).alias("kind"), "turn", "role", "key", "text", none.alias("audit"))
    stream = heads.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "kind", *ORDER)
    return stream.select("conv", "audit", "role", "text").mapInArrow(_edited(arrow_schema(spark, TURN)), TURN)


@dataclass
class Repaired:
    """``report``: one row per conversation; ``turns``: the repaired conversations, see ``repaired_turns``."""

    report: DataFrame
    turns: DataFrame


def repair(conversations: DataFrame) -> Repaired:
    """Bring every conversation into the form (system? (user assistant)+)? at the least cost.

    ``conversations``: conv_id, turn, role, text; further columns are not read. Rows are taken by turn, missing
    turns first, then by role and digest of the text. A row without a word is blank; one whose role and
    text occur before in the conversation is a duplicate, both have to go; one that does not end in
    ``.``, ``!`` or ``?`` is truncated. A role counts by its first letter as it stands; a missing or other role can
    only be replaced. A missing id is a conversation of its own. Empty input gives no rows.

    ``report``: conv (id as text), gaps, blank, duplicate, truncated, illegal (neighbours out of order), cost,
    audit (a letter for each edit in order: K, R, D, I; of equally cheap ones the least in ASCII).
    """
    turns = chosen_turns(conversations)
    rows = materialise(flagged(turns), "conversation-rows")
    parsed = materialise(parse_conversations(rows.select("conv", *ORDER, "code")), "conversation-audits")
    counts = _fault_counts(rows).withColumnRenamed("conv", "own")
    report = parsed.join(counts, F.col("conv").eqNullSafe(F.col("own"))).drop("own")
    return Repaired(report, repaired_turns(turns, parsed))


# --- the registered query -------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with one fault each, chosen by the checksum of ``conv_id:turn``."""
    name = [F.coalesce(F.col(c).cast("bigint").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
        (F.crc32(F.concat(name[0], F.lit(":"), name[1])) % 20).alias("fate"),
    )
    fate = F.col("fate")
    text = F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1)))
    return (
        rows.where(fate != 0)
        .select("conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"))
        .drop("copy")
    )


def _hashed(schema):
    def digests(batches):
        for conv, own in groupby(streamed(batches, ["conv", "role", "text"]), key=lambda r: r[0]):
            total = hashlib.sha256()
            for i, (_, role, text) in enumerate(own):
                total.update((("\n" if i else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            yield conv, total.hexdigest()

    return lambda batches: written(digests(batches), schema)


def digest(conversations: DataFrame) -> DataFrame:
    """One row per conversation of ``conversations``, repaired after ``damaged``, with the digest of its repaired turns."""
    spark = conversations.sparkSession
    repaired = repair(damaged(conversations))
    schema = "conv string, repaired_sha256 string"
    # The turns of a conversation come together and in order out of each task.
    hashed = repaired.turns.mapInArrow(_hashed(arrow_schema(spark, schema)), schema)
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    report = repaired.report.select("conv", *numbers, "audit")
    hashed = hashed.withColumnRenamed("conv", "hashed")
    joined = every.join(report, F.col("conv_id").cast("string").eqNullSafe(F.col("conv")), "left")
    joined = joined.join(hashed, F.col("conv_id").cast("string").eqNullSafe(F.col("hashed")), "left")
    return joined.select(
        "conv_id",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


# Checksum of a text in the checking SQL, byte by byte; a different way to parse: from the left, one state a role seen last.
def sql_crc(text: str) -> str:
    step = "lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


SQL_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(range(8)::BIGINT[], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i::BIGINT) ORDER BY i) AS t
  FROM range(256) x(i))"""


def _sql_least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _sql_edit(state: str, cost: str, letter: str, condition: str | None = None) -> str:
    made = f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}}"
    return f"CASE WHEN {state}.c IS NOT NULL{f' AND {condition}' if condition else ''} THEN {made} END"


def _sql_step() -> str:
    """Fold of one row ``r`` into the states of ``p``: nothing yet (e), system (s), user (u), assistant (a) last."""
    may, extra = "r.code NOT IN ('0', '1', '2', '3')", "(CASE WHEN r.code = upper(r.code) THEN 5 ELSE 0 END)"
    befores = {"e": "", "s": "e", "u": "esa", "a": "u"}
    states = {state: [_sql_edit(f"q.{state}", "2", "D")] for state in befores}
    for state, before in befores.items():
        for x in before:
            states[state].append(_sql_edit(f"q.{x}", extra, "K", f"{may} AND lower(r.code) = '{state}'"))
            if state != "s":
                states[state].append(_sql_edit(f"q.{x}", f"1 + {extra}", "R", may))
    fields = ", ".join(f"'{k}': {_sql_least(*v)}" for k, v in states.items())
    return f"list_transform([{_sql_inserted('p')}], lambda q: {{'code': r.code, {fields}}})[1]"


def _sql_inserted(p: str) -> str:
    """The states of ``p`` with inserted turns after them."""

    def once(x: str) -> str:
        u = _sql_least(f"{x}.u", *[_sql_edit(f"{x}.{k}", "5", "I") for k in "esa"])
        a = _sql_least(f"{x}.a", _sql_edit(f"{x}.u", "5", "I"))
        return f"{{'code': {x}.code, 'e': {x}.e, 's': {x}.s, 'u': {u}, 'a': {a}}}"

    return f"list_transform([{once(p)}], lambda i: {once('i')})[1]"


_SQL_NONE = "{'c': NULL::BIGINT, 'a': NULL::VARCHAR}"
_SQL_START = f"{{'code': '', 'e': {{'c': 0::BIGINT, 'a': ''}}, 's': {_SQL_NONE}, 'u': {_SQL_NONE}, 'a': {_SQL_NONE}}}"

SQL = rf"""WITH {SQL_CRC_TABLE},
fates AS (SELECT c.*, {sql_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate FROM conversations c, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM fates WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS nth FROM damaged),
faults AS (SELECT *, CASE WHEN text IS NULL OR NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nth) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS r,
    lag(r) OVER (PARTITION BY conv_id ORDER BY nth) AS before FROM placed),
coded AS (SELECT *, CASE fault WHEN 'truncated' THEN upper(r) WHEN '' THEN r ELSE translate(r, 'suax', '0123') END AS code FROM faults),
rolled AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal,
    list(role ORDER BY nth) AS roles, list(text ORDER BY nth) AS texts,
    list({{'code': code, 'e': {_SQL_NONE}, 's': {_SQL_NONE}, 'u': {_SQL_NONE}, 'a': {_SQL_NONE}}} ORDER BY nth) AS codes FROM coded GROUP BY conv_id),
folded AS (SELECT *, list_reduce(codes, lambda p, r: {_sql_step()}, {_SQL_START}) AS p FROM rolled),
ended AS (SELECT *, {_sql_inserted('p')} AS q FROM folded),
answered AS (SELECT *, {_sql_least(_sql_edit('q.e', '0', ''), _sql_edit('q.a', '0', ''))} AS won FROM ended),
letters AS (SELECT conv_id, roles, texts, unnest(string_split(won.a, '')) AS edit, generate_subscripts(string_split(won.a, ''), 1) AS step FROM answered),
used AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY step) AS own FROM letters),
left_over AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY step) AS place,
    first_value(CASE WHEN edit = 'K' AND roles[own][1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY step) AS led FROM used WHERE edit <> 'D'),
texts AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN roles[own] WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE texts[own] END, chr(10) ORDER BY place) AS repaired FROM left_over GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(won.c, 0) AS BIGINT) AS cost, coalesce(won.a, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN answered a ON a.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM e.conv_id"""
