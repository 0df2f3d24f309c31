"""Line dedup: chunks of lines around content-defined boundaries; those that occur before in the corpus are removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replyforge.llm.common import chosen, free_names, let, with_per_document
from replyforge.session import materialise

# Fixed values of the boundary rule; the checking SQL has the same.
MULTIPLIER = 1_000_003
MODULUS = 2_147_483_647
DIVISOR = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _body(lines: Column, at: Column) -> Column:
    """The two lines from number ``at`` on."""
    return F.concat_ws("\n", F.get(lines, at - 1), F.get(lines, at))


def _pairs(lines: Column, divisor: int) -> Column:
    """Array of (at, boundary, hash) of every two neighbouring lines, not both blank; ``at`` is the number of the first, from 1.

    There is a boundary where the rolling hash over the hashes of the two lines is no multiple of ``divisor``:
    at two of three places with the default, wherever in a text the lines stand.
    """
    # Eight hexadecimal digits of a digest: the same number in every engine.
    hashed = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("bigint"))

    def of(lines: Column, hashes: Column) -> Column:
        def pair(i: Column) -> Column:
            rolling = F.pmod(F.get(hashes, i - 1) * MULTIPLIER + F.get(hashes, i), F.lit(MODULUS))
            blank = (F.trim(F.get(lines, i - 1)) == "") & (F.trim(F.get(lines, i)) == "")
            return F.when(
                ~blank, F.struct(i.alias("at"), (F.pmod(rolling, F.lit(divisor)) != 0).alias("boundary"), F.xxhash64(_body(lines, i)).alias("hash"))
            )

        return F.when(F.size(lines) > 1, F.array_compact(F.transform(F.sequence(F.lit(1), F.size(lines) - 1), pair)))

    return let(lines, lambda ls: let(hashed, lambda hs: of(ls, hs)))


def repeated_runs(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """(doc_id, fp, runs): the stretches (first, last) of lines of each document that are removed, in order.

    A chunk is the two lines around a boundary, grown line by line. Pairs of lines are counted by hash first, on
    narrow rows; only pairs with a repeated hash are cut out of the texts, and a pair counts as a repeat
    where the bytes are equal, not only the hash. The first occurrence (smallest doc_id, a missing one last, then
    place) stays. Neighbouring repeats make one run, and a run goes if it has a boundary inside.
    """
    pairs = docs.select("doc_id", "fp", F.explode(_pairs(_lines(F.col("text")), divisor)).alias("pair")).select("doc_id", "fp", "pair.*")
    twice = pairs.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    places = F.collect_set(F.struct("at", "boundary", "hash")).alias("places")
    # Written, here and below, so that no more than one shuffle of texts is there at a time.
    maybe = materialise(pairs.join(twice, "hash").groupBy("doc_id", "fp").agg(places), "line-places")
    # One row a document at most, of a number that grows with the corpus: not to be broadcast by a guess at its size.
    texts = with_per_document(docs, maybe.hint("merge")).where(F.col("places").isNotNull())
    opened = texts.select("doc_id", "fp", _lines(F.col("text")).alias("lines"), F.explode("places").alias("p"))
    candidates = materialise(opened.select("doc_id", "fp", "p.*", _body(F.col("lines"), F.col("p.at")).alias("body")), "line-candidates")
    place = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("fp").alias("c"), F.col("at").alias("d"))
    # Grouping by the body itself is the comparison of bytes; a common pair shrinks to one row in each task.
    groups = candidates.groupBy("hash", "body").agg(F.min(place).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Rows equal in id and text are one document.
    again = candidates.join(groups, ["hash", "body"]).where(place != F.col("keep")).select("doc_id", "fp", "at", "boundary").distinct()
    by_place = Window.partitionBy("doc_id", "fp").orderBy("at")
    runs = again.withColumn("run", F.col("at") - F.row_number().over(by_place)).groupBy("doc_id", "fp", "run").agg(
        F.min("at").alias("first"), (F.max("at") + 1).alias("last"), F.bool_or("boundary").alias("boundary")
    )
    runs = runs.where("boundary").groupBy("doc_id", "fp").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))
    return materialise(runs, "line-runs").hint("merge")


def _removed(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)


def _kept(lines: Column, runs: Column) -> Column:
    """The text of the lines outside ``runs``: one slice between each two of them."""

    def between(k: Column) -> Column:
        first = F.when(k == 0, F.lit(1)).otherwise(F.get(runs, k - 1)["last"] + 1)
        last = F.when(k == F.size(runs), F.size(lines)).otherwise(F.get(runs, k)["first"] - 1)
        return F.slice(lines, first, F.greatest(last - first + 1, F.lit(0)))

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), between)), "\n")


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, text, n_lines, n_runs, n_removed_lines, kept_text).

    Lines are split at "\\n". Runs of two or more lines of which every two neighbours, not both blank, occur before in the
    corpus are removed when one of their places is a boundary; so of a run of two lines two of three go, of one
    of three lines eight of nine. The first occurrence of any line stays.

    A null text has no lines and stays null; an empty text is one empty line. Rows equal in id and
    text are one document, so they keep the same lines. A missing id counts as the largest. An
    empty table gives no rows. Further columns are not read.
    """
    rows = chosen(docs, id_col=id_col, text_col=text_col)
    joined = with_per_document(rows, repeated_runs(rows, divisor)).withColumn("lines", _lines(F.col("text")))
    return joined.select(
        "doc_id",
        "text",
        F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("runs"), F.lit(0)).cast("bigint").alias("n_runs"),
        F.coalesce(_removed(F.col("runs")), F.lit(0)).cast("bigint").alias("n_removed_lines"),
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(_kept(F.col("lines"), F.col("runs"))).alias("kept_text"),
    )


def remove_lines(docs: DataFrame, divisor: int = DIVISOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text that :func:`dedup_lines` leaves; other columns as they are, whatever their names.

    A document that loses all its lines goes, since nothing of it is left; one that was empty before stays.
    """
    i, f, r, new = free_names(docs, "id", "fp", "runs", "new")
    gone = repeated_runs(chosen(docs, id_col=id_col, text_col=text_col), divisor).toDF(i, f, r)
    on = docs[id_col].cast("bigint").eqNullSafe(F.col(i)) & (F.xxhash64(docs[text_col]) == F.col(f))
    lines = _lines(docs[text_col])
    left = F.when(_removed(F.col(r)) < F.size(lines), _kept(lines, F.col(r)))
    changed = F.col(r).isNotNull()
    joined = docs.join(gone, on, "left").withColumn(new, F.when(changed, left).otherwise(docs[text_col]))
    joined = joined.where(~changed | F.col(new).isNotNull())
    return joined.select(*[F.col(new).alias(c) if c == text_col else docs[c] for c in docs.columns])


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_runs", "n_removed_lines", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM lines),
pairs AS (
  SELECT doc_id, i, lead(i) OVER w AS after, line || chr(10) || lead(line) OVER w AS body,
         (h * {MULTIPLIER} + lead(h) OVER w) % {MODULUS} % {DIVISOR} <> 0 AS boundary
  FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
again AS (
  SELECT doc_id, i, boundary FROM pairs WHERE after IS NOT NULL AND trim(replace(body, chr(10), '')) <> ''
  QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, i) > 1),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM again),
runs AS (SELECT doc_id, min(i) AS first, max(i) + 1 AS last FROM islands GROUP BY doc_id, run HAVING bool_or(boundary)),
counted AS (SELECT doc_id, count(*) AS n_runs FROM runs GROUP BY doc_id),
judged AS (SELECT l.*, r.doc_id IS NOT NULL AS gone FROM lines l LEFT JOIN runs r ON r.doc_id = l.doc_id AND l.i BETWEEN r.first AND r.last)
SELECT d.doc_id, count(j.i) AS n_lines, coalesce(max(n_runs), 0) AS n_runs, count(*) FILTER (gone) AS n_removed_lines,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY j.i) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN judged j ON j.doc_id = d.doc_id LEFT JOIN counted c ON c.doc_id = d.doc_id GROUP BY d.doc_id
"""
