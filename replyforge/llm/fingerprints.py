"""Document fingerprints by consistent weighted sampling; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from replyforge.llm.common import chosen
from replyforge.session import materialise

# Samples of a fingerprint: SAMPLE_GROUPS rows of GROUP_SAMPLES columns. More columns than about ten in one
# aggregation make code that the JVM does not compile.
SAMPLE_GROUPS, GROUP_SAMPLES = 8, 8
SAMPLES = SAMPLE_GROUPS * GROUP_SAMPLES
# Bits of a hash that choose a gamma value; the rest are the fraction of the shift.
GAMMA_BITS = 12
FRACTION_BITS = 64 - 2 * GAMMA_BITS
LOW = 0xFFFFFFFF
NO_SAMPLE = LOW


@dataclass
class GammaTable:
    """``values``: Gamma(2, 1) at the middles of equal shares of its distribution; ``logs`` of them. Columns of one array each.

    Each is a scalar subquery: computed once a query, and no part of the text of the plan.
    """

    values: Column
    logs: Column


def gamma_table(spark: SparkSession) -> GammaTable:
    shares = 1 << GAMMA_BITS
    share = (F.col("id") + 0.5) / shares

    def halved(bounds: Column, _: Column) -> Column:
        middle = (bounds["low"] + bounds["high"]) / 2
        below = 1 - (1 + middle) * F.exp(-middle) < F.col("share")
        return F.struct(F.when(below, middle).otherwise(bounds["low"]).alias("low"), F.when(below, bounds["high"]).otherwise(middle).alias("high"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(64.0).alias("high"))
    rows = spark.range(0, shares, 1, 1).select("id", share.alias("share"))
    rows = rows.select("id", F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halved)["low"].alias("value"))

    def column(value: Column) -> Column:
        held = F.array_sort(F.collect_list(F.struct("id", value.alias("value"))))
        return rows.agg(F.transform(held, lambda x: x["value"]).alias("held")).scalar()

    return GammaTable(column(F.col("value")), column(F.log("value")))


def _sample(gamma: GammaTable, group: Column, number: int) -> Column:
    """The drawn value of one term in one sample: its key ln(a) in the high half, the name of (term, t) in the low half.

    With r and c gamma distributed and b uniform, all by hash of term and sample: t = floor(ln(w) / r + b) and
    ln(a) = ln(c) - r (t - b + 1). The term with the least a is drawn, and is drawn again in another text
    with the chance min(w, w') / max(w, w') of its weights, summed over the terms.
    """
    h = F.xxhash64("term", group, F.lit(number))
    r = F.get(gamma.values, F.shiftrightunsigned(h, 64 - GAMMA_BITS).cast("int"))
    log_c = F.get(gamma.logs, F.shiftrightunsigned(h, FRACTION_BITS).bitwiseAND((1 << GAMMA_BITS) - 1).cast("int"))
    b = h.bitwiseAND((1 << FRACTION_BITS) - 1).cast("double") / float(1 << FRACTION_BITS)
    t = F.floor(F.col("log_weight") / r + b)
    # r stays under 14 and ln(w) under 44, so ln(a) lies within (-64, 64).
    key = F.greatest(F.lit(0.0), F.least(F.lit(127.0), log_c - r * (t - b + 1.0) + 64.0))
    return F.shiftleft((key * float(1 << 24)).cast("bigint"), 32).bitwiseOR((h + t * 40503).bitwiseAND(LOW))


def signatures(words: DataFrame, keys: list[str], which: str) -> DataFrame:
    """(keys, samples by ``which``) from ``words`` (keys, which, word), one row per word; an empty word adds nothing.

    The weight of a term is how often it occurs. Rows dealt out by one of ``keys`` stay where they are.
    A group without words has null samples.
    """
    of = [*keys, which]
    terms = words.groupBy(*of, F.xxhash64("word").alias("term")).agg(F.count(F.nullif("word", F.lit(""))).alias("weight"))
    terms = terms.withColumn("log_weight", F.when(F.col("weight") > 0, F.log(F.col("weight").cast("double"))))
    gamma = gamma_table(words.sparkSession)
    spread = terms.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SAMPLE_GROUPS - 1))))
    least = spread.groupBy(*of, "part").agg(*[F.min(_sample(gamma, F.col("part"), i)).alias(f"s{i}") for i in range(GROUP_SAMPLES)])
    drawn = F.array(*[F.coalesce(F.col(f"s{i}").bitwiseAND(LOW), F.lit(NO_SAMPLE)) for i in range(GROUP_SAMPLES)])
    parts = least.select(*of, "part", drawn.alias("drawn"))
    held = F.array_sort(F.collect_list(F.struct(which, "part", "drawn")))
    return parts.groupBy(*keys).agg(F.flatten(F.transform(held, lambda x: x["drawn"])).alias("samples"))


def likeness(a: Column, b: Column) -> Column:
    """The share of samples in which two fingerprints agree: an estimate of the weighted Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(SAMPLES))


def printed(samples: Column) -> Column:
    return F.lower(F.array_join(F.transform(samples, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


# --- neighbours in descending id order ------------------------------------------------

MOST_BLOCKS = 2_000
NULL_BLOCK_BITS = 6


@dataclass
class Ordered:
    """``rows`` (block, edge, doc_id, fp, text): blocks of documents in descending id order.

    Each block ends with a copy of the next block's first document (``edge``), the last block with
    that of the first one, so every document meets its successor inside its block.
    """

    rows: DataFrame

    def window(self) -> Window:
        return Window.partitionBy("block").orderBy("edge", F.desc_nulls_last("doc_id"), "fp")


def in_blocks(rows: DataFrame) -> Ordered:
    """Documents (doc_id, fp, text) cut at quantiles of the id into blocks of about equal numbers of rows.

    Rows without an id come last, by hash of the text, in blocks of their own. What is collected or sent
    to the tasks is one value a block.
    """
    spark = rows.sparkSession
    blocks = max(2, min(MOST_BLOCKS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shares = [i / blocks for i in range(1, blocks)]
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, 20 * blocks)).first()[0] or []))
    later = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda cut: cut > F.col("doc_id")))
    without = F.lit(len(cuts) + 1) + F.shiftright("fp", 64 - NULL_BLOCK_BITS).cast("int") + (1 << (NULL_BLOCK_BITS - 1))
    placed = rows.withColumn("block", F.when(F.col("doc_id").isNull(), without).otherwise(later).cast("int"))
    # The first row of a block has the greatest id, then the least hash.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("turned"), "fp"))
    heads = placed.groupBy("block").agg(first.alias("head"))
    before = Window.orderBy("block")
    last = Window.orderBy(F.desc("block"))
    heads = heads.select(
        F.coalesce(F.lag("block").over(before), F.first("block").over(last)).alias("to"),
        F.bitwise_not("head.turned").alias("head_id"), F.col("head.fp").alias("head_fp"),
    )
    heads = materialise(heads, "fingerprint-heads")
    edges = placed.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("fp") == F.col("head_fp")))
    columns = ["doc_id", "fp", "text"]
    edges = edges.select(F.col("to").alias("block"), F.lit(True).alias("edge"), *columns)
    return Ordered(placed.select("block", F.lit(False).alias("edge"), *columns).unionByName(edges))


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of documents and of their edited texts, one row per row of ``docs``.

    The edited text of a document ends, in place of its last floor(n_chars / 2) code points, in as many of the first
    code points of the next document in descending id order (all, if it has fewer); the first document follows the last.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (SAMPLES drawn values of 32 bits, in
    hexadecimal), near_edited, near_next.

    Terms are the words of a text as they stand, weighted by their number. Texts of equal words have equal
    fingerprints. A null text is empty; texts without a word are alike (1) and like no other (0). Rows equal
    in id and text are one document with equal results, and the next document is another one; rows that
    share an id but not a text go by hash of the text, rows without an id come last. A single document follows
    itself. An empty table gives no rows. Further columns are not read.

    Texts are shuffled once, by block of ids; words are counted and samples drawn where the texts lie.
    """
    filled = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = chosen(filled)
    ordered = in_blocks(rows)
    window = ordered.window()
    keys = ["block", "edge", "doc_id", "fp"]
    same = [F.lag(c).over(window).eqNullSafe(F.col(c)) for c in ("edge", "doc_id", "fp")]
    # A copy has the row before it in everything; the first row of a block has none.
    single = ordered.rows.withColumn("copy", (F.row_number().over(window) > 1) & same[0] & same[1] & same[2]).where(~F.col("copy")).drop("copy")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    following = F.lead("text").over(window)
    edited = single.withColumn("following", following).withColumn("edited", F.concat(F.left("text", n - half), F.left(F.coalesce("following", F.lit("")), half)))

    def split(text: str) -> Column:
        return F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ")

    both = edited.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("x"))
    words = both.select(*keys, F.col("x.which").alias("which"), F.col("x.t").alias("t")).select(*keys, "which", F.explode(split("t")).alias("word"))
    drawn = signatures(words, keys, "which").select(
        *keys, F.slice("samples", 1, SAMPLES).alias("own"), F.slice("samples", SAMPLES + 1, SAMPLES).alias("changed")
    )
    near = drawn.withColumn("beside", F.lead("own").over(window)).where(~F.col("edge"))
    facts = edited.where(~F.col("edge")).select("block", "doc_id", "fp", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    facts = facts.select(*[F.col(c).alias(f"f_{c}" if c in keys else c) for c in facts.columns])
    on = (F.col("block") == F.col("f_block")) & F.col("doc_id").eqNullSafe(F.col("f_doc_id")) & (F.col("fp") == F.col("f_fp"))
    found = near.join(facts, on).select(
        "doc_id", "fp", "n_chars", "edited_sha256", printed(F.col("own")).alias("fingerprint"), printed(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("beside")).alias("near_next"),
    )
    copies = rows.groupBy("doc_id", "fp").agg(F.count(F.lit(1)).cast("int").alias("copies")).where("copies > 1")
    copies = copies.select(F.col("doc_id").alias("c_id"), F.col("fp").alias("c_fp"), "copies")
    times = F.explode(F.array_repeat(F.lit(0), F.coalesce("copies", F.lit(1)))).alias("copy")
    again = found.join(copies, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("fp") == F.col("c_fp")), "left")
    return again.select(*[c for c in found.columns if c != "fp"], times).drop("copy")
