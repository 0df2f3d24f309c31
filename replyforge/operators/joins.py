"""Left joins against lookup tables with one row per key, safe for hot keys.

A lookup side is broadcast only after its size was read; beyond the bound the
join shuffles, with the hot keys of the big side salted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyforge.session import materialise

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
HOT_ROWS = 1_000_000
HOT_BYTES = 32 << 20
MOST_NAMES = 500
SKETCHES = 64
HOT_KEYS_PER_SKETCH = 64
TRACKED_KEYS_PER_SKETCH = 512


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is small. No more than ``max_rows`` + 1 of its rows are counted and measured."""
    width = F.length(F.to_json(F.struct("*")))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def planned_bytes(df: DataFrame) -> int:
    """The size the optimizer expects, without a job. An estimate: it may choose a plan but prove no bound."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Hashes of the keys with more than ``hot_rows`` rows and how many parts each is cut into.

    Never more than ``SKETCHES * HOT_KEYS_PER_SKETCH`` rows. Mergeable sketches find them
    in one pass without a shuffle by key; the keys are dealt to several sketches, so that
    no single task merges those of all tasks. They only decide what gets salted, so
    their error cannot change a result.
    """
    hashed = df.select(key_hash(keys).alias("_hash"))
    top = hashed.groupBy(F.pmod("_hash", F.lit(SKETCHES)).alias("_sketch")).agg(
        F.expr(f"approx_top_k(_hash, {HOT_KEYS_PER_SKETCH}, {TRACKED_KEYS_PER_SKETCH})").alias("top")
    )
    return (
        top.select(F.explode("top").alias("t"))
        .where(F.col("t.count") > hot_rows)
        .select(F.col("t.item").alias("_hash"), F.ceil(F.col("t.count") / hot_rows).cast("bigint").alias("_parts"))
    )


def salted_left_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    hot_rows: int = HOT_ROWS,
    how: str = "left",
) -> DataFrame:
    """Shuffled left (or inner) join to one row per key; a hot key is cut into parts of about ``hot_rows`` rows.

    ``spread`` names columns that tell the rows of one key apart. The salt is their
    hash and not a random number, so a retried task puts every row where it was.
    The right row of a hot key is copied once per part: at most one copy for every
    ``hot_rows`` rows of the left side. The short list of hot keys is written, since both
    sides read it; without any this is a plain join. So it is where the left side is expected to be
    too small for hot keys.
    """
    if hot_rows == HOT_ROWS and planned_bytes(left) < HOT_BYTES:
        return left.join(right, list(keys), how)
    hot = materialise(hot_keys(left, keys, hot_rows), "hot-keys")
    if hot.isEmpty():
        return left.join(right, list(keys), how)
    hot = F.broadcast(hot)
    zero = F.lit(0).cast("bigint")
    big = (
        left.withColumn("_hash", key_hash(keys))
        .join(hot, "_hash", "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")), zero))
        .drop("_hash", "_parts")
    )
    small = (
        right.withColumn("_hash", key_hash(keys))
        .join(hot, "_hash", "left")
        .withColumn("_salt", F.explode(F.sequence(zero, F.coalesce("_parts", F.lit(1)) - 1)))
        .drop("_hash", "_parts")
    )
    return big.join(small, [*keys, "_salt"], how).drop("_salt")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    max_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join to a lookup table: broadcast when it is small, salted otherwise."""
    if fits_broadcast(right, max_rows):
        return left.join(F.broadcast(right), list(keys), "left")
    return salted_left_join(left, right, keys, spread, hot_rows)


def fetch_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Sequence[str]) -> DataFrame:
    """Rows of ``left`` with the row of a big table they point to, which is there for each of them.

    When ``left`` is small it is broadcast and the big table is scanned where it lies.
    """
    if fits_broadcast(left):
        return right.join(F.broadcast(left), list(keys))
    return salted_left_join(left, right, keys, spread, how="inner")


def asked_for(right: DataFrame, left: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``right`` without the rows no key of ``left`` asks for, when those keys are few enough to broadcast.

    Saves the shuffle of the rest before an aggregate or join; with many keys all rows are kept.
    """
    wanted = left.select(*keys).distinct()
    return right.join(F.broadcast(wanted), list(keys), "left_semi") if fits_broadcast(wanted) else right


def in_named_partitions(big: DataFrame, small: DataFrame, column: str, most: int = MOST_NAMES) -> DataFrame:
    """``big`` limited to the values of ``column`` that ``small`` has, as a filter the scan can prune partitions by.

    Without effect when there are more than ``most`` values.
    """
    names = [r[0] for r in small.select(column).distinct().limit(most + 1).collect()]
    return big.where(F.col(column).isin(names)) if len(names) <= most else big


def salted_anti_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right``; hot keys are spread like in the left join."""
    present = asked_for(right.select(*keys), left, keys).distinct().withColumn("_present", F.lit(True))
    return salted_left_join(left, present, keys, spread).where(F.col("_present").isNull()).select(*left.columns)
