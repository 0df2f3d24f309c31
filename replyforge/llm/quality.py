"""Quality rules: fixed limits, then robust multivariate outliers of each language and source."""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replyforge.llm.common import WORD, chosen, free_names, let
from replyforge.session import materialise

# Fixed by the contract of the base rules.
SYMBOL_CHARACTERS = "#*$%&|<>"
SYMBOLS = f"[{SYMBOL_CHARACTERS}]"
MIN_WORDS = 10
WINDOW_WORDS = 5
MOST_REPEATED_PERCENT = 20

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["x1", "x2", "x3", "x4"]
# Standard deviations that no estimate falls below: differences of this size are never unusual.
FLOORS = {"x1": 0.1, "x2": 0.04, "x3": 0.08, "x4": 0.05}
# The least share that cannot be mostly junk while junk is under half.
SUBSET = 0.5
# A step goes on only from where the logarithm of the determinant fell by more than this.
FALL = 1e-6
# Of documents of a group whose vectors are normal, one in ten thousand lies beyond the cutoff.
TAIL = 1e-4
MIN_GROUP = 200
# Tables with a row for each group and start are sent to the tasks up to so many groups, some 200 bytes a row.
MOST_SENT_GROUPS = 10_000
GRID = 0.001


def _repeated_words(words: Column) -> Column:
    """Words inside windows of five that the text has twice or more, on an array of words."""

    def covered(starts: Column) -> Column:
        step = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW_WORDS))))
        return F.aggregate(step, F.lit(0), lambda a, b: a + b)

    def starts(ordered: Column) -> Column:
        same = lambda e, k: (e["h"] == F.get(ordered, k - 1)["h"]) | (e["h"] == F.get(ordered, k + 1)["h"])
        return F.sort_array(F.transform(F.filter(ordered, same), lambda e: e["i"]))

    def from_windows(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # Most texts repeat nothing and stop at the cheap test.
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
            let(let(ordered, starts), covered)
        )

    def from_hashes(hashes: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW_WORDS)])
        return let(F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW_WORDS), window), from_windows)

    return F.when(F.size(words) <= WINDOW_WORDS, F.lit(0)).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), from_hashes)
    )


def base_statistics(rows: DataFrame) -> DataFrame:
    """``rows`` (with a text) with the five counts, ``n_lower``, ``n_marks`` and ``base_failed``; without the text.

    ``n_marks`` counts the words that are one symbol alone, as between the cells of a table.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counted = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            _repeated_words(w).cast("bigint").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(*SYMBOL_CHARACTERS))).cast("bigint").alias("n_marks"),
        ),
    )
    kept_length = lambda pattern: F.char_length(F.regexp_replace(text, pattern, ""))
    return (
        rows.withColumn("counted", counted)
        .withColumn("n_symbols", (F.char_length(text) - kept_length(SYMBOLS)).cast("bigint"))
        .withColumn("n_dup_lines", dup.cast("bigint"))
        .withColumn("n_lower", kept_length(r"[^\p{Ll}]+").cast("bigint"))
        .select(*[c for c in rows.columns if c != "text"], "counted.*", "n_symbols", "n_dup_lines", "n_lower")
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")),
        )
    )


def _transformed() -> dict[str, Column]:
    """The statistic vector: shares on a scale with even variance, shrunk where a text is short.

    The constants added are a prior of some fifty usual words, so that short clean texts are not far out. Symbols
    that stand alone are no words, as far as they are no more than the other words: a table is judged by its cells,
    and a text of symbols by its symbols.
    """
    marks = F.least("n_marks", F.floor(F.col("n_words") / 2))
    words, chars = F.col("n_words") - marks, F.col("word_chars") - marks
    return {
        "x1": F.log((chars + 250) / (words + 50)),
        "x2": F.sqrt((F.col("n_symbols") - marks) / (chars + 250)),
        "x3": F.sqrt(F.col("n_repeat_words") / (words + 50)),
        "x4": F.sqrt((chars - F.least(F.col("n_lower"), chars)) / (chars + 250)),
    }


def _grid_quantile(rows: DataFrame, keys: list[str], value: str, share: float, more: float = 0) -> DataFrame:
    """(keys, q): the quantile of ``value`` on a grid of ``GRID``, exact there; ``more`` rows are added to the share.

    Values are counted by grid cell before any shuffle, so a key with a third of all rows is no more
    than its cells; the cells are few because the value has a bounded range.
    """
    cells = rows.groupBy(*keys, F.floor(F.col(value) / GRID).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    below = F.sum("n").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    return (
        cells.select(*keys, "cell", below.alias("below"), F.sum("n").over(w).alias("all"))
        .where(F.col("below") >= F.least(F.col("all") * share + more, F.col("all")))
        .groupBy(*keys)
        .agg(((F.min("cell") + 1) * GRID).alias("q"))
    )


def _feature_quantiles(rows: DataFrame, values: dict[str, Column], prefix: str) -> DataFrame:
    """Median of each feature by key, as columns ``prefix + feature``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), v.alias("v")) for f, v in values.items()]))
    long = rows.select("key", pairs.alias("p")).select("key", "p.f", "p.v")
    medians = _grid_quantile(long, ["key", "f"], "v", 0.5)
    return medians.groupBy("key").agg(*[F.max(F.when(F.col("f") == f, F.col("q"))).alias(prefix + f) for f in values])


def chi_square_quantile(share: float) -> float:
    """Quantile of the chi-square distribution with four degrees, by halving."""
    low, high = 0.0, 200.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - math.exp(-middle / 2) * (1 + middle / 2) < share else (low, middle)
    return low


def _consistency(share: float) -> float:
    """Factor that makes the covariance of the ``share`` nearest of four normal variables unbiased."""
    x = chi_square_quantile(share)
    return share / (1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8))


def _factor(cov: dict[tuple[str, str], Column]) -> list[Column]:
    """Columns of the Cholesky factor of the covariance with the floors added to its diagonal."""
    made: dict[tuple[int, int], Column] = {}
    for i, a in enumerate(FEATURES):
        for j, b in enumerate(FEATURES[: i + 1]):
            rest = cov[b, a] + (F.lit(FLOORS[a] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            made[i, j] = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}")
    return [(f"l{i}{j}", c) for (i, j), c in sorted(made.items(), key=lambda x: (x[0][1], x[0][0]))]


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution with the columns m_* and l**."""
    z: list[Column] = []
    for i, f in enumerate(FEATURES):
        rest = F.col(f) - F.col("m_" + f)
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * z[k]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _estimate(rows: DataFrame, factor: float) -> DataFrame:
    """(key, start, m_*, l**, det): mean and Cholesky factor of the covariance of ``rows`` by key and start.

    ``det`` is the logarithm of the determinant, rounded so that equal estimates tie.
    """
    pairs = [(b, a) for i, a in enumerate(FEATURES) for b in FEATURES[: i + 1]]
    out = rows.groupBy("key", "start").agg(
        *[F.avg(f).alias("m_" + f) for f in FEATURES],
        *[(F.covar_pop(b, a) * factor).alias(f"c_{b}_{a}") for b, a in pairs],
    )
    for name, column in _factor({(b, a): F.col(f"c_{b}_{a}") for b, a in pairs}):
        out = out.withColumn(name, column)
    det = sum((2 * F.log(f"l{i}{i}") for i in range(1, len(FEATURES))), 2 * F.log("l00"))
    return out.drop(*[f"c_{b}_{a}" for b, a in pairs]).withColumn("det", F.round(det, 9))


def _parent(key: Column) -> Column:
    """The next coarser group, of (language, source) the language and of a language all; null for all."""
    language = F.concat(F.substring_index(key, "\x01", 1), F.lit("\x01"))
    return F.when(key == "", F.lit(None)).when(key == language, F.lit("")).otherwise(language)


def _starts(rows: DataFrame) -> DataFrame:
    """(key, start, m_*, l**): first estimates without covariances, several for each group.

    They are the medians of the group with its median deviations (0) and with the floors alone (1),
    and medians and deviations of the next coarser group (2) and of all documents (3).
    """
    medians = _feature_quantiles(rows, {f: F.col(f) for f in FEATURES}, "m_")
    away = _feature_quantiles(rows.join(medians, "key"), {f: F.abs(F.col(f) - F.col("m_" + f)) for f in FEATURES}, "s_")
    both = materialise(medians.join(away, "key"), "quality-medians")
    numbers = [c for c in both.columns if c != "key"]
    every = both.select("key", F.lit(0).alias("start"), *numbers).unionByName(
        both.select("key", F.lit(1).alias("start"), *["m_" + f for f in FEATURES], *[F.lit(0.0).alias("s_" + f) for f in FEATURES])
    )
    of_all = both.where(F.col("key") == "").drop("key")
    # A language with too few documents has no estimate; then those of all are used.
    coarser = both.withColumnRenamed("key", "parent")
    children = both.select("key", _parent(F.col("key")).alias("parent"))
    every = every.unionByName(children.join(coarser, "parent").select("key", F.lit(2).alias("start"), *numbers))
    finest = children.where(F.col("parent") != "").select("key", F.lit(3).alias("start"))
    out = every.unionByName(finest.join(F.broadcast(of_all), F.lit(True)).select("key", "start", *numbers))
    for i, f in enumerate(FEATURES):
        for j in range(i + 1):
            out = out.withColumn(
                f"l{i}{j}", F.greatest(F.col("s_" + f) * 1.4826, F.lit(FLOORS[f])) if i == j else F.lit(0.0)
            )
    return out.drop(*["s_" + f for f in FEATURES])


def _sender(groups: DataFrame):
    """``F.broadcast`` where the groups are few, so that a group with most documents is not gathered for a join; else nothing."""
    few = groups.limit(MOST_SENT_GROUPS + 1).count() <= MOST_SENT_GROUPS
    return F.broadcast if few else lambda table: table


def _nearest(rows: DataFrame, found: DataFrame, send) -> DataFrame:
    """The (n + 5) / 2 rows of each group that are nearest to each of its estimates."""
    away = rows.join(send(found), "key").withColumn("away", F.log1p(_distance()))
    limit = _grid_quantile(away, ["key", "start"], "away", SUBSET, 2.5)
    return away.join(send(limit), ["key", "start"]).where(F.col("away") <= F.col("q")).select("key", "start", *FEATURES)


def _keys() -> Column:
    """The document's three possible groups, finest first."""
    lang, source = F.coalesce("lang", F.lit("\x02")), F.coalesce("source", F.lit("\x02"))
    return F.array(F.concat(lang, F.lit("\x01"), source), F.concat(lang, F.lit("\x01")), F.lit(""))


def covariances(stats: DataFrame, min_group: int = MIN_GROUP) -> tuple[DataFrame, DataFrame]:
    """Estimates by group, and the groups in use, from the documents that pass the base rules.

    Each (language, source) with ``min_group`` such documents is a group of its own; others use
    their language, and languages with fewer use all documents. From several starts, each step keeps
    the nearest (n + 5) / 2 of every group and takes mean and covariance anew, which lowers the
    determinant, until it falls no more; the estimate with the lowest determinant is the group's.
    Starts that have met go on as one. Each step is one aggregation that is combined in the tasks.
    """
    good = stats.where(~F.col("base_failed"))
    sizes = good.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    usable = materialise(sizes.where((F.col("n") >= min_group) | (F.col("key") == "")).select("key"), "quality-groups")
    send = _sender(usable)
    rows = good.select(F.explode("keys").alias("key"), *FEATURES).join(send(usable), "key")
    factor = _consistency(SUBSET)
    active = materialise(_estimate(_nearest(rows, materialise(_starts(rows), "quality-start"), send), factor), "quality-step0")
    best = active
    columns = active.columns
    for step in count(1):
        active = active.dropDuplicates(["key", "det"])
        after = _estimate(_nearest(rows, active.drop("det"), send), factor)
        old = active.select("key", "start", F.col("det").alias("before"))
        lower = after.join(old, ["key", "start"]).where(F.col("det") < F.col("before") - FALL)
        active = materialise(lower.select(*columns), f"quality-step{step}")
        if active.isEmpty():
            break
        numbers = [c for c in columns if c != "key"]
        lowest = best.unionByName(active).groupBy("key").agg(F.min_by(F.struct(*numbers), F.struct("det", "start")).alias("b"))
        best = materialise(lowest.select("key", "b.*"), f"quality-best{step}")
    numbers = [c for c in columns if c not in ("key", "det", "start")]
    found = best.groupBy("key").agg(F.min_by(F.struct(*numbers), F.struct("det", "start")).alias("b")).select("key", "b.*")
    found = materialise(found, "quality-found")
    return found, usable


def judge(docs: DataFrame, tail: float = TAIL, min_group: int = MIN_GROUP, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: (doc_id, fp, five counts, base_failed, distance, kept).

    A document goes if it fails the base rules, or if its statistic vector (word length, symbols,
    repeated words, characters that are not lower-case letters) lies too far from the documents of its language
    and source. ``distance`` is the squared robust Mahalanobis distance, divided by the median distance of the group
    over that of a normal distribution where this is more than one; the cutoff is the value that a share of
    ``tail`` of a normal distribution exceeds.

    A null or empty text has no words and fails the base rules. A null language or source is a
    group like any other. Repeated rows are judged alike. With no document that passes the base
    rules there is nothing to estimate, and only the base rules count. Further columns are not read.
    """
    rows = chosen(docs, F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), id_col=id_col, text_col=text_col)
    stats = base_statistics(rows).withColumns(_transformed()).withColumn("keys", _keys())
    stats = materialise(stats.drop("lang", "source", "n_lower", "n_marks"), "quality-stats")
    found, usable = covariances(stats, min_group)
    # The finest usable group of each document; the groups are few, the documents of one may be a third of all.
    chains = stats.select("keys").distinct()
    finest = (
        chains.select("keys", F.posexplode("keys").alias("level", "key"))
        .join(usable, "key")
        .groupBy("keys")
        .agg(F.min_by("key", "level").alias("key"))
    )
    send = _sender(usable)
    measured = stats.join(send(finest), "keys", "left").join(send(found), "key", "left").withColumn("away", F.round(_distance(), 6))
    logs = measured.where(~F.col("base_failed") & F.col("away").isNotNull()).select("key", F.log1p("away").alias("away"))
    medians = _grid_quantile(logs, ["key"], "away", 0.5)
    scales = materialise(medians.select("key", F.greatest(F.lit(1.0), F.expm1("q") / chi_square_quantile(0.5)).alias("scale")), "quality-scales")
    away = F.round(F.col("away") / F.coalesce("scale", F.lit(1.0)), 6)
    return measured.join(send(scales), "key", "left").select(
        "doc_id",
        "fp",
        *BASE,
        "base_failed",
        away.alias("distance"),
        (~F.col("base_failed") & F.coalesce(away <= chi_square_quantile(1 - tail), F.lit(True))).alias("kept"),
    )


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are. ``options``: those of :func:`judge`."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    i, f = free_names(docs, "id", "fp")
    verdict = judge(docs, **options).where("kept").select(F.col("doc_id").alias(i), F.col("fp").alias(f))
    on = docs[id_col].cast("bigint").eqNullSafe(F.col(i)) & (F.xxhash64(docs[text_col]) == F.col(f))
    return docs.join(verdict, on, "left_semi")
