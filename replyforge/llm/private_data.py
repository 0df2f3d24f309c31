"""Personal data: fixed patterns, and identifiers found through contexts learned from them."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replyforge.llm.common import SPACE_CHARACTERS, chosen, free_names, let, scanned, with_per_document
from replyforge.session import materialise

# The four base patterns of the contract, written so that they cannot backtrack far: a possessive
# quantifier or a look-behind stands where the plain form would only try what must fail again.
# A match may begin where the last one ended (\G) or where the character before cannot belong to it.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must contain for a pattern to be tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
PART = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$"
# A run of tokens with a digit or an at sign, from one blank to another.
CANDIDATE = r"(?:\G|(?<![^\x20\x09-\x0D]))[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:\x20[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)*+"
# What an unseen identifier must look like to be taken for one of a kind.
SHAPES = {
    "email": r"^[^\s@]+@[^\s@]+$",
    "ip": r"^[0-9a-fA-F]+(?:[.:][0-9a-fA-F]*){3,}$",
    "card": r"^(?=(?:[^0-9]*[0-9]){12,19}[^0-9]*$)[0-9](?:[\x20.-]?[0-9])+$",
    "phone": r"^(?=(?:[^0-9]*[0-9]){6,15}[^0-9]*$)[+(0-9][\x20()./0-9-]*[0-9]$",
}
# No shape holds more digits than a card, and each token of a run has a digit or is a mail address.
MOST_TOKENS = 19
# Punctuation from the last word or blank to the end.
OPENING = r"(?<![^\p{L}\p{N}:=#\x20\x09-\x0D])[^\p{L}\p{N}:=#\x20\x09-\x0D]++$"
CONFIDENCE = 0.8
MIN_SEEDS = 5
# A rise that is only rounding.
SETTLED = 1e-9


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, 9 taken off where that exceeds it; the sum is a multiple of 10."""

    def term(i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.pmod(i, F.lit(2)) == 0
        return F.when(twice, F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), lambda a, i: a + term(i))
    return F.pmod(total, F.lit(10)) == 0


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: p.rlike(PART)),
    "card": lambda m: F.char_length(_digits(m)).between(16, 19) & _luhn(_digits(m)),
    "phone": lambda m: F.char_length(_digits(m)).between(8, 15),
}


def _located(text: Column, pattern: str) -> Column:
    """Array of (start, end, before, match) of the matches of ``pattern``, in code points, end exclusive.

    What lies between the matches gives their places: splitting and extracting walk the same matches.
    """
    parts = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda before, match: F.struct(before.alias("before"), match.alias("match")),
    )
    sizes = lambda ps: F.transform(ps, lambda p: F.char_length(p["before"]) + F.char_length(p["match"]))

    def placed(parts: Column) -> Column:
        def place(begins: Column) -> Column:
            def span(p: Column, i: Column) -> Column:
                start = F.get(begins, i) + F.char_length(p["before"])
                return F.struct(start.alias("start"), (start + F.char_length(p["match"])).alias("end"), p["before"].alias("before"), p["match"].alias("match"))

            return F.transform(parts, span)

        return let(scanned(sizes(parts), F.lit(0), lambda a, b: a + b), place)

    return let(F.filter(parts, lambda p: p["match"].isNotNull()), placed)


def _base(text: Column, kind: str) -> Column:
    found = F.filter(_located(text, PATTERNS[kind]), lambda s: VALID[kind](s["match"]))
    spans = F.transform(found, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("value")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")
    return F.when(text.rlike(HINTS[kind]), spans).otherwise(none)


def _left(before: Column) -> Column:
    """The last word of ``before``, in lower case, with only letters and the marks of a label.

    Lines and columns end words as blanks do, so that a label at the start of a line is the word.
    """
    # Only the end of what stands before is looked at, however long it is.
    near = F.translate(F.right(F.rtrim(before, F.lit(SPACE_CHARACTERS)), F.lit(200)), SPACE_CHARACTERS, " " * len(SPACE_CHARACTERS))
    return F.regexp_replace(F.lower(F.substring_index(near, " ", -1)), r"[^\p{L}:=#]+", "")


def _trimmed(run: Column) -> tuple[Column, Column]:
    """Characters before the value in ``run``, and the value: without the punctuation around it."""
    head = F.char_length(F.regexp_extract(run, r"^[^\p{L}\p{N}+(]*", 0))
    return head, F.regexp_replace(F.substr(run, head + 1), r"[^\p{L}\p{N}]+$", "")


def _regions(base: Column) -> Column:
    """The base matches by start as (start, kind, end, value); overlapping ones are one, under the first kind."""
    by_start = F.sort_array(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), b["value"].alias("value"))))

    def merged(spans: Column) -> Column:
        def from_reached(reached: Column) -> Column:
            heads = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: F.get(spans, i)["start"] >= F.get(reached, i))

            def regions(heads: Column) -> Column:
                def region(h: Column, k: Column) -> Column:
                    own = F.slice(spans, h + 1, F.coalesce(F.get(heads, k + 1), F.size(spans)) - h)
                    first = F.array_min(F.transform(own, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["value"].alias("value"))))
                    return F.struct(
                        F.get(spans, h)["start"].alias("start"), first["kind"].alias("kind"),
                        F.array_max(F.transform(own, lambda s: s["end"])).alias("end"), first["value"].alias("value"),
                    )

                return F.transform(heads, region)

            return let(heads, regions)

        # How far the matches before reach.
        return let(scanned(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b)), from_reached)

    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return let(by_start, lambda spans: F.when(F.size(spans) > 0, merged(spans)).otherwise(none))


def _parted(text: Column, base: Column) -> Column:
    """(seeds, runs): base matches as (left, value, seed), and identifier-like runs beside them as (start, run, left).

    Runs are looked for in what lies between the base matches, so that none holds part of one.
    """

    def between(regions: Column) -> Column:
        def segment(i: Column) -> Column:
            start = F.when(i > 0, F.get(regions, i - 1)["end"]).otherwise(F.lit(0))
            whole = F.size(regions) == 0
            body = F.when(whole, text).otherwise(F.substr(text, start + 1, F.coalesce(F.get(regions, i)["start"], F.char_length(text)) - start))
            return F.struct(start.alias("start"), body.alias("body"))

        return F.transform(F.sequence(F.lit(0), F.size(regions)), segment)

    def seed(segments: Column, region: Column, i: Column) -> Column:
        # An opening bracket or quote at the match is not a word.
        before = F.regexp_replace(F.get(segments, i)["body"], OPENING, "")
        return F.struct(_left(before).alias("left"), region["value"].alias("value"), region["kind"].alias("seed"))

    def runs(segment: Column) -> Column:
        return F.transform(
            _located(segment["body"], CANDIDATE),
            lambda s: F.struct((segment["start"] + s["start"]).alias("start"), s["match"].alias("run"), _left(s["before"]).alias("left")),
        )

    def parts(regions: Column) -> Column:
        return let(
            between(regions),
            lambda segments: F.struct(
                F.transform(regions, lambda r, i: seed(segments, r, i)).alias("seeds"),
                F.flatten(F.transform(segments, runs)).alias("runs"),
            ),
        )

    none = F.lit(None).cast("struct<seeds:array<struct<left:string,value:string,seed:int>>,runs:array<struct<start:int,run:string,left:string>>>")
    return F.when(text.rlike("[0-9@]"), let(let(base, _regions), parts)).otherwise(none)


def _looks(value: Column) -> Column:
    """The kinds whose shape ``value`` has."""
    return F.array_compact(F.array(*[F.when(value.rlike(SHAPES[k]), F.lit(i)) for i, k in enumerate(KINDS)]))


def _readings(runs: DataFrame) -> DataFrame:
    """A row for each token of each run: (doc_id, fp, left, other, readings).

    ``readings`` are the values that begin at the token and look like an identifier, shorter ones
    first, as (start, end, value, kinds); ``other`` is what stands there if nothing does.
    """

    def places(tokens: Column) -> Column:
        def place(t: Column, i: Column) -> Column:
            left = F.when(i == 0, F.col("left")).otherwise(_left(F.get(tokens, i - 1)["match"]))
            words = F.transform(F.slice(tokens, i + 1, MOST_TOKENS), lambda x: x["match"])
            other = F.when(i == 0, F.col("run")).otherwise(t["match"])
            return F.struct((F.col("start") + t["start"]).alias("at"), left.alias("left"), other.alias("other"), words.alias("words"))

        return F.transform(tokens, place)

    def reading(k: Column) -> Column:
        run = F.array_join(F.slice("words", 1, k), " ")

        def of(run: Column) -> Column:
            head, value = _trimmed(run)
            return let(
                value,
                lambda v: F.struct(
                    (F.col("at") + head).alias("start"), (F.col("at") + head + F.char_length(v)).alias("end"), v.alias("value"), _looks(v).alias("kinds")
                ),
            )

        return let(run, of)

    placed = runs.select("doc_id", "fp", F.explode(let(_located(F.col("run"), r"[^\x20]+"), places)).alias("p")).select("doc_id", "fp", "p.*")
    readings = F.transform(F.sequence(F.lit(1), F.size("words")), reading)
    return placed.select(
        "doc_id", "fp", "left", _trimmed(F.col("other"))[1].alias("other"), F.filter(readings, lambda r: F.size(r["kinds"]) > 0).alias("readings")
    )


def _instances(readings: DataFrame) -> DataFrame:
    """(left, value, kind, main): what each place says about the word before it.

    A place counts once, by its longest reading (``main``, without a kind); for each kind its
    longest reading of that kind is the value that may be one.
    """
    longest = lambda rs: F.get(rs, F.size(rs) - 1)["value"]
    entry = lambda value, kind, main: F.struct(value.alias("value"), F.lit(kind).cast("int").alias("kind"), F.lit(main).alias("main"))
    main = entry(F.coalesce(longest(F.col("readings")), F.col("other")), None, True)
    like = lambda i: F.filter("readings", lambda r: F.array_contains(r["kinds"], i))
    of_kind = [entry(longest(like(i)), i, False) for i in range(len(KINDS))]
    return (
        readings.where(F.col("left") != "")
        .select("left", F.explode(F.filter(F.array(main, *of_kind), lambda e: e["value"].isNotNull())).alias("e"))
        .select("left", "e.*")
    )


def learned_values(instances: DataFrame, confidence: float = CONFIDENCE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(value, kind) of the identifiers that contexts learned from the seeds point to.

    ``instances`` has (left, value, seed, kind, main): the word before a value, the value, the kind if
    it is a base match, the kind it may be one of, and whether it counts among the values of the
    context, see :func:`_instances`. Values and contexts form a graph. A context's confidence for a
    kind is the mean score of its distinct values, with one unknown value added; a value's score for
    a kind it looks like is the best confidence among its contexts. Contexts with few distinct seeds
    say nothing. A context or value with many rows shrinks to its distinct edges before any join.

    Both are taken at their limit, not after some rounds. A value whose best context is the one in
    question has that context's own confidence x, so with S seeds, n values, ``own`` such values and
    ``sum`` as the better scores of the others, x = (S + sum) / (n + 1 - own). Scores only rise, and a
    context waits only for better ones, so the rounds end by themselves: when none rises.

    The guard against drift: learned values never become seeds, x is S / (S + 1 + others) where
    no better context helps, and values of another shape are among the others. With the default
    ``confidence`` such a context needs four seeds for each of the others and four besides, and ``min_seeds`` at least.
    """
    edges = materialise(
        instances.where((F.col("left") != "") & (F.col("value") != ""))
        .groupBy("left", "value")
        .agg(F.max("seed").alias("seed"), F.max("main").alias("main"), F.collect_set("kind").alias("kinds")),
        "pii-edges",
    )
    counted = edges.where("main")
    known = edges.where("seed is not null").groupBy("value").agg(F.max("seed").alias("seed"))
    unseen = edges.select("left", "value", F.explode("kinds").alias("kind")).join(known, "value", "left_anti")
    sizes = counted.groupBy("left").agg(F.count(F.lit(1)).alias("n"))
    support = (
        counted.select("left", "value").join(known, "value").groupBy("left", F.col("seed").alias("kind")).agg(F.count(F.lit(1)).alias("seeds"))
    ).where(F.col("seeds") >= min_seeds)
    support = materialise(support.join(sizes, "left"), "pii-contexts")
    # Values that share a context with enough seeds; all others keep no score.
    reach = materialise(unseen.join(support.select("left", "kind"), ["left", "kind"]), "pii-reach")
    # Before any exchange a context knows its seeds and the values that follow it alone.
    own = reach.groupBy("left", "kind").agg(F.count(F.lit(1)).alias("own"))
    start = F.round(F.col("seeds") / (F.col("n") + 1 - F.col("own")), 12)
    contexts = materialise(support.join(own, ["left", "kind"]).withColumn("confidence", start).drop("own"), "pii-scores0")
    for i in count(1):
        scores = reach.join(contexts.select("left", "kind", "confidence"), ["left", "kind"])
        scores = scores.groupBy("value", "kind").agg(F.max("confidence").alias("score"))
        better = F.col("score") > F.col("confidence")
        gained = (
            reach.join(scores, ["value", "kind"])
            .join(contexts.select("left", "kind", "confidence"), ["left", "kind"])
            .groupBy("left", "kind")
            .agg(F.sum(F.when(better, F.col("score")).otherwise(0.0)).alias("sum"), F.count(F.when(~better, 1)).alias("own"))
        )
        limit = F.round((F.col("seeds") + F.col("sum")) / (F.col("n") + 1 - F.col("own")), 12)
        risen = contexts.join(gained, ["left", "kind"]).select(
            "left", "kind", "seeds", "n", F.greatest("confidence", limit).alias("confidence"), (limit > F.col("confidence") + SETTLED).alias("risen")
        )
        risen = materialise(risen, f"pii-scores{i}")
        contexts = risen.drop("risen")
        if risen.where("risen").isEmpty():
            break
    scores = reach.join(contexts.select("left", "kind", "confidence"), ["left", "kind"])
    fresh = scores.groupBy("value", "kind").agg(F.max("confidence").alias("score")).where(F.col("score") >= confidence)
    return fresh.groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confidence: float = CONFIDENCE,
         min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(doc_id, fp, base, spans) for each row of ``docs``; both are arrays of (kind, start, end).

    ``base`` holds the matches of the fixed patterns, by kind (index into ``KINDS``) and start. ``spans``
    holds these and the identifiers found by bootstrapping: base matches are the seeds, words before
    them the patterns, see :func:`learned_values`. A found identifier never overlaps a base match: a
    run of tokens is split around its base matches, and any tokens side by side in the rest may be one.

    A null text counts as empty and has no spans; nor has a text without digits and at signs.
    Repeated rows have equal results. An empty table gives no rows. Further columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    both = let(F.concat(*[_base(text, k) for k in KINDS]), lambda b: F.struct(b.alias("base"), _parted(text, b).alias("parted")))
    rows = chosen(docs, id_col=id_col, text_col=text_col).select("doc_id", "fp", both.alias("both"))
    rows = materialise(rows.select("doc_id", "fp", "both.base", "both.parted.*"), "pii-base")
    runs = rows.where(F.size("runs") > 0).select("doc_id", "fp", F.explode("runs").alias("r")).select("doc_id", "fp", "r.*")
    readings = materialise(_readings(runs), "pii-readings")
    seeds = rows.where(F.size("seeds") > 0).select(F.explode("seeds").alias("s")).select("s.*")
    instances = _instances(readings).unionByName(seeds.withColumn("main", F.lit(True)), allowMissingColumns=True)
    learned = learned_values(instances, confidence, min_seeds)
    hits = readings.select("doc_id", "fp", F.explode("readings").alias("r")).select("doc_id", "fp", "r.start", "r.end", "r.value")
    # Of readings inside one another the outermost stays.
    before = Window.partitionBy("doc_id", "fp").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    extra = (
        hits.join(learned, "value")
        .withColumn("reached", F.max("end").over(before))
        .where(F.col("reached").isNull() | (F.col("end") > F.col("reached")))
        .groupBy("doc_id", "fp")
        .agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end"))).alias("extra"))
    )
    base = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return with_per_document(rows.select("doc_id", "fp", base.alias("base")), extra).select(
        "doc_id", "fp", "base", F.sort_array(F.concat("base", F.coalesce("extra", none))).alias("spans")
    )


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("bigint")


def digest(found: DataFrame) -> DataFrame:
    counts = [_count(i).alias("n_" + k) for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each span in its text replaced by the kind in angle brackets; other columns as they are.

    Overlapping spans are replaced together, under the kind of the first. A null text stays null, and so does every row;
    repeated rows are redacted alike. Other columns may have any name.
    """
    found = find(docs, id_col, text_col, **options)
    # Repeated rows share one result, so that each row of the input comes out once.
    i, f, spans = free_names(docs, "id", "fp", "spans")
    found = found.where(F.size("spans") > 0).dropDuplicates(["doc_id", "fp"]).select(F.col("doc_id").alias(i), F.col("fp").alias(f), F.col("spans").alias(spans))
    on = docs[id_col].cast("bigint").eqNullSafe(F.col(i)) & (F.xxhash64(docs[text_col]) == F.col(f))
    text = docs[text_col]
    tags = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def replaced(by_start: Column) -> Column:
        def pieces(reached: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                at = F.get(reached, i)
                own = F.concat(F.substr(text, at + 1, F.greatest(s["start"] - at, F.lit(0))), F.get(tags, s["kind"]))
                return F.when(s["start"] < at, F.lit("")).otherwise(own)

            last = F.array_max(F.transform(by_start, lambda s: s["end"]))
            return F.concat(F.array_join(F.transform(by_start, piece), ""), F.substr(text, last + 1))

        return let(scanned(F.transform(by_start, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b)), pieces)

    by_start = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    new = F.when(F.col(spans).isNull(), text).otherwise(let(by_start, replaced)).alias(text_col)
    return docs.join(found, on, "left").select(*[new if c == text_col else docs[c] for c in docs.columns])
