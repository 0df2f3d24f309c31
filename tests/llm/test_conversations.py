"""Conversation repair, prefix trie and fingerprints against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from replyforge.llm import conversation_repair as repair
from replyforge.llm import conversation_trie as trie
from replyforge.llm import fingerprints

SCHEMA = "conv_id long, turn long, role string, text string, conv string, piece int, code string, key string, place int, audit string"
CLASH = ("clash", 7, "clash", "clash", 7, "clash")
SPACE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def made(conversations, most, seed):
    draw = random.Random(seed)
    words = ["alpha", "beta", "gamma.", "delta!", "epsilon?", "é", ""]
    rows = []
    for conv in conversations:
        for turn in range(draw.randint(1, most)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = draw.choice([" ".join(draw.choices(words, k=draw.randint(0, 6))), None, " \t", "same text."])
            rows.append((conv, turn + draw.choice([0, 0, 0, 2]), role, text))
    return rows


ODD = [
    (None, 0, "user", "hi."), (None, None, "assistant", "ho."), (900, None, "user", "one."), (900, None, "assistant", "two."),
    (900, 5, "user", "one."), (900, 5, "user", "one."), (901, 3, None, None), (902, 1, "system", "only."), (-7, 0, "user", "x."),
    (-7, 1, "assistant", "y" * 70_000 + "."), (903, 0, "User", "capital."), (903, 1, "assistant", "fine.\n "),
]


def by_text(value):
    return (value is not None, value or "")


def key_of(text):
    return (text is not None, hashlib.md5((text or "").encode()).digest())


# --- repair ---------------------------------------------------------------------------


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fate = zlib.crc32(name.encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = None if text is None else re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def cheapest(rows):
    """(cost, audit, final texts) by trying every edit from the left, keeping the best for each last role."""
    states = {"": (0, "", ())}

    def add(into, state, cost, audit, turns):
        if state not in into or (cost, audit) < into[state][:2]:
            into[state] = (cost, audit, turns)

    def inserted(states):
        for _ in range(3):
            for state, (cost, audit, turns) in list(states.items()):
                role = "assistant" if state == "u" else "user"
                add(states, role[0], cost + 5, audit + "I", (*turns, (role, "")))
        return states

    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, turns) in inserted(states).items():
            add(after, state, cost + 2, audit + "D", turns)
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault == "truncated" else 0
            allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
            first = (role or "x")[:1]
            if first and first in allowed:
                add(after, first, cost + extra, audit + "K", (*turns, (role, text)))
            new = "assistant" if state == "u" else "user"
            add(after, new[0], cost + 1 + extra, audit + "R", (*turns, (new, text)))
        states = after
    return min(inserted(states)[s] for s in ("", "a") if s in states)


def repaired(rows):
    held = defaultdict(list)
    for conv, turn, role, text in damage(rows):
        held[conv].append((turn, role, text))
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(held[conv], key=lambda r: ((r[0] is not None, r[0] or 0), by_text(r[1]), key_of(r[2])))
        seen, faults = set(), []
        for _, role, text in own:
            bare = (text or "").rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            faults.append(fault)
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        firsts = [r[:1] if r and r[0] in "sua" else "x" for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False))
        cost, audit, final = cheapest([(r, t, f) for (_, r, t), f in zip(own, faults, strict=True)])
        counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in final)))
    return out


def test_repair_against_plain_python(spark):
    rows = made(range(60), 9, 3) + made(range(100, 103), 120, 4) + ODD
    docs = spark.createDataFrame([r + CLASH for r in rows], SCHEMA).repartition(5)
    want = repaired(rows)
    found = repair.digest(docs).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == want and len(found) == len(want)
    assert repair.digest(docs.limit(0)).count() == 0


def test_repair_of_a_conversation_over_many_partitions(spark):
    rows = made([1], 400, 5) + made(range(2, 9), 5, 6)
    turns = repair.flagged(repair.chosen_turns(spark.createDataFrame([r + CLASH for r in rows], SCHEMA)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r["conv"]: (r["cost"], r["audit"]) for r in repair.parse_conversations(turns).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    codes = defaultdict(str)
    for r in turns.orderBy("conv", *repair.ORDER).collect():
        codes[r["conv"]] += r["code"]
    assert found == {conv: repair.answer(repair.parse(c)) for conv, c in codes.items()}


def all_splits(codes):
    """The cell of a span from every split of it, as the textbook algorithm does."""
    cells = {(i, i + 1): repair.leaf(c) for i, c in enumerate(codes)}
    for length in range(2, len(codes) + 1):
        for i in range(len(codes) - length + 1):
            found = [repair.combined(cells[i, k], cells[k, i + length]) for k in range(i + 1, i + length)]
            best = found[0]
            for other in found[1:]:
                best = repair._lesser(best, other)
            cells[i, i + length] = best
    return cells[0, len(codes)]


def test_one_split_of_a_span_is_enough():
    draw = random.Random(9)
    for _ in range(60):
        codes = "".join(draw.choices("suaxSUAX0123uauaua", k=draw.randint(1, 22)))
        assert repair.parse(codes) == all_splits(codes)
    assert repair.answer(repair.parse("")) == (0, "")


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "late."), (1, 1, "user", "ask?"), (2, 0, "system", "be."), (2, 1, "user", "a."), (2, 2, "user", "b.")]
    out = repair.repair(spark.createDataFrame([r + CLASH for r in rows], SCHEMA)).turns.collect()
    assert [(r["conv"], r["role"], r["text"], r["edit"]) for r in sorted(out, key=lambda r: (r["conv"], r["place"]))] == [
        ("1", "user", "late.", "R"), ("1", "assistant", "ask?", "R"),
        ("2", "system", "be.", "K"), ("2", "user", "a.", "K"), ("2", "assistant", "b.", "R"),
    ]


# --- trie -----------------------------------------------------------------------------


def plain_trie(sequences):
    """Nodes of {conv: [(name, words)]}: (conv, depth, parent conv, members, children, leaves, saved, digest)."""
    members, ends, words = defaultdict(list), defaultdict(list), {(): 0}
    for conv, turns in sequences.items():
        path = tuple(t[0] for t in turns)
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
            words[path[:d]] = turns[d - 1][1] if d else 0
        ends[path].append(conv)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(own) - 1) * words[p]
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(",".join(map(str, sorted(ends[p])))))
        for p, m in members.items()
    )


def rebuilt(rows):
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = f"{len(role)}:{role}{text}"
            held[conv].append(((turn is not None, turn or 0, hashlib.md5(name.encode()).hexdigest()), name, len(re.findall(r"[^\x20\x09-\x0D]+", text))))
    for own in held.values():
        own.sort()
    out = {}
    for conv, own in held.items():
        base = conv - int(math.fmod(conv, 20))
        h = zlib.crc32(str(conv).encode()) % 4
        out[conv] = [t[1:] for t in held.get(base, [])[:h]] + [t[1:] for t in own[h:]]
    return out


def as_rows(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.mark.parametrize("turns", [1, 2, 256])
def test_trie_against_plain_python(spark, monkeypatch, turns):
    monkeypatch.setattr(trie, "SPLITTER_TURNS", turns)
    draw = random.Random(8)
    few = ["a b.", "c", "", None]
    rows = [(c, t, draw.choice(["user", None]), draw.choice(few)) for c in range(300) for t in range(draw.randint(1, 5))]
    # A third of all conversations are one sequence, and some are long ones with a common start.
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 1150) for t in range(4)]
    rows += [(c, t, "user", f"long {t if t < 90 else t * c}") for c in range(2000, 2008) for t in range(100)] + ODD
    docs = spark.createDataFrame([r + CLASH for r in rows], SCHEMA).repartition(5)
    assert as_rows(trie.digest(docs)) == plain_trie(rebuilt(rows))


def test_trie_of_little(spark):
    docs = spark.createDataFrame([r + CLASH for r in [(22, 0, "user", "a")]], SCHEMA)
    assert zlib.crc32(b"22") % 4 > 0
    # Its first turn is left out and there is no conversation 20 to take one from.
    assert as_rows(trie.digest(docs)) == [(22, 0, None, 1, 0, 1, 0, sha("22"))]
    assert trie.digest(docs.limit(0)).count() == 0


# --- fingerprints ---------------------------------------------------------------------

DOCUMENTS = "doc_id long, text string, fp string, block int, edge string, word string, copies int, n_chars int"


def weighted(a, b):
    a, b = Counter(re.findall(r"[^\x20\x09-\x0D]+", a)), Counter(re.findall(r"[^\x20\x09-\x0D]+", b))
    return sum((a & b).values()) / total if (total := sum((a | b).values())) else 1.0


def test_fingerprints(spark):
    draw = random.Random(2)
    vocabulary = ["".join(draw.choices("abcdefé", k=3)) for _ in range(400)]
    texts = {i: " ".join(draw.choices(vocabulary, weights=range(1, 401), k=draw.randint(1, 90))) for i in range(0, 120, 3)}
    texts |= {500: texts[3], 501: texts[3] + "\n", 502: None, 503: "", 504: " \t\n", 505: "x", 506: "word " * 30_000}
    rows = [*texts.items(), (500, texts[3]), (None, "last of all")]
    docs = spark.createDataFrame([(i, t, "clash", 7, "clash", "clash", 7, 7) for i, t in rows], DOCUMENTS).repartition(4)
    found = fingerprints.fingerprint_pairs(docs).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in rows)
    order = sorted(texts, reverse=True)
    following = dict(zip([*order, None], [*order[1:], None, order[0]], strict=True))
    known = {**texts, None: "last of all"}
    errors, print_of = [], {}
    for r in found:
        text, after = known[r["doc_id"]] or "", known[following[r["doc_id"]]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(edited))
        errors += [r["near_edited"] - weighted(text, edited), r["near_next"] - weighted(text, after)]
        assert len(r["fingerprint"]) == len(r["edited_fingerprint"]) == 8 * fingerprints.SAMPLES
        print_of[r["doc_id"]] = r["fingerprint"]
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.3
    assert print_of[500] == print_of[3] == print_of[501] and print_of[502] == print_of[503] == print_of[504] != print_of[505]
    assert fingerprints.fingerprint_pairs(docs.limit(0)).count() == 0
    one = fingerprints.fingerprint_pairs(docs.where("doc_id = 505")).first()
    assert (one["near_next"], one["near_edited"], one["edited_sha256"]) == (1.0, 1.0, sha("x"))


def test_samples_against_plain_python(spark):
    """The drawn value of every sample, from the same hashes, is that of the term with the least ln(a)."""
    weights = {"a": 1, "bb": 2, "ccc": 3, "dddd": 40}
    words = spark.createDataFrame([(1, 0, w) for w, n in weights.items() for _ in range(n)], "k int, which int, word string")
    numbers = spark.range(fingerprints.SAMPLES).select((F.col("id") / 8).cast("int").alias("part"), (F.col("id") % 8).cast("int").alias("i"))
    hashed = words.distinct().select("word", F.xxhash64("word").alias("term")).crossJoin(numbers)
    hashes = {(r["word"], 8 * r["part"] + r["i"]): r["h"] % 2**64 for r in hashed.withColumn("h", F.xxhash64("term", "part", "i")).collect()}
    gamma = spark.range(1).select(fingerprints.gamma_table(spark).values.alias("g")).first()["g"]
    want = []
    for sample in range(fingerprints.SAMPLES):
        best = []
        for word, n in weights.items():
            h = hashes[word, sample]
            r, c, b = gamma[h >> 52], gamma[(h >> 40) & 4095], (h & (1 << 40) - 1) / (1 << 40)
            t = math.floor(math.log(n) / r + b)
            best.append((math.log(c) - r * (t - b + 1), (h + t * 40503) & 0xFFFFFFFF))
        want.append(min(best)[1])
    got = fingerprints.signatures(words, ["k"], "which").first()["samples"]
    assert got == want
    # Quantiles of the distribution have its mean and variance, both 2.
    mean = sum(gamma) / len(gamma)
    assert abs(mean - 2) < 0.01 and abs(sum((x - mean) ** 2 for x in gamma) / len(gamma) - 2) < 0.05
