"""Corpus operators against plain Python, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import os
import random
import sys
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from replyforge.llm import (  # noqa: E402
    exact_dedup,
    language,
    line_dedup,
    near_dedup,
    packing,
    pieces,
    private_data,
    quality,
    substring_dedup,
    suffix_dedup,
)
from replyforge.llm.common import scanned  # noqa: E402
from replyforge.llm.components import connected_components  # noqa: E402
from replyforge.llm.repeats import sliding_minimum  # noqa: E402
from replyforge.llm.words import mix  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp string, id string, n int, kept string"


def made():
    """Documents of few words with copies, near copies, shared passages; the last rows are the odd cases."""
    draw = random.Random(11)
    vocabulary = ["".join(draw.choices("abcdefghé", k=draw.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(draw.choices(vocabulary, k=n))
    passage = text(60)
    texts = [text(draw.randint(1, 120)) for _ in range(40)]
    for i in range(0, 20, 4):
        copy = texts[i].split()
        texts += [texts[i], " ".join(copy[: len(copy) // 2] + ["changed"] + copy[len(copy) // 2 + 1 :]), texts[i] + "\n" + passage + " " + text(9)]
    texts += [passage + "\n" + text(3), text(4) + " " + passage, passage + passage, "ab " * 400, text(9000)]
    lines = [text(8) for _ in range(9)]
    texts += ["\n".join(lines), "\n".join([text(5), *lines]), "\n".join(lines[:3] + lines)]
    rows = list(enumerate(texts, 1)) + [(900, None), (901, ""), (902, " \n\t"), (903, "x"), (None, texts[0]), (904, "y z"), (904, "y z")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if (i or 0) % 3 else None, "s", 1, "clash", "clash", 7, "clash") for i, t in made()]
    return spark.createDataFrame(rows, COLUMNS).repartition(5).cache()


def items():
    """The documents as brute force takes them: a missing id is the largest, equal rows are one."""
    return dict((10**9 if i is None else i, t) for i, t in made()).items()


def by_id(df, *columns):
    return {(10**9 if r["doc_id"] is None else r["doc_id"]): tuple(r[c] for c in columns) for r in df.collect()}


def count_ids(df):
    return Counter(r[0] for r in df.select("doc_id").collect())


def test_substrings(docs):
    out = substring_dedup.dedup_substrings(docs)
    assert by_id(out, "n_words", "n_removed", "kept") == brute.substring(items(), 20)
    assert count_ids(out) == Counter(i for i, _ in made())


@pytest.mark.parametrize("most", [3000, 1])
def test_suffixes(docs, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_CLASSES", most)
    out = suffix_dedup.dedup_suffixes(docs)
    assert {k: (*v[:3], bytes(v[3])) for k, v in by_id(out, "n_bytes", "n_removed", "n_spans", "kept").items()} == brute.suffix(items(), 200)


def test_equal_rows_do_not_remove_each_other(spark):
    """One document twice, beside another that shares an anchor with it but no window."""
    draw = random.Random(5)
    text = lambda n: "".join(draw.choices("abcdefghij ", k=n))
    shared = text(120)
    one, two = (text(300) + shared + text(300) for _ in range(2))
    rows = spark.createDataFrame([(1, one), (1, one), (2, two)], "doc_id long, text string")
    assert {(r["n_bytes"], r["n_removed"]) for r in suffix_dedup.dedup_suffixes(rows).collect()} == {(720, 0)}


def test_doubling():
    raw = [b"abcabcabcabc" * 5, b"xabcabcabcabcy" * 3]
    window = 30
    hit = suffix_dedup.double(raw, np.zeros(2, np.uint64), window)
    strings = [r[p : p + window] for r in raw for p in range(len(r))]
    often = Counter(s for s in strings if len(s) == window)
    assert hit.tolist() == [often[s] > 1 for s in strings]


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_anchors_ranked_in_pieces(monkeypatch, batch):
    """However large a batch is, no more bytes are ranked at once than the bound allows, or one anchor has."""
    draw = random.Random(3)
    stretches = [2] * 30 + [9] + [2] * 30
    rows = [(g, i, g, 0, 101, bytes(draw.choices(b"ab", k=101)) + b"c" * 29) for g, n in enumerate(stretches) for i in range(n)]
    frame = pd.DataFrame(rows, columns=["gram", "id", "fp", "low", "n", "bytes"])
    double, window = suffix_dedup.double, 30
    hit = iter(double(list(frame["bytes"]), frame["gram"].to_numpy().view(np.uint64), window))
    expected = {(g, i, p) for g, i, _, _, _, raw in rows for p in range(len(raw)) if next(hit)}
    ranked = []
    monkeypatch.setattr(suffix_dedup, "MOST_POSITIONS", 1000)
    monkeypatch.setattr(suffix_dedup, "double", lambda raw, *more: ranked.append(sum(map(len, raw))) or double(raw, *more))
    out = pd.concat(list(suffix_dedup._doubler(window)(frame[i : i + batch].reset_index(drop=True) for i in range(0, len(frame), batch))))
    assert expected and {(r.fp, r.id, r.low + k) for r in out.itertuples() for k in range(r.n)} == expected
    assert sum(ranked) == 130 * len(rows) and {r for r in ranked if r > 1000} == {9 * 130}


def test_sliding_minimum():
    values = np.random.default_rng(1).integers(0, 99, 50)
    for width in (1, 2, 3, 7, 8, 50):
        assert sliding_minimum(values, width).tolist() == [values[i : i + width].min() for i in range(51 - width)]


@pytest.mark.parametrize("paired", [32, 1])
def test_near(docs, monkeypatch, paired):
    monkeypatch.setattr(near_dedup, "MOST_PAIRED", paired)
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 2)
    out = near_dedup.near_groups(docs, near_dedup.Likeness(2, 80))
    want = brute.near(items(), 2, 80)
    assert by_id(out, "n_shingles", "component_id") == {i: (n, None if c == 10**9 else c) for i, (n, c) in want.items()}
    one = near_dedup.keep_one(docs, near_dedup.Likeness(2, 80))
    assert one.columns == docs.columns
    assert count_ids(one) == Counter(None if i == 10**9 else i for i, (_, c) in want.items() if i == c)


def test_block_comparison():
    import pandas as pd

    draw = random.Random(5)
    base = [draw.getrandbits(60) for _ in range(60)]
    sets = [sorted({*draw.sample(base, 56), *(draw.getrandbits(60) for _ in range(2))}) for _ in range(40)]
    frame = pd.DataFrame(
        {
            "low": 0, "high": 0, "block": 0, "nid": range(40), "component": range(40), "n": [len(x) for x in sets],
            "regs": [bytes(near_dedup.REGISTERS)] * 40, "shingles": [np.array(x) for x in sets],
        }
    )
    found = near_dedup._block_comparer(80)(frame)
    linked = lambda a, b: 100 * len({*a} & {*b}) >= 80 * len({*a} | {*b})
    assert all(linked(sets[a], sets[b]) for a, b in found.itertuples(index=False))
    reach = {i: {j for j in range(40) if linked(sets[i], sets[j])} for i in range(40)}
    todo, seen = [0], {0}
    while todo:
        fresh = reach[todo.pop()] - seen
        seen |= fresh
        todo += fresh
    assert len(found) >= len(seen) - 1


def test_registers_estimate():
    import pandas as pd  # noqa: F401

    shared = " ".join(f"w{i}" for i in range(900))
    texts = [shared + " " + " ".join(f"{side}{i}" for i in range(100)) for side in "ab"]
    s = near_dedup.Shingles([t.encode() for t in texts], 2)
    regs = near_dedup.registers(s)
    n = s.sizes.astype(float)
    true = len(set(s.values[: s.sizes[0]]) & set(s.values[s.sizes[0] :])) / len(set(s.values))
    assert abs(near_dedup.likely(n[:1], regs[:1], n[1:], regs[1:])[0] - true) < 0.1
    union = near_dedup.registers(near_dedup.Shingles([" ".join(texts).encode()], 1))
    single = near_dedup.registers(near_dedup.Shingles([t.encode() for t in texts], 1))
    # Mergeable: the registers of a union are the larger of both.
    assert (union[0] == np.maximum(single[0], single[1])).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 99), (99, 120)]
    out = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in out.collect()} == {**{i: 1 for i in range(1, 41)}, 99: 99, 100: 99, 120: 99}


def test_quality(docs):
    out = by_id(quality.judge(docs), *quality.BASE, "base_failed", "kept")
    for i, t in items():
        n, chars, symbols, dup, repeated = brute.base_counts(t)
        failed = n < 10 or 100 * repeated > 20 * n
        assert out[i][:6] == (n, chars, symbols, dup, repeated, failed)
        assert not (failed and out[i][6])


def test_quality_outliers(spark):
    draw = random.Random(2)
    usual = [(i, " ".join("abcdefgh"[: draw.randint(2, 8)] for _ in range(100)), "en", "s") for i in range(300)]
    odd = [(1000, " ".join(f"w{i}***%%%" for i in range(100)), "en", "s"), (1001, " ".join(f"LOUD{i}" for i in range(100)), "en", "s")]
    kept = quality.keep_good(spark.createDataFrame(usual + odd, "doc_id long, text string, lang string, source string"), min_group=50)
    assert {r["doc_id"] for r in kept.collect()} & {1000, 1001} == set()
    assert kept.count() >= 295


def test_short_junk_goes_and_tables_stay(spark):
    draw = random.Random(12)
    word = lambda: "".join(draw.choices("etaoinshrdlu", k=draw.choice([2, 3, 3, 4, 5, 6, 7, 9])))
    prose = lambda n: " ".join(word() + draw.choice(["", "", "", "", ",", "."]) for _ in range(n))
    usual = [prose(draw.randint(20, 300)) for _ in range(500)]
    tables = [" | ".join(prose(draw.randint(15, 300)).split()) for _ in range(25)]
    digits = [" ".join(str(draw.randint(10**3, 10**6)) for _ in range(n)) for n in (15, 25, 60, 150)]
    capitals = [prose(n).upper() for n in (15, 25, 60, 150)]
    glued = [" ".join(w + draw.choice(["###", "***", "$$$"]) for w in prose(n).split()) for n in (15, 25, 60, 150)]
    alone = [" ".join(draw.choice("#*$%&<>") for _ in range(n)) for n in (40, 150)]
    rows = [(i, t, "en", "s") for i, t in enumerate([*usual, *tables, *digits, *capitals, *glued, *alone])]
    found = by_id(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), "base_failed", "kept")
    passed = [[found[i][1] for i, t, *_ in rows if t in kind and not found[i][0]] for kind in (usual, tables, digits + capitals + glued + alone)]
    assert sum(passed[0]) / len(passed[0]) >= 0.99 and sum(passed[1]) / len(passed[1]) >= 0.9
    assert len(passed[2]) >= 12 and not any(passed[2])


def plain_mcd(x, rng, share=0.5):
    """The lowest log-determinant over many random starts, in numpy: mean and covariance of the nearest (n + 5) / 2."""
    h = min(len(x), int(np.ceil(share * len(x) + 2.5)))
    floors = np.diag([quality.FLOORS[f] ** 2 for f in quality.FEATURES])
    factor, best = quality._consistency(share), None
    for _ in range(60):
        own = x[rng.choice(len(x), 6, replace=False)]
        mean, cov, before = own.mean(0), np.cov(own.T, bias=True) + floors, np.inf
        while True:
            away = np.einsum("ij,ij->i", (x - mean) @ np.linalg.inv(cov), x - mean)
            near = x[np.argsort(away, kind="stable")[:h]]
            mean, cov = near.mean(0), np.cov(near.T, bias=True) * factor + floors
            det = np.linalg.slogdet(cov)[1]
            if det > before - 1e-6:
                break
            before = det
        if best is None or before < best[0]:
            best = (before, mean, cov)
    return best


def test_estimates_against_plain_mcd(spark):
    rng = np.random.default_rng(6)
    shape = rng.normal(size=(4, 4)) * 0.3
    x = np.vstack([rng.normal(size=(400, 4)) @ shape, 6 + rng.normal(size=(220, 4)) * 0.2])
    rows = [(["a\x01b", "a\x01", ""], False, *map(float, r)) for r in x] + [(["a\x01b", "a\x01", ""], True, 99.0, 99.0, 99.0, 99.0)]
    stats = spark.createDataFrame(rows, "keys array<string>, base_failed boolean, x1 double, x2 double, x3 double, x4 double")
    found = {r["key"]: r for r in quality.covariances(stats, min_group=50)[0].collect()}
    det, mean, cov = plain_mcd(x, rng)
    for r in found.values():
        low = np.array([[r[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        assert np.linalg.slogdet(low @ low.T)[1] <= det + 0.1
        assert np.abs(np.array([r["m_" + f] for f in quality.FEATURES]) - mean).max() < 0.05
        assert np.abs(low @ low.T - cov).max() < 0.1
    assert set(found) == {"a\x01b", "a\x01", ""}


def test_quality_with_two_fifths_junk(spark):
    draw = random.Random(7)
    usual = lambda: " ".join("abcdefgh"[: draw.randint(2, 8)] for _ in range(150))
    odd = lambda: " ".join(f"w{draw.randint(0, 999)}" + "".join(draw.choices("*%#$", k=3)) for _ in range(150))
    rows = [(i, usual(), "en", "clean") for i in range(300)]
    rows += [(1000 + i, odd() if i % 5 < 2 else usual(), "en", "mixed") for i in range(300)]
    # A source of another language, and junk that is copies of one text.
    copied = odd()
    rows += [(2000 + i, copied if i % 5 < 2 else usual(), "de", "copies") for i in range(300)]
    kept = quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), min_group=50)
    ids = {r["doc_id"] for r in kept.collect()}
    assert not [i for i in ids if i >= 1000 and i % 5 < 2]
    assert len(ids) >= 0.98 * (300 + 180 + 180)


def test_consistency_factor():
    draws = (np.random.default_rng(3).standard_normal((200_000, 4)) ** 2).sum(axis=1)
    nearest = np.sort(draws)[: int(len(draws) * 0.75)]
    assert math.isclose(4 / nearest.mean(), quality._consistency(0.75), rel_tol=0.02)


def test_private(spark, docs):
    texts = [
        "mail a.b@c.de, or x@y; 1.2.3.4.5.6.7.8 and 256.1.1.1", "call +1 (743) 555-3824 now", "4785380592391139 and 4785 3805 9239 1138",
        "a@b.c_x@d.e", "9" * 5000 + " 1" * 5000, "q" * 30000 + "@", None, "", "é+49 30 1234567é",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for i, (counts, sha, spans) in ((r["doc_id"], ([r["n_" + k] for k in private_data.KINDS], r["base_sha256"], r["spans"])) for r in private_data.digest(private_data.find(rows)).collect()):
        base = brute.personal(texts[i])
        joined = ",".join("%s:%d:%d" % s for s in base)
        assert counts == [sum(k == kind for k, _, _ in base) for kind in private_data.KINDS]
        assert sha == brute.sha(joined)
        assert spans == joined
    redacted = by_id(private_data.redact(rows), "text")
    assert redacted[1] == ("call <PHONE> now",) and redacted[6] == (None,)
    assert count_ids(private_data.redact(docs)) == Counter(i for i, _ in made())


def test_learned_contexts(spark):
    seeds = [(i, f"please phone: +1 (555) 010-{1000 + i} soon") for i in range(9)]
    unseen = [(100, "please phone: 555-0101 soon"), (101, "room: 555-0102 here"), (102, "phone: none")]
    out = by_id(private_data.digest(private_data.find(spark.createDataFrame(seeds + unseen, "doc_id long, text string"))), "spans")
    assert out[100] == ("phone:14:22",) and out[101] == ("",) and out[102] == ("",)


def test_labels_after_line_breaks_and_tabs(spark):
    names = ["Bob", "Ann", "Eve", "Max", "Zoe", "Kim", "Lea", "Tom", "Ida"]
    seeds = [(i, f"Hi {n}\nTel:{' ' if i % 2 else chr(9)}+1 (555) 010-{1000 + i}\nbye") for i, n in enumerate(names)]
    unseen = [(100, "Hi Una\nTel: 555-0101\nbye"), (101, "name\tTel:\t555-0102"), (102, "a\r\nTel:" + " " * 300 + "555-0103"), (103, "Hi\nRoom: 555-0104")]
    out = by_id(private_data.digest(private_data.find(spark.createDataFrame(seeds + unseen, "doc_id long, text string"))), "spans")
    assert [out[i][0] for i in range(100, 104)] == ["phone:12:20", "phone:10:18", "phone:307:315", ""]


def test_runs_split_around_base_matches(spark):
    seeds = [(i, f"please phone: +1 (555) 010-{1000 + i} soon") for i in range(9)]
    texts = [
        "please phone: 555-0101 soon", "please phone: 555 0102 soon", "mail: a@b.de 555-0101", "10.0.0.1 555-0101, x", "12 555-0101", "12 555 0102 x9 555-0101",
        "phone: 555-0103 4711 0815 4711", "555-0103", "10.0.0.1 555-0101, a@b.de 555 0102 +1 555 010 1000", "555-0109", "5 phone2: 555-0104 a1",
    ]
    rows = spark.createDataFrame(seeds + list(enumerate(texts, 100)), "doc_id long, text string")
    found = by_id(private_data.digest(private_data.find(rows)), "spans")
    text = dict(rows.collect())
    got = {i: [(k, text[i][int(a) : int(b)]) for k, a, b in (s.split(":") for s in found[i][0].split(",") if s)] for i in range(100, 111)}
    one, two = ("phone", "555-0101"), ("phone", "555 0102")
    assert got[100] == got[104] == [one] and got[101] == [two]
    assert got[102] == [("email", "a@b.de"), one] and got[103] == [("ip", "10.0.0.1"), one]
    assert got[105] == [two, one] and got[109] == []
    assert sorted(got[108]) == sorted([("email", "a@b.de"), ("ip", "10.0.0.1"), ("phone", "+1 555 010 1000"), one, two])
    assert got[106] == [("phone", "555-0103 4711 0815")] and got[110] == [("phone", "555-0104")]
    redacted = by_id(private_data.redact(rows), "text")
    assert redacted[102] == ("mail: <EMAIL> <PHONE>",) and redacted[104] == ("12 <PHONE>",)


def test_scores_settle(spark):
    def instances(left, seeds, unseen, other=0):
        rows = [(left, f"+1 555 {left} {i}", 3, None, True) for i in range(seeds)] + [(left, f"other {left} {i}", None, None, True) for i in range(other)]
        return rows + [(left, v, None, kind, main) for v in unseen for kind, main in ((None, True), (3, False))]

    numbers = lambda start, n: [f"555-{start + i}" for i in range(n)]
    rows = instances("a", 20, numbers(1000, 30)) + instances("b", 5, numbers(2000, 300)) + instances("c", 6, numbers(3000, 40), 3)
    # The context d is sure only through the values it shares with a.
    rows += instances("d", 6, numbers(1000, 9) + numbers(4000, 5), 2) + instances("e", 4, numbers(5000, 5))
    table = spark.createDataFrame(rows, "left string, value string, seed int, kind int, main boolean")
    learned = {r["value"]: r["kind"] for r in private_data.learned_values(table).collect()}
    assert learned == dict.fromkeys(numbers(1000, 30) + numbers(2000, 300) + numbers(4000, 5), 3)


def test_language(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang")
    out = language.identify(rows).join(rows.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) >= 0.9
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 !", "en"), (None, "word", "en"), (4, "", None)], "doc_id long, text string, lang string")
    got = by_id(language.identify(odd), "lang_pred")
    assert got[1] == got[2] == got[4] == ("und",) and got[10**9] == ("en",)


def test_language_against_plain_counts(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(900_001, "Ünïcode 12 ÅB", None), (900_002, "x", None), (900_003, "", None), (900_004, None, None), (900_005, "x", None)]
    source = rows.unionByName(spark.createDataFrame(odd, rows.schema))
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in source.collect()}
    texts = {r["doc_id"]: (r["text"], r["lang"]) for r in source.collect()}
    labelled = [tl for i, tl in texts.items() if not held[i] and None not in tl]

    def scramble(x):
        return int(mix(np.array([x], np.uint64))[0])

    asked = [t for i, (t, _) in texts.items() if t and (held[i] or i > 900_000)]
    want = brute.naive_bayes(labelled, asked, language.ORDERS, language.BUCKETS, language.SMOOTHING, scramble)
    out = {r["doc_id"]: r for r in language.identify(source).collect()}
    assert set(out) == set(texts) and all(out[i]["held_out"] == held[i] for i in texts)
    for i, (t, _) in texts.items():
        if t in want:
            assert out[i]["lang_pred"] == want[t][0] and math.isclose(out[i]["score"], want[t][1], rel_tol=1e-6)
        elif not t:
            assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0)


def test_packing(docs):
    tokenizer = packing.Encoder(packing.default_tokenizer()).tokenizer
    out = packing.pack(docs).collect()
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in made()}
    covered, sequences = Counter(), {}
    for r in out:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        covered[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert covered == {i: n * len(ids[i]) for i, n in Counter(i for i, _ in made()).items()}
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= packing.WINDOW


def test_least_squares():
    matrix = np.random.default_rng(4).random((12, 30))
    want = np.maximum(np.random.default_rng(5).standard_normal(30), 0)
    x = packing.non_negative_least_squares(matrix, matrix @ want)
    assert (x >= 0).all() and np.allclose(matrix @ x, matrix @ want)
    planned = packing.plan(np.array([0, 5, 3, 9, 2, 0, 4, 1, 7]))
    used = Counter(b for c, n in planned for b in c for _ in range(n))
    assert all(sum(c) == 8 for c, _ in planned) and all(used[b] <= n for b, n in enumerate([0, 5, 3, 9, 2, 0, 4, 1, 7]))


def test_pieces(docs):
    out = pieces.digest(pieces.decode(pieces.encode(docs))).collect()
    assert all(r["round_trip"] for r in out) and len(out) == len(made())
    table = pieces.PieceTable(pieces.default_model())
    score = {p: s for p, s in zip((table.pieces[i] for i in table.ids), table.scores, strict=True)}

    def best(word):
        reach = [0.0] + [-math.inf] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - 16), end):
                piece = score.get(word[start:end], table.unknown_score if end - start == 1 else -math.inf)
                reach[end] = max(reach[end], reach[start] + piece)
        return reach[-1]

    for word, ids in zip(ws := ["▁thing", "▁the", "nothingness", "▁▁a", "▁x" * 3], pieces.viterbi(table, ws), strict=True):
        assert "".join(table.pieces[i] for i in ids) == word
        assert math.isclose(sum(score[table.pieces[i]] for i in ids), best(word))


def test_pieces_of_whole_texts(spark):
    """Every text's ids against a plain search over its words, odd characters and long texts included."""
    table = pieces.PieceTable(pieces.default_model())
    score = dict(zip((table.pieces[i] for i in table.ids), table.scores.tolist(), strict=True))
    number = {p: i for i, p in enumerate(table.pieces)}
    source = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    source += [(900_001, "  two  blanks 漢字 \U0001f600\tx"), (900_002, ""), (900_003, None), (900_004, "z" * 3000), (900_005, "a\u0301 ﬁ")]
    docs = spark.createDataFrame(source, "doc_id long, text string").repartition(8)
    known = {}

    def ids(text):
        marked = pieces.BLANK + text.replace(" ", pieces.BLANK) if table.add_blank else text.replace(" ", pieces.BLANK)
        out = []
        for word in pieces.WORDS.findall(marked) if text else []:
            if word not in known:
                known[word] = [
                    i
                    for p in brute.best_pieces(word, score, table.longest, table.unknown_score)
                    for i in ([number[p]] if p in score else [number[f"<0x{b:02X}>"] for b in p.encode()])
                ]
            out += known[word]
        return out

    for r in pieces.encode(docs).collect():
        assert r["ids"] == (None if r["text"] is None else ids(r["text"]))


def removed_runs(rows):
    """{(id, text): (n_lines, n_runs, n_removed, kept)} by the rule, in plain Python."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None:
            out[i, t] = (0, 0, 0, None)
            continue
        lines = t.split("\n")
        number = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        again, now = [], set()
        for k in range(len(lines) - 1):
            pair = (lines[k], lines[k + 1])
            if "".join(pair).strip(" "):
                if pair in seen or pair in now:
                    again.append((k, (number[k] * line_dedup.MULTIPLIER + number[k + 1]) % line_dedup.MODULUS % line_dedup.DIVISOR != 0))
                now.add(pair)
        seen |= now
        runs = []
        for k, boundary in again:
            if runs and runs[-1][1] == k:
                runs[-1][1], runs[-1][2] = k + 1, runs[-1][2] or boundary
            else:
                runs.append([k, k + 1, boundary])
        gone = {k for first, last, boundary in runs if boundary for k in range(first, last + 1)}
        out[i, t] = (len(lines), sum(r[2] for r in runs), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_lines(spark):
    draw = random.Random(4)
    vocabulary = ["".join(draw.choices("abc", k=2)) for _ in range(400)] + ["", " "]
    shared = [draw.choices(vocabulary, k=draw.randint(2, 9)) for _ in range(12)]
    texts = []
    for _ in range(60):
        lines = draw.choices(vocabulary, k=draw.randint(1, 6))
        for _ in range(draw.randint(0, 2)):
            at = draw.randint(0, len(lines))
            lines[at:at] = draw.choice(shared)
        texts.append("\n".join(lines))
    long = "\n".join(f"line {k} {draw.random()}" for k in range(5000))
    rows = [*enumerate(texts), (500, texts[3]), (500, texts[3]), (501, None), (502, ""), (503, "\n\n"), (504, long), (505, long), (None, long), (506, "x\n" * 40)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "clash", "clash", 7, "clash") for i, t in rows], COLUMNS).repartition(5)
    want = removed_runs(rows)
    found = line_dedup.dedup_lines(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["n_lines"], r["n_runs"], r["n_removed_lines"], r["kept_text"]) == want[r["doc_id"], r["text"]]
    # A copy goes as a whole.
    assert want[505, long][2] == want[None, long][2] == 5000
    left = {(r["doc_id"], r["text"]) for r in line_dedup.remove_lines(docs).collect()}
    assert left == {(i, w[3]) for (i, t), w in want.items() if t is None or w[2] < w[0]}


def test_most_repeated_lines_go():
    """Of lines in runs of two or more that occur before, at least nine tenths go."""
    source = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR.replace('0.001', '0.01')}/documents.parquet'").fetchall()
    seen, due = set(), 0
    for _, t in sorted(source):
        lines = (t or "").split("\n")
        pairs = list(zip(lines, lines[1:], strict=False))
        own = [k for k, p in enumerate(pairs) if p in seen and "".join(p).strip(" ")]
        due += len({x for k in own for x in (k, k + 1)})
        seen.update(pairs)
    gone = sum(w[2] for w in removed_runs(source).values())
    assert due > 500 and gone / due >= 0.9


def test_exact(spark, docs):
    out = exact_dedup.exact_groups(docs)
    assert count_ids(out) == Counter(i for i, _ in made())
    groups = {}
    for r in out.collect():
        groups.setdefault(r["text_sha256"], []).append(r)
    assert all(len(g) == g[0]["group_size"] and sum(r["kept"] for r in g) == 1 for g in groups.values())
    tied = spark.createDataFrame([(3, "a b"), (2, "ab "), (1, "ab"), (4, None), (5, " ")], "doc_id long, text string")
    assert by_id(exact_dedup.exact_groups(tied), "keep_id", "group_size") == {1: (2, 3), 2: (2, 3), 3: (2, 3), 4: (5, 2), 5: (5, 2)}


def test_empty_tables(docs):
    none = docs.limit(0)
    made_of = [
        substring_dedup.dedup_substrings, suffix_dedup.dedup_suffixes, near_dedup.near_groups, quality.judge, private_data.find,
        language.identify, packing.pack, pieces.encode, line_dedup.dedup_lines, exact_dedup.exact_groups,
    ]
    assert [f(none).count() for f in made_of] == [0] * len(made_of)


def test_columns_of_any_name(spark):
    """Names that the operators use inside are no harm in the documents, and all rows come out of empty tables."""
    text = "one two three four five six seven eight nine ten eleven a@b.de"
    names = ["_id", "_fp", "_n", "_runs", "_new", "_spans", "_key_id", "_key_fp", "__id", "hash", "place", "pair"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names)
    rows = [(i, t, "en", "s", *["x"] * len(names)) for i, t in [(1, text), (2, text), (3, None), (4, "other words " * 30), (1, text)]]
    docs = spark.createDataFrame(rows, schema)
    for f in (line_dedup.remove_lines, private_data.redact, quality.keep_good, near_dedup.keep_one):
        out = f(docs)
        assert out.columns == docs.columns and 0 < out.count() <= 5
        assert {r[5] for r in out.collect()} == {"x"}
        assert f(docs.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(docs).collect()) == [1, 3, 4]
    assert [r["text"] for r in private_data.redact(docs).collect()].count(text.replace("a@b.de", "<EMAIL>")) == 3


def test_pipeline(spark):
    source = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    state, texts = source, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, state, SF_DIR)
        assert after.columns == source.columns and after.select("doc_id").distinct().count() == after.count() <= state.count()
        texts[name], state = after.count(), after
    failed = {r["doc_id"] for r in source.collect() if (c := brute.base_counts(r["text"]))[0] < 10 or 100 * c[4] > 20 * c[0]}
    ids = {r["doc_id"] for r in state.select("doc_id").collect()}
    assert not failed & ids
    assert all(not brute.personal(r["text"]) for r in state.collect())
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == ids
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_many_numbers_in_one_text(spark):
    """The work on a text grows with its matches, not with their square."""
    numbers = " ".join(str(1_000_000 + 37 * i) for i in range(100_000))
    mails = "\n".join(f"x{i}@mail.example and 10.0.{i % 250}.7" for i in range(2_000))
    docs = spark.createDataFrame([(1, numbers), (2, mails), (3, "tel: +49 30 1234567")], "doc_id long, text string")
    start = time.time()
    found = by_id(private_data.digest(private_data.find(docs)), "n_email", "n_ip", "n_phone")
    assert found == {1: (0, 0, 0), 2: (2000, 2000, 0), 3: (0, 0, 1)}
    left = {r["doc_id"]: r["text"] for r in private_data.redact(docs).collect()}
    assert left == {1: numbers, 2: "\n".join("<EMAIL> and <IP>" for _ in range(2_000)), 3: "tel: <PHONE>"}
    assert time.time() - start < 120


def test_scan_in_chunks(spark):
    values = [draw for draw in np.random.default_rng(1).integers(0, 50, 1000).tolist()]
    rows = spark.createDataFrame([(values[:n],) for n in (0, 1, 255, 256, 257, 1000)], "x array<int>")
    out = rows.select("x", scanned(F.col("x"), F.lit(0), lambda a, b: a + b).alias("sums"), scanned(F.col("x"), F.lit(0), lambda a, b: F.greatest(a, b)).alias("tops")).collect()
    for r in out:
        assert r["sums"] == [sum(r["x"][:i]) for i in range(len(r["x"]))]
        assert r["tops"] == [max(r["x"][:i], default=0) for i in range(len(r["x"]))]
