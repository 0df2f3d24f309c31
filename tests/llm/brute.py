"""Plain Python versions of the corpus operators."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def substring(items, window):
    seen, out = set(), {}
    for i, t in sorted(items):
        ws = words(t)
        gone = [False] * len(ws)
        for p in range(len(ws) - window + 1):
            key = tuple(ws[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        out[i] = (len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone, strict=True) if not g))
    return out


def suffix(items, window):
    count, out = Counter(), {}
    raw = {i: (t or "").encode() for i, t in items}
    for b in raw.values():
        count.update(b[p : p + window] for p in range(len(b) - window + 1))
    for i, b in raw.items():
        gone = [False] * len(b)
        for p in range(len(b) - window + 1):
            if count[b[p : p + window]] > 1:
                gone[p : p + window] = [True] * window
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


def near(items, k, percent):
    sets = {}
    for i, t in items:
        ws = words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    places = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for g in sets[i] for j in places[g])
        for g in sets[i]:
            places[g].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def base_counts(text):
    ws = words(text)
    windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(ws), sum(map(len, ws)), symbols, len(lines) - len(set(lines)), len(covered)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    twice = lambda c: sum(divmod(2 * int(c), 10))
    return sum(twice(c) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def _valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and _luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def personal(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if _valid(k, m.group())]


def naive_bayes(labelled, texts, orders, buckets, smoothing, scramble):
    """{text: (language, score)} by counting every n-gram in plain Python. ``scramble`` mixes a 64-bit number."""
    letters = re.compile(r"[^\W\d_]+")

    def grams(text):
        for word in letters.findall(text.lower()):
            padded = f" {word} "
            for n in orders:
                for i in range(len(padded) - n + 1):
                    if n > 1 or padded[i] != " ":
                        code = 0
                        for c in padded[i : i + n]:
                            code = (code * 1_114_129 + ord(c)) % 2**64
                        yield scramble((code + n) % 2**64) % buckets

    counts, rows = defaultdict(Counter), Counter(lang for _, lang in labelled)
    for text, lang in labelled:
        counts[lang].update(grams(text))
    total = {lang: sum(counts[lang].values()) + smoothing * buckets for lang in rows}
    out = {}
    for text in texts:
        if not text or not letters.search(text.lower()):
            continue
        own = Counter(grams(text))
        scores = {
            lang: math.log(rows[lang] / len(labelled)) + sum(k * math.log((counts[lang][g] + smoothing) / total[lang]) for g, k in own.items())
            for lang in sorted(rows)
        }
        best = max(scores, key=lambda x: scores[x])
        out[text] = (best, 1 / sum(math.exp(s - scores[best]) for s in scores.values()))
    return out


def best_pieces(word, score, longest, unknown):
    """The pieces of one word with the highest sum of scores, character by character; of equal ones the longest last."""
    best, back = [0.0] + [-math.inf] * len(word), [0] * (len(word) + 1)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - longest), end):
            piece = word[start:end]
            gain = score.get(piece, unknown if end - start == 1 else -math.inf)
            if best[start] + gain > best[end]:
                best[end], back[end] = best[start] + gain, start
    out, end = [], len(word)
    while end:
        out.append(word[back[end] : end])
        end = back[end]
    return out[::-1]
