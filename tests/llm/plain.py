"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return (text or "").translate(LOWER)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, texts, extra=False):
    """Documents from (id, text) pairs; `extra` adds columns with names used inside."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        names = ["id", "row", "row_", "runs_", "runs", "rank", "node", "point", "part", "words", "id_", "text_", "length", "level", "key"]
        df = df.withColumns({n: F.lit("x") for n in names})
    return df


def base_quality(text):
    text = text or ""
    words = BLANK_WORD.findall(text)
    lines = [x for x in text.split("\n") if BLANK_WORD.search(x)]
    windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    inside = set()
    for k in range(len(words) - 7):
        if windows[tuple(words[k : k + 8])] > 1:
            inside.update(range(k, k + 8))
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(inside),
        n < 20 or 100 * len(inside) > 30 * n,
    )


def shingles(text, length):
    words = BLANK_WORD.findall(lower(text))
    if len(words) < length:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + length]) for i in range(len(words) - length + 1)}


def groups(texts, length, num, den=100):
    """id -> (set size, least id reachable by links)."""
    sets = {i: shingles(t, length) for i, t in texts}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations([i for i in sets if sets[i]], 2):
        common = len(sets[a] & sets[b])
        if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def passages(texts, items, span=10):
    """id -> (n_words, n_hit, sorted item ids as strings)."""
    windows = collections.defaultdict(set)
    for item, text in items:
        words = ALNUM_WORD.findall(lower(text))
        size = min(span, len(words))
        for i in range(len(words) - size + 1) if size else ():
            windows[tuple(words[i : i + size])].add(str(item))
    found = {}
    sizes = {len(w) for w in windows}
    for i, text in texts:
        words, hit, names = ALNUM_WORD.findall(lower(text)), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if (w := tuple(words[k : k + size])) in windows:
                    hit.update(range(k, k + size))
                    names |= windows[w]
        found[i] = (len(words), len(hit), sorted(names))
    return found


def without_copies(texts, min_words):
    """id -> (deleted lines, text)."""
    order = sorted(texts, key=lambda d: (d[0] is not None, d[0] or 0))
    docs = [(i, None if t is None else t.split("\n")) for i, t in order]
    first, seeds = {}, []
    for a, (_, lines) in enumerate(docs):
        count = [len(BLANK_WORD.findall(x)) for x in lines or ()]
        for p in range(len(count)):
            n, e = 0, p
            while e < len(count) and n < min_words:
                n, e = n + count[e], e + 1
            if n >= min_words:
                run = tuple(lines[p:e])
                if run in first:
                    seeds.append((a, p, e - p, *first[run]))
                else:
                    first[run] = (a, p)
    gone = collections.defaultdict(set)
    for a, p, n, b, q in seeds:
        x, y = docs[a][1], docs[b][1]
        while p + n < len(x) and q + n < len(y) and x[p + n] == y[q + n]:
            n += 1
        gone[a].update(range(p, p + n))
    return [
        (i, len(gone[a]), None if lines is None else "\n".join(x for k, x in enumerate(lines) if k not in gone[a]))
        for a, (i, lines) in enumerate(docs)
    ]
