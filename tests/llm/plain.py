"""Plain versions of the operators, and a table of odd rows, for the tests."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, v int, s string, k long, row string, spans string, rep long, n int, score double"


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def table(spark, texts, partitions: int = 3):
    """Rows of (doc_id, text) or (doc_id, text, lang), with clashing extra columns."""
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or ""), 1, "x", 7, "row", None, 3, 4, 0.5) for r in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def sentence(seed: int, n: int) -> str:
    """``n`` words that other seeds do not have."""
    return " ".join(f"w{(seed * 7919 + i * 104729) % 1000003:x}" for i in range(n))


def odd_texts() -> list[tuple[int | None, str | None]]:
    base, shared = sentence(1, 120), sentence(2, 70)
    long = " ".join(sentence(100 + i, 50) for i in range(400))
    return [
        (10, None), (11, ""), (12, " \t\n "), (13, "one"), (14, "one two"), (15, "ONE two"),
        (20, base), (21, base), (22, base.replace("w1", "x1", 1)), (22, base.replace("w1", "x1", 1)), (None, base),
        (30, sentence(3, 60) + " " + shared + "\n" + sentence(4, 60)), (31, sentence(5, 40) + "\n" + shared + " " + sentence(6, 30)),
        (32, shared + " é漢🤔 " + shared), (40, long), (41, long + " end"), (42, "a" * 5000), (43, "the the the " * 100),
        (44, sentence(7, 60) + "\n" + sentence(7, 60)), (-5, sentence(8, 55)), (50, "é" * 150 + sentence(9, 5)), (51, "è" + "é" * 149 + "x"),
    ]


def near_components(rows, size: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component)."""
    sets: dict[int, list[set]] = {}
    for doc, text in rows:
        if doc is not None:
            w = words(lower(text or ""))
            sets.setdefault(doc, []).append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= percent * len(x | y):
                        p, q = sorted((find(a), find(b)))
                        root[q] = p
    return {d: (len(sets[d][0]), find(d)) for d in docs}


def _marked(length: int, starts, window: int) -> list[bool]:
    gone = [False] * length
    for i in starts:
        gone[i : i + window] = [True] * window
    return gone


def suffix_rows(rows, window: int):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = collections.Counter(t[i : i + window] for d, t in texts if d is not None for i in range(len(t) - window + 1))
    out = []
    for d, t in texts:
        gone = _marked(len(t), [] if d is None else [i for i in range(len(t) - window + 1) if count[t[i : i + window]] > 1], window)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def window_rows(rows, window: int):
    """(doc_id, n_words, n_removed, kept_sha256) for each row."""
    first: dict[tuple, int] = {}
    for d, t in rows:
        if d is not None:
            w = words(t)
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = _marked(len(w), [] if d is None else [i for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d], window)
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def rule_counts(text: str | None) -> tuple[int, ...]:
    text, w = text or "", words(text)
    count = collections.Counter(zip(w, w[1:], w[2:]))
    again, seen, dup = set(), set(), 0
    for i in range(len(w) - 2):
        if count[w[i], w[i + 1], w[i + 2]] > 1:
            again |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(map(text.count, "#*$%&|<>")), dup, len(again)


_ITEM_WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")


def item_shingles(text: str | None) -> set[tuple]:
    w = _ITEM_WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def leaked(text: str | None, items: dict[int, str]) -> list[int]:
    own = item_shingles(text)
    return [i for i, t in sorted(items.items()) if (s := item_shingles(t)) and 100 * len(s & own) >= 80 * len(s)]


def key(row):
    return tuple((x is not None, x) if not isinstance(x, list) else (True, x) for x in row)
