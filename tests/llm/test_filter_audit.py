from __future__ import annotations

import collections
import itertools
import re

import pytest
from plain import odd_texts, sentence, words

from trialspark.llm import filter_audit
from trialspark.llm.filter_audit import filter_interactions

SCHEMA = "doc_id long, text string, lang string, h long, part string, slice int, n int, mask int, quality int"
LABELS = "doc_id long, quality int, toxic int, part string"


def plain_rows(rows, labels):
    """The table of orders, document by document."""
    texts = collections.defaultdict(list)
    for d, t, _ in rows:
        if d is not None:
            texts[t or ""].append(d)
    good = {d for d, q, _, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x, _ in labels if x == 1 and d is not None}
    fails = []
    for d, t, lang in rows:
        t, w = t or "", words(t)
        fails.append((lang or "", d, {
            x for x, yes in {
                "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and min(texts[t]) < d,
            }.items() if yes
        }))
    out, orders = {}, ["".join(p) for p in itertools.permutations("ABCDE")]
    for part in {p for p, _, _ in fails}:
        sums = collections.Counter()
        for order in orders:
            left = [(d, f) for p, d, f in fails if p == part]
            gone: list = []
            for step, x in enumerate(order, 1):
                removed = [(d, f) for d, f in left if x in f]
                redundant = sum(x in f for _, f in gone)
                left, gone = [(d, f) for d, f in left if x not in f], gone + removed
                sums[x] += len(removed)
                out[part, order, step] = [len(left), len(removed), redundant, sum(f == {x} for p, _, f in fails if p == part), sum(d in good for d, _ in removed), sum(d in toxic for d, _ in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(sums[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5) for r in rows], SCHEMA).repartition(partitions)


def got(spark, rows, labels):
    found = filter_interactions(table(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}
    assert len(out) == len(found)
    return out


def cases():
    hot = sentence(1, 120)
    rows = [(d, t, ("en", None, "")[i % 3]) for i, (d, t) in enumerate(odd_texts())]
    rows += [(100 + i, hot, "de" if i % 2 else "en") for i in range(60)] + [(None, hot, "de"), (None, None, None), (90, hot, "fr"), (90, hot, "fr"), (90, hot, "de")]
    rows += [(300, "LOUD WORDS " * 60, "en"), (301, "many $ marks | " + sentence(2, 150), "en"), (302, "é" * 10 + "AB", "en"), (303, "é" * 8 + "AB", "en"), (304, "LOUD words " * 60, "en")]
    labels = [(d, int(d % 3 > 0), int(d % 5 == 0), "x") for d in (20, 21, 22, 90, 100, 101, 105, 110, 300, 301)] + [(101, None, 1, "x"), (110, 0, None, "y"), (None, 1, 1, "z"), (300, 1, 0, "w")]
    return rows, labels


@pytest.mark.parametrize("hot", [1024, 4])
def test_every_order_against_plain_counts(spark, hot, monkeypatch):
    monkeypatch.setattr(filter_audit, "HOT", hot)  # 4: the group of copies is dealt over slices
    rows, labels = cases()
    assert got(spark, rows, labels) == plain_rows(rows, labels)


def test_equal_hashes_of_different_texts_are_no_copies(spark, monkeypatch):
    real = filter_audit.F.xxhash64
    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *c: real(filter_audit.F.lit(1)) if c == ("text",) else real(*c))
    rows = [(1, "a", "en"), (2, "b", "en"), (3, "a", "en"), (0, "c", "en")]
    labels = [(3, 1, 1, "x")]
    assert got(spark, rows, labels) == plain_rows(rows, labels)


def test_no_documents_and_no_labels(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert filter_interactions(empty, spark.createDataFrame([], LABELS)).count() == 0
    rows = [(1, None, None)]
    assert got(spark, rows, []) == plain_rows(rows, [])
