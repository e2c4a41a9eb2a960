from __future__ import annotations

import hashlib

from plain import odd_texts, sentence, words
from pyspark.sql import functions as F

from trialspark.llm.fingerprints import fingerprints, merged, printed, sketch

SCHEMA = "doc_id long, text string, id long, named int, sketch string, head string, half int, range int, next string"


def hashes(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))] if w else []
    return {hashlib.md5(s.encode()).hexdigest()[:15] for s in shingles}


def plain_sketch(text):
    own = hashes(text)
    return {h for h in own if h < "2"} or set(sorted(own)[:1])


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def within(a, b):
    return len(a & b) / len(a) if a else 1.0


def plain_rows(rows):
    """doc_id -> the row, for distinct ids."""
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, changed, other = plain_sketch(t), plain_sketch(edited), plain_sketch(after)
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), " ".join(sorted(own)), " ".join(sorted(changed)), like(own, changed), like(own, other), within(own, other), within(other, own))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y", 3, 4, "z") for r in rows], SCHEMA).repartition(3)


def rows_of(df):
    return [(r.doc_id, (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.in_next, r.next_in)) for r in df.collect()]


def test_against_plain_rows(spark):
    seen, rows = set(), []
    for d, t in odd_texts():
        if d not in seen:
            seen.add(d)
            rows.append((d, t))
    rows += [(1000 + i, sentence(50 + i % 7, 3 + i)) for i in range(40)]
    got = rows_of(fingerprints(table(spark, rows)))
    assert len(got) == len(rows) and dict(got) == plain_rows(rows)


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "d e f g h i"), (None, "x"), (None, "x"), (None, None)]
    got = rows_of(fingerprints(table(spark, rows)))
    assert len(got) == len(rows)
    by = {}
    for d, row in got:
        by.setdefault((d, row[2]), set()).add(row)
    assert all(len(v) == 1 for v in by.values())  # equal rows for equal documents
    expected = plain_rows([(1, "a b c"), (2, "d e f g h i")])
    assert by[1, expected[1][2]] == {expected[1]}
    two_texts = rows_of(fingerprints(table(spark, [(5, "one two"), (5, "three"), (6, "four")])))
    assert {d for d, _ in two_texts} == {5, 6} and len({r[1] for _, r in two_texts}) == 3


def test_one_document_and_none(spark):
    rows = [(7, sentence(1, 300))]
    assert dict(rows_of(fingerprints(table(spark, rows)))) == plain_rows(rows)
    assert fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketches_merge_and_tell_containment(spark):
    small, large = sentence(3, 400), sentence(3, 400) + " " + sentence(4, 6000)
    row = spark.createDataFrame([(small, sentence(5, 700), large, "", "one word")], "a string, b string, c string, d string, e string")
    s = {c: sketch(F.col(c)) for c in "abcde"}
    got = row.select(printed(merged(s["a"], s["b"])).alias("ab"), printed(merged(s["a"], s["e"])).alias("ae"), printed(merged(s["d"], s["e"])).alias("de"), printed(s["c"]).alias("c"), printed(s["a"]).alias("a")).first()
    assert set(got.ab.split()) == {h for h in hashes(small) | hashes(sentence(5, 700)) if h < "2"}
    assert set(got.ae.split()) == {h for h in hashes(small) | hashes("one word") if h < "2"}
    assert got.de.split() == sorted(hashes("one word"))
    assert set(got.a.split()) <= set(got.c.split())
