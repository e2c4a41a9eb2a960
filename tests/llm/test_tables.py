from __future__ import annotations

import collections
import zlib

import corpus_pipeline
import pytest
from check_oracles import compare, connect
from plain import leaked, near_components, odd_texts, sentence, suffix_rows, table

from trialspark.llm import oracles, queries, shards
from trialspark.llm.shards import shard_documents
from trialspark.llm.urls import url_verdicts

DATA = "/root/testdata/sf0.001"
PAGES = [
    (1, "http://a.net/x", '<link rel="canonical" href="http://b.com/de/1">'), (2, "http://b.com/de/1", None), (3, "http://c.net/", '<meta http-equiv="refresh" content="0; url=/y"/>'),
    (4, "http://c.net/y", "<link href='//a.net/x' rel=canonical>"), (5, None, "x"), (6, "nohost", "<link rel=canonical href=http://a.net/x>"),
    (7, "http://q.net", '<link rel=canonical href="http://z.org/">'), (8, "http://r.net", '<link rel=canonical href="http://q.net/"><link rel=canonical href="http://b.com/de/9">'),
    (9, "HTTP://Www.Example.ORG/es/a?b#c", ""), (10, "http://example.org/en/12", None), (10, "http://example.org/en/12", None), (11, "http://forexample.org/es/", None),
    (12, "http://x.com/fr/a", "<link rel='stylesheet' href='http://b.com/de/1'>"), (13, "http://y.com#/de/", None), (None, "://", None), (14, "", "<link rel=canonical"),
]


def test_verdicts_follow_rules_and_aliases(spark):
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, rule string, component string")
    got = url_verdicts(pages).collect()
    assert len(got) == len(PAGES)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by[1] == ("a.net", "/x", None, "block") and by[2] == ("b.com", "/de/1", "com/de/", "block")
    assert by[3][3] == by[4][3] == "block"  # aliases of a blocked page
    assert by[7] == ("q.net", "", None, "allow") and by[8][3] == "allow"  # an allowed alias goes first
    assert by[5] == by[6] == by[14] == ("", "", None, "allow") and by[None] == ("", "", None, "allow")
    assert by[9] == ("www.example.org", "/es/a", "example.org/es/", "block")
    assert by[10] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert by[11] == ("forexample.org", "/es/", "org/", "allow") and by[12][2:] == ("com/fr/", "allow") and by[13] == ("y.com", "", None, "allow")


def test_verdicts_of_no_pages_and_no_rules(spark):
    schema = "page_id long, url string, html string"
    assert url_verdicts(spark.createDataFrame([], schema)).count() == 0
    got = url_verdicts(spark.createDataFrame(PAGES, schema), rules=()).collect()
    assert {r.verdict for r in got} == {"allow"} and {r.rule for r in got} == {None}


@pytest.mark.parametrize("range_rows", [4_000_000, 3])
def test_shards_hold_near_equal_bytes(spark, range_rows, monkeypatch):
    monkeypatch.setattr(shards, "RANGE_ROWS", range_rows)
    hot = sentence(9, 40)
    rows = [*odd_texts(), *((1000 + i, hot) for i in range(300)), *((2000 + i, sentence(4000 + i, 20 + i % 60)) for i in range(600))]
    got = shard_documents(table(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, t)
    held, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(held) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r.size for r in got)
    total = sum(held.values())
    assert all(abs(b - total / 16) <= 2 * largest for b in held.values())


def test_shards_of_an_empty_table(spark):
    assert shard_documents(table(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_queries_match_sql(spark, name):
    assert compare(spark, connect(DATA), name, DATA) is None


def test_every_query_is_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10


def test_pipeline_stages_match_plain_versions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, DATA).cache()
        after = {r.doc_id: r for r in out.collect()}
        assert len(after) == out.count() and set(after) <= set(before)
        if name == "language_id":
            assert all(not any(c.isalpha() for c in before[d]) for d in set(before) - set(after))
        elif name == "minhash_near_dedup":
            assert set(after) == {c for _, c in near_components(before.items(), 5, 80).values()}
        elif name == "suffix_array_dedup":
            assert set(after) == set(before)
            for d, n_bytes, n_removed, spans, _ in suffix_rows(before.items(), 200):
                left = len((after[d].text or "").encode())
                assert 0 <= left - (n_bytes - n_removed) <= 8 * spans and after[d].n_chars == len(after[d].text)
        elif name == "decontamination":
            items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
            assert set(after) == {d for d, t in before.items() if not leaked(t, items)}
        else:
            assert set(after) == set(before) and all(r.round_trip for r in after.values())
            break
        assert out.columns == columns
        docs = out


def test_pipeline_of_odd_rows(spark):
    docs = table(spark, [r for r in odd_texts()] * 2)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
    got = [r.doc_id for r in docs.collect()]
    assert 20 in got and 21 not in got and 10 not in got and None in got and len(got) == len(set(got))
