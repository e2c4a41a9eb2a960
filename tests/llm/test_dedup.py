from __future__ import annotations

import numpy as np
import pytest
from plain import key, near_components, odd_texts, sentence, suffix_rows, table, window_rows

from trialspark.llm import minhash, suffix
from trialspark.llm.doubling import doubling_dedup, lengths
from trialspark.llm.minhash import near_duplicates, spanning_links
from trialspark.llm.suffix import common_prefixes, suffix_array, suffix_dedup, without_repeats


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_texts()
    return rows, table(spark, rows).cache()


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(odd, words, percent):
    rows, docs = odd
    want = near_components(rows, words, percent)
    got = near_duplicates(docs, words, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
            assert r.kept == (r.component_id == r.doc_id)


def test_large_nodes_are_split_and_lose_no_link(spark, monkeypatch):
    # A dense group, a chain and strangers that share a passage, with nodes of four documents.
    monkeypatch.setattr(minhash, "NODE_DOCS", 4)
    monkeypatch.setattr(minhash, "MAX_DEPTH", 2)
    base = sentence(50, 100).split()
    rows = [(i, " ".join([*base[:i], "edit", *base[i + 1 :]])) for i in range(25)]
    rows += [(100 + i, " ".join(base[:40]) + " " + sentence(200 + i, 60)) for i in range(12)]
    chain = sentence(60, 400).split()
    rows += [(200 + i, " ".join(chain[i * 4 : i * 4 + 100])) for i in range(20)]
    want = near_components(rows, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table(spark, rows), 3, 85).collect()}
    assert got == want


def test_near_duplicates_of_an_empty_table(spark):
    assert near_duplicates(table(spark, [])).count() == 0


def test_spanning_links_connect_exactly_what_is_linked():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(40)] + [np.zeros(0, np.uint64)]
    root = list(range(len(sets)))

    def find(roots, x):
        while roots[x] != x:
            x = roots[x]
        return x

    got = list(range(len(sets)))
    for a, b in spanning_links(sets, 60):
        got[find(got, b)] = find(got, a)
    for a in range(len(sets)):
        for b in range(a):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            if x and y and 100 * len(x & y) >= 60 * len(x | y):
                root[find(root, a)] = find(root, b)
    same = lambda r: {frozenset(i for i in range(len(sets)) if find(r, i) == find(r, j)) for j in range(len(sets))}
    assert same(got) == same(root)


def test_suffix_arrays_and_prefixes_match_sorting():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n, depth = int(rng.integers(1, 300)), int(rng.integers(1, 60))
        data = rng.integers(97, 97 + int(rng.integers(1, 4)), n).astype(np.uint8)
        order, _ = suffix_array(data, depth)
        cut = [data.tobytes()[i : i + depth] for i in range(n)]
        assert [cut[i] for i in order] == sorted(cut)
        shared = common_prefixes(data, order, depth)
        for place in range(1, n):
            a, b = cut[order[place - 1]], cut[order[place]]
            assert shared[place] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("shard", [1 << 21, 1 << 11])
def test_suffix_dedup_matches_brute_force(odd, shard, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD_BYTES", shard)  # the small one spreads anchors over shards
    rows, docs = odd
    got = [tuple(r) for r in suffix_dedup(docs).collect()]
    assert sorted(got, key=key) == sorted(suffix_rows(rows, 200), key=key)


def test_suffix_dedup_of_periodic_texts_with_spread_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD_BYTES", 1 << 9)
    rows = [(i, ("abc" * (30 + i)) + sentence(i, 3)) for i in range(12)] + [(99, "zz")]
    got = [tuple(r) for r in suffix_dedup(table(spark, rows), 20).collect()]
    assert sorted(got, key=key) == sorted(suffix_rows(rows, 20), key=key)


def test_cut_texts_keep_rows_columns_and_whole_characters(odd):
    rows, docs = odd
    out = without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[10] is None and texts[11] == "" and texts[20] == "" and texts[13] == "one"
    assert "�" not in texts[50] and texts[51].startswith("è")


def test_suffix_dedup_of_an_empty_table(spark):
    assert suffix_dedup(table(spark, [])).count() == 0
    assert without_repeats(table(spark, [])).count() == 0


@pytest.mark.parametrize("window", [50, 25, 7])
def test_doubling_matches_brute_force(odd, window):
    rows, docs = odd
    got = [tuple(r) for r in doubling_dedup(docs, window).collect()]
    assert sorted(got, key=key) == sorted(window_rows(rows, window), key=key)


def test_doubling_lengths_and_an_empty_table(spark):
    assert lengths(50) == [12, 25, 50] and lengths(7) == [7]
    assert doubling_dedup(table(spark, [])).count() == 0
