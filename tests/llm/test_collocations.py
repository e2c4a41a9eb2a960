from __future__ import annotations

import collections
import random
import re
from pathlib import Path

import numpy as np
import pytest
from plain import lower, odd_texts

from trialspark.llm import collocations as module
from trialspark.llm.collocations import Tokens, _packed, _unpacked, collocations, followed, frequent_phrases, phrase_trie, word_trie

SCHEMA = "doc_id long, text string, lang string, w string, n string, word string, phrase string, code string, part string"


def plain_rows(rows, least, top):
    count, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        scored = []
        cand = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * c >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in cand.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        scored.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(scored[:top], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "a", "b", "c") for r in rows], SCHEMA).repartition(3)


def some_rows():
    draw = random.Random(3)
    vocabulary = [*"abcdefgh", "New", "york", "é", "ünïcode", "x" * 40, "don't"]
    rows = [(i, " ".join(draw.choice(vocabulary) + draw.choice(["", "", "", ",", ".", "\n", "\t", " \x0c"]) for _ in range(draw.randrange(60)))  , draw.choice(["en", "de", None, ""])) for i in range(120)]
    rows += [(d, t, "fr") for d, t in odd_texts()] + [(900, "new york city hall " * 40, "en"), (900, "new york city hall " * 40, "en"), (None, "a b", None)]
    return rows


@pytest.mark.parametrize(("part_bytes", "part_phrases", "chunk", "positions"), [(1 << 21, 1 << 20, 1 << 21, 1 << 22), (20, 15, 300, 40)])
def test_against_plain_counts(spark, monkeypatch, part_bytes, part_phrases, chunk, positions):
    for name, value in {"PART_BYTES": part_bytes, "PART_PHRASES": part_phrases, "CHUNK": chunk, "POSITIONS": positions}.items():
        monkeypatch.setattr(module, name, value)
    rows = some_rows()
    if part_bytes < 100:  # many parts: each is a pass of its own
        rows = [r for r in rows if r[2] in ("en", None)][:60] + rows[-3:]
    least = 5 if part_bytes > 100 else 6
    got = collocations(table(spark, rows), least=least, top=50)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = sorted(tuple(r) for r in got.collect())
    assert found == plain_rows(rows, least, 50) and len(found) > 4


@pytest.mark.parametrize("held", [1, 1 << 26])
def test_a_pass_takes_many_parts_and_deletes_the_runs_before_it(spark, monkeypatch, held):
    for name, value in {"PART_BYTES": 20, "PART_PHRASES": 15, "HELD_BYTES": held}.items():
        monkeypatch.setattr(module, name, value)
    rows = [r for r in some_rows() if r[2] in ("en", None)][:60]
    folder, cut, alive = Path(spark.conf.get("spark.checkpoint.dir")), module.cut_lineage, []
    before = set(folder.glob("trialspark-*"))

    def watched(df, name):
        stored = cut(df, name)
        if name == "runs":
            alive.append(len(set(folder.glob("trialspark-runs-*")) - before))
        return stored

    monkeypatch.setattr(module, "cut_lineage", watched)
    got = collocations(table(spark, rows), least=6, top=50)
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.glob("trialspark-*")) - before}
    assert sorted(tuple(r) for r in got.collect()) == plain_rows(rows, 6, 50)
    assert max(alive) == 2 and not left & {"trialspark-runs", "trialspark-tries"}
    assert len(alive) == 3 if held > 1 else len(alive) > 3


def test_nothing_frequent_and_no_rows(spark):
    assert collocations(table(spark, [(1, "a b c", "en"), (2, None, None), (3, "", "en")])).count() == 0
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(table(spark, [(i, "one. two. " * 20, "en") for i in range(5)])).count() == 0  # words, no phrases


def test_phrase_trie_against_a_dict():
    draw = np.random.default_rng(1)
    codes = np.unique(np.concatenate([draw.integers(0, 400, 3000) * 5000 + draw.integers(1, 5000, 3000), 7 * 5000 + np.arange(1, 3000)]))
    parent, symbol, ids = codes // 5000 + 100, codes % 5000, np.arange(1, len(codes) + 1)
    trie, more = _unpacked(_packed(phrase_trie(100, parent, symbol, ids, 5000)))
    known = {(p, s): i for p, s, i in zip(parent.tolist(), symbol.tolist(), ids.tolist(), strict=True)}
    p, s = np.repeat(np.arange(90, 520), 50), draw.integers(0, 5000, 430 * 50)
    assert followed(trie, more, p, s).tolist() == [known.get(x, 0) for x in zip(p.tolist(), s.tolist(), strict=True)]
    assert (followed(trie, more, parent, symbol) == ids).all()
    assert len(trie.check) < 2 * len(trie.base)


def test_word_trie_accepts_its_words_only():
    words = [b"a", b"ab", b"abc", b"b", "é".encode(), b"x" * 300]
    array, more = _unpacked(_packed(word_trie(words, np.arange(1, 7))))

    def accepted(word):
        node = np.zeros(1, np.int64)
        for b in word:
            node = array.step(node, np.array([b]))
            if node[0] < 0:
                return 0
        return int(more["accept"][node[0]])

    assert [accepted(w) for w in words] == [1, 2, 3, 4, 5, 6]
    assert [accepted(w) for w in (b"c", b"abcd", b"x" * 299, b"\xc3", b"")] == [0] * 5


def test_words_with_equal_hashes_are_told_apart():
    text = np.frombuffer(b"one two one six", np.uint8)
    tokens = Tokens(text, np.array([0, 15]))
    assert tokens.counted(np.arange(4), np.ones(4, np.uint64)) == {b"one": 2, b"two": 1, b"six": 1}


def test_all_lengths_have_their_counts(spark):
    rows = [("en", "a b c d e. a b c d e")] * 20
    phrases, totals = frequent_phrases(spark.createDataFrame(rows, "lang string, text string"), least=30)
    got = {r.phrase: (r.size, r.f) for r in phrases.collect()}
    assert got == {" ".join("abcde"[i : i + k]): (k, 40) for k in range(1, 5) for i in range(6 - k)}
    assert [tuple(r) for r in totals.collect()] == [("en", 200)]
