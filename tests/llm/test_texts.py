from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
import sentencepiece
from plain import key, leaked, odd_texts, rule_counts, sentence, table

from trialspark.llm import decontaminate, rules
from trialspark.llm.decontaminate import leaks, without_leaks
from trialspark.llm.language import UNKNOWN, identify, keep_identified
from trialspark.llm.pieces import MODEL, Encoder, Lattice, Stream, Vocabulary, decode_documents, encode_documents, encoder
from trialspark.llm.rules import quality
from trialspark.llm.token_counts import RANKS, Tokens, attribute, field_tokens, section_tokens

DATA = "/root/testdata/sf0.001"


def test_pieces_equal_the_library_and_come_back(spark):
    rows = odd_texts()
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = encode_documents(table(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, t)
    for r in got:
        text = texts[r.doc_id]
        assert r.ids == (None if text is None else model.encode(text))
        assert r.n_tokens == len(r.ids or []) and r.round_trip == (None if text is None else True)
    back = {r.doc_id: r.text for r in decode_documents(encode_documents(table(spark, rows))).collect()}
    assert back == texts


def test_pieces_of_random_text_equal_the_library():
    model, own, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), encoder(MODEL, "bpe"), random.Random(1)
    parts = ["a", "b", "th", "e", " ", "  ", "\n", "\t", "▁", "é", "漢", "🤔", "<0x0A>", "<s>", "the", "ing", "​", "\x00", "ñ", "1", "23", "aaaa", "zz"]
    for _ in range(800):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert own.encode(text).tolist() == model.encode(text), text
    for text in (" " * 3000, "a" * 9000, "ab" * 3000, "".join(rng.choice("abcdefghij") for _ in range(20000))):
        assert own.encode(text).tolist() == model.encode(text)


def test_round_trips_are_those_of_decoded_ids():
    own, rng = encoder(MODEL, "bpe"), random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "▁", "é", "漢", "🤔", "\x00", "ﬁ", "ñ", "１"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    got = own.round_trips(texts)
    assert [same for _, same in got] == [own.decode(ids) == t for (ids, _), t in zip(got, texts, strict=True)]
    assert {same for _, same in got} == {True, False}
    own.forget()
    assert [i.tolist() for i, _ in own.round_trips(texts)] == [i.tolist() for i, _ in got]


class _Pieces(Vocabulary):
    def __init__(self, pieces: dict[str, float], kind: str):
        self.kind, self.bytes, self.unknown = kind, {}, 0
        self.scores = [0.0, *pieces.values()]
        self.ids = {p: i + 1 for i, p in enumerate(pieces)}
        self.prepare()


def test_unigram_stream_finds_the_best_sum_and_forgets_what_is_final():
    rng = random.Random(4)
    pieces = {p: -rng.uniform(1, 9) for p in ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "bb", "aab", "bca"]}
    vocabulary = _Pieces(pieces, "unigram")

    def best(text):
        scores = [(0.0, [])]
        for j in range(1, len(text) + 1):
            scores.append(max((scores[i][0] + pieces.get(text[i:j], vocabulary.penalty if j == i + 1 else -1e18), [*scores[i][1], text[i:j]]) for i in range(max(0, j - 3), j)))
        return scores[-1][0]

    for _ in range(60):
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 300)))
        stream, out, most = Stream(vocabulary), [], 0
        for i in range(0, len(text), 7):
            out += stream.feed(text[i : i + 7])
            most = max(most, len(stream.pending))
        out += stream.feed("", end=True)
        names = [vocabulary.name(p) for p in out]
        assert "".join(names) == text
        total = sum(pieces.get(n, vocabulary.penalty) for n in names)
        assert abs(total - best(text)) < 1e-6
        in_order = Lattice(vocabulary)
        for start in sorted((text[:40], text[:45], text[3:30])):
            assert abs(sum(pieces.get(vocabulary.name(p), vocabulary.penalty) for p in in_order.pieces(start)) - best(start)) < 1e-6
        assert most < 80


def test_unknown_characters_without_byte_pieces_are_one_unknown():
    own = Encoder(_Pieces({"▁": -1.0, "a": -2.0, "▁a": -0.5}, "bpe"))
    assert own.encode("▁axy▁a").tolist() == [3, 0, 3]


def test_rules_match_brute_force_and_the_forest_separates(spark):
    rows = odd_texts()
    good = [(1000 + i, sentence(1000 + i, 80)) for i in range(60)]
    junk = [(2000 + i, " ".join(w + "###" for w in sentence(3000 + i, 80).split())) for i in range(8)]
    labels = spark.createDataFrame([(d, 1) for d, _ in good] + [(d, 0) for d, _ in junk[:4]] + [(None, 1), (1000, None), (5, 7)], "doc_id long, quality int")
    texts = {}
    for d, t in [*rows, *good, *junk]:
        texts.setdefault(d, t)
    got = quality(table(spark, [*rows, *good, *junk]), labels).collect()
    assert len(got) == len(rows) + len(good) + len(junk)
    for r in got:
        counts = rule_counts(texts[r.doc_id])
        assert tuple(r)[1:6] == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.kept and r.base_failed)
    kept = {r.doc_id for r in got if r.kept}
    assert all(d in kept for d, _ in good) and not any(d in kept for d, _ in junk)


def test_the_forest_is_fitted_on_every_labelled_row(spark, monkeypatch):
    monkeypatch.setattr(rules, "FIT_ROWS", 20, raising=False)
    good = [(i, sentence(i, 60 + i % 40) + " #" * (i % 9)) for i in range(400)]
    labels = spark.createDataFrame([(d, 1) for d, _ in good], "doc_id long, quality int")
    got = quality(table(spark, good), labels).collect()
    usable = [r for r in got if not r.base_failed]
    assert sum(r.kept for r in usable) >= (1 - rules.LOSS) * len(usable) - 1


def test_rules_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality(table(spark, [(1, sentence(1, 60)), (2, None)]), none).collect()
    assert {r.doc_id: r.kept for r in got} == {1: True, 2: False}
    assert quality(table(spark, []), none).count() == 0


def test_languages_are_told_apart_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = identify(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_of_odd_rows(spark):
    learn = [(i, "the cat and the dog with the house", "en") for i in range(8)] + [(20 + i, "der hund und die katze mit dem haus", "de") for i in range(8)]
    odd = [(100, None, "en"), (101, "", None), (102, "12 !! 34", "de"), (103, "die katze", None), (None, "the house", "en"), (104, "THE DOG " * 5000, None), (104, "THE DOG " * 5000, None)]
    got = {r.doc_id: r for r in identify(table(spark, learn + odd)).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == [UNKNOWN] * 3 and got[100].score == 0
    assert got[103].lang_pred == "de" and got[104].lang_pred == "en" and got[None].lang_pred == "en" and not got[None].held_out
    kept = keep_identified(table(spark, learn + odd), 0.1)
    assert kept.columns == table(spark, []).columns and kept.count() == len(learn) + 4
    assert identify(table(spark, [])).count() == 0
    assert {r.lang_pred for r in identify(table(spark, [(1, "abc", None)])).collect()} == {UNKNOWN}


def test_section_tokens_add_up_to_whole_text_tokens(spark):
    rows = odd_texts()
    tokens = Tokens(RANKS)
    got = section_tokens(table(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, t)
    for r in got:
        text = texts[r.doc_id] or ""
        assert r.n_tokens == sum(r.section_tokens) == len(tokens.ids(text))
        assert r.n_sections == len(r.section_tokens) == len(text.split("\n")) - text.endswith("\n") - (not text)


def test_tokens_across_boundaries_go_to_the_larger_part():
    chosen, crosses = attribute(np.array([0, 2, 6]), np.array([2, 6, 9]), np.array([0, 3, 6]), 9)
    assert chosen.tolist() == [0, 1, 2] and crosses.tolist() == [False, True, False]
    chosen, _ = attribute(np.array([0]), np.array([4]), np.array([0, 2]), 4)  # a tie goes to the earlier
    assert chosen.tolist() == [0]


def test_field_tokens(spark):
    rows = spark.createDataFrame([(1, "user", "Hello there"), (2, None, ""), (3, "a", None)], "doc_id long, role string, text string")
    got = {r.doc_id: r for r in field_tokens(rows, ["role", "text"]).collect()}
    assert got[1].section_tokens == [2, 2] and got[2].n_tokens == 1 and got[3].section_tokens == [2, 0]


@pytest.mark.parametrize("text", ["x" + " " * 50000 + "y\n\n" + " " * 3000, "漢字🤔" * 5, "a b" * 100, "  "])
def test_token_spans_cover_the_text(text):
    starts, ends = Tokens(RANKS).spans(text)
    assert starts[0] == 0 and ends[-1] == len(text) and (starts[1:] <= ends[:-1]).all()


@pytest.mark.parametrize("part", [1 << 24, 600])
def test_leaks_match_brute_force(spark, part, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_BYTES", part)
    items = {i: sentence(500 + i, 20 + 3 * i) for i in range(8)} | {90: "too short", 91: ""}
    rows = [(d, t) for d, t in odd_texts()]
    rows += [(300 + i, sentence(600 + i, 30) + " " + items[i].upper() + ", " + sentence(700 + i, 30)) for i in range(8)]
    rows += [(400, items[3] + " " + items[5]), (401, " ".join(items[2].split()[:12])), (402, items[4].replace("w1", "w1, ", 1))]
    benchmark = spark.createDataFrame([*items.items(), (92, None), (3, items[3])], "item_id long, text string")
    got = leaks(table(spark, rows), benchmark).collect()
    texts = {}
    for d, t in rows:
        texts.setdefault(d, t)
    assert len(got) == len(rows)
    for r in got:
        assert r.item_ids == leaked(texts[r.doc_id], items) and r.kept == (not r.item_ids) and r.n_items == len(r.item_ids)
    clean = without_leaks(table(spark, rows), benchmark)
    assert clean.columns == table(spark, []).columns
    assert sorted((r.doc_id for r in clean.collect()), key=lambda d: (d is None, d)) == sorted((r.doc_id for r in got if r.kept), key=lambda d: (d is None, d))


def test_leaks_with_answers_and_empty_tables(spark):
    question, answer = sentence(1, 30), "forty two"
    benchmark = spark.createDataFrame([(1, question, answer)], "item_id long, q string, a string")
    rows = table(spark, [(1, question), (2, f"{question} {answer}"), (3, answer), (4, None)])
    got = {r.doc_id: r.kept for r in leaks(rows, benchmark, question_column="q", answer_column="a").collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert leaks(rows, nothing).filter("NOT kept").count() == 0
    assert leaks(table(spark, []), nothing).count() == 0
    assert without_leaks(rows, nothing).count() == 4
