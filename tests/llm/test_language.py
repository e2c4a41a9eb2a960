from __future__ import annotations

import base64
import random

import corpus_pipeline
from plain import table

from trialspark.llm import language

DATA = "/root/testdata/sf0.001"
FOREIGN = {
    9001: "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. Ahi quanto a dir qual era è cosa dura questa selva selvaggia e aspra e forte che nel pensier rinova la paura",
    9002: "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Herkesin yaşama, hürriyet ve kişi güvenliği hakkı vardır",
    9003: "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek ma prawo do życia i wolności",
}


def junk() -> dict[int, str]:
    r = random.Random(1)
    letters = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(120))
    return {9010: letters, 9011: base64.b64encode(r.randbytes(900)).decode()}


def test_other_languages_and_letter_junk_go(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    real = {r.doc_id: r.text for r in docs.collect()}
    other = FOREIGN | junk()
    short = [(9100, "the", None), (9101, "the and", None)]
    columns = ["doc_id", "text", "lang"]
    more = table(spark, [*((i, t, None) for i, t in other.items()), *short]).select(columns)
    got = {r.doc_id for r in corpus_pipeline.identified(spark, docs.select(columns).union(more), DATA).collect()}
    assert not got & set(other)
    assert {9100, 9101} <= got and {d for d, t in real.items() if any(c.isalpha() for c in t)} <= got


def test_rare_languages_are_learned_from_large_tables(spark, monkeypatch):
    monkeypatch.setattr(language, "FIT_ROWS", 20)
    rows = [(i, "the cat and the dog with the house", "en") for i in range(400)] + [(1000 + i, "der hund und die katze mit dem haus", "de") for i in range(2)]
    rows += [(2000, "die katze mit dem hund", None), (2001, "the house with the cat", None)]
    got = {r.doc_id: r.lang_pred for r in language.identify(table(spark, rows)).collect()}
    assert got[2000] == got[1000] == "de" and got[2001] == "en"
