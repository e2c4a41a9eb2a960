from __future__ import annotations

from plain import sentence

from trialspark.llm import language


def test_least_scores_are_learned_from_every_labelled_row(spark, monkeypatch):
    monkeypatch.setattr(language, "SCORED_ROWS", 1, raising=False)
    rows = spark.createDataFrame([(i, sentence(i, 40), "aa") for i in range(60)], "doc_id long, text string, lang string")
    profiles = language.learn_profiles(rows)
    learned = language.least_scores(rows, profiles)
    known = language.Profiles(profiles)
    whole = [known.scores(r.text) for r in rows.collect()]
    sizes = {language.size_class(n) for _, n in whole}
    assert any(("aa", size) in learned for size in sizes)
    assert all(0 <= score <= 1 for score in learned.values())
