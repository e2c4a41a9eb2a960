from __future__ import annotations

from plain import leaked, sentence, table

from trialspark.llm.decontaminate import leaks, without_leaks

UNSPACED = {
    1: "谁在公元前二百二十一年统一了中国并成为第一位皇帝？",
    2: "日本で一番高い山の名前は何ですか。そしてその高さは何メートルですか",
    3: "เมืองหลวงของประเทศไทยคือเมืองอะไร",
}


def test_items_in_scripts_without_blanks_are_found(spark):
    benchmark = spark.createDataFrame(list(UNSPACED.items()), "item_id long, text string")
    rows = [(i, f"今天的练习：{t} 答案在下面。") for i, t in UNSPACED.items()] + [(9, "这是一篇关于天气的普通文章，里面没有问题。"), (10, UNSPACED[1][:8])]
    got = {r.doc_id: r.item_ids for r in leaks(table(spark, rows), benchmark).collect()}
    assert got == {1: [1], 2: [2], 3: [3], 9: [], 10: []}
    assert {r.doc_id for r in without_leaks(table(spark, rows), benchmark).collect()} == {9, 10}


def test_short_items_are_found_as_a_whole(spark):
    answer = sentence(2, 12)
    benchmark = spark.createDataFrame([(1, "Who wrote Hamlet?", None), (2, "Name it", answer), (3, "", "x"), (4, "?!", None), (5, "Zanzibar", None)], "item_id long, q string, a string")
    rows = [
        (1, f"Quiz: who wrote Hamlet, asked {sentence(3, 300)}"), (2, f"name it. {answer}"), (3, "name it, please"), (4, answer), (5, "who wrote about Hamlet"),
        (6, "zanzibar"), (7, "name"), (8, "it"), (9, None),
    ]
    got = {r.doc_id: r.item_ids for r in leaks(table(spark, rows), benchmark, question_column="q", answer_column="a").collect()}
    assert got == {1: [1], 2: [2], 3: [], 4: [], 5: [], 6: [5], 7: [], 8: [], 9: []}


def test_split_items_match_brute_force(spark):
    words = sentence(1, 59).split()
    items = {1: " ".join(words), 2: sentence(2, 59), 3: sentence(3, 25)}
    rows = [
        (10 * gap + lead, " ".join([sentence(50 + lead, lead), *words[:30], sentence(900 + gap, gap), *words[30:], sentence(70, 40)]))
        for gap in (0, 70, 100, 400)
        for lead in (5, 33)
    ]
    rows += [(9000, " ".join([sentence(80, 200), *words[:20], sentence(81, 150), *words[25:40], sentence(82, 150), *words[45:]]))]
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = leaks(table(spark, rows), benchmark).collect()
    texts = dict(rows)
    assert {r.doc_id: r.item_ids for r in got} == {d: leaked(t, items) for d, t in texts.items()}
    assert sum(r.n_items for r in got) == 8 and all(r.best_score >= 1 for r in got if r.n_items)
