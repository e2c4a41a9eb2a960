from __future__ import annotations

from trialspark.llm.urls import url_verdicts

PAGES = [
    (1, "http://a.net/view?id=1", '<link rel="canonical" href="http://b.com/de/1">'), (2, "http://a.net/view?id=2", None), (3, "http://a.net/view?utm_source=x&id=1&gclid=7#top", None),
    (4, "http://c.net/?p=1&q=2", None), (5, "http://b.com/de/1?x", '<meta http-equiv="refresh" content="0; url=http://c.net/?p=1&amp;q=2">'), (6, "http://c.net/?p=1", None),
    (7, "http://d.net/i.php?p=2", '<link rel=canonical href="?p=3">'), (8, "http://d.net/i.php?p=3", '<link rel=canonical href="http://b.com/de/9">'), (9, "http://d.net/i.php", None),
    (10, "http://e.net/in", '<link rel=canonical href="/login?next=http://b.com/de/1">'), (11, "http://e.net/login", None), (12, "http://f.net/?utm_campaign=z", '<link rel=canonical href="http://b.com/de/1?x">'), (13, "http://f.net", None),
]


def test_pages_that_differ_in_the_query_are_no_aliases(spark):
    got = {r.page_id: r for r in url_verdicts(spark.createDataFrame(PAGES, "page_id long, url string, html string")).collect()}
    assert {i for i, r in got.items() if r.verdict == "block"} == {1, 3, 4, 5, 7, 8, 12, 13}
    assert (got[1].host, got[1].path, got[1].rule) == ("a.net", "/view", None) and got[5].rule == "com/de/"
    assert got[1].component == got[3].component != got[2].component == "a.net/view?id=2"
    assert got[12].component == got[13].component == got[4].component == got[5].component
