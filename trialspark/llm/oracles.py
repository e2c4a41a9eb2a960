"""The registered queries that SQL can express over whole tables, as SQL.

The others are compared with plain versions in ``tests/llm``.
"""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[]))"

_OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i+2], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, md5(array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND 2
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, r.component_id = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

_OP7 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, i + k AS p
  FROM (SELECT doc_id, i, unnest(range(0, 50)) AS k FROM windows JOIN firsts ON firsts.h = windows.h WHERE first < doc_id)
),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.p) AS t, count(*) AS n
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

# Links to absolute urls only; tests/llm covers relative ones.
_KEY = "CASE WHEN {h} <> '' THEN {h} || CASE WHEN {p} = '' THEN '/' ELSE {p} END END"
_HOST = _LOWER.format("coalesce(regexp_extract({u}, '^[^:]*(?::[^:]+)*?://([^/?#]*)', 1), '')")
_PATH = "coalesce(regexp_extract({u}, '^[^:]*(?::[^:]+)*?://[^/?#]*([^?#]*)', 1), '')"
_OP8 = f"""
WITH RECURSIVE u AS (SELECT page_id, html, {_HOST.format(u='url')} AS host, {_PATH.format(u='url')} AS path FROM pages),
k AS (SELECT *, {_KEY.format(h='host', p='path')} AS key FROM u),
found AS (
  SELECT key, unnest(regexp_extract_all(html, '(?i)<link[^>]*rel=.?canonical[^>]*href=["'']?([a-z]+://[^"''\\s>]+)', 1)
    || regexp_extract_all(html, '(?i)<meta[^>]*http-equiv=.?refresh[^>]*url=([a-z]+://[^"''\\s>;]+)', 1)) AS target FROM k WHERE key IS NOT NULL
),
links AS (SELECT key AS a, {_KEY.format(h=_HOST.format(u='target'), p=_PATH.format(u='target'))} AS b FROM found),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT key, key FROM k WHERE key IS NOT NULL UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
urls AS (SELECT DISTINCT b AS key, split_part(b, '/', 1) AS host, substr(b, strpos(b, '/')) AS path FROM reach),
rules(action, rule, name, prefix) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
  ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
own AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM k
  JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix) GROUP BY page_id
),
judged AS (
  SELECT key, arg_max(action, length(rule)) AS action FROM urls
  JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix) GROUP BY key
),
aliases AS (SELECT a, bool_or(action = 'allow') AS allowed, bool_or(action = 'block') AS blocked FROM reach JOIN judged ON judged.key = reach.b GROUP BY a)
SELECT k.page_id, k.host, k.path, own.rule,
  coalesce(own.action, CASE WHEN coalesce(blocked, false) AND NOT coalesce(allowed, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN own ON own.page_id = k.page_id LEFT JOIN aliases ON aliases.a = k.key
"""

_OP11 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS.format('t')} AS w FROM d),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT w.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 10 * length(w.t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN firsts.first < w.doc_id THEN 16 ELSE 0 END AS mask
  FROM w JOIN firsts ON firsts.t = w.t LEFT JOIN l ON l.doc_id = w.doc_id
),
c AS (SELECT part, good, toxic, mask, count(*) AS n FROM f GROUP BY ALL),
letters(x, own) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders(filter_order, used) AS (SELECT x, own FROM letters UNION ALL SELECT filter_order || x, used + own FROM orders, letters WHERE used & own = 0),
steps AS (
  SELECT filter_order, s.step, own, coalesce((SELECT sum(e.own) FROM letters e WHERE strpos(filter_order, e.x) < s.step), 0) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step) s, letters WHERE used = 31 AND letters.x = filter_order[s.step]
),
out AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (own | CAST(before AS INTEGER)) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & own > 0 AND mask & CAST(before AS INTEGER) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own > 0 AND mask & CAST(before AS INTEGER) > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own > 0 AND mask & CAST(before AS INTEGER) = 0 AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & own > 0 AND mask & CAST(before AS INTEGER) = 0 AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM c, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM out
"""

_OP12 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k)
),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT *, array_to_string(w[1:j], ' ') AS p1, array_to_string(w[j + 1:], ' ') AS p2 FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (
  SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, j, CAST((2000000::HUGEINT * a) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p1 JOIN f y ON y.lang = cuts.lang AND y.phrase = p2
),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_parts AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2)) GROUP BY ALL
),
apart AS (SELECT best.* FROM best LEFT JOIN inner_parts i ON i.lang = best.lang AND i.phrase = best.phrase WHERE longer IS NULL OR 100 * longer < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM apart)
SELECT ranked.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""


def _hashes(words: str) -> str:
    """The five-word shingle hashes of a list of words."""
    count = f"CASE WHEN len({words}) > 0 THEN greatest(len({words}) - 4, 1) ELSE 0 END"
    return f"list_transform(range(1, {count} + 1), lambda i: substr(md5(array_to_string({words}[i:i + 4], ' ')), 1, 15))"


def _sketch(hashes: str) -> str:
    """The retained hashes, or the smallest one."""
    low = f"list_filter({hashes}, lambda h: h < '2')"
    return f"list_sort(list_distinct(CASE WHEN len({low}) > 0 OR len({hashes}) = 0 THEN {low} ELSE [list_min({hashes})] END))"


def _share(common: str, of: str) -> str:
    return f"CASE WHEN len({of}) = 0 THEN 1.0::DOUBLE ELSE len({common})::DOUBLE / len({of})::DOUBLE END"


_OP13 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS after FROM d),
e AS (SELECT *, left(t, CAST(length(t) - length(t) // 2 AS BIGINT)) || left(after, CAST(length(t) // 2 AS BIGINT)) AS edited FROM n),
w AS MATERIALIZED (SELECT *, {_WORDS.format('t')} AS w1, {_WORDS.format('after')} AS w2, {_WORDS.format('edited')} AS w3 FROM e),
h AS MATERIALIZED (SELECT *, {_hashes('w1')} AS h1, {_hashes('w2')} AS h2, {_hashes('w3')} AS h3 FROM w),
s AS (SELECT *, {_sketch('h1')} AS own, {_sketch('h2')} AS next, {_sketch('h3')} AS changed FROM h)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(own, ' ') AS fingerprint, array_to_string(changed, ' ') AS edited_fingerprint,
  {_share('list_intersect(own, changed)', 'list_distinct(own || changed)')} AS near_edited, {_share('list_intersect(own, next)', 'list_distinct(own || next)')} AS near_next,
  {_share('list_intersect(own, next)', 'own')} AS in_next, {_share('list_intersect(own, next)', 'next')} AS next_in
FROM s
"""

ORACLES: dict[str, str] = {"op2_chosen_path": _OP2, "op7_doubling": _OP7, "op8_redirect_equivalence": _OP8, "op11_existential_join": _OP11, "op12_double_array": _OP12, "op13_scaled_sketch": _OP13}
