"""The registered queries once more, as plain SQL over the same tables.

Written from the definitions and not from the Spark plans: the study table is
rebuilt here as common table expressions, and each query has its own SELECT.
"""

from __future__ import annotations

from trialspark import fixed_values as fixed

CURRENT_YEAR = 2000


def _words(words: tuple[str, ...]) -> str:
    return "|".join(words)


_DOSE = (
    r"\b\d+(?:[.,]\d+)?\s*(?:mg|mcg|ug|g|kg|ml|l|iu|units?|u|%|mmol|nmol|mm|nm|meq|mg/ml|mg/kg|mg/m2)\b"
)


def _drug_key(name: str) -> str:
    plain = f"trim(regexp_replace(regexp_replace(lower({name}), '{_DOSE}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    return f"regexp_replace({plain}, '(?: (?:{_words(fixed.DRUG_TRAILING_WORDS)}))+$', '')"


def _sponsor_key(name: str) -> str:
    plain = f"trim(regexp_replace(lower({name}), '[^a-z0-9]+', ' ', 'g'))"
    key = f"regexp_replace({plain}, '(?: (?:{_words(fixed.SPONSOR_TRAILING_WORDS)}))+$', '')"
    return f"CASE WHEN {key} = 'msd' THEN 'merck sharp dohme' ELSE {key} END"


def _slug(key: str) -> str:
    return f"trim(regexp_replace({key}, '[^a-z0-9]+', '-', 'g'), '-')"


def _cases(column: str, table: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {whens} ELSE {default} END"


def _title(column: str) -> str:
    """UPPER_SNAKE to Title Case, for up to three words."""
    parts = []
    for i in (1, 2, 3, 4):
        word = f"split_part({column}, '_', {i})"
        parts.append(f"CASE WHEN {word} <> '' THEN upper({word}[1:1]) || lower({word}[2:]) END")
    return f"concat_ws(' ', {', '.join(parts)})"


_STUDIES = f"""
base AS (
  SELECT o_orderkey AS k,
    'NCT' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(8, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') AS nct_id,
    CASE WHEN o_orderkey % 13 = 0 THEN ''
         WHEN o_orderkey % 11 <> 0 THEN 'Study ' || o_orderkey || ' of ' || lower(c_mktsegment) END AS brief_title,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'OBSERVATIONAL' ELSE 'INTERVENTIONAL' END AS study_type,
    CASE WHEN o_orderkey % 29 = 0 THEN NULL
         WHEN o_orderkey % 31 = 0 THEN 'UNKNOWN'
         WHEN o_orderkey % 37 = 0 THEN 'APPROVED_FOR_MARKETING'
         WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'ACTIVE_NOT_RECRUITING'
         WHEN o_orderstatus = 'P' THEN 'RECRUITING'
         WHEN o_orderstatus = 'F' THEN 'COMPLETED'
         ELSE 'NOT_YET_RECRUITING' END AS overall_status,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'INDUSTRY' WHEN 'BUILDING' THEN 'OTHER'
         WHEN 'AUTOMOBILE' THEN 'NIH' WHEN 'HOUSEHOLD' THEN 'OTHER_GOV' END AS sponsor_class,
    CASE WHEN c_custkey % 41 = 0 THEN NULL
         WHEN c_custkey % 97 = 0 THEN 'MSD'
         WHEN c_custkey % 89 = 0 THEN 'Merck Sharp & Dohme'
         ELSE upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) || ' ' || ((c_custkey // 4) % 10)
              || CASE c_custkey % 4 WHEN 0 THEN ' Inc.' WHEN 1 THEN ', LLC' WHEN 2 THEN ' Pharma' ELSE '' END
         END AS sponsor_name,
    CASE WHEN o_orderkey % 47 = 0 THEN NULL
         WHEN o_orderkey % 53 = 0 THEN 'TBD'
         WHEN o_orderkey % 59 = 0 THEN strftime(o_orderdate, '%Y') || '-13'
         WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
         WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m')
         ELSE strftime(o_orderdate, '%Y') END AS start_date,
    strftime(o_orderdate, '%Y-%m-%d') AS first_post_date
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
),
ship AS (
  SELECT l_orderkey AS k, min(l_shipdate) AS f, max(l_shipdate) AS m,
    bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'N') AS n, bool_or(l_returnflag = 'R') AS r
  FROM lineitem GROUP BY l_orderkey
),
t AS (
  SELECT base.*, s.k IS NOT NULL AS shipped,
    strftime(f, '%Y-%m') AS primary_completion_date,
    CASE WHEN base.k % 5 = 0 THEN strftime(m, '%Y') ELSE strftime(m, '%Y-%m-%d') END AS completion_date,
    strftime(m, '%Y-%m-%d') AS last_update_date,
    CASE WHEN s.k IS NULL THEN NULL WHEN base.k % 17 = 0 THEN 'NA'
         ELSE concat_ws('|', CASE WHEN r THEN 'PHASE3' END, CASE WHEN n THEN 'PHASE2' END,
                        CASE WHEN a THEN 'PHASE1' END, CASE WHEN base.k % 23 = 0 THEN 'EARLY_PHASE1' END)
         END AS phases,
    CASE WHEN s.k IS NULL THEN 'MISSING' WHEN base.k % 17 = 0 THEN 'NA'
         ELSE concat_ws('|', CASE WHEN base.k % 23 = 0 THEN 'EARLY_PHASE1' END, CASE WHEN a THEN 'PHASE1' END,
                        CASE WHEN n THEN 'PHASE2' END, CASE WHEN r THEN 'PHASE3' END)
         END AS phase_key
  FROM base LEFT JOIN ship s ON s.k = base.k
),
dated AS (
  SELECT *,
    CASE WHEN regexp_full_match(start_date, '[0-9]{{4}}(-(0[1-9]|1[0-2])(-[0-9]{{2}})?)?') THEN CAST(start_date[1:4] AS INT) END AS start_year,
    CASE WHEN regexp_full_match(start_date, '[0-9]{{4}}-(0[1-9]|1[0-2])(-[0-9]{{2}})?') THEN CAST(start_date[6:7] AS INT) END AS start_month,
    CAST(completion_date[1:4] AS INT) AS end_year,
    CASE WHEN length(completion_date) > 4 THEN CAST(completion_date[6:7] AS INT) END AS end_month
  FROM t
),
timed AS (
  SELECT *, CASE WHEN d >= 0 THEN d END AS months FROM (
    SELECT *, (end_year * 12 + coalesce(end_month, 1)) - (start_year * 12 + coalesce(start_month, 1)) AS d FROM dated)
),
loc AS (
  SELECT DISTINCT l_orderkey AS k,
    CASE n_nationkey WHEN 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'USA' ELSE 'United States' END
                     WHEN 1 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'U.K.' ELSE 'Great Britain' END
                     WHEN 2 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'Russian Federation' ELSE 'Russia' END
                     ELSE n_name END AS raw,
    CASE n_nationkey WHEN 0 THEN 'United States' WHEN 1 THEN 'United Kingdom' WHEN 2 THEN 'Russia' ELSE n_name END AS country
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  WHERE l_orderkey % 43 <> 0
),
seen AS (
  SELECT base.nct_id, base.k, base.brief_title, coalesce(c.country, 'UNKNOWN') AS value
  FROM base LEFT JOIN (SELECT DISTINCT k, country FROM loc) c ON c.k = base.k
),
iv AS (
  SELECT k, 'NCT' || lpad(CAST(k AS VARCHAR), CAST(greatest(8, length(CAST(k AS VARCHAR))) AS INTEGER), '0') AS nct_id, type, name, others,
    row_number() OVER (PARTITION BY k ORDER BY type, name, others) - 1 AS place
  FROM (
    SELECT DISTINCT l_orderkey AS k,
      CASE WHEN p_type <> 'PROMO' THEN 'DRUG' WHEN p_size % 3 = 0 THEN 'DEVICE'
           WHEN p_size % 3 = 1 THEN 'BIOLOGICAL' ELSE 'BEHAVIORAL' END AS type,
      CASE WHEN p_size % 25 = 24 THEN 'Placebo ' || p_name
           WHEN p_size % 10 = 9 THEN p_name || ' + cold rod'
           WHEN p_size % 4 = 1 THEN p_name || ' 10 mg'
           WHEN p_size % 4 = 2 THEN upper(p_name[1:1]) || split_part(p_name, ' ', 1)[2:] || ' '
                || upper(split_part(p_name, ' ', 2)[1:1]) || split_part(p_name, ' ', 2)[2:] || ' Hydrochloride Tablets'
           WHEN p_size % 4 = 3 THEN p_name || ', 25mg Oral'
           ELSE p_name END AS name,
      CASE WHEN p_size % 10 = 8 THEN ['hot ' || split_part(p_name, ' ', 2), 'cold ' || split_part(p_name, ' ', 2)]
           WHEN p_name LIKE 'red %' AND p_partkey % 5 = 0 THEN ['blue ' || split_part(p_name, ' ', 2)]
           WHEN p_name LIKE 'small %' AND p_partkey % 7 = 0 THEN ['red ' || split_part(p_name, ' ', 2), 'code-7']
           WHEN p_name LIKE 'new %' AND l_orderkey % 5003 = 77 THEN ['old ' || split_part(p_name, ' ', 2)]
           WHEN p_partkey % 3 = 0 THEN ['CODE-' || p_partkey]
           ELSE CAST([] AS VARCHAR[]) END AS others
    FROM lineitem JOIN part ON l_partkey = p_partkey)
),
cond AS (
  SELECT DISTINCT l_orderkey AS k, lower(p_type) || ' disorder' AS condition
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
kinds AS (
  SELECT base.nct_id, base.k, base.brief_title, coalesce(i.type, 'UNKNOWN') AS value
  FROM base LEFT JOIN (SELECT DISTINCT k, type FROM iv) i ON i.k = base.k
),
drugs AS (
  SELECT k, nct_id, place, name, others, {_drug_key('name')} AS key
  FROM iv WHERE type = 'DRUG' AND NOT contains(lower(name), 'placebo')
),
mains AS (SELECT DISTINCT key FROM drugs),
aliased AS (
  SELECT DISTINCT d.nct_id, d.name, d.others, d.key, {_drug_key('o.other')} AS alias
  FROM drugs d, unnest(d.others) AS o(other)
  WHERE NOT regexp_matches(d.name, '\\+|/')
),
attested AS (
  SELECT nct_id, key, min(alias) AS alias FROM (
    SELECT * FROM aliased WHERE alias <> key AND alias IN (SELECT key FROM mains))
  GROUP BY nct_id, name, others, key HAVING count(*) = 1
),
pairs AS (
  SELECT least(key, alias) AS a, greatest(key, alias) AS b
  FROM attested GROUP BY 1, 2 HAVING count(DISTINCT nct_id) >= 2
),
linked AS (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
reach(u, v) AS (
  SELECT key, key FROM mains UNION SELECT r.u, l.v FROM reach r JOIN linked l ON l.u = r.v
),
canon AS (SELECT u AS key, min(v) AS canon FROM reach GROUP BY u),
named AS (
  SELECT d.*, c.canon, 'drug:' || {_slug('c.canon')} AS id FROM drugs d JOIN canon c ON c.key = d.key
),
tallied AS (
  SELECT canon, name, count(*) AS n, min(nct_id || lpad(CAST(place AS VARCHAR), 6, '0')) AS first FROM named GROUP BY canon, name
),
drug_labels AS (
  SELECT canon, arg_min(name, lpad(CAST(1000000000 - n AS VARCHAR), 10, '0') || first) AS label FROM tallied GROUP BY canon
),
trial_drugs AS (
  SELECT nct_id, canon, id, arg_min(name, place) AS name FROM named GROUP BY nct_id, canon, id
),
sponsors AS (
  SELECT nct_id, brief_title, sponsor_name, {_sponsor_key('sponsor_name')} AS sponsor FROM base WHERE sponsor_name IS NOT NULL
),
sponsor_labels AS (
  SELECT sponsor, arg_min(sponsor_name, lpad(CAST(1000000000 - n AS VARCHAR), 10, '0') || first) AS label FROM (
    SELECT sponsor, sponsor_name, count(*) AS n, min(nct_id) AS first FROM sponsors GROUP BY 1, 2)
  GROUP BY sponsor
)
"""

ORACLES: dict[str, str] = {}


def oracle(name: str, select: str, *more: str) -> None:
    ctes = ",\n".join([_STUDIES, *more])
    ORACLES[name] = f"WITH RECURSIVE {ctes}\n{select}"


_PHASE_LABEL = """
CASE WHEN phase_key = 'MISSING' THEN 'Missing (not reported)'
     WHEN phase_key = 'NA' THEN 'NA (not applicable)'
     WHEN NOT contains(phase_key, '|') THEN replace(replace(phase_key, 'EARLY_PHASE', 'Early Phase '), 'PHASE', 'Phase ')
     WHEN contains(phase_key, 'EARLY') THEN replace(replace(replace(phase_key, 'EARLY_PHASE', 'Early Phase '), 'PHASE', 'Phase '), '|', '/')
     ELSE 'Phase ' || replace(replace(phase_key, 'PHASE', ''), '|', '/') END
"""

_STATUS = "coalesce(overall_status, 'UNKNOWN')"
_STATUS_LABEL = _cases("value", fixed.STATUS_LABELS, _title("value"))
_KIND_LABEL = _cases("value", fixed.INTERVENTION_TYPE_LABELS, "'Unknown'")
_SENTINEL = "CASE WHEN value IN ('UNKNOWN', 'NA', 'MISSING', 'Other') THEN 1 ELSE 0 END"
_RANKED = f"CAST(row_number() OVER (ORDER BY {_SENTINEL}, count_trials DESC, value) - 1 AS INT) AS position"

# --- sources -----------------------------------------------------------------------------

oracle(
    "study_records",
    """
    SELECT nct_id, brief_title, study_type, overall_status, start_date, primary_completion_date, completion_date,
      first_post_date, last_update_date, sponsor_name, sponsor_class, phases,
      (SELECT string_agg(type || ':' || name || '[' || array_to_string(others, '+') || ']', ';' ORDER BY place)
       FROM iv WHERE iv.k = t.k) AS interventions,
      CASE WHEN k % 43 = 0 THEN '' ELSE (SELECT string_agg(raw, ';' ORDER BY raw) FROM loc WHERE loc.k = t.k) END AS countries,
      (SELECT string_agg(condition, ';' ORDER BY condition) FROM cond WHERE cond.k = t.k) AS conditions
    FROM t
    """,
)
oracle(
    "nested_paths",
    """
    SELECT nct_id,
      (SELECT min(raw) FROM loc WHERE loc.k = t.k) AS first_country,
      (SELECT arg_min(name, place) FROM iv WHERE iv.k = t.k) AS first_intervention,
      coalesce((SELECT string_agg(raw, ';' ORDER BY raw) FROM loc WHERE loc.k = t.k), '-') AS all_countries,
      coalesce((SELECT string_agg(type, ';' ORDER BY place) FROM iv WHERE iv.k = t.k), '-') AS all_types,
      coalesce(overall_status, '-') AS all_statuses,
      CASE WHEN phases IS NOT NULL THEN len(string_split(phases, '|')) END AS phases
    FROM t
    """,
)
oracle("id_validity", "SELECT o_orderkey AS k, o_orderkey % 8 IN (0, 5, 7) AS valid FROM orders")
oracle("first_row_wins", "SELECT nct_id, overall_status FROM base")
oracle("stored_trials", "SELECT nct_id, overall_status, start_date, (SELECT count(DISTINCT nct_id) FROM base) AS trials FROM base")

# --- filters -------------------------------------------------------------------------------


def _matching(name: str, where: str) -> None:
    oracle(name, f"SELECT nct_id FROM dated WHERE {where}")


_HAS_DRUG = "k IN (SELECT k FROM iv, unnest(others) AS o(other) WHERE contains(lower(other), {0}) UNION SELECT k FROM iv WHERE contains(lower(name), {0}))"

_matching("filter_status", "overall_status = 'RECRUITING'")
_matching("filter_interventional", "study_type = 'INTERVENTIONAL'")
_matching("filter_study_type", "study_type = 'OBSERVATIONAL'")
_matching("filter_phase", "regexp_matches(phases, '(^|[|])(PHASE1|EARLY_PHASE1)([|]|$)')")
_matching("filter_sponsor_class", "sponsor_class = 'INDUSTRY'")
_matching("filter_intervention_type", "k IN (SELECT k FROM iv WHERE type = 'DEVICE')")
oracle(
    "filter_years_stored",
    """
    SELECT nct_id, 'closed' AS years FROM dated WHERE k % 50 > 2 AND start_year BETWEEN 1996 AND 1998
    UNION ALL SELECT nct_id, 'open' FROM dated WHERE k % 50 = 0 OR k % 50 > 2 AND start_year >= 1999
    """,
)
_matching("filter_years", "start_year BETWEEN 1996 AND 1998")
_matching("filter_since_year", "start_year >= 1999")
_matching(
    "filter_stacked",
    "overall_status = 'COMPLETED' AND study_type = 'INTERVENTIONAL' AND contains(phases, 'PHASE2') "
    "AND sponsor_class = 'NIH' AND k IN (SELECT k FROM iv WHERE type = 'DRUG') AND start_year <= 1999",
)
_matching("search_condition", "k IN (SELECT k FROM cond WHERE contains(condition, 'promo dis'))")
_matching("search_drug", _HAS_DRUG.format("'code-12'"))
_matching("search_sponsor", "contains(lower(sponsor_name), 'merck')")
_matching("search_country", "k IN (SELECT k FROM loc WHERE contains(lower(raw), 'russia'))")
_matching("search_term", _HAS_DRUG.format("'widget, 25mg'"))
_matching("search_operators_are_text", "false")
oracle(
    "search_indexed",
    f"""
    SELECT 'condition' AS search, nct_id FROM dated WHERE k IN (SELECT k FROM cond WHERE contains(condition, 'promo dis'))
    UNION ALL SELECT 'drug', nct_id FROM dated WHERE {_HAS_DRUG.format("'code-12'")}
    UNION ALL SELECT 'sponsor', nct_id FROM dated WHERE contains(lower(sponsor_name), 'merck')
    UNION ALL SELECT 'country', nct_id FROM dated WHERE k IN (SELECT k FROM loc WHERE contains(lower(raw), 'russia'))
    UNION ALL SELECT 'term', nct_id FROM dated WHERE {_HAS_DRUG.format("'widget, 25mg'")}
    UNION ALL SELECT 'short', nct_id FROM dated WHERE {_HAS_DRUG.format("'mg'")} OR contains(lower(brief_title), 'mg')
      OR contains(lower(sponsor_name), 'mg') OR k IN (SELECT k FROM cond WHERE contains(lower(condition), 'mg'))
    """,
)

# --- scalar functions ------------------------------------------------------------------------

oracle(
    "date_parts",
    f"""
    SELECT nct_id, start_year AS year, start_month AS month,
      CASE len(string_split(start_date, '-')) WHEN 1 THEN 'year' WHEN 2 THEN 'month' ELSE
        CASE WHEN start_date IS NOT NULL THEN 'day' END END AS precision,
      start_year > {CURRENT_YEAR} AS future
    FROM dated
    """,
)
oracle(
    "country_names",
    """
    SELECT raw, any_value(country) AS canonical,
      raw IN ('USA', 'U.K.', 'Great Britain', 'Russian Federation', 'Russia') AS aliased, count(DISTINCT k) AS trials
    FROM loc GROUP BY raw
    """,
)
oracle(
    "phase_text",
    """
    SELECT o_orderkey AS k, text, tokens, tokens IS NULL AS rejected
    FROM orders JOIN (VALUES
      (0, 'Phase 1/2', 'PHASE1|PHASE2'), (1, 'phase II', 'PHASE2'), (2, '1-2', 'PHASE1|PHASE2'),
      (3, '1 and 2', 'PHASE1|PHASE2'), (4, 'Early Phase 1', 'EARLY_PHASE1'), (5, 'Phase 0', 'EARLY_PHASE1'),
      (6, 'N/A', 'NA'), (7, 'not applicable', 'NA'), (8, 'PHASE3', 'PHASE3'), (9, 'early phase1', 'EARLY_PHASE1'),
      (10, 'IV', 'PHASE4'), (11, 'phase 5', NULL), (12, 'II/iii', 'PHASE2|PHASE3'), (13, 'Phase 2, Phase 2', 'PHASE2'),
      (14, 'unknown', NULL), (15, 'Phase-4.', 'PHASE4')) AS v(i, text, tokens)
    ON o_orderkey % 16 = i
    """,
)
oracle(
    "durations",
    """
    SELECT nct_id, months,
      CASE WHEN months < 6 THEN 0 WHEN months < 12 THEN 1 WHEN months < 24 THEN 2 WHEN months < 48 THEN 3
           WHEN months < 120 THEN 4 WHEN months >= 120 THEN 5 END AS bin
    FROM timed
    """,
)
oracle(
    "drug_names",
    f"""
    SELECT name, {_drug_key('name')} AS key, 'drug:' || {_slug(_drug_key('name'))} AS node,
      contains(lower(name), 'placebo') AS placebo, contains(name, '+') AS combination
    FROM (SELECT DISTINCT name FROM iv)
    """,
)
oracle(
    "sponsor_names",
    f"""
    SELECT sponsor_name, any_value(sponsor) AS key, 'sponsor:' || {_slug('any_value(sponsor)')} AS node, count(*) AS trials
    FROM sponsors GROUP BY sponsor_name
    """,
)
oracle(
    "excerpts",
    """
    SELECT nct_id, matched, CASE WHEN brief_title <> '' THEN brief_title ELSE matched END AS excerpt
    FROM (SELECT *, coalesce(split_part(phases, '|', 1), '') AS matched FROM t)
    """,
)

# --- counts ------------------------------------------------------------------------------------

oracle("trial_count", "SELECT count(*) AS count_trials FROM base")
_CARD = """
    SELECT CAST(n AS VARCHAR) AS value, format('{:,}', n) || ' trials' AS label, n AS count_trials, ids AS source_ids,
      n > 20 AS citations_truncated, 'Yes — ' || format('{:,}', n) || ' trials match this query.' AS answer
    FROM (SELECT count(*) AS n FROM base WHERE overall_status = 'RECRUITING'),
         (SELECT string_agg(nct_id, ',' ORDER BY nct_id) AS ids FROM (
            SELECT nct_id FROM base WHERE overall_status = 'RECRUITING' ORDER BY nct_id LIMIT 20))
"""
oracle("trial_card", _CARD)
oracle(
    "empty_card",
    "SELECT '0' AS value, '0 trials' AS label, CAST(0 AS BIGINT) AS count_trials, 0 AS cited, "
    "'No trials match this query.' AS answer",
)
oracle(
    "population_gates",
    """
    SELECT n AS of_total, CASE WHEN n = 0 THEN 'empty' ELSE 'ok' END AS status, gate
    FROM (SELECT gate, CASE gate WHEN 1 THEN 0 ELSE (SELECT count(*) FROM base) END AS n FROM (VALUES (0), (1)) AS g(gate))
    """,
)

_PHASE_BARS = f"""
    SELECT CAST(row_number() OVER (ORDER BY lead, composite, ranks, value) - 1 AS INT) AS position, value, label, count_trials,
      count_trials AS count_mentions
    FROM (
      SELECT phase_key AS value, {_PHASE_LABEL} AS label, count(*) AS count_trials,
        contains(phase_key, '|') AS composite,
        CASE WHEN phase_key = 'MISSING' THEN 0 WHEN phase_key = 'NA' THEN 1 WHEN phase_key LIKE 'EARLY%' THEN 2
             ELSE CAST(phase_key[6:6] AS INT) + 2 END AS lead,
        replace(replace(phase_key, 'EARLY_PHASE1', '2'), 'PHASE', '3') AS ranks
      FROM t GROUP BY phase_key)
"""
oracle("distribution_phase", _PHASE_BARS)

_COMBINE = """
    SELECT {ranked}, value, {label} AS label, count_trials, count_trials AS count_mentions
    FROM (SELECT {value} AS value, count(*) AS count_trials FROM base GROUP BY 1)
"""
oracle("distribution_status", _COMBINE.format(ranked=_RANKED, label=_STATUS_LABEL, value=_STATUS))
oracle(
    "distribution_sponsor_class",
    _COMBINE.format(ranked=_RANKED, label=_title("value"), value="coalesce(sponsor_class, 'UNKNOWN')"),
)
_EXPLODE = """
    SELECT {ranked}, value, {label} AS label, count_trials, count_trials AS count_mentions
    FROM (SELECT value, count(*) AS count_trials FROM {table} GROUP BY 1)
"""
oracle("distribution_intervention_type", _EXPLODE.format(ranked=_RANKED, label=_KIND_LABEL, table="kinds"))
_COUNTRY_LABEL = "CASE WHEN value = 'UNKNOWN' THEN 'Unknown' ELSE value END"
oracle("distribution_country", _EXPLODE.format(ranked=_RANKED, label=_COUNTRY_LABEL, table="seen"))


def _fold(n: int) -> tuple[str, str, str]:
    """CTEs of a country bar with the tail beyond n folded."""
    return (
        "tally AS (SELECT value, count(*) AS n FROM seen GROUP BY value)",
        f"kept AS (SELECT value FROM tally WHERE value <> 'UNKNOWN' ORDER BY n DESC, value LIMIT {n})",
        "folded AS (SELECT value, n FROM tally WHERE value <> 'UNKNOWN' AND value NOT IN (SELECT value FROM kept))",
    )


_FOLDED_BARS = f"""
    SELECT {_RANKED}, value, label, count_trials, count_mentions, derived, members FROM (
      SELECT value, {_COUNTRY_LABEL} AS label, n AS count_trials, n AS count_mentions, false AS derived, NULL AS members
      FROM tally WHERE value NOT IN (SELECT value FROM folded)
      UNION ALL
      SELECT 'Other', 'Other (' || count(*) || ' countries)',
        (SELECT count(DISTINCT nct_id) FROM seen WHERE value IN (SELECT value FROM folded)),
        CAST(sum(n) AS BIGINT), true, string_agg(value, ',' ORDER BY n DESC, value) FROM folded HAVING count(*) > 0)
"""
oracle("distribution_country_top10", _FOLDED_BARS, *_fold(10))
oracle("country_fold_members", "SELECT value, n AS count_trials, n AS count_mentions FROM folded", *_fold(10))
oracle(
    "distribution_country_repeats",
    f"""
    SELECT {_RANKED}, value, CASE WHEN value = 'Other' THEN 'Other (' || (SELECT count(*) FROM folded) || ' countries)'
      ELSE {_COUNTRY_LABEL} END AS label, count_trials, count_mentions
    FROM (
      SELECT CASE WHEN value IN (SELECT value FROM folded) THEN 'Other' ELSE value END AS value,
        count(DISTINCT id) AS count_trials, count(*) AS count_mentions
      FROM walk GROUP BY 1)
    """,
    "walk AS (SELECT nct_id AS id, value FROM seen UNION ALL "
    "SELECT CASE WHEN k % 28 <> 0 THEN nct_id END, value FROM seen WHERE k % 4 = 0)",
    *_fold(5),
)
oracle("distribution_status_repeats", _COMBINE.format(ranked=_RANKED, label=_STATUS_LABEL, value=_STATUS))
oracle(
    "distribution_custom_field",
    """
    SELECT value, CASE WHEN value = 'UNKNOWN' THEN 'Unknown' ELSE
        upper(value[1:1]) || split_part(value, ' ', 1)[2:] || ' Disorder' END AS label,
      count(*) AS count_trials, count(*) AS count_mentions
    FROM (SELECT coalesce(c.condition, 'UNKNOWN') AS value FROM base LEFT JOIN cond c ON c.k = base.k) GROUP BY value
    """,
)

_TOKENS = """
    SELECT value, {title} AS label, count(*) AS count_trials, count(*) AS count_mentions, false AS derived,
      count(*) > 10 AS citations_truncated,
      string_agg(nct_id, ',' ORDER BY nct_id) FILTER (WHERE place <= 20) AS source_ids
    FROM (SELECT nct_id, value, row_number() OVER (PARTITION BY value ORDER BY nct_id) AS place FROM ({rows}))
    GROUP BY value
"""
_RESIDUAL = """
    UNION ALL SELECT 'Missing', 'Missing (not reported)', count(*), count(*), true, false, ''
    FROM base WHERE {column} IS NULL HAVING count(*) > 0
"""
for _name, _column in (("status", "overall_status"), ("sponsor_class", "sponsor_class")):
    oracle(
        f"token_counts_{_name}",
        _TOKENS.format(
            title=_title("value"), rows=f"SELECT nct_id, {_column} AS value FROM base WHERE {_column} IS NOT NULL"
        )
        + _RESIDUAL.format(column=_column),
    )
oracle(
    "token_counts_intervention_type",
    _TOKENS.format(title=_title("value"), rows="SELECT DISTINCT nct_id, type AS value FROM iv"),
)
oracle(
    "count_bases",
    """
    SELECT n AS distinct_trials, sum_trials, sum_trials AS mentions, buckets, field
    FROM (SELECT count(*) AS n FROM base), (
      SELECT 'phase' AS field, count(*) AS sum_trials, count(DISTINCT phase_key) AS buckets FROM t
      UNION ALL SELECT 'overallStatus', count(*), count(DISTINCT coalesce(overall_status, 'UNKNOWN')) FROM base
      UNION ALL SELECT 'sponsorClass', count(*), count(DISTINCT coalesce(sponsor_class, 'UNKNOWN')) FROM base
      UNION ALL SELECT 'interventionType', count(*), count(DISTINCT value) FROM kinds
      UNION ALL SELECT 'country', count(*), count(DISTINCT value) FROM seen)
    """,
)
oracle("bars_basis", "SELECT count(*) AS trials, count(*) AS mentions FROM kinds")

# --- evidence -------------------------------------------------------------------------------------

# ``cited`` rows: value, nct_id, brief_title, matched, tokens.
_EVIDENCE = """
    SELECT value, max(n) AS contributing_count, max(n) > 20 AS citations_truncated,
      string_agg(nct_id, ',' ORDER BY nct_id) AS source_ids,
      string_agg(matched, ';' ORDER BY nct_id) AS matched,
      string_agg(tokens, ';' ORDER BY nct_id) AS tokens,
      string_agg(CASE WHEN brief_title <> '' THEN brief_title ELSE matched END, ';' ORDER BY nct_id) AS excerpts,
      true AS quotes_hold
    FROM (SELECT *, count(*) OVER (PARTITION BY value) AS n,
            row_number() OVER (PARTITION BY value ORDER BY nct_id) AS place FROM cited)
    WHERE place <= 20 GROUP BY value
"""
oracle(
    "evidence_phase",
    _EVIDENCE,
    """cited AS (SELECT phase_key AS value, nct_id, brief_title,
      CASE WHEN contains(phase_key, '|') THEN split_part(phase_key, '|', 1) ELSE coalesce(phases, '') END AS matched,
      CASE WHEN contains(phase_key, '|') THEN replace(phase_key, '|', '+') ELSE '-' END AS tokens FROM t)""",
)
oracle(
    "evidence_status",
    _EVIDENCE,
    f"cited AS (SELECT {_STATUS} AS value, nct_id, brief_title, coalesce(overall_status, '') AS matched, '-' AS tokens FROM base)",
)
oracle(
    "evidence_sponsor_class",
    _EVIDENCE,
    "cited AS (SELECT coalesce(sponsor_class, 'UNKNOWN') AS value, nct_id, brief_title, "
    "coalesce(sponsor_class, '') AS matched, '-' AS tokens FROM base)",
)
oracle(
    "evidence_intervention_type",
    _EVIDENCE,
    "cited AS (SELECT value, nct_id, brief_title, CASE WHEN value = 'UNKNOWN' THEN '' ELSE value END AS matched, "
    "'-' AS tokens FROM kinds)",
)
_FIRST_RAW = "coalesce((SELECT min(raw) FROM loc WHERE loc.k = seen.k AND loc.country = seen.value), '')"
oracle(
    "evidence_country",
    _EVIDENCE,
    f"cited AS (SELECT value, nct_id, brief_title, {_FIRST_RAW} AS matched, '-' AS tokens FROM seen)",
)
oracle(
    "evidence_country_top3",
    _EVIDENCE,
    *_fold(3),
    f"""cited AS (
      SELECT value, nct_id, brief_title, {_FIRST_RAW} AS matched, '-' AS tokens FROM seen
      WHERE value NOT IN (SELECT value FROM folded)
      UNION ALL
      SELECT 'Other', b.nct_id, b.brief_title, min(l.raw), '-' FROM loc l JOIN base b ON b.k = l.k
      WHERE l.country IN (SELECT value FROM folded) GROUP BY b.nct_id, b.brief_title)""",
)
oracle(
    "citation_index",
    """
    SELECT nct_id, arg_min(value, position) AS matched,
      arg_min(CASE WHEN brief_title <> '' THEN brief_title ELSE value END, position) AS excerpt
    FROM (
      SELECT nct_id, brief_title, CASE WHEN value = 'UNKNOWN' THEN '' ELSE value END AS value, position
      FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY nct_id) AS place FROM kinds)
      JOIN (SELECT value AS v, row_number() OVER (ORDER BY value = 'UNKNOWN', count(*) DESC, value) AS position
            FROM kinds GROUP BY value) ON v = value
      WHERE place <= 20)
    GROUP BY nct_id
    """,
)

# --- time series and histogram ----------------------------------------------------------------------


def _series(name: str, rows: str, where: str = "true") -> None:
    """``rows`` gives nct_id and year."""
    oracle(
        name,
        f"""
        SELECT coalesce(CAST(y AS VARCHAR), 'MISSING') AS value,
          CASE WHEN y IS NULL THEN 'Missing (no start date)' WHEN y > {CURRENT_YEAR} THEN y || ' (planned)'
               WHEN y = {CURRENT_YEAR} AND n > 0 THEN y || ' (partial)' ELSE CAST(y AS VARCHAR) END AS label,
          CAST(y AS VARCHAR) AS period, n AS count_trials, coalesce(y > {CURRENT_YEAR}, false) AS planned,
          coalesce(y = {CURRENT_YEAR} AND n > 0, false) AS partial_year, n > 20 AS citations_truncated,
          coalesce(ids, '') AS source_ids
        FROM (
          SELECT year AS y, count(*) AS n, string_agg(nct_id, ',' ORDER BY nct_id) FILTER (WHERE place <= 20) AS ids
          FROM placed GROUP BY year
          UNION ALL
          SELECT y, 0, NULL FROM (SELECT unnest(generate_series(
            (SELECT min(year) FROM placed WHERE year <= {CURRENT_YEAR}),
            (SELECT max(year) FROM placed WHERE year <= {CURRENT_YEAR}))) AS y)
          WHERE y NOT IN (SELECT year FROM placed WHERE year IS NOT NULL))
        """,
        f"""placed AS (SELECT nct_id, year, row_number() OVER (PARTITION BY year ORDER BY nct_id) AS place
            FROM ({rows}) WHERE {where})""",
    )


_series("series_start", "SELECT nct_id, start_year AS year FROM dated")
for _name, _column in (
    ("primary_completion", "primary_completion_date"), ("completion", "completion_date"),
    ("first_post", "first_post_date"), ("last_update", "last_update_date"),
):
    _series(f"series_{_name}", f"SELECT nct_id, CAST({_column}[1:4] AS INT) AS year FROM t")
_series("series_with_gap", "SELECT nct_id, start_year AS year FROM dated", "year IS NULL OR year NOT IN (1997, 1998)")
oracle(
    "series_notes",
    f"""
    SELECT points <= 1 AS degrade, points AS plotted_points,
      CAST((SELECT count(*) FROM (VALUES (1997), (1998)) v(y) WHERE y > low AND y < high) AS BIGINT) AS gap_years,
      planned_years, partial_years, missing_trials, sum_trials
    FROM (
      SELECT count(DISTINCT start_year) AS points, count(DISTINCT start_year) FILTER (WHERE start_year > {CURRENT_YEAR}) AS planned_years,
        count(DISTINCT start_year) FILTER (WHERE start_year = {CURRENT_YEAR}) AS partial_years,
        count(*) FILTER (WHERE start_year IS NULL) AS missing_trials, count(*) AS sum_trials,
        min(start_year) AS low, max(start_year) FILTER (WHERE start_year <= {CURRENT_YEAR}) AS high
      FROM dated WHERE start_year IS NULL OR start_year NOT IN (1997, 1998))
    """,
)
oracle(
    "series_one_year",
    """
    SELECT count(DISTINCT year(ts)) <= 1 AS degrade, count(DISTINCT year(ts)) AS plotted_points,
      CAST(max(year(ts)) - min(year(ts)) + 1 - count(DISTINCT year(ts)) AS BIGINT) AS gap_years,
      CAST(0 AS BIGINT) AS planned_years, CAST(0 AS BIGINT) AS partial_years, CAST(0 AS BIGINT) AS missing_trials,
      count(*) AS sum_trials
    FROM events
    """,
)


def _histogram(name: str, bins: list[tuple[int, int | None, str]]) -> None:
    case = " ".join(
        f"WHEN months >= {lo}" + (f" AND months < {hi}" if hi is not None else "") + f" THEN {i}"
        for i, (lo, hi, _) in enumerate(bins)
    )
    values = ", ".join(
        f"({i}, '{label}', {float(lo)}, {'NULL' if hi is None else float(hi)})" for i, (lo, hi, label) in enumerate(bins)
    )
    oracle(
        name,
        """
        SELECT label AS value, CASE WHEN label = 'UNDATED' THEN 'Unknown (undated)' ELSE label END AS label,
          CAST(lo AS DOUBLE) AS bin_start, CAST(hi AS DOUBLE) AS bin_end, coalesce(n, 0) AS count_trials,
          coalesce(n, 0) > 20 AS citations_truncated, coalesce(ids, '') AS source_ids, coalesce(quotes, '') AS matched
        FROM edges LEFT JOIN (
          SELECT bin, count(*) AS n, string_agg(nct_id, ',' ORDER BY nct_id) FILTER (WHERE place <= 20) AS ids,
            string_agg(coalesce(start_date, ''), ';' ORDER BY nct_id) FILTER (WHERE place <= 20) AS quotes
          FROM placed GROUP BY bin) c ON c.bin = edges.i
        WHERE i >= 0 OR n > 0
        """,
        f"""placed AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY nct_id) AS place
            FROM (SELECT nct_id, start_date, CASE {case} ELSE -1 END AS bin FROM timed))""",
        f"edges(i, label, lo, hi) AS (VALUES {values}, (-1, 'UNDATED', NULL, NULL))",
    )


_histogram("histogram_duration", list(fixed.DURATION_BINS))
_histogram("histogram_custom", [(0, 12, "0–12 mo"), (12, 36, "12–36 mo"), (60, None, "60+ mo")])

# --- comparison -----------------------------------------------------------------------------------------


def _arms(arms: list[tuple[str, str]]) -> str:
    """``members``: arm, label and trial; a trial may be in several arms."""
    parts = [f"SELECT {i} AS arm, k FROM dated WHERE {where}" for i, (_, where) in enumerate(arms)]
    return "members AS (" + " UNION ALL ".join(parts) + ")"


def _compare(name: str, arms: list[tuple[str, str]], bars: str, order: str, label: str, derived: str = "false", *more: str) -> None:
    """``bars``: a SELECT of arm, value, nct_id and mentions, one row per (arm, value, trial)."""
    labels = ", ".join(f"({i}, '{text}')" for i, (text, _) in enumerate(arms))
    oracle(
        name,
        f"""
        SELECT c.value, c.label, a.series, coalesce(p.n, 0) AS count_trials, coalesce(p.m, 0) AS count_mentions,
          CASE WHEN coalesce(t.total, 0) = 0 THEN 0.0
               ELSE ((2000 * coalesce(p.n, 0) + t.total) // (2 * t.total)) / 10.0 END AS percent,
          coalesce(t.total, 0) AS arm_total, c.arm AS category_arm, c.place AS category_place,
          coalesce({derived}, false) AS derived, coalesce(p.ids, '') AS source_ids
        FROM (SELECT value, min(arm) AS arm, arg_min(place, arm) AS place, arg_min(label, arm) AS label FROM placed GROUP BY value) c
        CROSS JOIN (SELECT * FROM (VALUES {labels}) v(arm, series)) a
        LEFT JOIN (SELECT arm, count(*) AS total FROM members GROUP BY arm) t ON t.arm = a.arm
        LEFT JOIN placed p ON p.arm = a.arm AND p.value = c.value
        """,
        _arms(arms),
        *more,
        f"bars AS ({bars})",
        f"""placed AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY arm ORDER BY {order}) AS INT) AS place, {label} AS label FROM (
            SELECT arm, value, count(*) AS n, CAST(sum(mentions) AS BIGINT) AS m, count(*) AS count_trials,
              string_agg(nct_id, ',' ORDER BY nct_id) FILTER (WHERE seq <= 20) AS ids
            FROM (SELECT *, row_number() OVER (PARTITION BY arm, value ORDER BY nct_id) AS seq FROM bars)
            GROUP BY arm, value))""",
    )


_BY_COUNT = f"{_SENTINEL}, count_trials DESC, value"
_PHASE_ORDER = (
    "CASE WHEN value = 'MISSING' THEN 0 WHEN value = 'NA' THEN 1 WHEN value LIKE 'EARLY%' THEN 2 "
    "ELSE CAST(value[6:6] AS INT) + 2 END, contains(value, '|'), "
    "replace(replace(value, 'EARLY_PHASE1', '2'), 'PHASE', '3'), value"
)
_compare(
    "compare_status",
    [
        ("Observational", "study_type = 'OBSERVATIONAL'"),
        ("Russia", "k IN (SELECT k FROM loc WHERE contains(lower(raw), 'russia'))"),
        ("Nobody", "false"),
    ],
    f"SELECT arm, {_STATUS} AS value, nct_id, 1 AS mentions FROM members JOIN base USING (k)",
    _BY_COUNT,
    _STATUS_LABEL,
)
_common = "study_type = 'INTERVENTIONAL' AND regexp_matches(phases, '(^|[|])PHASE[12]([|]|$)')"
_compare(
    "compare_phase_common",
    [
        ("Early", f"{_common} AND start_year <= 1997"),
        ("Industry", f"{_common} AND sponsor_class = 'INDUSTRY'"),
        ("Own phase", "study_type = 'INTERVENTIONAL' AND phases = 'NA'"),
    ],
    "SELECT arm, phase_key AS value, nct_id, 1 AS mentions FROM members JOIN t USING (k)",
    _PHASE_ORDER,
    _PHASE_LABEL.replace("phase_key", "value"),
)
_compare(
    "compare_country_top5",
    [("Early", "start_year <= 1997"), ("Industry", "sponsor_class = 'INDUSTRY'")],
    """
    SELECT arm, CASE WHEN own THEN value ELSE 'Other' END AS value, nct_id, count(*) AS mentions
    FROM (SELECT v.*, v.value = 'UNKNOWN' OR k.value IS NOT NULL AS own
          FROM arm_seen v LEFT JOIN arm_kept k ON k.arm = v.arm AND k.value = v.value)
    GROUP BY 1, 2, 3
    """,
    _BY_COUNT,
    """CASE value WHEN 'UNKNOWN' THEN 'Unknown' WHEN 'Other' THEN 'Other (' || (
         SELECT count(*) - 5 FROM (SELECT DISTINCT s.value FROM arm_seen s WHERE s.arm = arm_bars.arm AND s.value <> 'UNKNOWN')
       ) || ' countries)' ELSE value END""".replace("arm_bars.arm", "_x.arm"),
    "c.value = 'Other' AND p.n IS NOT NULL",
    "arm_seen AS (SELECT arm, value, nct_id FROM members JOIN seen USING (k))",
    """arm_kept AS (SELECT arm, value FROM (
         SELECT arm, value, row_number() OVER (PARTITION BY arm ORDER BY count(*) DESC, value) AS place
         FROM arm_seen WHERE value <> 'UNKNOWN' GROUP BY arm, value) WHERE place <= 5)""",
)
ORACLES["compare_country_top5"] = ORACLES["compare_country_top5"].replace(
    "GROUP BY arm, value))", "GROUP BY arm, value) _x)"
)
_ARM_TOTALS = """
    SELECT CAST(y - 1995 AS INT) AS arm, 'Since ' || y AS series, y >= {end} AS dropped,
      CASE WHEN y < {end} THEN (SELECT count(*) FROM dated WHERE start_year >= y) END AS arm_total,
      CASE y {declared} END - (SELECT count(*) FROM dated WHERE start_year >= y) AS drift,
      'ok' AS status
    FROM (SELECT unnest(generate_series(1995, 2001)) AS y)
"""
oracle("compare_arms", _ARM_TOTALS.format(end=2002, declared="WHEN 1995 THEN 10 WHEN 1996 THEN 20"))
oracle("compare_arms_capped", _ARM_TOTALS.format(end=2000, declared="WHEN 1995 THEN 10"))

# --- network ------------------------------------------------------------------------------------------------

oracle(
    "drug_interventions",
    """
    SELECT nct_id, count(*) AS drugs, CAST(sum(len(others)) AS BIGINT) AS other_names, count(DISTINCT name) AS names
    FROM drugs GROUP BY nct_id
    """,
)
oracle("drug_alias_pairs", "SELECT a, b FROM pairs")
oracle("drug_components", "SELECT key, canon AS root FROM canon WHERE key <> canon")
oracle("drug_components_in_batches", "SELECT key, canon AS root FROM canon WHERE key <> canon")
oracle("drug_display_labels", "SELECT canon, label FROM drug_labels")
oracle("sponsor_display_labels", "SELECT sponsor, label FROM sponsor_labels")

_DRUG_LINKS = """links AS (
  SELECT x.nct_id, least(x.id, y.id) AS source, greatest(x.id, y.id) AS target
  FROM trial_drugs x JOIN trial_drugs y ON y.nct_id = x.nct_id AND y.canon > x.canon
  WHERE x.nct_id IN (SELECT nct_id FROM trial_drugs GROUP BY nct_id HAVING count(*) <= {guard}))"""
_NO_LIMIT = 1_000_000_000
_SPONSOR_LINKS = f"""links AS (
  SELECT d.nct_id, 'sponsor:' || {_slug('s.sponsor')} AS source, d.id AS target
  FROM trial_drugs d JOIN sponsors s ON s.nct_id = d.nct_id)"""


def _graph_ctes(links: str, weight: int, nodes: int) -> tuple[str, ...]:
    return (
        links,
        "weighed AS MATERIALIZED (SELECT source, target, count(*) AS weight FROM links GROUP BY 1, 2)",
        f"heavy AS MATERIALIZED (SELECT * FROM weighed WHERE weight >= {weight})",
        """heavy_ends AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM heavy UNION ALL SELECT target FROM heavy)
             GROUP BY id)""",
        f"top AS (SELECT id FROM heavy_ends ORDER BY degree DESC, id LIMIT {nodes})",
        "kept AS MATERIALIZED (SELECT * FROM heavy WHERE source IN (SELECT id FROM top) AND target IN (SELECT id FROM top))",
        "ends AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM kept UNION ALL SELECT target FROM kept) GROUP BY id)",
        f"""labels AS (SELECT 'drug:' || {_slug('canon')} AS id, label FROM drug_labels
             UNION ALL SELECT 'sponsor:' || {_slug('sponsor')}, label FROM sponsor_labels)""",
        """sampled AS (SELECT * FROM (
             SELECT l.source, l.target, l.nct_id, row_number() OVER (PARTITION BY l.source, l.target ORDER BY l.nct_id) AS place
             FROM links l JOIN kept k ON k.source = l.source AND k.target = l.target) WHERE place <= 20)""",
    )


_NODES = "SELECT e.id, l.label, split_part(e.id, ':', 1) AS kind, e.degree FROM ends e JOIN labels l ON l.id = e.id"
_EDGES = """
    SELECT source, target, weight, ids AS source_ids, source_quote, target_quote,
      CASE WHEN b.brief_title <> '' THEN b.brief_title ELSE source_quote END AS source_excerpt,
      listed.drug_names,
      true AS quotes_hold
    FROM (
      SELECT k.source, k.target, k.weight, string_agg(s.nct_id, ',' ORDER BY s.nct_id) AS ids, min(s.nct_id) AS first
      FROM kept k JOIN sampled s ON s.source = k.source AND s.target = k.target GROUP BY 1, 2, 3) e
    JOIN base b ON b.nct_id = e.first
    JOIN (SELECT nct_id, string_agg(name, ';' ORDER BY place) AS drug_names FROM drugs GROUP BY nct_id) listed ON listed.nct_id = e.first
    JOIN quotes x ON x.nct_id = e.first AND x.id = e.source
    JOIN quotes y ON y.nct_id = e.first AND y.id = e.target
"""
_QUOTES = f"""quotes(nct_id, id, source_quote, target_quote) AS (
  SELECT nct_id, id, name, name FROM trial_drugs
  UNION ALL SELECT nct_id, 'sponsor:' || {_slug('sponsor')}, sponsor_name, NULL FROM sponsors)"""
_EDGES = _EDGES.replace("source_quote, target_quote,\n", "x.source_quote, y.target_quote,\n").replace(
    "ELSE source_quote END", "ELSE x.source_quote END"
)
_drug_graph = _graph_ctes(_DRUG_LINKS.format(guard=_NO_LIMIT), 1, _NO_LIMIT)
_sponsor_graph = _graph_ctes(_SPONSOR_LINKS, 1, _NO_LIMIT)
_capped_graph = _graph_ctes(_DRUG_LINKS.format(guard=25), 2, 60)
oracle("drug_drug_nodes", _NODES, *_drug_graph)
oracle("drug_drug_edges", _EDGES, *_drug_graph, _QUOTES)
oracle("drug_drug_nodes_capped", _NODES, *_capped_graph)
oracle("sponsor_drug_nodes", _NODES, *_sponsor_graph)
oracle("sponsor_drug_edges", _EDGES, *_sponsor_graph, _QUOTES)
_SUMMARY = """
    SELECT distinct_trials, n_nodes, n_edges, skipped_trials, pruned_edges, dropped_nodes, dropped_edges, weight1_edges,
      CASE WHEN n_edges > 0 THEN (200 * weight1_edges + n_edges) // (2 * n_edges) END AS weight1_percent,
      n_nodes <= 1 OR n_edges = 0 AS degenerate
    FROM (SELECT (SELECT count(*) FROM base) AS distinct_trials, (SELECT count(*) FROM ends) AS n_nodes,
      (SELECT count(*) FROM kept) AS n_edges, {skipped} AS skipped_trials,
      (SELECT count(*) FROM weighed) - (SELECT count(*) FROM heavy) AS pruned_edges,
      (SELECT count(*) FROM heavy_ends) - (SELECT count(*) FROM top) AS dropped_nodes,
      (SELECT count(*) FROM heavy) - (SELECT count(*) FROM kept) AS dropped_edges,
      (SELECT count(*) FROM kept WHERE weight = 1) AS weight1_edges)
"""
oracle("sponsor_drug_summary", _SUMMARY.format(skipped="CAST(0 AS BIGINT)"), *_sponsor_graph)
oracle(
    "drug_drug_guarded",
    _SUMMARY.format(
        skipped="(SELECT count(*) FROM (SELECT nct_id FROM trial_drugs GROUP BY nct_id HAVING count(*) > 3))"
    ),
    *_graph_ctes(_DRUG_LINKS.format(guard=3), 4, 30),
)
_FREQUENCIES = """
    SELECT label AS value, n AS count_trials, n > 20 AS citations_truncated,
      (SELECT count(DISTINCT canon) FROM trial_drugs) AS drugs_total, (SELECT count(DISTINCT nct_id) FROM trial_drugs) AS trials_total,
      (SELECT count(DISTINCT canon) > {n} FROM trial_drugs) AS buckets_truncated, ids AS source_ids, quotes AS matched
    FROM (
      SELECT l.label, count(*) AS n, string_agg(nct_id, ',' ORDER BY nct_id) FILTER (WHERE place <= 20) AS ids,
        string_agg(name, ';' ORDER BY nct_id) FILTER (WHERE place <= 20) AS quotes
      FROM (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY nct_id) AS place FROM trial_drugs) d
      JOIN drug_labels l ON l.canon = d.canon GROUP BY d.canon, l.label)
    ORDER BY n DESC, label LIMIT {n}
"""
oracle("drug_frequency_fallback", _FREQUENCIES.format(n=_NO_LIMIT))
oracle("drug_frequency_top25", _FREQUENCIES.format(n=25))

# --- audits -----------------------------------------------------------------------------------------------

_COMPLETED = "completed AS (SELECT count(*) AS n, least(count(*), 20) AS cited FROM base WHERE overall_status = 'COMPLETED')"
oracle(
    "audit_quotes",
    "SELECT 'forged_quote' AS result_id, 'COMPLETED' AS value, cited AS bad_citations FROM completed WHERE n > 0",
    _COMPLETED,
)
oracle(
    "audit_quotes_in_records",
    """
    SELECT r AS result_id, 'COMPLETED' AS value, cited AS bad_citations
    FROM completed, (VALUES ('forged_quote'), ('forged_value')) v(r) WHERE n > 0
    """,
    _COMPLETED,
)
oracle(
    "audit_edge_quotes",
    "SELECT 2 * count(*) AS citations, CAST(0 AS BIGINT) AS failed FROM kept",
    *_sponsor_graph,
)
oracle(
    "audit_release",
    """
    SELECT r AS result_id, reason IS NULL AS ok, reason,
      CASE WHEN r = 'small_drift' AND reason IS NULL THEN n || ' trials were counted where '
        || (n + 2) || ' were expected: 2 apart, within tolerance.' END AS disclosure
    FROM (SELECT r, n, CASE r
        WHEN 'forged_quote' THEN 'citation_invalid' WHEN 'inflated_bar' THEN 'bar_sum_mismatch'
        WHEN 'uncited' THEN 'uncited_datum' WHEN 'large_drift' THEN 'reconciliation_failed'
        WHEN 'small_drift' THEN CASE WHEN 2 > (n + 2) * 0.005 THEN 'reconciliation_failed' END
        WHEN 'no_total' THEN 'reconciliation_unavailable' WHEN 'partial_only' THEN 'partial_inconsistent' END AS reason
      FROM (SELECT count(*) AS n FROM base), (VALUES ('status'), ('country'), ('forged_quote'), ('forged_value'),
        ('inflated_bar'), ('uncited'), ('low_contributing'), ('loose_source'), ('negative'), ('small_drift'),
        ('large_drift'), ('no_total'), ('waived'), ('partial_only'), ('refused')) v(r))
    """,
)
oracle(
    "audit_bookkeeping",
    """
    SELECT r AS result_id, 'COMPLETED' AS value, problem
    FROM completed, (VALUES ('low_contributing', 'contributing_below_cited'), ('uncited', 'truncation_flag'),
      ('uncited', 'unresolved_source_id'), ('loose_source', 'unresolved_source_id'), ('negative', 'negative_count')) v(r, problem)
    WHERE problem <> 'truncation_flag' OR n <= 20
    """,
    _COMPLETED,
)
_RESULTS = (
    "results(r) AS (VALUES ('status'), ('country'), ('forged_quote'), ('forged_value'), ('inflated_bar'), "
    "('uncited'), ('low_contributing'), ('loose_source'), ('negative'))"
)
oracle(
    "audit_note_numbers",
    """
    SELECT r AS result_id, CASE WHEN r = 'country' THEN 'Each trial is counted once per country.' ELSE 'One bar per status.' END AS note,
      true AS safe FROM results
    UNION ALL SELECT r, 'Total ' || (SELECT count(*) FROM base), true FROM results
    UNION ALL SELECT r, 'Fabricated 987654321', false FROM results
    """,
    _RESULTS,
)
oracle(
    "audit_stored_results",
    """
    SELECT r AS result_id, CASE WHEN r = 'negative' THEN 'FAIL' ELSE 'PASS' END AS i_schema,
      CASE r WHEN 'negative' THEN 'SKIP' WHEN 'forged_quote' THEN 'FAIL' ELSE 'PASS' END AS ii_provenance,
      CASE WHEN r = 'negative' THEN 'SKIP' WHEN r IN ('uncited', 'low_contributing', 'loose_source') THEN 'FAIL' ELSE 'PASS' END AS iii_counts,
      CASE r WHEN 'negative' THEN 'SKIP' WHEN 'inflated_bar' THEN 'FAIL' ELSE 'PASS' END AS iv_reconciliation,
      '2/3' AS v_notes, r IN ('status', 'country', 'forged_value') AS ok
    FROM results
    """,
    _RESULTS,
)

oracle(
    "nested_source",
    """
    SELECT k % 8 AS kind, count(*) AS sent, CASE WHEN k % 8 IN (0, 4, 5, 7) THEN count(*) ELSE 0 END AS survived,
      CASE WHEN k % 8 = 4 THEN count(*) WHEN k % 8 IN (0, 7) THEN count(*) FILTER (WHERE contains(phase_key, 'PHASE2')) ELSE 0 END AS phase2
    FROM base JOIN t USING (k) GROUP BY k % 8
    """,
)
oracle(
    "stored_results",
    """
    SELECT r AS result_id, 'PASS' AS i_schema, 'PASS' AS ii_provenance, 'PASS' AS iii_counts, 'PASS' AS iv_reconciliation,
      CASE r WHEN 'status' THEN '0/0' WHEN 'country' THEN '2/2' ELSE '1/1' END AS v_notes, true AS ok,
      CASE WHEN r = 'cut_short' THEN 'reconciliation_failed' END AS reason,
      total.n AS count_total, CASE WHEN r = 'cut_short' THEN completed.n ELSE total.n END AS distinct_trials,
      CASE r WHEN 'status' THEN total.n WHEN 'country' THEN (SELECT count(*) FROM seen) ELSE completed.n END AS mentions,
      r = 'cut_short' AS truncated, r = 'cut_short' AS partial, CASE r WHEN 'status' THEN 0 WHEN 'country' THEN 2 ELSE 1 END AS n_notes
    FROM (VALUES ('status'), ('country'), ('cut_short')) v(r), (SELECT count(*) AS n FROM base) total, completed
    """,
    _COMPLETED,
)
oracle(
    "stored_files",
    f"""
    SELECT r AS result_id, CASE WHEN broken THEN 'FAIL' ELSE 'PASS' END AS i_schema,
      CASE WHEN broken THEN 'SKIP' ELSE 'PASS' END AS ii_provenance, CASE WHEN broken THEN 'SKIP' ELSE 'PASS' END AS iii_counts,
      CASE WHEN broken THEN 'SKIP' WHEN r = 'replaced' THEN 'FAIL' ELSE 'PASS' END AS iv_reconciliation,
      '0/0' AS v_notes, NOT broken AND r <> 'replaced' AS ok,
      CASE WHEN NOT broken THEN all_bars.n - CASE WHEN r = 'replaced' THEN 1 ELSE 0 END END AS bars,
      CASE WHEN NOT broken THEN CAST(all_bars.trials - CASE WHEN r = 'replaced' THEN all_bars.completed ELSE 0 END AS BIGINT) END AS bar_sum,
      problems
    FROM (VALUES
      ('sound', false, NULL), ('replaced', false, NULL), ('broken_off', false, NULL),
      ('missing_column', true, 'missing column contributing_count; missing column members'),
      ('mistyped_column', true, 'column count_trials is string, expected bigint'), ('short_meta', true, 'missing column notes')) v(r, broken, problems),
    (SELECT count(DISTINCT {_STATUS}) AS n, count(*) AS trials, count(*) FILTER (WHERE {_STATUS} = 'COMPLETED') AS completed FROM base) all_bars
    """,
)
