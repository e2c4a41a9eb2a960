"""URL rules with redirect equivalence, in DataFrame functions only.

Each url gets a host and a path; the longest rule that fits both decides it.
Pages that point at each other by a redirect or a canonical link are aliases:
connected components over those links carry a block to every page without a rule
of its own, unless some page of the component is allowed by a rule.

The rules are a parameter, so they are a literal map inside the plan; hosts meet
them by their own suffixes (one lookup per label), without a join or a shuffle.
Links are few columns of text; a target that a third of all pages point at is
counted with map-side aggregation and split by AQE in the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trialspark.operators.components import connected_components
from trialspark.session import cut_lineage

#: (action, host and path) as in a block list.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

_CANONICAL = (
    r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)",
    r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?[^\"'>]*?url\s*=\s*((?:&(?:amp|#38|#x26);|[^\"'\s>;])+)",
)
_TRACKING = r"(?i)^(utm_[^=]*|gclid|dclid|gbraid|wbraid|fbclid|msclkid|yclid|twclid|igshid|mc_cid|mc_eid|_ga|_gl)(=|$)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    """From ``?`` up to ``#`` or the end, without tracking parameters; empty without others."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(_TRACKING))
    return F.coalesce(F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest (action, rule) that fits: the rule's host or a subdomain, and a path prefix.

    Of rules of equal length, an allow goes before a block, then the smaller text.
    """
    by_host: dict[str, list] = {}
    for action, rule in rules:
        name, slash, prefix = rule.partition("/")
        entry = F.struct(F.lit(len(rule)).alias("size"), F.lit(action == "allow").alias("allow"), F.lit(rule).alias("rule"), F.lit(slash + prefix).alias("prefix"))
        by_host.setdefault(name, []).append(entry)
    if not by_host:
        return F.lit(None).cast("struct<size:int,allow:boolean,rule:string,prefix:string>")
    table = F.create_map(*[x for name, entries in by_host.items() for x in (F.lit(name), F.array(*entries))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(suffixes, lambda s: table[s]), lambda x: x.isNotNull()))
    fitting = F.filter(found, lambda x: path.startswith(x["prefix"]))
    ordered = F.array_sort(fitting, lambda a, b: (
        F.when(a["size"] != b["size"], b["size"] - a["size"])
        .when(a["allow"] != b["allow"], F.when(a["allow"], -1).otherwise(1))
        .otherwise(F.when(a["rule"] < b["rule"], -1).when(a["rule"] > b["rule"], 1).otherwise(0))
    ))
    return F.when(F.size(ordered) > 0, ordered[0])


def url_verdicts(pages: DataFrame, rules=RULES, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``component``) per row of ``pages``.

    ``verdict`` is the longest fitting rule's action. A page without a rule is
    blocked if a page of its component is blocked by a rule and none is allowed
    by one; else it is allowed. ``component`` is the smallest url key (host, path
    and query without tracking parameters) of the page's aliases, null for a url without a host, which links to
    nothing: a null url or one without ``://`` has empty host and path and is
    allowed. Links to urls that are no page still connect the pages that point
    at them. Repeated rows get a row each; other columns are ignored, whatever
    their names. A null html has no links.
    """
    url = F.col(url_column).cast("string")
    rows = pages.select(F.col(id_column).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_column).cast("string").alias("html"), url.alias("url"))
    rows = rows.withColumn("key", _key(F.col("host"), F.col("path"), query_of(F.col("url"))))
    rules_of = matching_rule(F.col("host"), F.col("path"), rules)
    links = cut_lineage(_links(rows), "links")
    roots, _ = connected_components(links)
    judged = rows.select("page_id", "host", "path", "key", rules_of.alias("m"))
    judged = judged.select("page_id", "host", "path", "key", F.col("m.rule").alias("rule"), F.col("m.allow").alias("allow"))
    placed = judged.join(roots, "key", "left").withColumn("component", F.coalesce("root", "key"))
    # Rules of urls that are only linked to count as well.
    targets = roots.select(F.col("key")).union(roots.select("root")).distinct()
    path = F.split(F.split("key", "/", 2)[1], r"\?", 2)[0]
    split = targets.select("key", F.split("key", "/", 2)[0].alias("host"), F.concat(F.lit("/"), path).alias("path"))
    actions = split.select("key", matching_rule(F.col("host"), F.col("path"), rules)["allow"].alias("allow")).join(roots, "key", "left")
    actions = actions.groupBy(F.coalesce("root", "key").alias("component")).agg(F.bool_or("allow").alias("any_allow"), F.bool_or(~F.col("allow")).alias("any_block"))
    verdict = F.coalesce("allow", ~(F.coalesce("any_block", F.lit(False)) & ~F.coalesce("any_allow", F.lit(False))))
    out = placed.join(actions, "component", "left")
    return out.select("page_id", "host", "path", "rule", F.when(verdict, "allow").otherwise("block").alias("verdict"), "component")


def _key(host: Column, path: Column, query: Column) -> Column:
    """What aliases are told apart by: host, path and query, an empty path being ``/``."""
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), query))


def _links(rows: DataFrame) -> DataFrame:
    """(``a``, ``b``): url keys joined by a canonical link or a redirect of the page's html."""
    targets = F.flatten(F.array(*[F.regexp_extract_all("html", F.lit(p), 1) for p in _CANONICAL]))
    found = rows.filter("key IS NOT NULL AND html IS NOT NULL").select("key", "host", "path", "url", F.explode(targets).alias("to"))
    found = found.withColumn("to", F.regexp_replace("to", "(?i)&(amp|#38|#x26);", "&"))
    scheme = F.regexp_extract("url", r"(?s)^(.*?)://", 1)
    folder = F.regexp_extract("path", r"(?s)^(.*/)", 1)
    absolute = (
        F.when(F.col("to").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, F.lit(":"), F.col("to")))
        .when(F.col("to").startswith("/"), F.concat(scheme, F.lit("://"), F.col("host"), F.col("to")))
        .when(F.col("to").startswith("?"), F.concat(scheme, F.lit("://"), F.col("host"), F.col("path"), F.col("to")))
        .when(F.col("to").startswith("#"), F.col("url"))
        .otherwise(F.concat(scheme, F.lit("://"), F.col("host"), F.when(folder == "", "/").otherwise(folder), F.col("to")))
    )
    other = absolute
    linked = found.select(F.col("key").alias("a"), _key(host_of(other), path_of(other), query_of(other)).alias("b"))
    return linked.filter("a <> b").distinct()
