"""Sponsor-drug and drug-drug co-occurrence graphs with conservative name resolution.

Two passes read the trials. The first reduces all drug mentions to distinct
(name, other names) pairs, from which keys, aliases and labels are resolved on
small tables. The second writes one row per trial with its resolved drugs;
edges, evidence and the fallback bar all read that table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialspark import fixed_values as fixed
from trialspark.functions.names import drug_key, drug_keys, is_combination, is_placebo, slug, slugs, sponsor_key
from trialspark.functions.paths import clean
from trialspark.functions.text import strip
from trialspark.operators.components import connected_components
from trialspark.operators.evidence import below_cut, citation, collect_citations, first_per_bucket, id_cuts, near_rows, with_evidence
from trialspark.session import BROADCAST_ROWS, broadcast_if_small, cut_lineage
from trialspark.sources.reader import dedupe_trials, is_valid_nct_id

KINDS = ("drug_drug", "sponsor_drug")

# Merged names up to which they are looked up in a map instead of joined.
MAP_ROWS = 500

# Distinct names, and bytes of them, up to which node ids are made once per name and looked up.
NAME_ROWS = 50_000
NAME_BYTES = 4 << 20

# Ids of one edge that are collected at once to take the smallest of them.
EDGE_IDS = 1 << 16

TRIAL_COLUMNS = ("nct_id", "brief_title", "sponsor_name", "interventions")

_DRUG_PATH = fixed.FIELD_PATHS["interventionName"]
_SPONSOR_PATH = fixed.FIELD_PATHS["sponsorName"]


# --- names and aliases ----------------------------------------------------------------


def _is_drug(item: Column) -> Column:
    # Markers hold no outer blanks, so the raw names can be tested before they are trimmed.
    named = (item["type"] == "DRUG") & (strip(item["name"]) != "")
    return F.coalesce(named & ~is_placebo(item["name"], item["otherNames"]), F.lit(False))


def drug_rows(trials: DataFrame, *carried: str) -> DataFrame:
    """One row per drug of a trial: ``nct_id``, ``place``, ``name``, ``other_names``.

    Drugs are the interventions of type DRUG with a name, placebo and
    standard-of-care arms excluded by name.
    """
    listed = trials.filter(F.col("nct_id").isNotNull()).select(
        "nct_id", *carried, F.posexplode("interventions").alias("place", "item")
    )
    kept = listed.filter(_is_drug(F.col("item")))
    return kept.select(
        "nct_id", *carried, "place", strip(F.col("item.name")).alias("name"), _other_names(F.col("item.otherNames")).alias("other_names")
    )


def _other_names(listed: Column) -> Column:
    return F.filter(F.transform(listed, strip), lambda o: o.isNotNull() & (o != ""))


def drug_mentions(trials: DataFrame) -> DataFrame:
    """Distinct (name, other names) with how often, where first, and in how many trials: one or more.

    Reduced before the shuffle, so a drug in a third of all trials costs each
    task one row. All measures are numbers, so the reduction is a hash
    aggregation: ``seen`` orders first mentions, and ``low`` differs from
    ``high`` where two trials mention the pair. The raw texts are reduced first,
    so names are trimmed, tested and made keys on the reduced rows only.
    """
    return _reduced_mentions(_all_raw_mentions(trials))


def item_codes(items: DataFrame) -> DataFrame:
    """Add ``code`` to distinct interventions: ``item``, a number that orders as they do, and ``name``, their drug name's.

    Trials whose interventions are these codes take the place of texts in
    :func:`build_network`. Both numbers are made once per intervention and
    stored; ``name`` is null for what is no drug, and counts from 0 without gaps
    where names are few enough to be looked up.
    """
    drug = F.when(_is_drug(F.col("item")), F.col("item.name")).alias("drug")
    items = cut_lineage(items.select("item", drug), "items")
    names = items.select("drug").filter(F.col("drug").isNotNull()).distinct()
    size = names.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("drug")), F.lit(0)).alias("bytes")).first()
    few = size["n"] <= NAME_ROWS and size["bytes"] <= NAME_BYTES
    number = F.row_number().over(Window.orderBy("drug")) - 1 if few else F.monotonically_increasing_id()
    names = cut_lineage(names.withColumn("name", number.cast("long")), "name-codes")
    # Sorted over all tasks, so that the numbers of one partition lie before those of the next.
    numbered = cut_lineage(items.orderBy("item").withColumn("number", F.monotonically_increasing_id()), "item-numbers")
    coded = numbered.join(F.broadcast(names) if few else names, "drug", "left")
    return cut_lineage(coded.select("item", F.struct(F.col("number").alias("item"), "name").alias("code")), "item-codes")


def _all_raw_mentions(trials: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """:func:`_raw_mentions` of all trials; raw texts that ids of both forms mention have a row for each."""
    valid = is_valid_nct_id(F.col("nct_id"))
    # Registry numbers order as their digits do: one long finds their first mention. Ids of any other form go apart.
    number = F.substring("nct_id", 4, 8).cast("long") * 1_000_000
    place = F.least("place", F.lit(999_999))
    numbered = _raw_mentions(trials.filter(valid), number.alias("at"), F.col("at") + place)
    numbered = numbered.withColumn("seen", _number_seen(F.col("seen")))
    others = _raw_mentions(trials.filter(F.col("nct_id").isNotNull() & ~valid), F.col("nct_id").alias("at"), first_seen(F.col("at"), F.col("place")))
    raw = numbered.unionByName(others)
    if items is None:
        return raw
    texts = items.select(F.col("code.item").alias("number"), "item.name", "item.otherNames")
    return raw.join(texts, "number").drop("number")


def _reduced_mentions(raw: DataFrame) -> DataFrame:
    item = F.struct(F.lit("DRUG").alias("type"), "name", "otherNames")
    # Tied to a count, or the optimizer would move the test below the reduction.
    kept = raw.withColumn("item", item).filter(F.when(_is_drug(F.col("item")), F.col("mentions")) > 0)
    reduced = (
        kept.groupBy(strip(F.col("name")).alias("name"), _other_names(F.col("otherNames")).alias("other_names"))
        .agg(
            F.sum("mentions").alias("mentions"),
            F.min("seen").alias("seen"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
        )
    )
    keys = F.array_distinct(F.transform(F.coalesce("other_names", F.array().cast("array<string>")), drug_key))
    return reduced.withColumn("key", drug_key(F.col("name"))).withColumn(
        "alias_keys", F.array_except(keys, F.array("key"))
    )


def _raw_mentions(trials: DataFrame, at: Column, seen: Column) -> DataFrame:
    """Distinct raw (name, other names) of the drugs, or their ``number``, with the measures of :func:`drug_mentions`."""
    listed = trials.select(F.xxhash64("nct_id").alias("trial"), at, F.posexplode("interventions").alias("place", "item"))
    if _is_coded(trials):
        drugs = listed.filter(F.col("item.name").isNotNull()).groupBy(F.col("item.item").alias("number"))
    else:
        drugs = listed.filter(F.col("item.type") == "DRUG").groupBy(F.col("item.name").alias("name"), F.col("item.otherNames").alias("otherNames"))
    return (
        drugs
        .agg(F.count(F.lit(1)).alias("mentions"), F.min(seen).alias("seen"), F.min("trial").alias("low"), F.max("trial").alias("high"))
    )


def alias_pairs(mentions: DataFrame) -> DataFrame:
    """(``a``, ``b``) key pairs to merge: aliases attested by at least two trials.

    An other name is an alias only when it is itself the main name of a drug.
    Combination products, and interventions with two or more such names, attest
    nothing. Attestation needs two distinct trials, and two are there when the
    smallest and the largest hash of their ids differ.
    """
    mains = mentions.select(F.col("key").alias("alias")).distinct()
    named = mentions.filter((F.size("alias_keys") > 0) & ~is_combination(F.col("name")))
    hits = (
        named.select("name", "other_names", "key", "low", "high", F.explode("alias_keys").alias("alias"))
        .join(mains, "alias", "left_semi")
        .groupBy("name", "other_names", "key", "low", "high")
        .agg(F.collect_list("alias").alias("aliases"))
        .filter(F.size("aliases") == 1)
        .withColumn("alias", F.get("aliases", 0))
    )
    return (
        hits.groupBy(F.least("key", "alias").alias("a"), F.greatest("key", "alias").alias("b"))
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .filter(F.col("low") < F.col("high"))
        .select("a", "b")
    )


def resolve(rows: DataFrame, components: tuple[DataFrame, int]) -> DataFrame:
    """Add ``canon``: the component root of ``key``, or the key itself."""
    table, size = components
    if size == 0:
        return rows.withColumn("canon", F.col("key"))
    joined = rows.join(broadcast_if_small(table, size), "key", "left")
    return joined.withColumn("canon", F.coalesce("root", "key")).drop("root")


def first_seen(nct_id: Column, place: Column) -> Column:
    """A number that orders mentions by trial id, then by place in the record.

    It holds the first 13 bytes of the id, all of a registry number, and the
    place up to 999,999; what ties beyond that is told apart by the name.
    """
    digits = F.rpad(F.hex(nct_id), 26, "0")
    head, tail = (F.conv(part, 16, 10).cast("decimal(20,0)") for part in (F.substring(digits, 1, 14), F.substring(digits, 15, 12)))
    number = head.cast("decimal(38,0)") * F.lit(1 << 48).cast("decimal(15,0)") + tail
    return (number.cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)") + F.least(place, F.lit(999_999))).cast("decimal(38,0)")


def _number_seen(number: Column) -> Column:
    """:func:`first_seen` of a registry number's digits times a million, and the place added to it."""
    digits = F.lpad(F.floor(number / 1_000_000).cast("string"), 8, "0")
    return first_seen(F.concat(F.lit("NCT"), digits), (number % 1_000_000).cast("int"))


def _most_frequent(names: DataFrame, key: str) -> DataFrame:
    """Display label per key: the most frequent raw name, the first seen on ties.

    The best of each measure in turn, all of them numbers: hash aggregations of
    the names that are left.
    """
    left = names.select(key, "name", (-F.col("n")).alias("_rare"), F.col("seen").alias("_seen"), F.xxhash64("name").alias("_name"))
    for measure in ("_rare", "_seen", "_name"):
        best = left.groupBy(key).agg(F.min(measure).alias("_best"))
        left = left.join(best, key).filter(F.col(measure) == F.col("_best")).drop("_best")
    return left.select(key, F.col("name").alias("label"))


def drug_labels(mentions: DataFrame, components: tuple[DataFrame, int]) -> DataFrame:
    """``canon`` -> ``label``; counts mentions, not trials."""
    names = resolve(mentions, components).groupBy("canon", "name").agg(
        F.sum("mentions").alias("n"), F.min("seen").alias("seen")
    )
    return _most_frequent(names, "canon")


def sponsor_labels(trials: DataFrame) -> DataFrame:
    """``sponsor`` key -> ``label`` over the raw lead-sponsor names."""
    return _sponsor_labels(sponsor_mentions(trials))


def _sponsor_labels(mentions: DataFrame) -> DataFrame:
    names = mentions.groupBy("sponsor", "name").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
    return _most_frequent(names, "sponsor")


def sponsor_mentions(trials: DataFrame) -> DataFrame:
    """Distinct raw lead-sponsor names with their trimmed name, their key, how often and where first."""
    valid = is_valid_nct_id(F.col("nct_id"))
    named = trials.filter(F.col("sponsor_name").isNotNull() & F.col("nct_id").isNotNull())

    def first(rows: DataFrame, seen: Column) -> DataFrame:
        return rows.groupBy("sponsor_name").agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("seen"))

    numbered = first(named.filter(valid), F.substring("nct_id", 4, 8).cast("long") * 1_000_000).withColumn("seen", _number_seen(F.col("seen")))
    raw = numbered.unionByName(first(named.filter(~valid), first_seen(F.col("nct_id"), F.lit(0))))
    reduced = raw.groupBy("sponsor_name").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
    cleaned = reduced.withColumn("name", clean(F.col("sponsor_name"))).filter(F.when(F.col("name").isNotNull(), F.col("n")) > 0)
    return cleaned.withColumn("sponsor", sponsor_key(F.col("name")))


# --- the graph --------------------------------------------------------------------------


def node_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), slug(key))


def _id_lookup(ids: DataFrame, *given: str) -> tuple[Column, Callable[[Column, Column], Column]] | None:
    """The ``id`` of each ``name`` of a table of distinct names as maps, and the read of a name in them.

    A read gives the ``id``, or a struct of the columns ``given``. Nothing when
    the names are too many.

    The names lie in as many small maps as there are names, chosen by a hash, as
    a map alone is searched from its start.
    """
    size = ids.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("name")), F.lit(0)).alias("bytes")).first()
    if size["n"] > NAME_ROWS or size["bytes"] > NAME_BYTES:
        return None
    n = max(1, size["n"])

    def place(name: Column) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(n)).cast("int")

    value = F.struct(*given) if given else F.col("id")
    listed_ids = ids.select(place(F.col("name")).alias("at"), F.struct("name", value.alias("value")).alias("entry"))
    filled = listed_ids.groupBy("at").agg(F.collect_list("entry").alias("entries"))
    every = ids.sparkSession.range(n).select(F.col("id").cast("int").alias("at")).join(filled, "at", "left")
    none = F.array().cast(filled.schema["entries"].dataType)
    listed = F.sort_array(F.collect_list(F.struct("at", F.coalesce("entries", none).alias("entries"))))
    maps = every.agg(F.transform(listed, lambda b: F.map_from_entries(b["entries"])).alias("maps")).scalar()
    return maps, lambda column, name: F.try_element_at(F.get(column, place(name)), name)


def _drug_ids(mentions: DataFrame, components: tuple[DataFrame, int]) -> DataFrame:
    """``name`` -> ``id`` of every drug name; a name has one key."""
    names = resolve(mentions.select("name", "key").distinct(), components)
    return cut_lineage(names.select("name", node_id("drug", F.col("canon")).alias("id")), "drug-ids")


def _raw_ids(ids: DataFrame, raw: DataFrame) -> DataFrame:
    """The ``id`` and the trimmed ``literal`` of each raw ``name`` that is a drug's."""
    names = raw.select(F.col("name").alias("raw")).distinct()
    named = names.join(ids, strip(F.col("raw")) == F.col("name"))
    return cut_lineage(named.select(F.col("raw").alias("name"), F.col("name").alias("literal"), "id"), "raw-ids")


def trial_drugs(
    trials: DataFrame,
    components: tuple[DataFrame, int],
    mentions: DataFrame | None = None,
    raw: DataFrame | None = None,
    named: bool = True,
) -> DataFrame:
    """One row per trial with a drug: its drug names, and its distinct resolved drugs.

    ``names`` are the literal names in record order; ``drugs`` pairs the node id
    of each resolved drug with the first literal name it has in this record. A
    record's list stays a list, so nothing is shuffled. With the ``mentions`` of
    these trials the id of each distinct name is made once and looked up. Where
    those are too many, ids are made in the record, and merged names looked up in
    a map, or by a join of the exploded lists. With the ``raw`` mentions too, the
    names are looked up untrimmed, and other names are tested only if any of them
    is a placebo's. Not ``named``, the result has ``ids`` in place of both lists.
    """
    table, size = components
    carried = [c for c in trials.columns if c not in ("nct_id", "interventions")]
    found, marked = None, True
    if mentions is not None:
        names = _drug_ids(mentions, components).withColumn("literal", F.col("name"))
        if raw is not None:
            names = _raw_ids(names.drop("literal"), raw)
            marked = not raw.filter(_others_placebo(F.col("otherNames"))).isEmpty()
        found = _id_lookup(names, *(("id", "literal") if named else ()))
    if found is not None:
        # Names that are no drug's are not among the mentions; other names are tested where there are any.
        maps, read = found

        def drug_of(x: Column) -> Column:
            wanted = x["type"] == "DRUG"
            if marked:
                wanted = wanted & ~_others_placebo(x["otherNames"])
            return F.when(wanted, read(F.col("maps"), strip(x["name"]) if raw is None else x["name"]))

        # One use of the maps, so that no row holds a copy of them.
        drugs = F.array_compact(F.transform("interventions", drug_of))
        listed = trials.filter(F.col("nct_id").isNotNull()).withColumn("maps", maps).select("nct_id", *carried, drugs.alias("found"))
        # A list of one element, exploded: a filter on its row is not moved below and computed again.
        listed = listed.select("nct_id", *carried, F.explode(F.array("found")).alias("found")).filter(F.size("found") > 0)
        listed = listed.select("nct_id", *carried, *((F.col("found.literal").alias("names"), F.col("found.id").alias("ids")) if named else (F.col("found").alias("ids"),)))
    elif size > MAP_ROWS:
        listed = _joined_drugs(trials, components, carried)
    else:
        kept = F.filter("interventions", _is_drug)
        names = F.transform(kept, lambda x: strip(x["name"]))
        one = F.explode(F.array(names)).alias("names")
        listed = trials.filter(F.col("nct_id").isNotNull()).select("nct_id", *carried, one)
        listed = listed.filter(F.size("names") > 0).withColumn("keys", drug_keys("names"))
        if size:
            roots = table.agg(F.map_from_entries(F.collect_list(F.struct("key", "root"))).alias("roots")).scalar()
            listed = listed.withColumn("roots", roots).withColumn("keys", F.transform("keys", lambda k: F.coalesce(F.try_element_at("roots", k), k)))
        listed = listed.withColumn("ids", F.transform(slugs("keys"), lambda s: F.concat(F.lit("drug:"), s)))
    if not named:
        return listed.select("nct_id", *carried, F.array_distinct("ids").alias("ids"))
    pairs = F.zip_with("ids", "names", lambda id, name: F.struct(id.alias("id"), name.alias("name")))
    first = F.filter(pairs, lambda x, i: F.array_position("ids", x["id"]) == i + 1)
    # Few records name a drug twice; only those are searched.
    drugs = F.when(F.size(F.array_distinct("ids")) == F.size("ids"), pairs).otherwise(first)
    return listed.select("nct_id", *carried, "names", drugs.alias("drugs"))


def _is_coded(trials: DataFrame) -> bool:
    return "item" in trials.schema["interventions"].dataType.elementType.fieldNames()


def _coded_drugs(trials: DataFrame, items: DataFrame, components: tuple[DataFrame, int], mentions: DataFrame) -> DataFrame:
    """:func:`trial_drugs`, not ``named``, of trials with the codes of ``items``: ids by the numbers of the names."""
    carried = [c for c in trials.columns if c not in ("nct_id", "interventions")]
    names = items.filter("code.name IS NOT NULL").select(F.col("code.name").alias("number"), strip(F.col("item.name")).alias("name")).distinct()
    ids = cut_lineage(names.join(_drug_ids(mentions, components), "name", "left").select("number", "id"), "name-ids")
    size = ids.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("number") + 1, F.lit(0)).alias("end")).first()
    trials = trials.filter(F.col("nct_id").isNotNull())
    if size["n"] != size["end"]:
        # Numbers with gaps: the names are too many for a list.
        rows = trials.select("nct_id", *carried, F.explode("interventions.name").alias("number")).join(ids.dropna(), "number")
        return rows.groupBy("nct_id").agg(*[F.first(c).alias(c) for c in carried], F.collect_set("id").alias("ids"))
    by_number = F.sort_array(F.collect_list(F.struct("number", "id")))
    every = ids.agg(F.transform(by_number, lambda x: x["id"]).alias("every")).scalar()
    # One use of the ids, so that no row holds a copy of them.
    found = F.array_compact(F.transform("interventions.name", lambda n: F.get(F.col("every"), n.cast("int"))))
    listed = trials.withColumn("every", every).select("nct_id", *carried, F.explode(F.array(F.array_distinct(found))).alias("ids"))
    return listed.filter(F.size("ids") > 0)


def _others_placebo(others: Column) -> Column:
    """:func:`is_placebo` of the other names alone."""
    return F.coalesce((F.size(others) > 0) & is_placebo(F.lit(None).cast("string"), others), F.lit(False))


def _joined_drugs(trials: DataFrame, components: tuple[DataFrame, int], carried: Sequence[str]) -> DataFrame:
    rows = drug_rows(trials, *carried).withColumn("key", drug_key(F.col("name")))
    rows = resolve(rows, components).withColumn("id", node_id("drug", F.col("canon")))
    grouped = rows.groupBy("nct_id").agg(
        *[F.first(c).alias(c) for c in carried],
        F.sort_array(F.collect_list(F.struct("place", "name", "id"))).alias("items"),
    )
    return grouped.select("nct_id", *carried, F.col("items.name").alias("names"), F.col("items.id").alias("ids"))


def _ids(resolved: DataFrame) -> Column:
    """The distinct drug ids of a resolved trial."""
    return F.col("drugs.id") if "drugs" in resolved.columns else F.col("ids")


def _pairs(resolved: DataFrame, max_drugs: int | None) -> DataFrame:
    """Unordered drug pairs of a trial.

    With ``max_drugs`` larger trials are skipped and counted in ``summary``; the
    fan-out of one record is then at most max_drugs^2 / 2 pairs.
    """
    # Only the ids are read: a pair carries two texts and the rest of its list, no names.
    ids = resolved.select("nct_id", _ids(resolved).alias("all"))
    if max_drugs is not None:
        ids = ids.filter(F.size("all") <= max_drugs)
    return ids.select("nct_id", "all", F.posexplode("all").alias("at", "one")).select(
        "nct_id", "one", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("two")
    ).select("nct_id", F.least("one", "two").alias("source"), F.greatest("one", "two").alias("target"))


def _with_sponsor(trials: DataFrame, mentions: DataFrame) -> DataFrame:
    """Add ``sponsor``, the node id of the lead sponsor, null without one: looked up, or made from the name."""
    ids = mentions.select(F.col("sponsor_name").alias("name"), node_id("sponsor", F.col("sponsor")).alias("id"))
    found = _id_lookup(cut_lineage(ids, "sponsor-ids"))
    if found is None:
        return trials.withColumn("sponsor", node_id("sponsor", sponsor_key(clean(F.col("sponsor_name")))))
    maps, read = found
    return trials.withColumn("sponsor", read(maps, F.col("sponsor_name")))


def _sponsor_pairs(resolved: DataFrame) -> DataFrame:
    # The id was made when the trials were stored: filters that a join adds on it cost nothing.
    named = resolved.filter(F.col("sponsor").isNotNull())
    return named.select("nct_id", F.col("sponsor").alias("source"), F.explode(_ids(resolved)).alias("target"))


def _drug_node_labels(mentions: DataFrame, components: tuple[DataFrame, int], shown: DataFrame | None = None) -> DataFrame:
    """``id`` -> ``label`` of all drugs, or of the ``shown`` ids only, chosen before the labels are."""
    names = resolve(mentions, components).withColumn("id", node_id("drug", F.col("canon")))
    if shown is not None:
        names = names.join(shown.select("id"), "id", "left_semi")
    names = names.groupBy("id", "name").agg(F.sum("mentions").alias("n"), F.min("seen").alias("seen"))
    return _most_frequent(names, "id")


def degrees(edges: DataFrame) -> DataFrame:
    """Incident edges per node."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


@dataclass
class Network:
    """A built graph. Tables are built on first use and read the stored resolved trials."""

    kind: str
    trials: DataFrame
    mentions: DataFrame
    components: tuple[DataFrame, int]
    resolved: DataFrame
    max_nodes: int | None
    min_edge_weight: int
    max_drugs_per_trial: int | None
    evidence_limit: int
    sponsors: DataFrame | None = None
    cited: bool = True

    @cached_property
    def links(self) -> DataFrame:
        """One row per (trial, edge)."""
        if self.kind == "sponsor_drug":
            return _sponsor_pairs(self.resolved)
        return _pairs(self.resolved, self.max_drugs_per_trial)

    @cached_property
    def all_weights(self) -> DataFrame:
        """All edges with their weight: distinct trials. Stored, as the other tables read it.

        The same pass counts how many of an edge's trials lie among the first
        ids: ``until`` is where its sample must end at the latest, ``below`` how
        many trials that leaves.
        """
        cuts = id_cuts(self.resolved.select("nct_id"), self.evidence_limit) if self.cited else []
        counts, until, below = below_cut(cuts, self.evidence_limit)
        counted = self.links.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"), *counts)
        return cut_lineage(counted.select("source", "target", "weight", until, F.coalesce(below, "weight").alias("below")), "edges")

    @cached_property
    def heavy(self) -> DataFrame:
        """Edges of at least the minimum weight."""
        return self.all_weights.filter(F.col("weight") >= self.min_edge_weight) if self.min_edge_weight > 1 else self.all_weights

    @cached_property
    def weights(self) -> DataFrame:
        """Kept edges: those between the ``max_nodes`` nodes of highest degree, or all."""
        heavy = self.heavy
        if self.max_nodes is None:
            return heavy
        top = degrees(heavy).orderBy(F.col("degree").desc(), "id").limit(self.max_nodes).select("id")
        if self.max_nodes <= BROADCAST_ROWS:
            top = F.broadcast(top)
        kept = heavy.join(top.withColumnRenamed("id", "source"), "source", "left_semi")
        kept = kept.join(top.withColumnRenamed("id", "target"), "target", "left_semi")
        return cut_lineage(kept, "kept-edges")

    @cached_property
    def nodes(self) -> DataFrame:
        """``id, label, kind, degree`` of every endpoint left, by falling degree."""
        ends = degrees(self.weights)
        shown = None if self.max_nodes is None else ends
        labels = _drug_node_labels(self.mentions, self.components, shown)
        if self.kind == "sponsor_drug":
            labels = labels.unionByName(
                _sponsor_labels(self.sponsors).select(node_id("sponsor", F.col("sponsor")).alias("id"), "label")
            )
        joined = ends.join(labels, "id", "left")
        kind = F.split_part(F.col("id"), F.lit(":"), F.lit(1))
        return joined.select("id", F.coalesce("label", "id").alias("label"), kind.alias("kind"), "degree").orderBy(
            F.col("degree").desc(), "id"
        )

    @cached_property
    def edges(self) -> DataFrame:
        """``source, target, weight, source_ids, citations`` by falling weight.

        The two citations of an edge, one per endpoint, quote the literal names
        in its trial with the smallest id.
        """
        self._must_be_cited()
        # max_nodes nodes have at most max_nodes^2 / 2 edges between them.
        few = self.max_nodes is not None and self.max_nodes**2 <= 2 * BROADCAST_ROWS
        ids = self._sampled_ids(few)
        # Only the ends and one id go to the records; the id lists meet the edges at the end.
        first = ids.select("source", "target", F.get("source_ids", 0).alias("nct_id"))
        cited = self.resolved.join(F.broadcast(first) if few else first, "nct_id").select(
            "source", "target", F.array(self._source_citation(), self._drug_citation("target")).alias("citations")
        )
        return (
            self.weights.drop("until", "below").join(ids, ["source", "target"])
            .join(cited, ["source", "target"])
            .withColumn("contributing_count", F.col("weight"))
            .withColumn("truncated", F.col("weight") > F.size("source_ids"))
            .orderBy(F.col("weight").desc(), "source", "target")
        )

    def _must_be_cited(self) -> None:
        if not self.cited:
            raise ValueError("a graph built with cited=False has no texts to cite")

    def _sampled_ids(self, few: bool) -> DataFrame:
        """``source, target, source_ids``: the smallest ids of each kept edge.

        Links beyond an edge's cut are dropped where they are made, so few more
        than the sample are shuffled and none are sorted by edge. Edges that have
        too many trials before the cut all the same, because their ids lie close
        together, go through a limited window.
        """
        key, linked = ["source", "target"], self.links
        if self.max_nodes is not None or self.min_edge_weight > 1:
            kept = self.weights.select(*key)
            linked = linked.join(F.broadcast(kept) if few else kept, key, "left_semi")
        cut = self.weights.filter("until IS NOT NULL").select(*key, "until", "below", "weight")
        facts = self.weights.agg(F.count("until").alias("cut"), F.coalesce(F.sum("weight"), F.lit(0)).alias("links"), F.count_if(F.col("below") > EDGE_IDS).alias("crowded")).first()
        if facts["cut"] > BROADCAST_ROWS:
            # Edges with more than this share of all links; the others are small enough for a task.
            cut = cut.filter(F.col("weight") * BROADCAST_ROWS > facts["links"])
        if facts["cut"]:
            marked = linked.join(F.broadcast(cut.select(*key, "until")), key, "left")
            linked = marked.filter(F.col("until").isNull() | (F.col("nct_id") <= F.col("until"))).select("nct_id", *key)
        smallest = F.slice(F.array_sort(F.collect_list("nct_id")), 1, self.evidence_limit).alias("source_ids")
        if not facts["crowded"]:
            return linked.groupBy(*key).agg(smallest)
        crowded = self.weights.filter(F.col("below") > EDGE_IDS).select(*key)
        limited = first_per_bucket(linked.join(crowded, key, "left_semi"), key, self.evidence_limit)
        return linked.join(crowded, key, "left_anti").unionByName(limited.select("nct_id", *key)).groupBy(*key).agg(smallest)

    def _source_citation(self) -> Column:
        if self.kind == "drug_drug":
            return self._drug_citation("source")
        return citation(_SPONSOR_PATH, F.array("sponsor_name"), False, F.col("sponsor_name"))

    @staticmethod
    def _drug_citation(end: str) -> Column:
        name = F.get(F.filter("drugs", lambda d: d["id"] == F.col(end)), 0)["name"]
        return citation(_DRUG_PATH, F.col("names"), True, F.coalesce(name, F.lit("")))

    @cached_property
    def summary(self) -> DataFrame:
        """One row: sizes, degeneracy, what the options left out, and the share of weight-1 edges."""
        edges = self.weights.agg(
            F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("weight") == 1).alias("weight1_edges")
        )
        nodes = degrees(self.weights).agg(F.count(F.lit(1)).alias("n"))
        distinct = self.trials.agg(F.count("nct_id").alias("n"))
        none = F.lit(0).cast("long")
        skips = self.kind == "drug_drug" and self.max_drugs_per_trial is not None
        skipped = self.resolved.agg(F.count_if(F.size(_ids(self.resolved)) > self.max_drugs_per_trial).alias("n")).scalar() if skips else none
        pruned = self.all_weights.agg(F.count_if(F.col("weight") < self.min_edge_weight).alias("n")).scalar()
        capped = self.max_nodes is not None
        heavy = self.heavy.agg(F.count(F.lit(1)).alias("n")).scalar()
        ends = degrees(self.heavy).agg(F.count(F.lit(1)).alias("n")).scalar()
        row = edges.select(
            distinct.scalar().alias("distinct_trials"),
            nodes.scalar().alias("n_nodes"),
            "n_edges",
            skipped.alias("skipped_trials"),
            pruned.alias("pruned_edges"),
            (F.greatest(none, ends - self.max_nodes) if capped else none).alias("dropped_nodes"),
            (heavy - F.col("n_edges") if capped else none).alias("dropped_edges"),
            "weight1_edges",
        )
        n, ones = F.col("n_edges"), F.col("weight1_edges")
        return row.select(
            "*",
            F.when(n > 0, F.floor((ones * 200 + n) / (n * 2))).alias("weight1_percent"),
            ((F.col("n_nodes") <= 1) | (n == 0)).alias("degenerate"),
        )

    def frequencies(self, top_n: int | None = None) -> DataFrame:
        """Drug-frequency bar, for when the graph is degenerate: see :func:`drug_frequencies`."""
        self._must_be_cited()
        return drug_frequencies(self.resolved, self.mentions, self.components, top_n, self.evidence_limit)

    @property
    def fallback(self) -> DataFrame:
        """The bar of all drugs."""
        return self.frequencies()


def drug_frequencies(
    resolved: DataFrame,
    mentions: DataFrame,
    components: tuple[DataFrame, int],
    top_n: int | None = None,
    evidence_limit: int = fixed.EVIDENCE_LIMIT,
) -> DataFrame:
    """Drugs by distinct trials, each cited by its own name in a record; with ``top_n`` the first ones.

    Every row holds the totals: ``drugs_total`` drugs in ``trials_total`` trials.
    Counts choose the drugs (those that tie with the last included) before any
    label is made.
    """
    rows = resolved.select("nct_id", "brief_title", "names", F.explode("drugs").alias("drug")).select(
        "nct_id", "brief_title", "names", "drug.id", "drug.name"
    )
    counts = rows.groupBy("id").agg(F.count(F.lit(1)).alias("count_trials"))
    counts = cut_lineage(counts, "frequencies")
    total = counts.agg(F.count(F.lit(1)).alias("n")).scalar()
    if top_n is None:
        top = counts.join(_drug_node_labels(mentions, components), "id")
    else:
        least = counts.select("count_trials").orderBy(F.col("count_trials").desc()).limit(top_n).agg(F.min("count_trials").alias("n"))
        most = counts.filter(F.col("count_trials") >= least.scalar())
        top = most.join(_drug_node_labels(mentions, components, most), "id")
        top = top.orderBy(F.col("count_trials").desc(), "label").limit(top_n)
        few = top.select("id")
        rows = rows.join(F.broadcast(few) if top_n <= BROADCAST_ROWS else few, "id", "left_semi")
    sampled = first_per_bucket(near_rows(rows, resolved.select("nct_id"), ["id"], evidence_limit), ["id"], evidence_limit)
    quoted = citation(_DRUG_PATH, F.col("names"), True, F.col("name"))
    evidence = collect_citations(sampled.withColumn("citation", quoted), ["id"])
    buckets = top.withColumn("value", F.col("label")).withColumn("count_mentions", F.col("count_trials"))
    return (
        with_evidence(buckets, evidence, ["id"])
        .withColumn("drugs_total", total)
        .withColumn("trials_total", resolved.agg(F.count_if(F.size("drugs") > 0).alias("n")).scalar())
        .withColumn("buckets_truncated", F.lit(False) if top_n is None else total > F.lit(top_n))
        .drop("id")
        .orderBy(F.col("count_trials").desc(), "label")
    )


def build_network(
    trials: DataFrame,
    kind: str,
    *,
    unique_ids: bool = False,
    order_column: str | None = None,
    max_nodes: int | None = None,
    min_edge_weight: int = 1,
    max_drugs_per_trial: int | None = None,
    evidence_limit: int = fixed.EVIDENCE_LIMIT,
    cited: bool = True,
    items: DataFrame | None = None,
) -> Network:
    """Resolve the names and store one resolved row per trial; the graph reads that.

    Everything is kept unless an option says otherwise: ``max_nodes`` of highest
    degree, a minimum edge weight, a maximum of drugs per trial. ``summary``
    counts what they leave out. Not ``cited``, the graph has weights, nodes and
    summary only: titles are not read, and no names are stored per trial. Then the
    interventions of a trial may be codes, and ``items`` the table of :func:`item_codes`.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown network kind {kind!r}; known: {list(KINDS)}")
    if items is not None and cited:
        raise ValueError("coded interventions have no texts to cite; use cited=False")
    order = [order_column] if order_column else []
    sponsored = ("sponsor_name",) if kind == "sponsor_drug" else ()
    trials = trials.select(*(TRIAL_COLUMNS if cited else ("nct_id", *sponsored, "interventions")), *order)
    if unique_ids:
        trials = trials.filter(F.col("nct_id").isNotNull())
    else:
        trials = cut_lineage(dedupe_trials(trials, order_column), "trials")
    raw = cut_lineage(_all_raw_mentions(trials, items), "raw-mentions")
    mentions = cut_lineage(_reduced_mentions(raw), "mentions")
    components = connected_components(alias_pairs(mentions))
    sponsors, named = None, trials
    if kind == "sponsor_drug":
        sponsors = cut_lineage(sponsor_mentions(trials), "sponsors")
        named = _with_sponsor(trials, sponsors)
    if items is None:
        resolved = trial_drugs(named, components, mentions, raw, named=cited)
    else:
        resolved = _coded_drugs(named, items, components, mentions)
    if cited or max_drugs_per_trial is not None:
        # Read more than once: else the links are the only reader.
        resolved = cut_lineage(resolved, "resolved")
    return Network(
        kind=kind,
        trials=trials,
        mentions=mentions,
        components=components,
        resolved=resolved,
        max_nodes=max_nodes,
        min_edge_weight=min_edge_weight,
        max_drugs_per_trial=max_drugs_per_trial,
        evidence_limit=evidence_limit,
        sponsors=sponsors,
        cited=cited,
    )
