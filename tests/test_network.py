from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from conftest import drug, nct
from pyspark.sql import functions as F

from trialspark.operators import evidence, network
from trialspark.operators.components import connected_components, merge_components
from trialspark.operators.network import alias_pairs, build_network, drug_mentions


def trial(number, *drugs, sponsor=None, title=None):
    return {
        "nct_id": nct(number), "sponsor_name": sponsor, "brief_title": title,
        "interventions": [d if isinstance(d, tuple) else drug(d) for d in drugs],
    }


def edges(graph):
    return [(r["source"], r["target"], r["weight"]) for r in graph.edges.collect()]


def nodes(graph):
    return [(r["id"], r["label"], r["kind"], r["degree"]) for r in graph.nodes.collect()]


def test_sponsor_drug(study_table):
    trials = study_table(
        [
            trial(1, "Pembrolizumab", sponsor="Merck", title="One"),
            trial(2, "Pembrolizumab", "Lenvatinib", sponsor="Merck Inc."),
            trial(3, "Nivolumab", sponsor="Bristol"),
            trial(4, "Nivolumab"),
        ]
    )
    graph = build_network(trials, "sponsor_drug")
    assert edges(graph) == [
        ("sponsor:merck", "drug:pembrolizumab", 2),
        ("sponsor:bristol", "drug:nivolumab", 1),
        ("sponsor:merck", "drug:lenvatinib", 1),
    ]
    assert nodes(graph)[0] == ("sponsor:merck", "Merck", "sponsor", 2)
    first = graph.edges.first()
    assert first["source_ids"] == [nct(1), nct(2)]
    sponsor, pembro = first["citations"]
    assert (sponsor["matched_value"], sponsor["value"], sponsor["is_array"]) == ("Merck", ["Merck"], False)
    assert (pembro["matched_value"], pembro["value"], pembro["excerpt"]) == ("Pembrolizumab", ["Pembrolizumab"], "One")
    summary = graph.summary.first()
    assert (summary["distinct_trials"], summary["n_nodes"], summary["n_edges"], summary["weight1_percent"]) == (4, 5, 3, 67)


def test_drug_drug_weights_and_prune(study_table):
    trials = study_table([trial(1, "A", "B"), trial(2, "A", "B", "A"), trial(3, "B", "C")])
    pruned = build_network(trials, "drug_drug", min_edge_weight=2)
    assert edges(pruned) == [("drug:a", "drug:b", 2)] and pruned.summary.first()["pruned_edges"] == 1
    assert edges(build_network(trials, "drug_drug")) == [("drug:a", "drug:b", 2), ("drug:b", "drug:c", 1)]


def test_only_named_non_placebo_drugs(study_table):
    trials = study_table(
        [trial(i, "A", "B", "Placebo tablet", drug("C", ["placebo comparator"]), drug("D", kind="DEVICE"), drug(None), drug("  "), drug("E", kind=None)) for i in range(2)]
    )
    assert edges(build_network(trials, "drug_drug")) == [("drug:a", "drug:b", 2)]


def test_corroborated_alias_merges(study_table):
    trials = study_table(
        [
            trial(1, drug("Keytruda", ["pembrolizumab"]), "X"),
            trial(2, drug("Keytruda", ["Pembrolizumab", "MK-3475"]), "X"),
            trial(3, "pembrolizumab", "X"),
            trial(4, drug("Pembrolizumab", ["MK-3475"]), "X"),
        ]
    )
    graph = build_network(trials, "drug_drug")
    assert edges(graph) == [("drug:keytruda", "drug:x", 4)]
    # Keytruda is named twice, the two spellings of the generic once each.
    assert ("drug:keytruda", "Keytruda", "drug", 1) in nodes(graph)


def pairs(study_table, *rows):
    return [(r["a"], r["b"]) for r in alias_pairs(drug_mentions(study_table(list(rows)))).collect()]


def test_what_does_not_merge(study_table):
    one = [trial(1, drug("Brand", ["generic"])), trial(2, "generic")]
    assert pairs(study_table, *one) == []
    assert pairs(study_table, *one, trial(3, drug("generic", ["Brand"]))) == [("brand", "generic")]
    # The same trial twice over is one trial.
    assert pairs(study_table, trial(1, drug("Brand", ["generic"]), drug("generic", ["Brand"]))) == []
    shared = [trial(i, drug("A", ["CODE-1"]), drug("B", ["CODE-1"])) for i in range(3)]
    assert pairs(study_table, *shared) == []
    combos = [trial(i, drug("A + B", ["A"]), drug("A")) for i in range(3)]
    assert pairs(study_table, *combos) == []
    regimens = [trial(i, drug("FOLFOX", ["A", "B"]), drug("A"), drug("B")) for i in range(3)]
    assert pairs(study_table, *regimens) == []


def test_label_is_the_most_frequent_then_first(study_table):
    trials = study_table([trial(1, "nab-paclitaxel", "Z"), trial(2, "Nab paclitaxel", "Z"), trial(3, "Nab paclitaxel", "z")])
    got = {n[0]: n[1] for n in nodes(build_network(trials, "drug_drug"))}
    assert got == {"drug:nab-paclitaxel": "Nab paclitaxel", "drug:z": "Z"}


def test_basket_guard_is_counted(study_table):
    basket = trial(9, *[f"D{i}" for i in range(26)])
    trials = study_table([trial(1, "D0", "D1"), trial(2, "D0", "D1"), basket])
    graph = build_network(trials, "drug_drug", max_drugs_per_trial=25)
    assert edges(graph) == [("drug:d0", "drug:d1", 2)]
    assert graph.summary.first()["skipped_trials"] == 1
    wide = build_network(trials, "drug_drug")
    assert len(edges(wide)) == 325 and wide.summary.first()["skipped_trials"] == 0


def test_node_cap_recomputes_degree(study_table):
    star = [trial(i * 10 + j, "Hub", f"Leaf{i}") for i in range(5) for j in range(2)]
    graph = build_network(study_table(star), "drug_drug", max_nodes=3)
    assert nodes(graph) == [
        ("drug:hub", "Hub", "drug", 2), ("drug:leaf0", "Leaf0", "drug", 1), ("drug:leaf1", "Leaf1", "drug", 1),
    ]
    summary = graph.summary.first()
    assert (summary["n_edges"], summary["dropped_nodes"], summary["dropped_edges"]) == (2, 3, 3)


def test_merged_names_are_joined_where_a_map_would_be_large(study_table, monkeypatch):
    trials = study_table([trial(i, drug("A", ["B"]), "C") for i in range(3)] + [trial(9, "B", "C")])
    mapped = edges(build_network(trials, "drug_drug"))
    monkeypatch.setattr(network, "MAP_ROWS", 0)
    assert edges(build_network(trials, "drug_drug")) == mapped == [("drug:a", "drug:c", 4)]


def test_unique_trials_are_not_regrouped(study_table):
    trials = study_table([trial(1, "A", "B"), trial(2, "A", "B")])
    mentions = network.drug_mentions(trials)
    resolved = network.trial_drugs(trials, (mentions.select("key", F.col("key").alias("root")).limit(0), 0))
    assert "Exchange" not in resolved._jdf.queryExecution().optimizedPlan().toString() and "Aggregate" not in resolved._jdf.queryExecution().optimizedPlan().toString()


def test_degenerate_graph_has_a_fallback(study_table):
    trials = study_table([trial(i, "Lonafarnib 50 mg" if i % 2 else "Lonafarnib", title=f"T{i}") for i in range(30)] + [trial(40, "Other drug"), trial(41)])
    graph = build_network(trials, "drug_drug")
    assert graph.summary.first()["degenerate"] and edges(graph) == []
    bars = graph.fallback.collect()
    assert [(r["value"], r["count_trials"]) for r in bars] == [("Lonafarnib", 30), ("Other drug", 1)]
    assert bars[0]["citations"][1]["matched_value"] == "Lonafarnib 50 mg" and bars[0]["citations_truncated"]
    assert not bars[0]["buckets_truncated"] and (bars[0]["drugs_total"], bars[0]["trials_total"]) == (2, 31)
    top = graph.frequencies(1).collect()
    assert [(r["value"], r["buckets_truncated"], r["drugs_total"]) for r in top] == [("Lonafarnib", True, 2)]
    nothing = build_network(study_table([trial(1, drug("x", kind="DEVICE"))]), "drug_drug")
    assert nothing.fallback.count() == 0 and nothing.summary.first()["degenerate"]


def test_unknown_kind(study_table):
    with pytest.raises(ValueError):
        build_network(study_table([]), "drug_sponsor")


def test_names_without_latin_letters_stay_apart(study_table):
    trials = study_table([trial(i, "阿司匹林", "布洛芬") for i in range(2)])
    graph = build_network(trials, "drug_drug")
    assert [n[1] for n in sorted(nodes(graph), key=lambda n: n[1])] == ["布洛芬", "阿司匹林"]


def test_repeated_rows_count_once(study_table):
    rows = [trial(1, "A", "B"), trial(1, "A", "B"), trial(2, "A", "B"), {"interventions": [drug("A"), drug("B")]}]
    assert edges(build_network(study_table(rows), "drug_drug")) == [("drug:a", "drug:b", 2)]


def test_hot_drug_against_brute_force(study_table):
    """One drug is in most trials; weights, labels and samples stay exact."""
    rng = random.Random(3)
    rows, ids = [], defaultdict(list)
    for i in range(1200):
        chosen = sorted({"Hot"} | {f"D{rng.randint(0, 15)}" for _ in range(rng.randint(0, 3))})
        rows.append(trial(i, *chosen))
        for pair in combinations(sorted(c.lower() for c in chosen), 2):
            ids[pair].append(nct(i))
    graph = build_network(study_table(rows, 6), "drug_drug", unique_ids=True)
    got = {(r["source"][5:], r["target"][5:]): (r["weight"], r["source_ids"]) for r in graph.edges.collect()}
    assert got == {p: (len(v), v[:20]) for p, v in ids.items() if len(v) >= 2}
    degree = Counter(end for p, v in ids.items() if len(v) >= 2 for end in p)
    assert {n[0][5:]: n[3] for n in nodes(graph)} == dict(degree)


def roots(spark, links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent if find(x) != x}


@pytest.mark.parametrize("seed", [0, 1])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}") for _ in range(45)]
    links += [(f"chain{i:02d}", f"chain{i + 1:02d}") for i in range(25)]
    links += [("hub", f"spoke{i}") for i in range(30)]
    rng.shuffle(links)
    table, count = connected_components(spark.createDataFrame(links, "a string, b string"))
    want = roots(spark, links)
    assert {r["key"]: r["root"] for r in table.collect()} == want
    assert count == len(want)


@pytest.mark.parametrize("seed", range(3))
def test_batches_of_links_give_the_components_of_all(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(50)] + [(i, i + 1) for i in range(100, 112)]
    rng.shuffle(links)
    stars, _ = connected_components(spark.createDataFrame(links[:20], "a int, b int"))
    for i in (20, 35, 50):
        batch = links[i : i + 15] + links[:2]  # known links come again
        stars, count = merge_components(stars, spark.createDataFrame(batch, "a int, b int"))
        full, _ = connected_components(spark.createDataFrame(links[: i + 15], "a int, b int"))
        got = sorted(tuple(r) for r in stars.collect())
        assert got == sorted(tuple(r) for r in full.collect()) and count == len(got)
    same, count = merge_components(stars, spark.createDataFrame([], "a int, b int"))
    assert sorted(tuple(r) for r in same.collect()) == got and count == len(got)


def test_no_components(spark):
    table, count = connected_components(spark.createDataFrame([("x", "x")], "a string, b string"))
    assert (table.count(), count) == (0, 0)


@pytest.mark.parametrize("crowded", [1 << 16, 20])
def test_samples_of_hot_edges_end_at_a_cut(study_table, monkeypatch, crowded):
    """Links beyond the cut are dropped before the shuffle; where ids lie close together a window limits them."""
    monkeypatch.setattr(evidence, "_CUT_SAMPLE", 300)
    monkeypatch.setattr(network, "EDGE_IDS", crowded)
    rng = random.Random(8)
    rows, ids = [], defaultdict(list)
    for i in range(900):
        late = {"Late"} if i > 850 else set()  # a drug of the last ids only
        chosen = sorted({"Hot", "Warm"} | late | ({f"D{rng.randint(0, 9)}"} if rng.random() < 0.3 else set()))
        rows.append(trial(i, *chosen))
        for pair in combinations(sorted(c.lower() for c in chosen), 2):
            ids[pair].append(nct(i))
    graph = build_network(study_table(rows, 4), "drug_drug", unique_ids=True, evidence_limit=3)
    marked = {(r["source"][5:], r["target"][5:]): (r["until"], r["below"]) for r in graph.weights.collect()}
    assert marked["hot", "warm"][0] is not None and marked["hot", "warm"][1] < 60
    assert (marked["hot", "late"][1] > 20) == (len(ids["hot", "late"]) > 20)
    got = {(r["source"][5:], r["target"][5:]): (r["weight"], r["source_ids"]) for r in graph.edges.collect()}
    assert got == {p: (len(v), v[:3]) for p, v in ids.items()}


def test_links_are_not_sorted(study_table):
    rows = [trial(i, "A", "B", "C") for i in range(60)]
    graph = build_network(study_table(rows), "drug_drug", unique_ids=True, evidence_limit=2)
    plan = graph._sampled_ids(False)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and not any(node in plan for node in ("Window", "Sort ", "SortAggregate"))


def test_cuts_of_few_and_no_ids(spark):
    ids = spark.createDataFrame([(nct(i),) for i in range(50)], "nct_id string")
    assert evidence.id_cuts(ids, 3) == [nct(2), nct(11), nct(47)]
    assert evidence.id_cuts(ids.limit(0), 3) == []


def test_labels_and_first_rows_are_not_sort_aggregated(study_table):
    trials = study_table([trial(i, "A", "B", sponsor="Acme") for i in range(9)])
    mentions = drug_mentions(trials)
    for table in (mentions, network.drug_labels(mentions, (mentions, 0)), network.sponsor_labels(trials)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_first_mentions_are_ordered_by_id_then_place(spark):
    rows = [("NCT00000001", 9), ("NCT00000002", 0), ("NCT000000019", 0), ("NCT0000000001", 1), ("A", 5), ("A", 2_000_000), ("é", 1)]
    number = network.first_seen(F.col("i"), F.col("p"))
    got = spark.createDataFrame(rows, "i string, p int").select("i", "p", number.alias("n")).collect()
    assert [(r.i, r.p) for r in sorted(got, key=lambda r: r.n)] == sorted(rows, key=lambda r: (r[0].encode(), r[1]))


def _names_of_all_kinds(study_table):
    return study_table([
        trial(1, " Aspirin 10 mg", drug("B", ["A2"]), drug("C", ["placebo arm"]), sponsor="Acme Inc.", title="T1"),
        trial(2, "aspirin", "Placebo aspirin", drug("B", [None, ""]), drug("  "), drug(None), drug("D", kind="DEVICE"), sponsor=" Acme"),
        trial(3, drug("B", ["A2"]), "A2", "ASPIRIN tablets", sponsor="  "),
        trial(4, "a2", "C", "Ａ", sponsor="雪"),
        trial(5, drug("A2", []), "Standard of Care", "B", "b", sponsor=None),
        {"nct_id": nct(6), "interventions": None},
        {"nct_id": None, "interventions": [drug("Aspirin")], "sponsor_name": "Acme"},
    ])


def _all_of(graph):
    drugs = {r["nct_id"]: (r["names"], sorted(map(tuple, r["drugs"]))) for r in graph.resolved.collect()}
    return drugs, [tuple(map(str, r)) for r in graph.edges.collect()], nodes(graph)


@pytest.mark.parametrize("kind", network.KINDS)
def test_ids_looked_up_are_those_made_in_the_record(study_table, monkeypatch, kind):
    trials = _names_of_all_kinds(study_table)
    looked_up = _all_of(build_network(trials, kind))
    monkeypatch.setattr(network, "NAME_ROWS", 0)
    assert _all_of(build_network(trials, kind)) == looked_up
    monkeypatch.setattr(network, "MAP_ROWS", 0)
    assert _all_of(build_network(trials, kind)) == looked_up
    assert looked_up[0][nct(1)] == (["Aspirin 10 mg", "B"], [("drug:a2", "B"), ("drug:aspirin", "Aspirin 10 mg")])


def test_names_are_made_keys_once_not_per_trial(study_table):
    """No pattern is tried on a trial's own names: sponsor ids are stored, drug ids are looked up."""
    trials = _names_of_all_kinds(study_table)
    graph = build_network(trials, "sponsor_drug")
    joined = graph.links.join(graph.weights, ["source", "target"])
    mentions = drug_mentions(trials)
    resolved = network.trial_drugs(trials, graph.components, graph.mentions)
    for table in (joined, resolved):
        assert "regexp_replace" not in table._jdf.queryExecution().optimizedPlan().toString()
    # The last of the plan is what lies below the reduction of the raw names.
    below = mentions._jdf.queryExecution().optimizedPlan().toString().split("count(1) AS mentions")
    assert len(below) == 3 and "placebo" in below[1] and "placebo" not in below[2]


@pytest.mark.parametrize("kind", network.KINDS)
def test_a_graph_without_citations_has_the_same_nodes_and_summary(study_table, monkeypatch, kind):
    trials = _names_of_all_kinds(study_table)
    options = {"unique_ids": True, "max_drugs_per_trial": 2}
    cited = build_network(trials, kind, **options)
    for maps in (True, False):
        bare = build_network(trials.drop("brief_title"), kind, cited=False, **options)
        assert nodes(bare) == nodes(cited) and bare.summary.collect() == cited.summary.collect()
        assert {"names", "drugs", "brief_title"}.isdisjoint(bare.resolved.columns)
        with pytest.raises(ValueError):
            bare.edges
        monkeypatch.setattr(network, "NAME_ROWS", 0)


def test_no_row_holds_a_copy_of_the_id_maps(study_table):
    trials = _names_of_all_kinds(study_table)
    graph = build_network(trials, "drug_drug")
    raw = network._all_raw_mentions(trials)
    for given in (None, raw):
        plan = network.trial_drugs(trials, graph.components, graph.mentions, given)._jdf.queryExecution().optimizedPlan().toString()
        # Lines of the subquery itself begin with a colon.
        outer = [line for line in plan.splitlines() if not line.lstrip().startswith(":")]
        assert "AS maps" not in "".join(outer) and any("scalar-subquery" in line for line in outer)


def _coded(trials):
    """The trials with codes in place of their interventions, and the codes."""
    listed = trials.select("nct_id", "sponsor_name", F.explode_outer("interventions").alias("item"))
    items = network.item_codes(listed.select("item").filter("item IS NOT NULL").distinct())
    lists = listed.join(items, "item", "left").groupBy("nct_id", "sponsor_name").agg(F.sort_array(F.collect_set("code")).alias("interventions"))
    return lists, items


@pytest.mark.parametrize("kind", network.KINDS)
def test_codes_give_the_graph_of_the_texts(study_table, monkeypatch, kind):
    trials = _names_of_all_kinds(study_table)
    # As lists of codes are: sorted sets.
    trials = trials.withColumn("interventions", F.sort_array(F.array_distinct(F.filter("interventions", lambda x: x.isNotNull()))))
    options = {"cited": False, "unique_ids": True, "max_drugs_per_trial": 2}
    texts = build_network(trials, kind, **options)
    for _ in ("listed", "joined"):
        coded, items = _coded(trials)
        graph = build_network(coded, kind, items=items, **options)
        assert nodes(graph) == nodes(texts) and graph.summary.collect() == texts.summary.collect()
        monkeypatch.setattr(network, "NAME_ROWS", 0)
    with pytest.raises(ValueError):
        build_network(coded, kind, items=items)


def test_codes_order_as_their_items_and_number_drug_names(spark):
    drugs = [drug("B"), drug("A", ["x"]), drug("A"), drug("Placebo"), drug("A", ["placebo"]), drug("C", kind="DEVICE"), drug(None)]
    rows = [((d[0], d[1], d[2]),) for d in drugs]
    items = spark.createDataFrame(rows, "item struct<type: string, name: string, otherNames: array<string>>").repartition(4)
    codes = network.item_codes(items).collect()
    by_item = sorted(codes, key=lambda r: r["code"]["item"])
    assert [r["item"] for r in by_item] == [r["item"] for r in items.orderBy("item").collect()]
    assert {(r["item"]["name"], tuple(r["item"]["otherNames"] or ())): r["code"]["name"] for r in codes if r["code"]["name"] is not None} == {
        ("A", ()): 0, ("A", ("x",)): 0, ("B", ()): 1
    }
