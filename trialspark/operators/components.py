"""Connected components of an undirected pair table, by alternating star steps.

The large-star / small-star method (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): rewire every edge towards the smallest neighbour
until each component is a star around its smallest key. Rounds grow with the
logarithm of the component size, so long chains stay cheap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trialspark.session import broadcast_if_small, cut_lineage


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, int]:
    """(``key``, ``root``) for every key that is not its own root, and the row count.

    The root is the smallest key of the component. The loop runs on the driver;
    the edges never leave the cluster.
    """
    edges = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = cut_lineage(edges, "edges")
    count, stars = _state(edges)
    while not stars:
        edges = cut_lineage(_small_star(_large_star(edges, count)), "edges")
        count, stars = _state(edges)
    return edges.select(F.col("u").alias("key"), F.col("v").alias("root")), count


def merge_components(stars: DataFrame, pairs: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, int]:
    """The (``key``, ``root``) table ``stars`` brought up to date with new ``pairs``, and the row count.

    New pairs are contracted through the roots they already have, so the search
    runs over the components they touch, each a single key. Only rows of
    components whose root changed are rewritten; a pair inside a component
    changes nothing. The result is that of a full run over all pairs so far.
    """
    new = cut_lineage(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "new-pairs")
    rooted = new
    for end in ("a", "b"):
        known = stars.select(F.col("key").alias(end), F.col("root").alias(f"{end}_root"))
        rooted = rooted.join(known, end, "left").withColumn(f"{end}_top", F.coalesce(f"{end}_root", end)).drop(f"{end}_root")
    moved, count = connected_components(rooted.select(F.col("a_top").alias("a"), F.col("b_top").alias("b")))
    moved = moved.select(F.col("key").alias("old"), F.col("root").alias("new"))
    # Roots and keys without a component are not rows of the table: those that moved become rows.
    moves = broadcast_if_small(moved, count)
    kept = stars.join(moves, stars["root"] == moves["old"], "left").select("key", F.coalesce("new", "root").alias("root"))
    merged = cut_lineage(kept.unionByName(moved.select(F.col("old").alias("key"), F.col("new").alias("root"))), "components")
    return merged, merged.count()


def _state(edges: DataFrame) -> tuple[int, bool]:
    """(number of edges, whether every component is a star around its smallest key).

    Edges point from the larger to the smaller key, so they form such stars
    exactly when a key with an edge of its own has only that one and receives none.
    """
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("u").alias("key"), F.lit(1).alias("own")),
        F.struct(F.col("v").alias("key"), F.lit(0).alias("own")),
    )))
    keys = ends.groupBy("key").agg(F.sum("own").alias("own"), F.count(F.lit(1)).alias("ends"))
    loose = (F.col("own") > 1) | ((F.col("own") == 1) & (F.col("ends") > 1))
    row = keys.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("n"), F.count_if(loose).alias("loose")).first()
    return row["n"], row["loose"] == 0


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    """Connect every larger neighbour of a key to the smallest key around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    joined = both.join(broadcast_if_small(smallest, 2 * count), "u")
    return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a key and its smaller neighbours to the smallest of them."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(smallest, "u")
    neighbours = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return neighbours.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()
