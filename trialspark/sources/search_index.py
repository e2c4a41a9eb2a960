"""A stored trigram index for literal substring search.

A text that contains a needle contains all of its three-letter parts, so the
trials whose texts have all of them are the only candidates; the exact test
follows on those. Texts repeat over trials, and most trials have one of their
own. So the distinct texts are kept in blocks of sorted texts, and there are three
kinds of lists: from a trigram to the blocks that have it, from a block to its
texts, and from a text to the trials that hold it. A search tells the trigrams
of a text from the text itself, in the blocks that have any. The lists of one
column serve every area it belongs to. Trigrams are sorted, so a search reads the
row groups of its own. A needle of fewer than three letters has no trigram and
scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trialspark.operators.filters import SEARCH_COLUMNS, filter_trials, search_area
from trialspark.session import broadcast_if_small, cut_lineage, shuffles_dropped

GRAM = 3
# Trigrams of a needle that one number can mark.
_MARKS = 60
# A block has two to this power of texts.
_BLOCK_BITS = 10


def _texts(column: str) -> Column:
    """All texts of a column, as one list."""
    none = F.array().cast("array<string>")
    if column == "interventions":
        others = F.flatten(F.filter("interventions.otherNames", lambda o: o.isNotNull()))
        listed = F.concat(F.coalesce("interventions.name", none), F.coalesce(others, none))
    else:
        listed = F.coalesce(column, none) if column in ("conditions", "countries_raw") else F.array(column)
    return F.filter(listed, lambda t: t.isNotNull())


def grams(text: Column) -> Column:
    """The three-letter parts of a lower-cased text, in order; null for a shorter one."""
    low = F.lower(text)
    starts = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - GRAM + 1))
    return F.transform(starts, lambda i: F.substring(low, i, GRAM))


def needle_grams(needle: str) -> list[str]:
    low = needle.lower()
    return sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})


def _lowered(trials: DataFrame, column: str) -> DataFrame:
    """(``nct_id``, ``low``) of the distinct lower-cased texts of a column in each trial."""
    lists = F.array_distinct(F.transform(_texts(column), F.lower))
    return trials.filter(F.col("nct_id").isNotNull()).select("nct_id", F.explode(lists).alias("low"))


def build_search_index(trials: DataFrame, path: str, areas: tuple[str, ...] = tuple(SEARCH_COLUMNS), partitions: int | None = None) -> DataFrame:
    """Write the lists of every column of the areas to ``path`` and return them.

    ``kind`` tells the lists apart: ``grams`` (``gram``, ``block``), ``texts``
    (``block``, ``text``, ``low``) and ``trials`` (``text``, ``nct_id``), ``area``
    is the column. ``text`` is a hash of column and text: texts that share one give
    more candidates, never fewer. Only distinct texts, and distinct trigrams of blocks, are
    shuffled: the lists of trials lie as the trials do. Trigrams are placed by
    trigram, and one that most blocks have is split over tasks by its measured
    size. Rows without an id are not indexed. ``trials`` is read twice.
    """
    spark, columns = trials.sparkSession, dict.fromkeys(c for area in areas for c in SEARCH_COLUMNS[area])
    with shuffles_dropped(spark):
        for column in columns:
            text = F.xxhash64(F.lit(column), "low").alias("text")
            _lowered(trials, column).select(text, "nct_id").write.parquet(f"{path}/kind=trials/area={column}")
        lows = reduce(DataFrame.unionByName, [_lowered(trials, c).select(F.lit(c).alias("area"), "low") for c in columns])
        block = F.shiftrightunsigned(F.monotonically_increasing_id(), _BLOCK_BITS).alias("block")
        ordered = lows.distinct().sortWithinPartitions("area", "low")
        ordered.select("area", block, F.xxhash64("area", "low").alias("text"), "low").write.partitionBy("area").parquet(f"{path}/kind=texts")
        texts = _read(spark, path).filter("kind = 'texts'")
        by_gram = texts.select("area", "block", F.explode(grams(F.col("low"))).alias("gram")).distinct()
        placed = by_gram.hint("rebalance", *([partitions] if partitions else []), F.col("area"), F.col("gram"))
        placed.sortWithinPartitions("area", "gram").write.partitionBy("area").parquet(f"{path}/kind=grams")
    return _read(spark, path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind string, area string, gram string, block long, text long, low string, nct_id string").parquet(path)


def candidates(index: DataFrame, area: str, needle: str) -> DataFrame | None:
    """The trials whose texts have all trigrams of the needle; none for a needle without any.

    A text, and then a trial, is marked with the trigrams it has: one bit each.
    """
    wanted = needle_grams(needle)
    if not wanted:
        return None
    own = index.filter(F.col("area").isin(*SEARCH_COLUMNS[search_area(area)]))
    parts = [wanted[i : i + _MARKS] for i in range(0, len(wanted), _MARKS)]
    bits = [reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.contains("low", F.lit(g)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, g in enumerate(part)]) for part in parts]
    names = [f"marks{i}" for i in range(len(parts))]
    blocks = own.filter((F.col("kind") == "grams") & F.col("gram").isin(wanted)).select("area", "block").distinct()
    listed = broadcast_if_small(blocks, blocks.count()).join(own.filter(F.col("kind") == "texts").select("area", "block", "text", "low"), ["area", "block"])
    some = reduce(lambda a, b: a | b, [F.col(n) != 0 for n in names])
    texts = listed.select("text", *[b.alias(n) for b, n in zip(bits, names, strict=True)]).filter(some)
    held = own.filter(F.col("kind") == "trials").select("text", "nct_id")
    met = broadcast_if_small(texts, texts.count()).join(held, "text").groupBy("nct_id").agg(*[F.bit_or(n).alias(n) for n in names])
    full = [F.col(n) == F.lit((1 << len(part)) - 1) for n, part in zip(names, parts, strict=True)]
    return met.filter(reduce(lambda a, b: a & b, full)).select("nct_id")


def search_trials(index: DataFrame, trials: DataFrame, search: dict[str, str], filters: dict | None = None) -> DataFrame:
    """The rows of :func:`filter_trials`, from the candidates of the index only.

    Trials must be indexed. Few candidates are broadcast to the scan; many meet
    it in a join, which a bucketed table does without a shuffle.
    """
    for area, needle in search.items():
        few = candidates(index, area, needle) if needle else None
        if few is not None:
            few = cut_lineage(few, "candidates")
            trials = trials.join(broadcast_if_small(few, few.count()), "nct_id", "left_semi")
    return filter_trials(trials, filters, search)
