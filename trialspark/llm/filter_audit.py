"""Interaction of quality filters: what each filter removes in every order of application.

The exact-copy filter is an existential self-join: a left-semi join on the text's
hash, the exact text and a smaller ``doc_id`` marks a document as a copy. Its ids
are united with the ids and failure bits of the other filters, and the table
collapses to counts of bit combinations, from which every order of the filters
follows by arithmetic: no order reads the documents again.

Only texts whose hash occurs with two or more ids enter the self-join, and its
right side is reduced to the smallest id of each text. Hashes that hold more
than one in ``HOT`` of all rows (so at most ``HOT`` of them) are dealt over
slices by ``doc_id``; every slice meets its own copy of the right side.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from trialspark.session import broadcast_if_small, cut_lineage

FILTERS = "ABCDE"
COPY = FILTERS.index("E")
# A hash with more than this share of all rows (one in HOT) is dealt over slices.
HOT = 1024
_WORD = r"[^\x20\x09-\x0D]+"
_ORDERS = ["".join(p) for p in permutations(FILTERS)]


def bits(letters: str) -> int:
    return sum(1 << FILTERS.index(x) for x in letters)


def failures(text: Column) -> list[Column]:
    """Whether a text fails the filters A to D."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    n = F.size(words)
    return [
        n < 100,
        100 * F.size(F.array_distinct(words)).cast("long") < 80 * n.cast("long"),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]


def filter_interactions(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang", label_id: str = "doc_id", good_column: str = "quality", toxic_column: str = "toxic") -> DataFrame:
    """One row per part, filter order and step, zeros included.

    ``part`` is the value of ``part_column``, null being the empty string; every
    part of ``docs`` has its 600 rows, an empty table none. Columns are ``kept``,
    ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost``
    and ``shapley``: the number of documents of the part that the step's filter
    removes, summed over all orders.

    A null text counts as an empty one, and is a copy of another empty one. Each
    row is one document: of repeated rows with one ``doc_id`` none is a copy of
    the other, and a row without a ``doc_id`` is nobody's copy, as nothing
    compares with a missing id; both are counted. A document with several label
    rows is good, or toxic, if one of them says so. Other columns are ignored,
    whatever their names.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    mask = reduce(add, [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(failures(F.col("text")))])
    facts = cut_lineage(rows.select("doc_id", "part", F.xxhash64("text").alias("h"), mask.alias("mask")), "filter-bits")
    failed = facts.withColumn("n", F.lit(1))
    copies = copied(rows, facts).withColumn("mask", F.lit(1 << COPY)).withColumn("n", F.lit(0))
    # A document is known by its id and its text's hash: its bits meet there, and each of its rows counts.
    united = failed.unionByName(copies).groupBy("doc_id", "h", "part").agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"))
    known = labels.groupBy(F.col(label_id).cast("long").alias("of")).agg(
        F.max((F.col(good_column) == 1).cast("int")).alias("good"), F.max((F.col(toxic_column) == 1).cast("int")).alias("toxic")
    )
    # Rows without an id match no label; the second key keeps them from meeting in one task.
    spread = F.when(F.col("doc_id").isNull(), F.col("h")).otherwise(0)
    judged = united.withColumn("spread", spread).join(known.withColumn("zero", F.lit(0).cast("long")), (F.col("doc_id") == F.col("of")) & (F.col("spread") == F.col("zero")), "left")
    counts = judged.groupBy("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.sum("n").alias("n"))
    return _steps(counts)


def copied(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """(``doc_id``, ``h``, ``part``) of the rows whose exact text a smaller ``doc_id`` has too."""
    groups = facts.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    groups = cut_lineage(groups.filter("lo < hi").select("h", "n"), "repeated-hashes")
    least = max(1, facts.count() // HOT)
    sliced = groups.select("h", F.ceil(F.col("n") / least).cast("int").alias("slices"))
    each = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    size = groups.count()
    hot = F.broadcast(sliced.filter("slices > 1").withColumnRenamed("h", "hot"))  # at most HOT rows: each holds more than one in HOT
    keyed = rows.filter("doc_id IS NOT NULL").withColumn("h", F.xxhash64("text")).join(hot, F.col("h") == F.col("hot"), "left")
    keyed = keyed.select("doc_id", "part", "h", F.pmod(F.xxhash64("doc_id"), F.coalesce("slices", F.lit(1))).cast("int").alias("slice"), "text")
    wanted = broadcast_if_small(sliced.select("h", each.alias("slice")), size + HOT)
    left = cut_lineage(keyed.join(wanted, ["h", "slice"], "left_semi"), "repeated-texts")
    # The smallest id of each slice first: a hot text costs a row per slice.
    first = left.groupBy("h", "slice", "text").agg(F.min("doc_id").alias("first")).groupBy("h", "text").agg(F.min("first").alias("first"))
    right = first.join(broadcast_if_small(sliced, size), "h").select(F.col("h").alias("rh"), each.alias("rslice"), F.col("text").alias("rtext"), "first")
    same = (F.col("h") == F.col("rh")) & (F.col("slice") == F.col("rslice")) & (F.col("text") == F.col("rtext"))
    return left.join(right, same & (F.col("first") < F.col("doc_id")), "left_semi").select("doc_id", "h", "part")


def _steps(counts: DataFrame) -> DataFrame:
    """The table of orders from (``part``, ``mask``, ``good``, ``toxic``, ``n``), a row per bit combination.

    What a step does depends on its filter and on the set of filters before it,
    so 80 such cases are summed and then looked up by the 600 steps of all orders.
    """
    cases = [(1 << i, before) for i in range(len(FILTERS)) for before in range(1 << len(FILTERS)) if not before >> i & 1]
    case = F.explode(F.array(*[F.struct(F.lit(f).alias("own"), F.lit(b).alias("before")) for f, b in cases]))
    rows = counts.select("*", case.alias("case")).select("part", "mask", "good", "toxic", "n", "case.own", "case.before")
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    removed = fails & ~earlier

    def total(which: Column, of: Column | str = "n") -> Column:
        return F.sum(F.when(which, F.col(of) if isinstance(of, str) else of).otherwise(0)).cast("long")

    # A failing document is removed by its own filter in one of k parts of all orders, k filters failing it.
    share = F.col("n") * (F.lit(len(_ORDERS)) / F.greatest(F.bit_count("mask"), F.lit(1))).cast("long")
    sums = rows.groupBy("part", "own", "before").agg(
        total(~fails & ~earlier).alias("kept"), total(removed).alias("removed"), total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"), total(removed & (F.col("good") == 1)).alias("good_lost"),
        total(removed & (F.col("toxic") == 1)).alias("toxic_lost"), total(fails, share).alias("shapley"),
    )
    steps = [(order, step + 1, bits(letter), bits(order[:step])) for order in _ORDERS for step, letter in enumerate(order)]
    table = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, own int, before int")
    return sums.join(F.broadcast(table), ["own", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
