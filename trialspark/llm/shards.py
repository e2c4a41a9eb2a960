"""Shards of near equal bytes by sampled splitters.

Records are ordered by a key: a hash of the text, then the id, so equal texts
are neighbours. A sample of keys, drawn with probability proportional to size,
gives quantile boundaries; records are range-partitioned by them, and a range
that turns out overfull is subdivided by a sample of its own keys. Each range is
then walked once, in order, and a record's shard follows from the bytes in front
of it. A range holds a bounded number of rows, also when a group of equal texts
holds a third of all, because the id is part of the key. Only ids, sizes and
hashes are shuffled, never texts.

A group of equal texts is kept in one shard if it is at most ``WHOLE`` of a
shard, and is cut at the boundary otherwise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from trialspark.session import cut_lineage

SHARDS = 16
#: Largest group of equal texts, as a share of a shard, that is never cut.
WHOLE = 0.02
#: Ranges at least, rows of a range aimed at, and keys drawn for each range.
RANGES = 128
RANGE_ROWS = 4_000_000
DRAWN = 64
_ROUNDS = 8


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``) per row.

    The law is ``bytes``: shards hold nearly the same sum of sizes, a size being
    the text's UTF-8 bytes plus 1. ``slot`` numbers a shard's rows without gaps.
    A null text counts as no bytes (size 1), and its group is that of the empty
    text. Repeated rows are records of their own; among rows that are equal in
    id and text the order of slots is arbitrary. A null id sorts first.
    Other columns of ``docs`` are ignored.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"),
    )
    rows = cut_lineage(rows.withColumn("t", F.coalesce("doc_id", F.lit(-(1 << 63)))), "records")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(1)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    placed = rows.withColumn("r", _range_of(_cuts(rows, total["b"], total["n"]))("g", "t"))
    walk = Window.partitionBy("r").orderBy("g", "t")
    running = walk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = placed.withColumns({"ahead": F.sum("size").over(running) - F.col("size"), "place": F.row_number().over(walk) - 1})
    walked = walked.join(F.broadcast(_fronts(placed)), "r")  # a row for each range
    walked = walked.select("doc_id", "size", "text_crc32", "g", (F.col("ahead") + F.col("bytes_before")).alias("ahead"), (F.col("place") + F.col("rows_before")).alias("place"))
    walked = cut_lineage(walked, "walked")
    groups = walked.groupBy("g").agg(F.min("ahead").alias("start"), F.sum("size").alias("whole"))
    # The middle of a record, or of a group that stays whole, decides its shard.
    cut = F.col("whole") > WHOLE * total["b"] / shards
    at = F.when(cut, F.col("ahead") + F.col("size") / 2).otherwise(F.col("start") + F.col("whole") / 2)
    shard = F.least(F.floor(at * F.lit(shards) / F.lit(total["b"])), F.lit(shards - 1)).cast("int")
    sharded = walked.join(groups, "g").select("doc_id", "size", "text_crc32", "place", shard.alias("shard"))
    firsts = sharded.groupBy("shard").agg(F.min("place").alias("first"))
    sharded = sharded.join(F.broadcast(firsts), "shard")  # a row for each shard
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _fronts(placed: DataFrame) -> DataFrame:
    """Bytes and rows in front of each range, from one row per range."""
    held = placed.groupBy("r").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("r").collect()
    rows, before, count = [], 0, 0
    for x in held:
        rows.append((x["r"], before, count))
        before, count = before + x["b"], count + x["n"]
    return placed.sparkSession.createDataFrame(rows, "r int, bytes_before long, rows_before long")


def _cuts(rows: DataFrame, size: int, count: int) -> list[tuple[int, int]]:
    """Range boundaries (g, t), ascending, such that no range is overfull.

    A record weighs its share of the bytes and of the rows; keys are drawn in
    proportion to it. The first sample is over everything, later ones over
    overfull ranges only. A range of one repeated key cannot be subdivided.
    """
    ranges = max(RANGES, -(-count // RANGE_ROWS))
    weight = (F.col("size") / F.lit(float(size)) + F.lit(1.0 / max(count, 1))) / 2
    cuts: list[tuple[int, int]] = []
    heavy = rows
    for attempt in range(_ROUNDS):
        draw = F.pmod(F.xxhash64("g", "t", F.lit(attempt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        times = F.floor(weight * F.lit(ranges * DRAWN) + draw).cast("long")
        drawn = heavy.select("g", "t", times.alias("w")).filter("w > 0").groupBy("g", "t").agg(F.sum("w").alias("w"))
        seen = 0
        for g, t, w in sorted((x["g"], x["t"], x["w"]) for x in drawn.collect()):
            seen += w
            if seen >= DRAWN:
                cuts.append((g, t))
                seen = 0
        cuts = sorted(set(cuts))
        held = rows.withColumn("r", _range_of(cuts)("g", "t")).withColumn("w", weight)
        many = (F.min("g") < F.max("g")) | (F.min("t") < F.max("t"))
        over = held.groupBy("r").agg(F.sum("w").alias("w"), many.alias("many")).filter(F.col("many") & (F.col("w") > 4 / ranges))
        over = [x["r"] for x in over.select("r").collect()]
        if not over:
            break
        heavy = held.filter(F.col("r").isin(over))
    return cuts


def _range_of(cuts: list[tuple[int, int]]):
    """Column function: the number of boundaries at or before a record's key, by binary search."""
    gs = np.array([g for g, _ in cuts], np.int64)
    ts = np.array([t for _, t in cuts], np.int64)

    @F.pandas_udf("int")
    def number(g: pd.Series, t: pd.Series) -> pd.Series:
        low = np.searchsorted(gs, g, "left")
        high = np.searchsorted(gs, g, "right")
        for i in np.flatnonzero(low < high):  # a boundary inside the record's own group
            low[i] += np.searchsorted(ts[low[i] : high[i]], t.iloc[i], "right")
        return pd.Series(low.astype(np.int32))

    return number
