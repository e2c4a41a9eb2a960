"""Repeated word windows by level-wise doubling.

A word is removed if a window of ``window`` words that covers it also starts in
a document with a smaller id. Lengths double up to the window (for 50 words: 12,
25, 50), and only what repeats at one length is looked at in the next:

1. Of each window, one subwindow of the smallest length is taken, chosen by its
   content (``anchors``), so equal windows take equal ones; consecutive windows
   mostly take the same and go together as a fragment. Fragments whose subwindow
   is in one document only are done. Equal fragments are one class: all copies
   but those of its smallest document are removed whole.
2. The subwindow is extended to twice its length inside the window, to the right
   where there is room and to the left otherwise, again by a rule on the window
   alone. What is in one document only is done. This repeats up to the window.
3. At full length each window is kept with the smallest document it starts in.

Hot groups: every level counts with map-side aggregation; a group of copies is
one class, and no window's occurrences are ever brought into one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trialspark.llm.anchors import fragments, span_marks, version, with_spans
from trialspark.llm.batches import RollingHash, Words, chunks, signed, sliding_argmin, span_lists, text_bytes
from trialspark.session import cut_lineage

WINDOW = 50
SHORTEST = 10

_FOUND = "doc_id long, v int, s int, n int, k long, f long"


def lengths(window: int) -> list[int]:
    """The window and its halves down to ``SHORTEST`` words, shortest first."""
    out = [window]
    while out[0] // 2 >= SHORTEST:
        out.insert(0, out[0] // 2)
    return out


def doubling_dedup(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``) per row of ``docs``.

    Words are runs of other bytes than ``\\x20`` and ``\\x09-\\x0D``, unchanged;
    the digest is over the kept words joined by one space. A null or empty text
    has no words; a text shorter than the window keeps all. Repeated rows share a
    ``doc_id``, so none of them is the smaller one: each keeps its words, and
    each is a row of the result. A row without a ``doc_id`` takes no part.
    Other columns of ``docs`` are ignored, whatever their names.
    """
    text = F.col(text_column).cast("string")
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), version(text).alias("v"), text.alias("text"))
    marked = with_spans(docs, repeated_windows(docs, window)).select("doc_id", "text", "spans")
    return marked.mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(``doc_id``, ``v``, ``s``, ``e``): word ranges of windows seen in a smaller document."""
    docs = docs.filter("doc_id IS NOT NULL")
    levels = lengths(window)
    found = docs.mapInArrow(_fragments(window, levels[0]), _FOUND)
    # Stored keys: both sides of these joins are then plain shuffles, which AQE splits where a key is hot.
    found = cut_lineage(found.join(cut_lineage(_in_two(found, "k"), "repeated"), "k", "left_semi"), "fragments")
    first = cut_lineage(found.groupBy("k", "f").agg(F.min("doc_id").alias("first")), "classes")
    placed = cut_lineage(found.join(first, ["k", "f"]), "placed")
    whole = placed.filter("doc_id > first").select("doc_id", "v", "s", (F.col("s") + F.col("n") + F.lit(window - 1)).alias("e"))
    # One document's fragment stands for its class where classes of one anchor differ.
    mixed = first.groupBy("k").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("k")
    open_rows = placed.filter("doc_id = first").join(mixed, "k", "left_semi")
    lists = open_rows.groupBy("doc_id", "v").agg(F.collect_list(F.struct("s", "n")).alias("wanted"))
    grown = docs.join(lists, ["doc_id", "v"]).select("doc_id", "v", "text", "wanted")
    middle = range(1, max(1, len(levels) - 1))
    schema = ", ".join(["doc_id long", "v int", "s int", "h array<long>", *(f"k{i} long" for i in middle)])
    grown = cut_lineage(grown.mapInArrow(_grown(window, levels), schema), "grown")
    for i in middle:
        grown = grown.join(_in_two(grown, f"k{i}"), f"k{i}", "left_semi")
    windows = grown.select("doc_id", "v", "s", F.posexplode("h").alias("i", "h"))
    smallest = windows.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("h", "first")
    single = windows.join(smallest, "h").filter("doc_id > first")
    single = single.select("doc_id", "v", (F.col("s") + F.col("i")).alias("s"), (F.col("s") + F.col("i") + F.lit(window)).alias("e"))
    return whole.unionByName(single)


def _in_two(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur in two documents at least."""
    return rows.groupBy(key).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select(key)


def _fragments(window: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch, "text"):
                words = Words(data, at)
                row, start, windows, k, f = fragments(words.hashes(), words.rows, window, shortest)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(take), part.column("v").take(take), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), signed(k), signed(f)],
                    ["doc_id", "v", "s", "n", "k", "f"],
                )

    return run


def _grown(window: int, levels: list[int]):
    """The wanted fragments, split where their extensions differ, with the hash of each window.

    At each middle length a window takes the subwindow of that length that holds
    the one before: starting with it if that ends inside the window, else ending
    with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch, "text"):
                words = Words(data, at)
                values = words.hashes()
                rolling = RollingHash(values)
                lists = part.column("wanted")
                count = np.diff(lists.offsets.to_numpy())
                inner = lists.flatten()
                row = np.repeat(np.arange(part.num_rows), count)
                start, n = inner.field("s").to_numpy(), inner.field("n").to_numpy()
                short = levels[0]
                grams = rolling.of(np.arange(len(values) - short + 1), np.arange(short, len(values) + 1))
                chosen = sliding_argmin(grams, window - short + 1)
                piece = np.repeat(np.arange(len(n)), n)
                p = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n) + (start + words.rows[row])[piece]
                a = chosen[p]
                keys = []
                for before, length in zip(levels[:-2], levels[1:-1], strict=True):
                    a = np.where(a + length <= p + window, a, a + before - length)
                    keys.append(rolling.of(a, a + length))
                new = np.append(True, piece[1:] != piece[:-1]) if len(piece) else np.zeros(0, bool)
                for key in keys:
                    new[1:] |= key[1:] != key[:-1]
                heads = np.flatnonzero(new)
                offsets = pa.array(np.append(heads, len(piece)).astype(np.int32))
                owner = row[piece[heads]]
                take = pa.array(owner)
                h = pa.ListArray.from_arrays(offsets, signed(rolling.of(p, p + window)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(take), part.column("v").take(take), pa.array((p[heads] - words.rows[owner]).astype(np.int32)), h, *(signed(key[heads]) for key in keys)],
                    ["doc_id", "v", "s", "h", *(f"k{i + 1}" for i in range(len(keys)))],
                )

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = text_bytes(batch.column("text"))
        n_words, n_removed, sha = [], [], []
        for i, spans in enumerate(span_lists(batch)):
            kept = data[at[i] : at[i + 1]].tobytes().split()
            gone = span_marks(spans, len(kept))
            n_words.append(len(kept))
            n_removed.append(int(gone.sum()))
            if n_removed[-1]:
                kept = [w for w, g in zip(kept, gone.tolist(), strict=True) if not g]
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])
