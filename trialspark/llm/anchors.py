"""Windows of a fixed length, grouped by an anchor that equal windows share.

The anchor of a window is the smallest hash among its shorter subwindows of
``anchor`` symbols. It depends on the window's content alone, so equal windows
have equal anchors, and consecutive windows mostly share one: a fragment is a
run of them, and stands for all its windows in a shuffle. Windows with an anchor
that occurs once cannot repeat.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from trialspark.llm.batches import RollingHash, sliding_argmin


def fragments(values: np.ndarray, rows: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(row, start, windows, anchor hash, fragment hash) of each fragment.

    ``values`` are the symbols of all rows, ``rows`` their offsets; ``start`` is
    relative to the row, and a fragment covers ``windows + window - 1`` symbols.
    """
    count = np.maximum(np.diff(rows) - window + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    if not len(row):
        return row, row, row, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    rolling = RollingHash(values)
    first = np.arange(len(values) - anchor + 1)
    grams = rolling.of(first, first + anchor)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    at = np.arange(len(row)) - begin[row] + rows[row]
    chosen = sliding_argmin(grams, window - anchor + 1)[at]
    new = np.ones(len(row), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    heads = np.flatnonzero(new)
    windows = np.diff(np.append(heads, len(row)))
    start = at[heads]
    return row[heads], start - rows[row[heads]], windows, grams[chosen[heads]], rolling.of(start, start + windows + window - 1)


def version(text: Column) -> Column:
    """Tells the texts of a repeated ``doc_id`` apart."""
    return F.coalesce(F.hash(text), F.lit(0))


def packed_rows(docs: DataFrame, text_column: str) -> DataFrame:
    """(``row``, ``text``): all other columns as one struct, so that no name can clash."""
    others = [docs[c] for c in docs.columns if c != text_column] or [F.lit(None).cast("int").alias("none")]
    return docs.select(F.struct(*others).alias("row"), docs[text_column].cast("string").alias("text"))


def unpacked_rows(packed: DataFrame, docs: DataFrame, text_column: str) -> DataFrame:
    """The columns of ``docs`` in their order, the text being the packed one."""
    return packed.select(*[(F.col("text") if c == text_column else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` (``doc_id``, ``v``, ``text``) with ``spans``, the ranges found in each text."""
    lists = spans.groupBy("doc_id", "v").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return docs.join(lists, ["doc_id", "v"], "left")


def span_marks(spans: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Which of ``n`` symbols lie in ranges ``s`` to ``e`` (not included)."""
    if not spans:
        return np.zeros(n, bool)
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, spans["s"], 1)
    np.add.at(steps, spans["e"], -1)
    return np.cumsum(steps[:n]) > 0
