"""Quality rules and an isolation forest on their statistics.

Base rules count words, symbols, repeated lines and repeated word windows on the
whole text. Ratios of these counts are the coordinates of a document in an
isolation forest (Liu, Ting and Zhou, 2008): random splits cut the box of all
labelled rows, and a document that ends on a short path lies where good rows are
rare. Trees are grown on good labelled rows; splits are drawn over the whole
box, not only over the rows in a node, so a region without any good row is cut
off early. The threshold is calibrated on labelled rows: at most ``LOSS`` of the
good ones that pass the base rules may be dropped.

Box and threshold come from all labelled rows; a tree grows on ``SUBSAMPLE`` of
the good ones, which is the method's own parameter, and every good row can be
drawn. Counts and scores cover every document. The forest is a few hundred
kilobytes, and is the only thing sent to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trialspark.llm.batches import RollingHash, Words, byte_values, chunks, mix
from trialspark.session import broadcast_if_small, cut_lineage

TREES = 128
SUBSAMPLE = 256
DEPTH = 10
LOSS = 0.005

_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_MARKS = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8))
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_AXES = ("chars", "symbols", "marks", "lines", "repeats", "upper")


def quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(``doc_id``, the base counts, ``base_failed``, ``kept``, ``score``) per row of ``docs``.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad); other values and
    nulls are left out, and a document with labels of both kinds is bad. ``base_failed``: fewer than 50 words, or more than half
    of the words in 3-word windows that occur twice or more in the text.
    ``kept`` is false if the base rules fail, else whether the isolation score
    is at most the calibrated threshold. Without a good labelled row that passes
    the base rules there is no forest: the score is 0 and the base rules decide.

    A null or empty text has all counts 0 and fails the base rules. Repeated rows
    get a row each. A row without a ``doc_id`` is judged like any other, but not
    used to fit. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    numbers = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean"
    # The texts are read once: the counts are stored, and the forest is fitted and applied on them.
    counted = cut_lineage(rows.mapInArrow(_counted, numbers + "".join(f", {c} double" for c in _AXES)), "rule-counts")
    forest = _fitted(counted, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")))
    return counted.mapInArrow(_judged(forest), numbers + ", kept boolean, score double")


def rule_counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text of a chunk."""
    words = Words(data, at)
    rows, n = words.rows, len(at) - 1

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[at])

    def per_word(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[rows])

    in_word = np.zeros(len(data) + 1, np.int8)
    in_word[words.starts] += 1
    np.add.at(in_word, words.ends, -1)
    in_word = np.cumsum(in_word[:-1]) > 0
    out = {
        "n_words": np.diff(rows), "word_chars": per_text(in_word & ((data & 0xC0) != 0x80)), "n_symbols": per_text(_SYMBOLS[data]),
        "n_upper": per_text((data >= 65) & (data <= 90)), "n_marks": per_text(_MARKS[data]),
    }
    # Lines: between line feeds and the ends of the texts; those without a word do not count.
    feeds = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([at[:-1], feeds + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    ends = np.where((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10) if len(starts) else False, ends - 1, ends)
    worded = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[worded], ends[worded]
    owner = np.searchsorted(at, starts, "right") - 1
    lines = mix(RollingHash(byte_values(data)).of(starts, ends)) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, first = np.unique(lines, return_index=True)
    out["n_lines"] = np.bincount(owner, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(owner[first], minlength=n)
    # Words in three-word windows that the text has twice or more.
    hashes = words.hashes()
    window = np.arange(max(0, len(hashes) - 2))
    owner = np.searchsorted(rows, window, "right") - 1
    window = window[window + 3 <= rows[owner + 1]] if len(window) else window
    owner = np.searchsorted(rows, window, "right") - 1
    keys = mix(RollingHash(hashes).of(window, window + 3)) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
    again = window[count[which] > 1] if len(window) else window
    repeated = np.zeros(len(hashes), bool)
    for i in range(3):
        repeated[again + i] = True
    out["n_repeat_words"] = per_word(repeated)
    return out


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def coordinates(c: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios of the counts, each between 0 and 1; none grows with the text's length."""
    words = np.maximum(c["n_words"], 1)
    per_word = lambda x, half: (x / words) / (x / words + half)
    return np.stack([
        per_word(c["word_chars"], 5.0), per_word(c["n_symbols"], 0.2), per_word(c["n_marks"], 0.5),
        c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words, c["n_upper"] / np.maximum(c["word_chars"], 1),
    ], axis=1)


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, float)
    more = np.maximum(n, 2)
    return np.where(n > 1, 2 * (np.log(more - 1) + 0.5772156649) - 2 * (more - 1) / more, 0.0)


class Forest:
    """Complete trees as arrays: at each inner node a coordinate and a value, at each leaf a path length."""

    def __init__(self, rows: np.ndarray, box: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        inner = (1 << DEPTH) - 1
        self.size = min(SUBSAMPLE, len(rows))
        self.axis = np.zeros((TREES, inner), np.int8)
        self.value = np.full((TREES, inner), np.inf, np.float32)
        self.length = np.zeros((TREES, inner + 1), np.float32)
        for tree in range(TREES):
            own = rows[rng.permutation(len(rows))[: self.size]]
            self._grow(tree, 0, 0, own, box.copy(), rng)
        self.threshold = 1.0

    def _grow(self, tree: int, node: int, depth: int, rows: np.ndarray, box: np.ndarray, rng) -> None:
        wide = np.flatnonzero(box[1] > box[0])
        if len(rows) <= 1 or depth == DEPTH or not len(wide):
            leaf, span = node, 1
            for _ in range(DEPTH - depth):
                leaf, span = 2 * leaf + 1, 2 * span
            first = leaf - ((1 << DEPTH) - 1)
            self.length[tree, first : first + span] = depth + _average_path(len(rows))
            return
        axis = int(rng.choice(wide))
        value = rng.uniform(box[0, axis], box[1, axis])
        self.axis[tree, node], self.value[tree, node] = axis, value
        left = rows[:, axis] <= value
        low, high = box.copy(), box.copy()
        low[1, axis] = high[0, axis] = value
        self._grow(tree, 2 * node + 1, depth + 1, rows[left], low, rng)
        self._grow(tree, 2 * node + 2, depth + 1, rows[~left], high, rng)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the shorter the paths, the higher."""
        total = np.zeros(len(rows))
        at = np.arange(len(rows))
        for tree in range(TREES):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[at, self.axis[tree, node]] > self.value[tree, node])
            total += self.length[tree, node - ((1 << DEPTH) - 1)]
        return 2 ** (-total / TREES / max(float(_average_path(self.size)), 1.0))


def _fitted(counted: DataFrame, labels: DataFrame) -> Forest | None:
    labels = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labels = cut_lineage(labels, "labels")
    usable = (F.col("quality") == 1) & ~F.col("base_failed")
    points = counted.join(broadcast_if_small(labels, labels.count()), "doc_id").select("doc_id", usable.alias("usable"), *_AXES)
    points = cut_lineage(points, "points")
    facts = points.agg(F.count_if("usable").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in _AXES]).first()
    if not facts["n"]:
        return None
    box = np.array([[facts[f"{f}_{c}"] for c in _AXES] for f in ("min", "max")])
    usable = points.filter("usable")
    # As many rows as the trees take, drawn by a hash of the id; the order settles ties, so the table's order does not matter.
    taken = usable.orderBy(F.xxhash64("doc_id", F.lit(3)), *_AXES).limit(TREES * SUBSAMPLE).select(*_AXES).toPandas().to_numpy()
    forest = Forest(taken[np.lexsort(taken.T)], box)
    # The threshold is one of the highest scores of all good rows: the one at the quantile, of those no more than come after it.
    above = facts["n"] - int(np.ceil((facts["n"] - 1) * (1 - LOSS)))
    scored = usable.mapInArrow(_point_scores(forest), "score double")
    forest.threshold = scored.orderBy(F.desc("score")).limit(above).agg(F.min("score").alias("least")).first()["least"]
    return forest


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, at in chunks(batch, "text"):
            counts = rule_counts(data, at)
            axes = [pa.array(axis.astype(float)) for axis in coordinates(counts).T]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(counts[c].astype(np.int64)) for c in _COUNTS), pa.array(base_failed(counts)), *axes],
                ["doc_id", *_COUNTS, "base_failed", *_AXES],
            )


def _at(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in _AXES], axis=1)


def _point_scores(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(forest.scores(_at(batch)))], ["score"])

    return run


def _judged(forest: Forest | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
            score = forest.scores(_at(batch)) if forest else np.zeros(len(failed))
            kept = ~failed & (score <= forest.threshold if forest else True)
            names = ["doc_id", *_COUNTS, "base_failed"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(kept), pa.array(score)], [*names, "kept", "score"])

    return run
