"""Benchmark decontamination by BM25 with block-max WAND.

The test items are an inverted index; every training text is cut into passages
that overlap by half and are as long as two of the longest item, so an item that
stands in one piece lies whole in some passage. Each passage is a query, and so is
the whole text, for items whose parts stand apart. A text that
holds ``percent`` of an item's shingles lacks so few of its words that the BM25
score cannot fall below a share of the score that the item gives itself: all but
its heaviest terms, as many as words can be missing. That share is the item's
threshold, and all items that reach it are retrieved. Block-max WAND (Ding and Suel, 2011) leaves out what cannot reach it:
of a passage's terms, ordered by their largest weight, those that together stay
below the threshold open no posting list; items met in the other lists are
scored only if the maxima of their block of items reach the threshold. Passages
of a batch go through these steps together. The whole text has most words of most
items, which no bound on terms can leave out; it opens the items of which it has
``percent`` of the question's shingles.

A retrieved item is a leak if the text holds at least ``percent`` of the
five-word shingles of its question, and of its answer where there is one. A
shorter question or answer is one shingle.

The index is bounded: items are split into parts of at most ``PART_BYTES`` of
text, each part is one broadcast and one pass over the texts, and all passes
count. Texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trialspark.llm.anchors import packed_rows, unpacked_rows, version
from trialspark.llm.batches import NOT_ALPHANUMERIC, RollingHash, Words, chunks, distinct, lower_ascii, text_bytes

WORDS = 5
PART_BYTES = 1 << 24
ITEM_BLOCK = 16
K1, B = 1.2, 0.75
# Upper bits of a term's hash by which most other words are told from terms.
_MAYBE_BITS = 20


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", question_column: str = "text", answer_column: str | None = None) -> DataFrame:
    """(``doc_id``, ``n_items``, ``item_ids``, ``best_score``, ``kept``) per row of ``docs``.

    ``item_ids`` are the leaked items in order, ``best_score`` the best BM25
    score among them in units of the item's threshold (that of a passage, or of
    the whole text where no passage reaches it), ``kept`` whether there is none. Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z
    lower-cased; a character of a script without blanks is a word of its own. A
    question or answer of fewer than five words must occur as a whole; one
    without words is never found. A null or empty text, or an empty benchmark, leaks nothing. Repeated
    items count once if their id is the same. Repeated rows get a row each, also
    those without a ``doc_id``. Other columns are ignored, whatever their names.
    """
    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), version(text).alias("v"), text.alias("text"))
    found = leaked_items(rows, benchmark, percent, item_column, question_column, answer_column)
    per_text = found.groupBy("doc_id", "v").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("score").alias("best_score"))
    same = rows["doc_id"].eqNullSafe(per_text["doc_id"]) & (rows["v"] == per_text["v"])
    items = F.coalesce("item_ids", F.array().cast("array<long>"))
    joined = rows.select("doc_id", "v").join(per_text, same, "left").select(rows["doc_id"], items.alias("item_ids"), "best_score")
    return joined.select("doc_id", F.size("item_ids").cast("long").alias("n_items"), "item_ids", "best_score", (F.size("item_ids") == 0).alias("kept"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", question_column: str = "text", answer_column: str | None = None) -> DataFrame:
    """The rows of ``docs`` that leak no item; handles the same cases as ``leaks``.

    Each part of the index filters what the part before left; nothing is shuffled.
    """
    rows = packed_rows(docs, text_column)
    schema = rows.schema
    for index in _indexes(benchmark, percent, item_column, question_column, answer_column):
        rows = rows.mapInArrow(_clean(rows.sparkSession.sparkContext.broadcast(index)), schema)
    return unpacked_rows(rows, docs, text_column)


def leaked_items(rows: DataFrame, benchmark: DataFrame, percent: int, item_column: str, question_column: str, answer_column: str | None) -> DataFrame:
    """(``doc_id``, ``v``, ``item_id``, ``score``): verified leaks, one per text and item."""
    schema = "doc_id long, v int, item_id long, score double"
    out = rows.sparkSession.createDataFrame([], schema)
    for index in _indexes(benchmark, percent, item_column, question_column, answer_column):
        out = out.unionByName(rows.mapInArrow(_searched(rows.sparkSession.sparkContext.broadcast(index)), schema))
    return out


def _indexes(benchmark: DataFrame, percent: int, item_column: str, question_column: str, answer_column: str | None) -> Iterator[Index]:
    """The index of each part of the items; a part's size is bounded."""
    answer = F.lit(None).cast("string") if answer_column is None else F.col(answer_column).cast("string")
    items = benchmark.select(F.col(item_column).cast("long").alias("item_id"), F.col(question_column).cast("string").alias("question"), answer.alias("answer"))
    items = items.filter("question IS NOT NULL").distinct()
    size = F.octet_length("question") + F.coalesce(F.octet_length("answer"), F.lit(0)) + 64
    total = items.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"]
    parts = max(1, -(-2 * total // PART_BYTES))
    for part in range(parts):
        own = items.filter(F.pmod(F.xxhash64("item_id", "question"), F.lit(parts)) == part).orderBy("item_id", "question", "answer").collect()
        index = Index([x["item_id"] for x in own], [x["question"] for x in own], [x["answer"] for x in own], percent)
        if index.items:
            yield index


class Index:
    """Postings of the items' terms, weights as shares of an item's threshold.

    Items go by length, so that a block holds items with similar weights.
    """

    def __init__(self, ids: list[int], questions: list[str], answers: list[str | None], percent: int):
        self.percent = percent
        hashes, rows = _hashed(questions)
        by_length = np.argsort(np.diff(rows), kind="stable").tolist()
        rolling = RollingHash(hashes)
        self.items, terms, self.shingles, self.sizes, self.answers, self.answer_size = [], [], [], [], [], []
        spans = []
        for i in by_length:
            a, b = int(rows[i]), int(rows[i + 1])
            if a == b:
                continue
            size = min(WORDS, b - a)
            first = np.arange(a, b - size + 1)
            self.items.append(ids[i])
            spans.append(b - a)
            terms.append(np.unique(hashes[a:b], return_counts=True))
            self.shingles.append(np.unique(rolling.of(first, first + size)))
            self.sizes.append(size)
            own, ends = _hashed([answers[i] or ""])
            n = min(WORDS, len(own))
            at = np.arange(len(own) - n + 1) if n else np.zeros(0, np.int64)
            self.answer_size.append(n)
            self.answers.append(np.unique(RollingHash(own).of(at, at + n)) if n else np.zeros(0, np.uint64))
        self.passage = 2 * max([WORDS, *spans])
        # Shingles with their items, for the whole text as a query, by number of words.
        self.whole = {}
        for size in sorted(set(self.sizes)):
            of = [i for i, n in enumerate(self.sizes) if n == size]
            shingle = np.concatenate([self.shingles[i] for i in of])
            owner = np.repeat(of, [len(self.shingles[i]) for i in of])
            order = np.argsort(shingle, kind="stable")
            shingle, owner = shingle[order], owner[order]
            maybe = np.zeros(1 << _MAYBE_BITS, bool)
            maybe[shingle >> np.uint64(64 - _MAYBE_BITS)] = True
            self.whole[size] = maybe, shingle, owner
        self.item_terms = []
        self.terms, which = np.unique(np.concatenate([t for t, _ in terms] or [np.zeros(0, np.uint64)]), return_inverse=True)
        self.maybe = np.zeros(1 << _MAYBE_BITS, bool)
        self.maybe[self.terms >> np.uint64(64 - _MAYBE_BITS)] = True
        item = np.repeat(np.arange(len(terms)), [len(t) for t, _ in terms])
        tf = np.concatenate([c for _, c in terms] or [np.zeros(0)])
        length = np.array(spans, float)
        df = np.bincount(which, minlength=len(self.terms))
        idf = np.log1p((len(terms) - df + 0.5) / (df + 0.5))
        weight = idf[which] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / max(length.mean() if len(length) else 1, 1)))
        weight /= np.bincount(item, weights=weight, minlength=len(terms))[item]
        for i, end in enumerate(np.cumsum([len(t) for t, _ in terms])):
            own = weight[end - len(terms[i][0]) : end]
            missing = len(self.shingles[i]) * (100 - percent) // 100 + 1
            own /= max(0.05, 1 - np.sort(own)[::-1][:missing].sum())
            self.item_terms.append((terms[i][0], own))
        order = np.lexsort((item, which))
        self.posting_item, self.posting_weight = item[order], weight[order]
        self.starts = np.append(0, np.cumsum(df))
        self.most = np.maximum.reduceat(self.posting_weight, self.starts[:-1]) if len(df) else np.zeros(0)
        self.keys = which[order] * len(terms) + item[order]
        # The maxima of each term over blocks of items.
        self.n_blocks = -(-len(terms) // ITEM_BLOCK)
        block_keys = which[order] * self.n_blocks + item[order] // ITEM_BLOCK
        heads = np.flatnonzero(np.append(True, block_keys[1:] != block_keys[:-1])) if len(block_keys) else np.zeros(0, np.int64)
        self.block_keys = block_keys[heads]
        self.block_most = np.maximum.reduceat(self.posting_weight, heads) if len(heads) else np.zeros(0)

    def search(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, score) of all items that reach their threshold in some passage of a row."""
        known = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - _MAYBE_BITS)])
        at = np.searchsorted(self.terms, hashes[known])
        is_term = self.terms[np.minimum(at, len(self.terms) - 1)] == hashes[known]
        known, term = known[is_term], at[is_term]
        row = np.repeat(np.arange(len(rows) - 1), np.diff(np.searchsorted(known, rows)))
        half = self.passage // 2
        number = np.diff(rows) // half + 1  # passages of each row; the last may be short
        before = np.append(0, np.cumsum(number))
        later = before[row] + (known - rows[row]) // half
        # A word is in the passage that starts with its half and in the one before.
        # Passages whose terms, even counted as often as they occur, stay below the threshold are done.
        halves = np.bincount(later, weights=self.most[term], minlength=before[-1] + 1)
        reaches = halves[:-1] + halves[1:] >= 1 - 1e-9
        earlier = later - 1
        own, also = reaches[later], (later > before[row]) & reaches[earlier]
        passage = np.concatenate([later[own], earlier[also]])
        term = np.concatenate([term[own], term[also]])
        pairs = distinct(passage * len(self.terms) + term)
        passage, term = pairs // len(self.terms), pairs % len(self.terms)
        most = self.most[term]
        order = np.lexsort((most, passage))
        passage, term, most = passage[order], term[order], most[order]
        heads = np.flatnonzero(np.append(True, passage[1:] != passage[:-1])) if len(passage) else np.zeros(0, np.int64)
        size = np.diff(np.append(heads, len(passage)))
        total = np.cumsum(most)
        reached = total - np.repeat(total[heads] - most[heads], size) >= 1 - 1e-9
        # Only terms from the pivot on open their posting lists.
        opened = np.flatnonzero(reached)
        count = self.starts[term[opened] + 1] - self.starts[term[opened]]
        owner = np.repeat(np.arange(len(opened)), count)
        posting = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + self.starts[term[opened]][owner]
        group = np.searchsorted(heads, opened, "right") - 1
        n = len(self.items)
        met = distinct(group[owner] * n + self.posting_item[posting])
        group, item = met // n, met % n
        blocks, which = np.unique(group * self.n_blocks + item // ITEM_BLOCK, return_inverse=True)
        bound = self._sums(heads, size, term, blocks // self.n_blocks, blocks % self.n_blocks, self.n_blocks, self.block_keys, self.block_most)
        can = bound[which] >= 1 - 1e-9
        group, item = group[can], item[can]
        score = self._sums(heads, size, term, group, item, n, self.keys, self.posting_weight)
        good = score >= 1 - 1e-9
        row = np.searchsorted(before, passage[heads[group[good]]], "right") - 1
        return row, item[good], score[good]

    def search_whole(self, hashes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(row, item, score) of the items of which a row has ``percent`` of the question's shingles."""
        rolling = RollingHash(hashes)
        n = len(self.items)
        needed = np.array([len(x) for x in self.shingles])
        for size, (maybe, shingle, owner) in self.whole.items():
            first = np.arange(max(0, len(hashes) - size + 1))
            own = rolling.of(first, first + size)
            first = first[maybe[own >> np.uint64(64 - _MAYBE_BITS)]]
            row = np.searchsorted(rows, first, "right") - 1
            inside = first + size <= rows[row + 1]
            first, row = first[inside], row[inside]
            at = np.searchsorted(shingle, own[first])
            known = shingle[np.minimum(at, len(shingle) - 1)] == own[first]
            pairs = distinct(row[known] * len(shingle) + at[known])
            row, low = pairs // len(shingle), pairs % len(shingle)
            count = np.searchsorted(shingle, shingle[low], "right") - low
            which = np.repeat(np.arange(len(low)), count)
            item = owner[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[which]]
            met, held = np.unique(row[which] * n + item, return_counts=True)
            met = met[100 * held >= self.percent * needed[met % n]]
            for r, i in zip((met // n).tolist(), (met % n).tolist(), strict=True):
                terms, weight = self.item_terms[i]
                yield r, i, float(weight[np.isin(terms, hashes[rows[r] : rows[r + 1]])].sum())

    @staticmethod
    def _sums(heads, size, term, group, column, columns, keys, values) -> np.ndarray:
        """Sums over a passage's terms of their values in one column."""
        count = size[group]
        owner = np.repeat(np.arange(len(group)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + heads[group][owner]
        wanted = term[place] * columns + column[owner]
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return np.bincount(owner, weights=np.where(keys[at] == wanted, values[at], 0.0), minlength=len(group)) if len(owner) else np.zeros(len(group))

    def holds(self, words: np.ndarray, item: int) -> bool:
        """Whether a text's words hold the item's question, and its answer."""
        rolling, size = RollingHash(words), self.sizes[item]
        first = np.arange(max(0, len(words) - size + 1))
        own = rolling.of(first, first + size)
        if 100 * np.isin(self.shingles[item], own).sum() < self.percent * len(self.shingles[item]):
            return False
        n = self.answer_size[item]
        if not n:
            return True
        first = np.arange(max(0, len(words) - n + 1))
        return bool(100 * np.isin(self.answers[item], rolling.of(first, first + n)).sum() >= self.percent * len(self.answers[item]))


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, at = text_bytes(pa.array(texts, pa.string()))
    words = Words(lower_ascii(data), at, NOT_ALPHANUMERIC, split=True)
    return words.hashes(), words.rows


def _held(index: Index, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, float]]:
    """(row, item, score) of the items that the texts of a chunk hold."""
    words = Words(lower_ascii(data), at, NOT_ALPHANUMERIC, split=True)
    hashes, rows = words.hashes(), words.rows
    best: dict[tuple[int, int], float] = {}
    for row, item, score in zip(*(x.tolist() for x in index.search(hashes, rows)), strict=True):
        best[row, item] = max(score, best.get((row, item), 0.0))
    for row, item, score in index.search_whole(hashes, rows):
        best.setdefault((row, item), score)
    return [(r, i, s) for (r, i), s in sorted(best.items()) if index.holds(hashes[rows[r] : rows[r + 1]], i)]


def _searched(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for part, data, at in chunks(batch, "text"):
                held = _held(index, data, at)
                if held:
                    take = pa.array([r for r, _, _ in held])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(take), part.column("v").take(take), pa.array([index.items[i] for _, i, _ in held], pa.int64()), pa.array([s for _, _, s in held], pa.float64())],
                        ["doc_id", "v", "item_id", "score"],
                    )

    return run


def _clean(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch, "text"):
                kept = np.ones(part.num_rows, bool)
                kept[[r for r, _, _ in _held(shared.value, data, at)]] = False
                yield part.filter(pa.array(kept))

    return run
