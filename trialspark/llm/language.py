"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A language's profile is the list of its most frequent character n-grams (one to
three letters, words padded with a mark), learned from labelled documents. A
document is given the language whose profile is nearest to its own list by the
out-of-place distance: the sum over its n-grams of how far their ranks differ,
an n-gram that the profile lacks counting as ``PROFILE`` places.

Profiles are learned from about ``FIT_ROWS`` labelled documents of each language,
drawn by a hash of the id, and from all of a language that has fewer; n-grams are counted and ranked on the cluster, and only ``PROFILE``
n-grams per language come to the driver and go to the executors.

A text in no learned language is still nearest to some profile. How far a real
text can be is learned too: labelled texts and their first words are scored
against their own language, and what lies as far below the lowest hundredth of
such scores as that lies below the median, at this number of n-grams, is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from trialspark.llm.anchors import packed_rows, unpacked_rows
from trialspark.llm.batches import chunks
from trialspark.session import broadcast_if_small

FIT_ROWS = 20_000
# Steps of the scores whose percentiles are the least scores; all labelled rows are scored.
GRAIN = 1 << 16
# Scores of a language and size from which a least score is learned, at least.
LEAST_ROWS = 20
PROFILE = 400
LONGEST = 3
UNKNOWN = "und"
_BITS = 21
_MARK = 1


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(``doc_id``, ``held_out``, ``lang_pred``, ``score``) per row of ``docs``.

    Learned from rows that are not held out and have an id, a text and a
    language. ``score`` is 1 for a document whose list equals the profile and 0
    for one without a common n-gram. A null text, or one without a letter, is
    ``und`` with score 0, and so is everything if nothing can be learned. Of
    equally near languages the one whose name sorts first is chosen. Repeated
    rows count as often as they occur. Other columns are ignored, whatever their
    names; the language is only read to learn.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"))
    profiles = learn_profiles(rows.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    told = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return told.mapInArrow(_predicted(profiles), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Rows of ``docs`` whose score is one that texts in their language have.

    The least score is learned from the labelled rows, by language and number of
    n-grams, from the nearest number that enough of them have; it is never below ``least``.
    Handles the same cases as ``identify``: rows without a letter go.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"))
    labelled = rows.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    profiles = learn_profiles(labelled)
    learned = least_scores(labelled, profiles)
    packed = packed_rows(docs, text_column)
    return unpacked_rows(packed.mapInArrow(_identified(profiles, learned, least), packed.schema), docs, text_column)


def least_scores(rows: DataFrame, profiles: list[tuple[str, np.ndarray]]) -> dict[tuple[str, int], float]:
    """(language, size class of the text) -> the score below which a text is not in the language."""
    told = rows.filter("text IS NOT NULL AND lang IS NOT NULL")
    scored = told.select("lang", "text").mapInArrow(_own_scores(profiles), "lang string, size int, score double")
    # Scores to the nearest of GRAIN steps, so that the exact percentiles of any number of rows hold few values.
    scored = scored.withColumn("score", F.round(F.col("score") * GRAIN) / GRAIN)
    low = scored.groupBy("lang", "size").agg(F.count("*").alias("n"), F.expr("percentile(score, array(0.01D, 0.5D))").alias("q")).filter(F.col("n") >= LEAST_ROWS)
    return {(r.lang, r.size): 2 * r.q[0] - r.q[1] for r in low.collect()}


def least_of(learned: dict[tuple[str, int], float], lang: str, size: int, least: float) -> float:
    """The least score of a language and size: that of the nearest size learned, the smaller of two.

    A language of which nothing was learned takes the lowest of the others at
    the nearest size; ``least`` is the bound below all, and what counts where
    no language has enough scores of any size.
    """
    own = [s for of, s in learned if of == lang] or [s for _, s in learned]
    if not own:
        return least
    near = min(own, key=lambda s: (abs(s - size), s))
    found = learned.get((lang, near))
    return max(least, min(v for (_, s), v in learned.items() if s == near) if found is None else found)


def _drawn(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows of each language, by a hash of the id; all of a language with fewer."""
    share = rows.groupBy(F.col("lang").alias("of")).agg(F.least(F.lit(1.0), F.lit(float(most)) / F.count("*")).alias("share"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30))
    return rows.join(broadcast_if_small(share, share.count()), F.col("lang") == F.col("of")).filter(place < F.col("share") * (1 << 30)).select("doc_id", "text", "lang")


def learn_profiles(rows: DataFrame) -> list[tuple[str, np.ndarray]]:
    """(language, its n-grams from the most frequent on), by language."""
    drawn = _drawn(rows.filter("text IS NOT NULL AND lang IS NOT NULL"), FIT_ROWS)
    counted = drawn.select("lang", "text").mapInArrow(_gram_counts, "lang string, gram long, n long")
    ranked = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = ranked.withColumn("place", place).filter(F.col("place") <= PROFILE).select("lang", "place", "gram").toPandas()
    return [(lang, own.sort_values("place")["gram"].to_numpy()) for lang, own in sorted(top.groupby("lang"))]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """The n-grams of a text as packed numbers, ``_MARK`` around each word; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.append(np.where(_letters()[codes], codes, _MARK).astype(np.int64), _MARK)
    keep = (codes != _MARK) | np.append(False, codes[:-1] != _MARK)
    codes = np.append(_MARK, codes[keep])
    is_letter = codes != _MARK
    out, packed = [codes[is_letter]], codes
    for n in range(2, LONGEST + 1):
        packed = (packed[:-1] << _BITS) | codes[n - 1 :]
        inside = np.ones(len(packed), bool)
        for i in range(1, n - 1):  # a mark stands at an end only
            inside &= is_letter[i : i + len(packed)]
        out.append(packed[inside])
    return np.concatenate(out) if len(out[0]) else np.zeros(0, np.int64)


def ranked_grams(text: str) -> np.ndarray:
    """The ``PROFILE`` most frequent n-grams, ties by their number."""
    values, count = np.unique(grams(text), return_counts=True)
    return values[np.lexsort((values, -count))[:PROFILE]]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with a bounded amount of text."""
    for batch in batches:
        for part, _, _ in chunks(batch, "text"):
            yield part


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        by_lang: dict[str, list] = {}
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(np.unique(grams(text), return_counts=True))
        for lang, parts in by_lang.items():
            values, which = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
            count = np.bincount(which, weights=np.concatenate([c for _, c in parts]), minlength=len(values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(count)], ["lang", "gram", "n"])


class Profiles:
    """Profiles prepared for lookup: n-grams sorted, with their ranks."""

    def __init__(self, profiles: list[tuple[str, np.ndarray]]):
        self.langs = [lang for lang, _ in profiles]
        self.all = np.unique(np.concatenate([g for _, g in profiles])) if profiles else np.zeros(0, np.int64)
        self.rank = np.full((len(profiles), len(self.all) + 1), -1)
        for i, (_, own) in enumerate(profiles):
            self.rank[i, np.searchsorted(self.all, own)] = np.arange(len(own))

    def scores(self, text: str | None) -> tuple[np.ndarray, int]:
        """The score of each language, and the text's number of n-grams; none without a letter."""
        own = ranked_grams(text) if text and self.langs else ()
        if not len(own):
            return np.zeros(0), 0
        at = np.searchsorted(self.all, own)
        at[(at == len(self.all)) | (self.all[np.minimum(at, len(self.all) - 1)] != own)] = len(self.all)
        rank = self.rank[:, at]
        places = np.where(rank < 0, PROFILE, np.abs(rank - np.arange(len(own))))
        return 1 - places.sum(axis=1) / (PROFILE * len(own)), len(own)

    def nearest(self, text: str | None) -> tuple[str, float, int]:
        """(language, score, size class)."""
        score, n = self.scores(text)
        if not n:
            return UNKNOWN, 0.0, 0
        best = int(np.argmax(score))
        return self.langs[best], float(score[best]), size_class(n)


def size_class(n: int) -> int:
    """Texts with 2^k to 2^(k+1) - 1 n-grams go together."""
    return n.bit_length()


def _own_scores(profiles: list[tuple[str, np.ndarray]]):
    """Scores of labelled texts and of their first 1, 2, 4 to 128 words against their own language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(profiles)
        for batch in _parts(batches):
            langs, sizes, scores = [], [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = text.split(None, 128)
                heads = [" ".join(words[: 1 << k]) for k in range(8) if 1 << k < len(words)]
                for part in [*heads, text]:
                    score, n = known.scores(part)
                    if n:
                        langs.append(lang)
                        sizes.append(size_class(n))
                        scores.append(score[known.langs.index(lang)])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(scores, pa.float64())], ["lang", "size", "score"])

    return run


def _predicted(profiles: list[tuple[str, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(profiles)
        for batch in _parts(batches):
            told = [known.nearest(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([t for t, _, _ in told], pa.string()), pa.array([s for _, s, _ in told], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def _identified(profiles: list[tuple[str, np.ndarray]], learned: dict[tuple[str, int], float], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = lru_cache(maxsize=None)(lambda lang, size: least_of(learned, lang, size, least))
        known = Profiles(profiles)
        for batch in _parts(batches):
            told = (known.nearest(t.as_py()) for t in batch.column("text"))
            yield batch.filter(pa.array([lang != UNKNOWN and score >= bound(lang, size) for lang, score, size in told], pa.bool_()))

    return run
