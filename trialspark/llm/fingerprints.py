"""Document fingerprints by a threshold-scaled sketch, in DataFrame functions only.

A text is a set of word shingles; its sketch retains every shingle hash below a
fixed fraction of the hash range (FracMinHash; Irber et al., "Lightweight
compositional analysis of metagenomes with FracMinHash", 2022). Whether a hash
is retained depends on the hash alone, so the sketch of a union is the union of
the sketches, and the share of a small text's hashes found in a large one
estimates its containment whatever their sizes.

The hash is the first 60 bits of the shingle's MD5, so any engine can make, merge
and compare the same sketches. A text of which nothing lies below the fraction
keeps its smallest hash instead, so that it has a fingerprint; :func:`merged`
drops such hashes as soon as anything is below.

The successor of a document is found on ids alone: they are range-partitioned
and looked up within a range, and the ends of the ranges, one row each, meet
each other. Texts are shuffled once by document and once, cut to the length
that is needed, to the document before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialspark.session import cut_lineage

SHINGLE_WORDS = 5
#: Hex digits of a hash, and the fraction of hashes retained: one in ``ONE_IN``.
DIGITS = 15
ONE_IN = 8
_WORD = r"[^\x20\x09-\x0D]+"
# A document is known by its id (none sorts first) and two hashes of its text.
_KEY = ("named", "id", "h1", "h2")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, though ``use`` names it many times."""
    return F.get(F.transform(F.array(value), use), 0)


def _limit(one_in: int) -> int:
    return 16**DIGITS // one_in


def shingle_hashes(words: Column, size: int = SHINGLE_WORDS) -> Column:
    """The hash of every shingle, in hex digits; fewer words are one shingle, none have none."""
    # Words are taken one by one, as a slice would copy the whole list.
    def at(i: Column) -> Column:
        parts = [F.get(words, i + k) for k in range(size)]
        return F.concat(parts[0], *[x for part in parts[1:] for x in (F.lit(" "), part)])

    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0))), lambda i: i <= F.size(words) - size)
    texts = F.when(F.size(words) >= size, F.transform(starts, at)).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
    return F.transform(texts, lambda t: F.substring(F.md5(t), 1, DIGITS))


def _numbers(digits: Column) -> Column:
    return F.array_sort(F.transform(F.array_distinct(digits), lambda h: F.conv(h, 16, 10).cast("long")))


def sketch(text: Column, size: int = SHINGLE_WORDS, one_in: int = ONE_IN) -> Column:
    """The sorted retained hashes of a text, as numbers."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    below = f"{_limit(one_in):0{DIGITS}x}"

    def retained(hashes: Column) -> Column:
        return _let(F.filter(hashes, lambda h: h < below), lambda low: F.when((F.size(low) > 0) | (F.size(hashes) == 0), low).otherwise(F.array(F.array_min(hashes))))

    return _numbers(_let(words, lambda w: _let(shingle_hashes(w, size), retained)))


def merged(a: Column, b: Column, one_in: int = ONE_IN) -> Column:
    """The sketch of two documents taken together, from their sketches."""

    def retained(both: Column) -> Column:
        low = F.filter(both, lambda h: h < _limit(one_in))
        return F.array_sort(F.when((F.size(low) > 0) | (F.size(both) == 0), low).otherwise(F.array(F.array_min(both))))

    return _let(F.array_union(a, b), retained)


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance: common hashes by all hashes; 1 for two empty sketches."""
    common, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(common.cast("double") / F.greatest(union, F.lit(1)).cast("double"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has; 1 for an empty sketch."""
    common = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) == 0, 1.0).otherwise(common.cast("double") / F.greatest(F.size(a), F.lit(1)).cast("double"))


def printed(hashes: Column) -> Column:
    """A sketch as a fingerprint: its hashes in hex, joined by blanks."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), DIGITS, "0"))), " ")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE_WORDS, one_in: int = ONE_IN) -> DataFrame:
    """Per row of ``docs`` its fingerprint, and that of its edited text.

    (``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``, ``in_next``,
    ``next_in``). The edited text is the text with its last half of code points
    (rounded down) replaced by the first as many, or all, of the next document's
    in the order of ``doc_id``; after the last document comes the first. ``near_*``
    are likenesses of the fingerprints, ``in_next`` and ``next_in`` how much of
    this text the next contains and the other way round.

    A null text counts as an empty one; an empty or wordless text has an empty
    fingerprint, like only to another empty one. Rows with the same ``doc_id``
    and text are one document and get equal rows; different texts of one
    ``doc_id`` follow each other by their hashes, and rows without a ``doc_id``
    come before all others in the same way. A single document is its own next.
    Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text.alias("text"))
    rows = rows.select(F.col("id").isNotNull().cast("int").alias("named"), F.coalesce("id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    known = cut_lineage(rows.select(*_KEY, F.length("text").cast("long").alias("n_chars")), "keys")
    order = cut_lineage(successors(known.distinct()), "successors")
    texts = rows.repartition(*_KEY).dropDuplicates().withColumn("sketch", sketch(F.col("text"), size, one_in))
    # The head of each text, as long as the document before needs it, goes there with the sketch.
    wanted = order.select(*[F.col(f"next_{c}").alias(c) for c in _KEY], *[F.col(c).alias(f"before_{c}") for c in _KEY], "half")
    heads = texts.join(wanted, list(_KEY)).select(*[F.col(f"before_{c}").alias(c) for c in _KEY], "half", F.left("text", "half").alias("head"), F.col("sketch").alias("next_sketch"))
    edited = texts.join(heads, list(_KEY)).select(*_KEY, "sketch", "next_sketch", F.concat(F.left("text", F.length("text") - F.col("half")), "head").alias("edited"))
    edited = edited.select(*_KEY, "sketch", "next_sketch", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited"), size, one_in).alias("edited_sketch"))
    own, changed, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return known.join(edited, list(_KEY)).select(
        F.when(F.col("named") == 1, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", printed(own).alias("fingerprint"), printed(changed).alias("edited_fingerprint"),
        likeness(own, changed).alias("near_edited"), likeness(own, after).alias("near_next"),
        containment(own, after).alias("in_next"), containment(after, own).alias("next_in"),
    )


def successors(keys: DataFrame) -> DataFrame:
    """The distinct ``keys`` with ``next_*``, the key after each, and ``half``, how much of it is needed.

    No window spans all rows: ranges are sorted apart, and only the first key of
    each range, as many as there are shuffle partitions, is sorted as a whole.
    """
    ranged = cut_lineage(keys.repartitionByRange(*_KEY).withColumn("range", F.spark_partition_id()), "ranges")
    key = F.struct(*_KEY)
    inside = Window.partitionBy("range").orderBy(*_KEY)
    placed = ranged.select("range", *_KEY, "n_chars", F.lead(key).over(inside).alias("next"), F.row_number().over(inside).alias("place"))
    placed = cut_lineage(placed, "placed")
    starts = placed.filter("place = 1").select("range", key.alias("start"))
    ranges = Window.partitionBy(F.lit(0)).orderBy("range")
    all_ranges = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = starts.select("range", F.coalesce(F.lead("start").over(ranges), F.first("start").over(all_ranges)).alias("after"))
    joined = placed.join(F.broadcast(starts), "range").withColumn("next", F.coalesce("next", "after"))
    return joined.select(*_KEY, *[F.col(f"next.{c}").alias(f"next_{c}") for c in _KEY], F.floor(F.col("n_chars") / 2).cast("int").alias("half"))
