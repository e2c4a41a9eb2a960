"""Repeated byte strings by suffix arrays over shards, merged by binary search.

Every byte covered by a string of ``window`` bytes that starts at two or more
places (in one document or several) is found, on whole texts.

1. Texts are cut into fragments by content (``anchors``). Fragments whose anchor
   occurs once cannot repeat and stop here; equal fragments are one class with a
   count, so a group of copies of any size costs one fragment.
2. The remaining fragments are dealt to shards of about ``SHARD_BYTES`` by their
   anchor, so equal windows meet. An anchor with more bytes than half a shard is
   spread over as many shards as it needs.
3. Each shard gets a suffix array by Larsson-Sadakane refinement (Larsson and
   Sadakane, "Faster suffix sorting", 2007): order by the first bytes, then by
   the ranks one doubled length ahead, touching only groups that are still
   unsorted, up to ``window`` bytes. Common prefixes follow in text order
   (Kasai et al., 2001), in lanes that advance together.
4. Windows of spread anchors send one digest per shard, range-partitioned; in
   each range the sorted digests are merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trialspark.llm.anchors import fragments, packed_rows, span_marks, unpacked_rows, version, with_spans
from trialspark.llm.batches import RollingHash, byte_values, chunks, signed, sorted_groups, span_lists, text_bytes
from trialspark.session import cut_lineage

WINDOW = 200
ANCHOR = 32
SHARD_BYTES = 1 << 20
_LANE = 128

_FOUND = "doc_id long, v int, s int, n int, k long, f long"
_VERDICTS = "k long, f long, a int, b int, digest long, alone boolean"


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(``doc_id``, ``v``, ``s``, ``e``): byte ranges covered by repeated windows.

    ``docs`` has ``doc_id``, ``v`` (see ``anchors.version``) and ``text``. Ranges
    may overlap. Rows without a ``doc_id`` take no part.
    """
    docs = docs.filter("doc_id IS NOT NULL")
    anchor = min(ANCHOR, max(1, window // 4))
    found = docs.mapInArrow(_fragments(window, anchor), _FOUND)
    repeated = found.groupBy("k").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("k")
    found = cut_lineage(found.join(repeated, "k", "left_semi"), "fragments")
    classes = found.groupBy("k", "f").agg(
        F.count(F.lit(1)).alias("m"), F.first("doc_id").alias("doc_id"), F.first("v").alias("v"), F.first("s").alias("s"), F.first("n").alias("n")
    )
    classes = cut_lineage(classes, "classes")
    size = F.col("n") + F.lit(window - 1)
    per_anchor = classes.groupBy("k").agg(F.sum(size).alias("w"))
    total = classes.agg(F.coalesce(F.sum(size), F.lit(0)).alias("w")).first()["w"]
    shards = max(1, -(-2 * total // SHARD_BYTES))
    spread = per_anchor.filter(F.col("w") > SHARD_BYTES // 2)
    parts = F.ceil(F.col("w") / (SHARD_BYTES // 4)).cast("long")
    classes = classes.join(spread, "k", "left")
    classes = classes.select(
        "k", "f", "m", "doc_id", "v", "s", "n", F.col("w").isNotNull().alias("spread"),
        F.when(F.col("w").isNull(), F.pmod("k", F.lit(shards))).otherwise(F.xxhash64("k", F.pmod("f", parts))).alias("shard"),
    )
    wanted = classes.groupBy("doc_id", "v").agg(F.collect_list(F.struct("shard", "k", "f", "m", "s", "n", "spread")).alias("wanted"))
    pieces = docs.join(wanted, ["doc_id", "v"]).select("text", "wanted").mapInArrow(_pieces(window), "shard long, k long, f long, m long, n int, spread boolean, piece binary")
    placed = pieces.repartition("shard").sortWithinPartitions("shard")
    verdicts = cut_lineage(placed.mapInArrow(_suffix_arrays(window), _VERDICTS), "verdicts")
    loose = verdicts.filter("digest IS NOT NULL").repartitionByRange("digest").sortWithinPartitions("digest")
    merged = loose.mapInArrow(_merged, "k long, f long, a int, b int")
    done = verdicts.filter("digest IS NULL").select("k", "f", "a", "b").unionByName(merged)
    return found.join(done, ["k", "f"]).select("doc_id", "v", (F.col("s") + F.col("a")).alias("s"), (F.col("s") + F.col("b") + F.lit(window)).alias("e"))


def suffix_dedup(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``) per row of ``docs``.

    Removed are the UTF-8 bytes of a text covered by a ``window``-byte string
    that also starts anywhere else, judged on the input. A null text is empty;
    an empty text and one shorter than the window keep all. Repeated rows are
    copies of each other, and each is a row of the result. A row without a
    ``doc_id`` takes no part: nothing of it is removed and nothing is removed
    because of it. Other columns of ``docs`` are ignored, whatever their names.
    """
    docs = _plain(docs, id_column, text_column)
    marked = with_spans(docs, repeated_spans(docs, window)).select("doc_id", "text", "spans")
    return marked.mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with repeated bytes cut out of the text; a cut never splits a character.

    All rows and columns stay, a null text stays null, and a text of nothing but
    repeats becomes empty. Handles the same cases as ``suffix_dedup``.
    """
    spans = repeated_spans(_plain(docs, id_column, text_column), window)
    lists = spans.groupBy("doc_id", "v").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    packed = packed_rows(docs, text_column)
    keyed = packed.select("row", "text", F.col(f"row.`{id_column}`").cast("long").alias("doc_id"), version(F.col("text")).alias("v"))
    joined = keyed.join(lists, ["doc_id", "v"], "left").select("row", "text", "spans")
    return unpacked_rows(joined.mapInArrow(_cut, packed.schema), docs, text_column)


def _plain(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.col(text_column).cast("string")
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), version(text).alias("v"), text.alias("text"))


def _fragments(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch, "text"):
                row, start, windows, k, f = fragments(byte_values(data), at, window, anchor)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(take), part.column("v").take(take), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), signed(k), signed(f)],
                    ["doc_id", "v", "s", "n", "k", "f"],
                )

    return run


def _pieces(window: int):
    """The bytes of the wanted fragments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch, "text", SHARD_BYTES // 4):
                lists = part.column("wanted")
                count = np.diff(lists.offsets.to_numpy())
                rows = lists.flatten()
                begin = np.repeat(at[:-1], count) + rows.field("s").to_numpy()
                size = rows.field("n").to_numpy() + (window - 1)
                offsets = np.concatenate([[0], np.cumsum(size)])
                index = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
                piece = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[index])])
                yield pa.RecordBatch.from_arrays([*(rows.field(c) for c in ("shard", "k", "f", "m", "n", "spread")), piece], ["shard", "k", "f", "m", "n", "spread", "piece"])

    return run


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` bytes, and the rank of each.

    Suffixes with equal first ``depth`` bytes (an end counts as smaller than any
    byte) share a rank, the place of the first of them.
    """
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data.astype(np.uint64) + np.uint64(1)
    known = min(7, depth)
    key = np.zeros(n, np.uint64)
    for i in range(known):  # nine bits for each byte, as an end is a symbol too
        key = (key << np.uint64(9)) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1

    def place(at: np.ndarray, members: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Rank runs of equal keys by their first place; return which are still unsorted."""
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(new)))
        rank[members] = np.repeat(at[heads], size)
        return np.repeat(size > 1, size)

    at = np.arange(n)
    ordered = key[order]
    unsorted = place(at, order, np.append(True, ordered[1:] != ordered[:-1])) if n else np.zeros(0, bool)
    at = at[unsorted]
    while known < depth and len(at):
        step = min(known, depth - known)
        members = order[at]
        key = (rank[members].astype(np.uint64) << np.uint64(32)) | (rank[np.minimum(members + step, n)] + 1).astype(np.uint64)
        by = np.argsort(key, kind="stable")
        members, key = members[by], key[by]
        order[at] = members
        unsorted = place(at, members, np.append(True, key[1:] != key[:-1]))
        at = at[unsorted]
        known += step
    return order, rank[:n]


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place of the suffix array, the bytes (up to ``depth``) shared with the place before.

    Kasai's walk in text order: from one suffix to the next the shared length
    falls by one at most, as long as both next suffixes keep their order (an
    order of ``depth`` bytes only may turn them around). Lanes of ``_LANE``
    suffixes walk at the same time.
    """
    n = len(data)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    place = np.empty(n + 1, np.int64)
    place[order], place[n] = np.arange(n), -1
    ordered = np.append(False, place[before[:-1] + 1] < place[1:n]) if n else np.zeros(0, bool)
    shared = np.zeros(n, np.int64)
    lanes = np.arange(0, n, _LANE)
    length = np.zeros(len(lanes), np.int64)
    for step in range(min(_LANE, n)):
        i = lanes + step
        inside = i < n
        i, length = i[inside], np.maximum(length[inside] - 1, 0)
        length[~ordered[i]] = 0
        lanes = lanes[inside]
        j = before[i]
        length[j < 0] = 0
        grow = np.flatnonzero((j >= 0) & (length < depth))
        while len(grow):
            a, b = i[grow] + length[grow], j[grow] + length[grow]
            ok = (a < n) & (b < n)
            ok[ok] = data[a[ok]] == data[b[ok]]
            grow = grow[ok]
            length[grow] += 1
            grow = grow[length[grow] < depth]
        shared[i] = length
    return shared[order]


def _suffix_arrays(window: int):
    """Per shard: runs of repeated windows, and one digest per window of spread anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "shard"):
            group = group.combine_chunks()
            data, at = text_bytes(group.column("piece"))
            n, count = group.column("n").to_numpy(), group.column("m").to_numpy()
            spread = group.column("spread").to_numpy(zero_copy_only=False)
            order, _ = suffix_array(data, window)
            shared = common_prefixes(data, order, window)
            piece = np.repeat(np.arange(len(n)), np.diff(at))
            offset = np.arange(len(data)) - at[piece]
            places = np.flatnonzero((offset < n[piece])[order])
            suffix = order[places]
            owner = piece[suffix]
            # What two windows share is the least of the places between them.
            equal = np.zeros(len(places), bool)
            equal[1:] = np.minimum.reduceat(shared[: places[-1] + 1], places[:-1] + 1) >= window if len(places) > 1 else False
            same = np.cumsum(~equal) - 1
            repeats = (np.bincount(same, weights=count[owner]) >= 2)[same]
            marks = np.zeros(len(data), bool)
            marks[suffix[repeats]] = True
            first = np.flatnonzero(marks & ((offset == 0) | ~np.append(False, marks[:-1])))
            last = np.flatnonzero(marks & np.append((offset[1:] == 0) | ~marks[1:], True))
            yield _rows(group, piece[first], offset[first], offset[last])
            head = ~equal & spread[owner]
            if head.any():
                digest = RollingHash(byte_values(data)).of(suffix[head], suffix[head] + window)
                yield _rows(group, owner[head], offset[suffix[head]], offset[suffix[head]], digest, ~repeats[head])

    return run


def _rows(group: pa.Table, piece: np.ndarray, a: np.ndarray, b: np.ndarray, digest: np.ndarray | None = None, alone: np.ndarray | None = None) -> pa.RecordBatch:
    k, f = (group.column(c).combine_chunks().take(pa.array(piece)) for c in ("k", "f"))
    digests = pa.nulls(len(a), pa.int64()) if digest is None else signed(digest)
    flags = pa.nulls(len(a), pa.bool_()) if alone is None else pa.array(alone)
    return pa.RecordBatch.from_arrays([k, f, pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), digests, flags], ["k", "f", "a", "b", "digest", "alone"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that no shard found repeated by itself, but that start in two shards or more.

    Each shard sent a digest once, so a digest has as many rows as shards.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    digests = table.column("digest").to_numpy()
    places = np.searchsorted(digests, digests, "right") - np.searchsorted(digests, digests, "left")
    found = table.filter(pa.array((places > 1) & table.column("alone").to_numpy(zero_copy_only=False)))
    yield from found.select(["k", "f", "a", "b"]).to_batches()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = text_bytes(batch.column("text"))
        rows = []
        for i, spans in enumerate(span_lists(batch)):
            own = data[at[i] : at[i + 1]]
            gone = span_marks(spans, len(own))
            runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            rows.append((len(own), int(gone.sum()), runs, hashlib.sha256(own[~gone].tobytes()).hexdigest()))
        n_bytes, n_removed, n_spans, sha = zip(*rows, strict=True) if rows else ((),) * 4
        longs = [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *longs, pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = text_bytes(batch.column("text"))
        null = batch.column("text").is_null().to_numpy(zero_copy_only=False)
        texts = []
        for i, spans in enumerate(span_lists(batch)):
            own = data[at[i] : at[i + 1]]
            gone = span_marks(spans, len(own))
            # A character goes if all its bytes go.
            heads = np.flatnonzero((own & 0xC0) != 0x80)
            if len(heads) and gone.any():
                whole = np.logical_and.reduceat(gone, heads)
                gone = np.repeat(whole, np.diff(np.append(heads, len(own))))
            texts.append(None if null[i] else own[~gone].tobytes().decode("utf-8"))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])
