"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole. Each token's span of characters follows
from the bytes of its id, and is joined to the sections' spans (both ascending,
so the interval join is a binary search of the token's ends among the section
boundaries). A token within one section counts there. A token that crosses a
boundary goes to the section that holds most of its characters; of equal ones,
to the earlier. So section counts always add up to the document's count, which
encoding the sections one by one would not give.

The vocabulary is a public file of byte pair ranks, read on the executors.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that goes with these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The encoder's pattern engine recurses over white space, so longer runs are encoded by themselves.
_LONG_SPACE = regex.compile(r"\p{White_Space}{2000,}")


class Tokens:
    """An encoder with the number of bytes of each id."""

    def __init__(self, ranks_file: str):
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._size = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for piece, rank in ranks.items():
            self._size[rank] = len(piece)

    def ids(self, text: str) -> list[int]:
        out, at = [], 0
        for run in _LONG_SPACE.finditer(text):
            # The pattern never goes on from other characters into white space, and
            # leaves the last of a run to the word that follows.
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += self._encoding.encode_ordinary(text[at : run.start()])
            out += self._encoding._encode_single_piece(text[run.start() : end])
            at = end
        return out + self._encoding.encode_ordinary(text[at:])

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and last (not included) character of each token.

        A token that holds only some bytes of a character covers that character.
        """
        ends = np.cumsum(self._size[np.array(self.ids(text), np.int64)]) if text else np.zeros(0, np.int64)
        starts = np.append(0, ends[:-1]) if len(ends) else ends
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        if len(data) == len(text):
            return starts, ends
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        return character[starts], character[ends - 1] + 1


def line_sections(text: str) -> np.ndarray:
    """First character of each line; a line holds the line feed that ends it."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = np.append(0, np.flatnonzero(codes == 10) + 1)
    return starts[starts < len(codes)]


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary), for ascending section starts."""
    first = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, np.maximum(ends - 1, starts), "right") - 1
    chosen = first.copy()
    bounds = np.append(sections, length)
    for i in np.flatnonzero(first != last):
        own = np.arange(first[i], last[i] + 1)
        held = np.minimum(bounds[own + 1], ends[i]) - np.maximum(bounds[own], starts[i])
        chosen[i] = own[np.argmax(held)]
    return chosen, first != last


def section_tokens(docs: DataFrame, ranks_file: str = RANKS, id_column: str = "doc_id", text_column: str = "text", sections=line_sections) -> DataFrame:
    """(``doc_id``, ``n_tokens``, ``n_sections``, ``n_crossing``, ``section_tokens``) per row of ``docs``.

    ``sections`` gives the ascending first characters of a text's sections, 0
    among them; by default its lines. ``section_tokens`` lists their counts in
    order, and adds up to ``n_tokens``. A null or empty text has no tokens and no
    sections, an empty list. Special tokens' strings are plain text. Repeated
    rows get a row each; other columns are ignored, whatever their names. The
    ranks file must be on every executor under the same path.
    """
    return _counted(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.array(F.col(text_column).cast("string")).alias("fields")), ranks_file, sections)


def field_tokens(rows: DataFrame, fields: list[str], ranks_file: str = RANKS, id_column: str = "doc_id", joint: str = "\n") -> DataFrame:
    """Like ``section_tokens``, for rows whose text is several fields joined by ``joint``.

    Each field is a section and holds the joint behind it; a null field is empty.
    """
    values = F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    parts = F.transform(values, lambda v, i: F.when(i < len(fields) - 1, F.concat(v, F.lit(joint))).otherwise(v))
    return _counted(rows.select(F.col(id_column).cast("long").alias("doc_id"), parts.alias("fields")), ranks_file, None)


@lru_cache(maxsize=2)
def _tokens(ranks_file: str) -> Tokens:
    return Tokens(ranks_file)


def _counted(rows: DataFrame, ranks_file: str, sections) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(ranks_file)
        for batch in batches:
            counts, crossing = [], []
            for fields in batch.column("fields").to_pylist():
                text = "".join(f or "" for f in fields)
                bounds = sections(text) if sections else np.cumsum([0, *map(len, fields[:-1])])
                starts, ends = tokens.spans(text)
                chosen, crosses = attribute(starts, ends, bounds, len(text))
                counts.append(np.bincount(chosen, minlength=len(bounds)))
                crossing.append(int(crosses.sum()))
            sizes = np.array([len(c) for c in counts], np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            flat = pa.array(np.concatenate(counts or [np.zeros(0)]).astype(np.int32))
            totals = pa.array([int(c.sum()) for c in counts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), totals, pa.array(sizes), pa.array(crossing, pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"],
            )

    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<int>")
