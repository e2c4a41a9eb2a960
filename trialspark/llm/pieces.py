"""SentencePiece encoding by a streaming Viterbi, and decoding.

Positions of the normalized text form a lattice whose edges are vocabulary
pieces. The encoder goes over it once, from left to right, and keeps only a
window of the longest piece's length: the best piece that ends at each position
(its backpointer) and its score. Whenever the backpointer paths of all positions
that can still be extended meet in one boundary, the ids before it are final and
leave the window, so a text of any length needs bounded state.

- ``unigram`` models: the best piece maximizes the sum of scores.
- ``bpe`` models: merging the best-scored pair until none is left gives, for each
  prefix, one last piece, and a sequence is that encoding exactly if every two
  neighbours encode to themselves. So a position's backpointer is the one piece
  that is compatible with the last piece of the prefix before it. This finds the
  same ids as the merges, without holding the text.

If no piece holds a space mark after another character, all paths meet before
each such mark; the text then falls into short segments whose ids are remembered
(a bounded table), as natural texts repeat them.

Normalization (the model's own rules) is the library's; so are the vocabulary
file's entries. Nothing is trained here.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from trialspark.llm.batches import chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of segments, and numbers of pairs and starts, that a task remembers: about 64, 25 and 30 MB.
REMEMBERED_BYTES = 64 << 20
REMEMBERED = 1 << 18
REMEMBERED_STARTS = 1 << 17
# What a remembered segment takes beside its characters and ids: two objects and a place in the table.
_ENTRY = 190
#: Characters of segments that are encoded together; a longer one goes through a stream.
SHORT = 64
#: Characters that mostly tell which pieces start at a position.
AHEAD = 5
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Vocabulary:
    """The pieces of a model file that text can match, and those that stand for bytes."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor, kind: str):
        self.kind = kind
        self.ids, self.scores, self.bytes = {}, [0.0] * model.vocab_size(), {}
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.scores[i] = i, model.get_score(i)
        self.unknown = model.unk_id()
        self.prepare()

    def prepare(self) -> None:
        self.longest = max(map(len, self.ids), default=1)
        self.prefixes = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.pieces = {i: p for p, i in self.ids.items()}
        self.penalty = min(self.scores, default=0.0) - 10.0
        self.pairs: dict[int, bool] = {}
        self.offers: dict[str, tuple] = {}
        if self.kind == "bpe":
            self.ids = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merged(p) == [p]}
        self.ends = dict.fromkeys((p[n:] for p in self.ids for n in range(len(p))), -1) | self.ids
        self.found = dict.fromkeys(self.prefixes) | {p: (len(p), i) for p, i in self.ids.items()}

    def merged(self, text: str) -> list[str]:
        """The pieces left when the best-scored neighbours are merged as long as any can be."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                made = ids.get(parts[i] + parts[i + 1])
                if made is not None and (best is None or scores[made] > best[0]):
                    best = (scores[made], i)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def starting(self, text: str, i: int) -> list[tuple[int, int]]:
        """(length, id) of the pieces that start at ``i``; remembered in ``offers`` if ``AHEAD`` characters tell."""
        out = []
        for j in range(i + 1, min(i + self.longest, len(text)) + 1):
            if text[i:j] not in self.found:
                break
            piece = self.found[text[i:j]]
            if piece:
                out.append(piece)
        if not out or out[0][0] > 1:  # a character without a piece of its own
            out.insert(0, (1, -1 - ord(text[i])))
        if i + AHEAD > len(text) or text[i : i + AHEAD] not in self.prefixes:
            if len(self.offers) >= REMEMBERED_STARTS:
                self.offers.clear()
            self.offers[text[i : i + AHEAD]] = tuple(out)
        return out

    def name(self, piece: int) -> str:
        """The text of an id; negative numbers are characters without a piece."""
        return self.pieces[piece] if piece >= 0 else chr(-1 - piece)

    def fits(self, left: int, right: int) -> bool:
        """Whether two neighbouring pieces stay apart when merged together; remembered in ``pairs``."""
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        a, b = self.name(left), self.name(right)
        known = self.pairs[left << 32 | right + (1 << 31)] = self.merged(a + b) == [a, b]
        return known


class Stream:
    """Feed characters, take final pieces: the lattice behind them is forgotten.

    After ``end`` the stream is over.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pending = ""  # text from the first position that is not final
        self.back = [None]  # at each position of it: (start, piece) that ends there
        self.best = [0.0]
        self.at = 0  # the next position to extend
        self.before = None  # the final piece in front of the window

    def feed(self, text: str, end: bool = False) -> list[int]:
        """The pieces that became final."""
        self.pending += text
        self.back += [None] * len(text)
        self.best += [0.0] * len(text)
        out: list[int] = []
        longest = self.vocabulary.longest
        while True:
            left = len(self.pending) - self.at - (0 if end else longest - 1)
            if left <= 0:
                break
            self._extend(min(left, 4 * longest))
            if self.at >= 4 * longest:
                out += self._commit()
        if end:
            out += self._path(len(self.pending))
        return out

    def _extend(self, count: int) -> None:
        """From each of the next positions, offer every piece to the position where it ends."""
        v, text, back, best = self.vocabulary, self.pending, self.back, self.best
        offers, pairs, fits, bpe, size = v.offers.get, v.pairs.get, v.fits, v.kind == "bpe", len(text)
        for i in range(self.at, self.at + count):
            if i and back[i] is None:
                continue
            last = back[i][1] if i else self.before
            ahead = offers(text[i : i + AHEAD])
            for length, piece in v.starting(text, i) if ahead is None else ahead:
                j = i + length
                if bpe:
                    if back[j] is None:
                        known = True if last is None else pairs(last << 32 | piece + (1 << 31))
                        if known or known is None and fits(last, piece):
                            back[j] = (i, piece)
                else:
                    score = best[i] + (v.scores[piece] if piece >= 0 else v.penalty)
                    if back[j] is None or score > best[j]:
                        back[j], best[j] = (i, piece), score
        self.at += count

    def _path(self, end: int) -> list[int]:
        out = []
        while end:
            end, piece = self.back[end]
            out.append(piece)
        return out[::-1]

    def _commit(self) -> list[int]:
        """Cut where the paths of all positions that can still grow have met."""
        ends = {p for p in range(self.at, min(self.at + self.vocabulary.longest, len(self.back))) if self.back[p] is not None}
        while len(ends) > 1:
            latest = max(ends)
            ends.remove(latest)
            ends.add(self.back[latest][0])
        met = ends.pop() if ends else 0
        if not met:
            return []
        out = self._path(met)
        self.before = out[-1]
        self.pending, self.at = self.pending[met:], self.at - met
        base = self.best[met]
        self.best = [x - base for x in self.best[met:]]
        self.back = [None] + [b if b is None else (b[0] - met, b[1]) for b in self.back[met + 1 :]]
        return out


class Lattice:
    """The lattice of short segments that come in order: what a segment shares with the one before is kept.

    The best piece that ends at a position depends on the text before it alone.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.text = ""
        self.starts: list[int | None] = [0]
        self.last: list[int | None] = [None]
        self.best = [0.0]

    def pieces(self, text: str) -> list[int]:
        """The pieces of a segment."""
        v, starts, last, best = self.vocabulary, self.starts, self.last, self.best
        ends, pairs, bpe, longest = v.ends.get, v.pairs.get, v.kind == "bpe", v.longest
        before, shared = self.text, 0
        for a, b in zip(text, before):  # noqa: B905
            if a != b:
                break
            shared += 1
        del starts[shared + 1 :], last[shared + 1 :], best[shared + 1 :]
        self.text = text
        for j in range(shared + 1, len(text) + 1):
            from_, piece_, score_ = None, None, 0.0
            for i in range(j - 1, max(-1, j - 1 - longest), -1):
                piece = ends(text[i:j])
                if piece is None and i < j - 1:
                    break
                if piece is None or piece < 0:
                    if i < j - 1:
                        continue
                    piece = -1 - ord(text[i])  # a character without a piece of its own
                left = last[i]
                if i and left is None:
                    continue
                if bpe:
                    fit = True if left is None else pairs(left << 32 | piece + (1 << 31))
                    if fit or fit is None and v.fits(left, piece):
                        from_, piece_ = i, piece
                        break
                else:
                    score = best[i] + (v.scores[piece] if piece >= 0 else v.penalty)
                    if piece_ is None or score >= score_:
                        from_, piece_, score_ = i, piece, score
            starts.append(from_)
            last.append(piece_)
            best.append(score_)
        out, end = [], len(text)
        while end:
            out.append(last[end])
            end = starts[end]
        return out[::-1]


class Encoder:
    """Text to ids and back, with the segments of earlier texts remembered."""

    def __init__(self, vocabulary: Vocabulary, normalize=None):
        self.vocabulary, self.normalize = vocabulary, normalize
        self._segments: dict[str, bytes] = {}
        self._lossy: set[str] = set()
        self._held = 0
        size = len(vocabulary.scores)
        text = {i: p.replace(SPACE, " ").encode() for i, p in vocabulary.pieces.items()}
        text |= {i: bytes([b]) for b, i in vocabulary.bytes.items()}
        self._text = [text.get(i, b"") for i in range(size)]

    def _ids(self, pieces: list[int]) -> bytes:
        if min(pieces, default=0) < 0:
            v, out, unknown = self.vocabulary, [], False
            for piece in pieces:
                if piece >= 0:
                    out.append(piece)
                elif v.bytes:
                    out += [v.bytes[b] for b in v.name(piece).encode("utf-8", "surrogatepass")]
                elif not unknown:  # neighbours without a piece are one unknown
                    out.append(v.unknown)
                unknown = piece < 0
            pieces = out
        return array("i", pieces).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, by the model's own normalization."""
        return self.round_trips([text])[0][0]

    def round_trips(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        """The ids of each text, and whether decoding them gives it back.

        Segments are decoded where they are encoded. The text of ids is that of
        their segments, so where all came back, decoding gives the normalized text.
        """
        normals = [self.normalize(t) if self.normalize else t for t in texts]
        if not self.vocabulary.splits or not self.vocabulary.bytes and any(normals):
            ids = [np.frombuffer(self._ids(self._stream(n)), np.int32) for n in normals]
            return [(i, self.decode(i) == t) for i, t in zip(ids, texts, strict=True)]
        parts = [_SEGMENT.findall(n) for n in normals]
        self._learn(set().union(*parts))
        known, lossy, out = self._segments, self._lossy, []
        for text, normal, own in zip(texts, normals, parts, strict=True):
            ids = np.frombuffer(b"".join([known[p] for p in own]), np.int32)
            whole = not lossy or lossy.isdisjoint(own)
            out.append((ids, (normal.replace(SPACE, " ").removeprefix(" ") if whole else self.decode(ids)) == text))
        return out

    def _learn(self, parts: set[str]) -> None:
        """Encode the segments that are not known, in order, so that each starts from the lattice of its beginning."""
        known = self._segments
        new = [p for p in parts if p not in known]
        if self._held + sum(map(len, new)) + _ENTRY * len(new) > REMEMBERED_BYTES:
            self._clear()
            new = list(parts)
        lattice = Lattice(self.vocabulary)
        for part in sorted(new):
            ids = self._ids(lattice.pieces(part) if len(part) <= SHORT else self._stream(part))
            if b"".join(map(self._text.__getitem__, array("i", ids))) != part.replace(SPACE, " ").encode("utf-8", "surrogatepass"):
                self._lossy.add(part)
            known[part] = ids
            self._held += len(part) + len(ids) + _ENTRY

    def _clear(self) -> None:
        self._segments.clear()
        self._lossy.clear()
        self._held = 0

    def forget(self) -> None:
        """Drop what was remembered; the vocabulary stays."""
        self._clear()
        self.vocabulary.pairs.clear()
        self.vocabulary.offers.clear()

    def _stream(self, text: str) -> list[int]:
        stream, out = Stream(self.vocabulary), []
        for i in range(0, len(text), 4096):
            out += stream.feed(text[i : i + 4096], i + 4096 >= len(text))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space that normalization puts in front goes."""
        return b"".join(map(self._text.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=4)
def encoder(model_file: str, kind: str) -> Encoder:
    """A worker's encoder for a model file."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return Encoder(Vocabulary(model, kind), model.normalize)


def encode_documents(docs: DataFrame, model_file: str = MODEL, kind: str = "bpe", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(``doc_id``, ``n_tokens``, ``ids``, ``round_trip``) per row of ``docs``, on whole texts.

    ``round_trip`` tells whether decoding the ids gives the text back. A null
    text has null ids, no tokens and no round trip; an empty one has no ids.
    Repeated rows are encoded alike. A text that holds the space mark itself
    (U+2581) or, in models whose normalization changes characters, others, does
    not come back unchanged, and says so. The model file must be on every
    executor under the same path. Other columns of ``docs`` are ignored.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_file, kind)
        for batch in batches:
            for part, _, _ in chunks(batch, "text", 1 << 20):
                texts = part.column("text").to_pylist()
                done = iter(own.round_trips([t for t in texts if t is not None]))
                done = [(None, None) if t is None else next(done) for t in texts]
                ids, same = [i for i, _ in done], [s for _, s in done]
                size = [0 if i is None else len(i) for i in ids]
                offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.append([i is None for i in ids], False))
                flat = pa.array(np.concatenate([i for i in ids if i is not None] or [np.zeros(0, np.int32)]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.ListArray.from_arrays(offsets, flat), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])
        own.forget()  # a worker serves other stages after this task

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, model_file: str = MODEL, kind: str = "bpe", id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(``doc_id``, ``text``) from ids; null ids give a null text."""
    rows = encoded.select(F.col(id_column).alias("doc_id"), F.col(ids_column).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_file, kind)
        for batch in batches:
            texts = [None if i is None else own.decode(np.array(i, np.int32)) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id long, text string")
