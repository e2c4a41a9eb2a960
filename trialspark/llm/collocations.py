"""Phrase collocations: counted level by level through broadcast double-array tries.

A phrase of k words can be frequent only if both of its parts of k - 1 words are
(Agrawal and Srikant, "Fast Algorithms for Mining Association Rules", 1994). So
level k broadcasts a trie of the frequent phrases of k - 1 words; in every task
numpy advances the states of all text positions at once by one word, and a
candidate is a position whose state and whose neighbour's state accept. Accepted
pairs of state and next word are counted with ``bincount``, and the sums of all
shards decide which are frequent. No hash stands for a word or a phrase: the
first trie reads the bytes of words, the others their numbers.

The tries are double arrays (Aoe, 1989): node ``s`` goes by symbol ``c`` to slot
``base[s] + c``, wrapped around the table, if ``check`` names ``s`` there. A trie is built in tasks, in parts
of bounded size; each part is one broadcast, a pass takes as many parts as a task
may hold, and all passes fill the same states. A pass deletes what the one before
it stored. Texts are reduced once to the numbers of frequent words, runs of
which are all that later levels read.
"""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from trialspark.llm.batches import Words, chunks, lower_ascii
from trialspark.session import cut_lineage, drop_table

LONGEST = 4
LEAST = 30
TOP = 2000
SCALE = 2_000_000
UNKNOWN = "und"
#: Text bytes of the words, and phrases, in one part of a trie, about.
PART_BYTES = 1 << 21
PART_PHRASES = 1 << 20
#: Bytes of tries that a task holds at once; more are further passes. One part is held whatever its size.
HELD_BYTES = 5 << 24
#: Text bytes, and word positions, that a task handles at once.
CHUNK = 1 << 20
POSITIONS = 1 << 20
#: Places of runs in a row, about, and rows that are handled at once.
RUN_WORDS = 1 << 10
ROWS = 1 << 8

_BYTES = np.arange(256)
_MARKS = np.isin(_BYTES, list(b".,;:!?\n\x0b\x0c\r"))
_BETWEEN = _MARKS | np.isin(_BYTES, list(b" \t"))


# --- double arrays ------------------------------------------------------------------------


class DoubleArray:
    """Transitions (node, symbol) -> child as two arrays, looked up for many nodes at once."""

    def __init__(self, base: np.ndarray, check: np.ndarray, child: np.ndarray):
        self.base, self.check, self.child = base, check, child

    @classmethod
    def build(cls, nodes: int, parent: np.ndarray, symbol: np.ndarray, child: np.ndarray) -> DoubleArray:
        """From transitions sorted by (parent, symbol), each once; symbols are small numbers.

        Parents with many children take their slots first, at some free offset
        or at the end of the table; parents with one child fill the gaps.
        """
        start = np.searchsorted(parent, np.arange(nodes + 1))
        count = np.diff(start)
        base, random, used = np.zeros(nodes, np.int64), np.random.default_rng(5), np.zeros(1024, bool)
        top = 0  # all slots from here on are free
        for p in np.argsort(-count, kind="stable")[: int((count > 1).sum())].tolist():
            own = symbol[start[p] : start[p + 1]]
            span = int(own[-1]) + 1
            if top + span > len(used):
                used = np.append(used, np.zeros(len(used) + span, bool))
            offsets = random.integers(0, top + 1, 64)
            free = np.flatnonzero(~used[offsets[:, None] + own].any(axis=1))
            base[p] = offsets[free[0]] if len(free) else top - int(own[0]) if top >= own[0] else top
            used[base[p] + own] = True
            top = max(top, int(base[p]) + span)
        lone = np.flatnonzero(count == 1)
        gaps = np.flatnonzero(~used[:top])[: len(lone)]
        gaps = np.append(gaps, np.arange(top, top + len(lone) - len(gaps)))
        base[lone] = gaps - symbol[start[lone]]
        slot = base[parent] + symbol
        size = int(slot.max()) + 1 if len(slot) else 1
        check, target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        check[slot], target[slot] = parent, child
        return cls(base.astype(np.int32), check, target)

    def step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The child of each node, or -1; a node of -1 has none."""
        slot = self.base[node].astype(np.int64) + symbol
        inside = (slot >= 0) & (slot < len(self.check)) & (node >= 0)
        slot[~inside] = 0
        return np.where(inside & (self.check[slot] == node), self.child[slot], -1)


def _grown(roots: int, node: np.ndarray, symbols_of: Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]], ids: np.ndarray) -> dict[str, np.ndarray]:
    """The trie of keys that start at the nodes ``node`` (below ``roots``), one symbol of every key at a time.

    ``symbols_of(keys, depth)`` tells which of the keys end at a depth, and the
    symbols of the others. ``accept`` holds a key's id at its last node, 0 elsewhere.
    """
    node, nodes, depth, left = node.astype(np.int64), roots, 0, np.arange(len(ids))
    parents, symbols, ends, accepted = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(left):
        over, symbol = symbols_of(left, depth)
        ends.append(node[left[over]])
        accepted.append(ids[left[over]])
        left = left[~over]
        made, which = np.unique(node[left] << 16 | symbol, return_inverse=True)
        parents.append(made >> 16)
        symbols.append(made & 0xFFFF)
        node[left] = nodes + which
        nodes, depth = nodes + len(made), depth + 1
    parent, symbol = np.concatenate(parents), np.concatenate(symbols)
    order = np.lexsort((symbol, parent))
    trie = DoubleArray.build(nodes, parent[order], symbol[order], np.arange(roots, nodes)[order])
    accept = np.zeros(nodes, np.int32)
    accept[np.concatenate(ends)] = np.concatenate(accepted)
    return {"base": trie.base, "check": trie.check, "child": trie.child, "accept": accept}


def word_trie(words: list[bytes], ids: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a trie over the bytes of distinct words."""
    size = np.array([len(w) for w in words], np.int64)
    data, start = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)

    def symbols_of(keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        over = size[keys] == depth
        return over, data[start[keys[~over]] + depth].astype(np.int64)

    return _grown(1, np.zeros(len(words), np.int64), symbols_of, ids)


def digits(symbols: int) -> tuple[int, int]:
    """Into how many digits of how many bits word numbers below ``symbols`` are split."""
    bits = max(1, (symbols - 1).bit_length())
    count = -(-bits // 10)
    return count, -(-bits // count)


def phrase_trie(low: int, parent: np.ndarray, symbol: np.ndarray, ids: np.ndarray, symbols: int) -> dict[str, np.ndarray]:
    """The arrays of the transitions from phrases ``low`` on by one word of ``symbols``.

    The number of a word is read digit by digit, so that the children of a node
    lie close together, as double arrays need it.
    """
    count, bits = digits(symbols)
    own = parent - low

    def symbols_of(keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        over = np.full(len(keys), depth == count)
        return over, symbol[keys[~over]] >> bits * (count - 1 - depth) & (1 << bits) - 1

    return _grown(int(own.max()) + 1, own, symbols_of, ids) | {"low": np.array([low, own.max() + 1, count, bits])}


def followed(trie: DoubleArray, more: dict[str, np.ndarray], phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The phrase that each phrase becomes by one more word, or 0; phrases of other parts become none."""
    low, nodes, count, bits = more["low"].tolist()
    node = np.where((phrase >= low) & (phrase < low + nodes), phrase - low, -1)
    for place in range(count - 1, -1, -1):
        node = trie.step(node, word >> bits * place & (1 << bits) - 1)
    return np.where(node >= 0, more["accept"][node], 0)


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _arrays(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data)))


def _trie(arrays: dict[str, np.ndarray]) -> tuple[DoubleArray, dict[str, np.ndarray]]:
    return DoubleArray(arrays["base"], arrays["check"], arrays["child"]), arrays


def _unpacked(data: bytes) -> tuple[DoubleArray, dict[str, np.ndarray]]:
    return _trie(_arrays(data))


# --- words --------------------------------------------------------------------------------


class Tokens:
    """The words of a chunk of texts (A-Z lower-cased), and where a piece of text begins."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data = lower_ascii(data)
        words = Words(self.data, at, _BETWEEN)
        self.starts, self.ends = words.starts, words.ends
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(words.rows))
        piece = np.cumsum(_MARKS[self.data])[self.starts]
        self.first = np.ones(len(self.starts), bool)
        self.first[1:] = (piece[1:] != piece[:-1]) | (self.row[1:] != self.row[:-1])
        self.words = words

    def counted(self, own: np.ndarray, hashes: np.ndarray) -> Counter:
        """The distinct words among those at ``own``, by their bytes, and how often each occurs."""
        _, first, which, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        starts, size = self.starts[own], (self.ends - self.starts)[own]
        like = first[which]
        same = size == size[like]
        ahead = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        if same.all():
            same &= (self.data[np.repeat(starts, size) + ahead] == self.data[np.repeat(starts[like], size) + ahead]).all()
        text = self.data.tobytes()
        if same.all():
            return Counter({text[a : a + n]: c for a, n, c in zip(starts[first].tolist(), size[first].tolist(), count.tolist(), strict=True)})
        return Counter(text[a : a + n] for a, n in zip(starts.tolist(), size.tolist(), strict=True))  # two words share a hash


def _langs(part: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    """The languages of a chunk's rows, and the number of each row's."""
    coded = part.column("lang").dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, at in chunks(batch, "text", CHUNK):
            tokens, (langs, of) = Tokens(data, at), _langs(part)
            hashes = tokens.words.hashes()
            for i, lang in enumerate(langs):
                own = np.flatnonzero(of[tokens.row] == i)
                found = tokens.counted(own, hashes[own]) if len(own) else {}
                names = pa.array([None, *found], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(found) + 1), pa.string()), names, pa.array([len(own), *found.values()], pa.int64())], ["lang", "word", "n"])


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """(``lang``, ``word``, ``n``) of words with at least ``least`` occurrences; a null word is all words of the language."""
    counts = docs.mapInArrow(_word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return counts.filter((F.col("n") >= least) | F.col("word").isNull())


def _numbered(rows: DataFrame, order: str) -> tuple[DataFrame, int]:
    """``rows`` with ``id`` from 1 on, numbered within their ``part``, and the largest possible id."""
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.max("part").alias("last")).first()
    width, last = sizes["n"] or 0, sizes["last"] or 0
    if width * (last + 1) >= 1 << 31:
        raise ValueError(f"{width * (last + 1)} phrases do not fit the numbers of a trie; raise the least count")
    place = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return rows.withColumn("id", (F.col("part") * width + place).cast("int")), width * (last + 1)


def _passes(tries: DataFrame) -> Iterator[tuple[list[Broadcast], bool]]:
    """The broadcast parts of the tries of each pass, and whether it is the last; those of one pass are alive at a time."""
    passes, held = [], 0
    for row in sorted(tries.select("part", F.octet_length("trie").alias("size")).collect()):
        if not passes or held + row["size"] > HELD_BYTES:
            passes.append([])
            held = 0
        passes[-1].append(row["part"])
        held += row["size"]
    for parts in passes:
        alive = [tries.sparkSession.sparkContext.broadcast(_arrays(bytes(tries.filter(F.col("part") == p).first()["trie"]))) for p in parts]
        yield alive, parts is passes[-1]
        for one in alive:
            one.destroy()


def _filled(table: DataFrame, tries: DataFrame, fill: Callable[[list[Broadcast], bool], Callable], between: str) -> DataFrame:
    """The runs after all passes of the tries, which are deleted; rows are ``between`` passes.

    A pass reads what the one before it stored, which goes when the pass ends.
    """
    for alive, last in _passes(tries):
        done = cut_lineage(table.mapInArrow(fill(alive, last), _RUNS if last else between), "runs")
        drop_table(table)
        table = done
    drop_table(tries)
    return table


# --- levels -------------------------------------------------------------------------------


def _collapsed(w: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Runs of words, one 0 between them and at both ends, and the numbers at the same places of ``more``."""
    end = np.zeros(1, np.int32)
    w = np.concatenate([end, w, end])
    keep = (w != 0) | np.append(True, w[:-1] != 0)
    return [w[keep], *(np.concatenate([end, x, end])[keep] for x in more)]


def _lists(column: str, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a list column, and where each row's begin."""
    lists = batch.column(column)
    at = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


# Words of runs and the states at them; no states where those of single words are meant, which are the words.
_RUNS = "lang string, w array<int>, node array<int>"


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Runs from some rows of one language at a time."""
    if not batch.num_rows:
        return
    langs, of = _langs(batch)
    (w, at), (node, node_at) = _lists("w", batch), _lists("node", batch)
    group = np.arange(len(of)) // ROWS
    ends = np.append(np.flatnonzero((of[1:] != of[:-1]) | (group[1:] != group[:-1])) + 1, len(of)).tolist()
    for a, b in zip([0, *ends], ends, strict=False):
        own, states = w[at[a] : at[b]], node[node_at[a] : node_at[b]]
        yield langs[of[a]], own, states if len(states) else own


def _run_batch(parts: list[tuple[str, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of about ``RUN_WORDS`` places, which begin between runs: readers hold many rows at once."""

    def packed(arrays: list[np.ndarray], sizes: list[np.ndarray]) -> pa.Array:
        at = np.concatenate([[0], *sizes]).cumsum().astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*arrays, np.zeros(0, np.int32)])))

    sizes = []
    for _, w, _ in parts:
        breaks = np.flatnonzero(w[:-1] == 0)
        first = breaks[np.append(True, breaks[1:] // RUN_WORDS != breaks[:-1] // RUN_WORDS)] if len(breaks) else breaks
        sizes.append(np.diff(np.concatenate([[0], first[first > 0], [len(w)]])))
    langs = pa.array([lang for (lang, _, _), size in zip(parts, sizes, strict=True) for _ in range(len(size))], pa.string())
    states = [size if len(node) else size * 0 for (_, _, node), size in zip(parts, sizes, strict=True)]
    return pa.RecordBatch.from_arrays([langs, packed([p[1] for p in parts], sizes), packed([p[2] for p in parts], states)], ["lang", "w", "node"])


def _encoded(held: list[Broadcast], last: bool) -> Callable:
    """Word numbers of the texts from some parts of the word trie.

    Texts that further parts must see keep their numbers so far beside them.
    """

    def numbers(tokens: Tokens, before: np.ndarray | None) -> np.ndarray:
        out = np.zeros(len(tokens.starts), np.int32) if before is None else before.copy()
        for array, more in (_trie(one.value) for one in held):
            open_words, depth = np.flatnonzero(out == 0), 0
            node = np.zeros(len(open_words), np.int32)
            while len(open_words):
                over = tokens.starts[open_words] + depth == tokens.ends[open_words]
                found = more["accept"][node[over]]
                ended = open_words[over]
                out[ended[found > 0]] = found[found > 0]
                open_words, node = open_words[~over], node[~over]
                node = array.step(node, tokens.data[tokens.starts[open_words] + depth])
                open_words, node, depth = open_words[node >= 0], node[node >= 0], depth + 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch, "text", CHUNK):
                tokens = Tokens(data, at)
                before = None
                if part.column("w").null_count < part.num_rows:
                    before = _lists("w", part)[0]
                w = numbers(tokens, before)
                if not last:
                    sizes = np.bincount(tokens.row, minlength=part.num_rows)
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("text"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(w))], ["lang", "text", "w"])
                    continue
                langs, of = _langs(part)
                rows = []
                for i, lang in enumerate(langs):
                    own = of[tokens.row] == i
                    # A break stands before every piece: twice as many places, the even ones for breaks.
                    places = np.zeros(2 * int(own.sum()), np.int32)
                    places[1::2] = w[own]
                    keep = np.ones(len(places), bool)
                    keep[::2] = tokens.first[own]
                    (runs,) = _collapsed(places[keep])
                    rows.append((lang, runs, runs[:0]))
                yield _run_batch(rows)

    return run


def _advanced(size: int, held: list[Broadcast], last: bool) -> Callable:
    """States of ``size`` words from states of one less and some parts of their trie.

    A position that is done has its new state as a negative number until the last part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, w, node in _runs(batch):
                node = node.copy()
                for one in held:
                    at = np.flatnonzero(node[: max(0, len(w) - size + 1)] > 0)
                    child = followed(*_trie(one.value), node[at], w[at + size - 1])
                    node[at[child > 0]] = -child[child > 0]
                if last:
                    node = np.where(node < 0, -node, 0).astype(np.int32)
                    near = np.zeros(len(w) + size, np.int32)
                    np.add.at(near, np.flatnonzero(node), 1)
                    np.add.at(near, np.flatnonzero(node) + size, -1)
                    w, node = _collapsed(np.where(np.cumsum(near, dtype=np.int32)[: len(w)] > 0, w, 0).astype(np.int32), node)
                yield _run_batch([(lang, w, node)])

    return run


def _candidates(size: int) -> Callable:
    """Counts of the phrases of ``size`` words whose both parts of one word less are frequent.

    A phrase is the state of its first part and its last word, in one number.
    """

    def summed(lang: str, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate(parts)
        codes.sort()
        new = np.append(True, codes[1:] != codes[:-1])
        count = np.bincount(np.cumsum(new, dtype=np.int32) - 1)
        table = pa.table({"lang": pa.repeat(pa.scalar(lang, pa.string()), len(count)), "code": codes[new], "n": count.astype(np.int64)})
        yield from table.to_batches(1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        waiting = 0
        for batch in batches:
            for lang, w, node in _runs(batch):
                count = max(0, len(w) - size + 1)
                at = np.flatnonzero((node[:count] > 0) & (node[1 : count + 1] > 0) & (w[size - 1 : size - 1 + count] > 0)) if count else np.zeros(0, np.int64)
                if len(at):
                    held.setdefault(lang, []).append(node[at].astype(np.int64) << 32 | w[at + size - 1])
                    waiting += len(at)
                if waiting >= POSITIONS:
                    for name, parts in held.items():
                        yield from summed(name, parts)
                    held, waiting = {}, 0
        for name, parts in held.items():
            yield from summed(name, parts)

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((``lang``, ``phrase``, ``size``, ``f``) of all frequent phrases, (``lang``, ``n``) of all words).

    ``docs`` holds ``lang`` and ``text``, neither null.
    """
    spark = docs.sparkSession
    counts = cut_lineage(word_counts(docs, least), "words")
    totals = counts.filter("word IS NULL").select("lang", "n")
    words = counts.filter("word IS NOT NULL")
    distinct = words.select("word").distinct()
    total = distinct.agg(F.coalesce(F.sum(F.octet_length("word") + 1), F.lit(0)).alias("b")).first()["b"]
    every = words.select("lang", F.col("word").cast("string").alias("phrase"), F.lit(1).alias("size"), F.col("n").alias("f"))
    if not total:
        return every, totals
    parts = -(-total // PART_BYTES)
    known, numbers = _numbered(distinct.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int")), "word")
    known = cut_lineage(known, "numbered-words")

    def words_of(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": part["part"].iloc[:1], "trie": [_packed(word_trie([bytes(w) for w in part["word"]], part["id"].to_numpy()))]})

    tries = cut_lineage(known.groupBy("part").applyInPandas(words_of, "part int, trie binary"), "tries")
    runs = _filled(docs.withColumn("w", F.lit(None).cast("array<int>")), tries, _encoded, "lang string, text string, w array<int>")
    phrases, names = every, known.select("id", F.col("word").cast("string").alias("word"))
    before = known.select("id", F.col("word").cast("string").alias("phrase"))
    for size in range(2, longest + 1):
        found = runs.mapInArrow(_candidates(size), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("f"))
        found = cut_lineage(found.filter(F.col("f") >= least), "phrases")
        made = found.select("code").distinct().select("code", F.shiftright("code", 32).cast("int").alias("parent"), F.col("code").bitwiseAND((1 << 32) - 1).cast("int").alias("symbol"))
        total = made.count()
        if not total:
            break
        ends = made.agg(F.min("parent").alias("a"), F.max("parent").alias("b")).first()
        width = -(-(ends["b"] - ends["a"] + 1) // -(-total // PART_PHRASES))
        made, _ = _numbered(made.withColumn("part", F.floor((F.col("parent") - ends["a"]) / width).cast("int")), "code")
        made = cut_lineage(made, "numbered-phrases")
        named = made.join(before.withColumnRenamed("id", "parent"), "parent").join(names.withColumnRenamed("id", "symbol"), "symbol")
        before = cut_lineage(named.select("id", "code", F.concat_ws(" ", "phrase", "word").alias("phrase")), "names")
        phrases = phrases.unionByName(found.join(before, "code").select("lang", "phrase", F.lit(size).alias("size"), "f"))
        before = before.select("id", "phrase")
        if size == longest:
            break

        def phrases_of(part: pd.DataFrame) -> pd.DataFrame:
            own = [part[c].to_numpy().astype(np.int64) for c in ("parent", "symbol", "id")]
            return pd.DataFrame({"part": part["part"].iloc[:1], "trie": [_packed(phrase_trie(int(own[0].min()), *own, numbers + 1))]})

        tries = cut_lineage(made.groupBy("part").applyInPandas(phrases_of, "part int, trie binary"), "tries")
        runs = _filled(runs, tries, partial(_advanced, size), _RUNS)
    drop_table(runs)
    return cut_lineage(phrases, "all-phrases"), totals


# --- scores -------------------------------------------------------------------------------


def _joined(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The first ``top`` phrases of every language by how much their parts stick together.

    (``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``). Texts
    have A-Z lower-cased and are split at ``.,;:!?`` and line ends into pieces, and
    those at blanks and tabs into words; a phrase lies within a piece. ``a`` is the
    number of occurrences of a phrase of two to four words, at least ``least``; ``l``
    and ``r`` those of its two parts at the cut with the lowest score, the first of
    equal ones; the score is ``floor(2000000 a / (l + r))``; ``n`` counts the
    language's words. A phrase is left out if a longer frequent one that contains
    it has 80 % of its occurrences. Ties of score and ``a`` go by the phrase's bytes.

    A null language is ``und``, a null text is empty. Every row counts, also
    repeated ones and those without an id. A table without frequent phrases, or
    without rows, gives none. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    phrases, totals = frequent_phrases(rows, least)
    candidates = phrases.filter("size > 1").withColumn("words", F.split("phrase", " "))
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    cuts = candidates.select("lang", "phrase", "size", F.col("f").alias("a"), "words", cut.alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", _joined(F.col("words"), 1, F.col("k")).alias("left"), _joined(F.col("words"), F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    known = phrases.select("lang", F.col("phrase").alias("part"), "f")
    cuts = cuts.join(known.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    exact = F.expr(f"CAST(a AS DECIMAL(20, 0)) * {SCALE} div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    best = F.row_number().over(Window.partitionBy("lang", "phrase").orderBy("score", "k"))
    scored = cuts.withColumn("score", exact.cast("long")).withColumn("place", best).filter("place = 1").select("lang", "phrase", "a", "l", "r", "score")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: _joined(F.col("words"), i, m))))
    inner = candidates.filter("size > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    apart = scored.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < 80 * F.col("a")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = apart.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
