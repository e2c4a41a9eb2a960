"""Near-duplicate documents by a chosen-path set similarity join.

After Christiani and Pagh, "Set Similarity Search Beyond MinHash" (2017), and
Christiani, Pagh and Sivertsen, "Scalable and Robust Set Similarity Join" (2018).
A document is a set of word shingles with a signature of minwise tokens. Each
tree starts from one selected token; documents that agree on it share a node. A
node that is still large selects ``BRANCHES`` further coordinates by a hash of
its path and splits on their tokens; a small node is compared exhaustively.
Independent trees repeat this, so that a pair at the threshold is missed with a
probability below 2e-5, and every reported link is confirmed on the full sets.

Hot groups: documents with equal sets are one class before the trees start, node
sizes are counted with map-side aggregation before rows are shuffled, and each
node that reaches a task is bounded by ``NODE_DOCS`` and ``NODE_SHINGLES``. A
node that does not shrink (a dense group of near copies) is cut into blocks, and
each pair of blocks is one task. Inside a node, documents already in one
component are not compared again, so a dense group costs about one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trialspark.llm.batches import Words, chunks, lower_ascii, mix, shingle_sets, signed, sorted_groups
from trialspark.operators.components import connected_components
from trialspark.session import cut_lineage

COORDINATES = 64
TREES = 8
BRANCHES = 2
MAX_DEPTH = 5
NODE_DOCS = 2048
NODE_SHINGLES = 1 << 22
_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_SHIFTS = np.random.default_rng(12).integers(1, 1 << 63, COORDINATES, dtype=np.uint64)
#: Standard deviations of the signature's estimate below the threshold at which a pair is still compared.
SLACK = 6.0

_SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, sig array<int>"


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(``doc_id``, ``n_shingles``, ``component_id``, ``kept``), one row per row of ``docs``.

    Two documents are linked if ``100 * |A & B| >= percent * |A | B|`` on their
    sets of ``words``-word shingles (A-Z lower-cased). ``component_id`` is the
    smallest ``doc_id`` reachable over links; ``kept`` marks that document.

    A text with fewer words is one shingle; a null, empty or wordless text has
    the empty set and no link. Repeated rows get a row each; if a ``doc_id``
    repeats with different texts, it links whatever either text links. A row
    without a ``doc_id`` is kept, with a null component. Other columns of
    ``docs`` are ignored, whatever their names.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    signed_docs = cut_lineage(docs.mapInArrow(_signatures(words), _SIGNED), "signatures")
    classes = signed_docs.filter("n_shingles > 0").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")
    )
    classes = cut_lineage(classes.filter("rep IS NOT NULL"), "classes")
    nodes = _nodes(classes, percent)
    links = cut_lineage(_verified(docs, _clusters(nodes, classes, percent), words, percent), "links")
    members = signed_docs.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "d1", "d2")
    own = members.join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # Copies hang on their representative; only representatives are searched.
    repeated = own.join(classes.select(F.col("rep").alias("a")), "a", "left_semi")
    roots, _ = connected_components(links.select("a", "b").union(repeated))
    reps = classes.select("d1", "d2", "rep")
    rows = signed_docs.join(reps, ["d1", "d2"], "left").withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")))
    key = F.coalesce("rep", "doc_id")
    rows = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), key).alias("key")).join(roots, "key", "left")
    component = F.coalesce("root", "key")
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def _digest(values: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit digests of a set."""
    with np.errstate(over="ignore"):
        return int(mix(values).sum(dtype=np.uint64)), int(mix(values ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64))


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch, "text"):
                found = Words(lower_ascii(data), at)
                sets = shingle_sets(found.hashes(), found.rows, words)
                sizes = np.array([len(s) for s in sets], np.int64)
                digests = np.array([_digest(s) for s in sets], np.uint64).reshape(-1, 2)
                tokens = np.zeros((len(sets), COORDINATES), np.int32)
                some = np.flatnonzero(sizes)
                if len(some):
                    values = np.concatenate([sets[i] for i in some])
                    starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                    for c in range(COORDINATES):
                        ranked = (values * _MULTIPLIERS[c] + _SHIFTS[c]) >> np.uint64(32)
                        tokens[some, c] = np.minimum.reduceat(ranked, starts).astype(np.uint32).view(np.int32)
                sig = pa.ListArray.from_arrays(pa.array(np.arange(0, tokens.size + 1, COORDINATES, dtype=np.int32)), pa.array(tokens.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes), signed(np.ascontiguousarray(digests[:, 0])), signed(np.ascontiguousarray(digests[:, 1])), sig],
                    ["doc_id", "n_shingles", "d1", "d2", "sig"],
                )

    return run


def _coordinate(path, branch: int):
    return F.pmod(F.xxhash64(path, F.lit(branch)), F.lit(COORDINATES)).cast("int") + 1


def _children(rows: DataFrame, branches: int) -> DataFrame:
    """Each row once per selected coordinate, in the node of its token there."""
    made = [
        F.struct(F.xxhash64("path", _coordinate(F.col("path"), b), F.element_at("sig", _coordinate(F.col("path"), b))).alias("path"))
        for b in range(branches)
    ]
    return rows.select("rep", "n", "sig", F.inline(F.array(*made)))


def _nodes(classes: DataFrame, percent: int) -> DataFrame:
    """(``path``, ``rep``) of every node with two to ``NODE_DOCS`` classes."""
    roots = classes.select("rep", "n", "sig", F.explode(F.sequence(F.lit(1), F.lit(TREES))).alias("tree"))
    level = _children(roots.select("rep", "n", "sig", F.xxhash64(F.lit("tree"), "tree").alias("path")), 1)
    small, depth = None, 1
    while True:
        sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w")).filter("m > 1")
        is_small = (F.col("m") <= NODE_DOCS) & (F.col("w") <= NODE_SHINGLES)
        placed = cut_lineage(level.select("path", "rep").join(sizes.select("path", is_small.alias("small"), "m", "w"), "path"), "nodes")
        done = placed.filter("small").select("path", "rep")
        small = done if small is None else small.unionByName(done)
        large = placed.filter("NOT small")
        if large.isEmpty():
            return small
        if depth == MAX_DEPTH:
            return small.unionByName(_blocks(large))
        level = _children(large.select("path", "rep").join(classes.select("rep", "n", "sig"), "rep"), BRANCHES)
        depth += 1


def _blocks(large: DataFrame) -> DataFrame:
    """Every pair of blocks of a node that no longer shrinks, as a node of its own.

    Blocks hold half a node, so two of them fit a task; every pair of documents
    meets in at least one node, and the blocks of one node are hashed apart.
    """
    count = F.ceil(F.greatest(F.col("m") / (NODE_DOCS / 4), F.col("w") / (NODE_SHINGLES / 4))).cast("int")
    rows = large.withColumn("k", count).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    rows = rows.select("path", "rep", "own", other.alias("other"))
    return rows.select(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("path"), "rep")


def _clusters(nodes: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(``unit``, ``rep``): parts of nodes in which signatures suggest links.

    Trees mostly meet the same groups again, so equal node contents are one unit.
    """
    contents = nodes.groupBy("path").agg(F.array_sort(F.collect_set("rep")).alias("reps"))
    units = contents.groupBy(F.xxhash64("reps").alias("unit"), F.size("reps").alias("m")).agg(F.first("reps").alias("reps"))
    rows = units.filter("m > 1").select("unit", F.explode("reps").alias("rep")).join(classes.select("rep", "n", "sig"), "rep")
    level = percent / 100
    least = int(np.floor(COORDINATES * level - SLACK * np.sqrt(COORDINATES * level * (1 - level))))
    placed = rows.repartition("unit").sortWithinPartitions("unit")
    found = placed.mapInArrow(_suggested(max(1, least), percent), "unit long, rep long")
    again = found.groupBy("unit").agg(F.array_sort(F.collect_list("rep")).alias("reps"))
    again = again.groupBy(F.xxhash64("reps").alias("unit")).agg(F.first("reps").alias("reps"))
    return again.select("unit", F.explode("reps").alias("rep"))


def _suggested(least: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "unit"):
            reps = group.column("rep").to_numpy()
            n = group.column("n").to_numpy()
            sig = group.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
            cluster = np.full(len(reps), -1)
            open_rows = np.arange(len(reps))
            label = 0
            while len(open_rows):
                queue, open_rows = [open_rows[0]], open_rows[1:]
                cluster[queue[0]] = label
                while queue and len(open_rows):
                    i = queue.pop()
                    close = (sig[open_rows] == sig[i]).sum(axis=1) >= least
                    close &= 100 * np.minimum(n[open_rows], n[i]) >= percent * np.maximum(n[open_rows], n[i])
                    near = open_rows[close]
                    cluster[near] = label
                    queue.extend(near.tolist())
                    open_rows = open_rows[~close]
                label += 1
            sizes = np.bincount(cluster, minlength=label)
            keep = sizes[cluster] > 1
            if keep.any():
                unit = mix(np.uint64(group.column("unit")[0].as_py() & (2**64 - 1)) + cluster[keep].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([signed(unit), pa.array(reps[keep])], ["unit", "rep"])

    return run


def _verified(docs: DataFrame, clusters: DataFrame, words: int, percent: int) -> DataFrame:
    """Links confirmed on full sets: for each unit, edges that span its components."""
    texts = clusters.join(docs.filter("text IS NOT NULL"), F.col("rep") == F.col("doc_id")).select("unit", "rep", "text")
    placed = texts.repartition("unit").sortWithinPartitions("unit")
    return placed.mapInArrow(_spanning(words, percent), "a long, b long")


def _spanning(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "unit"):
            reps, sets = [], []
            for batch in group.combine_chunks().to_batches():
                for part, data, at in chunks(batch, "text"):
                    found = Words(lower_ascii(data), at)
                    sets += shingle_sets(found.hashes(), found.rows, words)
                    reps += part.column("rep").to_pylist()
            pairs = spanning_links(sets, percent)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([reps[i] for i, _ in pairs], pa.int64()), pa.array([reps[j] for _, j in pairs], pa.int64())], ["a", "b"])

    return run


def spanning_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Index pairs of linked sets that join all that is linked, directly or in steps.

    Each set is compared with every later one that is not yet in its component.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(len(values), bool)
    component = np.arange(len(sets))
    pairs = []
    for i in range(len(sets)):
        later = np.arange(i + 1, len(sets))
        later = later[(component[later] != component[i]) & (sizes[later] > 0)]
        later = later[100 * np.minimum(sizes[later], sizes[i]) >= percent * np.maximum(sizes[later], sizes[i])]
        if not sizes[i] or not len(later):
            continue
        own = codes[starts[i] : starts[i + 1]]
        marked[own] = True
        which = np.concatenate([codes[starts[j] : starts[j + 1]] for j in later])
        edges = np.concatenate([[0], np.cumsum(sizes[later])[:-1]])
        common = np.add.reduceat(marked[which].astype(np.int64), edges)
        marked[own] = False
        union = sizes[later] + sizes[i] - common
        for j in later[100 * common >= percent * union].tolist():
            if component[j] != component[i]:
                component[component == component[j]] = component[i]
                pairs.append((i, j))
    return pairs
