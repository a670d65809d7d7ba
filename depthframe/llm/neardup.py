"""Similarity join of texts on word shingles: MinHash, Bayesian pruning, exact proof.

Texts become sets of hashes of WORDS words in a row. Texts with equal sets are one node of a
graph, so copies are counted and never compared. Bands of MinHash values give each node
keys; two texts of similarity 0.8 share none of the keys with a probability under 1e-6.

Only nodes that share a key are compared, MinHash value by MinHash value. The posterior of the
similarity, from an even prior, after m of n values agreed, gives the probability that it
reaches the threshold; a pair is dropped when that falls below TOLERANCE. That is done twice.
First over sketches (a byte of each value), key by key; keys with the same members are one,
and pairs that are connected already need no comparison. What stays connects nodes to groups.
Then within a group, over whole values, for all pairs that share a key; the pairs that are
left are verified on the whole sets. Large keys and large groups are dealt into blocks of
nodes, and each pair of blocks is a task of its own: no task holds more than two blocks, and
no pair leaves its task, only counts of links and one edge for each node.

Defined results: words are runs of letters and digits in lower case; a text of fewer than
WORDS words has one shingle, all its words; null texts and texts without words are copies of
each other. Repeated rows are copies. Rows without an id take part like others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_batches, pieces
from .graph import components

WORDS, THRESHOLD = 5, 0.8
#: Bands of ROWS values each: a pair of similarity 0.8 misses all with probability (1 - 0.8 ** 5) ** 36 = 6e-7.
ROWS, BANDS = 5, 36
TOLERANCE = 1e-7
#: Values compared in a step, nodes in a block of a group, and in a block of a key.
STEP, BLOCK, SKETCHES = 20, 256, 4096
#: A node with more rows than this, and than this share of all rows, is joined on its own; there are fewer than 1 / share of them.
HOT_ROWS, HOT_SHARE = 10_000, 0.001
_WORD = re.compile(r"\w+")
_N = ROWS * BANDS

_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 1 << 32, _N, np.uint32)
_MUL = _RNG.integers(0, 1 << 32, _N, np.uint32) | np.uint32(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _ODD
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


class Words:
    """64-bit hashes of words, remembered."""

    MOST = 1 << 19

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def hashes(self, text: str | None) -> np.ndarray:
        found = _WORD.findall(text.lower()) if text else []
        if len(self.known) > self.MOST:
            self.known.clear()
        known = self.known
        missing = set(found).difference(known)
        if missing:
            import xxhash

            for w in missing:
                known[w] = xxhash.xxh3_64_intdigest(w.encode())
        return np.fromiter((known[w] for w in found), np.uint64, len(found))


def shingles(word_hashes: np.ndarray) -> np.ndarray:
    """The set of a text's shingles: sorted distinct 64-bit hashes."""
    n = len(word_hashes)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(WORDS, n)
    h = np.full(n - width + 1, np.uint64(width))
    for i in range(width):
        h = _mix(h ^ word_hashes[i : n - width + 1 + i])
    return np.unique(h)


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (a row of _N for each set that is not empty; others are all ones)."""
    out = np.full((len(sets), _N), np.uint32(0xFFFFFFFF))
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        part, size = [], 0
        while at < len(full) and (not part or size + len(sets[full[at]]) <= 1 << 15):
            part.append(full[at])
            size += len(sets[full[at]])
            at += 1
        data = np.concatenate([sets[i] for i in part])
        low = (data ^ (data >> np.uint64(32))).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in part])[:-1]])
        got = np.empty((_N, len(part)), np.uint32)
        for k in range(_N):
            got[k] = np.minimum.reduceat((low ^ _XOR[k]) * _MUL[k], starts)
        out[part] = got.T
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(values), BANDS))
    for r in range(ROWS):
        h = _mix(h ^ (values[:, r::ROWS].astype(np.uint64) + np.uint64(r << 32)))
    return h


def set_key(s: np.ndarray) -> int:
    """A node's name: a hash of the whole set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def least_agreeing(step: int = STEP, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """By values compared: the fewest that have to agree for a pair to stay.

    With an even prior the posterior is Beta(m + 1, n - m + 1), and its mass above t is the
    probability that a binomial of n + 1 trials at t is at most m.
    """
    found = {}
    for n in range(step, _N + 1, step):
        mass, m = 0.0, 0
        while m <= n:
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= tolerance:
                break
            m += 1
        found[n] = m
    return found


_LEAST = least_agreeing()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard index of two sets reaches the threshold."""
    if len(a) == 0 or len(b) == 0:
        return len(a) == len(b)
    if min(len(a), len(b)) < THRESHOLD * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= THRESHOLD * (len(a) + len(b) - both) - 1e-9


def unpruned(values: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Those of the others that may reach the threshold with i, given all their values."""
    agree = np.zeros(len(others), np.int64)
    for n in range(STEP, _N + 1, STEP):
        if not len(others):
            break
        agree += (values[others, n - STEP : n] == values[i, n - STEP : n]).sum(1)
        stay = agree >= _LEAST[n]
        others, agree = others[stay], agree[stay]
    return others


def link(sets: list[np.ndarray], values: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each i of left, the members of right (greater than i where both are the same block) that it is linked with."""
    same = left is right
    sizes, keys = np.array([len(s) for s in sets]), band_keys(values)
    for k, i in enumerate(left):
        others = right[k + 1 :] if same else right
        others = others[np.minimum(sizes[others], sizes[i]) >= THRESHOLD * np.maximum(sizes[others], sizes[i])]
        others = unpruned(values, i, others[(keys[others] == keys[i]).any(1)])
        if len(others):
            yield int(i), verified(sets, int(i), others)


def connect(sketches: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what pairs of left and right connect which pruning leaves: fewer than there are members."""
    same, edges = left is right, []
    label = np.arange(len(sketches))
    for k, i in enumerate(left):
        others = right[k + 1 :] if same else right
        for j in unpruned(sketches, i, others[label[others] != label[i]]).tolist():
            if label[j] != label[i]:
                edges.append((int(i), j))
                label[label == label[j]] = label[i]
    return edges


def verified(sets: list[np.ndarray], i: int, others: np.ndarray) -> np.ndarray:
    """Those of the others whose Jaccard index with i reaches the threshold, on whole sets."""
    sizes = np.array([len(sets[j]) for j in others])
    data = np.concatenate([sets[j] for j in others])
    at = np.searchsorted(sets[i], data)
    at[at == len(sets[i])] = 0
    hit = sets[i][at] == data if len(sets[i]) else np.zeros(len(data), bool)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    both = np.add.reduceat(hit, starts, dtype=np.int64)
    return others[both >= THRESHOLD * (sizes + len(sets[i]) - both) - 1e-9]


def _nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, version, node, keys and sketch for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Words()
        for batch in pieces(batches, "text"):
            sets = [shingles(vocabulary.hashes(t)) for t in batch.column("text").to_pylist()]
            values = signature(sets)
            keys = band_keys(values).view(np.int64)
            sketches = [x.tobytes() for x in (values & np.uint32(0xFF)).astype(np.uint8)]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("version"), pa.array([set_key(s) for s in sets], pa.int64()), flat, pa.array(sketches, pa.binary())], ["id", "version", "node", "keys", "sketch"])

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("version"), F.col(f"`{text_col}`").alias("text"))
    return map_batches(src, run, "id long, version long, node long, keys array<long>, sketch binary")


def _grouped(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], columns: tuple[str, ...], solve) -> Iterator[pa.RecordBatch]:
    """solve(key, rows) for each run of equal keys with more than one row; of rows with equal first columns (block, node) one stays."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (*key, *columns)), strict=True):
            if row[: len(key)] != at:
                if len(rows) > 1 and (out := solve(at, rows)):
                    yield out
                at, rows = row[: len(key)], []
            row = row[len(key) :]
            if not rows or rows[-1][:2] != row[:2]:
                rows.append(row)
    if len(rows) > 1 and (out := solve(at, rows)):
        yield out


def _in_blocks(rows: DataFrame, key: str, size: str, block: int, n: int) -> DataFrame:
    """Rows (key, node, size, ...) dealt so that each block of a key's nodes meets itself and every other block once: x, y, block."""
    dealt = rows.withColumn("blocks", F.ceil(F.col(size) / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("other", "blocks", size)
    return dealt.repartition(n, key, "x", "y").sortWithinPartitions(key, "x", "y", "block", "node")


def _sides(key: tuple, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of both blocks; the same array if it is one block."""
    blocks = np.array([r[0] for r in rows])
    left = np.flatnonzero(blocks == key[1])
    return left, left if key[1] == key[2] else np.flatnonzero(blocks == key[2])


def _candidates(nodes: DataFrame) -> DataFrame:
    """a and b: edges that connect the nodes which share a key and which pruning on sketches leaves."""
    n = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = nodes.select("node", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2")).where("size > 1")
    # Near copies share many keys: of keys with the same members one is enough.
    shared = shared.groupBy("size", "h1", "h2").agg(F.min("key").alias("key")).select("key", "size")
    rows = keys.join(shared, "key").join(nodes.select("node", "sketch"), "node")

    def solve(key: tuple, rows: list[tuple]) -> pa.RecordBatch | None:
        edges = connect(np.stack([np.frombuffer(r[2], np.uint8) for r in rows]), *_sides(key, rows))
        names = [r[1] for r in rows]
        return pa.RecordBatch.from_arrays([pa.array([names[e[k]] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"]) if edges else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _grouped(batches, ("key", "x", "y"), ("block", "node", "sketch"), solve)

    return map_batches(_in_blocks(rows, "key", "size", SKETCHES, n), run, "a long, b long")


def _of_rows(docs: DataFrame, id_col: str, text_col: str, members: DataFrame) -> DataFrame:
    """members (id, version and others) with the text of the row of that id and version: no text that is there often meets in one place."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.xxhash64(F.col(f"`{text_col}`")).alias("__version"), F.col(f"`{text_col}`").alias("text"))
    return src.join(members, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__version") == F.col("version"))).drop("__id", "__version", "id", "version")


def _links(docs: DataFrame, id_col: str, text_col: str, members: DataFrame) -> DataFrame:
    """node, links (verified links to other nodes) and root (a node linked with it, itself through others) by task.

    members: id and version of a row that has the node's text, node, label (its group) and size (of the group).
    """

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Words()
        for batch in pieces(batches, "text"):
            sets = [shingles(vocabulary.hashes(t)) for t in batch.column("text").to_pylist()]
            values = signature(sets)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "label", "size")), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([v.tobytes() for v in values], pa.binary())], ["node", "label", "size", "shingles", "minhash"])

    texts = _of_rows(docs, id_col, text_col, members).select("node", "label", "size", "text")
    ready = map_batches(texts, prepare, "node long, label long, size long, shingles binary, minhash binary")
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _grouped(batches, ("label", "x", "y"), ("block", "node", "shingles", "minhash"), _solve)

    return map_batches(_in_blocks(ready, "label", "size", BLOCK, n), run, "node long, links long, root long")


def _solve(key: tuple[int, int, int], rows: list[tuple]) -> pa.RecordBatch | None:
    sets = [np.frombuffer(r[2], np.uint64) for r in rows]
    values = np.stack([np.frombuffer(r[3], np.uint32) for r in rows])
    count = np.zeros(len(rows), np.int64)
    parent = list(range(len(rows)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, others in link(sets, values, *_sides(key, rows)):
        count[i] += len(others)
        count[others] += 1
        for j in others.tolist():
            a, b = top(i), top(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    hit = np.flatnonzero(count).tolist()
    if not hit:
        return None
    nodes = [r[1] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in hit], pa.int64()), pa.array(count[hit]), pa.array([nodes[top(i)] for i in hit], pa.int64())], ["node", "links", "root"])


def _back_to_rows(rows: DataFrame, named: DataFrame) -> DataFrame:
    """rows (with node) and what named says of the node. Nodes that very many rows have, a bounded number, are broadcast."""
    most = max(HOT_ROWS, int(HOT_SHARE * rows.count()))
    hot = [r["node"] for r in named.where(F.col("n_copies") >= most).select("node").collect()]
    if not hot:
        return rows.join(named, "node")
    is_hot = F.col("node").isin(hot)
    return rows.where(~is_hot).join(named.where(~is_hot), "node").unionByName(rows.where(is_hot).join(F.broadcast(named.where(is_hot)), "node"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of docs: id, version (a hash of its text), node, label (of its class), class_id, n_copies and n_links.

    A class holds the texts that links connect; class_id is the lowest id in it. n_copies
    counts the other rows with equal shingles, n_links the different sets of shingles with
    which the row's own has a similarity of at least THRESHOLD.
    """
    rows = checkpointed(_nodes(docs, id_col, text_col))
    nodes = checkpointed(rows.groupBy("node").agg(F.count("*").alias("copies"), F.min(F.struct("id", "version", "keys", "sketch")).alias("first")).select("node", "copies", "first.*"))
    groups = components(_candidates(nodes))
    sizes = groups.groupBy("label").agg(F.count("*").alias("size"))
    members = groups.join(sizes, "label").join(nodes.select("node", "id", "version"), "node").select("id", "version", "node", "label", "size")
    found = checkpointed(_links(docs, id_col, text_col, members))
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.select("node", "copies", "id").join(links, "node", "left").join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = named.groupBy("label").agg(F.min("id").alias("class_id"))
    named = named.join(lowest, "label").select("node", "label", "class_id", (F.col("copies") - 1).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return _back_to_rows(rows.select("id", "version", "node"), checkpointed(named))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, one row of each class: that of the lowest id (null ids count as lowest), then of the lowest text hash."""
    joined = join(docs, id_col, text_col)
    keep = joined.groupBy("label").agg(F.min(F.struct("id", "version")).alias("first"), F.count("*").alias("n")).select(F.col("first.id").alias("__id"), F.col("first.version").alias("__version"))
    version = F.xxhash64(F.col(f"`{text_col}`"))
    kept = docs.withColumn("__v", version).join(keep, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id")) & (F.col("__v") == F.col("__version")))
    # Rows that are there more than once: the smallest of their other columns stays.
    others = [F.col(f"`{c}`") for c in docs.columns]
    twice = kept.groupBy("__id", "__version").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if twice:
        kept = kept.groupBy("__id", "__version").agg(F.min(F.struct(*others)).alias("row")).select("row.*")
    return kept.select(*others)
