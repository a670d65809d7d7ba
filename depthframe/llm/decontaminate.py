"""Benchmark passages in training texts, found through spaced seeds.

A mask names places among a few neighbouring words. The words at these places make a seed;
the words between them do not matter, so a passage with replaced words still shares seeds
with its original. The seeds of the benchmark and of every position of every text are
joined. Around each hit, text and item are laid side by side and the longest stretch is
found in which at least IDENTITY of the words agree; it counts if MATCHES words agree, or all
words of a shorter item. The masks leave no stretch out that this rule accepts.

A sieve of the benchmark's seeds (a Bloom filter of bounded size) goes to the executors and
keeps those of nearly all texts out of the join; what it lets through by chance finds no
partner. The join is an ordinary one, so a seed that very many texts or items have is split
like any hot key, and each candidate is checked in a row of its own: its item and the
window of the text beside it. Texts that are there more than once are checked once.

Words are runs of letters and digits in lower case. Defined results: null and empty texts and
items match nothing; items with equal texts all match; repeated rows each get their own
result. Words are compared by 64-bit hashes, texts by 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, forget, map_batches, pieces
from .neardup import _WORD, Words

#: Fixed masks: 1 is a place that has to agree. Together they hit every stretch of 10 to 27 words in which at least 10
#: words and 70 % agree, wherever the others are; longer stretches have a part of 14 to 27 words of which that holds.
MASKS = ("11111", "110111", "111101", "1101011", "1100000111", "11000101001", "11010010001")
SPAN = max(map(len, MASKS))
#: Words that have to agree, and their least share in the stretch.
MATCHES, IDENTITY = 10, 0.7
#: Bits of the sieve for a seed and at most (as a power of two: 64 MB), and bits that a seed sets.
SIEVE_BITS, MOST_BITS, PROBES = 32, 29, 8


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def places_of(short: list[int]) -> list[tuple[int, ...]]:
    """The places of each mask, then those of items shorter than a mask, which are sought as they are."""
    return [tuple(i for i, c in enumerate(m) if c == "1") for m in MASKS] + [tuple(range(n)) for n in short]


def seeds(arrays: list[np.ndarray], places: list[tuple[int, ...]], passes: Callable[[np.ndarray], np.ndarray] = lambda h: np.arange(len(h))) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each mask its number and, of its positions in the arrays of word hashes whose seeds pass: array, first word and seed."""
    sizes = np.array([len(x) for x in arrays], np.int64)
    if not sizes.sum():
        return
    data, ends = np.concatenate(arrays), np.cumsum(sizes)
    for k, where in enumerate(places):
        n = len(data) - where[-1]
        if n <= 0:
            continue
        h = np.full(n, np.uint64(k + 1))
        with np.errstate(over="ignore"):
            for p in where:
                h ^= data[p : p + n]
                h *= np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        # Of the few that pass, those that reach into the next array go.
        at = passes(h)
        of = np.searchsorted(ends, at, "right")
        inside = at + where[-1] < ends[of]
        at, of = at[inside], of[inside]
        yield k, of, at - (ends - sizes)[of], h[at]


class Sieve:
    """A Bloom filter over seeds: 64-bit words of bits."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @staticmethod
    def probe(found: np.ndarray, k: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (found + np.uint64(k) * ((found >> np.uint64(32)) | np.uint64(1))) & np.uint64(size - 1)

    def passes(self, found: np.ndarray) -> np.ndarray:
        """The places of the seeds that may be in the filter; few are asked more than twice."""
        at, size = np.arange(len(found)), 64 * len(self.bits)
        for k in range(PROBES):
            p = self.probe(found[at], k, size)
            at = at[(self.bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
        return at


def stretch(window: np.ndarray, item: np.ndarray) -> tuple[int, int, int] | None:
    """The longest stretch of two arrays of equal length in which at least IDENTITY agrees: first place, places, agreeing ones.

    Agreeing words gain 1 - IDENTITY and others cost IDENTITY; a stretch that does not lose
    is found from the falling minima of the running total and the ends behind them.
    """
    same = window == item
    total = [0.0, *np.cumsum(np.where(same, 1 - IDENTITY, -IDENTITY)).tolist()]
    minima = [0]
    for i, v in enumerate(total):
        if v < total[minima[-1]]:
            minima.append(i)
    first = end = 0
    for j in range(len(total) - 1, -1, -1):
        while minima and total[j] >= total[minima[-1]] - 1e-9:
            i = minima.pop()
            if j - i > end - first:
                first, end = i, j
    places = np.flatnonzero(same[first:end]) + first
    return (int(places[0]), int(places[-1] - places[0] + 1), len(places)) if len(places) else None


def _name(text_col: str) -> tuple[Column, Column]:
    text = F.col(f"`{text_col}`")
    return F.xxhash64(text), F.xxhash64(F.lit("text"), text)


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, item, n and words (64-bit hashes) of every different item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Words()
        for batch in pieces(batches, "text"):
            found = [vocabulary.hashes(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("item"), pa.array([len(x) for x in found], pa.int32()), pa.array([x.tobytes() for x in found], pa.binary())], ["key", "item", "n", "words"])

    rows = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item"), F.col(f"`{text_col}`").alias("text")).where("text is not null and item is not null").distinct()
    return map_batches(rows.select(F.xxhash64("item", "text").alias("key"), "item", "text"), run, "key long, item long, n int, words binary").where("n > 0")


def _item_seeds(items: DataFrame, places: list[tuple[int, ...]]) -> DataFrame:
    """seed, key and at (a place of the item). Masks of short items are for items of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array(batch.column("key").to_pylist(), np.int64)
            arrays = [np.frombuffer(x, np.uint64) for x in batch.column("words").to_pylist()]
            sizes = np.array([len(x) for x in arrays])
            for k, of, at, h in seeds(arrays, places):
                if k >= len(MASKS):
                    fits = sizes[of] == len(places[k])
                    of, at, h = of[fits], at[fits], h[fits]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[of]), pa.array(at.astype(np.int32))], ["seed", "key", "at"])

    return map_batches(items.select("key", "words"), run, "seed long, key long, at int")


def _sieve(found: DataFrame, n: int) -> Sieve:
    """The filter over all seeds: put together by aggregation, at most MOST_BITS come to the driver."""
    size = 1 << min(MOST_BITS, max(6, (SIEVE_BITS * n - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.unique(batch.column("seed").to_numpy().view(np.uint64))
            p = np.unique(np.concatenate([Sieve.probe(h, k, size) for k in range(PROBES)]))
            where, starts = np.unique(p >> np.uint64(6), return_index=True)
            if len(where):
                bits = np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), starts)
                yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int64)), pa.array(bits.view(np.int64))], ["place", "bits"])

    rows = map_batches(found.select("seed"), run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[rows.column("place").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Sieve(bits)


def _hits(docs: DataFrame, text_col: str, sieve: Sieve, places: list[tuple[int, ...]]) -> DataFrame:
    """t1, t2, words (64-bit hashes) and hits (seed, at) of the different texts with seeds that pass the sieve."""
    sent = docs.sparkSession.sparkContext.broadcast(sieve)
    kind = pa.struct([("seed", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Words()
        for batch in pieces(batches, "text"):
            arrays = [vocabulary.hashes(t) for t in batch.column("text").to_pylist()]
            found = [f for _, *f in seeds(arrays, places, sent.value.passes) if len(f[0])]
            if not found:
                continue
            of, at, h = map(np.concatenate, zip(*found, strict=True))
            order = np.argsort(of, kind="stable")
            of, at, h = of[order], at[order], h[order]
            rows, starts = np.unique(of, return_index=True)
            flat = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(at.astype(np.int32))], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array([*starts.tolist(), len(of)], pa.int32()), flat)
            names = [batch.column(c).take(pa.array(rows)) for c in ("t1", "t2")]
            yield pa.RecordBatch.from_arrays([*names, pa.array([arrays[i].tobytes() for i in rows], pa.binary()), lists], ["t1", "t2", "words", "hits"])

    t1, t2 = _name(text_col)
    src = docs.select(t1.alias("t1"), t2.alias("t2"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    return map_batches(src, run, "t1 long, t2 long, words binary, hits array<struct<seed:long,at:int>>").dropDuplicates(["t1", "t2"])


def _verified(rows: DataFrame) -> DataFrame:
    """t1, t2, item, first, words and agree of the candidates (t1, t2, item, n, item_words, begin, window) that hold."""
    columns = ("t1", "t2", "item", "first", "words", "agree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t1, t2, item, n, mine, begin, window in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "item", "n", "item_words", "begin", "window")), strict=True):
                w = np.frombuffer(window, np.uint64)
                skip = max(0, -begin)
                x = np.frombuffer(mine, np.uint64)[skip : skip + len(w)]
                got = stretch(w[: len(x)], x)
                if got and got[2] >= min(MATCHES, n):
                    out.append((t1, t2, item, begin + skip + got[0], got[1], got[2]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], list(columns))

    return map_batches(rows, run, ", ".join(f"{c} long" for c in columns))


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """t1, t2 (the name of a text), item, first, words and agree: the best stretch of each item in each different text."""
    items = checkpointed(_items(benchmark, item_col, item_text_col))
    short = sorted(r["n"] for r in items.where(F.col("n") < SPAN).select("n").distinct().collect())
    places = places_of(short)
    found = checkpointed(_item_seeds(items, places))
    texts = checkpointed(_hits(docs, text_col, _sieve(found, found.count()), places))
    hits = texts.select("t1", "t2", F.explode("hits").alias("h")).select("t1", "t2", F.col("h.seed").alias("seed"), F.col("h.at").alias("here"))
    rows = hits.join(found, "seed").select("t1", "t2", "key", (F.col("here") - F.col("at")).alias("begin")).distinct()
    rows = rows.join(items.select("key", "item", "n", F.col("words").alias("item_words")), "key").join(texts.select("t1", "t2", "words"), ["t1", "t2"])
    # The words of the text beside the item: eight bytes each.
    first, end = F.greatest(F.lit(0), F.col("begin")), F.col("begin") + F.col("n")
    rows = rows.select("t1", "t2", "item", "n", "item_words", "begin", F.substring("words", 8 * first + 1, 8 * (end - first)).alias("window"))
    best = checkpointed(_verified(rows).groupBy("t1", "t2", "item").agg(F.max(F.struct("agree", (-F.col("first")).alias("at"), "words")).alias("b")))
    forget(items, found, texts)
    return best.select("t1", "t2", "item", (-F.col("b.at")).alias("first"), F.col("b.words").alias("words"), F.col("b.agree").alias("agree"))


_HIT = "array<struct<item:bigint,first:bigint,words:bigint,agree:bigint>>"


def _named(docs: DataFrame, text_col: str) -> DataFrame:
    t1, t2 = _name(text_col)
    return docs.withColumn("__t1", t1).withColumn("__t2", t2)


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", hits_col: str = "hits") -> DataFrame:
    """All columns of docs and hits_col (one of that name is replaced): for each benchmark item found, its stretch of words and how many agree."""
    found = matches(docs, benchmark, text_col, item_col, item_text_col).groupBy(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"))
    found = checkpointed(found.agg(F.sort_array(F.collect_list(F.struct("item", "first", "words", "agree"))).alias("__found")))
    columns = [F.col(f"`{c}`") for c in docs.columns if c != hits_col]
    rows = _named(docs, text_col).join(found, ["__t1", "__t2"], "left")
    return rows.select(*columns, F.coalesce("__found", F.array().cast(_HIT)).alias(hits_col))


def without(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs in whose text no benchmark item is found."""
    found = matches(docs, benchmark, text_col, item_col, item_text_col).select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2")).distinct()
    return _named(docs, text_col).join(checkpointed(found), ["__t1", "__t2"], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
