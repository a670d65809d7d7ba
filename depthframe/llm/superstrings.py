"""Removal of long byte strings that occur more than once, by suffix arrays over shards.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in the
same text or another. Sharding keeps that exact, in two steps of anchoring.

1. In the middle of every window the run of GRAM bytes with the smallest hash (the first of
   equal ones) is its anchor, so equal windows have equal anchors, and ``margin`` bytes on
   either side of an anchor, its core, lie in every window that it anchors. Neighbouring
   windows of one anchor make a piece. Pieces whose core is there once go no further; pieces
   that are there twice, by hash, consist of repeated windows only.
2. Different pieces of one core are cut by the distance of window and anchor into parts of
   at most STRIDE windows. All windows of a part share all but STRIDE - 1 bytes, so equal
   windows are in parts with equal shared bytes. Only what lies before and after these bytes
   is still open: it goes, with a symbol for the shared bytes, into a shard. The shard's
   suffix array, by induced sorting, and permuted common prefixes show which windows repeat.

The parts of a core with more than MOST_PIECES different pieces are cut once more, into FINE
windows each, so that its groups of equal shared bytes get smaller and go to more shards.
Where even such a group has more than MOST_PIECES rows, its windows are hashed (128 bits)
and counted by aggregation, which any skew can pass through.

``summary`` works at two lengths. Every text is searched for strings of REPEAT bytes that
are there again, about fifty words. A string of LENGTH bytes that repeats lies within what
these cover, so only such stretches are searched again for the longer ones, which go.

Texts are UTF-8 bytes. A document is named by a 64-bit hash of its id and text; cores and
pieces are compared by 64-bit hashes each. Defined results: a null text counts as empty; texts
shorter than LENGTH keep all bytes; repeated rows count as different texts and lose all that
repeats. What is kept may end inside a character, so it is binary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, forget, map_batches, pieces
from .suffixes import repeated_windows

#: Bytes of a string that goes if it repeats, of one that is only reported, and of an anchor.
LENGTH, REPEAT, GRAM = 400, 256, 16
#: Windows in a part, and in a part of a hot core.
STRIDE, FINE = 64, 8
#: Different pieces of a core that meet in a shard, and symbols that are sorted at a time.
MOST_PIECES, SHARD = 20_000, 1 << 20
#: Symbols for bytes, for the shared bytes of a part, and how many bytes number these in a shard.
SYMBOLS, DIGITS = 257, 3
#: Bytes of a text that are scanned at a time.
SCAN = 1 << 20
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_HIGH = np.uint64(0xFFFFFFFF00000000)


@dataclass(frozen=True)
class Frame:
    """Windows of a length: the bytes around an anchor that all its windows have, and where in a window it can start."""

    length: int

    @property
    def margin(self) -> int:
        return self.length * 9 // 50

    @property
    def places(self) -> int:
        return self.length - 2 * self.margin - GRAM + 1

    @property
    def shared(self) -> int:
        """Bytes that all windows of a part have."""
        return self.length - STRIDE + 1


def _least_place(key: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours: within blocks from both sides."""
    n = len(key)
    m = -(-n // width) * width
    block = np.full(m, np.uint64(0xFFFFFFFFFFFFFFFF))
    block[:n] = key
    block = block.reshape(-1, width)
    ahead = np.minimum.accumulate(block, 1).reshape(-1)
    back = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, frame: Frame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window start of each piece, over texts laid end to end."""
    n = len(data)
    if n < frame.length:
        return (np.zeros(0, np.int64),) * 3
    buf = data.tobytes()
    words = np.ndarray((n - 7,), "<u8", buf, 0, (1,))
    with np.errstate(over="ignore"):
        h = (words[: n - 15] * _C1) ^ (words[8:] * _C2)
        h ^= h >> np.uint64(31)
        h *= _C1
    # Equal hashes: the first place, so what is chosen depends on the window's bytes alone.
    key = (h & _HIGH) | np.arange(len(h), dtype=np.uint64)
    anchor = (_least_place(key[frame.margin:], frame.places) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    anchor = anchor[: n - frame.length + 1]
    p = np.arange(len(anchor))
    inside = np.zeros(n + 1, np.int64)
    for s, e in zip(starts, ends, strict=True):
        if e - s >= frame.length:
            inside[s] += 1
            inside[e - frame.length + 1] -= 1
    good = np.cumsum(inside)[: len(anchor)] > 0
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (good[1:] != good[:-1])
    new[starts[starts < len(anchor)]] = True
    first = p[new]
    last = np.append(first[1:], len(anchor)) - 1
    ok = good[first]
    return anchor[first[ok]], first[ok], last[ok]


def _signed(h: int) -> int:
    return h - (1 << 63)


_SCANNED = "key long, core long, piece long, place long, whole array<long>"


def _pack(lo: int, hi: int, anchor: int, many: bool) -> int:
    """A piece's first and last window, its anchor and whether the text has it more than once, in one number."""
    return lo << 20 | (hi - lo) << 11 | (anchor - lo) << 1 | many


def _unpack(place: int) -> tuple[int, int, int]:
    lo = place >> 20
    return lo, lo + (place >> 11 & 0x1FF), lo + (place >> 1 & 0x3FF)


def _scan(docs: DataFrame, frame: Frame) -> DataFrame:
    """The pieces of every text: key, core, piece, place.

    A piece that one text has several times is there once, marked, and a row without core has
    what all these cover: starts and ends in turn.
    """

    length, margin = frame.length, frame.margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SCAN):
            keys = batch.column("key").to_pylist()
            out: list[list] = [[] for _ in range(5)]
            # Of texts that several parts have, all pieces are seen together.
            own: dict[int, dict[tuple[int, int], list[int]]] = {}
            part: list[tuple[int, int, bytes]] = []
            size = 0

            def flush(part=part, own=own) -> None:
                sizes = np.array([len(x) for _, _, x in part], np.int64)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                buf = b"".join([x for _, _, x in part])
                at, lo, hi = anchors(np.frombuffer(buf, np.uint8), ends, starts, frame)
                who = np.searchsorted(ends, lo, "right")
                view = memoryview(buf)
                digest = xxhash.xxh3_64_intdigest
                for w, a, b, c in zip(who.tolist(), lo.tolist(), hi.tolist(), at.tolist(), strict=True):
                    i, base, _ = part[w]
                    shift = base - int(starts[w])
                    name = (_signed(digest(view[c - margin : c + GRAM + margin])), _signed(digest(view[a : b + length], c - a)))
                    own.setdefault(i, {}).setdefault(name, []).append(_pack(a + shift, b + shift, c + shift, False))
                part.clear()

            for i, text in enumerate(batch.column("text").to_pylist()):
                raw = text or b""
                # Parts of a long text overlap, so that each window is in one of them.
                for base in range(0, len(raw) - length + 1, SCAN):
                    x = raw[base : base + SCAN + length - 1]
                    part.append((i, base, x))
                    size += len(x)
                    if size >= SCAN:
                        flush()
                        size = 0
            if part:
                flush()
            for i, found in own.items():
                spans = []
                for (core, piece), places in found.items():
                    many = len(places) > 1
                    for column, x in zip(out, (keys[i], core, piece, places[0] | many, None), strict=True):
                        column.append(x)
                    if many:
                        spans += [(lo, hi + length) for lo, hi, _ in map(_unpack, places)]
                if spans:
                    for column, x in zip(out, (keys[i], None, None, None, [x for s in _merged(spans) for x in s]), strict=True):
                        column.append(x)
            if out[0]:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["key", "core", "piece", "place", "whole"])

    return map_batches(docs.select("key", "text"), run, _SCANNED)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, end exclusive."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_PART = "shared long, key long, first int, once boolean, hot boolean, before binary, after binary"


def _extract(marked: DataFrame, frame: Frame) -> DataFrame:
    """The parts of the pieces that stand for their kind: a hash of the shared bytes, and what lies around them."""
    length, shared = frame.length, frame.shared
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows: list[tuple] = []
            for key, text, marks in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "open")), strict=True):
                if not marks:
                    continue
                raw = text
                for m in marks:
                    lo, hi, anchor = _unpack(m["place"])
                    for k in range((anchor - hi) // STRIDE, (anchor - lo) // STRIDE + 1):
                        base = anchor - k * STRIDE
                        a, b = max(lo, base - STRIDE + 1), min(hi, base)
                        rows.append((_signed(xxhash.xxh3_64_intdigest(raw[base : base + shared], k)), key, a, m["n"] == 1, m["hot"], raw[a:base], raw[base + shared : b + length]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["shared", "key", "first", "once", "hot", "before", "after"])

    return map_batches(marked.select("key", "text", "open"), run, _PART)


_SPANS = "key long, first int, last int"


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["key", "first", "last"])


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    yield from zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)


def _windows(before: bytes, after: bytes, stride: int) -> int:
    """How many windows a part has: each takes stride - 1 bytes of what lies around the shared ones."""
    return len(before) + len(after) - stride + 2


class Shard:
    """Parts in groups of equal shared bytes, sorted together."""

    def __init__(self, length: int, stride: int) -> None:
        self.length, self.stride = length, stride
        self._clear()

    def _clear(self) -> None:
        self.texts: list[np.ndarray] = []
        self.rows: list[list[tuple]] = []
        self.done: list[tuple] = []
        self.size = self.groups = 0

    def add(self, group: list[tuple]) -> None:
        """A group's rows: (shared, key, first, once, before, after)."""
        kinds: dict[tuple[bytes, bytes], list[tuple]] = {}
        for row in group:
            kinds.setdefault(row[4:], []).append(row)
        for (before, after), rows in kinds.items():
            if len(rows) > 1:
                self.done += [(r[1], r[2], r[2] + _windows(before, after, self.stride) - 1 + self.length) for r in rows if r[3]]
        if len(kinds) < 2:
            return
        number = [self.groups >> 8 * d & 0xFF for d in range(DIGITS)]
        self.groups += 1
        for (before, after), rows in kinds.items():
            text = np.empty(len(before) + len(after) + 1 + DIGITS, np.uint16)
            text[: len(before)] = np.frombuffer(before, np.uint8)
            text[len(before)] = 256
            text[len(before) + 1 : len(before) + 1 + DIGITS] = number
            text[len(before) + 1 + DIGITS :] = np.frombuffer(after, np.uint8)
            self.texts.append(text)
            self.rows.append(rows)
            self.size += len(text)

    def solve(self) -> list[tuple]:
        """(key, first, last) of what repeated windows cover; the shard is empty afterwards."""
        out = self.done
        if self.texts:
            for rows, flags in zip(self.rows, repeated_windows(self.texts, self.stride + DIGITS, SYMBOLS), strict=True):
                if len(rows) == 1 and rows[0][3]:
                    _, key, first, *_ = rows[0]
                    out += [(key, first + a, first + b - 1 + self.length) for a, b in _runs(flags)]
        self._clear()
        return out


def _by_suffixes(parts: DataFrame, n: int, length: int, stride: int = STRIDE) -> DataFrame:
    """key, first and last (bytes, end exclusive) that repeated windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, group = Shard(length, stride), []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shared", "key", "first", "once", "before", "after")), strict=True):
                if group and row[0] != group[0][0]:
                    if len(group) > 1:
                        shard.add(group)
                    group = []
                    if (shard.size >= SHARD or len(shard.done) > 10_000) and (out := shard.solve()):
                        yield _span_batch(out)
                group.append(row)
        if len(group) > 1:
            shard.add(group)
        if out := shard.solve():
            yield _span_batch(out)

    return map_batches(parts.repartition(n, "shared").sortWithinPartitions("shared"), run, _SPANS)


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of hot cores cut into parts of at most FINE windows, which share more bytes."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary())
    for batch in batches:
        rows: list[tuple] = []
        for shared, key, first, once, before, after in zip(*(batch.column(c).to_pylist() for c in ("shared", "key", "first", "once", "before", "after")), strict=True):
            name, n = shared.to_bytes(8, "little", signed=True), len(before)
            # A window takes ``a`` bytes before the shared ones and STRIDE - 1 - a after them.
            least = STRIDE - 1 - len(after)
            for low in range(least // FINE * FINE, n + 1, FINE):
                a, b = max(low, least), min(low + FINE - 1, n)
                left, right = before[n - low :], after[: STRIDE - FINE - low]
                h = xxhash.xxh3_64_intdigest(name + bytes([low]) + left + right)
                rows.append((_signed(h), key, first + n - b, once, True, before[n - b : n - low], after[len(right) : STRIDE - 1 - a]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["shared", "key", "first", "once", "hot", "before", "after"])


def _by_windows(parts: DataFrame, length: int) -> DataFrame:
    """The same by counting the hashes of all windows of fine parts."""
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for shared, key, first, once, before, after in zip(*(batch.column(c).to_pylist() for c in ("shared", "key", "first", "once", "before", "after")), strict=True):
                name = shared.to_bytes(8, "little", signed=True)
                for i in range(_windows(before, after, FINE)):
                    left = before[i:]
                    h = xxhash.xxh3_128_intdigest(name + bytes([len(left)]) + left + after[: FINE - 1 - len(left)])
                    rows.append((key, first + i, once, _signed(h >> 64), _signed(h & 0xFFFFFFFFFFFFFFFF)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "first", "once", "h1", "h2"])

    windows = checkpointed(map_batches(parts, run, "key long, first int, once boolean, h1 long, h2 long"))
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2")
    return windows.where("once").join(twice, ["h1", "h2"]).select("key", "first", (F.col("first") + length).alias("last"))


def _of_hot_cores(parts: DataFrame, n: int, length: int) -> DataFrame:
    fine = checkpointed(map_batches(parts, _finer, _PART))
    large = fine.groupBy("shared").agg(F.count("*").alias("c")).where(F.col("c") > MOST_PIECES).select("shared")
    large = checkpointed(large)
    if not large.limit(1).count():
        return _by_suffixes(fine, n, length, FINE)
    # Few groups are that large, but their number is not bounded: an ordinary join.
    return _by_suffixes(fine.join(large, "shared", "left_anti"), n, length, FINE).unionByName(_by_windows(fine.join(large, "shared", "left_semi"), length))


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))


def _covered(src: DataFrame, length: int) -> DataFrame:
    """The columns of src (key, text as bytes, others), whole and spans of its rows that may have repeated strings of a length.

    What they cover is the union of whole (starts and ends in turn) and spans (first, last); ``_cuts`` makes it.
    """
    frame = Frame(length)
    n = max(1, int(src.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = checkpointed(_scan(src, frame))
    known = found.where("core is not null").select("key", "core", "piece", "place")
    times = F.col("place").bitwiseAND(F.lit(1)) + 1
    # A table of its own, so that the join has two plain sides and Spark can split a core that very many rows have.
    cores = checkpointed(known.groupBy("core").agg(F.sum(times).alias("n")).where("n > 1").select("core"))
    hits = checkpointed(known.join(cores, "core"))
    kinds = checkpointed(hits.groupBy("core", "piece").agg(F.sum(times).alias("n"), F.min(F.struct("key", "place")).alias("first")))
    # Every row of a piece that is there twice; of each kind of a core with several, one row.
    pair = F.array((F.shiftright("place", 20)).alias("a"), (F.shiftright("place", 20) + F.shiftright("place", 11).bitwiseAND(F.lit(0x1FF)) + length).alias("b"))
    nothing = F.lit(None).cast("struct<place:bigint,n:bigint,hot:boolean>")
    whole = hits.join(kinds.where("n > 1").select("core", "piece"), ["core", "piece"]).select("key", pair.alias("whole"), nothing.alias("open"))
    local = found.where("core is null").select("key", "whole", nothing.alias("open"))
    several = checkpointed(kinds.groupBy("core").agg(F.count("*").alias("k")).where("k > 1").select("core", (F.col("k") > MOST_PIECES).alias("hot")))
    some_hot = several.where("hot").limit(1).count() > 0
    mixed = kinds.join(several, "core").select("first.key", F.lit(None).cast("array<bigint>").alias("whole"), F.struct("first.place", "n", "hot").alias("open"))
    marks = whole.unionByName(local).unionByName(mixed).groupBy("key").agg(F.flatten(F.collect_list("whole")).alias("whole"), F.collect_list("open").alias("open"))
    marked = checkpointed(src.join(marks, "key"))
    forget(found, cores, hits, kinds, several)
    parts = _extract(marked, frame)
    if some_hot:
        parts = checkpointed(parts)
    spans = _by_suffixes(parts.where("not hot"), n, length)
    if some_hot:
        spans = spans.unionByName(_of_hot_cores(parts.where("hot"), n, length))
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return marked.select(*src.columns, "whole").join(spans, "key", "left")


def _cuts(whole: list[int], spans: list[dict] | None) -> list[tuple[int, int]]:
    return _merged([*zip(whole[::2], whole[1::2], strict=True), *((s["first"], s["last"]) for s in spans or ())])


def repeats(docs: DataFrame, length: int = REPEAT, id_col: str = "doc_id", text_col: str = "text", at_least: int = LENGTH) -> DataFrame:
    """The rows of docs with bytes that repeated strings of a length cover: key (of id and text) and n_repeated.

    long has start and end of what covers at_least bytes in a row; text (bytes) is there for rows with such stretches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        for batch in pieces(batches, "text"):
            out: list[tuple] = []
            for key, text, whole, more in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "whole", "spans")), strict=True):
                if cuts := _cuts(whole, more):
                    long = [{"start": a, "end": b} for a, b in cuts if b - a >= at_least]
                    out.append((key, sum(b - a for a, b in cuts), text if long else None, long))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "n_repeated", "text", "long"])

    src = docs.select(_key(id_col, text_col).alias("key"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return map_batches(_covered(src, length), run, "key long, n_repeated long, text binary, long array<struct<start:long,end:long>>")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with repeated strings: key (of id and text), n_repeated, n_removed, n_spans and kept (binary; null if nothing goes).

    Rows that are there more than once are there once.
    """
    found = checkpointed(repeats(docs, REPEAT, id_col, text_col))
    open_ = found.where("text is not null")
    src = open_.select(F.col("key").alias("doc"), "text", F.explode("long").alias("l"))
    src = src.select("doc", F.col("l.start").alias("at"), F.xxhash64("doc", "l.start").alias("key"), F.substring("text", (F.col("l.start") + 1).cast("int"), (F.col("l.end") - F.col("l.start")).cast("int")).alias("text"))

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, at + a, at + b) for doc, at, whole, more in zip(*(batch.column(c).to_pylist() for c in ("doc", "at", "whole", "spans")), strict=True) for a, b in _cuts(whole, more)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["key", "first", "last"])

    cuts = map_batches(_covered(src, LENGTH).select("doc", "at", "whole", "spans"), shift, "key long, first long, last long")
    cuts = checkpointed(cuts.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("cuts")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for batch in pieces(batches, "text"):
            out: list[tuple] = []
            for key, n_repeated, text, found_ in zip(*(batch.column(c).to_pylist() for c in ("key", "n_repeated", "text", "cuts")), strict=True):
                gone = _cuts([], found_)
                ends = [0, *(b for _, b in gone)]
                kept = b"".join([text[b:a] for b, a in zip(ends, [*(a for a, _ in gone), len(text)], strict=True)])
                out.append((key, n_repeated, sum(b - a for a, b in gone), len(gone), kept))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "n_repeated", "n_removed", "n_spans", "kept"])

    schema = "key long, n_repeated long, n_removed long, n_spans long, kept binary"
    lost = map_batches(open_.dropDuplicates(["key"]).join(cuts, "key").select("key", "n_repeated", "text", "cuts"), cut, schema)
    zero = F.lit(0).cast("long")
    kept = found.select("key", "n_repeated").dropDuplicates(["key"])
    whole = kept.join(cuts.select("key"), "key", "left_anti").select("key", "n_repeated", zero.alias("n_removed"), zero.alias("n_spans"), F.lit(None).cast("binary").alias("kept"))
    return lost.unionByName(whole)


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_repeated for every row of docs.

    n_repeated counts the bytes that strings of REPEAT bytes cover which are there again, removed or not.
    """
    lost = removed(docs, id_col, text_col).select("key", "n_removed", "n_spans", "n_repeated", F.sha2("kept", 256).alias("sha"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _key(id_col, text_col).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"))
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(lost, "key", "left").select("doc_id", "n_bytes", count("n_removed"), count("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"), count("n_repeated"))
