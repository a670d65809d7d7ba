"""Byte-level BPE by replaying the merges over a corpus at once.

All words that have not been seen yet are laid out in one array of tokens. An inverted index
has, for each rank, the positions of the neighbours that merge into it. Ranks are taken in
order; all positions of a rank merge together, from the left where they overlap, and only the
pairs of the two neighbours of each position are looked up again and go into the index.

Where a merge makes a pair of a lower rank, encoding word by word would take that pair first:
such words are encoded alone. Vocabularies learned by merging hardly have any.

Defined results: a null text counts as empty; an empty text has no ids. The decoder maps
ids to bytes and gives back exactly the UTF-8 bytes of the text.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grown, map_batches, pieces

#: Bytes of words that a worker remembers; beyond it forgets them and starts again.
CACHE_BYTES = 80 << 20
#: Bytes of text whose words are replayed together.
TOGETHER = 6 << 20
#: Longer words are encoded but not remembered.
LONGEST_CACHED = 64


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines ``base64 rank`` of a vocabulary file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


#: Texts of these characters only are split by Python's own engine, which is faster and agrees on them.
_PLAIN = re.compile(r"[\x20-\x7e\t\n\r\x0b\x0cÀ-ÖØ-öø-ÿ]*")
_LETTERS, _BLANKS = "A-Za-zÀ-ÖØ-öø-ÿ", r" \t\n\r\x0b\x0c"


def _quick(pattern: str) -> re.Pattern | None:
    """The same splits for plain texts, where the pattern's classes can be spelled out."""
    known = {r"\p{L}": _LETTERS, r"\p{N}": "0-9", r"\s": _BLANKS}
    if r"\S" not in pattern or "[" + _BLANKS in pattern:
        return None
    out = pattern.replace(r"(?!\S)", f"(?![^{_BLANKS}])").replace(r"[^\s\p{L}\p{N}]", f"[^{_BLANKS}{_LETTERS}0-9]")
    for name, letters in known.items():
        out = out.replace(name, f"[{letters}]")
    return None if "\\p" in out else re.compile(out)


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.quick = _quick(pattern)
        self.text = {i: t for t, i in ranks.items()}
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        # All pairs of tokens that merge: two halves of a token, by a number made of both.
        self.base = max(ranks.values()) + 1
        found = {ranks[t[:k]] * self.base + ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pairs = np.array(sorted(found), np.int64)
        self.merged = np.array([found[p] for p in self.pairs.tolist()], np.int64)
        self.known: dict[str, bytes] = {}
        self.last: set[str] = set()
        self.size = 0

    def split(self, text: str) -> list[str]:
        return self.quick.findall(text) if self.quick and _PLAIN.fullmatch(text) else self.pattern.findall(text)

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Into which rank neighbours merge, or -1."""
        key = a * self.base + b
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        if not len(self.pairs):
            return np.full(len(key), -1, np.int64)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.merged[at], -1)

    def alone(self, word: bytes) -> list[int]:
        """One word, always the lowest rank first, the leftmost of equal ones."""
        parts: list[bytes | None] = [bytes([c]) for c in word]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))

        def pair(i: int) -> tuple[int, int, bytes] | None:
            j = after[i]
            r = self.ranks.get(parts[i] + parts[j]) if j < len(parts) else None
            return None if r is None else (r, i, parts[i] + parts[j])

        heap = [p for i in range(len(parts) - 1) if (p := pair(i))]
        heapq.heapify(heap)
        while heap:
            _, i, text = heapq.heappop(heap)
            # Entries of pairs that are no more are passed over.
            if parts[i] is None or after[i] == len(parts) or parts[i] + parts[after[i]] != text:
                continue
            j = after[i]
            parts[i], parts[j], after[i] = text, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (p := pair(k)):
                    heapq.heappush(heap, p)
        return [self.ranks[p] for p in parts if p is not None]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (little-endian, 32 bits), all merges applied over all words in the order of ranks."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes + 1)
        starts = ends - sizes - 1
        ids = self.single[np.frombuffer(b"\0".join(words) + b"\0", np.uint8)]
        ids[ends - 1] = -1  # parts the words, never merges
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, -1, np.int64)  # of the pair that begins at a position
        rank[:-1] = self._pair_ranks(ids[:-1], ids[1:])
        index: dict[int, list[np.ndarray]] = {}
        self._enter(index, np.flatnonzero(rank >= 0), rank)
        heap = list(index)
        heapq.heapify(heap)
        odd: set[int] = set()
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r, None)
            if places is None:
                continue
            i = np.concatenate(places)
            i = np.unique(i[rank[i] == r])
            if not len(i):
                continue
            # Of positions that overlap every other one merges, from the left.
            linked = np.zeros(len(i), bool)
            linked[1:] = after[i[:-1]] == i[1:]
            if linked.any():
                first = np.maximum.accumulate(np.where(linked, 0, np.arange(len(i))))
                i = i[(np.arange(len(i)) - first) % 2 == 0]
            j = after[i]
            k = after[j]
            # What the right neighbour was, should it merge in this step as well.
            was = ids[k]
            ids[i], ids[j], rank[j] = r, -2, -1
            after[i], before[k] = k, i
            h = before[i]
            right = self._pair_ranks(ids[i], ids[k])
            left = np.where(h >= 0, self._pair_ranks(ids[h], ids[i]), -1)
            changed = was != ids[k]
            low = ((right >= 0) & (right < r)) | ((left >= 0) & (left < r))
            if changed.any():
                half = self._pair_ranks(ids[i[changed]], was[changed])
                low[changed] |= (half >= 0) & (half < r)
            if low.any():
                odd.update(np.searchsorted(ends, i[low], "right").tolist())
            rank[i] = right
            inner = h >= 0
            rank[h[inner]] = left[inner]
            touched = np.concatenate([i[right >= 0], h[left >= 0]])
            for q in self._enter(index, touched, rank):
                heapq.heappush(heap, q)
        tokens = ids[ids >= 0].astype("<u4")
        alive = np.concatenate([[0], np.cumsum(ids >= 0)])
        first, last = (4 * alive[starts]).tolist(), (4 * alive[ends - 1]).tolist()
        data = tokens.tobytes()
        out = [data[a:b] for a, b in zip(first, last, strict=True)]
        for w in odd:
            out[w] = np.array(self.alone(words[w]), "<u4").tobytes()
        # A word that is a token as a whole has its rank, whether merges lead there or not.
        for w, raw in enumerate(words):
            if raw in self.ranks:
                out[w] = self.ranks[raw].to_bytes(4, "little")
        return out

    @staticmethod
    def _enter(index: dict[int, list[np.ndarray]], places: np.ndarray, rank: np.ndarray) -> list[int]:
        """Puts positions into the index by the rank of their pair; gives the ranks that are new there."""
        if not len(places):
            return []
        found = rank[places]
        order = np.argsort(found, kind="stable")
        places, found = places[order], found[order]
        cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
        new = []
        for a, b, q in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)], found[np.concatenate([[0], cuts])].tolist(), strict=True):
            if q in index:
                index[q].append(places[a:b])
            else:
                index[q] = [places[a:b]]
                new.append(q)
        return new

    def learn(self, words: set[str]) -> None:
        """Encodes the words together and remembers them."""
        if self.size > CACHE_BYTES:
            self.known.clear()
            self.size = 0
        new = [w for w in words if w not in self.known]
        self.known.update(zip(new, self.replay([w.encode() for w in new]), strict=True))
        self.size += sum(150 + 5 * len(w) for w in new)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        words: set[str] = set()
        for t in texts:
            words.update(self.split(t))
        self.learn(words)
        self.last = words
        known = self.known
        # Texts are split again: lists of all their words would take many times their size.
        out = [b"".join([known[w] for w in self.split(t)]) for t in texts]
        for w in words:
            if len(w) > LONGEST_CACHED:
                del known[w]
        return out

    def rest(self) -> None:
        """Between tasks only the words of the last texts are kept."""
        self.known = {w: self.known[w] for w in self.last if w in self.known}
        self.size = sum(150 + 5 * len(w) for w in self.known)

    def decode(self, ids: bytes) -> bytes:
        text = self.text
        return b"".join([text[i] for i in np.frombuffer(ids, "<u4").tolist()])


_HERE: dict[int, Vocabulary] = {}


def _vocabulary(ranks, pattern: str) -> Vocabulary:
    """One for a worker process, kept between its tasks."""
    key = zlib.crc32(ranks.value, zlib.crc32(pattern.encode()))
    if key not in _HERE:
        _HERE.clear()
        _HERE[key] = Vocabulary(read_ranks(ranks.value), pattern)
    return _HERE[key]


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches together, up to about TOGETHER bytes."""
    part: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        part.append(batch)
        size += batch.nbytes
        if size >= TOGETHER:
            yield pa.concat_batches(part)
            part, size = [], 0
    if part:
        yield pa.concat_batches(part)


def encode(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """doc_id, keep, ids_col (binary: little-endian unsigned 32-bit integers) for every row of docs. No shuffle.

    With decoded_col also the bytes that decoding the ids gives. Columns of these names are replaced. The vocabulary is
    read on the driver and broadcast: a file of fixed size, under 1 MB here.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(_file(vocab_path))
    new = [ids_col, decoded_col] if decoded_col else [ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(ranks, pattern)
        for batch in _joined(pieces(batches, "__text")):
            ids = vocabulary.encode([t or "" for t in batch.column("__text").to_pylist()])
            cols = [pa.array(ids, pa.binary())]
            if decoded_col:
                cols.append(pa.array([vocabulary.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *cols], [*kept, *new])
        vocabulary.rest()

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *(F.col(f"`{c}`") for c in keep if c not in ("doc_id", id_col, *new)), F.col(f"`{text_col}`").alias("__text"))
    kept = src.columns[:-1]
    return map_batches(src, run, grown(src.drop("__text"), *((c, "binary") for c in new)))


def decode(encoded: DataFrame, vocab_path: str, pattern: str, ids_col: str = "ids", as_col: str = "decoded") -> DataFrame:
    """All columns and as_col (binary), the bytes that the ids stand for. No shuffle."""
    ranks = encoded.sparkSession.sparkContext.broadcast(_file(vocab_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(ranks, pattern)
        for batch in pieces(batches, ids_col):
            got = [None if x is None else vocabulary.decode(x) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], [*batch.schema.names, as_col])

    return map_batches(encoded, run, grown(encoded, (as_col, "binary")))
