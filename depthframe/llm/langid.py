"""Language of a text by prediction by partial matching.

Each language has counts of byte strings up to ORDER + 1 bytes: a context tree whose node
for a context knows how often each byte followed it. The code length of a byte is that of
method C: if the longest known context has seen the byte, its share; else the escape
probability of the context, then the next shorter one, down to an even share. All counts
are frozen after training, so the code length of a byte depends only on the last
ORDER + 1 bytes, and whole texts are scored exactly by table lookups. The language of the
shortest code wins.

Texts are read in lower case as UTF-8, after ORDER line breaks. Defined results: null, and
a text without a letter, is ``und`` with score 0; so is every text if nothing was there to
learn from. Ties go to the first language in order of name. Every language that has a text
is learned; with many of them the sample of each is smaller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pieces, plain

ORDER = 4
#: Bytes of text, about, that training takes of each language: whole texts, by a hash of their id.
SAMPLE_BYTES = 1_200_000
#: The tables have a number for each context and language, so their size grows with the square of the number of
#: languages. From this many languages on, each one's sample shrinks so that they stay as large as they are then.
MANY_LANGUAGES = 4
_LETTER = regex.compile(r"\p{L}")
_START = b"\n" * ORDER
#: Bytes scored at a time.
_WINDOW = 1 << 20


class Model:
    """Context trees of all languages in one: nodes by depth, code lengths by node and language."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.langs = sorted(texts)
        parts = [np.frombuffer(b"".join(_START + t.lower().encode() for t in texts[lang]), np.uint8) for lang in self.langs]
        data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        # No string reaches back into another language.
        place = np.concatenate([np.arange(len(p)) for p in parts]) if parts else of
        # Class 0 has the bytes that training has not seen.
        seen = np.unique(data)
        self.cls = np.zeros(256, np.int64)
        self.cls[seen] = np.arange(1, len(seen) + 1)
        self.width = k = len(seen) + 1
        n_langs = len(self.langs)
        sizes = np.array([max(1, len(texts[lang])) for lang in self.langs], float)
        self.prior = -np.log2(sizes / sizes.sum()) if n_langs else sizes
        ids = self.cls[data]
        self.step: list[np.ndarray] = []  # by depth: node of the next depth by node * width + class
        self.cost: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        if not n_langs:
            return
        # Depth 0 has one node; the code of last resort is an even share of 256 bytes.
        above, short, classes = np.zeros(len(ids), np.int64), None, ids
        n_above = 1
        for depth in range(1, ORDER + 2):
            if depth > 1:
                above = np.concatenate([[0], short[:-1]])  # the context that ends a byte earlier
            key = above * k + classes
            key[place < depth - 1] = 0
            if depth > 1:
                key[above == 0] = 0
            found, node = np.unique(key, return_inverse=True)
            if not len(found) or found[0] != 0:
                found, node = np.concatenate([[0], found]), node + 1
            table = np.zeros(n_above * k, np.int32)
            table[found[1:]] = np.arange(1, len(found))
            counts = np.zeros((len(found), n_langs))
            for x in range(n_langs):
                counts[:, x] = np.bincount(node[of == x], minlength=len(found))
            counts[0] = 0
            parent = found // k
            total, kinds = np.zeros((n_above, n_langs)), np.zeros((n_above, n_langs))
            np.add.at(total, parent, counts)
            np.add.at(kinds, parent, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
                own = -np.log2(counts / (total + kinds)[parent])
            if depth == 1:
                lower = np.full((len(found), n_langs), 8.0)
            else:
                suffix = np.zeros(len(found), np.int64)
                suffix[node] = short
                lower = self.cost[-1][suffix]
            cost = np.where(counts > 0, own, escape[parent] + lower)
            cost[0] = 0
            self.step.append(table)
            self.cost.append(cost.astype(np.float32))
            self.escape.append(escape.astype(np.float32))
            short, n_above = node, len(found)

    def _codes(self, data: np.ndarray, skip: int) -> np.ndarray:
        """Bits of each byte after the first ``skip``, by language."""
        classes = self.cls[data]
        ids = [np.zeros(len(data), np.int64)]
        node = self.step[0][classes]
        ids.append(node)
        for table in self.step[1:]:
            prev = np.concatenate([[0], node[:-1]])
            node = table[prev.astype(np.int64) * self.width + classes]
            node[prev == 0] = 0
            ids.append(node)
        out = self.cost[-1][ids[-1][skip:]]
        left = np.flatnonzero(ids[-1][skip:] == 0) + skip
        for depth in range(ORDER, -1, -1):
            # What is left has not been seen at depth + 1 in any language: escape, then the shorter string.
            context = ids[depth][left - 1] if depth else np.zeros(len(left), np.int64)
            bits = self.escape[depth][context]
            if depth:
                bits[context == 0] = 0
                bits += self.cost[depth - 1][ids[depth][left]]
            else:
                bits += 8.0
            out[left - skip] += bits
            left = left[ids[depth][left] == 0] if depth else left[:0]
        return out

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each whole text, by language."""
        out = np.zeros((len(texts), len(self.langs)))
        part: list[bytes] = []
        owner: list[tuple[int, int]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if part:
                data = np.frombuffer(b"".join(part), np.uint8)
                bits = self._codes(data, ORDER)
                at = 0
                starts, who = [], []
                for i, n in owner:
                    starts += [at, at + n]
                    who.append(i)
                    at += n + ORDER
                starts = starts[:-1] if starts[-1] >= len(bits) else starts
                sums = np.add.reduceat(bits, starts, 0, dtype=np.float64)[::2]
                np.add.at(out, who, sums)
            part.clear()
            owner.clear()
            size = 0

        for i, t in enumerate(texts):
            raw = _START + t.lower().encode()
            for a in range(ORDER, len(raw), _WINDOW):
                chunk = raw[a - ORDER : a + _WINDOW]
                part.append(chunk)
                owner.append((i, len(chunk) - ORDER))
                size += len(chunk)
                if size >= _WINDOW:
                    flush()
        flush()
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        ask = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if ask and self.langs:
            bits = self.code_lengths([texts[i] for i in ask]) + self.prior
            best = bits.argmin(1)
            gap = bits - bits.min(1, keepdims=True)
            share = 1 / np.exp2(-np.minimum(gap, 1000)).sum(1)
            for i, b, s in zip(ask, best.tolist(), share.tolist(), strict=True):
                langs[i], scores[i] = self.langs[b], s
        return langs, scores


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Counts over a sample of the rows where learn holds: about sample_bytes of each language, less of more than MANY_LANGUAGES."""
    rows = docs.where(learn).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("n")).orderBy("lang").collect()
    sample_bytes = sample_bytes * min(1.0, MANY_LANGUAGES / max(1, len(sizes))) ** 2
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    # Of each language at least the row of the lowest place is there, however small its share.
    shares = {lang: min(1.0, sample_bytes / max(1, n)) for lang, n in sizes}
    first = {r["lang"]: r["place"] for r in rows.groupBy("lang").agg(F.min(place).alias("place")).collect()} if len(sizes) > MANY_LANGUAGES else {}
    limit = F.create_map(*(F.lit(x) for lang, share in shares.items() for x in (lang, max(int(share * (1 << 30)), first.get(lang, -1) + 1)))) if shares else None
    pick = place < F.element_at(limit, F.col("lang")) if shares else F.lit(False)
    texts: dict[str, list[str]] = {}
    for lang, text in rows.where(pick).select("lang", "text").orderBy("lang", "text").toLocalIterator():
        texts.setdefault(lang, []).append(text)
    return Model(texts)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for every row of docs. No shuffle; the model's size is bounded by its sample."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            langs, scores = sent.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    src = plain(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_batches(src, run, "doc_id long, lang_pred string, score double")
