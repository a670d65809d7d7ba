"""Toxic texts by a learned lexicon, misspellings included, weighed by context.

Training finds the lexicon in labelled texts: words, and stems that many words begin with,
which occur after many different words in toxic texts and hardly in others. The number of
different words before a term counts, not its occurrences, so a copied text adds nothing.

Scoring reads every token. A token is a term, begins with a stem, or is within a bounded
edit distance of a term, or a prefix of it is of a stem: a Levenshtein automaton of the token
walks the tries of the lexicon and only branches that the automaton still accepts are
followed. Tokens that occur in harmless training texts are never taken for misspellings.
Misspellings of a term that many harmless words come near count less, but are all sought. Each hit is weighed by its
context: next to other hits it counts more, inside quotation marks and near words of
reporting it counts less. A logistic model maps the weights to a probability.

Defined results: null and empty texts score as a text without hits; without labelled texts
of both kinds every score is the share of toxic labels, or 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import grown, map_batches, pieces, plain

#: Bytes of text, about, that training takes of each label: whole texts, by a hash. They bound the lexicon as well.
TOXIC_BYTES, CLEAN_BYTES = 4_000_000, 8_000_000
#: What a row counts beside its text, so that their number is bounded too; longer texts are scored but not learned from.
ROW_BYTES, LONGEST = 64, 1 << 20
#: A term follows at least so many different words in toxic texts ...
LEAST_CONTEXTS = 6
#: ... in at least so many toxic texts that are not near copies of others ...
LEAST_TEXTS = 5
#: ... and these are at least this share of its weighted contexts.
PURITY = 0.95
#: Chance findings expected among all terms tested.
FALSE_TERMS = 0.05
STEM_LENGTHS = range(4, 9)
#: Words around a hit that make its context.
WINDOW = 12
#: A misspelt term counts so much of the term.
NEAR = 0.8
#: From so many harmless words near a term on, its misspellings count less.
CROWD = 8
#: The logarithm of the ratio of a term's shares in toxic and other texts from which it counts fully.
FULL_RATIO = 5.0
#: Tokens that a worker remembers.
KNOWN = 1 << 20

_TOKEN = re.compile(r"[^\W_]+(?:[@$*][^\W_]+)*")
_LEET = str.maketrans("013457@$", "oieastas")
_QUOTES = "\"“”«»„"
# Words that report speech.
_REPORT = frozenset("said says wrote quoted quote called quotes reported word term dit écrit appelé mot sagte schrieb wort zitat dijo escribió palabra".split())


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def distance_allowed(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


def _accepted(seen: str, term: str, edits: int) -> bool:
    """Whether a text so many edits from a term is a misspelling of it; short terms and two edits keep the first letter."""
    return edits <= distance_allowed(term) and (edits < 1 + (len(term) > 4) or seen[0] == term[0])


class Trie:
    """The lexicon's words by letter; ``near`` intersects it with the Levenshtein automaton of a token."""

    def __init__(self, words: set[str]) -> None:
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def near(self, token: str, most: int, heads: bool = False) -> dict[str, int]:
        """Words within the distance, with their distances; with heads, of the nearest prefix of the token.

        The automaton's state is the row of edit distances to each prefix of the token; a
        branch ends where all of them exceed the bound.
        """
        found: dict[str, int] = {}
        stack = [(self.root, list(range(len(token) + 1)))]
        while stack:
            node, row = stack.pop()
            for c, child in node.items():
                if not c:
                    if (edits := min(row) if heads else row[-1]) <= most:
                        found[child] = edits
                    continue
                new = [row[0] + 1]
                for i, x in enumerate(token):
                    new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (x != c)))
                if min(new) <= most:
                    stack.append((child, new))
        return found


class Lexicon:
    """Terms and stems with a bounded memory of tokens already looked up."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], harmless: set[str], toxic: set[str] = frozenset(), purity: dict[str, float] | None = None) -> None:
        """toxic: words of toxic texts, harmless ones too; purity: as measured before, in place of them."""
        self.words, self.stems, self.harmless = words, stems, harmless
        self.trie, self.stem_trie = Trie(set(words)), Trie(set(stems))
        self.stem_lengths = sorted({len(s) for s in stems})
        # One edit leaves one half of a term as it is, two edits one third: a token that has none of these is not near.
        self.part_texts = {w[a:b] for w in words for a, b in self._cuts(w, distance_allowed(w))}
        self.part_lengths = sorted({len(p) for p in self.part_texts})
        self.lengths = {n for w in words if (d := distance_allowed(w)) for n in range(len(w) - d, len(w) + d + 1)}
        self.stem_parts = {s[a:b] for s in stems for a, b in self._cuts(s, distance_allowed(s))}
        self.stem_part_lengths = sorted({len(p) for p in self.stem_parts})
        self.purity = self._purity(toxic) if purity is None else purity
        self.known: dict[str, float] = {}

    def _purity(self, toxic: set[str]) -> dict[str, float]:
        """The share of words near a term that only toxic texts have, where many harmless words come near it; else 1.

        Any ending makes a word near a stem: there it is what this share is above one half, doubled.
        """
        good = Counter(w for token in self.harmless for w in self._near(token))
        bad = Counter(w for token in toxic - self.harmless if token not in self.words for w in self._near(token))
        share = {w: (bad[w] + CROWD) / (bad[w] + n) for w, n in good.items() if n > CROWD}
        return {w: max(0.0, 2 * p - 1) if w in self.stems else p for w, p in share.items()}

    @staticmethod
    def _cuts(word: str, edits: int) -> list[tuple[int, int]]:
        edges = [len(word) * k // (edits + 1) for k in range(edits + 2)]
        return [(edges[k], edges[k + 1]) for k in range(edits + 1)] if edits else []

    def _weight(self, token: str) -> float:
        if token in self.words:
            return self.words[token]
        for n in self.stem_lengths:
            if token[:n] in self.stems:
                return self.stems[token[:n]]
        if token in self.harmless:
            return 0.0
        seen = token if token.isalpha() else token.translate(_LEET).replace("*", "")
        if seen != token and seen in self.words:
            return self.words[seen]
        return max((NEAR * max(self.words.get(w, 0.0), self.stems.get(w, 0.0)) * self.purity.get(w, 1.0) for w in self._near(seen)), default=0.0)

    def _near(self, seen: str) -> list[str]:
        """The terms that a token may be a misspelling of, and the stems that its beginning may be."""

        def shares(parts: set[str], lengths: list[int]) -> bool:
            return any(seen[i : i + n] in parts for n in lengths for i in range(len(seen) - n + 1))

        found: dict[str, int] = {}
        if len(seen) in self.lengths and shares(self.part_texts, self.part_lengths):
            found = self.trie.near(seen, 2)
        if self.stem_parts and shares(self.stem_parts, self.stem_part_lengths):
            found |= self.stem_trie.near(seen[: STEM_LENGTHS[-1] + 1], 1, heads=True)
        return [w for w, d in found.items() if _accepted(seen, w, d)]

    def look_up(self, words: set[str]) -> dict[str, float]:
        """Weights of all the words; those without any are 0."""
        if len(self.known) > KNOWN:
            self.known.clear()
        known, weight = self.known, self._weight
        for w in words:
            if w not in known:
                known[w] = weight(w)
        return known

    def features(self, text: str) -> tuple[float, float, float]:
        """Weighted hits, the best window, and the share of hits that are quoted or reported."""
        words = tokens(text)
        known = self.look_up(set(words))
        hits = [(i, known[w]) for i, w in enumerate(words) if known[w]]
        if not hits:
            return 0.0, 0.0, 0.0
        quoted = self._quoted(text, [i for i, _ in hits]) if any(q in text for q in _QUOTES) else set()
        for i, _ in hits:
            if not _REPORT.isdisjoint(words[max(0, i - WINDOW // 2) : i]):
                quoted.add(i)
        # A quoted term counts a third; in a window with unquoted ones it counts fully.
        open_at = [i for i, _ in hits if i not in quoted]
        total, best, left = 0.0, 0.0, 0
        weights = []
        near = 0
        for i, w in hits:
            while near < len(open_at) and open_at[near] < i - WINDOW:
                near += 1
            alone = i in quoted and not (near < len(open_at) and open_at[near] <= i + WINDOW)
            weights.append(w / 3 if alone else w)
        run = 0.0
        for k, (i, _) in enumerate(hits):
            run += weights[k]
            while hits[left][0] < i - WINDOW:
                run -= weights[left]
                left += 1
            best = max(best, run)
            total += weights[k]
        return total, best, len(quoted) / len(hits)

    @staticmethod
    def _quoted(text: str, at: list[int]) -> set[int]:
        """Which of the tokens at these places stand between quotation marks on one line."""
        found, want, inside, k = set(), set(at), False, 0
        last = max(at)
        for m in re.finditer(rf"[{_QUOTES}]|\n|{_TOKEN.pattern}", text.lower()):
            c = m[0]
            if c == "\n":
                inside = False
            elif c in _QUOTES:
                inside = not inside if c == '"' else c in "“«„"
            else:
                if inside and k in want:
                    found.add(k)
                k += 1
                if k > last:
                    break
        return found


def _terms(toxic: list[str], clean: list[str]) -> tuple[dict[str, float], dict[str, float], set[str], set[str]]:
    """Words and stems of the lexicon with their weights, all words of the harmless texts, and all of the toxic ones."""

    def contexts(texts: list[str]) -> tuple[dict[str, set[str]], Counter, Counter, Counter]:
        """The words before each word; in how many texts a word or stem is; in how many of these most words before it are new."""
        found: dict[str, set[str]] = defaultdict(set)
        in_texts, stem_texts, new_texts = Counter(), Counter(), Counter()
        for t in texts:
            words = tokens(t)
            pairs = set(zip(words, ["", *words], strict=False))
            new = [(w, before) for w, before in pairs if before not in found[w]]
            for w, before in new:
                found[w].add(before)
            in_texts.update(own := set(words))
            stem_texts.update({w[:n] for w in own for n in STEM_LENGTHS if len(w) >= n})
            seen, fresh = Counter(), Counter()
            for count, part in ((seen, pairs), (fresh, new)):
                for w, _ in part:
                    count[w, 0] += 1
                    for n in STEM_LENGTHS:
                        if len(w) >= n:
                            count[w[:n], n] += 1
            # A near copy of a text, however long, has few that are new.
            new_texts.update([name for name, n in fresh.items() if 2 * n >= seen[name]])
        return found, in_texts, stem_texts, new_texts

    (bad, bad_texts, bad_stem_texts, bad_new), (good, good_texts, good_stem_texts, _) = contexts(toxic), contexts(clean)
    n_bad, n_good = sum(map(len, bad.values())), sum(map(len, good.values()))
    chance = n_bad / max(1, n_bad + n_good)

    def stems(found: dict[str, set[str]]) -> tuple[Counter, Counter]:
        sizes, forms = Counter(), Counter()
        for w, before in found.items():
            for n in STEM_LENGTHS:
                if len(w) >= n:
                    sizes[w[:n]] += len(before)
                    forms[w[:n]] += 1
        return sizes, forms

    bad_stems, bad_forms = stems(bad)
    good_stems, _ = stems(good)
    tested = max(1, len(bad) + len(bad_stems))
    # So many contexts, all of them in toxic texts, that chance explains few of the terms found.
    least = max(LEAST_CONTEXTS, math.ceil(math.log(FALSE_TERMS / tested) / math.log(max(1e-9, min(chance, 0.999)))))

    # Forms of a stem come in clusters, as texts differ in kind: chance is asked over independent texts as well.
    text_chance = len(toxic) / max(1, len(toxic) + len(clean))
    least_texts = max(LEAST_TEXTS, math.ceil(math.log(FALSE_TERMS / tested) / math.log(max(1e-9, min(text_chance, 0.999)))))

    def pure(n: int, other: int) -> bool:
        share = chance / (1 - chance) if chance < 1 else 1.0
        return n >= least + 4 * other and n >= PURITY * (n + other * share)

    words = {w for w, before in bad.items() if len(w) > 2 and bad_new[w, 0] >= LEAST_TEXTS and pure(len(before), len(good.get(w, ())))}
    found: set[str] = set()
    for s in sorted(bad_stems, key=len):
        if any(s[:n] in found for n in STEM_LENGTHS if n < len(s)) or bad_forms[s] < 4 or bad_new[s, len(s)] < least_texts or not pure(bad_stems[s], good_stems[s]):
            continue
        top = max((len(bad[w]) for w in words if w.startswith(s)), default=0)
        if top < 0.7 * bad_stems[s]:  # else one word explains the stem
            # All forms may share more than these letters.
            while len(s) < STEM_LENGTHS[-1] and (more := [x for x in bad_stems if len(x) == len(s) + 1 and x.startswith(s) and bad_stems[x] >= 0.98 * bad_stems[s]]):
                s = more[0]
            found.add(s)
    words = {w for w in words if not any(w[:n] in found for n in STEM_LENGTHS)}
    harmless = {w for w in good if len(w) >= 3}

    def weight(n: int, other: int) -> float:
        return min(1.0, max(0.1, math.log((n + 0.5) / len(toxic) * len(clean) / (other + 0.5)) / FULL_RATIO))

    return {w: weight(bad_texts[w], good_texts[w]) for w in sorted(words)}, {s: weight(bad_stem_texts[s], good_stem_texts[s]) for s in sorted(found)}, harmless - words, set(bad)


def _design(rows: list[tuple[float, float, float]]) -> np.ndarray:
    x = np.array(rows, float).reshape(-1, 3)
    return np.column_stack([np.ones(len(x)), np.log1p(x[:, 0]), np.minimum(1, x[:, 0]), np.log1p(x[:, 1]), x[:, 2]])


class Model:
    def __init__(self, lexicon: Lexicon, beta: np.ndarray) -> None:
        self.lexicon, self.beta = lexicon, beta

    def __reduce__(self):
        return Model._load, (self.lexicon.words, self.lexicon.stems, self.lexicon.harmless, self.lexicon.purity, self.beta)

    @staticmethod
    def _load(words, stems, harmless, purity, beta) -> Model:
        return Model(Lexicon(words, stems, harmless, purity=purity), beta)

    def score(self, texts: list[str | None]) -> list[float]:
        rows = [self.lexicon.features(t) if t else (0.0, 0.0, 0.0) for t in texts]
        return (1 / (1 + np.exp(-np.clip(_design(rows) @ self.beta, -30, 30)))).tolist()


def fit(toxic: list[str], clean: list[str], n_toxic: int, n_clean: int) -> Model:
    """toxic, clean: the sampled texts; n_toxic, n_clean: how many labelled texts there are."""
    share = n_toxic / (n_toxic + n_clean) if n_toxic + n_clean else 0.0
    if not toxic or not clean:
        flat = min(max(share, 1e-9), 1 - 1e-9)
        return Model(Lexicon({}, {}, set()), np.array([math.log(flat / (1 - flat)), 0, 0, 0, 0]))
    lexicon = Lexicon(*_terms(toxic, clean))
    x = _design([lexicon.features(t) for t in toxic + clean])
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    w = np.where(y == 1, n_toxic / len(toxic), n_clean / len(clean))
    w *= len(y) / w.sum()
    beta, ridge = np.zeros(5), np.diag([1e-3, 0.05, 0.05, 0.05, 0.2])
    prior = np.array([0, 1.0, 1.0, 0.5, -1.0])  # hits speak for toxic, quotation against it
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (w * p * (1 - p))) @ x + ridge, x.T @ (w * (y - p)) - ridge @ (beta - prior))
        new = beta + np.clip(step, -4, 4)
        # More hits never speak for a harmless text, whatever the labels of a small sample say.
        new[1:4] = np.maximum(new[1:4], 0)
        done, beta = np.abs(new - beta).max() < 1e-8, new
        if done:
            break
    return Model(lexicon, beta)


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from the labelled rows where learn (a condition on doc_id) holds; a bounded sample of them.

    A document labelled twice counts once for each label.
    """
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).where(learn & F.col("y").isin(0, 1)).distinct()
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where(learn & F.col("text").isNotNull() & (F.octet_length("text") <= LONGEST))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # Only ids and sizes meet the labels here: what is picked is a share of the labelled bytes.
    sizes = texts.select("doc_id", (F.octet_length("text") + ROW_BYTES).cast("long").alias("size")).join(marks, "doc_id").groupBy("y").agg(F.sum("size").alias("size")).collect()
    size = {r["y"]: r["size"] for r in sizes}
    count = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pick = F.lit(False)
    for y, most in ((1, TOXIC_BYTES), (0, CLEAN_BYTES)):
        share = min(1.0, most / max(1, size.get(y, 0)))
        pick = pick | ((F.col("y") == y) & (place < int(share * (1 << 30))))
    # At most (TOXIC_BYTES + CLEAN_BYTES) / ROW_BYTES rows, about, go to every executor; the texts stay where they are.
    picked = marks.where(pick).join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = texts.join(F.broadcast(picked), "doc_id").select("y", "text").distinct().orderBy("y", "text")
    got: dict[int, list[str]] = {0: [], 1: []}
    for y, text in rows.toLocalIterator():
        got[y].append(text)
    return fit(got[1], got[0], count.get(1, 0), count.get(0, 0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, score_col: str = "score") -> DataFrame:
    """doc_id and score_col for every row of docs; with keep_text all columns of docs (one of that name is replaced).

    No shuffle; the model is bounded by its sample.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            scores = sent.value.score(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], [*kept, score_col])

    if keep_text:
        src, text = docs, text_col
        kept = [c for c in docs.columns if c != score_col]
    else:
        src, text = plain(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")), "text"
        kept = ["doc_id"]
    return map_batches(src, run, grown(src.select(*(F.col(f"`{c}`") for c in kept)), (score_col, "double")))
