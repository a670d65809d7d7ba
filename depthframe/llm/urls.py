"""URL verdicts: rules first, gradient-boosted trees for the rest.

A rule is a host and a path: it fits the host and its subdomains where the path begins with
the rule's; the longest fitting rule decides. The other URLs get the verdict of boosted
regression trees over lexical features: lengths, depth, shares of digits and other signs,
entropy, counts of parameters, and how often URLs under the same suffix were blocked. The
trees are trained on URLs that a rule has decided (or any labelled URLs). What they learn
from is out of fold: the suffix counts of a training URL leave its own fold out.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no
rule and is judged by its features; without labelled URLs of both kinds the only kind seen,
or ``allow``, is the verdict. Repeated rows are judged alike.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import grown, map_batches

#: Labelled URLs that training takes at most, by a hash of the URL.
SAMPLE_ROWS = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_col: Column, path_col: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (null if none fits). rules: (rule, verdict), few of them."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host_col == name) | host_col.endswith(f".{name}")) & path_col.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _parts(url: str) -> tuple[str, str, str]:
    _, sep, rest = url.partition("://")
    if not sep:
        return "", "", ""
    ends = [i for c in "/?#" if (i := rest.find(c)) >= 0]
    cut = min(ends, default=len(rest))
    tail = rest[cut:]
    stop = min([i for c in "?#" if (i := tail.find(c)) >= 0], default=len(tail))
    return rest[:cut].lower(), tail[:stop], tail[stop:]


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def _suffixes(name: str, where: str) -> tuple[str, ...]:
    """The last label of a host, the last two, and the first segment of the path as such."""
    labels = name.split(".")
    return labels[-1], ".".join(labels[-2:]), "/" + where[1:].partition("/")[0][:16]


class Suffixes:
    """How many URLs had a suffix, or a first segment, in training, and how many of them were blocked (smoothed).

    At most three of each URL of the sample, so their number is bounded as the sample is.
    """

    def __init__(self, urls: list[str], blocked: list[int]) -> None:
        n, bad = Counter(), Counter()
        for u, y in zip(urls, blocked, strict=True):
            for s in set(_suffixes(*_parts(u)[:2])):
                n[s] += 1
                bad[s] += y
        self.base = (sum(blocked) + 1) / (len(blocked) + 2)
        self.seen = {s: (c, (bad[s] + 5 * self.base) / (c + 5)) for s, c in n.items()}

    def of(self, suffix: str) -> tuple[float, float]:
        c, rate = self.seen.get(suffix, (0, self.base))
        return math.log1p(c), rate


def features(url: str, suffixes: Suffixes) -> list[float]:
    name, where, rest = _parts(url)
    last, last2, head = map(suffixes.of, _suffixes(name, where))
    n = len(url)
    return [
        n, len(name), len(where), name.count(".") + 1, where.count("/"), rest.count("=") + rest.count("&"), float("#" in rest),
        sum(c.isdigit() for c in url) / max(1, n), sum(c.isdigit() for c in where) / max(1, len(where)), name.count("-"), sum(not c.isalnum() for c in url) / max(1, n),
        _entropy(url), _entropy(name), float(url.startswith("https")), *last, *last2, *head,
    ]


class Trees:
    """Gradient boosting of small regression trees on the logistic loss, with histogram splits."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 5) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = min(max(y.mean(), 1e-6), 1 - 1e-6) if len(y) else 0.5
        self.start = math.log(share / (1 - share))
        if len(np.unique(y)) < 2:
            return self
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree, out = self._grow(binned, edges, y - p, p * (1 - p))
            self.trees.append(tree)
            f += out
        return self

    def _grow(self, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[list[tuple], np.ndarray]:
        """A tree as rows (feature, threshold, left, right, value); feature -1 is a leaf."""
        rows: list[tuple] = [(-1, 0.0, 0, 0, 0.0)]
        out, todo = np.zeros(len(g)), [(0, np.arange(len(g)), 0)]
        while todo:
            at, ids, depth = todo.pop()
            total_g, total_h = g[ids].sum(), h[ids].sum()
            best = (1e-6, -1, 0)
            if depth < self.depth:
                for c, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[ids, c]
                    n = np.bincount(b, minlength=len(e) + 1).cumsum()[:-1]
                    sg = np.bincount(b, g[ids], len(e) + 1).cumsum()[:-1]
                    sh = np.bincount(b, h[ids], len(e) + 1).cumsum()[:-1]
                    gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                    gain[(n < self.least) | (len(ids) - n < self.least)] = -1
                    if gain.max() > best[0] + 1e-9:
                        best = (float(gain.max()), c, int(gain.argmax()))
            _, c, cut = best
            if c < 0:
                value = self.rate * total_g / (total_h + 1)
                rows[at] = (-1, 0.0, 0, 0, value)
                out[ids] = value
                continue
            left = binned[ids, c] <= cut
            rows[at] = (c, float(edges[c][cut]), len(rows), len(rows) + 1, 0.0)
            todo += [(len(rows), ids[left], depth + 1), (len(rows) + 1, ids[~left], depth + 1)]
            rows += [(-1, 0.0, 0, 0, 0.0)] * 2
        return rows, out

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        for rows in self.trees:
            feature, cut, left, right, value = (np.array(c) for c in zip(*rows, strict=True))
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                inner = feature[at] >= 0
                go = np.where(x[np.arange(len(x)), feature[at]] <= cut[at], left[at], right[at])
                at = np.where(inner, go, at)
            f += value[at]
        return 1 / (1 + np.exp(-f))


#: Parts of the training URLs, by a hash of the host; the suffix counts of each come from the others.
FOLDS = 5


class Model:
    def __init__(self, urls: list[str], blocked: list[int]) -> None:
        self.suffixes = Suffixes(urls, blocked)
        self.trees = Trees().fit(self._out_of_fold(urls, blocked), np.array(blocked, float)) if urls else None

    @staticmethod
    def _out_of_fold(urls: list[str], blocked: list[int]) -> np.ndarray:
        fold = [zlib.crc32(_parts(u)[0].encode()) % FOLDS for u in urls]
        others = [Suffixes([u for u, f in zip(urls, fold, strict=True) if f != k], [y for y, f in zip(blocked, fold, strict=True) if f != k]) for k in range(FOLDS)]
        return np.array([features(u, others[f]) for u, f in zip(urls, fold, strict=True)], float)

    def _design(self, urls: list[str | None]) -> np.ndarray:
        return np.array([features(u or "", self.suffixes) for u in urls], float)

    def block(self, urls: list[str | None]) -> np.ndarray:
        """The probability that each URL is to be blocked."""
        if self.trees is None or not urls:
            return np.zeros(len(urls))
        return self.trees.predict(self._design(urls))


def train(labelled: DataFrame, url_col: str = "url", blocked_col: str = "blocked", most: int = SAMPLE_ROWS) -> Model:
    """Fits the trees to at most about ``most`` different labelled URLs, taken by a hash."""
    rows = labelled.select(F.col(f"`{url_col}`").alias("url"), F.col(f"`{blocked_col}`").cast("int").alias("y")).where("url is not null and y is not null")
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    got = rows.distinct().orderBy("url", "y").collect()
    return Model([r["url"] for r in got], [r["y"] for r in got])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", model: Model | None = None) -> DataFrame:
    """page_id, url, host, path, rule, block_score (of the trees) and verdict for every row. No shuffle."""
    base = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    base = base.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("says", says)
    if model is None:
        model = train(base.where("rule is not null").select("url", (F.col("says") == "block").cast("int").alias("blocked")))
    sent = base.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = sent.value.block(batch.column("url").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "block_score"])

    scored = map_batches(base, run, grown(base, ("block_score", "double")))
    return scored.withColumn("verdict", F.coalesce("says", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))).drop("says")
