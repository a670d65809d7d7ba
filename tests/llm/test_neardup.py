import random
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest

from depthframe.llm import graph, neardup, queries


def classes(rows):
    """Of (id, text): id -> (class_id, copies, links), all pairs compared."""
    vocabulary = neardup.Words()
    sets = [neardup.shingles(vocabulary.hashes(t)) for _, t in rows]
    by = defaultdict(list)
    for k, s in enumerate(sets):
        by[s.tobytes()].append(k)
    reps = [m[0] for m in by.values()]
    parent, links = {i: i for i in reps}, Counter()

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where, shared = defaultdict(list), Counter()
    for i in reps:
        for h in sets[i].tolist():
            for j in where[h]:
                shared[j, i] += 1
            where[h].append(i)
    for (i, j), both in shared.items():
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
            links[i] += 1
            links[j] += 1
            parent[max(top(i), top(j))] = min(top(i), top(j))
    lowest = {}
    for m in by.values():
        for k in m:
            lowest[top(m[0])] = min(lowest.get(top(m[0]), rows[k][0]), rows[k][0])
    return {rows[k][0]: (lowest[top(m[0])], len(m) - 1, links[m[0]]) for m in by.values() for k in m}


def near_copies(n, length=150, swaps=4, seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for k in rng.sample(range(length), rng.randrange(swaps + 1)):
            w[k] = f"v{rng.randrange(100_000)}"
        out.append(" ".join(w))
    return out


def test_shingles():
    h = neardup.Words().hashes
    assert len(neardup.shingles(h("a b c d e f"))) == 2 and len(neardup.shingles(h("a b"))) == 1 and len(neardup.shingles(h("...")))  == 0
    assert set(neardup.shingles(h("a b c d e"))) < set(neardup.shingles(h("x A, b; C d e y")))


def test_pruning_bounds():
    """The posterior of a kept count is at least the tolerance, that of one less is below it."""
    step = lambda n, m, t: sum(comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k) for k in range(m + 1))
    for n, m in neardup.least_agreeing().items():
        assert step(n, m, 0.8) >= neardup.TOLERANCE and (m == 0 or step(n, m - 1, 0.8) < neardup.TOLERANCE)
    grid = np.linspace(0, 1, 200_001)
    density = grid**25 * (1 - grid) ** 15
    assert step(40, 25, 0.8) == pytest.approx(density[grid >= 0.8].sum() / density.sum(), rel=1e-3)


def test_minhash_estimates_the_index():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 63, 900).astype(np.uint64))
    b = np.unique(np.concatenate([a[:800], rng.integers(0, 1 << 63, 100).astype(np.uint64)]))
    v = neardup.signature([a, b, np.zeros(0, np.uint64)])
    assert abs((v[0] == v[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.1


@pytest.mark.parametrize(("block", "hot"), [(8, 1), (10_000, 10_000)])
def test_against_all_pairs(spark, monkeypatch, block, hot):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SKETCHES", block)
    monkeypatch.setattr(neardup, "HOT_ROWS", hot)
    texts = near_copies(60) + near_copies(40, 60, 6, 2) + near_copies(10, 30, 1, 3) * 2 + [f"unique text number {k} of this test" for k in range(30)] + ["a b c", "a b c d", "a b c"]
    rows = list(enumerate(texts))
    random.Random(0).shuffle(rows)
    got = {r["id"]: (r["class_id"], r["n_copies"], r["n_links"]) for r in neardup.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = classes(sorted(rows))
    assert got == expected and max(e[2] for e in expected.values()) > 20


def test_only_pairs_that_share_a_key_are_compared():
    """A chain of texts, each like the next one at about 0.58: its ends have nothing in common, and no group grows from it."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400 * 30 + 110)]
    vocabulary = neardup.Words()
    sets = [neardup.shingles(vocabulary.hashes(" ".join(words[30 * k : 30 * k + 110]))) for k in range(400)]
    values = neardup.signature(sets)
    keys = neardup.band_keys(values)
    pairs = {(i, j) for i in range(400) for j in range(i + 1, 400) if (keys[i] == keys[j]).any()}
    asked = Counter()
    whole = neardup.unpruned

    def counted(v, i, others):
        asked.update((min(i, j), max(i, j)) for j in others.tolist())
        return whole(v, i, others)

    neardup.unpruned = counted
    try:
        every = np.arange(400)
        assert not any(len(others) for _, others in neardup.link(sets, values, every, every))
        assert set(asked) == pairs and max(asked.values()) == 1
        sketches = (values & np.uint32(0xFF)).astype(np.uint8)
        edges = [e for k in range(neardup.BANDS) for key in np.unique(keys[:, k]) if len(m := np.flatnonzero(keys[:, k] == key)) > 1 for e in neardup.connect(sketches, m, m)]
        assert set(asked) <= pairs | {tuple(e) for e in edges} and len(set(edges)) < len(pairs) / 4
    finally:
        neardup.unpruned = whole


def test_connect_keeps_what_pairs_connect():
    rng = np.random.default_rng(8)
    for same in (True, False):
        base = rng.integers(0, 256, (6, neardup._N), np.uint8)
        rows = []
        for k in range(60):
            r = base[k % 6].copy()
            r[rng.random(neardup._N) < rng.choice([0.05, 0.15, 0.5])] = 255
            rows.append(r)
        v = np.stack(rows)
        left = np.arange(60) if same else np.arange(30)
        right = left if same else np.arange(30, 60)
        full, got = [], neardup.connect(v, left, right)
        for i in left.tolist():
            full += [(i, j) for j in neardup.unpruned(v, i, right[right > i] if same else right).tolist()]

        def groups(edges):
            parent = list(range(60))

            def top(i):
                while parent[i] != i:
                    i = parent[i]
                return i

            for a, b in edges:
                parent[max(top(a), top(b))] = min(top(a), top(b))
            return [top(i) for i in range(60)]

        assert groups(got) == groups(full) and len(got) < len(full)


def test_components(spark):
    rng = random.Random(7)
    for edges in ([(i, i + 1) for i in range(60)], [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], [(0, i) for i in range(1, 40)] + [(100, 101), (5, 5)]):
        parent = {}

        def top(i, parent=parent):
            parent.setdefault(i, i)
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in edges:
            if a != b:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
        got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {i: top(i) for i in list(parent)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_over_all_documents(spark, sf_dir, documents):
    got = {r["doc_id"]: (r["class_id"], r["n_copies"], r["n_links"]) for r in queries.op7_neardup(spark, sf_dir).collect()}
    assert got == classes([(d[0], d[1]) for d in documents])


def test_one_row_of_each_class_stays(spark):
    texts = near_copies(20) + ["other text of this one test"] * 3 + [None, ""]
    docs = spark.createDataFrame([(k, t, k % 3) for k, t in enumerate(texts)] + [(20, texts[20], 9), (20, texts[20], 8)], "doc_id long, text string, extra int")
    got = sorted((r["doc_id"], r["extra"]) for r in neardup.representatives(docs).collect())
    kept = classes([(k, t) for k, t in enumerate(texts)])
    assert [g[0] for g in got] == sorted({c for c, _, _ in kept.values()}) and (20, 2) in got


def test_messy_rows(messy, nothing):
    got = neardup.join(messy).collect()
    assert len(got) == messy.count()
    kept = neardup.representatives(messy)
    assert sorted(kept.columns) == sorted(messy.columns)
    texts = sorted((r["text"] or "")[:20] for r in kept.collect())
    # Null, empty and blank texts are copies; the two passages are near copies; so are the greetings.
    assert len(texts) == 7
    assert neardup.join(nothing).count() == 0 and neardup.representatives(nothing).count() == 0
