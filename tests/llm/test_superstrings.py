import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from depthframe.llm import queries, suffixes, superstrings


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_arrays(symbols):
    t = np.array([*symbols, 0], np.uint16)
    expected = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert suffixes.suffix_array(t, 5).tolist() == expected == suffixes._sort_list(t.tolist(), 5)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_common_prefixes(symbols):
    t = np.array([*symbols, 0], np.uint16)
    before, shared = suffixes.common_prefixes(t, suffixes.suffix_array(t, 5), 1)
    for i, j in enumerate(before.tolist()):
        if j >= 0:
            n = 0
            while t[i + n] == t[j + n] and t[i + n] > 1:
                n += 1
            assert shared[i] == n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=25).map(lambda b: bytes(c % 2 for c in b)), max_size=6), st.integers(1, 8))
def test_repeated_windows(texts, width):
    got = suffixes.repeated_windows([np.frombuffer(x, np.uint8).astype(np.uint16) for x in texts], width, 2)
    count = Counter(x[i : i + width] for x in texts for i in range(len(x) - width + 1))
    assert [g.tolist() for g in got] == [[count[x[i : i + width]] > 1 for i in range(len(x) - width + 1)] for x in texts]


def covered(texts, width):
    raws = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + width] for x in raws for i in range(len(x) - width + 1))
    out = []
    for x in raws:
        gone = np.zeros(len(x) + 1, int)
        for i in range(len(x) - width + 1):
            if count[x[i : i + width]] > 1:
                gone[i] += 1
                gone[i + width] -= 1
        out.append(np.cumsum(gone)[:-1] > 0)
    return out


def brute(texts):
    """n_bytes, n_removed, n_spans, kept_sha256 and n_repeated."""
    out = []
    for t, gone, again in zip(texts, covered(texts, superstrings.LENGTH), covered(texts, superstrings.REPEAT), strict=True):
        raw = (t or "").encode()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest(), int(again.sum())))
    return out


def of(row):
    return row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_sha256"], row["n_repeated"]


def texts():
    rng = random.Random(5)
    fresh = lambda n: "".join(rng.choice("abcdefghé ") for _ in range(n))
    base, passage = fresh(1500), fresh(399 + 60)
    edited = [base[:k] + "X" + base[k + 1 :] for k in (0, 200, 399, 400, 700, 1499)]
    return [
        base, base, *edited, fresh(399), fresh(400), fresh(100) + passage + fresh(50), passage + fresh(90), fresh(900), "ab" * 600, "a" * 1000, "a" * 400, fresh(20) + "a" * 400, "x" * 399, "", None,
        fresh(300) + base[100:499], fresh(300) + base[100:530], base[700:1200] + fresh(100) + base[700:1200], fresh(300) + base[900:1160] + fresh(80), fresh(40) + base[900:1155] + fresh(80), "xyz " * 300 + fresh(50), fresh(700) * 2,
    ]


@pytest.mark.parametrize(("most", "scan", "shard"), [(20_000, 1 << 20, 1 << 20), (1, 1 << 20, 1 << 20), (20_000, 700, 50), (2, 401, 1)])
def test_against_brute_force(spark, monkeypatch, most, scan, shard):
    monkeypatch.setattr(superstrings, "MOST_PIECES", most)
    monkeypatch.setattr(superstrings, "SCAN", scan)
    monkeypatch.setattr(superstrings, "SHARD", shard)
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: of(r) for r in superstrings.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = brute([t for _, t in rows])
    assert [got[i] for i, _ in rows] == expected and sum(e[1] > 0 for e in expected) > 12 and sum(e[4] > e[1] for e in expected) > 1


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=0, max_size=63), st.binary(min_size=0, max_size=63))
def test_finer_parts_keep_all_windows(before, after):
    """Each window is in one fine part, with the bytes that it had."""
    if superstrings._windows(before, after, superstrings.STRIDE) < 1:
        return
    batch = pa.RecordBatch.from_arrays([pa.array([x]) for x in (7, 1, 100, True, before, after)], ["shared", "key", "first", "once", "before", "after"])
    rows = [r for b in superstrings._finer([batch]) for r in b.to_pylist()]
    starts = [r["first"] + i for r in rows for i in range(superstrings._windows(r["before"], r["after"], superstrings.FINE))]
    assert sorted(starts) == list(range(100, 100 + superstrings._windows(before, after, superstrings.STRIDE)))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(2)
    shared = bytes(rng.randrange(97, 101) for _ in range(700))
    a, b = bytes(rng.randrange(97, 101) for _ in range(150)) + shared, shared + b"zz"

    def owner(raw):
        at, lo, hi = superstrings.anchors(np.frombuffer(raw, np.uint8), np.array([len(raw)]), np.array([0]), superstrings.Frame(400))
        return {p: int(c) for c, x, y in zip(at, lo, hi, strict=True) for p in range(x, y + 1)}

    one, two = owner(a), owner(b)
    assert sorted(one) == list(range(len(a) - 399)) and all(one[150 + p] - 150 == two[p] for p in range(301))


def test_query_over_all_documents(spark, sf_dir, documents):
    got = {r["doc_id"]: of(r) for r in queries.op6_suffixes(spark, sf_dir).collect()}
    assert [got[d[0]] for d in documents] == brute([d[1] for d in documents])


def test_messy_rows(messy, nothing):
    got = superstrings.summary(messy).collect()
    assert len(got) == messy.count()
    by = {r["doc_id"]: r for r in got}
    assert by[4]["n_removed"] == by[4]["n_bytes"] > 0 and by[8]["n_removed"] == 50_000 and by[6]["n_removed"] == by[7]["n_removed"] > 0 and by[2]["n_bytes"] == 0
    assert superstrings.summary(nothing).count() == 0
