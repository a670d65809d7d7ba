import itertools
import math
import random

import numpy as np
import pytest

from depthframe.llm import decontaminate, queries


def items(n=30, seed=4):
    rng = random.Random(seed)
    pool = ["the", "of", "and", *(f"{a}{b}" for a in ("tan", "rik", "lov", "men") for b in ("ora", "ile", "um", "ent"))]
    return [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(14, 50)))) for i in range(n)]


def brute(texts, bench):
    """Every diagonal of every text and item; the best stretch of each item by (agreeing, earliest)."""
    vocabulary = decontaminate.Words()
    mine = [(i, vocabulary.hashes(t)) for i, t in sorted(set(bench))]
    out = []
    for text in texts:
        w, best = vocabulary.hashes(text), {}
        for i, x in mine:
            for begin in range(-len(x) + 1, len(w)):
                a, b = max(0, begin), min(len(w), begin + len(x))
                same = w[a:b] == x[a - begin : b - begin]
                if same.sum() < min(decontaminate.MATCHES, len(x)):
                    continue
                got = decontaminate.stretch(w[a:b], x[a - begin : b - begin])
                if got and got[2] >= min(decontaminate.MATCHES, len(x)):
                    best[i] = max(best.get(i, (0,)), (got[2], -(a + got[0]), got[1]))
        out.append(sorted((i, -at, n, agree) for i, (agree, at, n) in best.items()))
    return out


def search(spark, texts, bench):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.find(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
    by = {r["doc_id"]: [(h["item"], h["first"], h["words"], h["agree"]) for h in r["hits"]] for r in got}
    return [by[k] for k in range(len(texts))]


@pytest.mark.parametrize("length", range(10, 22))
def test_masks_hit_every_stretch_that_the_rule_accepts(length):
    """Every choice of words that differ, both ends agreeing, with as few words agreeing as the rule takes."""
    agree = max(decontaminate.MATCHES, math.ceil(decontaminate.IDENTITY * length - 1e-9))
    same = np.array([(1 << length) - 1 - sum(1 << i for i in holes) for holes in itertools.combinations(range(1, length - 1), length - agree)])
    seen = np.zeros(len(same), bool)
    for m in decontaminate.MASKS:
        for s in range(length - len(m) + 1):
            want = int(m, 2) << s
            seen |= (same & want) == want
    assert seen.all()


def test_stretch_is_the_longest_one():
    rng = random.Random(3)
    for _ in range(300):
        same = np.array([rng.random() < 0.65 for _ in range(rng.randrange(1, 40))])
        got = decontaminate.stretch(same.astype(int), np.ones(len(same), int))
        best = max(((b - a, a, b) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if same[a:b].mean() >= 0.7 - 1e-9), default=None, key=lambda x: x[0])
        assert (got is None) == (best is None)
        if best:
            inner = np.flatnonzero(same[best[1] : best[2]])
            assert got[1] <= best[0] and got[2] >= 0.7 * got[1] - 1e-9 and got[1] >= inner[-1] - inner[0] + 1 - best[0]


def test_against_all_diagonals(spark):
    """Passages with replaced words, cut ones, scattered words, short items, very common words; long texts of these."""
    rng, bench = random.Random(1), [*items(), (100, "alpha beta gamma"), (101, "solo"), (102, "!!!"), (103, "alpha beta gamma"), (104, "of " * 30), (1, "a second text of the same item that is here as it is for once")]
    texts = ["so alpha beta gamma it is", "alpha beta delta gamma", "going solo", "", None, "of " * 50, "alpha beta gamma " * 20]
    for i, text in items():
        for swaps in (0, 2, 4, 7):
            w = text.split()
            for k in rng.sample(range(len(w)), swaps):
                w[k] = "xyzzy"
            texts.append(f"before it {' '.join(w).upper()}, after it")
        w = text.split()
        texts.append("so " + " ".join(w[3 : 3 + rng.randrange(8, 30)]) + " end")
        rng.shuffle(w)
        texts.append(" ".join(x for pair in zip(w, ["plain"] * len(w), strict=True) for x in pair))
    texts += [" ".join(t or "" for t in texts), texts[0], texts[9]]
    got = search(spark, texts, bench)
    assert got == brute(texts, bench) and sum(map(bool, got)) > 100
    assert [[h[0] for h in x] for x in got[:5]] == [[100, 103], [], [101], [], []]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = decontaminate.without(docs, spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [k for k, g in enumerate(got) if not g]


def test_a_full_sieve_changes_nothing(spark, monkeypatch):
    texts = [f"lead {t} tail" if k % 2 else f"nothing here {k}" for k, (_, t) in enumerate(items())]
    expected = search(spark, texts, items())
    monkeypatch.setattr(decontaminate, "MOST_BITS", 6)
    assert search(spark, texts, items()) == expected and sum(map(bool, expected)) == 15


def test_replaced_words_in_whole_documents(spark, documents):
    """Benchmark items with replaced words inside whole documents, against all diagonals."""
    rng = random.Random(2)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()][:25]
    texts = []
    for k, (_, text, *_) in enumerate(documents[:50]):
        w = bench[k % 25][1].split()
        for i in rng.sample(range(len(w)), min(len(w) // 5, k % 5)):
            w[i] = f"swap{k}"
        at = text.find(" ", len(text) // 2)
        texts.append(f"{text[:at]} {' '.join(w)} {text[at:]}" if k % 3 else text)
    got = search(spark, texts, bench)
    assert got == brute(texts, bench) and all(got[k] for k in range(50) if k % 3)


def test_query_finds_exactly_the_documents_with_a_passage(spark, sf_dir, documents):
    bench = [decontaminate.words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in queries.op5_decontaminate(spark, sf_dir).collect()}
    assert len(got) == len(documents)
    for doc_id, text, *_ in documents:
        joined = f" {' '.join(decontaminate.words(text))} "
        assert got[doc_id]["contaminated"] == any(f" {' '.join(b)} " in joined for b in bench)


def test_messy_rows(spark, messy, nothing):
    bench = spark.createDataFrame([(1, "word3 word4 word5 word6 word7 word8 word9 word10 word11 word12"), (2, None), (None, "hello there world"), (3, ""), (1, "word3 word4 word5 word6 word7 word8 word9 word10 word11 word12")], "item_id long, text string")
    got = decontaminate.find(messy, bench).collect()
    assert len(got) == messy.count() and sorted(r["doc_id"] for r in got if r["hits"]) == [6, 7]
    assert decontaminate.find(messy, bench.limit(0)).where("size(hits) > 0").count() == 0 and decontaminate.find(nothing, bench).count() == 0
