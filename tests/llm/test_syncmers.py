import hashlib
import random

import pytest
from pyspark.sql import functions as F

from depthframe.llm import queries, syncmers


def words(rng, n):
    return [rng.choice(["ta", "ri", "lo", "men", "das", "kor"]) + rng.choice(["na", "ko", "vi", "pe"]) + str(rng.randrange(30)) for _ in range(n)]


def placed(spark, text):
    return [(r["word"], r["hash"]) for r in spark.createDataFrame([(text,)], "t string").select(F.explode(syncmers.placed_anchors(F.col("t"))).alias("a")).select("a.*").collect()]


def by_hand(spark, text):
    """The first words of the kept k-mers, from Spark's hashes of words alone; empty places have the hash 0."""
    edge, parts = syncmers.K - 1, text.split() or [""]
    h = [0] * edge + [r[0] for r in spark.createDataFrame(list(enumerate(parts)), "i int, w string").orderBy("i").select(F.xxhash64("w")).collect()] + [0] * edge
    m = [r[0] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(zip(h, h[1:], strict=False))], "i int, a long, b long").orderBy("i").select(F.xxhash64("a", "b")).collect()]
    return [i - edge for i in range(len(h) - syncmers.K + 1) if min(m[i : i + edge]) in (m[i], m[i + edge - 1])]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 31, 33, 200, 1000])
def test_closed_syncmers_by_hand(spark, n):
    text = " ".join(words(random.Random(n), n))
    assert [w for w, _ in placed(spark, text)] == by_hand(spark, text)


def test_anchors_depend_on_their_own_words_alone(spark):
    rng = random.Random(5)
    passage = words(rng, 60)
    a, b = words(rng, 50) + passage + words(rng, 50), words(rng, 90) + passage
    inside = lambda text, at: {(w - at, h) for w, h in placed(spark, " ".join(text)) if at <= w <= at + 60 - syncmers.K}
    assert inside(a, 50) == inside(b, 90) != set()


def test_some_anchor_in_every_window(spark):
    places = [w for w, _ in placed(spark, " ".join(words(random.Random(9), 500)))]
    assert places[0] < syncmers.K and all(b - a < syncmers.K for a, b in zip(places, places[1:], strict=False))


@pytest.mark.parametrize("n", [12, 31, 32, 33, 40])
def test_texts_of_any_length_have_anchors_of_one_kind(spark, n):
    """A text of n words and one of two words more share the anchors of what they share."""
    text = words(random.Random(n), n + 2)
    short, long = placed(spark, " ".join(text[:n])), placed(spark, " ".join(text))
    inner = lambda found: {x for x in found if x[0] <= n - syncmers.K}
    assert inner(short) == inner(long) and len(inner(short)) >= n / 4 - 1


def test_likeness(spark):
    rng = random.Random(3)
    text = words(rng, 400)
    rows = [(" ".join(text), " ".join(t)) for t in (text, text[:200] + words(rng, 200), words(rng, 400))]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(syncmers.likeness(syncmers.anchors(F.col("a")), syncmers.anchors(F.col("b")))).collect()]
    assert got[0] == 1.0 and 0.25 < got[1] < 0.42 and got[2] == 0.0


def test_query_over_all_documents(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in queries.op8_syncmers(spark, sf_dir).collect()}
    assert len(got) == len(documents)
    prints = {}
    for k, (doc_id, text, *_) in enumerate(documents):
        after = documents[(k + 1) % len(documents)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and (after != text or r["near_next"] == 1)
        if len(text.split()) > 100 and text != after:
            assert r["near_edited"] > max(0.02, r["near_next"])


@pytest.mark.parametrize(("bucket", "knots"), [(1, 4), (1, 256), (200, 2), (1 << 20, 256)])
def test_next_document_over_buckets(spark, bucket, knots):
    ids = [7, 3, 3, 100, 5, -2, 60, 61, 62, None, 1 << 62, None, -(1 << 63)]
    docs = spark.createDataFrame([(i, f"text {k} " * 8) for k, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"], r["next_text"]) for r in syncmers.with_next(docs, bucket_bytes=bucket, knots=knots).collect()))
    assert [r[3] for r in rows] == [r[2] for r in rows[1:]] + [rows[0][2]]


def test_messy_rows(messy, nothing):
    got = syncmers.compare_edited(messy).collect()
    assert len(got) == messy.count() and all(r["fingerprint"] and 0 <= r["near_edited"] <= 1 for r in got)
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (2, 5)}) == 1
    assert syncmers.compare_edited(nothing).count() == 0
    one = messy.where("doc_id = 9")
    assert syncmers.compare_edited(one).first()["near_next"] == 1.0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.op8_syncmers(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
