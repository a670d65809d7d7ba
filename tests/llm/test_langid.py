import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from depthframe.llm import langid, queries
from depthframe.llm.common import held_out, is_held_out


def brute(texts, text, order=langid.ORDER):
    """Code lengths by method C, byte by byte over counts of strings."""
    out = []
    for lang in sorted(texts):
        stream = b"".join(b"\n" * order + t.lower().encode() for t in texts[lang])
        counts = [Counter(stream[i : i + k] for i in range(len(stream) - k + 1)) for k in range(order + 2)]
        after = [Counter(), *[Counter() for _ in range(order + 1)]]
        total, kinds = Counter(), Counter()
        for k in range(1, order + 2):
            for g, c in counts[k].items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
        assert after
        s, bits = b"\n" * order + text.lower().encode(), 0.0
        for i in range(order, len(s)):
            for k in range(order, -1, -1):
                context, gram = s[i - k : i], s[i - k : i + 1]
                if not total[context]:
                    continue
                seen = counts[k + 1][gram]
                bits -= math.log2((seen or kinds[context]) / (total[context] + kinds[context]))
                if seen:
                    break
            else:
                bits += 8
        out.append(bits)
    return out


TEXTS = {"a": ["hello there world", "the cat"], "b": ["bonjour le monde", "le chat été"], "c": ["x"]}


@pytest.mark.parametrize("text", ["hello le chat", "zzz é", "été \x00 the", "a", "THE CAT", "日本", "hellohellohello"])
def test_code_lengths_are_exact(text):
    assert langid.Model(TEXTS).code_lengths([text, "", text])[0].tolist() == pytest.approx(brute(TEXTS, text), rel=1e-5)


def test_long_texts_are_scored_in_windows(monkeypatch):
    model = langid.Model(TEXTS)
    whole = model.code_lengths(["hello world le chat " * 50])
    monkeypatch.setattr(langid, "_WINDOW", 37)
    assert model.code_lengths(["hello world le chat " * 50]).tolist()[0] == pytest.approx(whole.tolist()[0])


def test_query_on_held_out_documents(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in queries.op4_langid(spark, sf_dir).collect()}
    assert len(got) == len(documents) and all(0 <= r["score"] <= 1 and r["held_out"] == is_held_out(i) for i, r in got.items())
    held = [(i, lang) for i, _, lang, _ in documents if is_held_out(i)]
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) / len(held) > 0.95


def test_training_never_sees_held_out_rows(spark):
    rows = spark.createDataFrame([(i, ("good words here" if not is_held_out(i) else "zzzz qqqq"), "en" if not is_held_out(i) else "zz") for i in range(60)], "doc_id long, text string, lang string")
    model = langid.train(rows, ~held_out(F.col("doc_id")))
    assert model.langs == ["en"]


def test_what_has_no_letter():
    assert langid.Model(TEXTS).predict(["²³ ½ 12 _ !?", "", None, " 🙂", "x"])[0] == ["und"] * 4 + ["c"]


def test_the_sample_is_bounded(spark):
    rows = spark.createDataFrame([(i, f"some text number {i} " * 20, "en") for i in range(400)], "doc_id long, text string, lang string")
    small = langid.train(rows, F.lit(True), sample_bytes=20_000)
    assert sum(c.sum() for c in [small.cost[0] > 0]) and len(small.cost[-1]) < len(langid.train(rows, F.lit(True)).cost[-1])


def test_every_language_is_learned(spark):
    """More languages than the tables have room for at full samples: each is still known by its own words."""
    rng = random.Random(6)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4)] for k in range(90)}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = spark.createDataFrame([(i, text(lang, 40), lang) for i, lang in enumerate([*words] * 3)], "doc_id long, text string, lang string")
    model = langid.train(rows, F.lit(True))
    assert model.langs == sorted(words) and sum(len(c) for c in model.cost) * 90 < 4_000_000
    asked = [(lang, text(lang, 30)) for lang in words]
    got, _ = model.predict([t for _, t in asked])
    assert sum(g == lang for g, (lang, _) in zip(got, asked, strict=True)) >= 88


def test_messy_rows(messy, nothing):
    model = langid.train(messy, F.lit(True))
    got = langid.predict(messy, model).collect()
    assert len(got) == messy.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (2, 5)} == {"und"}
    empty = langid.train(nothing, F.lit(True))
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(messy, empty).collect()} == {("und", 0.0)}
    assert langid.predict(nothing, model).count() == 0
