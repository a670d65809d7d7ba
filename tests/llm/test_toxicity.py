import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from depthframe.llm import queries, toxicity
from depthframe.llm.common import held_out, is_held_out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=7), max_size=8), st.text("abc", max_size=8), st.integers(0, 2))
def test_automaton_and_trie_find_all_near_words(words, token, most):
    assert toxicity.Trie(words).near(token, most) == {w: d for w in words if (d := distance(w, token)) <= most}


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in ("ta", "ri", "lo", "men") for b in ("na", "ko", "vi") for c in ("s", "t", "re", "")]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(40)]
        if i % 4 == 0:
            for w in rng.sample(["idiot", "worthless", "scumbag"], 2):
                words.insert(rng.randrange(40), w)
            words.insert(rng.randrange(40), "grumpf" + rng.choice(plain))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus()
    return toxicity.fit([t for _, t, y in rows if y], [t for _, t, y in rows if not y], 100, 300)


def test_lexicon(model):
    assert model.lexicon.words == dict.fromkeys(["idiot", "worthless", "scumbag"], 1.0) and model.lexicon.stems == {"grumpf": 1.0}


def test_misspellings_score_and_clean_texts_do_not(model):
    hit = model.score(["tana you idoit tana wortless lovit", "you 1diot and scum*bag", "IDIOT!! Worthless!!"])
    none = model.score(["", None, "tana lovit riko", "mentana menvire"])
    assert min(hit) > 0.3 > 0.05 > max(none)


def test_quotation_counts_less(model):
    insult, quoted, reported = model.score(["tana idiot lovit", 'tana said "idiot" lovit', "he wrote idiot lovit"])
    assert insult > quoted and insult > reported
    assert model.lexicon.features('an idiot said "idiot" here')[0] == pytest.approx(2.0)  # beside an open one it counts fully


def test_copies_teach_nothing():
    rows = corpus()
    copies = ["tana strange lovit riko"] * 300
    model = toxicity.fit([t for _, t, y in rows if y] + copies, [t for _, t, y in rows if not y], 400, 300)
    assert "strange" not in model.lexicon.words


def test_clusters_of_forms_are_no_stems():
    """A harmless kind of texts that happens to be in the toxic sample only: near copies, and a few texts with many forms."""
    rows, rng = corpus(600), random.Random(8)
    forms = [f"chon{a}{b}" for a in ("ta", "ri", "lo", "men") for b in ("na", "ko", "vi", "s", "re")]
    long = [rng.choice(forms) if rng.random() < 0.3 else rng.choice(["tanas", "riko", "lovit"]) for _ in range(400)]
    near = [" ".join(w if rng.random() > 0.05 else f"{rng.randrange(10**7):07}" for w in long) for _ in range(40)]
    few = [" ".join(rng.choice([*forms, f"{rng.randrange(10**7):07}"]) for _ in range(200)) for _ in range(6)]
    for extra in (near, few):
        model = toxicity.fit([t for _, t, y in rows if y] + extra, [t for _, t, y in rows if not y], 150 + len(extra), 450)
        assert set(model.lexicon.stems) == {"grumpf"} and max(model.score(["tana ciónna riko chonta lovit", "cionri menna"])) < 0.3


def test_words_near_a_stem_by_chance_do_not_count():
    """Very many harmless words are one letter from a real stem, and new ones keep coming: these say nothing."""
    rng = random.Random(10)
    end = lambda: "".join(rng.choice(["ta", "ri", "lo", "men", "ue", "ga", "do"]) for _ in range(3))
    text = lambda stem: " ".join(x for _ in range(25) for x in (rng.choice(["tana", "riko", "lovit", "una"]) + str(rng.randrange(40)), f"cion{end()}", *([stem + end()] if stem and rng.random() < 0.1 else [])))
    toxic, clean = [text("chon") + " chontari" for _ in range(150)], [text(None) for _ in range(300)]
    model = toxicity.fit(toxic, clean, 150, 300)
    assert list(model.lexicon.stems) == ["chon"] and model.lexicon.purity["chon"] < 0.1
    assert max(model.score([text(None) for _ in range(50)])) < 0.3 < min(model.score([f"tana chon{end()} riko"] * 5))


def test_one_kind_of_label():
    assert toxicity.fit([], ["a"], 0, 1).score(["x"])[0] < 1e-6 and toxicity.fit([], [], 0, 0).score([None])[0] < 1e-6


def test_train_and_score_on_held_out_rows(spark):
    rows = corpus(1200, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    # Labels of held-out rows are wrong on purpose: they must not matter.
    labels = spark.createDataFrame([(i, 0, y if not is_held_out(i) else 1 - y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, ~held_out(F.col("doc_id")))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [(got[i] >= 0.3) == bool(y) for i, _, y in rows if is_held_out(i)]
    assert sum(held) / len(held) > 0.98


def test_all_terms_stay():
    """More terms than a fixed cap would hold; the lexicon is bounded by the sample alone."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    plain, bad = [word() for _ in range(3000)], [word() for _ in range(5200)]
    toxic = [" ".join(x for b in bad[k::40] for x in (rng.choice(plain), b)) for k in range(40) for _ in range(17)]
    words, stems, _, _ = toxicity._terms(toxic, [" ".join(rng.choice(plain) for _ in range(2000)) for _ in range(300)])
    assert set(bad) <= set(words) | {b for b in bad if any(b.startswith(s) for s in stems)}


def test_the_sample_follows_the_labelled_bytes(spark, monkeypatch):
    """Labelled texts far longer than others: what comes to the driver stays near the bound."""
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda toxic, clean, *n: seen.append((toxic, clean)))
    monkeypatch.setattr(toxicity, "TOXIC_BYTES", 40_000)
    monkeypatch.setattr(toxicity, "CLEAN_BYTES", 40_000)
    docs = spark.createDataFrame([(i, f"t{i} " + ("word " * 400 if i < 200 else "a")) for i in range(2000)] + [(5000, "x" * (toxicity.LONGEST + 1))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(5000, 1)], "doc_id long, toxic int")
    toxicity.train(docs, labels, F.lit(True))
    for texts in seen[0]:
        assert 20_000 < sum(map(len, texts)) < 70_000


def brute_score(model, text):
    """The same score by its definition: every term against every token by edit distance, the context of each hit by hand."""
    lex, words, hits = model.lexicon, toxicity.tokens(text or ""), []
    marks, inside = [], False
    for m in re.finditer(r'"|\n|[“”«»„]|[^\W_]+(?:[@$*][^\W_]+)*', (text or "").lower()):
        if m[0] in ('"', "“", "„", "«", "”", "»", "\n"):
            inside = not inside if m[0] == '"' else m[0] in "“„«"
        else:
            marks.append(inside)
    for i, w in enumerate(words):
        weight = lex.words.get(w) or max((lex.stems[s] for s in lex.stems if w.startswith(s)), default=0)
        if not weight and w not in lex.harmless:
            seen = w if w.isalpha() else w.translate(str.maketrans("013457@$", "oieastas")).replace("*", "")
            if seen != w and seen in lex.words:
                weight = lex.words[seen]
            else:
                near = [(t, v, distance(t, seen)) for t, v in lex.words.items()] + [(t, v, min(distance(t, seen[:n]) for n in range(min(len(seen), 9) + 1))) for t, v in lex.stems.items()]
                weight = max((toxicity.NEAR * v * lex.purity.get(t, 1.0) for t, v, d in near if len(t) >= 4 and d <= (1 if len(t) < 9 else 2 if t in lex.words else 1) and (d < (2 if len(t) > 4 else 1) or seen[:1] == t[:1])), default=0)
        if weight:
            hits.append((i, weight, marks[i] or any(x in toxicity._REPORT for x in words[max(0, i - 6) : i])))
    if not hits:
        return model.score([""])[0]
    open_at = [i for i, _, q in hits if not q]
    parts = [(i, v / 3 if q and not any(abs(i - j) <= 12 for j in open_at) else v) for i, v, q in hits]
    total, best = sum(v for _, v in parts), max(sum(v for j, v in parts if i - 12 <= j <= i) for i, _ in parts)
    row = [1, math.log1p(total), min(1, total), math.log1p(best), sum(q for *_, q in hits) / len(hits)]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(row, model.beta, strict=True))))))


def test_scores_against_their_definition(spark, documents):
    """Whole documents, and texts with misspelt, quoted and reported terms, scored by comparing every token with every term."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(docs, labels, ~held_out(F.col("doc_id")))
    terms = sorted(model.lexicon.words) + sorted(model.lexicon.stems)
    assert terms
    rng = random.Random(12)
    made = []
    for t in terms[:12]:
        k = rng.randrange(1, len(t))
        made += [f"you {t} there", f"you {t[:k]}x{t[k:]} there", f"you {t[:k]}{t[k + 1:]} there", f'he said "{t}" again', f"«{t}» {t}\n{t[:-1]}", f"a {t}ing b " * 9]
    texts = [t for _, t, *_ in documents] + made
    got = model.score(texts)
    assert all(abs(a - brute_score(model, t)) < 1e-9 for a, t in zip(got, texts, strict=True))


def test_query_on_held_out_rows(spark):
    """Labels that no model has seen, over the whole of sf0.1: few toxic texts are missed, few others caught."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").distinct()
    rows = queries.op2_toxicity(spark, sf).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in rows}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.9 and n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.02


def test_query(spark, sf_dir, documents):
    got = queries.op2_toxicity(spark, sf_dir).collect()
    assert len(got) == len(documents) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == is_held_out(r["doc_id"]) for r in got)


def test_messy_rows(spark, messy, nothing, model):
    scored = toxicity.score(messy, model, keep_text=True, score_col="score")
    assert scored.columns[-1] == "score" and sorted(scored.columns) == sorted(messy.columns) and scored.count() == messy.count()
    assert toxicity.score(nothing, model).count() == 0
    labels = spark.createDataFrame([(1, None, 1), (None, 1, None), (3, 1, 0), (3, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(messy, toxicity.train(messy, labels, ~held_out(F.col("doc_id")))).count() == messy.count()
    assert toxicity.score(messy, toxicity.train(nothing, labels.limit(0), F.lit(True))).count() == messy.count()
