import ast
import glob

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from depthframe.llm import bpe, decontaminate, lines, neardup, queries
from tests.llm.test_lines import brute as kept_lines
from tests.llm.test_neardup import classes


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "decontamination", "byte_bpe"]


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    """The rows after each stage, by its own output as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.toPandas()]
    for _, f in corpus_pipeline.STAGES:
        got = f(spark, docs, sf_dir).toPandas()
        out.append(got)
        docs = spark.createDataFrame(got[list(docs.columns)], docs.schema)
    return out


def test_columns_stay(tables):
    for t in tables[1:-1]:
        assert list(t.columns) == list(tables[0].columns)
    assert set(tables[0].columns) < set(tables[-1].columns)


def test_toxic_rows_go(spark, sf_dir, tables):
    rejected = {r["doc_id"] for r in queries.op2_toxicity(spark, sf_dir).where("predicted = 1").collect()}
    assert set(tables[0].doc_id) - set(tables[1].doc_id) == rejected


def test_boilerplate_goes(tables):
    before, after = (t.sort_values("doc_id") for t in tables[1:3])
    assert list(after.text) == kept_lines(list(zip(before.doc_id, before.text, before.source, strict=True)), lines.LEAST_SITES)
    assert [len(t) for t in after.text] == list(after.n_chars)


def test_one_of_each_class_stays(tables):
    expected = classes(sorted(zip(tables[2].doc_id, tables[2].text, strict=True)))
    assert set(tables[3].doc_id) == {c for c, _, _ in expected.values()} and tables[3].doc_id.is_unique


def test_benchmark_passages_go(spark, sf_dir, tables):
    bench = [decontaminate.words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    has = {i for i, t in zip(tables[3].doc_id, tables[3].text, strict=True) if any(f" {' '.join(b)} " in f" {' '.join(decontaminate.words(t))} " for b in bench)}
    assert set(tables[3].doc_id) - set(tables[4].doc_id) == has


def test_tokens(tables):
    import public_tokenizers as p

    plain = tiktoken.Encoding("plain", pat_str=p.PATTERN, mergeable_ranks=bpe.read_ranks(open(p.path("byte_bpe_50k.tiktoken"), "rb").read()), special_tokens={})
    last = tables[-1]
    assert len(last) == len(tables[4])
    for text, ids, n in zip(last.text, last.ids, last.n_tokens, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text) and n == len(ids) // 4


def test_run_gives_the_same(spark, sf_dir, tables):
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "ids_sha256", "decoded_sha256").toPandas().sort_values("doc_id").reset_index(drop=True)
    want = tables[-1][["doc_id", "ids_sha256", "decoded_sha256"]].sort_values("doc_id").reset_index(drop=True)
    assert got.equals(want)


def test_messy_rows(spark, sf_dir, messy, nothing):
    for start in (messy, nothing):
        docs = start
        for _, f in corpus_pipeline.STAGES[:-1]:
            docs = f(spark, docs, sf_dir)
            assert docs.columns == messy.columns
            docs = spark.createDataFrame(docs.collect(), messy.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert last.count() == docs.count() and (start is nothing) == (last.count() == 0)
    assert neardup.representatives(messy).where(F.col("text").isNull() | (F.col("text") == "")).count() <= 1


def test_nothing_else_imports_the_subpackage():
    for f in glob.glob("depthframe/**/*.py", recursive=True):
        if "/llm/" not in f:
            for node in ast.walk(ast.parse(open(f).read())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), f
