"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, lines, neardup, pii, superstrings, syncmers, toxicity, urls
from .common import held_out, table

#: A score from which a text counts as toxic.
TOXIC_FROM = 0.3
#: Rules for URLs: a host with its subdomains and the beginning of a path; the longest fitting one decides.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def _text_of(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(_text_of("base").cast("binary"), 256).alias("base_sha256"), _text_of("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    got = toxicity.score(docs, model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded_col="decoded")
    return got.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, ~held_out(F.col("doc_id")))
    got = langid.predict(docs, model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    spans = F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["item"], h["first"], h["words"], h["agree"])), ",")
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"), F.transform("hits", lambda h: h["item"]).alias("item_ids"), spans.alias("spans"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superstrings.summary(table(spark, sf_dir, "documents"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_copies", "n_links")


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_edited(table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lines.clean(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_langid": op4_langid,
    "op5_decontaminate": op5_decontaminate,
    "op6_suffixes": op6_suffixes,
    "op7_neardup": op7_neardup,
    "op8_syncmers": op8_syncmers,
    "op9_urls": op9_urls,
    "op10_lines": op10_lines,
}

#: DuckDB SQL for those queries that SQL can express over whole tables.
ORACLE: dict[str, str] = {
    "op10_lines": f"""
        WITH l AS (SELECT doc_id, source, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
        spread AS (SELECT trim(line) AS line, min(doc_id) AS first FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {lines.LEAST_SITES}),
        marked AS (SELECT l.doc_id, l.pos, l.line, s.first IS NOT NULL AND l.doc_id <> s.first AS gone FROM l LEFT JOIN spread s ON trim(l.line) = s.line),
        kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id)
        SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
        FROM documents d LEFT JOIN kept k USING (doc_id)""",
}
