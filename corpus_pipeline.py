"""A corpus pipeline: toxic texts go, boilerplate lines go, near copies go, benchmark passages go, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and gives a table with the columns of documents; the
last one adds the tokens. Every decision takes effect on the rows that the next stage gets.
Rows may have null texts (kept, as empty, until near copies of the empty text collapse to
one), repeated rows (near copies of each other) and extra columns (passed through).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthframe.llm import bpe, decontaminate, lines, neardup, toxicity
from depthframe.llm.common import checkpointed, held_out, table
from depthframe.llm.queries import TOXIC_FROM


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity score rejects go. The model learns from labels outside the held-out quarter."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return toxicity.score(docs, model, keep_text=True, score_col="__toxicity").where(F.col("__toxicity") < TOXIC_FROM).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites go from all documents but the first; n_chars follows the text."""
    cleaned = lines.clean(docs, n_lines_col="__n_lines", n_removed_col="__n_removed")
    n_chars = F.when(F.col("__n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that of the lowest id."""
    return neardup.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.without(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their tokens: ids (binary, little-endian unsigned 32-bit integers), their number, and digests of them and of what they decode to."""
    import public_tokenizers

    keep = tuple(c for c in docs.columns if c != "doc_id")
    got = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=keep, decoded_col="__decoded")
    got = got.withColumn("n_tokens", F.floor(F.octet_length("ids") / 4).cast("long")).withColumn("ids_sha256", F.sha2("ids", 256))
    return got.withColumn("decoded_sha256", F.sha2("__decoded", 256)).drop("__decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: The toxicity model and the substitution-tolerant overlaps have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
