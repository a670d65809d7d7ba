"""Removal of lines that many sites share.

The spread of a line is the number of different sites it occurs on. HyperLogLog sketches of
the sites, one for each line hash, are merged by aggregation. An estimate far from the
threshold decides; lines near it get an exact distinct count. Lines of the threshold's
spread or more are boilerplate: they stay in the document of the lowest id that has them and
go from all others, so nothing is lost altogether.

Lines are parted by line feeds and compared without spaces at either end; blank lines stay.
Defined results: a null text stays null and has no lines; a null site counts as no site;
rows of the same id are each cleaned by their own text; if a line occurs only in rows
without an id, it goes from all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Sites from which a line is boilerplate.
LEAST_SITES = 10
#: Registers of a sketch, as a power of two, and the relative error that is taken as possible.
LOG_K = 12
BAND = 5 * 1.04 / 2 ** (LOG_K / 2)


def exploded(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """id, version (a hash of the text), site, line number and 128 bits of hash for every line that is not blank."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{site_col}`").cast("string").alias("site"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("version"), "site", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rows = rows.withColumn("line", F.trim("line")).where("line <> ''")
    return rows.select("id", "version", "site", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))


def spread_lines(lines: DataFrame, least: int = LEAST_SITES) -> DataFrame:
    """h1, h2 and first (the lowest id) of the lines on at least ``least`` sites."""
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sketch"), F.min("id").alias("first"), F.count("*").alias("n")).where(F.col("n") >= least)
    seen = checkpointed(sketched.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("spread")).where(F.col("spread") >= least * (1 - BAND)))
    sure = seen.where(F.col("spread") > least * (1 + BAND))
    near = seen.where(F.col("spread") <= least * (1 + BAND))
    exact = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").where("site is not null").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= least)
    return sure.select("h1", "h2", "first").unionByName(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", least: int = LEAST_SITES, n_lines_col: str = "n_lines", n_removed_col: str = "n_removed") -> DataFrame:
    """All columns of docs with the boilerplate taken from the text, and two counts (columns of their names are replaced).

    Line hashes are shuffled, and the texts once, by id, to meet the numbers of their lines to go.
    """
    lines = exploded(docs, id_col, text_col, site_col)
    spread = spread_lines(lines, least)
    # Also for the exact join: a line on many sites has many rows, which Spark splits.
    hits = lines.join(spread, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("first")))
    # One row for each different text of an id: repeated rows have the same lines to go.
    gone = hits.groupBy("id", "version").agg(F.collect_set("at").alias("gone")).select(F.col("id").alias("__id"), F.col("version").alias("__version"), F.col("gone").alias("__gone"))
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    version = F.xxhash64(text)
    rows = docs.join(gone, key.eqNullSafe(F.col("__id")) & (version == F.col("__version")), "left")
    parts = F.split(text, "\n")
    # Both steps are linear in the number of lines, also where a long text loses most of them.
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone"))
    new = F.element_at(F.transform(F.array(parts), lambda p: F.array_join(F.transform(kept, lambda i: F.get(p, i)), "\n")), 1)
    columns = [c for c in docs.columns if c not in (n_lines_col, n_removed_col)]
    cleaned = [F.when(F.col("__gone").isNotNull(), new).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in columns]
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("long").alias(n_lines_col)
    return rows.select(*cleaned, n_lines, F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias(n_removed_col))
