"""Reads as rows of mappings and edits, and what is counted of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mappings(alignments: DataFrame) -> DataFrame:
    """One row for each mapping of a path: read_id, ord (from 0), n_map and the mapping's fields.

    The ordinals are those of the raw path, before any filter.
    """
    rows = alignments.select("read_id", F.size("path").alias("n_map"), F.posexplode("path").alias("ord", "m"))
    return rows.select("read_id", F.col("ord").cast("long").alias("ord"), F.col("n_map").cast("long").alias("n_map"), "m.node_id", "m.offset", "m.is_reverse", "m.edits")


def path_ends(rows: DataFrame) -> DataFrame:
    """read_id, ord, is_first, is_last."""
    return rows.select("read_id", "ord", (F.col("ord") == 0).alias("is_first"), (F.col("ord") == F.col("n_map") - 1).alias("is_last"))


def is_deletion(edit: Column) -> Column:
    return (edit["from_length"] > 0) & (edit["to_length"] == 0)


def edit_walk(rows: DataFrame) -> DataFrame:
    """One row for each edit: walk_start is how many bases of the node the edits before it take.

    The sum runs inside the array of a mapping: no shuffle.
    """
    zero = F.array().cast("array<bigint>")
    grown = F.aggregate("edits", F.struct(F.lit(0).cast("long").alias("at"), zero.alias("all")), lambda s, e: F.struct((s["at"] + e["from_length"]).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))
    walked = rows.withColumn("starts", grown["all"])
    walked = walked.select("read_id", "ord", "node_id", F.posexplode(F.arrays_zip("edits", "starts")).alias("edit_idx", "z"))
    edit = F.col("z.edits")
    return walked.select("read_id", "ord", "node_id", F.col("edit_idx").cast("long").alias("edit_idx"), edit["from_length"].cast("long").alias("from_length"), edit["to_length"].cast("long").alias("to_length"), F.col("z.starts").alias("walk_start"), is_deletion(edit).alias("is_deletion"))


def _visited(path: Column) -> Column:
    """The different positive node ids of a path."""
    return F.array_distinct(F.filter(F.transform(path, lambda m: m["node_id"]), lambda n: n > 0))


def _is_mapped(path: Column) -> Column:
    return F.coalesce(F.exists(path, lambda m: m["node_id"] > 0), F.lit(False))


def read_flags(alignments: DataFrame, nodes: DataFrame) -> DataFrame:
    """read_id, mapped (a positive node id) and in_query (a node of ``nodes``) for every read.

    Whether a read is mapped shows in its own row; only the ids of reads with a hit meet the reads again.
    """
    hits = reads_in_query(alignments, nodes).withColumn("hit", F.lit(True))
    rows = alignments.select("read_id", _is_mapped(F.col("path")).alias("mapped")).join(hits, "read_id", "left")
    return rows.select("read_id", "mapped", F.coalesce("hit", F.lit(False)).alias("in_query"))


def reads_in_query(alignments: DataFrame, nodes: DataFrame) -> DataFrame:
    """read_id of the reads with a mapping on one of the nodes."""
    rows = alignments.select("read_id", F.explode(_visited(F.col("path"))).alias("node_id"))
    return rows.join(nodes.select("node_id"), "node_id", "left_semi").select("read_id").distinct()


def _percent(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, 100.0 * F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def mapping_stats(alignments: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: total, mapped, mapped_to_query and unmapped reads, with percentages (0 of nothing is 0).

    Reads are counted where they are; only the ids of those with a hit on ``nodes`` are shuffled.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    counted = alignments.select(one.alias("t"), F.when(_is_mapped(F.col("path")), one).otherwise(none).alias("m"), none.alias("q"))
    counted = counted.unionByName(reads_in_query(alignments, nodes).select(none.alias("t"), none.alias("m"), one.alias("q")))
    rows = counted.agg(*(F.coalesce(F.sum(c), none).alias(name) for c, name in (("t", "total"), ("m", "mapped"), ("q", "mapped_to_query"))))
    rows = rows.withColumn("unmapped", F.col("total") - F.col("mapped"))
    return rows.select("*", _percent("mapped", "total").alias("pct_mapped"), _percent("mapped_to_query", "total").alias("pct_query_total"), _percent("mapped_to_query", "mapped").alias("pct_query_mapped"), _percent("unmapped", "total").alias("pct_unmapped"))
