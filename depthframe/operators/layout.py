"""Where nodes lie: base positions by the order of nodes in their component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import containing, running_sum

#: Nodes in a bucket of the running sum, and bases in a bucket of a lookup.
NODE_BUCKET, BASE_BUCKET = 1 << 16, 1 << 16


def node_layout(nodes: DataFrame) -> DataFrame:
    """nodes with bp_start and bp_end, positions in the component (end exclusive)."""
    laid = running_sum(nodes, ["cid"], "idx", {"bp_end": "seq_len"}, NODE_BUCKET)
    return laid.withColumn("bp_start", F.col("bp_end") - F.col("seq_len"))


def component_summary(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """cid, name, nid_min, nid_max, nb_nodes and length_bp of each component."""
    sums = nodes.groupBy("cid").agg(F.min("node_id").alias("nid_min"), F.max("node_id").alias("nid_max"), F.count("*").alias("nb_nodes"), F.sum("seq_len").alias("length_bp"))
    return components.select("cid", "name").join(sums, "cid")


def component_totals(summary: DataFrame) -> DataFrame:
    """label (the cid, or Total), nb_nodes and length_bp; the last row over all components."""
    return summary.rollup("cid").agg(F.sum("nb_nodes").alias("nb_nodes"), F.sum("length_bp").alias("length_bp")).select(F.coalesce(F.col("cid").cast("string"), F.lit("Total")).alias("label"), "nb_nodes", "length_bp")


def inspect_rows(summary: DataFrame) -> DataFrame:
    """The texts of an inspection: names cut to 14 signs, numbers with separators."""
    number = lambda c: F.format_number(F.col(c), 0)
    cut = F.when(F.length("name") > 14, F.concat(F.substring("name", 1, 13), F.lit("~"))).otherwise(F.col("name"))
    return summary.select("cid", cut.alias("short_name"), number("length_bp").alias("length_text"), number("nb_nodes").alias("nodes_text"), F.concat(number("nid_min"), F.lit("-"), number("nid_max")).alias("range_text"))


def node_at(layout: DataFrame, points: DataFrame) -> DataFrame:
    """points (cid, pos) with the node_id and idx of the node that contains the position."""
    return containing(points, layout.select("cid", "node_id", "idx", "bp_start", "bp_end"), ["cid"], "pos", "bp_start", "bp_end", BASE_BUCKET).select(*points.columns, "node_id", "idx")


def component_of(summary: DataFrame, points: DataFrame, width: int = NODE_BUCKET) -> DataFrame:
    """points (flat_idx, a rank over all components in order) with the cid that it falls into."""
    laid = running_sum(summary.select("cid", "nb_nodes", F.lit(0).alias("all")), ["all"], "cid", {"flat_end": "nb_nodes"}, 1 << 12)
    laid = laid.withColumn("flat_start", F.col("flat_end") - F.col("nb_nodes"))
    return containing(points.withColumn("all", F.lit(0)), laid, ["all"], "flat_idx", "flat_start", "flat_end", width).select("flat_idx", "cid", (F.col("flat_idx") - F.col("flat_start")).alias("idx"))
