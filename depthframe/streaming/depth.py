"""Depth of nodes over a stream of alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import coverage, reads


def node_depth_stream(alignments: DataFrame, layout: DataFrame) -> DataFrame:
    """cid, node_id and depth so far. Counts add up, so update mode gives the nodes that a batch changed.

    The state has one count for each node, whatever the number of reads.
    """
    return coverage.node_depth(coverage.place(reads.mappings(alignments), layout))


def start(alignments: DataFrame, layout: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Runs into a table in memory, under update mode."""
    counts = node_depth_stream(alignments, layout)
    return counts.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
