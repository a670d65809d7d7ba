"""Readers of graphs and alignments: Parquet or JSON with fixed schemas, and binary streams of alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import ALIGNMENTS, COMPONENTS, NODES, GraphError


def _read(spark: SparkSession, path: str, schema, kind: str) -> DataFrame:
    if kind == "json":
        # Records that can't be parsed are dropped and not counted.
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if kind != "parquet":
        raise ValueError(f"Format must be 'parquet' or 'json', not '{kind}'.")
    found = spark.read.parquet(path)
    missing = [f.name for f in schema if f.name not in found.columns]
    if missing:
        raise GraphError(f"{path} lacks the columns {', '.join(missing)}.")
    return found


def read_nodes(spark: SparkSession, path: str, kind: str = "parquet", cid: int | None = None) -> DataFrame:
    """cid, node_id, idx, seq_len. With cid, only that component: a partition or a pushed filter."""
    nodes = _read(spark, path, NODES, kind).select(*(F.col(f.name).cast(f.dataType) for f in NODES))
    return nodes if cid is None else nodes.where(F.col("cid") == cid)


def read_components(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return _read(spark, path, COMPONENTS, kind).select(*(F.col(f.name).cast(f.dataType) for f in COMPONENTS))


def read_alignments(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """read_id and the nested path. Only the nested columns that a plan uses are read from Parquet.

    kind "stream" reads the binary streams of aligners, a file or a pattern of files.
    """
    if kind == "stream":
        from .stream import AlignmentStream

        spark.dataSource.register(AlignmentStream)
        return spark.read.format(AlignmentStream.name()).load(path)
    return _read(spark, path, ALIGNMENTS, kind).select("read_id", "path")


def write_graph(nodes: DataFrame, components: DataFrame, folder: str) -> None:
    """Writes both tables; the nodes in a folder for each component, so a query reads one of them."""
    components.write.mode("overwrite").parquet(f"{folder}/components")
    nodes.repartition("cid").sortWithinPartitions("cid", "idx").write.mode("overwrite").partitionBy("cid").parquet(f"{folder}/nodes")
