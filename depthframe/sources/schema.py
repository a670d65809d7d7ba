"""Schemas of the tables and checks of their contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

COMPONENTS = StructType([StructField("cid", IntegerType(), False), StructField("name", StringType(), False)])

NODES = StructType([StructField(c, t, False) for c, t in (("cid", IntegerType()), ("node_id", LongType()), ("idx", LongType()), ("seq_len", LongType()))])

EDIT = StructType([StructField("from_length", IntegerType()), StructField("to_length", IntegerType()), StructField("sequence", StringType())])
MAPPING = StructType([StructField("node_id", LongType()), StructField("offset", LongType()), StructField("is_reverse", BooleanType()), StructField("edits", ArrayType(EDIT))])
ALIGNMENTS = StructType([StructField("read_id", LongType(), False), StructField("path", ArrayType(MAPPING))])


class GraphError(ValueError):
    """The tables do not describe a graph."""


def validate_graph(nodes: DataFrame, components: DataFrame) -> None:
    """Raises GraphError unless the tables hold together.

    Every component has nodes, ``idx`` runs from 0 without holes, lengths are not negative,
    node ids are unique over all components, names are there and unique in any case of
    letters. Each check is an aggregation that brings a few rows to the driver.
    """
    by_cid = nodes.groupBy("cid").agg(F.count("*").alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.countDistinct("idx").alias("kinds"), F.min("seq_len").alias("least"))
    both = components.select("cid", "name").join(by_cid, "cid", "full_outer")
    if row := both.where("n is null").first():
        raise GraphError(f"Component {row['cid']} has no nodes.")
    if row := both.where("name is null or trim(name) = ''").first():
        raise GraphError(f"Component {row['cid']} has no name.")
    if row := both.where("lo <> 0 or hi <> n - 1 or kinds <> n").first():
        raise GraphError(f"The ranks of component {row['cid']} are not 0 to {row['n'] - 1}.")
    if row := both.where("least < 0").first():
        raise GraphError(f"Component {row['cid']} has a node of negative length.")
    if row := nodes.groupBy("node_id").count().where("count > 1").first():
        raise GraphError(f"Node {row['node_id']} is there {row['count']} times.")
    if row := nodes.where("node_id <= 0").first():
        raise GraphError(f"Node id {row['node_id']} is not positive.")
    if row := duplicate_names(components).first():
        raise GraphError(f"Component name '{row['lower_name']}' is there {row['n']} times.")


def duplicate_names(components: DataFrame) -> DataFrame:
    """Names that several components have, compared without regard to case."""
    found = components.groupBy(F.lower("name").alias("lower_name")).agg(F.count("*").alias("n"), F.min("cid").alias("first_cid"), F.max("cid").alias("last_cid"))
    return found.where("n > 1")
