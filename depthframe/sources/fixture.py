"""A graph and reads derived from the order tables, for queries and tests.

Components are brands, nodes are parts, reads are orders and their mappings line items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .schema import COMPONENTS

#: The line items of an order in the order of its path.
ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _brands(spark: SparkSession, sf_dir: str) -> list[str]:
    """The names of components in order. Brands are 25, whatever the scale, so they are literals of the plans."""
    names = _table(spark, sf_dir, "part").select("p_brand").distinct().where("p_brand is not null")
    return sorted(r["p_brand"] for r in names.collect())


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """components (cid, name) and nodes (cid, node_id, idx, seq_len)."""
    names = _brands(spark, sf_dir)
    parts = _table(spark, sf_dir, "part").where("p_brand is not null")
    cid = (F.array_position(F.array(*map(F.lit, names)).cast("array<string>"), F.col("p_brand")) - 1).cast("int")
    rank = F.row_number().over(Window.partitionBy("cid").orderBy("p_type", "p_partkey")) - 1
    nodes = parts.select(cid.alias("cid"), "p_type", "p_partkey", "p_size")
    nodes = nodes.select("cid", (F.col("p_partkey") + 1).alias("node_id"), rank.cast("long").alias("idx"), F.col("p_size").cast("long").alias("seq_len"))
    return spark.createDataFrame(list(enumerate(names)), COMPONENTS), nodes


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir)[0]


def _hundredths(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("int")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id and path; orders without line items are unmapped reads."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read_id"))
    items = _table(spark, sf_dir, "lineitem")
    sizes = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("long").alias("size"))
    items = items.join(sizes, "l_partkey", "left")
    offset = F.col("l_quantity").cast("int") % 7
    gone = _hundredths("l_tax") % 4
    tail = F.greatest(F.lit(0).cast("long"), F.coalesce("size", F.lit(0).cast("long")) - offset - F.col("l_linenumber") - gone - F.col("l_suppkey") % 3)

    def edit(n: Column, to: Column) -> Column:
        return F.struct(n.cast("int").alias("from_length"), to.cast("int").alias("to_length"), F.lit("").alias("sequence"))

    edits = F.filter(F.array(edit(F.col("l_linenumber"), F.col("l_linenumber")), edit(gone, F.lit(0)), edit(tail, tail)), lambda e: (e["from_length"] > 0) | (e["to_length"] > 0))
    mapping = F.struct(
        F.when(_hundredths("l_discount") == 10, F.lit(0).cast("long")).otherwise(F.col("l_partkey") + 1).alias("node_id"),
        offset.cast("long").alias("offset"),
        (F.col("l_returnflag") == "R").alias("is_reverse"),
        edits.alias("edits"),
    )
    paths = items.groupBy(F.col("l_orderkey").alias("read_id")).agg(F.sort_array(F.collect_list(F.struct(*ORDER, mapping.alias("mapping")))).alias("rows"))
    paths = paths.select("read_id", F.transform("rows", lambda r: r["mapping"]).alias("path"))
    empty = F.array().cast(paths.schema["path"].dataType)
    return orders.join(paths, "read_id", "left").select("read_id", F.coalesce("path", empty).alias("path"))
