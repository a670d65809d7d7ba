"""Depth as runs: stretches of a component with equal depth.

Runs come from a sweep over events, +depth where a node begins and -depth where it ends,
-1 and +1 around each gap. Single bases are made only where a sink asks for them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .gaps import gap_array
from .prefix import bucket

#: Counts stop at the largest unsigned number of 32 bits.
MOST_DEPTH = (1 << 32) - 1
#: Bases in a bucket of the sweep.
SWEEP_BUCKET = 1 << 20


def place(mappings: DataFrame, layout: DataFrame) -> DataFrame:
    """Mappings on nodes of the layout, with cid, idx, seq_len and bp_start. Spark broadcasts the layout if it is small."""
    return mappings.where("node_id > 0").join(layout.select("node_id", "cid", "idx", "seq_len", "bp_start", "bp_end"), "node_id")


def node_depth(placed: DataFrame) -> DataFrame:
    """cid, node_id and depth: mappings, not reads, so a path counts a node each time that it visits it."""
    return placed.groupBy("cid", "node_id").agg(F.least(F.count("*"), F.lit(MOST_DEPTH)).alias("depth"))


def project_depth(layout: DataFrame, depth: DataFrame) -> DataFrame:
    """The layout with depth, 0 for nodes that no mapping visits."""
    return layout.join(depth.select("node_id", "depth"), "node_id", "left").withColumn("depth", F.coalesce("depth", F.lit(0).cast("long")))


def node_runs(projected: DataFrame) -> DataFrame:
    """Runs at node precision: one for each node that has bases."""
    return projected.where("bp_end > bp_start").select("cid", F.col("bp_start").alias("start"), F.col("bp_end").alias("end"), "depth")


def mapping_events(placed: DataFrame, base: bool = True) -> DataFrame:
    """cid, pos and delta: what each mapping adds where its node begins and takes off where it ends, and around its gaps.

    One pass over the mappings; events at the same position are added up before they are shuffled.
    """
    event = lambda pos, delta: F.struct(pos.alias("pos"), F.lit(delta).cast("long").alias("delta"))
    found = F.array(event(F.col("bp_start"), 1), event(F.col("bp_end"), -1))
    if base:
        start = F.col("bp_start")
        around = F.transform(gap_array(placed), lambda g: F.array(event(start + g["gap_start"], -1), event(start + g["gap_end"], 1)))
        found = F.concat(found, F.flatten(around))
    return placed.where("bp_end > bp_start").select("cid", F.explode(found).alias("e")).select("cid", "e.pos", "e.delta")


def node_events(projected: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """The same from depths of nodes, where these are known already."""
    start = projected.select("cid", F.col("bp_start").alias("pos"), F.col("depth").alias("delta"))
    events = start.unionByName(projected.select("cid", F.col("bp_end").alias("pos"), (-F.col("depth")).alias("delta")))
    if gaps is None:
        return events
    a, b = F.col("bp_start") + F.col("gap_start"), F.col("bp_start") + F.col("gap_end")
    both = F.array(F.struct(a.alias("pos"), F.lit(-1).cast("long").alias("delta")), F.struct(b.alias("pos"), F.lit(1).cast("long").alias("delta")))
    return events.unionByName(gaps.select("cid", F.explode(both).alias("e")).select("cid", "e.pos", "e.delta"))


def sweep(events: DataFrame, lengths: DataFrame, width: int = SWEEP_BUCKET) -> DataFrame:
    """Runs as long as can be, tiling each component of lengths (cid, length): cid, start, end, depth.

    Events at one position are added up first. The sweep has two levels like a running sum;
    each bucket of positions also learns where the next event after it is. A depth below 0
    is an error.
    """
    zero = F.lit(0).cast("long")
    origin = lengths.where("length > 0").select("cid", zero.alias("pos"), zero.alias("delta"))
    events = events.unionByName(origin).withColumn("bucket", bucket("pos", width))
    net = events.groupBy("cid", "bucket", "pos").agg(F.sum("delta").alias("delta")).where((F.col("delta") != 0) | (F.col("pos") == 0))
    order = Window.partitionBy("cid").orderBy("bucket")
    carry = net.groupBy("cid", "bucket").agg(F.sum("delta").alias("sum"), F.min("pos").alias("first"))
    carry = carry.select("cid", "bucket", F.coalesce(F.sum("sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), zero).alias("before"), F.lead("first").over(order).alias("next"))
    carry = carry.join(lengths.select("cid", "length"), "cid").select("cid", "bucket", "before", F.coalesce("next", "length").alias("next"))
    inner = Window.partitionBy("cid", "bucket").orderBy("pos")
    depth = F.col("before") + F.sum("delta").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    runs = net.join(carry, ["cid", "bucket"]).select("cid", F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(inner), F.col("next")).alias("end"), depth.alias("depth"))
    runs = runs.where(F.col("end") > F.col("start"))
    checked = F.when(F.col("depth") >= 0, F.least("depth", F.lit(MOST_DEPTH))).otherwise(F.raise_error(F.lit("Coverage fell below 0: more gaps than mappings.")).cast("long"))
    return runs.withColumn("depth", checked)


def coverage_runs(projected: DataFrame, gaps: DataFrame | None = None, width: int = SWEEP_BUCKET) -> DataFrame:
    """Runs from depths of nodes (cid, bp_start, bp_end, depth) and gaps."""
    return sweep(node_events(projected, gaps), projected.groupBy("cid").agg(F.max("bp_end").alias("length")), width)


def clip(runs: DataFrame, cid: int, pieces: Sequence[tuple[int, int]]) -> DataFrame:
    """Runs of one component cut to the pieces (end exclusive), in one pass and before any base is made."""
    runs = runs.where(F.col("cid") == cid)
    if not pieces:
        return runs.limit(0)
    zero = F.lit(0).cast("long")
    each = F.array(*(F.struct((zero + a).alias("a"), (zero + b).alias("b")) for a, b in pieces))
    cut = runs.select("cid", "start", "end", "depth", F.explode(each).alias("p")).where((F.col("end") > F.col("p.a")) & (F.col("start") < F.col("p.b")))
    return cut.select("cid", F.greatest("start", "p.a").alias("start"), F.least("end", "p.b").alias("end"), "depth")


def bases(runs: DataFrame) -> DataFrame:
    """One row for each base: cid, position, coverage."""
    return runs.where("end > start").select("cid", F.explode(F.sequence("start", F.col("end") - 1)).alias("position"), F.col("depth").alias("coverage"))


def named_bases(runs: DataFrame, components: DataFrame) -> DataFrame:
    """component_name, position, coverage, the rows of a table export."""
    return bases(runs).join(components.select("cid", F.col("name").alias("component_name")), "cid").select("component_name", "position", "coverage")
