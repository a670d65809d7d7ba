"""Distribution of depth, from runs and never from single bases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATS = ("region_length", "covered_positions", "breadth", "mean", "median", "stddev", "cv", "q1", "q3", "min", "max")


def depth_histogram(runs: DataFrame) -> DataFrame:
    """cid, depth and n_bases."""
    return runs.groupBy("cid", "depth").agg(F.sum(F.col("end") - F.col("start")).alias("n_bases"))


def _finish(grouped) -> DataFrame:
    """The statistics of groups of histogram rows. Sums are exact; quartiles interpolate at rank p * (n - 1)."""
    wide = lambda c: c.cast("decimal(38,0)")
    d, n = F.col("depth"), F.col("n_bases")
    rows = grouped.agg(
        F.sum("n_bases").alias("region_length"),
        F.sum(F.when(d > 0, n).otherwise(F.lit(0).cast("long"))).alias("covered_positions"),
        F.sum(wide(d) * n).cast("double").alias("__s1"),
        F.sum(wide(wide(d) * d) * n).cast("double").alias("__s2"),
        F.percentile("depth", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n_bases")).alias("__q"),
        F.min("depth").alias("min"),
        F.max("depth").alias("max"),
    )
    rows = rows.withColumn("mean", F.col("__s1") / F.col("region_length")).withColumn("stddev", F.sqrt(F.greatest(F.lit(0.0), F.col("__s2") / F.col("region_length") - F.col("mean") * F.col("mean"))))
    rows = rows.withColumn("breadth", 100.0 * F.col("covered_positions") / F.col("region_length")).withColumn("cv", F.when(F.col("mean") > 0, F.col("stddev") / F.col("mean")).otherwise(F.lit(0.0)))
    return rows.withColumns({k: F.element_at("__q", i) for i, k in ((1, "q1"), (2, "median"), (3, "q3"))})


def component_stats(histogram: DataFrame) -> DataFrame:
    """The statistics of each component."""
    return _finish(histogram.groupBy("cid")).select("cid", *STATS)


def total_stats(histogram: DataFrame) -> DataFrame:
    """One row of statistics over all bases; zeros if there are none."""
    one = _finish(histogram.groupBy("depth").agg(F.sum("n_bases").alias("n_bases")).groupBy())
    zero = {c: F.coalesce(c, F.lit(0).cast("long" if c in ("region_length", "covered_positions", "min", "max") else "double")) for c in STATS}
    return one.withColumns(zero).select(*STATS)


def rollup_stats(histogram: DataFrame) -> DataFrame:
    """The statistics of each component and, with a null cid, of all together."""
    return _finish(histogram.rollup("cid")).select("cid", *STATS)
