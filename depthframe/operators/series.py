"""Series for plots: sampled positions, moving averages, scales.

A moving average is a difference of cumulated areas, taken only at the sampled positions:
the width of the window does not matter, and no base is made.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .prefix import containing, running_sum
from .query import Scope

SMOOTHING, MOST_POINTS = 0.01, 10_000
#: Bases in a bucket of the cumulated area.
AREA_BUCKET = 1 << 16


def check_smoothing(smoothing: float) -> float:
    if not math.isfinite(smoothing) or smoothing > 1:
        raise ValueError("Smoothing must be a number up to 1.")
    return max(0.0, smoothing)


def window_size(n: Column, smoothing: Column) -> Column:
    """Bases in the window: the rounded share, at most n, made odd; 1 means no smoothing."""
    raw = F.least(F.greatest(F.lit(1).cast("long"), F.floor(n * smoothing + 0.5)), n)
    even = (raw > 1) & (raw % 2 == 0)
    return F.when(even & (raw < n), raw + 1).when(even, raw - 1).otherwise(raw)


def samples(lengths: DataFrame, most: int = MOST_POINTS) -> DataFrame:
    """cid, length and x: every step-th position from 0, and always the last one; at most ``most`` (0: all).

    When the last position would be one too many it takes the place of the last sample.
    """
    n = F.col("length")
    cap = n if most == 0 else F.lit(most).cast("long")
    step = F.greatest(F.lit(1).cast("long"), F.floor((n + cap - 1) / cap))
    rows = lengths.where("length > 0").withColumn("__step", step).withColumn("__cap", cap)
    rows = rows.withColumn("__x", F.sequence(F.lit(0).cast("long"), n - 1, F.col("__step")))
    last = F.element_at("__x", -1)
    end = F.array(n - 1)
    full = F.when(last == n - 1, F.col("__x")).when(F.size("__x") < F.col("__cap"), F.concat("__x", end)).otherwise(F.concat(F.slice("__x", 1, F.size("__x") - 1), end))
    return rows.withColumn("__x", full).select(*lengths.columns, F.explode("__x").alias("x"))


def area_runs(runs: DataFrame) -> DataFrame:
    """Runs with what lies before each of them: area, the sum of depth, and known, the number of bases with a depth."""
    size = F.col("end") - F.col("start")
    none = F.lit(0).cast("long")
    rows = runs.withColumn("__own", F.coalesce(F.col("depth") * size, none)).withColumn("__seen", F.when(F.col("depth").isNull(), none).otherwise(size))
    rows = running_sum(rows, ["cid"], "start", {"area": "__own", "known": "__seen"}, AREA_BUCKET)
    return rows.withColumn("area", F.col("area") - F.col("__own")).withColumn("known", F.col("known") - F.col("__seen")).drop("__own", "__seen")


def smooth(runs: DataFrame, lengths: DataFrame, smoothing: float = SMOOTHING, most: int = MOST_POINTS, circular: bool = False) -> DataFrame:
    """cid, x, y, raw (the depth at x) and window_size at the sampled positions of each component.

    runs: cid, start, end, depth, tiling 0 to length; bases of null depth count for nothing.
    Linear windows are cut at the ends and divided by what is left, circular ones go round. One
    join: both ends of the windows and the position itself are looked up together.
    """
    s = check_smoothing(smoothing)
    rows = samples(lengths, most).withColumn("window_size", window_size(F.col("length"), F.lit(float(s))) if s > 0 else F.lit(1).cast("long"))
    half, n, x = F.floor(F.col("window_size") / 2), F.col("length"), F.col("x")
    lo, hi, zero = x - half, x + half + 1, F.lit(0).cast("long")
    look = lambda at, sign: F.struct(at.alias("at"), F.lit(sign).alias("sign"))
    ends = [look(F.greatest(lo, zero), -1), look(F.least(hi, n), 1), look(x, 0)]
    if circular:
        # What hangs over either end is taken from the other one; nothing cancels out where nothing does.
        ends += [look(F.when(lo < 0, lo + n).otherwise(zero), -1), look(F.when(lo < 0, n).otherwise(zero), 1), look(zero, -1), look(F.when(hi > n, hi - n).otherwise(zero), 1)]
    points = rows.select("cid", "length", "x", "window_size", F.explode(F.array(*ends)).alias("e")).select("cid", "length", "x", "window_size", "e.at", "e.sign")
    # The end of a component lies in its last base.
    points = points.withColumn("look", F.least(F.col("at"), F.col("length") - 1))
    found = containing(points, area_runs(runs), ["cid"], "look", "start", "end", AREA_BUCKET)
    inside = F.col("at") - F.col("start")
    area = F.col("area") + F.coalesce(inside * F.col("depth"), zero)
    known = F.col("known") + F.when(F.col("depth").isNull(), zero).otherwise(inside)
    sums = found.groupBy("cid", "x", "window_size").agg(F.sum(F.col("sign") * area).alias("a"), F.sum(F.col("sign") * known).alias("k"), F.max(F.when(F.col("sign") == 0, F.col("depth"))).alias("raw"))
    return sums.select("cid", "x", F.when(F.col("k") > 0, F.col("a") / F.col("k")).alias("y"), "raw", "window_size")


def log_scale(value: Column, base: int) -> Column:
    """Values up to 1 stay, others are 1 + their logarithm."""
    if base <= 1:
        raise ValueError("The base of a logarithmic scale must be greater than 1.")
    return F.when(value <= 1, value).otherwise(1 + F.log(value) / math.log(base))


def traversal_runs(runs: DataFrame, scope: Scope) -> DataFrame:
    """Runs of the scope's pieces in coordinates of the traversal; depth is null where no active node is."""
    zero = F.lit(0).cast("long")
    shift = lambda a: -scope.start if a >= scope.start else scope.length - scope.start
    # All pieces in one pass over the runs.
    pieces = F.array(*(F.struct((zero + a).alias("a"), (zero + b).alias("b"), (zero + shift(a)).alias("shift")) for a, b in scope.pieces))
    cut = runs.where(F.col("cid") == scope.cid).select("cid", "start", "end", "depth", F.explode(pieces).alias("p")).where((F.col("end") > F.col("p.a")) & (F.col("start") < F.col("p.b")))
    cut = cut.select("cid", (F.greatest("start", "p.a") + F.col("p.shift")).alias("start"), (F.least("end", "p.b") + F.col("p.shift")).alias("end"), "depth")
    # What the pieces leave of the traversal: at most one stretch between two pieces, and its ends.
    n = scope.traversal_length()
    local = sorted((a - scope.start, b - scope.start) if a >= scope.start else (a + scope.length - scope.start, b + scope.length - scope.start) for a, b in scope.pieces)
    at, holes = 0, []
    for a, b in [*local, (n, n)]:
        if a > at:
            holes.append((at, a))
        at = max(at, b)
    for a, b in holes:
        cut = cut.unionByName(cut.sparkSession.range(1).select(F.lit(scope.cid).cast("int").alias("cid"), (zero + a).alias("start"), (zero + b).alias("end"), F.lit(None).cast("long").alias("depth")))
    return cut


def circular_series(runs: DataFrame, scope: Scope, smoothing: float = SMOOTHING, most: int = MOST_POINTS, log_base: int | None = None) -> DataFrame:
    """x (place in the traversal), position, y and plot_y of a circular plot; y is null where no active node is.

    The window keeps its size in bases on a part of a component: the share is scaled, to 1 at
    most. Windows take the bases that have a depth. Only a full component goes round.
    """
    n = scope.traversal_length()
    share = check_smoothing(smoothing)
    share = min(1.0, share * scope.length / n)
    lengths = runs.sparkSession.range(1).select(F.lit(scope.cid).cast("int").alias("cid"), F.lit(n).cast("long").alias("length"))
    points = smooth(traversal_runs(runs, scope), lengths, share, most, scope.full)
    y = F.when(F.col("raw").isNotNull(), F.col("y"))
    rows = points.withColumn("y", y).withColumn("position", (F.col("x") + scope.start) % scope.length)
    return rows.select("cid", "x", "position", "y", (log_scale(F.col("y"), log_base) if log_base else F.col("y")).alias("plot_y"), "window_size")


def segments(points: DataFrame, by: str = "cid", order: str = "x", value: str = "y") -> DataFrame:
    """Stretches of neighbouring samples that have a value: segment (from 0), first, last and n_points.

    points are the samples of a panel: bounded by the number of points of a plot.
    """
    w = Window.partitionBy(by).orderBy(order)
    start = F.when(F.col(value).isNotNull() & F.lag(value).over(w).isNull(), 1).otherwise(0)
    rows = points.withColumn("__s", start).withColumn("segment", F.sum("__s").over(w) - 1).where(F.col(value).isNotNull())
    return rows.groupBy(by, "segment").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n_points"))


def linear_series(runs: DataFrame, lengths: DataFrame, smoothing: float = SMOOTHING, most: int = MOST_POINTS, log_base: int | None = None) -> DataFrame:
    """cid, x, y, plot_y and window_size of linear plots; a missing depth counts as 0."""
    rows = smooth(runs.withColumn("depth", F.coalesce("depth", F.lit(0).cast("long"))), lengths, smoothing, most)
    return rows.withColumn("plot_y", log_scale(F.col("y"), log_base) if log_base else F.col("y")).select("cid", "x", "y", "plot_y", "window_size")
