"""Running sums and lookups by position that no single large group can hold up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bucket(name: str, width: int) -> Column:
    """Which bucket of width a number from 0 is in.

    Never null: a filter for that, on one of two uses of a table, would keep Spark from
    computing the table once for both.
    """
    return F.coalesce(F.expr(f"`{name}` div {int(width)}"), F.lit(0).cast("long"))


def running_sum(rows: DataFrame, by: Sequence[str], order: str, sums: dict[str, str], width: int) -> DataFrame:
    """For each new column in sums, the sum of a value over the rows of a group up to and including this one.

    order is a number from 0. Two levels: the rows are summed within buckets of ``width`` of
    order, and the sums of the buckets before are carried in. A group of any size is dealt
    over its buckets.
    """
    rows = rows.withColumn("__bucket", bucket(order, width))
    totals = rows.groupBy(*by, "__bucket").agg(*(F.sum(v).alias(f"__sum_{c}") for c, v in sums.items()))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*by, "__bucket", *(F.coalesce(F.sum(f"__sum_{c}").over(before), F.lit(0)).alias(f"__carry_{c}") for c in sums))
    inner = Window.partitionBy(*by, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.join(carry, [*by, "__bucket"]).withColumns({c: F.col(f"__carry_{c}") + F.sum(v).over(inner) for c, v in sums.items()})
    return found.drop("__bucket", *(f"__carry_{c}" for c in sums))


def containing(points: DataFrame, spans: DataFrame, by: Sequence[str], at: str, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Joins each point with the spans [start, end) of its group that contain it.

    Both sides meet on a bucket of positions: a span is there once for each bucket that it
    touches, and the comparison runs only within one. An equi-join, so Spark picks a
    broadcast or a shuffle by the measured sizes. Empty spans contain nothing.
    """
    last = F.expr(f"(`{end}` - 1) div {int(width)}")
    split = spans.where(F.col(end) > F.col(start)).withColumn("__bucket", F.explode(F.sequence(bucket(start, width), last)))
    points = points.withColumn("__bucket", bucket(at, width))
    keys = [*by, "__bucket"]
    left, right = points.alias("p"), split.alias("s")
    on = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in keys] + [F.col(f"p.{at}") >= F.col(f"s.{start}"), F.col(f"p.{at}") < F.col(f"s.{end}")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(right, cond, how).select("p.*", *(F.col(f"s.{c}") for c in split.columns if c not in keys and c != at)).drop("__bucket")
