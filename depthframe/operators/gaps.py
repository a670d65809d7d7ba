"""Which bases of a node a mapping does not cover, in forward coordinates of the node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reads import is_deletion


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def walk_span(length: Column, offset: Column, reverse: Column, w0: Column, w1: Column) -> tuple[Column, Column]:
    """The forward range of the bases w0 to w1 of a walk that begins at offset, against the strand if reverse."""
    zero = F.lit(0).cast("long")
    a = F.when(reverse, length - offset - w1).otherwise(offset + w0)
    b = F.when(reverse, length - offset - w0).otherwise(offset + w1)
    return clamp(a, zero, length), clamp(b, zero, length)


def leading(length: Column, offset: Column, reverse: Column) -> tuple[Column, Column]:
    """The bases before the walk."""
    zero = F.lit(0).cast("long")
    return F.when(reverse, length - offset).otherwise(zero), F.when(reverse, length).otherwise(offset)


def trailing(length: Column, offset: Column, reverse: Column, consumed: Column) -> tuple[Column, Column]:
    """The bases after a walk that takes ``consumed`` of them."""
    end = offset + F.least(consumed, length - offset)
    return F.when(reverse, F.lit(0).cast("long")).otherwise(end), F.when(reverse, length - end).otherwise(length)


_NONE = "array<struct<kind:string,gap_start:bigint,gap_end:bigint>>"


def gap_array(rows: DataFrame) -> Column:
    """The gaps of a mapping (kind, gap_start, gap_end in its node) as an array.

    rows: mappings joined with the layout. Deletions count in every mapping, leading bases
    only in the first of a raw path, trailing ones only in its last. A mapping without edits
    takes no base, so as the last one its whole node is a gap. Nodes without bases have none.
    """
    length, reverse = rows["seq_len"], rows["is_reverse"]
    offset = clamp(rows["offset"], F.lit(0).cast("long"), length)
    none = F.array().cast(_NONE)
    struct = lambda kind, pair: F.struct(F.lit(kind).alias("kind"), pair[0].alias("gap_start"), pair[1].alias("gap_end"))
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("found"))

    def step(s: Column, e: Column) -> Column:
        after = s["at"] + e["from_length"]
        gap = struct("deletion", walk_span(length, offset, reverse, s["at"], after))
        return F.struct(after.alias("at"), F.when(is_deletion(e), F.concat(s["found"], F.array(gap))).otherwise(s["found"]).alias("found"))

    def ends(walk: Column) -> Column:
        first = F.when(rows["ord"] == 0, F.array(struct("leading", leading(length, offset, reverse)))).otherwise(none)
        last = F.when(rows["ord"] == rows["n_map"] - 1, F.array(struct("trailing", trailing(length, offset, reverse, walk["at"])))).otherwise(none)
        return F.concat(walk["found"], first, last)

    # The walk over the edits is evaluated once.
    edits = F.coalesce(rows["edits"], F.array().cast("array<struct<from_length:int,to_length:int,sequence:string>>"))
    found = F.element_at(F.transform(F.array(F.aggregate(edits, start, step)), ends), 1)
    return F.filter(found, lambda g: g["gap_end"] > g["gap_start"])


def gaps(placed: DataFrame) -> DataFrame:
    """All gaps: read_id, ord, cid, node_id, bp_start of the node, kind, gap_start, gap_end. No shuffle."""
    rows = placed.select("read_id", "ord", "cid", "node_id", "bp_start", F.explode(gap_array(placed)).alias("g"))
    return rows.select("read_id", "ord", "cid", "node_id", "bp_start", "g.kind", "g.gap_start", "g.gap_end")
