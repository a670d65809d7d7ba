"""What a user asks for: a component by name or number, and a range of its bases."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .layout import node_layout

MOST_SUGGESTIONS = 3
_QUERY = re.compile(r"\s*(\S+)(?:\s+(-?\d+):(-?\d+))?\s*")


class QueryError(ValueError):
    """A query that can't be answered, with a text for the user."""


@dataclass(frozen=True)
class Scope:
    """A resolved query: bases start to end (inclusive), nodes first_idx to last_idx (inclusive).

    start after end goes through the origin. pieces are the stretches of bases (end
    exclusive), in the order of the traversal, that are both in range and on active nodes.
    """

    cid: int
    name: str
    length: int
    start: int
    end: int
    first_idx: int
    last_idx: int
    pieces: tuple[tuple[int, int], ...]

    @property
    def crosses_origin(self) -> bool:
        return self.start > self.end

    @property
    def full(self) -> bool:
        return self.start == 0 and self.end == self.length - 1

    def traversal_length(self) -> int:
        return self.length - self.start + self.end + 1 if self.crosses_origin else self.end - self.start + 1

    def active(self) -> Column:
        """Which nodes (by idx) take part: compared by rank, so two positions of one node mean that node alone."""
        idx = F.col("idx")
        if self.first_idx <= self.last_idx:
            return (F.col("cid") == self.cid) & idx.between(self.first_idx, self.last_idx)
        return (F.col("cid") == self.cid) & ((idx >= self.first_idx) | (idx <= self.last_idx))

    def local(self, position: Column) -> Column:
        """The place of a position in the traversal, from 0."""
        return F.when(position >= self.start, position - self.start).otherwise(position + (self.length - self.start))


def parse_query(text: str) -> tuple[str, tuple[int, int] | None]:
    """COMPONENT or 'COMPONENT START:END'; a colon without white space before the range belongs to a name."""
    m = _QUERY.fullmatch(text)
    if not m:
        raise QueryError(f"Invalid query '{text}': use COMPONENT or 'COMPONENT START:END', with a name or a number.")
    component, a, b = m.groups()
    return component, None if a is None else (int(a), int(b))


def resolve_range(component: int | str, length: int, asked: tuple[int, int] | None, circular: bool) -> tuple[int, int]:
    """Both ends as positions; negative ones count from the end, start after end needs a circular component."""
    if length <= 0:
        raise QueryError(f"Component {component} has no bases.")
    if asked is None:
        return 0, length - 1
    if not all(-(1 << 63) <= x < 1 << 63 for x in asked):
        raise QueryError("Query coordinates must fit 64 bits.")
    start, end = (x + length if x < 0 else x for x in asked)
    for which, x in (("start", start), ("end", end)):
        if not 0 <= x < length:
            raise QueryError(f"The {which} of the query is outside of the component (0 to {length - 1}).")
    if start > end and not circular:
        raise QueryError(origin_message(component, asked, start, end))
    return start, end


def origin_message(component: int | str, asked: tuple[int, int], start: int, end: int) -> str:
    low, high = sorted((start, end))
    return (
        f"Query {component} {asked[0]}:{asked[1]} means {start} to {end} and crosses the origin of the component.\n"
        f"For a circular component add --component-type circular.\nFor the interval between both positions use {component} {low}:{high}."
    )


def _number(query: Column) -> Column:
    """The component number that digits mean, whatever zeros lead; null for other texts and for numbers that no component has."""
    short = F.ltrim(query, F.lit("0"))
    return F.when(query.rlike("^[0-9]+$") & (F.length(short) <= 9), F.concat(F.lit("0"), short).cast("int"))


def resolve_names(asked: DataFrame, components: DataFrame) -> DataFrame:
    """asked (query) with the cid and name that it means, null if none.

    Digits are a component number; anything else is a name in any case of letters. Two
    equi-joins, one for each kind.
    """
    digits = F.col("query").rlike("^[0-9]+$")
    by = components.select("cid", "name")
    numbers = asked.where(digits).select("query", _number(F.col("query")).alias("cid")).join(by, "cid", "left")
    numbers = numbers.select("query", F.when(F.col("name").isNotNull(), F.col("cid")).alias("cid"), "name")
    names = asked.where(~digits | F.col("query").isNull()).select("query", F.lower("query").alias("__lower")).join(by.withColumn("__lower", F.lower("name")), "__lower", "left")
    return numbers.unionByName(names.select("query", "cid", "name"))


def suggestions(asked: Sequence[str], components: DataFrame, most: int = MOST_SUGGESTIONS) -> DataFrame:
    """query, rank and name: names that begin with the query in order of cid, then those within a small edit distance.

    asked: what a user typed, so a few texts; they are literals of one pass over the components.
    """
    if not asked:
        return components.limit(0).select(F.col("name").alias("query"), F.lit(0).alias("rank"), "name")
    lower, name = F.lower("query"), F.lower("name")
    distance = F.levenshtein(lower, name)
    allowed = F.greatest(F.lit(2), F.floor(F.length("query") / 4).cast("int"))
    rows = components.select("cid", "name", F.explode(F.array(*map(F.lit, sorted(set(asked))))).alias("query")).where(name.startswith(lower) | (distance <= allowed))
    rows = rows.select("query", "cid", "name", F.when(name.startswith(lower), -1).otherwise(distance).alias("far"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("far", "cid"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("query", "rank", "name")


def resolve_component(components: DataFrame, query: str) -> tuple[int, str]:
    """The cid and name that a query means; an error with suggestions if there is none. One pass that filters by a literal."""
    digits = re.fullmatch("[0-9]+", query)
    row = components.where(F.col("cid") == _number(F.lit(query)) if digits else F.lower("name") == F.lower(F.lit(query))).select("cid", "name").first()
    if row is not None:
        return row["cid"], row["name"]
    if digits:
        raise QueryError(f"Component number {query} is out of range ({components.count()} components). Use --inspect to list them.")
    near = [r["name"] for r in suggestions([query], components).orderBy("rank").collect()]
    raise QueryError(f"Component '{query}' was not found.\n" + ("Did you mean:\n" + "".join(f"  - {n}\n" for n in near) if near else "Use --inspect to list the components."))


def resolve_scope(nodes: DataFrame, cid: int, name: str, asked: tuple[int, int] | None, circular: bool) -> Scope:
    """Resolves a range on the driver: a length and two nodes are looked up, the rest are literals of later plans.

    Only the nodes of the component are read; without a range one aggregation is all there is to do.
    """
    own = nodes.where(F.col("cid") == cid)
    bases = F.col("seq_len") > 0
    ends = own.agg(F.sum("seq_len").alias("n"), F.min(F.when(bases, F.col("idx"))).alias("lo"), F.max(F.when(bases, F.col("idx"))).alias("hi")).first()
    length = ends["n"] or 0
    start, end = resolve_range(name, length, asked, circular)
    if (start, end) == (0, length - 1):
        return Scope(cid, name, length, start, end, ends["lo"], ends["hi"], ((0, length),))
    holds = lambda p: (F.col("bp_start") <= p) & (F.col("bp_end") > p)
    found = node_layout(own).where(holds(start) | holds(end)).select("idx", "bp_start", "bp_end").collect()
    first, last = (next(r["idx"] for r in found if r["bp_start"] <= p < r["bp_end"]) for p in (start, end))
    if start <= end:
        pieces = ((start, end + 1),)
    elif first == last:
        # Only this node is active, though the range goes round the whole component.
        pieces = ((start, found[0]["bp_end"]), (found[0]["bp_start"], end + 1))
    else:
        pieces = ((start, length), (0, end + 1))
    return Scope(cid, name, length, start, end, first, last, pieces)
