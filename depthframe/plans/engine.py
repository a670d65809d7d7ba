"""The analysis from reads to depth, for all components or for one query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coverage, layout, query, reads, stats

PRECISIONS = ("base", "node")


@dataclass(frozen=True)
class Analysis:
    """A graph laid out, and reads. Everything is lazy; cache runs() to use it several times."""

    nodes: DataFrame
    components: DataFrame
    alignments: DataFrame

    def layout(self) -> DataFrame:
        return layout.node_layout(self.nodes)

    def summary(self) -> DataFrame:
        return layout.component_summary(self.nodes, self.components)

    def lengths(self) -> DataFrame:
        return self.nodes.groupBy("cid").agg(F.sum("seq_len").alias("length"))

    def placed(self, scope: query.Scope | None = None, laid: DataFrame | None = None) -> DataFrame:
        """Mappings on their nodes; with a scope only on its active nodes, filtered before the join."""
        laid = self.layout() if laid is None else laid
        return coverage.place(reads.mappings(self.alignments), laid if scope is None else laid.where(scope.active()))

    def depth(self, scope: query.Scope | None = None, laid: DataFrame | None = None) -> DataFrame:
        return coverage.node_depth(self.placed(scope, laid))

    def runs(self, precision: str = "base", scope: query.Scope | None = None) -> DataFrame:
        """cid, start, end, depth. At base precision without what reads leave out; of a scope only its pieces."""
        runs = self.component_runs(precision, scope)
        return runs if scope is None else coverage.clip(runs, scope.cid, scope.pieces)

    def component_runs(self, precision: str = "base", scope: query.Scope | None = None) -> DataFrame:
        """Runs over whole components; with a scope over its component, from mappings on its active nodes."""
        if precision not in PRECISIONS:
            raise ValueError(f"Precision must be 'base' or 'node', not '{precision}'.")
        lengths = self.lengths() if scope is None else self.lengths().where(F.col("cid") == scope.cid)
        return coverage.sweep(coverage.mapping_events(self.placed(scope), precision == "base"), lengths)

    def mapping_stats(self, scope: query.Scope | None = None) -> DataFrame:
        active = self.nodes if scope is None else self.nodes.where(scope.active())
        return reads.mapping_stats(self.alignments, active)

    def histogram(self, precision: str = "base", scope: query.Scope | None = None) -> DataFrame:
        return stats.depth_histogram(self.runs(precision, scope))

    def scope(self, text: str, circular: bool = False) -> query.Scope:
        """Resolves a query as a user writes it."""
        component, asked = query.parse_query(text)
        cid, name = query.resolve_component(self.components, component)
        return query.resolve_scope(self.nodes, cid, name, asked, circular)
