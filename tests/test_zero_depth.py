"""Nodes that no read visits, in all operators that give them a row; and every read counts."""

import math

import __spark_entry__
from depthframe.operators import coverage, series, stats

from .graphs import TWO, analysis, mapping


def test_bases_without_reads(spark):
    whole = lambda node: mapping(node, 0, False, "M100")
    a = analysis(spark, TWO, [[whole(10)], [whole(10), whole(11)]])
    assert sorted(map(tuple, a.runs().select("cid", "start", "end", "depth").collect())) == [(0, 0, 100, 2), (0, 100, 200, 1), (0, 200, 300, 0), (1, 0, 100, 0)]
    assert {r["node_id"]: r["depth"] for r in coverage.project_depth(a.layout(), a.depth()).collect()} == {10: 2, 11: 1, 12: 0, 20: 0, 21: 0}
    r = stats.total_stats(a.histogram()).first()
    assert (r["region_length"], r["covered_positions"], r["breadth"], r["mean"], r["min"], r["max"]) == (400, 200, 50.0, 0.75, 0, 2)
    depths = a.runs().select("depth").distinct()
    assert {r["depth"]: round(r["y"], 6) for r in depths.select("depth", series.log_scale(depths["depth"].cast("double"), 10).alias("y")).collect()} == {0: 0.0, 1: 1.0, 2: round(1 + math.log10(2), 6)}
    assert {(r["y"], r["plot_y"]) for r in series.linear_series(a.runs(), a.lengths(), most=60, log_base=10).where("cid = 1").collect()} == {(0.0, 0.0)}


def test_every_read_counts(spark, sf_dir):
    found = __spark_entry__.queries()
    assert found["node_depth_projected"](spark, sf_dir).groupBy().sum("depth").first()[0] == found["node_depth"](spark, sf_dir).groupBy().sum("depth").first()[0]
    assert not any("% 16" in sql for sql in __spark_entry__.oracle_sql().values())


def test_asof_component_resolves_every_index(spark, sf_dir):
    found = __spark_entry__.queries()
    n = found["node_layout"](spark, sf_dir).count()
    assert sorted(r["flat_idx"] for r in found["asof_component"](spark, sf_dir).collect()) == list(range(n))
