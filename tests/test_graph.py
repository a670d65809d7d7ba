import pytest
from pyspark.sql import functions as F

from depthframe.operators import layout, prefix
from depthframe.sources import readers, schema

from .graphs import PERMUTED, THREE, TWO, analysis


def test_layout_follows_the_order_of_nodes(spark):
    got = {r["node_id"]: (r["bp_start"], r["bp_end"]) for r in analysis(spark, PERMUTED).layout().collect()}
    assert got == {11: (0, 10), 12: (10, 30), 10: (30, 60)}


def test_summary_and_total(spark):
    a = analysis(spark, TWO)
    rows = {r["name"]: (r["nid_min"], r["nid_max"], r["nb_nodes"], r["length_bp"]) for r in a.summary().collect()}
    assert rows == {"chr1": (10, 12, 3, 300), "chr2": (20, 21, 2, 100)}
    total = layout.component_totals(a.summary()).where("label = 'Total'").first()
    assert (total["nb_nodes"], total["length_bp"]) == (5, 400)


def test_long_names_are_cut(spark):
    a = analysis(spark, {"abcdefghijklmno": [(1, 0, 1234)], "abcdefghijklmn": [(2, 0, 1)]})
    got = {r["cid"]: (r["short_name"], r["length_text"]) for r in layout.inspect_rows(a.summary()).collect()}
    assert got == {0: ("abcdefghijklm~", "1,234"), 1: ("abcdefghijklmn", "1")}


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_running_sum_does_not_depend_on_the_bucket(spark, width):
    rows = spark.createDataFrame([(g, i, (i * 7 + g) % 5) for g in range(3) for i in range(20)], "g int, i long, v long")
    got = {(r["g"], r["i"]): r["s"] for r in prefix.running_sum(rows, ["g"], "i", {"s": "v"}, width).collect()}
    assert got == {(g, i): sum((k * 7 + g) % 5 for k in range(i + 1)) for g in range(3) for i in range(20)}


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_containing_finds_the_span_of_a_point(spark, width):
    spans = spark.createDataFrame([(0, 0, 10), (0, 10, 10), (0, 10, 35), (1, 0, 5)], "c int, s long, e long")
    points = spark.createDataFrame([(0, 9), (0, 10), (0, 34), (0, 35), (1, 4), (2, 0)], "c int, at long")
    got = sorted((r["c"], r["at"], r["s"]) for r in prefix.containing(points, spans, ["c"], "at", "s", "e", width).collect())
    assert got == [(0, 9, 0), (0, 10, 10), (0, 34, 10), (1, 4, 0)]


@pytest.mark.parametrize(
    ("graph", "says"),
    [({"c": [(1, 0, 5), (2, 2, 5)]}, "ranks"), ({"c": [(1, 0, -1)]}, "negative"), ({"a": [(1, 0, 5)], "b": [(1, 0, 5)]}, "2 times"), ({"a": [(1, 0, 5)], "A": [(2, 0, 5)]}, "2 times"), ({"a": []}, "no nodes"), ({" ": [(1, 0, 1)]}, "no name"), ({"a": [(0, 0, 1)]}, "not positive")],
)
def test_bad_graphs_are_refused(spark, graph, says):
    a = analysis(spark, graph)
    with pytest.raises(schema.GraphError, match=says):
        schema.validate_graph(a.nodes, a.components)


def test_a_graph_survives_writing(spark, tmp_path):
    a = analysis(spark, TWO)
    readers.write_graph(a.nodes, a.components, str(tmp_path))
    schema.validate_graph(readers.read_nodes(spark, f"{tmp_path}/nodes"), readers.read_components(spark, f"{tmp_path}/components"))
    one = readers.read_nodes(spark, f"{tmp_path}/nodes", cid=1)
    assert sorted(r["node_id"] for r in one.collect()) == [20, 21]
    assert "PartitionFilters: [isnotnull(cid" in one._jdf.queryExecution().toString()


def test_missing_columns_and_formats(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "x"))
    with pytest.raises(schema.GraphError, match="lacks"):
        readers.read_nodes(spark, str(tmp_path / "x"))
    with pytest.raises(ValueError, match="Format"):
        readers.read_nodes(spark, str(tmp_path / "x"), "csv")


def test_broken_records_are_dropped(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"read_id": 1, "path": [{"node_id": 10, "offset": 0, "is_reverse": false, "edits": []}]}\n{"read_id": oops\n{"read_id": 2, "path": []}\n')
    got = readers.read_alignments(spark, str(tmp_path / "r.json"), "json")
    assert sorted(r["read_id"] for r in got.collect()) == [1, 2]


def test_points_find_nodes(spark):
    a = analysis(spark, THREE)
    points = spark.createDataFrame([(0, p) for p in (0, 99, 100, 299, 300)], "cid int, pos long")
    assert {r["pos"]: r["idx"] for r in layout.node_at(a.layout(), points).collect()} == {0: 0, 99: 0, 100: 1, 299: 2}


def test_a_component_is_a_pushed_filter(spark, sf_dir):
    from depthframe.sources import fixture

    plan = fixture.graph(spark, sf_dir)[1].where(F.col("cid") == 3)._jdf.queryExecution().toString()
    assert "ReadSchema" in plan and "p_name" not in plan.rpartition("Physical Plan")[2]
