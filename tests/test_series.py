import pytest

from depthframe.operators import query, series

from .graphs import THREE, analysis


def runs_of(spark, values):
    return spark.createDataFrame([(0, i, i + 1, v) for i, v in enumerate(values)], "cid int, start long, end long, depth long"), spark.createDataFrame([(0, len(values))], "cid int, length long")


@pytest.mark.parametrize(("n", "most", "x"), [(10, 3, [0, 4, 9]), (8, 5, [0, 2, 4, 6, 7]), (4, 0, [0, 1, 2, 3]), (1, 1, [0]), (10, 1, [9]), (5, 100, [0, 1, 2, 3, 4])])
def test_samples(spark, n, most, x):
    lengths = spark.createDataFrame([(0, n)], "cid int, length long")
    assert sorted(r["x"] for r in series.samples(lengths, most).collect()) == x


@pytest.mark.parametrize(("circular", "y"), [(False, [1.5, 2, 3, 4, 5, 6, 7, 8, 9, 9.5]), (True, [13 / 3, 2, 3, 4, 5, 6, 7, 8, 9, 20 / 3])])
def test_moving_average(spark, circular, y):
    got = series.smooth(*runs_of(spark, range(1, 11)), 0.3, 100, circular).orderBy("x").collect()
    assert [r["y"] for r in got] == pytest.approx(y) and {r["window_size"] for r in got} == {3}


@pytest.mark.parametrize(("n", "share", "size"), [(8, 0.5, 5), (4, 1.0, 3), (10, 0.0, 1), (10, -1.0, 1), (10, 0.01, 1), (5, 1.0, 5)])
def test_window_sizes(spark, n, share, size):
    got = series.smooth(*runs_of(spark, range(n)), share, 100).collect()
    assert {r["window_size"] for r in got} == {size}


@pytest.mark.parametrize("n", [3, 4, 5, 10])
@pytest.mark.parametrize("share", [0.4, 0.9, 1.0])
@pytest.mark.parametrize("circular", [False, True])
def test_moving_average_by_hand(spark, n, share, circular):
    values = [(i * 7 + 3) % 11 for i in range(n)]
    got = {r["x"]: (r["y"], r["window_size"]) for r in series.smooth(*runs_of(spark, values), share, 100, circular).collect()}
    for x, (y, size) in got.items():
        window = range(x - size // 2, x + size // 2 + 1)
        own = [values[i % n] for i in window] if circular else [values[i] for i in window if 0 <= i < n]
        assert y == pytest.approx(sum(own) / len(own))


@pytest.mark.parametrize("share", [1.5, float("nan"), float("inf")])
def test_bad_smoothing(share):
    with pytest.raises(ValueError):
        series.check_smoothing(share)


def test_log_scale(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(v,) for v in (0.0, 0.5, 1.0, 10.0, 100.0)], "v double").select(series.log_scale(F.col("v"), 10).alias("y")).collect()
    assert [r["y"] for r in rows] == pytest.approx([0, 0.5, 1, 2, 3])
    with pytest.raises(ValueError):
        series.log_scale(F.col("v"), 1)


def test_a_hole_stays_a_hole(spark):
    a = analysis(spark, THREE, [[10, 11, 12]])
    scope = a.scope("chrX 20:10", circular=True)
    rows = series.circular_series(a.component_runs("node", scope), scope, 0.0, 0).orderBy("x").collect()
    assert len(rows) == scope.traversal_length() == 291
    assert [r["position"] for r in rows if r["y"] is not None] == [*range(20, 100), *range(11)]
    found = series.segments(series.circular_series(a.component_runs("node", scope), scope, 0.0, 0)).orderBy("segment").collect()
    assert [(r["first"], r["last"], r["n_points"]) for r in found] == [(0, 79, 80), (280, 290, 11)]


def test_windows_keep_their_bases_on_a_part(spark):
    a = analysis(spark, THREE, [[10, 11, 12]])
    scope = a.scope("chrX 0:99", circular=True)
    assert isinstance(scope, query.Scope) and not scope.full
    assert {r["window_size"] for r in series.circular_series(a.component_runs("node", scope), scope, 0.1, 0).collect()} == {31}
    assert {r["window_size"] for r in series.circular_series(a.component_runs("node", scope), scope, 0.9, 0).collect()} == {99}
