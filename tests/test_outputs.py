import glob
import struct
import xml.etree.ElementTree as ET
import zlib

import numpy as np
import pytest

from depthframe import cli
from depthframe.functions import axes
from depthframe.sinks import files, png, requests, svg
from depthframe.sources import readers
from depthframe.streaming import depth as stream

from .graphs import TWO, analysis

PATHS = [[10], [10, 11], [20], []]


@pytest.fixture
def folder(spark, tmp_path):
    a = analysis(spark, TWO, PATHS)
    readers.write_graph(a.nodes, a.components, str(tmp_path / "graph"))
    a.alignments.write.parquet(str(tmp_path / "reads"))
    return tmp_path


def table(path):
    parts = sorted(glob.glob(f"{path}/part-*")) or [str(path)]
    lines = [x for part in parts for x in open(part).read().splitlines()]
    assert lines[0] == "component_name\tposition\tcoverage" and lines[0] not in lines[1:]
    return lines[1:]


def test_table_has_every_base_in_order(spark, tmp_path):
    a = analysis(spark, TWO, PATHS)
    files.write_table(a.runs("node"), a.components, str(tmp_path / "t"))
    depth = [2] * 100 + [1] * 100 + [0] * 100
    assert table(tmp_path / "t") == [f"chr1\t{i}\t{d}" for i, d in enumerate(depth)] + [f"chr2\t{i}\t{int(i < 50)}" for i in range(100)]


def test_table_as_one_file(spark, tmp_path):
    a = analysis(spark, TWO, PATHS)
    for _ in range(2):  # the second one replaces the first
        files.write_table(a.runs("node"), a.components, str(tmp_path / "t.tsv"), one_file=True)
    assert (tmp_path / "t.tsv").is_file() and not (tmp_path / "t.tsv.parts").exists()
    files.write_table(a.runs("node"), a.components, str(tmp_path / "t"))
    assert table(tmp_path / "t.tsv") == table(tmp_path / "t") and len(table(tmp_path / "t.tsv")) == 400


def test_table_of_a_query_keeps_positions(spark, tmp_path):
    a = analysis(spark, TWO, PATHS)
    files.write_table(a.runs("node", a.scope("chr1 99:101")), a.components, str(tmp_path / "t"))
    assert table(tmp_path / "t") == ["chr1\t99\t2", "chr1\t100\t1", "chr1\t101\t1"]


def test_table_refuses_empty_names(spark, tmp_path):
    a = analysis(spark, {"": [(1, 0, 1)]})
    with pytest.raises(ValueError, match="no name"):
        files.write_table(a.runs("node"), a.components, str(tmp_path / "t"))


def test_report(spark):
    a = analysis(spark, TWO, PATHS)
    got = files.report(a, a.runs("node"), "node")
    assert "Mapped reads                   : 3 (75.00%)\n" in got and "Reads mapped to query" not in got
    assert got.index("Global Coverage") < got.index("chr1 Coverage") < got.index("chr2 Coverage")
    assert "Standard deviation             : 0.82\n" in got and "Coefficient of variation       : 0.8165\n" in got and "Maximum coverage               : 2x\n" in got
    scope = a.scope("chr2")
    got = files.report(a, a.runs("base", scope), "base", scope)
    assert "Component: chr2\nCoverage precision: base (per-base-pair)\n" in got and "  Percentage of mapped         : 33.33%\n" in got


def test_inspection(spark):
    a = analysis(spark, TWO)
    got = files.inspection(a)
    assert "chr1" in got and got.splitlines()[-1].split() == ["Total", "-", "400", "5", "-"]
    assert "chr1" not in files.inspection(a, 1) and "Total" not in files.inspection(a, 1)


def test_segments_and_drawing():
    points = [svg.Point(i, None if i in (3, 4) else float(i), None if i in (3, 4) else float(i)) for i in range(8)]
    assert [len(s) for s in svg.segments(points)] == [3, 3]
    for circular in (False, True):
        for base in (None, 10):
            drawn = svg.document([svg.Panel("a<b", points, 8, base)] * 5, (4, 3), circular)
            root = ET.fromstring(drawn)
            assert float(root.get("width")) == 3 * 4 * 96 and "a&lt;b" in drawn
    assert svg.linear_scale(svg.Panel("x", [], 1))[2] == 1.0 and svg.linear_scale(svg.Panel("x", points, 8))[2] == pytest.approx(7.7)
    assert svg.linear_scale(svg.Panel("x", points, 8, 10))[1] == ["0x", "1x", "10x"]
    assert svg.linear_scale(svg.Panel("x", [], 8, 10))[1] == ["0x", "1x"]
    assert svg.circular_scale(svg.Panel("x", points, 8))[2] == 8.0


@pytest.mark.parametrize("extra", [[], ["-q", "chr1 10:-20"], ["-q", "1 90:5", "-c", "c"], ["-c", "circular", "--log"], ["-p", "n", "--max-points", "0", "--smoothing", "0", "--graph-format", "svg"]])
def test_command_line(spark, folder, extra, capsys):
    args = cli.parse_args([str(folder / "graph"), str(folder / "reads"), "-o", str(folder / "out"), *extra])
    cli.run(spark, args)
    assert table(folder / "out" / files.TABLE)
    assert (folder / "out" / files.REPORT).read_text().startswith("=" * 70)
    if args.graph_format == "svg":
        ET.fromstring((folder / "out" / f"{files.GRAPH}.svg").read_text())
    else:
        assert len(np.unique(dots((folder / "out" / f"{files.GRAPH}.png").read_bytes())[0].reshape(-1, 3), axis=0)) >= 4


def dots(data):
    """Of a PNG without filters: its dots and dots a metre, all check sums checked."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, parts = 8, {}
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        parts[kind], at = body, at + 12 + n
    w, h = struct.unpack(">II", parts[b"IHDR"][:8])
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(h, 1 + 3 * w)
    assert not rows[:, 0].any()
    return rows[:, 1:].reshape(h, w, 3), struct.unpack(">II", parts[b"pHYs"][:8])


def test_png_has_the_dots_of_the_shapes():
    points = [svg.Point(i, 2.0, 2.0) for i in range(11)]
    panel = svg.Panel("AB", points, 11)
    got, (metre, _) = dots(png.document([panel], (4, 3), False, "#112233", "#445566", 96))
    assert got.shape == (288, 384, 3) and metre == 3780
    left, right, top, bottom = 55, 384 - 15, 28, 288 - 38
    middle = got[round(bottom - (bottom - top) / 4), (left + right) // 2].tolist()
    assert middle == [0x44, 0x55, 0x66] and [0x11, 0x22, 0x33] in got[top : bottom, (left + right) // 2].tolist()
    # Everything that a larger resolution has is there as well, only finer.
    twice, _ = dots(png.document([panel], (4, 3), False, "#112233", "#445566", 192))
    assert twice.shape == (576, 768, 3)
    share = lambda x: (x == [0x44, 0x55, 0x66]).all(2).mean()
    assert share(got) == pytest.approx(share(twice), abs=0.01) and share(got) > 0.3
    half, _ = dots(png.document([panel], (4, 3), False, "#112233", "#00000080", 96))
    assert half[round(bottom - (bottom - top) / 4), (left + right) // 2].tolist() == [127] * 3
    round_, _ = dots(png.document([panel] * 2, (3, 3), True, "#112233", "#445566", 96))
    assert round_.shape == (288, 576, 3) and share(round_) > 0.1
    assert png._bitmap("1é").shape == (8, 12) and png._bitmap("1")[:7].any() and not png._bitmap("1")[7].any()
    with pytest.raises(ValueError, match="too large"):
        png.document([panel], (400, 300), False, dpi=2400)


def test_plot_request_of_the_command_line(spark, folder):
    for extra, n in ((["-q", "chr1 290:20"], 1), ([], 2)):
        out = folder / f"request{n}"
        cli.run(spark, cli.parse_args([str(folder / "graph"), str(folder / "reads"), "-c", "circular", "-o", str(folder / "out"), "--no-table", "--no-stats", "--dpi", "50", "--plot-request", str(out), *extra]))
        got = requests.decode(out.read_bytes())
        assert len(got.packages) == n and got.dpi == 50 and got.rows == (0 if n == 1 else 1)
        p = got.packages[0]
        assert p.component_name == "chr1" and list(p.local_x) == sorted(p.local_x) and p.local_x[0] == 0 and len(p.plot_y) == len(p.local_x)
        assert (p.crosses_origin, p.full_component, p.query_start, p.query_end) == ((True, False, 290, 20) if n == 1 else (False, True, 0, 299))


def test_command_line_inspection(spark, folder, capsys):
    cli.run(spark, cli.parse_args([str(folder / "graph"), "-i"]))
    assert "Total" in capsys.readouterr().out
    cli.run(spark, cli.parse_args([str(folder / "graph"), "--inspect", "CHR2"]))
    assert "chr2" in capsys.readouterr().out


@pytest.mark.parametrize("extra", [["--no-graph", "--no-stats", "--no-table"], ["--log", "1"], ["--smoothing", "2"], ["-c", "round"], ["-p", "x"], ["--color-line", "red"], ["--fig-size", "7"], ["-q", "a b c"], ["--max-points", "-1"], ["--dpi", "0"], ["-t", "0"], ["-T", "x"], ["--plot-request", "f"]])
def test_command_line_errors(extra):
    with pytest.raises(SystemExit):
        cli.parse_args(["g", "r", *extra])


def test_command_line_defaults():
    got = cli.parse_args(["g", "r"])
    assert (got.coverage_precision, got.component_type, got.smoothing, got.max_points, got.log, got.fig_size) == ("base", "linear", 0.01, 10_000, None, (5.5, 3.5))
    assert cli.parse_args(["g", "r", "-q", "a", "-c", "c"]).fig_size == (7.0, 7.0) and cli.parse_args(["g", "r", "--log"]).log == 10
    assert (got.dpi, got.graph_format, got.worker_threads, cli.parse_args(["g", "r", "-t", "auto", "-T", "1"]).worker_threads) == (300, "png", None, 0)
    with pytest.raises(SystemExit):
        cli.parse_args(["g"])


def test_too_many_panels_stop_before_anything_is_written(spark, tmp_path):
    a = analysis(spark, {f"c{i}": [(i + 1, 0, 2)] for i in range(axes.MOST_PANELS + 1)}, [[1]])
    readers.write_graph(a.nodes, a.components, str(tmp_path / "graph"))
    a.alignments.write.parquet(str(tmp_path / "reads"))
    with pytest.raises(ValueError, match="panels"):
        cli.run(spark, cli.parse_args([str(tmp_path / "graph"), str(tmp_path / "reads"), "-o", str(tmp_path / "out")]))
    assert not (tmp_path / "out").exists()


def test_stream_of_reads(spark, folder):
    a = analysis(spark, TWO, PATHS)
    reads = spark.readStream.schema(a.alignments.schema).parquet(str(folder / "reads"))
    query = stream.start(reads, a.layout(), "depths", str(folder / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    assert {r["node_id"]: r["depth"] for r in spark.sql("SELECT node_id, max(depth) AS depth FROM depths GROUP BY 1").collect()} == {10: 2, 11: 1, 20: 1}
