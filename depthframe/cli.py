"""Command line: depth tables, reports and graphs from a graph and alignments.

    python -m depthframe.cli GRAPH [ALIGNMENTS] [options]

GRAPH is a folder with the tables ``components`` and ``nodes``; ALIGNMENTS is a table.
"""

from __future__ import annotations

import argparse
import logging
import math
import os
import sys
import time
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import axes
from .operators import query, series
from .plans.engine import Analysis
from .sinks import files, png, renderer, requests, svg
from .sources import readers, schema

log = logging.getLogger("depthframe")


@contextmanager
def step(name: str):
    began = time.monotonic()
    log.info("%s ...", name)
    try:
        yield
    except Exception:
        log.error("%s failed after %.2f s", name, time.monotonic() - began)
        raise
    log.info("%s: %.2f s", name, time.monotonic() - began)


def _choice(*names: str):
    def parse(text: str) -> str:
        found = [n for n in names if text.strip().lower() in (n, n[0])]
        if not found:
            raise argparse.ArgumentTypeError(f"must be one of {', '.join(f'{n}/{n[0]}' for n in names)}")
        return found[0]

    return parse


def _number(kind, low, high):
    def parse(text: str):
        value = kind(text)
        if not (math.isfinite(value) and low <= value <= high):
            raise argparse.ArgumentTypeError(f"must be between {low} and {high}")
        return value

    return parse


def _valid(parse):
    def checked(text: str):
        try:
            return parse(text)
        except ValueError as e:
            raise argparse.ArgumentTypeError(str(e)) from None

    return checked


def _threads(text: str) -> int:
    """A number of threads, 0 for auto; no more than there are."""
    if text.strip().lower() == "auto":
        return 0
    return min(_number(int, 1, 1 << 31)(text), os.cpu_count() or 1)


def parse_args(args: Sequence[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser("depthframe", description="Depth of coverage over a linearized graph.")
    p.add_argument("graph", help="folder with the tables components and nodes")
    p.add_argument("alignments", nargs="?", help="table of alignments; needed unless --inspect is given")
    p.add_argument("-q", "--query", type=_valid(query.parse_query), help="COMPONENT or 'COMPONENT START:END', by name or number, positions from 0, both ends included")
    p.add_argument("-c", "--component-type", type=_choice("linear", "circular"), default="linear")
    p.add_argument("-p", "--coverage-precision", type=_choice("base", "node"), default="base")
    p.add_argument("-i", "--inspect", nargs="?", const="", help="show all components, or one, and end")
    p.add_argument("-o", "--output", default=".", help="folder for the results")
    p.add_argument("--format", choices=("parquet", "json"), default="parquet", help="of the tables")
    p.add_argument("--alignments-format", choices=("parquet", "json", "stream"), help="of the alignments, if another one; stream: the binary files of aligners")
    p.add_argument("--no-graph", action="store_true")
    p.add_argument("--no-stats", action="store_true")
    p.add_argument("--no-table", action="store_true")
    p.add_argument("--one-file", action="store_true", help="write the table as one file instead of a folder of parts")
    p.add_argument("--log", nargs="?", type=_number(int, 2, 10_000), const=10, metavar="BASE")
    p.add_argument("--smoothing", type=_number(float, 0.0, 1.0), default=series.SMOOTHING)
    p.add_argument("--max-points", "--max-point", type=_number(int, 0, 1 << 62), default=series.MOST_POINTS, help="0: no limit")
    p.add_argument("--fig-size", type=_valid(axes.parse_size))
    p.add_argument("--dpi", type=_number(int, 1, 2400), default=300, help="of a graph as PNG")
    p.add_argument("--graph-format", choices=("png", "svg"), default="png")
    p.add_argument("--plot-request", metavar="FILE", help="write a circular graph as a binary plot request as well")
    p.add_argument("--renderer", metavar="COMMAND", help=f"program that draws circular graphs from a plot request: COMMAND REQUEST PICTURE; {renderer.VARIABLE} overrides it")
    p.add_argument("-t", "--worker-threads", type=_threads, metavar="N", help="threads of a local session, or auto")
    p.add_argument("-T", "--decompression-threads", type=_threads, metavar="N", help="taken for scripts that give it: tasks decompress what they read")
    p.add_argument("--color-line", type=_valid(axes.parse_colour), default=svg.LINE)
    p.add_argument("--color-filling", type=_valid(axes.parse_colour), default=svg.FILL)
    got = p.parse_args(args)
    if got.inspect is None and got.alignments is None:
        p.error("alignments are needed unless --inspect is given")
    if got.no_graph and got.no_stats and got.no_table:
        p.error("all outputs are disabled")
    if got.renderer and (got.component_type != "circular" or got.graph_format != "png"):
        p.error("a renderer draws circular graphs as PNG")
    if got.plot_request and got.component_type != "circular":
        p.error("a plot request is for circular components")
    if got.fig_size is None:
        got.fig_size = axes.default_size(got.query is not None, got.component_type == "circular")
    return got


def _points(rows, shift: int = 0, place: str = "x") -> list[svg.Point]:
    return [svg.Point(r[place] + shift, r["y"], r["plot_y"]) for r in sorted(rows, key=lambda r: r["x"])]


def _panels(a: Analysis, runs, args: argparse.Namespace, scope: query.Scope | None) -> list[svg.Panel]:
    circular = args.component_type == "circular"
    panels = []
    if scope is not None:
        if circular:
            rows = series.circular_series(a.component_runs(args.coverage_precision, scope), scope, args.smoothing, args.max_points, args.log).collect()
            panels = [svg.Panel(scope.name, _points(rows, place="position"), scope.length, args.log, scope)]
        else:
            part = runs.select("cid", (F.col("start") - scope.start).alias("start"), (F.col("end") - scope.start).alias("end"), "depth")
            lengths = runs.sparkSession.range(1).select(F.lit(scope.cid).cast("int").alias("cid"), F.lit(scope.traversal_length()).cast("long").alias("length"))
            panels = [svg.Panel(scope.name, _points(series.linear_series(part, lengths, args.smoothing, args.max_points, args.log).collect(), scope.start), scope.length, args.log, scope)]
    else:
        lengths = a.lengths()
        names = {r["cid"]: (r["name"], r["length"]) for r in a.components.join(lengths, "cid").collect()}
        found = series.smooth(runs, lengths, args.smoothing, args.max_points, circular)
        found = found.withColumn("plot_y", series.log_scale(F.col("y"), args.log) if args.log else F.col("y"))
        by: dict[int, list] = {}
        for r in found.collect():
            by.setdefault(r["cid"], []).append(r)
        panels = [svg.Panel(names[cid][0], _points(by[cid]), names[cid][1], args.log) for cid in sorted(by)]
    return panels


def _request(panels: Sequence[svg.Panel], args: argparse.Namespace) -> requests.Request:
    """The panels of a circular graph for renderers that read plot requests."""
    packages = []
    for p in panels:
        raw, _, limit = svg.circular_scale(p)
        values = axes.log_ticks(p.highest(), args.log)[0] if args.log else raw
        start, end = (p.scope.start, p.scope.end) if p.scope else (0, p.length - 1)
        local = [int(x.x - start) if x.x >= start else int(x.x - start + p.length) for x in p.points]
        full = p.scope is None or p.scope.full
        packages.append(requests.Package(p.title, p.length, start, end, full, bool(p.scope and p.scope.crosses_origin), True, bool(args.log), args.log or 0, limit, local, [x.shown for x in p.points], values, raw))
    width, height = args.fig_size
    if len(panels) == 1:
        return requests.Request(args.dpi, width, height, args.color_line, args.color_filling, packages)
    rows, columns = axes.panel_grid(len(panels))
    return requests.Request(args.dpi, width * columns, height * rows, args.color_line, args.color_filling, packages, width, height, rows, columns)


def _draw(spark: SparkSession, panels: Sequence[svg.Panel], args: argparse.Namespace) -> None:
    circular, look = args.component_type == "circular", (args.color_line, args.color_filling)
    if args.renderer:
        files.write_bytes(spark, renderer.draw(requests.encode(_request(panels, args)), args.renderer), f"{args.output}/{files.GRAPH}.png")
    elif args.graph_format == "svg":
        files.write_text(spark, svg.document(panels, args.fig_size, circular, *look), f"{args.output}/{files.GRAPH}.svg")
    else:
        files.write_bytes(spark, png.document(panels, args.fig_size, circular, *look, args.dpi), f"{args.output}/{files.GRAPH}.png")
    if args.plot_request:
        files.write_bytes(spark, requests.encode(_request(panels, args)), args.plot_request)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    components = readers.read_components(spark, f"{args.graph}/components", args.format)
    nodes = readers.read_nodes(spark, f"{args.graph}/nodes", args.format)
    if args.inspect is not None:
        a = Analysis(nodes, components, spark.createDataFrame([], schema.ALIGNMENTS))
        print(files.inspection(a, query.resolve_component(components, args.inspect)[0] if args.inspect else None), end="")
        return
    with step("Checking the graph"):
        schema.validate_graph(nodes, components)
        if not args.no_graph and args.query is None:
            axes.panel_grid(components.count())  # before any result is written
    a = Analysis(nodes, components, readers.read_alignments(spark, args.alignments, args.alignments_format or args.format))
    scope = None
    if args.query is not None:
        name, asked = args.query
        cid, name = query.resolve_component(components, name)
        scope = query.resolve_scope(nodes, cid, name, asked, args.component_type == "circular")
    runs = a.runs(args.coverage_precision, scope).persist()
    try:
        if not args.no_table:
            with step("Writing the table"):
                files.write_table(runs, components, f"{args.output}/{files.TABLE}", args.one_file)
        if not args.no_stats:
            with step("Writing the report"):
                files.write_text(spark, files.report(a, runs, args.coverage_precision, scope), f"{args.output}/{files.REPORT}")
        if not args.no_graph:
            with step("Drawing the graph"):
                _draw(spark, _panels(a, runs, args, scope), args)
    finally:
        runs.unpersist()


def main(args: Sequence[str] | None = None) -> int:
    parsed = parse_args(sys.argv[1:] if args is None else args)
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    builder = SparkSession.builder.appName("depthframe")
    if parsed.worker_threads is not None:
        builder = builder.master(f"local[{parsed.worker_threads or '*'}]")
    spark = builder.getOrCreate()
    try:
        run(spark, parsed)
    except Exception as e:  # the text is for the user
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
