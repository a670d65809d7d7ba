"""Plots of depth as SVG: linear and circular panels, alone or in a grid.

Panels are made of shapes, which this module writes as SVG and ``png`` as dots.

A panel gets a sampled series, at most the points of a plot, so its rows fit the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from html import escape

from ..functions import axes
from ..operators.query import Scope

LINE, FILL, DOTS = "#1E3A8A", "#93C5FD", 96
AXIS, GRID = "#111827", "#D1D5DB"


@dataclass(frozen=True)
class Path:
    """A line through places, or the area that it closes."""

    places: Sequence[tuple[float, float]]
    stroke: str | None = None
    fill: str | None = None
    dashed: bool = False


@dataclass(frozen=True)
class Circle:
    x: float
    y: float
    r: float
    stroke: str
    dashed: bool = False


@dataclass(frozen=True)
class Text:
    """anchor: which part of the text is at x (start, middle or end)."""

    x: float
    y: float
    content: str
    size: float = 10
    anchor: str = "middle"


Shape = Path | Circle | Text


@dataclass(frozen=True)
class Point:
    """A sample: its position, and the depth as measured and as shown (None: not in the query)."""

    x: float
    y: float | None
    shown: float | None


@dataclass(frozen=True)
class Panel:
    title: str
    points: Sequence[Point]
    length: int
    log_base: int | None = None
    scope: Scope | None = None

    def highest(self) -> float:
        return max((p.y for p in self.points if p.y is not None), default=0.0)


def linear_scale(panel: Panel) -> tuple[list[float], list[str], float]:
    """Places and labels of ticks, and the upper end of the axis: a tenth above the highest value."""
    top = panel.highest()
    if panel.log_base:
        if top <= 0:
            return [0.0, 1.0], ["0x", "1x"], 1.0
        raw, shown, limit = axes.log_ticks(top, panel.log_base)
        return shown, [f"{v:.0f}x" for v in raw], max(limit, 1.0)
    limit = top * 1.1 if top > 0 else 1.0
    ticks = axes.axis_ticks(0.0, limit, 5)
    return ticks, [f"{v:g}x" for v in ticks], limit


def circular_scale(panel: Panel) -> tuple[list[float], list[str], float]:
    top = panel.highest()
    if panel.log_base:
        raw, shown, limit = axes.log_ticks(top, panel.log_base)
        return shown, [f"{v:.0f}x" for v in raw], max(limit, 1.0)
    ticks, limit = axes.coverage_ticks(top)
    return ticks, [f"{v:g}x" for v in ticks], max(limit, 1.0)


def segments(points: Sequence[Point]) -> list[list[Point]]:
    """Neighbouring points with a value; a point without one parts two segments."""
    out: list[list[Point]] = [[]]
    for p in points:
        if p.shown is None:
            out.append([])
        else:
            out[-1].append(p)
    return [s for s in out if s]


def linear_panel(panel: Panel, x: float, y: float, width: float, height: float, line: str = LINE, fill: str = FILL) -> list[Shape]:
    left, right, top, bottom = x + 55, x + width - 15, y + 28, y + height - 38
    ticks, labels, limit = linear_scale(panel)
    first = panel.scope.start if panel.scope else 0
    last = max(first + 1, panel.scope.end if panel.scope else panel.length - 1)
    px = lambda v: left + (v - first) / (last - first) * (right - left)
    py = lambda v: bottom - min(1.0, v / limit) * (bottom - top)
    out: list[Shape] = [Text((left + right) / 2, y + 18, panel.title, 12)]
    for v, label in zip(ticks, labels, strict=True):
        out += [Path([(left, py(v)), (right, py(v))], GRID, dashed=True), Text(left - 5, py(v) + 3, label, 9, "end")]
    for part in segments(panel.points):
        places = [(px(p.x), py(p.shown)) for p in part]
        out += [Path([(places[0][0], bottom), *places, (places[-1][0], bottom)], fill=fill), Path(places, line)]
    out.append(Path([(left, top), (left, bottom), (right, bottom)], AXIS))
    out += [Text(px(v), bottom + 14, f"{v:,.0f}", 9) for v in axes.axis_ticks(first, last, 5)]
    return [*out, Text((left + right) / 2, bottom + 30, "Position (bp)", 10)]


def circular_panel(panel: Panel, x: float, y: float, width: float, height: float, line: str = LINE, fill: str = FILL) -> list[Shape]:
    """Positions run clockwise from the top; depth grows outwards from an inner circle."""
    cx, cy = x + width / 2, y + height / 2 + 10
    outer = min(width, height) / 2 - 30
    inner = outer * 0.55
    ticks, labels, limit = circular_scale(panel)

    def place(position: float, value: float) -> tuple[float, float]:
        turn = 2 * math.pi * position / max(1, panel.length)
        r = inner + min(1.0, value / limit) * (outer - inner)
        return cx + r * math.sin(turn), cy - r * math.cos(turn)

    out: list[Shape] = [Text(cx, y + 16, panel.title, 12), Circle(cx, cy, inner, AXIS)]
    for v, label in zip(ticks, labels, strict=True):
        r = inner + min(1.0, v / limit) * (outer - inner)
        out += [Circle(cx, cy, r, GRID, True), Text(cx + 2, cy - r - 1, label, 7, "start")]
    parts = segments(panel.points)
    full = panel.scope is None or panel.scope.full
    if full and len(parts) == 1 and len(parts[0]) > 2:
        parts = [[*parts[0], parts[0][0]]]  # the circle closes
    for part in parts:
        edge = [place(p.x, p.shown) for p in part]
        base = [place(p.x, 0.0) for p in reversed(part)]
        out += [Path([*edge, *base], fill=fill), Path(edge, line)]
    return out


def layout(panels: Sequence[Panel], size: tuple[float, float], circular: bool = False, line: str = LINE, fill: str = FILL) -> tuple[float, float, list[Shape]]:
    """Width and height in dots, and the shapes of all panels in a grid; size is that of one panel in inches."""
    line, fill = axes.parse_colour(line), axes.parse_colour(fill)
    rows, columns = axes.panel_grid(len(panels))
    width, height = size[0] * DOTS, size[1] * DOTS
    draw = circular_panel if circular else linear_panel
    return width * columns, height * rows, [s for i, p in enumerate(panels) for s in draw(p, (i % columns) * width, (i // columns) * height, width, height, line, fill)]


def _drawn(shape: Shape) -> str:
    if isinstance(shape, Text):
        return f'<text x="{shape.x:.2f}" y="{shape.y:.2f}" font-family="sans-serif" font-size="{shape.size:g}" text-anchor="{shape.anchor}">{escape(shape.content)}</text>'
    dash = ' stroke-dasharray="3,3"' if shape.dashed else ""
    if isinstance(shape, Circle):
        return f'<circle cx="{shape.x:.2f}" cy="{shape.y:.2f}" r="{shape.r:.2f}" fill="none" stroke="{shape.stroke}"{dash}/>'
    places = "M" + "L".join(f"{x:.2f},{y:.2f}" for x, y in shape.places)
    return f'<path d="{places}{"Z" if shape.fill else ""}" fill="{shape.fill or "none"}" stroke="{shape.stroke or "none"}"{dash}/>'


def document(panels: Sequence[Panel], size: tuple[float, float], circular: bool = False, line: str = LINE, fill: str = FILL) -> str:
    width, height, shapes = layout(panels, size, circular, line, fill)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}"><rect width="100%" height="100%" fill="white"/>{"".join(map(_drawn, shapes))}</svg>\n'
