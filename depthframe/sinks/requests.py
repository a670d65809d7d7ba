"""Circular plots as binary requests, for renderers that read them.

Little-endian. Fixed values: the signature CXCP, version 2, mode 0 for one package and 1 for
a grid of them; texts and arrays come after their lengths.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence
from dataclasses import dataclass, field, fields

MAGIC, VERSION = b"CXCP", 2
MOST_TEXT = 0xFFFF


@dataclass
class Package:
    """One component or query, ready to be drawn; a depth that is not a number is a gap."""

    component_name: str
    compo_length: int
    query_start: int
    query_end: int
    full_component: bool = False
    crosses_origin: bool = False
    visible: bool = True
    logarithmic: bool = False
    log_base: int = 0
    y_upper_limit: float = 1.0
    local_x: Sequence[int] = ()
    plot_y: Sequence[float] = ()
    tick_raw_values: Sequence[float] = ()
    tick_display_values: Sequence[float] = ()


@dataclass
class Request:
    """A grid of packages, or a single one (rows is 0 then)."""

    dpi: int
    fig_width: float
    fig_height: float
    line_color: str
    fill_color: str
    packages: list[Package] = field(default_factory=list)
    subplot_width: float = 0.0
    subplot_height: float = 0.0
    rows: int = 0
    columns: int = 0


#: Of the single values of a package, in the order of its fields: names and codes.
_SINGLE = tuple(zip([f.name for f in fields(Package)][1:10], "QQQ????id", strict=True))


def _text(value: str) -> bytes:
    raw = value.encode()
    if len(raw) > MOST_TEXT:
        raise ValueError(f"A text of a request has at most {MOST_TEXT} bytes.")
    return struct.pack("<H", len(raw)) + raw


def _array(code: str, values: Sequence) -> bytes:
    return struct.pack(f"<{len(values)}{code}", *values)


def _package(p: Package) -> bytes:
    if len(p.local_x) != len(p.plot_y) or len(p.tick_raw_values) != len(p.tick_display_values):
        raise ValueError("Points and ticks need as many places as values.")
    out = _text(p.component_name) + struct.pack("<" + "".join(c for _, c in _SINGLE), *(getattr(p, n) for n, _ in _SINGLE))
    out += struct.pack("<Q", len(p.local_x)) + _array("Q", p.local_x) + _array("d", [math.nan if y is None else y for y in p.plot_y])
    return out + struct.pack("<I", len(p.tick_raw_values)) + _array("d", p.tick_raw_values) + _array("d", p.tick_display_values)


def encode(r: Request) -> bytes:
    grid = r.rows > 0
    if not grid and len(r.packages) != 1:
        raise ValueError("A request without a grid has one package.")
    out = MAGIC + struct.pack("<BBIdd", VERSION, int(grid), r.dpi, r.fig_width, r.fig_height) + _text(r.line_color) + _text(r.fill_color)
    if grid:
        out += struct.pack("<ddIII", r.subplot_width, r.subplot_height, r.rows, r.columns, len(r.packages))
    return out + b"".join(map(_package, r.packages))


class _Tape:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, codes: str) -> tuple:
        size = struct.calcsize("<" + codes)
        if self.at + size > len(self.data):
            raise ValueError("The request ends too early.")
        self.at += size
        return struct.unpack("<" + codes, self.data[self.at - size : self.at])

    def text(self) -> str:
        (n,) = self.take("H")
        return self.take(f"{n}s")[0].decode()

    def package(self) -> Package:
        name = self.text()
        single = dict(zip((n for n, _ in _SINGLE), self.take("".join(c for _, c in _SINGLE)), strict=True))
        (n,) = self.take("Q")
        x, y = self.take(f"{n}Q"), self.take(f"{n}d")
        (k,) = self.take("I")
        return Package(name, **single, local_x=x, plot_y=y, tick_raw_values=self.take(f"{k}d"), tick_display_values=self.take(f"{k}d"))


def decode(data: bytes) -> Request:
    tape = _Tape(data)
    if data[:4] != MAGIC:
        raise ValueError("This is not a plot request.")
    tape.at = 4
    version, mode, dpi, width, height = tape.take("BBIdd")
    if version != VERSION:
        raise ValueError(f"Version {version} of plot requests is not known.")
    if mode not in (0, 1):
        raise ValueError(f"Mode {mode} of plot requests is not known.")
    r = Request(dpi, width, height, tape.text(), tape.text())
    n = 1
    if mode:
        r.subplot_width, r.subplot_height, r.rows, r.columns, n = tape.take("ddIII")
    r.packages = [tape.package() for _ in range(n)]
    return r
