"""Plots of depth as PNG: the shapes of ``svg`` as dots, at any resolution."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Sequence

import numpy as np

from ..functions import axes
from . import svg

#: Dots of a picture at most: about 600 MB while it is drawn.
MOST_DOTS = 200_000_000

# A font of 5 by 7 dots, from the space on; a letter is five columns, the lowest bit on top.
_FONT = bytes.fromhex(
    "0000000000 00005F0000 0007000700 147F147F14 242A7F2A12 2313086462 3649562050 0008070300 001C224100 0041221C00 2A1C7F1C2A 08083E0808 0080703000 0808080808 0000606000 2010080402"
    "3E5149453E 00427F4000 7249494946 2141494D33 1814127F10 2745454539 3C4A494931 4121110907 3649494936 464949291E 0000140000 0040340000 0008142241 1414141414 0041221408 0201590906"
    "3E415D594E 7C1211127C 7F49494936 3E41414122 7F4141413E 7F49494941 7F09090901 3E41415173 7F0808087F 00417F4100 2040413F01 7F08142241 7F40404040 7F021C027F 7F0408107F 3E4141413E"
    "7F09090906 3E4151215E 7F09192946 2649494932 03017F0103 3F4040403F 1F2040201F 3F4038403F 6314081463 0304780403 6159494D43 007F414141 0204081020 004141417F 0402010204 4040404040"
    "0003070800 2054547840 7F28444438 3844444428 384444287F 3854545418 00087E0902 18A4A49C78 7F08040478 00447D4000 2040403D00 7F10284400 00417F4000 7C04780478 7C08040478 3844444438"
    "FC18242418 18242418FC 7C08040408 4854545424 04043F4424 3C4040207C 1C2040201C 3C4030403C 4428102844 4C9090907C 4464544C44 0008364100 0000770000 0041360800 0201020402"
)


def _bitmap(text: str) -> np.ndarray:
    """The dots of a text, 8 rows by 6 columns for each letter; letters that the font lacks are question marks."""
    codes = [ord(c) - 32 if 32 <= ord(c) < 127 else ord("?") - 32 for c in text]
    columns = np.frombuffer(b"".join(_FONT[5 * c : 5 * c + 5] + b"\0" for c in codes), np.uint8)
    return (columns[None, :] >> np.arange(8, dtype=np.uint8)[:, None] & 1).astype(bool)


class Canvas:
    def __init__(self, width: float, height: float, scale: float) -> None:
        self.scale = scale
        w, h = max(1, round(width * scale)), max(1, round(height * scale))
        if w * h > MOST_DOTS:
            raise ValueError(f"A picture of {w} by {h} dots is too large; use a smaller size or --dpi.")
        self.dots = np.full((h, w, 3), 255, np.uint8)

    def _paint(self, y: np.ndarray, x: np.ndarray, colour: str) -> None:
        h, w, _ = self.dots.shape
        ok = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        self.dots[y[ok], x[ok]] = self._mix(self.dots[y[ok], x[ok]], colour)

    @staticmethod
    def _mix(under: np.ndarray, colour: str) -> np.ndarray:
        alpha = int(colour[7:9], 16) / 255 if len(colour) > 7 else 1.0
        return np.rint(under * (1 - alpha) + np.array(axes.rgb(colour)) * 255 * alpha).astype(np.uint8)

    def area(self, places: Sequence[tuple[float, float]], colour: str) -> None:
        """Every dot whose middle is inside the closed line, row by row."""
        p = np.array(places, float) * self.scale
        (x0, y0), (x1, y1) = p.T, np.roll(p, -1, 0).T
        for row in range(max(0, math.floor(y0.min())), min(len(self.dots), math.ceil(y0.max()) + 1)):
            y = row + 0.5
            cut = (y0 <= y) != (y1 <= y)
            at = np.sort(x0[cut] + (y - y0[cut]) / (y1[cut] - y0[cut]) * (x1[cut] - x0[cut]))
            for a, b in zip(np.ceil(at[::2] - 0.5).astype(int).tolist(), np.ceil(at[1::2] - 0.5).astype(int).tolist(), strict=True):
                part = self.dots[row, max(0, a) : max(0, b)]
                part[:] = self._mix(part, colour)

    def line(self, places: Sequence[tuple[float, float]], colour: str, dashed: bool = False) -> None:
        p = np.array(places, float) * self.scale
        step = np.diff(p, axis=0)
        n = np.maximum(1, np.ceil(np.abs(step).max(1))).astype(int)
        which = np.repeat(np.arange(len(n)), n)
        part = (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) / n[which]
        dots = np.concatenate([p[which] + part[:, None] * step[which], p[-1:]])
        if dashed:
            gone = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(dots, axis=0).T))])
            dots = dots[gone % (6 * self.scale) < 3 * self.scale]
        wide = max(1, round(self.scale))
        x, y = (np.floor(dots - (wide - 1) / 2).astype(int)).T
        offset = np.arange(wide)
        xs = np.broadcast_to(x[:, None, None] + offset[None, :, None], (len(x), wide, wide)).ravel()
        ys = np.broadcast_to(y[:, None, None] + offset[None, None, :], (len(y), wide, wide)).ravel()
        once = np.unique(np.stack([ys, xs], 1), axis=0)
        self._paint(once[:, 0], once[:, 1], colour)

    def text(self, t: svg.Text) -> None:
        dots = _bitmap(t.content)
        dot = t.size * self.scale / 10
        h, w = max(1, round(8 * dot)), max(1, round(dots.shape[1] * dot))
        grown = dots[np.minimum(7, (np.arange(h) / dot).astype(int))][:, np.minimum(dots.shape[1] - 1, (np.arange(w) / dot).astype(int))] if dots.size else np.zeros((0, 0), bool)
        y, x = np.nonzero(grown)
        left = t.x * self.scale - {"start": 0, "middle": w / 2, "end": w}[t.anchor]
        self._paint(y + round(t.y * self.scale - 7 * dot), x + round(left), svg.AXIS)

    def draw(self, shape: svg.Shape) -> None:
        if isinstance(shape, svg.Text):
            self.text(shape)
        elif isinstance(shape, svg.Circle):
            turn = np.linspace(0, 2 * math.pi, 361)
            self.line(np.stack([shape.x + shape.r * np.sin(turn), shape.y - shape.r * np.cos(turn)], 1), shape.stroke, shape.dashed)
        else:
            if shape.fill and len(shape.places) > 2:
                self.area(shape.places, shape.fill)
            if shape.stroke and len(shape.places) > 1:
                self.line(shape.places, shape.stroke, shape.dashed)

    def encoded(self, dpi: int) -> bytes:
        def chunk(kind: bytes, data: bytes) -> bytes:
            return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

        h, w, _ = self.dots.shape
        rows = np.concatenate([np.zeros((h, 1), np.uint8), self.dots.reshape(h, 3 * w)], 1)
        metre = round(dpi / 0.0254)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"pHYs", struct.pack(">IIB", metre, metre, 1)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def document(panels: Sequence[svg.Panel], size: tuple[float, float], circular: bool = False, line: str = svg.LINE, fill: str = svg.FILL, dpi: int = 300) -> bytes:
    """All panels in a grid; size is that of one panel in inches."""
    width, height, shapes = svg.layout(panels, size, circular, line, fill)
    canvas = Canvas(width, height, dpi / svg.DOTS)
    for shape in shapes:
        canvas.draw(shape)
    return canvas.encoded(dpi)
