"""Axes of plots: ticks, grids, colours. Plain numbers, one call for a panel."""

from __future__ import annotations

import math
import re

# Steps that read well, times a power of ten.
STEPS = (1.0, 2.0, 2.5, 3.0, 4.0, 5.0, 10.0)
# Rows and columns of a grid of 1 to 9 panels.
GRIDS = ((1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (2, 3), (3, 3), (2, 4), (3, 3))
MOST_PANELS = 30


def nice_step(raw: float) -> float:
    """The smallest step that reads well and is not below raw."""
    power = 10.0 ** math.floor(math.log10(raw))
    return next((s for s in STEPS if s >= raw / power), STEPS[-1]) * power


def coverage_ticks(highest: float, target: int = 4) -> tuple[list[float], float]:
    """Ticks from one step up to the limit, and the limit, which is not below highest."""
    if not math.isfinite(highest):
        raise ValueError("The highest coverage must be finite.")
    if target < 2:
        raise ValueError("At least two ticks are needed.")
    if highest <= 0:
        return [1.0], 1.0
    step = nice_step(highest / target)
    n = math.ceil(highest / step)
    return [step * k for k in range(1, n + 1)], step * n


def log_value(value: float, base: int) -> float:
    if base <= 1:
        raise ValueError("The base must be greater than 1.")
    if value < 0:
        raise ValueError("Coverage can't be negative.")
    return value if value <= 1 else 1 + math.log(value) / math.log(base)


def log_ticks(highest: float, base: int) -> tuple[list[float], list[float], float]:
    """Raw ticks 0, 1, base, ... that reach highest, their places, and the place of the last."""
    if base <= 1:
        raise ValueError("The base must be greater than 1.")
    if highest <= 0:
        return [0.0], [0.0], 1.0
    top = max(0, math.ceil(math.log(highest) / math.log(base)))
    raw = [0.0, *(float(base) ** k for k in range(top + 1))]
    shown = [log_value(v, base) for v in raw]
    return raw, shown, shown[-1]


def axis_ticks(low: float, high: float, target: int) -> list[float]:
    """Multiples of a step that reads well, within low to high."""
    if not high > low or target == 0:
        return [low]
    step = nice_step((high - low) / target)
    first = math.ceil(low / step)
    last = math.floor(high / step + 1e-9)
    return [k * step for k in range(first, last + 1)] or [low]


def panel_grid(n: int) -> tuple[int, int]:
    """Rows and columns for n panels."""
    if not 1 <= n <= MOST_PANELS:
        raise ValueError(f"A graph of all components has 1 to {MOST_PANELS} panels, not {n}.")
    if n <= len(GRIDS):
        return GRIDS[n - 1]
    columns = math.isqrt(n - 1) + 1
    return -(-n // columns), columns


def parse_colour(text: str) -> str:
    """A colour as #RRGGBB or #RRGGBBAA in capitals; shorthand digits are doubled."""
    text = text.strip()
    if not re.fullmatch(r"#(?:[0-9A-Fa-f]{3,4}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})", text):
        raise ValueError("A colour must be hexadecimal, for example #1E3A8A.")
    digits = text[1:].upper()
    return "#" + ("".join(c * 2 for c in digits) if len(digits) < 6 else digits)


def rgb(colour: str) -> tuple[float, float, float]:
    digits = parse_colour(colour)[1:]
    return tuple(int(digits[i : i + 2], 16) / 255 for i in (0, 2, 4))


def parse_size(text: str) -> tuple[float, float]:
    """WIDTHxHEIGHT in inches."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*[xX×]\s*(\d+(?:\.\d+)?)\s*", text)
    if not m or not all(float(v) > 0 for v in m.groups()):
        raise ValueError("A figure size must be WIDTHxHEIGHT, both above 0, for example 7x4.5.")
    return float(m[1]), float(m[2])


def default_size(query: bool, circular: bool) -> tuple[float, float]:
    # Fixed values.
    return {(False, False): (5.5, 3.5), (False, True): (4.0, 4.0), (True, False): (7.0, 4.5), (True, True): (7.0, 7.0)}[query, circular]
