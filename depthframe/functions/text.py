"""Numbers and rows as text, for reports."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

PRECISIONS = {"base": "base (per-base-pair)", "node": "node (whole-node resolution)"}
WIDTH = 70


def grouped(n: int) -> str:
    return f"{n:,}"


def plain_integer(value: float) -> str:
    """Rounded, halves away from 0."""
    return str(int(math.copysign(math.floor(abs(value) + 0.5), value)) if value else 0)


def line(label: str, value: str) -> str:
    return f"{label:<30} : {value}\n"


def stats_section(title: str, s: Mapping) -> str:
    two = lambda v: f"{v:.2f}"
    rows = [
        ("Indexed positions", grouped(s["region_length"])), ("Covered positions", grouped(s["covered_positions"])),
        ("Breadth of coverage", two(s["breadth"]) + "%"), ("Mean coverage", two(s["mean"]) + "x"), ("Median coverage", two(s["median"]) + "x"),
        ("Standard deviation", two(s["stddev"])), ("Coefficient of variation", f"{s['cv']:.4f}"),
        ("Q1", two(s["q1"]) + "x"), ("Q3", two(s["q3"]) + "x"), ("Minimum coverage", f"{s['min']}x"), ("Maximum coverage", f"{s['max']}x"),
    ]
    return f"[ {title} ]\n{'-' * WIDTH}\n" + "".join(line(*r) for r in rows)


def check_mapping(m: Mapping) -> None:
    if m["mapped"] + m["unmapped"] != m["total"] or m["mapped_to_query"] > m["mapped"] or min(m["mapped"], m["unmapped"]) < 0:
        raise ValueError("The counts of reads do not add up.")


def report(mapping: Mapping, precision: str, sections: Sequence[tuple[str, Mapping]], component: str | None = None) -> str:
    """The text of a report; with a component also what was mapped to the query."""
    check_mapping(mapping)
    bar = "=" * WIDTH
    share = lambda n, whole: f"{100 * n / whole if whole else 0:.2f}%"
    out = f"{bar}\nCOVERAGE REPORT\n" + (f"Component: {component}\n" if component is not None else "") + f"Coverage precision: {PRECISIONS[precision]}\n{bar}\n\n"
    out += f"[ Mapping Statistics ]\n{'-' * WIDTH}\n" + line("Total reads", grouped(mapping["total"]))
    out += line("Mapped reads", f"{grouped(mapping['mapped'])} ({share(mapping['mapped'], mapping['total'])})")
    if component is not None:
        out += line("Reads mapped to query", grouped(mapping["mapped_to_query"]))
        out += line("  Percentage of total", share(mapping["mapped_to_query"], mapping["total"]))
        out += line("  Percentage of mapped", share(mapping["mapped_to_query"], mapping["mapped"]))
    out += line("Unmapped reads", f"{grouped(mapping['unmapped'])} ({share(mapping['unmapped'], mapping['total'])})") + "\n"
    return out + "".join(stats_section(title, s) for title, s in sections)


def inspection(rows: Sequence[Mapping], total: Mapping | None = None) -> str:
    """The table of an inspection; rows have cid, short_name and the texts of numbers."""
    form = lambda a, b, c, d, e: f"{a:<8}{b:<15}{c:>18}{d:>15}{e:>28}\n"
    rule = "-" * 84 + "\n"
    out = form("CID", "Name", "Length (bp)", "Nodes", "Node ids") + rule
    out += "".join(form(str(r["cid"]), r["short_name"], r["length_text"], r["nodes_text"], r["range_text"]) for r in rows)
    return out + (rule + form("Total", "-", grouped(total["length_bp"]), grouped(total["nb_nodes"]), "-") if total else "")
