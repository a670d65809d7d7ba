"""Small graphs and reads for tests."""

from depthframe.plans.engine import Analysis
from depthframe.sources import schema

THREE = {"chrX": [(10, 0, 100), (11, 1, 100), (12, 2, 100)]}
TWO = {"chr1": [(10, 0, 100), (11, 1, 100), (12, 2, 100)], "chr2": [(20, 0, 50), (21, 1, 50)]}
PERMUTED = {"c0": [(10, 2, 30), (11, 0, 10), (12, 1, 20)]}


def edits(text):
    """M5 D2 I3 X1 as edits."""
    out = []
    for part in text.split():
        kind, n = part[0], int(part[1:])
        out.append({"from_length": 0 if kind == "I" else n, "to_length": 0 if kind == "D" else n, "sequence": "A" * n if kind in "IX" else ""})
    return out


def mapping(node, offset=0, reverse=False, walk=None):
    return {"node_id": node, "offset": offset, "is_reverse": reverse, "edits": edits(walk) if walk else []}


def analysis(spark, graph, paths=()):
    components = spark.createDataFrame([(cid, name) for cid, name in enumerate(graph)], schema.COMPONENTS)
    nodes = spark.createDataFrame([(cid, *n) for cid, ns in enumerate(graph.values()) for n in ns], schema.NODES)
    reads = spark.createDataFrame([(i, [m if isinstance(m, dict) else mapping(m) for m in p]) for i, p in enumerate(paths)], schema.ALIGNMENTS)
    return Analysis(nodes, components, reads)


def depths(runs, cid=0):
    out = []
    for r in sorted((r for r in runs.collect() if r["cid"] == cid), key=lambda r: r["start"]):
        out += [r["depth"]] * (r["end"] - r["start"])
    return out
