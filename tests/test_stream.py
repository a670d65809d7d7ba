import gzip
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from depthframe import cli
from depthframe.plans.engine import Analysis
from depthframe.sinks import files
from depthframe.sources import readers, stream

from .graphs import TWO, analysis, depths, mapping


def number(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def part(field, value):
    """A field of a message: a number, or bytes."""
    return number(field << 3) + number(value) if isinstance(value, int) else number(field << 3 | 2) + number(len(value)) + value


def message(path):
    maps = b""
    for rank, m in enumerate(path):
        position = part(1, m["node_id"]) + part(2, m["offset"]) + (part(4, 1) if m["is_reverse"] else b"") + part(5, b"chr")
        edits = b"".join(part(2, part(1, e["from_length"]) + part(2, e["to_length"]) + (part(3, e["sequence"].encode()) if e["sequence"] else b"")) for e in m["edits"])
        maps += part(2, part(1, position) + edits + part(5, rank))
    return part(1, b"ACGT") + part(2, part(1, b"name") + maps) + part(3, b"read") + number(9 << 3 | 1) + b"\0" * 8


def group(items, tag=b"GAM"):
    items = [tag, *items] if tag else list(items)
    return number(len(items)) + b"".join(number(len(x)) + x for x in items)


PATHS = [[mapping(10, 3, False, "M50 D2 M45")], [mapping(10, 0, True, "M100"), mapping(11, 0, False, "M40 I3 M60")], [], [mapping(20)], [mapping(0), mapping(-5)]]


def test_reads_what_was_written(spark, tmp_path):
    whole = group(map(message, PATHS[:2])) + group([b"\x0a\x01x"], b"VG") + group([]) + group(map(message, PATHS[2:]), None)
    (tmp_path / "a.gam").write_bytes(gzip.compress(whole[:40]) + gzip.compress(whole[40:]))
    (tmp_path / "b.gam").write_bytes(group([message(PATHS[0]), b"\x12\x05ab", message(PATHS[1])[:-3], b"\x07", message(PATHS[3])]))
    df = readers.read_alignments(spark, str(tmp_path / "*.gam"), "stream")
    rows = {r["read_id"]: [m.asDict(recursive=True) for m in r["path"]] for r in df.collect()}
    assert [rows[k] for k in sorted(rows)] == [*PATHS, PATHS[0], PATHS[3]]
    assert sorted(rows) == [0, 1, 2, 3, 4, 1 << 40, (1 << 40) + 1]


def test_counts_and_depths_are_those_of_the_tables(spark, tmp_path):
    a = analysis(spark, TWO, PATHS)
    (tmp_path / "r.gam").write_bytes(gzip.compress(group(map(message, PATHS))))
    b = Analysis(a.nodes, a.components, readers.read_alignments(spark, f"file://{tmp_path}/r.gam", "stream"))
    assert a.mapping_stats().first() == b.mapping_stats().first() and a.mapping_stats().first()["mapped"] == 3
    assert depths(a.runs()) == depths(b.runs()) and depths(a.runs(), 1) == depths(b.runs(), 1)


def test_command_line_on_a_stream(spark, tmp_path):
    a = analysis(spark, TWO, PATHS)
    readers.write_graph(a.nodes, a.components, str(tmp_path / "graph"))
    (tmp_path / "r.gam").write_bytes(group(map(message, PATHS)))
    cli.run(spark, cli.parse_args([str(tmp_path / "graph"), str(tmp_path / "r.gam"), "--alignments-format", "stream", "--no-graph", "--one-file", "-o", str(tmp_path / "out")]))
    assert len((tmp_path / "out" / files.TABLE).read_text().splitlines()) == 401
    assert "Total reads" in (tmp_path / "out" / files.REPORT).read_text()


@settings(max_examples=200, deadline=None)
@given(st.integers(-(1 << 63), (1 << 63) - 1), st.integers(0, 1 << 40), st.booleans(), st.lists(st.tuples(st.integers(-(1 << 31), (1 << 31) - 1), st.integers(0, 99), st.text(max_size=5)), max_size=4))
def test_any_numbers_and_texts(node, offset, reverse, edits):
    path = [{"node_id": node, "offset": offset, "is_reverse": reverse, "edits": [{"from_length": f, "to_length": t, "sequence": s} for f, t, s in edits]}]
    assert stream.path_of(message(path)) == path


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=30))
def test_any_bytes_are_a_path_or_malformed(data):
    try:
        assert isinstance(stream.path_of(data), list)
    except stream.Malformed:
        pass


@pytest.mark.parametrize("cut", [1, 5, 20])
def test_a_file_that_ends_too_early_is_an_error(cut):
    data = group([message(PATHS[0])])
    with pytest.raises(EOFError):
        list(stream.messages(io.BytesIO(data[:-cut])))
    assert list(stream.messages(io.BytesIO(data))) == [message(PATHS[0])]


def test_no_file(spark, tmp_path):
    with pytest.raises(Exception, match="No file"):
        readers.read_alignments(spark, str(tmp_path / "*.gam"), "stream").count()
