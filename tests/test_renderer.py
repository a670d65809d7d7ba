import os
from pathlib import Path

import pytest

from depthframe import cli
from depthframe.sinks import files, renderer, requests
from depthframe.sources import readers

from .graphs import TWO, analysis

SCRIPT = """import sys
data = open(sys.argv[-2], "rb").read()
open(sys.argv[-1], "wb").write(b"picture of " + data)
"""


def script(tmp_path, text):
    path = tmp_path / "draw.py"
    path.write_text(text)
    return str(path)


def test_a_script_draws_and_its_folder_goes(tmp_path, monkeypatch):
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path))
    assert renderer.draw(b"abc", script(tmp_path, SCRIPT)) == b"picture of abc"
    assert [p.name for p in tmp_path.iterdir()] == ["draw.py"]


@pytest.mark.parametrize(("text", "said"), [("import sys\nsys.exit('no colours here')", "no colours here"), ("pass", "no message")])
def test_a_failure_keeps_what_there_is(tmp_path, monkeypatch, text, said):
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path))
    with pytest.raises(renderer.RendererError, match=said) as e:
        renderer.draw(b"abc", script(tmp_path, text))
    (folder,) = (p for p in tmp_path.iterdir() if p.is_dir())
    assert str(folder) in str(e.value) and (folder / "request.bin").read_bytes() == b"abc" and (folder / "messages.txt").exists()
    with pytest.raises(renderer.RendererError, match="started"):
        renderer.draw(b"abc", str(tmp_path / "nothing"))


def test_the_environment_names_another_program(tmp_path, monkeypatch):
    monkeypatch.setenv(renderer.VARIABLE, f"{script(tmp_path, SCRIPT)} --fast")
    assert renderer.command("other")[1:] == [str(tmp_path / "draw.py"), "--fast"]
    monkeypatch.delenv(renderer.VARIABLE)
    assert os.path.basename(renderer.command("sh -x")[0]) == "sh"
    with pytest.raises(ValueError, match="renderer"):
        renderer.command(None)


def test_command_line(spark, tmp_path):
    a = analysis(spark, TWO, [[10], [20]])
    readers.write_graph(a.nodes, a.components, str(tmp_path / "graph"))
    a.alignments.write.parquet(str(tmp_path / "reads"))
    args = [str(tmp_path / "graph"), str(tmp_path / "reads"), "-c", "c", "--no-table", "--no-stats", "-o", str(tmp_path / "out"), "--renderer", script(tmp_path, SCRIPT)]
    cli.run(spark, cli.parse_args(args))
    got = Path(tmp_path / "out" / f"{files.GRAPH}.png").read_bytes()
    assert got.startswith(b"picture of ") and len(requests.decode(got.removeprefix(b"picture of ")).packages) == 2
    with pytest.raises(SystemExit):
        cli.parse_args([*args[:2], "--renderer", "x"])
