"""Plot requests drawn by another program: it gets the path of the request and that of the picture to write."""

from __future__ import annotations

import os
import shlex
import shutil
import subprocess
import sys
import tempfile
from pathlib import Path

#: Names a program, with arguments, that draws requests; overrides the one of the command line.
VARIABLE = "DEPTHFRAME_RENDERER"


class RendererError(RuntimeError):
    """The program failed; its request and messages are kept."""


def command(given: str | None) -> list[str]:
    """The program as words: Python scripts run under this Python."""
    words = shlex.split(os.environ.get(VARIABLE) or given or "")
    if not words:
        raise ValueError("No renderer is named.")
    found = words[0] if os.path.sep in words[0] else shutil.which(words[0]) or words[0]
    if found.endswith(".py"):
        return [sys.executable, found, *words[1:]]
    return [found, *words[1:]]


def draw(request: bytes, given: str | None = None, suffix: str = ".png") -> bytes:
    """The picture that the program writes. Its folder goes when it succeeds and stays, named in the error, when it does not."""
    words = command(given)
    folder = Path(tempfile.mkdtemp(prefix="depthframe-plot-"))
    source, target = folder / "request.bin", folder / f"picture{suffix}"
    source.write_bytes(request)
    try:
        done = subprocess.run([*words, str(source), str(target)], capture_output=True, text=True)
    except OSError as e:
        raise RendererError(f"The renderer {words[0]} can't be started: {e}. Its request is in {folder}.") from None
    if done.returncode or not target.is_file() or not target.stat().st_size:
        (folder / "messages.txt").write_text(done.stdout + done.stderr)
        last = (done.stderr.strip().splitlines() or ["no message"])[-1]
        raise RendererError(f"The renderer {words[0]} ended with {done.returncode}: {last}. Its request and messages are in {folder}.")
    picture = target.read_bytes()
    shutil.rmtree(folder)
    return picture
