"""Plain text: one unit a line."""

from __future__ import annotations

import os
from collections.abc import Iterator
from io import BytesIO
from typing import IO

from .registry import ExtractError, Format, Unit

# Extensions taken for text, bytes looked at, the longest line.
EXTENSIONS = (".txt", ".md", ".log", ".csv", ".ini", ".conf", ".cfg", ".go", ".py", ".js", ".ts", ".java", ".c", ".h", ".cpp", ".rs", "")
PEEK = 8192
MAX_LINE = 1 << 20


def sniff(path: str, data: bytes) -> bool:
    """No NUL in the first bytes; office files are never text."""
    return os.path.splitext(path)[1].lower() not in (".docx", ".pptx", ".xlsx") and b"\x00" not in data[:PEEK]


def stream(file: IO[bytes]) -> Iterator[Unit]:
    """Lines without LF and one CR before it. A line of over 1 MiB ends the file with
    an error. ``col`` follows from the match, so none is given here. No more than one
    line is held."""
    n = 0
    while line := file.readline(MAX_LINE + 1):
        n += 1
        line = line.removesuffix(b"\n")
        if len(line) >= MAX_LINE:
            raise ExtractError(f"line {n}: token too long")
        yield "text_line", {"line": n}, line.removesuffix(b"\r").decode("utf-8", "replace")


def extract(data: bytes) -> Iterator[Unit]:
    return stream(BytesIO(data))


FORMAT = Format("text", EXTENSIONS, sniff, extract, stream)
