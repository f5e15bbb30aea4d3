"""Which format claims a file.

Formats hinted by the file's extension are asked first, then all others, each in
registration order; text comes last as the catch-all.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import IO

from . import html, jsonish, odf, ooxml, text, toml, xml, yaml
from .registry import Format, Unit

EXTRACTORS: dict[str, Format] = {f.name: f for f in (*jsonish.FORMATS, yaml.FORMAT, toml.FORMAT, xml.FORMAT, html.FORMAT, *ooxml.FORMATS, *odf.FORMATS, text.FORMAT)}


def register(fmt: Format) -> None:
    """Adds or replaces a format; new ones are asked before text."""
    last = EXTRACTORS.pop("text")
    EXTRACTORS[fmt.name] = fmt
    if fmt.name != "text":
        EXTRACTORS["text"] = last


def claim(path: str, data: bytes) -> str | None:
    """The name of the format of a file, or None."""
    base = os.path.basename(path)
    ext = os.path.splitext(base)[1].lower()
    hinted = [f for f in EXTRACTORS.values() if ext in f.extensions]
    for fmt in (*hinted, *(f for f in EXTRACTORS.values() if ext not in f.extensions)):
        try:
            if fmt.sniff(path, data):
                return fmt.name
        except (ValueError, RecursionError):
            continue
    return None


def open_units(path: str, file: IO[bytes]) -> tuple[str | None, Iterator[Unit]]:
    """The format that claims an open file, and its units. Where the name hints at a
    format that reads line by line, and the first bytes agree, and where the file is a
    package of parts, it is never held whole; any other is read at once, as its format
    needs."""
    base = os.path.basename(path)
    ext = os.path.splitext(base)[1].lower()
    hinted = [f for f in EXTRACTORS.values() if ext in f.extensions]
    head = file.read(text.PEEK)
    file.seek(0)
    if hinted and hinted[0].stream is not None and hinted[0].sniff(path, head):
        return hinted[0].name, hinted[0].stream(file)
    if head[:2] == b"PK" and all(f.zipped for f in hinted):
        zipped = [f for f in EXTRACTORS.values() if f.zipped]
        for fmt in (*hinted, *(f for f in zipped if f not in hinted)):
            if fmt.sniff(path, file):
                return fmt.name, fmt.extract(file)
        file.seek(0)
    data = file.read()
    name = claim(path, data)
    return name, iter(()) if name is None else EXTRACTORS[name].extract(data)
