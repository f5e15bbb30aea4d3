"""Namespace-aware XML events from bytes, and zip parts."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from typing import IO
from xml.parsers import expat

from .registry import ExtractError

#: ("start", namespace, local name, attributes by local name), ("end", namespace,
#: local name, None) or ("text", "", characters, None).
Event = tuple[str, str, str, dict | None]
_STEP = 1 << 16


def _split(name: str) -> tuple[str, str]:
    space, _, local = name.rpartition("\n")
    return space, local


def xml_events(data: bytes | IO[bytes], part: str) -> Iterator[Event]:
    """Events in order, read in steps; an error comes after the events before it."""
    source = io.BytesIO(data) if isinstance(data, bytes) else data
    queue: list[Event] = []
    parser = expat.ParserCreate(namespace_separator="\n")
    parser.buffer_text = True
    parser.StartElementHandler = lambda n, a: queue.append(("start", *_split(n), {_split(k)[1]: v for k, v in a.items()}))
    parser.EndElementHandler = lambda n: queue.append(("end", *_split(n), None))
    parser.CharacterDataHandler = lambda t: queue.append(("text", "", t, None))
    more = True
    while more:
        error = None
        try:
            step = source.read(_STEP)
            more = bool(step)
            parser.Parse(step, not more)
        except expat.ExpatError as e:
            error = ExtractError(f"decoding {part}: {e}")
        except (zipfile.BadZipFile, OSError, EOFError, zlib.error) as e:
            error = ExtractError(f"reading {part}: {e}")
        yield from queue
        queue.clear()
        if error:
            raise error


class Package:
    """Parts of a zip file by name. From an open file, nothing but the part in hand is
    held, and of that one step."""

    def __init__(self, data: bytes | IO[bytes]) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data)
        except (zipfile.BadZipFile, OSError, ValueError) as e:
            raise ExtractError(f"not a zip file: {e}") from None
        self.names = set(self.zip.namelist())

    def events(self, name: str) -> Iterator[Event]:
        try:
            part = self.zip.open(name)
        except Exception as e:
            raise ExtractError(f"opening {name}: {e}") from None
        with part:
            yield from xml_events(part, name)


def has_parts(data: bytes | IO[bytes], *names: str) -> bool:
    if isinstance(data, bytes) and data[:2] != b"PK":
        return False
    try:
        return set(names) <= Package(data).names
    except ExtractError:
        return False
