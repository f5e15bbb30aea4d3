"""What a format plugs in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import IO

Unit = tuple[str, dict, str]


class ExtractError(ValueError):
    """A document that cannot be read to its end."""


@dataclass(frozen=True)
class Format:
    """``sniff(path, data)`` says whether a file is of this format; ``extract(data)``
    yields (location kind, location fields, text) in document order and may raise
    after some units. ``stream(file)`` does the same from an open file without holding
    it; a format that has it is told by its first bytes alone. A ``zipped`` format takes
    an open file for ``data`` too, and holds one step of one part of it."""

    name: str
    extensions: tuple[str, ...]
    sniff: Callable[[str, bytes], bool]
    extract: Callable[[bytes], Iterator[Unit]]
    stream: Callable[[IO[bytes]], Iterator[Unit]] | None = None
    zipped: bool = False
