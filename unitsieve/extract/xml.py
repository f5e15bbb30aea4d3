"""XML: direct text of elements, and attributes, by XPath."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from xml.parsers import expat

from ..functions.paths import Lines
from .registry import ExtractError, Format, Unit

PEEK = 4096
_STEP = 1 << 16
_TAG_END = re.compile(rb"(?:[^>\"']|\"[^\"]*\"|'[^']*')*>")
_OPENING = re.compile(rb"\A<(?:\?xml[\s?]|!--|!DOCTYPE|[A-Za-z_:\x80-\xff])")


def sniff(_: str, data: bytes) -> bool:
    """An XML-like start whose first token can be read."""
    head = data[:PEEK].removeprefix(b"\xef\xbb\xbf").lstrip(b" \t\r\n")
    if not _OPENING.match(head):
        return False
    if head.startswith(b"<?"):
        return b"?>" in head or len(data) > PEEK
    if head.startswith(b"<!--"):
        return b"-->" in head or len(data) > PEEK
    if head.startswith(b"<!"):
        return b">" in head or len(data) > PEEK
    m = re.match(rb"<[A-Za-z_:\x80-\xff][^\s/>]*(?:\s+[^\s=/>]+\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*\s*/?>", head)
    return bool(m) or (len(data) > PEEK and b">" not in head)


class _Element:
    __slots__ = ("at", "path", "seen", "text")

    def __init__(self, path: str) -> None:
        self.path, self.seen, self.text, self.at = path, Counter(), [], None


class _Reader:
    """Collects units; a text run ends where the next markup begins."""

    def __init__(self, data: bytes) -> None:
        self.data, self.lines = data, Lines(data)
        self.out: list[Unit] = []
        self.stack: list[_Element] = []
        self.run: list[str] = []
        self.parser = p = expat.ParserCreate()
        p.buffer_text = True
        p.ordered_attributes = True
        p.StartElementHandler, p.EndElementHandler = self.start, self.end
        p.CharacterDataHandler = self.run.append
        p.CommentHandler = p.ProcessingInstructionHandler = lambda *_: self.close_run(p.CurrentByteIndex)
        p.StartCdataSectionHandler = lambda: self.close_run(p.CurrentByteIndex)
        p.EndCdataSectionHandler = lambda: self.close_run(p.CurrentByteIndex + 3)

    def close_run(self, at: int) -> None:
        if self.run:
            text = "".join(self.run)
            self.run.clear()
            if self.stack:
                top = self.stack[-1]
                top.text.append(text)
                if top.at is None and text.strip():
                    top.at = at

    def unit(self, path: str, text: str, at: int) -> None:
        row, col = self.lines.at(at)
        self.out.append(("xml_path", {"xpath": path, "line": row, "col": col}, text))

    def start(self, name: str, attributes: list[str]) -> None:
        at = self.parser.CurrentByteIndex
        self.close_run(at)
        local = name.rpartition(":")[2]
        if self.stack:
            top = self.stack[-1]
            top.seen[local] += 1
            path = f"{top.path}/{local}[{top.seen[local]}]"
        else:
            path = "/" + local
        self.stack.append(_Element(path))
        if attributes:
            m = _TAG_END.match(self.data, at)
            end = m.end() if m else at
            for key, value in zip(attributes[::2], attributes[1::2], strict=True):
                prefix, _, key_local = key.rpartition(":")
                if prefix != "xmlns" and key != "xmlns":
                    self.unit(f"{path}/@{key_local}", value, end)

    def end(self, _: str) -> None:
        self.close_run(self.parser.CurrentByteIndex)
        top = self.stack.pop()
        text = "".join(top.text).strip()
        if text:
            self.unit(top.path, text, top.at)


def extract(data: bytes) -> Iterator[Unit]:
    """Attributes at an element's start, its own text at its end."""
    reader = _Reader(data)
    for at in range(0, len(data) + 1, _STEP):
        error = None
        try:
            reader.parser.Parse(data[at : at + _STEP], at + _STEP > len(data))
        except expat.ExpatError as e:
            error = ExtractError(str(e))
        yield from reader.out
        reader.out.clear()
        if error:
            raise error


FORMAT = Format("xml", (".xml",), sniff, extract)
