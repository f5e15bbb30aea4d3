"""HTML: direct text of elements by tag path, read leniently."""

from __future__ import annotations

import html
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

from .registry import Format, Unit

# Element names and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes noscript plaintext xmp".split())
ESCAPABLE_RAW = frozenset("textarea title".split())
VERBATIM = frozenset("pre textarea".split())
_CELLS, _TERMS, _SECTIONS = ("td", "th"), ("dt", "dd"), ("thead", "tbody", "tfoot")
CLOSES = {"li": ("li",), "td": _CELLS, "th": _CELLS, "tr": ("tr",), "option": ("option",), "optgroup": ("optgroup",), "dt": _TERMS, "dd": _TERMS, "thead": _SECTIONS, "tbody": _SECTIONS, "tfoot": _SECTIONS}
MAX_DEPTH = 1000
EXTENSIONS = (".html", ".htm", ".xhtml")

_SPACE = re.compile(r"[ \t\n\f\r]+")
_MARKUP = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)


class _Open:
    """An open element and the segments of its own text."""

    __slots__ = ("line", "name", "parts", "path", "seen", "segments", "space")

    def __init__(self, name: str, path: str) -> None:
        self.name, self.path, self.seen = name, path, Counter()
        self.segments: list[tuple[int, str]] = []
        self.cut()

    def cut(self) -> None:
        """Ends the current segment."""
        if hasattr(self, "parts") and self.parts:
            self.segments.append((self.line, "".join(self.parts)))
        self.parts: list[str] = []
        self.line, self.space = 0, False

    def add(self, text: str, line: int) -> None:
        """Text with white space collapsed, also across calls."""
        text = _SPACE.sub(" ", text)
        if self.space and text.startswith(" "):
            text = text[1:]
        if text:
            self.parts.append(text)
            self.space = text.endswith(" ")
        if not self.line and text.strip(" "):
            self.line = line

    def add_verbatim(self, text: str, line: int) -> None:
        for i, part in enumerate(text.split("\n")):
            if i:
                self.cut()
            self.line = self.line or line + i
            self.parts.append(part)

    def units(self) -> Iterator[Unit]:
        if self.name not in RAW:
            self.cut()
            for line, text in self.segments:
                text = text.strip()
                if text:
                    yield "html_path", {"htmlpath": self.path, "line": line, "col": 1}, text


def unescape_markup(text: str) -> str:
    """Decodes ``&lt;``, ``&gt;`` and ``&amp;`` alone; other references stay as written."""
    return text.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")


def extract(data: bytes, decode: Callable[[str], str] = html.unescape) -> Iterator[Unit]:
    """An element's segments come when it closes, so inner elements come first; what
    is still open at the end closes innermost first. ``decode`` reads character
    references, by default all of HTML, also those that lack their semicolon."""
    page = data.decode("utf-8", "replace").replace("\r\n", "\n")
    stack: list[_Open] = []
    roots: Counter[str] = Counter()
    skipped = 0
    at, line = 0, 1

    def text(raw: str, start: int) -> None:
        if stack and stack[-1].name not in RAW and raw:
            top = stack[-1]
            plain = decode(raw) if "&" in raw else raw
            if top.name in VERBATIM:
                top.add_verbatim(plain, start)
            else:
                lead = len(raw) - len(raw.lstrip(" \t\n\f\r"))
                top.add(plain, start + raw.count("\n", 0, lead))

    while at < len(page):
        m = _MARKUP.search(page, at)
        begin = m.start() if m else len(page)
        text(page[at:begin], line)
        line += page.count("\n", at, begin)
        if not m:
            break
        at = m.end()
        closing, name = m[1], (m[2] or "").lower()
        start_line = line
        line += page.count("\n", begin, at)
        if not name or (at == len(page) and not m[0].endswith(">")):
            continue
        if closing:
            if skipped:
                skipped -= 1
                continue
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            while depth is not None and len(stack) > depth:
                yield from stack.pop().units()
            continue
        if name == "br":
            if stack and stack[-1].name not in RAW:
                stack[-1].cut()
            continue
        if name in VOID:
            continue
        if name in CLOSES:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name in CLOSES[name]), None)
            while depth is not None and len(stack) > depth:
                yield from stack.pop().units()
        raw_end = None
        if name in RAW or name in ESCAPABLE_RAW:
            closer = None if name == "plaintext" else re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            raw_end = closer.start() if closer else len(page)
        if len(stack) >= MAX_DEPTH:
            skipped += 1
        else:
            seen, parent = (stack[-1].seen, stack[-1].path + ">") if stack else (roots, "")
            seen[name] += 1
            stack.append(_Open(name, f"{parent}{name}:nth-of-type({seen[name]})"))
        if raw_end is not None:
            if not skipped:
                text(page[at:raw_end], line)
            line += page.count("\n", at, raw_end)
            at = raw_end
        del start_line
    while stack:
        yield from stack.pop().units()


_TAG = re.compile(rb"<(?:!doctype\s+html[\s>]|html(?:[\s>/]))", re.I)


def sniff(path: str, data: bytes) -> bool:
    """Markup at the start; without an HTML extension, a doctype or an html tag first."""
    head = data[:65536].removeprefix(b"\xef\xbb\xbf").lstrip(b" \t\r\n\f")
    if not re.match(rb"<[!/A-Za-z?]", head):
        return False
    if os.path.splitext(path)[1].lower() in EXTENSIONS:
        return not head.startswith(b"<?") or head.lower().startswith(b"<?xml")
    while head.startswith(b"<!--"):
        end = head.find(b"-->")
        if end < 0:
            return False
        head = head[end + 3 :].lstrip(b" \t\r\n\f")
    return bool(_TAG.match(head))


FORMAT = Format("html", EXTENSIONS, sniff, extract)
