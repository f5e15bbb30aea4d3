"""TOML: each leaf, comment and empty table with its source line.

A syntactic scanner with byte positions: it does not object to a key set twice.
Plain ``key = value`` lines, most of any file, are read by one expression each.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator

from ..functions.paths import append_index, append_key
from .registry import ExtractError, Format, Unit

MAX_SIZE = 8 << 20
_BLANK = re.compile(rb"(?:[ \t\n]|\r\n)*")
_INLINE = re.compile(rb"[ \t]*")
_COMMENT = re.compile(rb"#[^\n\x00-\x08\x0b\x0c\x0e-\x1f\x7f]*")
_END = re.compile(rb"[ \t]*(?:\r?\n|\r?\Z)")
_ESCAPE = rb"\\(?:[btnfre\"\\]|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})"
_LETTERS = rb"[^\"\\\x00-\x08\x0a-\x1f\x7f]*"
_BASIC = rb"\"" + _LETTERS + rb"(?:" + _ESCAPE + _LETTERS + rb")*\""
_PLAIN = rb"'[^'\x00-\x08\x0a-\x1f\x7f]*'"
_TIME = rb"\d\d:\d\d(?::\d\d(?:\.\d+)?)?"
_ATOM = (
    rb"true|false|[+-]?(?:inf|nan)|0x[0-9A-Fa-f](?:_?[0-9A-Fa-f])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*"
    rb"|\d{4}-\d\d-\d\d(?:[Tt ]" + _TIME + rb"(?:[Zz]|[+-]\d\d:\d\d)?)?|" + _TIME + rb"|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?"
)
_ATOM_END = rb"(?![0-9A-Za-z_.:+-])"
_KEY = re.compile(rb"(" + _BASIC + rb")|'([^'\n]*)'|([A-Za-z0-9_-]+)")
_STRING = re.compile(rb"\"\"\"(?:[^\\]|\\.)*?\"\"\"\"{0,2}|'\'\'.*?'\'\''{0,2}|" + _BASIC + rb"|" + _PLAIN, re.S)
_SCALAR = re.compile(rb"(?:" + _ATOM + rb")" + _ATOM_END)
_SIMPLE = re.compile(rb"[ \t]*([A-Za-z0-9_-]+)[ \t]*=[ \t]*(" + _BASIC + rb"|" + _PLAIN + rb"|(?:" + _ATOM + rb")" + _ATOM_END + rb")[ \t]*(#[^\n\x00-\x08\x0b\x0c\x0e-\x1f\x7f]*)?(?:\r?\n|\r?\Z)")


class _Scanner:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0
        #: (kind, path, offset): kind is leaf, comment or header
        self.found: list[tuple[str, str, int]] = []
        self.filled: set[str] = set()
        self.arrays: dict[str, int] = {}

    def skip(self, pattern: re.Pattern[bytes]) -> None:
        self.at = pattern.match(self.data, self.at).end()

    def peek(self) -> bytes:
        return self.data[self.at : self.at + 1]

    def comment(self) -> bool:
        if self.peek() != b"#":
            return False
        self.found.append(("comment", "", self.at))
        self.skip(_COMMENT)
        return True

    def key(self) -> list[str]:
        parts = []
        while True:
            self.skip(_INLINE)
            m = _KEY.match(self.data, self.at)
            if not m:
                raise ExtractError(f"expected a key at offset {self.at}")
            self.at = m.end()
            if m[1] is not None:
                parts.append(_unquoted(m[1]))
            else:
                parts.append((m[2] if m[2] is not None else m[3]).decode("utf-8", "replace"))
            self.skip(_INLINE)
            if self.peek() != b".":
                return parts
            self.at += 1

    def below(self, path: str, parts: list[str], element: bool = False, header: bool = False) -> str:
        for i, part in enumerate(parts):
            self.filled.add(path)
            path = append_key(path, part, html=False)
            if element and i + 1 == len(parts):
                self.arrays[path] = self.arrays.get(path, 0) + 1
            if header and path in self.arrays:
                path = append_index(path, self.arrays[path] - 1)
        return path

    def pair(self, path: str) -> None:
        path = self.below(path, self.key())
        if self.peek() != b"=":
            raise ExtractError(f"expected = at offset {self.at}")
        self.at += 1
        self.skip(_INLINE)
        self.value(path)

    def value(self, path: str) -> None:
        start = self.at
        c = self.peek()
        if c in (b"[", b"{"):
            close = b"]" if c == b"[" else b"}"
            self.at += 1
            members = notes = 0
            open_ = True  # a member may follow
            while True:
                self.skip(_BLANK)
                if self.comment():
                    notes += 1
                elif self.peek() == b"," and not open_:
                    self.at += 1
                    open_ = True
                elif self.peek() == close:
                    self.at += 1
                    break
                elif self.at >= len(self.data):
                    raise ExtractError("unexpected end of file")
                elif not open_:
                    raise ExtractError(f"expected a comma at offset {self.at}")
                else:
                    open_ = False
                    if c == b"[":
                        self.value(append_index(path, members))
                    else:
                        self.pair(path)
                    members += 1
            if not members and not notes:
                self.found.append(("leaf", path, start))
            return
        self.found.append(("leaf", path, start))
        m = _STRING.match(self.data, self.at) or _SCALAR.match(self.data, self.at)
        if not m:
            raise ExtractError(f"expected a value at offset {self.at}")
        self.at = m.end()

    def run(self) -> None:
        path = "."
        data, found, simple = self.data, self.found, _SIMPLE.match
        names: dict[bytes, str] = {}
        while True:
            m = simple(data, self.at)
            if m:
                self.filled.add(path)
                key = m[1]
                if key not in names:
                    names[key] = append_key(path, key.decode(), html=False)
                found.append(("leaf", names[key], m.start(2)))
                if m[3] is not None:
                    found.append(("comment", "", m.start(3)))
                self.at = m.end()
                continue
            self.skip(_BLANK)
            if self.at >= len(data):
                return
            if self.comment():
                self.finish()
                continue
            if self.peek() == b"[":
                element = data[self.at + 1 : self.at + 2] == b"["
                self.at += 1 + element
                self.skip(_INLINE)
                begin = self.at
                path = self.below(".", self.key(), element, True)
                names = {}
                found.append(("header", path, begin))
                if data[self.at : self.at + 1 + element] != b"]" * (1 + element):
                    raise ExtractError(f"expected ] at offset {self.at}")
                self.at += 1 + element
            elif not simple(data, self.at):
                self.pair(path)
            else:
                continue
            self.skip(_INLINE)
            self.comment()
            self.finish()

    def finish(self) -> None:
        m = _END.match(self.data, self.at)
        if not m:
            raise ExtractError(f"expected a new line at offset {self.at}")
        self.at = m.end()


def _unquoted(raw: bytes) -> str:
    try:
        return tomllib.loads("k = " + raw.decode())["k"]
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise ExtractError(str(e)) from None


#: The file scanned last: sniffing and extracting share one scan.
_last: tuple[bytes, _Scanner] | None = None


def _scan(data: bytes) -> _Scanner:
    global _last
    if _last is not None and _last[0] is data:
        return _last[1]
    if len(data) > MAX_SIZE:
        raise ExtractError("file too large")
    if not data.isascii():
        try:
            data.decode("utf-8")
        except UnicodeDecodeError as e:
            raise ExtractError(str(e)) from None
    scanner = _Scanner(data)
    try:
        scanner.run()
    except RecursionError as e:
        raise ExtractError(str(e)) from None
    _last = data, scanner
    return scanner


def sniff(_: str, data: bytes) -> bool:
    """The whole file parses and holds more than comments."""
    if len(data) > MAX_SIZE or not re.search(rb"[=\[]", data):
        return False
    try:
        return any(kind != "comment" for kind, _, _ in _scan(data).found)
    except ExtractError:
        return False


def extract(data: bytes) -> Iterator[Unit]:
    scanner = _scan(data)
    filled = scanner.filled
    row, start, end, text = 0, 0, -1, ""  # the line in hand; places come in order
    for kind, path, at in scanner.found:
        if kind == "header" and path in filled:
            continue
        if at > end:
            while at > end:
                row, start = row + 1, end + 1
                end = data.find(b"\n", start)
                if end < 0:
                    end = len(data)
            text = data[start:end].removesuffix(b"\r").decode("utf-8", "replace")
        if kind == "comment":
            yield "toml_comment", {"line": row, "col": at - start + 1, "comment": True}, text
        else:
            yield "toml_path", {"tomlpath": path, "line": row, "col": at - start + 1}, text


FORMAT = Format("toml", (".toml",), sniff, extract)
