"""JSON, JSON Lines and JSON with comments."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from ..functions.paths import Lines, append_index, append_key, json_string
from .registry import ExtractError, Format, Unit

BOM = b"\xef\xbb\xbf"
PEEK = 4096
JSONC_MAX = 64 << 20
MAX_DEPTH = 10_000
_TOKEN = re.compile(
    rb'[ \t\r\n]*(?:([{}\[\]:,])|("(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![0-9A-Za-z_.+-])|(true|false|null)(?![0-9A-Za-z_]))'
)
_SPACE = re.compile(rb"[ \t\r\n]*")


def _next(data: bytes, at: int) -> tuple[str, bytes, int]:
    """Kind (punctuation, ``string``, ``number`` or ``word``), bytes and end of a token."""
    m = _TOKEN.match(data, at)
    if not m:
        at = _SPACE.match(data, at).end()
        if at >= len(data):
            raise ExtractError("unexpected end of JSON input")
        raise ExtractError(f"invalid character {chr(data[at])!r} at offset {at}")
    kind = m.lastindex
    return (m[1].decode() if kind == 1 else ("", "", "string", "number", "word")[kind]), m[kind], m.end(kind)


def _string(raw: bytes) -> str:
    text = json.loads(raw.decode("utf-8", "replace"))
    return re.sub("[\ud800-\udfff]", "�", text)


def values(data: bytes) -> Iterator[tuple[str, str, int]]:
    """``(path, literal, end offset)`` of each leaf of the first value."""
    kind, raw, at = _next(data, 0)
    #: [path, is object, members so far]
    stack: list[list] = []
    path = "."
    while True:
        if kind in ("{", "["):
            if len(stack) >= MAX_DEPTH:
                raise ExtractError("exceeded max depth")
            stack.append([path, kind == "{", 0])
        elif kind in ("string", "number", "word"):
            yield path, json_string(_string(raw)) if kind == "string" else raw.decode(), at
        else:
            raise ExtractError(f"invalid character {kind!r} at offset {at - 1}")
        while True:  # to the next value
            if not stack:
                return
            top = stack[-1]
            kind, raw, at = _next(data, at)
            if kind == ("}" if top[1] else "]"):
                stack.pop()
                if not top[2]:
                    yield top[0], "{}" if top[1] else "[]", at
                continue
            if top[2]:
                if kind != ",":
                    raise ExtractError(f"invalid character {raw[:1].decode('utf-8', 'replace')!r} after value at offset {at - len(raw)}")
                kind, raw, at = _next(data, at)
            if top[1]:
                if kind != "string":
                    raise ExtractError(f"invalid object key at offset {at - len(raw)}")
                path = append_key(top[0], _string(raw))
                if _next(data, at)[0] != ":":
                    raise ExtractError(f"missing colon at offset {at}")
                kind, raw, at = _next(data, _next(data, at)[2])
            else:
                path = append_index(top[0], top[2])
            top[2] += 1
            break


def _units(data: bytes, kind: str, line: int | None = None) -> Iterator[Unit]:
    data = data.removeprefix(BOM)
    lines = Lines(data)
    for path, literal, end in values(data):
        row, col = lines.at(end)
        yield kind, {"jsonpath": path, "line": line or row, "col": col}, f"{path} = {literal}"


def looks_like_json(data: bytes) -> bool:
    """A plausible first byte and a first token that can be read."""
    window = data[:PEEK].removeprefix(BOM).lstrip(b" \t\r\n")
    if not window or window[:1] not in b'{["-0123456789tfn':
        return False
    try:
        _next(window, 0)
    except ExtractError:
        return window[:1] == b'"' and len(data) > PEEK
    return True


def extract_json(data: bytes) -> Iterator[Unit]:
    if not data.removeprefix(BOM).strip(b" \t\r\n"):
        raise ExtractError("EOF")
    yield from _units(data, "json_path")


def _first_line(data: bytes) -> bytes:
    for line in data.removeprefix(BOM).split(b"\n"):
        if line.strip():
            return line
    return b""


def extract_jsonl(data: bytes) -> Iterator[Unit]:
    for n, line in enumerate(data.split(b"\n"), 1):
        if line.strip():
            try:
                yield from _units(line.removesuffix(b"\r"), "jsonl_path", n)
            except ExtractError as e:
                raise ExtractError(f"line {n}: {e}") from None


_COMMENTS = re.compile(rb'"(?:[^"\\]|\\.)*"|(//[^\n]*|/\*.*?\*/)|/\*', re.S)
_COMMA = re.compile(rb'"(?:[^"\\]|\\.)*"|(,)(?=[ \t\r\n]*[}\]])', re.S)


def strip_comments(data: bytes) -> tuple[bytes, list[tuple[int, bytes]]]:
    """Data with comments and trailing commas blanked in place, and the comments."""
    found: list[tuple[int, bytes]] = []

    def blank(m: re.Match[bytes]) -> bytes:
        if m[0] == b"/*":
            raise ExtractError("unterminated comment")
        if m[1] is None:
            return m[0]
        found.append((m.start(1), m[1].removesuffix(b"\r")))
        return re.sub(rb"[^\n]", b" ", m[1])

    plain = _COMMENTS.sub(blank, data)
    return _COMMA.sub(lambda m: m[0] if m[1] is None else b" ", plain), found


def _whole(data: bytes) -> bytes:
    """Comment-free data that is one JSON value; raises otherwise."""
    plain, _ = strip_comments(data.removeprefix(BOM))
    end = 0
    for _ in values(plain):
        pass
    depth, at = 0, 0
    while True:
        kind, _, at = _next(plain, at)
        depth += (kind in "{[" and kind != "") - (kind in "}]" and kind != "")
        if depth == 0:
            end = at
            break
    if plain[end:].strip(b" \t\r\n"):
        raise ExtractError("data after the value")
    return plain


def sniff_jsonc(_: str, data: bytes) -> bool:
    if len(data) > JSONC_MAX:
        return False
    try:
        _whole(data)
    except ExtractError:
        return False
    return True


def extract_jsonc(data: bytes) -> Iterator[Unit]:
    if len(data) > JSONC_MAX:
        raise ExtractError("file too large")
    data = data.removeprefix(BOM)
    plain, comments = strip_comments(data)
    _whole(data)
    lines = Lines(data)
    for at, text in comments:
        row, col = lines.at(at)
        yield "jsonc_comment", {"line": row, "col": col, "comment": True}, text.decode("utf-8", "replace")
    yield from _units(plain, "json_path")


FORMATS = (
    Format("json", (".json",), lambda _, data: looks_like_json(data), extract_json),
    Format("jsonl", (".jsonl", ".ndjson"), lambda _, data: looks_like_json(_first_line(data)), extract_jsonl),
    Format("jsonc", (".jsonc",), sniff_jsonc, extract_jsonc),
)
