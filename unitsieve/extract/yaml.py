"""YAML: scalar leaves and empty containers by key path."""

from __future__ import annotations

from collections.abc import Iterator

from ..functions.paths import append_index, append_key
from .registry import ExtractError, Format, Unit

MAX_SIZE = 64 << 20


def _events(text: str) -> Iterator:
    try:
        import yaml
    except ImportError:
        raise ExtractError("reading YAML needs PyYAML") from None
    try:
        yield from yaml.parse(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except (yaml.YAMLError, ValueError) as e:
        raise ExtractError(str(e)) from None


def _literal(event, text: str) -> str:
    """A scalar as its source has it; an absent value is ``null``."""
    raw = text[event.start_mark.index : event.end_mark.index].strip()
    if not raw:
        return "null" if event.value == "" else event.value
    for lead in ("&", "!"):  # an anchor or tag is not part of the value
        while raw.startswith(lead):
            raw = raw.partition(" ")[2].lstrip() or "null"
    return raw


def leaves(text: str) -> Iterator[tuple[int, str, str, int, int]]:
    """``(document, path below the root, literal, line, column)``."""
    document = -1
    #: [path, is mapping, members, key or None, line, column]
    stack: list[list] = []

    def place() -> str | None:
        """The path of the node that begins, or None if it is a key."""
        if not stack:
            return "."
        top = stack[-1]
        if not top[1]:
            top[2] += 1
            return append_index(top[0], top[2] - 1)
        if top[3] is None:
            return None
        path, top[3] = append_key(top[0], top[3]), None
        top[2] += 1
        return path

    keys = 0  # depth inside a complex key
    for e in _events(text):
        kind = type(e).__name__
        if kind == "DocumentStartEvent":
            document += 1
        elif keys or (kind in ("MappingStartEvent", "SequenceStartEvent") and stack and stack[-1][1] and stack[-1][3] is None):
            keys += (kind in ("MappingStartEvent", "SequenceStartEvent")) - (kind in ("MappingEndEvent", "SequenceEndEvent"))
            if keys == 1 and kind.endswith("StartEvent"):
                begin = e.start_mark.index
            if not keys:
                stack[-1][3] = text[begin : e.end_mark.index].strip()
        elif kind in ("MappingStartEvent", "SequenceStartEvent"):
            stack.append([place(), kind == "MappingStartEvent", 0, None, e.start_mark.line + 1, e.start_mark.column + 1])
        elif kind in ("MappingEndEvent", "SequenceEndEvent"):
            path, mapping, members, _, line, column = stack.pop()
            if not members:
                yield document, path, "{}" if mapping else "[]", line, column
        elif kind in ("ScalarEvent", "AliasEvent"):
            path = place()
            raw = "*" + e.anchor if kind == "AliasEvent" else _literal(e, text)
            if path is None:
                quoted = kind == "ScalarEvent" and e.style is not None
                stack[-1][3] = e.value if quoted else "null" if kind == "ScalarEvent" and e.value in ("", "~") else raw
            else:
                yield document, path, raw, e.start_mark.line + 1, e.start_mark.column + 1


def _text(data: bytes) -> str:
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise ExtractError(str(e)) from None


def sniff(_: str, data: bytes) -> bool:
    """The whole file parses and some document has a non-empty container."""
    if len(data) > MAX_SIZE or b"\x00" in data[:8192]:
        return False
    found = False
    try:
        for _, path, *_rest in leaves(_text(data)):
            found = found or path != "."
    except ExtractError:
        return False
    return found


def extract(data: bytes) -> Iterator[Unit]:
    """Nothing comes from a file that does not parse as a whole."""
    if len(data) > MAX_SIZE:
        raise ExtractError("file too large")
    rows = list(leaves(_text(data)))
    many = sum(type(e).__name__ == "DocumentStartEvent" for e in _events(_text(data))) > 1
    for document, path, raw, line, column in rows:
        if many:
            path = f".document[{document}]" + ("" if path == "." else path)
        yield "yaml_path", {"yamlpath": path, "line": line, "col": column}, f"{path} = {raw}"


FORMAT = Format("yaml", (".yaml", ".yml"), sniff, extract)
