"""Small text rules: key paths, JSON quoting, cell references, globs, URIs."""

from __future__ import annotations

import bisect
import os
import re
from urllib.parse import quote as percent

from pyspark.sql import Column
from pyspark.sql import functions as F

_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_SIMPLE = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_PLAIN_ESC = re.compile('["\\\\\x00-\x1f  ]')
_HTML_ESC = re.compile('["\\\\\x00-\x1f  <>&]')


def json_string(text: str, html: bool = True) -> str:
    """A JSON string; ``html`` also escapes ``< > &``."""
    return '"' + (_HTML_ESC if html else _PLAIN_ESC).sub(lambda m: _SIMPLE.get(m[0]) or f"\\u{ord(m[0]):04x}", text) + '"'


def append_key(path: str, key: str, html: bool = True) -> str:
    head = "" if path == "." else path
    return f"{head}.{key}" if _IDENT.match(key) else f"{head}.[{json_string(key, html)}]"


def append_index(path: str, i: int) -> str:
    return f"{path}[{i}]"


class Lines:
    """Line and column (both from 1) of byte offsets."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.starts = [0]
        at = data.find(b"\n") + 1
        while at:
            self.starts.append(at)
            at = data.find(b"\n", at) + 1

    def at(self, offset: int) -> tuple[int, int]:
        i = bisect.bisect_right(self.starts, max(0, offset))
        return i, max(0, offset) - self.starts[i - 1] + 1

    def text(self, line: int) -> bytes:
        start = self.starts[line - 1]
        end = self.starts[line] - 1 if line < len(self.starts) else len(self.data)
        return self.data[start:end].removesuffix(b"\r")


def column_letters(column: int) -> str:
    out = ""
    while column > 0:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def parse_cell(ref: str) -> tuple[int, int] | None:
    """(row, column) of a reference such as ``B45``."""
    m = re.fullmatch(r"([A-Za-z]+)([0-9]+)", ref)
    if not m:
        return None
    column = 0
    for c in m[1].upper():
        column = column * 26 + ord(c) - 64
    return int(m[2]), column


def quote_sheet(name: str) -> str:
    return name if re.fullmatch(r"[^\W]+", name) else "'" + name.replace("'", "''") + "'"


def glob_regex(pattern: str) -> str | None:
    """A regular expression for one shell glob without ``/`` in its wildcards; None
    if the glob is malformed (it then matches nothing)."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            if i >= len(pattern):
                return None
            out += re.escape(pattern[i])
            i += 1
        elif c == "[":
            negated = pattern[i : i + 1] == "^"
            i += negated
            body, first = "", True
            while True:
                if i >= len(pattern):
                    return None
                if pattern[i] == "]" and not first:
                    i += 1
                    break
                first = False
                ends = []
                for part in range(2):
                    if i >= len(pattern) or pattern[i] in "-]" and not (part == 0 and False):
                        return None
                    if pattern[i] == "\\":
                        i += 1
                        if i >= len(pattern):
                            return None
                    ends.append(pattern[i])
                    i += 1
                    if pattern[i : i + 1] != "-":
                        break
                    if part == 0:
                        i += 1
                lo, hi = ends[0], ends[-1]
                if lo <= hi:
                    body += re.escape(lo) + ("-" + re.escape(hi) if hi != lo else "")
            body = body or "\\x00"
            out += f"(?!/)[{'^' if negated else ''}{body}]" if negated else f"[{body}]"
        else:
            out += re.escape(c)
    return out


def glob_match(pattern: str, name: str) -> bool:
    rx = glob_regex(pattern)
    return rx is not None and re.fullmatch(rx, name, re.S) is not None


def wanted(path: str, include: tuple[str, ...], exclude: tuple[str, ...]) -> bool:
    """Include and exclude globs over base name or whole path; exclude wins."""
    names = (os.path.basename(path), path)
    if any(glob_match(g, n) for g in exclude for n in names):
        return False
    return not include or any(glob_match(g, n) for g in include for n in names)


def wanted_column(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """:func:`wanted` as a filter the scan can run."""
    base = F.substring_index(path, "/", -1)

    def any_of(globs: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for g in globs:
            rx = glob_regex(g)
            if rx is not None:
                out = out | base.rlike(f"(?s)\\A(?:{rx})\\z") | path.rlike(f"(?s)\\A(?:{rx})\\z")
        return out

    keep = ~any_of(exclude)
    return keep & any_of(include) if include else keep


#: Characters that stay as they are in a URI's path; in a fragment the question mark too.
_URI_SAFE = "/-_.~$&+,:;=@!'()*"


def percent_column(text: Column, safe: str) -> Column:
    """Percent-encoding of everything but letters, digits and ``safe``."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for c in safe:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def absolute_column(path: Column) -> Column:
    """A path from the root, without ``.``, ``..`` and doubled slashes."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(os.getcwd().rstrip("/") + "/"), path))
    empty = F.expr("cast(array() as array<string>)")
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    parts = F.aggregate(F.split(full, "/"), empty, lambda done, x: F.when(x.isin("", "."), done).when(x == "..", up(done)).otherwise(F.concat(done, F.array(x))))
    odd = full.rlike(r"//|/\.{1,2}(?:/|\z)|./\z")
    return F.when(odd, F.concat(F.lit("/"), F.array_join(parts, "/"))).otherwise(full)


def file_uri_column(path: Column) -> Column:
    """:func:`file_uri` as an expression of the engine."""
    stored = path.contains("://")
    return F.when(stored, percent_column(path, _URI_SAFE + "%")).otherwise(F.concat(F.lit("file://"), percent_column(absolute_column(path), _URI_SAFE)))


def fragment_column(text: Column) -> Column:
    return F.concat(F.lit("#"), percent_column(text, _URI_SAFE + "?"))


def file_uri(path: str) -> str:
    """The URI of a local path; a path that names its storage is one already."""
    if "://" in path:
        return percent(path, safe=_URI_SAFE + "%")
    return "file://" + percent(os.path.abspath(path), safe=_URI_SAFE)


def fragment(text: str) -> str:
    return "#" + percent(text, safe=_URI_SAFE + "?")


def escape_controls(column: Column) -> Column:
    """Line feed, return and tab as backslash letters, other control characters as ``\\xNN``."""
    for code in [9, 10, 13, *(c for c in range(32) if c not in (9, 10, 13)), 127]:
        column = F.replace(column, F.lit(chr(code)), F.lit({9: "\\t", 10: "\\n", 13: "\\r"}.get(code, f"\\x{code:02x}")))
    return column


def escape_text(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: {"\t": "\\t", "\n": "\\n", "\r": "\\r"}.get(m[0], f"\\x{ord(m[0]):02x}"), text)
