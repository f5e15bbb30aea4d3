"""Patterns: literals, RE2 syntax on the JVM's engine, byte spans.

Patterns are written in RE2 syntax. The JVM reads a slightly different dialect, so
:func:`translate` walks a pattern once and writes what means the same there.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

META = frozenset("\\.+*?()[]{}^$|")
_SPACE = r"\t\n\f\r "
_WORD = "0-9A-Za-z_"
_EDGE = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
_NO_EDGE = f"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))"
# POSIX class names as the JVM writes them.
_POSIX = {"alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}", "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\t\n\x0B\f\r ", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}"}
_CATEGORY = re.compile(r"(?:L[ultmo]?|M[nce]?|N[dlo]?|P[cdseifo]?|S[mcko]?|Z[slp]?|C[cfso]?)")
_COUNT = re.compile(r"\{(\d+)(,(\d*))?\}")
MAX_REPEAT = 1000


class PatternError(ValueError):
    """A pattern that RE2 does not accept."""


class _Reader:
    def __init__(self, pattern: str) -> None:
        self.p, self.i, self.out = pattern, 0, []

    def property_class(self) -> str:
        """At ``p`` or ``P`` after a backslash."""
        p, sign = self.p, self.p[self.i]
        if p[self.i + 1 : self.i + 2] == "{":
            end = p.find("}", self.i)
            if end < 0:
                raise PatternError("unclosed character property")
            name, self.i = p[self.i + 2 : end], end + 1
        else:
            name, self.i = p[self.i + 1 : self.i + 2], self.i + 2
        if name.startswith("^"):
            sign, name = ("P" if sign == "p" else "p"), name[1:]
        if name == "Any":
            return r"\x{0}-\x{10FFFF}" if sign == "p" else r"&&[]"
        return f"\\{sign}{{{name if _CATEGORY.fullmatch(name) else 'Is' + name}}}"

    def escape(self, in_class: bool) -> str:
        p = self.p
        self.i += 1
        if self.i >= len(p):
            raise PatternError("trailing backslash")
        c = p[self.i]
        if c in "pP":
            return self.property_class()
        self.i += 1
        if c == "s":
            return _SPACE if in_class else f"[{_SPACE}]"
        if c == "S":
            return f"[^{_SPACE}]"
        if c in "dDwW":
            return "\\" + c
        if c in "01234567":
            if c != "0" and not (p[self.i : self.i + 1] and p[self.i] in "01234567"):
                raise PatternError(f"invalid escape \\{c}")
            digits = re.match(r"[0-7]{0,2}", p[self.i :])[0]
            self.i += len(digits)
            return f"\\x{{{int(c + digits, 8):X}}}"
        if c == "x":
            m = re.match(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2})", p[self.i :])
            if not m:
                raise PatternError("invalid escape \\x")
            self.i += m.end()
            return f"\\x{{{m[1] or m[2]}}}"
        if c in "aftnrv":
            return {"a": r"\x07", "v": r"\x0B"}.get(c, "\\" + c)
        if not in_class:
            if c == "b":
                return _EDGE
            if c == "B":
                return _NO_EDGE
            if c == "A":
                return r"\A"
            if c == "z":
                return r"\z"
            if c == "Q":
                end = p.find("\\E", self.i)
                text = p[self.i :] if end < 0 else p[self.i : end]
                self.i = len(p) if end < 0 else end + 2
                return "".join(quote(x) for x in text)
        if c.isascii() and (c.isalnum()):
            raise PatternError(f"invalid escape \\{c}")
        return "\\" + c if c.isascii() else c

    def char_class(self) -> str:
        p, out = self.p, ["["]
        self.i += 1
        if p[self.i : self.i + 1] == "^":
            out.append("^")
            self.i += 1
        first = True
        while True:
            if self.i >= len(p):
                raise PatternError("missing closing ]")
            c = p[self.i]
            if c == "]" and not first:
                self.i += 1
                return "".join([*out, "]"])
            first = False
            if p.startswith("[:", self.i) and (m := re.match(r"\[:(\^?)([a-z]+):\]", p[self.i :])):
                if m[2] not in _POSIX:
                    raise PatternError(f"invalid character class [:{m[2]}:]")
                out.append(f"[{m[1]}{_POSIX[m[2]]}]")
                self.i += m.end()
            elif c == "\\":
                out.append(self.escape(True))
            else:
                out.append("\\" + c if c in "[]&^~" or c in " #" else c)
                self.i += 1

    def run(self) -> str:
        p, out = self.p, self.out
        lazy, multi = False, False
        stack: list[tuple[bool, bool]] = []
        can_repeat = False
        while self.i < len(p):
            c = p[self.i]
            if c == "\\":
                out.append(self.escape(False))
                can_repeat = True
            elif c == "[":
                out.append(self.char_class())
                can_repeat = True
            elif c == "(":
                can_repeat = False
                m = re.match(r"\(\?P?<([A-Za-z_][A-Za-z0-9_]*)>", p[self.i :])
                if m:
                    stack.append((lazy, multi))
                    out.append("(")
                    self.i += m.end()
                elif p.startswith("(?", self.i):
                    m = re.match(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])", p[self.i :])
                    if not m or not (m[1] or m[2] or m[3] == ":"):
                        raise PatternError("invalid or unsupported group syntax")
                    outer = (lazy, multi)
                    lazy = True if "U" in m[1] else False if m[2] and "U" in m[2] else lazy
                    multi = True if "m" in m[1] else False if m[2] and "m" in m[2] else multi
                    on = m[1].replace("U", "").replace("i", "iu")
                    off = (m[2] or "").replace("U", "")
                    flags = on + ("-" + off if off else "")
                    if m[3] == ":":
                        stack.append(outer)
                        out.append(f"(?{flags}:")
                    elif flags:
                        out.append(f"(?{flags})")
                    self.i += m.end()
                else:
                    stack.append((lazy, multi))
                    out.append("(")
                    self.i += 1
            elif c == ")":
                if not stack:
                    raise PatternError("unexpected )")
                lazy, multi = stack.pop()
                out.append(c)
                self.i += 1
                can_repeat = True
            elif c in "*+?" or (c == "{" and _COUNT.match(p, self.i)):
                if not can_repeat:
                    raise PatternError("missing argument to repetition operator")
                text = c
                if c == "{":
                    m = _COUNT.match(p, self.i)
                    low, high = int(m[1]), int(m[3]) if m[3] else None
                    if low > MAX_REPEAT or (high or 0) > MAX_REPEAT or (high is not None and high < low):
                        raise PatternError("invalid repeat count")
                    text = m[0]
                self.i += len(text)
                swap = lazy
                if p[self.i : self.i + 1] == "?":
                    swap = not swap
                    self.i += 1
                out.append(text + ("?" if swap else ""))
                if p[self.i : self.i + 1] in ("*", "+", "?") and p[self.i : self.i + 1] or _COUNT.match(p, self.i):
                    raise PatternError("invalid nested repetition operator")
                can_repeat = True
            elif c == "$":
                out.append("$" if multi else r"\z")
                self.i += 1
                can_repeat = True
            else:
                out.append("\\" + c if c in "{}]" else c)
                self.i += 1
                can_repeat = c != "|"
                if c == "^":
                    can_repeat = True
        if stack:
            raise PatternError("missing closing )")
        return "".join(out)


def translate(pattern: str, ignore_case: bool = False) -> str:
    """An RE2 pattern for ``java.util.regex``; raises :class:`PatternError`."""
    return ("(?diu)" if ignore_case else "(?d)") + _Reader(pattern).run()


def quote(text: str) -> str:
    """A regular expression for the text itself."""
    return "".join("\\" + c if c.isascii() and not c.isalnum() else c for c in text)


@dataclass(frozen=True)
class Matcher:
    """A compiled pattern: a predicate over a text column, and its byte spans."""

    pattern: str
    literal: bool
    ignore_case: bool
    word: bool
    java: str

    def matches(self, text: Column) -> Column:
        if self.literal and not self.pattern:
            return F.lit(False)
        if not self.literal:
            return text.rlike(self.java)
        if self.word:
            return self._near(text) & (F.size(self.spans(text)) > 0)
        return self._near(text)

    def _near(self, text: Column) -> Column:
        if self.ignore_case:
            return F.contains(F.lower(text), F.lit(self.pattern.lower()))
        return F.contains(text, F.lit(self.pattern))

    def spans(self, text: Column) -> Column:
        """Half-open UTF-8 byte ranges of all matches, left to right.

        Matches are set between two control characters, which are replaced in the
        text beforehand by others of the same length.
        """
        if self.literal and not self.pattern:
            return F.expr("cast(array() as array<struct<start:int,end:int>>)")
        if self.literal and not self.ignore_case:
            marked = F.replace(_masked(text), F.lit(self.pattern), F.lit("\x01" + (self.pattern + "\x02") * self.word))
        else:
            marked = F.regexp_replace(_masked(text), F.lit(self.java), F.lit("\x01$0\x02"))
        if self.literal and self.word:
            cut = _word_spans
        elif self.literal and not self.ignore_case:
            width = len(self.pattern.encode())
            cut = lambda p, sums: F.transform(F.slice(sums, 1, F.size(sums) - 1), lambda e, i: F.struct((e + i * width).alias("start"), (e + (i + 1) * width).alias("end")))
        else:
            cut = _regex_spans
        plain = self.literal and not self.ignore_case and not self.word
        return _bound(F.split(marked, "\x01", -1), lambda p: _bound(_sums(p, not plain), lambda sums: cut(p, sums)))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _masked(text: Column) -> Column:
    """The text with other control characters for the two that mark matches."""
    return F.when(text.contains("\x01") | text.contains("\x02"), F.translate(text, "\x01\x02", "\x03\x04")).otherwise(text)


#: Pieces added up in one go; a line of more hits is added up block by block, so the
#: work stays in proportion to the hits.
_BLOCK = 256


def _running(sizes: Column) -> Column:
    """Sums up to and including each place."""
    return F.aggregate(sizes, F.expr("cast(array() as array<int>)"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x)))


def _sums(pieces: Column, marked: bool) -> Column:
    """Bytes of the text up to the end of each piece; ``marked``: all pieces but the
    first hold a mark, which does not count."""
    sizes = F.transform(pieces, lambda p, i: F.octet_length(p) - F.when(i > 0, 1).otherwise(0) if marked else F.octet_length(p))

    def blocks(sizes: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(1), F.size(sizes), F.lit(_BLOCK)), lambda at: _running(F.slice(sizes, at, _BLOCK)))
        return _bound(inner, lambda parts: _bound(_running(F.transform(parts, lambda x: F.element_at(x, -1))), lambda ends: F.flatten(F.transform(parts, lambda x, k: F.transform(x, lambda v: v + F.when(k == 0, 0).otherwise(F.get(ends, k - 1)))))))

    return _bound(sizes, lambda z: F.when(F.size(z) <= _BLOCK, _running(z)).otherwise(blocks(z)))


def _hit(piece: Column) -> Column:
    return F.substring_index(piece, "\x02", 1)


def _rest(piece: Column) -> Column:
    return F.substring_index(piece, "\x02", -1)


def _regex_spans(pieces: Column, sums: Column) -> Column:
    """An empty match right after another one does not count."""
    found = F.transform(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p, i: F.struct(F.get(sums, i).alias("start"), (F.get(sums, i) + F.octet_length(_hit(p))).alias("end"), ((_hit(p) != "") | (i == 0) | (_rest(F.get(pieces, i)) != "")).alias("keep")),
    )
    return F.transform(F.filter(found, lambda s: s["keep"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def _word_spans(pieces: Column, sums: Column) -> Column:
    """Literal matches whose neighbours are no letter, digit or underscore. A
    candidate that fails is still used up."""
    n = F.size(pieces)

    def one(piece: Column, i: Column) -> Column:
        before, following = F.get(pieces, i), F.get(pieces, i + 2)
        left = F.when(i == 0, before).otherwise(F.when(_rest(before) == "", _hit(before)).otherwise(_rest(before)))
        right = F.when((_rest(piece) == "") & (i + 2 < n), _hit(following)).otherwise(_rest(piece))
        good = ~left.rlike(r"[\p{L}\p{Nd}_]\z") & ~right.rlike(r"\A[\p{L}\p{Nd}_]")
        return F.struct(F.get(sums, i).alias("start"), (F.get(sums, i) + F.octet_length(_hit(piece))).alias("end"), good.alias("good"))

    found = F.transform(F.slice(pieces, 2, F.greatest(n - 1, F.lit(0))), one)
    return F.transform(F.filter(found, lambda s: s["good"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def compile_pattern(pattern: str, ignore_case: bool = False, fixed: bool = False, word: bool = False, spark: SparkSession | None = None) -> Matcher:
    """A literal if asked for or if the pattern has no special character, else a
    regular expression; ``word`` is Unicode-aware for literals and ASCII for
    expressions. Raises :class:`PatternError` on the driver."""
    if fixed or not META & set(pattern):
        return Matcher(pattern, True, ignore_case, word, ("(?iu)" if ignore_case else "") + quote(pattern))
    java = translate(pattern, ignore_case)
    if word:
        flags, body = ("(?diu)", java[6:]) if ignore_case else ("(?d)", java[4:])
        java = f"{flags}{_EDGE}(?:{body}){_EDGE}"
    if spark is not None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(java)
        except Exception as error:
            raise PatternError(f"compiling pattern {pattern!r}: {getattr(error, 'java_exception', error)}") from None
    return Matcher(pattern, False, ignore_case, word, java)
