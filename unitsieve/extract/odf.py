"""OpenDocument: text documents, spreadsheets and presentations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import IO

from ..functions.paths import column_letters
from .events import Event, Package, has_parts
from .registry import ExtractError, Format, Unit

# Names of the formats.
_SVG = ("urn:oasis:names:tc:opendocument:xmlns:svg-compatible:1.0", "http://www.w3.org/2000/svg")
_OFFICE = "urn:oasis:names:tc:opendocument:xmlns:office:1.0"
_MIME = {"odt": "application/vnd.oasis.opendocument.text", "ods": "application/vnd.oasis.opendocument.spreadsheet", "odp": "application/vnd.oasis.opendocument.presentation"}
_BODY = {"odt": "text", "ods": "spreadsheet", "odp": "presentation"}
_TEXT = frozenset(("p", "h", "span", "a"))
SPACE_RUN = 65_536
MIME_BYTES = 256


def _number(value: str | None) -> int:
    """A repeat count: 1 unless it is a larger number."""
    return max(1, int(value)) if value and value.isdecimal() else 1


def _side(space: str, name: str, frames: bool) -> bool:
    """Whether an element and all in it is left out."""
    if name in ("annotation", "note", "binary-data", "deletion"):
        return True
    if name == "frame":
        return not frames
    return name in ("title", "desc") and (frames or space in _SVG)


def _segments(events: Iterator[Event], frames: bool, headings: bool) -> Iterator[tuple[str, str, dict | None]]:
    """``("segment", text)`` at ends of outermost paragraphs and at line breaks;
    ``("open", name)`` where such a paragraph begins; other starts and ends as they
    are. ``frames``: frames are content (presentations)."""
    marks = ("p", "h") if headings else ("p",)
    names: list[str] = []
    side = depth = 0
    text: list[str] | None = None
    for kind, space, name, a in events:
        if kind == "text":
            if not side and depth == 1 and text is not None and names and names[-1] in _TEXT:
                text.append(name)
            continue
        if kind == "start":
            names.append(name)
        elif names:
            names.pop()
        if _side(space, name, frames):
            side = max(0, side + (1 if kind == "start" else -1))
        elif side:
            continue
        elif name in marks:
            if kind == "start":
                depth += 1
                if depth == 1:
                    text = []
                    yield "open", name, a
            else:
                if depth == 1:
                    yield "segment", "".join(text or ()), None
                    text = None
                depth = max(0, depth - 1)
        elif kind == "start" and name in ("tab", "s", "line-break"):
            if depth == 1 and text is not None:
                if name == "line-break":
                    yield "segment", "".join(text), None
                    text = []
                else:
                    text.append("\t" if name == "tab" else " " * min(SPACE_RUN, _number(a.get("c"))))
        else:
            yield kind, name, a


_CELL = ("table-cell", "covered-table-cell")


def extract_odt(data: bytes | IO[bytes]) -> Iterator[Unit]:
    paragraph = tables = 0
    heading, own, is_heading = "", "", False
    #: [number, row, column, repeats of the row]
    table: list[list[int]] = []
    #: [table, row, column, repeats, heading] or None outside a table
    cells: list[list | None] = []
    for kind, value, a in _segments(Package(data).events("content.xml"), False, True):
        cell = cells[-1] if cells else None
        if kind == "segment":
            if is_heading:
                own = f"{own} {value}" if own else value
                if cell:
                    cell[4] = own
                else:
                    heading = own
            if not cell:
                yield "odt_paragraph", {"paragraph": paragraph, "heading": heading or None}, value
            elif value.strip():
                yield "odt_cell", {"table": cell[0], "row": cell[1], "col": cell[2], "heading": cell[4] or None}, value
        elif kind == "open":
            is_heading, own = value == "h", ""
            paragraph += not cell
        elif kind == "start":
            if value == "table":
                tables += 1
                table.append([tables, 0, 0, 1])
            elif value == "table-row" and table:
                table[-1][1:] = [table[-1][1] + 1, 0, _number(a.get("number-rows-repeated"))]
            elif value in _CELL:
                if table:
                    table[-1][2] += 1
                    cells.append([*table[-1][:3], _number(a.get("number-columns-repeated")), heading])
                else:
                    cells.append(None)
        elif value in _CELL and cells:
            cell = cells.pop()
            if cell and table:
                table[-1][2] += cell[3] - 1
        elif value == "table-row" and table:
            table[-1][1] += table[-1][3] - 1
        elif value == "table" and table:
            table.pop()


@dataclass
class _Run:
    """A row or cell that stands for ``size`` equal ones from ``first`` on."""

    first: int
    size: int

    def after(self, repeats: str | None) -> _Run:
        return _Run(self.first + self.size, _number(repeats))


@dataclass
class _Sheet:
    name: str
    row: _Run = field(default_factory=lambda: _Run(0, 1))
    cell: _Run = field(default_factory=lambda: _Run(0, 1))
    in_cell: bool = False

    def open_row(self, attributes: dict) -> None:
        self.row = self.row.after(attributes.get("number-rows-repeated"))
        self.cell = _Run(0, 1)

    def open_cell(self, attributes: dict) -> None:
        self.cell = self.cell.after(attributes.get("number-columns-repeated"))
        self.in_cell = True

    def unit(self, text: str) -> Unit:
        row, column = self.row.first, self.cell.first
        return "ods_cell", {"sheet": self.name, "cell": f"{column_letters(column)}{row}", "row": row, "col": column, "repeat": self.row.size * self.cell.size}, text


def extract_ods(data: bytes | IO[bytes]) -> Iterator[Unit]:
    """Repeated rows and cells come once, with their number as ``repeat``."""
    sheets = 0
    sheet: _Sheet | None = None
    for kind, value, a in _segments(Package(data).events("content.xml"), False, False):
        if kind == "start" and value == "table":
            sheets += 1
            sheet = _Sheet(a.get("name") or f"Sheet{sheets}")
        elif sheet is None:
            continue
        elif kind == "segment":
            if sheet.in_cell and value.strip():
                yield sheet.unit(value)
        elif value == "table":
            sheet = None
        elif value == "table-row" and kind == "start":
            sheet.open_row(a)
        elif value in _CELL:
            if kind == "start":
                sheet.open_cell(a)
            else:
                sheet.in_cell = False


def extract_odp(data: bytes | IO[bytes]) -> Iterator[Unit]:
    slide, notes = 0, False
    counts = {False: 0, True: 0}
    shapes: list[str] = []
    for kind, value, a in _segments(Package(data).events("content.xml"), True, False):
        if kind == "segment":
            if value.strip():
                if notes:
                    yield "odp_notes", {"slide": slide}, value
                else:
                    yield "odp_shape", {"slide": slide, "shape": shapes[-1] if shapes else "Shape"}, value
        elif value == "notes":
            notes = kind == "start"
        elif value == "page" and kind == "start" and not notes:
            slide, counts, shapes = slide + 1, {False: 0, True: 0}, []
        elif value == "frame":
            if kind == "start":
                counts[notes] += 1
                shapes.append(a.get("name") or f"Shape {counts[notes]}")
            elif shapes:
                shapes.pop()


def kind_of(data: bytes | IO[bytes]) -> str | None:
    """odt, ods or odp, by the mimetype part or else by the body's first element."""
    if not has_parts(data, "content.xml"):
        return None
    package = Package(data)
    try:
        if "mimetype" in package.names:
            mime = package.zip.open("mimetype").read(MIME_BYTES + 1)[:MIME_BYTES].decode("ascii", "replace").strip()
            for name, value in _MIME.items():
                if mime in (value, value + "-template"):
                    return name
            if mime:
                return None
        body = False
        for kind, space, local, _ in package.events("content.xml"):
            if kind == "start":
                if body:
                    return next((n for n, b in _BODY.items() if b == local), None)
                body = space == _OFFICE and local == "body"
    except (ExtractError, OSError):
        return None
    return None


FORMATS = (
    Format("odt", (".odt",), lambda _, data: kind_of(data) == "odt", extract_odt, zipped=True),
    Format("ods", (".ods",), lambda _, data: kind_of(data) == "ods", extract_ods, zipped=True),
    Format("odp", (".odp",), lambda _, data: kind_of(data) == "odp", extract_odp, zipped=True),
)
