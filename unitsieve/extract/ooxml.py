"""Office Open XML: text documents, presentations and spreadsheets."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from typing import IO

from ..functions.paths import column_letters, parse_cell
from .events import Event, Package, has_parts
from .registry import ExtractError, Format, Unit

_DRAWING = ("drawing", "pict")
_SLIDE_NS = ("http://schemas.openxmlformats.org/presentationml/2006/main", "http://purl.oclc.org/ooxml/presentationml/main", "p")
_DRAW_NS = ("http://schemas.openxmlformats.org/drawingml/2006/main", "http://purl.oclc.org/ooxml/drawingml/main", "a")


def relations(package: Package, part: str) -> dict[str, tuple[str, str]]:
    """Relation id → (type, target part) of a part; empty if it has none."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in package.names:
        return {}
    out = {}
    for kind, _, local, a in package.events(rels):
        if kind == "start" and local == "Relationship" and a.get("TargetMode") != "External":
            target = a.get("Target", "")
            out[a.get("Id", "")] = (a.get("Type", "").rpartition("/")[2], target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target)))
    return out


# --- text documents


def _runs(events: Iterator[Event]) -> Iterator[tuple[str, str, dict | None]]:
    """What counts in a text part: ``("text", characters)``, ``("break", "")`` and
    start and end of other elements; drawings are left out with all in them."""
    drawing = run = 0
    inside_t = False
    for kind, _, name, a in events:
        if kind == "text":
            if inside_t and run and not drawing:
                yield "text", name, None
        elif name in _DRAWING:
            drawing = max(0, drawing + (1 if kind == "start" else -1))
        elif drawing:
            continue
        elif name == "t":
            inside_t = kind == "start"
        elif name == "r":
            run = kind == "start"
        elif kind == "start" and name == "tab":
            if run:
                yield "text", "\t", None
        elif kind == "start" and name in ("br", "cr"):
            if run:
                yield "break", "", None
        else:
            yield kind, name, a


def _paragraphs(events: Iterator[Event]) -> Iterator[tuple[str, str, dict | None]]:
    """Segments as ``("segment", text)``; ends of paragraphs and breaks make one."""
    text: list[str] | None = None
    for kind, value, a in _runs(events):
        if kind == "text":
            if text is not None:
                text.append(value)
        elif kind == "break":
            if text is not None:
                yield "segment", "".join(text), None
                text = []
        else:
            if kind == "end" and value == "p":
                yield "segment", "".join(text or ()), None
                text = None
            yield kind, value, a
            if kind == "start" and value == "p":
                text = []


def _body(package: Package) -> Iterator[Unit]:
    paragraph = tables = 0
    heading, own, is_heading = "", "", False
    table: list[list[int]] = []
    cells: list[tuple[int, int, int]] = []
    for kind, value, a in _paragraphs(package.events("word/document.xml")):
        if kind == "segment":
            if is_heading:
                own = f"{own} {value}" if own else value
                heading = own
            if not cells:
                yield "docx_paragraph", {"paragraph": paragraph, "heading": heading or None}, value
            elif value.strip():
                t, r, c = cells[-1]
                yield "docx_cell", {"table": t, "row": r, "col": c, "heading": heading or None}, value
        elif kind == "start":
            if value == "p":
                is_heading, own = False, ""
                paragraph += not cells
            elif value == "pStyle":
                is_heading = is_heading or a.get("val", "").startswith("Heading")
            elif value == "tbl":
                tables += 1
                table.append([tables, 0, 0])
            elif value == "tr" and table:
                table[-1][1:] = [table[-1][1] + 1, 0]
            elif value == "tc" and table:
                table[-1][2] += 1
                cells.append(tuple(table[-1]))
        elif value == "tc" and cells:
            cells.pop()
        elif value == "tbl" and table:
            table.pop()


def _labelled(package: Package, part: str, kind: str, label: str, item: str | None = None) -> Iterator[Unit]:
    """Segments of a header, footer, or of a part with numbered items."""
    inside, count, current = item is None, 0, label
    for event, value, a in _paragraphs(package.events(part)):
        if event == "segment":
            if inside and value.strip():
                yield kind, {"label": current}, value
        elif item and value == item:
            inside = event == "start"
            if inside:
                count += 1
                current = f"{label} {a.get('id') or count}"


def extract_docx(data: bytes | IO[bytes]) -> Iterator[Unit]:
    """Body, headers, footers, footnotes, comments. The first error is raised at the
    end, after the other parts."""
    package = Package(data)
    jobs = [_body(package)]
    for word in ("header", "footer"):
        numbered = sorted((int(m[1] or 0), n) for n in package.names if (m := re.fullmatch(rf"word/{word}(\d*)\.xml", n)))
        jobs += [_labelled(package, n, "docx_header_footer", f"{word.title()} {i}" if i else word.title()) for i, n in numbered]
    for part, kind, label, item in (("word/footnotes.xml", "docx_footnote", "Footnote", "footnote"), ("word/comments.xml", "docx_comment", "Comment", "comment")):
        if part in package.names:
            jobs.append(_labelled(package, part, kind, label, item))
    failed = None
    for job in jobs:
        try:
            yield from job
        except ExtractError as e:
            failed = failed or e
    if failed:
        raise failed


# --- presentations


def _shapes(events: Iterator[Event]) -> Iterator[tuple[str, str]]:
    """(shape name, paragraph text); paragraphs without characters are left out."""
    shapes: list[list] = []
    count = 0
    text: list[str] | None = None
    inside = False
    for kind, space, name, a in events:
        if kind == "text":
            if inside and text is not None:
                text.append(name)
        elif space in _SLIDE_NS and name == "sp":
            if kind == "start":
                count += 1
                shapes.append([f"Shape {count}", False])
            elif shapes:
                shapes.pop()
        elif space in _SLIDE_NS and name == "cNvPr":
            if kind == "start" and shapes and not shapes[-1][1] and "name" in a:
                shapes[-1] = [a["name"] or shapes[-1][0], True]
        elif space in _DRAW_NS and name == "p":
            if kind == "end" and text:
                yield shapes[-1][0] if shapes else "Shape", "".join(text)
            text = [] if kind == "start" else None
        elif space in _DRAW_NS and name == "t":
            inside = kind == "start"


def extract_pptx(data: bytes | IO[bytes]) -> Iterator[Unit]:
    """Slides in presentation order, each followed by its notes; missing parts are
    passed over."""
    package = Package(data)
    main = "ppt/presentation.xml"
    targets = relations(package, main)
    order: list[str] = []
    for kind, _, name, a in package.events(main):
        if kind == "start" and name == "sldId":
            order += [targets[v][1] for v in a.values() if v in targets][:1]
    slide = 0
    for part in order:
        slide += 1
        if part not in package.names:
            continue
        for shape, text in _shapes(package.events(part)):
            yield "pptx_shape", {"slide": slide, "shape": shape}, text
        for kind, notes in relations(package, part).values():
            if kind == "notesSlide" and notes in package.names:
                for _, text in _shapes(package.events(notes)):
                    yield "pptx_notes", {"slide": slide}, text


# --- spreadsheets


def _rich(events: Iterator[Event], element: str) -> Iterator[str]:
    """The text of each ``element`` (its ``t`` parts, phonetic guides left out)."""
    parts: list[str] | None = None
    inside, phonetic = False, 0
    for kind, _, name, _a in events:
        if kind == "text":
            if inside and parts is not None and not phonetic:
                parts.append(name)
        elif name == element:
            if kind == "start":
                parts = []
            else:
                yield "".join(parts or ())
                parts = None
        elif name == "rPh":
            phonetic += 1 if kind == "start" else -1
        elif name == "t":
            inside = kind == "start"


def _cells(events: Iterator[Event], shared: list[str]) -> Iterator[tuple[str, int, int, str]]:
    """(reference, row, column, text) of the cells that have text."""
    row = column = 0
    cell: dict | None = None
    inside = ""
    for kind, _, name, a in events:
        if kind == "text":
            if cell is not None and inside:
                cell[inside] += name
        elif name == "row" and kind == "start":
            column = 0
            r = a.get("r", "")
            row = (int(r) if re.fullmatch(r"[+-]?\d+", r) else row) if r else row + 1
        elif name == "c" and kind == "start":
            cell = {"ref": a.get("r", ""), "type": a.get("t", ""), "v": "", "t": ""}
        elif name == "c" and cell is not None:
            text = cell["v"]
            if cell["type"] == "s":
                text = shared[int(text)] if text.isdecimal() and int(text) < len(shared) else ""
            elif cell["type"] == "inlineStr":
                text = cell["t"]
            elif cell["type"] == "b":
                text = {"1": "TRUE", "0": "FALSE"}.get(text, text)
            if text:
                at = parse_cell(cell["ref"])
                if at:
                    column = at[1]
                    yield cell["ref"], at[0], at[1], text
                else:
                    column += 1
                    yield f"{column_letters(column)}{row}", row, column, text
            cell = None
        elif name in ("v", "t"):
            inside = name if kind == "start" else ""


def extract_xlsx(data: bytes | IO[bytes]) -> Iterator[Unit]:
    """Sheets in tab order; a cell gives a unit for each of its non-empty lines."""
    package = Package(data)
    main = "xl/workbook.xml"
    targets = relations(package, main)
    sheets: list[tuple[str, str]] = []
    for kind, _, name, a in package.events(main):
        if kind == "start" and name == "sheet":
            sheets.append((a.get("name", ""), a.get("id", "")))
    strings = next((t for kind, t in targets.values() if kind == "sharedStrings"), "xl/sharedStrings.xml")
    shared = list(_rich(package.events(strings), "si")) if strings in package.names else []
    for sheet, key in sheets:
        part = targets.get(key, ("", ""))[1]
        if part not in package.names:
            continue
        for ref, row, column, text in _cells(package.events(part), shared):
            for line in text.split("\n"):
                if line:
                    yield "xlsx_cell", {"sheet": sheet, "cell": ref, "row": row, "col": column}, line


FORMATS = (
    Format("docx", (".docx",), lambda _, data: has_parts(data, "word/document.xml"), extract_docx, zipped=True),
    Format("pptx", (".pptx",), lambda _, data: has_parts(data, "ppt/presentation.xml"), extract_pptx, zipped=True),
    Format("xlsx", (".xlsx",), lambda _, data: has_parts(data, "xl/workbook.xml"), extract_xlsx, zipped=True),
)
