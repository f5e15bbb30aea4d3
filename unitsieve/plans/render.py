"""Small documents made from tables, for round trips through the extractors."""

from __future__ import annotations

import io
import json
import zipfile
from xml.sax.saxutils import escape, quoteattr

Rows = list[dict]


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def as_json(rows: Rows) -> bytes:
    return json.dumps(rows, ensure_ascii=False, separators=(",", ":")).encode()


def as_jsonl(rows: Rows) -> bytes:
    return b"".join(json.dumps(r, ensure_ascii=False).encode() + b"\n" for r in rows)


def as_jsonc(rows: Rows) -> bytes:
    return b"// made from a table\n[\n" + b"".join(b"  " + json.dumps(r, ensure_ascii=False).encode() + b", // row\n" for r in rows) + b"]\n"


def as_yaml(rows: Rows) -> bytes:
    return "".join("- " + "\n  ".join(f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in r.items()) + "\n" for r in rows).encode()


def as_toml(rows: Rows, name: str = "row") -> bytes:
    return "".join(f"[[{name}]]\n" + "".join(f"{k} = {json.dumps(v, ensure_ascii=False)}\n" for k, v in r.items()) for r in rows).encode()


def as_xml(rows: Rows, name: str = "row") -> bytes:
    return ("<table>" + "".join(f"<{name} " + " ".join(f"{k}={quoteattr(str(v))}" for k, v in r.items()) + "/>\n" for r in rows) + "</table>").encode()


def as_xlsx(rows: Rows, sheet: str = "Data") -> bytes:
    body = "".join(f'<row r="{i}">' + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for v in r.values()) + "</row>" for i, r in enumerate(rows, 1))
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    return package(
        {
            "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
        }
    )


_ODF = " ".join(f'xmlns:{p}="urn:oasis:names:tc:opendocument:xmlns:{n}:1.0"' for p, n in (("office", "office"), ("text", "text"), ("table", "table"), ("draw", "drawing"), ("presentation", "presentation")))


def _odf(kind: str, body: str) -> bytes:
    element = {"text": "text", "spreadsheet": "spreadsheet", "presentation": "presentation"}[kind]
    return package({"mimetype": f"application/vnd.oasis.opendocument.{kind}", "content.xml": f"<office:document-content {_ODF}><office:body><office:{element}>{body}</office:{element}></office:body></office:document-content>"})


def as_ods(rows: Rows, sheet: str = "Data") -> bytes:
    body = "".join("<table:table-row>" + "".join(f"<table:table-cell><text:p>{escape(str(v))}</text:p></table:table-cell>" for v in r.values()) + "</table:table-row>" for r in rows)
    return _odf("spreadsheet", f"<table:table table:name={quoteattr(sheet)}>{body}</table:table>")


def as_docx(paragraphs: list[str]) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
    return package({"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'})


def as_odt(paragraphs: list[str]) -> bytes:
    return _odf("text", "".join(f"<text:p>{escape(p)}</text:p>" for p in paragraphs))


def as_pptx(slides: list[list[str]]) -> bytes:
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    p, a = "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main"
    parts = {
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{p}" xmlns:r="{rel}"><p:sldIdLst>' + "".join(f'<p:sldId id="{255 + i}" r:id="s{i}"/>' for i in range(1, len(slides) + 1)) + "</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="s{i}" Type="{rel}/slide" Target="slides/slide{i}.xml"/>' for i in range(1, len(slides) + 1)) + "</Relationships>",
    }
    for i, lines in enumerate(slides, 1):
        text = "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in lines)
        parts[f"ppt/slides/slide{i}.xml"] = f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree><p:sp><p:nvSpPr><p:cNvPr id="2" name="Title"/></p:nvSpPr><p:txBody>{text}</p:txBody></p:sp></p:spTree></p:cSld></p:sld>'
    return package(parts)


def as_odp(slides: list[list[str]]) -> bytes:
    return _odf("presentation", "".join("<draw:page><draw:frame draw:name=\"Title\"><draw:text-box>" + "".join(f"<text:p>{escape(x)}</text:p>" for x in lines) + "</draw:text-box></draw:frame></draw:page>" for lines in slides))
