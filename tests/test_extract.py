"""Extractors: bytes in, (location, text) out."""

import pytest

from unitsieve.extract import dispatch, html, jsonish, odf, ooxml, text, toml, xml, yaml
from unitsieve.extract.registry import ExtractError
from unitsieve.plans import render


def texts(units):
    return [t for _, _, t in units]


def partial(units):
    out, error = [], None
    try:
        for u in units:
            out.append(u)
    except ExtractError as e:
        error = str(e)
    return out, error


def test_text_lines():
    assert texts(text.extract(b"alpha\r\nbeta\n\ngamma")) == ["alpha", "beta", "", "gamma"]
    assert texts(text.extract(b"")) == []
    assert texts(text.extract(b"x\n")) == ["x"]
    out, error = partial(text.extract(b"a\n" + b"z" * ((1 << 20) + 1) + b"\nb"))
    assert [u[2] for u in out] == ["a"] and "too long" in error


def test_json_paths_and_positions():
    data = b'{"a": 1, "b-c": [true, {"d": "x<y"}], "e": {}, "f": [], "a": 1.50}'
    got = [(u[1]["jsonpath"], u[2]) for u in jsonish.extract_json(data)]
    assert got == [(".a", ".a = 1"), ('.["b-c"][0]', '.["b-c"][0] = true'), ('.["b-c"][1].d', '.["b-c"][1].d = "x\\u003cy"'), (".e", ".e = {}"), (".f", ".f = []"), (".a", ".a = 1.50")]
    (first, *_) = jsonish.extract_json(b'{\n  "k": 87}')
    assert (first[1]["line"], first[1]["col"]) == (2, 10)


def test_json_roots_bom_and_errors():
    assert texts(jsonish.extract_json(b"\xef\xbb\xbf3 4")) == [". = 3"]
    assert texts(jsonish.extract_json(b"[[]]")) == [".[0] = []"]
    out, error = partial(jsonish.extract_json(b'{"a": 1, "b": '))
    assert [u[2] for u in out] == [".a = 1"] and error


def test_jsonl():
    out, error = partial(jsonish.extract_jsonl(b'{"a":1}\n\n{"b":2}\n{bad\n{"c":3}'))
    assert [(u[1]["line"], u[2]) for u in out] == [(1, ".a = 1"), (3, ".b = 2")]
    assert error.startswith("line 4:")


def test_jsonc():
    data = b'// top\n{"u": "http://x//y", /* in */ "a": [1, 2,],}\n// end'
    got = [(u[0], u[2]) for u in jsonish.extract_jsonc(data)]
    assert got == [("jsonc_comment", "// top"), ("jsonc_comment", "/* in */"), ("jsonc_comment", "// end"), ("json_path", '.u = "http://x//y"'), ("json_path", ".a[0] = 1"), ("json_path", ".a[1] = 2")]


def test_yaml():
    data = b"a: 1\nb:\n  - x\n  - {c: 'q', d: {}}\n  - &n [1, *n]\n1.5: !!str t\nnull: ~\nempty:\n"
    got = texts(yaml.extract(data))
    assert got == [".a = 1", ".b[0] = x", ".b[1].c = 'q'", ".b[1].d = {}", ".b[2][0] = 1", ".b[2][1] = *n", '.["1.5"] = t', ".null = ~", ".empty = null"]
    assert texts(yaml.extract(b"a: 1\n---\nb: 2\n")) == [".document[0].a = 1", ".document[1].b = 2"]
    assert partial(yaml.extract(b"a: [1\nb: 2"))[1]


def test_toml():
    data = b'# top\nt = 0x1F # why\n[srv]\n[srv.a]\nx = [1, # one\n 2]\n[empty]\n[[p]]\nn = "a"\n[[p]]\nn = "b"\nq = { r = 1, s = {} }\nd = 1979-05-27T07:32:00Z\n'
    got = [(u[1].get("tomlpath", "#"), u[1]["line"], u[1]["col"]) for u in toml.extract(data)]
    assert got == [("#", 1, 1), (".t", 2, 5), ("#", 2, 10), (".srv.a.x[0]", 5, 6), ("#", 5, 9), (".srv.a.x[1]", 6, 2), (".empty", 7, 2), (".p[0].n", 9, 5), (".p[1].n", 11, 5), (".p[1].q.r", 12, 11), (".p[1].q.s", 12, 18), (".p[1].d", 13, 5)]
    assert list(toml.extract(data))[1][2] == "t = 0x1F # why"


def test_xml():
    data = b'<r a="1" xmlns:p="u">\n <p:i>one</p:i>\n <i>two <b>x</b> three</i><i><![CDATA[<c>]]></i>\n</r>'
    got = [(u[1]["xpath"], u[2], u[1]["line"], u[1]["col"]) for u in xml.extract(data)]
    assert got == [("/r/@a", "1", 1, 22), ("/r/i[1]", "one", 2, 10), ("/r/i[2]/b[1]", "x", 3, 13), ("/r/i[2]", "two  three", 3, 9), ("/r/i[3]", "<c>", 3, 45)]
    out, error = partial(xml.extract(b"<r><i>ok</i><j></r>"))
    assert [u[2] for u in out] == ["ok"] and error


def test_html():
    data = b"<html><body><h1>Ti &amp; tle</h1>\n<p>one<br>two\n  <b>bold</b> end<ul><li>a<li>b</ul><script>no</script><pre>x\n y</pre></body>"
    got = [(u[1]["htmlpath"].rpartition(">")[2], u[2], u[1]["line"]) for u in html.extract(data)]
    assert got == [
        ("h1:nth-of-type(1)", "Ti & tle", 1),
        ("b:nth-of-type(1)", "bold", 3),
        ("li:nth-of-type(1)", "a", 3),
        ("li:nth-of-type(2)", "b", 3),
        ("pre:nth-of-type(1)", "x", 3),
        ("pre:nth-of-type(1)", "y", 4),
        ("p:nth-of-type(1)", "one", 2),
        ("p:nth-of-type(1)", "two end", 2),
    ]


def test_html_references():
    data = b"<title>&quot;a&quot; &amp;lt; &eacute;</title><p>ver&amp</p>"
    assert texts(html.extract(data)) == ['"a" &lt; \u00e9', "ver&"]
    assert texts(html.extract(data, html.unescape_markup)) == ["&quot;a&quot; &lt; &eacute;", "ver&amp"]


def test_html_depth_and_stray_tags():
    assert texts(html.extract(b"<p>" * 1200 + b"deep")) == ["deep"]
    assert texts(html.extract(b"</x><p>a</b>b</p>")) == ["ab"]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_docx():
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    body = (
        f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr>{run("Top")}</w:p><w:p/><w:p>{run("a")}<w:r><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p>'
        f"<w:tbl><w:tr><w:tc><w:p>{run('c1')}</w:p><w:p/></w:tc><w:tc><w:p>{run('c2')}</w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:drawing>{run('no')}</w:drawing></w:r>{run('z')}</w:p>"
    )
    data = render.package({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/header2.xml": f"<w:hdr {W}><w:p>{run('h2')}</w:p></w:hdr>", "word/header1.xml": f"<w:hdr {W}><w:p>{run('h1')}</w:p></w:hdr>", "word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:id="3"><w:p>{run("fn")}</w:p></w:footnote></w:footnotes>'})
    got = [(u[0], {k: v for k, v in u[1].items() if v is not None}, u[2]) for u in ooxml.extract_docx(data)]
    top = {"heading": "Top"}
    assert got == [
        ("docx_paragraph", {"paragraph": 1, **top}, "Top"),
        ("docx_paragraph", {"paragraph": 2, **top}, ""),
        ("docx_paragraph", {"paragraph": 3, **top}, "a\tb"),
        ("docx_paragraph", {"paragraph": 3, **top}, "c"),
        ("docx_cell", {"table": 1, "row": 1, "col": 1, **top}, "c1"),
        ("docx_cell", {"table": 1, "row": 1, "col": 2, **top}, "c2"),
        ("docx_paragraph", {"paragraph": 4, **top}, "z"),
        ("docx_header_footer", {"label": "Header 1"}, "h1"),
        ("docx_header_footer", {"label": "Header 2"}, "h2"),
        ("docx_footnote", {"label": "Footnote 3"}, "fn"),
    ]
    assert ooxml.FORMATS[0].sniff("x", data)


def test_xlsx_types_and_refs():
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    data = render.package(
        {
            "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="B" r:id="r2"/><sheet name="A" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="x"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/s1.xml"/><Relationship Id="r2" Type="{rel}/worksheet" Target="/xl/worksheets/s2.xml"/></Relationships>',
            "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r><rPh><t>no</t></rPh></si></sst>',
            "xl/worksheets/s1.xml": f'<worksheet xmlns="{main}"><sheetData><row r="4"><c r="B4" t="s"><v>1</v></c><c t="b"><v>1</v></c><c><f>1+1</f><v>2.50</v></c><c t="s"><v>9</v></c></row></sheetData></worksheet>',
            "xl/worksheets/s2.xml": f'<worksheet xmlns="{main}"><sheetData><row><c t="inlineStr"><is><t>x\n\ny</t></is></c></row></sheetData></worksheet>',
        }
    )
    got = [(u[1]["sheet"], u[1]["cell"], u[2]) for u in ooxml.extract_xlsx(data)]
    assert got == [("B", "A1", "x"), ("B", "A1", "y"), ("A", "B4", "two"), ("A", "C4", "TRUE"), ("A", "D4", "2.50")]


def test_pptx_round_trip_and_order():
    data = render.as_pptx([["a", "b"], ["c & d"]])
    assert [(u[1]["slide"], u[1]["shape"], u[2]) for u in ooxml.extract_pptx(data)] == [(1, "Title", "a"), (1, "Title", "b"), (2, "Title", "c & d")]


def test_odt():
    body = '<text:h>Head</text:h><text:p>a<text:tab/>b<text:s text:c="3"/>c<text:line-break/>d<text:note>no</text:note></text:p><table:table><table:table-row><table:table-cell table:number-columns-repeated="2"><text:p>x</text:p></table:table-cell><table:table-cell><text:h>in</text:h><text:p>y</text:p></table:table-cell></table:table-row></table:table><text:p/>'
    got = [(u[0], u[1].get("col") or u[1].get("paragraph"), u[1]["heading"], u[2]) for u in odf.extract_odt(render._odf("text", body))]
    assert got == [("odt_paragraph", 1, "Head", "Head"), ("odt_paragraph", 2, "Head", "a\tb   c"), ("odt_paragraph", 2, "Head", "d"), ("odt_cell", 1, "Head", "x"), ("odt_cell", 3, "in", "in"), ("odt_cell", 3, "in", "y"), ("odt_paragraph", 3, "Head", "")]


def test_ods_repeats():
    body = '<table:table table:name="S"><table:table-row table:number-rows-repeated="3"><table:table-cell table:number-columns-repeated="2"><text:p>a</text:p></table:table-cell><table:table-cell><text:p> </text:p></table:table-cell></table:table-row><table:table-row><table:table-cell/><table:table-cell><text:p>b</text:p></table:table-cell></table:table-row></table:table>'
    assert [(u[1]["cell"], u[1]["repeat"], u[2]) for u in odf.extract_ods(render._odf("spreadsheet", body))] == [("A1", 6, "a"), ("B4", 1, "b")]


def test_odp_notes():
    body = '<draw:page><draw:frame><draw:text-box><text:p>t</text:p></draw:text-box></draw:frame><presentation:notes><draw:page/><draw:frame draw:name="N"><draw:text-box><text:p>note</text:p></draw:text-box></draw:frame></presentation:notes></draw:page><draw:page><text:p>u</text:p></draw:page>'
    assert [(u[0], u[1]["slide"], u[1].get("shape"), u[2]) for u in odf.extract_odp(render._odf("presentation", body))] == [("odp_shape", 1, "Shape 1", "t"), ("odp_notes", 1, None, "note"), ("odp_shape", 2, "Shape", "u")]


@pytest.mark.parametrize(
    ("path", "data", "name"),
    [
        ("a.json", b'{"a":1}', "json"),
        ("a.json", b"plain words", "text"),
        ("a.jsonl", b'\n{"a":1}\n', "jsonl"),
        ("a.jsonc", b"// c\n{}", "jsonc"),
        ("a.jsonc", b'{"a": ', "json"),
        ("a.yaml", b"a: 1\n", "yaml"),
        ("a.yaml", b"just prose\n", "text"),
        ("a.toml", b"a = 1\n", "toml"),
        ("a.toml", b"# only\n", "text"),
        ("a.xml", b"<?xml version='1.0'?><r/>", "xml"),
        ("a.html", b"<p>x", "html"),
        ("page.bin", b"<!doctype html><p>", "html"),
        ("a.txt", b"x\x00y", None),
        ("empty.txt", b"", "text"),
        ("~$lock.docx", b"\x05user lock file", None),
        ("a.bin", render.as_xlsx([{"a": 1}]), "xlsx"),
        ("a.odt", render.as_odt(["x"]), "odt"),
        ("a.zip", render.as_odp([["x"]]), "odp"),
    ],
)
def test_dispatch(path, data, name):
    assert dispatch.claim(path, data) == name


def test_register():
    from unitsieve.extract.registry import Format

    fmt = Format("rev", (".rev",), lambda p, d: p.endswith(".rev"), lambda d: iter([("text_line", {"line": 1}, d.decode()[::-1])]))
    dispatch.register(fmt)
    try:
        assert dispatch.claim("x.rev", b"abc") == "rev" and list(dispatch.EXTRACTORS)[-1] == "text"
    finally:
        del dispatch.EXTRACTORS["rev"]


def test_ods_cells_after_repeats_and_sheets():
    """Rows and columns go on after repeats; a sheet without a name is numbered; side notes stay out."""
    cell = lambda t, n=1: f'<table:table-cell table:number-columns-repeated="{n}">' + (f"<text:p>{t}</text:p>" if t else "") + "</table:table-cell>"
    one = f'<table:table table:name="A"><table:table-row>{cell("", 3)}{cell("d")}{cell("e", 2)}{cell("g")}</table:table-row><table:table-row table:number-rows-repeated="1048570"/><table:table-row>{cell("x<text:line-break/>y")}<table:covered-table-cell/>{cell("c")}</table:table-row></table:table>'
    two = f'<table:table><table:table-row table:number-rows-repeated="2">{cell("p", 2)}<table:table-cell><office:annotation><text:p>no</text:p></office:annotation><text:p>q</text:p></table:table-cell></table:table-row></table:table>'
    got = [(u[1]["sheet"], u[1]["cell"], u[1]["repeat"], u[2]) for u in odf.extract_ods(render._odf("spreadsheet", one + two))]
    assert got == [("A", "D1", 1, "d"), ("A", "E1", 2, "e"), ("A", "G1", 1, "g"), ("A", "A1048572", 1, "x"), ("A", "A1048572", 1, "y"), ("A", "C1048572", 1, "c"), ("Sheet2", "A1", 4, "p"), ("Sheet2", "C1", 2, "q")]


def test_pptx_notes_unnamed_shapes_and_missing_parts():
    """Slides in the order of the presentation, notes by the slide's own relations."""
    p, a, r = "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shape = lambda name, *ts: f'<p:sp>{"" if name is None else f"<p:nvSpPr><p:cNvPr id=\"1\" name=\"{name}\"/></p:nvSpPr>"}<p:txBody>' + "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in ts) + "<a:p/></p:txBody></p:sp>"
    slide = lambda *shapes: f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree>{"".join(shapes)}</p:spTree></p:cSld></p:sld>'
    rels = lambda *xs: '<Relationships xmlns="x">' + "".join(f'<Relationship Id="{i}" Type="{r}/{k}" Target="{t}"/>' for i, k, t in xs) + "</Relationships>"
    data = render.package(
        {
            "ppt/presentation.xml": f'<p:presentation xmlns:p="{p}" xmlns:r="{r}"><p:sldIdLst><p:sldId id="256" r:id="r2"/><p:sldId id="257" r:id="r9"/><p:sldId id="258" r:id="r1"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": rels(("r1", "slide", "slides/slide1.xml"), ("r2", "slide", "slides/slide2.xml"), ("r9", "slide", "slides/none.xml")),
            "ppt/slides/slide1.xml": slide(shape("Body", "last")),
            "ppt/slides/slide2.xml": slide(shape(None, "first", "second"), shape("", "third")),
            "ppt/slides/_rels/slide2.xml.rels": rels(("n", "notesSlide", "../notesSlides/notesSlide7.xml")),
            "ppt/notesSlides/notesSlide7.xml": slide(shape("Notes", "say it")),
        }
    )
    got = [(u[0], u[1]["slide"], u[1].get("shape"), u[2]) for u in ooxml.extract_pptx(data)]
    assert got == [("pptx_shape", 1, "Shape 1", "first"), ("pptx_shape", 1, "Shape 1", "second"), ("pptx_shape", 1, "Shape 2", "third"), ("pptx_notes", 1, None, "say it"), ("pptx_shape", 3, "Body", "last")]


def test_yaml_documents_anchors_and_keys():
    """Several documents are numbered, aliases are leaves, keys keep their spelling."""
    got = [(u[1]["line"], u[1]["col"], u[2]) for u in yaml.extract(b"a: &x {k: 1}\nb: *x\n---\n- 2\n- [3, {c d: q}]\n---\ntrue: y\n")]
    assert got == [(1, 11, ".document[0].a.k = 1"), (2, 4, ".document[0].b = *x"), (4, 3, ".document[1].[0] = 2"), (5, 4, ".document[1].[1][0] = 3"), (5, 13, '.document[1].[1][1].["c d"] = q'), (7, 7, ".document[2].true = y")]


def test_docx_comments_and_broken_parts():
    """Parts after a broken one still come; its error is raised at the end."""
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    data = render.package({"word/document.xml": f"<w:document {W}><w:body><w:p>{run('body')}</w:p>", "word/comments.xml": f'<w:comments {W}><w:comment w:id="4"><w:p>{run("note")}</w:p><w:p/></w:comment></w:comments>', "word/footer1.xml": f"<w:ftr {W}><w:p>{run('foot')}</w:p></w:ftr>"})
    out, error = partial(ooxml.extract_docx(data))
    assert [(u[0], u[1].get("label"), u[2]) for u in out] == [("docx_paragraph", None, "body"), ("docx_header_footer", "Footer 1", "foot"), ("docx_comment", "Comment 4", "note")]
    assert "word/document.xml" in error
