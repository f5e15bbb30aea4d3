"""Batches over many files, bounded memory, stored folders and streamed input."""

import io
import itertools
import json
import sys
import tracemalloc

import pytest
from pyspark.sql import functions as F

from unitsieve import cli
from unitsieve.extract import dispatch
from unitsieve.functions.pattern import compile_pattern
from unitsieve.model import SearchOptions
from unitsieve.operators import search as ops
from unitsieve.plans import render
from unitsieve.plans.run import run
from unitsieve.sources import files
from unitsieve.streaming import lines

MIB = 1 << 20


def peak(path):
    """Bytes held at most while a file's units are read, and their number."""
    tracemalloc.start()
    with open(path, "rb") as f:
        name, units = dispatch.open_units(str(path), f)
        n = sum(1 for _ in units)
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return name, n, top


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def as_sheet(n):
    rows = "".join(f'<row r="{i}">' + "".join(f'<c r="{c}{i}" t="s"><v>{i % 50}</v></c>' for c in "ABC") + "</row>" for i in range(1, n + 1))
    return render.package(
        {
            "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="x"><Relationship Id="r1" Type="{REL}/worksheet" Target="worksheets/s1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}">' + "".join(f"<si><t>text {k}</t></si>" for k in range(50)) + "</sst>",
            "xl/worksheets/s1.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>',
        }
    )


MAKERS = {
    "a.txt": (lambda n: b"".join(b"line %06d with some words on it, fifty in all\n" % i for i in range(n)), 300, 300_000, 8 * MIB),
    "a.docx": (lambda n: render.package({"word/document.xml": f"<w:document {W}><w:body>" + "".join(f"<w:p><w:r><w:t>paragraph {i}</w:t></w:r></w:p>" for i in range(n)) + "</w:body></w:document>"}), 100, 100_000, 20 * MIB),
    "a.xlsx": (as_sheet, 100, 120_000, 32 * MIB),
    "a.pptx": (lambda n: render.as_pptx([[f"t{i}", "u", "v", "w"] for i in range(n)]), 5, 5_000, 64 * MIB),
    "a.odt": (lambda n: render.as_odt([f"paragraph {i}" for i in range(n)]), 10, 10_000, None),
    "a.ods": (lambda n: render.as_ods([{"a": f"x{i}", "b": "y"} for i in range(n)]), 10, 10_000, None),
    "a.odp": (lambda n: render.as_odp([[f"t{i}", "u"] for i in range(n)]), 5, 5_000, None),
}


@pytest.mark.parametrize("name", MAKERS)
def test_memory_does_not_grow_with_the_file(tmp_path, name):
    """The bounds the survey lists for each format: a cap, and 50 times a small file."""
    make, few, many, cap = MAKERS[name]
    tops, counts = [], []
    for n in (few, many):
        path = tmp_path / f"{n}{name}"
        path.write_bytes(make(n))
        found, units, top = peak(path)
        assert found == name[2:].replace("txt", "text")
        tops.append(top)
        counts.append(units)
    assert counts[1] >= many and counts[0] >= few
    assert tops[1] <= (cap or 64 * MIB) and (name == "a.pptx" or tops[1] <= 50 * tops[0]), tops


def test_small_files_share_batches():
    out = files._Batches()
    batches = []
    for i in range(10_000):
        batches += out.units(f"{i}.json", "json", iter([("json_path", {"line": 1, "jsonpath": ".a"}, "x")]))
    batches += out.rest()
    assert len(batches) == 10 and sum(b.num_rows for b in batches) == 20_000
    first = batches[0].slice(0, 2).to_pylist()
    assert first[0]["ord"] is None and first[0]["loc"] is None and first[0]["text"] is None
    assert first[1]["ord"] == 0 and first[1]["loc"]["jsonpath"] == ".a" and first[1]["loc"]["cell"] is None


def test_failure_halfway_keeps_units(spark):
    frame = spark.createDataFrame([("a.jsonl", b'{"k": 1}\n{bad'), ("b.jsonl", b'{"k": 2}'), ("c.txt", b"")], "path string, content binary")
    got = [(r["path"], r["ord"], r["text"], r["error"] is not None) for r in files.content_units(frame.coalesce(1), F.col("path"), F.col("content")).collect()]
    assert got == [("a.jsonl", None, None, False), ("a.jsonl", 0, ".k = 1", False), ("a.jsonl", None, None, True), ("b.jsonl", None, None, False), ("b.jsonl", 0, ".k = 2", False), ("c.txt", None, None, False)]


def test_stored_folder(spark, tmp_path):
    """A root with a scheme is listed and read by Spark alone."""
    (tmp_path / "in").mkdir()
    (tmp_path / "a.txt").write_text("needle\nx\n")
    (tmp_path / "in" / "b.json").write_text('{"k": "needle"}')
    (tmp_path / "in" / "c.skip").write_text("needle")
    root = f"file://{tmp_path}"
    r = run(spark, "needle", [root], SearchOptions(exclude=("*.skip",)))
    assert {(x["path"].rpartition("/")[2], x["text"]) for x in r.matches.collect()} == {("a.txt", "needle"), ("b.json", '.k = "needle"')}
    assert r.stats.first()["files_walked"] == 2 and all("://" not in x["uri"][7:] for x in r.matches.collect())
    r.close()
    r = run(spark, "needle", [root, f"{root}/none"], SearchOptions(types=("json",)))
    assert r.matches.count() == 1 and "none" in str(r.walk_error)
    r.close()


@pytest.mark.parametrize("options", [SearchOptions(), SearchOptions(before=2, after=1), SearchOptions(max_count=3, after=2), SearchOptions(invert=True, max_count=4)])
def test_streamed_lines_equal_batch(spark, monkeypatch, options):
    """Context and caps carry over from chunk to chunk."""
    monkeypatch.setattr(lines, "CHUNK_LINES", 4)
    data = "".join(("hit" if i * 7 % 5 == 0 or i == 12 else "miss") + f" {i}\n" for i in range(23)).encode()
    matcher = compile_pattern("hit")
    found = lines.LineSearch(spark, io.BytesIO(data), matcher, options)
    got = [(r["ord"], r["text"], r["is_match"], r["human"], [tuple(s) for s in r["spans"]]) for frame in found for r in frame.orderBy("ord").collect()]
    batch = ops.search(files.stdin_units(spark, data), matcher, options).orderBy("ord").collect()
    assert got == [(r["ord"], r["text"], r["is_match"], str(r["ord"] + 1), [tuple(s) for s in r["spans"]]) for r in batch]
    assert found.count == sum(r["is_match"] for r in batch)


class Endless(io.RawIOBase):
    """Lines without end; counts what was read."""

    def __init__(self):
        self.n = 0

    def readline(self, limit=-1):
        self.n += 1
        return b"a needle\n" if self.n % 10 == 0 else b"hay\n"


def test_endless_input_stops_at_the_cap(spark, monkeypatch):
    monkeypatch.setattr(lines, "CHUNK_LINES", 50)
    source = Endless()
    found = list(itertools.chain.from_iterable(f.collect() for f in lines.LineSearch(spark, source, compile_pattern("needle"), SearchOptions(max_count=7))))
    assert [r["ord"] for r in found] == [9, 19, 29, 39, 49, 59, 69] and source.n <= 150


def test_cli_reads_standard_input_as_it_comes(spark, monkeypatch, capsys):
    monkeypatch.setattr(lines, "CHUNK_LINES", 50)
    monkeypatch.setattr(sys, "stdin", type("Stdin", (), {"buffer": Endless()})())
    assert cli.main(["-m", "2", "--json", "needle", "-"], spark) == 0
    records = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(r["type"], r.get("line")) for r in records] == [("match", 10), ("match", 20), ("summary", None)]
    assert cli.main(["-l", "needle", "-"], spark) == 0
    assert capsys.readouterr().out == "-\n"
    assert cli.main(["needle"], spark, stdin=b"x\n" + b"y" * (1 << 20) + b"\n") == 1
    assert "too long" in capsys.readouterr().err


def test_sql_reports_failures(spark):
    from unitsieve import sql

    sql.register(spark)
    spark.createDataFrame([("a.jsonl", bytearray(b'{"k": 1}\n{bad'))], "path string, content binary").createOrReplaceTempView("broken")
    rows = spark.sql("SELECT u.* FROM broken d, LATERAL extract_units(d.path, d.content) u").collect()
    assert [(r["ord"], r["loc_kind"]) for r in rows] == [(0, "jsonl_path"), (None, "error")] and rows[1]["text"].startswith("line 2:")


@pytest.mark.parametrize(("pattern", "kw"), [("ab", {}), ("ab", {"ignore_case": True}), ("ab", {"word": True}), ("a[bc]|x*", {})])
def test_spans_of_a_line_with_many_hits(spark, pattern, kw):
    """More hits than one block of sums holds."""
    import re

    text = "".join(["é ab", " ac,", "ab ab", "q"][i % 4] for i in range(3000))
    rx = {"ab": "ab", "a[bc]|x*": "a[bc]|x*"}[pattern]
    want, last = [], -1
    for m in re.finditer(rx, text):
        a, b = len(text[: m.start()].encode()), len(text[: m.end()].encode())
        edge = not kw.get("word") or not (re.match(r"\w", text[m.end() : m.end() + 1]) or re.search(r"\w$", text[: m.start()][-1:]))
        if edge and (b > a or a != last):
            want.append((a, b))
        last = b
    got = spark.createDataFrame([(text,)], "t string").select(compile_pattern(pattern, **kw).spans(F.col("t")).alias("s")).first()["s"]
    assert [(s["start"], s["end"]) for s in got] == want and len(want) > 1000


def test_a_failing_sink_costs_one_line():
    from unitsieve.sinks import output

    class Bad(io.StringIO):
        def write(self, text):
            if "two" in text:
                raise OSError("disk full")
            if "three" in text:
                raise RuntimeError
            return super().write(text)

    sink, warn = Bad(), io.StringIO()
    assert output.emit(["one", "two", "three", "four"], sink, warn) == 2
    assert sink.getvalue() == "one\nfour\n" and warn.getvalue() == "warning: writing a record: disk full\nwarning: writing a record: RuntimeError\n"
