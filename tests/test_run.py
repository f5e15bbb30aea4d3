"""Whole runs over a folder, standard input, streams, SQL and sinks."""

import json

import pytest

from unitsieve import cli
from unitsieve.functions.pattern import compile_pattern
from unitsieve.model import SearchOptions
from unitsieve.operators import search as ops
from unitsieve.plans import render
from unitsieve.plans.run import run
from unitsieve.sinks import output
from unitsieve.streaming.context import search_stream


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.txt").write_text("one\nneedle here\nthree\nneedle\n")
    (tmp_path / "b.json").write_text('{"k": ["needle", 2]}')
    (tmp_path / "c.jsonl").write_text('{"k": "needle"}\n{broken\n')
    (tmp_path / "d.xlsx").write_bytes(render.as_xlsx([{"x": "a needle"}], "My Sheet"))
    (tmp_path / "e.bin").write_bytes(b"\x00needle")
    (tmp_path / "f.txt").write_text("nothing\n")
    return tmp_path


def test_run(spark, folder):
    r = run(spark, "needle", [str(folder)])
    got = {(x["path"].rpartition("/")[2], x["human"], x["text"]) for x in r.matches.collect()}
    assert got == {("a.txt", "2", "needle here"), ("a.txt", "4", "needle"), ("b.json", ".k[0] (line 1:16)", '.k[0] = "needle"'), ("c.jsonl", ".k (line 1:15)", '.k = "needle"'), ("d.xlsx", "My Sheet:A1", "a needle")}
    assert r.stats.first().asDict() == {"files_walked": 6, "files_searched": 5, "files_matched": 4, "total_matches": 5}
    assert [(e["path"].rpartition("/")[2], e["message"][:7]) for e in r.errors.collect()] == [("c.jsonl", "line 2:")]
    uris = {x["uri"].rpartition("/")[2] for x in r.matches.collect()}
    assert uris == {"a.txt:2:1", "a.txt:4:1", "b.json:1:16", "c.jsonl:1:15", "d.xlsx#'My%20Sheet'!A1"}


def test_types_stdin_and_missing_root(spark, folder):
    r = run(spark, "needle", ["-", str(folder)], SearchOptions(types=("text",)), b"x needle\r\n")
    assert {(x["path"].rpartition("/")[2], x["format"]) for x in r.matches.collect()} == {("-", "text"), ("a.txt", "text")}
    assert r.stats.first()["files_walked"] == 7
    r = run(spark, "needle", [str(folder / "a.txt"), str(folder / "none")])
    assert r.walk_error and r.matches.count() == 2


def test_duplicate_roots_count_twice(spark, folder):
    r = run(spark, "needle", [str(folder / "a.txt")] * 2)
    assert r.matches.count() == 4


def test_cli(spark, folder, capsys, monkeypatch):
    monkeypatch.chdir(folder)
    assert cli.main(["--color", "never", "-F", "needle", "a.txt"], spark) == 0
    assert capsys.readouterr().out == "a.txt:2 needle here\na.txt:4 needle\n"
    assert cli.main(["-c", "needle", "a.txt", "f.txt"], spark) == 0
    assert capsys.readouterr().out == "a.txt:2\n"
    assert cli.main(["-l", "needle", "a.txt", "f.txt"], spark) == 0
    assert capsys.readouterr().out == "a.txt\n"
    assert cli.main(["absent", "a.txt"], spark) == 1
    assert cli.main(["-l", "-c", "x", "a.txt"], spark) == 2
    assert cli.main(["(", "a.txt"], spark) == 2
    assert cli.main(["x", "missing"], spark) == 2
    capsys.readouterr()
    assert cli.main(["--json", "--stats", "needle"], spark, stdin=b"a needle\n") == 0
    out = capsys.readouterr()
    records = [json.loads(x) for x in out.out.splitlines()]
    assert records == [{"type": "match", "path": "-", "format": "text", "uri": "", "text": "a needle", "spans": [{"start": 2, "end": 8}], "line": 1, "col": 3}, {"type": "summary", "path": "-", "match_count": 1}]
    assert "1 files walked, 1 searched, 1 matched, 1 matches" in out.err


def test_sinks(spark, folder, tmp_path):
    r = run(spark, "needle", [str(folder / "a.txt")], SearchOptions(context=1))
    output.write_json(output.json_records(r.matches, r.summary), str(tmp_path / "out_json"))
    lines = [x["value"] for x in spark.read.text(str(tmp_path / "out_json")).collect()]
    assert [json.loads(x)["type"] for x in lines] == ["match"] * 4 + ["summary"]
    output.write_table(r.matches, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).where("is_match").count() == 2
    assert output.highlight("aéb", [(1, 3), (2, 3), (9, 12)]) == "a\x1b[1;31mé\x1b[0mb"


def test_sql(spark):
    from unitsieve import sql

    sql.register(spark)
    spark.createDataFrame([("a.json", bytearray(b'{"k": [1, 2]}'))], "path string, content binary").createOrReplaceTempView("docs")
    rows = spark.sql("SELECT d.path, u.keypath, u.text FROM docs d, LATERAL extract_units(d.path, d.content) u ORDER BY u.ord").collect()
    assert [tuple(r) for r in rows] == [("a.json", ".k[0]", ".k[0] = 1"), ("a.json", ".k[1]", ".k[1] = 2")]


@pytest.mark.parametrize("options", [SearchOptions(before=1, after=1), SearchOptions(max_count=2, after=1), SearchOptions(invert=True)])
def test_stream_equals_batch(spark, tmp_path, options):
    rows = [("f%d" % (i % 3), i // 3, "hit" if i * 7 % 5 == 0 else "miss") for i in range(90)]
    for k in range(3):
        part = spark.createDataFrame(rows[30 * k : 30 * k + 30], "path string, ord long, text string")
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema("path string, ord long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    name = f"out_{abs(hash(options))}"
    q = search_stream(stream, compile_pattern("hit"), options).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["path"], r["ord"]) for r in spark.table(name).collect()}
    batch = ops.search(spark.createDataFrame(rows, "path string, ord long, text string"), compile_pattern("hit"), options)
    assert got == {(r["path"], r["ord"]) for r in batch.collect()}


def test_uris_in_the_engine(spark):
    """Expressions of the engine encode as the functions for single paths do."""
    from pyspark.sql import functions as F

    from unitsieve.functions import paths

    every = ["/a b/c+d#e?f%.txt", "rel/é ß日.md", "./x", "../up/./y//z", "/..", "/a/..", "/a/b/", "a~$&,:;=@!'()*-_.txt", '"<>[]{}|^`\\', "hdfs://host:9/a b/c%20d", "."]
    rows = spark.createDataFrame([(x,) for x in every], "p string").select("p", paths.file_uri_column(F.col("p")).alias("u"), paths.fragment_column(F.col("p")).alias("f")).collect()
    assert [(r["p"], r["u"], r["f"]) for r in rows] == [(x, paths.file_uri(x), paths.fragment(x)) for x in every]
