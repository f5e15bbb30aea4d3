"""Patterns, spans, context and caps against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from unitsieve.functions.pattern import PatternError, compile_pattern, translate
from unitsieve.model import OptionError, SearchOptions
from unitsieve.operators import search as ops
from unitsieve.streaming.context import fresh, step


def spans(spark, pattern, text, **kw):
    m = compile_pattern(pattern, spark=spark, **kw)
    r = spark.createDataFrame([(text,)], "t string").select(m.matches(F.col("t")).alias("m"), m.spans(F.col("t")).alias("s")).first()
    return r["m"], [(s["start"], s["end"]) for s in r["s"]]


@pytest.mark.parametrize(
    ("pattern", "text", "kw", "want"),
    [
        ("ab", "abxabab", {}, [(0, 2), (3, 5), (5, 7)]),
        ("aa", "aaaaa", {}, [(0, 2), (2, 4)]),
        ("é", "aéé", {}, [(1, 3), (3, 5)]),
        ("É", "xé", {"ignore_case": True}, [(1, 3)]),
        ("the", "the then _the the", {"word": True}, [(0, 3), (14, 17)]),
        ("aa", "aaa aa", {"word": True}, [(4, 6)]),
        ("a*", "baac", {}, [(0, 0), (1, 3), (4, 4)]),
        ("\\ba", "éa", {}, [(2, 3)]),
        ("b$", "ab\u0085", {}, []),
        ("\\s", "a\x0bb", {}, []),
        ("(?i)é", "É", {}, [(0, 2)]),
        ("a.b", "a\u0085b", {}, [(0, 4)]),
        ("x|y+", "xyyx", {}, [(0, 1), (1, 3), (3, 4)]),
        ("(?U)a+", "aa", {}, [(0, 1), (1, 2)]),
        ("[[:alpha:]]+", "ab1c", {}, [(0, 2), (3, 4)]),
        ("(?P<n>a)b", "xab", {}, [(1, 3)]),
        ("\\x{e9}", "é", {}, [(0, 2)]),
        ("[]a]", "]", {}, [(0, 1)]),
        ("a.c", "a.c abc", {"fixed": True}, [(0, 3)]),
        ("th|on", "on thon", {"word": True}, [(0, 2)]),
        ("", "abc", {}, []),
        ("t\\w", "a\x01tb", {}, [(2, 4)]),
    ],
)
def test_spans(spark, pattern, text, kw, want):
    matched, got = spans(spark, pattern, text, **kw)
    assert got == want and matched == bool(want)


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<!a)b", "a\\1", "a*+", "(a", "a)", "[a", "*a", "a{2,1}", "(?>a)", "\\Z", "a**", "a{1001}"])
def test_rejected(spark, pattern):
    with pytest.raises(PatternError):
        compile_pattern(pattern, spark=spark)


def test_translate_agrees_with_re(spark):
    rng = random.Random(3)
    atoms = ["a", "b", "[ab]", "[^a]", "a+", "b?", "(?:ab)*", "a|b", ".", "\\d", "\\w", "^a", "b$"]
    texts = ["".join(rng.choice("ab1 ") for _ in range(rng.randrange(8))) for _ in range(60)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").cache()
    for _ in range(12):
        p = "".join(rng.choice(atoms) for _ in range(rng.randrange(1, 4)))
        got = [r[0] for r in frame.select(F.col("t").rlike(translate(p))).collect()]
        assert got == [re.search(p.replace("b$", "b\\Z"), t) is not None for t in texts], p


def machine(hits, before, after, limit):
    """One row at a time, as the stream does."""
    state, out = fresh(), []
    for i, h in enumerate(hits):
        out += [(o, m) for o, _, m in step(state, i, "", h, before, after, limit)]
    return out


@pytest.mark.parametrize(("before", "after", "limit"), [(0, 0, 0), (2, 1, 0), (0, 2, 1), (1, 2, 2), (3, 0, 1), (2, 2, 0), (0, 1, 3)])
def test_context_equals_state_machine(spark, before, after, limit):
    rng = random.Random(before * 100 + after * 10 + limit)
    files = {f"f{i}": [rng.random() < 0.35 for _ in range(rng.randrange(25))] for i in range(150)}
    rows = [(p, i, "hit" if h else "miss") for p, hits in files.items() for i, h in enumerate(hits)]
    units = spark.createDataFrame(rows, "path string, ord long, text string")
    got = ops.search(units, compile_pattern("hit"), SearchOptions(before=before, after=after, max_count=limit)).select("path", "ord", "is_match").collect()
    want = {(p, o, m) for p, hits in files.items() for o, m in machine(hits, before, after, limit)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_cap_overrun():
    hits = [True, True, False, False, False, True]
    assert machine(hits, 0, 2, 1) == [(0, True), (1, True), (2, False), (3, False)]


def test_options():
    with pytest.raises(OptionError):
        SearchOptions(files_with_matches=True, count=True)
    with pytest.raises(OptionError):
        SearchOptions(types=("nope",))
    with pytest.raises(OptionError):
        SearchOptions(color="red")
    assert (SearchOptions(context=3, after=1).lead, SearchOptions(context=3, after=1).trail) == (3, 1)


@pytest.mark.parametrize("text", ["", "a", "a\n", "\n", "\n\n", "a\r\nb\r", "a\r\r\nb\n", "\r", "a\n\r\n", "é\n\nb"])
def test_lines_equal_the_file_reader(spark, text):
    from unitsieve.extract import text as reader
    from unitsieve.sources.files import text_units

    frame = spark.createDataFrame([("p", text)], "path string, t string")
    got = [r["text"] for r in text_units(frame, F.col("path"), F.col("t")).orderBy("ord").collect()]
    assert got == [t for _, _, t in reader.extract(text.encode())]


def test_prefilter_reaches_the_scan(spark):
    from unitsieve.plans import catalog

    plan = catalog._matches(spark, "/root/testdata/sf0.001", "tion")._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(text,tion)" in plan and "doc_id" in plan and "n_chars" not in plan
