"""Command line: ``python -m unitsieve.cli [flags] PATTERN [PATH...]``.

Exit status: 0 with a match, 1 without, 2 after an error.
"""

from __future__ import annotations

import argparse
import os
import stat
import sys
from collections import Counter
from dataclasses import replace
from io import BytesIO
from typing import IO

from pyspark.sql import SparkSession

from .functions import config
from .functions.pattern import PatternError, compile_pattern
from .model import STDIN, OptionError, SearchOptions
from .plans.run import run
from .sinks import output
from .sources.walk import resolve_roots
from .streaming.lines import LineSearch

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="unitsieve", add_help=True)
    p.add_argument("pattern")
    p.add_argument("paths", nargs="*")
    flag = lambda *names, **kw: p.add_argument(*names, **kw)
    for names in (("-i", "--ignore-case"), ("-F", "--fixed-strings"), ("-w", "--word-regexp"), ("-v", "--invert-match"), ("--json",), ("--no-ignore",), ("-l", "--files-with-matches"), ("-c", "--count"), ("--stats",)):
        flag(*names, action="store_true")
    flag("--color", default=None)
    for names, default in ((("-j", "--threads"), None), (("-m", "--max-count"), 0), (("-B", "--before-context"), None), (("-A", "--after-context"), None), (("-C", "--context"), 0)):
        flag(*names, type=int, default=default)
    for name in ("--include", "--exclude", "--type"):
        flag(name, action="append", default=[])
    flag("-V", "--version", action="version", version=VERSION)
    return p


def piped(fd: int = 0) -> bool:
    """A regular file, pipe or socket on standard input."""
    try:
        mode = os.fstat(fd).st_mode
    except OSError:
        return False
    return stat.S_ISREG(mode) or stat.S_ISFIFO(mode) or stat.S_ISSOCK(mode)


def options_of(a: argparse.Namespace, c: config.Config) -> SearchOptions:
    return SearchOptions(ignore_case=a.ignore_case, fixed=a.fixed_strings, word=a.word_regexp, invert=a.invert_match, max_count=a.max_count, before=a.before_context, after=a.after_context, context=a.context, include=tuple(a.include), exclude=tuple(a.exclude), no_ignore=a.no_ignore, types=tuple(a.type), files_with_matches=a.files_with_matches, count=a.count, json=a.json, stats=a.stats, color=a.color or c.color, threads=a.threads if a.threads is not None else c.threads)


def _search_input(spark: SparkSession, pattern: str, o: SearchOptions, stream: IO[bytes], totals: Counter) -> None:
    """Standard input, chunk by chunk as it comes; records appear with their chunk."""
    totals["walked"] += 1
    if o.types and "text" not in o.types:
        return
    totals["searched"] += 1
    summary_only = o.files_with_matches or o.count
    color = not o.json and output.wants_color(o.color, sys.stdout)
    # for a list of names one match is enough
    found = LineSearch(spark, stream, compile_pattern(pattern, o.ignore_case, o.fixed, o.word, spark), replace(o, max_count=1, context=0, before=0, after=0) if o.files_with_matches and not o.stats else o)
    for matches in found:
        if o.json and not summary_only:
            rows = output.match_records(matches).orderBy("ord")
            output.emit(x["record"] for x in rows.select("record").toLocalIterator())
        elif not summary_only:
            output.emit(output.terminal_lines(matches, color, sys.stdout.isatty()))
        sys.stdout.flush()
    if found.count:
        totals["matched"] += 1
        totals["matches"] += found.count
        if o.json:
            output.emit([output.summary_record(STDIN, found.count)])
        elif summary_only:
            output.emit([f"{STDIN}:{found.count}" if o.count else STDIN])
    if found.error:
        print(f"warning: {STDIN}: {found.error}", file=sys.stderr)


def _search_files(spark: SparkSession, pattern: str, roots: list[str], o: SearchOptions, ignore: tuple[str, ...], totals: Counter) -> Exception | None:
    r = run(spark, pattern, roots, o, None, ignore)
    try:
        summary_only = o.files_with_matches or o.count
        if o.json:
            rows = output.json_records(r.matches, r.summary, summary_only).orderBy("path", "kind", "ord")
            output.emit(x["record"] for x in rows.select("record").toLocalIterator())
        elif summary_only:
            output.emit(output.summary_lines(r.summary, o.count))
        else:
            output.emit(output.terminal_lines(r.matches, output.wants_color(o.color, sys.stdout), sys.stdout.isatty()))
        for e in r.errors.orderBy("path").toLocalIterator():
            print(f"warning: {e['path']}: {e['message']}", file=sys.stderr)
        s = r.stats.first()
    finally:
        r.close()
    totals.update(walked=s["files_walked"], searched=s["files_searched"], matched=s["files_matched"], matches=s["total_matches"])
    return r.walk_error


def main(argv: list[str] | None = None, spark: SparkSession | None = None, stdin: bytes | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        c = config.load()
        o = options_of(a, c)
        roots = resolve_roots(a.paths, stdin is not None or (not a.paths and piped()))
        spark = spark or SparkSession.builder.master(f"local[{o.threads or '*'}]").appName("unitsieve").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        totals = Counter()
        if "-" in roots:
            _search_input(spark, a.pattern, o, sys.stdin.buffer if stdin is None else BytesIO(stdin), totals)
        rest = [r for r in roots if r != "-"]
        failed = _search_files(spark, a.pattern, rest, o, c.ignore, totals) if rest else None
        if o.stats:
            print(f"{totals['walked']} files walked, {totals['searched']} searched, {totals['matched']} matched, {totals['matches']} matches", file=sys.stderr)
        if failed:
            raise failed
        return 0 if totals["matches"] else 1
    except (OptionError, PatternError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
