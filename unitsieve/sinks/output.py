"""Sinks: JSON lines, terminal text, paths and counts, tables."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator
from typing import IO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..model import COLOR_MODES, OptionError

_PATH, _HIT, _OFF = "\x1b[35m", "\x1b[1;31m", "\x1b[0m"
#: Location fields as they are called in a record.
_FIELDS = ("line", "col", "comment", "jsonpath", "yamlpath", "tomlpath", "xpath", "htmlpath", "paragraph", "heading", "table", "row", "sheet", "cell", "repeat", "slide", "shape", "label")


def json_records(matches: DataFrame, per_file: DataFrame, summaries_only: bool = False) -> DataFrame:
    """``path, kind, ord, record``: match records and, for each matching file, a
    summary after them. Absent fields are left out."""
    summary = per_file.select("path", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("ord"), F.to_json(F.struct(F.lit("summary").alias("type"), "path", "match_count")).alias("record"))
    if summaries_only:
        return summary
    return match_records(matches).unionByName(summary)


def match_records(matches: DataFrame) -> DataFrame:
    """``path, kind, ord, record`` of matches alone."""
    fields = [F.col("loc")[f].alias(f) for f in _FIELDS]
    return matches.select("path", F.lit(0).alias("kind"), "ord", F.to_json(F.struct(F.lit("match").alias("type"), "path", "format", "uri", "text", "spans", *fields)).alias("record"))


def summary_record(path: str, count: int) -> str:
    return json.dumps({"type": "summary", "path": path, "match_count": count}, separators=(",", ":"))


def ordered(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of a file together and in document order, files by path."""
    spread = records.repartitionByRange(partitions, "path") if partitions else records.repartitionByRange("path")
    keys = [c for c in ("path", "kind", "ord") if c in records.columns]
    return spread.sortWithinPartitions(*keys)


def write_json(records: DataFrame, target: str) -> None:
    ordered(records).select("record").write.mode("overwrite").text(target)


def write_table(matches: DataFrame, target: str) -> None:
    """Matches as Parquet, a folder for each format."""
    matches.write.mode("overwrite").partitionBy("format").parquet(target)


def wants_color(mode: str, stream: IO[str]) -> bool:
    if mode not in COLOR_MODES:
        raise OptionError(f"color must be one of {', '.join(COLOR_MODES)}, not {mode!r}")
    return mode == "always" or (mode == "auto" and stream.isatty())


def highlight(text: str, spans: list[tuple[int, int]]) -> str:
    """Byte spans set in colour; malformed and overlapping ones are passed over."""
    raw, at, out = text.encode(), 0, []
    for start, end in spans:
        if start < at or end <= start or end > len(raw):
            continue
        out += [raw[at:start].decode("utf-8", "replace"), _HIT, raw[start:end].decode("utf-8", "replace"), _OFF]
        at = end
    return "".join(out) + raw[at:].decode("utf-8", "replace")


def hyperlink(text: str, uri: str) -> str:
    return f"\x1b]8;;{uri}\x1b\\{text}\x1b]8;;\x1b\\" if uri else text


def terminal_lines(matches: DataFrame, color: bool = False, links: bool = False) -> Iterator[str]:
    """``location text`` for each row, fetched partition by partition."""
    for r in matches.orderBy("path", "ord").select("path", "human", "uri", "text", "spans").toLocalIterator():
        place = paths.escape_text(r["path"] + (":" + r["human"] if r["human"] else ""))
        if color:
            place = f"{_PATH}{place}{_OFF}"
        if links and r["path"] != "-":
            place = hyperlink(place, r["uri"])
        text = highlight(r["text"], [(s["start"], s["end"]) for s in r["spans"]]) if color else r["text"]
        yield f"{place} {text}"


def summary_lines(per_file: DataFrame, count: bool) -> Iterator[str]:
    for r in per_file.orderBy("path").toLocalIterator():
        path = paths.escape_text(r["path"])
        yield f"{path}:{r['match_count']}" if count else path


def emit(lines: Iterable[str], stream: IO[str] | None = None, warn: IO[str] | None = None) -> int:
    """Writes lines; one that cannot be written is warned of, and the rest still come.
    The number of lines written."""
    stream = stream or sys.stdout
    n = 0
    for line in lines:
        try:
            stream.write(line + "\n")
            n += 1
        except Exception as e:  # whatever a sink raises concerns its line alone
            print(f"warning: writing a record: {str(e) or type(e).__name__}", file=warn or sys.stderr)
    return n
