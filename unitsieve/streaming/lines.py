"""A search over a stream of lines that is never held whole, such as standard input.

Lines are gathered to chunks; each chunk is matched by the engine, and the context
and the cap carry over from chunk to chunk in the state of :mod:`.context`. Reading
stops as soon as the cap is reached.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract import text
from ..extract.registry import ExtractError
from ..functions.locations import with_locations
from ..functions.pattern import Matcher
from ..model import SearchOptions
from ..operators import search as ops
from ..sources import files
from .context import fresh, step

#: Lines and characters of a chunk at most.
CHUNK_LINES = 20_000
CHUNK_CHARS = 4 << 20


class LineSearch:
    """Iterate for the matches of each chunk; then ``count`` has the hits and
    ``error`` why the input ended early, if it did."""

    def __init__(self, spark: SparkSession, stream: IO[bytes], matcher: Matcher, options: SearchOptions = SearchOptions()) -> None:  # noqa: B008
        self.spark, self.stream, self.matcher, self.options = spark, stream, matcher, options
        self.count = 0
        self.error: str | None = None

    def _chunks(self) -> Iterator[tuple[int, list[str]]]:
        first, held, size = 0, [], 0
        try:
            for _, _, line in text.stream(self.stream):
                held.append(line)
                size += len(line)
                if len(held) >= CHUNK_LINES or size >= CHUNK_CHARS:
                    yield first, held
                    first, held, size = first + len(held), [], 0
        except ExtractError as e:
            self.error = str(e)
        if held:
            yield first, held

    def __iter__(self) -> Iterator[DataFrame]:
        o = self.options
        before, after = (0, 0) if o.invert else (o.lead, o.trail)
        state = fresh()
        for first, lines in self._chunks():
            units = files.line_units(self.spark, lines, first)
            hits = {r["ord"] for r in ops.flagged(units, self.matcher, o.invert).where("hit").select("ord").collect()}
            out = [r for i, t in enumerate(lines, first) for r in step(state, i, t, i in hits, before, after, o.max_count)]
            self.count += sum(hit for _, _, hit in out)
            if out:
                yield self._located(out)
            if state["done"]:
                return

    def _located(self, rows: list[tuple[int, str, bool]]) -> DataFrame:
        """Rows to report, which may reach back to earlier chunks."""
        schema = "ord long, text string, is_match boolean"
        found = self.spark.createDataFrame(rows, schema)
        units = files.with_line_location(found)
        nothing = F.expr(ops.NO_SPANS)
        spans = nothing if self.options.invert else F.when(F.col("is_match"), self.matcher.spans(F.col("text"))).otherwise(nothing)
        return with_locations(units.withColumn("spans", spans))
