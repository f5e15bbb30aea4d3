"""From paths, tables and standard input to text units."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import model
from ..extract import dispatch
from ..extract.registry import Unit
from ..functions import paths

#: Rows of one Arrow batch, whether of one large file or of many small ones.
BATCH = 2_000
#: Bytes of text after which a batch leaves early.
BATCH_BYTES = 4 << 20


def files_frame(spark: SparkSession, paths: Iterable[str], partitions: int | None = None) -> DataFrame:
    """``FILES``: paths spread over tasks; contents stay where they are until read."""
    def size(p: str) -> int:
        try:
            return os.path.getsize(p)
        except OSError:
            return -1

    rows = [(p, os.path.abspath(p), os.path.basename(p), os.path.splitext(p)[1].lower(), size(p)) for p in paths]
    frame = spark.createDataFrame(rows, model.FILES)
    return frame.repartition(partitions or max(1, min(len(rows), spark.sparkContext.defaultParallelism * 4)))


class _Batches:
    """Gathers rows of many files into batches of ``BATCH`` rows."""

    def __init__(self) -> None:
        self.schema = to_arrow_schema(model.UNITS)
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple[str, str | None, int | None, str | None, dict | None, str | None, str | None]] = []
        self.bytes = 0

    def batch(self) -> pa.RecordBatch:
        """The rows as columns; a location field that none of them has is all null."""
        n = len(self.rows)
        path, name, order, kind, locs, text, error = zip(*self.rows, strict=True) if n else [()] * 7
        used = set().union(*(x for x in locs if x))
        loc_type = self.schema.field("loc").type
        fields = [pa.array([x and x.get(f.name) for x in locs], f.type) if f.name in used else pa.nulls(n, f.type) for f in loc_type]
        loc = pa.StructArray.from_arrays(fields, fields=list(loc_type), mask=pa.array([x is None for x in locs], pa.bool_()))
        columns = [pa.array(c, self.schema.field(i).type) if not isinstance(c, pa.Array) else c for i, c in enumerate((path, name, order, kind, loc, text, error))]
        self.clear()
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)

    def note(self, path: str, name: str | None, error: str | None = None) -> None:
        """A row about a file: that it is searched, or that it failed."""
        self.rows.append((path, name, None, None, None, None, error))

    def units(self, path: str, name: str, units: Iterator[tuple[str, dict, str]]) -> Iterator[pa.RecordBatch]:
        """Adds a file: a row that marks it as searched, its units, and, if it fails
        half-way, one error row after the units before. Gives batches as they fill."""
        self.note(path, name)
        rows = self.rows
        order = 0
        try:
            for kind, loc, text in units:
                rows.append((path, name, order, kind, loc, text, None))
                order += 1
                self.bytes += len(text)
                if len(rows) >= BATCH or self.bytes > BATCH_BYTES:
                    yield self.batch()
                    rows = self.rows
        except Exception as e:
            self.note(path, name, str(e) or type(e).__name__)
        if len(self.rows) >= BATCH:
            yield self.batch()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield self.batch()


def read_units(files: DataFrame, types: tuple[str, ...] = ()) -> DataFrame:
    """``UNITS`` of every file. A file that cannot be read, or fails half-way, adds a
    row with ``error``; one that no format claims, or of a type not asked for, adds
    none. A file without units adds a row without text and order, so it still counts
    as searched. Plain text is read line by line, whatever the file's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Batches()
        for batch in batches:
            for path, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with open(file, "rb") as f:
                        name, units = dispatch.open_units(path, f)
                        if name is not None and (not types or name in types):
                            yield from out.units(path, name, units)
                except OSError as e:
                    out.note(path, None, e.strerror or str(e))
        yield from out.rest()

    return files.select("path", "file").mapInArrow(run, model.UNITS)


def content_units(table: DataFrame, path: Column, content: Column, types: tuple[str, ...] = (), extractors: Mapping[str, Callable[[bytes], Iterator[Unit]]] | None = None) -> DataFrame:
    """``UNITS`` of files held in a table: ``content`` is text or bytes. Small files
    share batches; a table of few, large partitions is spread by the caller.
    ``extractors``, by format, are used in place of the formats' own."""
    extractors = extractors or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Batches()
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py() or b""
                name = dispatch.claim(p, data)
                if name is not None and (not types or name in types):
                    extract = extractors.get(name) or dispatch.EXTRACTORS[name].extract
                    yield from out.units(p, name, extract(data))
        yield from out.rest()

    return table.select(path.alias("path"), content.cast("binary").alias("content")).mapInArrow(run, model.UNITS)


def stored_files(spark: SparkSession, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """``path, content`` of the files below ``root`` on any storage that Spark reads
    (HDFS, object stores, ``file://``); executors list and read, the driver sees no
    contents. Globs are those of a local walk; ignore files are not looked up there,
    and names that begin with ``.`` or ``_`` are passed over, as Spark does."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.where(paths.wanted_column(F.col("path"), include, exclude)).select("path", "content")


def _text_lines(text: Column) -> Column:
    """Lines of a non-empty text: LF ends a line, one CR before it goes, and so does
    one at the very end; no empty last line."""
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    ended = F.endswith(unix, F.lit("\n")) | F.endswith(unix, F.lit("\r"))
    return F.split(F.when(ended, F.left(unix, F.char_length(unix) - 1)).otherwise(unix), "\n", -1)


def text_units(table: DataFrame, path: Column, text: Column, *keep: str, where: Column | None = None) -> DataFrame:
    """Lines of a table of texts, one document a row: ``path, format, ord, text`` and
    the columns ``keep``. JVM expressions only; ``where`` filters whole texts before
    they are cut into lines."""
    there = text.isNotNull() & (text != "")
    table = table.where(there if where is None else there & where)
    return table.select(path.cast("string").alias("path"), F.lit("text").alias("format"), *keep, F.posexplode(_text_lines(text)).alias("pos", "text")).select("path", "format", *keep, F.col("pos").cast("long").alias("ord"), "text")


def with_line_location(lines: DataFrame) -> DataFrame:
    """Lines of standard input, ``ord, text`` and more, with the other columns of ``UNITS``."""
    fields = [((F.col("ord") + 1) if f.name == "line" else F.lit(None)).cast(f.dataType).alias(f.name) for f in model.LOC]
    return lines.select("*", F.lit(model.STDIN).alias("path"), F.lit("text").alias("format"), F.lit("text_line").alias("loc_kind"), F.struct(*fields).alias("loc"), F.lit(None).cast("string").alias("error"))


def line_units(spark: SparkSession, lines: list[str], first: int) -> DataFrame:
    """Lines of standard input as ``UNITS``, numbered from ``first``."""
    table = pa.table({"ord": pa.array(range(first, first + len(lines)), pa.int64()), "text": pa.array(lines, pa.string())})
    return with_line_location(spark.createDataFrame(table))


def stdin_units(spark: SparkSession, data: bytes) -> DataFrame:
    """Units of standard input: always text, with path ``-``."""
    frame = spark.createDataFrame([(bytearray(data),)], "content binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Batches()
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield from out.units(model.STDIN, "text", dispatch.EXTRACTORS["text"].extract(data))
        yield from out.rest()

    return frame.mapInArrow(run, model.UNITS)
