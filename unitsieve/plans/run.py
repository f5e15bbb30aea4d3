"""A whole search: roots to matches, summaries, statistics and failures."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions.locations import with_locations
from ..functions.pattern import compile_pattern
from ..operators import search as ops
from ..sources import files, walk


@dataclass
class Result:
    matches: DataFrame
    summary: DataFrame
    stats: DataFrame
    errors: DataFrame
    #: Why the walk ended early; raised by the caller once results are out.
    walk_error: Exception | None = None
    #: The units that all of these read, kept until :meth:`close`.
    units: DataFrame | None = None

    def close(self) -> None:
        if self.units is not None:
            self.units.unpersist()


def run(spark: SparkSession, pattern: str, roots: list[str], options: model.SearchOptions = model.SearchOptions(), stdin: bytes | None = None, ignore: tuple[str, ...] = ()) -> Result:  # noqa: B008
    """Searches files below ``roots``; ``-`` stands for ``stdin``. A root with a scheme
    (``hdfs://``, ``s3a://``) is listed and read by the executors alone. ``ignore`` are
    globs that count as excluded too. The pattern is checked before any file."""
    matcher = compile_pattern(pattern, options.ignore_case, options.fixed, options.word, spark)
    roots, piped = walk.split_stdin(roots)
    found: list[str] = []
    failed = None
    exclude = (*ignore, *options.exclude)
    try:
        for path in walk.walk([r for r in roots if "://" not in r], options.include, exclude, options.no_ignore, options.ignore_files, options.threads):
            found.append(path)
    except walk.MissingRoot as e:
        failed = e
    frame = files.files_frame(spark, found)
    parts = [files.read_units(frame, options.types)]
    walked = frame.select("path")
    for root in (r for r in roots if "://" in r):
        try:
            stored = files.stored_files(spark, root, options.include, exclude)
        except AnalysisException:
            failed = failed or walk.MissingRoot(f"{root}: no such file or directory")
            continue
        parts.append(files.content_units(stored, F.col("path"), F.col("content"), options.types))
        walked = walked.unionByName(stored.select("path"))
    if piped:
        walked = walked.unionByName(spark.createDataFrame([(model.STDIN,)], "path string"))
        if not options.types or "text" in options.types:
            parts.append(files.stdin_units(spark, stdin or b""))
    units = reduce(DataFrame.unionByName, parts)
    if options.max_count <= 0 and (options.invert or not (options.lead or options.trail)):
        # nothing but hits and rows about files is asked for again
        units = ops.flagged(units, matcher, options.invert).where("hit or text is null").drop("hit")
    units = units.persist(StorageLevel.MEMORY_AND_DISK)
    matches = with_locations(ops.search(units, matcher, options))
    per_file = ops.counts(matches)
    searched = units.where("ord is null and error is null").select("path")
    errors = units.where("error is not null").select("path", F.col("error").alias("message"))
    return Result(matches, per_file, ops.run_stats(walked, searched, per_file), errors, failed, units)
