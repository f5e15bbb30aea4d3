"""Matching, inversion, per-file caps and context over text units.

A unit is a row with ``path``, ``ord`` and ``text``; ``search`` adds ``spans`` and
``is_match`` and keeps the rows a search reports. Predicates run first, spans only
for rows that stay. Without context and cap there is no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pattern import Matcher
from ..model import SearchOptions

NO_SPANS = "cast(array() as array<struct<start:int,end:int>>)"


def flagged(units: DataFrame, matcher: Matcher, invert: bool = False) -> DataFrame:
    """``units`` with the boolean ``hit``: the row matches (or, inverted, does not)."""
    hit = F.coalesce(matcher.matches(F.col("text")), F.lit(False))
    return units.withColumn("hit", ~hit if invert else hit)


def capped(units: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` hits of each file."""
    hits = units.where("hit")
    if limit <= 0:
        return hits
    return hits.withColumn("rn", F.row_number().over(Window.partitionBy("path").orderBy("ord"))).where(F.col("rn") <= limit).drop("rn")


def with_context(units: DataFrame, before: int, after: int, limit: int = 0) -> DataFrame:
    """Hits and the rows around them, each once; ``hit`` stays true for reported
    hits only. With a limit, rows after the last hit still come, and a hit among
    them is reported, counts, and has rows after it in turn."""
    w = Window.partitionBy("path").orderBy("ord")
    past = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.when(F.col("hit"), F.col("ord"))
    out = units
    if limit > 0:
        out = out.withColumn("rank", F.sum(F.col("hit").cast("int")).over(past)).withColumn("prev", F.max(own).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        stop = F.col("hit") & (F.col("rank") > limit) & (F.col("ord") - F.col("prev") > after)
        out = out.withColumn("stopped", F.sum(stop.cast("int")).over(past)).withColumn("hit", F.col("hit") & (F.col("stopped") == 0)).drop("rank", "prev", "stopped")
        own = F.when(F.col("hit"), F.col("ord"))
        out = out.withColumn("last", F.max(own).over(past)).withColumn("next", F.min(own).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        near = (F.col("ord") - F.col("last") <= after) | (F.col("next") - F.col("ord") <= before)
        return out.where(F.col("hit") | (~F.col("was") & F.coalesce(near, F.lit(False)))).drop("last", "next")
    near = F.max(F.col("hit").cast("int")).over(w.rowsBetween(-after, before)) == 1
    return out.withColumn("near", near).where("near").drop("near")


def search(units: DataFrame, matcher: Matcher, options: SearchOptions = SearchOptions()) -> DataFrame:  # noqa: B008
    """The rows a search reports, with ``spans`` and ``is_match``.

    Context rows and rows of an inverted search have no spans. Rows without text
    (markers of files) are passed over.
    """
    rows = flagged(units.where(F.col("text").isNotNull()), matcher, options.invert)
    if options.invert or not (options.lead or options.trail):
        rows = capped(rows, options.max_count)
    else:
        rows = with_context(rows.withColumn("was", F.col("hit")), options.lead, options.trail, options.max_count).drop("was")
    spans = F.expr(NO_SPANS) if options.invert else F.when(F.col("hit"), matcher.spans(F.col("text"))).otherwise(F.expr(NO_SPANS))
    return rows.withColumn("spans", spans).withColumnRenamed("hit", "is_match")


def counts(matches: DataFrame) -> DataFrame:
    """``path, match_count`` of the files with a match."""
    return matches.where("is_match").groupBy("path").agg(F.count("*").alias("match_count"))


def matching_files(matches: DataFrame) -> DataFrame:
    return matches.where("is_match").select("path").distinct()


def run_stats(walked: DataFrame, searched: DataFrame, per_file: DataFrame) -> DataFrame:
    """One row: files walked, searched and matched, and all matches."""
    def one(df: DataFrame, *columns: Column) -> DataFrame:
        return df.agg(*columns)

    a = one(walked, F.count("*").alias("files_walked"))
    b = one(searched, F.count("*").alias("files_searched"))
    c = one(per_file, F.count("*").alias("files_matched"), F.coalesce(F.sum("match_count"), F.lit(0)).alias("total_matches"))
    return a.crossJoin(b).crossJoin(c)  # three single rows


def document_prefilter(text: Column, matcher: Matcher, invert: bool = False) -> Column | None:
    """A filter on whole texts that no reported line fails: a literal without line
    ends must occur in the text. Filters on lines do not move below the split by
    themselves."""
    if invert or not matcher.literal or not matcher.pattern or set(matcher.pattern) & set("\r\n"):
        return None
    return matcher._near(text)
