"""How a location reads: for people, as fields, and as a link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import paths

_PATHS = {"json_path": "jsonpath", "jsonl_path": "jsonpath", "yaml_path": "yamlpath", "xml_path": "xpath"}


def column_of(spans: Column) -> Column:
    """The text column of a match: one past its first span's start."""
    return F.when(F.size(spans) > 0, F.get(spans, 0)["start"] + 1).otherwise(F.lit(1))


def human(kind: Column, loc: Column) -> Column:
    """What follows ``path:`` on the terminal; may be empty."""
    line, col = loc["line"], loc["col"]
    there = F.coalesce(loc["jsonpath"], loc["yamlpath"], loc["xpath"])
    placed = F.when(F.coalesce(line, F.lit(0)) == 0, there).otherwise(F.format_string("%s (line %d:%d)", there, line, col))
    text = (
        F.when(kind.isin("text_line", "toml_comment"), line.cast("string"))
        .when(kind.isin(*_PATHS), placed)
        .when(kind == "jsonc_comment", F.format_string("line %d:%d (comment)", line, col))
        .when(kind == "toml_path", loc["tomlpath"])
        .when(kind == "html_path", F.when(line > 0, line.cast("string")).otherwise(loc["htmlpath"]))
        .when(kind.isin("docx_paragraph", "docx_cell", "odt_paragraph", "odt_cell"), F.coalesce(loc["heading"], F.lit("")))
        .when(kind.isin("docx_header_footer", "docx_footnote", "docx_comment"), loc["label"])
        .when(kind.isin("pptx_shape", "odp_shape"), F.format_string("Slide %d", loc["slide"]))
        .when(kind.isin("pptx_notes", "odp_notes"), F.format_string("Slide %d (Notes)", loc["slide"]))
        .when(kind.isin("xlsx_cell", "ods_cell"), F.concat_ws(":", loc["sheet"], loc["cell"]))
    )
    return F.coalesce(text, F.lit(""))


def location(path: Column, text: Column) -> Column:
    """``path`` or ``path:human``, control characters escaped."""
    return paths.escape_controls(F.when(text == "", path).otherwise(F.concat_ws(":", path, text)))


def with_uris(matches: DataFrame) -> DataFrame:
    """Adds ``uri``: the path made absolute and encoded, and a suffix that follows from
    the location."""
    kind, loc = F.col("loc_kind"), F.col("loc")
    line_col = F.when(F.coalesce(loc["line"], F.lit(0)) > 0, F.concat(F.lit(":"), loc["line"], F.lit(":"), F.coalesce(loc["col"], F.lit(1)))).otherwise(F.lit(""))
    sheet = F.when(loc["sheet"].rlike(r"\A[\p{L}\p{N}_]+\z"), loc["sheet"]).otherwise(F.concat(F.lit("'"), F.replace(loc["sheet"], F.lit("'"), F.lit("''")), F.lit("'")))
    suffix = (
        F.when(kind.isin("text_line", "json_path", "jsonl_path", "jsonc_comment", "yaml_path", "toml_path", "toml_comment", "xml_path", "html_path"), line_col)
        .when(kind.isin("pptx_shape", "odp_shape"), F.concat(F.lit("#"), loc["slide"]))
        .when(kind.isin("xlsx_cell", "ods_cell"), paths.fragment_column(F.concat(sheet, F.lit("!"), loc["cell"])))
        .otherwise(F.lit(""))
    )
    linked = ~kind.isin("docx_header_footer", "docx_footnote", "docx_comment", "pptx_notes", "odp_notes") & (F.col("path") != "-")
    return matches.withColumn("uri", F.when(linked, F.concat(paths.file_uri_column(F.col("path")), suffix)).otherwise(F.lit("")))


def with_locations(matches: DataFrame) -> DataFrame:
    """Sets the column of text lines from the spans; adds ``human`` and ``uri``."""
    col = F.when(F.col("loc_kind") == "text_line", column_of(F.col("spans"))).otherwise(F.col("loc.col"))
    out = matches.withColumn("loc", F.col("loc").withField("col", col.cast("int")))
    return with_uris(out.withColumn("human", human(F.col("loc_kind"), F.col("loc"))))

