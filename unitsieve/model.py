"""Schemas, options and their validation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

FORMATS = ("json", "jsonl", "jsonc", "yaml", "toml", "xml", "html", "docx", "pptx", "xlsx", "odt", "ods", "odp", "text")
STDIN = "-"
COLOR_MODES = ("auto", "always", "never")

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_INT_FIELDS = ("line", "col")
_TEXT_FIELDS = ("jsonpath", "yamlpath", "tomlpath", "xpath", "htmlpath")
LOC = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in _INT_FIELDS]
    + [T.StructField("comment", T.BooleanType())]
    + [T.StructField(c, T.StringType()) for c in _TEXT_FIELDS]
    + [
        T.StructField("paragraph", T.IntegerType()),
        T.StructField("heading", T.StringType()),
        T.StructField("table", T.IntegerType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("sheet", T.StringType()),
        T.StructField("cell", T.StringType()),
        T.StructField("repeat", T.IntegerType()),
        T.StructField("slide", T.IntegerType()),
        T.StructField("shape", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)
#: One row per file: what the walker gives. ``file`` is the absolute path to read.
FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("file", T.StringType()), T.StructField("base", T.StringType()), T.StructField("ext", T.StringType()), T.StructField("size", T.LongType())])
#: One row per text unit. ``error`` is set on the row that reports a failed file.
UNITS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("ord", T.LongType()),
        T.StructField("loc_kind", T.StringType()),
        T.StructField("loc", LOC),
        T.StructField("text", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


class OptionError(ValueError):
    """An option or a combination of options that is not allowed."""


@dataclass(frozen=True)
class SearchOptions:
    """Everything a search can be asked for.

    ``before``/``after`` win over ``context`` where they are set. ``max_count`` of
    zero or less means no limit.
    """

    ignore_case: bool = False
    fixed: bool = False
    word: bool = False
    invert: bool = False
    max_count: int = 0
    before: int | None = None
    after: int | None = None
    context: int = 0
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    no_ignore: bool = False
    types: tuple[str, ...] = ()
    files_with_matches: bool = False
    count: bool = False
    json: bool = False
    stats: bool = False
    color: str = "auto"
    threads: int = 0
    ignore_files: tuple[str, ...] = field(default=(".gitignore", ".searchignore"))

    def __post_init__(self) -> None:
        if self.files_with_matches and self.count:
            raise OptionError("files-with-matches and count cannot be used together")
        unknown = [t for t in self.types if t not in FORMATS]
        if unknown:
            raise OptionError(f"unknown type {unknown[0]!r}; known types: {', '.join(sorted(FORMATS))}")
        if self.color not in COLOR_MODES:
            raise OptionError(f"color must be one of {', '.join(COLOR_MODES)}, not {self.color!r}")

    @property
    def lead(self) -> int:
        return max(0, self.context if self.before is None else self.before)

    @property
    def trail(self) -> int:
        return max(0, self.context if self.after is None else self.after)
