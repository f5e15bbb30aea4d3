"""SQL surface: views over results and a table function for documents."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from . import model
from .extract import dispatch


@udtf(returnType="format string, ord long, loc_kind string, line int, col int, keypath string, text string")
class ExtractUnits:
    """``LATERAL extract_units(path, content)``: the units of a document. One that fails
    half-way ends with a row of kind ``error`` whose text is the message."""

    def eval(self, path: str, content: bytes) -> Iterator[tuple]:
        data = content.encode() if isinstance(content, str) else bytes(content or b"")
        name = dispatch.claim(path or "", data)
        if name is None:
            return
        try:
            for order, (kind, loc, text) in enumerate(dispatch.EXTRACTORS[name].extract(data)):
                key = next((loc[k] for k in ("jsonpath", "yamlpath", "tomlpath", "xpath", "htmlpath", "cell") if loc.get(k)), None)
                yield name, order, kind, loc.get("line"), loc.get("col"), key, text
        except Exception as e:  # the units before it stay; the failure is a row of its own
            yield name, None, "error", None, None, None, str(e) or type(e).__name__


def register(spark: SparkSession) -> None:
    spark.udtf.register("extract_units", ExtractUnits)


def views(**frames: DataFrame) -> None:
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


__all__ = ["ExtractUnits", "model", "register", "views"]
