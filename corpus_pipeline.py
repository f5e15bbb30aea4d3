"""A training-corpus pipeline over ``documents``: five stages, each an operator.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir). Each
result is written as Parquet to the shared scratch folder and read again.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from unitsieve.llm.alike import drop_near
from unitsieve.llm.common import materialize, recorded, sweep, table
from unitsieve.llm.decontam import drop_contaminated
from unitsieve.llm.line_templates import drop_template_lines
from unitsieve.llm.packing import pack
from unitsieve.llm.quality_rules import drop_low_quality


#: Scratch tables of the stages run so far, by place in ``STAGES``.
_scratch: dict[int, list] = {}


def _stage(place: int):
    """What the stages before wrote for themselves goes when a stage begins: by then
    their results are written, or are read from tables that stay."""

    def wrap(stage):
        @wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            for earlier in range(place):
                sweep(_scratch.get(earlier, []), docs)
            with recorded() as made:
                out = stage(spark, docs, sf_dir)
            _scratch.setdefault(place, []).extend(made)
            return out

        return run

    return wrap


@_stage(0)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_low_quality(docs)


@_stage(1)
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_template_lines(docs)


@_stage(2)
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near(docs)


@_stage(3)
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage(4)
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontaminate), ("packing", packing)]

#: Learned rule weights, fingerprints and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
