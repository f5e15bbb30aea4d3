"""Matching with context over unbounded input.

The state of a file is small whatever its length: the last ``before`` rows, how many
rows after a hit are still due, and counters. Rows of a file arrive in order within
and across batches (as lines of one source do).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.pattern import Matcher
from ..model import SearchOptions

OUTPUT = "path string, ord long, text string, is_match boolean"
_STATE = "held string, due long, hits long, done boolean"


def step(state: dict, ord_: int, text: str, hit: bool, before: int, after: int, limit: int) -> list[tuple[int, str, bool]]:
    """Feeds one row to a file's state; the rows to report now."""
    out: list[tuple[int, str, bool]] = []
    if state["done"]:
        return out
    if hit and not (limit > 0 and state["hits"] >= limit and state["due"] <= 0):
        out += [(o, t, False) for o, t in state["held"]]
        out.append((ord_, text, True))
        state.update(held=[], due=after, hits=state["hits"] + 1)
    elif state["due"] > 0:
        out.append((ord_, text, False))
        state["due"] -= 1
    elif not hit:
        state["held"] = [*state["held"], (ord_, text)][-before:] if before > 0 else []
    if limit > 0 and state["hits"] >= limit and state["due"] <= 0:
        state.update(done=True, held=[])
    return out


def fresh() -> dict:
    return {"held": [], "due": 0, "hits": 0, "done": False}


class ContextProcessor(StatefulProcessor):
    """:func:`step` for each file, with its state in the state store."""

    def __init__(self, before: int, after: int, limit: int) -> None:
        self.before, self.after, self.limit = before, after, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("context", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        import json

        state = fresh()
        if self.state.exists():
            held, due, hits, done = self.state.get()
            state = {"held": [tuple(x) for x in json.loads(held)], "due": due, "hits": hits, "done": done}
        frames = list(rows)
        data = pd.concat(frames).sort_values("ord") if frames else pd.DataFrame(columns=["ord", "text", "hit"])
        out = [(key[0], *r) for o, t, h in zip(data["ord"], data["text"], data["hit"], strict=True) for r in step(state, int(o), t, bool(h), self.before, self.after, self.limit)]
        self.state.update((json.dumps(state["held"]), int(state["due"]), int(state["hits"]), bool(state["done"])))
        yield pd.DataFrame(out, columns=["path", "ord", "text", "is_match"])

    def close(self) -> None:
        pass


def search_stream(units: DataFrame, matcher: Matcher, options: SearchOptions = SearchOptions()) -> DataFrame:  # noqa: B008
    """A search over a stream of units ``path, ord, text``.

    Without context and cap it is a plain filter. Otherwise the session needs the
    RocksDB state store (see :func:`use_rocksdb`)."""
    hit = F.coalesce(matcher.matches(F.col("text")), F.lit(False))
    rows = units.select("path", "ord", "text", (~hit if options.invert else hit).alias("hit"))
    before, after = (0, 0) if options.invert else (options.lead, options.trail)
    if not (before or after or options.max_count > 0):
        return rows.where("hit").select("path", "ord", "text", F.lit(True).alias("is_match"))
    return rows.groupBy("path").transformWithStateInPandas(ContextProcessor(before, after, options.max_count), OUTPUT, "Append", "None")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def new_files(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Text files as they appear in a folder, a row each: ``path, text``."""
    read = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
