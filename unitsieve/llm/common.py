"""Shared helpers: scratch tables, word splitting, 64-bit mixing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these characters (space, tab, LF, VT, FF, CR).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is used in local mode only; a cluster
    without the setting is an error, as executors would not share the folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="unitsieve-")
    spark.sparkContext.setCheckpointDir(root)
    return root


#: Bytes that a writer holds before it passes them on.
ROW_GROUP = 32 << 20
#: While a table is written: shuffle files go once the result stands, and Python
#: workers get fewer rows at once than by default, as a row may be a long text.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Jobs inside run with the settings for written tables; the session's come back."""
    before = {k: spark.conf.get(k) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back. What was
    shuffled on the way is not needed after that and is removed."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/unitsieve/{uuid.uuid4().hex}"
    with lean(spark):
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    held = (spark, path)
    _written.append(held)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = held
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that :func:`materialize` wrote and no later step reads."""
    for df in tables:
        _written.remove(df._scratch)
        _delete(*df._scratch)


@contextmanager
def recorded() -> Iterator[list[tuple[SparkSession, str]]]:
    """The tables that are written meanwhile and still there at the end."""
    before = set(map(id, _written))
    made: list[tuple[SparkSession, str]] = []
    yield made
    made += [x for x in _written if id(x) not in before]


def sweep(tables: list[tuple[SparkSession, str]], docs: DataFrame) -> None:
    """Deletes recorded tables that ``docs`` does not read."""
    if not tables:
        return
    read = {f.rsplit("/", 1)[0] for f in docs.inputFiles()}
    for held in list(tables):
        if not any(r.endswith(held[1].split(":", 1)[-1].lstrip("/")) for r in read):
            tables.remove(held)
            if held in _written:
                _written.remove(held)
                _delete(*held)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone; the folder is scratch space
            return


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, id, text`` written once: ``row`` is a number of its own for every row,
    whatever its id and text, and stays the same for all that read the table."""
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialize(plain)


def with_numbers(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written once with one more column, whose name is given too: a number
    of its own for every row. Row identity for stages that keep or drop whole rows."""
    name = "__number"
    while name in docs.columns:
        name += "_"
    return materialize(docs.withColumn(name, F.monotonically_increasing_id())), name


def words_of(text: str | None) -> list[bytes]:
    """The UTF-8 words of a text. ``bytes.split`` breaks at exactly the six
    ASCII white-space characters of ``WORD_PATTERN``."""
    return text.encode().split() if text else []


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
