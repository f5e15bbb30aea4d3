"""Near copies by the likeness of their word shingles.

SimHash's three bits find copies that differ little; documents with a shingle likeness
(Jaccard) of 0.8 are mostly ten bits apart. Here documents with an equal key of ``ROWS``
least hashes meet, and each meeting is checked over all their shingles. In a bucket all
compare with the smallest, the linked ones leave, and the others go on with more of the
smallest at a time until none is left. So no two documents that meet and are alike both
stay, and a group of copies costs no square of its size. Documents that meet and are not
alike enough are all compared, as each may be alike to a third.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix64, release, with_numbers
from .simhash import later_rows

WIDTH = 5
#: Documents of likeness J meet with 1 - (1 - J ** ROWS) ** KEYS: 0.9992 at 0.8.
KEYS, ROWS = 24, 6
#: Of a bucket so many at most are compared with all others at once.
MOST = 512
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ORDERS = (mix64(np.arange(1, KEYS * ROWS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's shingles; a shorter text is one shingle."""
    words = text.encode().translate(_LOWER).split() if text else []
    flat = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(flat, 5)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(flat[a:b], 5) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def keys_of(hashes: np.ndarray) -> np.ndarray:
    """Keys from the least hashes in many orders, over the upper halves of the hashes."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_ORDERS), np.iinfo(np.uint32).max, np.uint32)
    odd = _ORDERS | np.uint32(1)
    for at in range(0, len(short), 512):
        part = (short[at : at + 512, None] ^ _ORDERS) * odd
        part ^= part >> np.uint32(15)
        np.minimum(least, part.min(axis=0), out=least)
    out = np.arange(KEYS, dtype=np.uint64)
    for row in least.astype(np.uint64).reshape(KEYS, ROWS).T:
        out = mix64(out ^ row)
    return out


def alike_rows(rows: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", likeness: float = 0.8) -> DataFrame:
    """``row``: the numbers of rows alike to one before them that they meet. Rows are in
    order of id (none: last) and number. Shingles are held for rows that meet others only."""
    keys_schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("keys", pa.list_(pa.int64()))])
    sets_schema = pa.schema([("row", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [keys_of(shingle_hashes(t.as_py())).view(np.int64) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))], schema=keys_schema)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [shingle_hashes(t.as_py()).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], schema=sets_schema)

    texts = rows.select(F.col(f"`{row_col}`").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    nodes = materialize(texts.mapInArrow(keys, "row long, id long, keys array<long>"))
    places = nodes.select(F.struct(F.col("id").isNull().alias("none"), "id", "row").alias("k"), F.explode("keys").alias("key"))
    shared = places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    places = materialize(places.join(shared, "key", "left_semi").select("k", "key"))
    release(nodes)
    # written, so that its size is known before it meets the texts
    meeting = materialize(places.select(F.col("k.row").alias("row")).distinct())
    sets = materialize(texts.join(meeting, "row", "left_semi").select("row", "text").mapInArrow(shingles, "row long, shingles array<long>"))
    gone, most = None, 1
    while True:
        # the smallest of each key; ranks are cut in every task before keys meet
        rank = F.row_number().over(Window.partitionBy("key").orderBy("k"))
        least = places.withColumn("rank", rank).where(F.col("rank") <= most)
        pivots = materialize(least.groupBy("key").agg(F.collect_list("k").alias("pivots")))
        met = places.join(pivots, "key")
        pairs = met.select("k", F.explode("pivots").alias("pivot")).where("pivot < k").select(F.col("k.row").alias("row"), F.col("pivot.row").alias("pivot")).distinct()
        both = pairs.join(sets, "row").join(sets.select(F.col("row").alias("pivot"), F.col("shingles").alias("other")), "pivot")
        common = F.size(F.array_intersect("shingles", "other"))
        linked = materialize(both.where(common >= likeness * (F.size("shingles") + F.size("other") - common)).select("row").distinct())
        gone = linked if gone is None else gone.unionByName(linked)
        left = met.where(~F.array_contains("pivots", F.col("k")))
        before, places = places, materialize(left.join(linked, F.col("k.row") == F.col("row"), "left_anti").select("k", "key"))
        release(pivots, before)
        if places.isEmpty():
            gone = materialize(gone.distinct())
            release(meeting, sets, places)
            return gone
        most = min(8 * most, MOST)


def drop_alike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without those alike to a row before them that they meet.

    Rows are in order of id (none: last) and told apart by a number of their own, so
    rows of one id, equal rows and rows without id count like any other. Null and empty
    texts are alike. An empty table gives an empty result; all columns pass."""
    rows, number = with_numbers(docs)
    gone = alike_rows(rows, number, id_col, text_col, likeness)
    return rows.join(gone, rows[number] == gone["row"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness: float = 0.8) -> DataFrame:
    """SimHash near duplicates (:func:`.simhash.drop_near_duplicates`), then rows alike,
    over one written table."""
    rows, number = with_numbers(docs)
    gone = later_rows(rows, number, id_col, text_col)
    left = rows.join(gone, rows[number] == gone["row"], "left_anti")
    both = materialize(gone.unionByName(alike_rows(left, number, id_col, text_col, likeness)))
    return rows.join(both, rows[number] == both["row"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
