"""SimHash near-duplicates with exact tiled comparison.

Fingerprints are compared by numpy exclusive-or and bit counts inside tiles. A
tile holds fingerprints that agree on one of four 16-bit bands (two words at
most three bits apart agree on a band) and whose remaining bits have population
counts in one range of eight; a pair of tiles whose counts differ by more than
the radius is never formed. A crowded tile is cut into parts of bounded size and
all pairs of its parts are compared, so no pair is lost and no task grows with a
group. Of the links in a tile only a spanning forest is kept; components are then
found by alternating large-star and small-star steps over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, with_numbers

RADIUS = 3
BANDS = 4
SPAN = 8
TILE = 1024
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text; zero if it has no word."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(flat, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -width] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    hashes = np.fromiter((digest(flat[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        part = hashes[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``(doc_id, fp)``, or ``(row, doc_id, fp)`` with a row number: one row per input
    row; ``fp`` is a signed 64-bit integer."""
    names = ["row"] * (row_col is not None) + [id_col]
    schema = pa.schema([(c, pa.int64()) for c in (*names, "fp")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column(len(names))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(fp.view(np.int64))], schema=schema)

    number = [F.col(f"`{row_col}`").alias("row")] if row_col else []
    return docs.select(*number, F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, ", ".join(f"`{c}` long" for c in (*names, "fp")))


def forest(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links: (member, smallest member)."""
    label = np.arange(len(values))
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        label = label[label]
        if np.array_equal(before, label):
            break
    least = values.copy()
    np.minimum.at(least, label, values)
    root = least[label]
    moved = root != values
    return values[moved], root[moved]


def links_in_tiles(tile: np.ndarray, side: np.ndarray, value: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by ``tile``. side 0: compared with every row of the
    tile; sides 1 and 2: with the other side only; side 3 (halo): with side 0."""
    bits = value.view(np.uint64)
    found_l, found_r = [], []
    lag = 1
    alive = np.flatnonzero(tile[1:] == tile[:-1])
    while len(alive):
        other = alive + lag
        near = np.bitwise_count(bits[alive] ^ bits[other]) <= radius
        a, b = alive[near], other[near]
        keep = ~((side[a] == side[b]) & (side[a] > 0))
        found_l.append(a[keep])
        found_r.append(b[keep])
        lag += 1
        alive = alive[alive + lag < len(tile)]
        alive = alive[tile[alive] == tile[alive + lag]]
    if not found_l:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_l), np.concatenate(found_r)


def near_links(nodes: DataFrame, radius: int = RADIUS, tile_rows: int = TILE) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints ``fp`` that span the same
    components as all pairs at most ``radius`` bits apart."""
    if radius >= BANDS:
        raise ValueError("the radius must be below the number of bands")
    width = 64 // BANDS
    mask = (1 << width) - 1
    spread = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit(mask)).alias("key")) for i in range(BANDS)])).alias("b")
    rows = nodes.select("fp", spread).select("fp", "b.band", "b.key", (F.bit_count("fp") - F.bit_count("b.key")).alias("rest"))
    span = F.floor(F.col("rest") / SPAN)
    rows = rows.select("fp", "band", "key", F.explode(F.when(F.col("rest") % SPAN >= SPAN - radius, F.array(F.struct(span.alias("span"), F.lit(0).alias("halo")), F.struct((span + 1).alias("span"), F.lit(3).alias("halo")))).otherwise(F.array(F.struct(span.alias("span"), F.lit(0).alias("halo"))))).alias("s"))
    rows = rows.select("fp", F.xxhash64("band", "key", "s.span").alias("tile"), F.col("s.halo").alias("halo"))
    crowded = rows.groupBy("tile").agg(F.count("*").alias("n")).where(F.col("n") > tile_rows).select("tile", F.ceil(F.col("n") / tile_rows).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("parts")).cast("int")
    each = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda j: F.struct(
            F.xxhash64("tile", F.least(j, F.col("part")), F.greatest(j, F.col("part"))).alias("tile"),
            F.when(j == F.col("part"), F.col("halo")).when(F.col("part") < j, F.lit(1)).otherwise(F.lit(2)).alias("side"),
        ),
    )
    placed = (
        rows.join(crowded, "tile", "left")
        .withColumn("part", F.when(F.col("parts").isNotNull(), part))
        .select("fp", F.explode(F.when(F.col("parts").isNull(), F.array(F.struct(F.col("tile"), F.col("halo").alias("side")))).otherwise(each)).alias("t"))
        .select("fp", "t.tile", "t.side")
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def star(columns: list[np.ndarray]) -> pa.RecordBatch:
            left, right = links_in_tiles(*columns, radius)
            a, b = forest(columns[2], left, right)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        held = [np.empty(0, np.int64) for _ in range(3)]
        for batch in batches:
            held = [np.concatenate((h, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64))) for i, h in enumerate(held)]
            if len(held[0]) and held[0][0] != held[0][-1]:
                cut = int(np.searchsorted(held[0], held[0][-1]))
                yield star([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        yield star(held)

    return placed.select("tile", "side", "fp").repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)``: the smallest node of the component of every node that an
    edge ``(a, b)`` touches, the root itself included."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that a join with a hub's many edges can be split
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        before, edges = edges, materialize(small.where("a <> b").distinct())
        release(before, low)
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile_rows: int = TILE) -> DataFrame:
    """``(doc_id, fp, component_id)``: one row per input row.

    Null and wordless texts have fingerprint zero, linked like any other. Equal
    rows stay as many rows. A row without id is linked but never names a
    component, unless no other does; then the component is null. Further columns
    of ``docs`` are ignored; an empty table gives an empty result.
    """
    marked = materialize(fingerprints(docs, id_col, text_col).withColumnRenamed(id_col, "id"))
    nodes = materialize(marked.groupBy("fp").agg(F.min("id").alias("first")))
    tree = components(near_links(nodes.select("fp"), radius, tile_rows))
    joined = nodes.join(tree, nodes["fp"] == tree["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def later_rows(rows: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile_rows: int = TILE) -> DataFrame:
    """``row``: the numbers of all rows but one of each component. The row of the
    smallest id stays (without id: after all others), of these the smallest number."""
    marked = materialize(fingerprints(rows, id_col, text_col, row_col).withColumnRenamed(id_col, "id"))
    nodes = materialize(marked.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")))
    tree = components(near_links(nodes.select("fp"), radius, tile_rows))
    joined = nodes.join(tree, nodes["fp"] == tree["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("stays"))
    named = materialize(joined.select("fp", "root").join(least, "root").select("fp", F.col("stays.row").alias("stays")))
    gone = materialize(marked.join(named, "fp").where("row <> stays").select("row"))
    release(marked, nodes, named)
    return gone


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each component.

    Rows are told apart by a number of their own: rows of one id with unrelated texts
    all stay, equal rows leave one, and rows without id count like any other. Null and
    wordless texts are near duplicates of each other. An empty table gives an empty
    result; all columns pass, whatever their names."""
    rows, number = with_numbers(docs)
    gone = later_rows(rows, number, id_col, text_col)
    return rows.join(gone, rows[number] == gone["row"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
