"""Shard assignment by a hierarchical weighted hash tree (DataFrame functions only).

A topology has regions, racks and shards. A row descends it: at each level every
child makes a weighted hash draw ``-ln(u) / weight`` with ``u`` from a hash of the
key and the child's name, and the smallest draw wins. Changing the weight of one
subtree moves keys only into or out of that subtree, at every level above it.

Law ``key``: the shard depends on the key and the topology alone. ``grow`` opens
one more shard as a new region of its own, so only the root's draw changes and
every moved key lands in the new shard.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard are numbered in so many buckets at once; with the number of
#: shards this bounds the table of bucket counts.
SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class Topology:
    """``leaves``: (region, rack, weight) of shard 0, 1, ..."""

    leaves: tuple[tuple[int, int, float], ...]

    @classmethod
    def grid(cls, regions: int, racks: int, shards: int) -> Topology:
        return cls(tuple((r, k, 1.0) for r in range(regions) for k in range(racks) for _ in range(shards)))

    @classmethod
    def of(cls, shards: int, racks: int = 2, per_rack: int = 4) -> Topology:
        """Whole regions of ``racks * per_rack`` shards, then single-shard regions."""
        whole, rest = divmod(shards, racks * per_rack)
        tree = cls.grid(whole, racks, per_rack)
        return reduce(lambda t, _: t.grow(), range(rest), tree)

    def grow(self, weight: float = 1.0) -> Topology:
        return Topology((*self.leaves, (1 + max((x[0] for x in self.leaves), default=-1), 0, weight)))

    def tree(self) -> dict[int, dict[int, dict[int, float]]]:
        out: dict[int, dict[int, dict[int, float]]] = {}
        for shard, (region, rack, weight) in enumerate(self.leaves):
            if weight > 0:
                out.setdefault(region, {}).setdefault(rack, {})[shard] = weight
        return out


def _draw(key: Column, level: int, path: tuple[Column, ...], weight: Column) -> Column:
    """An exponential draw with rate ``weight``: 52 hash bits make ``u`` in (0, 1)."""
    h = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), *path), 12)
    return -F.log((h.cast("double") + F.lit(0.5)) / F.lit(float(2**52))) / weight


def _total(node: dict | float) -> float:
    return sum(map(_total, node.values())) if isinstance(node, dict) else node


def _children(node: dict) -> Column:
    """The names and weights of a node's children, a constant."""
    return F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(_total(x))).alias("weight")) for k, x in node.items()])


def _least(key: Column, level: int, path: tuple[Column, ...], children: Column) -> Column:
    """The smallest draw among the children and its name (ties: the smaller name)."""
    return F.array_min(F.transform(children, lambda c: F.struct(_draw(key, level, (*path, c["name"]), c["weight"]).alias("draw"), c["name"].alias("name"))))


def _constant_map(options: dict[int, Column]) -> Column:
    return F.create_map(*[x for k, v in options.items() for x in (F.lit(k), v)])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def descend(key: Column, topology: Topology) -> Column:
    """The root's smallest draw and the shard (int) of a key, as a struct. A level
    costs one draw for each child of the one node chosen; the tree is a constant."""
    tree = topology.tree()
    if not tree:
        raise ValueError("the topology has no shard with a positive weight")
    racks = _constant_map({r: _children(x) for r, x in tree.items()})
    shards = _constant_map({r: _constant_map({k: _children(y) for k, y in x.items()}) for r, x in tree.items()})

    def in_region(top: Column) -> Column:
        rack = _least(key, 1, (top["name"],), F.element_at(racks, top["name"]))["name"]
        return _let(rack, lambda k: F.struct(top["draw"].alias("draw"), _least(key, 2, (top["name"], k), F.element_at(F.element_at(shards, top["name"]), k))["name"].cast("int").alias("shard")))

    return _let(_least(key, 0, (), _children(tree)), in_region)


def assign(key: Column, topology: Topology) -> Column:
    """The shard (int) of a key."""
    return descend(key, topology)["shard"]


def shard(docs: DataFrame, topology: Topology, id_col: str = "doc_id", text_col: str = "text", buckets: int = SLOT_BUCKETS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``; a row per input row.

    ``size``: UTF-8 bytes of the text plus 16; a null text has none and CRC 0.
    Rows without id are keyed alike and fall into one shard. ``slot`` numbers the
    rows of a shard from 0 without gaps, by bucket, id, CRC and size. Buckets are told
    by id and text, so rows of one id or without id spread; equal rows are counted
    before they meet and numbered one after the other. An empty table gives an empty
    result; further columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.col(id_col).cast("long")
    rows = docs.select(key.alias("k"), (F.octet_length(text).cast("long") + F.lit(16)).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"))
    equal = rows.groupBy("k", "size", "crc").agg(F.count("*").alias("n"))
    # one more shard is a region of its own: it takes a key if its draw beats the root's
    region = topology.grow().leaves[-1][0]
    base = equal.select("*", descend(F.col("k"), topology).alias("place"), _draw(F.col("k"), 0, (F.lit(region),), F.lit(1.0)).alias("new"))
    base = base.select("k", "size", "crc", "n", F.col("place.shard").alias("shard"), F.when(F.col("new") < F.col("place.draw"), len(topology.leaves)).otherwise(F.col("place.shard")).alias("grown"), F.pmod(F.xxhash64(F.lit(7), "k", "size", "crc"), F.lit(buckets)).cast("int").alias("bucket"))
    counts = base.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("k", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = base.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["shard", "bucket"])
    first = F.col("start") + F.col("at")
    out = numbered.select("k", "size", "crc", "shard", "grown", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot"))
    return out.select(F.col("k").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.col("grown").cast("int").alias("grown_shard"))
