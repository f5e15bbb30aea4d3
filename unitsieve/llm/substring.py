"""Removal of long repeated word spans by De Bruijn compaction.

The windows of ``WINDOW`` words are the edges of a De Bruijn graph whose nodes are the
word sequences between them. Before any shuffle, consecutive windows of a document that
share a minimiser (the least hash among the ``KMER``-word sequences of a window) are
taken as one path of at most ``PATH`` windows. Equal windows have equal minimisers, so
all further work joins paths by minimiser:

1. minimisers met in one document only are out;
2. equal paths are one node of the compacted graph, with the coordinates (row,
   position) of the first document that has it and with its degrees: how many different
   paths precede and follow it. Two nodes are linked if the first is followed by nothing
   but the second and the second preceded by nothing but the first; chains of linked
   nodes compact to one span. Every occurrence of a node goes through its whole chain;
3. at its source coordinates the text is read again. A chain gives a digest of all its
   words; where different paths share a minimiser, each of their windows gives a digest
   of its own, and those that also start in an earlier document are found by a join;
4. a document loses a chain only if its own words at that place have the chain's digest.

Digests have 128 bits. The tables that travel hold a row for a path, not for a window.
Rows of the input are told apart by a number given when they are first written.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix64, numbered, release

WINDOW = 13
KMER = 5
PATH = 32
_CHUNK = 200_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Stands for a missing id: later than all others.
_LAST = (1 << 63) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Spans:
    """Hashes of all word ranges of a list of documents laid end to end."""

    def __init__(self, docs: list[list[bytes]]) -> None:
        digest = xxhash.xxh64_intdigest
        self.sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        n = int(self.sizes.sum())
        self.doc = np.repeat(np.arange(len(docs)), self.sizes)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        word = np.fromiter((digest(w) for words in docs for w in words), np.uint64, n)
        self.back = _powers(_INVERSE, n + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word * _powers(_BASE, n), dtype=np.uint64)))

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mix64((self.sums[end] - self.sums[start]) * self.back[start] + length * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, window: int, kmer: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows that lie in one document, and their minimisers."""
        n = len(self.doc)
        at = np.flatnonzero(self.doc[: max(0, n - window + 1)] == self.doc[window - 1 :]) if n >= window else np.empty(0, np.int64)
        if not len(at):
            return at, np.empty(0, np.uint64)
        starts = np.arange(n - kmer + 1)
        least = mix64(self.range_hash(starts, starts + kmer) ^ np.uint64(0x5851F42D4C957F2D))
        reach, goal = 1, window - kmer + 1
        while reach < goal:
            step = min(reach, goal - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        return at, least[at]

    def paths(self, window: int, kmer: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document index, start in the laid words, windows and minimiser of each path."""
        at, key = self.windows(window, kmer)
        if not len(at):
            return at, at, at, key
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1]) | (self.doc[at[1:]] != self.doc[at[:-1]])
        run = np.cumsum(new) - 1
        inside = np.arange(len(at)) - np.flatnonzero(new)[run]
        head = np.flatnonzero(inside % most == 0)
        size = np.diff(np.append(head, len(at)))
        return self.doc[at[head]], at[head], size, key[head]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[list[bytes]]]]:
    """Rows, ids and words, about ``_CHUNK`` words at once."""
    rows: list[int] = []
    ids: list[int] = []
    docs: list[list[bytes]] = []
    held = 0
    for batch in batches:
        for r, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = (t.as_py() or "").encode().split()
            rows.append(r)
            ids.append(_LAST if i is None else i)
            docs.append(words)
            held += len(words)
            if held > _CHUNK:
                yield np.array(rows, np.int64), np.array(ids, np.int64), docs
                rows, ids, docs, held = [], [], [], 0
    if rows:
        yield np.array(rows, np.int64), np.array(ids, np.int64), docs


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def minimisers(rows: DataFrame, window: int, kmer: int, most: int) -> DataFrame:
    """``(mh, n)``: minimisers of ``rows(row, id, text)`` with the number of rows that
    have it, added up over some hundred rows at a time."""
    schema = pa.schema([("mh", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, docs in _chunks(batches):
            doc, _, _, key = Spans(docs).paths(window, kmer, most)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new_key = np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            fresh = new_key.copy()
            fresh[1:] |= doc[1:] != doc[:-1]
            some = np.flatnonzero(new_key)
            count = np.add.reduceat(fresh.astype(np.int64), some) if len(some) else some
            yield pa.RecordBatch.from_arrays([_signed(key[some]), pa.array(np.minimum(count, 2))], schema=schema)

    return rows.mapInArrow(run, "mh long, n long")


def all_paths(rows: DataFrame, window: int, kmer: int, most: int) -> DataFrame:
    """``(mh, ch, row, id, spot)`` of every path of ``rows(row, id, text)``; ``spot``
    packs its position and its number of windows less one, ``ch`` hashes its words."""
    names = ["mh", "ch", "row", "id", "spot"]
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, docs in _chunks(batches):
            spans = Spans(docs)
            doc, at, size, key = spans.paths(window, kmer, most)
            hashes = spans.range_hash(at, at + size + window - 1)
            yield pa.RecordBatch.from_arrays([_signed(key), _signed(hashes), pa.array(row[doc]), pa.array(ids[doc]), pa.array(((at - spans.first[doc]) << 6) | (size - 1))], schema=schema)

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _at(spot: str | Column) -> Column:
    return F.shiftright(spot, 6)


def _windows(spot: str | Column) -> Column:
    return (F.col(spot) if isinstance(spot, str) else spot).bitwiseAND(F.lit(63)) + 1


def nodes_of(hits: DataFrame) -> DataFrame:
    """``mh, ch, lo, hi, row, spot, prev_one, next_one``: the nodes of the compacted
    graph with their source (the first occurrence in the document of the smallest id,
    ``lo``), and the one node that is always before and after, or null."""
    by_row = Window.partitionBy("row").orderBy("spot")
    key = F.xxhash64("mh", "ch")
    near = hits.withColumn("key", key)
    before = F.when(F.lag(_at("spot") + _windows("spot")).over(by_row) == _at("spot"), F.lag("key").over(by_row))
    after = F.when(F.lead(_at("spot")).over(by_row) == _at("spot") + _windows("spot"), F.lead("key").over(by_row))
    near = near.select("mh", "ch", "id", "row", "spot", before.alias("before"), after.alias("after"))
    one = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c))
    grouped = near.groupBy("mh", "ch").agg(F.min(F.struct("id", "row", "spot")).alias("src"), F.max("id").alias("hi"), one("before").alias("prev_one"), one("after").alias("next_one"))
    return grouped.select("mh", "ch", F.xxhash64("mh", "ch").alias("key"), F.col("src.id").alias("lo"), "hi", F.col("src.row").alias("row"), F.col("src.spot").alias("spot"), "prev_one", "next_one")


def chained(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``head`` (the first of its chain) and, for heads, ``length``: the
    windows of the chain. Links are met at the source: a chain lies there as it does in
    every occurrence."""
    by_row = Window.partitionBy("row").orderBy("spot")
    linked = (F.lag("key").over(by_row) == F.col("prev_one")) & (F.lag("next_one").over(by_row) == F.col("key")) & (F.lag(_at("spot") + _windows("spot")).over(by_row) == _at("spot"))
    marked = nodes.withColumn("head", ~F.coalesce(linked, F.lit(False)))
    marked = marked.withColumn("chain", F.sum(F.col("head").cast("long")).over(by_row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.withColumn("length", F.when(F.col("head"), F.sum(_windows("spot")).over(Window.partitionBy("row", "chain")))).drop("chain")


def _digest(words: list[bytes]) -> bytes:
    return blake2b(b" ".join(words), digest_size=16).digest()


def _read_again(window: int):
    """Digests at the wanted coordinates of a row: of whole chains, and of each window
    of the paths that share a minimiser with others."""
    schema = pa.schema([("mh", pa.int64()), ("ch", pa.int64()), ("id", pa.int64()), ("bit", pa.int32()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, wanted in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "wanted")), strict=True):
                words = (t or "").encode().split()
                out: list[tuple] = []
                for w in wanted:
                    at = w["spot"] >> 6
                    if w["length"]:
                        out.append((w["mh"], w["ch"], i, -1, _digest(words[at : at + w["length"] + window - 1])))
                    if w["forked"]:
                        out += [(w["mh"], w["ch"], i, k, _digest(words[at + k : at + k + window])) for k in range((w["spot"] & 63) + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run, "mh long, ch long, id long, bit int, digest binary"


def covered_spans(rows: DataFrame, window: int = WINDOW, kmer: int = KMER, most: int = PATH) -> tuple[DataFrame, list[DataFrame]]:
    """``(row, at, length, digest, bits)`` for places of ``rows(row, id, text)`` whose
    windows also start in a document of a smaller id: ``length`` windows from ``at`` on
    if the words there have the digest, or those marked in ``bits``. Also the written
    tables that it reads."""
    if not kmer < window or not 1 <= most <= 63:
        raise ValueError("kmer must be below window, and a path has 1 to 63 windows")
    shared = materialize(minimisers(rows, window, kmer, most).groupBy("mh").agg(F.sum("n").alias("n")).where("n > 1").select("mh"))
    hits = materialize(all_paths(rows, window, kmer, most).join(shared.hint("shuffle_hash"), "mh", "left_semi"))
    release(shared)
    nodes = materialize(nodes_of(hits))
    forked = materialize(nodes.groupBy("mh").agg(F.count("*").alias("n")).where("n > 1").select("mh"))
    # chains of one document alone are not read; their windows may be, at forks
    chains = materialize(chained(nodes))
    wanted = chains.join(forked.withColumn("forked", F.lit(True)), "mh", "left").select("row", F.struct("mh", "ch", "spot", F.when(F.col("lo") < F.col("hi"), F.col("length")).alias("length"), F.coalesce("forked", F.lit(False)).alias("forked")).alias("w"))
    wanted = materialize(wanted.where("w.length is not null or w.forked").groupBy("row").agg(F.collect_list("w").alias("wanted")))
    run, schema = _read_again(window)
    texts = rows.select("row", F.coalesce("id", F.lit(_LAST)).alias("id"), "text")
    read = materialize(texts.join(wanted, "row").select("id", "text", "wanted").mapInArrow(run, schema))
    release(nodes, forked, wanted)
    windows = read.where("bit >= 0")
    first = materialize(windows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("hi")).where("first < hi").select("digest", "first"))
    late = windows.join(first, "digest").where("first < id").groupBy("mh", "ch").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    known = chains.where((F.col("head") & (F.col("lo") < F.col("hi")))).select("mh", "ch", "lo", "length").join(read.where("bit < 0").select("mh", "ch", "digest"), ["mh", "ch"])
    known = materialize(known.join(late, ["mh", "ch"], "full"))
    whole = F.col("lo").isNotNull() & (F.col("lo") < F.col("id"))
    found = hits.join(known, ["mh", "ch"]).where(whole | F.col("bits").isNotNull())
    return found.select("row", _at("spot").alias("at"), F.when(whole, F.col("length")).alias("length"), F.when(whole, F.col("digest")).alias("digest"), "bits"), [hits, chains, read, first, known]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, kmer: int = KMER, most: int = PATH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text``: a row per input row.

    A word goes if a window of ``window`` consecutive words that covers it also
    starts in a document with a smaller id; windows are judged on the input. Null
    texts have no words. Rows without id are later than all others (and than the
    greatest 64-bit id, which they share) and, as rows of one id, do not count against
    each other; any number of rows may have one id or none. Repeated rows fare alike.
    Further columns are ignored; an empty table gives an empty result.
    """
    rows = numbered(docs, id_col, text_col)
    spans, tables = covered_spans(rows, window, kmer, most)
    gone = materialize(spans.groupBy("row").agg(F.collect_list(F.struct("at", "length", "digest", "bits")).alias("gone")))
    release(*tables)
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                out = []
                for t, gone in zip(part.column(1), part.column(2), strict=True):
                    words = (t.as_py() or "").encode().split()
                    n = len(words)
                    gone = gone.as_py()
                    if gone:
                        cover = np.zeros(n + 1, np.int64)
                        for g in gone:
                            at = g["at"]
                            if g["length"]:
                                end = at + g["length"] + window - 1
                                if end <= n and _digest(words[at:end]) == g["digest"]:
                                    cover[at] += 1
                                    cover[end] -= 1
                            if g["bits"]:
                                for k in range(most):
                                    if g["bits"] >> k & 1:
                                        cover[at + k] += 1
                                        cover[at + k + window] -= 1
                        words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:n]) == 0).tolist()]
                    out.append((n, n - len(words), b" ".join(words).decode()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], schema=schema)

    joined = rows.join(gone, "row", "left").select("id", "text", "gone")
    return joined.mapInArrow(run, "id long, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)
