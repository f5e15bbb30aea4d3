"""Packing of tokenised documents into windows by minimum bin slack.

A document's tokens are cut at multiples of the window; whole windows stand alone
and one remainder per document is left. Remainders are planned as a multiset: a
histogram of lengths (fewer rows than the window has tokens) goes to the driver,
where each step takes the longest length left and a bitset subset-sum dynamic
programme finds the multiset that fills the window closest to capacity;
backtracking gives its counts, and the fill is used as often as stock allows. As
documents may be cut anywhere, a fill is only taken where its slack is zero: a length
that no fill closes exactly goes, with all its stock, to a final stream
that is laid end to end and cut at window borders; the stream's tail is split into
powers of two, which need no padding. The plan is a bounded table; documents find
their place by their rank within their length, so no group is ever collected.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 4096
END_ID = 2
#: Distinct words whose ids a Python worker remembers.
CACHE_WORDS = 500_000
#: Up to so many documents cut in the final stream are found by a broadcast; more, by a join.
BROADCAST_IDS = 100_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: visible Latin-1 characters stand for
    themselves, the others follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of texts, word by word through caches.

    The vocabulary's pre-tokenizer drops white space, so a text's ids are those of
    its words in turn. Words of visible ASCII and Latin letters are lower-cased and
    split here, and only their pieces not met before go to the vocabulary's model;
    any other word, and a text with a special token, is encoded by the tokenizer as
    a whole. A vocabulary of another make is used as a whole too.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.letters = _byte_letters()
        parts = json.loads(self.model.to_str())
        made = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])], [x["type"] for x in (parts["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_word = made == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
        if self.by_word:
            self.split = regex.compile(parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
            self.plain = re.compile("[!-~À-įı-ɏ]+").fullmatch
            self.step = self.model.model.tokenize

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            found = self.pieces[piece] = struct.pack(f"<{len(ids)}I", *ids) if (ids := [t.id for t in self.step(shown)]) else b""
        return found

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        if not self.plain(text):
            return self.whole(text)
        text = text.lower()
        return self.piece(text) if text.isalpha() else b"".join([self.piece(p) for p in self.split(text)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The little-endian 32-bit ids of each text."""
        known, out = self.known, []
        for text in texts:
            if not self.by_word or any(s in text for s in self.special):
                out.append(self.whole(text))
                continue
            if len(known) > CACHE_WORDS or len(self.pieces) > CACHE_WORDS:
                known.clear()
                self.pieces.clear()
            words = text.encode().split()
            for w in words:
                if w not in known:
                    known[w] = self.word(w)
            out.append(b"".join([known[w] for w in words]))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for a worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _slices(batch: pa.RecordBatch, column: int, most: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with about ``most`` characters of text."""
    texts = [t.as_py() or "" for t in batch.column(column)]
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > most or i + 1 == len(texts):
            yield batch.slice(at, i + 1 - at), texts[at : i + 1]
            at, size = i + 1, 0


def fills(stock: dict[int, int], capacity: int) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """``([(times, {length: count}), ...], rest)``: fills of exactly ``capacity`` and
    the stock of lengths that none of them closes."""
    stock = {k: n for k, n in stock.items() if n > 0}
    out: list[tuple[int, dict[int, int]]] = []
    rest: dict[int, int] = {}
    order = sorted(stock, reverse=True)
    for longest in order:
        while stock.get(longest):
            counts = _closest(stock, longest, capacity, order)
            if counts is None:
                rest[longest] = stock.pop(longest)
                break
            times = min(stock[k] // c for k, c in counts.items())
            out.append((times, counts))
            for k, c in counts.items():
                stock[k] -= times * c
                if not stock[k]:
                    del stock[k]
    return out, rest


def _closest(stock: dict[int, int], longest: int, capacity: int, order: list[int]) -> dict[int, int] | None:
    """The counts of an exact fill with ``longest`` in it, or None. Bit s of
    ``reach`` says that some multiset of the lengths so far sums to s."""
    goal = capacity - longest
    if goal < 0:
        return None
    if not goal:
        return {longest: 1}
    mask = (1 << (goal + 1)) - 1
    reach, steps = 1, []
    for k in order:
        have = stock.get(k, 0) - (k == longest)
        if k > goal or have <= 0:
            continue
        have = min(have, goal // k)
        take = 1
        while have:  # binary parts of the count
            take = min(take, have)
            after = (reach | (reach << (k * take))) & mask
            if after != reach:
                steps.append((k, take, reach))
                reach = after
                if reach >> goal & 1:
                    have = 0
                    break
            have -= take
            take *= 2
        if reach >> goal & 1:
            break
    if not reach >> goal & 1:
        return None
    counts = {longest: 1}
    for k, take, before in reversed(steps):
        if not before >> goal & 1:
            goal -= k * take
            counts[k] = counts.get(k, 0) + take
    return counts


class Plan:
    """Where the remainder of rank r among those of its length goes."""

    def __init__(self, histogram: dict[int, int], window: int) -> None:
        self.window = window
        self.by_length: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        exact, rest = fills(histogram, window)
        self.sequences = 0
        for times, counts in exact:
            offset = 0
            for k, c in sorted(counts.items(), reverse=True):
                self.by_length.setdefault(k, []).append((used.get(k, 0), c, self.sequences, offset))
                used[k] = used.get(k, 0) + times * c
                offset += k * c
            self.sequences += times
        self.stream: dict[int, tuple[int, int]] = {}
        self.total = 0
        for k in sorted(rest, reverse=True):
            self.stream[k] = (used.get(k, 0), self.total)
            self.total += k * rest[k]
        whole, tail = divmod(self.total, window)
        #: Stream offsets where sequences begin beyond the whole windows.
        self.tail = []
        at = whole * window
        for bit in range(tail.bit_length() - 1, -1, -1):
            if tail >> bit & 1:
                self.tail.append(at)
                at += 1 << bit
        self.whole = whole
        self.first_full = self.sequences + whole + len(self.tail)

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """``(start, length, sequence, offset)`` within the remainder."""
        if length in self.stream and rank >= self.stream[length][0]:
            first, base = self.stream[length]
            at, end, start, out = base + (rank - first) * length, base + (rank - first + 1) * length, 0, []
            while at < end:
                if at < self.whole * self.window:
                    seq, offset = divmod(at, self.window)
                    stop = (seq + 1) * self.window
                else:
                    i = int(np.searchsorted(self.tail, at, "right")) - 1
                    seq, offset = self.whole + i, at - self.tail[i]
                    stop = self.tail[i + 1] if i + 1 < len(self.tail) else self.total
                n = min(end, stop) - at
                out.append((start, n, self.sequences + seq, offset))
                start, at = start + n, at + n
            return out
        runs = self.by_length[length]
        lo, hi = 0, len(runs)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if runs[mid][0] <= rank else (lo, mid)
        first, count, seq, offset = runs[lo]
        t, j = divmod(rank - first, count)
        return [(0, length, seq + t, offset + j * length)]


def tokenized(docs: DataFrame, path: str, window: int) -> DataFrame:
    """``id, mark, n, crcs, part, full_at, rank``: a row per document. ``crcs`` are of
    its whole windows and its remainder; ``full_at`` and ``rank`` count whole windows
    and remainders of this length before it in its task's partition."""
    names = "id long, mark long, n long, crcs array<long>, part int, full_at long, rank long"
    schema = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("crcs", pa.list_(pa.int64())), ("part", pa.int32()), ("full_at", pa.int64()), ("rank", pa.int64())])
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        model = encoder(path)
        seen: dict[int, int] = {}
        full = 0
        step = 4 * window
        for batch in batches:
            for rows, texts in _slices(batch, 2):
                out: list[list] = [[], [], [], []]
                for raw in model.encode(texts):
                    raw += end
                    n = len(raw) // 4
                    rest = n % window
                    out[0].append(n)
                    out[1].append([zlib.crc32(raw[at : at + step]) for at in range(0, len(raw), step)])
                    out[2].append(full)
                    out[3].append(seen.get(rest, 0))
                    full += n // window
                    seen[rest] = seen.get(rest, 0) + 1
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *[pa.array(x, f.type) for x, f in zip([out[0], out[1], [part] * len(texts), out[2], out[3]], list(schema)[2:], strict=True)]], schema=schema)

    return docs.select("id", "mark", "text").mapInArrow(run, names)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: a row per
    piece; every id of every row lies in one piece.

    Null and empty texts are one end id. Repeated rows are packed each. An empty
    table gives an empty result; further columns are ignored.
    """
    path = tokenizer or default_tokenizer()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    rows = materialize(tokenized(plain, path, window))
    per_part = materialize(rows.groupBy("part", (F.col("n") % window).alias("rest")).agg(F.count("*").alias("docs"), F.sum(F.floor(F.col("n") / window)).alias("full")))
    plan = Plan({r["rest"]: r["docs"] for r in per_part.where("rest > 0").groupBy("rest").agg(F.sum("docs").alias("docs")).collect()}, window)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_part.select("part", "rest", F.coalesce(F.sum("docs").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rank0"))
    starts = per_part.groupBy("part").agg(F.sum("full").alias("full")).select("part", F.coalesce(F.sum("full").over(before), F.lit(0)).alias("full0"))
    base = ranks.join(starts, "part")
    placed = rows.withColumn("rest", F.col("n") % window).join(base, ["part", "rest"]).select("id", "mark", "n", "crcs", "rest", (F.col("rank") + F.col("rank0")).alias("rank"), (F.col("full_at") + F.col("full0")).alias("full_at"))
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    names = "id long, mark long, start long, length long, crc long, n long, sequence_id long, `offset` long"
    schema = pa.schema([(c, pa.int64()) for c in ("id", "mark", "start", "length", "crc", "n", "sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                full = r["n"] // window
                for i in range(full):
                    out.append((r["id"], r["mark"], i * window, window, r["crcs"][i], r["n"], plan.first_full + r["full_at"] + i, 0))
                if r["rest"]:
                    pieces = plan.pieces(r["rest"], r["rank"])
                    for start, length, seq, offset in pieces:
                        out.append((r["id"], r["mark"], full * window + start, length, r["crcs"][full] if len(pieces) == 1 else None, r["n"], seq, offset))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 8)], schema=schema)

    pieces = materialize(placed.mapInArrow(run, names))
    cut = pieces.where("crc is null").select("id", "mark", "start", "length").distinct()
    cuts = cut.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "length")).alias("cuts"))
    few = cuts.count() <= BROADCAST_IDS
    wanted = plain.dropDuplicates(["id", "mark"]) if not few else plain
    found = wanted.join(F.broadcast(cuts.withColumnRenamed("id", "cid").withColumnRenamed("mark", "cmark")) if few else cuts.withColumnRenamed("id", "cid").withColumnRenamed("mark", "cmark"), F.col("id").eqNullSafe(F.col("cid")) & (F.col("mark") == F.col("cmark")))
    crc_schema = pa.schema([(c, pa.int64()) for c in ("id", "mark", "start", "length", "crc2")])
    end = np.array([END_ID], "<u4").tobytes()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            for part, texts in _slices(batch, 2):
                out = []
                for i, mark, cuts, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), model.encode(texts), strict=True):
                    raw += end
                    out += [(i, mark, c["start"], c["length"], zlib.crc32(raw[4 * c["start"] : 4 * (c["start"] + c["length"])])) for c in cuts]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 5)], schema=crc_schema)

    redone = found.select("id", "mark", "text", "cuts").mapInArrow(again, "id long, mark long, start long, length long, crc2 long").distinct()
    redone = redone.select(F.col("id").alias("rid"), F.col("mark").alias("rmark"), F.col("start").alias("rstart"), F.col("length").alias("rlength"), "crc2")
    open_pieces = pieces.where("crc is null")
    closed = open_pieces.join(redone, open_pieces["id"].eqNullSafe(F.col("rid")) & (open_pieces["mark"] == F.col("rmark")) & (open_pieces["start"] == F.col("rstart")) & (open_pieces["length"] == F.col("rlength"))).select("id", "mark", "start", "length", F.col("crc2").alias("crc"), "n", "sequence_id", "offset")
    return pieces.where("crc is not null").unionByName(closed).select(F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")
