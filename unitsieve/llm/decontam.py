"""Benchmark decontamination: BM25 over test items with block-max WAND.

The inverted index holds the test items; every passage of every document is a
query. Scores are divided by an item's score for its own text, so one threshold
suits items of any length. Item numbers are cut into blocks, and postings keep their
greatest impact in each block: for a passage, the sums of these bounds show in one
vectorised step which blocks can reach the threshold at all; the others are skipped.
Within a block that can, a pivot moves by the terms' bounds there. Every item above
the threshold is retrieved, then its question and its answer are looked for in the
passage by five-word shingles.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.8
PART_OVERLAP = 0.5
SHINGLE = 5
EPS = 1e-9
#: Items of a block; neighbours have similar words.
BLOCK = 4
#: Items of one index; more items make more indexes, each read against all documents.
INDEX_ITEMS = 20_000
#: Of items with fewer words, question and answer must each stand whole in the passage.
MIN_ITEM_WORDS = 8
_CLEAN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
#: Characters of scripts without blanks between words, and their punctuation.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_WIDE_MARKS = re.compile("[\u3000-\u3004\u3008-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def terms(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation; in scripts without blanks, characters."""
    if not text:
        return []
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", _WIDE_MARKS.sub(" ", text))
    return text.lower().encode().translate(_CLEAN).split()


def parts(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item: its last sentence is the answer; an item of
    one sentence ends with its answer, a fifth of its words."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|(?<=[\u3002\uff01\uff1f])", text.strip()) if terms(s)]
    if len(sentences) > 1:
        head, tail = terms(" ".join(sentences[:-1])), terms(sentences[-1])
        if len(head) >= SHINGLE:
            return head, tail
    words = terms(text)
    cut = len(words) - max(1, len(words) // 5)
    return words[:cut], words[cut:]


def shingles(words: list[bytes], width: int = SHINGLE) -> set[tuple[bytes, ...]]:
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width)), strict=False))


def _by_likeness(items: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Items ordered so that neighbours share frequent words (and so a language) and
    are of similar length: by which of the most frequent words they hold."""
    held = [set(terms(t)) for _, t in items]
    df = Counter(w for h in held for w in h)
    top = sorted(df, key=lambda w: (-df[w], w))[:64]
    order = sorted(range(len(items)), key=lambda k: (tuple(w not in held[k] for w in top), len(items[k][1]), items[k][0] is None, items[k][0] or 0, items[k][1]))
    return [items[k] for k in order]


class Index:
    """Items with their postings. ``items``: (item_id, text)."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        items = _by_likeness([i for i in items if terms(i[1])])
        self.ids = [i for i, _ in items]
        words = [terms(t) for _, t in items]
        self.longest = max(map(len, words), default=0)
        self.parts = [parts(t) for _, t in items]
        n, mean = len(items), sum(map(len, words)) / max(1, len(items))
        df = Counter(t for w in words for t in set(w))
        postings: dict[bytes, list[tuple[int, float]]] = {}
        for i, w in enumerate(words):
            norm = K1 * (1 - B + B * len(w) / mean)
            impacts = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in Counter(w).items()}
            own = sum(impacts.values())
            for t, x in impacts.items():
                postings.setdefault(t, []).append((i, x / own))
        self.term = {t: k for k, t in enumerate(sorted(postings))}
        #: For each term, block → (items, impacts, greatest impact).
        self.cells: list[dict[int, tuple[list[int], list[float], float]]] = []
        for t in sorted(postings):
            cells: dict[int, tuple[list[int], list[float], float]] = {}
            for i, x in postings[t]:
                docs, impacts, most = cells.get(i // BLOCK, ([], [], 0.0))
                cells[i // BLOCK] = ([*docs, i], [*impacts, x], max(most, x))
            self.cells.append(cells)
        self.blocks = -(-n // BLOCK)
        self.block_at = [np.fromiter(c, np.int64, len(c)) for c in self.cells]
        self.block_max = [np.fromiter((x[2] for x in c.values()), float, len(c)) for c in self.cells]
        self.bound = np.array([x.max() for x in self.block_max] + [0.0])

    def search(self, query: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all items scoring at least ``threshold`` for distinct terms."""
        if not query:
            return []
        reach = np.bincount(np.concatenate([self.block_at[t] for t in query]), np.concatenate([self.block_max[t] for t in query]), self.blocks)
        found = []
        for b in np.flatnonzero(reach >= threshold - EPS).tolist():
            found += self._in_block([self.cells[t][b] for t in query if b in self.cells[t]], threshold)
        return found

    @staticmethod
    def _in_block(lists: list[tuple[list[int], list[float], float]], threshold: float) -> list[tuple[int, float]]:
        """WAND over the postings of one block. A list's state is (item at its cursor,
        cursor, items, impacts, bound)."""
        live = sorted((x[0][0], 0, *x) for x in lists)
        found = []
        while live:
            total, pivot = 0.0, -1
            for k, x in enumerate(live):
                total += x[4]
                if total >= threshold - EPS:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = live[pivot][0]
            goal = doc
            if live[0][0] == doc:
                score = sum(x[3][x[1]] for x in live if x[0] == doc)
                if score >= threshold - EPS:
                    found.append((doc, score))
                goal = doc + 1
            moved = []
            for at, k, docs, impacts, most in live:
                while at < goal:
                    k += 1
                    if k == len(docs):
                        break
                    at = docs[k]
                if k < len(docs):
                    moved.append((at, k, docs, impacts, most))
            live = sorted(moved)
        return found

    def matches(self, text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, float, float, float]]:
        """``(item_id, score, question, answer)`` of verified items of a whole text."""
        words = terms(text)
        n = len(words)
        if not n or not self.longest:
            return []
        get, none = self.term.get, len(self.term)
        at = np.fromiter((get(w, none) for w in words), np.int64, n)
        weight = np.concatenate(([0.0], np.cumsum(self.bound[at])))
        step = max(self.longest, 16)
        starts = np.arange(0, max(1, n - step), step)
        ends = np.minimum(starts + 2 * step, n)
        best: dict[int, tuple[int, float, float, float]] = {}
        for k in np.flatnonzero(weight[ends] - weight[starts] >= threshold - EPS).tolist():
            lo, hi = int(starts[k]), int(ends[k])
            query = np.unique(at[lo:hi])
            query = query[query < none]
            if self.bound[query].sum() < threshold - EPS:
                continue
            hits = self.search(query.tolist(), threshold)
            if not hits:
                continue
            seen = shingles(words[lo:hi])
            for item, score in hits:
                q, a = self.parts[item]
                share = []
                sizes = []
                short = len(q) + len(a) < MIN_ITEM_WORDS
                for part in (q, a):
                    want = shingles(part)
                    if not part:  # the question of an item of one term
                        share.append(1.0)
                    elif short or len(part) < SHINGLE:
                        flat, probe = b" " + b" ".join(words[lo:hi]) + b" ", b" " + b" ".join(part) + b" "
                        share.append(float(probe in flat))
                    else:
                        share.append(len(want & seen) / max(1, len(want)))
                    sizes.append(max(1, len(want)))
                whole = (share[0] * sizes[0] + share[1] * sizes[1]) / sum(sizes)
                if whole >= OVERLAP and min(share) >= PART_OVERLAP and (item not in best or best[item][1] < score):
                    best[item] = (self.ids[item], score, share[0], share[1])
        return [best[i] for i in sorted(best)]


def indexes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", most: int = INDEX_ITEMS) -> Iterator[Index]:
    """Indexes of about ``most`` items that together hold all of them."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    blocks = math.ceil(items.count() / most)
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        yield Index([(r["item"], r["text"]) for r in part.collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap``: a row per row of
    ``docs`` and item found in it (an item counts once for a document).

    Null and empty texts hold nothing; rows without id are reported without one,
    repeated rows each; items of equal text are found each, and an item repeated in
    the benchmark counts once; an empty table on either side gives an empty result;
    further columns are ignored.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    names = f"`{id_col}` long, item_id long, score double, question_overlap double, answer_overlap double"
    schema = pa.schema([(id_col, pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])

    def against(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in held.value.matches(t.as_py(), threshold)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 5, schema, strict=True)], schema=schema)

        return plain.mapInArrow(run, names)

    return _one_by_one(benchmark, against, spark.createDataFrame([], names), DataFrame.unionByName)


def _one_by_one(benchmark: DataFrame, against: Callable, start: DataFrame, add: Callable) -> DataFrame:
    """What ``against(index)`` gives for each index, added up. With several, each
    result is written and its index freed before the next is sent, so no more than
    one index of ``INDEX_ITEMS`` items is ever held, however large the benchmark."""
    out, before = start, None
    for index in indexes(benchmark):
        if before is not None:
            out = materialize(out)
            before.destroy()
        before = benchmark.sparkSession.sparkContext.broadcast(index)
        out = add(out, against(before))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their columns as they are.

    Null and empty texts hold nothing and stay; repeated rows fare alike; ids play no
    part; an empty table on either side drops nothing."""
    return _one_by_one(benchmark, _leaks, docs, lambda left, leaks: left.where(~leaks(F.col(text_col).cast("string"))))


def _leaks(held):
    @F.pandas_udf("boolean")
    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda t: bool(held.value.matches(t)), na_action=None).astype(bool)

    return run
