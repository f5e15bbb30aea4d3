"""Brown class-based bigram language model.

Words belong to classes; ``P(w | v) = P(class(w) | class(v)) * P(w | class(w))``.
Classes come from exchange clustering: one word at a time moves to the class that
raises the likelihood of the corpus most. All ``HEAD`` most frequent words are
clustered, in three steps of growing width and falling cost for each word:

1. the ``FIRST`` leading words and, for all others, groups by word ending, exactly,
   over their matrix of bigram counts;
2. the ``LEADERS`` leading words, over the counts of each word with each class next
   to it, taken anew from the whole training part in every round;
3. the rest of the head, each word by one exchange over such counts, in the tasks
   that add them up.

Words outside the head share the classes of their endings. What reaches the driver
is bounded by ``HEAD`` words and by words times classes, at any input size; word
counts, and the counts that the classes are learned from, cover the whole training
part. The counts of words outside the head stay in a table and meet the documents in
a join by word; no such word can be frequent, as the head has all that are.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, numbered, release

HEAD = 131_072
LEADERS = 16_384
FIRST = 1_024
SUFFIXES = 511
CLASSES = 32
ROUNDS = 6
DELTA = 0.1
#: Cells of one block when tasks add up their counts.
BLOCK = 1 << 16
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Words counted, and tokens gathered, before a task passes its counts on.
_SEGMENT = 1_500_000
_FLUSH = 250_000


def tokens(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased; the end token is not in the list."""
    return text.encode().translate(_LOWER).split() if text else []


def held_out(id_column: Column) -> Column:
    """True where crc32 of the id as text is 0 modulo 10 (a null id counts as '')."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % 10 == 0


def suffix_group(word: bytes) -> int:
    return zlib.crc32(word.rstrip(b".,;:!?\"')")[-3:]) % SUFFIXES


class Lexicon:
    """The head, most frequent word first. A unit is a head word's place, then a
    suffix group (for words outside the head), then the end token."""

    def __init__(self, head: list[bytes]) -> None:
        self.index = {w: i for i, w in enumerate(head)}
        self.size = len(head)
        self.units = self.size + SUFFIXES + 1
        self.end = self.units - 1
        self.groups = np.array([suffix_group(w) for w in head], np.int64)

    def read(self, words: list[bytes]) -> tuple[np.ndarray, Counter[bytes]]:
        """The units of words, and those outside the head with their counts."""
        get = self.index.get
        at = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        out = np.flatnonzero(at < 0).tolist()
        others = Counter(words[i] for i in out)
        unit = {w: self.size + suffix_group(w) for w in others}
        for i in out:
            at[i] = unit[words[i]]
        return at, others

    def level(self, leading: int) -> np.ndarray:
        """For each unit its number where only ``leading`` words stand for themselves."""
        leading = min(leading, self.size)
        own = np.arange(self.size)
        return np.concatenate((np.where(own < leading, own, leading + self.groups), leading + np.arange(SUFFIXES + 1))).astype(np.int64)


def word_counts(train: DataFrame) -> DataFrame:
    """``word, n, suffix`` of every word of ``train(text)``, with local counts first."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("suffix", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        held = 0

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64()), pa.array([suffix_group(w) for w in counts], pa.int32())], schema=schema)

        for batch in batches:
            for t in batch.column(0):
                words = tokens(t.as_py())
                counts.update(words)
                held += len(words)
                if held > _SEGMENT:
                    yield found()
                    counts.clear()
                    held = 0
        yield found()

    return train.select("text").mapInArrow(run, "word binary, n long, suffix int").groupBy("word").agg(F.sum("n").alias("n"), F.first("suffix").alias("suffix"))


def head_of(vocabulary: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words and their counts, at most ``most``: all words of a
    count or none, where counts beyond 64 are told apart to about two parts in a
    hundred. So the table of counts on the driver is bounded."""
    scale = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.log2("n") * 32)).cast("long")
    kinds = {r["s"]: r["words"] for r in vocabulary.groupBy(scale.alias("s")).agg(F.count("*").alias("words")).collect()}
    held, least = 0, None
    for s in sorted(kinds, reverse=True):
        if held + kinds[s] > most:
            break
        held, least = held + kinds[s], s
    if least is None:
        return [], np.zeros(0, np.int64)
    rows = vocabulary.where(scale >= least).select("word", "n").toArrow()
    found = sorted(zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    return [w for w, _ in found], np.array([n for _, n in found], np.int64)


def encoded_rows(rows: DataFrame, lexicon) -> DataFrame:
    """``row, id, held_out, ids, others`` of ``rows(row, id, text)``: the units of a
    text as 32-bit numbers, and the words outside the head with their counts."""
    other = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("others", other)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                ids: list[bytes] = []
                words: list[bytes] = []
                counts: list[int] = []
                ends = [0]
                for t in part.column(3):
                    at, found = lex.read(tokens(t.as_py()))
                    ids.append(at.tobytes())
                    words += found
                    counts += found.values()
                    ends.append(len(words))
                pairs = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["word", "n"])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs, type=other)], schema=schema)

    return rows.select("row", "id", held_out(F.col("id")).alias("held_out"), "text").mapInArrow(run, "row long, id long, held_out boolean, ids binary, others array<struct<word:binary,n:long>>")


def _sequences(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[np.ndarray]:
    """Units of many texts in one array, an end before, between and after them."""
    mark = np.array([end], np.int32).tobytes()
    parts: list[bytes] = []
    held = 0
    for batch in batches:
        for x in batch.column(0).to_pylist():
            parts += (mark, x)
            held += len(x) + 4
            if held > 4 * _FLUSH:
                yield np.frombuffer(b"".join([*parts, mark]), np.int32).astype(np.int64)
                parts, held = [], 0
    if parts:
        yield np.frombuffer(b"".join([*parts, mark]), np.int32).astype(np.int64)


def _summed(train: DataFrame, end: int, cells: int, count: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``k, at, n``: how often each of ``cells`` cells is met over all tasks, where
    ``count`` gives the cells of a sequence, in blocks of ``BLOCK`` cells; only cells
    that are not zero travel."""
    schema = pa.schema([("k", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])

    def rows(k: int, block: np.ndarray) -> tuple[int, bytes, bytes]:
        some = np.flatnonzero(block)
        return k, some.astype("<u2").tobytes(), block[some].astype("<i8").tobytes()

    def table(found: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], schema.field(i).type) for i in range(3)], schema=schema)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.uint32)
        one = np.uint32(1)
        for sequence in _sequences(batches, end):
            np.add.at(total, count(sequence), one)
        for k, a in enumerate(range(0, cells, BLOCK)):
            if total[a : a + BLOCK].any():
                yield table([rows(k, total[a : a + BLOCK])])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums.setdefault(k, np.zeros(BLOCK, np.int64))[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<i8")
        yield table([rows(k, block) for k, block in sums.items()])

    names = "k int, at binary, n binary"
    return train.select("ids").mapInArrow(local, names).repartition("k").mapInArrow(merge, names)


def _gather(blocks: DataFrame, cells: int) -> np.ndarray:
    out = np.zeros(-(-cells // BLOCK) * BLOCK, np.int64)
    with lean(blocks.sparkSession):
        found = blocks.toArrow()
    for r in found.to_pylist():
        out[r["k"] * BLOCK + np.frombuffer(r["at"], "<u2").astype(np.int64)] = np.frombuffer(r["n"], "<i8")
    return out[:cells]


def pair_counts(train: DataFrame, level: np.ndarray, end: int) -> np.ndarray:
    """Bigram counts of the units that ``level`` maps to (all of them, as a matrix)."""
    n = int(level.max()) + 1

    def count(sequence: np.ndarray) -> np.ndarray:
        s = level[sequence]
        return s[:-1] * n + s[1:]

    return _gather(_summed(train, end, n * n, count), n * n).reshape(n, n)


def _neighbours(start: np.ndarray, of: np.ndarray, classes: int) -> Callable[[np.ndarray], np.ndarray]:
    """The cells, for each unit, of the classes after it, of those before it, and of
    itself after itself, from ``start[unit]`` on (below 0: passed over)."""

    def count(sequence: np.ndarray) -> np.ndarray:
        at, c = start[sequence], of[sequence]
        left, right = at[:-1], at[1:]
        same = left[(left == right) & (left >= 0)] + 2 * classes
        after, before = (left + c[1:])[left >= 0], (right + classes + c[:-1])[right >= 0]
        return np.concatenate((after, before, same))

    return count


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(m: np.ndarray) -> float:
    """What the classes add to the log likelihood, from class bigram counts."""
    return float(_f(m).sum() - _f(m.sum(axis=1)).sum() - _f(m.sum(axis=0)).sum())


def gains(m: np.ndarray, right: np.ndarray, left: np.ndarray, own: float) -> np.ndarray:
    """What :func:`likelihood` gains when a unit joins each class. ``m`` is without the
    unit; ``right`` and ``left`` are its counts with the classes after and before it,
    without itself, and ``own`` those of itself after itself."""
    rows, cols = m.sum(axis=1) + left, m.sum(axis=0) + right  # its bigrams stand in other rows too
    fm = _f(m)
    gain = (_f(m + right) - fm).sum(axis=1) + (_f(m + left[:, None]) - fm).sum(axis=0)
    d = np.diag(m)
    gain += _f(d + right + left + own) - _f(d + right) - _f(d + left) + _f(d)
    return gain - (_f(rows + right.sum() + own) - _f(rows) + _f(cols + left.sum() + own) - _f(cols))


def _without(m: np.ndarray, a: int, right: np.ndarray, left: np.ndarray, own: float, sign: int = -1) -> None:
    m[a, :] += sign * right
    m[:, a] += sign * left
    m[a, a] += sign * own


def cluster(pairs: np.ndarray, classes: int = CLASSES, rounds: int = 12) -> np.ndarray:
    """Exchange clustering over all bigram counts: the class of each unit; the last
    unit keeps class ``classes`` to itself. Starts from units dealt out by frequency;
    ties go to the class with the smaller number."""
    n = len(pairs)
    pairs = pairs.astype(float)
    freq = pairs.sum(axis=1)
    order = [u for u in sorted(range(n - 1), key=lambda u: (-freq[u], u)) if freq[u] or pairs[:, u].any()]
    of = np.zeros(n, np.int64)
    of[order] = np.arange(len(order)) % classes
    of[n - 1] = classes
    for _ in range(rounds):
        one = np.zeros((n, classes + 1))
        one[np.arange(n), of] = 1
        m = one.T @ pairs @ one
        moved = 0
        for u in order:
            a, own = int(of[u]), pairs[u, u]
            right, left = pairs[u] @ one, pairs[:, u] @ one
            right[a] -= own
            left[a] -= own
            _without(m, a, right, left, own)
            b = _best(m, a, right, left, own, classes)
            _without(m, b, right, left, own, 1)
            if b != a:
                one[u, a], one[u, b], of[u] = 0, 1, b
                moved += 1
        if not moved:
            break
    return of


def _best(m: np.ndarray, a: int, right: np.ndarray, left: np.ndarray, own: float, classes: int) -> int:
    gain = gains(m, right, left, own)
    b = int(np.argmax(gain[:classes]))
    return a if gain[b] <= gain[a] + 1e-9 else b


def class_moves(near: np.ndarray, of: np.ndarray, classes: int) -> np.ndarray:
    """Class bigram counts from the counts of units with classes."""
    m = np.zeros((classes + 1, classes + 1))
    np.add.at(m, of, near[:, : classes + 1])
    return m


def sweep(near: np.ndarray, of: np.ndarray, classes: int) -> tuple[np.ndarray, int]:
    """One round of exchange over counts of units with classes, as taken before the
    round; class bigram counts follow each move. The last unit stays."""
    of, width = of.copy(), classes + 1
    m = class_moves(near, of, classes)
    freq = near[:, :width].sum(axis=1)
    moved = 0
    for u in sorted(np.flatnonzero(freq[:-1]).tolist(), key=lambda u: (-freq[u], u)):
        a, own = int(of[u]), float(near[u, 2 * width])
        right, left = near[u, :width].astype(float), near[u, width : 2 * width].astype(float)
        right[a] -= own
        left[a] -= own
        _without(m, a, right, left, own)
        b = _best(m, a, right, left, own, classes)
        _without(m, b, right, left, own, 1)
        moved += b != a
        of[u] = b
    return of, moved


def learn(train: DataFrame, lex: Lexicon, classes: int = CLASSES) -> np.ndarray:
    """The class of every unit, from ``train(ids)``; the end token has its own."""
    first = lex.level(FIRST)
    of = cluster(pair_counts(train, first, lex.end), classes)[first]
    if lex.size > FIRST:
        of = _leaders(train, lex, of, classes)
    if lex.size > LEADERS:
        of = _rest(train, lex, of, classes)
    return of


def _leaders(train: DataFrame, lex: Lexicon, of: np.ndarray, classes: int) -> np.ndarray:
    """Rounds of exchange of leading words and groups, until one gains nothing."""
    level, width = lex.level(LEADERS), 2 * (classes + 1) + 1
    n = int(level.max()) + 1
    inside = np.zeros(n, np.int64)
    inside[level] = of
    best, kept = -math.inf, inside
    for _ in range(ROUNDS):
        near = _gather(_summed(train, lex.end, n * width, _neighbours(level * width, inside[level], classes + 1)), n * width).reshape(n, width)
        reached = likelihood(class_moves(near, inside, classes))
        if reached <= best:
            break
        best, kept = reached, inside
        inside, moved = sweep(near, inside, classes)
        if not moved:
            break
    return kept[level]


def _rest(train: DataFrame, lex: Lexicon, of: np.ndarray, classes: int) -> np.ndarray:
    """The classes of the head's words beyond ``LEADERS``, each by one exchange
    against the class bigram counts of all others as they are."""
    m, width = moves_of(train, lex, of, classes), 2 * (classes + 1) + 1
    words = np.arange(lex.size - LEADERS)
    in_block = BLOCK // width  # units of a block, whole ones only
    start = np.full(lex.units, -1)
    start[LEADERS : lex.size] = words // in_block * BLOCK + words % in_block * width
    cells = (len(words) // in_block + 1) * BLOCK

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, found = [], []
            for k, at, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = np.zeros(BLOCK)
                block[np.frombuffer(at, "<u2")] = np.frombuffer(counts, "<i8")
                for j, near in enumerate(block[: in_block * width].reshape(in_block, width)):
                    if near.any():
                        u = LEADERS + k * in_block + j
                        a, right, left, own = int(of[u]), near[: classes + 1], near[classes + 1 : -1], near[-1]
                        right[a] -= own
                        left[a] -= own
                        others = m.copy()
                        _without(others, a, right, left, own)
                        units.append(u)
                        found.append(_best(others, a, right, left, own, classes))
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int32()), pa.array(found, pa.int32())], names=["unit", "class"])

    out = of.copy()
    with lean(train.sparkSession):
        chosen = _summed(train, lex.end, cells, _neighbours(start, of, classes + 1)).mapInArrow(choose, "unit int, class int").toArrow()
    out[chosen["unit"].to_numpy()] = chosen["class"].to_numpy()
    return out


def moves_of(train: DataFrame, lex: Lexicon, of: np.ndarray, classes: int) -> np.ndarray:
    """Class bigram counts of the whole training part."""
    return pair_counts(train, of, lex.end).astype(float)


class Model:
    """Everything but the counts of words outside the head, in tables of fixed size."""

    def __init__(self, lex: Lexicon, of: np.ndarray, moves: np.ndarray, heads: np.ndarray, others: dict[int, tuple[int, int]], ends: int, classes: int = CLASSES) -> None:
        c = classes + 1
        self.of, self.ends = of, ends
        self.move = np.log10(moves + DELTA) - np.log10(moves.sum(axis=1, keepdims=True) + DELTA * c)
        size, kinds = np.zeros(c), np.zeros(c)
        np.add.at(size, of[: lex.size], heads)
        np.add.at(kinds, of[: lex.size], 1)
        for group, (words, count) in others.items():
            kinds[of[lex.size + group]] += words
            size[of[lex.size + group]] += count
        size[classes] += ends
        kinds[classes] += ends > 0
        self.n, self.v = int(size.sum()), int(kinds.sum())
        self.class_log = np.log10(size + DELTA * (kinds + 1))
        #: By unit: what is emitted here (0 for words outside the head, which a join adds).
        self.emit = np.concatenate((np.log10(heads + DELTA), np.zeros(SUFFIXES), [math.log10(ends + DELTA)]))
        self.known = np.concatenate((np.ones(lex.size, np.int64), np.zeros(SUFFIXES, np.int64), [int(ends > 0)]))
        self.base_log = math.log10(self.n + DELTA * (self.v + 1))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; a row
    per input row, scores in log10.

    Null and empty texts are one end token. Rows are told apart by a number of their
    own, so rows without id, rows of one id and repeated rows are each scored and
    each count as often as they occur. Without training rows every token is unknown.
    Further columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = numbered(docs, id_col, text_col)
    vocabulary = materialize(word_counts(rows.where(~held_out(F.col("id")))))
    head, heads = head_of(vocabulary, HEAD)
    lex = Lexicon(head)
    lexicon = spark.sparkContext.broadcast(lex)
    encoded = materialize(encoded_rows(rows, lexicon))
    release(rows)
    train = encoded.where("not held_out")
    of = learn(train, lex, classes)
    moves = moves_of(train, lex, of, classes)
    least = int(heads[-1]) if len(heads) else None
    outside = vocabulary.where(F.lit(True) if least is None else F.col("n") < least)
    others = {r["suffix"]: (r["words"], r["count"]) for r in outside.groupBy("suffix").agg(F.count("*").alias("words"), F.sum("n").alias("count")).collect()}
    model = spark.sparkContext.broadcast(Model(lex, of, moves, heads, others, train.count(), classes))

    rare = encoded.select("row", F.explode("others").alias("o")).select("row", "o.word", F.col("o.n").alias("times"))
    count = F.coalesce("n", F.lit(0))
    rare = rare.join(outside.select("word", "n"), "word", "left").groupBy(F.col("row").alias("rare_row")).agg(F.sum(F.col("times") * F.log10(count + F.lit(DELTA))).alias("rare_log"), F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    rare = materialize(rare)
    release(vocabulary)

    names = "row long, id long, held_out boolean, n_tokens long, head_known long, base double, own double"
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("head_known", pa.int64()), ("base", pa.float64()), ("own", pa.float64())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        end = len(m.of) - 1
        for batch in batches:
            out: list[tuple] = []
            for raw in batch.column(3).to_pylist():
                units = np.concatenate(([end], np.frombuffer(raw, np.int32), [end]))
                c = m.of[units]
                said = float(m.emit[units[1:]].sum())
                n = len(units) - 1
                own = said - float(m.class_log[c[1:]].sum()) + float(m.move[c[:-1], c[1:]].sum())
                out.append((n, int(m.known[units[1:]].sum()), said - n * m.base_log, own))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[3:], strict=True)]], schema=schema)

    scored = encoded.select("row", "id", "held_out", "ids").mapInArrow(local, names)
    joined = scored.join(rare, F.col("row") == F.col("rare_row"), "left")
    return joined.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.value.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_log", F.lit(0.0))).alias("base_score"),
        (F.col("own") + F.coalesce("rare_log", F.lit(0.0))).alias("score"),
    )
