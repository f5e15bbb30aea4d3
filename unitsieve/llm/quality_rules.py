"""Quality rules under weak supervision.

A rule votes bad (-1), good (1) or abstains (0) on a document; each votes one way
only. How far a vote can be trusted is not given: expectation-maximisation over
the counts of vote patterns of the whole corpus estimates each rule's accuracy
(how often its vote is right), and a document's posterior probability of being
good replaces "all rules must pass". Patterns are at most 2 ** rules, so their counts are a bounded table
whatever the corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words_of
from .html_extract import STOP_WORDS

BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rules and the way each votes.
RULES = {"symbols": -1, "pipes": -1, "repeats": -1, "dup_lines": -1, "capitals": -1, "shouting": -1, "word_length": -1, "variety": -1, "no_stops": -1, "stop_words": 1, "sentences": 1, "letters": 1}
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Documents judged good by at least this posterior are kept.
THRESHOLD = 0.5

_STOP = frozenset(w.encode() for w in STOP_WORDS)
_SYMBOLS = "#*$%&|<>"
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LINE_END = (b".", b"!", b"?", b":", b'"', b")", "…".encode(), "”".encode(), "。".encode())


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` words that occur twice or more in the text."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, n)
    if len(ids) == n:
        return 0
    key = np.zeros(n - width + 1, np.uint64)
    if len(ids) < 6000:  # five ids below 6000 fit 64 bits: exact
        for j in range(width):
            key = key * np.uint64(6000) + at[j : n - width + 1 + j]
    else:
        wide = np.stack([at[j : n - width + 1 + j] for j in range(width)], axis=1)
        key = np.unique(wide, axis=0, return_inverse=True)[1].reshape(-1).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(key), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover[:n]) > 0).sum())


def measure(text: str | None) -> tuple[list[int], list[int]]:
    """The five base numbers and the votes of ``RULES`` on a text."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    glued = b"".join(words).decode()
    symbols = sum(glued.count(c) for c in _SYMBOLS)
    seen: set[str] = set()
    lines = dup = ended = 0
    for line in text.split("\n"):
        bare = line.encode().strip()
        if bare:
            lines += 1
            ended += bare.endswith(_LINE_END)
            if line in seen:
                dup += 1
            seen.add(line)
    repeat = repeated_words(words)
    base = [n, len(glued), symbols, dup, repeat]
    if not n:
        return base, [0] * len(RULES)
    upper = len(_UPPER.findall(glued))
    letters = sum(map(str.isalpha, glued))
    stop = sum(w.strip(b".,;:!?\"'()") in _STOP for w in (text.lower().encode().split()))
    shout = sum(w.endswith(b"!!") for w in words)
    kinds = len(set(words))
    mean = len(glued) / n
    enough = n >= MIN_WORDS
    return base, [
        -(symbols > 0.15 * n),
        -(glued.count("|") > 0.15 * n),
        -(enough and repeat > 0.2 * n),
        -(lines >= 4 and dup > 0.4 * lines),
        -(enough and upper > 0.5 * letters),
        -(enough and shout > 0.2 * n),
        -(not 2.5 <= mean <= 14),
        -(n >= 30 and kinds < min(0.2 * n, 40)),
        -(n >= 30 and stop < 0.02 * n),
        int(enough and stop >= 0.1 * n),
        int(2 * ended > lines),
        int(letters >= 0.9 * len(glued)),
    ]


def fit(patterns: list[tuple[tuple[int, ...], int]], weight: float = 20.0, rounds: int = 300) -> dict:
    """Expectation-maximisation of the accuracies of ``RULES``.

    For each rule: how often it votes where its vote is right, and where it is
    wrong; and the share of good documents. Estimates are smoothed by ``weight``
    imagined documents. A vote stays at least as strong as odds of three to one, so
    no rule is turned around. No patterns: the imagined documents decide.
    """
    ways = np.array(list(RULES.values()), float)
    hit, miss = np.where(ways > 0, 0.8, 0.3), np.where(ways > 0, 0.2, 0.01)
    first = hit.copy(), miss.copy()
    share = 0.8
    patterns = sorted(patterns)
    cast = (np.array([p for p, _ in patterns], float).reshape(-1, len(ways)) != 0).astype(float)
    count = np.array([c for _, c in patterns], float)
    for _ in range(rounds if patterns else 0):
        prior, votes, silence = _weights(hit, miss, share)
        q = 1 / (1 + np.exp(-(prior + cast @ votes + (1 - cast) @ silence)))
        good, bad = count * q, count * (1 - q)
        yes, no = np.where(ways > 0, cast.T @ good, cast.T @ bad), np.where(ways > 0, cast.T @ bad, cast.T @ good)
        n_yes, n_no = np.where(ways > 0, good.sum(), bad.sum()), np.where(ways > 0, bad.sum(), good.sum())
        new_hit = (yes + weight * first[0]) / (n_yes + weight)
        miss = np.minimum((no + weight * first[1]) / (n_no + weight), 0.9)
        new_hit = np.clip(np.maximum(new_hit, 3 * miss / (1 + 2 * miss)), 1e-6, 1 - 1e-6)
        moved, hit = np.abs(new_hit - hit).max(), new_hit
        share = float((good.sum() + weight * 0.8) / (count.sum() + weight))
        if moved < 1e-9:
            break
    return {"share": share, "hit": hit.tolist(), "miss": miss.tolist()}


def _weights(hit: np.ndarray, miss: np.ndarray, share: float) -> tuple[float, np.ndarray, np.ndarray]:
    ways = np.array(list(RULES.values()), float)
    return math.log(share / (1 - share)), ways * np.log(hit / miss), ways * np.log((1 - hit) / (1 - miss))


def log_odds(model: dict) -> tuple[float, list[tuple[float, float]]]:
    """The prior's log odds and, per rule, what a vote and an abstention add."""
    prior, votes, silence = _weights(np.array(model["hit"]), np.array(model["miss"]), model["share"])
    return prior, list(zip(votes.tolist(), silence.tolist(), strict=True))


def posterior(model: dict, votes: Column) -> Column:
    """The probability of good as an expression over an array of votes."""
    prior, weights = log_odds(model)
    z = reduce(lambda a, x: a + x, [F.when(votes[i] != 0, F.lit(w)).otherwise(F.lit(s)) for i, (w, s) in enumerate(weights)], F.lit(prior))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def measured(docs: DataFrame, text_col: str = "text") -> Column:
    """A struct of the base numbers and the votes, computed from whole texts."""

    @F.pandas_udf("struct<base:array<bigint>,votes:array<tinyint>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in parts:
            both = [measure(t) for t in series]
            yield pd.DataFrame({"base": [b for b, _ in both], "votes": [v for _, v in both]})

    return run(F.col(text_col).cast("string"))


def estimate(votes: DataFrame) -> dict:
    """The model of a table with a column ``votes``. The patterns brought to the
    driver are at most 2 ** len(RULES)."""
    rows = votes.groupBy("votes").count().collect()
    return fit([(tuple(r["votes"]), r["count"]) for r in rows])


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the base numbers, ``base_failed``, ``quality`` and ``kept``; a row
    per input row.

    Null and empty texts have no words and fail the base. Repeated rows count as
    often as they occur; an empty table gives an empty result; further columns of
    ``docs`` are ignored.
    """
    seen = materialize(docs.select(F.col(id_col).alias("id"), measured(docs, text_col).alias("m")).select("id", "m.base", "m.votes"))
    model = estimate(seen)
    out = seen.select(F.col("id").alias(id_col), *[F.col("base")[i].alias(c) for i, c in enumerate(BASE_COLUMNS)], posterior(model, F.col("votes")).alias("quality"))
    out = out.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= THRESHOLD))


def drop_low_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with their columns as they are.

    Texts are measured once, and the measures written with the rows. Null, empty and
    short texts go; repeated rows fare alike; an empty table gives an empty result."""
    held = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), measured(docs, text_col).alias("m")))
    model = estimate(held.select("m.votes"))
    good = ~base_failed(F.col("m.base")[0], F.col("m.base")[4]) & (posterior(model, F.col("m.votes")) >= THRESHOLD)
    return held.where(good).select("row.*")
