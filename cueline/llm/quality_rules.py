"""Quality rules with repetition found by suffix arrays.

The suffixes of a document's words are sorted by prefix doubling.  The longest
common prefixes of neighbours in that order give, for each position, the
deepest interval it lies in: the longest substring that starts there and occurs
elsewhere in the document too.  The spans of these maximal repeats are united;
a document fails if they cover too much of it or if one of them is too long.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.llm._common import col, columns, spare


#: Shortest repeat that counts (words), the share of words such repeats may cover, and the longest one allowed.
LEAST_REPEAT, MOST_COVERED, LONGEST_REPEAT = 10, 0.2, 100
LEAST_WORDS, GRAM, MOST_REPEATED = 10, 5, 20
#: Doublings whose ranks are kept, for texts whose repeats are shorter than two to this power; the memory for longer ones stays the same.
LEVELS = 8
_BLANK = re.compile(r"[\x20\x09-\x0D]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")


def _common_prefixes(ids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest common prefixes of neighbours in suffix order, in the order of the text: each is at most one shorter than the last."""
    n, words = len(ids), ids.tolist()
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out, length = np.zeros(n, np.int64), 0
    for i, j in enumerate(before.tolist()):
        if j < 0:
            length = 0
            continue
        most = n - max(i, j)
        while length < most and words[i + length] == words[j + length]:
            length += 1
        out[i] = length
        length = max(length - 1, 0)
    return out[order[1:]]


def longest_repeats(ids: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring from there that occurs elsewhere too."""
    n = len(ids)
    if n < 2:
        return np.zeros(n, np.int64)
    rank, levels, width = np.unique(ids, return_inverse=True)[1].astype(np.int64), [], 1
    while True:
        if len(levels) < LEVELS:
            levels.append(rank)
        follow = np.zeros(n, np.int64)
        follow[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        width *= 2
    # longest common prefixes of neighbours in suffix order: from the widest level down, or one after another
    a, b = order[:-1], order[1:]
    if width >= 1 << LEVELS:
        common = _common_prefixes(ids, order)
        levels = []
    else:
        common = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        at, bt = a + common, b + common
        inside = (at < n) & (bt < n)
        same = np.zeros(n - 1, bool)
        same[inside] = levels[level][at[inside]] == levels[level][bt[inside]]
        common[same] += 1 << level
    out = np.zeros(n, np.int64)
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def _covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> int:
    """Positions that the spans cover together."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeat_covered, longest_repeat."""
    text = text or ""
    words = [w for w in _BLANK.split(text) if w]
    n = len(words)
    lines = Counter(text.split("\n"))
    dup_lines = sum(c - 1 for line, c in lines.items() if c > 1 and _BLANK.sub("", line))
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    longest = longest_repeats(ids)
    five = np.flatnonzero(longest >= GRAM)
    long = np.flatnonzero(longest >= LEAST_REPEAT)
    return (
        n, sum(map(len, words)), len(_SYMBOLS.findall(text)), dup_lines,
        _covered(five, GRAM, n) if len(five) else 0, _covered(long, longest[long], n) if len(long) else 0,
        int(longest.max(initial=0)),
    )


def with_rules(docs: DataFrame, text: str = "text", most_covered: float = MOST_COVERED, longest_repeat: int = LONGEST_REPEAT) -> DataFrame:
    """Add the measures and verdicts of each whole text; other columns are kept unless they share a name.

    Input: a text column; further columns may have any names.  Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    repeat_covered (words), longest_repeat (words), base_failed and kept.  A
    null or empty text has no words and fails the base rule.  Rows never
    influence each other, so repeated rows give repeated rows.  Equal repeats tie
    to the same span.  A text of any length is read whole; the memory for it is a
    fixed number of arrays, each as long as the text has words.  An empty table
    gives an empty table.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_covered", "longest_repeat"]

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=names, dtype="int64")

    measured_, = spare(docs, "measured")
    rest = columns(docs, {*names, "base_failed", "kept"})
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    within = (F.col("repeat_covered") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= longest_repeat)
    return (
        docs.withColumn(measured_, of(col(text))).select(*rest, *[F.col(measured_)[n].alias(n) for n in names])
        .withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & within)
    )
