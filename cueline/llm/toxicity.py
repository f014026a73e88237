"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms: lower-case words and their first
letters, each once more where it occurs at least twice, and again where at
least three times, so that one chance match of a stem and several of them are
told apart.  Over all terms that stand in a few documents of the training sample
a second-order factorization machine learns a weight for each term and, through
factor vectors, one for each pair, such as an insult and the group it names,
which single weights would miss.  No term needs to go with the label by itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.llm._common import MEMO, TOGETHER, checkpoint, col, slices

#: Bound on the labelled rows that the model is fitted on.
LABELLED_ROWS = 20_000
#: Bound on the terms of these rows together, four bytes each: of long texts fewer rows are sampled, but each whole.
LABELLED_TERMS = 1 << 25
#: Parts in which these rows come to the driver.
SAMPLE_PARTS = 16
BUCKETS = 1 << 20
#: A term has a weight and factors if so many documents of the sample hold it.
LEAST_DOCUMENTS = 3
#: Terms of this chi-squared statistic with the label are fitted first, alone; then all terms are.
STRONG = 20.0
#: The other terms learn slowly, the more so the fewer documents hold them: their steps are damped by so much a document.
DAMPING = 0.1
PREFIXES = (4, 5)
#: A bucket stands for so many terms: its first, second and third occurrence in a text.
LEVELS = 3
FACTORS = 8
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str | None) -> Counter[str]:
    """How often each lower-case word occurs in a whole text."""
    return Counter(_WORD.findall((text or "").lower()))


def buckets_of(word: str) -> list[int]:
    """Buckets of a word and of its prefixes."""
    names = [word, *(f"{word[:k]}~" for k in PREFIXES if len(word) > k)]
    return [xxhash.xxh32_intdigest(n.encode("utf-8", "surrogatepass")) % BUCKETS for n in names]


def levels(counts: Counter[int]) -> Iterator[int]:
    """Terms of counted buckets."""
    for bucket, n in counts.items():
        yield from range(LEVELS * bucket, LEVELS * bucket + min(n, LEVELS))


@dataclass
class Model:
    """Kept terms, bias, weights, and factors (term x factor)."""

    kept: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def _sigmoid(x: float | np.ndarray) -> float | np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _association(rows: list[np.ndarray], labels: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many documents each term is, and its chi-squared statistic with the label."""
    total, ones = len(labels), labels.sum()
    n, pos = np.zeros(n_terms), np.zeros(n_terms)
    for terms, label in zip(rows, labels):  # a document's terms are distinct
        n[terms] += 1
        pos[terms] += label
    spread = n * (total - n) * ones * (total - ones)
    return n, np.divide(total * (total * pos - n * ones) ** 2, spread, out=np.zeros(n_terms), where=spread > 0)


def fit_machine(rows: list, labels: np.ndarray, n_terms: int, epochs: int = 30, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by mini-batch AdaGrad on the logistic loss.

    Two thirds of the epochs fit the terms that go with the label by themselves,
    the last third all terms, so that a pair is learned from what its terms alone
    don't tell and many rare terms don't learn the sample by heart.
    """
    rng = np.random.default_rng(seed)
    rows = [np.asarray(r, np.int32) for r in rows]  # no copies of what is of that kind
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    n, chi = _association(rows, labels, n_terms)
    strong = chi >= STRONG
    bias = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    w, v = np.zeros(n_terms, np.float32), rng.normal(0, 0.05, (n_terms, FACTORS)).astype(np.float32)
    v[~strong] *= 0.2
    damping = np.where(strong, 1e-8, DAMPING / np.maximum(n, 1)).astype(np.float32)
    seen_w, seen_v, seen_b = damping.copy(), np.repeat(damping[:, None], FACTORS, axis=1), 1e-8
    order = rng.permutation(len(rows))

    def batches(chosen: np.ndarray) -> list[tuple]:
        """Rows, distinct terms, occurrences of each, and their places among the rows, by term."""
        out = []
        for at in range(0, len(order), 256):
            some = order[at : at + 256]
            terms = np.concatenate([rows[i] for i in some])
            owner = np.repeat(np.arange(len(some)), sizes[some]).astype(np.uint8)[chosen[terms]]
            terms = terms[chosen[terms]]
            own, times = np.unique(terms, return_counts=True)
            out.append((some, own, times.astype(np.int16), owner[np.argsort(terms, kind="stable")]))
        return out

    first = 2 * epochs // 3 if strong.any() else 0
    made = batches(strong) if first else []
    for epoch in range(epochs):
        if epoch == first:
            made = batches(np.ones(n_terms, bool))
        for k in rng.permutation(len(made)):
            some, own, times, owner = made[k]
            at = np.repeat(np.arange(len(own)), times)
            each = v[own][at]
            sums = np.stack([np.bincount(owner, each[:, f], len(some)) for f in range(FACTORS)], axis=1)
            squares = np.bincount(owner, (each**2).sum(axis=1), len(some))
            guess = bias + np.bincount(owner, w[own][at], len(some)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = (_sigmoid(guess) - labels[some]) / len(some)
            seen_b += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(seen_b)
            if not len(own):
                continue
            starts = np.cumsum(times, dtype=np.int64) - times
            grad_w = np.add.reduceat(error[owner], starts) + decay * w[own]
            grad_v = np.add.reduceat(error[owner][:, None] * (sums[owner] - each), starts, axis=0) + decay * v[own]
            seen_w[own] += grad_w**2
            seen_v[own] += grad_v**2
            w[own] -= rate * grad_w / np.sqrt(seen_w[own])
            v[own] -= 0.2 * rate * grad_v / np.sqrt(seen_v[own])
    return bias, w, v


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents, chosen by a hash of their doc_id."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # at most ``rows`` pairs of numbers
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")


def sampled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(text, y) of these documents."""
    return labelled(docs, labels, label, rows).select("text", "y")


def bounded(sample: DataFrame, terms: int) -> DataFrame:
    """The first documents of a sample, in the order of the hash of their doc_id, that have at most so many terms together."""
    order = ["h", "doc_id"]
    sizes = sample.groupBy("doc_id").agg(F.sum(F.length("terms") / 4).alias("n")).select(F.xxhash64("doc_id").alias("h"), "doc_id", "n")
    so_far = 0
    for r in sizes.orderBy(*order).collect():  # at most LABELLED_ROWS numbers
        so_far += r["n"]
        if so_far > terms:
            h = F.xxhash64("doc_id")
            return sample.where((h < r["h"]) | (h == r["h"]) & (F.col("doc_id") < r["doc_id"]))
    return sample


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All terms of each text, sorted, as 32-bit numbers."""
    memo: dict[str, list[int]] = {}
    for doc_id, texts, y in (some for batch in batches for some in slices(*map(batch.column, ("doc_id", "text", "y")))):
        found = []
        for text in texts.to_pylist():
            if len(memo) > MEMO:
                memo.clear()
            counts = Counter()
            for word, n in words_in(text).items():
                buckets = memo.get(word)
                if buckets is None:
                    buckets = memo[word] = buckets_of(word)
                for b in buckets:
                    counts[b] += n
            found.append(np.array(sorted(levels(counts)), "<i4").tobytes())
        yield pa.RecordBatch.from_arrays([doc_id, pa.array(found, pa.binary()), y], names=["doc_id", "terms", "y"])


def gathered(rows: Iterable, terms: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The terms of rows (terms, y) of at most ``terms`` terms together, and their labels, ordered by both.

    The terms lie in one array, of which only the part in use takes memory and
    which is given back whole; thousands of small ones leave the driver's heap in pieces.
    """
    flat, ends, y = np.empty(terms, "<i4"), [0], []
    for r in rows:
        row = np.frombuffer(r["terms"], "<i4")
        ends.append(ends[-1] + len(row))
        flat[ends[-2] : ends[-1]] = row
        y.append(float(r["y"]))
    found = [flat[a:b] for a, b in zip(ends, ends[1:])]

    def compared(i: int, j: int) -> int:
        a, b = (found[i].tobytes(), y[i]), (found[j].tobytes(), y[j])
        return (a > b) - (a < b)

    order = sorted(range(len(found)), key=cmp_to_key(compared))
    return [found[k] for k in order], np.array([y[k] for k in order])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = LABELLED_ROWS, terms: int = LABELLED_TERMS) -> Model:
    """Fit on at most ``rows`` of the labelled documents, of at most ``terms`` terms together; labels hold doc_id and ``label`` (0 or 1).

    Null labels are left out and repeated ones count once.  Without labels, or
    with labels of one kind only, every text scores the share of ones.
    """
    # bounded in rows and in bytes: arrays of distinct terms; in a stated order, so that the fit can be repeated.
    # The texts are scanned once for them; the driver keeps terms, not texts.
    # They come a part at a time, and each is kept once.
    sample = labelled(docs, labels, label, rows)
    chosen = checkpoint(sample.mapInArrow(_terms, f"doc_id {dict(sample.dtypes)['doc_id']}, terms binary, y int").repartition(SAMPLE_PARTS))
    found, y = gathered(bounded(chosen, terms).select("terms", "y").toLocalIterator(), terms)
    total, ones = len(y), y.sum()
    held = np.zeros(LEVELS * BUCKETS, np.int32)
    for row in found:
        held[row] += 1
    kept = np.flatnonzero(held >= LEAST_DOCUMENTS)
    if not len(kept) or ones in (0, total):
        share = (ones + 0.5) / (total + 1)
        return Model(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))
    place = np.full(len(held), -1, np.int32)
    place[kept] = np.arange(len(kept))
    for k, row in enumerate(found):
        left = place[row]
        left = left[left >= 0]
        row[: len(left)] = left  # in its place, which is one array's
        found[k] = row[: len(left)]
    del held, place
    bias, w, v = fit_machine(found, y, len(kept))
    return Model(kept, bias, w, v)


class _Places(dict):
    """Numbers distinct words; a word none of whose buckets is kept is 0."""

    def __init__(self, row: dict[int, int]) -> None:
        self._row, self.rows = row, np.zeros((1024, 1 + len(PREFIXES)), np.int32)
        self.clear()

    def clear(self) -> None:
        super().clear()
        self._n = 0

    def __missing__(self, word: str) -> int:
        found = [r for r in map(self._row.get, buckets_of(word)) if r]
        if found:
            self._n += 1
            if self._n == len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            self.rows[self._n] = 0
            self.rows[self._n, : len(found)] = found
        self[word] = number = self._n if found else 0
        return number


class Scorer:
    """Scores many texts at once.

    A bucket that occurs n times brings the terms of its first n occurrences, so
    the sums that the machine needs of it (weights, factors, squared factors) are
    kept ready for each n.
    """

    def __init__(self, model: Model) -> None:
        buckets = np.unique(model.kept // LEVELS)
        self._bias = model.bias
        self._sums = np.zeros((len(buckets) + 1, LEVELS, 2 + FACTORS))
        row = 1 + np.searchsorted(buckets, model.kept // LEVELS)
        own = np.column_stack((model.weights, (np.asarray(model.factors, float) ** 2).sum(axis=1), model.factors))
        self._sums[row, model.kept % LEVELS] = own
        self._sums = self._sums.cumsum(axis=1)
        self._places = _Places({int(b): k for k, b in enumerate(buckets, 1)})

    def __call__(self, texts: list[str | None], together: int = TOGETHER) -> np.ndarray:
        parts = [self._some(texts[at : at + together]) for at in range(0, len(texts), together)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _some(self, texts: list[str | None]) -> np.ndarray:
        places, numbers, times, sizes = self._places, [], [], []
        if len(places) > MEMO:
            places.clear()
        for text in texts:
            counts = words_in(text)
            numbers.extend(map(places.__getitem__, counts))
            times.extend(counts.values())
            sizes.append(len(counts))
        number = np.array(numbers, np.int64)
        known = number > 0
        row = places.rows[number[known]]
        owner = np.repeat(np.repeat(np.arange(len(texts)), sizes)[known], row.shape[1])
        n = np.repeat(np.array(times, np.int64)[known], row.shape[1])
        row = row.ravel()
        key, at = np.unique((owner * len(self._sums) + row)[row > 0], return_inverse=True)
        occurs = np.bincount(at, n[row > 0], len(key)).astype(np.int64)
        found = self._sums[key % len(self._sums), np.minimum(occurs, LEVELS) - 1]
        # summed text by text, in the order of its terms: a score doesn't depend on the texts beside it
        of = key // len(self._sums)
        total = np.column_stack([np.bincount(of, column, len(texts)) for column in found.T])
        return _sigmoid(self._bias + total[:, 0] + 0.5 * ((total[:, 2:] ** 2).sum(axis=1) - total[:, 1]))


def score(model: Model, text: Column) -> Column:
    """The score of each whole text, 0 to 1; null and empty texts, and those without any known term, score the model's bias."""

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer(texts.to_pylist()) for texts, in slices(batch)]
            yield pa.array(np.concatenate([np.zeros(0), *found]), pa.float64())

    return of(text)


def with_toxicity(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Add score and predicted (1 where score >= threshold) to whole documents; all rows and other columns stay.

    Input: ``doc_id``, ``text``, and further columns of any names; score and
    predicted are replaced.  Null and empty texts score the bias.  A text of any
    length is read whole; how long it is counts only through its distinct terms.
    Rows are scored by themselves, so repeated ones get equal scores, and null
    doc_ids are scored too, but never learned from.  An empty table gives an empty
    table.
    """
    model = fit(docs, labels, rows=rows)
    return docs.withColumn("score", score(model, col("text"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
