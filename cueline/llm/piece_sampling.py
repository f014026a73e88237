"""SentencePiece encoding by forward filtering and backward sampling, and its decoding.

All ways to cut a text into pieces form a lattice.  Forward filtering sums, for
each position, the weights of all paths to it; backward sampling walks from the
end and draws each piece in proportion to the weight of the paths through it.
The draws of a row come from its key alone, so a row is cut the same way
wherever and whenever it is processed.

The lattice is cut only where no piece can cross: between a word and the blanks
before the next, around other white space, and, in words of over ``UNIT``
characters, where no piece that fits the word reaches across.  Characters without a
piece of their own are spelt in bytes, and so is the blank sign itself where a
text has it; nothing is normalised, hence decoding gives back the exact text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from cueline.llm._common import col

#: Longer units are filtered one by one, with scaled sums.
UNIT = 33
#: Inverse temperature of the piece weights, and the seed that is mixed with a row's key.
ALPHA, SEED = 1.0, 42
_BLANK = "▁"
#: Characters of text that are sampled together, or one text.
TOGETHER = 400_000
#: Lengths up to which units share a lattice.
WIDTHS = (4, 7, 10, 14, 20, UNIT)


_STEP = 0x9E3779B97F4A7C15


def _uniform(seeds: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th draw of each seed (unsigned 64 bits): 53 bits, 0 to 1, by a counter that is mixed."""
    x = seeds + np.uint64((k + 1) * _STEP % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Text and weight of each piece of a SentencePiece model."""

    def __init__(self, path: str, alpha: float = ALPHA) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        scores = np.array([model.get_score(i) for i in ids])
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        # Merge models score a piece by minus its rank; a weight falls with the rank as word frequencies do.
        merges = scores.min() < -1000
        weight = {i: float(np.exp(alpha * (-np.log(2.0 - scores[i]) if merges else scores[i]))) for i in plain}
        self.weights = {model.id_to_piece(i).replace(_BLANK, " "): (i, weight[i]) for i in plain}
        self.longest = max(map(len, self.weights))
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        if len(self.bytes) < 256:
            raise ValueError("the model has no pieces for bytes")
        self.spelt = min(weight.values())
        self.table = [b""] * len(ids)
        for text, (i, _) in self.weights.items():
            self.table[i] = text.encode("utf-8")
        for value, i in self.bytes.items():
            self.table[i] = bytes([value])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "surrogatepass")


class Sampler:
    """Samples segmentations of many texts at once.

    The lattices of the distinct units of some texts are built and filtered
    together, position by position; then all units are sampled together, piece
    by piece.  What is drawn for a text depends on its key and words only.
    """

    def __init__(self, pieces: Pieces, seed: int = SEED) -> None:
        self._pieces, self._seed = pieces, seed
        # white space other than blanks parts units, unless pieces join it to other characters
        joined = {c for text in pieces.weights if len(text) > 1 for c in text if c.isspace() and c != " "}
        self._units = re.compile(r" *(?:\S%s)+| +|\s" % "".join(f"|{re.escape(c)}" for c in sorted(joined)))
        if not all(map(self._units.fullmatch, pieces.weights)):
            raise ValueError("a piece of the model reaches across units")
        prefixes: dict[str, int] = {"": 0}
        edges, final = {}, {}
        for text, (piece, _) in pieces.weights.items():
            for k in range(1, len(text) + 1):
                if text[:k] not in prefixes:
                    prefixes[text[:k]] = len(prefixes)
                    edges[(prefixes[text[: k - 1]] << 21) | ord(text[k - 1])] = prefixes[text[:k]]
            final[prefixes[text]] = piece
        self._keys = np.array(sorted(edges), np.int64)
        self._next = np.array([edges[k] for k in self._keys.tolist()], np.int64)
        self._final = np.full(len(prefixes), -1, np.int64)
        self._final[list(final)] = list(final.values())
        self._weight = np.zeros(len(pieces.table) + 1)  # the last place stands for no piece
        for piece, w in pieces.weights.values():
            self._weight[piece] = w

    def _lattice(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces by [length - 1, start, unit] (-1: none, under -1: a character spelt in bytes), and the filtered sums by [end, unit].

        Units come longest first.
        """
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        flat = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        unit = np.repeat(np.arange(len(units)), sizes)
        start = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        width = int(sizes[0])
        longest = min(width, self._pieces.longest)
        piece = np.full((longest, width, len(units)), -1, np.int32)
        state, at = np.zeros(len(flat), np.int64), np.arange(len(flat))
        for length in range(longest):
            fits = start[at] + length < sizes[unit[at]]
            at, state = at[fits], state[fits]
            key = (state << 21) | flat[at + length]
            place = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            known = self._keys[place] == key
            at, state = at[known], self._next[place[known]]
            piece[length, start[at], unit[at]] = self._final[state]
        alone = piece[0, start, unit] < 0
        piece[0, start[alone], unit[alone]] = -2 - flat[alone]
        weight = self._weight[np.maximum(piece, -1)]
        weight[0][piece[0] < -1] = self._pieces.spelt
        total = np.zeros((width + 1, len(units)))
        total[0] = 1.0
        active = np.searchsorted(-sizes, -np.arange(width + 1), side="right")  # units at least so long
        for end in range(1, width + 1):
            n = active[end]
            for length in range(1, min(end, longest) + 1):
                total[end, :n] += total[end - length, :n] * weight[length - 1, end - length, :n]
        return piece, total

    def _sampled(self, units: list[str], who: np.ndarray, unit: np.ndarray, seeds: np.ndarray, n_pieces: np.ndarray) -> Iterator[tuple]:
        """Backward sampling of occurrences ``who`` of units, last piece first: (number from the end, occurrences, pieces).

        Each piece is a draw of its own, so that no path is too rare to be drawn.
        """
        piece, total = self._lattice(units)
        end, k = np.fromiter(map(len, units), np.int64, len(units))[unit], 0
        while len(who):
            left = _uniform(seeds, k) * total[end, unit]
            chosen, taken = np.zeros(len(who), np.int32), np.zeros(len(who), np.int64)
            open_, v, e, l = np.arange(len(who)), unit, end, left
            for length in range(1, len(piece) + 1):
                begin = e - length
                own = piece[length - 1, begin, v]  # a start before the first is none of the unit's, and is masked
                w = self._weight[np.maximum(own, -1)]
                if length == 1:
                    w[own < -1] = self._pieces.spelt
                mass = total[begin, v] * w
                mass[begin < 0] = 0.0
                here = mass > 0
                # what rounding leaves over goes to the last piece there is
                o = open_[here]
                chosen[o], taken[o] = own[here], length
                stay = ~(here & (l < mass)) & (begin > 0)
                open_, v, e, l = open_[stay], v[stay], e[stay], (l - mass)[stay]
                if not len(open_):
                    break
            n_pieces[who] += 1
            yield k, who, chosen
            end, k = end - taken, k + 1
            more = end > 0
            who, unit, end, seeds = who[more], unit[more], end[more], seeds[more]

    def _fitting(self, unit: str) -> np.ndarray:
        """Pieces by [end, length - 1] of one unit of any length; as in a lattice."""
        flat = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        piece = np.full((len(flat) + 1, min(self._pieces.longest, len(flat))), -1, np.int32)
        state, at = np.zeros(len(flat), np.int64), np.arange(len(flat))
        for length in range(piece.shape[1]):
            fits = at + length < len(flat)
            at, state = at[fits], state[fits]
            key = (state << 21) | flat[at + length]
            place = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            known = self._keys[place] == key
            at, state = at[known], self._next[place[known]]
            piece[at + length + 1, length] = self._final[state]
        alone = np.flatnonzero(piece[1:, 0] < 0)
        piece[alone + 1, 0] = -2 - flat[alone]
        return piece

    def _split(self, unit: str) -> list[str]:
        """A long unit cut wherever no piece that fits it reaches across."""
        piece = self._fitting(unit)
        end, length = np.nonzero(piece != -1)
        first = np.arange(len(unit) + 1)  # where the longest piece over each place starts
        np.minimum.at(first, end, end - length - 1)
        cuts = np.flatnonzero(np.minimum.accumulate(first[::-1])[::-1][1:] == np.arange(len(unit)))
        return [unit[a:b] for a, b in zip(cuts, [*cuts[1:].tolist(), len(unit)])]

    def _long(self, unit: str, seeds: list[int]) -> list[np.ndarray]:
        """Pieces of a unit of any length, last first, for each of some seeds; the sums are scaled at each place."""
        piece = self._fitting(unit)
        n, longest = len(unit), piece.shape[1]
        share = np.empty((n + 1, longest))
        window = np.zeros(longest)  # sums of the places before, the nearest first
        window[0] = 1.0
        for end in range(1, n + 1):
            own = self._weight[np.maximum(piece[end], -1)]
            if piece[end, 0] < -1:
                own[0] = self._pieces.spelt
            np.cumsum(window * own, out=share[end])
            total = share[end, -1]
            window[1:] = window[:-1] / total
            window[0] = 1.0
        out = []
        for seed in seeds:
            u = np.random.Generator(np.random.PCG64(seed)).random(n)
            end, chosen = n, []
            while end:
                length = int(np.searchsorted(share[end], u[len(chosen)] * share[end, -1], side="right"))
                chosen.append(piece[end, length])
                end -= length + 1
            out.append(np.array(chosen, np.int64))
        return out

    def _some(self, texts: list[str], keys: list) -> list[np.ndarray]:
        number: dict[str, int] = {}
        units, counts, draws = [], [], []
        split: dict[str, list[str]] = {}
        for text, key in zip(texts, keys):
            own = self._units.findall(text)
            if max(map(len, own), default=0) > UNIT:
                for u in own:
                    if len(u) > UNIT and u not in split:
                        split[u] = self._split(u)
                own = [part for u in own for part in (split[u] if len(u) > UNIT else (u,))]
            counts.append(len(own))
            units.extend([number.setdefault(u, len(number)) for u in own])
            row = xxhash.xxh64_intdigest(f"{self._seed}:{key}".encode())
            draws.append(np.random.Generator(np.random.PCG64(row)).integers(0, 1 << 64, len(own), np.uint64))
        if not units:
            return [np.zeros(0, np.int32) for _ in texts]
        names = sorted(number, key=len, reverse=True)
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        place = np.empty(len(names), np.int64)
        place[[number[name] for name in names]] = np.arange(len(names))
        unit, u = place[np.array(units)], np.concatenate(draws)
        steps, n_pieces = [], np.zeros(len(unit), np.int64)
        # units of like length share a lattice, whose size is their number times the square of the longest
        for shortest, longest in zip((1, *(w + 1 for w in WIDTHS)), WIDTHS):
            a, b = np.searchsorted(-sizes, [-longest, 1 - shortest])
            if a < b:
                who = np.flatnonzero((unit >= a) & (unit < b))
                steps.extend(self._sampled(names[a:b], who, unit[who] - a, u[who], n_pieces))
        far = np.flatnonzero(sizes[unit] > UNIT)
        far = far[np.argsort(unit[far], kind="stable")]
        for some in np.split(far, np.flatnonzero(np.diff(unit[far])) + 1) if len(far) else ():
            for i, chosen in zip(some.tolist(), self._long(names[unit[some[0]]], u[some].tolist())):
                n_pieces[i] = len(chosen)
                steps.append((np.arange(len(chosen)), i, chosen))
        last = np.cumsum(n_pieces)
        ids = np.empty(int(last[-1]), np.int64)
        for k, who, chosen in steps:
            ids[last[who] - 1 - k] = chosen
        ends = np.concatenate(([0], last))[np.cumsum(counts)]
        spelt = np.flatnonzero(ids < -1)
        if len(spelt):
            codes = [[self._pieces.bytes[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in (-2 - ids[spelt]).tolist()]
            repeat = np.ones(len(ids), np.int64)
            repeat[spelt] = list(map(len, codes))
            new = np.cumsum(repeat)
            ends = np.concatenate(([0], new))[ends]
            ids = np.repeat(ids, repeat)
            ids[ids < -1] = [b for c in codes for b in c]
        return np.split(ids.astype(np.int32), ends[:-1])

    def encode(self, texts: list[str | None], keys: list) -> list[np.ndarray]:
        """Ids of one sampled segmentation of each text, determined by the seed, its key and itself."""
        return [ids for a, b in together(list(map(len, (t or "" for t in texts)))) for ids in self._some([t or "" for t in texts[a:b]], keys[a:b])]


def together(sizes: list[int], most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` characters, or of one row."""
    start = size = 0
    for k, n in enumerate(sizes):
        if k > start and size + n > most:
            yield start, k
            start, size = k, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, seed: int = SEED, alpha: float = ALPHA, name: str = "piece_ids") -> DataFrame:
    """Add one sampled segmentation of each whole text as an array of piece ids.

    A null or empty text has no pieces.  Rows of one key and text, repeated ones
    among them, are cut alike; null keys count as one key.  Other columns stay,
    whatever their names; one of the added name is replaced.  A text of any length
    is one lattice, filtered over a window of the longest piece.  An empty table
    gives an empty table.
    """
    path = path or default_path()
    rest = [f for f in docs.schema.fields if f.name.lower() != name.lower()]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(Pieces(path, alpha), seed)
        for batch in batches:
            sizes = [len(t.as_py() or "") for t in batch.column(1)]
            for a, b in together(sizes, TOGETHER):  # a batch's pieces are handed on bit by bit
                some = batch.slice(a, b - a)
                ids = sampler.encode(some.column(1).to_pylist(), some.column(0).to_pylist())
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*some.columns[2:], made], names=names)

    # columns go by plain names on the way, for theirs may hold dots
    names = [f"c{k}" for k in range(len(rest) + 1)]
    kinds = StructType([*(StructField(n, f.dataType, f.nullable) for n, f in zip(names, rest)), StructField(names[-1], ArrayType(IntegerType()))])
    given = docs.select(F.coalesce(col(key).cast("string"), F.lit("")).alias("key"), col(text).alias("text"), *[col(f.name).alias(n) for n, f in zip(names, rest)])
    return given.mapInArrow(of, kinds).toDF(*(f.name for f in rest), name)


def decode(ids: Column, path: str | None = None) -> Column:
    """The exact text of an array of piece ids."""
    path = path or default_path()

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = Pieces(path)
        for batch in batches:
            yield pd.Series([None if i is None else pieces.decode(np.asarray(i).tolist()) for i in batch], dtype=object)

    return of(ids)
