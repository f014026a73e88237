"""Greedy groups of consecutive rows, each of which begins where the one before ends.

Where a group ends depends on where it began, so the rows of a key are passed
once, in order.  Rows are exchanged by the key and sorted; a task holds one batch
and the state of the group that is open, however many rows a key has.  Ends are
found by search in prefix sums, so time is linear in the rows; other columns pass
untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

#: (lengths, flags, open length, g) -> (numbers of the groups, open length, g) of one key's rows in a batch.
#: The open length is ``none`` where no group is open.
Step = Callable[[np.ndarray, np.ndarray, int, int], tuple[np.ndarray, int, int]]


def _grouped(rows: DataFrame, key: str, order: list[str], length: str, flag: str | None, step: Step, none: int, name: str) -> DataFrame:
    kind = StructType([*rows.schema.fields, StructField(name, LongType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held, g = None, none, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            n = batch.column(length).to_numpy(zero_copy_only=False).astype(np.int64)
            flags = batch.column(flag).to_numpy(zero_copy_only=False).astype(bool) if flag else np.zeros(len(n), bool)
            coded = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.flatnonzero(np.diff(coded)) + 1, [len(n)]))
            numbers = np.empty(len(n), np.int64)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if before is None or keys[a] != before:
                    before, held, g = keys[a], none, 0
                numbers[a:b], held, g = step(n[a:b], flags[a:b], held, g)
            before = keys[len(n) - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], names=[*batch.schema.names, name])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(of, kind)


def cut_after(rows: DataFrame, key: str, order: list[str], length: str, ends: str, least: int, name: str = "g") -> DataFrame:
    """Number groups that end with the first row that is flagged and makes them at least ``least`` long, or with the last.

    A group's length is that of its rows joined by one blank; rows before the first that isn't empty add nothing.
    """

    def step(n: np.ndarray, flags: np.ndarray, held: int, g: int) -> tuple[np.ndarray, int, int]:
        total, at, out, i = np.cumsum(n + 1), np.flatnonzero(flags), np.empty(len(n), np.int64), 0
        filled = np.flatnonzero(n)
        while i < len(n):
            if held:
                need, first, base = least - held, i, (total[i - 1] if i else 0)
            else:
                k = np.searchsorted(filled, i)
                first = int(filled[k]) if k < len(filled) else len(n)
                base = (total[first - 1] if first else 0) + 1
                need = least
                if least <= 0:
                    first = i
            enough = max(first, int(np.searchsorted(total, need + base))) if need > 0 else first
            k = np.searchsorted(at, enough)
            end = int(at[k]) + 1 if k < len(at) else len(n)
            out[i:end] = g
            if k < len(at):
                held, g = 0, g + 1
            else:
                some = filled[np.searchsorted(filled, i) :]
                if held:
                    held += int(total[-1] - base)
                elif len(some):
                    held = int(total[-1] - (total[some[0] - 1] if some[0] else 0)) - 1
            i = end
        return out, held, g

    return _grouped(rows, key, order, length, ends, step, 0, name)


def fill_up(rows: DataFrame, key: str, order: list[str], length: str, most: int, name: str = "g") -> DataFrame:
    """Number groups that take in rows as long as they are no longer than ``most`` together; a longer row is one by itself."""

    def step(n: np.ndarray, flags: np.ndarray, held: int, g: int) -> tuple[np.ndarray, int, int]:
        total, out, i = np.cumsum(n), np.empty(len(n), np.int64), 0
        while i < len(n):
            base, used = (total[i - 1] if i else 0), max(held, 0)
            end = int(np.searchsorted(total, base + most - used, "right"))
            if end <= i:
                if held >= 0:  # the open group is full
                    held, g = -1, g + 1
                    continue
                end = i + 1
            out[i:end] = g
            held = used + int(total[end - 1] - base)
            if end < len(n):
                held, g = -1, g + 1
            i = end
        return out, held, g

    return _grouped(rows, key, order, length, None, step, -1, name)
