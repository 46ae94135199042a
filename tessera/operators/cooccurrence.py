"""How often columns (samples, draws) meet in the rows of a sparse table: the product of the table with itself, in parts.

Each key's columns are brought together once, in a list no longer than the number of columns. A task multiplies its keys
into partial sums by pair of columns, and only these are shuffled and added up: no row is made for a key and a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs multiplied at a time; cells of a task's partial product, which is a square array up to that size and lists of cells, handed on when as many are held, beyond.
PAIRS, CELLS = 1 << 21, 1 << 23


class Product:
    """A task's partial product."""

    def __init__(self, valued: bool):
        self.valued, self.names, self.number = valued, [], {}
        self.side, self.square = 64, [np.zeros(64 * 64, np.int64) for _ in range(1 + valued)]
        self.code, self.cells = np.zeros(0, np.int64), [np.zeros(0, np.int64) for _ in range(1 + valued)]

    def numbers(self, labels: pa.Array) -> np.ndarray:
        coded = labels.dictionary_encode()
        names = coded.dictionary.to_pylist()
        for n in names:
            if n not in self.number:
                self.number[n] = len(self.names)
                self.names.append(n)
        return np.array([self.number[n] for n in names], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]

    def add(self, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> None:
        if self.side and len(self.names) > self.side:
            self.widen()
        parts = [None, value][: 1 + self.valued]
        if self.side:
            for square, v in zip(self.square, parts):
                if v is None:
                    square += np.bincount(a * self.side + b, minlength=len(square))
                else:
                    np.add.at(square, a * self.side + b, v)
            return
        code, at = np.unique(np.concatenate([self.code, a << 32 | b]), return_inverse=True)
        for k, v in enumerate(parts):
            total = np.zeros(len(code), np.int64)
            np.add.at(total, at, np.concatenate([self.cells[k], np.ones(len(a), np.int64) if v is None else v]))
            self.cells[k] = total
        self.code = code

    def widen(self) -> None:
        side = self.side
        while side < len(self.names):
            side *= 2
        if side * side * len(self.square) > CELLS:
            self.code, self.cells = self.held()
            self.side, self.square = 0, []
            return
        for k, old in enumerate(self.square):
            new = np.zeros((side, side), np.int64)
            new[: self.side, : self.side] = old.reshape(self.side, self.side)
            self.square[k] = new.ravel()
        self.side = side

    def held(self) -> tuple[np.ndarray, list[np.ndarray]]:
        if not self.side:
            return self.code, self.cells
        at = np.flatnonzero(self.square[0])
        return (at // self.side) << 32 | at % self.side, [s[at] for s in self.square]

    def batches(self, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
        """The cells held, which are forgotten."""
        code, cells = self.held()
        names = pa.array(self.names, pa.string())
        for i in range(0, len(code), rows):
            part = code[i : i + rows]
            columns = [names.take(pa.array(part >> 32)), names.take(pa.array(part & 0xFFFFFFFF)), *(pa.array(c[i : i + rows]) for c in cells)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n", "x"][: len(columns)])
        self.code, self.cells = self.code[:0], [c[:0] for c in self.cells]
        for s in self.square:
            s[:] = 0


def together(rows: DataFrame, key: list[str], label: str, value: str | None = None, wanted: Column | None = None) -> DataFrame:
    """(a, b, n[, x]): for every two labels, in both orders and each with itself, the keys that have both, and the sum of a's values there.

    ``rows``: at most one for a key and a label; null keys meet each other. ``wanted``: a condition on a and b.
    """
    pair = F.struct(F.col(label).cast("string").alias("l"), (F.lit(1) if value is None else F.col(value)).cast("long").alias("v"))
    lists = rows.groupBy(*key).agg(F.collect_list(pair).alias("m")).select(F.transform("m", lambda m: m["l"]).alias("l"), F.transform("m", lambda m: m["v"]).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product = Product(value is not None)
        for batch in batches:
            size = np.array(batch.column(0).value_lengths())
            number, values = product.numbers(batch.column(0).flatten()), np.array(batch.column(1).flatten())
            first, wide = np.repeat(np.cumsum(size) - size, size), np.repeat(size, size).astype(np.int64)  # of each element's key
            upto = np.cumsum(wide)
            low = 0
            while low < len(number):
                high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS, side="right")))
                m = wide[low:high]
                other = np.repeat(first[low:high] - np.cumsum(m) + m, m) + np.arange(m.sum())
                product.add(np.repeat(number[low:high], m), number[other], np.repeat(values[low:high], m))
                if not product.side and len(product.code) > CELLS:
                    yield from product.batches()
                low = high
        yield from product.batches()

    names = ["n", "x"][: 1 + (value is not None)]
    cells = lists.mapInArrow(run, ", ".join(["a string", "b string", *(f"{c} long" for c in names)]))
    return (cells if wanted is None else cells.where(wanted)).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in names])
