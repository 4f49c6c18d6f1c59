"""Steps whose result depends on the order of a series' rows: one call a series, many series a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows handed on at once.
ROWS = 20_000

#: Given a series' columns in order: its rows, without the series.
Kernel = Callable[[int, dict[str, np.ndarray]], Iterable[tuple]]


def by_series(table: DataFrame, order: list[str], kernel: Kernel, columns: str) -> DataFrame:
    """series_id and the columns of the rows that kernel makes of each series' rows, sorted by `order`. Null numbers
    are NaN there, and None or NaN stands for null in rows of type long."""
    return by_many(table, order, lambda some: (kernel(*one) for one in some), columns, 1)


def by_many(table: DataFrame, order: list[str], kernel: Callable[[list[tuple[int, dict[str, np.ndarray]]]], Iterable[Iterable[tuple]]], columns: str, least: int) -> DataFrame:
    """by_series with a kernel that takes series together, as many as have `least` rows, and gives the rows of each."""
    met = table.repartition("series_id").sortWithinPartitions("series_id", *order)
    names, kinds = zip(*(c.split() for c in columns.split(",")), strict=True)
    types = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for some in _together(_series(batches), order[0], least):
            for (series_id, _), made_of in zip(some, kernel(some), strict=True):
                rows += ((series_id, *row) for row in made_of)
            if len(rows) >= ROWS:
                yield made(rows)
                rows = []
        yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        cells = list(zip(*rows, strict=True)) or [()] * (len(names) + 1)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, [pa.int64(), *types], strict=True)], names=["series_id", *names])

    return met.mapInArrow(run, f"series_id long, {columns}")


def _together(each: Iterator[tuple[int, dict[str, np.ndarray]]], column: str, least: int) -> Iterator[list[tuple[int, dict[str, np.ndarray]]]]:
    held, size = [], 0
    for series_id, own in each:
        held.append((series_id, own))
        size += len(own[column])
        if size >= least:
            yield held
            held, size = [], 0
    if held:
        yield held


def _series(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids = batch.column("series_id").to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, int)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)], strict=True):
            if held and held[0].column("series_id")[0].as_py() != int(ids[a]):
                yield _columns(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield _columns(held)


def _columns(parts: list[pa.RecordBatch]) -> tuple[int, dict[str, np.ndarray]]:
    own = {c: np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) if len(parts) > 1 else parts[0].column(c).to_numpy(zero_copy_only=False) for c in parts[0].schema.names}
    return int(own.pop("series_id")[0]), own
