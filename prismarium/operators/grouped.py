"""Whole groups of rows for Arrow functions, many at a time; far cheaper than one call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def by_group(key: int, handle: Callable[[np.ndarray, pa.RecordBatch], Iterator[pa.RecordBatch]], least: int = 20_000) -> Callable:
    """For mapInArrow over partitions sorted by the number in column ``key``: calls ``handle(bounds, rows)`` with whole groups.

    Groups come many at a time (about ``least`` rows), so memory holds a few batches and the largest group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def emit(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in pa.Table.from_batches(parts).combine_chunks().to_batches():
                keys = rows.column(key).to_numpy()
                yield from handle(np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]), rows)

        for b in batches:
            if not b.num_rows:
                continue
            kept.append(b)
            if sum(x.num_rows for x in kept) < least:
                continue
            keys = b.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            if cut:
                yield from emit([*kept[:-1], b.slice(0, cut)])
                kept = [b.slice(cut)]
        if kept:
            yield from emit(kept)

    return run
