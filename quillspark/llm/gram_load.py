"""How often k-grams occur, by cells of their fingerprints: tells which anchors would gather too much.

Every k-gram of every text is counted in one of `CELLS` counters. Cells far above the
mean hold a frequent k-gram; windows then prefer other anchors (see
`window_anchors`). That only steers where windows meet, so a cell that is called
frequent by chance does no harm, and results do not depend on it. Fewer than
CELLS / TIMES cells can be above TIMES the mean, which bounds what tasks are sent.

That bar rises with the input, so a second, absolute one follows: where an anchor has
more distinct contexts than a shard should take, the exact k-grams that are as
frequent in those contexts come last of all, and the windows are anchored anew, until
no anchor is over the bound. There are fewer such k-grams than k-grams / bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import forget, lean, written
from quillspark.llm.text import byte_parts, text_bytes

CELL_BITS = 17
CELLS = 1 << CELL_BITS
#: A cell is frequent above so many times the mean, and so many occurrences.
TIMES, LEAST = 8, 2_000


def cell_of(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - CELL_BITS)).astype(np.int64)


class Levels:
    """How late k-grams may be anchors: 0 first, 1 those of frequent cells, 2 those named `late` (sorted)."""

    def __init__(self, cells: np.ndarray | None, late: np.ndarray):
        self.cells, self.late = cells, late
        self.late_cells = np.zeros(CELLS, bool)
        self.late_cells[cell_of(late)] = True

    def __call__(self, grams: np.ndarray) -> np.ndarray | None:
        if self.cells is None and not len(self.late):
            return None
        level = np.zeros(len(grams), np.uint8) if self.cells is None else self.cells[cell_of(grams)].astype(np.uint8)
        if len(self.late):
            some = np.flatnonzero(self.late_cells[cell_of(grams)])
            level[some[np.isin(grams[some], self.late)]] = 2
        return level


def grams_of_runs(grams: np.ndarray, place: np.ndarray, first: np.ndarray, n: np.ndarray, width: int, crowded: np.ndarray) -> pa.RecordBatch:
    """Counts of the k-grams in the windows of crowded anchors; a window has `width` k-grams."""
    hit = np.isin(grams[place], crowded)
    first, size = first[hit], n[hit] + width - 1
    found, count = np.unique(grams[np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(count)], names=["gram", "n"])


def bounded_anchors(anchored: Callable[[np.ndarray], DataFrame], shared: Callable[[DataFrame], DataFrame], grams: Callable[[np.ndarray, np.ndarray], DataFrame], most: int) -> tuple[DataFrame, DataFrame]:
    """(anchors, shared anchors) in which no anchor has more than `most` distinct contexts.

    `anchored(late)` gives the anchors, `shared(anchors)` those to keep with their
    number `n` of occurrences, `grams(late, crowded)` the counted k-grams of the
    windows of crowded anchors. Only windows that hold nothing but k-grams above
    the bound can stay together beyond it.
    """
    late = np.zeros(0, np.uint64)
    while True:
        anchors = anchored(late)
        kept = shared(anchors)
        heavy = kept.filter(F.col("n") > most).select("anchor")
        contexts = anchors.join(F.broadcast(heavy), "anchor").groupBy("anchor", "span").agg(F.count(F.lit(1)).alias("copies"))
        crowded = _longs(contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("anchor"))
        crowded = np.setdiff1d(crowded, late)
        if not len(crowded):
            return anchors, kept
        more = np.union1d(crowded, _longs(grams(late, crowded).groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > most).select("gram")))
        late = np.union1d(late, more)
        forget(anchors, kept)


def _longs(column: DataFrame) -> np.ndarray:
    return np.array([r[0] for r in column.collect()], np.int64).view(np.uint64)


def frequent_cells(rows: DataFrame, grams_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """Marks of the frequent cells, None if there are none. `rows` has text; each task adds up its own counters first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(CELLS, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b, rows_first, _ in byte_parts(offsets, 1):
                count += np.bincount(cell_of(grams_of(data[a:b], rows_first)), minlength=CELLS)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some])], names=["cell", "n"])

    load = written(rows.select("text").mapInArrow(lean(run), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")), "gram-load")
    whole = load.agg(F.sum("n")).first()[0] or 0
    cells = [r.cell for r in load.filter(F.col("n") > max(LEAST, TIMES * whole / CELLS)).select("cell").collect()]
    forget(load)
    if not cells:
        return None
    marks = np.zeros(CELLS, bool)
    marks[cells] = True
    return marks
