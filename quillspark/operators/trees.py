"""Binary decision trees and random forests, grown level by level from histograms.

The table is kept once: features as an array, their codes (the cell of each value
between quantiles of its feature), the code of the row id, and how often each tree drew
the row. A tree carries no rows; the node of a row follows from its features and the
splits so far, which are small arrays. For all trees and nodes of a level there are

1. rows and positives by node, feature and code, and rows by node and code of the id; of
   two siblings only the smaller is counted, the larger is what the parent has besides;
2. the candidates, which are the rows of a node at every `max(1, n // 32)`-th place in
   the order of the id (at most 63): the counts by id code say in which cells they lie,
   and those rows are fetched, after finer counts where a cell holds many;
3. rows at or below each candidate. Where all values of a cell are equal the counts of
   step 1 give them; else the rows of the cells in question are counted once more.

All of it is aggregates of Spark SQL functions. The driver sees counts by node and cell
and the candidates, never a share of the rows. Below the root the order is that of the
id in every node; rows that share an id go by a hash of their values.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from math import exp
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.expr import column, literal_sql, literals, positive
from quillspark.operators.vectors import appended, is_vector, matrix, vector, width
from quillspark.sources.features import numeric, resolve, spread, to_features

CANDIDATES = 32
MIN_GAIN = 1e-6
#: Cells of a feature and of the row id.
FEATURE_CELLS, ID_CELLS = 128, 1024
#: Bounds of what the driver takes at once: cells counted, rows that may be candidates, candidate values.
MOST_CELLS, MOST_ROWS, MOST_VALUES = 1 << 22, 1 << 17, 1 << 18
#: Values of the sample that the cells come from.
SAMPLED_VALUES = 1 << 18
#: Histograms kept to subtract from, in bytes; beyond, both siblings are counted.
KEPT_BYTES = 1 << 28
#: Deeper trees are applied in Arrow batches instead of as one expression.
EXPRESSION_DEPTH = 8
#: Forests of more nodes in all are not written out as conditions.
EXPRESSION_NODES = 256


@dataclass(frozen=True)
class Node:
    feature: int
    threshold: float
    left: int
    right: int
    value: float
    is_leaf: bool

    @staticmethod
    def leaf(value: float) -> Node:
        return Node(-1, 0.0, -1, -1, value, True)

    @staticmethod
    def branch(feature: int, threshold: float, left: int, right: int) -> Node:
        return Node(feature, threshold, left, right, 0.0, False)


class Split(NamedTuple):
    feature: int
    threshold: float
    gain: float
    n_left: int
    p_left: int


class _Nodes:
    """The nodes of all trees by number: roots first, both children of a node side by side."""

    def __init__(self, trees: int):
        self.trees = trees
        self.split: list[Split | None] = [None] * trees
        self.left = [-1] * trees
        self.rows = [0] * trees
        self.positives = [0] * trees

    def branch(self, at: int, split: Split) -> tuple[int, int]:
        self.split[at], self.left[at] = split, len(self.split)
        n, p = self.rows[at], self.positives[at]
        self.split += [None, None]
        self.left += [-1, -1]
        self.rows += [split.n_left, n - split.n_left]
        self.positives += [split.p_left, p - split.p_left]
        return self.left[at], self.left[at] + 1

    def flat(self, tree: int) -> tuple[Node, ...]:
        """A tree, each node before its left subtree, that before its right one."""
        out: list[Node | None] = []

        def add(i: int) -> int:
            at = len(out)
            if self.split[i] is None:
                out.append(Node.leaf(1.0 if self.rows[i] and 2 * self.positives[i] >= self.rows[i] else 0.0))
            else:
                out.append(None)
                left = add(self.left[i])
                out[at] = Node.branch(*self.split[i][:2], left, add(self.left[i] + 1))
            return at

        add(tree)
        return tuple(out)


def best_split(values: np.ndarray, n_left: np.ndarray, p_left: np.ndarray, n: int, pos: int) -> Split | None:
    """The split of the largest Gini gain over candidates (features x places): the first of equals, features first. NaN is none."""
    if n < 2 or pos in (0, n):
        return None

    def gini(total: np.ndarray, ones: np.ndarray) -> np.ndarray:
        p = ones / total
        return 1.0 - p * p - (1.0 - p) * (1.0 - p)

    real = ~np.isnan(values) & (n_left > 0) & (n_left < n)
    nl = np.where(real, n_left, 1)
    gain = gini(n, pos) - (nl / n) * gini(nl, p_left) - ((n - nl) / n) * gini(n - nl, pos - p_left)
    gain = np.where(real, gain, -1.0)
    f, k = np.unravel_index(np.argmax(gain), gain.shape)
    if not gain[f, k] > 0:
        return None
    return Split(int(f), float(values[f, k]), float(gain[f, k]), int(n_left[f, k]), int(p_left[f, k]))


def _below(cuts: Sequence[float], value: Column, kind: str) -> Column:
    """How many of the sorted cuts are smaller: among one of every group, then within a group."""
    if not len(cuts):
        return F.lit(0)
    width = int(len(cuts) ** 0.5) + 1
    every = literals(cuts, kind)
    group = F.size(F.filter(literals(cuts[::width], kind), lambda c: c < value))
    return F.when(group == 0, 0).otherwise((group - 1) * width + F.size(F.filter(F.slice(every, (group - 1) * width + 1, width), lambda c: c < value)))


class _Cells(NamedTuple):
    """Counts of one node: rows and positives by feature and code, rows by code of the id."""

    n: np.ndarray
    p: np.ndarray
    ids: np.ndarray

    def minus(self, other: _Cells) -> _Cells:
        return _Cells(self.n - other.n, self.p - other.p, self.ids - other.ids)


class _Table:
    """The coded table: key (the row id as a number), y, x, c (codes of the features, then of the key), w (draws by tree)."""

    def __init__(self, rows: DataFrame, d: int, weights: Column, trees: int):
        """`rows`: key, y, f0.. ; `weights` may use `key`."""
        self.d, self.trees = d, trees
        self.raw = rows
        each = [F.col(f"f{i}") for i in range(d)]
        known = rows.agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.max("key").alias("most")).first()
        self.rows = known.n
        #: A null id comes before all others.
        first = max((known.least or 0) - 1, -(1 << 63))
        share = min(1.0, max(SAMPLED_VALUES // (d + 1), FEATURE_CELLS) / max(known.n, 1))
        sample = rows.select(*each).sample(share, 42).toArrow()
        self.cuts = [_quantiles(sample.column(f"f{i}"), FEATURE_CELLS) for i in range(d)]
        #: Equal spans of ids; where one holds many rows, finer counts follow.
        width = ((known.most or 0) - first) // ID_CELLS + 1
        key = "key" if width < 1 << 52 else "cast(key as decimal(20,0))"
        cell = F.expr(f"cast(({key} - ({first}L)) div {width}L as int)" if first > -(1 << 63) else f"cast((cast(key as decimal(20,0)) + 9223372036854775808BD) div {width}L as int)")
        code = [F.when(F.isnan(c), len(q) + 1).otherwise(_below(q.tolist(), c, "double")) for c, q in zip(each, self.cuts, strict=True)]
        keyed = spread(rows, self.rows).withColumn("key", F.coalesce("key", F.lit(first)))
        self.base = keyed.select("key", "y", F.array(*each).alias("x"), F.array(*code, cell).cast("array<int>").alias("c"), weights.alias("w")).persist()

    def measure(self) -> _Cells:
        """Counts of the whole table, each row once; also notes which cells hold one value only, and the span of the key in each."""
        by = self.base.selectExpr("key", "y", "x", "posexplode(c) as (f, code)").groupBy("f", "code")
        found = by.agg(*(F.expr(e) for e in ("count(1) as n", "sum(y) as p", "min(get(x, f)) as low", "max(get(x, f)) as high", "min(key) as first", "max(key) as last"))).toArrow()
        f, code, n, p = (found.column(c).to_numpy() for c in ("f", "code", "n", "p"))
        self.single = np.zeros((self.d, FEATURE_CELLS + 2), bool)
        own = f < self.d
        self.single[f[own], code[own]] = (found.column("low").to_numpy() == found.column("high").to_numpy())[own]
        self.raw.unpersist()
        key = {int(c): (a, b) for c, a, b, mine in zip(code, found.column("first").to_pylist(), found.column("last").to_pylist(), ~own, strict=True) if mine}
        self.key_span = key
        return self._cells(f, code, n, p)

    def _cells(self, f: np.ndarray, code: np.ndarray, n: np.ndarray, p: np.ndarray) -> _Cells:
        out = _Cells(np.zeros((self.d, FEATURE_CELLS + 2), np.int64), np.zeros((self.d, FEATURE_CELLS + 2), np.int64), np.zeros(ID_CELLS + 1, np.int64))
        own = f < self.d
        out.n[f[own], code[own]], out.p[f[own], code[own]] = n[own], p[own]
        out.ids[code[~own]] = n[~own]
        return out

    def routed(self, nodes: _Nodes, depth: int, slots: Sequence[int]) -> DataFrame:
        """The rows at the nodes `slots`, with `slot`, the place of their node there, and `w`, how often they count."""
        kept = ("key", "y", "x", "c", "w")
        rows = self.base.selectExpr(*kept[:-1], "posexplode(w) as (node, w)").where("w > 0")
        feature = literal_sql([-1 if s is None else s.feature for s in nodes.split], "int")
        cut, left = literal_sql([0.0 if s is None else s.threshold for s in nodes.split], "double"), literal_sql(nodes.left, "int")
        for _ in range(depth):
            rows = _then(rows, kept, "node", f"if(get({feature}, node) >= 0, get({left}, node) + if(get(x, get({feature}, node)) <= get({cut}, node), 0, 1), node)")
        place = np.full(len(nodes.split), -1)
        place[list(slots)] = np.arange(len(slots))
        return _then(rows, kept, "slot", f"get({literal_sql(place.tolist(), 'int')}, node)").where("slot >= 0")

    def histograms(self, nodes: _Nodes, depth: int, slots: Sequence[int]) -> dict[int, _Cells]:
        out, width = {}, FEATURE_CELLS + ID_CELLS
        for some in _chunks(slots, MOST_CELLS // (self.d * FEATURE_CELLS + ID_CELLS)):
            cells = self.routed(nodes, depth, some).selectExpr("slot", "y", "w", "posexplode(c) as (f, code)")
            cells = cells.selectExpr(f"(cast(slot as bigint) * {self.d + 1} + f) * {width} + code as cell", "w", "w * y as p")
            found = cells.groupBy("cell").agg(F.expr("sum(w) as n"), F.expr("sum(p) as p")).toArrow()
            cell, n, p = (found.column(c).to_numpy() for c in ("cell", "n", "p"))
            order = np.argsort(cell, kind="stable")
            cell, n, p = cell[order], n[order], p[order]
            ends = np.searchsorted(cell, np.arange(len(some) + 1) * (self.d + 1) * width)
            for k, node in enumerate(some):
                mine = slice(ends[k], ends[k + 1])
                out[node] = self._cells(cell[mine] // width % (self.d + 1), cell[mine] % width, n[mine], p[mine])
        return out

    def candidates(self, nodes: _Nodes, depth: int, cells: dict[int, _Cells]) -> dict[int, np.ndarray]:
        """For each node the features of its candidates (places x features)."""
        out = {}
        for some in _chunks(list(cells), max(1, MOST_ROWS // (2 * CANDIDATES))):
            places = {node: np.arange(0, nodes.rows[node], max(1, nodes.rows[node] // CANDIDATES)) for node in some}
            wanted = {}
            for k, node in enumerate(some):
                upto = np.cumsum(cells[node].ids)
                for code in np.unique(np.searchsorted(upto, places[node], "right")):
                    wanted[k, int(code)] = (int(upto[code] - cells[node].ids[code]), int(cells[node].ids[code]))
            out |= self._fetched(self.routed(nodes, depth, some), some, places, wanted)
        return out

    def _fetched(self, rows: DataFrame, some: Sequence[int], places: dict[int, np.ndarray], wanted: dict[tuple[int, int], tuple[int, int]]) -> dict[int, np.ndarray]:
        """`wanted`: by slot and code of the id, how many rows of the node lie before, and how many there."""
        words = ID_CELLS // 32 + 1
        bits = np.zeros(len(some) * words, np.int64)
        for k, code in wanted:
            bits[k * words + code // 32] |= 1 << code % 32
        hits = rows.where(f"getbit(get({literal_sql(bits.tolist(), 'bigint')}, slot * {words} + shiftright(element_at(c, -1), 5)), element_at(c, -1) % 32) = 1")
        hits = hits.selectExpr("slot", "element_at(c, -1) as cell", "key", "pmod(xxhash64(x, y), 4294967296) as h", "x", "w")
        if sum(n for _, n in wanted.values()) > MOST_ROWS:
            hits, wanted = self._narrowed(hits, some, places, wanted)
            hits = hits.groupBy("slot", "cell", "key", "h", "x").agg(F.sum("w").alias("w"))
        found = hits.toArrow()
        slot, cell, key, h, w = (found.column(c).to_numpy() for c in ("slot", "cell", "key", "h", "w"))
        x = found.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, self.d)
        order = np.lexsort((*x.T[::-1], h, key, slot))
        slot, cell, w, x = slot[order], cell[order], w[order].astype(np.int64), x[order]
        bounds, out = np.searchsorted(slot, np.arange(len(some) + 1)), {}
        for k, node in enumerate(some):
            mine = slice(bounds[k], bounds[k + 1])
            within = np.cumsum(w[mine])
            first = np.ones(len(within), bool)
            first[1:] = cell[mine][1:] != cell[mine][:-1]
            heads = np.flatnonzero(first)
            before = np.array([wanted[k, int(c)][0] for c in cell[mine][heads]]) - (within - w[mine])[heads]
            upto = within + np.repeat(before, np.diff(np.append(heads, len(within))))
            out[node] = x[mine][np.searchsorted(upto, places[node], "right")]
        return out

    def _narrowed(self, hits: DataFrame, some: Sequence[int], places: dict[int, np.ndarray], wanted: dict[tuple[int, int], tuple[int, int]]) -> tuple[DataFrame, dict]:
        """Cells that hold few rows, or only rows of one id and hash: each is cut into equal spans again and again.

        What is joined has a row for each cell with a candidate, at most 63 a node.
        """
        spark, wide = hits.sparkSession, F.col("key").cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("h").cast("decimal(38,0)")
        hits = hits.withColumn("k", wide.cast("decimal(38,0)"))
        spans = {(k, c): (self.key_span[c][0] << 32, (self.key_span[c][1] << 32) + (1 << 32) - 1) for k, c in wanted}
        while sum(n for _, n in wanted.values()) > MOST_ROWS and any(a < b for a, b in spans.values()):
            table = spark.createDataFrame([(k, c, str(a), str(b - a + 1)) for (k, c), (a, b) in spans.items()], "slot int, cell int, low string, span string")
            table = table.select("slot", "cell", F.col("low").cast("decimal(38,0)").alias("low"), F.col("span").cast("decimal(38,0)").alias("span"))
            part = F.expr(f"cast((k - low) * {ID_CELLS} div span as int)")
            hits = hits.join(F.broadcast(table), ["slot", "cell"]).withColumn("part", part).drop("low", "span")
            counts = hits.groupBy("slot", "cell", "part").agg(F.sum("w").alias("n"), F.min("k").cast("string").alias("a"), F.max("k").cast("string").alias("b")).collect()
            by: dict[tuple[int, int], list] = {}
            for r in counts:
                by.setdefault((r.slot, r.cell), []).append(r)
            finer, spans, names = {}, {}, []
            for (k, c), parts in by.items():
                before, _ = wanted[k, c]
                for r in sorted(parts, key=lambda r: r.part):
                    at = places[some[k]]
                    if np.searchsorted(at, before) < np.searchsorted(at, before + r.n):
                        name = len(names)
                        names.append((k, c, r.part, name))
                        finer[k, name], spans[k, name] = (before, r.n), (int(r.a), int(r.b))
                    before += r.n
            wanted = finer
            hits = hits.join(F.broadcast(spark.createDataFrame(names, "slot int, cell int, part int, name int")), ["slot", "cell", "part"]).drop("cell", "part").withColumnRenamed("name", "cell")
        return hits, wanted

    def at_or_below(self, nodes: _Nodes, depth: int, cells: dict[int, _Cells], values: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each node the rows and the positives at or below each value (features x places); 0 for a NaN."""
        codes = {node: np.stack([np.searchsorted(q, v) for q, v in zip(self.cuts, x.T, strict=True)]) for node, x in values.items()}
        each = np.arange(self.d)[:, None]
        out, open_ = {}, []
        for node, x in values.items():
            code, real = codes[node], ~np.isnan(x.T)
            code[~real] = 0
            whole = self.single[each, code]
            last = code + whole
            n, p = (np.concatenate([np.zeros((self.d, 1), np.int64), a.cumsum(1)], axis=1) for a in cells[node][:2])
            out[node] = (np.where(real, n[each, last], 0), np.where(real, p[each, last], 0))
            if (real & ~whole).any():
                open_.append((node, real & ~whole))
        cells_each = FEATURE_CELLS + 2
        for some in _chunks(open_, max(1, MOST_VALUES // (cells_each * self.d))):
            #: The values in question, by node, feature and cell; where those of a cell begin, and their number.
            cuts, begin, size = [], np.zeros(len(some) * self.d * cells_each, np.int64), np.zeros(len(some) * self.d * cells_each, np.int64)
            for k, (node, mine) in enumerate(some):
                for f in np.flatnonzero(mine.any(1)):
                    own, first = np.unique(values[node][mine[f], f], return_index=True)
                    cell, start, number = np.unique(codes[node][f, mine[f]][first], return_index=True, return_counts=True)
                    at = (k * self.d + f) * cells_each + cell
                    begin[at], size[at] = len(cuts) + start, number
                    cuts += own.tolist()
            rows = self.routed(nodes, depth, [node for node, _ in some]).selectExpr("slot", "y", "x", "w", f"posexplode(slice(c, 1, {self.d})) as (f, code)")
            rows = rows.selectExpr("y", "w", "x", "f", f"(slot * {self.d} + f) * {cells_each} + code as at")
            number = f"get({literal_sql(size.tolist(), 'int')}, at)"
            inside = f"filter(slice({literal_sql(cuts, 'double')}, get({literal_sql(begin.tolist(), 'int')}, at) + 1, {number}), q -> q < get(x, f))"
            rows = rows.where(f"{number} > 0").selectExpr("at", "w", "w * y as p", f"size({inside}) as bin")
            found = rows.groupBy("at", "bin").agg(F.expr("sum(w) as n"), F.expr("sum(p) as p")).toArrow()
            more: dict[int, list[tuple[int, int, int]]] = {}
            for at, bin_, n, p in zip(*(found.column(c).to_pylist() for c in ("at", "bin", "n", "p")), strict=True):
                more.setdefault(at, []).append((bin_, n, p))
            for k, (node, mine) in enumerate(some):
                for f, j in np.argwhere(mine):
                    at = int((k * self.d + f) * cells_each + codes[node][f, j])
                    here = int(np.searchsorted(cuts[begin[at] : begin[at] + size[at]], values[node][j, f]))
                    for bin_, n, p in more.get(at, ()):
                        if bin_ <= here:
                            out[node][0][f, j] += n
                            out[node][1][f, j] += p
        return out


def _quantiles(values: pa.ChunkedArray, cells: int) -> np.ndarray:
    """Different values at the bounds of about equal cells. They steer work only; counts and candidates are exact wherever they lie."""
    v = values.drop_null().to_numpy()
    v = np.sort(v[~np.isnan(v)])
    return np.unique(v[np.arange(1, cells) * len(v) // cells]) if len(v) else v


def _then(rows: DataFrame, kept: Sequence[str], name: str, value: str) -> DataFrame:
    """The columns `kept` and one computed from columns of `rows`, as a list of one that is unfolded: filters on it are not moved beneath, where a chain of such columns would be written out over and over."""
    return rows.selectExpr(*kept, f"explode(array({value})) as {name}")


def _chunks(items: Sequence, size: int) -> Iterable[Sequence]:
    size = max(1, size)
    return (items[i : i + size] for i in range(0, len(items), size))


def _grow(rows: DataFrame, d: int, max_depth: int, min_split: int, trees: int, weights: Column | None = None) -> _Nodes:
    """`rows`: key, y (0 or 1), f0..; `weights` are the draws of each row by tree, once for one tree if none are given."""
    nodes = _Nodes(trees)
    #: Kept until it is coded, so that what it comes from runs once.
    rows, table = rows.persist(), None
    try:
        table = _Table(rows, d, F.array(F.lit(1)) if weights is None else weights, trees)
        if not table.rows:
            return nodes
        whole = table.measure()
        cells = {0: whole} if weights is None else table.histograms(nodes, 0, range(trees))
        for t in range(trees):
            nodes.rows[t], nodes.positives[t] = int(cells[t].ids.sum()), int(cells[t].p[0].sum())

        def open_(at: int) -> bool:
            n = nodes.rows[at]
            return n >= max(2, min_split) and 0 < nodes.positives[at] < n

        for depth in range(max_depth):
            cells = {at: c for at, c in cells.items() if open_(at)}
            if not cells:
                break
            values = table.candidates(nodes, depth, cells)
            counts = table.at_or_below(nodes, depth, cells, values)
            pairs = []
            for at in cells:
                found = best_split(values[at].T, *counts[at], nodes.rows[at], nodes.positives[at])
                if found and found.gain > MIN_GAIN:
                    pairs.append((at, *nodes.branch(at, found)))
            pairs = [p for p in pairs if depth + 1 < max_depth and (open_(p[1]) or open_(p[2]))]
            if len(pairs) * sum(a.nbytes for a in whole) <= KEPT_BYTES:
                small = {p: min(p[1:], key=lambda i: nodes.rows[i]) for p in pairs}
                counted = table.histograms(nodes, depth + 1, list(small.values()))
                cells = {i: counted[small[p]] if i == small[p] else cells[p[0]].minus(counted[small[p]]) for p in pairs for i in p[1:]}
            else:
                cells = table.histograms(nodes, depth + 1, [i for p in pairs for i in p[1:] if open_(i)])
        return nodes
    finally:
        rows.unpersist()
        if table is not None:
            table.base.unpersist()


def positions(df: DataFrame, id_col: str, *then: str) -> tuple[DataFrame, int]:
    """`df` with `pos`, the place of each row in the order of the id (and the columns `then`), dense from 0, and the number of rows.

    Rows are dealt by ranges of the id, numbered there, and moved on by the rows of the
    ranges before, whose counts are the only numbers that reach the driver. The bounds
    of the ranges are fixed first, so a range that is computed again holds the same rows.
    """
    key = column(id_col)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 1_000).alias("b")).first().b if isinstance(df.schema[id_col].dataType, T.NumericType) else None
    if found is None:
        #: Other kinds of ids have no quantiles; a sample by hash bounds their ranges.
        rows = df.filter(key.isNotNull()).select(key.alias("b")).orderBy(F.xxhash64("b"), "b").limit(20 * parts).toPandas()["b"].sort_values()
        found = list(rows.iloc[:: max(1, len(rows) // parts)])
    bounds = sorted(set(found))
    ranged = df.withColumn("_part", F.when(key.isNull(), -1).otherwise(_bounds_below(key, bounds)))
    counts = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
    before = np.concatenate([[0], np.cumsum([counts.get(k, 0) for k in range(-1, len(bounds) + 1)])]).tolist()
    offset = F.element_at(F.array(*(F.lit(b).cast("long") for b in before)), F.col("_part") + 2)
    numbered = ranged.withColumn("pos", F.row_number().over(Window.partitionBy("_part").orderBy(key, *map(column, then))).cast("long") - 1 + offset)
    return numbered.drop("_part"), int(before[-1])


def _bounds_below(key: Column, bounds: list) -> Column:
    """How many of the sorted bounds are smaller, by comparing with one of every group of them and then within a group: about twice the root of their number."""
    if not bounds:
        return F.lit(0)
    width = int(len(bounds) ** 0.5) + 1
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]

    def smaller(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b < key))

    group = smaller(F.array(*(F.lit(g[0]) for g in groups)))
    return F.when(group == 0, 0).otherwise((group - 1) * width + smaller(F.element_at(F.array(*(F.array(*map(F.lit, g)) for g in groups)), group)))


def tree_expr(nodes: Sequence[Node], features: Sequence[str], at: int = 0, vector: bool = False) -> Column:
    """A tree as nested conditions, on columns or on the places of one array column; NaN goes right."""
    node = nodes[at]
    if node.is_leaf:
        return F.lit(node.value)
    value = F.get(column(features[0]), node.feature).cast("double") if vector else column(features[node.feature])
    return F.when(value <= F.lit(node.threshold), tree_expr(nodes, features, node.left, vector)).otherwise(tree_expr(nodes, features, node.right, vector))


def forest_expr(trees: Sequence[Sequence[Node]], features: Sequence[str], vector: bool = False) -> Column:
    """The mean value of trees of any number and depth, in SQL functions alone: constant arrays of all their nodes, walked level by level; NaN and null go right.

    Leaves lead to themselves, so each tree takes as many steps as the deepest one.
    """
    feature, cut, left, right, value, roots, deepest = [], [], [], [], [], [], 0
    for nodes in trees:
        base, level = len(feature), [0]
        roots.append(base)
        for i, node in enumerate(nodes):
            feature.append(0 if node.is_leaf else node.feature)
            cut.append(0.0 if node.is_leaf else node.threshold)
            left.append(base + (i if node.is_leaf else node.left))
            right.append(base + (i if node.is_leaf else node.right))
            value.append(node.value)
        depth = 0
        while level := [child for i in level if not nodes[i].is_leaf for child in (nodes[i].left, nodes[i].right)]:
            depth += 1
        deepest = max(deepest, depth)
    x = column(features[0]).cast("array<double>") if vector else F.array(*(column(c).cast("double") for c in features))
    feature, left, right, roots = (literals(v, "int") for v in (feature, left, right, roots))
    cut, value, steps = literals(cut, "double"), literals(value, "double"), literals(range(deepest), "int")

    def leaf(x: Column, root: Column) -> Column:
        return F.aggregate(steps, root, lambda at, _: F.when(F.get(x, F.get(feature, at)) <= F.get(cut, at), F.get(left, at)).otherwise(F.get(right, at)))

    #: A list of one names the features, which are then made once for all trees.
    return F.get(F.transform(F.array(x), lambda x: F.aggregate(roots, F.lit(0.0), lambda total, root: total + F.get(value, leaf(x, root)))), F.lit(0)) / F.lit(float(len(trees)))


def _walk(x: np.ndarray, nodes: Sequence[Node]) -> np.ndarray:
    feature, threshold, left, right, value, leaf = (np.array([getattr(n, c) for n in nodes]) for c in ("feature", "threshold", "left", "right", "value", "is_leaf"))
    at = np.zeros(len(x), np.int64)
    while True:
        rows = np.flatnonzero(~leaf[at])
        if not len(rows):
            return value[at]
        node = at[rows]
        at[rows] = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])


@dataclass(frozen=True)
class DecisionTreeModel:
    features: tuple[str, ...]
    nodes: tuple[Node, ...]
    max_depth: int
    min_samples_split: int
    vector: bool = False

    def expr(self) -> Column:
        """Nested conditions, or for deeper trees a walk through constant arrays."""
        return tree_expr(self.nodes, self.features, 0, self.vector) if self.max_depth <= EXPRESSION_DEPTH else forest_expr([self.nodes], self.features, self.vector)

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        if self.max_depth <= EXPRESSION_DEPTH:
            return df.withColumn(output, self.expr())
        return _scored(df, self.features, [self.nodes], output, None)

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, n.feature, n.threshold, n.left, n.right, n.value, n.is_leaf) for i, n in enumerate(self.nodes)], "node int, feature int, threshold double, left_child int, right_child int, value double, is_leaf boolean")


@dataclass(frozen=True)
class RandomForestModel:
    features: tuple[str, ...]
    trees: tuple[tuple[Node, ...], ...]
    max_depth: int
    vector: bool = False

    @property
    def num_trees(self) -> int:
        return len(self.trees)

    def probability(self) -> Column:
        """The share of trees that vote 1; nested conditions, or for larger forests a walk through constant arrays."""
        if sum(map(len, self.trees)) > EXPRESSION_NODES:
            return forest_expr(self.trees, self.features, self.vector)
        return sum((tree_expr(t, self.features, 0, self.vector) for t in self.trees[1:]), tree_expr(self.trees[0], self.features, 0, self.vector)) / F.lit(float(self.num_trees))

    def expr(self) -> Column:
        return F.when(self.probability() >= 0.5, 1.0).otherwise(0.0)

    def transform(self, df: DataFrame, output: str = "prediction", probability: str | None = "probability") -> DataFrame:
        """The share of trees that vote 1, and 1 where it is one half or more. Small forests are expressions, others Arrow batches."""
        if sum(map(len, self.trees)) <= EXPRESSION_NODES:
            out = df.withColumn(output, self.expr())
            return out.withColumn(probability, self.probability()) if probability else out
        return _scored(df, self.features, self.trees, output, probability)


def _scored(df: DataFrame, features: Sequence[str], trees: Sequence[Sequence[Node]], output: str, probability: str | None) -> DataFrame:
    extra = [T.StructField(c, T.DoubleType()) for c in (output, probability) if c]

    places, names = [df.columns.index(resolve(df, c)) for c in features], [*df.columns, *(f.name for f in extra)]

    def run(batches):
        for batch in batches:
            x = matrix(batch.select(places))
            p = sum(_walk(x, t) for t in trees) / len(trees)
            more = [pa.array(np.where(p >= 0.5, 1.0, 0.0)), *([pa.array(p)] if probability else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=names)

    return appended(df, run, *extra)


class DecisionTree:
    """One tree on a 0/1 label. A row id gives the order that candidates are taken in."""

    def __init__(self, max_depth: int = 6, min_samples_split: int = 2):
        self.max_depth, self.min_samples_split = max_depth, min_samples_split

    def fit(self, df: DataFrame, features: Sequence[str], label: str, id_col: str) -> DecisionTreeModel:
        samples, d = _samples(df, features, label, id_col)
        nodes = _grow(_keyed(samples), d, self.max_depth, self.min_samples_split, 1)
        return DecisionTreeModel(tuple(features), nodes.flat(0), self.max_depth, self.min_samples_split, is_vector(df, features[0]))


def _samples(df: DataFrame, features: Sequence[str], label: str, id_col: str) -> tuple[DataFrame, int]:
    """(_id, y, f0..) and the number of features, which are columns or the places of one array column."""
    if any(is_vector(df, c) for c in features):
        if len(features) > 1:
            raise TypeError("an array column stands alone, without other features")
        x = vector(df, features[0])
        d = width(df, features)
        other = F.raise_error(F.lit("vectors of different lengths"))
        rows = df.select(column(resolve(df, id_col)).alias("_id"), numeric(df, label).alias("y"), F.when(F.size(x) == d, x).otherwise(other).alias("x"))
        return rows.select("_id", F.when(positive(F.col("y")), 1).otherwise(0).alias("y"), *(F.get("x", i).alias(f"f{i}") for i in range(d))), d
    rows = to_features(df, features, label, id_col)
    return rows.select(column(id_col).alias("_id"), F.when(positive(column(label)), 1).otherwise(0).alias("y"), *(column(c).alias(f"f{i}") for i, c in enumerate(features))), len(features)


def _keyed(samples: DataFrame) -> DataFrame:
    """`_id` as a whole number `key` of the same order: itself, days, microseconds, or for other types its position."""
    kind = samples.schema["_id"].dataType
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return samples.withColumn("key", F.col("_id").cast("long"))
    if isinstance(kind, T.DateType):
        return samples.withColumn("key", F.unix_date("_id").cast("long"))
    if isinstance(kind, T.TimestampType):
        return samples.withColumn("key", F.unix_micros("_id"))
    return positions(samples, "_id")[0].withColumnRenamed("pos", "key")


def bootstrap(spark, trees: int, rows: int, size: int, seed: int = 42) -> DataFrame:
    """(tree, draw, pos): for each tree `size` positions of 0..rows-1, drawn with replacement by 60 bits of a hash of seed, tree and draw."""
    draws = spark.range(trees * size).select(F.floor(F.col("id") / size).cast("int").alias("tree"), (F.col("id") % size).alias("draw"))
    key = F.concat_ws(":", F.lit(seed) + F.lit(31) * F.col("tree"), F.col("draw"))
    return draws.withColumn("pos", _bits(key) % max(rows, 1))


def _bits(text: Column) -> Column:
    """60 bits of a hash."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def poisson_steps(mean: float) -> list[int]:
    """The shares of 2^60 up to which a Poisson variable is 0, 1, 2, ..."""
    steps, term, total, k = [], exp(-mean), 0.0, 0
    while (total := total + term) < 1.0 and int(total * (1 << 60)) not in steps[-1:] and k < 64:
        steps.append(int(total * (1 << 60)))
        k += 1
        term *= mean / k
    return steps


def multiplicities(key: Column, trees: int, ratio: float, seed: int = 42) -> Column:
    """How often each tree draws a row: a Poisson variable of mean `ratio`, by a hash of seed, tree and row id.

    Draws with replacement come to this when rows are many; a row's share needs no other row.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: _bits(F.concat_ws(":", (F.lit(seed) + 31 * t).cast("string"), key.cast("string"))))
    steps = literals(poisson_steps(ratio), "bigint")
    return F.transform(hashes, lambda h: F.size(F.filter(steps, lambda s: s <= h)))


class RandomForest:
    """Bagged trees with all features, each on about `subsample_ratio` of the rows, drawn with replacement.

    By default a row knows by its id how often each tree draws it, so bagging needs no
    shuffle and the number of draws is that share of the rows on average; rows that
    share an id are drawn together. With `exact` the number is fixed: draws are positions in the order of
    the id, counted by row (a sort, and a join of rows x trees x ratio draws).
    """

    def __init__(self, num_trees: int = 100, max_depth: int = 8, min_samples_split: int = 2, subsample_ratio: float = 0.8, seed: int = 42, exact: bool = False):
        self.num_trees, self.max_depth, self.min_samples_split = max(1, num_trees), max_depth, min_samples_split
        self.subsample_ratio, self.seed, self.exact = min(1.0, max(0.1, subsample_ratio)), seed, exact

    def fit(self, df: DataFrame, features: Sequence[str], label: str, id_col: str) -> RandomForestModel:
        samples, d = _samples(df, features, label, id_col)
        if self.exact:
            rows, n = positions(samples, "_id")
            draws = bootstrap(df.sparkSession, self.num_trees, n, max(2, int(n * self.subsample_ratio)), self.seed)
            each = F.array(*(F.count_if(F.col("tree") == t).cast("int") for t in range(self.num_trees)))
            rows = rows.withColumnRenamed("pos", "key").join(draws.groupBy(F.col("pos").alias("key")).agg(each.alias("times")), "key", "left")
            weights = F.coalesce("times", F.array_repeat(F.lit(0), self.num_trees))
        else:
            rows = _keyed(samples)
            weights = multiplicities(F.col("key"), self.num_trees, self.subsample_ratio, self.seed)
        nodes = _grow(rows, d, self.max_depth, self.min_samples_split, self.num_trees, weights)
        if not any(nodes.rows):
            raise ValueError("no rows were drawn")
        return RandomForestModel(tuple(features), tuple(nodes.flat(t) for t in range(self.num_trees)), self.max_depth, is_vector(df, features[0]))


def gini_candidates(df: DataFrame, feature: str, label: str, id_col: str) -> DataFrame:
    """(threshold, gain) of the best first split on one feature, as a frame of one row; no row if there is none."""
    root = _grow(_keyed(_samples(df, [feature], label, id_col)[0]), 1, 1, 2, 1).split[0]
    return df.sparkSession.createDataFrame([(root.threshold, root.gain)] if root else [], "threshold double, gain double")
