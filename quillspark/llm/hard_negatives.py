"""Hard negatives by vantage-point trees: for an anchor and a positive, the best-scored rows of other labels within a window of scores.

A score is an inner product. With one more coordinate, the root of what a row's squared
norm lacks of the largest one, all rows lie on a sphere, and a score becomes a distance:
|q - x|^2 = |q|^2 + M - 2 * score. So a window of scores is an annulus around the
anchor, and descending scores are ascending distances.

Rows lie in shards of about `SHARD_ROWS`; each task builds the tree of one shard and
takes one block of at most `BLOCK_QUERIES` queries through it. Bounds from the vantage
points put the leaves of the tree in order; a query goes through them nearest first,
from the inner rim of its annulus outwards, and ends when no leaf ahead can hold a row
as good as the last one it has. Distances only order and prune, with a margin for
rounding; scores are whole numbers and compared as such, so the result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import forget, written

POSITIVES, NEGATIVES = 5, 10
#: An anchor's id is divisible by the first; a row whose id is divisible by the second has the next label.
ANCHORS, MOVED, LABELS = 100, 7, 10
SCALE = 256
#: A negative's score in hundredths of the positive's.
WINDOW = (30, 90)
SHARD_ROWS, BLOCK_QUERIES, LEAF_ROWS = 16_384, 2_048, 256

_FOUND = "query long, vec_id long, score long"


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, whole numbers, each different row once."""
    x = F.transform("embedding", lambda c: F.floor(SCALE * c.cast("double")))
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) >= float(1 << 22)))
    moved = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(~odd)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), moved.cast("long").alias("label"), x.cast("array<int>").alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return rows.filter(squares < float(1 << 61)).distinct()


class VantageTree:
    """Rows in halves by their distance from a vantage point, down to leaves; a node keeps the span of distances of either half."""

    def __init__(self, x: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.points: list[np.ndarray] = []
        #: Node (point, spans of its halves, what each half is: a node or -1 - a leaf), parents before children.
        self.nodes: list[tuple[int, list[tuple[float, float]], list[int]]] = []
        self.leaves: list[np.ndarray] = []
        self.x, self.leaf_rows = x, leaf_rows
        draw = np.random.default_rng(len(x))
        todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(x)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop(0)
            if len(rows) <= leaf_rows:
                me = -1 - len(self.leaves)
                self.leaves.append(rows)
            else:
                me = len(self.nodes)
                point = x[rows[draw.integers(len(rows))]]
                distance = np.sqrt(((x[rows] - point) ** 2).sum(1))
                order = np.argsort(distance, kind="stable")
                halves = (order[: len(rows) // 2], order[len(rows) // 2 :])
                self.nodes.append((len(self.points), [(float(distance[h[0]]), float(distance[h[-1]])) for h in halves], [0, 0]))
                self.points.append(point)
                todo += [(rows[h], me, s) for s, h in enumerate(halves)]
            if parent >= 0:
                self.nodes[parent][2][side] = me

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries x leaves) least and largest distance of a leaf's rows by the triangle inequality."""
        low, high = np.zeros((len(q), len(self.leaves))), np.full((len(q), len(self.leaves)), np.inf)
        reach: dict[int, tuple[np.ndarray, np.ndarray]] = {0: (np.zeros(len(q)), np.full(len(q), np.inf))}
        for me, (point, spans, below) in enumerate(self.nodes):
            a, b = reach.pop(me)
            d = np.sqrt(((q - self.points[point]) ** 2).sum(1))
            for (least, most), child in zip(spans, below, strict=True):
                near, far = np.maximum(a, np.maximum(d - most, least - d)), np.minimum(b, d + most)
                if child >= 0:
                    reach[child] = near, far
                else:
                    low[:, -1 - child], high[:, -1 - child] = near, far
        return low, high


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of whole numbers; shorter vectors end in zeros."""
    flat = column.combine_chunks()
    size = flat.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def _wide(x: np.ndarray, d: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, d - x.shape[1])))


def search(x: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, q_ids: np.ndarray, q_labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score): for each query the k rows of the same label (itself left out), or of others, that come first among those with low <= score <= high."""
    d = max(x.shape[1], q.shape[1])
    x, q = _wide(x, d), _wide(q, d)
    norms, own = (x.astype(float) ** 2).sum(1), (q.astype(float) ** 2).sum(1)
    largest = norms.max(initial=0.0)
    #: Products of doubles are exact below 2^53, which the norms bound; larger ones are taken in whole numbers.
    kind = np.float64 if np.sqrt(largest * own.max(initial=0.0)) < 2.0**52 else np.int64
    xk, qk = x.astype(kind), q.astype(kind)
    tree = VantageTree(np.column_stack([x, np.sqrt(np.maximum(largest - norms, 0.0))]))
    near, far = tree.bounds(np.column_stack([q, np.zeros(len(q))]).astype(float))
    margin = 1e-9 * (own + largest + 1.0)[:, None]
    best = (own[:, None] + largest - near**2) / 2 + margin
    least = (own[:, None] + largest - far**2) / 2 - margin
    #: Leaves outside the annulus are left out, those that reach over its inner rim are equally near.
    best = np.where((least > high[:, None]) | (best < low[:, None]), -np.inf, np.minimum(best, high[:, None]))
    order = np.argsort(-best, axis=1, kind="stable")
    none = np.iinfo(np.int64).min
    scores, rows = np.full((len(q), k), none), np.full((len(q), k), -1)
    keys = np.full((len(q), k), np.iinfo(np.int64).max)
    live = np.arange(len(q))
    for step in range(order.shape[1]):
        leaf = order[live, step]
        ahead = best[live, leaf]
        go = (ahead > -np.inf) & ((scores[live, k - 1] == none) | (scores[live, k - 1] <= ahead))
        live, leaf = live[go], leaf[go]
        if not len(live):
            break
        for at in np.unique(leaf):
            mine, inside = live[leaf == at], tree.leaves[at]
            s = np.rint(qk[mine] @ xk[inside].T).astype(np.int64) if kind is np.float64 else qk[mine] @ xk[inside].T
            fit = (s >= low[mine, None]) & (s <= high[mine, None]) & ((labels[inside] == q_labels[mine, None]) == same)
            fit &= (scores[mine, k - 1, None] == none) | (s >= scores[mine, k - 1, None])
            if same:
                twin = ids[inside] == q_ids[mine, None]
                for i, j in np.argwhere(fit & twin):
                    fit[i, j] = not np.array_equal(x[inside[j]], q[mine[i]])
            some = fit.any(1)
            if some.any():
                mine = mine[some]
                s = np.concatenate([scores[mine], np.where(fit[some], s[some], none)], axis=1)
                key = np.concatenate([keys[mine], np.where(fit[some], ids[inside], np.iinfo(np.int64).max)], axis=1)
                row = np.concatenate([rows[mine], np.where(fit[some], inside, -1)], axis=1)
                first = np.lexsort((key, -np.maximum(s, none + 1)), axis=-1)[:, :k]
                scores[mine], keys[mine], rows[mine] = (np.take_along_axis(z, first, axis=1) for z in (s, key, row))
    hit = rows >= 0
    return np.nonzero(hit)[0], rows[hit], scores[hit]


def _searched(index: DataFrame, shards: int, queries: DataFrame, blocks: int, k: int, same: bool) -> DataFrame:
    """(query, vec_id, score): the first k rows of the whole index for each query (query, vec_id, label, v, low, high)."""
    def run(key: tuple, shard: pa.Table, block: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        if shard.num_rows and block.num_rows:
            of = lambda t, c: t.column(c).to_numpy()
            q, r, s = search(_matrix(shard.column("v")), of(shard, "vec_id"), of(shard, "label"), _matrix(block.column("v")), of(block, "vec_id"), of(block, "label"), of(block, "low"), of(block, "high"), k, same)
            found = [of(block, "query")[q], of(shard, "vec_id")[r], s]
        return pa.table(dict(zip(("query", "vec_id", "score"), map(pa.array, found), strict=True)))

    def dealt(rows: DataFrame, shard: Column, block: Column) -> DataFrame:
        return rows.withColumn("shard", shard).withColumn("block", block).groupBy("shard", "block")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = dealt(index, F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"), every(blocks))
    right = dealt(queries, every(shards), F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    found = left.cogroup(right).applyInArrow(run, _FOUND)
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", first).filter(F.col("rank") <= k)


def mine(embeddings: DataFrame, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null id take no part, nor do vectors so long that their products leave 63
    bits (a component of 2^22 or more). Shorter vectors end in zeros. Rows that agree in
    id, label and whole-numbered vector count once; other rows of one id are rows of their
    own. A positive score under zero has an empty window. Ties go by vec_id. Other columns
    are ignored; no rows give no rows.

    Rows of one label and vector differ only in their ids, so an index needs but the first
    of them: as many as could come first, and one more, which could be the anchor itself.
    That takes nothing from the result and tames vectors with very many copies.
    """
    rows = written(vectors(embeddings), "negatives-rows")
    copy = F.row_number().over(Window.partitionBy("label", "v").orderBy("vec_id"))
    index = written(rows.withColumn("copy", copy).filter(F.col("copy") <= max(POSITIVES, NEGATIVES) + 1).drop("copy"), "negatives-index")
    anchors = written(rows.filter(F.col("vec_id") % ANCHORS == 0).withColumn("anchor", F.monotonically_increasing_id()), "negatives-anchors")
    forget(rows)
    shards, blocks = -(-index.count() // shard_rows) or 1, -(-anchors.count() // block_queries) or 1
    whole = (1 << 62) - 1
    queries = anchors.select(F.col("anchor").alias("query"), "vec_id", "label", "v", F.lit(-whole).alias("low"), F.lit(whole).alias("high"))
    positives = written(_searched(index, shards, queries, blocks, POSITIVES, True).select(F.col("query").alias("anchor"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")

    #: One query for each anchor and score, as positives of one score have one window. 100 low >= 30 p and 100 high <= 90 p.
    p = F.col("positive_score")
    windows = positives.filter(p >= 0).select("anchor", "positive_score").distinct().withColumn("query", F.monotonically_increasing_id())
    windows = written(windows, "negatives-windows")
    low, high = F.expr(f"({WINDOW[0]} * positive_score + 99) div 100"), F.expr(f"({WINDOW[1]} * positive_score) div 100")
    queries = windows.join(anchors, "anchor").select("query", "vec_id", "label", "v", low.alias("low"), high.alias("high"))
    found = _searched(index, shards, queries, -(-windows.count() // block_queries) or 1, NEGATIVES, False)
    named = positives.join(windows, ["anchor", "positive_score"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return named.join(found, "query").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = f"""
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % {MOVED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.v AS av, b.vec_id, b.label = a.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % {ANCHORS} = 0 AND (b.vec_id, b.label, b.v) <> (a.vec_id, a.label, a.v)),
p AS (SELECT anchor_id, av, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id, av ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.av, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.av = p.av AND NOT s.same AND {WINDOW[0]} * p.positive_score <= 100 * s.score AND 100 * s.score <= {WINDOW[1]} * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
