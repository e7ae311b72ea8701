"""Quality rules: base rules on counts, then an isolation forest over rule statistics.

Every whole text is read once, where it lies, and gives counts (words, symbols, repeated
lines, repeated word triples, ...). Documents that fail a base rule go. Of the others the
counts, as shares, are the rule statistics; an isolation forest, random trees that split
a random statistic at a random place, isolates odd documents after few splits. The mean
length of the path gives a score, and the threshold on it comes from labelled rows: the
lowest one at which no more than `LOST` of the good ones would go.

All labelled rows take part in the fit. Each tree draws its `TREE_ROWS` from all of them,
as isolation forests do, by the smallest hashes of tree and id, and grows in a task of
its own; then all good rows go through it, and their numbers in its leaves give the
lengths of its paths. The threshold is the exact order statistic over all good rows.
Counts, not texts, are written, joined with labels and shuffled; forest and threshold,
of bounded size, travel to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import forget, lean, written
from quillspark.llm.text import owners, row_slices, text_bytes

#: Trees, the labelled rows that each of them draws, their depth.
TREES, TREE_ROWS, DEPTH, SEED = 150, 2_048, 14, 11
#: Share of the good labelled rows that the threshold may reject.
LOST = 0.003
#: Parts of a span whose scores are counted in one round of `nth_highest`.
CELLS = 1_024
#: Base rules: so many words at least, and no more than such a percentage of them in repeated triples.
LEAST_WORDS, MOST_REPEATED = 50, 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bytes", "n_letters", "n_capitals", "n_digits", "n_points")
STATISTICS = ("word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "capital_rate", "digit_rate", "point_rate", "letter_rate")

_bytes = np.arange(256)
_SYMBOL = np.isin(_bytes, [ord(c) for c in "#*$%&|<>"])
_POINT = np.isin(_bytes, [ord(c) for c in ".,;:!?"])
_DIGIT = (_bytes >= 48) & (_bytes <= 57)
_CAPITAL = (_bytes >= 65) & (_bytes <= 90)
#: ASCII letters and the first bytes of other characters.
_LETTER = _CAPITAL | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 0xC0)


def _codes(values: pa.Array) -> np.ndarray:
    """Equal values have equal numbers, by their bytes."""
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of pairs; both are smaller than 2^31."""
    return pd.factorize((a << 31) | b)[0].astype(np.int64)


def _again(keys: np.ndarray) -> np.ndarray:
    """Which keys are there twice or more."""
    return (np.bincount(keys) > 1)[keys] if len(keys) else np.zeros(0, bool)


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def count(texts: pa.Array) -> np.ndarray:
    """Rows x COUNTS of whole texts; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    data, offsets = text_bytes(texts)
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    parts = pc.ascii_split_whitespace(texts)
    first, words = parts.offsets.to_numpy(), parts.flatten()
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    first = np.concatenate([[0], np.cumsum(real)])[first - first[0]]
    words = words.filter(pa.array(real))
    out[:, 0] = np.diff(first)
    out[:, 1] = _per_row(pc.utf8_length(words).to_numpy(zero_copy_only=False), first)
    row = owners(first)
    if len(words) > 2:
        code = _codes(words)
        triple = _paired(_paired(code[:-2], code[1:-1]), code[2:])
        inside = row[:-2] == row[2:]
        twice = np.zeros(len(triple), bool)
        twice[inside] = _again(_paired(row[:-2][inside], triple[inside]))
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : len(words) - 2 + k] |= twice
        out[:, 4] = _per_row(covered, first)
    lines = pc.split_pattern(texts, "\n")
    begin, flat = lines.offsets.to_numpy(), lines.flatten()
    begin = begin - begin[0]
    worded = pc.binary_length(pc.ascii_trim_whitespace(flat)).to_numpy(zero_copy_only=False) > 0
    key = _paired(owners(begin), _codes(flat)) if len(flat) else np.zeros(0, np.int64)
    earlier = np.ones(len(key), bool)
    earlier[np.unique(key, return_index=True)[1]] = False
    out[:, 3] = _per_row(earlier & worded, begin)
    out[:, 5] = _per_row(worded, begin)
    out[:, 6] = np.diff(offsets)
    for k, kind in zip((2, 7, 8, 9, 10), (_SYMBOL, _LETTER, _CAPITAL, _DIGIT, _POINT), strict=True):
        out[:, k] = _per_row(kind[data], offsets)
    return out


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


def statistics(counts: np.ndarray) -> np.ndarray:
    """Rows x STATISTICS."""
    c = dict(zip(COUNTS, np.maximum(counts, 0).T.astype(float), strict=True))
    per = lambda a, b: c[a] / np.maximum(c[b], 1)
    return np.column_stack([
        per("word_chars", "n_words"), per("n_symbols", "n_words"), per("n_dup_lines", "n_lines"), per("n_repeat_words", "n_words"),
        per("n_capitals", "n_letters"), per("n_digits", "n_bytes"), per("n_points", "n_words"), per("n_letters", "word_chars"),
    ])


def _expected_depth(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random binary tree of n rows; n need not be whole."""
    n = np.asarray(n, float)
    large = np.maximum(n, 2)
    return np.where(n > 2, np.maximum(2 * (np.log(large - 0.5) + np.euler_gamma) - 2 * (large - 1) / large, 1), np.clip(n - 1, 0, 1))


def grow(x: np.ndarray, good: np.ndarray, draw: np.random.Generator, most: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A random tree, with splits at random places of random statistics; by node: feature or -1, cut, depth, both children.

    Splits lie within the span of all rows of a node, but a path ends where fewer than two
    good rows are left: the length of a path says how soon a document is apart from the
    good ones, so a crowd of alike bad rows does not hide itself.
    """
    feature, cut, depths, below = [], [], [], []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        me, n = len(feature), int(good[rows].sum())
        if parent >= 0:
            below[parent][side] = me
        low, high = x[rows].min(0, initial=np.inf), x[rows].max(0, initial=-np.inf)
        open_ = np.flatnonzero(high > low)
        f, c = -1, 0.0
        if depth < most and n > 1 and len(open_):
            f = int(draw.choice(open_))
            c = draw.uniform(low[f], high[f])
            left = x[rows, f] <= c
            todo += [(rows[left], depth + 1, me, 0), (rows[~left], depth + 1, me, 1)]
        feature.append(f)
        cut.append(c)
        depths.append(depth)
        below.append([me, me])
    return np.array(feature), np.array(cut), np.array(depths, float), np.array(below)


@dataclass(frozen=True)
class IsolationForest:
    """Trees as `grow` gives them, each on `rows` labelled rows, with lengths of paths instead of depths once they are `weighed`."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    rows: int

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Tree by tree, the nodes where the paths of rows end."""
        each = np.arange(len(x))
        for feature, cut, _, below in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = below[node, (x[each, feature[node]] > cut[node]).astype(np.int64)]
            yield node

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher where rows are isolated sooner; 0.5 without trees."""
        if not self.trees or not len(x):
            return np.full(len(x), 0.5)
        total = np.zeros(len(x))
        for (_, _, length, _), leaf in zip(self.trees, self.leaves(x), strict=True):
            total += length[leaf]
        return 2.0 ** (-total / len(self.trees) / max(float(_expected_depth(self.rows)), 1.0))


@dataclass(frozen=True)
class RuleModel:
    forest: IsolationForest
    threshold: float

    def odd(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, whether the score is over the threshold)."""
        scores = self.forest.scores(statistics(counts))
        return scores, scores > self.threshold


def calibrated(scores: np.ndarray, good: np.ndarray, lost: float = LOST) -> float:
    """The lowest threshold over which at most a share `lost` of the good rows lies; infinite without good rows."""
    if not good.any():
        return float("inf")
    own = np.sort(scores[good])
    return float(own[len(own) - 1 - int(lost * len(own))])


def counted(docs: DataFrame, *more: str) -> DataFrame:
    """The columns `more` of `docs` and the COUNTS of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            _, offsets = text_bytes(texts)
            each = [count(texts.slice(i, j - i)) for i, j in row_slices(offsets)]
            counts = np.concatenate(each) if each else np.zeros((0, len(COUNTS)), np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in more), *map(pa.array, counts.T)], names=[*more, *COUNTS])

    rows = docs.select(*more, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(lean(run), ", ".join([*(f"{c} {kinds[c]}" for c in more), *(f"{c} long" for c in COUNTS)]))


def teachers(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, good and COUNTS of the labelled ids whose text passes the base rules, one row an id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good")).filter("doc_id IS NOT NULL AND good IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("good").alias("good"))
    rows = counts.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("least")).select("doc_id", "least.*")
    return rows.join(known, "doc_id").filter(f"n_words >= {LEAST_WORDS} AND 100 * n_repeat_words <= {MOST_REPEATED} * n_words")


def drawn(known: DataFrame, n: int, trees: int = TREES, rows: int = TREE_ROWS) -> DataFrame:
    """`known`, of n rows, by `tree`: at least the `rows` rows with the smallest hash `place` of tree and id, and not many more."""
    most = min(1.0, (rows + 8 * rows**0.5) / max(n, 1))
    by_tree = known.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("place", F.xxhash64(F.lit(SEED), "tree", "doc_id"))
    return by_tree.filter(F.col("place") <= min((1 << 63) - 1, int(most * 2.0**64) - (1 << 63)))


def _matrix(columns: pd.DataFrame | pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.column_stack([np.asarray(columns[c]) for c in COUNTS]).astype(np.int64)


def _grown(rows: pd.DataFrame) -> pd.DataFrame:
    """One tree on the first TREE_ROWS of its rows, as a row of arrays."""
    rows = rows.sort_values(["place", "doc_id"])[:TREE_ROWS]
    tree = int(rows["tree"].iloc[0])
    feature, cut, depth, below = grow(statistics(_matrix(rows)), rows["good"].to_numpy() == 1, np.random.default_rng([SEED, tree]))
    return pd.DataFrame({"tree": [tree], "feature": [feature], "cut": [cut], "depth": [depth], "low": [below[:, 0]], "high": [below[:, 1]]})


def forest(known: DataFrame) -> IsolationForest:
    """From rows as `teachers` gives them; trees grow side by side, and only their nodes and the counts of their leaves reach the driver."""
    n = known.count()
    if not n:
        return IsolationForest([], 0)
    grown = drawn(known, n).groupBy("tree").applyInPandas(_grown, "tree int, feature array<long>, cut array<double>, depth array<double>, low array<long>, high array<long>")
    nodes = grown.orderBy("tree").select("feature", "cut", "depth", "low", "high").toArrow()
    trees = [[column[i].values.to_numpy() for column in nodes.columns] for i in range(nodes.num_rows)]
    grown = IsolationForest([(feature, cut, depth, np.column_stack(below)) for feature, cut, depth, *below in trees], min(TREE_ROWS, n))
    return weighed(grown, known, n)


def weighed(grown: IsolationForest, known: DataFrame, n: int) -> IsolationForest:
    """The trees with lengths of paths: the depth of a leaf, and what its share of all good rows of `known`, of n rows, would add below it."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(depth), np.int64) for _, _, depth, _ in grown.trees]
        for batch in batches:
            for count, leaf in zip(counts, grown.leaves(statistics(_matrix(batch))), strict=True):
                count += np.bincount(leaf, minlength=len(count))
        for tree, count in enumerate(counts):
            leaf = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), tree)), pa.array(leaf), pa.array(count[leaf])], names=["tree", "leaf", "n"])

    table = known.filter("good = 1").select(*COUNTS).mapInArrow(lean(held), "tree long, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).toArrow()
    tree, leaf, number = (table.column(c).to_numpy() for c in ("tree", "leaf", "n"))
    trees = []
    for k, (feature, cut, depth, below) in enumerate(grown.trees):
        good = np.zeros(len(depth))
        good[leaf[tree == k]] = number[tree == k]
        trees.append((feature, cut, depth + _expected_depth(good * grown.rows / n), below))
    return IsolationForest(trees, grown.rows)


def nth_highest(scores: DataFrame, k: int) -> float:
    """The k-th highest `score`, exactly: rounds count the scores in parts of a span and go on in the part that holds it."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    while low < high:
        part = F.floor((F.col("score") - low) / (high - low) * CELLS).alias("part")
        parts = scores.filter(F.col("score").between(low, high)).groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
        for r in parts.orderBy(F.desc("part")).collect():
            if k <= r.n:
                low, high = r.low, r.high
                break
            k -= r.n
    return low


def threshold(scores: DataFrame, lost: float = LOST) -> float:
    """As `calibrated`, over a table with the `score` of every good row."""
    n = scores.count()
    return nth_highest(scores, int(lost * n) + 1) if n else float("inf")


def _fitted(counts: DataFrame, labels: DataFrame) -> RuleModel:
    known = written(teachers(counts, labels), "rules-teachers")
    trees = forest(known)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(trees.scores(statistics(_matrix(batch))))], names=["score"])

    scores = written(known.filter("good = 1").select(*COUNTS).mapInArrow(lean(scored), "score double"), "rules-scores")
    model = RuleModel(trees, threshold(scores))
    forget(known, scores)
    return model


def fit(docs: DataFrame, labels: DataFrame) -> RuleModel:
    """From `labels` (doc_id, quality) and the texts of `docs`, all rows of both.

    Rows without id or label are left out; of several labels of an id the smallest counts,
    of several texts of an id that with the smallest counts. Rows that fail a base rule teach nothing.
    """
    return _fitted(_counted(docs), labels)


def _counted(docs: DataFrame) -> DataFrame:
    return counted(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")


def _judged(counts: DataFrame, model: RuleModel) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = _matrix(batch)
            failed = base_failed(numbers)
            scores, odd = model.odd(numbers)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", *COUNTS[:5])), pa.array(failed), pa.array(~failed & ~odd), pa.array(scores, mask=failed)],
                names=["doc_id", *COUNTS[:5], "base_failed", "kept", "score"],
            )

    return counts.mapInArrow(lean(run), f"doc_id long, {', '.join(f'{c} long' for c in COUNTS[:5])}, base_failed boolean, kept boolean, score double")


def judge(docs: DataFrame, model: RuleModel) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score (null where a base rule failed)."""
    return _judged(_counted(docs), model)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Judge every row of `docs` by the base rules and a forest fitted with `labels`.

    A null text is empty and fails the base rules, as does one without words. A null
    doc_id stays null. Repeated rows are judged alike. Without good labels the forest
    rejects nothing. Other columns are ignored. No rows give no rows.
    """
    counts = written(_counted(docs), "rules-counts")
    return _judged(counts, _fitted(counts, labels))
