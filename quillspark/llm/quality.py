"""Quality: cumulative-link (proportional odds) regression on graded ratings.

P(grade >= k) = sigmoid(w . x - t_k) with one weight vector w over hashed text
features and ordered thresholds t_1 < t_2 < ... The fit takes a bounded sample of
rated rows (`TRAIN_ROWS`), picked by a hash of the id; scoring is one scan without
a shuffle, with the weights (`DIMENSIONS` floats) as the only side data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import by_place, forget, give_back, lean, quoted, written
from quillspark.llm.text import Prefix, Words, mix, owners, row_slices, text_bytes

#: Bounds of the fit: rated rows, and features of all of them together (rows are left out from the end of the sample).
TRAIN_ROWS, TRAIN_FEATURES = 12_000, 8_000_000
DIMENSIONS = 1 << 17
#: Features that the driver takes from the sample, and works on, at a time.
_PORTION = 1 << 18
#: A row is selected if the probability of this grade or a better one reaches TAIL.
GRADE, TAIL = 1, 0.5

_bytes = np.arange(256)
_LETTER = ((_bytes >= 65) & (_bytes <= 90)) | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)
_UPPER = (_bytes >= 65) & (_bytes <= 90)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EDGES = np.array([0.0, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.75])
_RATES = 6


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 17)).astype(np.int64)


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the features of each text.

    Words and word endings of signs weigh by their share of the words; rates of
    signs, capitals, repeats and sizes are one bucket for each step of the rate.
    """
    words = Words(data, offsets)
    n, rows = np.diff(words.first), owners(words.first)
    lower = Prefix(_LOWER[data], "byte")
    whole = lower.of(words.start, words.end)
    letter = _LETTER[data]
    last = np.maximum.accumulate(np.where(letter, np.arange(len(data)), -1)) if len(data) else np.zeros(0, np.int64)
    tail = np.maximum(last[words.end - 1] + 1, words.start) if len(words.start) else words.start
    signs = words.end - tail
    ending = lower.of(tail, words.end)
    share = 1.0 / np.maximum(n, 1)[rows]
    caps = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_UPPER[data], out=caps[1:])
    again = np.zeros(len(whole), bool)
    if len(whole):
        again[1:] = (whole[1:] == whole[:-1]) & (rows[1:] == rows[:-1])
    size = words.end - words.start
    shouted = (caps[words.end] - caps[words.start] >= np.maximum(tail - words.start, 2)) & (size > 2)
    per = np.maximum(n, 1)
    rates = [_per_row(x, words.first) / per for x in (signs > 1, signs == size, shouted, again)]
    rates += [np.minimum(1.0, _per_row(size, words.first) / per / 16), np.minimum(1.0, np.log1p(n) / 12)]
    out_rows, out_buckets, out_values = [rows, rows[signs > 0]], [_bucket(whole), _bucket(mix(ending[signs > 0] ^ np.uint64(0xE)))], [4 * share, 4 * share[signs > 0]]
    every = np.arange(len(n))
    for k, rate in enumerate(rates):
        step = np.searchsorted(_EDGES, rate, "left") if k < 4 else (rate * 12).astype(int)
        out_rows.append(every)
        out_buckets.append(_bucket(mix((step + 100 * (k + 1)).astype(np.uint64))))
        out_values.append(np.ones(len(n)))
    return np.concatenate(out_rows), np.concatenate(out_buckets), np.concatenate(out_values)


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows x thresholds: P(grade >= k)."""
        rows, buckets, values = hashed(data, offsets)
        line = np.bincount(rows, self.weights[buckets] * values, len(offsets) - 1)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - line[:, None], -50, 50)))


def fit_cumulative_link(first: np.ndarray, buckets: np.ndarray, values: np.ndarray, grades: np.ndarray, n_grades: int, rounds: int = 150, rate: float = 0.08, ridge: float = 2e-4) -> OrdinalModel:
    """Maximum likelihood by Adam; thresholds are the first one and positive gaps, so they stay ordered.

    Row i has features first[i]:first[i + 1]. The driver fits: it holds a bucket and a value
    of 32 bits for each feature, and works on whole rows of about _PORTION features at a time.
    `buckets` is overwritten: each becomes its number among those in use.
    """
    n, parts = len(grades), [(i, j, slice(int(first[i]), int(first[j]))) for i, j in row_slices(first, _PORTION)]
    seen = np.zeros(DIMENSIONS, bool)
    for _, _, some in parts:
        seen[buckets[some]] = True
    used = np.flatnonzero(seen)
    place = np.zeros(DIMENSIONS, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    for _, _, some in parts:
        buckets[some] = place[buckets[some]]
    values = values.astype(np.float32, copy=False)
    share = np.array([(grades >= k).mean() for k in range(1, n_grades)]).clip(1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-2 * np.arange(n_grades - 1))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    theta = np.concatenate([np.zeros(len(used)), start[:1], gaps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    every, d = np.arange(n), len(used)
    for t in range(1, rounds + 1):
        w = theta[:d].astype(np.float32)
        cuts = np.concatenate([theta[d : d + 1], np.exp(theta[d + 1 :])]).cumsum()
        line = np.zeros(n)
        for i, j, some in parts:
            line[i:j] = np.bincount(np.repeat(every[: j - i], np.diff(first[i : j + 1])), w[buckets[some]] * values[some], j - i)
        upper = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(cuts - line[:, None], -50, 50))), np.zeros((n, 1))], 1)
        slope = upper * (1 - upper)
        p = np.maximum(upper[every, grades] - upper[every, grades + 1], 1e-9)
        d_line = ((slope[every, grades] - slope[every, grades + 1]) / p).astype(np.float32)
        d_cuts = np.zeros((n, n_grades + 1))
        d_cuts[every, grades] -= slope[every, grades] / p
        d_cuts[every, grades + 1] += slope[every, grades + 1] / p
        back = d_cuts[:, 1:-1].mean(0)[::-1].cumsum()[::-1]
        g_w = np.zeros(d)
        for i, j, some in parts:
            g_w += np.bincount(buckets[some], np.repeat(d_line[i:j], np.diff(first[i : j + 1])) * values[some], d)
        g_w = g_w / n - ridge * theta[:d]
        g = np.concatenate([g_w, back[:1], back[1:] * np.exp(theta[d + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[used] = theta[:d]
    return OrdinalModel(weights, np.concatenate([theta[d : d + 1], np.exp(theta[d + 1 :])]).cumsum())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for i, j in row_slices(offsets):
            rows, buckets, values = hashed(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            key, inverse = np.unique(rows * DIMENSIONS + buckets, return_inverse=True)
            summed = np.bincount(inverse, values, len(key)).astype(np.float32)
            first = np.searchsorted(key, np.arange(j - i + 1) * DIMENSIONS).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x)) for x in ((key % DIMENSIONS).astype(np.int32), summed)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("doc_id", "grade")), *lists], names=["doc_id", "grade", "buckets", "values"])


def fit(docs: DataFrame, ratings: DataFrame, train_rows: int = TRAIN_ROWS) -> OrdinalModel:
    """From `ratings` (doc_id, grade from 0 up) and the texts of `docs`; at most `train_rows` rated ids, picked by hash.

    Rows without id or grade are left out; of several grades of an id the lowest counts,
    of several texts of an id the smallest, so that repeated ids do not enlarge the sample.
    """
    picked = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).filter("doc_id IS NOT NULL AND grade >= 0")
    picked = picked.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")).mapInArrow(lean(_features), "doc_id long, grade int, buckets array<int>, values array<float>")
    sample = whole = written(sample, "quality-sample")
    #: One number a row, of `train_rows` rows at most, shows where the features go over their bound.
    sizes = sample.select("doc_id", F.size("buckets").alias("n"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").toArrow()
    over = np.flatnonzero(np.cumsum(sizes.column("n").to_numpy()) > TRAIN_FEATURES)
    if len(over):
        h, doc = (sizes.column(c)[int(over[0])].as_py() for c in ("h", "doc_id"))
        sample = sample.filter(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id") < F.struct(F.lit(h).alias("h"), F.lit(doc).alias("doc_id")))
    ids, size = (sizes.column(c).to_numpy()[: over[0] if len(over) else None] for c in ("doc_id", "n"))
    if not len(ids):
        forget(whole)
        return OrdinalModel(np.zeros(DIMENSIONS, np.float32), np.zeros(1))
    by_id = np.argsort(ids)
    first, buckets, values, grades = _collected(sample, ids[by_id], size[by_id])
    forget(whole)
    model = fit_cumulative_link(first, buckets, values, grades, max(2, int(grades.max()) + 1))
    del buckets, values
    give_back()
    return model


def _collected(sample: DataFrame, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, buckets, values, grades) of the rows with these rising ids and numbers of features, in their order.

    The driver takes whole rows of about _PORTION features at a time, so it holds the sample once.
    """
    first = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    buckets, values, grades = np.zeros(first[-1], np.int32), np.zeros(first[-1], np.float32), np.zeros(len(ids), np.int64)
    for i, j in row_slices(first, _PORTION):
        rows = sample.filter(F.col("doc_id").between(int(ids[i]), int(ids[j - 1]))).toArrow().sort_by("doc_id")
        grades[i:j] = rows.column("grade").to_numpy()
        for name, out in (("buckets", buckets), ("values", values)):
            out[first[i] : first[j]] = np.concatenate([x.flatten().to_numpy() for x in rows.column(name).chunks])
    return first, buckets, values, grades


def score(docs: DataFrame, model: OrdinalModel, columns: list[str] | None = None, grade: int = GRADE, tail: float = TAIL) -> DataFrame:
    """doc_id, expected_grade, tail_probability, selected for every row; or, with `columns`, those columns of the selected rows.

    A null or empty text is scored as no words; repeated rows are scored alike, columns of
    any name pass through, a null doc_id stays null, no rows give no rows.
    """
    names = columns or ["doc_id"]
    kept = docs.select(*quoted(names))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(names.index("text") if columns else 1))
            tails = [model.tails(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in row_slices(offsets)]
            tails = np.concatenate(tails) if tails else np.zeros((0, len(model.thresholds)))
            at = tails[:, min(grade, tails.shape[1]) - 1]
            if columns:
                yield batch.filter(pa.array(at >= tail)).rename_columns(names)
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(1)), pa.array(at), pa.array(at >= tail)], names=["doc_id", "expected_grade", "tail_probability", "selected"])

    if columns:
        return by_place(kept).mapInArrow(lean(scored), kept.schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(scored), "doc_id long, expected_grade double, tail_probability double, selected boolean")


def grades(labels: DataFrame) -> DataFrame:
    """Three grades: 0 poor, 1 good but toxic, 2 good and civil. A null `toxic` counts as civil."""
    return labels.select("doc_id", (F.col("quality") * (F.lit(2) - F.coalesce("toxic", F.lit(0)))).cast("int").alias("grade"))


def quality(docs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Fit on `ratings` (doc_id, grade) and give each row of `docs` its expected grade and tail probability.

    Repeated rows are scored alike, a null doc_id stays null, other columns are
    ignored. Without ratings every probability is one half; no rows give no rows.
    """
    return score(docs, fit(docs, ratings))
