"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Training takes a bounded sample of labelled rows (`TRAIN_ROWS`), picked by a hash
of the id. A lexicon is counted over that sample with Spark: words and word
beginnings that are far commoner in toxic texts. To keep the trees from trusting
words that only their own row brought in, the rows of either half are described
with the lexicon of the other half. Scoring is one scan of all texts without a
shuffle; only the lexicon and the trees, both of bounded size, travel to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import forget, lean, written
from quillspark.llm.text import Prefix, owners, row_slices, text_bytes

#: Bound of the fit: labelled rows. The lexicon follows from it: an entry is in a share of the toxic texts.
TRAIN_ROWS = 16_000
#: Word beginnings of so many bytes stand beside whole words.
BEGINNINGS = (5, 7, 9)
THRESHOLD = 0.3
TIERS = (2.0, 3.0, 4.5)
#: A lexicon entry is in so many toxic texts at least, and in such a share of them.
SUPPORT, SUPPORT_SHARE = 3, 0.01

#: Words of the second person in four languages.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine euch euer ihr tu te toi ton ta tes vous votre vos usted ustedes ti tus tuyo vosotros eres".split()
#: Signs that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

FEATURES = (
    "hits_low", "hits_mid", "hits_high", "density_low", "density_mid", "density_high", "weight_sum", "weight_mean", "weight_top", "near_second_person", "second_person_rate",
    "capital_rate", "shouted_rate", "exclamation_rate", "question_rate", "sign_rate", "obfuscation_rate", "hidden_hits", "stretch_rate", "log_words",
)

_bytes = np.arange(256)
_LETTER = ((_bytes >= 65) & (_bytes <= 90)) | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)
_UPPER = (_bytes >= 65) & (_bytes <= 90)
_ASCII_LETTER = _UPPER | ((_bytes >= 97) & (_bytes <= 122))
_SIGN = np.isin(_bytes, [ord(c) for c in "#$%&*@^~"])
_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in LEET.items():
    _LEET[ord(_a)] = ord(_b)
_MASKED = _LEET != _bytes
_JOINT = np.isin(_bytes, [ord(c) for c in "*._-"])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Tokens:
    """Runs of letters of some texts, lower-cased, as hashes of the word and of its beginnings."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = _LETTER[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)
        prefix = Prefix(data, "byte")
        size = self.end - self.start
        self.hashes = [prefix.of(self.start, self.end)]
        for n in BEGINNINGS:
            long = size > n
            h = np.zeros(len(size), np.uint64)
            h[long] = prefix.of(self.start[long], self.start[long] + n) ^ np.uint64(n)
            self.hashes.append(h)


_SECOND = None


def _second_person() -> np.ndarray:
    global _SECOND
    if _SECOND is None:
        data, offsets = text_bytes(pa.array(SECOND_PERSON))
        _SECOND = np.sort(Prefix(data, "byte").of(offsets[:-1], offsets[1:]))
    return _SECOND


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places in a sorted table, -1 where absent; a bitmap spares most searches."""
    out = np.full(len(keys), -1, np.int64)
    if not len(table):
        return out
    seen = np.zeros(1 << 18, bool)
    seen[(table >> np.uint64(46)).astype(np.int64)] = True
    likely = np.flatnonzero(seen[(keys >> np.uint64(46)).astype(np.int64)])
    at = np.minimum(np.searchsorted(table, keys[likely]), len(table) - 1)
    hit = table[at] == keys[likely]
    out[likely[hit]] = at[hit]
    return out


@dataclass(frozen=True)
class Lexicon:
    """Sorted hashes and the log odds of each."""

    hashes: np.ndarray
    weights: np.ndarray

    def weigh(self, tokens: Tokens) -> np.ndarray:
        weight = np.zeros(len(tokens.start))
        for h in tokens.hashes:
            at = _find(self.hashes, h)
            hit = at >= 0
            weight[hit] = np.maximum(weight[hit], self.weights[at[hit]])
        return weight


def _sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _unmasked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with signs between letters read as letters or left out, their offsets, and which bytes were so."""
    letter = _ASCII_LETTER[data] | (data >= 128)
    soft = letter | _MASKED[data]
    between = np.zeros(len(data), bool)
    between[1:-1] = soft[:-2] & soft[2:] & (letter[:-2] | letter[2:])
    masked = between & _MASKED[data]
    joint = np.zeros(len(data), bool)
    joint[1:-1] = _JOINT[data[1:-1]] & letter[:-2] & letter[2:]
    out = np.where(masked, _LEET[data], data)[~joint]
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~joint, out=kept[1:])
    return out, kept[offsets], masked | joint


def describe(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Rows x FEATURES; an empty text is all zero."""
    n_rows = len(offsets) - 1
    length = np.maximum(np.diff(offsets), 1)
    lower = _LOWER[data]
    tokens = Tokens(lower, offsets)
    words = np.diff(tokens.first)
    per = np.maximum(words, 1)
    weight = lexicon.weigh(tokens)
    out = np.zeros((n_rows, len(FEATURES)))
    for k, tier in enumerate(TIERS):
        hits = _sum(weight >= tier, tokens.first)
        out[:, k], out[:, 3 + k] = hits, hits / per
    out[:, 6] = _sum(weight, tokens.first)
    out[:, 7] = out[:, 6] / per
    some = words > 0
    if some.any():
        out[some, 8] = np.maximum.reduceat(weight, tokens.first[:-1][some])
    row = owners(tokens.first)
    second = np.flatnonzero(_find(_second_person(), tokens.hashes[0]) >= 0)
    hit = np.flatnonzero(weight >= TIERS[1])
    if len(second) and len(hit):
        near = np.zeros(len(hit), bool)
        at = np.searchsorted(second, hit)
        for side in (np.maximum(at - 1, 0), np.minimum(at, len(second) - 1)):
            near |= (np.abs(second[side] - hit) <= 5) & (row[second[side]] == row[hit])
        out[:, 9] = np.bincount(row[hit[near]], minlength=n_rows)
    out[:, 10] = np.bincount(row[second], minlength=n_rows) / per
    upper = _UPPER[data]
    letters = np.maximum(_sum(_ASCII_LETTER[data], offsets), 1)
    out[:, 11] = _sum(upper, offsets) / letters
    size = tokens.end - tokens.start
    caps = np.zeros(len(data) + 1, np.int64)
    np.cumsum(upper, out=caps[1:])
    out[:, 12] = _sum((caps[tokens.end] - caps[tokens.start] == size) & (size > 2), tokens.first) / per
    out[:, 13] = _sum(data == 33, offsets) / length
    out[:, 14] = _sum(data == 63, offsets) / length
    out[:, 15] = _sum(_SIGN[data], offsets) / length
    plain, own, changed = _unmasked(lower, offsets)
    out[:, 16] = _sum(changed, offsets) / per
    if changed.any():
        dirty = np.flatnonzero(_sum(changed, offsets) > 0)
        bare = Tokens(plain, own)
        out[dirty, 17] = np.maximum(_sum(lexicon.weigh(bare) >= TIERS[1], bare.first) - out[:, 1], 0)[dirty]
    stretch = np.zeros(len(data), bool)
    if len(data) > 2:
        stretch[2:] = (lower[2:] == lower[1:-1]) & (lower[1:-1] == lower[:-2]) & _ASCII_LETTER[data[2:]]
    out[:, 18] = _sum(stretch, offsets) / per
    out[:, 19] = np.log1p(words)
    return out


class BoostedTrees:
    """Logistic gradient boosting with histograms of at most `bins` quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 2.0, ridge: float = 2.0):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else c for c in x.T]
        codes = np.stack([np.searchsorted(cut, c, "left") for cut, c in zip(self.cuts, x.T, strict=True)], 1)
        mean = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
        self.base, self.trees, self.depth = float(np.log(mean / (1 - mean))), [], depth
        margin = np.full(len(y), self.base)
        width = bins + 1
        flat = codes + np.arange(x.shape[1]) * width
        for _ in range(rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.full(2**depth - 1, -1), np.zeros(2**depth - 1, int)
            node = np.zeros(len(y), int)
            for level in range(depth):
                first, n = 2**level - 1, 2**level
                key = ((node - first)[:, None] * (x.shape[1] * width) + flat).ravel()
                shape = (n, x.shape[1], width)
                hist_g = np.bincount(key, np.repeat(g, x.shape[1]), n * x.shape[1] * width).reshape(shape).cumsum(2)
                hist_h = np.bincount(key, np.repeat(h, x.shape[1]), n * x.shape[1] * width).reshape(shape).cumsum(2)
                total_g, total_h = hist_g[:, :, -1:], hist_h[:, :, -1:]
                rest_g, rest_h = total_g - hist_g, total_h - hist_h
                gain = hist_g**2 / (hist_h + ridge) + rest_g**2 / (rest_h + ridge) - total_g**2 / (total_h + ridge)
                gain[(hist_h < least) | (rest_h < least)] = 0
                best = gain.reshape(n, -1).argmax(1)
                good = gain.reshape(n, -1)[np.arange(n), best] > 1e-9
                feature[first : first + n] = np.where(good, best // width, -1)
                cut[first : first + n] = best % width
                f, c = feature[node], cut[node]
                right = (f < 0) | (codes[np.arange(len(y)), f] > c)
                node = 2 * node + 1 + right
            leaf = node - (2**depth - 1)
            value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
            margin += value[leaf]
            self.trees.append((feature, cut, value))

    def margins(self, x: np.ndarray) -> np.ndarray:
        codes = np.stack([np.searchsorted(cut, c, "left") for cut, c in zip(self.cuts, x.T, strict=True)], 1)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[node]
                node = 2 * node + 1 + ((f < 0) | (codes[rows, f] > cut[node]))
            out += value[node - (2**self.depth - 1)]
        return out


class Isotonic:
    """Least-squares fit of a rising step function (pool adjacent violators), read with interpolation."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        order = np.argsort(x, kind="stable")
        sums: list[list[float]] = []
        for a, b in zip(x[order], y[order], strict=True):
            sums.append([a, b, 1.0])
            while len(sums) > 1 and sums[-2][1] * sums[-1][2] >= sums[-1][1] * sums[-2][2]:
                a2, b2, n2 = sums.pop()
                sums[-1] = [(sums[-1][0] * sums[-1][2] + a2 * n2) / (sums[-1][2] + n2), sums[-1][1] + b2, sums[-1][2] + n2]
        self.x = np.array([s[0] for s in sums])
        #: Each block counts one more case of its opposite halves, so that no score is quite 0 or 1.
        self.y = np.maximum.accumulate(np.array([(s[1] + 0.05) / (s[2] + 0.1) for s in sums]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y) if len(self.x) else np.zeros(len(x))


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    trees: BoostedTrees
    scale: Isotonic

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        margins = self.trees.margins(describe(data, offsets, self.lexicon))
        #: The slope keeps the order of the trees within a step of the isotonic fit.
        return np.clip(0.999 * self.scale(margins) + 0.001 / (1 + np.exp(-margins)), 0.0, 1.0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold each word or beginning, by half and label."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        kind = batch.column("half").to_numpy(zero_copy_only=False) * 2 + batch.column("label").to_numpy(zero_copy_only=False)
        for i, j in row_slices(offsets):
            tokens = Tokens(_LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i])
            row = owners(tokens.first).astype(np.uint64)
            keys, rows = [], []
            for h in tokens.hashes:
                some = h != 0
                _, one = np.unique(h[some] ^ (row[some] * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
                keys.append(h[some][one])
                rows.append(row[some][one])
            keys, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.bincount(inverse * 4 + kind[i:j][np.concatenate(rows).astype(np.int64)], minlength=4 * len(keys)).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(count[:, k]) for k in range(4))], names=["h", "neg0", "pos0", "neg1", "pos1"])


def _lexicon(rows: list, halves: tuple[int, ...], totals: np.ndarray) -> Lexicon:
    if not rows:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    h = np.array([r.h for r in rows], np.int64).view(np.uint64)
    neg = sum(np.array([r[f"neg{k}"] for r in rows], float) for k in halves)
    pos = sum(np.array([r[f"pos{k}"] for r in rows], float) for k in halves)
    n_neg, n_pos = sum(totals[2 * k] for k in halves), sum(totals[2 * k + 1] for k in halves)
    weight = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    keep = (pos >= max(SUPPORT, SUPPORT_SHARE * n_pos)) & (weight >= TIERS[0])
    order = np.argsort(h[keep])
    return Lexicon(h[keep][order], weight[keep][order])


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """From `labels` (doc_id, toxic) and the texts of `docs`; at most `train_rows` labelled ids, picked by hash.

    Rows without id or label are left out; of several labels of an id the largest counts,
    of several texts of an id the smallest, so that repeated ids do not enlarge the sample.
    """
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    picked = picked.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int"))
    sample = written(sample, "toxicity-sample")
    counts = {(r.half, r.label): r["count"] for r in sample.groupBy("half", "label").count().collect()}
    totals = np.array([counts.get((k // 2, k % 2), 0) for k in range(4)], float)
    n_pos, n_neg = max(1.0, totals[1] + totals[3]), max(1.0, totals[0] + totals[2])
    grouped = sample.select("text", "half", "label").mapInArrow(lean(_counted), "h long, neg0 long, pos0 long, neg1 long, pos1 long").groupBy("h").agg(*(F.sum(c).alias(c) for c in ("neg0", "pos0", "neg1", "pos1")))
    odds = F.log((F.expr("pos0 + pos1") + 0.5) / n_pos) - F.log((F.expr("neg0 + neg1") + 0.5) / n_neg)
    rows = grouped.filter(F.expr("pos0 + pos1") >= max(SUPPORT, SUPPORT_SHARE * n_pos)).withColumn("odds", odds).filter(F.col("odds") >= TIERS[0]).select("h", "neg0", "pos0", "neg1", "pos1").collect()
    whole, crossed = _lexicon(rows, (0, 1), totals), [_lexicon(rows, (1,), totals), _lexicon(rows, (0,), totals)]

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            half = batch.column("half").to_numpy(zero_copy_only=False)
            x = np.zeros((batch.num_rows, len(FEATURES)))
            for i, j in row_slices(offsets):
                both = [describe(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], c) for c in crossed]
                x[i:j] = np.where(half[i:j, None] == 0, both[0], both[1])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), lists], names=["doc_id", "label", "x"])

    table = sample.mapInArrow(lean(described), "doc_id long, label int, x array<double>").orderBy("doc_id").toArrow()
    forget(sample)
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    y = table.column("label").to_numpy().astype(float)
    part = np.arange(len(y)) % 5
    margins = np.zeros(len(y))
    for k in range(5):
        if (part == k).any():
            margins[part == k] = BoostedTrees(x[part != k], y[part != k]).margins(x[part == k])
    return ToxicityModel(whole, BoostedTrees(x, y), Isotonic(margins, y))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. An empty or null text is scored as no words."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            values = [model.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in row_slices(offsets)]
            values = np.concatenate(values) if values else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(values), pa.array((values >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(scored), "doc_id long, held_out boolean, score double, predicted int")


def held_out(doc_id):
    """Rows whose labels are never learnt: a quarter, by the checksum of the id."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels that are not held out and score every row of `docs`.

    A null doc_id is not held out. Repeated rows are scored alike. Other columns
    are ignored; without labels every score is near 0; no rows give no rows.
    """
    return score(docs, fit(docs, labels.filter(~held_out(F.col("doc_id")))))
