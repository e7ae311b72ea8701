"""Chroma fingerprints of audio columns, and recordings aligned by them.

A recording is mono 16-bit PCM. Frames become twelve pitch classes; an integral
image over (time, pitch class) gives the sums of rectangles, sixteen filters compare
such sums, and each is quantized to two bits (Gray code): one 32-bit integer per
frame. Recordings with equal fingerprints form a class.

The queries of a search are a stated set of recordings. Their fingerprints go to
the tasks in blocks of about `BLOCK_PRINTS` integers, each an inverted index over the
16-bit halves, one block after the other; all classes stream past each. Hits vote for an offset, the best offset of each
pair is confirmed by the share of differing bits over the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import lean, written

RATE, FRAME, HOP = 4_000, 1_024, 512
#: Frames that one integer looks at.
SPAN = 16
LOWEST_HZ, HIGHEST_HZ = 100.0, 1_800.0
MAX_BIT_ERROR = 0.15
#: A match overlaps by so many integers at least, and needs so many votes to be confirmed.
MIN_OVERLAP, MIN_VOTES = 16, 2
#: Integers of the queries that are held at once; a longer recording is a block of its own.
BLOCK_PRINTS = 250_000
#: Hits that a task expands at once.
_HITS = 2_000_000

NOTE_SAMPLES = 512


def _filters() -> list[tuple[int, int, int, int, int]]:
    """(kind, first pitch class, pitch classes, first frame, frames) by rule: five shapes at growing widths."""
    out = []
    for k in range(16):
        kind = k % 5
        width = (4, 8, 12, 16)[k % 4]
        height = (2, 3, 4, 6)[k // 4]
        out.append((kind, (5 * k) % (13 - height), height, (SPAN - width) // 2, width))
    return out


FILTERS = _filters()
_CUTS = np.array([-0.35, 0.0, 0.35])
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Recordings x frames x 12, each frame scaled to length one; `samples` is recordings x samples."""
    n = (samples.shape[1] - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((len(samples), 0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME, axis=1)[:, ::HOP][:, :n]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=2)) ** 2
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    used = (hz >= LOWEST_HZ) & (hz <= HIGHEST_HZ)
    pitch = np.rint(12 * np.log2(np.where(used, hz, 440.0) / 440.0)).astype(int) % 12
    fold = np.zeros((len(hz), 12))
    fold[np.flatnonzero(used), pitch[used]] = 1
    out = power @ fold
    size = np.sqrt((out**2).sum(2, keepdims=True))
    return np.where(size > 1e-6, out / np.maximum(size, 1e-6), 0.0)


def fingerprints(features: np.ndarray) -> np.ndarray:
    """Recordings x integers (uint32) of chroma features."""
    n = features.shape[1] - SPAN + 1
    if n <= 0:
        return np.zeros((len(features), 0), np.uint32)
    image = np.zeros((len(features), features.shape[1] + 1, 13))
    image[:, 1:, 1:] = features.cumsum(1).cumsum(2)
    t = np.arange(n)

    def area(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        return image[:, t + x1, y1] - image[:, t + x0, y1] - image[:, t + x1, y0] + image[:, t + x0, y0]

    out = np.zeros((len(features), n), np.uint32)
    for kind, y, h, x, w in FILTERS:
        whole = area(x, x + w, y, y + h)
        if kind == 0:
            a = whole
            b = area(x, x + w, 0, 12) * (h / 12)
        elif kind == 1:
            a, b = area(x, x + w // 2, y, y + h), area(x + w // 2, x + w, y, y + h)
        elif kind == 2:
            a, b = area(x, x + w, y, y + h // 2), area(x, x + w, y + h // 2, y + h)
        elif kind == 3:
            a = area(x, x + w // 2, y, y + h // 2) + area(x + w // 2, x + w, y + h // 2, y + h)
            b = whole - a
        else:
            a = 2 * area(x + w // 4, x + w // 4 + w // 2, y, y + h)
            b = whole - a / 2
            b = 2 * b
        value = np.log((1 + a) / (1 + b))
        out = (out << np.uint32(2)) | _GRAY[np.searchsorted(_CUTS, value)]
    return out


def sonified(vectors: np.ndarray) -> np.ndarray:
    """PCM of vectors (rows x any size): each value is a note, its pitch in semitones from the value.

    It stands in for an audio column where the tables have none.
    """
    v = np.nan_to_num(vectors.astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    pitch = np.rint(18 * np.tanh(4 * v))
    hz = 440.0 * 2 ** (pitch / 12)
    step = np.repeat(hz / RATE, NOTE_SAMPLES, axis=1)
    return np.rint(12_000 * np.sin(2 * np.pi * np.cumsum(step, axis=1))).astype(np.int16)


def recordings(embeddings: DataFrame) -> DataFrame:
    """(media_id, pcm) from (vec_id, embedding). A null or empty vector is an empty recording."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                rows = [np.array([x or 0.0 for x in v], float) if v else np.zeros(0) for v in part.column(1).to_pylist()]
                pcm: list[bytes] = [b""] * len(rows)
                for size in {len(r) for r in rows if len(r)}:
                    same = [k for k, r in enumerate(rows) if len(r) == size]
                    for k, sound in zip(same, sonified(np.stack([rows[k] for k in same])), strict=True):
                        pcm[k] = sound.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pcm, pa.binary())], names=["media_id", "pcm"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("media_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.mapInArrow(lean(run), "media_id long, pcm binary")


def fingerprinted(media: DataFrame) -> DataFrame:
    """(media_id, prints array<int>) from (media_id, pcm). Recordings shorter than one integer have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                sounds = [np.frombuffer((b or b"")[: len(b or b"") // 2 * 2], "<i2") for b in part.column(1).to_pylist()]
                prints: list[np.ndarray] = [np.zeros(0, np.int32)] * len(sounds)
                for size in {len(s) for s in sounds}:
                    same = [k for k, s in enumerate(sounds) if len(s) == size]
                    made = fingerprints(chroma(np.stack([sounds[k] for k in same]).astype(np.float32) / 32_768))
                    for k, row in zip(same, made, strict=True):
                        prints[k] = row.view(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.list_(pa.int32()))], names=["media_id", "prints"])

    return media.select(F.col("media_id").cast("long").alias("media_id"), "pcm").mapInArrow(lean(run), "media_id long, prints array<int>")


class Block:
    """An inverted index over the fingerprints of some queries."""

    def __init__(self, ids: list[int], prints: list[np.ndarray]):
        self.ids = np.array(ids, np.int64)
        self.first = np.zeros(len(prints) + 1, np.int64)
        np.cumsum([len(p) for p in prints], out=self.first[1:])
        self.prints = np.concatenate([*prints, np.zeros(0, np.uint32)]).astype(np.uint32)
        query = np.repeat(np.arange(len(prints)), np.diff(self.first))
        place = np.arange(len(self.prints)) - self.first[:-1][query]
        self.halves = []
        for shift in (0, 16):
            half = ((self.prints >> np.uint32(shift)) & np.uint32(0xFFFF)).astype(np.int64)
            order = np.argsort(half, kind="stable")
            self.halves.append((shift, np.searchsorted(half[order], np.arange(65_537)), query[order], place[order]))

    def search(self, prints: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(recording, query, offset, votes, bit error) of confirmed matches; offset is the place in the recording less that in the query."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        place = np.arange(len(prints)) - first[:-1][row]
        count = np.zeros(len(prints), np.int64)
        for shift, heads, _, _ in self.halves:
            half = ((prints >> np.uint32(shift)) & np.uint32(0xFFFF)).astype(np.int64)
            count += heads[half + 1] - heads[half]
        work = np.concatenate([[0], np.cumsum(count)])[first]
        i = 0
        while i < len(first) - 1:
            j = max(i + 1, int(np.searchsorted(work, work[i] + _HITS, "right")) - 1)
            a, b = first[i], first[j]
            rows, queries, offsets = [], [], []
            for shift, heads, query, query_place in self.halves:
                half = ((prints[a:b] >> np.uint32(shift)) & np.uint32(0xFFFF)).astype(np.int64)
                n = heads[half + 1] - heads[half]
                at = np.arange(n.sum()) + np.repeat(heads[half] - np.cumsum(n) + n, n)
                rows.append(np.repeat(row[a:b], n))
                queries.append(query[at])
                offsets.append(np.repeat(place[a:b], n) - query_place[at])
            yield from self._confirmed(prints, first, *(np.concatenate(x) for x in (rows, queries, offsets)))
            i = j

    def _confirmed(self, prints, first, rows, queries, offsets) -> Iterator[tuple[np.ndarray, ...]]:
        if not len(rows):
            return
        low, width = int(offsets.min()), int(offsets.max() - offsets.min()) + 1
        keys, votes = np.unique((rows * len(self.ids) + queries) * width + offsets - low, return_counts=True)
        keys, votes = keys[votes >= MIN_VOTES], votes[votes >= MIN_VOTES]
        #: Of equal votes the smallest offset wins.
        order = np.lexsort((keys, -votes, keys // width))
        keys, votes = keys[order], votes[order]
        best = np.ones(len(keys), bool)
        best[1:] = keys[1:] // width != keys[:-1] // width
        keys, votes = keys[best], votes[best]
        pair, offset = keys // width, keys % width + low
        row, query = pair // len(self.ids), pair % len(self.ids)
        n_row, n_query = np.diff(first)[row], np.diff(self.first)[query]
        begin = np.maximum(offset, 0)
        overlap = np.minimum(n_row, n_query + offset) - begin
        good = overlap >= np.minimum(MIN_OVERLAP, np.minimum(n_row, n_query))
        row, query, offset, votes, begin, overlap = (x[good] for x in (row, query, offset, votes, begin, overlap))
        step = np.arange(overlap.sum()) - np.repeat(np.cumsum(overlap) - overlap, overlap)
        mine = prints[np.repeat(first[:-1][row] + begin, overlap) + step]
        theirs = self.prints[np.repeat(self.first[:-1][query] + begin - offset, overlap) + step]
        which = np.repeat(np.arange(len(row)), overlap)
        error = np.bincount(which, np.bitwise_count(mine ^ theirs), len(row)) / np.maximum(32 * overlap, 1)
        hit = error <= MAX_BIT_ERROR
        yield row[hit], self.ids[query[hit]], offset[hit], votes[hit], error[hit]


def _searched(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            first = np.asarray(lists.offsets).astype(np.int64)
            prints = lists.flatten().to_numpy().view(np.uint32)
            for row, query, offset, votes, error in block.search(prints, first - first[0]):
                if len(row):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(query), pa.array(offset.astype(np.int32)), pa.array(votes.astype(np.int64)), pa.array(error)], names=["class_id", "query_class", "offset", "votes", "bit_error"])

    return run


def align(media: DataFrame, every: int = 100) -> DataFrame:
    """Per recording: media_id, class_id, n_prints, n_matches, matches.

    class_id is the smallest media_id with the same fingerprint. The queries are the
    recordings whose media_id is divisible by `every`; `matches` lists, for the
    recording's class, the query classes that align with it (itself too, where it is
    asked for): query_class, offset, votes, bit_error. Recordings without integers (null, empty, short) are classes of
    their own and match nothing. A null media_id is no query and counts as larger than
    all. Repeated rows share a class. Other columns are ignored; no rows give no rows.
    """
    prints = written(fingerprinted(media), "chroma-prints")
    some = prints.filter(F.size("prints") > 0).withColumn("own", F.coalesce("media_id", F.lit((1 << 63) - 1))).withColumn("print_hash", F.sha2(F.array_join(F.transform("prints", lambda x: F.hex(x)), ","), 256))
    classes = some.groupBy("print_hash").agg(F.min(F.struct("own", "prints")).alias("one"), F.max(F.coalesce(F.col("media_id") % every == 0, F.lit(False))).alias("asked"))
    classes = written(classes.select("print_hash", F.col("one.own").alias("class_id"), F.col("one.prints").alias("prints"), "asked"), "chroma-classes")
    asked = classes.filter("asked").select("class_id", "prints")
    volume = asked.agg(F.sum(F.size("prints"))).first()[0] or 0
    parts = max(1, -(-volume // BLOCK_PRINTS))
    pairs = None
    for k in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("class_id"), F.lit(parts)) == k).orderBy("class_id").toArrow()
        block = Block(rows.column("class_id").to_pylist(), [np.array(x, np.int32).view(np.uint32) for x in rows.column("prints").to_pylist()])
        found = classes.select("class_id", "prints").mapInArrow(lean(_searched(block)), "class_id long, query_class long, offset int, votes long, bit_error double")
        #: Searched before the next block is made, so that the driver holds one.
        found = written(found, "chroma-pairs") if parts > 1 else found
        pairs = found if pairs is None else pairs.unionByName(found)
    lists = pairs.groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("query_class", "offset", "votes", "bit_error"))).alias("matches"))
    members = some.select("media_id", "print_hash", F.size("prints").cast("long").alias("n_prints")).join(classes.select("print_hash", "class_id"), "print_hash")
    out = members.join(lists, "class_id", "left").select("media_id", "class_id", "n_prints", "matches")
    bare = prints.filter(F.size("prints") == 0).select("media_id", F.coalesce("media_id", F.lit((1 << 63) - 1)).alias("class_id"), F.lit(0).cast("long").alias("n_prints"), F.lit(None).cast("array<struct<query_class:bigint,offset:int,votes:bigint,bit_error:double>>").alias("matches"))
    out = out.unionByName(bare).withColumn("matches", F.coalesce("matches", F.expr("CAST(array() AS array<struct<query_class:bigint,offset:int,votes:bigint,bit_error:double>>)")))
    return out.select("media_id", "class_id", "n_prints", F.size("matches").cast("long").alias("n_matches"), "matches")
