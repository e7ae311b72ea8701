"""Repeated word windows, found by backward search in a compressed FM-index per shard.

A window that occurs in two documents has the same anchor in both (the smallest
fingerprint of a word k-gram inside it). The steps:

1. one scan counts k-grams by cells, another emits the anchors of all windows of
   `window` words (about one per 22); frequent k-grams are anchors of last resort, so
   that a common line does not gather all the texts around it;
2. a pre-aggregated minimum and maximum of the document keeps anchors that occur
   in two documents or more;
3. equal contexts (the words that the windows of an anchor cover) collapse to one row
   with its smallest document, so copies, however many, are one row: later documents
   lose the whole context. Only anchors with several different contexts go on; where an
   anchor has more of them than a shard should take, its windows get other anchors;
4. anchors are dealt to shards of bounded size. The contexts of an anchor are numbered
   by document, and for each bit of these numbers the contexts without it are indexed
   (Burrows-Wheeler transform in a wavelet matrix with packed ranks) and those with it
   stream past: so each context meets every earlier one of its anchor. Streams go from
   right to left in lockstep, a word extends the match by one backward step, a mismatch
   first shortens it to what the nearest suffixes after that word share; where the
   matching statistic reaches `window`, its interval gives the smallest document;
5. intervals above the threshold go back to the documents, which cut them out.

Words are compared by their bytes; context and row keys are hashes of whole bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.gram_load import Levels, bounded_anchors, frequent_cells, grams_of_runs
from quillspark.llm.shared import forget, lean, row_key, shuffle_partitions, written
from quillspark.llm.text import Prefix, Words, covered, digests, owners, pieces, row_slices, text_bytes, window_anchors

WINDOW = 50
GRAM = 8
#: Distinct contexts that one anchor may have, and bytes of contexts that one shard should take.
SHARD_CONTEXTS = 8_000
SHARD_BYTES = 4 << 20
#: Windows of one stream; longer contexts are several.
STREAM_WINDOWS = 64
_LAST = (1 << 63) - 1

_ANCHOR_SCHEMA = "anchor long, span long, doc long, rid binary, start int, windows int"


class WaveletMatrix:
    """Ranks of symbols over a sequence: one packed bit vector with block counts per bit."""

    def __init__(self, values: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(values), bits, []
        for b in range(bits - 1, -1, -1):
            bit = (values >> b) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            padded = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            padded[: len(packed)] = packed
            words = padded.view(np.uint64)
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            zeros = self.n - int(before[-1])
            self.levels.append((words, before, zeros))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def places(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the first `ends` elements that equal the symbol end in the last arrangement; the difference of two such places counts symbols."""
        at = ends
        for b, (words, before, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            block = at >> 6
            ones = before[block] + np.bitwise_count(words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbols >> b & 1, zeros + ones, at - ones)
        return at

    def ranks(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its end."""
        return self.places(symbols, ends) - self.places(symbols, np.zeros(len(ends), np.int64))


class Minima:
    """Smallest of any range of small numbers, from the smallest of all ranges of 1, 2, 4, ... of them."""

    def __init__(self, values: np.ndarray):
        self.levels = np.zeros((max(1, len(values).bit_length()), len(values)), values.dtype)
        self.levels[0] = values
        for k in range(1, len(self.levels)):
            half = 1 << k - 1
            self.levels[k] = self.levels[k - 1]
            self.levels[k, :-half] = np.minimum(self.levels[k - 1, :-half], self.levels[k - 1, half:])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of first..last, both included; first must not be larger."""
        k = np.frexp(last - first + 1)[1] - 1
        return np.minimum(self.levels[k, first], self.levels[k, last - (1 << k) + 1])


class FMIndex:
    """Over texts of symbols from 1 up, each closed by a separator; matches are followed up to `window` symbols.

    It keeps the transform as a wavelet matrix, symbol counts, where each symbol occurs in
    the transform, the capped lengths that neighbouring suffixes share (a byte each, and
    their range minima), and the smallest value of the texts in each interval of `window`
    symbols; neither the texts nor the suffix array.
    """

    def __init__(self, codes: np.ndarray, first: np.ndarray, window: int, values: np.ndarray):
        rows = owners(first)
        n = len(codes) + len(first) - 1
        text = np.zeros(n, np.int64)
        text[np.arange(len(codes)) + rows] = codes
        order = self._suffixes(text, window + 1)
        self.window, self.largest = window, int(text.max(initial=0))
        transform = text[order - 1]
        self.bwt = WaveletMatrix(transform, max(1, self.largest.bit_length()))
        self.smaller = np.zeros(self.largest + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=self.largest + 1), out=self.smaller[1:])
        every = np.arange(self.largest + 1)
        #: A backward step is this and the place of the symbol in the wavelet matrix.
        self.shift = self.smaller[:-1] - self.bwt.places(every, np.zeros(len(every), np.int64))
        self.occurs = np.argsort(transform, kind="stable").astype(np.int32)
        shared = self._shared(text, order, window)
        self.shared = Minima(shared)
        self.heads = np.flatnonzero(shared[:-1] < window)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first) + 1)
        self.least = np.minimum.reduceat(values[owner[order]], self.heads)

    @staticmethod
    def _suffixes(text: np.ndarray, depth: int) -> np.ndarray:
        """Rotations in the order of their first `depth` symbols or more, by rank doubling; a backward step over shorter matches needs no more."""
        rank, reach, n = text, 1, len(text)
        order = np.argsort(rank)
        while reach < depth:
            key = rank * (int(rank.max()) + 1) + np.roll(rank, -reach)
            order = np.argsort(key)
            ordered = key[order]
            new = np.ones(n, bool)
            new[1:] = ordered[1:] != ordered[:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            reach *= 2
            if new.all():
                break
        return order

    @staticmethod
    def _shared(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
        """How many symbols each suffix shares with the one before it, up to `most` and not past a separator; 0 at both ends."""
        shared = np.zeros(len(order) + 1, np.uint8 if most < 256 else np.int32)
        ring = np.resize(text, len(text) + most)
        live = np.arange(1, len(order))
        for k in range(most):
            symbol = ring[order[live] + k]
            live = live[(symbol == ring[order[live - 1] + k]) & (symbol > 0)]
            if not len(live):
                break
            shared[live] += 1
        return shared

    def back(self, symbol: np.ndarray, row: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step of matches, each given by a suffix that starts with it and its length.

        Of the suffixes after the symbol, the nearest ones above and below the match share
        most with it: what they share is kept, the rest of the match is cut off. Symbols
        that the index does not hold give matches of length 0.
        """
        symbol = np.where(symbol <= self.largest, symbol, 0)
        begin, end = self.smaller[symbol], self.smaller[symbol + 1]
        step = self.bwt.places(symbol, row) + self.shift[symbol]
        below, above = (step < end) & (symbol > 0), (step > begin) & (symbol > 0)
        kept = np.full((2, len(row)), -1)
        at = self.occurs[step[below]].astype(np.int64)
        same = at == row[below]
        kept[0, below] = np.where(same, length[below], np.minimum(length[below], self.shared.of(np.minimum(row[below] + 1, at + same), at + same)))
        at = self.occurs[step[above] - 1].astype(np.int64)
        kept[1, above] = np.minimum(length[above], self.shared.of(at + 1, row[above]))
        best = kept.max(0)
        return np.where(best < 0, 0, np.where(kept[0] == best, step, step - 1)), np.minimum(best + 1, self.window)

    def stream(self, codes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of some texts in lockstep, from right to left: yields (texts, places, lengths capped at `window`, a suffix that matches)."""
        size = np.diff(first)
        texts = np.arange(len(size))
        row, length = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for step in range(1, int(size.max(initial=0)) + 1):
            live = size[texts] >= step
            if not live.all():
                texts, row, length = texts[live], row[live], length[live]
            place = size[texts] - step
            row, length = self.back(codes[first[texts] + place], row, length)
            yield texts, place, length, row

    def holders(self, row: np.ndarray) -> np.ndarray:
        """The smallest value of the texts that hold the first `window` symbols of a suffix."""
        return self.least[np.searchsorted(self.heads, row, "right") - 1]


def _anchors(window: int, k: int, levels: Levels, crowded: np.ndarray | None = None):
    """Anchors of all windows; with `crowded`, counts of the k-grams in the windows of those anchors instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in row_slices(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                joined, start, end = words.joined() if crowded is None else (None, None, None)
                for hashes, rows_first, r, w in words.parts(window):
                    grams = Prefix(hashes, "word").grams(k)
                    row, place, first, n, _ = window_anchors(grams, rows_first, window, k, levels(grams))
                    if not len(row):
                        continue
                    if crowded is not None:
                        yield grams_of_runs(grams, place, first, n, window - k + 1, crowded)
                        continue
                    begin, row = first + w, pa.array(row + i + r)
                    span = digests(joined, start[begin], end[begin + n + window - 2])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(grams[place].view(np.int64)), pa.array(span.view(np.int64)), batch.column("doc").take(row), batch.column("rid").take(row), pa.array((begin - words.first[row.to_numpy() - i]).astype(np.int32)), pa.array(n.astype(np.int32))],
                        names=["anchor", "span", "doc", "rid", "start", "windows"],
                    )

    return run


def _contexts(window: int):
    """The words of the picked contexts, with one space after each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            picks = batch.column("picks")
            head = np.asarray(picks.offsets) - picks.offsets[0].as_py()
            flat = picks.flatten()
            start, windows = flat.field("start").to_numpy(), flat.field("windows").to_numpy()
            for i, j in row_slices(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                joined, word_start, word_end = words.joined()
                begin = words.first[:-1][owners(head[i : j + 1])] + start[head[i] : head[j]]
                a, z = word_start[begin], word_end[begin + windows[head[i] : head[j]] + window - 2] + 1
                for k, m in row_slices(np.concatenate([[0], np.cumsum(z - a)])):
                    some = flat.slice(int(head[i]) + k, m - k)
                    cut = np.concatenate([[0], np.cumsum(z[k:m] - a[k:m])])
                    index = np.arange(cut[-1]) + np.repeat(a[k:m] - cut[:-1], z[k:m] - a[k:m])
                    content = pa.Array.from_buffers(pa.large_binary(), m - k, [None, pa.py_buffer(cut), pa.py_buffer(joined[index])]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([*(some.field(c) for c in ("anchor", "span", "windows", "doc")), content], names=["anchor", "span", "windows", "doc", "content"])

    return run


def repeats_of_earlier(codes: np.ndarray, first: np.ndarray, anchor: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """For each window of some contexts (windows of one after those of the other): whether a context with the same anchor and a smaller document holds it."""
    windows = np.diff(first) - window + 1
    cut = np.concatenate([[0], np.cumsum(windows)])
    out = np.zeros(cut[-1], bool)
    order = np.lexsort((doc, anchor))
    head = np.ones(len(order), bool)
    head[1:] = anchor[order][1:] != anchor[order][:-1]
    begin = np.flatnonzero(head)
    many = np.diff(np.append(begin, len(order)))
    number, held = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    number[order] = np.arange(len(order)) - np.repeat(begin, many)
    held[order] = np.repeat(many, many)
    for bit in range(int(held.max(initial=1) - 1).bit_length()):
        asked = np.flatnonzero(number >> bit & 1)
        known = np.flatnonzero((number >> bit & 1 == 0) & (((number >> bit) + 1) << bit < held))
        index = FMIndex(*_picked(codes, first, known, np.zeros(len(known), np.int64), first[known + 1] - first[known]), window, doc[known])
        parts = -(-windows[asked] // STREAM_WINDOWS)
        text = np.repeat(asked, parts)
        begin = STREAM_WINDOWS * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        size = np.minimum(STREAM_WINDOWS, windows[text] - begin) + window - 1
        for texts, places, lengths, row in index.stream(*_picked(codes, first, text, begin, size)):
            whole = np.flatnonzero(lengths == window)
            texts, places = texts[whole], places[whole]
            earlier = index.holders(row[whole]) < doc[text[texts]]
            out[cut[text[texts]] + begin[texts] + places] |= earlier
    return out


def _picked(codes: np.ndarray, first: np.ndarray, text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.concatenate([[0], np.cumsum(size)])
    return codes[np.arange(cut[-1]) + np.repeat(first[text] + begin - cut[:-1], size)], cut


def _searched_shard(window: int):
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        data, offsets = binary_bytes(shard.column("content"))
        words = Words(data, offsets)
        codes = pieces(data, words.start, words.end).dictionary_encode().indices.to_numpy().astype(np.int64) + 1
        hit = repeats_of_earlier(codes, words.first, shard.column("anchor").to_numpy(), shard.column("doc").to_numpy(), window)
        windows = shard.column("windows").to_numpy().astype(np.int64)
        return runs_of(shard, hit, np.concatenate([[0], np.cumsum(windows)]))

    return run


def runs_of(shard: pa.Table, hit: np.ndarray, cut: np.ndarray) -> pa.Table:
    """Runs of marked windows of each context, whose windows are cut[i]:cut[i + 1]."""
    row = owners(cut)
    before, after = np.zeros(len(hit), bool), np.zeros(len(hit), bool)
    before[1:] = hit[:-1] & (row[1:] == row[:-1])
    after[:-1] = hit[1:] & (row[1:] == row[:-1])
    begins, ends = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
    at = row[begins]
    return pa.table({"anchor": shard.column("anchor").take(pa.array(at)), "span": shard.column("span").take(pa.array(at)), "run_start": pa.array((begins - cut[at]).astype(np.int32)), "run_end": pa.array((ends - cut[at]).astype(np.int32))})


def binary_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks().cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def earlier_ranges(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """Ranges (rid, ranges array<struct<start, end>>) of words that a window of an earlier document covers.

    `rows` has doc (long, the order), rid (binary, the row's key) and text.
    """
    marks = frequent_cells(rows, lambda data, offsets: Prefix(Words(data, offsets).hashes(), "word").grams(gram))
    anchors, shared = bounded_anchors(
        lambda late: written(rows.mapInArrow(lean(_anchors(window, gram, Levels(marks, late))), _ANCHOR_SCHEMA), "fm-anchors"),
        #: Written, so that the join below stands on plain exchanges and Spark can split a hot anchor among tasks.
        lambda anchors: written(anchors.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high").select("anchor", "n"), "fm-shared"),
        lambda late, crowded: rows.mapInArrow(lean(_anchors(window, gram, Levels(marks, late), crowded)), "gram long, n long"),
        shard_contexts,
    )
    #: Rows that share rid are one row. Grouped without the anchor, so that the shuffle after the join stays and the join may be split.
    found = written(anchors.join(shared, "anchor", "left_semi").groupBy("rid", "doc", "start", "span", "windows").agg(F.min("anchor").alias("anchor")), "fm-candidates")
    forget(anchors, shared)
    distinct = written(found.groupBy("anchor", "span").agg(F.min(F.struct("doc", "rid", "start", "windows")).alias("one")).select("anchor", "span", "one.*"), "fm-distinct")
    several = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    picks = distinct.join(several, "anchor", "left_semi").groupBy("rid").agg(F.collect_list(F.struct("anchor", "span", "start", "windows", "doc")).alias("picks"))
    contexts = written(
        rows.join(picks, "rid").dropDuplicates(["rid"]).select("text", "picks").mapInArrow(lean(_contexts(window)), "anchor long, span long, windows int, doc long, content binary"),
        "fm-contexts",
    )
    volume = contexts.agg(F.sum(F.length("content"))).first()[0] or 0
    shards = max(shuffle_partitions(rows.sparkSession), volume // SHARD_BYTES)
    runs = contexts.withColumn("shard", F.pmod("anchor", F.lit(shards))).groupBy("shard").applyInArrow(_searched_shard(window), "anchor long, span long, run_start int, run_end int")
    runs = runs.groupBy("anchor", "span").agg(F.collect_list(F.struct("run_start", "run_end")).alias("runs"))
    known = written(distinct.select("anchor", "span", F.col("doc").alias("low")).join(runs, ["anchor", "span"], "left"), "fm-runs")
    forget(contexts, distinct)
    #: A later document than the context's first loses it whole, the first what still earlier ones hold.
    whole = F.array(F.struct(F.lit(0).alias("run_start"), F.col("windows").alias("run_end")))
    hits = found.join(known, ["anchor", "span"]).withColumn("runs", F.when(F.col("doc") > F.col("low"), whole).otherwise(F.col("runs"))).filter("runs IS NOT NULL")
    hits = hits.select("rid", F.expr(f"transform(runs, r -> struct(start + r.run_start AS start, start + r.run_end + {window - 1} AS end))").alias("ranges"))
    ranges = written(hits.groupBy("rid").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "fm-ranges")
    forget(found, known)
    return ranges


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        ranges = batch.column("ranges")
        n_words, n_removed, digests = [], [], []
        for i, j in row_slices(offsets):
            words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            keep = np.ones(len(words.start), bool)
            for r in range(i, j):
                if ranges[r].is_valid and len(ranges[r].values):
                    a, b = words.first[r - i], words.first[r - i + 1]
                    flat = ranges[r].values
                    keep[a:b] = ~covered(flat.field("start").to_numpy(), flat.field("end").to_numpy(), b - a)
            left = np.zeros(len(keep) + 1, np.int64)
            np.cumsum(keep, out=left[1:])
            left = left[words.first]
            start, end = words.start[keep], words.end[keep]
            size = end - start + 1
            to = np.zeros(len(size) + 1, np.int64)
            np.cumsum(size, out=to[1:])
            joined = np.full(to[-1], 0x20, np.uint8)
            at = np.ones(to[-1], bool)
            at[to[1:] - 1] = False
            source = np.arange(to[-1]) + np.repeat(start - to[:-1], size)
            joined[at] = words.data[source[at]]
            for r in range(j - i):
                a, b = to[left[r]], to[left[r + 1]]
                digests.append(hashlib.sha256(joined[a : max(a, b - 1)].tobytes()).hexdigest())
            n_words.append(np.diff(words.first))
            n_removed.append(np.diff(words.first) - np.diff(left))
        empty = [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(n_words or empty)), pa.array(np.concatenate(n_removed or empty)), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, the order `doc` and a row key; rows that agree in id and text share a key and have the same result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.withColumn("doc", F.coalesce("doc_id", F.lit(_LAST))).withColumn("rid", row_key())


def dedup_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256.

    Words are runs of bytes other than ASCII white space. Removed is each word
    covered by `window` consecutive words that also start in a row with a smaller
    doc_id. A null text has no words; a null doc_id counts as larger than all.
    Rows with one doc_id do not remove each other's words. Texts of fewer than
    `window` words stay whole. Other columns are ignored; no rows give no rows.
    """
    rows = keyed(docs)
    ranges = earlier_ranges(rows.select("doc", "rid", "text"), window, gram)
    return rows.select("doc_id", "text", "rid").join(ranges, "rid", "left").select("doc_id", "text", "ranges").mapInArrow(lean(_cut), "doc_id long, n_words long, n_removed long, kept_sha256 string")
