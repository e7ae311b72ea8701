"""Repeated byte strings, found by a suffix sort with bucket-pointer refinement.

A string of `length` bytes that occurs twice has, in both places, the same
anchor: the smallest k-gram fingerprint inside it. So only places whose
anchor occurs twice anywhere can be repeats, and repeats of one string meet under
one anchor. The steps:

1. one scan counts k-grams by cells, another emits the anchors of all windows (about
   one per 69 bytes); frequent k-grams are anchors of last resort, so that a common
   line does not gather all the texts around it;
2. a pre-aggregated count keeps anchors that occur at least twice;
3. equal contexts (the bytes that the windows of an anchor cover) collapse to one
   row with a count, so a passage that a third of all documents share is one row, and
   goes whole. Only anchors with several different contexts, or at several places of
   one, are sorted; where an anchor
   has more of them than a shard should take, its windows get other anchors;
4. anchors are dealt to shards of bounded size; each shard suffix-sorts its
   contexts: buckets of `BUCKET_GRAM` bytes, in byte order, are refined by the bucket
   pointers of later offsets, and pointers that a round has renewed serve the rest of it;
5. neighbours of the suffix array that share `length` bytes are repeats; they go back to
   their documents as byte ranges.

Shards are cut by anchor. The rows of a shard are distinct contexts, so copies do
not enlarge it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.fm_dedup import binary_bytes, runs_of
from quillspark.llm.gram_load import Levels, bounded_anchors, frequent_cells, grams_of_runs
from quillspark.llm.shared import forget, lean, row_key, shuffle_partitions, written
from quillspark.llm.text import Prefix, byte_parts, covered, digests, owners, row_slices, text_bytes, window_anchors

LENGTH = 200
GRAM = 64
#: Initial buckets are of so many bytes, as one 64-bit number.
BUCKET_GRAM = 8
#: Distinct contexts that one anchor may have, and bytes of contexts that one shard should take.
SHARD_CONTEXTS = 4_000
SHARD_BYTES = 1 << 20
#: Open suffixes refined at once; the next such portion already sees their new pointers.
REFINE_AT_ONCE = 1 << 17

_ANCHOR_SCHEMA = "anchor long, span long, rid binary, start int, windows int, again boolean"


def byte_grams(data: np.ndarray) -> np.ndarray:
    """The `BUCKET_GRAM` bytes from each place as a number that sorts like them; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(BUCKET_GRAM, np.uint8)])
    grams = np.zeros(len(data), np.uint64)
    for k in range(BUCKET_GRAM):
        grams = (grams << np.uint64(8)) | padded[k : k + len(data)]
    return grams


def suffix_array(grams: np.ndarray, length: int) -> np.ndarray:
    """The places of all suffixes in byte order of their first `length` bytes or more, by bucket-pointer refinement.

    A bucket is a range of the array whose suffixes share `depth` bytes; its pointer is
    where the range begins. A round sorts the suffixes of every bucket of more than one
    by the pointers at the offset `depth`, which doubles the depth and keeps the order
    of buckets. It goes through the array in portions: pointers that one portion has
    renewed are read by the next ones of the same round.
    """
    n = len(grams)
    order = np.argsort(grams)
    sorted_ = grams[order]
    new = np.ones(n, bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    pointer = np.zeros(n + 1, np.int64)
    pointer[order] = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    depth = BUCKET_GRAM
    while depth < length:
        alone = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~alone)
        heads = np.flatnonzero(new[open_])
        cuts, a = [0], 0
        while a < len(open_):
            k = int(np.searchsorted(heads, a + REFINE_AT_ONCE, "left"))
            a = int(heads[k]) if k < len(heads) else len(open_)
            cuts.append(a)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            slots = open_[a:b]
            places = order[slots]
            own = pointer[places]
            later = pointer[np.minimum(places + depth, n)]
            key = own * (n + 1) + later
            by_key = np.argsort(key)
            order[slots] = places[by_key]
            ordered = key[by_key]
            head = np.ones(b - a, bool)
            head[1:] = ordered[1:] != ordered[:-1]
            new[slots] = head
            pointer[order[slots]] = slots[np.flatnonzero(head)[np.cumsum(head) - 1]] + 1
        depth *= 2
    return order


def repeated_places(data: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """Which of the `wanted` places (marks) start a string of `length` bytes that starts at another wanted place too: those whose neighbour in the suffix array shares it."""
    grams = byte_grams(data)
    order = suffix_array(grams, length)
    order = order[wanted[order]]
    live = np.arange(1, len(order))
    for k in [*range(0, length - BUCKET_GRAM + 1, BUCKET_GRAM), max(0, length - BUCKET_GRAM)]:
        live = live[grams[order[live] + k] == grams[order[live - 1] + k]]
    repeated = np.zeros(len(data), bool)
    repeated[order[live]] = True
    repeated[order[live - 1]] = True
    return repeated


def _anchors(length: int, k: int, levels: Levels, crowded: np.ndarray | None = None):
    """Anchors of all windows; with `crowded`, counts of the k-grams in the windows of those anchors instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b, rows_first, i in byte_parts(offsets, length):
                part = data[a:b]
                grams = Prefix(part, "byte").grams(k)
                row, place, first, n, again = window_anchors(grams, rows_first, length, k, levels(grams))
                if not len(row):
                    continue
                if crowded is not None:
                    yield grams_of_runs(grams, place, first, n, length - k + 1, crowded)
                    continue
                span = digests(part, first, first + n - 1 + length)
                start = (first + a - offsets[row + i]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(grams[place].view(np.int64)), pa.array(span.view(np.int64)), batch.column("rid").take(pa.array(row + i)), pa.array(start), pa.array(n.astype(np.int32)), pa.array(again)], names=["anchor", "span", "rid", "start", "windows", "again"])

    return run


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            picks = batch.column("picks")
            head = np.asarray(picks.offsets) - picks.offsets[0].as_py()
            flat = picks.flatten()
            begin = offsets[:-1][owners(head)] + flat.field("start").to_numpy()
            size = flat.field("windows").to_numpy().astype(np.int64) + (length - 1)
            for a, b in row_slices(np.concatenate([[0], np.cumsum(size)])):
                cut = np.concatenate([[0], np.cumsum(size[a:b])])
                index = np.arange(cut[-1]) + np.repeat(begin[a:b] - cut[:-1], size[a:b])
                content = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(cut), pa.py_buffer(data[index])]).cast(pa.binary())
                some = flat.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(some.field(c) for c in ("anchor", "span", "windows", "copies")), content], names=["anchor", "span", "windows", "copies", "content"])

    return run


def _sorted_shard(length: int):
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        data, offsets = binary_bytes(shard.column("content"))
        windows = shard.column("windows").to_numpy().astype(np.int64)
        cut = np.concatenate([[0], np.cumsum(windows)])
        row = owners(cut)
        places = np.arange(cut[-1]) - cut[:-1][row] + offsets[:-1][row]
        wanted = np.zeros(len(data), bool)
        wanted[places] = True
        hit = repeated_places(data, wanted, length)[places] | (shard.column("copies").to_numpy() > 1)[row]
        return runs_of(shard, hit, cut)

    return run


def repeated_ranges(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """Ranges (rid, ranges array<struct<start, end>>) of bytes that a repeated window covers.

    `rows` has rid (binary, the row's key) and text. Rows without repeats are absent.
    """
    marks = frequent_cells(rows, lambda data, offsets: Prefix(data, "byte").grams(gram))
    anchors, shared = bounded_anchors(
        lambda late: written(rows.mapInArrow(lean(_anchors(length, gram, Levels(marks, late))), _ANCHOR_SCHEMA), "suffix-anchors"),
        #: Written, so that the join below stands on plain exchanges and Spark can split a hot anchor among tasks.
        lambda anchors: written(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.bool_or("again").alias("again")).filter("n > 1 OR again").select("anchor", "n"), "suffix-shared"),
        lambda late, crowded: rows.mapInArrow(lean(_anchors(length, gram, Levels(marks, late), crowded)), "gram long, n long"),
        shard_contexts,
    )
    #: Rows that share rid are one row with a count. Grouped without the anchor, so that the shuffle after the join stays and the join may be split.
    found = written(anchors.join(shared, "anchor", "left_semi").groupBy("rid", "start", "span", "windows", "again").agg(F.min("anchor").alias("anchor"), F.count(F.lit(1)).alias("copies")), "suffix-candidates")
    forget(anchors, shared)
    distinct = written(found.groupBy("anchor", "span").agg(F.min(F.struct("rid", "start", "windows", "again")).alias("one"), F.sum("copies").alias("copies")).select("anchor", "span", "one.*", "copies"), "suffix-distinct")
    several = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("again") & (F.col("copies") == 1)).alias("again")).filter("n > 1 OR again").select("anchor")
    picks = distinct.join(several, "anchor", "left_semi").groupBy("rid").agg(F.collect_list(F.struct("anchor", "span", "start", "windows", "copies")).alias("picks"))
    contexts = written(
        rows.join(picks, "rid").dropDuplicates(["rid"]).select("text", "picks").mapInArrow(lean(_contexts(length)), "anchor long, span long, windows int, copies long, content binary"),
        "suffix-contexts",
    )
    volume = contexts.agg(F.sum(F.length("content"))).first()[0] or 0
    shards = max(shuffle_partitions(rows.sparkSession), volume // SHARD_BYTES)
    runs = contexts.withColumn("shard", F.pmod("anchor", F.lit(shards))).groupBy("shard").applyInArrow(_sorted_shard(length), "anchor long, span long, run_start int, run_end int")
    #: A context that occurs twice goes whole; it needs no sort unless another one shares its anchor.
    whole = F.array(F.struct(F.lit(0).alias("run_start"), F.col("windows").alias("run_end")))
    runs = runs.groupBy("anchor", "span").agg(F.collect_list(F.struct("run_start", "run_end")).alias("runs"))
    known = distinct.join(runs, ["anchor", "span"], "left").select("anchor", "span", F.when(F.col("copies") > 1, whole).otherwise(F.col("runs")).alias("runs"))
    known = written(known.filter("runs IS NOT NULL"), "suffix-runs")
    forget(contexts, distinct)
    hits = found.join(known, ["anchor", "span"]).select("rid", F.expr(f"transform(runs, r -> struct(start + r.run_start AS start, start + r.run_end + {length - 1} AS end))").alias("ranges"))
    ranges = written(hits.groupBy("rid").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "suffix-ranges")
    forget(found, known)
    return ranges


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        ranges = batch.column("ranges")
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for i in range(batch.num_rows):
            body = data[offsets[i] : offsets[i + 1]]
            spans = 0
            kept = body
            if ranges[i].is_valid and len(ranges[i].values):
                flat = ranges[i].values
                gone = covered(flat.field("start").to_numpy(), flat.field("end").to_numpy(), len(body))
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = body[~gone]
            out["n_bytes"].append(len(body))
            out["n_removed"].append(len(body) - len(kept))
            out["n_spans"].append(spans)
            out["kept_sha256"].append(hashlib.sha256(kept.tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a row key: rows that agree in id and text share a key and have the same result."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("rid", row_key())


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte covered by a `length`-byte string that starts anywhere
    else too, in the same text or another. Matches never cross rows. A null text
    is empty: nothing removed, the hash of no bytes. Texts shorter than `length`
    stay whole. Repeated rows are repeats of each other and go whole. A null
    doc_id is kept as null. Other columns are ignored. No rows give no rows.
    """
    rows = keyed(docs)
    ranges = repeated_ranges(rows.select("rid", "text"), length, gram)
    return rows.join(ranges, "rid", "left").select("doc_id", "text", "ranges").mapInArrow(lean(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
