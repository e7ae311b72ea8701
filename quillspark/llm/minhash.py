"""Near-duplicate documents: b-bit MinHash, banding, and exact confirmation.

1. One scan gives each text its number of distinct shingles, a 128-bit hash of the
   set, the minima of `BANDS * ROWS` hash functions folded to band keys, and the
   low `BITS` bits of each minimum packed into longs.
2. Equal sets form a class; only the smallest document of a class goes on. A class
   is named by a key of its set, as ids may be null or repeated. A shingle is the XXH3
   of its words' bytes, a set the sums of two mixes of those.
3. Classes that share a band key are candidates. Shingles are counted over all
   candidates: one held by a single class cannot be shared, so a class with a larger
   share of such shingles than a link may lack has no link, whatever it is compared with.
4. In each bucket the class with the smallest share of such shingles is the hub.
   Members are compared with hubs only: the packed bits give a collision-corrected
   estimate, which drops pairs far below the threshold; the rest are confirmed on
   full sets.
5. Members that no link ties to the largest component of their family (classes
   chained by buckets) are compared with the whole family, in blocks of about
   `BLOCK_SHINGLES` shingles against slices of `SLICE_SHINGLES`; a block counts
   common shingles through an index of its sets, and only links leave it. So no link between two classes of a family
   is lost, and pairs are never written out.
6. Links give components, named at the end by their smallest document.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.llm.shared import forget, lean, quoted, row_key, written
from quillspark.llm.text import Words, digests, mix, owners, row_slices, text_bytes

SHINGLE = 5
BANDS, ROWS, BITS = 24, 4, 2
#: Percent of the union that a link must share: in the query of op6, and in the pipeline's stage.
THRESHOLD, STAGE_THRESHOLD = 85, 80
#: A pair is dropped unconfirmed if its estimate is so far (in percent) below the threshold: over five standard deviations.
SLACK = 25
#: Shingles of the sets that one task indexes, and of those that stream past it.
BLOCK_SHINGLES, SLICE_SHINGLES = 1 << 20, 1 << 22
#: Leading bits of row keys that mark candidates for the second scan.
MARK_BITS = 24

_PERMUTATIONS = BANDS * ROWS
_rng = np.random.default_rng(20240607)
_MULTIPLY = (_rng.integers(0, 1 << 32, _PERMUTATIONS, dtype=np.uint64) | 1).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, _PERMUTATIONS, dtype=np.uint64).astype(np.uint32)
_PER_LONG = 64 // BITS


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, and where each text's begin; a shorter text is one shingle, an empty one none."""
    joined, word_start, word_end = words.joined()
    count = np.diff(words.first)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=first[1:])
    row = owners(first)
    start = np.arange(first[-1]) - first[:-1][row] + words.first[:-1][row]
    return digests(joined, word_start[start], word_end[np.minimum(start + size, words.first[1:][row]) - 1]), first


def distinct_in_rows(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row."""
    row = owners(first)
    _, index = np.unique(mix(hashes ^ mix(row.astype(np.uint64) + np.uint64(1))), return_index=True)
    index.sort()
    return hashes[index], np.searchsorted(index, first)


def minima(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows x permutations; rows must not be empty."""
    low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.empty((len(first) - 1, _PERMUTATIONS), np.uint32)
    for p in range(_PERMUTATIONS):
        out[:, p] = np.minimum.reduceat(low * _MULTIPLY[p] + _ADD[p], first[:-1])
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    keys = np.empty((len(mins), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(mins), b + 1, np.uint64)
        for r in range(ROWS):
            key = mix(key ^ mins[:, b * ROWS + r].astype(np.uint64))
        keys[:, b] = key
    return keys.view(np.int64)


def packed_bits(mins: np.ndarray) -> np.ndarray:
    """The low bits of each minimum, `_PER_LONG` to a long."""
    bits = mix(mins.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    packed = np.zeros((len(mins), _PERMUTATIONS // _PER_LONG), np.uint64)
    for p in range(_PERMUTATIONS):
        packed[:, p // _PER_LONG] |= bits[:, p] << np.uint64(BITS * (p % _PER_LONG))
    return packed.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for i, j in row_slices(offsets):
            words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
            hashes, first = distinct_in_rows(*shingle_hashes(words, SHINGLE))
            n = np.diff(first)
            some = n > 0
            head = np.append(first[:-1][some], len(hashes))
            sums = [np.zeros(j - i, np.uint64) for _ in range(2)]
            keys = np.zeros((j - i, BANDS), np.int64)
            bits = np.zeros((j - i, _PERMUTATIONS // _PER_LONG), np.int64)
            if some.any():
                sums[0][some] = np.add.reduceat(mix(hashes), head[:-1])
                sums[1][some] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), head[:-1])
                mins = minima(hashes, head)
                keys[some], bits[some] = band_keys(mins), packed_bits(mins)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())) for x in (keys, bits)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("doc", "rid")), pa.array(n), *(pa.array(s.view(np.int64)) for s in sums), *lists], names=["doc", "rid", "n", "set1", "set2", "bands", "bits"])


def _sets(marks: np.ndarray):
    """The shingles of rows whose key is marked; a few others are marked by chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets, keys = batch.column("rid").buffers()
            keys = np.frombuffer(keys, np.uint8)[16 * batch.column("rid").offset :][: 16 * batch.num_rows].reshape(-1, 16).astype(np.int64)
            cell = keys[:, 0] << 16 | keys[:, 1] << 8 | keys[:, 2]
            batch = batch.filter(pa.array((marks[cell >> 3] >> (cell & 7) & 1).astype(bool)))
            data, offsets = text_bytes(batch.column("text"))
            for i, j in row_slices(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
                hashes, first = distinct_in_rows(*shingle_hashes(words, SHINGLE))
                yield pa.RecordBatch.from_arrays([batch.column("rid").slice(i, j - i), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))], names=["rid", "shingles"])

    return run


def _marks(rids: DataFrame) -> np.ndarray:
    """A bitmap of the leading bits of some row keys, of one size however many there are."""
    cells = rids.select(F.conv(F.hex(F.substring("rid", 1, MARK_BITS // 8)), 16, 10).cast("int").alias("cell")).distinct().toArrow().column("cell").to_numpy()
    marks = np.zeros(1 << MARK_BITS - 3, np.uint8)
    np.bitwise_or.at(marks, cells >> 3, (1 << (cells & 7)).astype(np.uint8))
    return marks


def keyed(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.withColumn("rid", row_key("doc"))


def estimate(a: str, b: str) -> str:
    """SQL for the collision-corrected similarity of two packed signatures (arrays of longs `a` and `b`)."""
    longs, even = _PERMUTATIONS // _PER_LONG, 0x5555555555555555
    differ = " + ".join(f"bit_count((({a}[{i}] ^ {b}[{i}]) | shiftrightunsigned({a}[{i}] ^ {b}[{i}], 1)) & {even}L)" for i in range(longs))
    chance = 0.5**BITS
    return f"((1.0D - ({differ}) / {_PERMUTATIONS}.0D - {chance}D) / {1 - chance}D)"


def _blocks(members: DataFrame, queries: DataFrame) -> DataFrame:
    """Blocks of unsettled sets beside slices of their family: one row for each family set and block, and for each unsettled set and slice."""
    part = F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), F.ceil(F.col("unsettled_shingles") / BLOCK_SHINGLES)).cast("long")).cast("int")
    slices = F.greatest(F.lit(1), F.ceil(F.col("whole_shingles") / SLICE_SHINGLES)).cast("int")
    queries = written(queries.withColumn("block", part).withColumn("slices", slices), "minhash-queries")
    blocks = queries.select("family", "block").distinct()
    others = members.withColumn("slice", F.pmod(F.xxhash64(F.lit("slice"), "rep"), slices.cast("long")).cast("int")).join(blocks, "family")
    others = others.select("family", "block", "slice", "rep", "component", "shingles", F.lit(False).alias("query"))
    asked = queries.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    return others.unionByName(asked.select("family", "block", "slice", "rep", "component", "shingles", F.lit(True).alias("query")))


def _block_links(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Rows of one block arrive sorted: its query sets first, then the family as a stream."""
    asked: list[tuple[int, int, np.ndarray]] = []
    vocabulary = None
    for batch in batches:
        query = batch.column("query").to_numpy(zero_copy_only=False)
        rep, component = batch.column("rep").to_numpy(), batch.column("component").to_numpy()
        lists = batch.column("shingles")
        head = np.asarray(lists.offsets).astype(np.int64)
        flat = lists.flatten().to_numpy()
        head = head - head[0]
        for i in np.flatnonzero(query):
            asked.append((rep[i], component[i], flat[head[i] : head[i + 1]]))
        if query.all():
            continue
        if vocabulary is None:
            sizes = np.array([len(s) for _, _, s in asked])
            vocabulary, column = np.unique(np.concatenate([s for _, _, s in asked]), return_inverse=True)
            ids, parts = np.array([a for a, _, _ in asked]), np.array([c for _, c, _ in asked])
            order = np.argsort(column, kind="stable")
            by_word = np.repeat(np.arange(len(asked)), sizes)[order]
            word_first = np.searchsorted(column[order], np.arange(len(vocabulary) + 1))
        for i in np.flatnonzero(~query):
            own = flat[head[i] : head[i + 1]]
            if not (100 * np.minimum(sizes, len(own)) >= threshold * np.maximum(sizes, len(own))).any():
                continue
            at = np.searchsorted(vocabulary, own)
            at = at[(at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == own)]
            count = word_first[at + 1] - word_first[at]
            index = np.arange(count.sum()) + np.repeat(word_first[at] - np.cumsum(count) + count, count)
            common = np.bincount(by_word[index], minlength=len(ids))
            hit = (100 * common >= threshold * (sizes + len(own) - common)) & (parts != component[i])
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(np.full(int(hit.sum()), rep[i]))], names=["a", "b"])


def _linked_in_blocks(frames: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Splits a sorted partition by (family, block, slice)."""

    def runs():
        for frame in frames:
            keys = np.stack([frame.column(c).to_numpy().astype(np.int64) for c in ("family", "block", "slice")])
            cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            edges = [0, *cut.tolist(), frame.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    yield tuple(keys[:, a].tolist()), frame.slice(a, b - a)

    for _, group in itertools.groupby(runs(), key=lambda x: x[0]):
        yield from _block_links((piece for _, piece in group), threshold)


def _class_key(classes: DataFrame) -> Column:
    """A long of (set1, set2, n) that no two classes share; the salt is raised until that holds, which the first nearly always does."""
    for salt in itertools.count():
        key = F.xxhash64(F.lit(salt), "set1", "set2", "n")
        if not classes.groupBy(key.alias("rep")).agg(F.count(F.lit(1)).alias("held")).filter("held > 1").limit(1).count():
            return key


def links(docs: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, links): members has doc, rid, n, rep for every row; classes the smallest doc and its rid of every rep; links has (a, b) between reps."""
    signed = written(docs.mapInArrow(lean(_signatures), "doc long, rid binary, n long, set1 long, set2 long, bands array<long>, bits array<long>"), "minhash-signatures")
    #: One row for each set; null ids sort last, so a class is named by an id where it has one.
    classes = signed.filter("n > 0").groupBy("set1", "set2", "n").agg(F.min(F.struct(F.isnull("doc").alias("nameless"), "doc", "rid", "bands", "bits")).alias("one"))
    classes = written(classes.select("set1", "set2", "n", F.col("one.doc").alias("doc"), F.col("one.rid").alias("rid"), F.col("one.bands").alias("bands"), F.col("one.bits").alias("bits")), "minhash-classes")
    key = _class_key(classes)
    classes = classes.withColumn("rep", key)
    members = written(signed.select("doc", "rid", "n", F.when(F.col("n") > 0, key).alias("rep")), "minhash-members")
    forget(signed)

    keys = classes.select("rep", F.explode("bands").alias("band"))
    full = written(keys.groupBy("band").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("band"), "minhash-full")
    buckets = written(keys.join(full, "band"), "minhash-buckets")
    forget(full)
    candidates = written(classes.join(buckets.select("rep").distinct(), "rep", "left_semi").select("rep", "rid", "n", "bits"), "minhash-candidates")
    #: Texts are not shuffled: the scan makes the sets of marked rows, and only those meet the candidates.
    sets = docs.select("rid", "text").mapInArrow(lean(_sets(_marks(candidates))), "rid binary, shingles array<long>")
    sets = sets.join(candidates.select("rid", "rep").hint("merge"), "rid").dropDuplicates(["rep"]).select("rep", "shingles")
    sets = written(sets, "minhash-sets")

    alone = sets.select("rep", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("rep").alias("rep")).filter("df = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("alone"))
    able = candidates.join(alone, "rep", "left").withColumn("alone", F.coalesce("alone", F.lit(0))).filter(f"100 * (n - alone) >= {threshold} * n")
    able = written(able.select("rep", "n", "bits", (F.col("alone") / F.col("n")).alias("apart")), "minhash-able")

    joined = written(buckets.join(able.select("rep", "apart"), "rep"), "minhash-joined")
    hubs = written(joined.groupBy("band").agg(F.min(F.struct("apart", "rep")).alias("hub"), F.count(F.lit(1)).alias("held")).filter("held > 1").select("band", F.col("hub.rep").alias("hub")), "minhash-hubs")
    spokes = written(joined.join(hubs, "band").filter("rep <> hub").select("rep", "hub").distinct(), "minhash-spokes")
    near = spokes.join(able.select("rep", "n", "bits"), "rep").join(able.select(F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("bits").alias("hub_bits")), "hub")
    #: Numbers and packed bits decide which pairs are worth their sets.
    near = near.filter(f"100 * least(n, hub_n) >= {threshold} * greatest(n, hub_n)").filter(f"{estimate('bits', 'hub_bits')} >= {(threshold - SLACK) / 100}D").select("rep", "hub", "n", "hub_n")
    near = written(near, "minhash-near")
    forget(buckets, joined, hubs)
    compared = near.join(sets, "rep").join(sets.select(F.col("rep").alias("hub"), F.col("shingles").alias("hub_shingles")), "hub").withColumn("common", F.size(F.array_intersect("shingles", "hub_shingles")))
    first_links = written(compared.filter(f"100 * common >= {threshold} * (n + hub_n - common)").select(F.col("hub").alias("a"), F.col("rep").alias("b")), "minhash-links")

    families = components(spokes.select(F.col("hub").alias("a"), F.col("rep").alias("b"))).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    parts = components(first_links).select(F.col("node").alias("rep"), "component")
    placed = written(families.join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "minhash-placed")
    sizes = placed.join(able.select("rep", "n"), "rep").groupBy("family", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    largest = sizes.groupBy("family").agg(F.max(F.struct("size", "component", "shingles")).alias("largest"), F.count(F.lit(1)).alias("components"), F.sum("shingles").alias("whole_shingles"))
    largest = largest.filter("components > 1").select("family", F.col("largest.component").alias("main"), "whole_shingles", (F.col("whole_shingles") - F.col("largest.shingles")).alias("unsettled_shingles"))
    open_ = placed.join(largest, "family").join(sets, "rep")
    blocks = _blocks(open_, open_.filter("component <> main"))
    blocks = blocks.repartition("family", "block", "slice").sortWithinPartitions("family", "block", "slice", F.desc("query")).select("family", "block", "slice", "rep", "component", "shingles", "query")
    late_links = blocks.mapInArrow(lean(partial(_linked_in_blocks, threshold=threshold)), "a long, b long")
    found = written(first_links.unionByName(late_links), "minhash-all-links")
    forget(sets, candidates, able, spokes, near, first_links, placed)
    return members, classes.select("rep", "doc", "rid"), found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, class_id, n_confirmed.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a set
    holds the distinct shingles of five words, or the whole text if it has fewer.
    Rows whose sets share `THRESHOLD` percent of their union are linked;
    component_id is the smallest doc_id reachable, and `kept` tells whether it is
    the row's own, so all rows of one component under that id are kept (`deduplicated`
    keeps one of them); unrelated texts under one id are components of their own. class_id is the smallest doc_id with the same set,
    n_confirmed the links of that class which the search confirmed: enough to connect its component, not all that exist. Null and
    empty texts have no set and stay alone (class and component are their own
    ids). A null doc_id counts as larger than all: class and component are null only
    where no row of theirs has an id, and two nulls count as the same. Repeated rows
    are one class. Other columns are ignored; no rows give no rows.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return _labelled(docs, THRESHOLD).select("doc_id", "n_shingles", "component_id", kept, "class_id", "n_confirmed")


def _labelled(docs: DataFrame, threshold: int) -> DataFrame:
    """Per row: rid, doc_id, n_shingles, component_id, `head` (whether its component keeps the row's text under its id), class_id, n_confirmed."""
    members, classes, found = links(keyed(docs), threshold)
    labels = components(found).select(F.col("node").alias("rep"), "component")
    both = found.select(F.col("a").alias("rep")).unionByName(found.select(F.col("b").alias("rep")))
    degree = both.groupBy("rep").agg(F.count(F.lit(1)).alias("n_confirmed"))
    linked = written(labels.join(classes, "rep"), "minhash-linked")
    heads = linked.groupBy("component").agg(F.min(F.struct(F.isnull("doc").alias("nameless"), "doc", "rid")).alias("head"))
    headed = written(linked.join(heads, "component").join(degree, "rep", "left").select("rep", "head", "n_confirmed"), "minhash-heads")
    forget(linked, found)
    #: One written table on the other side, so that Spark can split a class of very many members.
    named = F.coalesce("head", F.struct(F.isnull("doc").alias("nameless"), "doc", "rid"))
    placed = written(classes.join(headed, "rep", "left").select("rep", F.col("doc").alias("class_id"), named["doc"].alias("component_id"), named["rid"].alias("kept_rid"), "n_confirmed"), "minhash-labels")
    out = members.join(placed, "rep", "left")
    return out.select(
        "rid",
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc").alias("component_id"),
        F.coalesce(F.col("rid") == F.col("kept_rid"), F.lit(True)).alias("head"),
        F.coalesce("class_id", "doc").alias("class_id"),
        F.coalesce("n_confirmed", F.lit(0)).cast("long").alias("n_confirmed"),
    )


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, that are kept where `threshold` percent make a link; of rows that agree in doc_id and text, one stays.

    Null and empty texts have no set and all stay, save repeats under one id. A null
    doc_id counts as larger than all; of rows that agree in id and text but differ in
    other columns any one stays. Columns of any name pass through, no rows give no rows.
    """
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = _labelled(rows.select("doc_id", "text"), threshold).filter("head").select("rid").distinct()
    rows = rows.select("row", "doc_id", F.coalesce("text", F.lit("")).alias("text")).select("row", row_key().alias("rid")).join(keys, "rid", "left_semi").dropDuplicates(["rid"])
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))
