"""SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a batch (a run of word marks and the characters up to the
next) are one text. Its suffix array is built by rank doubling up to the longest
piece; every piece of the vocabulary is found by binary search, which gives the
range of suffixes that start with it; the ranges become edges (place, length,
piece), sorted by place and length; that sorted list is what the relaxation walks.
The relaxation is that of the model: in byte-pair models
the best-scored edge that joins two neighbouring tokens is taken first, the
leftmost of equals. Short segments are relaxed in lockstep, one edge of each a round;
in long ones a round takes every edge that is the best within the longest piece on
either side, as nothing outside can change what happens there, and of equals in a row
as many as follow each other from the left without a better edge coming up.

Pieces never hold a word mark after another character (checked when the model is
read), so segments are independent; so are their parts between two characters that
stand side by side in no piece. A segment seen before (compared by its bytes) is not
matched anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import lean
from quillspark.llm.text import owners, pieces, row_slices, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters of distinct segments matched at once, and segments remembered by a task.
MATCH_CHARS = 150_000
REMEMBERED = 200_000
#: Longer parts take several edges a round.
LOCKSTEP_CHARS = 64
_NONE = np.int32(2**31 - 1)


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.vocab_size()
        ids = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.pieces = [p.id_to_piece(i) for i in ids]
        if any(MARK in x.lstrip(MARK) for x in self.pieces):
            raise ValueError("pieces that cross word marks are not supported")
        self.bytes = np.full(256, -1, np.int32)
        for i in range(n):
            if p.is_byte(i):
                self.bytes[int(p.id_to_piece(i)[1:-1], 16)] = i
        if (self.bytes < 0).any():
            raise ValueError("a model with byte fallback is needed")
        self.ids = np.array(ids, np.int32)
        score = np.array([p.get_score(i) for i in ids])
        _, self.rank = np.unique(-score, return_inverse=True)
        self.rank = self.rank.astype(np.int32)
        self.size = np.array([len(x) for x in self.pieces])
        self.longest = int(self.size.max())
        self.depth = -(-self.longest // 4) * 4
        self.first = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.size, out=self.first[1:])
        chars = np.frombuffer("".join(self.pieces).encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(chars)
        if len(self.alphabet) > 65_000:
            raise ValueError("an alphabet of at most 65,000 characters is needed")
        codes = self.codes(chars)
        inside = np.ones(len(chars), bool)
        inside[self.first[1:] - 1] = False
        at = np.flatnonzero(inside)
        #: Characters that stand side by side in some piece.
        self.neighbours = np.unique(codes[at] << 16 | codes[at + 1])
        self.low, self.high = [], []
        for k in range(0, self.depth, 4):
            low, high = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
            for c in range(k, k + 4):
                within = self.size > c
                code = np.where(within, codes[np.minimum(self.first[:-1] + c, len(codes) - 1)], 0).astype(np.uint64)
                low = (low << np.uint64(16)) | code
                high = (high << np.uint64(16)) | np.where(within, code, np.uint64(0xFFFF))
            self.low.append(low)
            self.high.append(high)
        raw = [bytes([int(p.id_to_piece(i)[1:-1], 16)]) if p.is_byte(i) else b"" if p.is_control(i) else p.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        self.raw_first = np.zeros(n + 1, np.int64)
        np.cumsum([len(x) for x in raw], out=self.raw_first[1:])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        probe = ["The quick  brown fox\n\tjumps, été 中文 \U0001f600 aaaa", " ", "x"]
        if [r.tolist() for r in Encoder(self).encode(probe)] != p.encode(probe):
            raise ValueError("only byte-pair models are supported")

    def codes(self, chars: np.ndarray) -> np.ndarray:
        """Numbers of characters from 1 up; those that no piece holds share the last."""
        at = np.minimum(np.searchsorted(self.alphabet, chars), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == chars, at + 1, len(self.alphabet) + 1)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def suffix_order(codes: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by the first `depth` codes (at most, up to the segment's end), and the packed codes of each suffix, four to a key.

    `left[i]` is what remains of the segment from i on.
    """
    n = len(codes)
    padded = np.concatenate([codes.astype(np.uint64), np.zeros(depth + 4, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(4):
        key = (key << np.uint64(16)) | np.where(left > k, padded[k : k + n], np.uint64(0))
    keys = [key]
    for at in range(4, depth, 4):
        later = np.zeros(n, np.uint64)
        later[: max(0, n - at)] = key[at:]
        keys.append(np.where(left > at, later, np.uint64(0)))
    _, rank = np.unique(key, return_inverse=True)
    reach = 4
    order = np.argsort(rank, kind="stable")
    while reach < depth:
        later = np.zeros(n, np.int64)
        later[: max(0, n - reach)] = rank[reach:] + 1
        pair = rank * (n + 2) + np.where(left > reach, later, 0)
        order = np.argsort(pair, kind="stable")
        new = np.ones(n, bool)
        new[1:] = pair[order[1:]] != pair[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        reach *= 2
    return order, keys


def _lower_bound(order: np.ndarray, keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
    """Binary search of many keys in the suffix array at once; `after` counts equals as smaller."""
    lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(order))
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        suffix = order[np.minimum(mid, len(order) - 1)]
        smaller, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for key, want in zip(keys, wanted, strict=True):
            here = key[suffix]
            smaller |= equal & (here < want)
            equal &= here == want
        smaller |= equal & after
        lo, hi = np.where(open_ & smaller, mid + 1, lo), np.where(open_ & ~smaller, mid, hi)


def _least(values: np.ndarray, before: int, after: int) -> np.ndarray:
    """The least of each value, `before` values on its left and `after` on its right."""
    wanted = before + after + 1
    least = np.concatenate([np.full(before, _NONE), values, np.full(after, _NONE)])
    width = 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = wanted - width
    return np.minimum(least[: len(values)], least[rest : rest + len(values)])


class Encoder:
    """Encodes batches; remembers segments it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.pool = np.zeros(0, np.int32)
        self.pool_first = np.zeros(1, np.int64)

    def match(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edges of all pieces in some segments, by place and length: place * (longest + 1) + length, and the piece."""
        v = self.v
        left = np.repeat(first[1:], np.diff(first)) - np.arange(len(codes))
        order, keys = suffix_order(codes, left, v.depth)
        begin, end = _lower_bound(order, keys, v.low, False), _lower_bound(order, keys, v.high, True)
        count = end - begin
        piece = np.repeat(np.arange(len(count), dtype=np.int32), count)
        edge = order[np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count)] * (v.longest + 1) + v.size[piece]
        by_place = np.argsort(edge)
        return edge[by_place], piece[by_place]

    def joined(self, edges: tuple[np.ndarray, np.ndarray], start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The pieces of some lengths at some places, which should rise; -1 where there is none."""
        edge, piece = edges
        if not len(edge):
            return np.full(len(start), -1, np.int32)
        wanted = start * (self.v.longest + 1) + np.minimum(length, self.v.longest)
        at = np.minimum(np.searchsorted(edge, wanted), len(edge) - 1)
        return np.where((edge[at] == wanted) & (length <= self.v.longest), piece[at], -1)

    def _ranks(self, edges: tuple[np.ndarray, np.ndarray], start: np.ndarray, length: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Ranks of the pieces of some lengths at some places, the largest where there is none or `same` does not hold."""
        piece = self.joined(edges, start, length)
        return np.where(same & (piece >= 0), self.v.rank[piece], _NONE)

    def _next(self, edges: tuple[np.ndarray, np.ndarray], start: np.ndarray, length: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """For each token the rank of the edge that joins it to the next."""
        both = length.copy()
        both[:-1] += length[1:]
        return self._ranks(edges, start, both, np.append(segment[1:] == segment[:-1], False))

    def relax(self, edges: tuple[np.ndarray, np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens (place, length) of all segments, in order."""
        long = np.diff(first) > LOCKSTEP_CHARS
        segment = owners(first)
        found = [self._lockstep(edges, np.flatnonzero(~long[segment]), segment), self._windowed(edges, np.flatnonzero(long[segment]), segment)]
        place, length = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(place, kind="stable")
        return place[order], length[order]

    def _lockstep(self, edges: tuple[np.ndarray, np.ndarray], start: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A round takes the best edge of every segment."""
        places, lengths = [start[:0]], [start[:0]]
        length, segment = np.ones(len(start), np.int64), owner[start]
        while len(start):
            best = self._next(edges, start, length, segment).astype(np.int64) << 32 | np.arange(len(start))
            heads = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            least = np.minimum.reduceat(best, heads)
            done = (least >> 32) == _NONE
            chosen = (least & 0xFFFFFFFF)[~done]
            finished = np.repeat(done, np.diff(np.append(heads, len(start))))
            places.append(start[finished])
            lengths.append(length[finished])
            length[chosen] += length[chosen + 1]
            keep = ~finished
            keep[chosen + 1] = False
            start, length, segment = start[keep], length[keep], segment[keep]
        return np.concatenate(places), np.concatenate(lengths)

    def _windowed(self, edges: tuple[np.ndarray, np.ndarray], start: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A round takes every edge that is the best among those that begin within the longest piece on either side.

        An edge that could come before such a one and touch it would be built of edges
        that lie there already and are better. Of equals within that reach of each other
        the model takes one after the other from the left, skipping those whose left token
        is gone, until one makes a better or equal edge; a round takes all up to that one.
        """
        length, reach = np.ones(len(start), np.int64), self.v.longest + 1
        while len(start):
            segment = owner[start]
            rank = self._next(edges, start, length, segment)
            best = np.flatnonzero((rank == _least(rank, reach, reach)) & (rank != _NONE))
            if not len(best):
                break
            #: An equal on the left that is not the best of its own surroundings comes first; all that follows waits for it.
            others = rank.copy()
            others[best] = _NONE
            waits = _least(others, reach, 0)[best] == rank[best]
            chain = np.cumsum(np.append(True, np.diff(best) > reach)) - 1
            run = np.maximum.accumulate(np.where(np.append(True, np.diff(best) > 1), np.arange(len(best)), 0))
            second = (np.arange(len(best)) - run) % 2 == 1
            taken = best[~second]
            after = length[taken] + length[taken + 1]
            #: What the merged token makes with its neighbours: the next token as it is, the one before it as it is by then.
            follower, before = np.minimum(taken + 2, len(start) - 1), np.maximum(taken - 1, 0)
            merged = np.append(False, np.diff(taken) == 2)
            leader = np.where(merged, taken - 2, before)
            next_rank = self._ranks(edges, start[taken], after + length[follower], (follower == taken + 2) & (segment[follower] == segment[taken]))
            leading = start[taken] - start[leader]
            last_rank = self._ranks(edges, start[leader], after + leading, (taken > 0) & (segment[leader] == segment[taken]))
            upset = np.zeros(len(best), bool)
            upset[~second] = np.minimum(next_rank, last_rank) <= rank[taken]
            #: Within a chain: nothing from the first that waits on, nothing after the first that upsets the order.
            stops = np.cumsum(waits) + np.cumsum(upset) - upset
            head = np.flatnonzero(np.append(True, np.diff(chain) > 0))
            base = (np.cumsum(waits) - waits + np.cumsum(upset) - upset)[head]
            chosen = best[~second & (stops == base[chain])]
            length[chosen] += length[chosen + 1]
            keep = np.ones(len(start), bool)
            keep[chosen + 1] = False
            start, length = start[keep], length[keep]
        return start, length

    def _learn(self, fresh: pa.Array) -> None:
        """Encode segments not seen before, in portions of about MATCH_CHARS characters, and remember them."""
        _, offsets, body = fresh.buffers()
        cut = np.frombuffer(offsets, np.int64)[fresh.offset : fresh.offset + len(fresh) + 1]
        body = np.frombuffer(body, np.uint8)[cut[0] : cut[-1]]
        cut = cut - cut[0]
        codes = self.v.codes(np.frombuffer(body.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32))
        heads = np.flatnonzero((body & 0xC0) != 0x80)
        first = np.searchsorted(heads, cut).astype(np.int64)
        pair = codes[:-1] << 16 | codes[1:]
        at = np.minimum(np.searchsorted(self.v.neighbours, pair), len(self.v.neighbours) - 1)
        part_first = np.union1d(first, np.flatnonzero(self.v.neighbours[at] != pair) + 1)
        heads = np.append(heads, len(body))
        pools, count = [self.pool], np.zeros(len(fresh), np.int64)
        for i, j in row_slices(part_first, MATCH_CHARS):
            a, b = part_first[i], part_first[j]
            edges = self.match(codes[a:b], part_first[i : j + 1] - a)
            place, length = self.relax(edges, part_first[i : j + 1] - a)
            token = self.joined(edges, place, length)
            single = np.where(token >= 0, self.v.ids[token], -1)
            place = place + a
            lost = single < 0
            spread = np.where(lost, heads[place + 1] - heads[place], 1)
            at = np.repeat(heads[place], spread) + np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)
            pools.append(np.where(np.repeat(lost, spread), self.v.bytes[body[np.minimum(at, len(body) - 1)]], np.repeat(single, spread)).astype(np.int32))
            np.add.at(count, np.searchsorted(first, place, "right") - 1, spread)
        self.pool, self.pool_first = np.concatenate(pools), np.concatenate([self.pool_first, self.pool_first[-1] + np.cumsum(count)])
        self.known = pa.concat_arrays([self.known, fresh])

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalized texts (UTF-8), and where each text's begin."""
        n = len(data)
        mark = np.zeros(n, bool)
        if n > 2:
            mark[:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        head = mark.copy()
        head[3:] &= ~mark[:-3]
        head[offsets[:-1][offsets[:-1] < n]] = True
        start = np.flatnonzero(head)
        first = np.searchsorted(start, offsets).astype(np.int64)
        if not len(start):
            return np.zeros(0, np.int32), first
        distinct = pieces(data, start, np.append(start[1:], n)).dictionary_encode()
        if len(self.known) > REMEMBERED:
            self._forget()
        at = pc.index_in(distinct.dictionary, value_set=self.known)
        new = at.is_null()
        slots = at.fill_null(-1).to_numpy().astype(np.int64)
        if at.null_count:
            slots[slots < 0] = len(self.known) + np.arange(at.null_count)
            self._learn(distinct.dictionary.filter(new))
        slot = slots[distinct.indices.to_numpy()]
        count = self.pool_first[slot + 1] - self.pool_first[slot]
        total = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        ids = self.pool[np.arange(total[-1]) + np.repeat(self.pool_first[slot] - total[:-1], count)]
        return ids, total[first]

    def normalized(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return text_bytes(pa.array(self.v.processor.normalize(texts) if texts else [], pa.large_string()))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, first = self.encode_bytes(*self.normalized(texts))
        return [ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the texts, and where each begins; the space that encoding puts before a text is taken off."""
        v = self.v
        size = v.raw_first[ids + 1] - v.raw_first[ids]
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        out = v.raw[np.arange(total[-1]) + np.repeat(v.raw_first[ids] - total[:-1], size)]
        begin = total[first]
        keep = np.ones(len(out), bool)
        some = begin[:-1][np.diff(begin) > 0]
        keep[some] = out[some] != 0x20
        left = np.zeros(len(out) + 1, np.int64)
        np.cumsum(keep, out=left[1:])
        return out[keep], left[begin]


def _texts(batch: pa.RecordBatch, encoder: Encoder, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(batch.column(column))
    for i, j in row_slices(offsets, 2 << 20):
        own = offsets[i : j + 1] - offsets[i]
        part = data[offsets[i] : offsets[j]]
        texts = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(np.ascontiguousarray(own)), pa.py_buffer(part)).to_pylist()
        ids, first = encoder.encode_bytes(*encoder.normalized(texts))
        yield i, j, ids, first, part, own


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and ids (array<int>) of every row. A null or empty text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(model))
        for batch in batches:
            for i, j, ids, first, _, _ in _texts(batch, encoder, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    return _rows(docs).mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids). Null or no ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(model))
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            first = np.asarray(lists.offsets).astype(np.int64)
            out, cut = encoder.decode(lists.flatten().to_numpy(), first - first[0])
            texts = [out[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(lean(run), "doc_id long, text string")


def checked(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens, restored of every row: ids as in `encode`, restored as in `round_trip`.

    A null or empty text has no ids and is restored; a null doc_id stays null, repeated
    rows give repeated rows, other columns are ignored, no rows give no rows.
    """
    return _round_trip(docs, model, True)


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit numbers), restored.

    The text is encoded, the ids are decoded, and `restored` tells whether that gives
    the text again (a word mark in it comes back as a space, as in the model). A null
    or empty text has no tokens and is restored. Repeated rows give repeated rows, a
    null doc_id stays null, other columns are ignored, no rows give no rows.
    """

    return _round_trip(docs, model, False)


def _round_trip(docs: DataFrame, model: str, with_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(model))
        for batch in batches:
            for i, j, ids, first, data, own in _texts(batch, encoder, 1):
                out, cut = encoder.decode(ids, first)
                wanted, back = data.tobytes(), out.tobytes()
                same = pa.array([back[a:b] == (w := wanted[c:d]) or back[a:b] == w.replace(MARK.encode(), b" ") for a, b, c, d in zip(cut[:-1], cut[1:], own[:-1], own[1:], strict=True)])
                doc_id, n = batch.column(0).slice(i, j - i), pa.array(np.diff(first))
                if with_ids:
                    yield pa.RecordBatch.from_arrays([doc_id, pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids)), n, same], names=["doc_id", "ids", "n_tokens", "restored"])
                else:
                    raw = ids.astype("<i4").tobytes()
                    digests = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(first[:-1], first[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([doc_id, n, pa.array(digests, pa.string()), same], names=["doc_id", "n_tokens", "ids_sha256", "restored"])

    kind = "ids array<int>, n_tokens long" if with_ids else "n_tokens long, ids_sha256 string"
    return _rows(docs).mapInArrow(lean(run), f"doc_id long, {kind}, restored boolean")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
