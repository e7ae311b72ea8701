"""Benchmark leaks: a BM25 index of test items, searched by every training passage.

The items are the indexed side. Document frequencies and lengths are counted over all
of them; the index itself comes in shards of about `SHARD_WORDS` words. Each shard is
made, sent to the tasks, searched in a scan of its own and released before the next,
so neither the driver nor a task ever holds more than one.

Every text is cut into passages of 128 words that overlap by half, items into pieces of
64. Impacts are divided by the piece's score for itself, so that one threshold fits all.
Block-max WAND, for many passages in lockstep: cursors over the postings of a passage's
words stand in document order; the first one at which the summed list maxima reach the
threshold is the pivot; the block maxima around the pivot either let it be scored or
skip to where they end. Passages whose block maxima reach the threshold nowhere are
left out before. Everything above the threshold is then verified: the item's question
and its answer must both share enough of their word shingles with the text. Words are
compared by their bytes.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import by_place, forget, lean, quoted, written
from quillspark.llm.text import owners, pieces, row_slices, text_bytes

STRIDE = 64
PASSAGE = 2 * STRIDE
K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach to be verified.
RETRIEVE = 0.5
SHINGLE, OVERLAP = 5, 0.8
BLOCK = 8
#: Words of the items in one shard of the index; a longer item is a shard of its own.
SHARD_WORDS = 200_000
#: Bounds of what a task expands at once: postings, and cells of passages by blocks.
_POSTINGS, _CELLS = 1 << 20, 1 << 20
_SLACK = 1e-9

_bytes = np.arange(256)
_INSIDE = ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 65) & (_bytes <= 90)) | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The runs of letters and digits, and where each text's begin."""
    inside = _INSIDE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return pieces(data, start, end), np.searchsorted(start, offsets).astype(np.int64)


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return text_bytes(pc.utf8_lower(column.cast(pa.large_string())))


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer, what stands before it the question; a single sentence is both."""
    cut = [m.end() for m in re.finditer(r"[.?!](?=\s)|\n", text.rstrip())]
    question, answer = (text[: cut[-1]], text[cut[-1] :]) if cut else (text, text)
    return (question, answer) if question.strip() and answer.strip() else (text, text)


def shingles(terms: np.ndarray, size: int = SHINGLE) -> set[bytes]:
    """Distinct shingles of `size` terms, all of them known; a shorter text is one."""
    size = min(size, len(terms))
    if not size:
        return set()
    grams = np.lib.stride_tricks.sliding_window_view(terms.astype(np.int32), size)
    grams = np.ascontiguousarray(grams[(grams >= 0).all(1)])
    return set(grams.view(np.dtype((np.void, 4 * size))).ravel().tolist())


def _csr(keys: np.ndarray, n: int, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    return np.searchsorted(keys[order], np.arange(n + 1)), *(c[order] for c in columns)


def _expand(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists `at` of a CSR: (which of them, place) of every entry."""
    count = first[at + 1] - first[at]
    which = np.repeat(np.arange(len(at)), count)
    return which, np.arange(count.sum()) + np.repeat(first[at] - np.cumsum(count) + count, count)


@dataclass(frozen=True)
class Statistics:
    """Of all items: pieces, their mean length, and in how many of them a word is."""

    pieces: int
    mean_length: float
    words: pa.Array
    held_by: np.ndarray


def _piece_terms(terms: np.ndarray, first: np.ndarray, n_terms: int) -> tuple[np.ndarray, ...]:
    """(item of each piece, words of each piece, postings as (term, piece, count))."""
    item = owners(first)
    place = np.arange(len(terms)) - first[:-1][item]
    size = -(-np.diff(first) // STRIDE)
    piece = (np.cumsum(size) - size)[item] + place // STRIDE
    pair, count = np.unique(terms * max(1, int(size.sum())) + piece, return_counts=True)
    return np.repeat(np.arange(len(size)), size), np.bincount(piece, minlength=int(size.sum())), pair // max(1, int(size.sum())), pair % max(1, int(size.sum())), count


@dataclass(frozen=True)
class ItemIndex:
    """Postings in document order with list and block maxima; documents are pieces of items of at most `STRIDE` words."""

    vocabulary: pa.Array
    piece_item: np.ndarray
    lists: tuple
    block_lists: tuple
    most: np.ndarray
    questions: list
    answers: list

    @classmethod
    def build(cls, texts: list[str], statistics: Statistics | None = None) -> ItemIndex:
        words, first = tokens(*lowered(pa.array(texts, pa.string())))
        coded = words.dictionary_encode()
        vocabulary, terms = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        piece_item, length, term, piece, count = _piece_terms(terms, first, len(vocabulary))
        n = len(piece_item)
        own = np.bincount(term, minlength=len(vocabulary))
        statistics = statistics or Statistics(n, length.mean() if n else 1.0, vocabulary, own)
        held = statistics.held_by[pc.index_in(vocabulary, value_set=statistics.words).to_numpy()] if len(vocabulary) else own
        idf = np.log1p((statistics.pieces - held + 0.5) / (held + 0.5))
        impact = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length[piece] / max(statistics.mean_length, 1e-9)))
        impact = impact / np.bincount(piece, impact, n)[piece]
        lists = _csr(term, len(vocabulary), piece, impact)
        blocks = max(1, -(-n // BLOCK))
        block_pair, where = np.unique(term * blocks + piece // BLOCK, return_inverse=True)
        top = np.zeros(len(block_pair))
        np.maximum.at(top, where, impact)
        block_lists = _csr(block_pair // blocks, len(vocabulary), block_pair % blocks, top)
        most = np.zeros(len(vocabulary))
        np.maximum.at(most, term, impact)
        index = cls(vocabulary, piece_item, lists, block_lists, most, [], [])
        for text in texts:
            for side, part in zip((index.questions, index.answers), question_and_answer(text), strict=True):
                own_terms = index.terms(tokens(*lowered(pa.array([part], pa.string())))[0])
                side.append((min(SHINGLE, len(own_terms)), shingles(own_terms)))
        return index

    def terms(self, words: pa.Array) -> np.ndarray:
        """Numbers of the words in the vocabulary, -1 for others."""
        return pc.index_in(words, value_set=self.vocabulary).fill_null(-1).to_numpy().astype(np.int64)

    def search(self, terms: np.ndarray, first: np.ndarray, retrieve: float = RETRIEVE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, score): the items that some passage of the text retrieves, with the best score."""
        hit = np.flatnonzero(terms >= 0)
        row, n = owners(first), np.diff(first)
        passages = np.where(n > PASSAGE, -(-(n - STRIDE) // STRIDE), np.minimum(n, 1))
        passage_first = np.concatenate([[0], np.cumsum(passages)])
        near = (hit - first[:-1][row[hit]]) // STRIDE
        passage, term = [], []
        for step in (0, 1):
            good = (near - step >= 0) & (near - step < passages[row[hit]])
            passage.append(passage_first[row[hit[good]]] + near[good] - step)
            term.append(terms[hit[good]])
        pair = np.unique(np.concatenate(passage) * max(1, len(self.vocabulary)) + np.concatenate(term))
        passage, term = pair // max(1, len(self.vocabulary)), pair % max(1, len(self.vocabulary))
        pieces_found, texts, scores = [], [], []
        for a, b in self._portions(passage, term):
            begin, end = self._live(passage[a:b], term[a:b], retrieve)
            some = np.flatnonzero(begin < end)
            for p, piece, score in self._wand(passage[a + some], term[a + some], begin[some], end[some], retrieve):
                texts.append(np.searchsorted(passage_first, p, "right") - 1)
                pieces_found.append(piece)
                scores.append(score)
        none = [np.zeros(0, np.int64)]
        texts, found, scores = np.concatenate(texts or none), np.concatenate(pieces_found or none), np.concatenate(scores or [np.zeros(0)])
        items = self.piece_item[found] if len(found) else found
        width = int(items.max(initial=0)) + 1
        found, where = np.unique(texts * width + items, return_inverse=True)
        best = np.zeros(len(found))
        np.maximum.at(best, where, scores)
        return found // width, found % width, best

    def _portions(self, passage: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of whole passages whose postings and blocks stay within the bounds; one passage at least."""
        heads = np.append(np.flatnonzero(np.diff(passage, prepend=-1)), len(passage))
        work = np.concatenate([[0], np.cumsum(np.diff(self.lists[0])[term])])[heads]
        most = max(1, _CELLS // max(1, -(-len(self.piece_item) // BLOCK)))
        i = 0
        while i < len(heads) - 1:
            j = min(len(heads) - 1, i + most, max(i + 1, int(np.searchsorted(work, work[i] + _POSTINGS, "right")) - 1))
            yield int(heads[i]), int(heads[j])
            i = j

    def _live(self, passage: np.ndarray, term: np.ndarray, retrieve: float) -> tuple[np.ndarray, np.ndarray]:
        """For each row the pieces from the first to the last block whose maxima reach the threshold for its passage, none if there is none."""
        blocks = max(1, -(-len(self.piece_item) // BLOCK))
        local = passage - passage[0]
        bound = np.zeros(int(local[-1] + 1) * blocks)
        which, at = _expand(self.block_lists[0], term)
        np.add.at(bound, local[which] * blocks + self.block_lists[1][at], self.block_lists[2][at])
        open_ = bound.reshape(-1, blocks) >= retrieve - _SLACK
        begin, end = open_.argmax(1) * BLOCK, (blocks - open_[:, ::-1].argmax(1)) * BLOCK
        return begin[local], np.where(open_.any(1), end, 0)[local]

    def _wand(self, passage: np.ndarray, term: np.ndarray, begin: np.ndarray, end: np.ndarray, retrieve: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(passage, piece, score) of all pieces at or above the threshold; rows are the cursors of the passages, each over its pieces begin:end."""
        first, piece, impact = self.lists
        block_first, block_of, block_top = self.block_lists
        n, blocks = len(self.piece_item), max(1, -(-len(self.piece_item) // BLOCK))
        key = np.repeat(np.arange(len(first) - 1), np.diff(first)) * (n + 1) + piece
        block_key = np.repeat(np.arange(len(first) - 1), np.diff(block_first)) * blocks + block_of
        place, stop = np.searchsorted(key, np.concatenate([term * (n + 1) + begin, term * (n + 1) + np.minimum(end, n)])).reshape(2, -1)
        some = place < stop
        passage, term, place, stop = passage[some], term[some], place[some], stop[some]
        while len(passage):
            doc = piece[place]
            order = np.argsort(passage * (n + 1) + doc)
            passage, term, place, stop, doc = passage[order], term[order], place[order], stop[order], doc[order]
            heads = np.flatnonzero(np.diff(passage, prepend=-1))
            owner = owners(np.append(heads, len(passage)))
            summed = np.cumsum(self.most[term])
            summed -= (summed[heads] - self.most[term[heads]])[owner]
            pivot = np.minimum.reduceat(np.where(summed >= retrieve - _SLACK, np.arange(len(passage)), len(passage)), heads)
            some = pivot < len(passage)
            keep = some[owner]
            pivot_doc = doc[np.minimum(pivot, len(passage) - 1)][owner]
            upto = doc <= pivot_doc
            near = np.flatnonzero(upto & keep)
            want = term[near] * blocks + pivot_doc[near] // BLOCK
            at = np.minimum(np.searchsorted(block_key, want), len(block_key) - 1)
            top = np.where(block_key[at] == want, block_top[at], 0.0)
            worth = (np.bincount(owner[near], top, len(heads)) >= retrieve - _SLACK)[owner]
            ready = (doc[heads])[owner] == pivot_doc
            scored = np.flatnonzero(keep & worth & ready & upto)
            if len(scored):
                score = np.bincount(owner[scored], impact[place[scored]], len(heads))
                good = np.flatnonzero(score >= retrieve)
                if len(good):
                    yield passage[heads[good]], doc[heads[good]], score[good]
            #: Without hope in the block, on to its end or to the next cursor, whichever comes first.
            beyond = np.minimum.reduceat(np.where(upto, n, doc), heads)[owner]
            target = np.where(worth, np.where(ready, pivot_doc + 1, pivot_doc), np.minimum((pivot_doc // BLOCK + 1) * BLOCK, beyond))
            move = upto & keep & (doc < target)
            place = place.copy()
            place[move] = np.searchsorted(key, term[move] * (n + 1) + target[move])
            keep &= place < stop
            passage, term, place, stop = passage[keep], term[keep], place[keep], stop[keep]

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, score, question overlap, answer overlap) of verified leaks."""
        words, first = tokens(data, offsets)
        terms = self.terms(words)
        texts, items, scores = self.search(terms, first)
        share = np.zeros((len(texts), 2))
        last, own = -1, {}
        for k, (t, i) in enumerate(zip(texts, items, strict=True)):
            if t != last:
                last, own = t, {}
            for side, (size, wanted) in enumerate((self.questions[i], self.answers[i])):
                if size not in own:
                    own[size] = shingles(terms[first[t] : first[t + 1]], size) if first[t + 1] - first[t] >= size else set()
                share[k, side] = len(wanted & own[size]) / len(wanted) if wanted else 1.0
        good = (share >= OVERLAP).all(1)
        return texts[good], items[good], scores[good], share[good, 0], share[good, 1]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a batch of items: (word, pieces that hold it, words of it), and under no word the number of pieces."""
    for batch in batches:
        data, offsets = lowered(batch.column("text"))
        for i, j in row_slices(offsets):
            words, first = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            coded = words.dictionary_encode()
            _, length, term, _, _ = _piece_terms(coded.indices.to_numpy().astype(np.int64), first, len(coded.dictionary))
            held = np.bincount(term, minlength=len(coded.dictionary))
            names = pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([None], pa.binary())])
            yield pa.RecordBatch.from_arrays([names, pa.array(np.append(held, len(length))), pa.array(np.append(np.zeros(len(held), np.int64), length.sum()))], names=["word", "held", "words"])


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, first = tokens(*lowered(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("text"), pa.array(np.diff(first))], names=["item_id", "text", "n"])


def indexes(items: DataFrame, shard_words: int = SHARD_WORDS) -> Iterator[tuple[bool, list, ItemIndex]]:
    """(whether it is the only one, item ids, index) of the shards of items (item_id, text), one after the other.

    Items without words are left out; equal rows count once.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    items = written(items.mapInArrow(lean(_sized), "item_id long, text string, n long").filter("n > 0"), "leak-items")
    counts = written(items.select("text").mapInArrow(lean(_counted), "word binary, held long, words long").groupBy("word").agg(F.sum("held").alias("held"), F.sum("words").alias("words")), "leak-words")
    total = counts.filter("word IS NULL").first()
    words, n = (total.words, total.held) if total else (0, 0)
    parts = max(1, -(-words // shard_words))
    for k in range(parts):
        shard = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        rows = shard.orderBy("item_id", "text").select("item_id", "text").collect()
        wanted = counts.filter("word IS NOT NULL")
        if parts > 1:
            wanted = wanted.join(shard.select("text").mapInArrow(lean(_counted), "word binary, held long, words long").select("word").distinct(), "word", "left_semi")
        found = wanted.select("word", "held").toArrow() if rows else None
        statistics = found and Statistics(n, words / n, found.column("word").combine_chunks().cast(pa.large_binary()), found.column("held").to_numpy())
        yield parts == 1, [r.item_id for r in rows], ItemIndex.build([r.text for r in rows], statistics)
    forget(items, counts)


def _searched(ids: list, index: ItemIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = lowered(batch.column("text"))
            for i, j in row_slices(offsets):
                texts, items, *numbers = index.leaks(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if len(texts):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(texts + i)), pa.array([ids[k] for k in items], pa.int64()), *(pa.array(x) for x in numbers)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs doc_id, item_id with score (share of the item's own BM25), question_overlap and answer_overlap.

    Words are runs of letters and digits in lower case. Null and empty texts leak
    nothing; items without words match nothing; a null doc_id stays null. Repeated
    rows of `docs` give repeated pairs, repeated items count once. Other columns are
    ignored. No rows, or no items, give no pairs.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = None
    for only, ids, index in indexes(items):
        found = rows.mapInArrow(lean(_searched(ids, index)), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        found = found if only else written(found, "leaks")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose text holds no item.

    Null and empty texts hold none and stay; repeated rows stay or go together; columns
    of any name pass through; without items all rows stay. Where the items fill several
    shards, each gives the keys (128 bits of the text) of the texts that leak, and one
    anti-join takes those away; no shard writes the corpus.
    """
    rows, leaks, through = docs.select(F.struct(*quoted(docs.columns)).alias("row"), F.col("text").cast("string").alias("text")), [], docs
    rows = rows.select("row", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    for only, _, index in indexes(items):
        if only:
            #: One shard: the texts go through it on their way, nothing is joined.
            through = by_place(docs).mapInArrow(lean(_free_of(index, docs.columns)), docs.schema)
        else:
            leaks.append(written(rows.select("key", "text").mapInArrow(lean(_keys_of_leaks(index)), "key binary").distinct(), "leaking-keys"))
    if not leaks:
        return through
    found = written(functools.reduce(DataFrame.unionByName, leaks).distinct(), "leaking-texts")
    forget(*leaks)
    return rows.join(found, "key", "left_anti").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def _leaking(index: ItemIndex, texts: pa.Array) -> np.ndarray:
    """Marks of the texts that hold an item of the index."""
    data, offsets = lowered(texts)
    marks = np.zeros(len(texts), bool)
    for i, j in row_slices(offsets):
        marks[index.leaks(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0] + i] = True
    return marks


def _free_of(index: ItemIndex, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~_leaking(index, batch.column(names.index("text"))))).rename_columns(names)

    return run


def _keys_of_leaks(index: ItemIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key").filter(pa.array(_leaking(index, batch.column("text"))))], names=["key"])

    return run
