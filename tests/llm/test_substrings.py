"""Repeated windows and byte strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from support import WORDS, SCHEMA, edge_frame, edge_rows, ordered, prose

from quillspark.llm import fm_dedup, suffix_dedup, text

LAST = 1 << 63


def brute_windows(rows, n):
    first = {}
    for d, t in rows:
        w = WORDS.findall(t or "")
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, LAST), LAST - 1 if d is None else d)
    out = []
    for d, t in rows:
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < (LAST - 1 if d is None else d):
                gone[i : i + n] = [True] * n
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return ordered(out)


def brute_bytes(rows, n):
    count = Counter(b[i : i + n] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - n + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return ordered(out)


def woven(seed):
    """Documents that share passages of many lengths, with edits, in several places."""
    rng = random.Random(seed)
    shared = [prose(900 + i, 80) for i in range(4)]
    rows = []
    for d in range(30):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            w = rng.choice(shared).split()
            a = rng.randrange(0, 30)
            part = w[a : a + rng.randrange(20, 70)]
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "edit"
            parts += [" ".join(part), prose(rng.randrange(10**6), rng.randrange(0, 30))]
        rows.append((d, rng.choice([" ", "\n", "  "]).join(parts)))
    return rows


def test_windows_of_edge_cases(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    assert ordered(fm_dedup.dedup_windows(edge_frame(spark)).collect()) == brute_windows(rows, 50)


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_of_woven_documents(spark, seed):
    rows = woven(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(fm_dedup.dedup_windows(df).collect()) == brute_windows(rows, 50)
    assert ordered(fm_dedup.dedup_windows(df, 15, 5).collect()) == brute_windows(rows, 15)


def test_bytes_of_edge_cases(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    assert ordered(suffix_dedup.dedup_substrings(edge_frame(spark)).collect()) == brute_bytes(rows, 200)


@pytest.mark.parametrize("seed", [3, 4])
def test_bytes_of_woven_documents(spark, seed):
    rows = woven(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(suffix_dedup.dedup_substrings(df).collect()) == brute_bytes(rows, 200)


def test_frequent_grams_change_nothing(spark, monkeypatch):
    from quillspark.llm import gram_load

    line = "all the terms and conditions of this licence apply to every copy of the work in any form"
    rows = [(d, f"{t} {line} {prose(d, 40)} {line}\n{line} {t[:150]}") for d, t in woven(7)] + [(90 + i, line * 12) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    plain = gram_load.frequent_cells
    for times, least in ((8, 2_000), (1, 5), (0, 0)):
        monkeypatch.setattr(gram_load, "TIMES", times)
        monkeypatch.setattr(gram_load, "LEAST", least)
        for module in (fm_dedup, suffix_dedup):
            monkeypatch.setattr(module, "frequent_cells", lambda *a: seen.append(plain(*a)) or seen[-1])
        assert ordered(fm_dedup.dedup_windows(df).collect()) == brute_windows(rows, 50)
        assert ordered(suffix_dedup.dedup_substrings(df).collect()) == brute_bytes(rows, 200)
    assert seen[0] is None and seen[2].any() and seen[4].sum() > seen[2].sum()


def test_no_anchor_gathers_more_contexts_than_the_bound(spark, monkeypatch):
    """A common line between different texts, under the bar of the cells: it must not be the anchor of them all."""
    line = prose(70, 26)
    rows = [(d, f"{prose(1000 + d, 60)} {line} {prose(3000 + d, 60)}") for d in range(60)] + [(90, f"{prose(1003, 60)} {line}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain, seen = fm_dedup.bounded_anchors, []
    for module, name in ((fm_dedup, "earlier_ranges"), (suffix_dedup, "repeated_ranges")):
        monkeypatch.setattr(module, "bounded_anchors", lambda *a: seen.append(plain(*a)) or seen[-1])
        monkeypatch.setattr(module, "forget", lambda *a: None)
        ranges = getattr(module, name)
        covered = [{(r.rid, i) for r in ranges(module.keyed(df), shard_contexts=most).collect() for x in r.ranges for i in range(x.start, x.end)} for most in (1000, 10)]
        assert covered[0] == covered[1] and covered[0]
        most = [a.join(s, "anchor").select("anchor", "span").distinct().groupBy("anchor").count().agg({"count": "max"}).first()[0] for a, s in seen[-2:]]
        assert most[0] > 10 >= most[1]


def test_ranges_of_a_row_do_not_grow_with_its_copies(spark):
    shared = prose(50, 150)
    rows = [(0, shared)] + [(None, shared + " " + prose(51, 60))] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for module, ranges in ((fm_dedup, fm_dedup.earlier_ranges), (suffix_dedup, suffix_dedup.repeated_ranges)):
        found = [(r.rid, x.start, x.end) for r in ranges(module.keyed(df)).collect() for x in r.ranges]
        assert found and len(found) == len(set(found))
    assert ordered(suffix_dedup.dedup_substrings(df).collect()) == brute_bytes(rows, 200)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fm_dedup.dedup_windows(empty).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert fm_dedup.dedup_windows(empty).count() == 0
    assert suffix_dedup.dedup_substrings(empty).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert suffix_dedup.dedup_substrings(empty).count() == 0


def test_wavelet_ranks_are_counts():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 37, 1000)
    tree = fm_dedup.WaveletMatrix(values, 6)
    symbols, ends = rng.integers(0, 37, 200), rng.integers(0, 1001, 200)
    assert tree.ranks(symbols, ends).tolist() == [int((values[:e] == s).sum()) for s, e in zip(symbols, ends, strict=True)]


def _packed(texts):
    return np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def test_backward_search_gives_matching_statistics_and_holders():
    """Of streams that are not in the index: lengths of the longest matches, through mismatches and unknown symbols."""
    rng = np.random.default_rng(1)
    held = [rng.integers(1, 4, n) for n in (8, 20, 5, 13)]
    asked = [rng.integers(1, 5, n) for n in (30, 9, 17, 1)] + [np.concatenate([held[1][3:12], [9], held[3]])]
    index = fm_dedup.FMIndex(*_packed(held), 5, np.array([40, 30, 20, 10]))
    inside = lambda w: [v for v, t in zip((40, 30, 20, 10), held, strict=True) if any(w == t[i : i + len(w)].tolist() for i in range(len(t)))]
    seen = 0
    for texts, places, lengths, at in index.stream(*_packed(asked)):
        for t, p, n, a in zip(texts, places, lengths, at, strict=True):
            tail = asked[t][p : p + 5].tolist()
            assert n == max(k for k in range(len(tail) + 1) if not k or inside(tail[:k]))
            if n == 5:
                seen += 1
                assert index.holders(np.array([a]))[0] == min(inside(tail))
    assert seen > 5


def test_range_minima():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 50, 300).astype(np.uint8)
    first = rng.integers(0, 300, 500)
    last = np.minimum(first + rng.integers(0, 300, 500), 299)
    assert fm_dedup.Minima(values).of(first, last).tolist() == [int(values[a : b + 1].min()) for a, b in zip(first, last, strict=True)]


def test_contexts_meet_every_earlier_one_of_their_anchor():
    rng = np.random.default_rng(2)
    texts = [rng.integers(1, 3, rng.integers(4, 12)) for _ in range(40)]
    anchor, doc = rng.integers(0, 5, 40), rng.integers(0, 25, 40)
    hit = fm_dedup.repeats_of_earlier(*_packed(texts), anchor, doc, 4)
    windows = [(i, tuple(t[k : k + 4].tolist())) for i, t in enumerate(texts) for k in range(len(t) - 3)]
    sure = [any(w == v and doc[j] < doc[i] and anchor[i] == anchor[j] for j, v in windows) for i, w in windows]
    may = [any(w == v and doc[j] < doc[i] for j, v in windows) for i, w in windows]
    assert all(h >= s and h <= m for h, s, m in zip(hit, sure, may, strict=True)) and hit.any() and not hit.all()


@pytest.mark.parametrize("portion", [1 << 17, 7])
def test_bucket_pointer_refinement_sorts_suffixes(portion, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "REFINE_AT_ONCE", portion)
    rng = np.random.default_rng(3)
    data = np.concatenate([np.frombuffer(b"zebra apple " * 30, np.uint8), rng.integers(97, 99, 600).astype(np.uint8), np.full(100, 97, np.uint8)])
    order = suffix_dedup.suffix_array(suffix_dedup.byte_grams(data), 64)
    suffixes = [(bytes(data[i : i + 64]) + bytes(64))[:64] for i in order]
    assert sorted(order.tolist()) == list(range(len(data))) and suffixes == sorted(suffixes)


@pytest.mark.parametrize("length", [8, 20, 64])
def test_neighbours_of_the_suffix_array_are_the_repeats(length):
    rng = np.random.default_rng(length)
    data = np.concatenate([rng.integers(97, 99, 300).astype(np.uint8), np.frombuffer(b"ab" * 50, np.uint8)])
    wanted = np.zeros(len(data), bool)
    wanted[rng.permutation(len(data) - length)[:250]] = True
    count = Counter(bytes(data[i : i + length]) for i in np.flatnonzero(wanted))
    got = suffix_dedup.repeated_places(data, wanted, length)
    assert got.tolist() == [bool(w) and count[bytes(data[i : i + length])] > 1 for i, w in enumerate(wanted)]


def thue_morse(n):
    """Two different words that polynomials modulo 2^64 cannot tell apart, whatever the base."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_with_one_polynomial_are_different(spark):
    a, b = thue_morse(4096)
    rows = [(0, prose(1, 30) + f" {a} " + prose(2, 30)), (1, prose(1, 30) + f" {b} " + prose(2, 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ordered(fm_dedup.dedup_windows(df).collect())
    assert got == brute_windows(rows, 50) and [r[2] for r in got] == [0, 0]
    assert ordered(suffix_dedup.dedup_substrings(df).collect()) == brute_bytes(rows, 200)


def test_long_runs_of_one_sign_are_few_contexts(spark):
    rows = [(0, " " * 300_000), (1, "ha " * 60_000), (2, prose(9, 100) + " " * 5_000 + prose(10, 100))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ranges = suffix_dedup.repeated_ranges(suffix_dedup.keyed(df).select("rid", "text"))
    assert ranges.selectExpr("max(size(ranges))").first()[0] < 2_000
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.dedup_substrings(df).collect()}
    assert got[0] == (300_000, 300_000) and got[1] == (180_000, 180_000) and got[2][1] >= 5_000
    assert {r.doc_id: r.n_removed for r in fm_dedup.dedup_windows(df).collect()} == {0: 0, 1: 0, 2: 0}


def test_texts_in_portions_give_the_same(spark, monkeypatch):
    """A text longer than a portion is cut with overlap; no window is lost or judged twice."""
    body = np.frombuffer((prose(3, 400) + " " + prose(3, 400)).encode(), np.uint8)
    offsets = np.array([0, len(body)])
    parts = list(text.byte_parts(offsets, 200, 500))
    assert [x for a, b, _, _ in parts for x in range(a, b - 199)] == list(range(len(body) - 199))
    words = text.Words(body, offsets)
    cut = [(w + x) for h, first, r, w in words.parts(50, 90) for x in range(len(h) - 49)]
    assert cut == list(range(len(words.start) - 49))
    whole = words.hashes()
    assert all((h == whole[w : w + len(h)]).all() for h, first, r, w in words.parts(50, 90))


def test_anchors_cover_each_window_once():
    data = np.frombuffer(("abcab " * 40 + prose(5, 60)).encode(), np.uint8)
    first = np.array([0, 100, 100, 130, len(data)])
    rows, place, start, n, _ = text.window_anchors(text.Prefix(data, "byte").grams(8), first, 30, 8)
    seen = [(int(r), int(s) + i) for r, s, m in zip(rows, start, n, strict=True) for i in range(m)]
    assert seen == [(r, s) for r in range(4) for s in range(first[r], first[r + 1] - 29)]
    grams = text.Prefix(data, "byte").grams(8)
    assert all(grams[p] in grams[s + i : s + i + 23] for p, s, m in zip(place, start, n, strict=True) for i in range(m))
