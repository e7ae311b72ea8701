"""Near duplicates against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from support import SCHEMA, WORDS, edge_frame, edge_rows, ordered, prose

import corpus_pipeline
from quillspark.llm import minhash
from quillspark.llm.components import components


def brute(rows):
    sets, ids = [], []
    for d, t in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = WORDS.findall(t)
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4))))
        ids.append(float("inf") if d is None else d)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for v in holders.values() for k, b in enumerate(v) for a in v[:k])
    for (a, b), n in common.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = least[find(i)]
        c = None if c == float("inf") else c
        out.append((d, len(sets[i]), c, c == d))
    return ordered(out)


def test_edge_cases(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    got = minhash.near_duplicates(edge_frame(spark)).select("doc_id", "n_shingles", "component_id", "kept")
    assert ordered(got.collect()) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_families_of_edited_copies(spark, seed, monkeypatch):
    """Chains and stars of edits around the threshold; hubs alone would miss some links."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 800)
    monkeypatch.setattr(minhash, "SLICE_SHINGLES", 1_800)
    rng = random.Random(seed)
    rows, k = [], 0
    for f in range(5):
        base = prose(100 * seed + f, 120).split()
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.2:
                base = w
            if rng.random() < 0.1:
                w = w[rng.randrange(20) :]
            rows.append((k, " ".join(w)))
            k += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept")
    assert ordered(got.collect()) == brute(rows)
    kept = minhash.deduplicated(df)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in brute(rows) if r[3]}


def test_copies_count_as_one_class(spark):
    rows = [(i, prose(5, 60)) for i in range(50)] + [(99, prose(6, 60))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.component_id, r.n_confirmed) for r in got} == {(0, 0, 0), (99, 99, 0)}


def test_deduplicated_keeps_columns_and_one_of_repeated_rows(spark):
    out = minhash.deduplicated(edge_frame(spark))
    assert out.columns == edge_frame(spark).columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [0, 1, 2, 3, 5, 6, 7, 8, 10, 11]


def test_the_stage_links_from_four_fifths(spark):
    """Two edits of 104 words: 90 of 110 shingles are common, 0.82."""
    words = prose(8, 104).split()
    near = " ".join("edit" if i in (30, 70) else w for i, w in enumerate(words))
    df = spark.createDataFrame([(1, " ".join(words)), (2, near), (3, prose(9, 104))], "doc_id long, text string")
    assert {r.doc_id for r in minhash.near_duplicates(df).filter("kept").collect()} == {1, 2, 3}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()} == {1, 3}


def test_null_and_repeated_ids_are_told_apart_by_their_texts(spark):
    a, b, c, d = (prose(40 + i, 120) for i in range(4))
    near_a, near_d = a + " more", d + " more"
    rows = [(1, a), (None, near_a), (None, b), (5, near_a + " of it"), (5, b + " " + c), (5, c), (None, d), (None, near_d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = minhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept")
    assert ordered(labelled.collect()) == brute(rows)
    got = {(r.doc_id, r.text) for r in minhash.deduplicated(df).collect()}
    last = (None, d) if (None, d) in got else (None, near_d)
    assert got == {(1, a), (None, b), (5, b + " " + c), (5, c), last}


def test_rows_under_the_id_of_their_component_are_all_kept(spark):
    a, b = prose(50, 120), prose(51, 120)
    rows = [(7, a), (7, a + " more"), (9, a + " of it"), (None, b), (None, b + " more"), (None, prose(52, 120)), ((1 << 63) - 1, prose(53, 120))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept")
    assert ordered(got.collect()) == brute(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in got.collect()} == {(7, 7, True), (9, 7, False), (None, None, True), ((1 << 63) - 1, (1 << 63) - 1, True)}
    assert minhash.deduplicated(df).count() == 4


def test_words_with_one_polynomial_are_different(spark):
    """A pair under the threshold by one long word, which polynomials modulo 2^64 cannot tell from its complement."""
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    left, right = prose(60, 29), prose(61, 29)
    rows = [(1, f"{left} {a} {right}"), (2, f"{left} {b} {right}")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id", "kept")
    assert ordered(got.collect()) == brute(rows) and [r[2] for r in brute(rows)] == [1, 2]


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert minhash.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_estimate_is_corrected_for_chance(spark):
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    signatures = []
    for part in (shared[:2000], shared[1000:3000]):
        signatures.append(minhash.packed_bits(minhash.minima(part, np.array([0, len(part)])))[0].tolist())
    df = spark.createDataFrame([(signatures[0], signatures[0]), (signatures[0], signatures[1])], "a array<long>, b array<long>")
    same, third = [r[0] for r in df.selectExpr(minhash.estimate("a", "b")).collect()]
    assert same == pytest.approx(1.0) and abs(third - 1 / 3) < 0.2


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    random.Random(3).shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
