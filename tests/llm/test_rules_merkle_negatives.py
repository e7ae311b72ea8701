import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from support import SCHEMA, WORDS, edge_frame, edge_rows, ordered, prose

from quillspark.llm import hard_negatives, merkle, rules

# Quality rules


def plain_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    triples = list(zip(words, words[1:], words[2:]))
    often, covered = Counter(triples), set()
    for i, t in enumerate(triples):
        if often[t] > 1:
            covered |= {i, i + 1, i + 2}
    lines, repeated = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            repeated += line in lines
            lines.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)]


ODD_TEXTS = [
    None, "", " \n\t ", "a", "a b c", "a b c a b c", "a a a a", "x\ny\nx\n x\nx \nx", "\n\n\n", "a\r\nb\r\na\r\n", "a\x0bb\x0cc", "é ü é ü é ü", "naïve # $ % & | < > *",
    "a b c\nd a b c", "\x85    ", "line one\nline two\nline one\nline two", "日本語 日本語 日本語 日本語", " lead", "trail ", "x" * 10_000, "ab " * 5_000,
]


def test_counts_are_those_of_plain_python():
    rng = random.Random(4)
    texts = ODD_TEXTS + ["".join(rng.choice("ab \n#é") for _ in range(rng.randrange(80))) for _ in range(400)]
    got = rules.count(pa.array(texts, pa.string()))
    assert [list(map(int, r[:5])) for r in got] == [plain_counts(t) for t in texts]
    sliced = rules.count(pa.array(texts, pa.string()).slice(7, 20))
    assert (sliced == got[7:27]).all()
    assert rules.count(pa.array([], pa.string())).shape == (0, len(rules.COUNTS))


def _judged(spark, rows, labels):
    docs = spark.createDataFrame(rows, SCHEMA)
    return rules.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def _corpus(n):
    """Good prose, and three kinds of bad documents that pass the base rules."""
    rng, rows, labels = random.Random(8), [], []
    for i in range(n):
        words = prose(1000 + i, 80 + rng.randrange(200)).split()
        bad = i % 8 == 0
        if bad:
            kind = rng.randrange(3)
            words = [w.upper() for w in words] if kind == 0 else [w + "###" for w in words] if kind == 1 else [w * 6 for w in words]
        text = "\n".join(" ".join(words[k : k + 12]) + "." for k in range(0, len(words), 12))
        rows.append((i, text, "r", 1, None, 7, 3, len(text)))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_forest_finds_odd_documents_and_keeps_good_ones(spark):
    rows, labels = _corpus(800)
    known = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 4 != 2]
    got = {r.doc_id: r for r in _judged(spark, rows, known).collect()}
    unseen = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    good, bad = [i for i, q, _ in unseen if q], [i for i, q, _ in unseen if not q]
    assert len(got) == 800
    assert sum(got[i].kept for i in good) / len(good) > 0.97
    assert sum(not got[i].kept for i in bad) / len(bad) > 0.9
    for i, text, *_ in rows:
        assert [got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words] == plain_counts(text)


def test_rules_take_odd_rows(spark):
    labels = [(4, 1, 0), (4, 0, 0), (None, 1, 0), (6, None, 0), (13, 1, 0), (7, 1, 0)]
    got = rules.quality_rules(edge_frame(spark), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(edge_rows())
    texts = {}
    for i, t, *_ in edge_rows():
        texts.setdefault(i, []).append(t)
    for r in got:
        plain = [plain_counts(t) for t in texts[r.doc_id]]
        mine = [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words]
        assert mine in plain
        assert r.base_failed == (mine[0] < 50 or 100 * mine[4] > 50 * mine[0])
        assert not (r.base_failed and r.kept)
        assert (r.score is None) == r.base_failed


def test_rules_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = rules.quality_rules(edge_frame(spark), none).collect()
    assert all(r.kept != r.base_failed for r in got)
    assert rules.quality_rules(edge_frame(spark).limit(0), none).collect() == []


def test_threshold_loses_no_more_than_its_share():
    rng = np.random.default_rng(2)
    scores, good = rng.random(5000), rng.random(5000) < 0.8
    for lost in (0.0, 0.01, 0.2):
        t = rules.calibrated(scores, good, lost)
        assert (scores[good] > t).mean() <= lost
        assert lost == 0 or (scores[good] > np.nextafter(t, 0)).mean() >= lost - 1 / good.sum()
    assert rules.calibrated(scores, np.zeros(5000, bool)) == math.inf


def test_every_labelled_row_counts(spark):
    """Of more labelled rows than any bound of old, some tree draws each, all good ones count in every tree, and the threshold is that of all good ones."""
    n, rng = 20_000, np.random.default_rng(5)
    letters = rng.integers(1, 9, (n, 60))
    texts = [" ".join("abcdefgh"[:k] + str(j) * (1 + i % 3) for j, k in enumerate(row)) for i, row in enumerate(letters.tolist())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    good = rng.random(n) < 0.9
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good.tolist())], "doc_id long, quality int")
    model = rules.fit(docs, labels)
    x = rules.statistics(rules.count(pa.array(texts, pa.string())))
    for (feature, _, length, _), leaf in list(zip(model.forest.trees, model.forest.leaves(x), strict=True))[::50]:
        held = np.bincount(leaf[good], minlength=len(feature))
        assert held.sum() == good.sum() and not held[feature >= 0].any()
        depth = length - rules._expected_depth(held * rules.TREE_ROWS / n)
        assert np.allclose(depth, depth.round()) and depth.round().max() <= rules.DEPTH
    scores = model.forest.scores(x)
    assert model.threshold == pytest.approx(rules.calibrated(scores, good), abs=1e-12)
    known = rules.teachers(rules.counted(docs, "doc_id"), labels)
    assert known.count() == n
    taken = rules.drawn(known, n).select("tree", "doc_id", "place").toPandas().sort_values(["tree", "place"]).groupby("tree").head(rules.TREE_ROWS)
    assert len(taken) == rules.TREES * rules.TREE_ROWS and taken.doc_id.nunique() == n


def test_the_nth_highest_score_is_exact(spark):
    rng = random.Random(6)
    for scores in ([0.5], [0.25] * 40, [rng.random() for _ in range(3000)], [rng.choice((0.1, 0.1 + 2e-17, 0.3, 0.3 + 6e-17)) for _ in range(500)]):
        rows = spark.createDataFrame([(x,) for x in scores], "score double")
        down = sorted(scores, reverse=True)
        for k in {1, len(down) // 3 + 1, len(down)}:
            assert rules.nth_highest(rows, k) == down[k - 1]
    assert rules.threshold(rows.limit(0)) == math.inf


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def above(nodes):
    return [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]


def path(nodes, at):
    """(siblings and sides of a node up to the last one, the last one)."""
    steps = []
    while len(nodes) > 1:
        mate = at ^ 1
        steps.append((nodes[mate], mate < at) if mate < len(nodes) else (None, False))
        nodes, at = above(nodes), at // 2
    return steps, nodes[0]


def fold(x, steps):
    for mate, left in steps:
        x = h(x) if mate is None else h(mate, x) if left else h(x, mate)
    return x


def plain_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    leaf = lambda r, more=0: h(*map(field, (r[0], r[3], r[2], r[4] if r[4] is None else r[4] + more, r[1])))
    trees = {}
    for r in rows:
        trees.setdefault("n" if r[2] is None else "v" + r[2], []).append(r)
    names = sorted(trees, key=lambda s: s.encode())
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    tops = [path([leaf(r) for r in trees[name]], 0)[1] for name in names]
    out = []
    for k, name in enumerate(names):
        hashes = [leaf(r) for r in trees[name]]
        outer, root = path(tops, k)
        for i, r in enumerate(trees[name]):
            steps = path(hashes, i)[0] + outer
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = fold(leaf(r, 1) if bad else hashes[i], steps)
            out.append((r[0], hashes[i], tops[k], root, h(*(m for m, _ in steps if m is not None)), folded, folded == root))
    return out


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _documents(seed, n, langs):
    rng = random.Random(seed)
    return [(i if rng.random() > 0.03 else None, rng.choice(["", None, prose(i, 5), "é:9"]), rng.choice(langs), rng.choice(["a", "", None]), rng.choice([None, 0, 7, 12])) for i in range(n)]


@pytest.mark.parametrize(("n", "langs", "levels"), [(1, ["en"], 12), (2, [None], 12), (37, ["en", "de", None, ""], 12), (500, ["en"], 2), (700, ["en", "é", "z", None, ""], 3), (90, [f"l{i}" for i in range(40)], 1)])
def test_manifest_is_that_of_plain_python(spark, n, langs, levels):
    rows = _documents(n, n, langs)
    got = merkle.manifest(spark.createDataFrame(rows, DOCS), levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert ordered(got.collect()) == ordered(plain_manifest(rows))


def test_manifest_of_repeated_rows_and_clashing_columns(spark):
    rows = [(3, "same", "en", "s", 4)] * 200 + [(3, "other", "en", "s", 5), (None, "x", "en", "s", 1), (None, "x", "en", "s", 1)]
    wide = spark.createDataFrame([(*r, "g", 1, "h", 2) for r in rows], DOCS + ", grp string, pos int, leaf string, size int")
    assert ordered(merkle.manifest(wide, 3).collect()) == ordered(plain_manifest(rows))


def test_manifest_verifies_all_but_tampered_rows(spark):
    rows = [(i, prose(i, 20), "en", "s", 7) for i in range(300)]
    for r in merkle.manifest(spark.createDataFrame(rows, DOCS)).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)


def test_manifest_of_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_manifest_sql_agrees(spark, tmp_path):
    rows = _documents(5, 150, ["en", "de", None])
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'").fetchall()
    assert ordered(db.execute(merkle.SQL).fetchall()) == ordered(plain_manifest(rows))


# Hard negatives


def plain_negatives(rows):
    """rows: (vec_id, embedding, label)."""
    kept = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, tuple(math.floor(256 * x) for x in v), (label + 1) % 10 if i % 7 == 0 else label))
    kept = sorted(set(kept))
    out = []
    for a in kept:
        if a[0] % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a[1], b[1])), b[0], b[2]) for b in kept if b != a)
            for s, i, _ in [x for x in scored if x[2] == a[2]][:5]:
                window = [x for x in scored if x[2] != a[2] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
                out += [(a[0], i, k + 1, x[1], -s, -x[0]) for k, x in enumerate(window)]
    return out


EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def _vectors(seed, n, d, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    return [(i, [float(np.float32(x)) for x in centres[rng.integers(6)] + spread * rng.normal(size=d)], int(rng.integers(4))) for i in range(n)]


@pytest.mark.parametrize(("n", "d", "spread", "shard", "block"), [(1500, 8, 0.3, 400, 4), (900, 3, 1.0, 16_384, 2_048), (700, 1, 1.0, 100, 3)])
def test_negatives_are_those_of_brute_force(spark, n, d, spread, shard, block):
    rows = _vectors(n, n, d, spread)
    got = hard_negatives.mine(spark.createDataFrame(rows, EMBEDDINGS), shard, block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert ordered(got.collect()) == ordered(plain_negatives(rows))


def test_negatives_of_odd_rows(spark):
    """Ties by the hundred, repeated rows, nulls, values that are not finite, zero vectors, clashing columns."""
    inf = float("inf")
    rows = _vectors(3, 300, 4) + [(1000 + i, [0.5, 0.25, 0.0, 1.0], i % 3) for i in range(300)]
    rows += [(100, rows[100][1], rows[100][2])] * 3 + [(2000, None, 1), (2001, [1.0, None, 0.0, 0.0], 1), (2100, [inf, 0.0, 0.0, 0.0], 1), (2101, [float("nan"), 0.0, 0.0, 0.0], 2), (2102, [1.0, 1.0, 1.0, 1.0], None), (2200, [0.0] * 4, 1)]
    wide = spark.createDataFrame([(*r, 1, 2, "s") for r in rows], EMBEDDINGS + ", query long, shard int, v string")
    assert ordered(hard_negatives.mine(wide, 128, 2).collect()) == ordered(plain_negatives(rows))


def test_negatives_take_large_whole_numbers_and_short_vectors():
    x = np.array([[1 << 29, 3], [1 << 29, 4], [(1 << 29) - 1, 9], [5, 5]])
    ids, labels = np.arange(4), np.array([0, 1, 1, 1])
    q, r, s = hard_negatives.search(x, ids, labels, np.array([[1 << 29, 1, 1]]), np.array([0]), np.array([0]), np.array([-(1 << 62)]), np.array([1 << 62]), 2, False)
    assert list(r) == [1, 2] and [int(v) for v in s] == [(1 << 58) + 4, ((1 << 29) - 1) * (1 << 29) + 9]


def test_negatives_of_no_rows(spark):
    assert hard_negatives.mine(spark.createDataFrame([], EMBEDDINGS)).collect() == []


def test_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.1, (200, 3)) for c in range(8)])
    tree, q = hard_negatives.VantageTree(x, 50), rng.normal(3, 3, (20, 3))
    low, high = tree.bounds(q)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(len(x)))
    for k, rows in enumerate(tree.leaves):
        d = np.sqrt(((q[:, None] - x[rows]) ** 2).sum(2))
        assert (low[:, k] <= d.min(1) + 1e-9).all() and (high[:, k] >= d.max(1) - 1e-9).all()
    assert (low > 0.5).mean() > 0.3
