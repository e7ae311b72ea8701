"""Audio fingerprints, the pipeline and the registered queries."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import edge_frame, ordered, prose

import corpus_pipeline
from quillspark.llm import catalog, chroma, decontaminate, minhash, pii, quality, sentencepiece_codec

SF = "/root/testdata/sf0.001"


def _sound(seed, notes=64):
    rng = np.random.default_rng(seed)
    return chroma.sonified(rng.normal(0, 0.125, (1, notes)))[0]


def _prints(sound):
    return chroma.fingerprints(chroma.chroma(sound[None].astype(np.float32) / 32768))[0]


def _brute(queries, all_prints):
    """Best bit error over every offset with enough overlap."""
    out = {}
    for q in queries:
        for r, p in all_prints.items():
            a, best = all_prints[q], (1.0, 0)
            for offset in range(-len(a) + 1, len(p)):
                x, y = p[max(offset, 0) :], a[max(-offset, 0) :]
                n = min(len(x), len(y))
                if n >= min(chroma.MIN_OVERLAP, len(a), len(p)):
                    best = min(best, (float(np.bitwise_count(x[:n] ^ y[:n]).sum()) / 32 / n, offset))
            out[q, r] = best
    return out


def test_recall_of_shifted_and_noisy_recordings(spark):
    rng = np.random.default_rng(1)
    sounds = {}
    for k in range(12):
        base = _sound(k)
        sounds[100 * k] = base
        sounds[100 * k + 1] = base[4 * chroma.HOP :]
        noisy = base.astype(float) + rng.normal(0, 600, len(base))
        sounds[100 * k + 2] = np.clip(noisy, -32768, 32767).astype(np.int16)
        sounds[100 * k + 3] = np.concatenate([_sound(1000 + k, 10), base])
        sounds[100 * k + 4] = _sound(500 + k)
    media = spark.createDataFrame([(i, s.tobytes()) for i, s in sounds.items()], "media_id long, pcm binary")
    got = {(m.query_class, r.media_id): m for r in chroma.align(media).collect() for m in r.matches}
    prints = {i: _prints(s) for i, s in sounds.items()}
    brute = _brute([i for i in sounds if i % 100 == 0], prints)
    want = {pair for pair, (error, _) in brute.items() if error <= chroma.MAX_BIT_ERROR}
    assert len(want) >= 36 and set(got) <= want and len(set(got) & want) >= 0.9 * len(want)
    for pair, match in got.items():
        assert match.bit_error == pytest.approx(brute[pair][0]) and match.offset == brute[pair][1]
    assert got[(0, 1)].offset == -4


def test_search_in_several_blocks(spark, monkeypatch):
    media = spark.createDataFrame([(50 * i, _sound(i % 4).tobytes()) for i in range(16)], "media_id long, pcm binary")
    whole = ordered((r.media_id, r.class_id, r.n_matches) for r in chroma.align(media).collect())
    assert {c for _, c, _ in whole} == {0, 50, 100, 150}
    monkeypatch.setattr(chroma, "BLOCK_PRINTS", 1)
    monkeypatch.setattr(chroma, "_HITS", 10)
    assert ordered((r.media_id, r.class_id, r.n_matches) for r in chroma.align(media).collect()) == whole


def test_audio_edge_cases(spark):
    rows = [(1, None), (2, b""), (3, b"\x01"), (4, _sound(1)[:500].tobytes()), (None, _sound(2).tobytes()), (5, _sound(2).tobytes()), (5, _sound(2).tobytes()), (100, np.zeros(40_000, np.int16).tobytes())]
    media = spark.createDataFrame(rows, "media_id long, pcm binary").withColumn("prints", F.lit(1)).withColumn("class_id", F.lit(2))
    got = chroma.align(media).collect()
    assert len(got) == len(rows) and {r.media_id: r.class_id for r in got if r.media_id is not None} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 100: 100}
    assert [r.class_id for r in got if r.media_id is None] == [5]
    assert [r.n_matches for r in got if r.media_id == 100] == [1]
    assert chroma.align(media.limit(0)).count() == 0
    vectors = spark.createDataFrame([(1, None), (2, []), (3, [0.1, None, float("nan")]), (4, [0.5] * 64)], "vec_id long, embedding array<float>")
    sizes = {r.media_id: len(r.pcm) for r in chroma.recordings(vectors).collect()}
    assert sizes == {1: 0, 2: 0, 3: 2 * 3 * chroma.NOTE_SAMPLES, 4: 2 * 64 * chroma.NOTE_SAMPLES}


def test_integral_image_filters_equal_plain_sums():
    features = np.random.default_rng(0).uniform(size=(1, 20, 12))
    kind, y, h, x, w = chroma.FILTERS[1]
    assert kind == 1
    got = (chroma.fingerprints(features)[0] >> np.uint32(28)) & np.uint32(3)
    for t in range(5):
        part = features[0, t + x : t + x + w, y : y + h]
        value = np.log((1 + part[: w // 2].sum()) / (1 + part[w // 2 :].sum()))
        assert got[t] == chroma._GRAY[np.searchsorted(chroma._CUTS, value)]


# Pipeline


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Good, junk, copied, leaking and personal documents."""
    folder = str(tmp_path_factory.mktemp("sf"))
    item = prose(77, 40)
    rows = [(i, prose(i, 60 + i)) for i in range(60)]
    rows += [(100 + i, " ".join(w + "%%%" for w in prose(i, 60).split())) for i in range(30)]
    rows += [(200, rows[3][1]), (201, rows[4][1] + " more"), (202, prose(900, 50) + " " + item + " " + prose(901, 50)), (203, prose(902, 60) + " 4111111111111111 end")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 0 if 100 <= i < 200 else 1, 0) for i, _ in rows if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(rows)


def test_pipeline_takes_effect_stage_by_stage(spark, tables):
    folder, texts = tables
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        seen.append({r.doc_id: r for r in docs.collect()})
    assert set(seen[0]) == set(range(60)) | {200, 201, 202, 203}
    assert set(seen[1]) == set(range(60)) | {202, 203}
    assert set(seen[2]) == set(range(60)) | {203}
    assert set(seen[3]) == set(seen[2]) and "4111111111111111" not in seen[3][203].text
    assert all(seen[3][i].text == texts[i] for i in range(60)) and seen[3][203].n_chars == len(seen[3][203].text)
    library = sentencepiece_codec.vocabulary(sentencepiece_codec.MODEL).processor
    assert all(r.restored and r.ids == library.encode(seen[3][i].text) for i, r in seen[4].items())
    assert ordered((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()) == ordered((i, tuple(r.ids)) for i, r in seen[4].items())


def test_stages_take_odd_rows(spark, tables):
    folder, _ = tables
    docs = edge_frame(spark).withColumnRenamed("row", "a.`b")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_stages_call_the_operators():
    used = {quality, minhash, decontaminate, pii, sentencepiece_codec}
    assert len(corpus_pipeline.STAGES) == 5 and used <= {v for v in vars(corpus_pipeline).values() if type(v) is type(os)}
    assert corpus_pipeline.ORACLE_SQL is None


# Registered queries


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_queries_cover_their_tables(spark, name):
    table = {"op7_chroma_fingerprints": "embeddings", "op10_html_blocks": "pages", "op13_hard_negatives": "embeddings"}.get(name, "documents")
    rows = catalog.queries()[name](spark, SF)
    n = rows.count()
    assert n == spark.read.parquet(f"{SF}/{table}.parquet").count() or (name.startswith(("op9_", "op13_")) and n > 0)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.queries()) == list(range(1, 14))
