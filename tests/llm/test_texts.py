"""Personal data, quality, toxicity, leaks, tokens and pages."""

import datetime
import hashlib
import html
import ipaddress
import os
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from support import SCHEMA, edge_frame, edge_rows, ordered, prose

from quillspark.llm import decontaminate, html_blocks, pii, quality, sentencepiece_codec, toxicity
from quillspark.llm.text import text_bytes

# Personal data


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_ok(text):
    t = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def replaced(spark, *texts, key=pii.KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.pseudonymize(df, key).orderBy("doc_id").collect()
    return [r.text for r in rows], [r.n_replaced for r in rows]


def test_pseudonyms_keep_their_format(spark):
    texts = [
        "4111111111111111", "5500 0000 0000 0004", "3782-822463-10005", "078-05-1120", "97.51.17.173", "+1 (017) 555-7713", "jo.Ann.55@mail4.example.com",
        "1987-06-05", "05/06/1987", "12/31/1999", "5.6.1987", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32",
    ]
    out, n = replaced(spark, *texts)
    assert n == [1] * len(texts) and all(a != b for a, b in zip(texts, out, strict=True))
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", t)))
    for i in (0, 1, 2, 3, 5, 6, 7, 8, 9, 11, 12):
        assert shape(texts[i]) == shape(out[i])
    assert all(luhn(re.sub(r"\D", "", out[i])) and out[i][:4] == texts[i][:4] for i in (0, 1, 2))
    area, group, serial = map(int, out[3].split("-"))
    assert 0 < area < 900 and area != 666 and group and serial
    assert all(int(p) < 256 for p in out[4].split("."))
    assert out[5].startswith("+1 (") and out[6].endswith("@mail4.example.com")
    datetime.date.fromisoformat(out[7])
    datetime.datetime.strptime(out[8], "%d/%m/%Y")
    datetime.datetime.strptime(out[9], "%m/%d/%Y")
    datetime.datetime.strptime(out[10], "%d.%m.%Y")
    assert iban_ok(out[11]) and iban_ok(out[12]) and out[11][:2] == "DE"


def test_invalid_values_stay(spark):
    texts = ["4111111111111112", "9111111111111111", "666-12-1234", "000-12-1234", "300.1.1.1", "1987-02-30", "31/06/1990", "GB00WEST12345698765432", "v1.2.3.4", "version 2.0", "a@b", "0x4111111111111111f"]
    assert replaced(spark, *texts) == (texts, [0] * len(texts))


def test_equal_values_stay_linked_and_keys_matter(spark):
    one, _ = replaced(spark, "a 4111111111111111 b", "4111 1111 1111 1111; 4111111111111111!")
    number = re.search(r"\d{16}", one[0])[0]
    assert one[1].replace(" ", "").count(number) == 2
    assert replaced(spark, "4111111111111111", key="other")[0] != replaced(spark, "4111111111111111")[0]


@pytest.mark.parametrize("domain", [[f"{i:02d}" for i in range(100)], [f"{i:03d}" for i in range(1000)]])
def test_digit_network_is_a_permutation(spark, domain):
    df = spark.createDataFrame([(d,) for d in domain], "d string").select(F.expr(pii.Pseudonyms().let("y", "d", pii.Pseudonyms().digits("t", "y"))))
    assert sorted(r[0] for r in df.collect()) == domain


def test_dates_are_a_permutation(spark):
    days = [(datetime.date(1900, 1, 1) + datetime.timedelta(i)).isoformat() for i in range(270 * 271)]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.expr(pii.Pseudonyms.let("m", "d", pii.Pseudonyms().date("m"))))
    assert sorted(r[0] for r in df.collect()) == days


def feistel(key, kind, left, right, a, b):
    """The network on Z_a x Z_b, written anew."""
    for i in range(1, pii.ROUNDS + 1):
        h = hashlib.sha256(f"{key}|{kind}|{i}|{right}".encode()).hexdigest()[:13]
        left, right = right, (left + int(h, 16)) % (a if i % 2 else b)
    return left, right


def feistel_digits(key, kind, d):
    a, b = (len(d) + 1) // 2, len(d) // 2
    left, right = feistel(key, kind, int(d[:a]), int(d[a:]), 10**a, 10**b)
    return f"{left:0{a}d}{right:0{b}d}"


def test_pseudonyms_against_an_independent_network(spark):
    got, n = replaced(spark, "card 4111 1111 1111 1111", "ip 10.0.200.7", "call +49 30 1234567", "id 123-45-6789", "on 2020-02-29", key="k")
    body = "4111" + feistel_digits("k", "card", "11111111111")
    card = next(body + c for c in "0123456789" if luhn(body + c))
    left, right = feistel("k", "ipv4", 10 * 256, 200 * 256 + 7, 65536, 65536)
    phone = feistel_digits("k", "phone", "301234567")
    area, serial = feistel("k", "ssn", 122 * 99 + 44, 6788, 898 * 99, 9999)
    area, group = divmod(area, 99)
    day = (datetime.date(2020, 2, 29) - datetime.date(1900, 1, 1)).days
    high, low = feistel("k", "date", day // 271, day % 271, 270, 271)
    assert n == [1] * 5 and got == [
        "card " + " ".join(card[i : i + 4] for i in range(0, 16, 4)),
        f"ip {left // 256}.{left % 256}.{right // 256}.{right % 256}",
        f"call +49 {phone[:2]} {phone[2:]}",
        f"id {area + (2 if area >= 665 else 1):03d}-{group + 1:02d}-{serial + 1:04d}",
        f"on {datetime.date(1900, 1, 1) + datetime.timedelta(high * 271 + low)}",
    ]


def test_one_value_has_one_pseudonym_in_all_spellings(spark):
    got, n = replaced(spark, "+1 415 555 2671", "+14155552671", "(415) 555-2671", "415-555-2671", "2001:db8::1", "2001:0DB8:0:0:0:0:0:0001", "2001:db8::2")
    assert n == [1] * 7
    bare = [re.sub(r"[^0-9]", "", x) for x in got[:4]]
    assert bare[0] == bare[1] == "1" + bare[2] == "1" + bare[3]
    a, b, c = (ipaddress.ip_address(x) for x in got[4:])
    assert a == b != c and int(a) >> 64 == int(c) >> 64 != 0x20010DB800000000


def test_names_beyond_latin_and_what_stands_after_an_iban(spark):
    got, n = replaced(spark, "иван@пример.рф", "Ο λόγος: γιώργος@example.gr", "田中@example.jp", "BE68 5390 0754 7034 EUR", "to DE89370400440532013000 2024 X1", "12:30:45 and a::b c::d")
    assert n == [1, 1, 1, 1, 1, 0]
    assert re.fullmatch(r"[а-я]{4}@пример[.]рф", got[0]) and "иван" not in got[0]
    assert "γιώργος" not in got[1] and re.fullmatch(r"[一-鿿]{2}@example[.]jp", got[2]) and "田中" not in got[2]
    assert got[3].endswith(" EUR") and iban_ok(got[3][:-4]) and got[4].endswith(" 2024 X1") and iban_ok(got[4][3:25])


def test_the_key_comes_from_the_session(spark):
    df = spark.createDataFrame([(1, "mail ada@example.org")], "doc_id long, text string")
    with pytest.warns(UserWarning):
        plain = pii.pseudonymize(df).first().text
    spark.conf.set(pii.KEY_SETTING, "other")
    try:
        assert pii.pseudonymize(df).first().text == pii.pseudonymize(df, "other").first().text != plain
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_pii_edge_cases(spark):
    got = pii.pseudonymize(edge_frame(spark))
    assert ordered(got.collect()) == ordered([(r[0], r[1], 0) for r in edge_rows()])
    assert pii.pseudonymize(spark.createDataFrame([], SCHEMA)).count() == 0
    both = pii.with_pseudonyms(edge_frame(spark).withColumn("text", F.concat("text", F.lit(" 97.51.17.173"))))
    assert both.columns == edge_frame(spark).columns and both.filter("text LIKE '%97.51.17.173'").count() == 0
    assert both.filter("n_chars <> char_length(text)").count() == 0
    assert "Python" not in both._jdf.queryExecution().executedPlan().toString()


# Quality


def _rated(n=300):
    rows = []
    for i in range(n):
        words = prose(i, 40).split()
        kind = i % 3
        rows.append((i, " ".join(w + "%%%" for w in words) if kind == 0 else " ".join(words[:20] + ["rude"] * 3 + words[20:]) if kind == 1 else " ".join(words), kind))
    return rows


def test_ordinal_regression_orders_grades(spark):
    rows = _rated()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows if i % 4], "doc_id long, grade int")
    out = {r.doc_id: r for r in quality.quality(docs, ratings).collect()}
    held = [(g, out[i]) for i, _, g in rows if i % 4 == 0]
    assert np.mean([r.selected == (g >= 1) for g, r in held]) > 0.95
    means = [np.mean([r.expected_grade for g, r in held if g == k]) for k in range(3)]
    assert means[0] < means[1] < means[2]
    model = quality.fit(docs, ratings)
    assert (np.diff(model.thresholds) > 0).all()


def test_cumulative_link_gradient_reaches_the_maximum():
    """One feature: the fit cannot be bettered by small steps."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    grades = np.digitize(2 * x + rng.logistic(size=400), [-1.0, 1.5])
    m = quality.fit_cumulative_link(np.arange(401), np.zeros(400, int), x, grades, 3, rounds=800, ridge=0.0)

    def likelihood(w, t):
        upper = np.concatenate([np.ones((400, 1)), 1 / (1 + np.exp(t - w * x[:, None])), np.zeros((400, 1))], 1)
        return np.log(upper[np.arange(400), grades] - upper[np.arange(400), grades + 1]).sum()

    w, t = float(m.weights[0]), m.thresholds
    best = likelihood(w, t)
    for step in (-0.05, 0.05):
        assert likelihood(w + step, t) < best + 1e-6 and likelihood(w, t + [step, 0]) < best + 1e-6 and likelihood(w, t + [0, step]) < best + 1e-6


def test_the_sample_has_a_bound_in_features(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i, 40)) for i in range(40)], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 3) for i in range(40)], "doc_id long, grade int")
    seen = []
    plain = quality.fit_cumulative_link
    monkeypatch.setattr(quality, "fit_cumulative_link", lambda first, *a: seen.append(len(first) - 1) or plain(first, *a))
    quality.fit(docs, ratings)
    monkeypatch.setattr(quality, "TRAIN_FEATURES", 500)
    quality.fit(docs, ratings)
    assert seen[0] == 40 and 5 < seen[1] < 15


def test_the_driver_holds_the_sample_once(spark, monkeypatch):
    """Features come in portions that give the same model as all at once, and the fit needs little beside them."""
    docs = spark.createDataFrame([(i, prose(i, 40)) for i in range(60)], "doc_id long, text string").repartition(3)
    ratings = spark.createDataFrame([(i, i % 3) for i in range(0, 60, 2)], "doc_id long, grade int")
    whole = quality.fit(docs, ratings)
    monkeypatch.setattr(quality, "_PORTION", 300)
    parts = quality.fit(docs, ratings)
    assert np.allclose(whole.weights, parts.weights) and np.allclose(whole.thresholds, parts.thresholds)
    monkeypatch.undo()
    rng, n, each = np.random.default_rng(3), 4_000, 500
    first, buckets, values = np.arange(n + 1) * each, rng.integers(0, quality.DIMENSIONS, n * each).astype(np.int32), rng.random(n * each).astype(np.float32)
    tracemalloc.start()
    quality.fit_cumulative_link(first, buckets, values, rng.integers(0, 3, n), 3, rounds=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 << 20


def test_quality_edge_cases(spark):
    docs = edge_frame(spark)
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, grade int")
    got = quality.quality(docs, none).collect()
    assert len(got) == len(edge_rows()) and {r.tail_probability for r in got} == {0.5}
    model = quality.fit(docs, spark.createDataFrame([(0, 1), (0, 0), (5, 1), (11, 0), (7, 1)], "doc_id long, grade int"))
    kept = quality.score(docs, model, docs.columns)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert quality.score(spark.createDataFrame([], SCHEMA), model).count() == 0
    grades = quality.grades(spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 1, 0), (4, 1, None), (5, None, 0)], "doc_id long, quality int, toxic int"))
    assert [r.grade for r in grades.orderBy("doc_id").collect()] == [0, 1, 2, 2, None]


def test_a_repeated_id_is_one_row_of_the_sample(spark):
    rows = [(i, prose(i, 30, 40)) for i in range(20)]
    few = spark.createDataFrame(rows, "doc_id long, text string")
    many = spark.createDataFrame(rows + 60 * [rows[3]] + 5 * [(4, "zz later")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(20)], "doc_id long, grade int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    a, b = quality.fit(few, labels), quality.fit(many, labels)
    assert np.allclose(a.weights, b.weights) and np.allclose(a.thresholds, b.thresholds)
    a, b = toxicity.fit(few, labels), toxicity.fit(many, labels)
    assert (a.lexicon.hashes == b.lexicon.hashes).all() and np.allclose(a.scale.y, b.scale.y)


# Toxicity


def _toxic(n=600):
    rows = []
    for i in range(n):
        words = prose(7000 + i, 40).split()
        bad = i % 4 == 0
        if bad:
            for k in (3, 11, 30):
                words[k] = ["blargh", "zorp", "grumpus" + words[k][1:3]][(i // 4 + k) % 3]
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_is_learnt_without_held_out_labels(spark):
    rows = _toxic()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in out)
    held = [(y, out[i]) for i, _, y in rows if out[i].held_out]
    assert np.mean([r.predicted == y for y, r in held]) > 0.95 and all(0 <= r.score <= 1 for _, r in held)
    wrong = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.toxicity(docs, wrong).collect()} == {i: r.score for i, r in out.items()}


def test_toxicity_edge_cases(spark):
    labels = spark.createDataFrame([(0, 1), (None, 1), (5, None), (6, 0), (7, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(edge_frame(spark), labels).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out is not None for r in got)
    assert toxicity.toxicity(edge_frame(spark), labels.limit(0)).filter("score > 0.3").count() == 0
    assert toxicity.toxicity(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_features_see_masks_capitals_and_second_person():
    import pyarrow as pa

    data, offsets = text_bytes(pa.array(["you are a st0pid z.o.r.p", "plain words", "SHOUT! loud?", "soooo", ""]))
    word, cuts = text_bytes(pa.array(["zorp", "stopid"]))
    hashes = toxicity.Tokens(word, cuts).hashes[0]
    order = np.argsort(hashes)
    x = toxicity.describe(data, offsets, toxicity.Lexicon(hashes[order], np.full(2, 5.0)))
    f = {n: x[:, i] for i, n in enumerate(toxicity.FEATURES)}
    assert f["hidden_hits"].tolist() == [2, 0, 0, 0, 0] and f["obfuscation_rate"][0] > 0 == f["obfuscation_rate"][1]
    assert f["second_person_rate"][0] > 0 and f["shouted_rate"][2] == 0.5 and f["exclamation_rate"][2] > 0 and f["stretch_rate"][3] > 0
    assert not x[4].any()


def test_isotonic_is_rising_and_calibrated():
    rng = np.random.default_rng(0)
    x = rng.uniform(-3, 3, 4000)
    y = (rng.uniform(size=4000) < 1 / (1 + np.exp(-x))).astype(float)
    scale = toxicity.Isotonic(x, y)
    grid = scale(np.linspace(-3, 3, 50))
    assert (np.diff(grid) >= 0).all() and np.abs(grid - 1 / (1 + np.exp(-np.linspace(-3, 3, 50)))).max() < 0.15


# Leaks


def _items():
    return [(i, f"{prose(500 + i, 30 + i)}. {prose(800 + i, 6)}.") for i in range(25)] + [(90, None), (91, "?!"), (92, "Yes."), (93, prose(599, 200))]


def test_leaks_against_brute_force(spark):
    items = _items()
    rows = [(i, prose(i, 300)) for i in range(20)]
    rows += [(100 + i, f"{prose(40 + i, 70)} {items[i][1]} {prose(60 + i, 100)}") for i in range(10)]
    rows += [(200 + i, items[i][1].upper().replace(" ", " - ")) for i in range(10, 15)]
    rows += [(300, " ".join(items[20][1].split()[:15])), (301, items[93 - 68][1] if False else prose(599, 200))]
    rows += [(302, prose(1, 30) + " " + " ".join(w if k != 15 else "edit" for k, w in enumerate(items[24][1].split())))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    want = set()
    for d, t in rows:
        own = words(t)
        grams = {tuple(own[k : k + n]) for n in range(1, 6) for k in range(len(own) - n + 1)}
        for i, item in items:
            sides = [words(p) for p in decontaminate.question_and_answer(item or "")]
            if all(w and np.mean([g in grams for g in {tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)}]) >= 0.8 for w in sides):
                want.add((d, i))
    assert want and got == want


def test_items_go_in_several_indexes(spark, monkeypatch):
    items = spark.createDataFrame(_items(), "item_id long, text string")
    docs = spark.createDataFrame([(i, t) for i, t in _items()], "doc_id long, text string")
    whole = ordered(decontaminate.find_leaks(docs, items).select("doc_id", "item_id").collect())
    monkeypatch.setattr(decontaminate.indexes, "__defaults__", (400,))
    assert ordered(decontaminate.find_leaks(docs, items).select("doc_id", "item_id").collect()) == whole
    written, tables = decontaminate.written, []
    monkeypatch.setattr(decontaminate, "written", lambda df, name: tables.append((name, df.columns)) or written(df, name))
    rows = docs.select("doc_id", F.lit("clash").alias("key"), "text", F.lit(1).alias("row")).unionByName(docs.limit(1).selectExpr("null as doc_id", "null as key", "null as text", "null as row"))
    clean = decontaminate.clean(rows, items)
    assert clean.columns == rows.columns and clean.count() == len(_items()) + 1 - len({d for d, _ in whole})
    #: Whatever the number of shards, keys of leaking texts are written and no texts.
    assert sum(name == "leaking-keys" for name, _ in tables) >= 4
    assert all(columns == ["key"] for name, columns in tables if name.startswith("leaking"))


def test_wand_retrieves_all_above_the_threshold(monkeypatch):
    """Against scores summed for every passage and piece; also where portions hold one passage each."""
    rng = np.random.default_rng(5)
    items = [" ".join(f"w{min(199, int(rng.pareto(0.7) * 3))}" for _ in range(rng.integers(5, 200))) for _ in range(60)]
    index = decontaminate.ItemIndex.build(items)
    texts = [" ".join(f"w{min(220, int(rng.pareto(0.7) * 3))}" for _ in range(n)) for n in (0, 3, 50, 128, 129, 700)] + [items[3], items[7] + " " + items[9]]
    words, first = decontaminate.tokens(*decontaminate.lowered(pa.array(texts)))
    terms = index.terms(words)
    for retrieve in (0.3, 0.5, 0.8):
        want = {}
        for t in range(len(texts)):
            own = terms[first[t] : first[t + 1]]
            for p in range(0, max(1, len(own) - decontaminate.STRIDE), decontaminate.STRIDE):
                seen = [x for x in set(own[p : p + decontaminate.PASSAGE].tolist()) if x >= 0]
                score = np.zeros(len(index.piece_item))
                for x in seen:
                    a, b = index.lists[0][x : x + 2]
                    score[index.lists[1][a:b]] += index.lists[2][a:b]
                for d in np.flatnonzero(score >= retrieve):
                    k = (t, int(index.piece_item[d]))
                    want[k] = max(want.get(k, 0), score[d])
        for bounds in ((1 << 20, 1 << 20), (1, 1)):
            monkeypatch.setattr(decontaminate, "_POSTINGS", bounds[0])
            monkeypatch.setattr(decontaminate, "_CELLS", bounds[1])
            got = {(int(t), int(i)): s for t, i, s in zip(*index.search(terms, first, retrieve), strict=True)}
            assert got == pytest.approx(want) and len(want) > 5


def test_long_items_against_a_long_text_in_bounded_memory():
    rng = np.random.default_rng(6)
    items = [" ".join(f"v{k}" for k in rng.integers(0, 3000, 3000)) for _ in range(60)]
    index = decontaminate.ItemIndex.build(items)
    data, offsets = decontaminate.lowered(pa.array([" ".join(f"v{k}" for k in rng.integers(0, 3000, 30_000)) + " " + items[5]]))
    tracemalloc.start()
    texts, found, *_ = index.leaks(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(zip(texts.tolist(), found.tolist(), strict=True)) == [(0, 5)] and peak < 300 << 20


def test_leak_edge_cases(spark):
    items = spark.createDataFrame([(1, edge_rows()[0][1]), (1, edge_rows()[0][1])], "item_id long, text string")
    got = decontaminate.find_leaks(edge_frame(spark), items)
    assert ordered(r[:2] for r in got.collect()) == ordered([(d, 1) for d in (0, 4, 4, 5, None, 12, 14)][: 5] + [(14, 1)] + ([(12, 1)]))
    assert decontaminate.find_leaks(edge_frame(spark), items.limit(0)).count() == 0
    assert decontaminate.find_leaks(spark.createDataFrame([], SCHEMA), items).count() == 0
    assert decontaminate.clean(edge_frame(spark), items).columns == edge_frame(spark).columns


# Tokens


def test_ids_equal_the_library(spark):
    v = sentencepiece_codec.vocabulary(sentencepiece_codec.MODEL)
    texts = [t or "" for _, t, *_ in edge_rows()] + ["日本語テキスト" * 40, "\x00\x01 😀😀", "a▁b ▁▁ c", "ab" * 300 + "\n\n  " * 50, " leading", "trailing  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sentencepiece_codec.encode(docs).orderBy("doc_id").collect()
    assert [r.ids for r in got] == v.processor.encode(texts)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs)).orderBy("doc_id").collect()
    assert [r.text for r in back] == [v.processor.decode(r.ids) for r in got]
    both = sentencepiece_codec.checked(docs).orderBy("doc_id").collect()
    assert [r.ids for r in both] == [r.ids for r in got] and all(r.restored for r in both)


def test_odd_segments_equal_the_library():
    """Texts that polynomials modulo 2^64 confuse, very many characters, and long segments of which some can be cut nowhere."""
    v = sentencepiece_codec.vocabulary(sentencepiece_codec.MODEL)
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    rng = np.random.default_rng(7)
    texts = ["".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits), "".join(map(chr, range(0x3400, 0xD000))) + "".join(map(chr, range(0x20000, 0x28000)))]
    texts += ["".join(rng.choice(list("etaoinshrdlu"), 6_000)), "a" * 3_000, "ab" * 2_000, "theinternational" * 300, "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 4_000)))]
    got = sentencepiece_codec.Encoder(v).encode(texts)
    assert [x.tolist() for x in got] == v.processor.encode(texts)


@pytest.mark.parametrize("unit", ["a", "ab", "-", "=", "aab", "ha", "0"])
def test_runs_of_two_million_characters_equal_the_library(unit):
    v = sentencepiece_codec.vocabulary(sentencepiece_codec.MODEL)
    text = unit * (2_000_000 // len(unit))
    began = time.process_time()
    got = sentencepiece_codec.Encoder(v).encode([text])[0]
    assert time.process_time() - began < 20
    assert got.tolist() == v.processor.encode(text)


@pytest.mark.parametrize("seed", range(4))
def test_long_segments_of_few_letters_equal_the_library(seed):
    """Runs and repeats of all lengths, side by side."""
    v = sentencepiece_codec.vocabulary(sentencepiece_codec.MODEL)
    rng = np.random.default_rng(seed)
    units = ["a", "e", "ab", "the", "in", "-", "ing", "o", "er", "s"]
    texts = ["".join(rng.choice(units[: 2 + k % 9]) * int(rng.integers(1, 30)) for _ in range(200)) for k in range(18)]
    assert [x.tolist() for x in sentencepiece_codec.Encoder(v).encode(texts)] == v.processor.encode(texts)


def test_token_edge_cases(spark):
    got = sentencepiece_codec.round_trip(edge_frame(spark)).collect()
    assert len(got) == len(edge_rows()) and all(r.restored for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    assert sentencepiece_codec.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
    assert sentencepiece_codec.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).filter("text = ''").count() == 2


def test_suffix_ranges_are_all_occurrences():
    v = sentencepiece_codec.vocabulary(sentencepiece_codec.MODEL)
    text = "▁the▁that▁thethe"
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    edge, piece = sentencepiece_codec.Encoder(v).match(v.codes(chars), np.array([0, 4, 9, 16]))
    known = {p: i for i, p in enumerate(v.pieces)}
    bounds = [4] * 4 + [9] * 5 + [16] * 7
    want = {(i, n): known[text[i : i + n]] for i in range(16) for n in range(1, v.longest + 1) if i + n <= bounds[i] and text[i : i + n] in known}
    assert {divmod(e, v.longest + 1): p for e, p in zip(edge.tolist(), piece.tolist(), strict=True)} == want and (np.diff(edge) > 0).all()


def test_memory_of_segments_may_be_lost(monkeypatch):
    v = sentencepiece_codec.vocabulary(sentencepiece_codec.MODEL)
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 10)
    monkeypatch.setattr(sentencepiece_codec, "MATCH_CHARS", 50)
    e = sentencepiece_codec.Encoder(v)
    for k in range(4):
        texts = [prose(k + j, 30) for j in range(5)]
        assert [x.tolist() for x in e.encode(texts)] == v.processor.encode(texts)


# Pages


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


PAGES = {
    "<nav><a href=/>Home</a></nav><article><h1>Head &amp; line</h1><p>One  two\n three.<p>Four<br>five &lt;b&gt;.</article><footer>&copy; x</footer>": "Head & line\nOne two three.\nFour five <b>.",
    "<header><p>Site of the year, they say.</p></header><main><p>First words of a story.</p><aside>See also this.</aside><p>x</p></main><form><p>Your name please now.</p></form>": "First words of a story.\nx",
    "<div class=cookie-banner>We use cookies on all our pages here.</div><article><p>Text of it.</p><section id=comments><p>I think this is a fine text, and I say so at length here.</p></section></article>": "Text of it.",
    "<article><p>Unclosed <b>bold<p>Next &#233;&nbsp;one<!-- <p>no</p> -->": "Unclosed bold\nNext é one",
    "": "",
}


def test_pages(spark):
    rows = [(i, f"u{i}", page(b)) for i, b in enumerate(PAGES)] + [(50, None, None), (None, "u", ""), (51, "u", "<"), (51, "u", "<")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    got = html_blocks.extract_main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(i, f"u{i}", t, len(t)) for i, t in enumerate(PAGES.values())] + [(50, None, "", 0), (None, "u", "", 0)]
    found = got.collect()
    assert ordered(r for r in found if r.page_id != 51) == ordered(want) and sum(r.page_id == 51 for r in found) == 2
    assert html_blocks.extract_main_text(df.limit(0)).count() == 0


def test_tree_fits_its_table():
    for p in html_blocks.LABELLED_PAGES:
        texts, _ = html_blocks.blocks(p)
        plain = p.replace(">+", ">")
        want = [t[1:] for t in texts if t.startswith("+")]
        got = html_blocks.main_texts([plain])[0]
        assert (got.split("\n") if got else []) == want


def test_very_long_and_broken_pages():
    long = "<article>" + "<p>" + html.escape("a < b & c ") * 20_000 + "</article>"
    assert len(html_blocks.main_texts([long])[0]) > 190_000
    for bad in ("<" * 5000, "<p " * 5000, "<a href='" + "x" * 5000, "</div>" * 3000, "<!--" * 3000, "&#xD800;&#0;&bogus;"):
        assert isinstance(html_blocks.main_texts([bad])[0], str)


def test_raw_elements_end_where_they_end():
    """No closing tag, a self-closed tag, a longer name: the article stays; raw text that is closed goes."""
    article = "<article><p>Text of the story.</p><p>And more of it.</p></article>"
    want = "Text of the story.\nAnd more of it."
    before = ["<head><title>t</title><meta name=a><body>", "<head><title>t</title>", "<head><script>a</script></head><body>"]
    before += [f"<{tag}/>" for tag in ("svg", "iframe", "object")] + ["<svg viewBox='0 0 1 1' />", '<script src="a.js"/>']
    before += [f"<{tag}>" for tag in ("svg", "iframe", "object", "noscript", "template", "textarea", "select", "title")] + ["<object-x>", "<title-bar>", "<select-box>"]
    before += ["<svg><text>no</text></svg>", "<SCRIPT>no</script >", "<iframe src=http://a/>no</iframe>", "<style>no</style>"]
    for b in before:
        for after in ("", "<svg><text>no</text></svg><script>no</script>" if "svg" not in b or "/>" in b or "</" in b else ""):
            assert html_blocks.main_texts([b + article + after]) == [want], b
    assert html_blocks.main_texts([article + "<script>var a = '<p>no</p>'"]) == [want]
    assert html_blocks.main_texts(["<svg><select>" * 100_000 + article]) == [want]


def _articles(page):
    """What the articles of a page say, cut out by another way: the words between their tags."""
    body = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", page, re.S)
    return html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", body[1] if body else "", flags=re.S))).split()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_articles_of_the_pages_table_are_kept_and_nothing_else():
    pages = [p or "" for p in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()]
    got = [Counter(t.split()) for t in html_blocks.main_texts(pages)]
    want = [Counter(_articles(p)) for p in pages]
    common = sum((g & w).total() for g, w in zip(got, want, strict=True))
    assert common >= 0.99 * sum(w.total() for w in want) and common >= 0.99 * sum(g.total() for g in got)


@pytest.mark.parametrize("page", ["<a b " * 200_000, '<p a="' * 150_000, "<a title='x> " * 80_000, "<div>" * 60_000 + "</section></p>" * 60_000, "<p><article>" + "<div>" * 60_000 + "</p>" * 200_000, "<title>" * 100_000, "<!--" * 200_000, "<" * 500_000])
def test_broken_pages_take_time_in_proportion(page):
    began = time.process_time()
    html_blocks.main_texts([page])
    assert time.process_time() - began < 10


def test_pages_in_other_languages_and_buttons():
    body = "Der Rat der Stadt hat gestern beschlossen, die alte Brücke zu erneuern, weil das Holz nach vielen Jahren morsch geworden ist."
    page = f"<html><head><title>T</title><body><ul><li><a href=/>Start</a></li></ul><div class=inhalt><h1>Die Brücke</h1><p>{body}</p><button>Mehr</button><p>{body}</p></div><div class=kommentare><p>{body}</p></div><div id=werbung>{body}</div>"
    assert html_blocks.main_texts([page]) == [f"Die Brücke\n{body}\n{body}"]


_PARAGRAPHS = [
    "The council met on Tuesday evening to decide whether the old bridge over the river should be repaired or replaced by a new one.",
    "Most of those who spoke wanted to keep it, since it has stood for two hundred years and carries the only road to the school.",
]
_NEWS = "<h1>Council keeps the bridge</h1>" + "".join(f"<p>{p}</p>" for p in _PARAGRAPHS)


@pytest.mark.parametrize(
    "opening",
    ['<article class="post type-post comments-open">', "<div id=content class=search-results>", '<div class="site-main has-sidebar">', "<form id=aspnetForm>", "<div id=page class=menu-closed>", '<article class="newsletter-archive post">', "<div class=comments-enabled>", "<div class='l-page page--with-banner'>", "<section class=popular-science>"],
)
def test_names_of_wrappers_do_not_drop_the_article(opening):
    want = "\n".join(["Council keeps the bridge", *_PARAGRAPHS])
    closing = f"</{re.match(r'<(.*?)[ >]', opening)[1]}>"
    menu, replies = "<ul><li><a href=/>Home</a><li><a href=/s>Sport</a></ul>", f"<div id=comments class=comments-area><h3>Comments</h3><p>{_PARAGRAPHS[1]}</p><p>Well said.</p></div>"
    for page in (opening + _NEWS + closing, f"<nav>{menu}</nav>{opening}{_NEWS}{closing}<footer><p>All about us and our paper.</p></footer>", opening + menu + _NEWS + closing + replies, opening + _NEWS + replies + closing, opening + _NEWS + closing + 5 * replies):
        assert html_blocks.main_texts([page]) == [want], page


def test_names_of_parts_drop_them():
    want = "\n".join(["Council keeps the bridge", *_PARAGRAPHS])
    for name in ("comments", "comment-list", "site-footer", "sidebar-left", "cookie-banner", "related", "kommentarii", "ad-slot", "newsletter", "breadcrumbs"):
        page = f"<body><div id=wrap class=has-sidebar><div class=entry-content>{_NEWS}</div><div class={name}><p>{_PARAGRAPHS[0]}</p><p>Yes.</p></div></div>"
        assert html_blocks.main_texts([page]) == [want], name


def test_scripts_without_spaces_and_empty_comments():
    text = "市議会は火曜日の夜、川にかかる古い橋を修理するか、新しい橋に架け替えるかを決めるために集まった。発言した人の多くは橋を残すことを望んだ。"
    assert html_blocks.main_texts([f"<body><div>{text}</div><div>{text}</div></body>"]) == [f"{text}\n{text}"]
    for comment in ("<!-->", "<!--->", "<!---->", "<!-- x -->"):
        assert html_blocks.main_texts([f"<article>{comment}{_NEWS}</article><!-- end -->"]) == ["\n".join(["Council keeps the bridge", *_PARAGRAPHS])]
