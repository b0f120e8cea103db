"""Classifiers on planted text, exact search, decontamination: held-out accuracy and brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyproof.llm import decontam, langid, quality, topk, toxicity
from tallyproof.llm.sampling import sample_evenly, split_of, with_text
from tallyproof.llm.trees import BoostedTrees, Isotonic


def prose(rng, n, syllables=("ta", "re", "mi", "no", "lu", "ke", "so", "pi", "va", "du")):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_split_is_crc32(spark):
    ids = [0, 7, 123456789, -5, None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id bigint").select(split_of("doc_id", 3).alias("s"), "doc_id").collect()
    assert [r.s for r in got] == [zlib.crc32(("" if i is None else str(i)).encode()) % 3 for i in ids]


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    f = BoostedTrees().fit(x[:3000], y[:3000]).raw(x[3000:])
    assert ((f > 0) == (y[3000:] > 0)).mean() > 0.95
    iso = Isotonic().fit(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    p = iso(np.linspace(0, 6, 50))
    assert (np.diff(p) >= 0).all() and 0 <= p.min() <= p.max() <= 1


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(900):
        bad, junk = rng.random() < 0.25, rng.random() < 0.2
        t = prose(rng, rng.randrange(30, 120)).split(" ")
        if bad:
            for _ in range(5):
                t.insert(rng.randrange(len(t)), rng.choice(["idiot", "zorbal", "zorbek", "Scum", "w0rthless"]))
        if junk:
            t = [w + rng.choice(["%%%", "$$$", "&&&"]) for w in t]
        rows.append((i, " ".join(t)))
        if i % 3:
            labels.append((i, int(not junk), int(bad)))
    rows += [(5000, None), (5001, ""), (5002, "ta " * 60_000), (0, rows[0][1])]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def judged(scored, labels, label, threshold):
    got = scored.join(labels, "doc_id").where(split_of("doc_id", 3) == 1).select("score", label).collect()
    return np.mean([(r.score >= threshold) == bool(r[label]) for r in got]), len(got)


def test_toxicity(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(toxicity.train_rows(labels, "toxic"), docs)
    scored = toxicity.score(docs, model).cache()
    accuracy, n = judged(scored, labels, "toxic", toxicity.THRESHOLD)
    assert accuracy > 0.93 and n > 100
    assert scored.count() == docs.count() and scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    none = toxicity.fit(toxicity.train_rows(labels.where("false"), "toxic"), docs)
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_quality(spark, labelled):
    docs, labels = labelled
    model = quality.fit_on_tables(docs, labels)
    scored = quality.score(docs, model).cache()
    accuracy, _ = judged(scored, labels, "quality", quality.THRESHOLD)
    assert accuracy > 0.93 and scored.where("score IS NULL").count() == 0
    kept = quality.keep_good(docs.withColumn("score", F.lit("clash")), model)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == scored.where("score >= 0.5").count()
    none = quality.fit_on_tables(docs, labels.where("false"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}


def test_quality_uses_no_negative_labels(spark, labelled):
    docs, labels = labelled
    a = quality.fit_on_tables(docs, labels).score(pa.array(["ta re mi", "TA!! RE!!"]))
    b = quality.fit_on_tables(docs, labels.where("quality = 1")).score(pa.array(["ta re mi", "TA!! RE!!"]))
    assert np.array_equal(a, b)


def test_samples_are_bounded_whatever_ids_repeat(spark):
    rows = [(1, f"text {i}", "aa") for i in range(300)] + [(i, f"other {i}", "bb" if i % 2 else "cc") for i in range(2, 40)] + [(None, "x", "aa"), (2, "again", "bb"), (3, None, "aa")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    chosen = sample_evenly(docs.where("doc_id IS NOT NULL"), 9, "lang", "doc_id")
    got = with_text(docs, chosen, "doc_id", "lang").collect()
    per = Counter(r.lang for r in got)
    assert len(got) == 9 and per["aa"] == 2 and {per["bb"], per["cc"]} == {3, 4}  # aa has two ids
    assert all((r.doc_id, r.text, r.lang) in rows for r in got)
    assert sorted(map(tuple, with_text(docs, chosen, "doc_id", "lang").collect())) == sorted(map(tuple, got))
    a, b = (langid.fit(d, size=9) for d in (docs, docs.repartition(5)))
    assert np.array_equal(a.weights, b.weights) and a.languages == ["aa", "bb", "cc"]
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(labels.selectExpr("doc_id", "toxic AS y"), docs)).count() == len(rows)
    assert quality.score(docs, quality.fit(labels.where("quality = 1"), docs, size=3)).count() == len(rows)


def test_models_ignore_other_columns(spark, labelled):
    docs, labels = labelled
    clash = docs.withColumn("y", F.lit("k")).withColumn("fold", F.lit("k")).withColumn("score", F.lit("k")).withColumn("trusted", F.lit("k")).withColumn("t", F.lit("k"))
    texts = pa.array(["ta re mi", "you idiot", ""])
    for fit in (lambda d: toxicity.fit(toxicity.train_rows(labels, "toxic"), d), lambda d: quality.fit_on_tables(d, labels)):
        assert np.array_equal(fit(docs).score(texts), fit(clash).score(texts))
    lang = docs.withColumn("lang", F.lit("aa"))
    assert langid.predict(lang.withColumn("slots", F.lit(1)).withColumn("turn", F.lit(1)), langid.fit(lang.withColumn("slots", F.lit(1)).withColumn("turn", F.lit(1)))).columns == ["doc_id", "lang_pred", "score"]


TEXTS = ["You IDIOT!! 'idiot' it's a MÜLL-day, id10t; you're w0rthless", "", None, "die Katze und du ton sie", "a", "Hello, World. 12 apples?\n\nhi hi hi a|b $$ %% LOUD words", "é É çà " * 40, "x" * 30 + " " + "tú imbécil"]


def test_toxicity_features_by_a_plain_count():
    got = toxicity.features(pa.array(TEXTS), [np.zeros(0, np.uint64)] * 3)
    stands = str.maketrans("013457@", "oieasta")
    lists = [set(w.translate(stands) for w in ws.split()) for ws in toxicity.INSULTS.values()]
    you = set(w.translate(stands) for ws in toxicity.SECOND_PERSON.values() for w in ws.split())
    letter = "[A-Za-z\\u0080-\\U0010ffff]"
    for row, text in zip(got, TEXTS):
        text = text or ""
        raw, n = text.encode(), max(len(text.encode()), 1)
        words = re.findall(rf"(?:[A-Za-z0-9@\u0080-\U0010ffff]|(?<={letter})'(?={letter}))+", text)
        plain = [w.lower().translate(stands) for w in words]
        m = max(len(words), 1)
        hit = [any(w in x for x in lists) for w in plain]
        near = [h and any(plain[j] in you for j in range(max(0, i - 5), min(len(plain), i + 6)) if j != i) for i, h in enumerate(hit)]
        punct = sum(33 <= b <= 126 and not chr(b).isalnum() for b in raw)
        want = [*(sum(w in x for w in plain) / m for x in lists), sum(hit) / m]
        if not text:
            assert not row.any()
            continue
        assert row[:5] == pytest.approx(want), text
        assert row[17:19] == pytest.approx([sum(near) / m, sum(w in you for w in plain) / m])
        assert row[[19, 21, 23, 24, 27, 28, 29]] == pytest.approx([sum(65 <= b <= 90 for b in raw) / n, punct / n, raw.count(b"!") / n, raw.count(b"?") / n, sum(48 <= b <= 57 for b in raw) / n, np.log1p(len(words)), len(raw) / m])


def test_quality_features_by_a_plain_count():
    got = quality.features(pa.array(TEXTS))
    for row, text in zip(got, TEXTS):
        raw = (text or "").encode()
        if not raw:
            assert not row.any()
            continue
        n, words = len(raw), re.findall(rb"[^\x20\x09-\x0D]+", raw)
        lower = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
        pairs = list(zip(lower, lower[1:]))
        plain = b".,;:'\"-()"
        is_letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 0x80
        sign = lambda b: 33 <= b <= 126 and not is_letter(b) and not 48 <= b <= 57 and b not in plain
        m, sizes = len(words), [len(w) for w in words]
        want = [
            sum(65 <= b <= 90 for b in raw) / n, sum(map(sign, raw)) / n, sum(48 <= b <= 57 for b in raw) / n, sum(b in plain for b in raw) / n, sum(b >= 0x80 for b in raw) / n,
            sum(sign(b) and a == b for a, b in zip(raw, raw[1:])) / n, raw.count(b"!") / n, raw.count(b"|") / n,
            sum(sum(map(is_letter, w)) > 1 and all(65 <= b <= 90 for b in w if is_letter(b)) for w in words) / m, sum(any(map(sign, w)) for w in words) / m, sum(not any(map(is_letter, w)) for w in words) / m, sum(x > 20 for x in sizes) / m,
            np.mean(sizes), np.std(sizes), sum(x <= 3 for x in sizes) / m, len(set(lower)) / m, max(Counter(lower).values()) / m,
            len(set(pairs)) / max(len(pairs), 1), max(Counter(pairs).values(), default=0) / max(len(pairs), 1), sum(a == b for a, b in pairs) / m,
            sum(raw.count(c) for c in (b".", b"?", b"!")) / m, sum(bool(x) for x in raw.split(b"\n")) / m, np.log1p(m), np.log1p(len(set(lower))),
        ]
        assert row == pytest.approx(want, abs=1e-9), text


def test_language_by_a_plain_kernel(spark):
    rng = random.Random(14)
    kinds = {"aa": ("ta", "re", "mi"), "bb": ("ta", "schu", "mi")}
    rows = [(i, prose(rng, 6, kinds[x]), x) for i, x in enumerate(["aa", "bb"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs, landmarks=8)
    order = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    text, lang = {i: t for i, t, _ in rows}, {i: x for i, _, x in rows}
    grams = lambda t: {t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)}
    kernel = lambda a, b: len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5
    marks = [i for x in ("aa", "bb") for i in [j for j in order if lang[j] == x][:4]]
    k = np.array([[kernel(text[i], text[j]) for j in marks] for i in order])
    y = np.array([[1.0 if lang[i] == x else -1.0 for x in ("aa", "bb")] for i in order])
    gram = np.array([[kernel(text[i], text[j]) for j in marks] for i in marks])
    weights = np.linalg.solve(k.T @ k + langid.RIDGE * (gram + 1e-3 * np.eye(8)), k.T @ y)
    new = [prose(rng, 5, kinds[x]) for x in ("aa", "bb") * 5]
    response = 4 * np.array([[kernel(t, text[j]) for j in marks] for t in new]) @ weights
    want = 1 / np.exp(response - response.max(1, keepdims=True)).sum(1)
    names, score = model.predict(pa.array(new))
    assert names == [("aa", "bb")[b] for b in response.argmax(1)] and score == pytest.approx(want, abs=2e-3)


def test_class_prior():
    rng = np.random.default_rng(1)
    p = rng.normal(0, 1, (3000, 3))
    u = np.concatenate([rng.normal(0, 1, (2100, 3)), rng.normal(5, 1, (900, 3))])
    assert quality.class_prior(p, u) == pytest.approx(0.7, abs=0.05)


def test_language(spark):
    rng = random.Random(4)
    kinds = {"aa": ("ta", "re", "mi"), "bb": ("schla", "ung", "ei"), "cc": ("éa", "ou", "eux")}
    rows = []
    for i in range(300):
        lang = rng.choice(list(kinds))
        rows.append((i, prose(rng, 30, kinds[lang]), lang if i % 10 else None))
    rows += [(900, None, "aa"), (901, "12 34 !?", None), (902, "", None), (903, "é", None), (904, "ta " * 50_000, None), (None, "ta re", "aa")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs.where(split_of("doc_id", 4) != 2))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert np.mean([got[i].lang_pred == x for i, _, x in rows[:300] if x]) > 0.98
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[903].lang_pred != "und" and got[904].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values()) and langid.predict(docs.where("false"), model).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs.where("lang = 'zz'"))).collect()} == {"und"}


def test_kernel_matches_its_definition():
    texts = ["the cat sat", "the dog sat", "xyz"]
    sets = []
    for a, e, slots, bounds, _ in langid.presence(pa.array(texts)):
        sets += [set(slots[bounds[i] : bounds[i + 1]].tolist()) for i in range(e - a)]
    grams = [{t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)} for t in texts]
    assert [len(s) for s in sets] == [len(g) for g in grams] and len(sets[0] & sets[1]) == len(grams[0] & grams[1])


@pytest.mark.parametrize("d,n,scale", [(3, 400, 1.0), (16, 300, 0.3), (64, 200, 0.1)])
def test_top_k_equals_brute_force(spark, d, n, scale):
    rng = np.random.default_rng(d)
    v = rng.normal(0, scale, (n, d)).astype(np.float32)
    v[n // 2 :: 3] = v[0]  # many ties
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)] + [(7001, None), (7002, [1.0, None]), (7003, [float("nan")] * d), (7004, [float("inf")] * d), (7020, [0.0] * d), (None, [1.0] * d)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in topk.exact_top_k(topk.integer_vectors(table), F.col("vec_id") % 20 == 0, 5, block=90).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ints = {int(i): np.floor(64 * x.astype(float)).astype(int) for i, x in enumerate(v)} | {7020: np.zeros(d, int)}
    for q in (i for i in ints if i % 20 == 0):
        want = sorted(((-int(ints[q] @ x), i) for i, x in ints.items() if i != q))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_top_k_stops_early_and_handles_few_rows(spark):
    ids, v = np.arange(5000), np.zeros((5000, 4))
    v[:, 0] = np.arange(5000)
    ((_, rows, scores, scored),) = list(topk.threshold_top_k(ids, v, np.array([-1]), np.array([[1.0, 0, 0, 0]]), 3))
    assert rows.tolist() == [4999, 4998, 4997] and scored == 8
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (20, [])], "vec_id bigint, embedding array<float>")
    got = topk.exact_top_k(topk.integer_vectors(table), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 1, 4096), (0, 20, 0), (20, 0, 0), (20, 1, 0)]
    assert topk.exact_top_k(topk.integer_vectors(table.where("false")), F.lit(True)).count() == 0


def test_top_k_reads_on_until_the_bound_is_met():
    ids, v = np.arange(5000), np.zeros((5000, 2))
    v[:100, 0], v[100:200, 1] = 9, 9  # at depths 8 and 32 the bound of 9 times the square root of 2 exceeds the best score of 9
    ((_, rows, _, scored),) = list(topk.threshold_top_k(ids, v, np.array([-1]), np.array([[1.0, 1.0]]), 3))
    assert rows.tolist() == [0, 1, 2] and scored < 400


def test_top_k_stops_on_clustered_vectors():
    rng = np.random.default_rng(7)
    v = np.zeros((6400, 64))
    for c in range(64):  # each cluster has four dimensions of its own and noise elsewhere
        rows = slice(100 * c, 100 * c + 100)
        v[rows] = rng.integers(-1, 2, (100, 64))
        v[rows, rng.choice(64, 4, replace=False)] += rng.integers(40, 60, (100, 4))
    ids, asked = np.arange(6400), np.arange(0, 6400, 50)
    found = {i: (r, s, n) for i, r, s, n in topk.threshold_top_k(ids, v, asked, v[asked], 5)}
    for i, x in enumerate(asked):
        want = sorted((-int(v[x] @ v[j]), j) for j in ids if j != x)[:5]
        assert [(-int(s), int(r)) for r, s in zip(*found[i][:2])] == want
    share = np.mean([n for *_, n in found.values()]) / 6400
    assert share < 0.5
    least = np.array([found[i][1][-1] for i in range(len(asked))], float)
    again = list(topk.threshold_top_k(ids, v, asked, v[asked], 5, least))
    assert all(r.tolist() == found[i][0].tolist() for i, r, _, _ in again) and sum(n for *_, n in again) <= sum(n for *_, n in found.values())


def test_top_k_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [1.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 1.0])]
    got = topk.exact_top_k(topk.integer_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")), F.col("vec_id") == 0, 4, block=2, group=1).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 1, 3 * 4096), (2, 1, 2 * 4096), (3, 2, 2 * 4096), (4, 1, 4096)]


def slow_alignment(a, b, penalty=0.5):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -penalty), h[i - 1, j] - penalty, h[i, j - 1] - penalty)
    return h.max()


def test_alignment_equals_the_recurrence():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(1, 40))
        score, x, y = decontam.local_alignment(a.astype(np.uint64), b.astype(np.uint64))
        assert score == slow_alignment(a, b) and slow_alignment(a, b[x:y]) == score


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, 40)) for i in range(6)] + [(10, "zip zap"), (11, ""), (12, None), (13, "unu")]
    return rng, items, spark.createDataFrame(items, "item_id bigint, text string")


def test_decontamination(spark, bench):
    rng, items, table = bench
    leak = {1: (0, items[0][1]), 2: (1, items[1][1].upper() + "!"), 5: (4, items[4][1])}
    w = items[2][1].split()
    for k in range(0, 40, 6):
        w[k] = f"edit{k}"
    leak[3] = (2, " ".join(w))
    leak[4] = (3, " ".join(items[3][1].split()[:26]))
    leak[6] = (10, "they said zip zap again")
    rows = [(i, f"{prose(rng, 200)} {t} {prose(rng, 90)}") for i, (_, t) in leak.items()] + [(100 + i, prose(rng, 300)) for i in range(40)] + [(200, None), (201, ""), (202, "ta re " * 40_000), (203, "unusual")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, table).collect()}
    assert got == {(i, item) for i, (item, _) in leak.items()}
    blocked = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, table, block_words=50).collect()}
    assert blocked == got
    kept = decontam.drop_contaminated(docs, table)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - set(leak)
    assert decontam.contaminated(docs.where("false"), table).count() == 0 and decontam.contaminated(docs, table.where("false")).count() == 0


def test_a_leak_in_very_many_documents_is_found(spark, bench):
    rng, items, table = bench
    rows = [(i, f"{prose(rng, 20)} {items[5][1]}" if i % 3 == 0 else prose(rng, 60)) for i in range(300)]
    got = {r.doc_id for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), table).collect()}
    assert got == {i for i in range(300) if i % 3 == 0}


def edited(words, every, mark):
    return " ".join(f"{mark}{k}" if k % every == every - 1 else w for k, w in enumerate(words))


def test_edited_copies_in_several_documents_are_found(spark, bench):
    rng, items, table = bench
    w = items[0][1].split()
    common = " ".join(items[1][1].split()[:3])  # a seed of another item in every document
    texts = [f"{prose(rng, 30)} {edited(w, 5, 'one')} {prose(rng, 20)}" for _ in range(2)]
    texts += [f"{prose(rng, 30)} {edited(w, 5, 'two')}" for _ in range(7)] + [f"{edited(w, 4, 'three')} {prose(rng, 9)}" for _ in range(20)]
    texts += [f"{prose(rng, 30)} {common} {prose(rng, 30)}" for _ in range(60)]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), table).collect()}
    assert got == {(i, 0) for i in range(29)}


def test_seeds_find_what_alignment_of_all_pairs_finds(spark):
    rng = random.Random(21)
    vocabulary = [prose(rng, 1) + str(i) for i in range(400)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [some(rng.randrange(8, 50)) for _ in range(25)]
    texts = []
    for i in range(300):
        w = list(rng.choice(items))
        for _ in range(rng.randrange(0, 1 + len(w) // 2)):  # words replaced, dropped, put in, moved
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([some(1), [], [w[k], *some(1)], some(1)])
            w = w or some(1)
        texts.append(some(rng.randrange(40)) + (w if i % 3 else some(20)) + some(rng.randrange(40)))
    ids = {}
    number = lambda w: np.array([ids.setdefault(x, len(ids)) for x in w], np.uint64)
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            if decontam.local_alignment(number(item), number(t))[0] >= max(decontam.SHARE * len(item), min(len(item), decontam.SURE)):
                want.add((d, i))
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id bigint, text string")
    bench_ = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(3, " ".join(items[3]))], "item_id bigint, text string")
    rows = decontam.contaminated(docs.union(docs.limit(5)), bench_).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 150, (len(got), len(want))
