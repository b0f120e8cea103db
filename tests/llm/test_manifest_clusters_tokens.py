"""The Merkle manifest, exact clustering and BPE coding against plain versions of them."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyproof.llm import bpe, centroids, merkle, queries

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, fields):
    return sha(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in fields])


def plain_tree(leaves):
    """(root, proofs) of one tree, by the definition."""
    at, proofs, level = list(range(len(leaves))), [[] for _ in leaves], list(leaves)
    while len(level) > 1:
        for i, p in enumerate(at):
            s = p // 16 * 16
            proofs[i].append(("".join(level[s:p]), "".join(level[p + 1 : s + 16])))
        level = [sha(*level[s : s + 16]) for s in range(0, len(level), 16)]
        at = [p // 16 for p in at]
    return level[0], proofs


def plain_manifest(rows):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"], plain_leaf(r, fields)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by[s], key=lambda x: (x[0], x[1] or 0, x[2]))]) for s in names}
    root, upper = plain_tree([trees[s][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for (_, doc_id, leaf), proof in zip(sorted(by[s], key=lambda x: (x[0], x[1] or 0, x[2])), trees[s][1]):
            out.append((s, doc_id, leaf, trees[s][0], root, tuple(proof + upper[i])))
    return out


def manifest_of(spark, rows, **kw):
    docs = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], DOCS)
    got = merkle.manifest(docs.withColumns({c: F.lit("clash") for c in ("tree", "hash", "pos", "leaf", "proof", "level", "run", "block", "note")}), **kw)
    return [(r["source"], r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((p["before"], p["after"]) for p in r["proof"])) for r in got.collect()], got


def docs_of(sizes, seed=1):
    rng = random.Random(seed)
    rows = [{"doc_id": i, "text": rng.choice(["", None, "Ab ç " * (i % 7)]), "lang": rng.choice(["en", None]), "source": s, "n_chars": i % 3 or None} for s, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    return rows


key = lambda x: tuple((v is not None, v) for v in x[:3])


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1, "": 1}, {"a": 16, "b": 17, None: 15, "é": 33, "z": 257}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_manifest_equals_the_definition(spark, sizes):
    rows = docs_of(sizes)
    assert sorted(manifest_of(spark, rows)[0], key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_of_a_hot_source_in_many_runs(spark, monkeypatch):
    """Five levels above the leaves, borders of runs and batches anywhere, and two merges of three levels."""
    monkeypatch.setattr(merkle, "RUN", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        rows = [{"doc_id": i // 3 if i % 50 else None, "text": f"t{i % 11}", "lang": None, "source": "hot" if i % 3 else f"s{i % 60}", "n_chars": 1} for i in range(9000)]
        assert sorted(manifest_of(spark, rows)[0], key=key) == sorted(plain_manifest(rows), key=key)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_manifest_of_more_levels_than_one_merge(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SPAN", 1)
    rows = docs_of({"a": 700, "b": 3, "c": 16, None: 40})
    assert sorted(manifest_of(spark, rows)[0], key=key) == sorted(plain_manifest(rows), key=key)


def test_repeated_rows_are_leaves_each(spark):
    rows = [{"doc_id": 1, "text": "x", "lang": "en", "source": "a", "n_chars": 1}] * 40 + [{"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None}] * 2
    assert sorted(manifest_of(spark, rows)[0], key=key) == sorted(plain_manifest(rows), key=key)


def test_tampering_is_told_and_sound_rows_pass(spark):
    rows = docs_of({"a": 50, None: 20})
    _, got = manifest_of(spark, rows, changed=F.col("doc_id") % 4 == 0, changed_text=F.lower("text"))
    for r in got.withColumn("folded", merkle.fold("tampered", "proof")).collect():
        assert (r["folded"] == r["root"]) == (r["tampered"] == r["leaf"])
        assert r["doc_id"] % 4 == 0 or r["folded"] == r["root"]
    assert any(r["tampered"] != r["leaf"] for r in got.collect())


def test_empty_manifest(spark):
    got = merkle.manifest(spark.createDataFrame([], DOCS))
    assert got.count() == 0 and got.columns == ["doc_id", "source", "leaf", "tampered", "subroot", "root", "proof"]


def plain_clusters(vectors, k=8, rounds=10, seed=3):
    """vectors: (id, list of ints)."""
    order = sorted(vectors, key=lambda v: (sha(f"{seed}:{'' if v[0] is None else v[0]}"), v[1]))
    cs = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cs))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in vectors]
        for i in range(len(cs)):
            mine = [v for (_, v), a in zip(vectors, at) if a == i]
            if mine:
                cs[i] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [near(v) for _, v in vectors]
    return [(i, c, d, sum(x for x, y in found if y == c), sum(x for x, _ in found), cs[c]) for (i, _), (d, c) in zip(vectors, found)]


def clusters_of(spark, rows, **kw):
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, v string, norms string, cluster string")
    return [(r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], list(r["centroid"])) for r in centroids.cluster(centroids.integer_vectors(table, **kw)).collect()]


def as_ints(rows, dims=64, scale=1024):
    ok = [r for r in rows if r[1] is not None and len(r[1]) == dims and all(x is not None and np.isfinite(x) for x in r[1])]
    return [(r[0], [int(np.floor(float(np.float32(x)) * scale)) for x in r[1]]) for r in ok]


ids_first = lambda x: (x[0] is not None, x[0] or 0, x[1:])


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=64) + 3 * (i % 5)], "a", "b", "c") for i in range(300)]
    rows += [rows[7]] * 5 + [(None, rows[3][1], "", "", "")] * 2
    rows += [(900, None, "", "", ""), (901, [1.0] * 63, "", "", ""), (902, [1.0] * 63 + [float("nan")], "", "", ""), (903, [1.0] * 63 + [None], "", "", ""), (904, [float("inf")] * 64, "", "", ""), (905, [], "", "", "")]
    assert sorted(clusters_of(spark, rows), key=ids_first) == sorted(plain_clusters(as_ints(rows)), key=ids_first)


@pytest.mark.parametrize("n", [0, 1, 5, 8])
def test_few_vectors(spark, n):
    rows = [(i, [float(i)] * 64, "", "", "") for i in range(n)]
    assert sorted(clusters_of(spark, rows)) == sorted(plain_clusters(as_ints(rows)))


def test_ties_and_large_components(spark):
    rows = [(i, [float((i % 4) * 300_000)] * 2 + [0.0] * 62, "", "", "") for i in range(24)]
    assert sorted(clusters_of(spark, rows)) == sorted(plain_clusters(as_ints(rows)))
    far = [(i, [1e18 * (i % 2)] * 64, "", "", "") for i in range(3)] + [(9, [5.0] * 64, "", "", "")]
    got = clusters_of(spark, far)
    assert len(got) == 4 and all(d is None or d >= 0 for _, _, d, *_ in got)


def test_screening_spares_distances_and_changes_nothing():
    rng = np.random.default_rng(2)
    cs = rng.integers(-500, 500, (8, 64)) * np.repeat(rng.integers(1, 9, (8, 8)), 8, axis=1)
    x = cs[rng.integers(0, 8, 2000)] + rng.integers(-300, 300, (2000, 64))
    got = centroids.nearest(x, centroids.segment_norms(x), cs)
    d = ((x[:, None, :] - cs[None]) ** 2).sum(2)
    assert (got[0] == d.argmin(1)).all() and (got[1] == d.min(1)).all() and got[2] < 2000 * 8 / 3


TEXTS = [
    None, "", "   \n\t", "Hello WORLD, it's 1234 don't", "<|endoftext|>x <|StartOfText|> a<|startoftext|>", "café café İ ΣΣ ΑΣ a b \x1cq a\x85b c", "x" * 30_000, "日本語のテキスト 한국어 각 " * 3, "'s 's't ''s 're'",
    "́ lone mark ̸= ≠ ≮", "🙂🙂🏽 👨‍👩‍👧", "a\x00b \x7f", "1½2³ ٣٤ Ⅷ", "   ", "ﬁ ǅ ß ẞ", " lead and trail \r\n",
]


def coded_of(spark, rows, path):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("block", "code", "word", "ids", "digest", "decoded")})
    docs.write.mode("overwrite").parquet(f"{path}/docs")
    file = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{path}/docs")
    coded = bpe.encode(docs, file, decoded=True)
    assert plain_rows(coded) == plain_rows(bpe.decode(bpe.encode(docs, file), file))
    return coded


def expected(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    out = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((i, tuple(ids), t.decode(ids, skip_special_tokens=False)))
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def plain_rows(df):
    rows = [(r["doc_id"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist()), r["decoded"]) for r in df.collect()]
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


@pytest.mark.parametrize("block", [1, 64, 1 << 25])
def test_coding_equals_the_library(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", block)
    rng = random.Random(4)
    rows = list(enumerate(TEXTS)) + [(None, "null id"), (3, "again Hello"), (3, "again Hello"), (None, "null id")]
    rows += [(100 + i, " ".join(rng.choice(["the", "The", "a,b", "x1y2", "naïve", "«q»", "word."]) for _ in range(i))) for i in range(60)]
    assert plain_rows(coded_of(spark, rows, tmp_path)) == expected(rows)


@pytest.mark.parametrize("which", ["word_bpe_49k.json"])
def test_random_code_points(spark, tmp_path, which):
    rng = random.Random(9)
    ranges = [(32, 126), (0xA0, 0x24F), (0x300, 0x36F), (0x370, 0x5FF), (0x900, 0xDFF), (0x1E00, 0x20CF), (0x3040, 0x30FF), (0xAC00, 0xAD00), (0x1F300, 0x1F6FF)]
    rows = [(i, "".join(chr(rng.randint(*rng.choice(ranges))) if rng.random() < 0.8 else rng.choice(" \n\t") for _ in range(200))) for i in range(200)]
    assert plain_rows(coded_of(spark, rows, tmp_path)) == expected(rows)


def test_no_documents(spark, tmp_path):
    assert plain_rows(coded_of(spark, [], tmp_path)) == []


def test_each_distinct_word_is_encoded_once(spark):
    spec = json.dumps(json.load(open(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))))
    words = spark.createDataFrame([(w, i) for i in range(50) for w in ("the", "of", "naïve")], "word string, block bigint")
    got = bpe.encode_words(words, spec).collect()
    assert sorted(r["word"] for r in got) == ["naïve", "of", "the"] and all(len(r["places"]) == 50 for r in got)


def test_decoding_ids_of_any_table(spark):
    file = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    pack = lambda *ids: bytearray(np.array(ids, "<u4").tobytes())
    got = bpe.decode(spark.createDataFrame([(1, pack(49406, 0, 49407)), (2, None), (3, pack()), (4, pack(70_000, 1, 2**32 - 1))], "doc_id int, ids binary"), file)
    assert [r["decoded"] for r in got.orderBy("doc_id").collect()] == ["<|startoftext|> ! <|endoftext|>", "", "", '"']


def test_changed_input_is_an_error(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("w"), F.expr("cast(rand() as string)")).alias("text"))
    shuffled = docs.withColumn("text", F.udf(lambda t: t + str(random.random()), "string").asNondeterministic()("text"))
    with pytest.raises(Exception, match="read again"):
        bpe.encode(shuffled, pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")).collect()


def test_queries_name_the_contract_columns(spark):
    got = {n: queries.QUERIES[n](spark, "/root/testdata/sf0.001").dtypes for n in ("op11_centroid_clustering", "op12_merkle_manifest", "op13_bpe_encoding")}
    assert dict(got["op11_centroid_clustering"]) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    assert dict(got["op12_merkle_manifest"]) == {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"}
    assert dict(got["op13_bpe_encoding"]) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
