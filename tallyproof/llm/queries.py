"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, decontam, langid, licences, merkle, mixing, quality, secret_scan, substrings, topk, toxicity
from .minhash import near_duplicates
from .sampling import split_of
from .store import Store


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _judged(scored: DataFrame, parts: int, held: int, threshold: float) -> DataFrame:
    return scored.select("doc_id", (split_of("doc_id", parts) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.train_rows(_read(spark, sf_dir, "labels"), "toxic"), docs)
    return _judged(toxicity.score(docs, model), 3, 1, toxicity.THRESHOLD)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("licences", lambda m: m["licence"]))))
    best = F.round(F.coalesce(F.array_max(F.transform("licences", lambda m: m["dice"])), F.lit(0.0)), 6)
    return found.select("doc_id", F.size("licences").cast("bigint").alias("n_matches"), names.alias("licences"), best.alias("best_dice"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_on_tables(docs, _read(spark, sf_dir, "labels"))
    return _judged(quality.score(docs, model), 3, 1, quality.THRESHOLD)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    sized = store.keep(_read(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size")))
    mixed = mixing.mix(sized, store.keep(mixing.rates(sized)))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = found.withColumn("base", F.filter("spans", lambda s: s["kind"] < 3))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return base.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secret_scan.labels("base"), 256).alias("base_sha256"), secret_scan.labels("spans").alias("spans"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(_read(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(vectors, F.col("vec_id") % 20 == 0)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), "first_word", "end_word")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.fit(docs.where(split_of("doc_id", 4) != 2)))
    return found.select("doc_id", (split_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(centroids.integer_vectors(_read(spark, sf_dir, "embeddings")))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(_read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    folded = found.withColumn("folded_root", merkle.fold("tampered", "proof"))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings("proof"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_bpe_encoding(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.encode(_read(spark, sf_dir, "documents"), path, decoded=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_source_mixing": op6_source_mixing,
    "op7_secret_scan": op7_secret_scan,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_language_id": op10_language_id,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_bpe_encoding": op13_bpe_encoding,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _licence_sql() -> str:
    """The same by relations: places of template bigrams, windows between two of them, sets of bigrams by lists."""
    rows, sizes = [], []
    for key, text in licences.TEMPLATES.items():
        grams = licences.template_bigrams(text)
        need, most = licences.bounds(len(grams), licences.THRESHOLD)
        rows += [f"('{key}', '{g}')" for g in grams]
        sizes.append(f"('{key}', {len(grams)}, {need}, {most})")
    return rf"""
WITH t(licence, b) AS (VALUES {", ".join(rows)}),
sizes(licence, size, need, most) AS (VALUES {", ".join(sizes)}),
words AS (SELECT doc_id, text, list_filter(string_split(regexp_replace({_LOWER}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
grams AS (SELECT doc_id, text, CASE WHEN len(w) < 2 THEN [] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END AS g FROM words),
placed AS (SELECT doc_id, text, unnest(g) AS b, unnest(range(1, len(g) + 1)) AS p FROM grams),
hits AS (SELECT doc_id, text, licence, p, row_number() OVER (PARTITION BY doc_id, text, licence ORDER BY p) AS k FROM placed JOIN t USING (b)),
windows AS (SELECT x.doc_id, x.text, x.licence, size, x.p AS s, y.p AS e FROM hits x JOIN hits y ON x.doc_id IS NOT DISTINCT FROM y.doc_id AND x.text = y.text AND x.licence = y.licence
  JOIN sizes ON sizes.licence = x.licence WHERE y.k - x.k + 1 >= need AND y.p - x.p < most),
lists AS (SELECT licence, list(b) AS b FROM t GROUP BY licence),
scored AS (SELECT windows.doc_id, windows.text, windows.licence, s, e, 2.0::DOUBLE * len(list_intersect(list_distinct(g[s:e]), b)) / (len(list_distinct(g[s:e])) + size) AS dice
  FROM windows JOIN grams ON grams.doc_id IS NOT DISTINCT FROM windows.doc_id AND grams.text = windows.text JOIN lists ON lists.licence = windows.licence),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text, licence ORDER BY dice DESC, s, e) AS r FROM scored WHERE dice >= {licences.THRESHOLD}),
kept AS (SELECT * FROM best m WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM best o WHERE o.r = 1 AND o.doc_id IS NOT DISTINCT FROM m.doc_id AND o.text = m.text AND o.dice > m.dice AND o.s < m.e + 2 AND o.e + 2 > m.s)),
per AS (SELECT doc_id, text, count(*) AS n, array_to_string(list_sort(list(licence)), ',') AS l, max(dice) AS d FROM kept GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(n, 0) AS n_matches, coalesce(l, '') AS licences, round(coalesce(per.d, 0.0::DOUBLE), 6) AS best_dice
FROM documents d LEFT JOIN per ON per.doc_id IS NOT DISTINCT FROM d.doc_id AND per.text = d.text"""


def _kmeans_sql(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """Each round as two relations: distances to all centroids, then exact floors of means."""
    ctes = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, e) - 1)::INTEGER AS c, e FROM (SELECT sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h, e FROM v ORDER BY h, e LIMIT {k}))"]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, e, c, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS n FROM (
  SELECT v.r, vec_id, v.e, c, list_sum(list_transform(list_zip(v.e, c{i}.e), lambda z: ((z[1] - z[2]) * (z[1] - z[2]))::HUGEINT))::BIGINT AS d FROM v, c{i})) WHERE n = 1)""")
        if i < rounds:
            ctes.append(f"""m{i} AS (SELECT c, j, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, unnest(range(1, 65)) AS j FROM a{i}) GROUP BY c, j),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(f, e) AS e FROM c{i} LEFT JOIN (SELECT c, list((s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END)::BIGINT ORDER BY j) AS f FROM m{i} GROUP BY c) USING (c))""")
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, a{rounds}.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a{rounds}.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.e, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""


def _merkle_sql(levels: int = 8) -> str:
    """Levels as relations; trees of up to 16 ** levels leaves."""
    field = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
    leaf = lambda t: f"sha256(concat({', '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', t)))}))"
    crc = f"""xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [f"d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS bad FROM documents)"]

    def tree(name: str, rows: str) -> list[str]:
        """Levels name0, name1, ... of (t, p, h), their one-node ends, and proofs of level 0 (pieces by level)."""
        out = [f"{name}0 AS MATERIALIZED ({rows})"]
        for i in range(levels):
            out.append(f"{name}{i + 1} AS MATERIALIZED (SELECT t, p // 16 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM {name}{i}) WHERE n > 1 GROUP BY t, p // 16)")
        ends = " UNION ALL ".join(f"(SELECT t, min(h) AS h FROM {name}{i} GROUP BY t HAVING count(*) = 1)" for i in range(levels + 1))
        out.append(f"{name}end AS MATERIALIZED ({ends})")
        pieces = " UNION ALL ".join(
            f"(SELECT l.t, l.p, {i} AS lv, coalesce(string_agg(s.h, '' ORDER BY s.p) FILTER (s.p < l.p >> {4 * i}), '') AS before, coalesce(string_agg(s.h, '' ORDER BY s.p) FILTER (s.p > l.p >> {4 * i}), '') AS after "
            f"FROM {name}0 l JOIN (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM {name}{i}) s ON s.t IS NOT DISTINCT FROM l.t AND s.p // 16 = l.p >> {4 * i + 4} AND s.n > 1 GROUP BY l.t, l.p)"
            for i in range(levels)
        )
        out.append(f"{name}proof AS MATERIALIZED (SELECT t, p, list({{'b': before, 'a': after}} ORDER BY lv) AS proof FROM ({pieces}) GROUP BY t, p)")
        return out

    ctes += ["n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d)"]
    ctes += tree("x", "SELECT source AS t, p, leaf AS h FROM n")
    ctes += ["s AS MATERIALIZED (SELECT t AS source, h AS subroot, row_number() OVER (ORDER BY t NULLS FIRST) - 1 AS p FROM xend)"]
    ctes += tree("y", "SELECT 0 AS t, p, subroot AS h FROM s")
    ctes += ["""f AS (SELECT doc_id, leaf, bad, subroot, (SELECT h FROM yend) AS root, list_concat(coalesce(xproof.proof, []), coalesce(yproof.proof, [])) AS proof FROM n JOIN s ON s.source IS NOT DISTINCT FROM n.source
  LEFT JOIN xproof ON xproof.t IS NOT DISTINCT FROM n.source AND xproof.p = n.p LEFT JOIN yproof ON yproof.p = s.p),
g AS (SELECT *, list_reduce(list_prepend({'b': '', 'a': bad}, proof), lambda acc, x: {'b': '', 'a': sha256(x.b || acc.a || x.a)}).a AS folded_root FROM f)"""]
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(proof, lambda x: x.b || x.a), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM g"


ORACLE_SQL = {
    "op11_centroid_clustering": _kmeans_sql(),
    "op12_merkle_manifest": _merkle_sql(),
    "op8_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM (SELECT DISTINCT * FROM v WHERE vec_id % 20 = 0) q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op4_license_scan": _licence_sql(),
    "op6_source_mixing": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{mixing.SEED}'), 1, 8))::BIGINT AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w, (2 * source_size)::DOUBLE AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target, d.size * (floor(rate)::BIGINT + CASE WHEN u < (rate - floor(rate)) * 4294967296.0::DOUBLE THEN 1 ELSE 0 END) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source""",
    "op1_minhash_near_dedup": rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_id AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least_id USING (doc_id)""",
}
