"""The operators' queries against their SQL on the smallest tables, and contracts that hold on any table."""

import glob
import hashlib
import os
import re

import duckdb
import numpy as np
import pytest

from tallyproof.llm import queries

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(repr(v.item() if isinstance(v, np.generic) else v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    assert plain(queries.QUERIES[name](spark, TABLES).toPandas()) == plain(db.sql(queries.ORACLE_SQL[name]).df())


SCHEMAS = {
    "op1_minhash_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}, "op2_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_suffix_array_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}, "op5_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_source_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}, "op7_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op8_exact_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}, "op10_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


@pytest.mark.parametrize("name", list(SCHEMAS))
def test_contract_columns(spark, name):
    got = queries.QUERIES[name](spark, TABLES)
    assert dict(got.dtypes) == SCHEMAS[name] and got.count() > 0


def test_reruns_agree(spark):
    for name in ("op5_quality_classifier", "op2_toxicity", "op10_language_id"):
        a, b = (plain(queries.QUERIES[name](spark, TABLES).toPandas()) for _ in range(2))
        assert a == b, name


def test_base_secrets_of_the_whole_table(spark, db):
    """The pattern columns against Python's regular expressions."""
    tables = "/root/testdata/sf0.01"
    rx = (
        r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]+", "[0-9a-f]+",
    )
    want = {}
    for i, text in db.sql(f"SELECT doc_id, text FROM '{tables}/documents.parquet'").fetchall():
        spans = [(m.start(), k, m.end()) for k, r in enumerate(rx) for m in re.finditer(r, text or "") if (len(m[2]) >= 6 if k == 0 else len(m[0]) >= (20, 24)[k - 1])]
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        want[i] = (*(sum(k == j for _, j, _ in spans) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest())
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in queries.QUERIES["op7_secret_scan"](spark, tables).collect()}
    assert got == want and any(sum(w[:3]) for w in want.values())
