"""Pages of files that are read in splits."""

import random

import pytest

from tallyproof.operators import tables
from tallyproof.sources import documents


def plain(df):
    return sorted((r.doc_id, r.page_ord, r.page, r.total_pages, r.body) for r in df.collect())


@pytest.fixture(scope="module")
def reports(tmp_path_factory):
    root = tmp_path_factory.mktemp("reports")
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("资产负债 abc|\n<!->") for _ in range(n))
    files = {
        "long": "head\n" + "".join(f"<!-- page {i} of 400 -->\n{text(rng.randint(0, 90))}" for i in range(1, 401)), "at start": "<!-- page 3 of 4 -->a<!-- page 4 of 4 -->", "none": "no marks here", "empty": "", "one": "x<!-- page 7 of 9 -->y\r\nz",
        "torn": "h <!-- page break --> <!-- page 1 of 3 -->a <!-- page x --> b<!-- page 2 of 3 -->" + "c <!-- page of 3 --> " * 40 + "<!--page 3   of 5-->d<!-- page > <!-- image -->e", "repeated": "<!-- page 1 of 2 -->a<!-- page 1 of 2 -->a",
    }
    for name, t in files.items():
        (root / f"{name}.md").write_bytes(t.encode())
    return str(root / "*.md")


@pytest.mark.parametrize("split", [37, 64, 200, 1 << 20])
def test_pages_are_the_same_for_any_split(spark, reports, split):
    want = plain(tables.pages(documents.read_documents(spark, reports)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = documents.read_pages(spark, reports)
        assert plain(got) == want
        assert len(want) == 400 + 2 + 1 + 3 + 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
