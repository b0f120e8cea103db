"""Command line: spark-submit this file, or python -m tallyproof.cli.

  build-index REPORTS INDEX          page-marked files to index tables
  answer INDEX FACTS QUESTIONS OUT   questions (JSON lines) to answers (Parquet)
  evaluate INDEX FACTS BANK          a bank's pass rates, failures and statistics
  check-bank BANK                    rules that items break
  gold-check INDEX BANK [--source REPORTS]   the gates of a bank's gold annotations; the third one needs the reports
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .operators import tables
from .plans import answer, evaluation
from .session import get_session
from .sources import bank, documents, index_store


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, args in (("build-index", ("reports", "index")), ("answer", ("index", "facts", "questions", "out")), ("evaluate", ("index", "facts", "bank")), ("check-bank", ("bank",)), ("gold-check", ("index", "bank"))):
        command = commands.add_parser(name)
        for a in args:
            command.add_argument(a)
        if name == "gold-check":
            command.add_argument("--source", help="page-marked files that the index was built from")
    a = parser.parse_args(argv)
    spark = get_session()
    if a.command == "build-index":
        docs = documents.read_documents(spark, a.reports)
        chunks = tables.build_chunks(docs)
        index_store.write(index_store.build(chunks, hold=True), a.index)
        years = tables.logical_tables(tables.stitch(tables.blocks(tables.pages(docs)))).groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("report_years")))).alias("years"))
        facts = tables.issuer(docs).join(tables.declared_unit(docs.withColumn("priority", F.lit(0))), "doc_id").join(years, "doc_id", "left")
        facts.write.mode("overwrite").parquet(f"{a.index}/facts")
        index_store.scope_report(index_store.load(spark, a.index)["chunks"]).show()
    elif a.command == "answer":
        questions = spark.read.schema("question_id string, doc_id string, question string, period string").json(a.questions).withColumn("period", F.coalesce("period", F.lit("current")))
        answer.answer(questions, spark.read.parquet(a.facts), index_store.load(spark, a.index)).write.mode("overwrite").parquet(a.out)
    elif a.command == "evaluate":
        items = bank.read_bank(spark, a.bank)
        questions = items.select(F.col("item_id").alias("question_id"), F.col("doc").alias("doc_id"), "question")
        results = evaluation.compare(items, answer.answer(questions, spark.read.parquet(a.facts), index_store.load(spark, a.index))).cache()
        for table in (evaluation.pass_rates(results), evaluation.failures(results), evaluation.eval_stats(results)):
            table.show(100, False)
    elif a.command == "check-bank":
        bad = bank.bad_lines(spark, a.bank)
        if not bad.isEmpty():
            bad.show(100, False)
            return
        items = bank.read_bank(spark, a.bank)
        evaluation.validate_bank(items).show(100, False)
        bank.bank_stats(items).show(100, False)
    else:
        pages = documents.chunk_pages(index_store.load(spark, a.index)["chunks"])
        source = a.source and documents.read_pages(spark, a.source).select("doc_id", "page", F.col("body").alias("text"))
        evaluation.gold_gates(bank.read_bank(spark, a.bank), pages, source).show(100, False)


if __name__ == "__main__":
    main()
