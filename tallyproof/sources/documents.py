"""Page-marked documents, and word tables of page text layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): each file a document, its id the file name without its ending."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]+)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("doc_id"), F.col("value").alias("text"))


#: What a page mark begins with: files are split there.
_MARK = "<!--"
_REST = r"(?s)^\s*page\s+([0-9]+)\s+of\s+([0-9]+)\s*-->(.*)$"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page_ord, page, total_pages, body): the pages of page-marked files, as tables.pages(read_documents()) gives them.

    A file is read in as many tasks as it has splits, each taking whole pages, so that a report
    may be larger than a task or a text value; texts aren't shuffled. Pages are numbered by
    counts of the splits before theirs. total_pages is the greatest that a mark of the file
    names. Text before the first mark is left out. Another comment inside a page is text of that
    page; only files with such get their pieces put together by page. A comment's beginning as
    the last characters of a file is left out.
    """
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]+)?$", 1)
    lines = spark.read.option("lineSep", _MARK).text(path).select(
        F.col("_metadata.file_path").alias("file"), name.alias("doc_id"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value")
    )
    marked = lines.withColumn("is_mark", F.col("value").rlike(_REST))
    # A row a split: its first place, its marks, and whether pieces follow that aren't pages (a file's first piece isn't one).
    splits = marked.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("pieces"), F.count_if("is_mark").alias("marks"), F.max(F.when(F.col("is_mark"), F.regexp_extract("value", _REST, 2).cast("int"))).alias("total"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumns({"offset": F.coalesce(F.sum("marks").over(before), F.lit(0)), "total_pages": F.max("total").over(Window.partitionBy("file"))})
    head = F.when(F.col("split") == 0, 1).otherwise(0)
    splits = cut(splits.withColumn("torn", F.bool_or(F.col("pieces") - F.col("marks") > head).over(Window.partitionBy("file"))))
    rows = marked.join(splits.select("file", "split", "first", "pieces", "marks", "offset", "total_pages", "torn"), ["file", "split"])
    page = lambda value: (F.regexp_extract(value, _REST, 1).cast("int").alias("page"), "total_pages", F.regexp_extract(value, _REST, 3).alias("body"))
    # Whole files: only the first piece isn't a page, and the others follow each other in a split.
    skipped = F.when((F.col("split") == 0) & (F.col("pieces") > F.col("marks")), 1).otherwise(0)
    whole = rows.where("NOT torn AND is_mark").select("doc_id", (F.col("offset") + F.col("at") - F.col("first") - skipped).cast("int").alias("page_ord"), *page("value"))
    torn = rows.where("torn")
    nth = F.count_if("is_mark").over(Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) + F.col("offset") - 1
    pieces = torn.withColumn("page_ord", nth.cast("int")).where("page_ord >= 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "at", "value"))), lambda x: x["value"]), _MARK)
    joined = pieces.groupBy("file", "doc_id", "page_ord", "total_pages").agg(text.alias("value")).select("doc_id", "page_ord", *page("value"))
    return whole.unionByName(joined)


def page_text(words: DataFrame) -> DataFrame:
    """(doc_id, page, …words…) -> doc_id, page, text in block, line and x order."""
    ordered = F.array_sort(F.collect_list(F.struct("block", "line", "x0", "y0", "text")))
    return words.groupBy("doc_id", "page").agg(ordered.alias("w")).select("doc_id", "page", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"))


def chunk_pages(chunks: DataFrame) -> DataFrame:
    """(doc_id, page, text): each page's chunks in order, one per line."""
    ordered = F.array_sort(F.collect_list(F.struct("table_index", "row_index", "text")))
    return chunks.groupBy("doc_id", "page").agg(ordered.alias("c")).select("doc_id", "page", F.array_join(F.transform("c", lambda x: x["text"]), "\n").alias("text"))
