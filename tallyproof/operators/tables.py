"""Page-marked documents to table rows: pages, blocks, logical tables, chunks.

Each step is a DataFrame; order is an explicit column from the scan on. All windows are
partitioned by document, so a corpus spreads over the cluster by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import NON_VALUE_HEADERS
from ..functions.rewrite import caption_scope
from ..functions.text import chunk_text, clean_label, looks_like_amount, looks_like_date, normalize_text, page_span, strip_tags, years_in

_MARKER = r"<!--\s*page\s+([0-9]+)\s+of\s+([0-9]+)\s*-->"
_ITEM = r"((?s:<table\b.*?</table>)|(?m:(?:^\|[^\n]*$\n?)+)|(?m:^[ \t]*#{1,6}[ \t]*[^\n]+?[ \t]*$))"


def pages(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, page_ord, page, total_pages, body. Text before the first marker is left out."""
    split = docs.select(
        "doc_id",
        F.regexp_extract_all("text", F.lit(_MARKER), F.lit(1)).alias("numbers"),
        F.array_max(F.transform(F.regexp_extract_all("text", F.lit(_MARKER), F.lit(2)), lambda x: x.cast("int"))).alias("total_pages"),
        F.split("text", _MARKER).alias("bodies"),
    ).where(F.size("numbers") > 0)
    each = F.arrays_zip(F.col("numbers").alias("number"), F.expr("slice(bodies, 2, size(bodies))").alias("body"))
    return split.select("doc_id", "total_pages", F.posexplode(each).alias("page_ord", "p")).select("doc_id", "page_ord", F.col("p.number").cast("int").alias("page"), "total_pages", F.col("p.body").alias("body"))


def _cells(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(t.alias("text"), F.lit(1).alias("colspan")))


def _html_rows(item: Column) -> Column:
    def cell(c: Column) -> Column:
        span = F.regexp_extract(F.regexp_extract(c, r"(?s)^<t[dh]\b([^>]*)>", 1), r'(?i)colspan\s*=\s*"?([0-9]+)"?', 1)
        return F.struct(strip_tags(F.regexp_extract(c, r"(?s)^<t[dh]\b[^>]*>(.*?)</t[dh]>$", 1)).alias("text"), F.greatest(F.coalesce(span.try_cast("int"), F.lit(1)), F.lit(1)).alias("colspan"))

    rows = F.regexp_extract_all(item, F.lit(r"((?s:<tr\b.*?</tr>))"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"((?s:<t[dh]\b[^>]*>.*?</t[dh]>))"), F.lit(1)), cell))


def _pipe_rows(item: Column) -> Column:
    lines = F.filter(F.transform(F.split(item, "\n"), lambda x: F.trim(x)), lambda s: s.startswith("|"))
    rows = F.transform(lines, lambda s: _cells(F.transform(F.split(F.regexp_replace(s, r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))))
    return F.filter(rows, lambda r: ~F.forall(r, lambda c: c["text"].rlike("^[-: ]+$")))


def flat(row: Column) -> Column:
    """A row's texts with a spanning cell followed by empty ones."""
    return F.flatten(F.transform(row, lambda c: F.concat(F.array(c["text"]), F.array_repeat(F.lit(""), c["colspan"] - 1))))


def fit(cells: Column, width: Column) -> Column:
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), F.lit(1), width)


def mode_larger(values: Column) -> Column:
    """The most frequent value of an array, the larger one on ties."""
    counted = F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), v.alias("v")))
    return F.array_max(counted)["v"]


def mode_by(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The same per group, for groups of any size: values are counted first, so no array of a group is built."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.max(F.struct("n", value))[value].alias(value))


def is_header(cells: Column) -> Column:
    rest = F.slice(cells, F.lit(2), F.size(cells))
    dated = F.exists(cells, lambda c: looks_like_date(c)) & ~F.exists(rest, lambda c: looks_like_amount(c))
    return F.coalesce(F.try_element_at(cells, F.lit(1)).contains("项目") | dated, F.lit(False))


def blocks(paged: DataFrame) -> DataFrame:
    """Table blocks in document order: doc_id, ord, page, serialization, caption, rows, width, head_like.

    The caption is the last heading before the block, carried over pages.
    """
    items = paged.select("doc_id", "page_ord", "page", F.posexplode(F.regexp_extract_all("body", F.lit(_ITEM), F.lit(1))).alias("pos", "item"))
    kind = F.when(F.col("item").startswith("<table"), "html").when(F.col("item").startswith("|"), "markdown")
    order = Window.partitionBy("doc_id").orderBy("page_ord", "pos")
    heading = F.when(kind.isNull(), F.trim(F.regexp_replace("item", r"^[ \t]*#{1,6}[ \t]*", "")))
    out = items.withColumn("serialization", kind).withColumn("caption", F.last(heading, ignorenulls=True).over(order))
    rows = F.filter(F.when(F.col("serialization") == "html", _html_rows(F.col("item"))).otherwise(_pipe_rows(F.col("item"))), lambda r: F.size(r) > 0)
    out = out.where("serialization IS NOT NULL").withColumn("rows", rows).where(F.size("rows") > 0)
    out = out.withColumn("ord", (F.row_number().over(order) - 1).cast("int"))
    width = mode_larger(F.transform("rows", lambda r: F.size(flat(r))))
    return out.select("doc_id", "ord", "page", "serialization", "caption", "rows", width.alias("width"), is_header(flat(F.col("rows")[0])).alias("head_like"))


def stitch(block: DataFrame) -> DataFrame:
    """blocks with table_index, continuation and reason: a block starts a table iff it has a header or doesn't continue the block before.

    A block either starts a table or extends the last one, so the table before it ends on
    the previous block's page and has its width: gaps and islands, no iteration.
    """
    order = Window.partitionBy("doc_id").orderBy("ord")
    before_page, before_width = F.lag("page").over(order), F.lag("width").over(order)
    joins = F.coalesce((F.col("page") == before_page + 1) & (F.col("width") == before_width), F.lit(False))
    reason = F.when(F.col("head_like") | joins, None).when(before_page.isNull(), "first block without a header").otherwise(
        F.format_string("doesn't continue the table before (page %s, %s columns; this block page %s, %s columns)", before_page, before_width, F.col("page"), F.col("width"))
    )
    out = block.withColumn("new", F.col("head_like") | ~joins).withColumn("reason", reason)
    out = out.withColumn("table_index", (F.sum(F.col("new").cast("int")).over(order) - 1).cast("int"))
    return out.withColumn("continuation", ~F.col("new")).drop("new")


def table_rows(stitched: DataFrame) -> DataFrame:
    """One row per table row: header (or null), table width, label, cells, section carried forward, scope by caption."""
    table = Window.partitionBy("doc_id", "table_index").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.first(F.when(F.col("head_like"), fit(flat(F.col("rows")[0]), F.col("width")))).over(table)
    out = stitched.withColumn("header", head).withColumn("scope", caption_scope(F.first("caption").over(table))).withColumn("table_width", F.first("width").over(table))
    body = F.when(F.col("head_like"), F.expr("slice(rows, 2, size(rows))")).otherwise(F.col("rows"))
    out = out.select("doc_id", "table_index", "table_width", "header", "scope", "ord", "page", "width", "continuation", F.posexplode(body).alias("pos", "row"))
    cells = fit(flat(F.col("row")), F.greatest("width", F.lit(1)))
    section = (F.size("row") == 1) & (F.col("row")[0]["colspan"] > 1)
    order = Window.partitionBy("doc_id", "table_index").orderBy("ord", "pos")
    out = out.withColumn("cells", cells).withColumn("label", F.col("cells")[0]).withColumn("is_section", section)
    out = out.withColumn("section", F.last(F.when(F.col("is_section"), F.col("label")), ignorenulls=True).over(order))
    return out.withColumn("row_index", (F.row_number().over(order) - 1).cast("int")).drop("row", "ord", "pos")


def logical_tables(stitched: DataFrame) -> DataFrame:
    """One row per table: pages, serializations, flags, header, report years."""
    first = F.min_by(F.struct("head_like", "rows", "caption", "width"), "ord")
    grouped = stitched.groupBy("doc_id", "table_index").agg(
        first.alias("f"), F.min("page").alias("page_start"), F.max_by("page", "ord").alias("page_end"), F.array_sort(F.collect_set("serialization")).alias("serializations"),
        F.array_sort(F.collect_list("page")).alias("pages"), F.min_by("reason", "ord").alias("flag"), F.count("*").alias("blocks"),
    )
    header = F.when(F.col("f.head_like"), fit(flat(F.col("f.rows")[0]), F.col("f.width")))
    years = F.when(header.isNotNull(), F.array_sort(F.array_distinct(F.flatten(F.transform(header, lambda h: years_in(h, bounded=False)))))).otherwise(F.array().cast("array<int>"))
    flags = F.filter(F.array("flag"), lambda x: x.isNotNull())
    return grouped.select(
        "doc_id", "table_index", header.alias("header"), "page_start", "page_end", page_span(F.col("page_start"), F.col("page_end")).alias("page_span"), "pages", "serializations", flags.alias("flags"),
        F.col("f.caption").alias("caption"), caption_scope(F.col("f.caption")).alias("scope"), years.alias("report_years"), F.col("f.width").alias("width"), "blocks",
    )


def value_columns(header: Column, width: Column) -> Column:
    """Indexes of value columns: those whose header isn't a label, note or ordinal column; all but the first without such."""
    default = F.when(width > 1, F.sequence(F.lit(1), F.greatest(width - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    picked = F.filter(F.transform(header, lambda h, i: F.when(~normalize_text(h, cell=True).isin(*NON_VALUE_HEADERS), i)), lambda i: i.isNotNull())
    return F.when(header.isNull() | (F.size(picked) == 0), default).otherwise(picked)


def chunks(rows: DataFrame) -> DataFrame:
    """One retrieval unit per table row that isn't a section row.

    `values` keeps each value column's place (blank cells stay ''), `compact_values` is
    without blanks.
    """
    values = F.transform(value_columns(F.col("header"), F.col("table_width")), lambda i: F.trim(F.coalesce(F.get("cells", i), F.lit(""))))
    label = clean_label("label")
    out = rows.where("NOT is_section").withColumn("values", values).withColumn("compact_values", F.filter("values", lambda v: v != ""))
    return out.select(
        F.concat("doc_id", F.lit("#t"), "table_index", F.lit("r"), "row_index").alias("chunk_id"), "doc_id", "table_index", "row_index", "page", label.alias("label"), "section", "values", "compact_values",
        F.trim(chunk_text(label, F.col("section"), F.col("compact_values"))).alias("text"), "scope", "continuation",
    )


def build_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> chunks, the whole offline path."""
    return chunks(table_rows(stitch(blocks(pages(docs)))))


def to_markdown(rows: DataFrame) -> DataFrame:
    """doc_id, table_index, line_no, line: tables as pipe rows with their page behind each."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "cells"), F.lit(" | <!-- p"), F.col("page").cast("string"), F.lit(" -->"))
    return rows.select("doc_id", "table_index", F.col("row_index").alias("line_no"), line.alias("line"))


def declared_unit(docs: DataFrame) -> DataFrame:
    """(doc_id, priority, text) -> doc_id, unit, found_in: the first declared unit by priority; yuan where none is."""
    unit = F.regexp_extract("text", "单位[:：]\\s*(百万元|万元|千元|亿元|元)", 1)
    found = docs.withColumn("unit", F.when(unit != "", unit)).groupBy("doc_id").agg(F.min_by("unit", F.when(F.col("unit").isNotNull(), F.col("priority"))).alias("unit"), F.min(F.when(F.col("unit").isNotNull(), F.col("priority"))).alias("found_in"))
    return found.select("doc_id", F.coalesce("unit", F.lit("元")).alias("unit"), "found_in")


def issuer(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, company: what stands behind the preparing entity's mark, else ''."""
    return docs.select("doc_id", F.trim(F.regexp_extract("text", r"编制单位[:：]\s*([^\s|<]+)", 1)).alias("company"))
