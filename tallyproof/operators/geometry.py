"""Boxes on pages: algebra, text search over words, and rows by vertical overlap.

Words are a table (doc_id, page, x0, y0, x1, y1, text, block, line), one row a word. A search
joins targets to words by document and page; windows of up to 12 words are arrays within a
page's block. Tables without a doc_id are of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squash
from ..session import cut

MAX_WORDS = 12
ROW_TOLERANCE = 1.0


def union_box(a: Column, b: Column) -> Column:
    """The smallest box around two boxes (structs of x0, y0, x1, y1) of one page."""
    return F.struct(*[f(a[c], b[c]).alias(c) for c, f in (("x0", F.least), ("y0", F.least), ("x1", F.greatest), ("y1", F.greatest))])


def is_empty(b: Column) -> Column:
    return (b["x1"] <= b["x0"]) | (b["y1"] <= b["y0"])


def centre(b: Column) -> Column:
    return F.struct(((b["x0"] + b["x1"]) / 2).alias("x"), ((b["y0"] + b["y1"]) / 2).alias("y"))


def same_row(page_a: Column, a: Column, page_b: Column, b: Column, tol: float = ROW_TOLERANCE) -> Column:
    """Vertical ranges overlap, with a tolerance, on one page."""
    return (page_a == page_b) & ~((a["y1"] + tol < b["y0"]) | (b["y1"] + tol < a["y0"]))


def vertical_distance(page_a: Column, a: Column, page_b: Column, b: Column) -> Column:
    """Distance of the centres; infinite across pages."""
    return F.when(page_a == page_b, F.abs((a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2)).otherwise(F.lit(float("inf")))


def _of_document(df: DataFrame) -> DataFrame:
    return df if "doc_id" in df.columns else df.withColumn("doc_id", F.lit(""))


def find_text(targets: DataFrame, words: DataFrame, max_words: int = MAX_WORDS, unique: bool = False) -> DataFrame:
    """targets (target_id, doc_id, page, target) -> target_id, doc_id, page, ord, box: runs of words that hold the target's text.

    unique: only targets that are found exactly once.

    Within a block, runs in (line, x) order are extended up to max_words words; the first
    length that holds the target counts if the run's height is at most 2.6 times its
    tallest word. Boxes within 0.6 points of an earlier one are left out.
    """
    targets, words = _of_document(targets), _of_document(words)
    order = Window.partitionBy("doc_id", "page", "block").orderBy("line", "x0", "y0")
    run = order.rowsBetween(0, max_words - 1)
    w = words.withColumn("s", squash("text")).withColumn("run", F.collect_list(F.struct("x0", "y0", "x1", "y1", "s")).over(run)).withColumn("ord", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("block", "line", "x0", "y0")))
    t = targets.withColumn("t", squash("target")).where("t <> ''")
    both = t.join(w.select("doc_id", "page", "ord", "run"), ["doc_id", "page"]).where(F.call_function("contains", F.array_join(F.transform("run", lambda r: r["s"]), ""), F.col("t")))
    lengths = F.sequence(F.lit(1), F.size("run"))
    text = lambda n: F.array_join(F.transform(F.slice("run", F.lit(1), n), lambda r: r["s"]), "")
    first = F.array_min(F.filter(lengths, lambda n: F.call_function("contains", text(n), F.col("t"))))
    both = both.withColumn("n", first).where(F.length(text(F.col("n"))) <= F.length("t") + 24)
    # A shorter run that starts later holds the target too: keep runs that need their first word.
    rest = F.array_join(F.transform(F.expr("slice(run, 2, n - 1)"), lambda r: r["s"]), "")
    both = both.where(~F.call_function("contains", rest, F.col("t")))
    part = F.slice("run", F.lit(1), F.col("n"))
    box = F.aggregate(part, part[0], lambda a, r: F.struct(F.least(a["x0"], r["x0"]).alias("x0"), F.least(a["y0"], r["y0"]).alias("y0"), F.greatest(a["x1"], r["x1"]).alias("x1"), F.greatest(a["y1"], r["y1"]).alias("y1"), a["s"].alias("s")))
    tallest = F.array_max(F.transform(part, lambda r: r["y1"] - r["y0"]))
    found = both.withColumn("b", box).where((F.col("b.y1") - F.col("b.y0")) <= 2.6 * tallest)
    rounded = [F.round(F.col(f"b.{c}") / 0.6).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")]
    near = Window.partitionBy("target_id", "doc_id", "page", *[r for r in ("r_x0", "r_y0", "r_x1", "r_y1")]).orderBy("ord")
    found = found.select("target_id", "doc_id", "page", "ord", F.struct("b.x0", "b.y0", "b.x1", "b.y1").alias("box"), *rounded)
    found = found.withColumn("k", F.row_number().over(near)).where("k = 1").select("target_id", "doc_id", "page", "ord", "box")
    return found.withColumn("k", F.count("*").over(Window.partitionBy("target_id"))).where("k = 1").drop("k") if unique else found


def row_pairs(left: DataFrame, right: DataFrame, by: list[str], tol: float = ROW_TOLERANCE) -> DataFrame:
    """Rows of left (by, lbox) and right (by, rbox) whose boxes share a row of the page: a range join by bins over y.

    Bins are as high as the greater of the two sides' mean heights (and the tolerance), and a box lies in
    each bin that it touches; a pair is made only in the bin where its overlap begins, so once.
    Pairs grow with what overlaps nearby, not with the boxes of a page. `by` must hold the page;
    null keys, null boxes and boxes with null or non-finite edges meet nothing.
    """
    height = lambda df, c: df.where(_has_range(F.col(c))).agg(F.avg(F.col(c)["y1"] - F.col(c)["y0"]).alias("h")).first()["h"] or 0.0
    bin_height = max(height(left, "lbox"), height(right, "rbox"), tol, 1e-6) * 2
    at = lambda y: F.floor(y / F.lit(bin_height)).cast("bigint")
    # Half of the tolerance on each side decides on the same pairs but for rounding, which the exact test settles; so both get all of it.
    bins = lambda c: F.explode(F.sequence(at(F.col(c)["y0"] - tol), at(F.col(c)["y1"] + tol)))
    l = left.where(_has_range(F.col("lbox"))).withColumn("bin", bins("lbox"))
    r = right.where(_has_range(F.col("rbox"))).withColumn("bin", bins("rbox"))
    begins = at(F.greatest(F.col("lbox")["y0"], F.col("rbox")["y0"]) - tol) == F.col("bin")
    page = F.lit(1)
    return l.join(r, [*by, "bin"]).where(begins & same_row(page, F.col("lbox"), page, F.col("rbox"), tol)).drop("bin")


def nearest_in_row(left: DataFrame, right: DataFrame, by: list[str], other: str, tol: float = ROW_TOLERANCE) -> DataFrame:
    """Rows of left (by, lbox, …) with `other` and the gap of the right box (by, rbox, other) of their row whose centre is nearest; ties: the least `other`.

    Both sides are sorted by centre in bins, and each left box sees the next right centres below
    and above it (from other bins by a row a bin). If all boxes with the nearest centre share its row, it is done:
    work grows with the boxes, not with their pairs. Only the rest, whose nearest centre isn't of
    their row, meets all boxes of the row, see row_pairs().
    """
    names = left.columns
    kept = lambda df, c: df.where(_has_range(F.col(c))).dropna(subset=by)
    middle = lambda c: ((F.col(c)["y0"] + F.col(c)["y1"]) / 2).alias("c")
    edge = lambda y, c: F.col(c)[y].cast("double")
    # Boxes with one centre: the lowest of them decides whether all share a row.
    centres = kept(right, "rbox").groupBy(*by, middle("rbox")).agg(F.min(other).alias("other"), F.max(edge("y0", "rbox")).alias("y0"), F.min(edge("y1", "rbox")).alias("y1"))
    r = centres.select(*by, "c", F.lit(None).cast(left.select(F.struct(*names)).dtypes[0][1]).alias("l"), F.struct("c", "other", "y0", "y1").alias("r"))
    l = kept(left, "lbox").select(*by, middle("lbox"), F.struct(*names).alias("l"), F.lit(None).cast(r.select("r").dtypes[0][1]).alias("r"))
    both = l.unionByName(r).withColumn("bin", F.floor(F.col("c") / tol))
    seen = lambda order, *keys: Window.partitionBy(*keys).orderBy(order)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    before = lambda order: seen(order, *by).rowsBetween(Window.unboundedPreceding, -1)
    bins = both.groupBy(*by, "bin").agg(F.min("r").alias("lowest"), F.max("r").alias("highest"))
    bins = bins.select(*by, "bin", last("highest", before(F.asc("bin"))).alias("under"), last("lowest", before(F.desc("bin"))).alias("over"))
    at = both.withColumn("a", last("r", seen(F.asc("c"), *by, "bin"))).withColumn("b", last("r", seen(F.desc("c"), *by, "bin"))).where("l IS NOT NULL")
    at = at.join(bins, [*by, "bin"]).withColumns({"a": F.coalesce("a", "under"), "b": F.coalesce("b", "over")}).where("a IS NOT NULL OR b IS NOT NULL")
    gap = lambda c: F.coalesce(F.abs(F.col("c") - F.col(c)["c"]), F.lit(float("inf")))
    at = at.withColumns({"ga": gap("a"), "gb": gap("b")}).withColumn("gap", F.least("ga", "gb"))
    shares = lambda c: ~((F.col("l.lbox.y1") + tol < F.col(c)["y0"]) | (F.col(c)["y1"] + tol < F.col("l.lbox.y0")))
    ok = lambda c, g: (F.col(g) > F.col("gap")) | shares(c)
    at = at.withColumn("done", ok("a", "ga") & ok("b", "gb"))
    mine = lambda c, g: F.when(F.col(g) == F.col("gap"), F.col(c)["other"])
    done = at.where("done").select("l.*", F.least(mine("a", "ga"), mine("b", "gb")).alias(other), "gap")
    rest = cut(at.where("NOT done").select("l.*"))
    met = row_pairs(rest.withColumn("row", F.monotonically_increasing_id()), right.select(*by, "rbox", other), by, tol)
    page = F.lit(1)
    best = met.withColumn("gap", vertical_distance(page, F.col("lbox"), page, F.col("rbox"))).groupBy("row").agg(F.min_by(F.struct(*names, other, "gap"), F.struct("gap", other)).alias("m"))
    return done.unionByName(best.select("m.*"))


def _has_range(b: Column) -> Column:
    finite = lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf"))
    return b.isNotNull() & finite(b["y0"]) & finite(b["y1"]) & (b["y0"] <= b["y1"])


def locate_rows(pairs: DataFrame, label_boxes: DataFrame, value_boxes: DataFrame, tol: float = ROW_TOLERANCE) -> DataFrame:
    """pairs (pair_id) with boxes (pair_id, doc_id, page, ord, box) of a label and of a value, in one document -> label_box, value_box, row_box, same_row.

    The pair of boxes that share a row with the least distance counts (ties: the first
    ones); without one the first boxes are given, unverified.
    """
    l = _of_document(label_boxes).select("pair_id", "doc_id", "page", F.col("ord").alias("lo"), F.col("box").alias("lbox"))
    v = _of_document(value_boxes).select("pair_id", "doc_id", "page", F.col("ord").alias("vo"), F.col("box").alias("rbox"))
    met = row_pairs(l, v, ["pair_id", "doc_id", "page"], tol)
    gap = vertical_distance(F.col("page"), F.col("lbox"), F.col("page"), F.col("rbox"))
    best = met.groupBy("pair_id").agg(F.min_by(F.struct(F.col("page").alias("lp"), F.col("lbox").alias("lb"), F.col("rbox").alias("vb")), F.struct(gap, "lo", "vo")).alias("m"))
    l, v = l.withColumnRenamed("lbox", "lb"), v.withColumnRenamed("rbox", "vb")
    first_l = l.groupBy("pair_id").agg(F.min_by("lb", "lo").alias("fl"))
    first_v = v.groupBy("pair_id").agg(F.min_by("vb", "vo").alias("fv"))
    out = pairs.select("pair_id").join(best, "pair_id", "left").join(first_l, "pair_id", "left").join(first_v, "pair_id", "left")
    ok = F.col("m").isNotNull()
    return out.select("pair_id", F.coalesce("m.lb", "fl").alias("label_box"), F.coalesce("m.vb", "fv").alias("value_box"), F.when(ok, union_box(F.col("m.lb"), F.col("m.vb"))).alias("row_box"), ok.alias("same_row"))
