"""Operators over lines in order: hyphen merging, running headers, page labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

ROMAN = r"(?i)^(i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii|xiii|xiv|xv|xvi|xvii|xviii|xix|xx)$"
DIGITS = r"^\d{1,4}$"


def alternate(df: DataFrame, by: str, order: str, condition: str, out: str) -> DataFrame:
    """out = condition and not out of the row before: in each run of true conditions, the first, third, fifth ... row.

    Runs are found by subtracting row numbers, so a rule that consumes or rewrites the next row needs no loop.
    """
    w = Window.partitionBy(by).orderBy(order)
    df = df.withColumn("_n", F.row_number().over(w))
    df = df.withColumn("_run", F.col("_n") - F.sum(F.col(condition).cast("int")).over(w))
    inside = F.row_number().over(Window.partitionBy(by, "_run", condition).orderBy(order))
    return df.withColumn(out, F.col(condition) & (inside % 2 == 1)).drop("_n", "_run")


def merge_hyphenated(lines: DataFrame, by: str, prefixes=None) -> DataFrame:
    """Lines (by, line_no, line), normalised and without empty ones; a line that ends in a hyphen takes in the next one
    when that begins in lower case and is no heading. A line taken in can't take in another."""
    kept = lines.withColumn("line", T.normalize_line(F.col("line"))).where("line <> ''")
    w = Window.partitionBy(by).orderBy("line_no")
    nxt = F.col("_next")
    heading = T.is_heading(nxt, prefixes) if prefixes else T.is_heading(nxt)
    kept = kept.withColumn("_next", F.lead("line").over(w))
    kept = kept.withColumn("_can", F.coalesce(F.col("line").rlike(T.HYPHEN_END) & nxt.rlike(r"^\p{Ll}") & ~heading, F.lit(False)))
    kept = alternate(kept, by, "line_no", "_can", "_merge")
    kept = kept.withColumn("_used", F.coalesce(F.lag("_merge").over(w), F.lit(False)))
    merged = F.when(F.col("_merge"), F.concat(F.expr("left(line, length(line) - 1)"), nxt)).otherwise(F.col("line"))
    return kept.where("not _used").withColumn("line", merged).drop("_next", "_can", "_merge", "_used")


def repeated_lines(lines: DataFrame, doc: str, page: str, key: str, ratio: float = 0.60, least: int = 2) -> DataFrame:
    """(doc, key, df, pages): keys on at least `ratio` of a document's pages, each counted once per page."""
    pages = lines.groupBy(doc).agg(F.countDistinct(page).alias("pages"))
    df = lines.where(F.col(key) != "").select(doc, page, key).distinct().groupBy(doc, key).agg(F.count("*").alias("df"))
    enough = F.greatest(F.lit(least), F.ceil(F.lit(ratio) * F.col("pages")))
    return df.join(pages, doc).where(F.col("df") >= enough).select(doc, key, "df", "pages")


def labels_trivial(labels: Column, pages: Column) -> Column:
    """Whether an array of labels only numbers the pages from 1; true without labels or pages, false with fewer labels than pages."""
    number = lambda s: F.nullif(F.regexp_extract(s, r"(?i)^\s*(?:page\s+)?0*([0-9]{1,6})\s*$", 1), F.lit("")).cast("int")
    same = F.forall(F.transform(F.slice(labels, F.lit(1), pages), lambda s, i: F.coalesce(number(s) == i + 1, F.lit(False))), lambda x: x)
    return F.when(labels.isNull() | (pages <= 0), F.lit(True)).when(F.size(labels) < pages, F.lit(False)).otherwise(same)


def display_page(label: Column, index: Column) -> Column:
    """The printed label, else the page's number, else a question mark."""
    return F.coalesce(F.nullif(F.btrim(label), F.lit("")), F.when(index >= 0, (index + 1).cast("string")), F.lit("?"))


def derive_labels(lines: DataFrame, by: list[str], index: str) -> DataFrame:
    """(by, index, label, candidates) from non-empty page lines (by, index, pos, line), pos counting from 0.

    Footer numbers win (the last of the bottom 15 lines), then footer numerals, then the smallest number or the last numeral
    of the eight lines after one that says guideline, then the smallest number or last numeral of the page's top and bottom.
    """
    keys = [*by, index]
    page = Window.partitionBy(*keys)
    x = lines.withColumn("_t", T.normalize_line(F.col("line"))).withColumn("_n", F.count("*").over(page))
    x = x.withColumn("_mark", F.min(F.when(F.lower("line").contains("guideline"), F.col("pos"))).over(page))
    x = x.withColumn("_words", F.coalesce(F.lead("line").over(page.orderBy("pos")).rlike(r"\p{L}"), F.lit(False)))
    pos = F.col("pos")
    value = F.when(F.col("_t").rlike(DIGITS) & ~F.col("_t").rlike(ROMAN), F.col("_t").cast("int"))
    x = x.withColumn("_v", F.when((value >= 1) & (value <= 500), value)).withColumn("_r", F.when(F.col("_t").rlike(ROMAN), F.lower("_t")))
    x = x.withColumn("_foot", pos >= F.col("_n") - 15).withColumn("_head", F.coalesce((pos > F.col("_mark")) & (pos <= F.col("_mark") + 8), F.lit(False)))
    footed = F.max(F.when(F.col("_foot") & (F.col("_v").isNotNull() | F.col("_r").isNotNull()), F.lit(1))).over(page)
    x = x.withColumn("_footed", footed.isNotNull())
    bound = F.when(F.col(index) < 20, 30).otherwise(500)
    section = F.col("_footed") & (pos < 15) & (F.col("_v") <= 20) & F.col("_words")
    x = x.withColumn("_hv", F.when(F.col("_head") & (F.col("_v") <= bound) & ~section, F.col("_v")))
    x = x.withColumn("_fv", F.when(F.col("_foot"), F.col("_v"))).withColumn("_wide", (pos < 15) | F.col("_foot"))
    last = lambda c, cond: F.max_by(F.when(cond, F.col(c)), F.when(cond & F.col(c).isNotNull(), pos))
    out = x.groupBy(*keys).agg(
        last("_v", F.col("_foot")).cast("string").alias("a"), last("_r", F.col("_foot")).alias("b"), F.min("_hv").cast("string").alias("c"), last("_r", F.col("_head")).alias("e"),
        F.min(F.when(F.col("_wide"), F.col("_v"))).cast("string").alias("f"), last("_r", F.col("_wide")).alias("g"),
        F.array_sort(F.collect_set(F.coalesce("_fv", "_hv"))).alias("near"), F.array_sort(F.collect_set(F.when(F.col("_wide"), F.coalesce("_v", "_hv")))).alias("wide"),
    )
    narrow = F.coalesce("a", "b", "c", "e")
    found = F.when(narrow.isNull() & F.coalesce("f", "g").isNotNull(), F.col("wide")).otherwise(F.col("near"))
    return out.select(*keys, F.coalesce(narrow, F.col("f"), F.col("g")).alias("label"), found.alias("candidates"))


def smooth_labels(pages: DataFrame, doc: str, index: str) -> DataFrame:
    """Labels (doc, index, label, candidates) with outliers between consecutive neighbours replaced.

    A page that was replaced serves as the next one's neighbour, and the next one then agrees with it; so of a run of pages
    that ask for a change, every second one changes, beginning with the first.
    """
    w = Window.partitionBy(doc).orderBy(index)
    number = F.when(F.btrim("label").rlike(DIGITS), F.btrim("label").cast("int"))
    p = pages.withColumn("_v", number)
    p = p.withColumn("_p", F.lag("_v").over(w)).withColumn("_x", F.lead("_v").over(w))
    expected = F.col("_p") + 1
    odd = F.coalesce(F.col("_v") != expected, F.lit(True))
    chosen = F.array_contains("candidates", expected) | F.col("_v").isNull() | (F.abs(F.col("_v") - expected) >= 10)
    p = p.withColumn("_ask", F.coalesce((F.col("_x") == expected + 1) & odd & chosen, F.lit(False)))
    p = alternate(p, doc, index, "_ask", "_set")
    return p.withColumn("label", F.when(F.col("_set"), expected.cast("string")).otherwise(F.col("label"))).drop("_v", "_p", "_x", "_ask", "_set")
