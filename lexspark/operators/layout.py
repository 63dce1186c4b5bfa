"""Lines, tables, pages and blocks: what stands where on a page."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold, fold_heading, let

TABLE_ROWS = 4
#: Gate of a page against its oracle.
LOW, HIGH, COVERAGE, BLANK = 0.75, 2.5, 0.85, 12
#: Tandem repeats.
PERIOD, TIMES, SPAN, MOST = 40, 3, 20, 2000


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no, line."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def table_regions(rows: DataFrame, key: str = "doc_id", least: int = TABLE_ROWS) -> DataFrame:
    """key, first_line, last_line, n_rows, title, page of runs of table lines
    (blank lines inside count) with at least so many rows that are no
    separators. Gaps and islands over lines; title: the last heading before."""
    w = Window.partitionBy(key).orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    table, blank = F.col("line").rlike(r"^\s*\|.*\|\s*$"), F.trim("line") == ""
    rule = F.col("line").rlike(r"^\s*\|[\s|:-]+\|\s*$")
    rows = rows.withColumns({"_table": table, "_blank": blank, "_row": table & ~rule, "_title": F.last(F.when(F.col("line").rlike(r"^#{1,4}\s"), F.regexp_replace("line", r"^#+\s*", "")), ignorenulls=True).over(upto)})
    rows = rows.withColumn("_page", F.sum(F.col("line").rlike(r"<!--\s*page").cast("int")).over(upto))
    rows = rows.withColumn("_island", F.sum((~F.col("_table") & ~F.col("_blank")).cast("int")).over(upto)).filter("_table")
    out = rows.groupBy(key, "_island").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.sum(F.col("_row").cast("int")).alias("n_rows"), F.min_by("_title", "line_no").alias("title"), F.min("_page").alias("page"))
    return out.filter(F.col("n_rows") >= least).drop("_island")


def mask_tables(rows: DataFrame, regions: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text: the lines with one placeholder for each region. Lines meet
    regions of their own document only, which are disjoint."""
    r = regions.select(F.col(key).alias("_k"), "first_line", "last_line")
    joined = rows.join(r, (F.col(key) == F.col("_k")) & F.col("line_no").between(F.col("first_line"), F.col("last_line")), "left")
    kept = joined.filter(F.col("first_line").isNull() | (F.col("line_no") == F.col("first_line"))).withColumn("line", F.when(F.col("first_line").isNotNull(), "[TABLE]").otherwise(F.col("line")))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


def stitch_tables(tables: DataFrame) -> DataFrame:
    """doc_id, table_no, n_parts, n_rows: a part continues the one before it on
    the page before if it is as wide and has its header, none, or nothing else."""
    w = Window.partitionBy("doc_id").orderBy("page", "part")
    before = lambda c: F.lag(c).over(w)
    goes_on = (F.col("width") == before("width")) & (F.col("page") - before("page") <= 1) & ((F.col("header") == before("header")) | (F.trim("header") == "") | (F.col("n_rows") == 0))
    rows = tables.withColumn("table_no", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "table_no").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("n_rows").alias("n_rows"))


def toc_rows(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """A TOC pipe table: number, title, page of its rows, under the last row
    with a single filled cell, their category."""
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    rows = rows.filter(F.col("line").rlike(r"^\s*\|.*\|\s*$") & ~F.col("line").rlike(r"^[\s|:-]+$")).withColumn("c", cells)
    filled = F.filter("c", lambda x: x != "")
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("category", F.last(F.when(F.size(filled) == 1, filled[0]), ignorenulls=True).over(w)).filter(F.size(filled) > 1)
    return rows.select(key, "line_no", F.get("c", F.lit(0)).alias("number"), F.get("c", F.lit(1)).alias("title"), F.get("c", F.lit(2)).try_cast("int").alias("page"), "category")


KEYWORD = r"^\s*(?:DECRET|H0?OTAR[AI]RE|HOTAR[AI]RE|[IL]EGE|ORD[IL]N|DEC[IL]Z[IL][EA]|PROC[IL]AMAT[IL]E|COMUN[IL]CAT|OUG|ORDONANTA)"
CUE = r"(?:\bNR\b|PR[IL]V[IL]ND|CU PR[IL]V[IL]RE|REFER[IL]TOR|PENTRU)"
DENY = r"^\s*(?:ROMAN[IL]A|MARE[IL]E STAT|ADUNAREA|MAREA ADUNARE)"
SECTION = r"^\s*(?:COMUN[IL]CATE|DECRETE|DEC[IL]Z[IL][IL]|HOTAR[AI]R[IL]|[IL]EG[IL]|ORD[IL]NE)\s*$"


def promote_headings(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """lines with a heading mark where a keyword starts a line after a blank or
    section line and a cue stands in it or the next; the text is the same else."""
    w = Window.partitionBy(key).orderBy("line_no")
    # 1, l and I are one letter in folded headings
    folded = fold_heading(F.col("line"))
    before, after = F.lag("line").over(w), F.lead("line").over(w)
    free = before.isNull() | (F.trim(before) == "") | fold_heading(before).rlike(SECTION)
    cue = folded.rlike(CUE) | F.coalesce(fold_heading(after).rlike(CUE), F.lit(False))
    heading = ~F.col("line").startswith("#") & folded.rlike(KEYWORD) & ~folded.rlike(DENY) & ~folded.rlike(SECTION) & free & cue
    return rows.withColumn("promoted", heading).withColumn("line", F.when(heading, F.concat(F.lit("## "), F.trim("line"))).otherwise(F.col("line")))


def page_layout(blocks: DataFrame) -> DataFrame:
    """doc_id, page_no, layout of blocks (x0, x1, y0, page_width): prose,
    two_column or table, by where the blocks' centres lie."""
    centre = (F.col("x0") + F.col("x1")) / 2
    half = F.col("page_width") / 2
    wide = (F.col("x1") - F.col("x0")) > 0.6 * F.col("page_width")
    g = blocks.groupBy("doc_id", "page_no").agg(F.count_if(~wide & (centre < half)).alias("l"), F.count_if(~wide & (centre >= half)).alias("r"), F.count_if(wide).alias("f"), F.count(F.lit(1)).alias("n"), F.count_distinct(F.round("x0", -1)).alias("xs"))
    layout = F.when((F.col("xs") >= 5) & (F.col("n") >= 12), "table").when((F.col("l") >= 3) & (F.col("r") >= 3) & (F.col("l") + F.col("r") > F.col("f")), "two_column").otherwise("prose")
    return g.select("doc_id", "page_no", layout.alias("layout"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """blocks with column (L, R, FULL) and order: bands between full-width
    blocks, in each the left column before the right, then the full block."""
    full = (F.col("x1") - F.col("x0")) > 0.6 * F.col("page_width")
    column = F.when(full, "FULL").when((F.col("x0") + F.col("x1")) / 2 < F.col("page_width") / 2, "L").otherwise("R")
    w = Window.partitionBy("doc_id", "page_no").orderBy("y0", "x0", "block_id")
    rows = blocks.withColumn("column", column)
    rows = rows.withColumn("_band", F.coalesce(F.sum((F.col("column") == "FULL").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    side = F.when(F.col("column") == "L", 0).when(F.col("column") == "R", 1).otherwise(2)
    order = Window.partitionBy("doc_id", "page_no").orderBy("_band", side, "y0", "x0", "block_id")
    return rows.withColumn("order", F.row_number().over(order)).drop("_band")


def chrome_role(y0: Column, y1: Column, height: Column, text: Column) -> Column:
    """header, footer, page_number or body, by bands of the page."""
    return F.when(text.rlike(r"^\s*\d{1,4}\s*$") & ((y1 < 0.1 * height) | (y0 > 0.9 * height)), "page_number").when(y1 < 0.06 * height, "header").when(y0 > 0.94 * height, "footer").otherwise("body")


def is_caps_name(c: Column) -> Column:
    w = F.split(F.trim(c), r"\s+")
    return (F.size(w) >= 2) & F.forall(w, lambda x: (x == F.upper(x)) & x.rlike(r"\p{L}"))


def is_centered(x0: Column, x1: Column, width: Column, tolerance: float = 30.0) -> Column:
    return F.abs((x0 + x1) / 2 - width / 2) <= tolerance


def page_words(words: DataFrame, bucket: float = 6.0) -> DataFrame:
    """doc_id, page_no, text: words in lines of one height bucket, by place."""
    line = words.withColumn("_y", F.bround(F.col("y") / bucket) * bucket)
    per = line.groupBy("doc_id", "page_no", "_y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word"))), lambda w: w["word"]), " ").alias("line"))
    return per.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_y", "line"))), lambda x: x["line"]), "\n").alias("text"))


def era(text: Column) -> Column:
    """scanned, broken_2007, broken_2002 or modern, by a text layer's marks."""
    count = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < 50, "scanned").when(count("∫˛ˇ√") >= 5, "broken_2007").when(count("ãþºªÞ") >= 5, "broken_2002").otherwise("modern")


def confident_words(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit("[a-z]{4,}"), F.lit(0))


def verify_pages(pairs: DataFrame) -> DataFrame:
    """pairs (page_index, candidate, oracle) with ratio, coverage, repetition,
    passed: as many words, most of the oracle's, no block over and over."""
    c, o = F.size(confident_words(F.col("candidate"))), F.size(confident_words(F.col("oracle")))
    held = let(fold(F.col("candidate")), lambda t: F.size(F.filter(confident_words(F.col("oracle")), lambda w: t.contains(w))))
    rows = pairs.withColumns({"ratio": F.when(o > 0, F.round(c / o, 6)).otherwise(F.lit(1.0)), "coverage": F.when(o > 0, F.round(held / o, 6)).otherwise(F.lit(1.0)), "repetition": repeated(F.col("candidate"))})
    return rows.withColumn("passed", (o < BLANK) | (F.col("ratio").between(LOW, HIGH) & (F.col("coverage") >= COVERAGE) & ~F.col("repetition")))


def tandem(text: str | None, least: int = PERIOD, times: int = TIMES, low: int = SPAN, high: int = MOST) -> bool:
    """Whether a stretch of low to high characters follows itself so often, the
    whole at least `least` characters long."""
    if not text:
        return False
    seen: dict[str, int] = {}
    t = " ".join(text.lower().split())
    at = 0
    while at + low <= len(t):
        key = t[at : at + low]
        start = seen.get(key)
        seen[key] = at
        if start is not None and low <= at - start <= high:
            period, end = at - start, at
            while end < len(t) and t[end] == t[end - period]:
                end += 1
            if end - start >= max(times * period, least):
                return True
        at += 1
    return False


@F.pandas_udf(T.BooleanType())
def repeated(texts: pd.Series) -> pd.Series:
    return texts.map(tandem)


def route(text_layer: DataFrame, markdown: DataFrame, most_missing: int = 6, bloat: float = 1.5) -> DataFrame:
    """doc_id, missing, escalate: closing numbers (doc_id, number, chars) of the
    text layer that the Markdown lacks; many, and it is done again."""
    missing = text_layer.join(markdown.select("doc_id", "number"), ["doc_id", "number"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("missing"))
    size = lambda df, n: df.groupBy("doc_id").agg(F.max("chars").alias(n))
    rows = size(text_layer, "a").join(size(markdown, "b"), "doc_id", "left").join(missing, "doc_id", "left").fillna(0, ["missing", "b"])
    return rows.select("doc_id", "missing", ((F.col("missing") >= most_missing) & (F.col("b") <= bloat * F.col("a"))).alias("escalate"))
