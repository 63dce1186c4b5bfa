"""From a document's pages or Markdown to its acts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, let, markdown_plain

#: Short artefact, publisher's footer, lead block, orphan tokens, ratios.
ARTEFACT, FOOTER, LEAD, ORPHAN, ORPHAN_SCANNED, LOW, HIGH, SHORT = 150, 1000, 300, 50, 20, 0.3, 2.0, 50
CLOSING = r"(?i)(bucure[sș]ti,\s+\d{1,2}\s+\w+\s+\d{4}\.\s*\n+\s*nr\.\s*[\d.]+\.)"
BODY_SIGNAL = r"(?m)^\s*art\.|\bart\. \d|in temeiul|avand in vedere|hotarare|ordin|decide|decret"


def split_headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, block_no, block: a text cut before every second-level heading; what
    precedes the first is kept if it is long and reads like a body."""
    parts = docs.select(key, F.posexplode(F.split(text, r"(?m)^(?=## )")).alias("block_no", "block"))
    lead = ~F.col("block").startswith("## ")
    return parts.filter(~lead | ((F.length("block") >= LEAD) & fold(F.col("block")).rlike(BODY_SIGNAL)))


def split_closings(blocks: DataFrame, key: str = "doc_id", text: str = "block") -> DataFrame:
    """blocks cut after every closing (place, date, number) but the last."""
    marked = F.split(F.regexp_replace(text, CLOSING, "$1\u0001"), "\u0001")
    parts = blocks.withColumn("_p", F.filter(marked, lambda x: F.trim(x) != ""))
    return parts.select(*[c for c in blocks.columns if c != text], F.posexplode("_p").alias("part_no", text))


#: Headers that start an act, a letter-spaced title, types and
#: numbered items that do where there are none; the delimiter of one era.
INSTITUTIONS = ("PARLAMENTUL ROMÂNIEI", "CURTEA CONSTITUȚIONALĂ", "GUVERNUL ROMÂNIEI", "PREȘEDINTELE ROMÂNIEI", "MINISTERUL", "BANCA NAȚIONALĂ")
SPACED = r"(?m)^(?:[A-ZĂÂÎȘȚ]\s+){3,}"
TYPED = r"(?m)^(?:Comunicat|COMUNICAT|Decret-lege|DECRET-LEGE)\b"
ITEMS = r"(?:(?<=\A)|(?<=\n\n))(?=\d{1,2}\.\s+[A-ZĂÂÎȘȚ])"
DELIMITER = "«"
#: Least acts, growth and multiple of what is expected that count
#: as cut too often.
LEAST_ACTS, GROWTH, BEYOND = 3, 2, 3


def split_patterns(c: Column) -> Column:
    """A text's pieces that start at an institution's name or a letter-spaced
    title; without any at a type, without those at numbered items; the whole if
    there is none of these."""
    names = "|".join(x.replace(" ", r"\s") for x in INSTITUTIONS)
    cut = F.when(c.rlike(rf"(?iu){names}") | c.rlike(SPACED), F.regexp_replace(F.regexp_replace(c, rf"(?iu)({names})", "\u0001$1"), SPACED.replace("(?:", "(\u0001?(?:", 1) + ")", "\u0001$1"))
    cut = cut.when(c.rlike(TYPED), F.regexp_replace(c, f"({TYPED})", "\u0001$1")).otherwise(F.regexp_replace(c, ITEMS, "\u0001"))
    return F.filter(F.transform(F.split(cut, "\u0001+"), lambda x: F.trim(x)), lambda x: x != "")


def closing_parts(c: Column) -> Column:
    """A text's parts, each up to a closing; the rest after the last one."""
    marked = F.regexp_replace(c, r"(?i)(bucure[sș]ti,\s+\d{1,2}\s+\w+\s+\d{4}\.[\s\S]{0,120}?nr\.\s*[\d.]+\.)", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda x: F.trim(x)), lambda x: x != "")


def split_guarded(acts: Column, expected: Column) -> Column:
    """An array of acts cut at closings; as it was if three or more became twice
    as many, and more than expected (0: not known)."""
    def judged(own: Column, parts: Column) -> Column:
        spurious = (F.size(own) >= LEAST_ACTS) & (F.size(parts) >= GROWTH * F.size(own)) & ((expected == 0) | (F.size(parts) > expected))
        return F.when(spurious, own).otherwise(parts)

    return let(acts, lambda own: let(F.flatten(F.transform(own, closing_parts)), lambda parts: judged(own, parts)))


def segment_pages(pages: DataFrame, toc: DataFrame | None = None) -> DataFrame:
    """doc_id, act_index, text of documents given as pages (doc_id, page_no,
    text, era, expected: acts that the table of contents leads one to expect, 0
    if none). By the contents' pages where they can be trusted, else by pages
    that start with an authority, by the delimiter of the era that has one, or
    by patterns; then cut at closings. A document that patterns cut into more
    than three times what is expected is one act; short fragments of patterns
    join the act before."""
    doc = pages.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n").alias("full"),
        F.first("era").alias("era"), F.max(F.coalesce("expected", F.lit(0))).alias("expected"), F.max("page_no").alias("last"),
    )
    listed = lambda df, order: df.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]).alias("acts"))
    headed = listed(split_page_headers(pages.select("doc_id", "page_no", "text")), "act_no").withColumnRenamed("acts", "headed")
    rows = doc.join(headed, "doc_id", "left")
    if toc is not None:
        n_pages = doc.select("doc_id", (F.col("last") + 1).alias("n_pages"))
        rows = rows.join(degenerate_toc(toc.join(n_pages, "doc_id")), "doc_id", "left")
        rows = rows.join(listed(slice_pages(pages.select("doc_id", "page_no", "text"), toc), "toc_idx").withColumnRenamed("acts", "sliced"), "doc_id", "left")
    else:
        rows = rows.withColumns({"degenerate": F.lit(None).cast("boolean"), "sliced": F.lit(None).cast("array<string>")})
    split = lambda c: split_guarded(c, F.col("expected"))
    patterns = split(split_patterns(F.col("full")))
    patterns = let(patterns, lambda p: F.when((F.col("expected") >= 2) & (F.size(p) > BEYOND * F.col("expected")), F.array("full")).otherwise(p))
    delimited = F.filter(F.transform(F.split("full", DELIMITER), lambda x: F.trim(x)), lambda x: x != "")
    several = F.size("headed") > 1
    chosen = (
        F.when(F.col("degenerate") == F.lit(False), "contents").when(F.col("degenerate") & (F.size("headed") > 0), "headers")
        .when((F.col("era") == "broken_2002") & F.col("full").contains(DELIMITER), "delimiter").when(several, "headers").otherwise("patterns")
    )
    how = F.col("strategy")
    acts = F.when(how == "contents", split(F.col("sliced"))).when(how == "headers", split(F.col("headed"))).when(how == "delimiter", split(delimited)).otherwise(patterns)
    return joined_fragments(rows.withColumn("strategy", chosen).select("doc_id", "strategy", F.posexplode(acts).alias("act_index", "text")))


def joined_fragments(acts: DataFrame, least: int = SHORT) -> DataFrame:
    """acts (doc_id, strategy, act_index, text): those of patterns shorter than
    least join the one before. Over rows, as an array that grows is copied for
    each act."""
    w = Window.partitionBy("doc_id").orderBy("act_index")
    starts = (F.col("strategy") != "patterns") | (F.col("act_index") == 0) | (F.length(F.trim("text")) >= least)
    rows = acts.withColumn("_g", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int") - 1)
    parts = F.array_sort(F.collect_list(F.struct("act_index", "text")))
    # a piece that others join loses the spaces at its end
    text = F.transform(parts, lambda p, i: F.when(i + 1 < F.size(parts), F.rtrim(p["text"])).otherwise(p["text"]))
    return rows.groupBy("doc_id", "strategy", "_g").agg(F.array_join(text, "\n").alias("text")).select("doc_id", "strategy", F.col("_g").alias("act_index"), "text")


def is_artefact(c: Column) -> Column:
    """Short without a body's signs, a footnote, or the publisher's footer."""
    folded = fold(c)
    signal = folded.rlike(BODY_SIGNAL)
    footer = folded.rlike(r"iban|www\.|tiparul|editor|regia autonoma") & (F.length(c) < FOOTER)
    return ((F.length(F.trim(c)) < ARTEFACT) & ~signal) | c.rlike(r"^\s*(?:\*\)|\d{1,2}\))\s") | (footer & ~folded.rlike(r"(?m)^\s*art\."))


#: Words (folded) that open an act, of which one is in its first
#: characters; the least text of an act without one.
OPENERS = r"decret(?:-lege)?|hotarare|ordin(?:ul)?|lege\b|oug\b|comunicat|decizie|raport|anunt|rectificare|ministerul\b|curtea\b|guvernul\b|parlamentul\b|agentia\b|banca\b|presedintele\b|consiliul\b|autoritatea\b|art\.\s*\d"
OPENER_HEAD, GHOST = 200, 80


def is_fragment(c: Column) -> Column:
    """Whether a text starts like none of the acts: a stretch of another one."""
    return ~fold(F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, OPENER_HEAD)).rlike(OPENERS)


def merge_act_fragments(acts: DataFrame) -> DataFrame:
    """issue_id, act_index, full_text: texts that open no act join the one
    before, the first of an issue stays, empty ones go."""
    rows = acts.select("issue_id", "act_index", F.trim(F.coalesce("full_text", F.lit(""))).alias("t"))
    w = Window.partitionBy("issue_id").orderBy("act_index")
    rows = rows.withColumn("_first", F.row_number().over(w) == 1).filter(F.col("_first") | (F.col("t") != ""))
    rows = rows.withColumn("_g", F.sum((F.col("_first") | ~is_fragment(F.col("t"))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("act_index", "t")))
    return rows.groupBy("issue_id", "_g").agg(F.min("act_index").alias("act_index"), F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("full_text")).drop("_g")


def suppress_ghosts(acts: DataFrame) -> DataFrame:
    """acts without those that are short and open nothing."""
    return acts.filter(~((F.length(F.trim(F.coalesce("full_text", F.lit("")))) < GHOST) & is_fragment(F.col("full_text"))))


def page_hints(c: Column) -> Column:
    """Distinct lone page numbers, in order."""
    found = F.regexp_extract_all(c, F.lit(r"(?m)^\s*(\d{1,3})\s*$"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def merge_fragments(rows: DataFrame, key: str, order: str, text: str, least: int = SHORT) -> DataFrame:
    """key, block_no, text, n_parts: rows shorter than least join the one before."""
    w = Window.partitionBy(key).orderBy(order)
    start = (F.length(text) >= least) | (F.row_number().over(w) == 1)
    rows = rows.withColumn("_s", start).withColumn("block_no", F.sum(F.col("_s").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(key, "block_no").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias(text), F.count(F.lit(1)).alias("n_parts"))


def split_delimiter(docs: DataFrame, delimiter: str = r"\n\n", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, position, part: parts that aren't blank, with their own positions."""
    return docs.select(key, F.posexplode(F.split(text, delimiter)).alias("position", "part")).filter(F.trim("part") != "")


def degenerate_toc(toc: DataFrame) -> DataFrame:
    """doc_id, degenerate: pages that go back, are all one, or beyond the document."""
    w = Window.partitionBy("doc_id").orderBy("toc_idx")
    rows = toc.withColumn("_back", (F.col("page_start") < F.lag("page_start").over(w)).cast("int"))
    g = rows.groupBy("doc_id").agg(F.max(F.coalesce("_back", F.lit(0))).alias("back"), F.count_distinct("page_start").alias("d"), F.count(F.lit(1)).alias("n"), F.max("page_start").alias("m"), F.max("n_pages").alias("p"))
    return g.select("doc_id", ((F.col("back") == 1) | ((F.col("n") > 1) & (F.col("d") == 1)) | (F.col("m") > F.col("p"))).alias("degenerate"))


def slice_pages(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """doc_id, toc_idx, first_page, last_page, text: a line's pages go up to the
    next line's; lines of one page are one. Pages and lines go through one
    window, so the range join needs no pairs."""
    starts = toc.groupBy("doc_id", "page_start").agg(F.min("toc_idx").alias("toc_idx")).select("doc_id", F.col("page_start").alias("page_no"), "toc_idx")
    rows = pages.join(starts, ["doc_id", "page_no"], "left")
    w = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("toc_idx", F.last("toc_idx", ignorenulls=True).over(w)).filter("toc_idx is not null")
    parts = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return rows.groupBy("doc_id", "toc_idx").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def split_page_headers(pages: DataFrame, pattern: str = r"(?i)^\s*(?:guvernul|parlamentul|pre[sș]edintele|ministerul|curtea)") -> DataFrame:
    """doc_id, act_no, first_page, text: a page that starts with an authority
    starts an act, page 0 never does by itself."""
    w = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("text").rlike(pattern) & (F.col("page_no") > 0)
    rows = pages.withColumn("act_no", F.sum(start.cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return rows.groupBy("doc_id", "act_no").agg(F.min("page_no").alias("first_page"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def segment_markdown(docs: DataFrame, expected: DataFrame | None = None, era: str = "modern") -> DataFrame:
    """doc_id, act_index, markdown, plain_text, title_hint, page_hints: headings,
    then closings; artefacts go, orphans join the block before; where the number
    is far off what is expected (doc_id, n), the whole is one block."""
    blocks = split_closings(split_headings(docs)).filter(~is_artefact(F.col("block")))
    order = Window.partitionBy("doc_id").orderBy("block_no", "part_no")
    blocks = blocks.withColumn("_o", F.row_number().over(order))
    least = ORPHAN_SCANNED if era == "scanned" else ORPHAN
    start = (F.size(F.split(F.trim("block"), r"\s+")) >= least) | F.col("block").startswith("## ") | (F.col("_o") == 1)
    upto = Window.partitionBy("doc_id").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("act_index", F.sum(start.cast("int")).over(upto) - 1)
    parts = F.array_sort(F.collect_list(F.struct("_o", "block")))
    out = blocks.groupBy("doc_id", "act_index").agg(F.array_join(F.transform(parts, lambda p: p["block"]), "\n").alias("markdown"))
    if expected is not None:
        n = out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("got")).join(expected, "doc_id")
        bad = n.filter((F.col("got") < LOW * F.col("n")) | (F.col("got") > HIGH * F.col("n"))).select("doc_id")
        whole = docs.join(bad, "doc_id", "left_semi").select("doc_id", F.lit(0).cast("long").alias("act_index"), F.col("text").alias("markdown"))
        out = out.join(bad, "doc_id", "left_anti").unionByName(whole)
    hint = F.trim(F.regexp_replace(F.split_part(F.col("markdown"), F.lit("\n"), F.lit(1)), r"^#+\s*", ""))
    return out.select("doc_id", "act_index", "markdown", markdown_plain(F.col("markdown")).alias("plain_text"), hint.alias("title_hint"), page_hints(F.col("markdown")).alias("page_hints"))
