"""Checks of extracted acts, and the merge of two extractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import PLACEHOLDERS, fold_act_number, malformed_reason
from ..functions.text import fold

UNNUMBERED = ("COMUNICAT", "RECTIFICARE", "ANUNT", "ANUNȚ")
#: Shortest act, ratios of acts to lines, acts that need lines.
LEAST_TEXT, LOW_RATIO, HIGH_RATIO, MANY_ACTS = 80, 0.5, 2.5, 3
FIXABLE = ("ACT_NUMBER_ZERO", "ACT_NUMBER_EMPTY", "ACT_NUMBER_IN_ABROGATION", "DOC_TYPE_UNKNOWN", "LLM_FAILED")
#: Fixed values of the merge: short text and how much longer its stand-in is, title.
SHORT_TEXT, LONGER, LONG_TITLE = 120, 2, 220


def repeal_numbers(text: Column) -> Column:
    """Numbers in 'abroga' clauses, narrower than the extractor's."""
    found = F.regexp_extract_all(fold(text), F.lit(r"abroga[^\n]{0,80}?nr\. *([\d.]*\d)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda n: F.regexp_replace(n, r"\.", "")))


def act_issues(acts: DataFrame) -> DataFrame:
    """issue_id, act_index, check, severity: one row per finding; of the number
    checks one at most."""
    n, text = F.trim(F.coalesce("act_number", F.lit(""))), F.coalesce("full_text", F.lit(""))
    free = F.col("doc_type").isin(*UNNUMBERED)
    soft = F.when(free, "INFO").otherwise("ERROR")
    warn = lambda p: F.exists(F.coalesce("extraction_warnings", F.array().cast("array<string>")), lambda w: w.contains(p)) if "extraction_warnings" in acts.columns else F.lit(False)
    finding = lambda name, severity: F.struct(F.lit(name).alias("check"), severity.alias("severity"))
    of_number = (
        F.when(n == "0", finding("ACT_NUMBER_ZERO", soft)).when(n == "", finding("ACT_NUMBER_EMPTY", soft))
        .when(F.lower(n).isin(*PLACEHOLDERS), finding("ACT_NUMBER_PLACEHOLDER", F.lit("ERROR")))
        .when(F.array_contains(repeal_numbers(text), F.split_part(fold_act_number(n), F.lit("/"), F.lit(1))), finding("ACT_NUMBER_IN_ABROGATION", F.lit("ERROR")))
    )
    checks = F.array(
        of_number,
        F.when(malformed_reason(n) != "", finding("ACT_NUMBER_MALFORMED", F.lit("WARNING"))),
        F.when(F.coalesce("doc_type", F.lit("UNKNOWN")) == "UNKNOWN", finding("DOC_TYPE_UNKNOWN", F.lit("ERROR"))),
        F.when(F.coalesce("issuing_authority", F.lit("")) == "", finding("AUTHORITY_MISSING", F.lit("WARNING"))),
        F.when(F.coalesce("title", F.lit("")) == "", finding("TITLE_MISSING", F.lit("WARNING"))),
        F.when(F.length(F.trim(text)) < LEAST_TEXT, finding("TEXT_SHORT", F.lit("WARNING"))),
        F.when(warn("_via:llm_failed"), finding("LLM_FAILED", F.lit("WARNING"))),
        F.when(warn("hallucination"), finding("HALLUCINATION", F.lit("WARNING"))),
    )
    return acts.select("issue_id", "act_index", F.explode(F.array_compact(checks)).alias("x")).select("issue_id", "act_index", "x.check", "x.severity")


def issue_issues(acts: DataFrame, toc: DataFrame) -> DataFrame:
    """issue_id, check, severity of whole issues: no TOC for three acts, or
    far fewer or more acts than lines."""
    a = acts.groupBy("issue_id").agg(F.count(F.lit(1)).alias("a"))
    t = toc.groupBy("issue_id").agg(F.count(F.lit(1)).alias("t"))
    both = a.join(t, "issue_id", "left").fillna(0, ["t"])
    ratio = F.col("a") / F.col("t")
    check = F.when((F.col("t") == 0) & (F.col("a") >= MANY_ACTS), "SUMAR_ZERO").when((F.col("t") > 0) & ((ratio < LOW_RATIO) | (ratio > HIGH_RATIO)), "ACT_COUNT_MISMATCH")
    return both.select("issue_id", check.alias("check"), F.lit("WARNING").alias("severity")).filter("check is not null")


def needs_reextraction(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_id").agg(F.bool_or((F.col("severity") == "ERROR") & F.col("check").isin(*FIXABLE)).alias("needed"), F.array_sort(F.collect_set("check")).alias("checks"))


def report(issues: DataFrame) -> DataFrame:
    """check, severity, n with subtotals by severity and in all."""
    return issues.rollup("severity", "check").agg(F.count(F.lit(1)).alias("n"))


def at_least(issues: DataFrame, severity: str) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for kv in (("INFO", 0), ("WARNING", 1), ("ERROR", 2)) for x in kv])
    return issues.filter(rank[F.col("severity")] >= {"INFO": 0, "WARNING": 1, "ERROR": 2}[severity])


def structural_issues(acts: DataFrame, toc: DataFrame) -> DataFrame:
    """The second validator: no text, no articles where the type has them, and
    a TOC more than two lines off."""
    article = F.col("doc_type").isin("LEGE", "HG", "OUG", "ORDONANȚĂ") & ~F.coalesce("full_text", F.lit("")).rlike(r"(?im)^\s*(?:art\.|articolul)")
    a = acts.select("issue_id", "act_index", F.explode(F.array_compact(F.array(F.when(F.coalesce("full_text", F.lit("")) == "", "no text"), F.when(article, "no articles")))).alias("message"))
    counts = acts.groupBy("issue_id").agg(F.count(F.lit(1)).alias("a")).join(toc.groupBy("issue_id").agg(F.count(F.lit(1)).alias("t")), "issue_id", "left").fillna(0, ["t"])
    off = counts.filter(F.abs(F.col("a") - F.col("t")) > 2).select("issue_id", F.lit(-1).cast(acts.schema["act_index"].dataType).alias("act_index"), F.lit("act count").alias("message"))
    return a.union(off)


def annotate(acts: DataFrame, issues: DataFrame) -> DataFrame:
    """acts with validation messages of errors in extraction_warnings."""
    m = issues.filter("severity = 'ERROR'").groupBy("issue_id", "act_index").agg(F.array_sort(F.collect_set(F.concat(F.lit("[VALIDATE:"), F.col("check"), F.lit("]")))).alias("_m"))
    own = F.coalesce("extraction_warnings", F.array().cast("array<string>")) if "extraction_warnings" in acts.columns else F.array().cast("array<string>")
    return acts.join(m, ["issue_id", "act_index"], "left").withColumn("extraction_warnings", F.array_union(own, F.coalesce("_m", F.array().cast("array<string>")))).drop("_m")


def flagged(acts: DataFrame) -> DataFrame:
    return acts.filter(F.exists("extraction_warnings", lambda w: w.startswith("[VALIDATE:")))


def is_bad_number(c: Column) -> Column:
    """0 to 3 or a year 2000 to 2029, without leading zeros."""
    n = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "^0+", "")
    return n.isin("", "1", "2", "3") | n.rlike(r"^20[0-2]\d$")


def is_bad_title(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return (t == "") | t.rlike(r"\.{3,}") | (F.length(t) > LONG_TITLE) | fold(t).rlike(r"^(?:in temeiul|avand in vedere|art\.)")


def merge(primary: DataFrame, fallback: DataFrame, toc: DataFrame | None = None) -> DataFrame:
    """Acts of two extractions, by position: each field from the fallback where
    the primary's is bad and its own is good; further acts of the fallback if no
    act has their number. toc (issue_id, toc_number) must confirm new numbers."""
    fields = ["doc_type", "act_number", "act_year", "issuing_authority", "title", "full_text"]
    p = primary.select("issue_id", "act_index", F.lit(True).alias("has_p"), *(F.col(c).alias(f"p_{c}") for c in fields))
    f = fallback.select("issue_id", "act_index", F.lit(True).alias("has_f"), *(F.col(c).alias(f"f_{c}") for c in fields))
    both = p.join(f, ["issue_id", "act_index"], "full_outer")
    digits = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    known = primary.select("issue_id", digits(F.col("act_number")).alias("_k")).distinct()
    extra = both.filter("has_p is null").withColumn("_k", digits(F.col("f_act_number"))).join(known, ["issue_id", "_k"], "left_anti").drop("_k")
    both = both.filter("has_p").unionByName(extra)
    if toc is None:
        both = both.withColumn("_confirmed", F.lit(True))
    else:
        lines = toc.select("issue_id", fold_act_number(F.col("toc_number")).alias("_n")).distinct().withColumn("_in", F.lit(True))
        some = toc.select("issue_id").distinct().withColumn("_some", F.lit(True))
        both = both.withColumn("_n", fold_act_number(F.col("f_act_number"))).join(lines, ["issue_id", "_n"], "left").join(some, "issue_id", "left").withColumn("_confirmed", F.col("_some").isNull() | F.coalesce("_in", F.lit(False)))
    there, added = F.col("has_f").isNotNull(), F.col("has_p").isNull()
    number = there & is_bad_number(F.col("p_act_number")) & ~is_bad_number(F.col("f_act_number")) & F.col("_confirmed")
    take = {
        "doc_type": there & (F.coalesce("p_doc_type", F.lit("UNKNOWN")) == "UNKNOWN"), "act_number": number, "act_year": number,
        "issuing_authority": there & (F.coalesce("p_issuing_authority", F.lit("")) == ""), "title": there & is_bad_title(F.col("p_title")) & ~is_bad_title(F.col("f_title")),
        "full_text": there & (F.length("p_full_text") < SHORT_TEXT) & (F.length("f_full_text") > LONGER * F.length("p_full_text")),
    }
    return both.select("issue_id", "act_index", *(F.when(added | F.coalesce(take[c], F.lit(False)), F.col(f"f_{c}")).otherwise(F.col(f"p_{c}")).alias(c) for c in fields), (number | added).alias("merged"))


def resolve_missing(warnings: DataFrame, fallback: DataFrame) -> DataFrame:
    """issue_id, number, act_index: the longest act of the fallback that has the
    number a 'missing' warning names."""
    n = fold_act_number(F.regexp_extract("warning", r"(?i)missing[^\n]*nr\.?\s*([\d./]*\d)", 1))
    wanted = warnings.select("issue_id", n.alias("number")).filter("number <> ''").distinct()
    have = fallback.select("issue_id", "act_index", fold_act_number(F.col("act_number")).alias("number"), F.length("full_text").alias("len"))
    return wanted.join(have, ["issue_id", "number"]).groupBy("issue_id", "number").agg(F.max_by("act_index", F.struct("len", -F.col("act_index"))).alias("act_index"))


def directory_issues(issues: DataFrame, found: DataFrame) -> DataFrame:
    """found (findings of acts) and a PARSE_ERROR for each issue file that can't
    be read (_corrupt_record), in order of severity's name, issue and act."""
    broken = issues.filter("_corrupt_record is not null").select(F.col("gazette_id").alias("issue_id"), F.lit(None).cast("int").alias("act_index"), F.lit("PARSE_ERROR").alias("check"), F.lit("ERROR").alias("severity"))
    return found.select("issue_id", "act_index", "check", "severity").unionByName(broken).orderBy("severity", "issue_id", F.coalesce("act_index", F.lit(-1)))


def reextract(acts: DataFrame, fallback: DataFrame, toc: DataFrame | None = None) -> DataFrame:
    """acts after another extraction of the issues that need one: merged field
    by field; numbers that a 'missing' warning names come from the fallback's
    longest act. Issues without an error stay as they are."""
    found = act_issues(acts)
    need = needs_reextraction(found).filter("needed").select("issue_id")
    fields = ["issue_id", "act_index", "doc_type", "act_number", "act_year", "issuing_authority", "title", "full_text"]
    some = acts.join(need, "issue_id", "left_semi")
    done = merge(some.select(*fields), fallback.join(need, "issue_id", "left_semi").select(*fields), toc).select(*fields, "merged")
    return acts.join(need, "issue_id", "left_anti").select(*fields, F.lit(False).alias("merged")).unionByName(done)
