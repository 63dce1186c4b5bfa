"""Acts, titles, roles and tables that the first pass missed, and the steps that
models do as plug-ins: repairs, summaries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import MONTHS, number_key
from ..functions.text import fold, fold_ws, let
from .extraction import CLOSING
from .linkage import is_generic_title, sanitize_title

#: Shortest and longest span between two closings.
SHORTEST, LONGEST = 120, 25_000
#: Shortest text, longest and shortest summary.
SUMMARY_TEXT, SUMMARY, SUMMARY_WORDS = 200, 500, 4


def recover_acts(layer: DataFrame, acts: DataFrame, markdown: DataFrame, key: str = "issue_id") -> DataFrame:
    """key, number, span: acts that the text layer (key, text) closes with a
    number that no act (key, act_number) has, if the span's end isn't in the
    Markdown (key, markdown) already. A span is what stands between a closing
    and the one before. As it ends with its number, its end can stand only
    where the Markdown has that number: these places are listed and joined."""
    spans = layer.select(key, F.posexplode(F.split(F.regexp_replace(fold(F.col("text")), f"({CLOSING})", "$1\u0001"), "\u0001")).alias("pos", "span"))
    spans = spans.withColumn("number", F.regexp_replace(F.regexp_extract("span", CLOSING, 2), r"\.", ""))
    spans = spans.filter((F.col("number") != "") & F.length("span").between(SHORTEST, LONGEST))
    have = acts.select(key, number_key(F.col("act_number")).alias("number")).distinct()
    lost = spans.join(have, [key, "number"], "left_anti")
    tail = fold_ws(F.col("span"))
    lost = lost.withColumn("_tail", F.substring(tail, F.greatest(F.length(tail) - 119, F.lit(1)), F.lit(120)))
    lost = lost.withColumn("_last", F.regexp_extract("_tail", r"nr\.([\d.]*\d)\.$", 1))
    there = numbered_ends(markdown.select(key, fold_ws(F.col("markdown")).alias("_md")), key)
    whole = F.length("_tail") == 120
    full = lost.filter(whole).join(there.select(key, F.col("_end").alias("_tail")).distinct(), [key, "_tail"], "left_anti")
    brief = lost.filter(~whole).select(key, "_last", "_tail").distinct().join(there, [key, "_last"]).filter(F.endswith("_end", F.col("_tail"))).select(key, "_tail").distinct()
    rest = full.unionByName(lost.filter(~whole).join(brief, [key, "_tail"], "left_anti"), allowMissingColumns=True)
    return rest.select(key, "number", F.trim("span").alias("span"))


def numbered_ends(texts: DataFrame, key: str, most: int = 120) -> DataFrame:
    """key, _last, _end: every 'nr.n.' of dense texts (key, _md): n and the
    characters up to it, most at most."""
    import re

    def run(batches):
        for pdf in batches:
            for k, text in zip(pdf[key], pdf["_md"]):
                out = []
                for m in re.finditer(r"nr\.(?=[0-9.]*[0-9]\.)([0-9.]+)", text or ""):
                    for end in re.finditer(r"(?<=[0-9])\.", m[1]):
                        at = m.start(1) + end.end()
                        out.append((k, m[1][: end.start()], text[max(at - most, 0) : at]))
                for i in range(0, len(out), 10_000):
                    yield pd.DataFrame(out[i : i + 10_000], columns=[key, "_last", "_end"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.mapInPandas(run, f"{key} {kind}, _last string, _end string")


def scanned_toc(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, number, doc_type of what a scanned first page lists: distinct
    numbers with their type, and communiques without one."""
    pattern = r"\b(decret-lege|decret|lege|hotarare|ordin|decizie)\s+nr\.?\s*([\d.]*\d)"
    found = lambda i: F.regexp_extract_all(fold(F.col(text)), F.lit(pattern), F.lit(i))
    rows = docs.select(key, F.explode(F.arrays_zip(found(2).alias("n"), found(1).alias("t"))).alias("x")).select(key, F.regexp_replace("x.n", r"\.", "").alias("number"), F.upper("x.t").alias("doc_type"))
    notices = docs.select(key, F.explode(F.regexp_extract_all(fold(F.col(text)), F.lit(r"(?m)^\s*(comunicat)\b"), F.lit(1))).alias("t")).select(key, F.lit("").alias("number"), F.upper("t").alias("doc_type"))
    return rows.union(notices).dropDuplicates([key, "number", "doc_type"])


def title_from_body(title: Column, text: Column) -> Column:
    """A generic title gives way to the first of the body's six first lines
    that says what the act is about."""
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 6)
    about = F.get(F.filter(lines, lambda x: fold(x).rlike(r"^(?:privind|pentru|referitor|cu privire)\b")), 0)
    return F.when(is_generic_title(title) & about.isNotNull(), sanitize_title(about)).otherwise(title)


def monthly_table(c: Column) -> Column:
    """A table of twelve months, names first and values after them, as lines
    'month = value'; missing values are 0."""
    names = F.array(*map(F.lit, MONTHS))

    def of(numbers: Column) -> Column:
        padded = F.slice(F.concat(numbers, F.array_repeat(F.lit("0"), 12)), 1, 12)
        return F.array_join(F.zip_with(names, padded, lambda m, v: F.concat(m, F.lit(" = "), v)), "\n")

    whole = F.forall(names, lambda m: fold(c).contains(m))
    return F.when(whole, let(F.regexp_extract_all(F.regexp_replace(c, r"(?is)^.*decembrie", ""), F.lit(r"\d[\d.,]*"), F.lit(0)), of)).otherwise(c)


#: Roles of blocks by pattern on folded text, in order.
ROLES = (
    ("masthead", r"^monitorul oficial"), ("toc_heading", r"^sumar\b"), ("article", r"^art\.?\s*\d|^articolul\s+\d"), ("annex", r"^anexa\b"),
    ("paragraph", r"^\(\d+\)"), ("letter", r"^[a-z]\)"), ("point", r"^\d+\.\s"), ("closing_date", r"^bucuresti,\s*\d"), ("closing_number", r"^nr\.\s*[\d.]+\.?$"),
    ("act_type", r"^(?:lege|ordin|hotarare|decret|decizie|ordonanta)\b"), ("title", r"^(?:privind|pentru|referitor)\b"), ("preamble", r"^(?:in temeiul|avand in vedere|in baza)"),
)


def classify_blocks(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, page_no, order, text) with role: by pattern; a line of
    capitals after a closing is a signature, one that nothing fits continues
    the role before it."""
    folded = F.trim(fold(F.col("text")))
    role = F.lit(None).cast("string")
    for name, pattern in reversed(ROLES):
        role = F.when(folded.rlike(pattern), name).otherwise(role)
    w = Window.partitionBy("doc_id").orderBy("page_no", "order")
    before = F.last(F.col("_role"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    capitals = F.col("text").rlike(r"^[\p{Lu}\s.-]{5,}$")
    rows = blocks.withColumn("_role", role)
    carried = F.when(F.col("_role").isNotNull(), F.col("_role")).when(capitals & before.startswith("closing"), "signature")
    return rows.withColumn("role", F.coalesce(carried, F.when(before.isin("title", "preamble", "article", "paragraph", "letter", "point"), before), F.lit("body"))).drop("_role")


def acts_of_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, act_no, text: an act starts at an act type that follows a
    closing, a signature or nothing; what precedes the first is left out."""
    w = Window.partitionBy("doc_id").orderBy("page_no", "order")
    closed = F.lag("role").over(w).isin("closing_number", "signature", "masthead", "toc_heading")
    start = (F.col("role") == "act_type") & F.coalesce(closed, F.lit(True))
    rows = blocks.withColumn("act_no", F.sum(start.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("act_no > 0")
    parts = F.array_sort(F.collect_list(F.struct("page_no", "order", "text")))
    return rows.groupBy("doc_id", "act_no").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def unmapped(blocks: DataFrame, claimed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (doc_id, block_id, text) that no act claims, and per document the
    share of characters that are claimed and whether that is lossless."""
    rest = blocks.join(claimed, ["doc_id", "block_id"], "left_anti")
    size = lambda df, n: df.groupBy("doc_id").agg(F.sum(F.length("text")).alias(n))
    share = size(blocks, "total").join(size(rest, "rest"), "doc_id", "left").select("doc_id", F.round(1 - F.coalesce("rest", F.lit(0)) / F.greatest("total", F.lit(1)), 6).alias("share"))
    return rest, share.withColumn("lossless", F.col("share") >= 0.999)


def repair(acts: DataFrame, issues: DataFrame, patch: Callable[[str, list[str]], dict[str, str]]) -> DataFrame:
    """acts with the fields that findings flag replaced by what the plug-in
    says for (text, fields); other fields and unlikely years stay."""
    fields = F.create_map(*[F.lit(x) for kv in (("ACT_NUMBER_ZERO", "act_number"), ("ACT_NUMBER_EMPTY", "act_number"), ("ACT_NUMBER_IN_ABROGATION", "act_number"), ("DOC_TYPE_UNKNOWN", "doc_type"), ("TITLE_MISSING", "title"), ("AUTHORITY_MISSING", "issuing_authority")) for x in kv])
    wanted = issues.groupBy("issue_id", "act_index").agg(F.array_compact(F.collect_set(fields[F.col("check")])).alias("_fields"))
    rows = acts.join(wanted, ["issue_id", "act_index"], "left")

    def run(texts: pd.Series, asked: pd.Series) -> pd.Series:
        return pd.Series([dict(patch(t, list(f))) if f is not None and len(f) else {} for t, f in zip(texts, asked)])

    said = rows.withColumn("_said", F.pandas_udf(run, "map<string,string>")("full_text", "_fields"))
    take = lambda c: F.when(F.array_contains("_fields", c), F.coalesce(F.col("_said")[c], F.col(c))).otherwise(F.col(c)).alias(c)
    return said.select(*(take(c) if c in ("act_number", "doc_type", "title", "issuing_authority") else F.col(c) for c in acts.columns))


def summaries(acts: DataFrame, cache: DataFrame | None, summarize: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """cache_key, summary of acts (title, full_text) that cache doesn't hold:
    short texts have none, summaries are cut, those of a few words dropped."""
    key = F.sha1(F.concat(F.coalesce("title", F.lit("")), F.substring("full_text", 1, 4000)))
    new = acts.select(key.alias("cache_key"), "full_text").dropDuplicates(["cache_key"])
    if cache is not None:
        new = new.join(cache.select("cache_key"), "cache_key", "left_anti")
    made = F.substring(F.pandas_udf(summarize, "string")("full_text"), 1, SUMMARY)
    said = new.withColumn("summary", F.when(F.length("full_text") < SUMMARY_TEXT, "").otherwise(made))
    return said.select("cache_key", F.when(F.size(F.split(F.trim("summary"), r"\s+")) < SUMMARY_WORDS, "").otherwise(F.col("summary")).alias("summary"))
