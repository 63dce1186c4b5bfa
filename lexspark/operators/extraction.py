"""Fields of an act by rule: type, number, year, citations, authority, title,
articles, signatures. Patterns are written for folded text (no accents), so
one form covers all spellings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, let

#: Heading words of each type, more specific ones first.
HEADINGS = (
    ("DECRET_LEGE", r"de\s?crete?\s*-\s*lege\b"), ("OUG", r"ordonanta\s+de\s+urgenta\b"), ("ORDONANȚĂ", r"ordonanta\b"), ("HG", r"hotar[ai]re\b"),
    ("DECRET", r"de\s?crete?\b"), ("DECIZIE", r"deciz(?:ie|ia?)\b"), ("ORDIN", r"ordin(?:ul)?\b"), ("LEGE", r"legea?\b"),
    ("COMUNICAT", r"comunicat(?:ul|e)?\b"), ("RAPORT", r"r\s*a\s*p\s*o\s*r\s*t\b"), ("RECTIFICARE", r"rectificari?e?\b"),
)
COURT = r"curtea\s+constitutionala"
CADASTRE = r"agenti(?:a|ei)\s+nationala\s+de\s+cadastru"

#: Authorities, their short tags and (folded) patterns, the first
#: that occurs anywhere wins; of parliament not the newspaper's footer.
AUTHORITIES = (
    ("Curtea Constituțională", "ccr", COURT),
    ("Agenția Națională de Cadastru și Publicitate Imobiliară", "ancpi", CADASTRE),
    ("Agenția Națională de Control al Exporturilor", "ance", r"agentia\s+nationala\s+de\s+control\s+al\s+export"),
    ("Agenția Națională pentru Resurse Minerale", "anrm", r"agentia\s+nationala\s+pentru\s+resurse\s+minerale"),
    ("Autoritatea Electorală Permanentă", "aep", r"autoritatea\s+electorala\s+permanenta"),
    ("Autoritatea Națională Sanitară Veterinară și pentru Siguranța Alimentelor", "ansvsa", r"autoritatea\s+nationala\s+sanitara\s+veterinara"),
    ("Banca Națională a României", "bnr", r"banca\s+nationala\s+a\s+romaniei"),
    ("Parlamentul României", "parl", r"parlamentul\s+romaniei(?!\s*[—–-]\s*camera)"),
    ("Președintele României", "pres", r"presedintele\s+romaniei"),
    ("Guvernul României", "gov", r"(?m)^guvernul\s+romaniei"),
    ("Ministerul Internelor", "mai", r"ministr\w+\s+internelor"),
    ("Ministerul Educației", "medu", r"ministr\w+\s+educatiei"),
    ("Ministerul Finanțelor", "mfin", r"ministr\w+\s+finantelor"),
    ("Ministerul Sănătății", "msan", r"ministr\w+\s+sanatatii"),
    ("Minister", "min", r"\bminister(?:ul)?\b"),
)

CLOSING = r"bucuresti, +\d{1,2} +[a-z]+ +(\d{4})\.[^§]{0,100}?nr\. *([\d.]*\d)\."
LONE = r"(?:^|\n) *nr\. *([\d.]*\d)\. *(?:\n|$)"
REPEAL = r"(?:se abroga|abroga|se modifica|modifica)[^\n]{0,80}?nr\. *([\d.]*\d)"
PREAMBLE = r"(?:in temeiul|avand in vedere|in baza)[^\n]{0,120}?nr\. *([\d.]*\d)"


def doc_type(text: Column, head: int = 800) -> Column:
    """The type whose heading comes first in the text's head; the order of
    HEADINGS breaks ties; the court's decisions are DCC, the cadastre's acts
    ORDIN; UNKNOWN without a heading."""
    # one search: the alternatives are tried in order where the first one fits,
    # and what it found tells which
    words = "|".join(f"(?:{p})" for _, p in HEADINGS)

    def of(start: Column) -> Column:
        def typed(word: Column) -> Column:
            best = F.lit(None).cast("string")
            for t, p in reversed(HEADINGS):
                best = F.when(word.rlike(f"^(?:{p})"), t).otherwise(best)
            return let(best, lambda b: F.when((b == "DECIZIE") & start.rlike(COURT), "DCC").when(start.contains("agenti") & start.rlike(CADASTRE), "ORDIN").otherwise(b))

        return F.coalesce(let(F.regexp_extract(start, rf"(?m)^\s*({words})", 1), typed), F.lit("UNKNOWN"))

    return let(F.substring(fold(text), 1, head), of)


def _opening(pattern: str) -> str:
    """The letters that a pattern starts with, which a text that it fits has."""
    return re.match(r"(?:\(\?m\)\^|\\b)?([a-z]+?)(?=[a-z]?[?*{]|[^a-z]|$)", pattern)[1]


def _authority(text: Column, field: int) -> Column:
    def of(folded: Column) -> Column:
        out = F.lit(None).cast("string")
        for row in reversed(AUTHORITIES):
            out = F.when(folded.contains(_opening(row[2])) & folded.rlike(row[2]), row[field]).otherwise(out)
        return out

    return let(fold(text), of)


def authority(text: Column) -> Column:
    """The first authority of the list that the text names."""
    return _authority(text, 0)


def authority_tag(text: Column) -> Column:
    return _authority(text, 1)


#: Roles after which a comma and the next line's name sign an act (folded).
ROLES = ("ministrul", "ministra", "presedintele", "directorul", "guvernatorul", r"p\.\s+ministrul", "secretarul de stat")


def signatory_hint(text: Column) -> Column:
    """The first signature's name, three words of it at most: a line that starts
    a role and ends with a comma, then (after a blank line or none) a line that
    starts with a capital; empty without one, or if it is a single word."""
    plain = F.replace(text, F.lit("<!-- orphaned-signature -->"), F.lit(""))
    role = "|".join(ROLES).replace("presedintele", "pre[sșş]edintele")
    name = F.trim(F.regexp_extract(plain, rf"(?:(?i:{role}))[^\n]{{0,120}},[^\S\n]*\n(?:[^\S\n]*\n)?[^\S\n]*([A-ZĂÂÎȘȚ][^\n]{{2,60}})", 1))
    return let(F.filter(F.split(F.regexp_replace(name, r"[,;.]+$", ""), r"\s+"), lambda w: w != ""), lambda w: F.when(F.size(w) >= 2, F.array_join(F.slice(w, 1, 3), " ")).otherwise(""))


def issue_header(text: Column) -> Column:
    """year_label (the newspaper's own, in Roman numerals) and weekday of a
    masthead; null where it has none."""
    some = lambda p: F.nullif(F.regexp_extract(fold(text), p, 1), F.lit(""))
    return F.struct(F.upper(some(r"\banul\s+([ivxlcdm\d]+)\b")).alias("year_label"), some(r"\b(luni|marti|miercuri|joi|vineri|sambata|duminica)\b").alias("weekday"))


def reclassify(acts: DataFrame) -> DataFrame:
    """acts with type and authority found anew where they are UNKNOWN or empty;
    what is known stays."""
    kind, by = doc_type(F.col("full_text")), authority(F.col("full_text"))
    empty = F.coalesce("issuing_authority", F.lit("")) == ""
    return acts.withColumns({"doc_type": F.when(F.col("doc_type") == "UNKNOWN", kind).otherwise(F.col("doc_type")), "issuing_authority": F.when(empty, by).otherwise(F.col("issuing_authority"))})


def reclassify_chunks(chunks: DataFrame) -> DataFrame:
    """chunks (issue_id, act_index, chunk_index, text, doc_type,
    issuing_authority) with their acts' type and authority, found anew in the
    acts' texts, which are put together from their chunks; one small row an act
    is joined back."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n")
    acts = chunks.groupBy("issue_id", "act_index").agg(texts.alias("full_text"), F.first("doc_type").alias("doc_type"), F.first("issuing_authority").alias("issuing_authority"))
    found = reclassify(acts.filter((F.col("doc_type") == "UNKNOWN") | (F.coalesce("issuing_authority", F.lit("")) == ""))).select("issue_id", "act_index", F.struct("doc_type", "issuing_authority").alias("_n"))
    out = chunks.join(found, ["issue_id", "act_index"], "left")
    new = lambda c: F.when(F.col("_n").isNotNull(), F.col("_n")[c]).otherwise(F.col(c)).alias(c)
    return out.select(*(new(c) if c in ("doc_type", "issuing_authority") else F.col(c) for c in chunks.columns))


def numbers_in(text: Column, pattern: str) -> Column:
    """Distinct numbers that the pattern finds, without dots, in order."""
    return _numbers_in(fold(text), pattern)


def _numbers_in(folded: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(folded, F.lit(pattern), F.lit(1)), lambda n: F.regexp_replace(n, r"\.", "")))


def repealed_numbers(text: Column) -> Column:
    return numbers_in(text, REPEAL)


def cited_numbers(text: Column) -> Column:
    return numbers_in(text, PREAMBLE)


def number_and_year(text: Column) -> Column:
    """number, year, confidence: from the last closing block; else the first
    lone 'Nr. n.' of the last 5000 characters that no preamble cites; else 0."""
    def of(folded: Column) -> Column:
        def lone() -> Column:
            tail = F.regexp_extract_all(F.substring(folded, F.greatest(F.length(folded) - 4999, F.lit(1)), F.lit(5000)), F.lit(LONE), F.lit(1))
            return let(_numbers_in(folded, PREAMBLE), lambda cited: F.get(F.filter(F.transform(tail, lambda n: F.regexp_replace(n, r"\.", "")), lambda n: ~F.array_contains(cited, n)), 0))

        def said(closing: Column) -> Column:
            return F.struct(
                F.coalesce(F.regexp_replace(F.regexp_extract(closing, CLOSING, 2), r"\.", ""), lone(), F.lit("0")).alias("number"), F.regexp_extract(closing, CLOSING, 1).cast("int").alias("year"),
                F.when(closing.isNotNull(), "high").otherwise("low").alias("confidence"),
            )

        return let(F.try_element_at(F.regexp_extract_all(folded, F.lit(CLOSING), F.lit(0)), F.lit(-1)), said)

    return let(fold(text), of)


def final_year(number: Column, closing_year: Column, issue_year: Column) -> Column:
    """A /YYYY suffix; else the closing year if it is the issue's or the one
    before; else the issue's."""
    suffix = F.regexp_extract(number, r"/((?:19|20)\d\d)$", 1).try_cast("int")
    return F.coalesce(suffix, F.when(closing_year.between(issue_year - 1, issue_year), closing_year), issue_year)


def title_after_type(text: Column) -> Column:
    """Up to three lines after the type's line, up to an article, 300 characters."""
    lines = F.filter(F.transform(F.slice(F.split(text, "\n"), 2, 3), lambda x: F.trim(x)), lambda x: x != "")
    stop = F.array_position(F.transform(lines, lambda x: x.rlike(r"(?i)^art")), True)
    kept = F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines)
    return F.substring(F.array_join(kept, " "), 1, 300)


def locality(text: Column) -> Column:
    """The county named after the first 50 characters."""
    return F.nullif(F.regexp_extract(F.when(F.lower(text).contains("jude"), F.substring(text, F.lit(51), F.length(text))).otherwise(""), r"(?iu)jude[țt]ul(?:ui)?\s+((?-i)[A-ZĂÂÎȘȚ][a-zăâîșț-]{2,})", 1), F.lit(""))


def articles(text: Column) -> Column:
    """number, title, paragraphs, text of each article."""
    parts = F.filter(F.split(text, r"(?im)^(?=\s*(?:art\.|articolul)\s*\d)"), lambda x: x.rlike(r"(?i)^\s*(?:art\.|articolul)\s*\d"))
    return F.transform(parts, lambda x: F.struct(
        F.regexp_extract(x, r"(?i)^\s*(?:art\.|articolul)\s*(\d+(?:\^\d+)?)", 1).alias("number"),
        F.trim(F.regexp_extract(x, r"(?i)^\s*(?:art\.|articolul)\s*\d+(?:\^\d+)?\.?\s*[-–—]?\s*([^\n]*)", 1)).alias("title"),
        F.regexp_extract_all(x, F.lit(r"(?m)^\s*\((\d+(?:\^\d+)?)\)"), F.lit(1)).alias("paragraphs"),
        F.trim(x).alias("text"),
    ))


def annexes(text: Column) -> Column:
    """number and text of each annex."""
    parts = F.filter(F.split(text, r"(?im)^(?=\s*anexa(?:\s+nr\.)?\s*\d*)"), lambda x: x.rlike(r"(?i)^\s*anexa"))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"(?i)^\s*anexa(?:\s+nr\.)?\s*(\d*)", 1).alias("number"), F.trim(x).alias("text")))


def signatories(text: Column) -> Column:
    """Names after a role and a comma, in order."""
    names = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:p\.\s*)?(?:Prim-ministru|Pre[sș]edinte(?:le)?[^,\n]*|Ministrul[^,\n]*|Ministru[^,\n]*),\s*\n\s*([A-ZĂÂÎȘȚ][^\n,]{3,60})"), F.lit(1))
    return F.array_distinct(F.transform(names, lambda n: F.trim(n)))


def extract_acts(acts: DataFrame, text: str = "full_text", issue_year: str = "act_year") -> DataFrame:
    """acts with draft, the fields that rules find."""
    return acts.withColumn("draft", let(number_and_year(F.col(text)), lambda n: F.struct(
        doc_type(F.col(text)).alias("doc_type"), n["number"].alias("act_number"), final_year(n["number"], n["year"], F.col(issue_year)).alias("act_year"),
        n["confidence"].alias("confidence"), authority(F.col(text)).alias("issuing_authority"), title_after_type(F.col(text)).alias("title"), locality(F.col(text)).alias("locality"),
    )))


def propagate_annex(acts: DataFrame) -> DataFrame:
    """Acts that are annexes (no type, no number) take type, number and year of
    the last act before them in their issue that is none."""
    annex = (F.col("doc_type") == "UNKNOWN") & F.col("act_number").isin("", "0")
    last = lambda c: F.last(F.when(~annex, F.col(c)), ignorenulls=True).over(Window.partitionBy("issue_id").orderBy("act_index").rowsBetween(Window.unboundedPreceding, 0))
    return acts.select("*", *(F.when(annex, F.coalesce(last(c), F.col(c))).otherwise(F.col(c)).alias(f"{c}_filled") for c in ("doc_type", "act_number", "act_year")))


def is_phantom(acts: DataFrame, least_tokens: int = 200) -> Column:
    """Short, without type, number, authority and article."""
    return (
        (F.size(F.split(F.trim("full_text"), r"\s+")) < least_tokens) & (F.col("doc_type") == "UNKNOWN") & F.col("act_number").isin("", "0")
        & (F.coalesce("issuing_authority", F.lit("")) == "") & ~F.col("full_text").rlike(r"(?im)^\s*art\.")
    )


def closing_signatures(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, number, context: closing blocks, then lone numbers, of
    each page; the first of each number in a document, none from a masthead."""
    folded = fold(F.col("text"))
    full = F.regexp_extract_all(folded, F.lit(CLOSING), F.lit(2))
    lone = F.regexp_extract_all(folded, F.lit(LONE), F.lit(1))
    rows = pages.select("doc_id", "page_no", "text", F.posexplode(F.concat(F.transform(full, lambda n: F.struct(n.alias("n"), F.lit(0).alias("kind"))), F.transform(lone, lambda n: F.struct(n.alias("n"), F.lit(1).alias("kind"))))).alias("at", "x"))
    rows = rows.filter(~F.col("text").rlike(r"(?i)^\s*monitorul oficial") | (F.col("x.kind") == 0))
    rows = rows.withColumn("number", F.regexp_replace("x.n", r"\.", ""))
    first = Window.partitionBy("doc_id", "number").orderBy("page_no", "x.kind", "at")
    return rows.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("doc_id", "page_no", "number", F.substring(F.regexp_replace("text", r"\s+", " "), 1, 300).alias("context"))


def match_recovered(acts: DataFrame, signatures: DataFrame, tolerance: int = 2, excluded: DataFrame | None = None) -> DataFrame:
    """doc_id, act_index, number of acts without a number whose signatory's
    names all stand in the context of one signature: of those near their page
    if they have a page_hint, of the document's else; null if none or several.
    excluded (doc_id, number): numbers that the document's acts abrogate, which
    sign none of them.

    A range join: pages are cut into bands of the tolerance, so it is an
    equi-join on document and band. Acts without a page meet the document's
    signatures by the signatory's longest name, which has to be there."""
    width = 2 * tolerance + 1
    if excluded is not None:
        signatures = signatures.join(excluded.select("doc_id", "number").distinct(), ["doc_id", "number"], "left_anti")
    words = lambda c: F.filter(F.split(fold(c), r"[^a-z0-9]+"), lambda n: F.length(n) > 3)
    names = F.filter(F.split(fold(F.col("signatory")), r"\s+"), lambda n: F.length(n) > 3)
    # names and contexts are folded once, not for each pair
    named = acts.withColumn("_names", names).filter(F.size("_names") > 0)
    signatures = signatures.select("doc_id", "page_no", "number", fold(F.col("context")).alias("context"))
    a = named.filter("page_hint is not null").withColumn("_band", F.explode(F.array_distinct(F.array(F.floor((F.col("page_hint") - tolerance) / width), F.floor((F.col("page_hint") + tolerance) / width)))))
    s = signatures.withColumn("_band", F.floor(F.col("page_no") / width))
    near = a.join(s, ["doc_id", "_band"]).filter(F.abs(F.col("page_hint") - F.col("page_no")) <= tolerance).drop("_band")
    longest = F.array_max(F.transform(words(F.col("signatory")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    far = named.filter("page_hint is null").withColumn("_w", longest).join(signatures.withColumn("_w", F.explode(F.array_distinct(words(F.col("context"))))), ["doc_id", "_w"]).drop("_w")
    met = near.unionByName(far).filter(F.forall("_names", lambda n: F.col("context").contains(n)))
    found = met.groupBy("doc_id", "act_index").agg(F.count_distinct("number").alias("c"), F.min("number").alias("number"))
    return acts.select("doc_id", "act_index").join(found, ["doc_id", "act_index"], "left").select("doc_id", "act_index", F.when(F.col("c") == 1, F.col("number")).alias("number"))


def positional_tiebreak(acts: DataFrame, candidates: DataFrame) -> DataFrame:
    """The n-th act of a signatory in a document takes the n-th candidate."""
    nth = lambda by: F.row_number().over(Window.partitionBy("doc_id", "signatory").orderBy(*by))
    a = acts.withColumn("rn", nth(["act_index"]))
    c = candidates.withColumn("rn", nth(["page_no", "number"])).select("doc_id", "signatory", "rn", "number")
    return a.join(c, ["doc_id", "signatory", "rn"], "left").drop("rn")


def positional_fill(acts: DataFrame, toc: DataFrame) -> DataFrame:
    """Number 0 takes that of the TOC line at its position if types agree."""
    t = toc.select("issue_id", F.col("toc_idx").alias("act_index"), "toc_number", "toc_type")
    ok = F.col("act_number").isin("0", "") & (F.col("toc_type") == F.col("doc_type")) & ~F.coalesce("toc_number", F.lit("")).isin("0", "")
    return acts.join(t, ["issue_id", "act_index"], "left").withColumn("act_number", F.when(ok, F.col("toc_number")).otherwise(F.col("act_number"))).drop("toc_number", "toc_type")


