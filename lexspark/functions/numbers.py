"""Act numbers, document types, identifiers and dates as column functions.

An act number is a string: plain, dotted by thousands, with /YYYY, joint with
another (999/726), 0 or empty. It is never cast, only folded."""

from __future__ import annotations



import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import fold

#: Aliases of document types and the types themselves.
TYPE_ALIASES = {
    "HOTARARE": "HG", "HOTARARE A GUVERNULUI": "HG", "ORDONANTA DE URGENTA": "OUG", "ORDONANTA": "ORDONANȚĂ", "LEGEA": "LEGE",
    "ORDINUL": "ORDIN", "DECRETUL": "DECRET", "DECIZIA": "DECIZIE", "DECRET-LEGE": "DECRET_LEGE", "DCC": "DCC",
}
TYPES = ("LEGE", "HG", "OUG", "ORDONANȚĂ", "DECRET", "DECRET_LEGE", "DCC", "DECIZIE", "ORDIN", "COMUNICAT", "RAPORT", "ANUNT", "RECTIFICARE", "UNKNOWN")

#: Months by name.
MONTHS = "ianuarie februarie martie aprilie mai iunie iulie august septembrie octombrie noiembrie decembrie".split()

#: Modality of each era.
MODALITIES = {"scanned": "M1_SCANNED", "broken_2002": "M2_BROKEN_FONT", "broken_2007": "M2_BROKEN_FONT", "hybrid": "M2_BROKEN_FONT"}
MODERN = "M3_MODERN_DIGITAL"


def fold_act_number(c: Column) -> Column:
    """1.439 is 1439, 226/2006 is 226, a joint number stays, 0 is empty."""
    c = F.trim(c)
    c = F.regexp_replace(c, r"(\d)\.(?=\d{3}(?:\D|$))", "$1")
    c = F.regexp_replace(c, r"^(.*)/(?:19|20)\d\d$", "$1")
    return F.when(c.rlike(r"^0*$"), F.lit("")).otherwise(F.coalesce(c, F.lit("")))


def number_key(c: Column) -> Column:
    """What stands before a slash, letters and digits only, no leading 0."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.split_part(F.coalesce(c, F.lit("")), F.lit("/"), F.lit(1))), "[^a-z0-9]", ""), "^0+(?=.)", "")


def split_number_year(c: Column) -> Column:
    return F.struct(number_key(c).alias("number"), F.regexp_extract(c, r"/((?:19|20)\d\d)$", 1).try_cast("int").alias("year"))


#: Words that stand for a missing number.
PLACEHOLDERS = ("necunoscut", "unknown", "lipsă", "lipsa", "n/a")


def malformed_reason(c: Column) -> Column:
    """Why a number can't be one; empty if it can, is missing or stands for a
    missing one."""
    t = F.trim(F.coalesce(c, F.lit("")))
    whole = r"(?:\d+|\d{1,3}(?:\.\d{3})+)"
    return (
        F.when(t.isin("", "0", *PLACEHOLDERS) | F.lower(t).isin(*PLACEHOLDERS), "")
        .when(t.rlike(f"^{whole}(?:/\\d{{4}})?$"), "")
        .when(t.rlike(r"(?i)\bdin\b"), "date")
        .when(F.size(F.split(t, "/")) > 2, "segments")
        .when(t.contains("/") & ~t.rlike(f"^{whole}\\s*/"), "left side")
        .when(t.contains("/") & ~t.rlike(f"/\\s*(?:\\d{{4}}|{whole})$"), "suffix")
        .when(t.rlike("^[A-Za-zÀ-ÿ]"), "letter").when(t.rlike(r"\s"), "space").otherwise("")
    )


def canonical_type(c: Column) -> Column:
    """A type by its aliases; unknown ones as they are, upper-case."""
    key = F.regexp_replace(F.upper(fold(F.trim(c))), r"\s+", " ")
    table = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(table, key), key)


def clean_number(c: Column) -> Column:
    """Without a leading 'Nr.' and trailing dot leaders."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^nr\.?\s*", ""), r"[\s.…]+$", "")


def issue_id(part: Column, number: Column, year: Column, bis: Column | None = None) -> Column:
    suffix = F.when(bis, F.lit("Bis")).otherwise(F.lit("")) if bis is not None else F.lit("")
    return F.concat(F.lit("MO_P"), part, F.lit("_"), number.cast("string"), suffix, F.lit("_"), year.cast("string"))


def act_id(issue: Column, index: Column) -> Column:
    return F.format_string("%s::act-%03d", issue, index)


def chunk_id(act: Column, index: Column) -> Column:
    return F.format_string("%s::chunk-%03d", act, index)


def modality(era: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MODALITIES.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(era)), F.lit(MODERN))


def law_id(kind: Column, number: Column, year: Column) -> Column:
    return F.concat_ws("_", kind, F.nullif(number, F.lit("")), year.cast("string"))


def edit_ratio(a: Column, b: Column) -> Column:
    """Edit distance by the longer length, in the JVM; for matching_ratio()'s
    measure it is only a stand-in."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.levenshtein(a, b) / longest


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - 2 * characters in matching blocks by both lengths: 0 for equal texts
    and for two empty ones; null counts as empty."""
    from difflib import SequenceMatcher

    return pd.Series([1 - SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def file_identity(path: Column) -> Column:
    """part, number, bis and date from names such as
    'Monitorul-Oficial--PI--123Bis--2007-03-05.pdf'; a sentinel otherwise."""
    name = F.element_at(F.split(path, "/"), -1)
    pattern = r"(?i)P(I{1,3}|IV|V)--(\d+)(bis)?--(\d{4}-\d\d-\d\d)"
    ok = name.rlike(pattern)
    get = lambda n: F.regexp_extract(name, pattern, n)
    return F.struct(
        F.when(ok, F.upper(get(1))).otherwise("I").alias("part"), F.when(ok, get(2)).otherwise("0").alias("number"),
        (ok & (get(3) != "")).alias("bis"), F.when(ok, get(4)).otherwise("0000-00-00").alias("date"),
    )


def month_number(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)])
    return F.element_at(table, fold(name))


DATE = r"(?iu)(\d{1,2})\s+(" + "|".join(MONTHS) + r")\s+(\d{4})"


def text_date(c: Column) -> Column:
    """The first 'd month yyyy' as a date; null if none or impossible."""
    day, month, year = (F.regexp_extract(c, DATE, i) for i in (1, 2, 3))
    made = F.concat_ws("-", year, F.lpad(month_number(month).cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.when(c.rlike(DATE), F.try_to_date(made, "yyyy-MM-dd"))


