"""From act text to retrieval chunks: cleaning, quality gates, duplicates,
chunking, prefixes, vectors."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import act_id, chunk_id, law_id
from ..functions.text import fold, let, strip_all
from ..session import materialize

#: Chunk sizes in tokens, overlap, and the least preamble.
TARGET, LARGEST, OVERLAP, PREAMBLE = 450, 512, 80, 50
#: Near-duplicate threshold, least text, words a shingle, least shingles.
DUP_SHARE, DUP_LENGTH, DUP_WORDS, DUP_SHINGLES = 0.55, 5000, 4, 8
#: Vocabulary share, least words, words that are looked at.
POISON_SHARE, POISON_LEAST, POISON_HEAD = 0.12, 150, 1000
ARTICLE_TYPES = ("LEGE", "OUG", "HG", "HOTĂRÂRE", "ORDIN", "ORDONANȚĂ", "DECRET_LEGE")


#: What isn't an act's text: running headers, page breaks, marker
#: comments, the colophon up to the end, lone page numbers.
POLLUTION = (
    r"(?im)^\s*\d*\s*MONITORUL\s+OFICIAL\s+AL\s+ROM[ÂA]NIEI[^\n]*$\n?",
    r"(?imu)^\s*Monitorul\s+Oficial\s+al\s+Rom[âa]niei,\s*Partea\s+I[^\n]*$\n?",
    r"(?im)^\s*(?:<!--\s*\w+:)?page-break(?:\s*-->)?\s*$\n?",
    r"<!--\s*\w+:[^>]*-->\n?",
    r"(?is)\n[^\n]{0,10}EDITOR\s*:\s*(?:PARLAMENTUL|CONSILIUL|MONITORUL).{0,2500}\z",
    r"(?m)^\s*\d{1,3}\s*$\n?",
)


def clean_act_text(c: Column) -> Column:
    """Without POLLUTION; blocks of lines that repeat at once count once."""
    for pattern in POLLUTION:
        c = F.regexp_replace(c, pattern, "")
    return strip_all(F.regexp_replace(collapse_blocks_udf(c), r"\n{3,}", "\n\n"))


def line_key(line: Column) -> Column:
    return F.regexp_replace(fold(line), r"\s", "")


def collapse_lines(c: Column, least: int = 15) -> Column:
    """A line equal to the one before it, folded, with so many letters, goes."""
    def kept(rows: Column) -> Column:
        same = lambda x, i: (i > 0) & (F.get(rows, i - 1)["key"] == x["key"]) & (F.length(F.regexp_replace(x["key"], "[^a-z]", "")) >= least)
        return F.array_join(F.transform(F.filter(rows, lambda x, i: ~F.coalesce(same(x, i), F.lit(False))), lambda x: x["line"]), "\n")

    return let(F.transform(F.split(c, "\n"), lambda x: F.struct(x.alias("line"), line_key(x).alias("key"))), kept)


def collapse_blocks(text: str | None, most: int = 8, least: int = 15) -> str | None:
    """Blocks of up to most lines that repeat at once are kept once, until
    nothing changes; larger blocks first."""
    if text is None:
        return None
    import unicodedata

    def key(line):
        if line.isascii():
            return "".join(line.lower().split())
        return "".join(c for c in unicodedata.normalize("NFKD", line.lower()) if not unicodedata.combining(c) and not c.isspace())

    lines = text.split("\n")
    keys = [key(x) for x in lines]
    changed = any(k and k in keys[i + 1 : i + most + 1] for i, k in enumerate(keys))
    while changed:
        changed = False
        for size in range(most, 0, -1):
            i = 0
            while i + 2 * size <= len(lines):
                same = keys[i : i + size] == keys[i + size : i + 2 * size]
                if same and sum(c.isalpha() for k in keys[i : i + size] for c in k) >= least:
                    del lines[i + size : i + 2 * size], keys[i + size : i + 2 * size]
                    changed = True
                else:
                    i += 1
    return "\n".join(lines)


@F.pandas_udf(T.StringType())
def collapse_blocks_udf(texts: pd.Series) -> pd.Series:
    return texts.map(collapse_blocks, na_action="ignore")


def letter_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-zăâîșț]{2,}"), F.lit(0))


def is_poison(c: Column) -> Column:
    """Long enough, with too few distinct words among the first thousand."""
    w = letter_words(c)
    head = F.slice(w, 1, POISON_HEAD)
    return (F.size(w) > POISON_LEAST) & (F.size(F.array_distinct(head)) / F.size(head) < POISON_SHARE)


def shingles(c: Column, n: int = DUP_WORDS) -> Column:
    """Distinct n-word shingles at every second word, the last start left out."""
    def of(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - n - 1, F.lit(0)), F.lit(2))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " ")))

    return let(F.regexp_extract_all(F.lower(c), F.lit("[a-zăâîșț0-9]{2,}"), F.lit(0)), of)


def duplicate_pairs(docs: DataFrame, key: str, share: float = DUP_SHARE, length: int = DUP_LENGTH, within: tuple[str, ...] = ()) -> DataFrame:
    """Pairs a < b of long texts whose containment, shared shingles by the
    smaller set, reaches share. The smaller set shares at least share of itself,
    so one of its first shingles, in the order of document frequency, must be in
    the larger one: the join is on those, the rarest, so that frequent shingles
    don't pair everything; what meets is verified on whole sets."""
    rows = docs.filter(F.length("text") >= length).select(F.col(key).alias("id"), *within, F.transform(shingles(F.col("text")), lambda x: F.xxhash64(x)).alias("s"))
    rows = rows.filter(F.size("s") >= DUP_SHINGLES)
    every = rows.select("id", *within, F.size("s").alias("n"), F.explode("s").alias("h"))
    # a shingle that one text has can't meet another, but comes first
    common = every.groupBy(*within, "h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    met = every.join(common, [*within, "h"])
    own = Window.partitionBy(*within, "id")
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "h"))
    first = met.withColumn("_r", place).filter(F.col("_r") <= F.col("n") - F.ceil(F.lit(share) * F.col("n")) + 1)
    small = first.select(F.col("id").alias("x"), *within, F.col("n").alias("nx"), "h")
    large = met.select(F.col("id").alias("y"), *within, F.col("n").alias("ny"), "h")
    pairs = small.join(large, [*within, "h"]).filter((F.col("x") != F.col("y")) & (F.col("nx") <= F.col("ny")))
    pairs = pairs.select(*within, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    left, right = rows.select(*within, F.col("id").alias("a"), F.col("s").alias("sa")), rows.select(*within, F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, [*within, "a"]).join(right, [*within, "b"]).withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    both = both.select(*within, "a", "b", "shared", F.size("sa").alias("na"), F.size("sb").alias("nb"))
    return both.filter(F.col("shared") >= F.lit(share) * F.least("na", "nb"))


def duplicate_losers(pairs: DataFrame, group: str) -> DataFrame:
    """group, id of what goes: pairs in order of a, b; of a pair the smaller set
    goes (b if equal); what has gone is no evidence."""

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        gone: set = set()
        for r in pdf.sort_values(["a", "b"]).itertuples():
            if r.a not in gone and r.b not in gone:
                gone.add(r.a if r.na < r.nb else r.b)
        return pd.DataFrame({group: pdf[group].iloc[0], "id": sorted(gone)})

    kinds = dict(pairs.dtypes)
    return pairs.groupBy(group).applyInPandas(resolve, f"{group} {kinds[group]}, id {kinds['a']}")


def count_tokens(c: Column) -> Column:
    """The built-in counter: words and marks."""
    return F.size(F.regexp_extract_all(c, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0)))


def strategy(text: Column, kind: Column, authority: Column) -> Column:
    """whole_act, article, paragraph or token_window."""
    court = fold(F.coalesce(authority, F.lit(""))).contains("curtea constitutionala")
    return (
        # a token has a character at least, so short texts need no count
        F.when((F.length(text) <= LARGEST) | (count_tokens(text) <= LARGEST), "whole_act")
        .when(kind.isin(*ARTICLE_TYPES) & text.rlike(r"(?im)^\s*(?:art\.|articolul)\s*\d"), "article")
        .when((kind == "DECIZIE") & court, "paragraph").otherwise("token_window")
    )


def windows(tokens: Column, size: int = TARGET, overlap: int = OVERLAP) -> Column:
    """Arrays of size tokens with overlap; none starts once one has reached
    the end."""
    step = size - overlap

    def of(t: Column) -> Column:
        last = F.when(F.size(t) <= size, F.lit(0)).otherwise(F.ceil((F.size(t) - size) / step) * step)
        return F.transform(F.sequence(F.lit(0), last.cast("int"), F.lit(step)), lambda i: F.slice(t, i + 1, F.lit(size)))

    return let(tokens, of)


def packed(units: Column, size: int = TARGET) -> Column:
    """Units (text, n) packed in order into parts of at most size, each part
    an array of units; a larger unit is a part of its own."""
    start = F.struct(F.array().cast("array<array<struct<text:string,n:int>>>").alias("done"), F.array().cast("array<struct<text:string,n:int>>").alias("now"), F.lit(0).alias("n"))

    def step(a, x):
        flush = (a["n"] > 0) & (a["n"] + x["n"] > size)
        return F.struct(
            F.when(flush, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"),
            F.when(flush, F.array(x)).otherwise(F.concat(a["now"], F.array(x))).alias("now"),
            F.when(flush, x["n"]).otherwise(a["n"] + x["n"]).alias("n"),
        )

    return F.aggregate(units, start, step, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))


def split_markers(text: str, pattern: str) -> list[str]:
    """Pieces that start at each match; what precedes the first comes first."""
    import re

    starts = [m.start() for m in re.finditer(pattern, text, re.M | re.I)]
    cuts = sorted({0, *starts, len(text)})
    return [p for p in (text[a:b].strip() for a, b in zip(cuts, cuts[1:])) if p]


def chunk_text(text: str | None, kind: str, how: str, count: Callable[[str], int]) -> list[tuple[str, str | None, str]]:
    """(text, first article or None, path) of an act's chunks."""
    import re

    if not text or not text.strip():
        return []
    join = lambda parts: "\n".join(parts)

    def window(t):
        words, out, at = t.split(), [], 0
        while True:
            out.append(" ".join(words[at : at + TARGET]))
            if at + TARGET >= len(words):
                return out
            at += TARGET - OVERLAP

    def pack(parts, label):
        out, now, n = [], [], 0
        for p in parts:
            c = count(p)
            if now and n + c > TARGET:
                out.append(label(now))
                now, n = [], 0
            now.append(p)
            n += c
        return [*out, label(now)] if now else out

    if how == "whole_act":
        out = [(text.strip(), None, "whole")]
    elif how == "article":
        head, found = r"^\s*(?:art\.|articolul)\s*(\d+)", []
        number = lambda p: (m[1] if (m := re.match(head, p, re.I)) else None)
        pieces = split_markers(text, r"^\s*(?:art\.|articolul)\s*\d+")
        if pieces and number(pieces[0]) is None:
            first = pieces.pop(0)
            if count(first) >= PREAMBLE:
                found.append((first, None, "preamble"))

        def label(parts):
            a, b = number(parts[0]), number(parts[-1])
            return join(parts), a, f"art_{a}" if a == b else f"art_{a}-{b}"

        run: list[str] = []
        for p in pieces:
            if count(p) > LARGEST:
                found += pack(run, label)
                run = []
                found += pack(split_markers(p, r"^\s*\(\d+\)"), lambda parts, a=number(p): (join(parts), a, f"art_{a}_alin_{m[1]}" if (m := re.match(r"\s*\((\d+)\)", parts[0])) else f"art_{a}"))
            else:
                run.append(p)
        out = found + pack(run, label)
    elif how == "paragraph":
        out = pack(split_markers(text, r"^\s*\d+\.\s"), lambda parts: (join(parts), None, f"par_{m[1]}" if (m := re.match(r"\s*(\d+)\.", parts[0])) else "par"))
    else:
        out = [(t, None, f"window_{i}") for i, t in enumerate(window(text))]
    return [(part, art, path) for t, art, path in out for part in ([t] if count(t) <= LARGEST else window(t))]


def default_counter(text: str) -> int:
    import re

    return len(re.findall(r"\w+|[^\w\s]", text))


def chunk_acts(acts: DataFrame, token_counter: Callable[[str], int] = default_counter) -> DataFrame:
    """issue_id, act_index, chunk_index, strategy, article_number, path, text,
    n_tokens, chunk_id of every act, by its strategy."""
    return chunked(acts, [], token_counter)


def chunked(acts: DataFrame, facets: list[str], token_counter: Callable[[str], int] = default_counter) -> DataFrame:
    """What chunk_acts gives, and facets of the acts: these stay in the row, so
    chunks need no join with their acts and texts are made once."""

    def run(texts: pd.Series, kinds: pd.Series, hows: pd.Series) -> pd.Series:
        return pd.Series([[(t, art, path, token_counter(t)) for t, art, path in chunk_text(x, k, h, token_counter)] for x, k, h in zip(texts, kinds, hows)], dtype=object)

    made = F.pandas_udf(run, "array<struct<text:string,article_number:string,path:string,n_tokens:int>>")
    rows = acts.withColumn("strategy", strategy(F.col("full_text"), F.col("doc_type"), F.col("issuing_authority")))
    rows = rows.select("issue_id", "act_index", "strategy", *facets, F.posexplode(made("full_text", "doc_type", "strategy")).alias("chunk_index", "_c"))
    name = chunk_id(act_id(F.col("issue_id"), F.col("act_index")), F.col("chunk_index")).alias("chunk_id")
    return rows.select("issue_id", "act_index", "chunk_index", "strategy", *(f"_c.{c}" for c in ("article_number", "path", "text", "n_tokens")), name, *facets)


def prefix(kind: Column, number: Column, year: Column, authority: Column, issue: Column, summary: Column | None = None) -> Column:
    """[TYPE n/y | authority | MO issue | year] and a summary, parts that are
    empty left out."""
    nr = F.nullif(F.nullif(F.coalesce(number, F.lit("")), F.lit("")), F.lit("0"))
    label = F.concat_ws(" ", F.coalesce(F.nullif(kind, F.lit("")), F.lit("ACT")), F.concat_ws("/", nr, F.when(nr.isNotNull(), year.cast("string"))))
    head = F.concat(F.lit("["), F.concat_ws(" | ", F.trim(label), F.nullif(authority, F.lit("")), F.concat(F.lit("MO "), F.nullif(issue, F.lit(""))), year.cast("string")), F.lit("]"))
    return head if summary is None else F.concat_ws(" ", head, F.concat(F.lit("["), F.nullif(summary, F.lit("")), F.lit("]")))


def path_parts(path: Column) -> Column:
    """alineat and litera of a path."""
    return F.struct(F.nullif(F.regexp_extract(path, r"alin_(\d+)", 1), F.lit("")).alias("alineat"), F.nullif(F.regexp_extract(path, r"lit_([a-z])", 1), F.lit("")).alias("litera"))


def dense_length(c: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s", ""))


def coverage_ratio(raw: Column, mapped: Column) -> Column:
    """Share of raw's characters that are no white space in mapped; 1 for an
    empty raw, 1 at most."""
    n = dense_length(raw)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(dense_length(mapped) / n, F.lit(1.0)))


def split_table(markdown: Column, most: int = 900) -> Column:
    """A table's parts of at most most words, header and separator repeated."""
    lines = F.filter(F.split(markdown, "\n"), lambda x: F.trim(x) != "")
    ruled = F.coalesce(F.get(lines, 1).rlike(r"^[\s|:-]+$"), F.lit(False))
    head = F.slice(lines, F.lit(1), F.when(ruled, 2).otherwise(1))
    rows = F.slice(lines, F.when(ruled, 3).otherwise(2), F.greatest(F.size(lines), F.lit(1)))
    units = F.transform(rows, lambda x: F.struct(x.alias("text"), F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")).alias("n")))
    return F.transform(packed(units, most), lambda part: F.array_join(F.concat(head, F.transform(part, lambda u: u["text"])), "\n"))


def quantize(v: Column) -> Column:
    """Vectors as bytes: value times 127, half to even, clamped."""
    return F.transform(v, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.bround(x.cast("double") * 127).cast("int"))).cast("tinyint"))


#: Characters that are embedded at most; what a question starts
#: with for models that ask for it.
MOST_CHARS = 30_000
QUERY_INSTRUCTION = "Reprezintă această interogare pentru căutarea documentelor juridice românești: "


def unit(v: Column) -> Column:
    """A vector at length 1; one of zeros stays."""
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double")))
    return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: (x.cast("double") / n).cast("float"))).otherwise(v))


def embed(df: DataFrame, embedder: Callable[[pd.Series], pd.Series], text: str = "text", most: int = MOST_CHARS, normalize: bool = True, instruction: str = "") -> DataFrame:
    """df with embedding, made by the plug-in on batches of texts (cut to its
    limit, as the model would; questions after their instruction)."""
    udf = F.pandas_udf(embedder, "array<float>")
    rows = df.withColumn("embedding", udf(F.substring(F.concat(F.lit(instruction), F.col(text)), 1, most)))
    return rows.withColumn("embedding", unit(F.col("embedding"))) if normalize else rows


def reembed(chunks: DataFrame, embedder: Callable[[pd.Series], pd.Series], version: str) -> DataFrame:
    """chunks with embeddings made anew of what was embedded (its prefix kept,
    or made where there is none) and their version."""
    head = prefix(F.col("doc_type"), F.col("act_number"), F.col("act_year"), F.col("issuing_authority"), F.col("issue_id"))
    rows = chunks.withColumn("text_embedded", F.coalesce("text_embedded", F.concat_ws(" ", head, "text")))
    return embed(rows.drop("embedding"), embedder, "text_embedded").withColumn("embedding_version", F.lit(version))


def legacy_prefix(text: Column, kind: Column, number: Column, year: Column, authority: Column, issue: Column) -> Column:
    """[TYPE n/y | authority | MO issue | year] text; a party's table without an
    authority gets the party that its text names."""
    nr = F.nullif(number, F.lit(""))
    label = F.concat_ws(" ", F.coalesce(F.nullif(kind, F.lit("")), F.lit("ACT")), F.when(nr.isNotNull(), F.concat_ws("/", nr, year.cast("string"))))
    party = F.nullif(F.trim(F.regexp_extract(text, r"(?iU)(Partidul[ \t]+\w+(?:[ \t]+\w+)?)", 1)), F.lit(""))
    by = F.coalesce(F.nullif(authority, F.lit("")), F.when(text.contains("STRUCTURA TABEL COTIZATII"), F.concat_ws(" | ", party, F.lit("cotizatii lunare 12 luni"))))
    return F.concat(F.lit("["), F.concat_ws(" | ", label, by, F.concat(F.lit("MO "), F.nullif(issue, F.lit(""))), year.cast("string")), F.lit("] "), text)


#: Lines that are a table's title, and those that never are.
TITLE_GOOD = r"(?iu)ANEX[AĂE]|Nomenclator|Lista|Situa[țt]ia|Structura"
TITLE_BAD = r"(?u)^\d+$|^MONITORUL\s+OFICIAL|^PRIM-?MINISTRU|^MINISTRU|^PRE[ȘS]EDINTELE|^[A-ZĂÂÎȘȚ\s.\-]+$"


def table_title(above: Column, most: int = 120) -> Column:
    """Of the lines above a table the last one that reads like a caption, else
    the last that isn't a signature, a header or a number; else empty."""
    lines = F.reverse(F.filter(F.transform(F.split(above, "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    best = F.coalesce(F.get(F.filter(lines, lambda x: x.rlike(TITLE_GOOD)), F.lit(0)), F.get(F.filter(lines, lambda x: ~x.rlike(TITLE_BAD)), F.lit(0)), F.lit(""))
    return F.substring(best, 1, most)


def table_chunks(tables: DataFrame) -> DataFrame:
    """chunk_id, issue_id, act_index (null), chunk_index, path, text, n_tokens,
    title, text_embedded, parent_text of tables (issue_id, table_index, markdown,
    title, act_year), cut at rows."""
    rows = tables.filter(F.length("markdown") >= 10).withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Tabel "), (F.col("table_index") + 1).cast("string"))))
    rows = rows.select("*", F.posexplode(split_table(F.col("markdown"))).alias("chunk_index", "text"))
    n, i = F.col("table_index").cast("string"), F.col("chunk_index").cast("string")
    return rows.select(
        F.concat("issue_id", F.lit("_tbl"), n, F.lit("_p"), i).alias("chunk_id"), "issue_id", F.lit(None).cast("int").alias("act_index"), "chunk_index", F.lit("TABLE").alias("doc_type"), "act_year",
        F.concat(F.lit("table/"), n, F.lit("/part/"), i).alias("path"), "text", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("n_tokens"), "title",
        F.concat(F.lit("[TABLE | "), "title", F.lit(" | MO "), "issue_id", F.lit(" | "), F.col("act_year").cast("string"), F.lit("] "), "text").alias("text_embedded"), F.substring("markdown", 1, 12000).alias("parent_text"),
    )


def without_duplicates(acts: DataFrame) -> DataFrame:
    """acts without those whose long text near-duplicates another one of their
    issue; the shorter one goes."""
    # only long texts have duplicates: they are put down and compared, and the
    # others pass without a shuffle
    long = F.coalesce(F.length("full_text") >= DUP_LENGTH, F.lit(False))
    some = materialize(acts.filter(long))
    key = some.select("issue_id", F.col("act_index").alias("n"), F.col("full_text").alias("text"))
    gone = duplicate_losers(duplicate_pairs(key, "n", within=("issue_id",)), "issue_id").withColumnRenamed("id", "act_index")
    return acts.filter(~long).unionByName(some.join(gone, ["issue_id", "act_index"], "left_anti"))


def build_chunks(acts: DataFrame, token_counter: Callable[[str], int] = default_counter, tables: DataFrame | None = None) -> DataFrame:
    """The gold table of chunks: acts with 20 characters that are neither poison
    nor near-duplicates in their issue, chunked, with law id, prefix and up to
    12,000 characters of parent text; tables' chunks after them."""
    good = without_duplicates(acts.filter(F.length("full_text") >= 20))
    # explode() keeps the filters after it from being cleaned texts' second making
    good = good.select(*(c for c in good.columns if c != "full_text"), F.explode(F.array(clean_act_text(F.col("full_text")))).alias("full_text"))
    good = good.filter((F.length("full_text") >= 20) & ~is_poison(F.col("full_text")))
    good = good.withColumns({
        "law_id": law_id(F.col("doc_type"), F.col("act_number"), F.col("act_year")), "parent_text": F.substring("full_text", 1, 12000),
        "head": prefix(F.col("doc_type"), F.col("act_number"), F.col("act_year"), F.col("issuing_authority"), F.col("issue_id")),
    })
    out = chunked(good, ["doc_type", "act_number", "act_year", "issuing_authority", "title", "law_id", "head", "parent_text"], token_counter)
    out = out.withColumn("text_embedded", F.concat_ws(" ", "head", "text")).withColumn("parts", path_parts(F.col("path"))).drop("head")
    return out if tables is None else out.unionByName(table_chunks(tables), allowMissingColumns=True)


def issue_coverage(acts: DataFrame, raw: DataFrame) -> DataFrame:
    """issue_id, coverage_ratio: characters of an issue's acts by those of its
    raw text (rows of issue_id, raw; lengths are summed, texts stay apart)."""
    mapped = acts.groupBy("issue_id").agg(F.sum(dense_length(F.col("full_text"))).alias("m"))
    whole = raw.groupBy("issue_id").agg(F.sum(dense_length(F.col("raw"))).alias("n"))
    return whole.join(mapped, "issue_id", "left").select("issue_id", F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.least(F.coalesce("m", F.lit(0)) / F.col("n"), F.lit(1.0))).alias("coverage_ratio"))
