"""Column functions that normalise text: folding, spacing, code-point repair,
markup removal. All of them stay inside the JVM; null gives null."""

from __future__ import annotations


import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Letters that decompose to one base letter, and these; combining marks
    come last, without a counterpart, so that translate() deletes them."""
    source, target = [], []
    for code in range(0xC0, 0x2000):
        c = chr(code)
        if c.isalpha() and c.lower() == c:
            base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if len(base) == 1 and base != c:
                source.append(c)
                target.append(base)
    marks = [chr(c) for c in range(0x300, 0x370)]
    return "".join(source + marks), "".join(target)


FOLD_FROM, FOLD_TO = _fold_table()


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once a row, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(c: Column) -> Column:
    """Lower case without accents, for search and comparison. Text of one byte
    a character has none, and translate() looks up each character."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(F.lower(c), FOLD_FROM, FOLD_TO))


def fold_heading(c: Column) -> Column:
    """Upper case without accents, 1 and l read as I, for heading keywords."""
    return F.translate(F.upper(fold(F.translate(c, "l", "I"))), "1", "I")


def match_key(c: Column) -> Column:
    """Upper-case letters and digits only."""
    return F.upper(F.regexp_replace(fold(c), "[^a-z0-9]", ""))


def fold_ws(c: Column) -> Column:
    """Folded, without white space and the marks that layout leaves."""
    return F.regexp_replace(fold(c), r"[\s\-–—|*#>_]", "")


def strip_all(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def join_spaced(c: Column) -> Column:
    """Runs of three or more single letters with a space between lose it: first
    those between two inner letters, then those at a run's ends."""
    one = "[A-Za-zĂÂÎȘȚăâîșț]"
    run = rf"(?<!\S)({one}) (?={one} {one}(?!\S))"
    marked = F.regexp_replace(c, run, "$1\x01")
    return F.regexp_replace(F.regexp_replace(marked, rf"(?<=\x01{one}) (?={one}(?!\S))", ""), "\x01", "")


def strip_letterspacing(c: Column) -> Column:
    """A string whose tokens all have one or two characters is one word."""
    words = F.split(F.trim(c), r"\s+")
    spaced = (F.size(words) >= 3) & F.forall(words, lambda w: F.length(w) <= 2)
    return F.when(spaced, F.array_join(words, "")).otherwise(c)


def fix_fi(c: Column) -> Column:
    """A T with comma that came out as fi, between capitals or before an
    apostrophe."""
    capital = "[A-ZĂÂÎȘȚ]"
    return F.regexp_replace(F.regexp_replace(c, f"(?<={capital})fi(?={capital})", "Ț"), r"(?U)\bfi(?=')", "Ț")


#: Code points that broken fonts of two eras print, what they
#: stand for, and the old cedilla spellings with the right ones.
ERA_POINTS = {
    "broken_2002": ("ãºþªÞÃÑ\x93\x94", 'ășțȘȚĂ—""'),
    "broken_2007": ("„∫˛ÓŒˇ‚√¬™ﬁ", "ășțîÎȚâĂÂȘȚ"),
}
CEDILLA = ("şţŞŢ", "șțȘȚ")

NOISE = "[\\u2460-\\u24ff\\u25a0-\\u25ff\\u3000-\\u9fff\\uff00-\\uffef]"


def strip_noise(c: Column) -> Column:
    """Without ideographs, full-width, enclosed and geometric characters."""
    return F.regexp_replace(c, NOISE, "")


def normalize_text(c: Column, era: Column) -> Column:
    """Code points by era, cedillas to commas, spaced words joined; in broken
    eras noise goes and, in the later one, the fi ligature comes back."""
    out = c
    for name, (wrong, right) in ERA_POINTS.items():
        out = F.when(era == name, F.translate(out, wrong, right)).otherwise(out)
    out = join_spaced(F.translate(out, *CEDILLA))
    out = F.when(era.startswith("broken"), strip_noise(out)).otherwise(out)
    return F.when(era == "broken_2007", fix_fi(out)).otherwise(out)


def repair_legacy(c: Column) -> Column:
    """The later era's table where its signs outweigh letters that use them."""
    wrong, right = ERA_POINTS["broken_2007"]
    signs = F.length(c) - F.length(F.translate(c, wrong, ""))
    return F.translate(F.when(signs >= 3, F.translate(c, wrong, right)).otherwise(c), *CEDILLA)


def mojibake_ratio(c: Column) -> Column:
    """Share of characters that only broken fonts leave."""
    n = F.length(c)
    return F.when(n > 0, (n - F.length(F.translate(c, "ãþºªÞ∫˛ˇ√�", ""))) / n).otherwise(F.lit(0.0))


def strip_markdown(c: Column) -> Column:
    """Without images, fences, code marks, emphasis and heading marks."""
    for pattern, to in (
        (r"!\[[^\]]*\]\([^)]*\)", ""), (r"(?m)^```[^\n]*\n?", ""), (r"`([^`\n]*)`", "$1"),
        (r"\*\*([^*\n]+)\*\*", "$1"), (r"__([^_\n]+)__", "$1"), (r"(?m)^#{1,6}[ \t]+", ""),
    ):
        c = F.regexp_replace(c, pattern, to)
    return c


def flatten_tables(c: Column, between: str = "\t") -> Column:
    """Pipe rows as cells with a tab between, without separator rows."""
    c = F.regexp_replace(c, r"(?m)^[ \t]*\|[ \t:|-]+\|[ \t]*(?:\n|$)", "")
    c = F.regexp_replace(c, r"(?m)^[ \t]*\|[ \t]*|[ \t]*\|[ \t]*$", "")
    return F.regexp_replace(c, r"[ \t]*\|[ \t]*", between)


PAGE_BREAK = r"\n?<!--\s*page[^>]*-->\n?|\n-{3,}\s*page\s*-{3,}\n|\f"


def markdown_pages(c: Column) -> Column:
    """Plain text per page; pages without text go, none leaves the whole."""
    pages = F.filter(F.transform(F.split(c, PAGE_BREAK), lambda p: F.trim(flatten_tables(strip_markdown(p)))), lambda p: p != "")
    return F.when(F.size(pages) > 0, pages).otherwise(F.array(F.trim(c)))


def markdown_plain(c: Column) -> Column:
    """Markdown as plain text, cells two spaces apart."""
    return flatten_tables(strip_markdown(F.regexp_replace(c, r"<!--.*?-->", "")), "  ")


def strip_artifacts(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"<!--.*?-->", ""), r"(?m)^\s*(?:\*{3,}|-{3,}|_{3,})\s*$", "")


def clean_markers(c: Column) -> Column:
    """Without footnote and page marks; (n) paragraph marks stay."""
    return F.regexp_replace(F.regexp_replace(c, r"\[\^?\d+\]", ""), r"(?m)^\s*-\s*\d{1,4}\s*-\s*$", "")


def dehyphenate(c: Column) -> Column:
    """Words that a line end cut are joined."""
    return F.regexp_replace(c, r"(\p{L})-\n(\p{Ll})", "$1$2")


def normalize_heading(line: Column) -> Column:
    """A heading whose words are mostly single letters is letter-spaced."""
    words = F.filter(F.split(F.regexp_replace(line, r"^#+\s*", ""), r"\s+"), lambda w: w.rlike(r"^\p{L}+$"))
    single = F.size(F.filter(words, lambda w: F.length(w) == 1))
    spaced = line.rlike(r"^#+\s") & (F.size(words) >= 3) & (10 * single >= 7 * F.size(words))
    return F.when(spaced, F.concat(F.regexp_extract(line, r"^(#+\s*)", 1), F.array_join(words, ""))).otherwise(line)


def char_trigrams(c: Column) -> Column:
    n = F.length(c)
    return F.array_distinct(F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(c, i, F.lit(3)))).otherwise(F.array().cast("array<string>")))


def words(c: Column, pattern: str = "[a-z0-9]+") -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def try_json(c: Column, schema: str) -> Column:
    """JSON out of a model's answer: fences and end marks go, the first flat
    object counts; null if it is none."""
    body = F.regexp_replace(F.regexp_replace(c, r"</?s>|<\|[^|]*\|>", ""), r"(?s)```(?:json)?\s*|\s*```", "")
    flat = F.regexp_extract(body, r"(?s)\{[^{}]*\}", 0)
    some = F.when(flat != "", flat).otherwise(F.regexp_extract(body, r"(?s)\{.*\}", 0))
    return F.from_json(F.regexp_replace(some, r"[\x00-\x1f]", " "), schema, {"mode": "PERMISSIVE"})




#: Roles that sign with a comma; the place and date of a closing.
SIGNED = r"(?:Ministrul|Ministra|Președintele|Directorul\s+general|Guvernatorul|p\.\s+Ministrul|Secretarul\s+de\s+stat)[^\n]{0,120},"
DATED = r"Bucure[șs]ti,\s+\d{1,2}\s+\w+\s+\d{4}"
ORPHANED = "<!-- orphaned-signature -->"
#: Letters of a paragraph that may be an echo, look-back of a signature.
ECHO, LOOK_BACK = 120, 300


def drop_echoes(c: Column) -> Column:
    """Without fence lines and without paragraphs that came before: those of
    ECHO letters at least, without a number of an act."""
    def once(parts: Column) -> Column:
        def kept(keys: Column) -> Column:
            return F.array_join(F.filter(parts, lambda p, i: F.get(keys, i).isNull() | (F.array_position(keys, F.get(keys, i)) == i + 1)), "\n\n")

        key = lambda p: F.lower(F.regexp_replace(p, r"(?U)\W+", ""))
        return let(F.transform(parts, lambda p: F.when((F.length(key(p)) >= ECHO) & ~p.rlike(r"(?i)\bnr\.\s*\d"), key(p))), kept)

    return let(F.split(F.regexp_replace(c, r"(?m)^\s*```(?:markdown)?\s*$\n?", ""), r"\n\s*\n"), once)


def mark_orphaned(c: Column) -> Column:
    """ORPHANED after every signature line without a place and date in the
    LOOK_BACK characters before it."""
    def step(state, part):
        plain = F.translate(part, "\u0002", "")
        said = F.when(state["tail"].rlike(DATED), plain).otherwise(F.replace(part, F.lit("\u0002"), F.lit(f"\n{ORPHANED}")))
        return F.struct(F.concat(state["out"], said).alias("out"), F.right(F.concat(state["tail"], plain), F.lit(LOOK_BACK)).alias("tail"))

    def of(parts: Column) -> Column:
        start = F.struct(F.get(parts, F.lit(0)).alias("out"), F.right(F.get(parts, F.lit(0)), F.lit(LOOK_BACK)).alias("tail"))
        return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, step, lambda s: s["out"])

    return let(F.split(F.regexp_replace(c, rf"(?m)^({SIGNED})[^\S\n]*$", "\u0001$1\u0002"), "\u0001"), of)


def normalize_markdown(c: Column, era: Column) -> Column:
    """A document's Markdown made fit for segmentation: marker comments go, code
    points are put right by era, in the scanned era echoes go, runs of spaces
    inside body lines become one, signatures without a date are marked.
    (Headings of the scanned era are promoted by layout.promote_headings, words
    of the later broken era split by defusion.defuse.)"""
    out = normalize_text(F.regexp_replace(c, r"<!--\w+:[^>]+-->\n?", ""), era)
    out = F.translate(out, "\x82\x92\x93", "ășț")
    out = F.when(era == "scanned", drop_echoes(out)).otherwise(out)
    body = lambda x: ~(x.startswith("#") | x.startswith("|") | x.startswith("  "))
    lines = F.transform(F.split(out, "\n"), lambda x: F.when(body(x), F.regexp_replace(x, r"(?<=\S) {2,}(?=\S)", " ")).otherwise(x))
    return mark_orphaned(F.array_join(lines, "\n"))


#: Running header (on pages after the first), start of the colophon,
#: marks of OCR and footnotes; (n) stays, as it numbers a paragraph.
RUNNING = r"(?iu)MONITORUL\s+OFICIAL\s+AL\s+ROM[ÂA]NIEI,?\s*PARTEA\s+I,?\s*Nr\.\s*\d+[^\n]*\n"
COLOPHON = r"(?is)(?:EDITOR:\s*PARLAMENTUL|Monitorul Oficial R\.A\.|Pre[tț]ul:|ABONAMENTE).*"
MARKS = r"<[^>]{1,12}>|\[\d{1,3}\]|(?<!\S)\*(?!\S)|\bcite\b"


def strip_structural(pages: Column) -> Column:
    """Pages without running headers (the first keeps its own), lone page
    numbers, the colophon to the page's end, and marks."""
    def page(p: Column, i: Column) -> Column:
        out = F.when(i > 0, F.regexp_replace(p, RUNNING, "")).otherwise(p)
        for pattern in (r"(?m)^\s*\d{1,3}\s*$", COLOPHON, MARKS):
            out = F.regexp_replace(out, pattern, "")
        return strip_all(strip_artifacts(out))

    return F.transform(pages, page)


#: Cedillas and signs of broken fonts, and what they stand for.
AUDIT_POINTS = ("şţŞŢ˛∫˚", "șțȘȚțșț")


def normalize_audit(c: Column) -> Column:
    """Spellings that an audit of coverage takes as one."""
    return F.translate(c, *AUDIT_POINTS)


def strip_issn_lines(c: Column) -> Column:
    """Without lines that name an ISSN."""
    return F.regexp_replace(c, r"(?im)^[^\n]*\bI\.?S\.?S\.?N\.?\b[^\n]*$\n?", "")
