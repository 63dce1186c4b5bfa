"""License scan: an exact set-similarity join of text blocks with templates.

A template is a set of words (a notice, or a paragraph of a licence), a block is
a line or a paragraph (a run of lines that are not blank). A block meets a
template when it holds at least CONTAINED of the template's words. Words are put
in the global order of their document frequency, rarest first. A block that
meets a template of m words with an overlap of o must hold one of its first
m - o + 1 words (prefix filter) and have o of the templates' words itself
(length filter); words of the block are looked up in that order, and at each one
that is shared the overlap can't exceed the shared ones so far and the fewer of
the words that follow in the template and in the block (positional filter). What
passes is verified.

Defined cases: null texts are empty; an empty text has no words, no labels and
score 0; a base phrase without a template scores PHRASE_SCORE; repeated rows get
equal results; equally frequent words are ordered by their bytes; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, map_arrow, utf8
from .notices import NOTICES as TEMPLATES

#: Share of a template's words that a block must hold.
CONTAINED = 0.8
PHRASE_SCORE = 0.5
#: More templates than this are refused: they are broadcast.
MOST_TEMPLATES = 10_000

#: The base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_TABLE).split()


def template_sets(templates) -> list[tuple[str, frozenset[bytes]]]:
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; at most {MOST_TEMPLATES} can be broadcast")
    return [(label, frozenset(words_of(text.encode()))) for label, text in templates]


def document_frequency(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each of the templates' words occurs."""

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for text in utf8(batch.column(0)):
                if text:
                    found.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_pydict({"w": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})

    rows = map_arrow(docs.select(F.col("text").cast("string")), count, "w binary, n long")
    return {bytes(r.w): r.n for r in rows.groupBy("w").agg(F.sum("n").alias("n")).toLocalIterator()}


class Index:
    """What the filters need of the templates: the rank of every word, the
    prefix words with (template, place), sizes and least overlaps."""

    def __init__(self, sets, frequency: dict[bytes, int], contained: float):
        self.sets = sets
        vocabulary = frozenset().union(*(words for _, words in sets))
        self.rank = {w: n for n, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
        self.need = [math.ceil(contained * len(words) - 1e-9) for _, words in sets]
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for n, (_, words) in enumerate(sets):
            for at, w in enumerate(sorted(words, key=self.rank.get)[: len(words) - self.need[n] + 1]):
                self.prefix.setdefault(w, []).append((n, at))
        self.vocabulary, self.first = vocabulary, frozenset(self.prefix)

    def candidates(self, block: set[bytes]) -> tuple[set[int], set[int]]:
        """Templates that pass all filters, and those that only the positional
        filter leaves out."""
        known = sorted(self.vocabulary & block, key=self.rank.get)
        shared: dict[int, int] = {}
        out: set[int] = set()
        for at, w in enumerate(known):
            for n, place in self.prefix.get(w, ()):
                need = self.need[n]
                if len(known) < need or n in out:
                    continue
                so_far = shared[n] = shared.get(n, 0) + 1
                if so_far + min(len(self.sets[n][1]) - place - 1, len(known) - at - 1) < need:
                    out.add(n)
        return shared.keys() - out, out

    def match(self, block: set[bytes]) -> dict[int, float]:
        """Containment of each template that the block meets."""
        out = {}
        if not self.first.isdisjoint(block):
            for n in self.candidates(block)[0]:
                words = self.sets[n][1]
                both = len(words & block)
                if both >= self.need[n]:
                    out[n] = both / len(words)
        return out


def blocks_of(text: bytes):
    """(start, end) of every line, and of every paragraph of several lines."""
    at, begin, lines, end = 0, 0, 0, 0
    for line in [*text.split(b"\n"), b""]:
        if line.strip():
            yield at, at + len(line)
            begin = begin if lines else at
            lines, end = lines + 1, at + len(line)
        elif lines:
            if lines > 1:
                yield begin, end
            lines = 0
        at += len(line) + 1


def phrase_places(words: list[bytes], phrases) -> list[tuple[int, str]]:
    out = []
    for phrase, label in phrases:
        own = phrase.encode().split()
        at = -1
        try:
            while True:
                at = words.index(own[-1], at + 1)
                start = at - len(own) + 1
                if start >= 0 and words[start : at + 1] == own:
                    out.append((start, label))
        except ValueError:
            pass
    return out


def scan_text(text: bytes, index: Index, phrases):
    """(number of words, base places, spans met as (start, end, label, containment))."""
    words = words_of(text)
    present = set(words)
    places = phrase_places(words, phrases) if any(p.encode().split()[-1] in present for p, _ in phrases) else []
    spans = []
    if not index.first.isdisjoint(present):
        for start, end in blocks_of(text):
            for n, share in index.match(set(words_of(text[start:end]))).items():
                spans.append((start, end, index.sets[n][0], share))
    return len(words), places, spans


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, contained: float = CONTAINED) -> DataFrame:
    """doc_id, n_words, base (places as word, label), spans (blocks met, as
    byte offsets with label and containment) for every document."""
    sets = template_sets(templates)
    vocabulary = frozenset().union(*(w for _, w in sets))
    index = Index(sets, document_frequency(docs, vocabulary), contained)
    place = pa.struct([("word", pa.int64()), ("label", pa.string())])
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])

    def run(batches):
        for batch in batches:
            n, base, met = [], [], []
            for text in utf8(batch.column("text")):
                count, places, spans = scan_text(text or b"", index, phrases)
                n.append(count)
                base.append([{"word": w, "label": x} for w, x in places])
                met.append([{"start": a, "end": b, "label": x, "containment": c} for a, b, x, c in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(base, pa.list_(place)), pa.array(met, pa.list_(span))], names=["doc_id", "n_words", "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, n_words long, base array<struct<word:long,label:string>>, spans array<struct<start:long,end:long,label:string,containment:double>>")


def report(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = scan(docs, templates)
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "spans.label")).alias("labels"),
        F.greatest(F.coalesce(F.array_max("spans.containment"), F.lit(0.0)), F.when(F.size("base") > 0, F.lit(PHRASE_SCORE)).otherwise(0.0)).alias("score"),
    )


def sql(templates=TEMPLATES, phrases=PHRASES) -> str:
    """DuckDB's SQL for report(): every line and paragraph with every template."""
    sets = template_sets(templates)
    rows = ", ".join(f"({n}, '{label}', {[w.decode() for w in sorted(words)]}, {math.ceil(CONTAINED * len(words) - 1e-9)})" for n, (label, words) in enumerate(sets))
    at = lambda own: " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(own))
    places = " UNION ALL ".join(f"SELECT rid, i, '{label}' AS label FROM i WHERE {at(phrase.split())}" for phrase, label in phrases)
    words = "coalesce(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])".format
    return f"""
WITH t(id, label, words, need) AS (VALUES {rows}), d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid, {words("text")} AS w FROM documents
), i AS (
  SELECT rid, w, unnest(range(len(w))) AS i FROM d WHERE list_contains(w, 'license')
), b AS ({places}), l AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d
), r AS (
  SELECT *, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS filled, sum(CASE WHEN regexp_matches(line, '[^\\x20\\x09-\\x0D]') THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY n) AS run FROM l
), k AS (
  SELECT rid, line AS block FROM r WHERE filled UNION ALL SELECT rid, string_agg(line, chr(10) ORDER BY n) FROM r WHERE filled GROUP BY rid, run HAVING count(*) > 1
), v AS (
  SELECT rid, list_distinct({words("block")}) AS own FROM k
), m AS (
  SELECT rid, label, len(list_intersect(own, words)) * 1.0 / len(words) AS share FROM v, t WHERE len(own) >= need AND len(list_intersect(own, words)) >= need
), bs AS (
  SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM b GROUP BY rid
), bl AS (
  SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT rid, label FROM b) GROUP BY rid
), al AS (
  SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM b UNION SELECT rid, label FROM m) GROUP BY rid
), sc AS (
  SELECT rid, max(share) AS share FROM m GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(bl.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
  greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN {PHRASE_SCORE} ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN bs USING (rid) LEFT JOIN bl USING (rid) LEFT JOIN al USING (rid) LEFT JOIN sc USING (rid)
"""
