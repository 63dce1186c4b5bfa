"""Words that extraction has run together, taken apart again."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold

#: Least token, longest and shortest part, most parts, margin.
LEAST, LONGEST, SHORTEST, MOST, MARGIN = 18, 20, 3, 6, 2.0
#: Words of the lexicon that are kept: the most frequent; it is broadcast.
LEXICON = 200_000


def lexicon(docs: DataFrame, text: str) -> DataFrame:
    """word, cost: -ln of a folded word's share of all words."""
    counts = docs.select(F.explode(F.regexp_extract_all(fold(F.col(text)), F.lit("[a-z]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("word", F.round(-F.log(F.col("n") / F.col("t")), 6).alias("cost"))


def split_token(token: str, cost: dict[str, float], base: float) -> list[str] | None:
    """Parts of a token if two to six known words explain it better by the
    margin than one unknown word; dynamic programme over its cuts."""
    n = len(token)
    best: list[tuple[float, int]] = [(0.0, 0)] + [(math.inf, 0)] * n
    for end in range(1, n + 1):
        for start in range(max(0, end - LONGEST), end - SHORTEST + 1):
            part = cost.get(token[start:end], base + 3.0 * (end - start))
            if best[start][0] + part < best[end][0]:
                best[end] = (best[start][0] + part, start)
    if best[n][0] == math.inf:
        return None
    parts, end = [], n
    while end:
        parts.append(token[best[end][1] : end])
        end = best[end][1]
    parts.reverse()
    fits = 2 <= len(parts) <= MOST and all(p in cost for p in parts)
    return parts if fits and base + 2.0 * n - best[n][0] >= MARGIN else None


def defuse(docs: DataFrame, corpus: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, splits (token, parts): long unknown lower-case tokens split by
    the corpus's words; lines with numbers, headings or signatures stay."""
    words = lexicon(corpus, text).orderBy("cost", "word").limit(LEXICON)
    own = {r.word: r.cost for r in words.collect()}
    base = math.log(10) + max(own.values(), default=0.0)
    shipped = docs.sparkSession.sparkContext.broadcast((own, base))

    def run(batches):
        import re

        cost, unknown = shipped.value
        long_token, skip = re.compile(rf"[a-zà-ɏ]{{{LEAST},}}"), re.compile(r"^#|^\s*(?:Nr\.|p\. )|^\s*\d+\s*$")
        for pdf in batches:
            texts, splits = [], []
            for t in pdf[text]:
                found: list[dict] = []

                def put(m):
                    parts = None if m[0] in cost else split_token(m[0], cost, unknown)
                    if parts is None:
                        return m[0]
                    found.append({"token": m[0], "parts": parts})
                    return " ".join(parts)

                texts.append(None if t is None else "\n".join(x if skip.search(x) else long_token.sub(put, x) for x in t.split("\n")))
                splits.append(found)
            yield pd.DataFrame({key: pdf[key], text: texts, "splits": splits})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, {text} string, splits array<struct<token:string,parts:array<string>>>")
