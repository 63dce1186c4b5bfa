"""Quality rules with thresholds from mergeable quantile sketches.

For each document four rates are taken as whole numbers (characters a word,
symbols and repeated words per hundred words, repeated lines per hundred
lines). A sketch is a histogram with buckets of a relative width of 1/32 (whole
numbers below 64 exactly): it is merged by adding counts, so sketches per
language and source add up to those per language and of all. A group's fences
are Tukey's, FENCE quartile distances outside the quartiles, at least a stated
width, as the quartiles of clean text often coincide (all three quarters at no
symbols, repeated words or lines); each width is under what the base rules
refuse, so that every fence can be the one that decides; a group with fewer than LEAST_GROUP documents takes its language's, and
a small language that of all. A document is kept if it passes the base rules
and lies inside its group's fences.

Defined cases: null texts have no words and fail; null languages and sources
are groups of their own; rates of a text without words or lines are 0; ties and
repeated rows count as often as they are there; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SPACE = r"[\x20\x09-\x0D]+"
N = 5
FENCE = 3
LEAST_GROUP = 50
#: Rate -> (least distance of the lower fence, of the upper one) from the
#: quartile; null: no such fence.
WIDTHS = {"word_length": (150, 200), "symbol_rate": (None, 10), "repeat_rate": (None, 15), "line_rate": (None, 45)}
#: Groups up to which their fences are broadcast.
MOST_BROADCAST = 100_000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts, n_lines (with a word)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    rows = rows.withColumn("_w", F.array_remove(F.split("text", SPACE), ""))
    rows = rows.withColumn("_l", F.filter(F.split("text", "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0))
    at = F.when(F.size("_w") >= N, F.sequence(F.lit(0), F.size("_w") - N)).otherwise(F.array().cast("array<int>"))
    word = lambda i, k: F.get(F.col("_w"), i + k)
    rows = rows.withColumn("_h", F.transform(at, lambda i: F.xxhash64(*(word(i, k) for k in range(N)))))
    # only texts with an equal pair of windows need their places
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    placed = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.select(
        "doc_id", "lang", "source", F.size("_w").cast("long").alias("n_words"), F.size("_l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(twice, F.array_sort(placed)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("_s"),
    )
    same = lambda x, j: F.coalesce(F.get(F.col("_s"), j)["h"] == x["h"], F.lit(False))
    rows = rows.withColumn("_p", F.array_sort(F.transform(F.filter("_s", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])))
    steps = F.transform("_p", lambda x, j: F.least(F.coalesce(F.get(F.col("_p"), j + 1) - x, F.lit(N)), F.lit(N)))
    return rows.select("doc_id", "lang", "source", "n_lines", *BASE[:-1], F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"))


def rate(over: str, under: str) -> Column:
    return F.when(F.col(under) > 0, F.expr(f"(100 * {over}) div {under}")).otherwise(F.lit(0).cast("long"))


def with_rates(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "word_length": rate("word_chars", "n_words"),
        "symbol_rate": rate("n_symbols", "n_words"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
        "line_rate": rate("n_dup_lines", "n_lines"),
    })


def sketches(rows: DataFrame) -> DataFrame:
    """level (0 all, 1 language, 2 language and source), lang, source, rate,
    bucket (its least value), n: what is merged by adding n."""
    bits = "greatest(length(bin(v)) - 6, 0)"
    long = rows.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), F.col(r).alias("v")) for r in WIDTHS))).alias("x")).select("lang", "source", "x.rate", "x.v")
    own = cut(long.withColumn("bucket", F.expr(f"shiftleft(shiftright(v, {bits}), {bits})")).groupBy("lang", "source", "rate", "bucket").agg(F.count(F.lit(1)).alias("n")))
    none = F.lit(None).cast("string")
    merged = lambda level, lang: own.groupBy(lang.alias("lang"), "rate", "bucket").agg(F.sum("n").alias("n")).select(F.lit(level).alias("level"), "lang", none.alias("source"), "rate", "bucket", "n")
    return own.select(F.lit(2).alias("level"), "lang", "source", "rate", "bucket", "n").union(merged(1, F.col("lang"))).union(merged(0, none))


def fences(sketch: DataFrame) -> DataFrame:
    """level, lang, source, n and for each rate its lower and upper fence."""
    group = ["level", "lang", "source", "rate"]
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy("bucket"))
    total = F.sum("n").over(Window.partitionBy(*group))
    rows = sketch.withColumns({"_c": upto, "_n": total})
    q = rows.groupBy(*group).agg(F.max("_n").alias("n"), F.min(F.when(4 * F.col("_c") >= F.col("_n"), F.col("bucket"))).alias("q1"), F.min(F.when(4 * F.col("_c") >= 3 * F.col("_n"), F.col("bucket"))).alias("q3"))
    reach = FENCE * (F.col("q3") - F.col("q1"))
    out = []
    for r, (down, up) in WIDTHS.items():
        here = F.col("rate") == r
        lower = F.lit(None).cast("long") if down is None else F.max(F.when(here, F.col("q1") - F.greatest(reach, F.lit(down))))
        out += [lower.alias(f"{r}_lower"), F.max(F.when(here, F.col("q3") + F.greatest(reach, F.lit(up)))).alias(f"{r}_upper")]
    return q.groupBy("level", "lang", "source").agg(F.max("n").alias("n"), *out)


def judge(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows with base_failed and kept, by their group's fences."""
    bounds = [f"{r}_{side}" for r in WIDTHS for side in ("lower", "upper")]
    pick = F.struct(*bounds)
    whole = limits.filter("level = 0").select(F.struct(*bounds).alias("_all"))
    by_lang = limits.filter("level = 1").select(F.col("lang").alias("_l1"), F.when(F.col("n") >= LEAST_GROUP, pick).alias("_lang"))
    own = limits.filter("level = 2").select(F.col("lang").alias("_l2"), F.col("source").alias("_s2"), F.when(F.col("n") >= LEAST_GROUP, pick).alias("_own"))
    chosen = own.join(by_lang, F.col("_l2").eqNullSafe(F.col("_l1"))).join(F.broadcast(whole))
    chosen = cut(chosen.select("_l2", "_s2", F.coalesce("_own", "_lang", "_all").alias("_f")))
    if chosen.count() <= MOST_BROADCAST:
        chosen = F.broadcast(chosen)
    joined = rows.join(chosen, F.col("lang").eqNullSafe(F.col("_l2")) & F.col("source").eqNullSafe(F.col("_s2")), "left")
    inside = F.lit(True)
    for r in WIDTHS:
        inside &= F.coalesce(F.col(r) >= F.col("_f")[f"{r}_lower"], F.lit(True)) & F.coalesce(F.col(r) <= F.col("_f")[f"{r}_upper"], F.lit(True))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & inside)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept."""
    rows = cut(with_rates(measures(docs)))
    return judge(rows, fences(sketches(rows))).select("doc_id", *BASE, "base_failed", "kept")


#: DuckDB's SQL for report().
SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), p AS (
  SELECT rid, unnest(range(len(ws) - 4)) AS i, ws FROM w WHERE len(ws) >= 5
), g AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(ws[i + 1 : i + 5], ' ')) AS c FROM p
), r AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM g, (SELECT unnest(range(5)) AS k) WHERE c >= 2 GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, len(ls)::BIGINT AS n_lines,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)
), f AS (
  SELECT *, CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_length,
    CASE WHEN n_words > 0 THEN 100 * n_symbols // n_words ELSE 0 END AS symbol_rate,
    CASE WHEN n_words > 0 THEN 100 * n_repeat_words // n_words ELSE 0 END AS repeat_rate,
    CASE WHEN n_lines > 0 THEN 100 * n_dup_lines // n_lines ELSE 0 END AS line_rate
  FROM m
), u AS (
  SELECT lang, source, unnest(['word_length', 'symbol_rate', 'repeat_rate', 'line_rate']) AS rate,
    unnest([word_length, symbol_rate, repeat_rate, line_rate]) AS v FROM f
), b AS (
  SELECT lang, source, rate, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bucket, count(*) AS n
  FROM u GROUP BY ALL
), s AS (
  SELECT 2 AS level, lang, source, rate, bucket, n FROM b
  UNION ALL SELECT 1, lang, NULL, rate, bucket, sum(n) FROM b GROUP BY lang, rate, bucket
  UNION ALL SELECT 0, NULL, NULL, rate, bucket, sum(n) FROM b GROUP BY rate, bucket
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bucket) AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, rate) AS total FROM s
), q AS (
  SELECT level, lang, source, rate, max(total) AS n, min(bucket) FILTER (4 * upto >= total) AS q1,
    min(bucket) FILTER (4 * upto >= 3 * total) AS q3 FROM c GROUP BY level, lang, source, rate
), l AS (
  SELECT level, lang, source, max(n) AS n,
    max(q1 - greatest(3 * (q3 - q1), 150)) FILTER (rate = 'word_length') AS wl,
    max(q3 + greatest(3 * (q3 - q1), 200)) FILTER (rate = 'word_length') AS wu,
    max(q3 + greatest(3 * (q3 - q1), 10)) FILTER (rate = 'symbol_rate') AS su,
    max(q3 + greatest(3 * (q3 - q1), 15)) FILTER (rate = 'repeat_rate') AS ru,
    max(q3 + greatest(3 * (q3 - q1), 45)) FILTER (rate = 'line_rate') AS lu
  FROM q GROUP BY level, lang, source
), k AS (
  SELECT f.*, CASE WHEN l2.n >= 50 THEN [l2.wl, l2.wu, l2.su, l2.ru, l2.lu] WHEN l1.n >= 50 THEN [l1.wl, l1.wu, l1.su, l1.ru, l1.lu]
    ELSE [l0.wl, l0.wu, l0.su, l0.ru, l0.lu] END AS x,
    (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed
  FROM f JOIN l AS l2 ON l2.level = 2 AND l2.lang IS NOT DISTINCT FROM f.lang AND l2.source IS NOT DISTINCT FROM f.source
    JOIN l AS l1 ON l1.level = 1 AND l1.lang IS NOT DISTINCT FROM f.lang JOIN l AS l0 ON l0.level = 0
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND word_length >= x[1] AND word_length <= x[2] AND symbol_rate <= x[3] AND repeat_rate <= x[4] AND line_rate <= x[5]) AS kept
FROM k
"""
