"""Quality of retrieval, answers, extraction and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_trigrams, fold, let, mojibake_ratio
from ..session import parts

#: Bytes of keys, as Spark estimates them, that make a task.
KEYS_BYTES = 1 << 20


def retrieval_metrics(golden: DataFrame, ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), depth: int = 10) -> DataFrame:
    """n, hit_at_k, mrr_at_10, ndcg_at_10 of golden (query_id, target) under
    ranked (query_id, id, rank); beyond depth counts as a miss."""
    r = golden.join(ranked, (golden["query_id"] == ranked["query_id"]) & (golden["target"] == ranked["id"]), "left").select(golden["query_id"], F.when(F.col("rank") <= depth, F.col("rank")).alias("rank"))
    r = r.groupBy("query_id").agg(F.min("rank").alias("rank"))
    hits = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 4).alias(f"hit_at_{k}") for k in ks]
    return r.agg(F.count(F.lit(1)).alias("n"), *hits, F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 4).alias("mrr_at_10"), F.round(F.avg(F.coalesce(1 / F.log2(F.col("rank") + 1), F.lit(0.0))), 4).alias("ndcg_at_10"))


def sample_golden(chunks: DataFrame, n: int, seed: int = 42, least_tokens: int = 100) -> DataFrame:
    """n chunks of distinct laws, in an order that the seed fixes."""
    from pyspark.sql import Window

    rows = chunks.filter(F.col("n_tokens") >= least_tokens).withColumn("_h", F.xxhash64("chunk_id", F.lit(seed)))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("law_id").orderBy("_h", "chunk_id"))).filter("_r = 1")
    return first.orderBy("_h", "chunk_id").limit(n).drop("_h", "_r")


def answer_share(answer: Column, expected: Column, dots: bool = False) -> Column:
    """Share of expected's folded tokens of three characters in the answer."""
    plain = lambda c: fold(F.regexp_replace(c, r"(\d)\.(?=\d{3})", "$1") if dots else c)
    tokens = F.array_distinct(F.regexp_extract_all(plain(expected), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    hit = let(plain(answer), lambda a: F.size(F.filter(tokens, lambda t: a.contains(t))))
    return F.when(F.size(tokens) > 0, hit / F.size(tokens)).otherwise(F.lit(0.0))


def answer_status(share: Column, good: float = 0.6, partial: float = 0.3) -> Column:
    return F.when(share >= good, "CORRECT").when(share >= partial, "PARTIAL").otherwise("WRONG")


def token_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(fold(c), F.lit("[a-z]{3,}"), F.lit(0)))


def token_overlap(source: Column, produced: Column) -> Column:
    """precision, recall, f1 of distinct tokens; 0 for an empty source."""
    s, p = token_set(source), token_set(produced)
    both = F.size(F.array_intersect(s, p))
    ok = (F.size(s) > 0) & (F.size(p) > 0)
    zero = F.lit(0.0)
    return F.struct(
        F.when(ok, F.round(both / F.size(p), 6)).otherwise(zero).alias("precision"), F.when(ok, F.round(both / F.size(s), 6)).otherwise(zero).alias("recall"),
        F.when(ok & (both > 0), F.round(2 * both / (F.size(s) + F.size(p)), 6)).otherwise(zero).alias("f1"),
    )


def by_era(rows: DataFrame, *measures: str, era: str = "era") -> DataFrame:
    """Averages per era and of all (era null), as one rollup."""
    return rows.rollup(era).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in measures))


def act_score(acts: DataFrame) -> DataFrame:
    """score (0 to 4) and the fields that fail."""
    checks = {"number": ~F.coalesce("act_number", F.lit("")).isin("", "0"), "type": F.col("doc_type") != "UNKNOWN", "title": F.length("title") > 10, "authority": F.coalesce("issuing_authority", F.lit("")) != ""}
    return acts.withColumn("score", sum(F.when(c, 1).otherwise(0) for c in checks.values())).withColumn("failed", F.array_compact(F.array(*(F.when(~c, F.lit(n)) for n, c in checks.items()))))


def compare_pipelines(rows: DataFrame, value: str, pipelines: list[str]) -> DataFrame:
    """era, one column per pipeline with the average, and the last one's gain."""
    out = rows.groupBy("era").pivot("pipeline", pipelines).agg(F.round(F.avg(value), 6))
    return out.withColumn("gain", F.round(F.col(pipelines[-1]) - F.col(pipelines[0]), 6))


def identity_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Keys that only one side has: change is removed or added. One grouping of
    both sides' keys, dealt into parts that don't grow with them."""
    o, n = old.select(*key).withColumn("_s", F.lit("removed")), new.select(*key).withColumn("_s", F.lit("added"))
    rows = o.union(n).repartition(parts(o, n, size=KEYS_BYTES), *key)
    return rows.groupBy(*key).agg(F.min("_s").alias("change"), F.max("_s").alias("_t")).filter("change = _t").drop("_t")


def trigram_overlap(a: Column, b: Column) -> Column:
    x, y = char_trigrams(fold(a)), char_trigrams(fold(b))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.round(F.size(F.array_intersect(x, y)) / union, 6)).otherwise(F.lit(0.0))


def structure(markdown: Column) -> Column:
    """Headings, table rows and articles of a Markdown text."""
    return F.struct(F.regexp_count(markdown, F.lit(r"(?m)^#{1,6}\s")).alias("headings"), F.regexp_count(markdown, F.lit(r"(?m)^\s*\|.*\|\s*$")).alias("table_rows"), F.regexp_count(markdown, F.lit(r"(?im)^\s*art\.")).alias("articles"))


def issue_audit(acts: DataFrame, toc_match: DataFrame) -> DataFrame:
    """Per issue: acts, generic titles, mojibake, unmatched acts."""
    generic = F.col("title").isin("ORDIN", "DECRET", "LEGE", "HOTARARE", "DECIZIE")
    own = acts.groupBy("issue_id").agg(F.count(F.lit(1)).alias("acts"), F.count_if(generic).alias("generic_titles"), F.round(F.avg(mojibake_ratio(F.col("full_text"))), 6).alias("mojibake"))
    found = toc_match.groupBy("issue_id").agg(F.count_distinct("act_index").alias("matched"))
    return own.join(found, "issue_id", "left").withColumn("phantom", F.col("acts") - F.coalesce("matched", F.lit(0))).drop("matched")


def drift(run: DataFrame, baseline: DataFrame, key: str, tolerance: float = 0.2) -> DataFrame:
    """key, share, base_share, drifted: histogram of a run against a baseline's."""
    share = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("t")))).select(key, F.round(F.col("c") / F.col("t"), 6).alias(name))
    both = share(run, "share").join(share(baseline, "base_share"), key, "full_outer").fillna(0.0, ["share", "base_share"])
    return both.withColumn("drifted", F.abs(F.col("share") - F.col("base_share")) > F.lit(tolerance) * F.greatest("base_share", F.lit(0.01)))


def status_histogram(answers: DataFrame) -> DataFrame:
    """status, n and share of a run's answers."""
    n = answers.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(answers.agg(F.count(F.lit(1)).alias("_all")))).select("status", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))
