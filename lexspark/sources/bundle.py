"""Files in and out: scans, JSON issues, bundles with manifests and checksums,
idempotent loads. Plain Parquet has no MERGE, so an upsert is a union with the
last row per key, written beside the old table or per partition."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import file_identity
from ..session import materialize

#: Versions with their own invalidation: a row is new if any differs.
VERSIONS = ("schema_version", "pipeline_version", "embedding_version")

ACT = "struct<act_index:int,doc_type:string,act_number:string,act_year:int,title:string,issuing_authority:string,full_text:string,extraction_warnings:array<string>>"
TOC_LINE = "struct<act_number:string,doc_type:string,title:string,page_start:int,page_end:int,category:string>"
ISSUE = f"gazette_id string, part string, number string, date string, sumar array<{TOC_LINE}>, acts array<{ACT}>, extraction_warnings array<string>"


@dataclass
class Settings:
    """What a load needs; environment overrides are the caller's."""

    root: str
    schema_version: str = "1.0"
    pipeline_version: str = "1.0"
    embedding_version: str = "1.0"
    options: dict[str, str] = field(default_factory=dict)


def scan_files(spark: SparkSession, root: str, glob: str = "*.pdf", limit: int | None = None) -> DataFrame:
    """path, sha256, identity of files below root, in order of path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rows = files.select("path", "length", F.sha2("content", 256).alias("sha256"), file_identity(F.col("path")).alias("identity"))
    return rows if limit is None else rows.orderBy("path").limit(limit)


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """Issues from JSON files; a file that can't be read has _corrupt_record."""
    return spark.read.schema(f"{ISSUE}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def issue_acts(issues: DataFrame) -> DataFrame:
    return issues.select(F.col("gazette_id").alias("issue_id"), F.explode("acts").alias("a")).select("issue_id", "a.*")


def issue_toc(issues: DataFrame) -> DataFrame:
    return issues.select(F.col("gazette_id").alias("issue_id"), F.posexplode("sumar").alias("toc_idx", "t")).select(
        "issue_id", "toc_idx", F.col("t.doc_type").alias("toc_type"), F.col("t.act_number").alias("toc_number"), F.col("t.title").alias("toc_title"), F.col("t.page_start").alias("page_start"), F.col("t.category").alias("category")
    )


def write_issues(issues: DataFrame, path: str, date: str = "date") -> None:
    parts = F.split(F.col(date), "-")
    issues.withColumns({"yyyy": parts[0], "mm": parts[1], "dd": parts[2]}).write.mode("overwrite").partitionBy("yyyy", "mm", "dd").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def last_wins(df: DataFrame, key: str | list[str], order: str | Column) -> DataFrame:
    """The last row of each key by order."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(F.desc(order) if isinstance(order, str) else order.desc())
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert(old: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """old with new's rows in place of those with their key."""
    return new if old is None else old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def with_key(df: DataFrame, *candidates: str) -> DataFrame:
    """df with _id, the first candidate that is there; a row without one fails."""
    key = F.coalesce(*(F.col(c).cast("string") for c in candidates if c in df.columns))
    return df.withColumn("_id", F.when(key.isNull(), F.raise_error(F.lit("row without an id"))).otherwise(key))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Last entry per doc_id, in order of first appearance (first_seq)."""
    rows = spark.read.json(path)
    first = rows.groupBy("doc_id").agg(F.min("seq").alias("first_seq"))
    return last_wins(rows, "doc_id", "seq").join(first, "doc_id")


def append_manifest(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def verify_checksums(spark: SparkSession, root: str, expected: DataFrame) -> DataFrame:
    """name, expected, found, ok of files (name, sha256)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    return expected.select("name", F.col("sha256").alias("expected")).join(found, "name", "left").withColumn("ok", F.coalesce(F.col("expected") == F.col("found"), F.lit(False)))


def pending(sources: DataFrame, state: DataFrame, key: str = "doc_id") -> DataFrame:
    """sources whose key, hash and versions state doesn't hold."""
    on = [key, "sha256", *(v for v in VERSIONS if v in sources.columns and v in state.columns)]
    return sources.join(state.select(*on).distinct(), on, "left_anti")


def load(spark: SparkSession, new: DataFrame, path: str, key: str, partition: str) -> None:
    """Upsert into the table at path, only in the partitions that new touches."""
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # a first load has no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is not None:
        touched = new.select(partition).distinct()
        old = materialize(old.join(touched, partition, "left_semi"))
    upsert(old, new, key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def emit_bundle(chunks: DataFrame, edges: DataFrame, issues: DataFrame, root: str) -> None:
    """An issue's three record kinds, by issue, and their manifest."""
    for name, df in (("gazettes", issues), ("chunks", chunks), ("edges", edges)):
        df.write.mode("overwrite").partitionBy("issue_id").option("compression", "gzip").json(f"{root}/{name}")
    counts = chunks.groupBy("issue_id").agg(F.count(F.lit(1)).alias("chunks"), F.sha2(F.concat_ws("", F.array_sort(F.collect_list(F.sha2("text", 256)))), 256).alias("sha256"))
    before = _manifest_end(chunks.sparkSession, f"{root}/manifest")
    append_manifest(counts.select(F.col("issue_id").alias("doc_id"), F.lit(before + 1).alias("seq"), "chunks", "sha256"), f"{root}/manifest")


def _manifest_end(spark: SparkSession, path: str) -> int:
    """The last seq of a manifest, 0 without one."""
    try:
        return spark.read.schema("seq long").json(path).agg(F.max("seq")).first()[0] or 0
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0


def save_markdown(docs: DataFrame, path: str) -> None:
    """Append doc_id, sha256 (of the source), era, markdown to the cache."""
    docs.select("doc_id", "sha256", "era", "markdown").write.mode("append").parquet(path)


def cached_markdown(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """sources (doc_id, sha256) with the cached markdown and era; null where the
    cache has none for this content (a changed source makes it stale)."""
    known = cache.groupBy("doc_id", "sha256").agg(F.max_by(F.struct("markdown", "era"), F.length("markdown")).alias("_m"))
    return sources.join(known, ["doc_id", "sha256"], "left").select(*sources.columns, F.col("_m.markdown").alias("markdown"), F.col("_m.era").alias("era"))


def match_files(issues: DataFrame, files: DataFrame) -> DataFrame:
    """issues (issue_id, stem, date yyyy-mm-dd) with path, the source file: the
    one below the date's folders, else the first by path that has the stem."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    own = files.select("path", name.alias("stem"), F.array_join(F.slice(F.split("path", "/"), -4, 3), "-").alias("_date"))
    by_date = own.groupBy("stem", F.col("_date").alias("date")).agg(F.min("path").alias("_exact"))
    by_name = own.groupBy("stem").agg(F.min("path").alias("_any"))
    out = issues.join(by_date, ["stem", "date"], "left").join(by_name, "stem", "left")
    return out.select(*issues.columns, F.coalesce("_exact", "_any").alias("path"))


def record_run(spark: SparkSession, path: str, run_id: str, stats: dict[str, int], failures: list[str]) -> None:
    row = spark.createDataFrame([(run_id, stats, failures)], "run_id string, stats map<string,bigint>, failures array<string>")
    row.withColumn("started_at", F.current_timestamp()).write.mode("append").parquet(path)


def recent(log: DataFrame, now: Column, days: int = 365) -> DataFrame:
    """Log rows (ts) that aren't older than days."""
    return log.filter(F.col("ts") > F.date_sub(now, days).cast("timestamp"))


def drop_tables(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
