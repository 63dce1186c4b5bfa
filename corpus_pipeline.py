"""From raw documents to token records: five stages, each an operator of
lexspark.llm over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexspark.llm import binary, common, decontam, mixing, ngramjoin, queries, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Null and empty texts score 0 and stay;
    without labels of both kinds all stay."""
    return toxicity.drop_toxic(docs, common.read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that with the least
    doc_id (a null one comes last; of several texts with one doc_id the one with
    the least fingerprint, of equal rows any). Rows without words all stay."""
    return ngramjoin.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a run of benchmark words go; null and wordless texts stay,
    null and wordless items find nothing."""
    return decontam.drop_contaminated(docs, common.read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once
    or twice. Texts without words stay once; a null source is a source; equal
    rows share their copies by place."""
    return mixing.mix(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token records: doc_id, start, n_tokens, ids_crc32 of each, as
    read back from the files. A row that the mix takes twice has two records; a
    null or empty text has the end id alone; a null doc_id comes first."""
    found = binary.encode(docs, queries.tokenizer_path(queries.BYTE_BPE))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", toxic),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", mix),
    ("token_binary", token_records),
]

#: Toxicity, mixing and tokenisation can't be said in SQL;
#: tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
