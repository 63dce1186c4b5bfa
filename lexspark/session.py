"""Sessions and the tables they see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's defaults; what the caller sets wins."""
    builder = SparkSession.builder.config(map=DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


#: Bytes that stand for a size that isn't known.
UNKNOWN = 1 << 50


def parts(*tables: DataFrame, size: int) -> int:
    """How many partitions of so many bytes of their files some tables make; two
    for each core at least. A fixed number isn't put together again, so tasks
    keep their size as tables grow and small tables still fill the cores. Rows
    that come from no file have no size that Spark knows, and count as none."""
    sizes = (int(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for t in tables)
    total = sum(s for s in sizes if s < UNKNOWN)
    return max(2 * tables[0].sparkSession.sparkContext.defaultParallelism, -(-total // size))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, set for the session's checkpoints.
    Where none is named a local master gets one of its own, which goes with the
    process; a cluster has to name one that all executors share."""
    import atexit
    import shutil
    import tempfile

    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return str(there.get())
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lexspark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return str(sc._jsc.sc().getCheckpointDir().get())


def materialize(df: DataFrame) -> DataFrame:
    """df's rows from a reliable checkpoint in the shared folder: what several
    later steps read is made once, and the plan starts anew."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
