"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are no part of a word [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ become a
#: space, A-Z become a-z; what str.split leaves are then the words.
ALNUM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)

#: Java / RE2 form of a word between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Most bytes of text that one Arrow batch should hold.
BATCH_BYTES = 16 << 20
BATCH_ROWS = 2000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where the session names none,
    a local master gets a folder of its own; a cluster has to name one."""
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


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint; for small tables."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table written there."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a Parquet table in the shared folder; for
    tables that are too large for a checkpoint's uncompressed files."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most rows rows and about BATCH_BYTES."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * BATCH_BYTES // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow over batches that are bounded in rows and bytes; the session's
    own settings stay as they are."""
    return df.mapInArrow(lambda batches: fn(pieces(batches, rows)), schema)


def give_back() -> None:
    """Return to the system what earlier tasks of this process have freed:
    Arrow's pool and the C library keep it otherwise, and workers are reused."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name a column name that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def every(df: DataFrame) -> list[Column]:
    """df's columns, whatever they are called."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column's values as bytes, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def held_out(modulus: int, remainder: int) -> Column:
    """crc32 of doc_id as text, modulo; false for a null doc_id."""
    return F.coalesce(
        F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder,
        F.lit(False),
    )


def chunks(items: Iterable, size: int) -> Iterator[list]:
    block: list = []
    for x in items:
        block.append(x)
        if len(block) >= size:
            yield block
            block = []
    if block:
        yield block


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS = np.ones(1, np.uint64)
_SPACE = np.ones(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd multiplier, modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        factors = np.full(max(n, 64), 0x9E3779B97F4A7C15, np.uint64)
        factors[0] = 1
        _POWERS = np.cumprod(factors, dtype=np.uint64)
    return _POWERS[:n]


def word_spans(data: np.ndarray, inside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes whose table entry is true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside[data], [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span; spans don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    own = data[place + np.repeat(starts, sizes)].astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(own * powers(int(sizes.max()))[place], first) + sizes.astype(np.uint64) * _MIX2)
