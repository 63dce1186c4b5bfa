"""Token-ID output as length-delimited binary records, with an offset index.

A shard is a sequence of frames, one for each document:

    4 bytes  b"LXR1"
    8 bytes  length of the payload, little-endian unsigned
    4 bytes  masked CRC-32 of those 8 bytes
    payload  1 byte: bytes per id (2 or 4); 1 byte: kind of doc_id (0 none, 1 a
             number, 2 a text); 8 bytes: doc_id, or the length of its UTF-8
             bytes, which follow; then the ids, little-endian unsigned
    4 bytes  masked CRC-32 of the payload
    1 byte   b"\\n", the end of the frame

The mask is that of the TFRecord format: rotate right by 15, add 0xa282ead8.
Spark's own text writer puts the frames into files (it writes a row's bytes as
they are and the line feed after them), so that shards go to any file system
that Spark can write, by its commit protocol; a lost executor's attempt leaves
nothing behind. A task starts a new shard before a frame that would make the one
at hand larger than SHARD_BYTES, so that only a single frame can. Shards are
named by their place in the order of doc_id. The index table has shard, offset,
length, doc_id and n_tokens of every frame, for shuffled reads.

Defined cases: null texts are empty; an empty text has the end id alone; a null
doc_id sorts first; repeated doc_ids keep all their records, in an order that a
hash of the text and then of the place gives; a doc_id that is no whole number
is kept as text, in the order of its own type; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, map_arrow, scratch, span_hashes, stored, utf8
from .tokens import read_tokenizer

MAGIC = b"LXR1"
HEAD = struct.Struct("<4sQI")
META = struct.Struct("<BBq")
TAIL = 5
#: Bytes of text for one task, and of frames in one shard.
TASK_BYTES = 16 << 20
SHARD_BYTES = 8 << 20
#: Stretches that a worker's memo of ids holds before it starts anew; with
#: their ids about 20 bytes each.
MEMO = 500_000
#: Bytes of text that are cut at once.
FAST_BYTES = 1 << 18
#: Texts of one Arrow batch.
ROWS = 400
END_ID = 0


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | str | None, ids: np.ndarray, width: int) -> bytes:
    if isinstance(doc_id, str):
        name = doc_id.encode()
        head = META.pack(width, 2, len(name)) + name
    else:
        head = META.pack(width, doc_id is not None, doc_id or 0)
    payload = head + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((MAGIC, length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload)), b"\n"))


def frames(data: bytes):
    """(offset, length, doc_id, ids) of every frame; raises on any damage."""
    at = 0
    while at < len(data):
        magic, size, crc = HEAD.unpack_from(data, at)
        if magic != MAGIC or masked(data[at + 4 : at + 12]) != crc:
            raise ValueError(f"damaged frame head at byte {at}")
        start, end = at + HEAD.size, at + HEAD.size + size
        payload = data[start:end]
        if len(data) < end + TAIL or data[end + 4 : end + 5] != b"\n" or masked(payload) != struct.unpack_from("<I", data, end)[0]:
            raise ValueError(f"damaged frame at byte {at}")
        width, kind, doc_id = META.unpack_from(payload)
        first = META.size
        if kind == 2:
            first += doc_id
            doc_id = payload[META.size : first].decode()
        yield at, end + TAIL - at, doc_id if kind else None, np.frombuffer(payload, f"<u{width}", offset=first)
        at = end + TAIL


#: What the fast way can't cut: white space beyond ASCII (and the separators
#: that libraries may treat as such).
ODD = re.compile("[\x00\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Space, line feed, or the mark of a text's start.
_CUT = np.zeros(256, bool)
_CUT[[0, 10, 32]] = True


class Encoder:
    """ids of whole texts by the tokenizers library.

    A byte-level vocabulary with the usual pattern never joins what a single
    space or line feed between two other characters starts with what precedes
    it. Such stretches are found by array operations over many texts at once,
    named by a 64-bit hash, encoded once by the library and kept in a memo of
    bounded size; all other texts go to the library whole."""

    def __init__(self, data: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from .tokens import byte_symbols

        self.lib = Tokenizer.from_str(data.decode())
        self.special = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocab.values()) < 1 << 16 else 4
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        known = set(byte_symbols())
        for token, i in vocab.items():
            self.bytes_of[i] = len(token) if known.issuperset(token) else len(token.encode())
        self.fresh()

    def fresh(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint16 if self.width == 2 else np.uint32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def simple(self, raw: bytes) -> bool:
        if b"  " in raw or b"\n " in raw or b" \n" in raw or b"\n\n\n" in raw or b"\t" in raw or b"\r" in raw or b"\x0b" in raw or b"\x0c" in raw:
            return False
        if not raw or raw[:1] in b" \n" or raw[-1:] in b" \n" or any(s in raw for s in self.special):
            return False
        if raw.isascii():
            return not any(c in raw for c in (b"\x00", b"\x1c", b"\x1d", b"\x1e", b"\x1f"))
        return ODD.search(raw.decode("utf-8", "replace")) is None

    def learn(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        """Encode units raw[start:end], each a cut and what follows it, and
        keep their ids."""
        data = np.frombuffer(raw, np.uint8)
        size = np.zeros(len(keys), np.int64)
        start, flat, used = np.zeros(len(keys), np.int64), [self.flat], len(self.flat)
        alone = (data[starts] == 0) | ((data[starts] == 10) & (ends - starts == 1))
        single = np.flatnonzero(alone)
        for i, x in zip(single.tolist(), self.whole([raw[starts[i] : ends[i]].lstrip(b"\0").decode() for i in single])):
            start[i], size[i] = used, len(x)
            flat.append(np.array(x, self.flat.dtype))
            used += len(x)
        rest = np.flatnonzero(~alone)
        for some in np.split(rest, range(20_000, len(rest), 20_000)):
            if len(some):
                # as words of one text; the tokens' lengths tell them apart
                text = b"".join([raw[s:e] for s, e in zip(starts[some].tolist(), ends[some].tolist())])
                found = np.array(self.whole([text.decode()])[0], self.flat.dtype)
                cuts = np.searchsorted(np.cumsum(self.bytes_of[found]), np.cumsum(ends[some] - starts[some])) + 1
                size[some] = np.diff(cuts, prepend=0)
                start[some] = used + cuts - size[some]
                flat.append(found)
                used += len(found)
        self.flat = np.concatenate(flat)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.size = np.insert(self.keys, at, keys), np.insert(self.start, at, start), np.insert(self.size, at, size)

    def fast(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = b"\0" + b"\0".join(texts)
        data = np.frombuffer(raw, np.uint8)
        starts = np.flatnonzero(_CUT[data])
        ends = np.append(starts[1:], len(data))
        keys, first, at = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(keys) > MEMO:
            half = len(texts) // 2
            return self.fast(texts[:half]) + self.fast(texts[half:]) if half else [np.array(self.whole([texts[0].decode()])[0], self.flat.dtype)]
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        if not known.all():
            if len(self.keys) + np.count_nonzero(~known) > MEMO:
                self.fresh()
                known[:] = False
            new = first[~known]
            self.learn(raw, starts[new], ends[new], keys[~known])
            place = np.searchsorted(self.keys, keys)
        start, size = self.start[place][at], self.size[place][at]
        upto = np.cumsum(size)
        out = self.flat[np.arange(upto[-1]) + np.repeat(start - (upto - size), size)]
        last = np.flatnonzero(data[starts] == 0)[1:]
        return np.split(out, upto[last - 1])

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        quick, held = [], 0
        for i, t in enumerate(texts):
            if not self.simple(t):
                out[i] = np.array(self.whole([t.decode("utf-8", "replace")])[0] if t else [], self.flat.dtype)
                continue
            quick.append(i)
            held += len(t)
            if held >= FAST_BYTES:
                for j, x in zip(quick, self.fast([texts[j] for j in quick])):
                    out[j] = x
                quick, held = [], 0
        if quick:
            for j, x in zip(quick, self.fast([texts[j] for j in quick])):
                out[j] = x
        return out


_KEPT: dict[bytes, Encoder] = {}


def kept_encoder(data: bytes) -> Encoder:
    """The encoder of this process for a vocabulary file, built once and used by
    all tasks that the process runs: the memory of one that is dropped comes
    back in pieces only, so that an encoder for each task makes a worker grow
    with the number of its tasks. Only the last file's is kept."""
    if data not in _KEPT:
        _KEPT.clear()
        _KEPT[data] = Encoder(data)
    return _KEPT[data]


def kind_of(docs: DataFrame) -> str:
    """bigint for whole numbers, else string: how frames keep a doc_id."""
    return "bigint" if docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, task_bytes: int = TASK_BYTES, shard_bytes: int = SHARD_BYTES) -> str:
    """Write docs (doc_id, text) as shards under path, ascending by doc_id over
    the shards' names; returns the path."""
    spark, text = docs.sparkSession, F.col("text").cast("string")
    # equal doc_ids, and equal rows, are spread too
    order = ["by", "tie", "place"]
    rows = docs.select(F.col("doc_id").alias("by"), F.xxhash64(text).alias("tie"), F.rand(7).alias("place"), text.alias("text"))
    total = docs.agg(F.sum(F.octet_length(text)), F.count(F.lit(1))).first()
    count = max(1, -(-((total[0] or 0) + 64 * total[1]) // task_bytes))
    shipped = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def encode(batches):
        give_back()
        own, end = kept_encoder(shipped.value), np.array([end_id], np.uint32)
        shard, held, before = 0, 0, 0
        for batch in batches:
            task, out, shards = batch.column("task").to_pylist(), [], []
            found = own.ids([t or b"" for t in utf8(batch.column("text"))])
            for n, i, x in zip(task, batch.column("doc_id").to_pylist(), found):
                out.append(frame(i, np.concatenate((x, end)), own.width)[:-1])
                if held and held + len(out[-1]) >= shard_bytes:
                    shard, held = shard + 1, 0
                held += len(out[-1]) + 1
                shards.append(f"{n:08d}-{shard:08d}")
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.string()), pa.array(np.arange(before, before + len(out))), pa.array(out, pa.binary())], names=["shard", "nth", "value"])
            before += len(out)

    ordered = rows.repartitionByRange(int(count), *order).sortWithinPartitions(*order)
    ordered = ordered.select(F.col("by").cast(kind_of(docs)).alias("doc_id"), "text", F.spark_partition_id().alias("task"))
    # the writer wants its rows by shard; saying so keeps their order inside
    out = map_arrow(ordered, encode, "shard string, nth long, value binary", ROWS).sortWithinPartitions("shard", "nth").select("shard", F.col("value").cast("string"))
    out.write.partitionBy("shard").option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", 0).text(path)
    shipped.destroy()
    return path


def shards(spark: SparkSession, path: str) -> DataFrame:
    """shard (its name) and content of every shard."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.filter("length > 0").select(F.regexp_extract("path", r"shard=([^/]+)/", 1).alias("shard"), "content")


def read_shards(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """shard, offset, length, doc_id, n_tokens, ids_crc32 of every frame, all
    checksums verified; the first five columns are the offset index."""

    def parse(batches):
        give_back()
        for batch in batches:
            for name, data in zip(batch.column("shard").to_pylist(), batch.column("content")):
                rows = [(at, size, doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for at, size, doc, ids in frames(data.as_py())]
                at, size, doc, n, crc = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(rows), pa.string()), pa.array(at, pa.int64()), pa.array(size, pa.int64()), pa.array(doc, pa.int64() if kind == "bigint" else pa.string()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    names=["shard", "offset", "length", "doc_id", "n_tokens", "ids_crc32"],
                )

    return map_arrow(shards(spark, path), parse, f"shard string, offset long, length long, doc_id {kind}, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """doc_id and ids (array) of every frame."""

    def parse(batches):
        for batch in batches:
            for data in batch.column("content"):
                for _, _, doc, ids in frames(data.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64() if kind == "bigint" else pa.string()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return map_arrow(shards(spark, path).select("content"), parse, f"doc_id {kind}, ids array<long>")


def write_index(frames_read: DataFrame, path: str) -> None:
    frames_read.select("shard", "offset", "length", "doc_id", "n_tokens").write.parquet(path)


def encode(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write docs' ids as shards and an index, then return from what was
    written doc_id, start, n_tokens, ids_crc32 (and shard, offset, length).

    start is the sum of the shards before it (a sum over one row per shard)
    plus a running sum within its shard, so no task sees more than a shard."""
    spark = docs.sparkSession
    path = path or scratch(spark, "shards")
    write_shards(docs, tokenizer_path, f"{path}/data")
    found = stored(read_shards(spark, f"{path}/data", kind_of(docs)), "frames")
    write_index(found, f"{path}/index")
    per_shard = found.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = per_shard.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_before"))
    within = Window.partitionBy("shard").orderBy("offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return found.join(before, "shard").select(
        "doc_id", (F.col("_before") + F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32", "shard", "offset", "length"
    )
