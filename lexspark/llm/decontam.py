"""Benchmark decontamination by a prefix-filtered set join.

A window of ten item words is the set of its three-word shingles. Containment
of a whole window is asked for, so one shingle is its necessary prefix: the
rarest one in the order of document frequency over all documents. A document
is a candidate where it has such a prefix shingle; the positional bound says
where the window would have to start, the length bound that it must fit, and
the words themselves are then compared, outwards from the shingle, over
item-sized windows.

A benchmark of up to BROADCAST_BYTES is broadcast whole. A larger one stays
distributed: shingles are 64-bit hashes, what is broadcast is a bitmap of at most
BITMAP bits that says which shingles can't be in the benchmark, and the places
of the others meet the prefix shingles in a shuffled join, each with the words
around it, by which it is verified. Both take two passes over the documents,
whatever the benchmark's size.

Defined cases: null or wordless texts have no words and no hits; null or
wordless items have no window; items with equal ids count once; an item with a
null id marks words but isn't listed; repeated documents give repeated rows;
equally frequent shingles are ordered by their words, then by place.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, every, fresh, map_arrow, mix, span_hashes, stored, utf8, word_spans

WINDOW = 10
SHINGLE = 3
#: Bytes of text up to which a benchmark is broadcast.
BROADCAST_BYTES = 4 << 20
#: Most bits of a bitmap of shingles.
BITMAP = 1 << 27
#: Shingles of an item that are looked at in one place.
STRETCH = 4096


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM_TABLE).split() if text else []


def shingles(words: list[bytes], k: int):
    return zip(*(words[i:] for i in range(k)))


def items_of(bench: DataFrame) -> list[tuple[str | None, list[bytes]]]:
    """(item_id as text, words) of a benchmark of bounded size."""
    rows = bench.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t")).filter("t is not null").collect()
    return [(r.i, words) for r in rows if (words := words_of(bytes(r.t)))]


def shingle_sizes(block) -> list[int]:
    return sorted({min(SHINGLE, len(words)) for _, words in block})


def document_frequency(docs: DataFrame, block) -> dict[tuple, int]:
    """In how many documents each shingle of the block's items occurs."""
    sizes = shingle_sizes(block)
    keys = {g for _, words in block for k in sizes for g in shingles(words, k)}
    index = {g: n for n, g in enumerate(sorted(keys))}
    shipped = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches):
        at, found = shipped.value, Counter()
        known = at.keys()
        for batch in batches:
            for text in utf8(batch.column(0)):
                words = words_of(text)
                for k in sizes:
                    found.update(at[g] for g in known & set(shingles(words, k)))
        yield pa.RecordBatch.from_pydict({"g": pa.array(list(found), pa.int64()), "n": pa.array(list(found.values()), pa.int64())})

    rows = map_arrow(docs.select(F.col("text").cast("string")), count, "g long, n long")
    total = {r.g: r.n for r in rows.groupBy("g").agg(F.sum("n").alias("n")).toLocalIterator()}
    return {g: total.get(n, 0) for g, n in index.items()}


def anchors(block, frequency: dict[tuple, int]) -> dict[tuple, list[tuple[int, int]]]:
    """Prefix shingle -> (item, offset) of the windows that it stands for."""
    out: dict[tuple, set] = defaultdict(set)
    for n, (_, words) in enumerate(block):
        k = min(SHINGLE, len(words))
        at = list(shingles(words, k))
        span = min(WINDOW, len(words)) - k + 1
        for start in range(len(words) - min(WINDOW, len(words)) + 1):
            best = min(range(start, start + span), key=lambda i: (frequency.get(at[i], 0), at[i], i))
            out[at[best]].add((n, best))
    return {g: sorted(x) for g, x in out.items()}


def find(words: list[bytes], block, index: dict[tuple, list[tuple[int, int]]], sizes: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
    """Runs of hit words, and the items whose windows occur."""
    runs, items, known = [], set(), index.keys()
    for k in sizes:
        present = known & set(shingles(words, k))
        if not present:
            continue
        reached: dict[tuple[int, int], int] = {}
        for at, g in enumerate(shingles(words, k)):
            if g not in present:
                continue
            for n, offset in index[g]:
                if reached.get((n, at - offset), 0) > at:
                    continue
                own = block[n][1]
                lo, i = at, offset
                while lo > 0 and i > 0 and words[lo - 1] == own[i - 1]:
                    lo, i = lo - 1, i - 1
                hi, j = at + k, offset + k
                while hi < len(words) and j < len(own) and words[hi] == own[j]:
                    hi, j = hi + 1, j + 1
                reached[n, at - offset] = hi
                if hi - lo >= min(WINDOW, len(own)):
                    runs.append((lo, hi))
                    items.add(n)
    return runs, items


def covered(runs: list[tuple[int, int]]) -> int:
    total, end = 0, 0
    for lo, hi in sorted(runs):
        total += max(0, hi - max(lo, end))
        end = max(end, hi)
    return total


def find_broadcast(docs: DataFrame, bench: DataFrame, runs: str, items: str) -> DataFrame:
    block = items_of(bench)
    index, sizes = anchors(block, document_frequency(docs, block)), shingle_sizes(block)
    shipped = docs.sparkSession.sparkContext.broadcast((block, index, sizes))
    text = fresh(docs, "_text")[0]

    def scan(batches):
        block, index, sizes = shipped.value
        for batch in batches:
            some, ids = [], []
            for t in utf8(batch.column(text)):
                more, found = find(words_of(t), block, index, sizes)
                some.append([x for run in more for x in run])
                ids.append([block[n][0] for n in found if block[n][0] is not None])
            fields = [*list(batch.schema)[:-1], pa.field(runs, pa.list_(pa.int32())), pa.field(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(some, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.string()))], schema=pa.schema(fields))

    schema = docs.select("*", F.array().cast("array<int>").alias(runs), F.array().cast("array<string>").alias(items)).schema
    return map_arrow(docs.withColumn(text, F.col("text").cast("string")), scan, schema)


_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def hashed(text: bytes | None, sizes) -> tuple[bytes, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """The text's words as bytes between spaces, their starts and ends, and the
    hashes of the shingles of each size."""
    raw = (text or b"").translate(ALNUM_TABLE)
    data = np.frombuffer(raw, np.uint8)
    starts, ends = word_spans(data)
    word, out = span_hashes(data, starts, ends), {}
    for k in sizes:
        n = max(len(word) - k + 1, 0)
        x = np.full(n, k, np.uint64)
        for i in range(k):
            x = mix(x + word[i : i + n] * _MULT[i])
        out[k] = x
    return raw, starts, ends, out


def around(raw: bytes, starts: np.ndarray, ends: np.ndarray, at: int) -> tuple[bytes, bytes]:
    """Up to a window's words before word at, and from it on."""
    lo, hi = max(at - WINDOW, 0), min(at + WINDOW, len(starts))
    return raw[starts[lo] : ends[at - 1]] if at else b"", raw[starts[at] : ends[hi - 1]]


def item_shingles(bench: DataFrame) -> DataFrame:
    """n (number of the item), id, words, size, at, h, before, after: every
    shingle of every item with the words around it."""

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for n, i, t in zip(batch.column("n").to_pylist(), batch.column("id").to_pylist(), utf8(batch.column("text"))):
                raw, starts, ends, _ = hashed(t, ())
                size = min(SHINGLE, len(starts))
                for at, h in enumerate(hashed(t, (size,))[3][size].view(np.int64).tolist() if size else ()):
                    for col, x in zip(cols, (n, i, len(starts), size, at, h, *around(raw, starts, ends, at))):
                        col.append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["n", "id", "words", "size", "at", "h", "before", "after"])

    rows = bench.select(F.monotonically_increasing_id().alias("n"), F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    return stored(map_arrow(rows, run, "n long, id string, words long, size int, at long, h long, before binary, after binary", 50), "items")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits of the hashes h, eight for each at least up to BITMAP bits."""
    bits = min(BITMAP, max(1 << 16, 1 << (8 * hashes.count()).bit_length()))
    place = F.col("h").bitwiseAND(bits - 1)
    words = hashes.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast((h & {bits - 1}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(bits >> 6, np.uint64)
    for r in words.toLocalIterator():
        out[r.w] = np.uint64(r.b & (1 << 64) - 1)
    return out


def inside(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def matched(before: bytes, after: bytes, own_before: bytes, own_after: bytes) -> tuple[int, int]:
    """How many words agree backwards and forwards."""
    out = []
    for x, y in ((before.split()[::-1], own_before.split()[::-1]), (after.split(), own_after.split())):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        out.append(n)
    return out[0], out[1]


def find_joined(docs: DataFrame, bench: DataFrame, runs: str, items: str) -> DataFrame:
    spark = docs.sparkSession
    rid, key, of_runs, of_items = fresh(docs, "_rid", "_key", "_found", "_ids")
    base = stored(docs.withColumn(rid, F.monotonically_increasing_id()), "documents")
    texts = base.select(F.col(rid).alias("rid"), F.col("text").cast("string").alias("text"))
    own = item_shingles(bench)
    sizes = tuple(sorted(r.size for r in own.select("size").distinct().collect()))
    shipped = spark.sparkContext.broadcast(bitmap(own.select("h").distinct()))

    def count(batches):
        for batch in batches:
            found = [x for t in utf8(batch.column("text")) for h in hashed(t, sizes)[3].values() for x in (np.unique(h[inside(shipped.value, h)]),)]
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    frequency = map_arrow(texts, count, "h long, n long").groupBy("h").agg(F.sum("n").alias("df"))
    # the rarest shingle of each window, in stretches that reach into the next one
    ranked = own.join(frequency, "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    part = F.floor(F.col("at") / STRETCH)
    reach = F.array_distinct(F.array(part, F.floor(F.greatest(F.col("at") - WINDOW, F.lit(0)) / STRETCH)))
    span = Window.partitionBy("n", "part").orderBy("at").rowsBetween(0, WINDOW - SHINGLE)
    ranked = ranked.withColumn("part", F.explode(reach)).withColumn("best", F.min(F.struct("df", "h", "at", "before", "after")).over(span))
    starts = ranked.filter((part == F.col("part")) & (F.col("at") <= F.col("words") - F.least("words", F.lit(WINDOW))))
    anchor = stored(starts.select("n", "id", "words", "best.at", "best.h", F.col("best.before").alias("own_before"), F.col("best.after").alias("own_after")).dropDuplicates(["n", "at"]), "anchors")
    marked = spark.sparkContext.broadcast(bitmap(anchor.select("h").distinct()))

    def place(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for n, t in zip(batch.column("rid").to_pylist(), utf8(batch.column("text"))):
                raw, first, last, found = hashed(t, sizes)
                for h in found.values():
                    hits = np.flatnonzero(inside(marked.value, h))
                    for at, x in zip(hits.tolist(), h[hits].view(np.int64).tolist()):
                        for col, y in zip(cols, (n, at, x, *around(raw, first, last, at))):
                            col.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["rid", "at", "h", "before", "after"])

    def verify(batches):
        for batch in batches:
            x = batch.to_pydict()
            cols: list[list] = [[] for _ in range(4)]
            for n, at, words, i, *four in zip(*(x[c] for c in ("rid", "at", "words", "id", "before", "after", "own_before", "own_after"))):
                back, on = matched(*four)
                if back + on >= min(WINDOW, words):
                    for col, y in zip(cols, (n, at - back, at + on, i)):
                        col.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["rid", "lo", "hi", "id"])

    met = map_arrow(texts, place, "rid long, at long, h long, before binary, after binary").join(anchor.drop("n", "at"), "h")
    hits = stored(map_arrow(met, verify, "rid long, lo int, hi int, id string").distinct(), "hits")
    found = hits.groupBy(F.col("rid").alias(key)).agg(F.flatten(F.collect_set(F.array("lo", "hi"))).alias(of_runs), F.collect_set("id").alias(of_items))
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    return base.join(found, F.col(rid) == F.col(key), "left").select(*every(docs), none(of_runs, "array<int>").alias(runs), none(of_items, "array<string>").alias(items))


def find_benchmark(docs: DataFrame, bench: DataFrame, runs: str = "_runs", items: str = "_items", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with runs (array of hit runs as start, end pairs, flat) and items
    (ids of the items found), for every row of docs and every item of bench.
    Columns of docs with these two names are replaced."""
    docs = docs.drop(runs, items)
    total = bench.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return (find_broadcast if total <= broadcast_bytes else find_joined)(docs, bench, runs, items)


def report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_benchmark(docs.select("doc_id", "text"), bench)

    def digest(batches):
        for batch in batches:
            items = [sorted(set(x)) for x in batch.column("_items").to_pylist()]
            runs = batch.column("_runs").to_pylist()
            hit = [covered(list(zip(r[::2], r[1::2]))) for r in runs]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array([len(words_of(t)) for t in utf8(batch.column("text"))], pa.int64()),
                "n_hit": pa.array(hit, pa.int64()),
                "n_items": pa.array([len(x) for x in items], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                "contaminated": pa.array([h > 0 for h in hit], pa.bool_()),
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(found, digest, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs without a run of benchmark words."""
    runs, items = fresh(docs, "_runs", "_items")
    return find_benchmark(docs, bench, runs, items).filter(F.size(runs) == 0).select(*every(docs))


#: DuckDB's SQL for report().
SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), i AS (
  SELECT item_id, w, least(10, len(w)) AS k, unnest(range(len(w) - least(10, len(w)) + 1)) AS s FROM b WHERE len(w) > 0
), x AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s + 1 : s + k], ' ') AS g FROM i
), p AS (
  SELECT rid, w, k, unnest(range(len(w) - k + 1)) AS pos FROM d, (SELECT DISTINCT k FROM x) WHERE len(w) >= k
), m AS (
  SELECT rid, pos, x.k, item_id FROM (SELECT rid, pos, k, array_to_string(w[pos + 1 : pos + k], ' ') AS g FROM p) AS y JOIN x ON y.k = x.k AND y.g = x.g
), h AS (
  SELECT rid, count(DISTINCT pos + j) AS n_hit FROM m, (SELECT unnest(range(10)) AS j) WHERE j < k GROUP BY rid
), n AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, cast(item_id AS VARCHAR) AS item FROM m) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN n USING (rid)
"""
