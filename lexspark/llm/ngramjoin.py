"""Near-duplicate join on word shingles by PartEnum signatures.

A document is the set of its distinct five-word shingles, as 64-bit hashes; two
documents link when 100 * intersection >= 75 * union. Copies (equal sets) are
one node, named by a fingerprint of the set.

Signatures. Sets of a size band [B, 2B) share one partition of the hash domain
into n1 parts of n2 smaller ones each; a set of the top quarter of its band also
signs by the partition of the next one, so that every pair that can link has a
partition in common. Of each part all subsets of n2 - 1 smaller parts are
enumerated, and the elements that the set has in such a subset are one
signature, if there are any. Sets r and s that link differ in at most
k = (|r| + |s|) / 7 elements. A part in which r has elements in two smaller parts
at least takes two differences to leave r and s without a signature in common
there: leaving out the smaller part that holds a single difference, they have
the same one, and it isn't empty. A part in which r has elements in one smaller
part takes one. So r and s share signatures in as many parts as k differences
can't pay for, and if that is one at least no link is lost; what r has more of
them is to spare. n1 is large enough that this holds but for rare sets. Those
sign, besides, with the first elements of the set in hash order, as many as two sets that link can't
both have without one in common; that is needed only to meet each other.
n2 is 3 for bands up to SUBSETS, where single smaller parts would hold too few
elements to be rare, and 2 beyond.

Buckets. Sets that share a signature meet in a bucket. A bucket of at most
COLD sets yields all its pairs. A larger one yields none at first: a set with
fewer signatures in large buckets than it has to spare has met all its partners.
The others (mostly members of large groups of near copies) are compared with
their bucket's least member; then connected components are found, sets outside
the largest component of a bucket are compared with one member of it, in each
bucket another, and those that are still outside meet what they share one of
their rarest shingles with (as many as two sets that link can't both have
without one in common). So groups cost a multiple of their size, no link
between two components is lost, and every pair that counts is verified on whole
sets. A task that makes more than COLD rows of one signature spreads the rest
over all partitions, so no signature gathers in one place.

Components come from alternating large-star and small-star rounds over
checkpointed edges; nothing is collected.

Defined cases: null texts and texts without words have no shingles, n_shingles
0 and themselves as component; a text of fewer than five words is one shingle;
repeated rows are copies; a component is named by its least doc_id that isn't
null; other columns are ignored by near_duplicates() and kept by keep_one().
Sets count as equal if their 64-bit fingerprints are: among 10^9 different sets
one such pair has a chance of 3 %.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, every, fresh, map_arrow, mix, span_hashes, stored, utf8, word_spans

WORDS = 5
#: A bucket of at most so many sets yields all its pairs.
COLD = 24
#: Sets of up to so many shingles sign with subsets of two parts of three.
SUBSETS = 512
#: Mean elements of a smaller part for the largest sets of a band, by n2.
LOAD = {2: 2.75, 3: 2.0}
#: Signature rows for one partition, and those that a task looks through for
#: frequent ones at a time.
ROWS = 2_000_000
CHUNK = 1 << 19
#: Pairs that are joined up at a time.
PAIRS = 200_000
#: Rounds in which a set outside is compared with one member of each bucket.
PIVOT_ROUNDS = 3
#: Sets, and shingles, of a group that is verified in one place.
TOGETHER = 8_000
TOGETHER_SHINGLES = 2_000_000
#: Ids up to which a checked column of them is broadcast (to leave texts where
#: they are); beyond it, a shuffled join does the same.
MOST_BROADCAST = 1_000_000

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    data = np.frombuffer((text or b"").lower(), np.uint8)
    hashes = span_hashes(data, *word_spans(data))
    if not len(hashes):
        return hashes
    n = max(len(hashes) - WORDS + 1, 1)
    x = hashes[:n] * _MULT[0]
    for i in range(1, min(WORDS, len(hashes))):
        x = mix(x) + hashes[i : n + i] * _MULT[i]
    return np.unique(mix(x + np.uint64(min(WORDS, len(hashes)))))


def fingerprint(own: np.ndarray) -> int:
    """Of a set; 0 for the empty one."""
    if not len(own):
        return 0
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def band_of(n: int) -> int:
    return n.bit_length() - 1


def parts_of(band: int) -> tuple[int, int]:
    """n1, n2 for the sets of sizes [2^band, 2^(band+1))."""
    top = 2 << band
    n2 = 3 if top <= SUBSETS else 2
    return max(1, round(top / (n2 * LOAD[n2]))), n2


def bands_for(n: int) -> list[int]:
    band = band_of(n)
    return [band, band + 1] if 4 * n >= 3 * (2 << band) else [band]


def differences(n: int, band: int) -> int:
    """Most elements in which a set of n and one that links with it and signs
    by the same band's partition differ."""
    return (n + min(4 * n // 3, (2 << band) - 1)) // 7


def part_of(own: np.ndarray, parts: int) -> np.ndarray:
    return ((own >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def prefix_of(n: int) -> int:
    """Elements of a set of n of which sets that link with it must have one
    among their own, in any order that all sets share."""
    return n - -(-3 * n // 4) + 1


def signatures(own: np.ndarray) -> list[tuple[tuple[int, int], np.ndarray, np.ndarray, int]]:
    """For each of the set's bands the domain (band, 0), its signatures, the part
    of each, and how many parts may be left out without losing a link (-1: they
    don't suffice, then the domain (band, 1) has those of the set's first
    elements, each a part)."""
    out = []
    for band in bands_for(len(own)):
        n1, n2 = parts_of(band)
        seed, plain = mix(np.array([band * 2 + 1, band * 2 + 2], np.uint64) * _MULT[3])
        part = part_of(own, n1 * n2).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        held = np.zeros(n1 * n2, np.uint64)
        held[part[starts]] = np.add.reduceat(mix(own + seed), starts)
        held = held.reshape(n1, n2)
        full = held != 0
        term = held * _MULT[:n2]
        rest = term.sum(1, dtype=np.uint64)[:, None] - term  # without each of the smaller parts
        some = full.sum(1)
        kept = np.flatnonzero((some[:, None] - full > 0).ravel())
        sigs = mix(rest.ravel()[kept] ^ (kept.astype(np.uint64) * _MULT[3] + seed))
        # differences go to the parts that one of them spoils, then by twos
        one, two, k = int(np.count_nonzero(some == 1)), int(np.count_nonzero(some >= 2)), differences(len(own), band)
        spare = (one - k + two if k < one else two - (k - one) // 2) - 1
        out.append(((band, 0), sigs, kept // n2, max(spare, -1)))
        if spare < 0:
            first = own[: prefix_of(len(own))]
            out.append(((band, 1), mix(first ^ plain), np.arange(len(first)), 0))
    return out


def packed(size: int, spare: int, which: int, part: np.ndarray) -> np.ndarray:
    """What a signature row says of its set: size (26 bits, or all of them set),
    spare + 1 (17), the domain (2) and the part (18). Where a number doesn't fit,
    nothing is to spare."""
    if spare + 1 >= 1 << 17 or (len(part) and int(part.max()) >= 1 << 18):
        spare = -1
    head = min(size, MOST_SIZE) << 37 | (spare + 1) << 20 | which << 18
    return head | (part & ((1 << 18) - 1))


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, node (fingerprint of its set), n_shingles."""

    def run(batches):
        for batch in batches:
            node, n = [], []
            for text in utf8(batch.column("text")):
                own = shingle_set(text)
                node.append(fingerprint(own))
                n.append(len(own))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(node, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "node", "n_shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, node long, n_shingles long")


#: Sizes beyond this one are kept as it, and fit any other.
MOST_SIZE = (1 << 26) - 1
#: Marks a row of a bucket that is known to be large.
LARGE = np.int64(-1 << 63)


def signature_rows(docs: DataFrame) -> DataFrame:
    """sig, node, info (packed()) of every document; a set that its task has
    seen before is left out, so that copies cost a row per signature and task.
    Rows beyond the first COLD + 1 of a signature are marked LARGE."""

    def emit(sig, node, info):
        times = [len(s) for s in sig]
        sig, node, info = np.concatenate(sig).view(np.int64), np.repeat(np.array(node, np.int64), times), np.concatenate(info)
        order = np.argsort(sig, kind="stable")
        ranked = sig[order]
        starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        size = np.diff(np.append(starts, len(ranked)))
        many = np.flatnonzero(size > COLD + 1)
        if len(many):
            more = np.concatenate([order[starts[i] + COLD + 1 : starts[i] + size[i]] for i in many])
            info[more] |= LARGE
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node), pa.array(info)], names=["sig", "node", "info"])

    def run(batches):
        seen: set[int] = set()
        sig, node, info, held = [], [], [], 0
        for batch in batches:
            for text in utf8(batch.column(0)):
                own = shingle_set(text)
                name = fingerprint(own)
                if not len(own) or name in seen:
                    continue
                seen.add(name)
                low = band_of(len(own))
                for (band, kind), sigs, part, spare in signatures(own):
                    sig.append(sigs)
                    node.append(name)
                    info.append(packed(len(own), spare, kind << 1 | (band - low), part))
                    held += len(sigs)
                if held >= CHUNK:
                    yield emit(sig, node, info)
                    sig, node, info, held = [], [], [], 0
        if sig:
            yield emit(sig, node, info)

    return map_arrow(docs.select(F.col("text").cast("string")), run, "sig long, node long, info long")


MET = ["sig", "a", "info_a", "b", "info_b", "times"]


def bucket_rows(sigs: DataFrame, partitions: int) -> DataFrame:
    """What the buckets yield: a candidate pair a, b with sig null and the
    number of buckets in which it met, or a member a of a large bucket sig."""

    def run(batches):
        got = [tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "node", "info")) for b in batches]
        if not got:
            return
        sig, node, info = (np.concatenate(x) for x in zip(*got))
        del got
        known = info < 0
        if known.any():
            none = pa.nulls(int(known.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(sig[known]), pa.array(node[known]), pa.array(info[known] & ~LARGE), none, none, none], names=MET)
            sig, node, info = sig[~known], node[~known], info[~known]
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        twice = sig[1:] == sig[:-1]
        kept = np.concatenate(([False], twice)) | np.concatenate((twice, [False]))  # all others are alone
        order, sig = order[kept], sig[kept]
        node, info = node[order], info[order]
        order = np.lexsort((node, sig))
        sig, node, info = sig[order], node[order], info[order]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node, info = sig[fresh], node[fresh], info[fresh]
        starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(sig)))
        n, left, right = info >> 37, [], []
        pair = info >> 18  # without the part
        for m in range(2, COLD + 1):
            at = starts[size == m]
            if len(at):
                i, j = np.triu_indices(m, 1)
                a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                fit = (np.minimum(n[a], n[b]) * 4 >= np.maximum(n[a], n[b]) * 3) | (n[b] == MOST_SIZE) | (n[a] == MOST_SIZE)
                left.append(a[fit])
                right.append(b[fit])
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            order = np.lexsort((pair[a] & 3, pair[b] & 3, node[b], node[a]))
            a, b = a[order], b[order]
            fresh = np.ones(len(a), bool)
            fresh[1:] = (node[a[1:]] != node[a[:-1]]) | (node[b[1:]] != node[b[:-1]]) | (pair[a[1:]] != pair[a[:-1]]) | (pair[b[1:]] != pair[b[:-1]])
            at = np.flatnonzero(fresh)
            times = np.diff(np.append(at, len(a)))
            a, b = a[at], b[at]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(node[a]), pa.array(pair[a]), pa.array(node[b]), pa.array(pair[b]), pa.array(times)], names=MET)
        large = np.repeat(size > COLD, size)
        if large.any():
            none = pa.nulls(int(large.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(sig[large]), pa.array(node[large]), pa.array(info[large]), none, none, none], names=MET)

    place = F.when(F.col("info") < 0, F.col("node")).otherwise(F.col("sig"))
    return map_arrow(sigs.repartition(partitions, place), run, ", ".join(f"{c} long" for c in MET))


def small(rows: DataFrame) -> DataFrame:
    """A narrow table, checkpointed; to be broadcast if it has few rows."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def texts_of(docs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles (their hashes as bytes) of the given nodes, made anew
    from the text of one document each (all those without a doc_id)."""
    named = sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    some = texts.join(small(named.select("doc_id")), "doc_id", "left_semi").union(texts.filter("doc_id is null"))

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            own = {fingerprint(x): x.tobytes() for x in map(shingle_set, utf8(batch.column("text")))}
            new = [x for x in own if x not in seen]
            seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([own[x] for x in new], pa.binary())], names=["node", "shingles"])

    return map_arrow(some, run, "node long, shingles binary").join(small(nodes.select("node").distinct()), "node", "left_semi")


def links_between(x: bytes, y: bytes) -> bool:
    r, s = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(r, s, assume_unique=True))
    return 100 * both >= 75 * (len(r) + len(s) - both)


def verified(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs a, b whose sets link."""

    def run(batches):
        for batch in batches:
            keep = [links_between(x.as_py(), y.as_py()) for x, y in zip(batch.column("x"), batch.column("y"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = own.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = own.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return map_arrow(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), run, "a long, b long")


def joined_up(nodes, pairs) -> dict[int, int]:
    """Least node reachable from each node by the pairs."""
    root = {x: x for x in nodes}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in pairs:
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {x: top(x) for x in root}


def solve(nodes: list[int], shingles: list[bytes]) -> list[tuple[int, int]]:
    """(node, least node reachable by links) of a group's sets. From the least
    node that isn't placed, sets are reached breadth first; each is compared, by
    array operations, with all that aren't placed yet."""
    order = sorted(range(len(nodes)), key=nodes.__getitem__)
    own = [np.frombuffer(shingles[i], np.uint64) for i in order]
    names = [nodes[i] for i in order]
    size = np.array([len(x) for x in own])
    values, flat = np.unique(np.concatenate(own), return_inverse=True)
    ends = np.cumsum(size)
    mark = np.zeros(len(values), np.int32)
    left, rest, rest_flat = np.arange(len(own)), np.cumsum(size) - size, flat
    out = []
    while len(left):
        root, queue = int(left[0]), [int(left[0])]
        placed = np.zeros(len(left), bool)
        placed[0] = True
        while queue:
            x = queue.pop()
            mark[flat[ends[x] - size[x] : ends[x]]] = 1
            shared = np.add.reduceat(mark[rest_flat], rest)
            mark[flat[ends[x] - size[x] : ends[x]]] = 0
            new = ~placed & (100 * shared >= 75 * (size[x] + size[left] - shared))
            queue += left[new].tolist()
            placed |= new
            if placed.sum() * 2 > len(left) or not queue:
                # leave out what is placed
                out += [(names[i], names[root]) for i in left[placed].tolist()]
                keep = ~placed
                rest_flat = rest_flat[np.repeat(keep, size[left])]
                left = left[keep]
                rest = np.cumsum(size[left]) - size[left]
                placed = np.zeros(len(left), bool)
                if not len(left):
                    break
    return out


def solved_together(own: DataFrame, groups: DataFrame) -> DataFrame:
    """node, root (least node reachable by links) of all nodes in groups (node,
    root) that are small enough to meet in one task: each set is sent once."""
    rows = own.join(groups, "node").select("root", "node", "shingles").repartition("root").sortWithinPartitions("root", "node")

    def run(batches):
        root, nodes, held, done = None, [], [], []
        for batch in batches:
            for r, node, shingles in zip(batch.column("root").to_pylist(), batch.column("node").to_pylist(), batch.column("shingles")):
                if r != root:
                    done += solve(nodes, held) if nodes else []
                    root, nodes, held = r, [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    held.append(shingles.as_py())
            if len(done) > 10_000:
                yield emit(done)
                done = []
        yield emit(done + (solve(nodes, held) if nodes else []))

    def emit(rows):
        node, top = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(top, pa.int64())], names=["node", "root"])

    return map_arrow(rows, run, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node reachable) of every node that has an edge."""

    def contract(batches):
        # what meets in one task by chance is joined up there first
        pairs: list = []
        for batch in batches:
            pairs += zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())
            if len(pairs) >= PAIRS:
                yield emit(pairs)
                pairs = []
        yield emit(pairs)

    def emit(pairs):
        found = [(x, r) for x, r in joined_up({x for p in pairs for x in p}, pairs).items() if x != r]
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    spread = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).repartition("a", "b")
    edges = cut(map_arrow(spread, contract, "a long, b long").distinct())
    now = state(edges)
    # a row for each node at most: twice the edges, which aren't more from here on
    hint = F.broadcast if 2 * now[0] <= MOST_BROADCAST else cut
    while True:
        # large star: each node's larger neighbours go to its least neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = hint(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = cut(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        # small star: smaller neighbours, and the node, go to the least one
        least = hint(large.groupBy("a").agg(F.min("b").alias("m")))
        linked = large.join(least, "a").filter("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        edges = cut(linked.union(least.select("a", F.col("m").alias("b"))).distinct())
        before, now = now, state(edges)
        if before == now:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())


def candidates(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs a > b that may link, and members sig, a, needed of large buckets
    that may have partners which they haven't met in another bucket, and whether
    they must look for them in this one.

    A set with so many parts to spare shares a signature in one part more with
    each set that links with it; those in large buckets may be hidden, the
    others must have met."""
    spare = lambda c: F.expr(f"(({c} >> 2) & 131071) - 1")
    members = met.filter("sig is not null").select("sig", "a", F.expr("info_a >> 18").alias("info"), F.expr("info_a & 262143").alias("part"))
    hidden = cut(members.groupBy("a", "info", "part").agg(F.lit(1).alias("x")).groupBy("a", "info").agg(F.count("x").alias("hidden")))
    heavy_nodes = hidden.filter(F.col("hidden") > spare("info")).select("a", "info", (F.col("hidden") - spare("info")).alias("need"))
    heavy = members.join(heavy_nodes.select("a").distinct(), "a", "left_semi").join(heavy_nodes, ["a", "info"], "left")
    # of a set's parts with large buckets, as many of those with the largest as
    # it has to spare aren't needed to meet its partners
    size = small(heavy.groupBy("sig").agg(F.count(F.lit(1)).alias("size")))
    sized = heavy.join(size, "sig").withColumn("most", F.max("size").over(Window.partitionBy("a", "info", "part")))
    place = F.dense_rank().over(Window.partitionBy("a", "info").orderBy("most", "part"))
    heavy = cut(sized.select("sig", "a", (place <= F.coalesce("need", F.lit(0))).alias("needed")))
    pairs = met.filter("sig is null").groupBy("a", "info_a", "b", "info_b").agg(F.sum("times").alias("times"))
    for c in "ab":
        h = hidden.select(F.col("a").alias(c), F.col("info").alias(f"info_{c}"), F.col("hidden").alias(f"hidden_{c}"))
        pairs = pairs.join(h, [c, f"info_{c}"], "left")
    need = lambda c: spare(f"info_{c}") + 1 - F.coalesce(f"hidden_{c}", F.lit(0))
    pairs = pairs.filter(F.col("times") >= F.greatest(need("a"), need("b")))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), heavy


def linked_sets(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """node, root of the sets that link with others (and of some that don't):
    the least node reachable by links."""
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    spark = docs.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ROWS))
    met = stored(bucket_rows(signature_rows(docs), partitions), "buckets")
    pairs, heavy = candidates(met)
    first = small(heavy.groupBy("sig").agg(F.min("a").alias("b")))
    stars = heavy.join(first, "sig").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    ask = cut(pairs.union(stars).distinct())

    # candidates form groups; small ones are solved each in one place
    groups = components(ask)
    size = sets.groupBy("node").agg(F.max("n_shingles").alias("n"))
    sizes = groups.join(size, "node").groupBy("root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    fits = cut(groups.join(sizes, "root").select("node", "root", ((F.col("c") <= TOGETHER) & (F.col("n") <= TOGETHER_SHINGLES)).alias("fits")))
    little, much = fits.filter("fits").select("node", "root"), fits.filter("not fits").select("node")
    own = texts_of(docs, sets, little.select("node"))
    roots = cut(solved_together(own, little))
    if much.isEmpty():
        return roots

    # large ones: each set with its least partner, then what isn't connected
    own = stored(texts_of(docs, sets, much), "sets")
    ask = cut(ask.join(much.select(F.col("node").alias("a")), "a", "left_semi"))
    tried = cut(ask.groupBy("a").agg(F.min("b").alias("b")))
    found = cut(verified(tried, own))
    placed = cut(components(found))
    end = lambda c: placed.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    apart = ask.join(end("a"), "a", "left").join(end("b"), "b", "left")
    apart = apart.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b").join(tried, ["a", "b"], "left_anti")
    apart = cut(apart)
    found = cut(found.union(verified(apart, own)))
    placed = cut(components(found))

    # in large buckets: sets outside the largest component, first with one
    # member each of the largest component of many buckets
    tested = tried.union(apart)
    for rounds in range(PIVOT_ROUNDS + 1):
        rooted = heavy.join(small(placed), F.col("a") == F.col("node"), "left").select("sig", "a", "needed", F.coalesce("root", "a").alias("root"))
        counts = rooted.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("c"), F.max_by("a", F.xxhash64("sig", "a", F.lit(rounds))).alias("pivot"))
        top = counts.groupBy("sig").agg(F.max_by(F.struct("root", "pivot"), F.struct("c", "root")).alias("t"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
        rooted = cut(rooted.join(small(top.select("sig", F.col("t.root").alias("top"), "t.pivot")), "sig"))
        outside = rooted.filter("needed and root <> top")
        if outside.isEmpty():
            break
        if rounds < PIVOT_ROUNDS:
            pairs = outside.select(F.greatest("a", "pivot").alias("a"), F.least("a", "pivot").alias("b"))
        else:
            members = rooted.groupBy("a").agg(F.first("root").alias("root"), F.max(F.col("needed") & (F.col("root") != F.col("top"))).alias("asks"))
            pairs = rare_pairs(own, members)
        pairs = cut(pairs.distinct().join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            continue
        found = cut(found.union(verified(pairs, own)).distinct())
        tested = cut(tested.union(pairs))
        placed = cut(components(found))
    return roots.union(placed)


def rare_pairs(own: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs a > b of members (a, root, asks) with different roots, one of which
    asks, that have one of both sets' rarest shingles in common: of all that
    link, by the prefix filter, in the order of frequency among members."""

    def explode(batches):
        for batch in batches:
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("shingles")]
            n = [len(x) for x in sets]
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(batch.column("node"), np.int64), n)), pa.array(flat.view(np.int64)), pa.array(np.repeat(np.array(n, np.int64), n))], names=["a", "x", "n"])

    rows = stored(map_arrow(own.join(small(members.select(F.col("a").alias("node"))), "node", "left_semi").dropDuplicates(["node"]), explode, "a long, x long, n long", 200), "shingles")
    frequency = small(rows.groupBy("x").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.coalesce("df", F.lit(1)), "x"))
    first = rows.join(frequency, "x", "left").withColumn("_r", place).filter((F.col("_r") <= F.col("n") - F.ceil(F.lit(3) * F.col("n") / 4) + 1) & (F.col("df") > 1))
    first = stored(first.select("a", "x", "n").join(small(members), "a"), "prefixes")
    asks = first.filter("asks").select("x", F.col("a").alias("u"), F.col("root").alias("ru"), F.col("n").alias("nu"))
    fit = (F.col("root") != F.col("ru")) & (4 * F.least("n", "nu") >= 3 * F.greatest("n", "nu"))
    return first.join(asks, "x").filter(fit).select(F.greatest("a", "u").alias("a"), F.least("a", "u").alias("b"))


def named(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """node, component_id (least doc_id) and first (its least doc_id) of every
    node that isn't empty."""
    least = sets.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    joined = least.join(small(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return joined.join(names, "root").select("node", "first", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    sets = stored(document_sets(docs), "docsets")
    # only documents whose component has another name than theirs need a join
    names = named(sets, linked_sets(docs, sets))
    many = sets.groupBy("node").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.count("doc_id").alias("c"), F.count(F.lit(1)).alias("all"))
    many = many.filter("x <> y or c < all").select("node")
    moved = names.filter("not (first <=> component_id)").select("node", "component_id")
    again = names.join(many, "node", "left_semi").select("node", "component_id")
    of_node = small(moved.union(again).distinct())
    filled = sets.filter("n_shingles > 0").join(of_node, "node", "left")
    out = filled.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.union(sets.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the least doc_id (null last), of
    several texts of one doc_id that with the least fingerprint, of equal rows
    any. Rows without shingles all stay.

    A doc_id that one row has is decided by the doc_id alone, so that texts stay
    where they are; where several rows share one, their sets are made anew."""
    sets = stored(document_sets(docs), "docsets")
    roots = small(linked_sets(docs, sets))
    filled = sets.filter("n_shingles > 0").select("doc_id", "node").distinct()
    joined = filled.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))
    stays = joined.groupBy("root").agg(F.min_by(F.struct("doc_id", "node"), order).alias("k")).select("k.doc_id", "k.node")
    stays = cut(stays)
    repeated = sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 or doc_id is null").select("doc_id")
    repeated = small(repeated)
    node, key, of = fresh(docs, "_node", "_key", "_of")
    go = filled.join(stays, filled["doc_id"].eqNullSafe(stays["doc_id"]) & (filled["node"] == stays["node"]), "left_anti").select(F.col("doc_id").alias(key))
    again = repeated.select(F.col("doc_id").alias(key))
    same = F.col("doc_id").eqNullSafe(F.col(key))
    single = docs.join(again, same, "left_anti").join(small(go), same, "left_anti")
    if repeated.isEmpty():
        return single

    def fingerprints(batches):
        for batch in batches:
            found = [fingerprint(shingle_set(t)) for t in utf8(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], schema=pa.schema([*list(batch.schema)[:-1], pa.field(node, pa.int64())]))

    text = fresh(docs, "_text")[0]
    with_text = docs.join(again, same, "left_semi").withColumn(text, F.col("text").cast("string"))
    schema = docs.select("*", F.lit(0).cast("long").alias(node)).schema
    several = map_arrow(with_text, fingerprints, schema)
    k = stays.select(F.col("doc_id").alias(key), F.col("node").alias(of))
    kept = several.join(k, same & (F.col(node) == F.col(of)), "left_semi").groupBy("doc_id", node).agg(F.first(F.struct(*every(docs))).alias(of)).select(f"{of}.*")
    return single.select(*every(docs)).union(several.filter(F.col(node) == 0).select(*every(docs))).union(kept)


#: DuckDB's SQL for near_duplicates().
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i + 1 : i + 5], ' ') FOR i IN range(len(w) - 4)]) END AS g FROM w
), l AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM l AS a JOIN l AS b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r AS (
  SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), c AS (
  SELECT a, min(b) AS m FROM r GROUP BY a
)
SELECT doc_id, len(g)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM s LEFT JOIN c ON doc_id = a
"""
