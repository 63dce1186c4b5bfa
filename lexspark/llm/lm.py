"""Language-model scores by logistic context mixing.

A text is its tokens: words, then one end. A token is spelled as bytes, ended by
a space (the end is the space alone); each bit of the spelling is predicted by
several predictors, one for each context: the class of the text with the last
one, two or three bytes or with the whole word so far, and the whole word so far
in all classes. The class is that of the most frequent short word (one of
CLASSES, which costs log10(CLASSES) a text). Contexts of the last bytes reach
over the start of a word to the word before, if that has at most SHORT bytes (as
most function words have; in one of SHORTS buckets). Each context has hashed
counts of zeros and ones. The predictions are
mixed in the logistic domain by weights that a gate selects (how often the word
so far was seen, and which bit it is), and refined by an adaptive map from what
the mixer says to what then came. Both learn online from every training
document, bit by bit in small blocks, from counts that leave out one occurrence
of the word at hand; the parts of the corpus learn side by side, and their
weights are averaged by the bits that each gate saw, their maps added up. The
product over a spelling's bits is the token's probability, whether it was seen
or not.

All counts are those of the corpus: a token counts at each of its occurrences.
The distinct words, each with its class and the word before, are dealt by ranges of their
spelling, so that those with a common beginning are neighbours, and a part's
counts of beginnings are sums over runs of its sorted words. Beginnings that
reach over an edge of a part are added up and broadcast: a few hundred numbers a
part of PART_BYTES. Contexts of one to three bytes are counted in tables with
twice as many slots as there are different contexts, up to MOST_SLOTS.

Each distinct token is scored once. The scores of the MOST_BROADCAST most
frequent are broadcast, all others meet the documents in a join, so no key of
that join is frequent; the way changes no score.

Defined cases: null texts are empty and have the end alone; without training
documents all counts are 0, the base score of a token is 0 (log10 of 0.1 / 0.1) and
the model's that of the untrained mixer; repeated rows are scored each; other
columns are ignored. A part takes about 100 bytes of memory for each byte of its
words, so a single word far longer than PART_BYTES takes as much more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_arrow, mix, powers, span_hashes, stored, utf8, word_spans

#: Slots of a table.
SLOTS, MOST_SLOTS = 1 << 16, 1 << 22
#: Bytes of the contexts that are counted in tables.
TABLED = (1, 2, 3)
#: The predictors: those, the word so far in its class, the word so far.
PREDICTORS = len(TABLED) + 2
#: Classes, bytes and buckets of short words; what came before is a class and a
#: bucket, or 0 if the word before isn't short.
CLASSES, SHORT, SHORTS = 16, 3, 32
BEFORE = CLASSES * (SHORTS + 1)
#: Words (with what came before) of one file, and bytes of one part of it.
FILE_WORDS = 60_000
PART_BYTES = 1 << 18
MOST_BROADCAST = 200_000
#: First weights, and the length of a weight's first step; later ones are as much
#: shorter as its slopes add up (AdaGrad).
START, RATE = 0.25, 0.05
GATES = 64
BINS = 33
#: Steps of the mixer's output for which log-probabilities are tabled.
FINE = 1025
#: Bits that learn at once.
STEP = 8192
#: Hash of the end of a text.
END = 0x5EED
#: Bytes of text that are taken at once, and words that a task adds up.
BLOCK = 4 << 20
GATHERED = 1_000_000


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def stretched(zeros, ones) -> np.ndarray:
    """A predictor's input from its counts."""
    return np.log((ones + np.float32(0.2)) / (zeros + np.float32(0.2)))


# tokens of texts


def classes_of(hashes: np.ndarray, sizes: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Class of each text, texts ending at word upto: by the most frequent of
    its short words' hash buckets."""
    n = np.diff(upto, prepend=0)
    short = np.flatnonzero(sizes <= SHORT)
    doc = np.searchsorted(upto, short, side="right")
    votes = np.bincount(doc * 256 + (hashes[short] >> np.uint64(56)).astype(np.int64), minlength=len(n) * 256).reshape(-1, 256)
    return votes.argmax(1) % CLASSES


def before(hashes: np.ndarray, sizes: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What came before each word, and before the end of each text: its class
    and the word before."""
    of_text, n = classes_of(hashes, sizes, upto), np.diff(upto, prepend=0)
    own = np.where(sizes <= SHORT, 1 + ((hashes >> np.uint64(40)) % np.uint64(SHORTS)).astype(np.int64), 0)
    last = np.zeros(len(n), np.int64)
    last[n > 0] = own[upto[n > 0] - 1]
    out = np.append(np.zeros(1, np.int64), own[:-1]) if len(own) else own
    out[(upto - n)[n > 0]] = 0
    base = of_text * (SHORTS + 1)
    return out + np.repeat(base, n), last + base


def keyed(hashes: np.ndarray, q: np.ndarray) -> np.ndarray:
    return mix(hashes + mix(q.astype(np.uint64) + np.uint64(1)))


#: Keys of the ends of texts, for each of what may come before.
ENDS = keyed(np.full(BEFORE, END, np.uint64), np.arange(BEFORE))


def blocks(batches):
    """(bytes of some texts, starts and ends of their words, ends of the texts
    in words), lower-cased, of at most BLOCK bytes or one text."""
    for batch in batches:
        some, held = [], 0
        for t in utf8(batch.column("text")):
            some.append(t or b"")
            held += len(some[-1])
            if held >= BLOCK:
                yield block(some)
                some, held = [], 0
        if some:
            yield block(some)


def block(texts: list[bytes]):
    data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    starts, ends = word_spans(data)
    upto = np.cumsum([len(t) + 1 for t in texts])
    return data, starts, ends, np.searchsorted(starts, upto)


def gather(texts: DataFrame, counted: bool) -> DataFrame:
    """key, word (with its space), q (what came before) and n (its occurrences,
    0 if they don't count) of the texts, the ends among them; what a task finds
    in several blocks is added up there, GATHERED rows at a time."""

    def merged(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(some).combine_chunks()
        key, first, at = np.unique(whole.column("key").to_numpy(), return_index=True, return_inverse=True)
        n = np.bincount(at, whole.column("n").to_numpy(), len(key)).astype(np.int64)
        taken = whole.select(["word", "q"]).take(pa.array(first)).combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array(key), *(c.chunk(0) for c in taken.columns), pa.array(n)], names=["key", "word", "q", "n"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for found in each(batches):
            held.append(found)
            if len(held) > 1 and sum(x.num_rows for x in held[1:]) >= held[0].num_rows:
                held = [merged(held)]
                if held[0].num_rows >= GATHERED:
                    yield held.pop()
        if held:
            yield merged(held)

    def each(batches):
        for data, starts, ends, upto in blocks(batches):
            hashes = span_hashes(data, starts, ends)
            q, of_end = before(hashes, ends - starts, upto)
            key, first, times = np.unique(keyed(hashes, q), return_index=True, return_counts=True)
            k, ended = np.unique(of_end, return_counts=True)
            # the words' bytes, each with a space, then those of the ends
            size = np.append(ends[first] - starts[first] + 1, np.ones(len(k), np.int64))
            upto = np.cumsum(size)
            at = np.arange(upto[-1]) - np.repeat(upto - size, size) + np.repeat(np.append(starts[first], np.zeros(len(k), np.int64)), size)
            flat = data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else np.zeros(len(at), np.uint8)
            flat[upto - 1] = 32
            word = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, upto).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
            columns = np.append(key, ENDS[k]).view(np.int64), np.append(q[first], k).astype(np.int32), np.append(times, ended) * counted
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), word, pa.array(columns[1]), pa.array(columns[2].astype(np.int64))], names=["key", "word", "q", "n"])

    return map_arrow(texts.select(F.col("text").cast("string").alias("text")), run, "key long, word binary, q int, n long")


# words in parts


def dealt(words: DataFrame) -> DataFrame:
    """words with part: those of one part are neighbours in one file, by ranges
    of word and sorted; a word is in one part, whatever came before it."""

    def number(batches):
        size, last, part = 0, None, 0
        for batch in batches:
            word = batch.column("word")
            length = pc.binary_length(word).to_numpy().astype(np.int64)
            turns = np.flatnonzero(np.append(word[0].as_py() != last, pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)))
            upto, at = np.cumsum(length), 0
            out = np.zeros(len(length), np.int64)
            while at < len(length):
                # the first new word once the part is full
                full = int(np.searchsorted(upto, upto[at] - length[at] + PART_BYTES - size)) + 1 if size < PART_BYTES else at
                turn = int(np.searchsorted(turns, full))
                end = int(turns[turn]) if turn < len(turns) else len(length)
                out[at:end] = part
                size += int(length[at:end].sum())
                if end < len(length):
                    size, part = 0, part + 1
                at = end
            last = word[-1].as_py()
            file = batch.column("file").to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(file << 32 | out)], names=["key", "word", "q", "n", "part"])

    count = max(-(-words.count() // FILE_WORDS), 1)
    ranged = words.repartitionByRange(count, "word").sortWithinPartitions("word", "q").select("key", "word", "q", "n", F.spark_partition_id().alias("file"))
    return stored(map_arrow(ranged, number, "key long, word binary, q int, n long, part long", 10_000), "parts")


def neighbours(words: DataFrame) -> dict[int, tuple[bytes | None, bytes | None]]:
    """For each part the last word before it and the first one after it."""
    ends = sorted((bytes(r.first), bytes(r.last), r.part) for r in words.groupBy("part").agg(F.min("word").alias("first"), F.max("word").alias("last")).collect())
    lasts, firsts = [None, *(r[1] for r in ends)], [*(r[0] for r in ends[1:]), None]
    return {r[2]: (last, first) for r, last, first in zip(ends, lasts, firsts)}


#: Leading zero bits of each byte.
_ZEROS = np.array([8 - x.bit_length() for x in range(256)])
_NODE, _PLACE = np.uint64(0x9E3779B1), np.uint64(0xC2B2AE3D27D4EB4F)


def shared_bits(x: bytes, y: bytes) -> int:
    """Bits that two words have in common at their start."""
    for i, (a, b) in enumerate(zip(x, y)):
        if a != b:
            return 8 * i + int(_ZEROS[a ^ b])
    return 8 * min(len(x), len(y))


def beginnings(word: bytes, bits: int) -> np.ndarray:
    """Hashes of the word's first 0, 1, ... bits - 1 bits."""
    data = np.frombuffer(word, np.uint8).astype(np.uint64)
    sums = np.cumsum((data + np.uint64(1)) * powers(len(data))) if len(data) else data
    sums = np.append(np.zeros(1, np.uint64), sums)
    i, j = np.divmod(np.arange(bits), 8)
    node = (1 << j) | (data[np.minimum(i, len(data) - 1)].astype(np.int64) >> (8 - j))
    return mix(sums[i] + i.astype(np.uint64) * _PLACE + node.astype(np.uint64) * _NODE)


class Part:
    """Sorted words with what came before them and their occurrences."""

    def __init__(self, rows: pa.Table, around: tuple[bytes | None, bytes | None]):
        word = pa.concat_arrays(rows.column("word").chunks).cast(pa.large_binary())
        upto = np.frombuffer(word.buffers()[1], np.int64)[word.offset : word.offset + len(word) + 1]
        self.data = np.frombuffer(word.buffers()[2], np.uint8)[upto[0] : upto[-1]]
        self.first, self.size = upto[:-1] - upto[0], np.diff(upto)
        self.key, self.q, self.n = (rows.column(c).to_numpy() for c in ("key", "q", "n"))
        self.k = self.q // (SHORTS + 1)
        self.of_byte = np.repeat(np.arange(len(self.size)), self.size)
        self.around = around
        self.link = self.links()
        # c: occurrences of the word, whatever came before
        starts = np.flatnonzero(self.link < 8 * self.size)
        self.c = np.repeat(np.add.reduceat(self.n, starts), np.diff(np.append(starts, len(self.n))))

    def links(self) -> np.ndarray:
        """Bits that each word shares with the one before, -1 for the first."""
        out = np.full(len(self.size), -1)
        live, i = np.arange(1, len(out)), 0
        while len(live):
            x, y = self.data[self.first[live - 1] + i], self.data[self.first[live] + i]
            other = x != y
            out[live[other]] = 8 * i + _ZEROS[x[other] ^ y[other]]
            live, i = live[~other], i + 1
            whole = self.size[live] == i  # the same word
            out[live[whole]] = 8 * i
            live = live[~whole]
        return out

    def word(self, row: int) -> bytes:
        return self.data[self.first[row] : self.first[row] + self.size[row]].tobytes()

    def edge_rows(self):
        """(key, zeros, ones) of each beginning that a neighbour may share, for
        every class and (CLASSES) for all."""
        key, zeros, ones = [], [], []
        left, right = self.around
        low = shared_bits(left, self.word(0)) if left is not None else -1
        inner = int(self.link[1:].min()) if len(self.link) > 1 else 8 * int(self.size[0])
        for word, most, rows in ((left, low, None), (right, shared_bits(right, self.word(-1)) if right is not None else -1, -1)):
            if word is None:
                continue
            # what each row shares with the edge falls from row to row
            if rows is None:
                run = np.minimum.accumulate(np.append(most, self.link[1:]))
            else:
                run = np.minimum.accumulate(np.append(most, self.link[:0:-1]))
            bits = min(most + 1, 8 * len(word))
            names = beginnings(word, bits)
            for d in range(bits):
                if rows is not None and d <= min(inner, low):
                    continue  # the left edge has it
                m = int(np.searchsorted(-run, -d, side="right"))
                some = slice(0, m) if rows is None else slice(len(run) - m, len(run))
                bit = (self.data[self.first[some] + d // 8] >> (7 - d % 8)) & 1
                count = np.bincount(self.k[some] * 2 + bit, self.n[some], 2 * CLASSES).reshape(-1, 2)
                met = np.flatnonzero(count.any(1))
                key.append(np.append(keyed(np.full(len(met), names[d]), met), keyed(names[d : d + 1], np.array([CLASSES]))))
                zeros.append(np.append(count[met, 0], count[:, 0].sum()))
                ones.append(np.append(count[met, 1], count[:, 1].sum()))
        none = np.zeros(0)
        return (np.concatenate(key) if key else np.zeros(0, np.uint64), np.concatenate([none, *zeros]), np.concatenate([none, *ones]))

    def runs(self, group: np.ndarray | None, over) -> tuple[np.ndarray, np.ndarray]:
        """Counts of zeros and ones after the beginning of each bit (8 x bytes),
        among rows of one group (None: all). over: keys and counts of edges."""
        count, link = len(self.n), self.link
        if group is None:
            order, begin, names = np.arange(count), np.zeros(1, np.int64), np.array([CLASSES])
        else:
            order = np.argsort(group, kind="stable")
            ranked = group[order]
            begin = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            names, link = ranked[begin], np.full(count, -1)
            for lo, hi in zip(begin, np.append(begin[1:], count)):
                own = order[lo:hi]
                if hi - lo > 1:
                    link[lo + 1 : hi] = np.minimum.reduceat(self.link[: own[-1] + 1], own[:-1] + 1)
        end = np.append(begin[1:], count) - 1
        first, n = self.first[order], self.n[order].astype(np.float64)
        deep = np.maximum(link, np.append(link[1:], -1))
        edges = []
        for at, word in ((begin, self.around[0]), (end, self.around[1])):
            reach = np.array([shared_bits(word, self.word(order[x])) for x in at]) if word is not None else np.full(len(at), -1)
            bits = min(int(reach.max()) + 1, 8 * len(word)) if word is not None else 0
            sums = np.zeros((2, bits, len(at)))
            if bits:
                key = keyed(np.repeat(beginnings(word, bits), len(at)), np.tile(names, bits))
                place = np.minimum(np.searchsorted(over[0], key), max(len(over[0]) - 1, 0))
                met = over[0][place] == key
                sums = np.stack([np.where(met, x[place], 0.0).reshape(bits, -1) for x in over[1:]])
            deep[at] = np.maximum(deep[at], np.minimum(reach, bits - 1))
            edges.append((at, np.minimum(reach, bits - 1), sums))
        deep = np.minimum(deep, 8 * self.size[order] - 1)
        # a beginning that no other word shares has that word's own occurrences
        own = self.n[self.of_byte].astype(np.float32)
        bits = (self.data >> np.arange(7, -1, -1, dtype=np.uint8)[:, None]) & 1
        ones = own * bits
        zeros = own - ones
        live = np.arange(count)
        for d in range(int(deep.max()) + 1 if count else 0):
            live = live[deep[live] >= d]
            i, j = divmod(d, 8)
            at, weight = first[live] + i, n[live]
            start = np.flatnonzero(link[live] < d)
            total, one = np.add.reduceat(weight, start), np.add.reduceat(weight * bits[j, at], start)
            zero = total - one
            for place, reach, sums in edges:
                some = np.flatnonzero(reach >= d)
                if len(some):
                    run = np.searchsorted(start, np.searchsorted(live, place[some]), side="right") - 1
                    zero[run], one[run] = sums[0, d, some], sums[1, d, some]
            times = np.diff(np.append(start, len(live)))
            zeros[j, at], ones[j, at] = np.repeat(zero, times), np.repeat(one, times)
        return zeros, ones

    def contexts(self) -> list[np.ndarray]:
        """For each of TABLED the hash of each byte's context: the bytes before
        it, and the word before if there are fewer, in the text's class."""
        place = np.arange(len(self.data)) - self.first[self.of_byte]
        own, q = self.data.astype(np.uint64) + np.uint64(1), (self.q % (SHORTS + 1))[self.of_byte].astype(np.uint64) + np.uint64(300)
        of_class = mix(self.k[self.of_byte].astype(np.uint64) + np.uint64(1))
        out, x = [], np.zeros(len(self.data), np.uint64)
        for n in TABLED:
            back = np.zeros(len(self.data), np.uint64)
            back[n:] = own[:-n]
            x = x + (np.where(place >= n, back, np.where(place == n - 1, q, np.uint64(0))) << np.uint64(9 * (n - 1)))
            out.append(mix(x * np.uint64(8) + np.uint64(n) + of_class))
        return out

    def nodes(self, j: int) -> np.ndarray:
        """What is added to a byte's context for its bit j."""
        return ((1 << j) | (self.data >> (8 - j)).astype(np.int64)).astype(np.uint64) * _NODE


def parts(batches, around):
    """(number, Part) of each part."""
    held, at = [], None
    for b in batches:
        own = b.column("part").to_numpy()
        turns = np.flatnonzero(np.diff(own)) + 1
        for lo, hi in zip([0, *turns.tolist()], [*turns.tolist(), len(own)]):
            if hi > lo:
                if held and own[lo] != at:
                    yield Part(pa.Table.from_batches(held), around[at])
                    held = []
                at = int(own[lo])
                held.append(b.slice(lo, hi - lo))
    if held:
        yield Part(pa.Table.from_batches(held), around[at])


# counts


def summed_by(*columns: np.ndarray):
    """Distinct first columns and sums of the others."""
    key, at = np.unique(columns[0], return_inverse=True)
    return key, *(np.bincount(at, x, len(key)) for x in columns[1:])


def count_contexts(words: DataFrame, around: dict) -> tuple[list[np.ndarray], tuple]:
    """Tables (slots x zeros, ones) of the contexts of a few bytes; keys, zeros
    and ones of the beginnings that reach over an edge of a part."""
    shipped = words.sparkSession.sparkContext.broadcast(around)

    def run(batches):
        held: list[list] = [[] for _ in TABLED]
        for part in parts(batches, shipped.value):
            times = part.n[part.of_byte].astype(np.float64)
            for i, x in enumerate(part.contexts()):
                pair, first, at = np.unique(x + part.data.astype(np.uint64) * _PLACE, return_index=True, return_inverse=True)
                # the byte is in the low bits, as it has to be known again
                held[i].append((pair, x[first], part.data[first], np.bincount(at, times, len(pair))))
                if len(held[i]) >= 8:
                    held[i] = [merged(held[i])]
            yield listed(-1, *part.edge_rows())
        for i in range(len(TABLED)):
            if held[i]:
                _, x, byte, n = merged(held[i])
                yield listed(i, x, byte.astype(np.float64), n)

    def merged(some):
        pair, first, at = np.unique(np.concatenate([x[0] for x in some]), return_index=True, return_inverse=True)
        return pair, *(np.concatenate([x[k] for x in some])[first] for k in (1, 2)), np.bincount(at, np.concatenate([x[3] for x in some]), len(pair))

    def listed(i, key, x, y):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i, np.int32)), pa.array(key.view(np.int64)), *(pa.array(z.astype(np.int64)) for z in (x, y))], names=["i", "key", "x", "y"])

    found = stored(map_arrow(words, run, "i int, key long, x long, y long"), "contexts")
    edge = found.filter("i < 0").groupBy("key").agg(F.sum("x").alias("zeros"), F.sum("y").alias("ones")).toArrow().sort_by("key")
    over = (edge.column("key").to_numpy().view(np.uint64), edge.column("zeros").to_numpy().astype(np.float64), edge.column("ones").to_numpy().astype(np.float64))
    order = np.argsort(over[0])

    def slots(batches):
        for b in batches:
            which, key, byte, n = (b.column(c).to_numpy() for c in ("i", "key", "x", "n"))
            for i in np.unique(which).tolist():
                own = which == i
                x, c, times = key[own].view(np.uint64), byte[own], n[own].astype(np.float64)
                at = np.concatenate([x + ((1 << j) | (c >> (8 - j))).astype(np.uint64) * _NODE for j in range(8)]) & np.uint64(MOST_SLOTS - 1)
                bit = np.concatenate([(c >> (7 - j)) & 1 for j in range(8)])
                slot, zeros, ones = summed_by(at, np.tile(times, 8) * (1 - bit), np.tile(times, 8) * bit)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), i, np.int32)), *(pa.array(z.astype(np.int64)) for z in (slot, zeros, ones))], names=["i", "slot", "zeros", "ones"])

    pairs = found.filter("i >= 0").groupBy("i", "key", "x").agg(F.sum("y").alias("n"))
    counts = map_arrow(pairs, slots, "i int, slot long, zeros long, ones long", 50_000).groupBy("i", "slot").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toArrow()
    which, slot, zeros, ones = (counts.column(c).to_numpy() for c in ("i", "slot", "zeros", "ones"))
    tables = []
    for i in range(len(TABLED)):
        own = which == i
        size = min(MOST_SLOTS, max(SLOTS, 1 << (2 * int(own.sum())).bit_length()))
        at = slot[own] & (size - 1)
        tables.append(np.stack([np.bincount(at, x[own], size) for x in (zeros, ones)], 1).astype(np.float32))
    shipped.destroy()
    return tables, tuple(x[order] for x in over)


# the mixer


class Mixer:
    """Weights by gate, and the map from the mixer's output."""

    def __init__(self):
        self.weights, self.steep = np.full((GATES, PREDICTORS), START), np.zeros((GATES, PREDICTORS))
        self.map = np.tile(squash(np.linspace(-8, 8, BINS)), (GATES, 1))
        self.seen, self.observed = np.zeros(GATES), np.zeros((2, GATES * BINS))
        self.logs = np.zeros(0, np.float32)

    @staticmethod
    def bin_of(x: np.ndarray) -> np.ndarray:
        step = np.float32((BINS - 1) / 16)
        return np.minimum(np.maximum(x * step + (8 * step + np.float32(0.5)), 0), BINS - 1).astype(np.int64)

    def learn(self, bit: np.ndarray, inputs: list[np.ndarray], gate: np.ndarray, times: np.ndarray) -> None:
        """Predict some bits, then adjust the weights and the map to them."""
        weights = self.weights.T.astype(np.float32)
        x = weights[0][gate] * inputs[0]
        for k in range(1, PREDICTORS):
            x += weights[k][gate] * inputs[k]
        at = gate * BINS + self.bin_of(x)
        hits = times * bit
        self.observed[0] += np.bincount(at, times, GATES * BINS)
        self.observed[1] += np.bincount(at, hits, GATES * BINS)
        error = hits - times * squash(x)
        total = np.bincount(gate, times, GATES)
        self.seen += total
        slope = np.stack([np.bincount(gate, error * own, GATES) for own in inputs], 1) / np.maximum(total, 1)[:, None]
        self.steep += slope * slope
        self.weights += RATE * slope / np.sqrt(self.steep + 1e-12)

    def chart(self) -> None:
        """The adaptive map, from what was observed."""
        seen, hits = self.observed.reshape(2, GATES, BINS)
        prior = squash(np.linspace(-8, 8, BINS))[None, :]
        self.map = np.clip((hits + 20 * prior) / (seen + 20), 1e-5, 1 - 1e-5)

    def settle(self) -> None:
        """Table the logs of both bits' probabilities for each gate and step."""
        x, gate = np.tile(np.linspace(-8, 8, FINE), GATES), np.repeat(np.arange(GATES), FINE)
        p = (squash(x) + self.map[gate, self.bin_of(x)]) / 2
        self.logs = np.log10(np.stack((1 - p, p), 1)).astype(np.float32).ravel()

    def log10(self, bit: np.ndarray, inputs, gate: np.ndarray) -> np.ndarray:
        weights = self.weights.T.astype(np.float32)
        x = sum(own * weights[k][gate] for k, own in enumerate(inputs))
        step = np.clip(x * np.float32((FINE - 1) / 16) + np.float32((FINE - 1) / 2 + 0.5), 0, FINE - 1).astype(np.int64)
        return self.logs[(gate * FINE + step) * 2 + bit]


def gates(total: np.ndarray, j: int) -> np.ndarray:
    return np.minimum(np.frexp(total + 1)[1] - 1, 7).astype(np.int64) * 8 + j


def without(tables: list[np.ndarray]) -> list[np.ndarray]:
    """For each slot and bit the input with that bit left out once."""
    return [np.stack((stretched(np.maximum(x[:, 0] - 1, 0), x[:, 1]), stretched(x[:, 0], np.maximum(x[:, 1] - 1, 0))), 1).ravel() for x in tables]


def train(part: Part, mixer: Mixer, left_out: list[np.ndarray], over) -> None:
    """Learn from every occurrence of the part's words, STEP bytes at a time:
    every so many-th byte of the part, so that a step has words from all over."""
    seen = np.flatnonzero(part.n[part.of_byte] > 0)
    if not len(seen):
        return
    steps = -(-len(seen) // STEP)

    def dealt(x: np.ndarray) -> np.ndarray:
        """The columns of the bytes that were seen, steps x bytes of a step."""
        x = x[..., seen]
        spare = -x.shape[-1] % steps
        x = np.concatenate((x, np.zeros((*x.shape[:-1], spare), x.dtype)), -1)  # spare ones count 0 times
        return np.ascontiguousarray(np.moveaxis(x.reshape(*x.shape[:-1], -1, steps), -1, -2))

    bits = (part.data >> np.arange(7, -1, -1, dtype=np.uint8)[:, None]) & 1
    trees = []
    for group in (part.k, None):
        zeros, ones = part.runs(group, over)
        gate = dealt(np.minimum(np.frexp(np.maximum(zeros + ones - 1, 0) + 1)[1] - 1, 7).astype(np.int8)) if group is None else None
        trees.append(dealt(stretched(np.maximum(zeros - (1 - bits), 0), np.maximum(ones - bits, 0))))
    contexts, data, times = [dealt(x) for x in part.contexts()], dealt(part.data.astype(np.int64)), dealt(part.n[part.of_byte].astype(np.float32))
    for i in range(steps):
        own = data[i]
        for j in range(8):
            bit = (own >> (7 - j)) & 1
            node = ((1 << j) | (own >> (8 - j))).astype(np.uint64) * _NODE
            inputs = [t[((x[i] + node) & np.uint64(len(t) // 2 - 1)).astype(np.int64) * 2 + bit] for x, t in zip(contexts, left_out)]
            mixer.learn(bit, [*inputs, *(t[j, i] for t in trees)], gate[j, i].astype(np.int64) * 8 + j, times[i])


def spelled(part: Part, mixer: Mixer, logs: list[np.ndarray], over) -> np.ndarray:
    """log10 of the probability of each of the part's words."""
    contexts, out = part.contexts(), np.zeros(len(part.data), np.float64)
    counts = [part.runs(group, over) for group in (part.k, None)]
    for j in range(8):
        slots = [((x + part.nodes(j)) & np.uint64(len(t) - 1)).astype(np.int64) for x, t in zip(contexts, logs)]
        inputs = [*(t[s] for s, t in zip(slots, logs)), *(stretched(zeros[j], ones[j]) for zeros, ones in counts)]
        bit = ((part.data >> (7 - j)) & 1).astype(np.int64)
        out += mixer.log10(bit, inputs, gates(counts[1][0][j] + counts[1][1][j], j))
    return np.add.reduceat(out, part.first)


def learn(words: DataFrame) -> tuple:
    """What is needed to score words: the parts' neighbours, counts across
    edges, logs of the tables, the mixer."""
    around = neighbours(words)
    tables, over = count_contexts(words, around)
    shipped = words.sparkSession.sparkContext.broadcast((around, without(tables), over))

    def run(batches):
        around, left_out, over = shipped.value
        mixer = Mixer()  # goes on from part to part
        total = np.zeros((GATES, PREDICTORS))
        for part in parts(batches, around):
            seen = mixer.seen.copy()
            train(part, mixer, left_out, over)
            total += mixer.weights * (mixer.seen - seen)[:, None]
        own = np.concatenate((mixer.seen, total.ravel(), mixer.observed.ravel()))
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(own[some])], names=["i", "x"])

    sums = map_arrow(words, run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    found = np.zeros(GATES * (1 + PREDICTORS + 2 * BINS))
    found[sums.column("i").to_numpy()] = sums.column("x").to_numpy()
    shipped.destroy()
    mixer = Mixer()
    mixer.seen, total, mixer.observed = found[:GATES], found[GATES : GATES * (1 + PREDICTORS)].reshape(GATES, -1), found[GATES * (1 + PREDICTORS) :].reshape(2, -1)
    met = mixer.seen > 0
    mixer.weights[met] = total[met] / mixer.seen[met, None]
    mixer.chart()
    mixer.settle()
    return around, [stretched(x[:, 0], x[:, 1]) for x in tables], over, mixer


def scored(words: DataFrame, learned: tuple) -> DataFrame:
    """key, n, c (occurrences, whatever came before) and lm (log10 of the
    probability) of each word with what came before."""
    shipped = words.sparkSession.sparkContext.broadcast(learned)

    def run(batches):
        around, logs, over, mixer = shipped.value
        for part in parts(batches, around):
            yield pa.RecordBatch.from_arrays([pa.array(part.key), pa.array(part.n), pa.array(part.c), pa.array(spelled(part, mixer, logs, over))], names=["key", "n", "c", "lm"])

    out = stored(map_arrow(words, run, "key long, n long, c long, lm double"), "scores")
    shipped.destroy()
    return out


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """docs' doc_id and held_out with n_tokens, n_known, train_tokens,
    base_score, score, n_bytes, bits_per_byte; docs that aren't held out are
    among training."""
    spark = docs.sparkSession
    gathered = gather(training, True).union(gather(docs.filter("held_out"), False))
    words = dealt(stored(gathered.groupBy("key").agg(F.first("word").alias("word"), F.first("q").alias("q"), F.sum("n").alias("n")), "words"))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct(F.when(F.col("n") > 0, F.xxhash64("word")))).first()
    scores = scored(words, learn(words))
    # the least count that no more than MOST_BROADCAST reach, by powers of 2^(1/8)
    level = F.floor(8 * F.log2(F.col("n") + 1))
    reach, least = 0, None
    for r in scores.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("level")).collect():
        reach += r.c
        if reach > MOST_BROADCAST:
            break
        least = r.level
    hot = scores.filter(F.col("key").isin(ENDS.view(np.int64).tolist()) | (F.lit(False) if least is None else level >= least)).toArrow().sort_by("key")
    shipped = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("key", "c", "lm")))

    def first(batches):
        keys, own_c, own_lm = shipped.value
        last = max(len(keys) - 1, 0)
        for batch in batches:
            start = 0
            for data, starts, ends, upto in blocks([batch]):
                docs_here, n = len(upto), np.diff(upto, prepend=0)
                hashes = span_hashes(data, starts, ends)
                q, of_end = before(hashes, ends - starts, upto)
                each = np.concatenate((keyed(hashes, q), ENDS[of_end])).view(np.int64)
                doc = np.concatenate((np.repeat(np.arange(docs_here), n), np.arange(docs_here)))
                h, at = np.unique(each, return_inverse=True)
                place = np.minimum(np.searchsorted(keys, h), last)
                is_hot = keys[place] == h
                c, lm, w = own_c[place][at], own_lm[place][at], is_hot[at].astype(np.float64)
                base = np.bincount(doc, np.log10(c + 0.1) * w, docs_here)
                mine = np.bincount(doc, lm * w, docs_here) - np.log10(CLASSES)
                known = np.bincount(doc, w * (c > 0), docs_here).astype(np.int64)
                rare = np.flatnonzero(~is_hot[at])
                size = len(h)
                pair, times = np.unique(doc[rare] * size + at[rare], return_counts=True)
                offsets, word = pa.array(np.searchsorted(pair, np.arange(docs_here + 1) * size), pa.int32()), pair % size
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h[word], times.astype(np.int32))]
                part = batch.slice(start, docs_here)
                start += docs_here
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("held_out"), part.column("rid"), pa.array(n.astype(np.int64) + 1), pa.array(known), pa.array(base), pa.array(mine),
                        pa.array([len(t or b"") for t in utf8(part.column("text"))], pa.int64()), *lists,
                    ],
                    names=["doc_id", "held_out", "rid", "n_tokens", "known", "base", "mine", "n_bytes", "keys", "n"],
                )

    rows = docs.select("doc_id", "held_out", F.monotonically_increasing_id().alias("rid"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = stored(map_arrow(rows, first, f"doc_id {kind}, held_out boolean, rid long, n_tokens long, known long, base double, mine double, n_bytes long, keys array<long>, n array<int>"), "scored")
    rare = known.select("rid", F.explode(F.arrays_zip("keys", "n")).alias("x")).select("rid", F.col("x.keys").alias("key"), "x.n")
    met = rare.join(scores.drop("n"), "key").select("rid", (F.col("n") * F.log10(F.col("c") + 0.1)).alias("base_rare"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).cast("long").alias("known_rare"), (F.col("n") * F.col("lm")).alias("mine_rare"))
    sums = met.groupBy("rid").agg(F.sum("base_rare").alias("base_rare"), F.sum("known_rare").alias("known_rare"), F.sum("mine_rare").alias("mine_rare"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    out = known.drop("keys", "n").join(sums, "rid", "left")
    norm = float(np.log10(total + 0.1 * (distinct + 1)))
    mine = F.col("mine") + zero("mine_rare")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("known_rare")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_rare") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), mine.alias("score"), "n_bytes",
        F.when(F.col("n_bytes") > 0, -mine * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def report(docs: DataFrame) -> DataFrame:
    out = held_out(10, 0)
    rows = docs.select("doc_id", "text", out.alias("held_out"))
    found = score(rows, rows.filter(~out))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
