"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in the
features of its distinct words (the word, its beginnings and its ends, so that
inflected and derived forms share evidence), a document's is the noisy-or of
its sentences, 1 - product(1 - p). Only documents have labels; the gradient of
the noisy-or gives each sentence its share, so that the same weights locate the
offending sentences afterwards.

The weights are fitted on a bounded sample of labelled rows: of each label the
first in the order of a hash, up to FIT_ROWS rows or FIT_BYTES of whole texts,
whichever comes first (no text is passed over for its length). All documents are
scored, whole.

Defined cases: null and empty texts have no sentence and score 0; null labels
aren't learned from; of repeated doc_ids in labels any labels it toxic; without
labelled rows of both kinds all scores are 0; repeated rows get equal scores;
drop_toxic() keeps all columns, whatever they are called.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_arrow, utf8

FIT_ROWS = 2000
FIT_BYTES = 6 << 20
#: Features are hash buckets.
BUCKETS = 1 << 20
#: A feature must be in so many of the sample's documents.
LEAST_DOCUMENTS = 3
EPOCHS = 30
RATE = 0.3
L1 = 2e-4
START_BIAS = -7.0
MEMO = 400_000

#: Bytes that end a sentence become line feeds, other ASCII that is no letter
#: or digit becomes a space.
SENTENCE_TABLE = bytes(10 if c in b".!?\n\r" else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def sentences(text: bytes) -> list[bytes]:
    lowered = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return lowered.translate(SENTENCE_TABLE).split(b"\n")


def features(word: bytes) -> list[int]:
    """Buckets of the word, its beginnings of 3 to 7 and its ends of 3 to 5
    characters."""
    w = word.decode("utf-8", "replace")
    n = len(w)
    parts = [f"={w}", *(f"^{w[:k]}" for k in range(3, min(n, 8))), *(f"${w[-k:]}" for k in range(3, min(n, 6)))]
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


class Model:
    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.memo: dict[bytes, float] = {}

    def word(self, word: bytes) -> float:
        z = self.memo.get(word)
        if z is None:
            get = self.weights.get
            z = sum(get(f, 0.0) for f in features(word))
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = z
        return z

    def logits(self, text: bytes) -> list[tuple[int, float]]:
        """(place, logit) of every sentence with a word."""
        if not self.weights:
            return []
        word, out = self.word, []
        for at, s in enumerate(sentences(text)):
            words = set(s.split())
            if words:
                out.append((at, self.bias + sum(map(word, words))))
        return out

    def score(self, text: bytes) -> float:
        z = np.array([x for _, x in self.logits(text)])
        return float(-np.expm1(-np.logaddexp(0, z).sum())) if len(z) else 0.0

    def worst(self, text: bytes, least: float = 0.5) -> list[tuple[int, float]]:
        """Sentences (place, probability) that reach least by themselves."""
        p = ((at, 1 / (1 + np.exp(-max(z, -500.0)))) for at, z in self.logits(text))
        return [(at, float(x)) for at, x in p if x >= least]


def fit(positive: list[bytes], negative: list[bytes], weight: float = 1.0) -> Model:
    """Weights from toxic and other texts; weight: of a negative one, which may
    be sampled more thinly. Proximal AdaGrad over the noisy-or's likelihood."""
    if not positive or not negative:
        return Model({}, START_BIAS)
    at: dict[bytes, int] = {}
    word_features, word_ends = array("i"), array("i", [0])
    words_flat, lengths, sizes = array("i"), array("i"), []
    frequency = np.zeros(BUCKETS, np.int32)
    for text in [*positive, *negative]:
        used, present = 0, set()
        for s in sentences(text):
            own = set(s.split())
            if own:
                for w in own:
                    i = at.get(w)
                    if i is None:
                        i = at[w] = len(at)
                        word_features.extend(features(w))
                        word_ends.append(len(word_features))
                    words_flat.append(i)
                    present.add(i)
                lengths.append(len(own))
                used += 1
        sizes.append(used)
        seen = {f for i in present for f in word_features[word_ends[i] : word_ends[i + 1]]}
        frequency[list(seen)] += 1
    del at
    # features of too few documents fall away; the others are numbered anew
    number = np.full(BUCKETS, -1, np.int32)
    names = np.flatnonzero(frequency >= LEAST_DOCUMENTS)
    number[names] = np.arange(len(names))
    of_feature, ends = number[np.frombuffer(word_features, np.int32)], np.frombuffer(word_ends, np.int32)
    n_kept = np.concatenate(([0], np.cumsum(of_feature >= 0)))[ends]
    of_feature = of_feature[of_feature >= 0]
    # words to features, sentence by sentence
    w = np.frombuffer(words_flat, np.int32)
    n = np.diff(n_kept)[w]
    upto = np.cumsum(n)
    flat = of_feature[np.arange(upto[-1] if len(upto) else 0) + np.repeat(n_kept[w] - (upto - n), n)]
    of_sentence = np.repeat(np.arange(len(lengths)), lengths)
    lengths = np.bincount(of_sentence, n, len(lengths)).astype(np.int64)
    del w, n, upto, of_sentence, word_features, words_flat
    y = np.r_[np.ones(len(positive)), np.zeros(len(negative))]
    keep = np.array(sizes) > 0
    y, sizes = y[keep], np.array(sizes)[keep]
    sentence_ends, doc_ends = np.r_[0, np.cumsum(lengths)], np.r_[0, np.cumsum(sizes)]
    w, g2 = np.zeros(len(names)), np.full(len(names), 1e-6)
    bias, b2 = START_BIAS, 1e-6
    rng = np.random.default_rng(7)
    batches = np.array_split(rng.permutation(len(y)), max(1, len(y) // 200))
    for _ in range(EPOCHS):
        for docs in batches:
            s = np.concatenate([np.arange(doc_ends[d], doc_ends[d + 1]) for d in docs])
            of = np.repeat(np.arange(len(docs)), sizes[docs])
            n = lengths[s]
            ends = np.cumsum(n)
            take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(sentence_ends[s] - (ends - n), n)
            ids, row = flat[take], np.repeat(np.arange(len(s)), n)
            z = bias + np.bincount(row, w[ids], len(s))
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            none = np.exp(-np.bincount(of, np.logaddexp(0, z), len(docs)))
            share = np.where(y[docs] == 1, -none / np.maximum(1 - none, 1e-9), weight)
            gz = p * share[of] / len(docs)
            g = np.bincount(ids, gz[row], len(names))
            g2 += g * g
            step = RATE / np.sqrt(g2)
            w -= step * g
            w = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
            gb = gz.sum()
            b2 += gb * gb
            bias = min(bias - RATE / np.sqrt(b2) * gb, -4.0)
    return Model({int(f): float(x) for f, x in zip(names, w) if abs(x) > 1e-3}, float(bias))


def sample(docs: DataFrame, labels: DataFrame, toxic: int, rows: int, most_bytes: int) -> tuple[list[bytes], int]:
    """Texts of at most rows labelled documents, and how many there are."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter((F.col("toxic") == toxic) & ~held_out(5, 0))
    total = known.count()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id")
    found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id", "left_semi")
    out, held = [], 0
    for r in found.filter("text is not null").orderBy(F.xxhash64("doc_id"), "text").toLocalIterator():
        if out and held + len(r.text) > most_bytes:
            break
        out.append(bytes(r.text))
        held += len(r.text)
    return out, total


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> Model:
    positive, n1 = sample(docs, labels, 1, rows, most_bytes)
    negative, n0 = sample(docs, labels, 0, rows, most_bytes)
    # as if both kinds were sampled at one rate
    thinner = (n0 / max(1, len(negative))) / max(1e-9, n1 / max(1, len(positive)))
    return fit(positive, negative, min(thinner, 10.0))


def scored(docs: DataFrame, model: Model, schema, add) -> DataFrame:
    """docs mapped by add(batch, scores); scores: of every whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches):
        own = Model(*shipped.value)
        for batch in batches:
            yield add(batch, np.array([own.score(t) if t else 0.0 for t in utf8(batch.column("text"))]))

    return map_arrow(docs, run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def add(batch, scores):
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(5, 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return scored(rows, learn(docs, labels), f"doc_id {kind}, held_out boolean, score double, predicted int", add)


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs that score below least."""
    return scored(docs, learn(docs, labels), docs.schema, lambda batch, scores: batch.filter(pa.array(scores < least)))
