"""Language identification of mixed-language text.

Each word (a run of letters) has a script, by ranges of code points; the
languages that were seen to use the script are its candidates. A word's score
for a candidate is the mean log-probability of its character n-grams, times its
number of n-grams up to a bound, so that long words don't outweigh the rest.
Viterbi over the words of a text, with a penalty for each switch, labels spans;
the text's language is that of most letters.

The n-gram counts are gathered from all training documents, into BUCKETS hash
buckets per language, or fewer where that many times the languages would be more
than TABLE numbers: the table that is broadcast is bounded, whatever is learned.

Texts of more than LONG words are labelled block by block: forwards for the state
at the start of each block, then backwards, each block made anew for its path.
So memory is bounded by the languages times a block, not by a text.

Defined cases: null texts and texts without a letter are und, score 0; rows
without lang or text aren't learned from; without any training row all are und;
of two languages with equally many letters the smaller name is taken; repeated
rows get equal results; columns named lang_pred or score are replaced, other
columns of docs but text are kept.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, held_out, map_arrow, mix, utf8

#: 2^16, as buckets are the upper 16 bits of a hash.
BUCKETS = 1 << 16
NGRAMS = (1, 2, 3, 4)
SWITCH = 20.0
#: A word counts as so many n-grams at most.
MOST_NGRAMS = 12
#: Share of a language's letters that a script must have.
SCRIPT_SHARE = 0.001
#: Scores (words times languages) that a worker keeps before it starts anew.
MEMO = 1_600_000
#: Numbers in the table that is broadcast.
TABLE = 1 << 25
#: Words (or stretches between spaces) of a text that is taken whole, and of a
#: block of a longer one; cells of texts that are taken together.
LONG = 20_000
CELLS = 1 << 19

#: Ranges of code points and their scripts (Unicode blocks).
SCRIPTS = (
    (0x0041, 0x024F, "Latin"), (0x0250, 0x02AF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"), (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0E00, 0x0E7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x30FF, "Kana"), (0x3400, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
)

_ENDS = [hi for _, hi, _ in SCRIPTS]
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
#: ASCII that is no letter, as spaces; the rest is cut where it is rare.
_CUT = bytes(c if c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def script_of(char: str) -> str:
    code = ord(char)
    at = bisect.bisect_left(_ENDS, code)
    return SCRIPTS[at][2] if at < len(SCRIPTS) and SCRIPTS[at][0] <= code else "Other"


def words_of(piece: bytes) -> list[str]:
    """Lower-case words in a stretch without ASCII other than letters."""
    if piece.isascii():
        return [piece.decode().lower()]
    text = piece.decode("utf-8", "replace").lower()
    return [text] if text.isalpha() else [w for w in _WORD.findall(text) if _LETTER.search(w)]


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word and bucket of every n-gram of bytes in the words, each of which
    has a space before and after it."""
    data = np.frombuffer(f" {' '.join(words)} ".encode(), np.uint8)
    cut = data == 32
    word = np.cumsum(cut) - 1
    places = np.arange(len(data))
    after = np.append(np.flatnonzero(cut), len(data))[word + 1]
    value, at, bucket = np.zeros(len(data), np.uint64), [], []
    for n in range(1, max(NGRAMS) + 1):
        value = value[: len(data) - n + 1] * np.uint64(256) + data[n - 1 :]
        if n in NGRAMS:
            keep = np.flatnonzero((places[: len(value)] + n - 1 <= after[: len(value)]) & (word[: len(value)] < len(words)))
            at.append(word[keep])
            bucket.append(mix(value[keep] * np.uint64(8) + np.uint64(n)) >> np.uint64(48))
    return np.concatenate(at), np.concatenate(bucket).astype(np.int64)


def pieces(text: bytes | None) -> list[bytes]:
    return text.translate(_CUT).split() if text else []


def count_ngrams(docs: DataFrame) -> DataFrame:
    """lang, kind (0: n-gram bucket, 1: script), at, n over all documents with
    a lang and a text."""

    def run(batches):
        found: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text"))):
                found[lang].update(pieces(text))
            if sum(map(len, found.values())) > 400_000:
                yield emit(found)
                found.clear()
        yield emit(found)

    def emit(found):
        langs, kinds, ats, ns = [], [], [], []
        for lang, counts in found.items():
            buckets, scripts, words, times = np.zeros(BUCKETS), Counter(), [], []
            for piece, n in counts.items():
                for w in words_of(piece):
                    words.append(w)
                    times.append(n)
                    scripts["Latin" if w[0] < "\x80" else script_of(w[0])] += n * len(w)
            for some in range(0, len(words), 50_000):
                word, bucket = ngrams(words[some : some + 50_000])
                buckets += np.bincount(bucket, np.array(times[some : some + 50_000])[word], BUCKETS)
            at = np.flatnonzero(buckets)
            langs += [lang] * (len(at) + len(scripts))
            kinds += [0] * len(at) + [1] * len(scripts)
            ats += [*map(str, at.tolist()), *scripts]
            ns += [*buckets[at].astype(np.int64).tolist(), *scripts.values()]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(kinds, pa.int32()), pa.array(ats, pa.string()), pa.array(ns, pa.int64())], names=["lang", "kind", "at", "n"])

    known = docs.filter("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return map_arrow(known, run, "lang string, kind int, at string, n long").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n"))


class Model:
    """Scores words and labels spans; table: buckets x languages."""

    def __init__(self, langs: list[str], table: np.ndarray, scripts: dict[str, list[int]]):
        self.langs, self.table, self.scripts = langs, table, scripts
        self.fresh()

    def fresh(self) -> None:
        self.memo: dict[bytes, tuple[int, int]] = {}
        self.scores = np.zeros((0, len(self.langs)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def words(self, words: list[str]) -> np.ndarray:
        """Scores of words: words x languages."""
        word, bucket = ngrams(words)
        bucket &= len(self.table) - 1
        count = np.bincount(word, minlength=len(words))
        out = np.stack([np.bincount(word, column[bucket], len(words)) for column in self.table.T], 1)
        out *= (np.minimum(count, MOST_NGRAMS) / count)[:, None]
        for i, w in enumerate(words):
            own = self.scripts.get("Latin" if w[0] < "\x80" else script_of(w[0]))
            if own is not None and len(own) < len(self.langs):
                barred = np.ones(len(self.langs), bool)
                barred[own] = False
                out[i, barred] = out[i].min() - 20.0
        return out

    def learn(self, new: list[bytes]) -> None:
        if (len(self.letters) + len(new)) * len(self.langs) > MEMO:
            self.fresh()
        words, at = [], len(self.letters)
        for piece in new:
            own = words_of(piece)
            self.memo[piece] = (at, at + len(own))
            at += len(own)
            words += own
        if words:
            self.scores = np.concatenate((self.scores, self.words(words).astype(np.float32)))
            self.letters = np.concatenate((self.letters, [len(w) for w in words]))

    def prepare(self, texts: list[list[bytes]]) -> None:
        """Learn the texts' new words in one go."""
        new = dict.fromkeys(p for t in texts for p in set(t) if p not in self.memo)
        if new and self.langs:
            self.learn(list(new))

    def rows(self, parts: list[bytes]) -> np.ndarray:
        """Rows of scores of the words in the pieces, in order."""
        memo = self.memo
        found = list(map(memo.get, parts))
        if None in found:
            before = self.memo
            self.learn(list(dict.fromkeys(p for p, x in zip(parts, found) if x is None)))
            if self.memo is not before:
                self.learn(list(dict.fromkeys(p for p in parts if p not in self.memo)))
            found = list(map(self.memo.get, parts))
        span = np.array(found, np.int64).reshape(-1, 2)
        n = span[:, 1] - span[:, 0]
        if (n == 1).all():
            return span[:, 0]
        ends = np.cumsum(n)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(span[:, 0] - (ends - n), n)

    def spans(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Language of each word, and its letters, for each text."""
        none = np.zeros(0, np.int64)
        if not self.langs:
            return [(none, none)] * len(texts)
        out: list = [(none, none)] * len(texts)
        parts = [pieces(t) for t in texts]
        at = 0
        while at < len(parts):
            # together as many as fit in CELLS, or a long one by itself
            some, held = [], 0
            while at < len(parts) and len(parts[at]) <= LONG and (not some or held + len(parts[at]) * len(self.langs) <= CELLS):
                held += len(parts[at]) * len(self.langs)
                some.append(at)
                at += 1
            if not some:
                out[at] = self.long(parts[at])
                at += 1
                continue
            self.prepare([parts[i] for i in some])
            held_rows = []
            for i in some:
                r = self.rows(parts[i])  # may start the memo anew, so take what it gives now
                held_rows.append((self.scores[r], self.letters[r]))
            for i, path, (_, letters) in zip(some, viterbi([x for x, _ in held_rows], SWITCH), held_rows):
                out[i] = (path, letters)
        return out

    def long(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As spans(), for one text, by blocks."""

        def block(at: int) -> tuple[np.ndarray, np.ndarray]:
            r = self.rows(parts[at : at + LONG])
            return self.scores[r], self.letters[r]

        states, state, letters = [], None, []
        for at in range(0, len(parts), LONG):
            score, own = block(at)
            states.append(state)
            letters.append(own)
            _, state = steps(score, SWITCH, state)
        if state is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        paths, last = [], int(state.argmax())
        for n in range(len(states) - 1, -1, -1):
            back, _ = steps(block(n * LONG)[0], SWITCH, states[n])
            path = np.zeros(len(back), np.int64)
            for t in range(len(back) - 1, -1, -1):
                path[t], last = last, int(back[t, last])
            paths.append(path)
        return np.concatenate(paths[::-1]), np.concatenate(letters)

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        out = []
        for path, letters in self.spans(texts):
            if len(path):
                share = np.bincount(path, letters, len(self.langs))
                best = int(share.argmax())
                out.append((self.langs[best], float(share[best] / share.sum())))
            else:
                out.append(("und", 0.0))
        return out


def constant(score: np.ndarray, penalty: float) -> int | None:
    """The label of the best path, if that has no switch.

    No path beats the best constant one if no stretch gains more by another
    label than one switch costs, nor a stretch from the first word and one to
    the last together: k stretches have k switches at least, or k - 1 if the
    best label is nowhere, and then the first and the last are among them."""
    best = int(score.sum(0, dtype=np.float64).argmax())
    gain = np.cumsum(score - score[:, [best]], 0, dtype=np.float64)
    before = np.vstack((np.zeros(gain.shape[1]), gain[:-1]))
    stretch = (gain - np.minimum.accumulate(before, 0)).max()
    return best if max(stretch, gain.max() + (gain[-1] - before).max()) <= penalty else None


def steps(score: np.ndarray, penalty: float, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """For each word and label the label before it on the best path, and the
    values of the best paths after the last word, from those before the first
    (None: the text starts here)."""
    own = np.arange(score.shape[1])
    back = np.zeros(score.shape, np.int16)
    for t, row in enumerate(score.astype(np.float64)):
        if state is None:
            state, back[t] = row, own
            continue
        top = int(state.argmax())
        other = state[top] - penalty
        back[t] = np.where(other > state, top, own)
        state = np.maximum(state, other) + row
    return back, state


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Labels of the best path through each score (words x labels), less
    penalty for each switch. Paths that switch are found step by step, for
    texts of about the same length at once, of CELLS cells together or one."""
    out: list = [np.zeros(0, np.int64)] * len(scores)
    left = []
    for i, score in enumerate(scores):
        if len(score):
            label = constant(score, penalty)
            if label is None:
                left.append(i)
            else:
                out[i] = np.full(len(score), label)
    left.sort(key=lambda i: -len(scores[i]))
    while left:
        n = max(1, CELLS // scores[left[0]].size)
        some, left = left[:n], left[n:]
        for i, path in zip(some, together([scores[i] for i in some], penalty)):
            out[i] = path
    return out


def together(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best paths through scores, of which the longest is the first."""
    sizes = np.array([len(x) for x in scores])
    k, most = scores[0].shape[1], int(sizes[0])
    padded = np.zeros((most, len(scores), k), np.float32)
    for j, x in enumerate(scores):
        padded[: sizes[j], j] = x
    back = np.zeros((most, len(scores), k), np.int16)
    own, docs = np.arange(k), np.arange(len(scores))
    state = padded[0].astype(np.float64)
    for t in range(1, most):
        live = int(np.searchsorted(-sizes, -t))  # texts longer than t come first
        here = state[:live]
        top = here.argmax(1)
        other = here[docs[:live], top][:, None] - penalty
        switch = other > here
        back[t, :live] = np.where(switch, top[:, None], own)
        state[:live] = np.where(switch, other, here) + padded[t, :live]
    path = np.zeros((most, len(scores)), np.int64)
    path[sizes - 1, docs] = state.argmax(1)
    for t in range(most - 1, 0, -1):
        live = int(np.searchsorted(-sizes, -t))
        path[t - 1, :live] = back[t, docs[:live], path[t, :live]]
    return [path[: sizes[j], j].copy() for j in range(len(scores))]


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray, dict[str, list[int]]]:
    rows = cut(count_ngrams(docs))
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    buckets = BUCKETS
    while buckets * len(langs) > TABLE and buckets > 256:
        buckets //= 2
    place = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((buckets, len(langs)), np.float32)
    scripts: dict[str, Counter] = defaultdict(Counter)
    for r in rows.toLocalIterator():
        if r.kind == 0:
            counts[int(r.at) & (buckets - 1), place[r.lang]] += r.n
        else:
            scripts[r.lang][r.at] = r.n
    if not langs:
        return [], counts, {}
    total = counts.sum(0, dtype=np.float64) + 0.5 * buckets
    table = np.log((counts + np.float32(0.5)) / total.astype(np.float32))
    of_script: dict[str, list[int]] = defaultdict(list)
    for i, x in enumerate(langs):
        total = sum(scripts[x].values())
        for name, n in scripts[x].items():
            if n >= SCRIPT_SHARE * total:
                of_script[name].append(i)
    return langs, table.astype(np.float32), dict(of_script)


def identify(docs: DataFrame, training: DataFrame) -> DataFrame:
    """docs' columns with lang_pred and score; learned from training."""
    shipped = docs.sparkSession.sparkContext.broadcast(learn(training))
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches):
        own = Model(*shipped.value)
        for batch in batches:
            texts = utf8(batch.column("text"))
            found = []
            for some in chunks(texts, 200):
                found += own.predict(some)
            lang, score = zip(*found) if found else ((), ())
            keep = [c for c in names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names and f.name != "text")
    return map_arrow(docs.select(*names), run, f"{schema}, lang_pred string, score double")


def label_spans(model: Model, text: bytes | None) -> list[tuple[str, int, int]]:
    """(language, first word, number of words) of the text's spans."""
    path, _ = model.spans([text])[0]
    if not len(path):
        return []
    starts = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
    return [(model.langs[path[s]], int(s), int(e - s)) for s, e in zip(starts, [*starts[1:], len(path)])]


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    out = held_out(4, 2)
    rows = docs.select("doc_id", out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(rows, docs.filter(~out))
