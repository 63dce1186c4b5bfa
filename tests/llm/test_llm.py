"""Operators of lexspark.llm against brute force, the libraries and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexspark.llm import binary, common, decontam, langid, licenses, lm, mixing, ngramjoin, quality, tokens, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")

EDGE = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", None, "b"), (5, "same text here twice over", "en", "b"), (6, "same text here twice over", "en", "b"),
    (7, "lung " * 20000, "ro", "c"), (8, "Привет мир это текст", "ru", "c"), (9, "x\x00y \x1c z\xa0w　v", "en", None), (10, "fin.\n\n\nAlt\ttext", "fr", "d"), (None, "no id at all in this row", "en", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def alnum(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


# mixing


def test_mix_meets_targets(docs):
    got = mixing.report(docs).toPandas().merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    assert len(got) == docs.count() and (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source").agg(size=("size", "sum"), said=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.said).all()
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6 * by["size"].sum()
    assert ((by.taken - by.target).abs() <= 0.15 * by.target).all()  # ten texts a source here
    again = mixing.report(docs).toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))


def test_mix_targets_water_fill(spark):
    rows = [("a", 100), ("b", 1000), ("c", 1000), ("d", 10), (None, 500), ("e", 0)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    weight = {"a": 5, "b": 2, "c": 1, "d": 5, "e": 0, None: 1}
    want, left, open_ = {}, 1.5 * 2610, dict(rows)
    want["e"] = 0.0
    del open_["e"]
    while True:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 2 * open_[s] - 1e-9]
        if not full:
            want |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            want[s] = 2.0 * open_.pop(s)
            left -= want[s]
    assert got == pytest.approx(want)


def test_mix_edges(edge, empty):
    got = mixing.report(edge).collect()
    assert len(got) == len(EDGE) and mixing.report(empty).count() == 0
    assert {r.taken for r in got if r.size == 0} == {0}
    assert mixing.mix(edge).columns == edge.columns


# tokens


def fuzz(n=4000):
    rng = random.Random(5)
    pool = "ab'sSΣςİßéÉ̈ \n\t\r\x0b\x1c\x85\xa0 　.,!?19²½٣中文Éǅﬁ﻿​\U0001f600"
    out = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 30))) for _ in range(n)]
    parts = ["the", " of", "\n", "of ", ".\n", " a", "b", " ", "é", "\n'", "'s"]
    out += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 20))) for _ in range(n)]
    return out + ["a<|endoftext|>b <|startoftext|>x", "<|ENDOFTEXT|>", " a", "a ", "a\n\nb", "a\n\n\nb", "a \n b", ""]


def test_token_counts_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, lib = tokens.Merger(tokens.read_tokenizer(path)), Tokenizer.from_file(path)
    texts = fuzz()
    assert [own.count(t.encode()) for t in texts] == [len(x.ids) for x in lib.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_edges(edge, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = {r.doc_id: r for r in tokens.count_tokens(edge, path).collect()}
    assert (got[1].n_bytes, got[1].n_tokens, got[3].n_tokens, got[7].over_limit) == (0, 0, 0, True)
    assert tokens.count_tokens(empty, path).count() == 0


def test_binary_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, lib = binary.Encoder(tokens.read_tokenizer(path)), Tokenizer.from_file(path)
    texts = fuzz()
    assert [x.tolist() for x in own.ids([t.encode() for t in texts])] == [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]


def test_binary_round_trip(edge, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = sorted(binary.encode(edge, path).collect(), key=lambda r: r.start)
    start = 0
    for r, (doc_id, text, *_) in zip(got, sorted(EDGE, key=lambda x: (x[0] is not None, x[0]))):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert binary.encode(empty, path).count() == 0


def test_binary_tasks_share_an_encoder(spark, tmp_path, monkeypatch):
    """Two tasks of one process build one encoder, and write the same frames."""
    import pyarrow as pa

    built, wrote, real, kind = [], [], binary.map_arrow, binary.Encoder
    texts = ["one two\nthree two", "two four", ""]

    def two_tasks(df, fn, *rest):
        batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array(texts), pa.array([0, 0, 0])], names=["doc_id", "text", "task"])
        wrote.extend(pa.Table.from_batches(fn(iter([batch]))).to_pylist() for _ in range(2))
        return real(df, fn, *rest)

    monkeypatch.setattr(binary, "_KEPT", {}, raising=False)
    monkeypatch.setattr(binary, "map_arrow", two_tasks)
    monkeypatch.setattr(binary, "Encoder", lambda data: built.append(1) or kind(data))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    binary.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "data"))
    assert len(built) == 1
    assert wrote[0] == wrote[1] and len(wrote[0]) == 3


def test_damaged_frames_are_refused():
    data = binary.frame(5, np.arange(20), 2)
    assert [(d, x.tolist()) for _, _, d, x in binary.frames(data * 2)] == [(5, list(range(20)))] * 2
    for at in (0, 6, 20, len(data) - 1):
        with pytest.raises(ValueError):
            list(binary.frames(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]))


# language model


def test_lm_base_and_gain(docs):
    rows = docs.select("doc_id", "text").collect()
    counts = Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 10:
            counts.update(r.text.encode().lower().split())
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in lm.report(docs).collect()}
    for r in rows:
        words = [*r.text.encode().lower().split(), None]
        base = sum(np.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(words), sum(w in counts for w in words), n)
        assert g.base_score == pytest.approx(base) and g.score < 0


def tokens_of(text):
    """(word with its space, what came before) of a text's tokens, plainly."""
    words = text.encode().lower().split()
    hashes = [int(common.span_hashes(np.frombuffer(w, np.uint8), np.zeros(1, np.int64), np.full(1, len(w)))[0]) for w in words]
    votes = [0] * 256
    for w, h in zip(words, hashes):
        votes[h >> 56] += len(w) <= lm.SHORT
    own, out, q = votes.index(max(votes)) % lm.CLASSES * (lm.SHORTS + 1), [], 0
    for w, h in zip(words, hashes):
        out.append((w + b" ", own + q))
        q = 1 + (h >> 40) % lm.SHORTS if len(w) <= lm.SHORT else 0
    return [*out, (b" ", own + q)]


def lm_words(rows):
    return lm.dealt(lm.stored(lm.gather(rows, True).groupBy("key").agg(lm.F.first("word").alias("word"), lm.F.first("q").alias("q"), lm.F.sum("n").alias("n")), "words"))


def random_texts(n=40):
    rng = random.Random(4)
    return [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(60)) for _ in range(n)]


def test_lm_tokens_and_what_came_before(spark):
    texts = [*random_texts(10), "", "one", "the cat the dog of the cat"]
    rows = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], SCHEMA)
    got = {(bytes(r.word), r.q): r.n for r in lm_words(rows).collect()}
    assert got == Counter(x for t in texts for x in tokens_of(t))


def test_lm_counts_and_scores_are_those_of_plain_code(spark, monkeypatch):
    texts = random_texts()
    monkeypatch.setattr(lm, "PART_BYTES", 400)
    monkeypatch.setattr(lm, "FILE_WORDS", 300)
    monkeypatch.setattr(lm, "SLOTS", 1 << 22)
    monkeypatch.setattr(lm, "MOST_SLOTS", 1 << 22)
    words = lm_words(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], SCHEMA))
    around, logs, over, mixer = lm.learn(words)
    got = {r.key: r for r in lm.scored(words, (around, logs, over, mixer)).collect()}
    seen = Counter(x for t in texts for x in tokens_of(t))
    assert len(got) == len(seen) == words.count() and words.select("part").distinct().count() > 5
    # counts of zeros and ones by context, plainly
    counts: dict = defaultdict(lambda: [0, 0])

    def contexts(w, q, i, j):
        node = (1 << j) | (w[i] >> (8 - j))
        k, last = divmod(q, lm.SHORTS + 1)
        back = [*w[max(i - 3, 0) : i][::-1], 300 + last]
        return [("last", n, tuple(back[:n]), k, node) for n in lm.TABLED] + [("class", k, w[:i], node), ("all", w[:i], node)]

    for (w, q), n in seen.items():
        for i in range(len(w)):
            for j in range(8):
                for c in contexts(w, q, i, j):
                    counts[c][w[i] >> (7 - j) & 1] += n
    key, equal = {(bytes(r.word), r.q): r.key for r in words.collect()}, 0
    for (w, q), _ in random.Random(1).sample(sorted(seen.items()), 60):
        want = 0.0
        for i in range(len(w)):
            for j in range(8):
                found = [counts[c] for c in contexts(w, q, i, j)]
                gate = int(min(np.log2(sum(found[-1]) + 1), 7)) * 8 + j
                x = sum(k * np.log((one + 0.2) / (zero + 0.2)) for k, (zero, one) in zip(mixer.weights[gate], found))
                x = np.clip(int(np.clip(x, -9, 9) * 64 + 512.5) / 64 - 8, -8, 8)  # as it is tabled
                p = (lm.squash(x) + mixer.map[gate, int(mixer.bin_of(x))]) / 2
                want += np.log10(p if w[i] >> (7 - j) & 1 else 1 - p)
        r = got[key[w, q]]
        equal += abs(r.lm - want) < 0.01
        assert r.c == sum(n for (v, _), n in seen.items() if v == w)
    assert equal >= 54  # but for contexts that share a slot


def test_lm_mixer_is_a_distribution(spark):
    """Of all first bytes, each followed by the end, the probabilities add up to
    no more than one."""
    table = [np.random.default_rng(1).normal(size=lm.SLOTS).astype(np.float32) for _ in lm.TABLED]
    rows = pa_rows([(bytes([c, 32]) if c != 32 else b" ", 0, 1) for c in range(256)])
    part = lm.Part(rows, (None, None))
    mixer = lm.Mixer()
    mixer.settle()
    none = (np.zeros(1, np.uint64), np.zeros(1), np.zeros(1))
    assert 0 < (10.0 ** lm.spelled(part, mixer, table, none)).sum() <= 1.0 + 1e-6


def pa_rows(rows):
    import pyarrow as pa

    word, q, n = zip(*rows)
    return pa.table([pa.array(range(len(rows)), pa.int64()), pa.array(word, pa.binary()), pa.array(q, pa.int32()), pa.array(n, pa.int64())], names=["key", "word", "q", "n"])


def test_lm_learns_from_all_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lm.Mixer, "chart", lambda self, f=lm.Mixer.chart: (seen.append(self.observed[0].sum()), f(self))[1])
    rows = spark.createDataFrame([(i, f"word{i:04d}", "en", "s") for i in range(900)], SCHEMA).repartition(3)
    lm.score(rows.withColumn("held_out", common.held_out(10, 0)), rows).count()
    assert seen == [900 * (9 + 1) * 8]  # each word's eight bytes and the space after it, and the end


def test_lm_scores_don_t_depend_on_what_is_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"the word w{i % 7} is the {i}", "en", "s") for i in range(50)], SCHEMA)
    want = {r.doc_id: r for r in lm.report(rows).collect()}
    monkeypatch.setattr(lm, "MOST_BROADCAST", 3)
    for r in lm.report(rows).collect():
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known) == (w.n_tokens, w.n_known)
        assert r.score == pytest.approx(w.score) and r.base_score == pytest.approx(w.base_score)


def test_lm_end_is_known_among_many_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(lm, "MOST_BROADCAST", 100)
    many = " ".join(f"w{i} w{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, many, "en", "s"), (2, "w1 w2", "en", "s")], SCHEMA)
    got = {r.doc_id: r for r in lm.score(docs.withColumn("held_out", lm.F.lit(False)), docs).collect()}
    n, v = 6000 + 2 + 2, 3001
    assert got[2].n_known == 3 and got[2].train_tokens == n
    assert got[2].base_score == pytest.approx(2 * np.log10(3.1) + np.log10(2.1) - 3 * np.log10(n + 0.1 * (v + 1)))


def test_lm_edges(edge, empty):
    got = {r.doc_id: r for r in lm.report(edge).collect()}
    assert len(got) == len(EDGE) and got[1].n_tokens == 1 and got[1].bits_per_byte is None
    assert lm.report(empty).count() == 0


# language


def test_language_held_out(docs):
    got = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    scores = [(rng.normal(size=(int(rng.integers(1, 50)), 4)) * 3).astype(np.float32) for _ in range(200)]

    def best(s, penalty):
        state = s[0].astype(float)
        for row in s[1:]:
            state = np.maximum(state, state.max() - penalty) + row
        return state.max()

    for s, path in zip(scores, langid.viterbi(scores, 5.0)):
        value = s[np.arange(len(path)), path].astype(float).sum() - 5.0 * (np.diff(path) != 0).sum()
        assert value == pytest.approx(best(s, 5.0), abs=1e-3)


def test_viterbi_without_the_best_constant_label():
    score = np.array([(0, -40, -15), (-40, 0, -15)], np.float32)
    assert langid.viterbi([score], 20.0)[0].tolist() == [0, 1]


def test_language_blocks_of_long_texts_change_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    model = langid.Model(["de", "en", "fr"], rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32) * 4, {})
    texts = [" ".join(f"{rng.choice(['ab', 'xy', 'pq'])}{i % 37:x}".translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(n)).encode() for n in (1, 5, 300, 900)]
    whole = model.spans(texts)
    assert any(len(set(path.tolist())) > 1 for path, _ in whole)
    monkeypatch.setattr(langid, "LONG", 7)
    monkeypatch.setattr(langid, "MEMO", 60)
    for (path, letters), (path2, letters2) in zip(whole, model.spans(texts)):
        assert letters.tolist() == letters2.tolist() and path.tolist() == path2.tolist()


def test_language_spans_of_mixed_text(spark):
    rows = [(i, t, x, "s") for i in range(40) for t, x in (("the cat sat on the mat and was happy with it", "en"), ("der hund und die katze sind nicht in dem haus", "de"), ("кошка сидит дома и смотрит в окно", "ru"))]
    model = langid.Model(*langid.learn(spark.createDataFrame(rows, SCHEMA)))
    spans = langid.label_spans(model, "the cat sat on the mat and was happy. der hund und die katze sind nicht in dem haus. кошка сидит дома".encode())
    assert [s[0] for s in spans] == ["en", "de", "ru"]


def test_language_edges(edge, empty):
    got = {r.doc_id: r for r in langid.report(edge).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1, 2, 3)) and langid.report(empty).count() == 0


# toxicity


def toxic_rows():
    rng, words = random.Random(2), [f"wort{i}" for i in range(300)]
    out = []
    for i in range(600):
        lines = [" ".join(rng.choices(words, k=8)) + "." for _ in range(rng.randint(1, 12))]
        bad = i % 4 == 0
        if bad:
            at = rng.randrange(len(lines))
            lines[at] = f"du {rng.choice(['depp', 'trottel', 'idiot'])} {lines[at]}"
        out.append((i, " ".join(lines), int(bad)))
    return out


def test_toxicity_held_out(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "de", "s") for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    truth = {i: x for i, _, x in rows}
    got = [r for r in toxicity.report(docs, labels).collect() if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in got) >= 0.95 * len(got)
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert sum(truth[i] for i in kept) <= 5 and sum(1 - truth[i] for i in kept) >= 440
    model = toxicity.learn(docs, labels)
    assert [at for at, _ in model.worst("alles gut hier. du idiot wort1. ende".encode())] == [1]


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(4, None), (5, 1), (5, 0), (6, 0), (77, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.report(edge, labels).collect()}
    assert len(got) == len(EDGE) and got[1].score == 0.0
    assert toxicity.report(empty, labels).count() == 0


# quality


def test_quality_counts(spark, edge, empty):
    t = "a b c d e f\na b c d e g\nx # $\nx # $\n\n"
    got = quality.measures(spark.createDataFrame([(1, t, "en", "s")], SCHEMA)).first()
    words = t.split()
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (len(words), len("".join(words)), 4, 1, len(hit))
    assert quality.report(edge).count() == len(EDGE) and quality.report(empty).count() == 0


def test_quality_fences_decide_alone(spark):
    """Each fence refuses a document that the base rules and all others let
    pass, in a group whose other documents are alike."""
    rng = random.Random(3)
    word = lambda n=5: "".join(rng.choice("abcdefghijklm") for _ in range(n))
    plain = [(i, "\n".join(" ".join(word() for _ in range(10)) for _ in range(10)), "en", "s") for i in range(60)]
    lines = [" ".join(word() for _ in range(20)) for _ in range(4)]
    again = " ".join(word() for _ in range(9))
    odd = [
        (100, " ".join(word(12) for _ in range(50)), "en", "s"),  # long words
        (101, " ".join([word() for _ in range(50)] + ["#$%"] * 4 + [word() for _ in range(50)]), "en", "s"),  # symbols
        (102, " ".join([*(word() for _ in range(41)), again, *(word() for _ in range(41)), again]), "en", "s"),  # 18 % repeated words
        (103, "\n".join([*(f"{x} {word()} {word()}" for x in lines), *["a b"] * 8]), "en", "s"),  # equal lines
    ]
    got = {r.doc_id: r for r in quality.report(spark.createDataFrame(plain + odd, SCHEMA)).collect()}
    assert all(got[i].kept for i in range(60))
    for i in (100, 101, 102, 103):
        assert not got[i].base_failed and not got[i].kept, i


# licenses


def test_license_places_and_blocks(spark, edge, empty):
    t = "Intro.\nReleased under the MIT License.\nThe MIT license and the Apache License.\nLicensed under CC BY-NC 4.0."
    got = licenses.report(spark.createDataFrame([(1, t, "en", "s")], SCHEMA)).first()
    assert (got.n_base, got.first_word, got.last_word, got.base_labels, got.labels) == (3, 4, 11, "apache,mit", "apache,cc-by-nc,mit")
    assert licenses.report(edge).count() == len(EDGE) and licenses.report(empty).count() == 0


def test_license_join_is_exact():
    rng, words = random.Random(9), [f"w{i}".encode() for i in range(40)]
    sets = [(f"t{i}", frozenset(rng.sample(words, rng.randint(3, 12)))) for i in range(30)]
    index, left_out = licenses.Index(sets, {w: rng.randint(0, 9) for w in words}, 0.8), 0
    for _ in range(500):
        block = set(rng.sample(words, rng.randint(0, 30)))
        want = {n: len(s & block) / len(s) for n, (_, s) in enumerate(sets) if len(s & block) >= 0.8 * len(s) - 1e-9}
        assert index.match(block) == want
        passed, out = index.candidates(block)
        assert passed >= want.keys() and not out & want.keys()
        left_out += len(out)
    assert left_out > 100


def test_license_full_texts(spark):
    from lexspark.llm.notices import NOTICES

    texts = [(i, f"Some words before.\n\n{t}\n\nand after", "en", "s") for i, (_, t) in enumerate(NOTICES)]
    texts += [(100 + i, f"{t[: len(t) // 2]}\n{t[len(t) // 2 :]}", "en", "s") for i, (_, t) in enumerate(NOTICES)]
    for r in licenses.report(spark.createDataFrame(texts, SCHEMA)).collect():
        if r.doc_id < 100:
            assert NOTICES[r.doc_id][0] in r.labels.split(",") and r.score == 1.0


# decontamination


def test_decontamination_is_exact(spark, edge, empty, monkeypatch):
    rng, words = random.Random(3), [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(rng.choice([1, 2, 5, 12, 30]))) for i in range(25)] + [(25, None), (26, "...")]
    docs = [(i, text(rng.randint(0, 60)), "en", "s") for i in range(60)]
    docs += [(100 + i, text(5) + " " + items[i][1] + " " + text(5), "en", "s") for i in range(25)] + [(200, None, "en", "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (1_000_000, 40):
        monkeypatch.setattr(decontam, "STRETCH", 5)
        found = decontam.find_benchmark(spark.createDataFrame(docs, SCHEMA).select("doc_id", "text"), bench, broadcast_bytes=most).collect()
        assert len(found) == len(docs)
        for r in found:
            own, hit, which = alnum(r.text), set(), set()
            for i, t in items:
                it = alnum(t)
                k = min(10, len(it))
                for s in range(len(it) - k + 1 if it else 0):
                    for p in range(len(own) - k + 1):
                        if own[p : p + k] == it[s : s + k]:
                            hit |= set(range(p, p + k))
                            which.add(str(i))
            assert (decontam.covered(list(zip(r._runs[::2], r._runs[1::2]))), set(r._items)) == (len(hit), which)
    got = decontam.report(edge, bench).collect()
    assert len(got) == len(EDGE) and {r.items_sha256 for r in got if not r.n_items} == {hashlib.sha256(b"").hexdigest()}
    assert decontam.report(empty, bench).count() == 0 and decontam.drop_contaminated(edge, bench).columns == edge.columns
    clash = edge.selectExpr("*", "doc_id as _runs", "doc_id as _items", "doc_id as _rid", "doc_id as _text")
    for r in [*decontam.drop_contaminated(clash, bench).collect(), *decontam.drop_contaminated(clash, bench.limit(0)).collect()]:
        assert r._runs == r._items == r._rid == r._text == r.doc_id


# near duplicates


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)})
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    inverse = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in inverse[g])
        for g in s:
            inverse[g].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def groups():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(4000)]
    pick = lambda n: [rng.choice(vocabulary) for _ in range(n)]

    def edit(words, k):
        out = list(words)
        for _ in range(k):
            out[rng.randrange(len(out))] = rng.choice(vocabulary)
        return out

    base, passage = pick(120), pick(60)
    drift, docs = list(base), [" ".join(edit(base, rng.randrange(5))) for _ in range(60)]
    for _ in range(40):
        drift = edit(drift, 1)
        docs.append(" ".join(drift))
    for _ in range(50):
        n = rng.randrange(5, 60)
        docs.append(" ".join([*pick(n), *passage, *pick(n)]))
    docs += [" ".join(edit(passage[:40], rng.randrange(3))) for _ in range(40)] + [" ".join(pick(rng.randrange(1, 300))) for _ in range(30)]
    docs += [docs[0]] * 10 + ["", None, "a b", "A b", "  "]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("cold, together", [(24, 8000), (3, 4)])
def test_near_duplicates_are_exact(spark, monkeypatch, cold, together):
    monkeypatch.setattr(ngramjoin, "COLD", cold)
    monkeypatch.setattr(ngramjoin, "TOGETHER", together)
    texts = groups()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_near_duplicates_edges(edge, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.near_duplicates(edge).collect()}
    assert got[1] == (0, 1) and got[4] == (1, 4) and got[6] == (1, 5)
    assert ngramjoin.near_duplicates(empty).count() == 0
    assert {r.doc_id for r in ngramjoin.keep_one(edge).collect()} == {d for d, *_ in EDGE} - {6}


def test_signatures_suffice():
    """Sets that link share more than they may leave out."""
    rng = np.random.default_rng(8)
    for n in (5, 20, 64, 70, 100, 200, 500, 1000, 3000):
        for _ in range(10):
            r = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            k = int(len(r) * 0.14)
            s = np.unique(np.concatenate((rng.permutation(r)[k:], rng.integers(0, 1 << 63, k).astype(np.uint64))))
            shared = len(np.intersect1d(r, s))
            if 100 * shared < 75 * (len(r) + len(s) - shared):
                continue
            best = max(
                len(set(m[np.isin(x, y)].tolist())) - max(p, q, 0)
                for a, x, m, p in ngramjoin.signatures(r) for b, y, _, q in ngramjoin.signatures(s) if a == b
            )
            assert best >= 1


def test_signatures_are_subsets_of_parts():
    """Each signature is what a set has in two smaller parts of three: it stays
    when the third changes, and goes when one of the two does."""
    rng = np.random.default_rng(8)
    r = np.unique(rng.integers(0, 1 << 63, 100).astype(np.uint64))
    band = ngramjoin.band_of(len(r))
    n1, n2 = ngramjoin.parts_of(band)
    assert n2 == 3
    part = ngramjoin.part_of(r, n1 * n2)
    own = dict(((a, x) for a, x, *_ in ngramjoin.signatures(r)))[band, 0]
    for at in range(0, 100, 7):
        s = np.delete(r, at)
        other = dict(((a, x) for a, x, *_ in ngramjoin.signatures(s))).get((band, 0))
        lost = len(np.setdiff1d(own, other))
        assert lost == 2  # the two subsets that hold its smaller part
        assert len(np.intersect1d(own, other)) == len(own) - 2
        assert int(part[at]) // n2 < n1


def test_keep_one_goes_by_row(spark):
    rows = [(1, "a b c d e f g", 1, 1), (2, "h i j k l m n o", 2, 2), (2, "a b c d e f g", 3, 3), (3, "p q r s t u v", 4, 4), (3, "w x y z a b c", 5, 5), (3, "p q r s t u v", 4, 4), (4, "", 6, 6), (4, None, 7, 7), (None, "a b c d e f g", 8, 8), (None, "only here with no id at all", 9, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `_node` long, `_key` long")
    got = ngramjoin.keep_one(df)
    assert got.columns == df.columns
    want = [rows[i] for i in (0, 1, 3, 4, 6, 7, 9)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_repeated_rows_and_clashing_names(spark, edge):
    """Every operator gives one row for each row, equal rows equal results, with
    columns of other meanings beside the ones that it reads."""
    names = ("_h", "_k", "_d", "_hash", "_total", "_rows", "_runs", "_items", "_node", "_key", "_at", "_copies", "_plan", "score", "lang_pred", "size", "target", "n", "c", "rid", "part", "shard")
    twice = edge.union(edge).selectExpr("*", *(f"doc_id as `{x}`" for x in names))
    labels = spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "same text here twice over")], "item_id long, text string")
    path = public_tokenizers.path
    for f in (
        mixing.report, lm.report, langid.report, quality.report, licenses.report, ngramjoin.near_duplicates,
        lambda d: tokens.count_tokens(d, path("word_bpe_49k.json")), lambda d: toxicity.report(d, labels), lambda d: decontam.report(d, bench), lambda d: binary.encode(d, path("byte_bpe_50k.json")),
    ):
        rows = f(twice).collect()
        assert len(rows) == 2 * len(EDGE)
        assert Counter(r.doc_id for r in rows) == Counter(d for d, *_ in EDGE * 2)
    for f in (mixing.mix, ngramjoin.keep_one, lambda d: decontam.drop_contaminated(d, bench), lambda d: toxicity.drop_toxic(d, labels)):
        out = f(twice)
        assert out.columns == twice.columns
        for r in out.collect():
            assert all(r[x] == r.doc_id for x in names)


def test_mix_by_brute_force(spark):
    """Rates from a bisection of the dual in plain code; copies follow them."""
    rng = random.Random(11)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 3, 7, 20, 50, 200])), "en", rng.choice(["a", "b", "c", "d", None])) for i in range(400)]
    rows += [(1000, "w w w w w", "en", "a")] * 9
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.report(df).join(df.select("doc_id", "source").distinct(), "doc_id").collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for source, own in by.items():
        sizes, target = np.array([r.size for r in own], float), own[0].target
        low, high = -50.0, 50.0
        for _ in range(200):
            lam = (low + high) / 2
            rate = np.minimum(2, np.exp(np.minimum(lam * sizes / 200, 700)))
            low, high = (lam, high) if (rate * sizes).sum() < target else (low, lam)
        taken = sum(r.taken for r in own)
        assert abs(taken - target) <= max(1, 0.01 * target)
        off = 0.0
        for size in set(sizes) - {0.0}:
            same = [r.copies for r in own if r.size == size]
            want = float(np.minimum(2, np.exp(np.minimum(low * size / 200, 700))))
            assert max(same) <= 2 and max(same) - min(same) <= 1
            off += size * abs(sum(same) - want * len(same))
        # a copy of each size for rounding, and what that leaves made up by a few
        assert off <= sum(set(sizes)) + max(sizes)
    mixed = Counter((r.doc_id, r.source) for r in mixing.mix(df).collect())
    planned = Counter()
    for r in got:
        planned[r.doc_id, r.source] += r.copies
    assert mixed == +planned


def test_toxicity_scores_are_those_of_plain_code(spark):
    """Noisy-or over sentences of the sums of their words' weights."""
    rows = toxic_rows()[:200]
    docs = spark.createDataFrame([(i, t, "de", "s") for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.report(docs, labels).collect()}
    for i, t, _ in rows:
        clean = 1.0
        for sentence in re.split(r"[.!?\n\r]", t.lower()):
            words = set(re.findall(r"[a-z0-9]+", sentence))
            if words:
                z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in toxicity.features(w.encode()))
                clean *= 1 - 1 / (1 + np.exp(-z))
        assert got[i] == pytest.approx(1 - clean, abs=1e-9)


def test_hashes_follow_words():
    data = np.frombuffer(b"one two one  three\n", np.uint8)
    h = common.span_hashes(data, *common.word_spans(data))
    assert h[0] == h[2] and len(set(h.tolist())) == 3
