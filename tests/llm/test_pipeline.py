"""The stages in order, each on what the one before it kept."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, D).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] == counts[5]
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = sorted(docs.collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, D).count() == 0


def test_stages_against_plain_versions(spark, tmp_path):
    """Each stage's rows from what the one before it kept."""
    import zlib
    from collections import Counter

    import numpy as np
    from test_llm import alnum, brute
    from tokenizers import Tokenizer

    from lexspark.llm import common, mixing, queries, toxicity

    docs = spark.read.parquet(f"{D}/documents.parquet")
    docs = docs.union(docs.limit(5))  # repeated rows too
    stages = [f for _, f in corpus_pipeline.STAGES]
    steps, now = [docs], docs
    for i, f in enumerate(stages):
        f(spark, now, D).write.parquet(str(tmp_path / str(i)))
        now = spark.read.parquet(str(tmp_path / str(i)))
        steps.append(now)
    rows = [x.collect() for x in steps]
    labels, bench = common.read(spark, D, "labels"), common.read(spark, D, "benchmark").collect()
    as_bag = lambda some: Counter(map(tuple, some))
    # toxicity
    model = toxicity.learn(docs, labels)
    assert as_bag(rows[1]) == as_bag(r for r in rows[0] if not r.text or model.score(r.text.encode()) < 0.5)
    # near duplicates
    ordered = sorted(rows[1], key=lambda r: r.doc_id)
    kept = {}
    for r, (n, root) in zip(ordered, brute([r.text for r in ordered])):
        kept.setdefault(root if n else id(r), r)
    assert as_bag(rows[2]) == as_bag(kept.values())
    # decontamination
    windows = {tuple(w[i : i + min(10, len(w))]) for b in bench for w in (alnum(b.text),) for i in range(max(len(w) - 9, 1)) if w}
    sizes = {len(w) for w in windows}
    clean = [r for r in rows[2] for w in (alnum(r.text),) if not any(tuple(w[i : i + k]) in windows for k in sizes for i in range(len(w) - k + 1))]
    assert as_bag(rows[3]) == as_bag(clean)
    # mixing
    plan = {r.doc_id: r.copies for r in mixing.report(steps[3]).collect()}
    assert as_bag(rows[4]) == +Counter({tuple(r): plan[r.doc_id] for r in rows[3]})
    # records
    lib = Tokenizer.from_file(queries.tokenizer_path(queries.BYTE_BPE))
    ids = {r.doc_id: [*lib.encode(r.text or "", add_special_tokens=False).ids, 0] for r in rows[4]}
    start = 0
    for r in sorted(rows[5], key=lambda r: r.start):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()))
        start += r.n_tokens
    assert Counter(r.doc_id for r in rows[5]) == Counter(r.doc_id for r in rows[4])
