import hashlib
import json

from lexspark.sources import bundle


def test_issue_files(spark, tmp_path):
    issue = {"gazette_id": "PI_1_2007", "date": "2007-03-05", "sumar": [{"act_number": "1", "doc_type": "LEGE", "title": "t", "page_start": 1}], "acts": [{"act_index": 0, "doc_type": "LEGE", "act_number": "1"}]}
    (tmp_path / "a.json").write_text(json.dumps(issue))
    (tmp_path / "b.json").write_text("{ nicht json")
    rows = bundle.read_issues(spark, str(tmp_path)).collect()
    assert sorted(r._corrupt_record is not None for r in rows) == [False, True]
    good = bundle.read_issues(spark, str(tmp_path / "a.json"))
    assert bundle.issue_acts(good).count() == 1 and bundle.issue_toc(good).first().toc_number == "1"


def test_checksums_and_scan(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"abc")
    right = hashlib.sha256(b"abc").hexdigest()
    expected = spark.createDataFrame([("x.pdf", right), ("y.pdf", right)], "name string, sha256 string")
    assert {r.name: r.ok for r in bundle.verify_checksums(spark, str(tmp_path), expected).collect()} == {"x.pdf": True, "y.pdf": False}
    assert bundle.scan_files(spark, str(tmp_path)).first().sha256 == right


def test_load_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", "p", 1), ("b", "p", 1), ("c", "q", 1)], "id string, part string, v int")
    bundle.load(spark, first, path, "id", "part")
    second = spark.createDataFrame([("a", "p", 2), ("d", "p", 2)], "id string, part string, v int")
    for _ in range(2):
        bundle.load(spark, second, path, "id", "part")
    assert {r.id: r.v for r in spark.read.parquet(path).collect()} == {"a": 2, "b": 1, "c": 1, "d": 2}


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "m")
    for seq, sha in ((1, "x"), (2, "y")):
        bundle.append_manifest(spark.createDataFrame([("d", seq, sha)], "doc_id string, seq int, sha256 string"), path)
    got = bundle.read_manifest(spark, path).collect()
    assert [(r.seq, r.sha256, r.first_seq) for r in got] == [(2, "y", 1)]
