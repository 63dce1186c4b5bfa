"""Behaviour that queries over the derived corpus don't reach."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lexspark.functions import numbers
from lexspark.operators import extraction, graph, linkage, preparation, retrieval, segmentation


def test_recovered_signatures(spark):
    acts = spark.createDataFrame(
        [("d", 0, 3, "Ion Popescu"), ("d", 1, None, "Ana Dinu"), ("d", 2, 9, "Ion Popescu"), ("d", 3, None, "Maria Ene"), ("d", 4, None, None)], "doc_id string, act_index int, page_hint int, signatory string"
    )
    signatures = spark.createDataFrame(
        [("d", 4, "11", "semnat Ion Popescu"), ("d", 20, "12", "semnat ANA DINU, ministru"), ("d", 9, "13", "Ion Popescu"), ("d", 30, "14", "Maria Ene"), ("d", 31, "15", "Maria Ene")], "doc_id string, page_no int, number string, context string"
    )
    got = {r.act_index: r.number for r in extraction.match_recovered(acts, signatures).collect()}
    assert got == {0: "11", 1: "12", 2: "13", 3: None, 4: None}
    excluded = spark.createDataFrame([("d", "11"), ("d", "15")], "doc_id string, number string")
    got = {r.act_index: r.number for r in extraction.match_recovered(acts, signatures, excluded=excluded).collect()}
    assert got == {0: None, 1: "12", 2: "13", 3: "14", 4: None}


def test_blocks_of_lines_collapse(spark):
    block = "Prima linie a blocului\nA doua linie a lui\nA treia linie a lui\n"
    t = spark.createDataFrame([(block * 3 + "sfarsit",), ("1\n2\n1\n2\nsfarsit",), (None,)], "t string")
    got = [r.x for r in t.select(preparation.clean_act_text(F.col("t")).alias("x")).collect()]
    assert got == [block + "sfarsit", "sfarsit", None]


def test_only_listed_acts_are_cited(spark):
    t = spark.createDataFrame([(1, "Ordinul nr. 5/2001, Legea nr. 1.234/2002 și lege nr. 7/2003")], "k int, full_text string")
    assert [(r.type, r.number, r.year) for r in graph.citations(t).collect()] == [("lege", "1234", 2002), ("lege", "7", 2003)]


def test_stop_words(spark):
    row = spark.createDataFrame([("Nu se acest care un o legea și în",)], "t string").select(retrieval.terms(F.col("t")).alias("x")).first()
    assert row.x == ["un", "o", "legea"]


def test_matching_ratio(spark):
    pairs = [("abcd", "bcde"), ("", ""), ("x", None), ("ministerul finanțelor", "ministrul finantelor")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", numbers.matching_ratio(F.col("a"), F.col("b")).alias("r"))
    for r in df.collect():
        assert abs(r.r - (1 - SequenceMatcher(None, r.a or "", r.b or "").ratio())) < 1e-12


def test_closings_are_not_cut_too_often(spark):
    one = "text Bucuresti, 3 mai 2007.\nNr. 5."
    df = spark.createDataFrame([([f"{one} {one}"] * 3, 0), ([f"{one} {one}"] * 3, 6), ([f"{one} {one}"], 0)], "a array<string>, n int")
    assert [len(r.x) for r in df.select(segmentation.split_guarded(F.col("a"), F.col("n")).alias("x")).collect()] == [3, 6, 2]


def test_duplicates_within_an_issue(spark):
    body = " ".join(f"cuvant{i}" for i in range(900))
    acts = spark.createDataFrame([("a", 0, body + " unu doi trei"), ("a", 1, body), ("b", 0, body), ("b", 1, "scurt")], "issue_id string, act_index int, full_text string")
    assert {(r.issue_id, r.act_index) for r in preparation.without_duplicates(acts).collect()} == {("a", 0), ("b", 0), ("b", 1)}


def test_reconciliation_stops_early(spark):
    a = spark.createDataFrame([("i", 0, "LEGE", "5", "t", "x"), ("i", 1, "HG", "0", "t", "x")], "issue_id string, act_index int, doc_type string, act_number string, title string, full_text string")
    t = spark.createDataFrame([("i", 0, "LEGE", "5", "t", 1), ("i", 1, "HG", "9", "u", 2)], "issue_id string, toc_idx int, toc_type string, toc_number string, toc_title string, page_start int")
    assert [r["pass"] for r in linkage.reconcile(a, t, passes=2).collect()] == [1]
    assert sorted(r["pass"] for r in linkage.reconcile(a, t).collect()) == [1, 3]
