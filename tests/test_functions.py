import pytest
from pyspark.sql import functions as F

from lexspark.functions import numbers, text
from lexspark.operators import defusion, evaluation, extraction, layout, preparation, retrieval, validation


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("given, want", [("Hotărâre ȘI", "hotarare si"), ("École", "ecole"), ("straße", "straße"), (None, None), ("", "")])
def test_fold(spark, given, want):
    assert one(spark, text.fold(F.col("c")), c=given) == want


@pytest.mark.parametrize("given, want", [("a b c d", "abcd"), ("G U V E R N U L României", "GUVERNUL României"), ("a b text", "a b text"), ("un a b c x", "un abcx")])
def test_join_spaced(spark, given, want):
    assert one(spark, text.join_spaced(F.col("c")), c=given) == want


@pytest.mark.parametrize("era, given, want", [("broken_2002", "ºi þarã", "și țară"), ("broken_2007", "∫i ˛ar„", "și țară"), ("modern", "şi", "și"), ("broken_2007", "ADMINISTRAfiIEI", "ADMINISTRAȚIEI")])
def test_normalize(spark, era, given, want):
    assert one(spark, text.normalize_text(F.col("c"), F.col("era")), c=given, era=era) == want


@pytest.mark.parametrize("given, want", [("1.439", "1439"), ("226/2006", "226"), ("999/726", "999/726"), ("0", ""), ("", ""), ("1.439/2006", "1439")])
def test_fold_number(spark, given, want):
    assert one(spark, numbers.fold_act_number(F.col("c")), c=given) == want


@pytest.mark.parametrize("given, bad", [("162 din 20 decembrie 2006", True), ("2.412/C/2013", True), ("E 356", True), ("999/726", False), ("1.642/2016", False), ("", False), ("necunoscut", False)])
def test_malformed(spark, given, bad):
    assert bool(one(spark, numbers.malformed_reason(F.col("c")), c=given)) is bad


def test_dates_and_files(spark):
    assert str(one(spark, numbers.text_date(F.col("c")), c="din 5 martie 2007 azi")) == "2007-03-05"
    assert one(spark, numbers.text_date(F.col("c")), c="31 februarie 2007") is None
    assert one(spark, numbers.file_identity(F.col("c"))["date"], c="x.pdf") == "0000-00-00"


def test_closing_number_is_not_the_repealed_one(spark):
    t = "ORDIN\nSe abrogă Ordinul nr. 275/2003.\nBucurești, 5 martie 2007.\nNr. 1.642."
    got = one(spark, extraction.number_and_year(F.col("c")), c=t)
    assert (got.number, got.year, got.confidence) == ("1642", 2007, "high")
    assert one(spark, extraction.repealed_numbers(F.col("c")), c=t) == ["275"]


def test_type_is_the_earliest_heading(spark):
    assert one(spark, extraction.doc_type(F.col("c")), c="ORDONANȚĂ DE URGENȚĂ\nLEGE") == "OUG"
    assert one(spark, extraction.doc_type(F.col("c")), c="fără antet") == "UNKNOWN"


def test_blocks_collapse():
    footer = "Monitorul Oficial al Statului"
    assert preparation.collapse_blocks(f"{footer}\n{footer}\n{footer}\ntext") == f"{footer}\ntext"
    pair = "prima linie destul de lunga\na doua linie destul de lunga"
    assert preparation.collapse_blocks(f"{pair}\n{pair}") == pair
    assert preparation.collapse_blocks("..... \n.....") == "..... \n....."
    assert preparation.collapse_blocks(None) is None


def test_chunks():
    n = preparation.default_counter
    assert preparation.chunk_text("", "LEGE", "whole_act", n) == []
    art = "\n".join(f"Art. {i}. " + "cuvant " * 100 for i in range(1, 11))
    got = preparation.chunk_text(art, "LEGE", "article", n)
    assert [p for _, _, p in got][0] == "art_1-4" and all(n(t) <= 512 for t, _, _ in got)
    window = preparation.chunk_text("cuvant " * 2000, "X", "token_window", n)
    assert len(window) == 6 and window[0][0].split()[370:] == window[1][0].split()[:80]


def test_tandem():
    assert layout.tandem("un bloc de text care se repeta mereu. " * 4)
    assert not layout.tandem("un text obisnuit care nu se repeta deloc si este destul de lung pentru test")
    assert not layout.tandem(None)


def test_defuse():
    words = {"articolul": 3.0, "prezentului": 4.0, "ordin": 3.0}
    assert defusion.split_token("articolulprezentuluiordin", words, 12.0) == ["articolul", "prezentului", "ordin"]
    assert defusion.split_token("necunoscutcompletaltceva", words, 12.0) is None


@pytest.mark.parametrize("q, number, year, issue", [("Ordinul nr. 20/2007", "20", 2007, None), ("nr. 3/1989", "", None, None), ("Decizia 922 din 2007", "922", 2007, None), ("Monitorul Oficial nr. 820/3.XII.2007", "", None, "820")])
def test_hints(spark, q, number, year, issue):
    h = one(spark, retrieval.hints(F.col("c")), c=q)
    assert (h.act_number, h.act_year, h.issue_number) == (number, year, issue)


def test_merge_keeps_good_numbers(spark):
    schema = "issue_id string, act_index int, doc_type string, act_number string, act_year int, issuing_authority string, title string, full_text string"
    p = spark.createDataFrame([("i", 0, "ORDIN", "2", 2007, "", "", "x"), ("i", 1, "LEGE", "77", 2007, "A", "titlu bun", "y")], schema)
    f = spark.createDataFrame([("i", 0, "ORDIN", "345", 2006, "M", "alt titlu", "x" * 10), ("i", 1, "LEGE", "78", 2007, "B", "z", "y"), ("i", 2, "HG", "9", 2007, "B", "nou", "z")], schema)
    got = {r.act_index: r for r in validation.merge(p, f).collect()}
    assert (got[0].act_number, got[0].act_year, got[0].issuing_authority, got[0].title) == ("345", 2006, "M", "alt titlu")
    assert (got[1].act_number, got[1].title, got[2].act_number) == ("77", "titlu bun", "9")


def test_validation_severity(spark):
    schema = "issue_id string, act_index int, doc_type string, act_number string, act_year int, issuing_authority string, title string, full_text string"
    body = "x" * 100
    a = spark.createDataFrame([("i", 0, "COMUNICAT", "0", 2007, "A", "t", body), ("i", 1, "LEGE", "0", 2007, "A", "t", body), ("i", 2, "UNKNOWN", "5", 2007, "A", "t", body)], schema)
    got = {(r.act_index, r.check, r.severity) for r in validation.act_issues(a).collect()}
    assert got == {(0, "ACT_NUMBER_ZERO", "INFO"), (1, "ACT_NUMBER_ZERO", "ERROR"), (2, "DOC_TYPE_UNKNOWN", "ERROR")}


def test_overlap_of_empty_source(spark):
    got = one(spark, evaluation.token_overlap(F.col("a"), F.col("b")), a="", b="ceva aici")
    assert (got.precision, got.recall, got.f1) == (0.0, 0.0, 0.0)
