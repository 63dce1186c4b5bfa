import pandas as pd
from pyspark.sql import functions as F

from lexspark.operators import recovery


def test_recovered_act(spark):
    body = "ORDIN privind ceva destul de lung ca sa treaca de prag. " * 3
    layer = spark.createDataFrame([("i", f"{body}\nBucurești, 5 martie 2007.\nNr. 12.\n{body} altul\nBucurești, 6 martie 2007.\nNr. 13.")], "issue_id string, text string")
    acts = spark.createDataFrame([("i", "12")], "issue_id string, act_number string")
    md = spark.createDataFrame([("i", "alt text")], "issue_id string, markdown string")
    got = recovery.recover_acts(layer, acts, md).collect()
    assert [r.number for r in got] == ["13"]


def test_roles_and_acts(spark):
    rows = ["MONITORUL OFICIAL", "ORDIN", "privind ceva", "si altceva", "Art. 1. - x", "București, 5 martie 2007", "Nr. 7.", "LEGE", "Art. 1. - y"]
    blocks = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(rows)], "doc_id int, page_no int, order int, text string")
    got = recovery.classify_blocks(blocks)
    assert [r.role for r in got.orderBy("order").collect()] == ["masthead", "act_type", "title", "title", "article", "closing_date", "closing_number", "act_type", "article"]
    assert recovery.acts_of_blocks(got).count() == 2


def test_months_titles_and_toc(spark):
    months = "Ianuarie Februarie Martie Aprilie Mai Iunie Iulie August Septembrie Octombrie Noiembrie Decembrie 1 2 3"
    df = spark.createDataFrame([(1, months, "ORDIN", "ORDIN\nprivind taxe .... 3\ntext")], "doc_id int, t string, title string, body string")
    r = df.select(recovery.monthly_table(F.col("t")).alias("m"), recovery.title_from_body(F.col("title"), F.col("body")).alias("x")).first()
    assert r.m.split("\n")[:4] == ["ianuarie = 1", "februarie = 2", "martie = 3", "aprilie = 0"] and r.x == "privind taxe"
    toc = spark.createDataFrame([(1, "DECRET-LEGE nr. 2\nDecret nr. 10 si Decret nr. 10\nCOMUNICAT")], "doc_id int, text string")
    assert {(r.number, r.doc_type) for r in recovery.scanned_toc(toc).collect()} == {("2", "DECRET-LEGE"), ("10", "DECRET"), ("", "COMUNICAT")}


def test_plugins(spark):
    acts = spark.createDataFrame([("i", 0, "UNKNOWN", "0", "t", "a", "text " * 60), ("i", 1, "LEGE", "5", "t", "a", "scurt")], "issue_id string, act_index int, doc_type string, act_number string, title string, issuing_authority string, full_text string")
    issues = spark.createDataFrame([("i", 0, "ACT_NUMBER_ZERO")], "issue_id string, act_index int, check string")
    got = {r.act_index: r for r in recovery.repair(acts, issues, lambda text, fields: {"act_number": "44", "title": "altul"}).collect()}
    assert (got[0].act_number, got[0].title, got[1].act_number) == ("44", "t", "5")

    def first_words(texts: pd.Series) -> pd.Series:
        return texts.str.split().str[:5].str.join(" ")

    made = recovery.summaries(acts, None, first_words)
    assert sorted(r.summary for r in made.collect()) == ["", "text text text text text"]
    assert recovery.summaries(acts, made, first_words).count() == 0


def test_unmapped(spark):
    blocks = spark.createDataFrame([(1, 1, "abc"), (1, 2, "d")], "doc_id int, block_id int, text string")
    rest, share = recovery.unmapped(blocks, blocks.filter("block_id = 1").select("doc_id", "block_id"))
    assert rest.count() == 1 and (share.first().share, share.first().lossless) == (0.75, False)
