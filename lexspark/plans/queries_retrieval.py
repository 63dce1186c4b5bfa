"""Queries of preparation, retrieval, listing, graph, evaluation and loading."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, graph, layout, preparation, recovery, retrieval, segmentation, validation
from ..session import materialize, shared_folder, table
from ..sources import bundle
from .corpus import WITH_ACTS, acts
from .registry import query

# preparation


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zăâîșț]{2,}') AS w FROM documents)
SELECT doc_id, (len(w) > 150 AND len(list_distinct(w[1:1000])) * 1.0 / len(w[1:1000]) < 0.12) AS poison FROM w""")
def poison_ttr(spark, d):
    return table(spark, d, "documents").select("doc_id", preparation.is_poison(F.col("text")).alias("poison"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zăâîșț]{2,}') AS w FROM documents), p AS (SELECT doc_id, coalesce(len(w) > 150 AND len(list_distinct(w[1:1000])) * 1.0 / len(w[1:1000]) < 0.12, false) AS poison FROM w)
SELECT quality, toxic, count(*) AS n, count(*) FILTER (poison) AS poisoned FROM labels JOIN p USING (doc_id) GROUP BY quality, toxic""")
def quality_vs_labels(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.coalesce(preparation.is_poison(F.col("text")), F.lit(False)).alias("poison"))
    return table(spark, d, "labels").join(p, "doc_id").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.count_if("poison").alias("poisoned"))


SHINGLES = r"""w AS (SELECT doc_id, length(text) AS len, regexp_extract_all(lower(text), '[a-zăâîșț0-9]{2,}') AS w FROM documents),
s AS (SELECT doc_id, len, list_distinct([array_to_string(w[i + 1 : i + 4], ' ') FOR i IN range(0, greatest(1, len(w) - 4), 2)]) AS s FROM w WHERE len(w) > 0)"""


@query(f"WITH {SHINGLES} SELECT doc_id, len(s) AS n FROM s")
def word_shingles(spark, d):
    rows = table(spark, d, "documents").select("doc_id", preparation.shingles(F.col("text")).alias("s"))
    return rows.filter(F.size("s") > 0).select("doc_id", F.size("s").cast("long").alias("n"))


@query(f"""WITH {SHINGLES}, l AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s WHERE len >= 5000 AND len(s) >= 8),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared, any_value(x.n) AS na, any_value(y.n) AS nb FROM l x JOIN l y ON x.x = y.x AND x.doc_id < y.doc_id GROUP BY 1, 2)
SELECT a, b, shared, na, nb FROM p WHERE shared >= 0.55 * least(na, nb)""")
def near_dup_pairs(spark, d):
    return preparation.duplicate_pairs(table(spark, d, "documents"), "doc_id")


@query()
def near_dup_losers(spark, d):
    return preparation.duplicate_losers(preparation.duplicate_pairs(table(spark, d, "documents"), "doc_id", length=1000, within=("source",)), "source")


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r]+') AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= 450 THEN 1 ELSE cast(ceil((len(w) - 450) / 370.0) AS INTEGER) * 370 + 1 END, 370)) AS pos FROM w)
SELECT doc_id, (pos // 370)::INTEGER AS chunk_index, array_to_string(w[pos + 1 : pos + 450], ' ') AS text FROM i""")
def window_chunks(spark, d):
    w = F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0))
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(preparation.windows(w)).alias("chunk_index", "c"))
    return rows.select("doc_id", "chunk_index", F.array_join("c", " ").alias("text"))


@query()
def packed_chunks(spark, d):
    units = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"), F.size(F.split(x, " ")).alias("n")))
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(preparation.packed(units)).alias("part_no", "p"))
    return rows.select("doc_id", "part_no", F.array_join(F.transform("p", lambda u: u["text"]), "\n").alias("text"))


@query()
def act_chunks(spark, d):
    return preparation.chunk_acts(acts(spark, d))


@query()
def gold_chunks(spark, d):
    return preparation.build_chunks(acts(spark, d)).drop("parts")


@query(WITH_ACTS + """ SELECT k, '[' || concat_ws(' | ', trim(concat_ws(' ', doc_type, concat_ws('/', CASE WHEN act_number NOT IN ('', '0') THEN act_number END, CASE WHEN act_number NOT IN ('', '0') THEN cast(act_year AS string) END))), issuing_authority, 'MO ' || issue_id, cast(act_year AS string)) || ']' AS prefix FROM a2""")
def chunk_prefix(spark, d):
    p = preparation.prefix(F.col("doc_type"), F.col("act_number"), F.col("act_year"), F.col("issuing_authority"), F.col("issue_id"))
    return acts(spark, d).select("k", p.alias("prefix"))


@query(WITH_ACTS + r"""SELECT issue_id, round(sum(length(regexp_replace(title, '\s', '', 'g'))) * 1.0 / sum(length(regexp_replace(full_text, '\s', '', 'g'))), 6) AS coverage FROM a2 GROUP BY issue_id""")
def issue_coverage(spark, d):
    a = acts(spark, d)
    raw = a.select("issue_id", F.col("full_text").alias("raw"))
    mapped = a.withColumn("full_text", F.col("title"))
    return preparation.issue_coverage(mapped, raw).select("issue_id", F.round("coverage_ratio", 6).alias("coverage"))


@query("""SELECT vec_id, [cast(greatest(-128, least(127, round_even(x::DOUBLE * 127, 0))) AS INTEGER) FOR x IN embedding] AS q FROM embeddings""")
def int8_quantize(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(preparation.quantize(F.col("embedding")), lambda x: x.cast("int")).alias("q"))


# retrieval

QUERY = "the and of eaon thination inoran 3 questions about"


def _queries(spark, d):
    """Every row whose id is divisible by 50: query_id, q and v, null where the
    other table has no such id."""
    q = table(spark, d, "benchmark").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    v = table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return q.join(v, "query_id", "full")


STOP = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)


def _bm25_sql(field: str = "text", x: str = "") -> str:
    """The legs' SQL over a field of documents; x ends the names of its parts."""
    words = f"list_filter(regexp_extract_all(strip_accents(lower({{}})), '[a-z0-9]+'), lambda x: x NOT IN ({STOP}))"
    return f"""t{x} AS (SELECT doc_id AS id, {words.format(field)} AS t FROM documents),
st{x} AS (SELECT count(*) AS n, avg(len(t)) AS avg_dl FROM t{x}),
q{x} AS (SELECT item_id AS query_id, unnest(list_distinct({words.format("text")})) AS term FROM benchmark WHERE item_id % 50 = 0),
e{x} AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM t{x}), tf{x} AS (SELECT id, dl, term, count(*) AS tf FROM e{x} WHERE term IN (SELECT term FROM q{x}) GROUP BY ALL), df{x} AS (SELECT term, count(*) AS df FROM tf{x} GROUP BY term),
sc{x} AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_dl))), 6) AS score FROM tf{x} JOIN df{x} USING (term) JOIN q{x} USING (term), st{x} GROUP BY query_id, id),
bm{x} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc{x}) WHERE rank <= 80)"""


BM25 = _bm25_sql()
VECTOR = """v AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), vs AS (SELECT query_id, vec_id AS id, round(list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q, q)), 6) AS score FROM embeddings, v {where}),
vt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vs) WHERE rank <= 80)"""


def _bm25(spark, d):
    return retrieval.bm25(table(spark, d, "documents"), _queries(spark, d).filter("q is not null"), "doc_id")


def _vectors(spark, d, where=None):
    return retrieval.vector_search(table(spark, d, "embeddings"), _queries(spark, d).filter("v is not null"), "vec_id", where=where)


@query(f"WITH {BM25} SELECT query_id, id, score, rank FROM bm")
def bm25_topk(spark, d):
    return _bm25(spark, d)


@query(f"WITH {BM25} SELECT query_id, term FROM q")
def analyze_terms(spark, d):
    return _queries(spark, d).select("query_id", F.explode(F.array_distinct(retrieval.terms(F.col("q")))).alias("term"))


@query(f"WITH {VECTOR.format(where='')} SELECT query_id, id, score, rank FROM vt")
def vector_topk(spark, d):
    return _vectors(spark, d)


@query(f"WITH {VECTOR.format(where='WHERE label IN (1, 3)')} SELECT query_id, id, score, rank FROM vt")
def vector_topk_filtered(spark, d):
    return _vectors(spark, d, F.col("label").isin(1, 3))


RRF = f"""WITH {BM25}, {VECTOR.format(where='')}, f AS (SELECT coalesce(vt.query_id, bm.query_id) AS query_id, coalesce(vt.id, bm.id) AS id, vt.rank AS vr, bm.rank AS tr,
  round(coalesce(0.3 / (60 + vt.rank), 0) + coalesce(0.7 / (60 + bm.rank), 0), 9) AS score FROM vt FULL JOIN bm ON vt.query_id = bm.query_id AND vt.id = bm.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vr ASC NULLS LAST, tr ASC NULLS LAST) AS rank FROM f)"""


@query(RRF + " SELECT query_id, id, score, rank FROM r WHERE rank <= 20")
def rrf_hybrid(spark, d):
    return retrieval.fuse(_vectors(spark, d), _bm25(spark, d)).select("query_id", "id", "score", "rank")


@query(RRF.replace("0.3 / (60", "1.0 / (60").replace("0.7 / (60", "1.0 / (60") + " SELECT query_id, id, score, rank FROM r WHERE rank <= 20")
def rank_fusion_equal(spark, d):
    return retrieval.fuse(_vectors(spark, d), _bm25(spark, d), weights=(1.0, 1.0)).select("query_id", "id", "score", "rank")


@query(RRF + ", g AS (SELECT item_id AS query_id, item_id AS target FROM benchmark WHERE item_id % 50 = 0), j AS (SELECT g.query_id, min(CASE WHEN rank <= 10 THEN rank END) AS rank FROM g LEFT JOIN r ON g.query_id = r.query_id AND target = id GROUP BY g.query_id)"
       " SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 4) AS hit_at_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 4) AS hit_at_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 4) AS hit_at_5,"
       " round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 4) AS hit_at_10, round(avg(coalesce(1.0 / rank, 0.0)), 4) AS mrr_at_10, round(avg(coalesce(1 / log2(rank + 1), 0.0)), 4) AS ndcg_at_10 FROM j")  # fmt: skip
def hit_mrr(spark, d):
    golden = table(spark, d, "benchmark").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("item_id").alias("target"))
    ranked = retrieval.fuse(_vectors(spark, d), _bm25(spark, d), limit=160)
    return evaluation.retrieval_metrics(golden, ranked)


@query(f"WITH {_bm25_sql('left(text, 60)', '1')}, {_bm25_sql('text', '2')}, u AS (SELECT query_id, id, score * 1.0 AS score FROM sc1 UNION ALL SELECT query_id, id, score * 0.4 FROM sc2), g AS (SELECT query_id, id, round(sum(score), 6) AS score FROM u GROUP BY query_id, id)"
       " SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM g) WHERE rank <= 80")  # fmt: skip
def two_field_bm25(spark, d):
    docs = table(spark, d, "documents").withColumn("title", F.substring("text", 1, 60))
    return retrieval.bm25_fields(docs, _queries(spark, d).filter("q is not null"), "doc_id", {"title": 1.0, "text": 0.4})


QS = [("q1", "Ordinul nr. 20/1996 privind regimul", None), ("q2", "Decizia 45 din 1997", None), ("q3", "MO nr. 3/1996 despre building", None), ("q4", "ceva fara repere", None)]


def _hinted(spark):
    return spark.createDataFrame([(a, b) for a, b, _ in QS], "query_id string, q string")


@query("""SELECT * FROM (VALUES ('q1', '20', 1996, NULL, NULL::INTEGER), ('q2', '45', 1997, NULL, NULL), ('q3', '', NULL, '3', 1996), ('q4', '', NULL, NULL, NULL)) t(query_id, act_number, act_year, issue_number, issue_year)""")
def question_hints(spark, d):
    return _hinted(spark).select("query_id", retrieval.hints(F.col("q")).alias("h")).select("query_id", "h.*")


@query(WITH_ACTS + r""", n AS (SELECT issue_id, act_index, k, title, act_year, CASE WHEN regexp_matches(f, '^0*$') THEN '' ELSE f END AS n FROM (SELECT *, regexp_replace(regexp_replace(trim(act_number), '^(\d{1,3})\.(\d{3})$', '\1\2'), '^(.*)/((19|20)\d\d)$', '\1') AS f FROM a2))
SELECT k, 'q1' AS query_id, round(CASE WHEN (n = '20' OR split_part(n, '/', 1) = '20') AND abs(act_year - 1996) <= 1 THEN 0.01 + CASE WHEN act_year = 1996 THEN 0.005 ELSE 0 END + CASE WHEN contains(lower(title), 'ordinul') OR contains(lower(title), 'privind') OR contains(lower(title), 'regimul') THEN 0.015 ELSE 0 END ELSE 0 END, 6) AS boost FROM n
UNION ALL SELECT k, 'q2', round(CASE WHEN (n = '45' OR split_part(n, '/', 1) = '45') AND abs(act_year - 1997) <= 1 THEN 0.01 + CASE WHEN act_year = 1997 THEN 0.005 ELSE 0 END + CASE WHEN contains(lower(title), 'decizia') THEN 0.015 ELSE 0 END ELSE 0 END, 6) FROM n
UNION ALL SELECT k, 'q4', 0 FROM n
UNION ALL SELECT k, 'q3', CASE WHEN issue_id IN ('MO_PI_3_1996', 'PI_3_1996') THEN 0.15 WHEN contains(issue_id, '3') AND contains(issue_id, '1996') THEN 0.02 ELSE 0 END FROM n""")
def metadata_boost(spark, d):
    q = _hinted(spark).withColumn("h", retrieval.hints(F.col("q")))
    rows = acts(spark, d).join(F.broadcast(q))
    return rows.select("k", "query_id", retrieval.boost(F.col("h"), F.col("q"), F.col("act_number"), F.col("act_year"), F.col("title"), F.col("issue_id")).alias("boost"))


@query("""SELECT conv_id % 7 AS query_id, string_agg('user' || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY conv_id) AS context FROM conversations WHERE turn = 0 AND role = 'user' GROUP BY 1""")
def context_assembly(spark, d):
    c = table(spark, d, "conversations").filter("turn = 0 and role = 'user'")
    none = F.lit(None).cast("string")
    ranked = c.select(
        (F.col("conv_id") % 7).alias("query_id"), F.col("conv_id").alias("rank"), none.alias("issue_id"), F.col("conv_id").alias("act_index"), F.col("text").alias("parent_text"), "text",
        F.col("role").alias("doc_type"), none.alias("act_number"), F.lit(None).cast("int").alias("act_year"), none.alias("issuing_authority"), none.alias("title"), none.alias("path"),
    )
    return retrieval.context(ranked, parents=1 << 30)


@query()
def hybrid_search(spark, d):
    a = preparation.build_chunks(acts(spark, d))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("v_id"), "embedding")
    chunks = a.crossJoin(F.broadcast(e.agg(F.max("v_id").alias("m")))).withColumn("v_id", F.col("act_index") * 7 % (F.col("m") + 1)).join(e, "v_id").withColumn("era", F.lit("modern"))
    chunks = materialize(chunks.select("chunk_id", "text", "embedding", "doc_type", "act_number", "act_year", "title", "issue_id", "era"))
    q = _hinted(spark).crossJoin(table(spark, d, "embeddings").filter("vec_id = 3").select(F.col("embedding").alias("v")))
    return retrieval.search(chunks, q).select("query_id", "id", "score", "boost", "rank")


# listing


def _laws(spark, d):
    a = acts(spark, d)
    return a.select(F.concat_ws("_", "doc_type", F.nullif("act_number", F.lit("")), F.col("act_year").cast("string")).alias("law_id"), F.format_string("%s::act-%03d::chunk-000", F.col("issue_id"), F.col("act_index")).alias("chunk_id"), F.lit(0).alias("chunk_index"), F.col("full_text").alias("text"), "doc_type", "act_number", "act_year", "title", "issuing_authority", "issue_id")


LAWS = """, lw AS (SELECT concat_ws('_', doc_type, nullif(act_number, ''), cast(act_year AS string)) AS law_id, issue_id || '::act-' || lpad(cast(act_index AS string), greatest(3, length(cast(act_index AS string)))::INTEGER, '0') || '::chunk-000' AS chunk_id, * FROM a2),
ls AS (SELECT law_id, arg_min(title, chunk_id) AS title, arg_min(doc_type, chunk_id) AS doc_type, arg_min(act_year, chunk_id) AS act_year, count(*) AS n_chunks FROM lw WHERE {where} GROUP BY law_id)"""


@query(WITH_ACTS + LAWS.format(where="doc_type IN ('LEGE', 'HG') AND act_year BETWEEN 1996 AND 1998 AND regexp_matches(title, '(?i)building')") + " SELECT law_id, title, doc_type, act_year, n_chunks FROM ls")
def acts_listing(spark, d):
    return retrieval.listing(_laws(spark, d), ["LEGE", "HG"], (1996, 1998), "building").select("law_id", "title", "doc_type", "act_year", "n_chunks")


@query(WITH_ACTS + LAWS.format(where="true") + " SELECT law_id, act_year, (SELECT count(*) FROM ls) AS total FROM ls ORDER BY act_year DESC, law_id DESC LIMIT 20 OFFSET 40")
def acts_facet_total(spark, d):
    return retrieval.page(retrieval.listing(_laws(spark, d)), "date_desc", 40, 20).select("law_id", "act_year", "total")


@query(WITH_ACTS + LAWS.format(where="true") + " SELECT chunk_id, left(full_text, 300) AS summary FROM lw WHERE law_id = 'UNKNOWN_0_1996' ORDER BY chunk_id LIMIT 1")
def act_detail(spark, d):
    return retrieval.detail(_laws(spark, d), "UNKNOWN_0_1996").select("chunk_id", "summary")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def runs_latest(spark, d):
    runs = table(spark, d, "events").select(F.col("ts").alias("started_at"), F.col("event_id").alias("run_id"), "user_id")
    return retrieval.latest_runs(runs).select(F.col("run_id").alias("event_id"), "user_id")


@query("SELECT doc_id AS issue_id FROM documents WHERE text LIKE '%!!%' ORDER BY doc_id LIMIT 200")
def coverage_worklist(spark, d):
    i = table(spark, d, "documents").select(F.col("doc_id").alias("issue_id"), F.regexp_extract_all("text", F.lit("!!"), F.lit(0)).alias("extraction_warnings"))
    return retrieval.coverage_worklist(i).select("issue_id")


@query("SELECT count(*) FILTER (value > 10) AS ok, count(*) FILTER (NOT value > 10) AS failed, min(value) AS coverage_min FROM events")
def batch_stats(spark, d):
    return retrieval.batch_stats(table(spark, d, "events").select((F.col("value") > 10).alias("ok"), F.col("value").alias("coverage")))


@query(WITH_ACTS + " SELECT doc_type, issuing_authority, count(*) AS n FROM a2 GROUP BY ALL")
def type_authority_counts(spark, d):
    return acts(spark, d).groupBy("doc_type", "issuing_authority").agg(F.count(F.lit(1)).alias("n"))


@query(WITH_ACTS + " SELECT count(*) AS chunks, count(DISTINCT concat_ws('_', doc_type, nullif(act_number, ''), cast(act_year AS string))) AS laws, count(*) AS acts, min(act_year) AS first_year, max(act_year) AS last_year, count(DISTINCT issue_id) AS issues FROM a2")
def corpus_counts(spark, d):
    a = acts(spark, d)
    return retrieval.counts(_laws(spark, d).join(a.select("issue_id", "act_index", F.format_string("%s::act-%03d::chunk-000", F.col("issue_id"), F.col("act_index")).alias("chunk_id")), ["issue_id", "chunk_id"]), a.select("issue_id").distinct())


@query("SELECT event_type AS status, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type")
def status_histogram(spark, d):
    return evaluation.status_histogram(table(spark, d, "events").withColumnRenamed("event_type", "status"))


# graph


CITING = """, c AS (SELECT k, i AS pos, ['lege', 'ordonanta', 'ordonanta', 'hotarare_guvern', 'decret', 'decizie', 'lege'][i + 1] AS type, cast(CASE WHEN i = 6 THEN k + 1 ELSE 1000 + k % 100 + i END AS string) AS number, (1990 + k % 9 + i)::INTEGER AS year, CASE WHEN i = 0 THEN '5 alin. (2)' WHEN i = 4 THEN '7' END AS article
FROM a2, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS i))"""


def _citing(spark, d):
    """Acts whose texts name each kind of act that counts, an order that doesn't,
    and a law that may be there."""
    names = ("Legea", "ORDONANŢA Guvernului", "Ordonanța de  urgență a Guvernului", "Hotărârea\nGuvernului", "Decretul", "Decizia Curții Constituționale", "lege")
    year = lambda i: (F.lit(1990 + i) + F.col("k") % 9).cast("string")
    number = lambda i: (F.col("k") + 1).cast("string") if i == 6 else F.concat(F.lit("1."), F.lpad((F.col("k") % 100 + i).cast("string"), 3, "0"))
    ends = (", art. 5 alin. (2)", ".", ".", ".", ", art. 7", ".", ";")
    said = F.concat(*(x for i, (n, e) in enumerate(zip(names, ends)) for x in (F.lit(f" {n} nr. "), number(i), F.lit("/"), year(i), F.lit(e))), F.lit(" Ordinul nr. 5/2001."))
    return acts(spark, d).select("k", F.concat("full_text", F.lit("\n"), said).alias("full_text"))


@query(WITH_ACTS + CITING + " SELECT k, pos, type, number, year, article FROM c")
def citation_edges(spark, d):
    return graph.citations(_citing(spark, d)).select("k", "pos", "type", "number", "year", "article")


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages""")
def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target"))


@query(WITH_ACTS + CITING + """, t AS (SELECT cast(k AS string) AS number, 1996 + k % 9 AS year, min(k) AS target_id FROM a2 GROUP BY 1, 2)
SELECT c.k, pos, c.number, c.year, target_id, target_id IS NULL AS external FROM c LEFT JOIN t ON type = 'lege' AND c.number = t.number AND c.year = t.year""")
def edge_resolution(spark, d):
    targets = acts(spark, d).select(F.lit("lege").alias("type"), F.col("k").cast("string").alias("number"), (F.lit(1996) + F.col("k") % 9).cast("int").alias("year"), F.col("k").alias("act_id"))
    return graph.resolve(graph.citations(_citing(spark, d)), targets).select("k", "pos", "number", "year", "target_id", "external")


# evaluation


@query("""WITH x AS (SELECT d.doc_id, list_distinct(regexp_extract_all(strip_accents(lower(d.text)), '[a-z]{3,}')) AS s, list_distinct(regexp_extract_all(strip_accents(lower(b.text)), '[a-z]{3,}')) AS p FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id),
y AS (SELECT *, len(list_intersect(s, p)) AS c FROM x)
SELECT doc_id, CASE WHEN len(s) > 0 AND len(p) > 0 THEN round(c * 1.0 / len(p), 6) ELSE 0.0 END AS precision, CASE WHEN len(s) > 0 AND len(p) > 0 THEN round(c * 1.0 / len(s), 6) ELSE 0.0 END AS recall, CASE WHEN c > 0 THEN round(2.0 * c / (len(s) + len(p)), 6) ELSE 0.0 END AS f1 FROM y""")
def token_prf(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("b"))
    rows = table(spark, d, "documents").withColumn("item_id", F.col("doc_id") % 40).join(b, "item_id")
    return rows.select("doc_id", evaluation.token_overlap(F.col("text"), F.col("b")).alias("t")).select("doc_id", "t.*")


@query(r"""WITH p AS (SELECT u.conv_id, u.turn, a.text AS answer, u.text AS expected FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'),
t AS (SELECT *, list_distinct(regexp_extract_all(strip_accents(lower(expected)), '[a-z0-9]{3,}')) AS t FROM p),
s AS (SELECT conv_id, turn, CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda x: contains(strip_accents(lower(answer)), x))) * 1.0 / len(t) ELSE 0.0 END AS share FROM t)
SELECT conv_id, turn, round(share, 6) AS share, CASE WHEN share >= 0.6 THEN 'CORRECT' WHEN share >= 0.3 THEN 'PARTIAL' ELSE 'WRONG' END AS status FROM s""")
def answer_score(spark, d):
    c = table(spark, d, "conversations")
    a = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rows = c.filter("role = 'user'").join(a, ["conv_id", "turn"]).withColumn("share", evaluation.answer_share(F.col("answer"), F.col("text")))
    return rows.select("conv_id", "turn", F.round("share", 6).alias("share"), evaluation.answer_status(F.col("share")).alias("status"))


@query("SELECT lang AS era, count(*) AS n, round(avg(n_chars), 6) AS n_chars FROM documents GROUP BY ROLLUP (lang)")
def era_rollup(spark, d):
    return evaluation.by_era(table(spark, d, "documents").withColumnRenamed("lang", "era"), "n_chars")


@query("""SELECT lang AS era, round(avg(n_chars) FILTER (source = 'src0'), 6) AS src0, round(avg(n_chars) FILTER (source = 'src1'), 6) AS src1, round(round(avg(n_chars) FILTER (source = 'src1'), 6) - round(avg(n_chars) FILTER (source = 'src0'), 6), 6) AS gain FROM documents WHERE source IN ('src0', 'src1') GROUP BY lang""")
def era_compare_pivot(spark, d):
    rows = table(spark, d, "documents").filter("source in ('src0', 'src1')").select(F.col("lang").alias("era"), F.col("source").alias("pipeline"), "n_chars")
    return evaluation.compare_pipelines(rows, "n_chars", ["src0", "src1"])


@query("""WITH g AS (SELECT item_id, list_distinct([substr(strip_accents(lower(text)), i, 3) FOR i IN range(1, length(text) - 1)]) AS g FROM benchmark)
SELECT x.item_id, round(len(list_intersect(x.g, y.g)) * 1.0 / len(list_distinct(list_concat(x.g, y.g))), 6) AS overlap FROM g x JOIN g y ON y.item_id = x.item_id + 1""")
def trigram_jaccard(spark, d):
    b = table(spark, d, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(nxt, "item_id").select("item_id", evaluation.trigram_overlap(F.col("text"), F.col("other")).alias("overlap"))


@query("""SELECT o_orderkey, 'removed' AS change FROM (SELECT o_orderkey FROM orders EXCEPT SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0) UNION ALL SELECT o_orderkey, 'added' FROM (SELECT o_orderkey + 100000000 AS o_orderkey FROM orders WHERE o_orderkey % 50 = 0)""")
def identity_diff(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    new = o.filter("o_orderkey % 10 <> 0").union(o.filter("o_orderkey % 50 = 0").select(F.col("o_orderkey") + 100000000))
    return evaluation.identity_diff(o, new, ["o_orderkey"])


@query(WITH_ACTS + """ SELECT k, (CASE WHEN act_number NOT IN ('', '0') THEN 1 ELSE 0 END + CASE WHEN doc_type <> 'UNKNOWN' THEN 1 ELSE 0 END + CASE WHEN length(title) > 10 THEN 1 ELSE 0 END + 1) AS score FROM a2""")
def act_scores(spark, d):
    return evaluation.act_score(acts(spark, d)).select("k", "score")


@query("""WITH r AS (SELECT event_type, count(*) * 1.0 / (SELECT count(*) FROM events WHERE event_id % 2 = 0) AS s FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type, count(*) * 1.0 / (SELECT count(*) FROM events) AS t FROM events GROUP BY 1)
SELECT event_type, round(s, 6) AS share, round(t, 6) AS base_share FROM r FULL JOIN b USING (event_type)""")
def drift_histogram(spark, d):
    e = table(spark, d, "events")
    return evaluation.drift(e.filter("event_id % 2 = 0"), e, "event_type").select("event_type", "share", "base_share")


@query()
def golden_sample(spark, d):
    c = preparation.build_chunks(acts(spark, d))
    return evaluation.sample_golden(c, 20, least_tokens=50).select("chunk_id", "law_id", "n_tokens")


@query(r"""WITH m AS (SELECT doc_id, '# a' || chr(10) || replace(text, '. ', chr(10) || '## b' || chr(10) || '| c | d |' || chr(10) || 'Art. 1') AS md FROM documents)
SELECT doc_id, len(regexp_extract_all(md, '(?m)^#{1,6}\s'))::INTEGER AS headings, len(regexp_extract_all(md, '(?m)^\s*\|.*\|\s*$'))::INTEGER AS table_rows, len(regexp_extract_all(md, '(?mi)^\s*art\.'))::INTEGER AS articles FROM m""")
def structure_counts(spark, d):
    md = F.concat(F.lit("# a\n"), F.replace(F.col("text"), F.lit(". "), F.lit("\n## b\n| c | d |\nArt. 1")))
    return table(spark, d, "documents").select("doc_id", evaluation.structure(md).alias("s")).select("doc_id", "s.*")


# loading


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def last_wins_upsert(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    return bundle.last_wins(e, "user_id", F.struct("ts", "event_id")).select("user_id", "event_id")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 3 <> 0")
def incremental_skip(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.lit("1").alias("pipeline_version"))
    return bundle.pending(rows, rows.filter("doc_id % 3 = 0")).select("doc_id", "sha256")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def stream_events_upsert(spark, d):
    from ..streaming.upserts import latest, upsert_stream, watch

    root = shared_folder(spark) + "/stream-" + spark.sql("SELECT uuid()").first()[0]
    schema = table(spark, d, "events").schema
    stream = watch(spark, f"{d}/events.parquet*", schema).select("user_id", "event_id", F.struct("ts", "event_id").alias("o"))
    upsert_stream(stream, f"{root}/table", f"{root}/checkpoint", "user_id", "o")
    return latest(spark, f"{root}/table").select("user_id", "event_id")


@query("SELECT o_custkey AS doc_id, max(o_orderkey) AS seq, min(o_orderkey) AS first_seq FROM orders GROUP BY o_custkey")
def manifest_last_entry(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seq"))
    first = o.groupBy("doc_id").agg(F.min("seq").alias("first_seq"))
    return bundle.last_wins(o, "doc_id", "seq").join(first, "doc_id")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def recent_log(spark, d):
    return bundle.recent(table(spark, d, "events"), F.to_date(F.lit("2024-01-30")), 10).select("event_id")


@query("SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1")
def stitched_tables(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("part"), F.lit(3).alias("width"), F.lit("h").alias("header"), F.lit(1).alias("n_rows"))
    return layout.stitch_tables(t).groupBy("doc_id").agg(F.sum("n_parts").alias("n"))


@query(WITH_ACTS + """ SELECT issue_id, cast(k AS string) AS number, act_index FROM a2 WHERE k % 40 = 0 AND k > 0""")
def resolved_missing(spark, d):
    a = acts(spark, d).withColumn("act_number", F.col("k").cast("string"))
    w = a.filter("k % 40 = 0").select("issue_id", F.concat(F.lit("missing act nr. "), F.col("act_number")).alias("warning"))
    return validation.resolve_missing(w, a)




@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE left(text, 40) END AS markdown FROM documents")
def markdown_cache(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.substring("text", 1, 40).alias("markdown"), F.lit("modern").alias("era"))
    stale = F.when(F.col("doc_id") % 3 == 0, F.lit("0")).otherwise(F.col("sha256"))
    return bundle.cached_markdown(rows.select("doc_id", "sha256"), rows.withColumn("sha256", stale)).select("doc_id", "markdown")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'laws/2007/03/05/d' || cast(doc_id AS VARCHAR) || '.pdf' ELSE 'laws/2001/01/01/d' || cast(doc_id AS VARCHAR) || '.pdf' END AS path FROM documents")
def source_files(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("stem"))
    at = lambda day: rows.select(F.concat(F.lit(f"laws/{day}/"), "stem", F.lit(".pdf")).alias("path"))
    files = at("2007/03/05").filter("cast(regexp_extract(path, 'd([0-9]+).pdf', 1) as long) % 2 = 0").union(at("2001/01/01")).filter("cast(regexp_extract(path, 'd([0-9]+).pdf', 1) as long) % 5 <> 0")
    return bundle.match_files(rows.withColumn("date", F.lit("2007-03-05")), files).select("doc_id", "path")


@query(WITH_ACTS + """ SELECT k, '[' || concat_ws(' | ', doc_type || CASE WHEN act_number <> '' THEN ' ' || act_number || '/' || cast(act_year AS string) ELSE '' END, CASE WHEN k % 2 = 0 THEN 'Partidul Nou Roman | cotizatii lunare 12 luni' ELSE issuing_authority END, 'MO ' || issue_id, cast(act_year AS string)) || '] STRUCTURA TABEL COTIZATII Partidul Nou Roman: ' || title AS t FROM a2""")
def legacy_prefixes(spark, d):
    a = acts(spark, d)
    t = F.concat(F.lit("STRUCTURA TABEL COTIZATII Partidul Nou Roman: "), "title")
    by = F.when(F.col("k") % 2 == 0, "").otherwise(F.col("issuing_authority"))
    return a.select("k", preparation.legacy_prefix(t, F.col("doc_type"), F.col("act_number"), F.col("act_year"), by, F.col("issue_id")).alias("t"))


@query(WITH_ACTS + " SELECT k, CASE k % 3 WHEN 0 THEN 'Lista ' || title WHEN 1 THEN title || ' text' ELSE '' END AS title FROM a2")
def table_titles(spark, d):
    lines = F.when(F.col("k") % 3 == 0, F.concat(F.lit("Lista "), "title", F.lit("\nalta linie\nPRIM-MINISTRU"))).when(F.col("k") % 3 == 1, F.concat("title", F.lit(" text\n12\nMINISTRU X\n"))).otherwise("12\nMINISTRUL")
    return acts(spark, d).select("k", preparation.table_title(lines).alias("title"))


@query("""SELECT vec_id, [round(cast(x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS FLOAT)::DOUBLE, 5) FOR x IN embedding] AS u FROM embeddings""")
def unit_vectors(spark, d):
    # round() gives 0 for small negative values, the SQL -0
    rounded = lambda x: F.when((x < 0) & (F.round(x, 5) == 0), F.lit(-0.0)).otherwise(F.round(x, 5))
    return table(spark, d, "embeddings").select("vec_id", F.transform(preparation.unit(F.col("embedding")), lambda x: rounded(x.cast("double"))).alias("u"))


@query(WITH_ACTS + """, f AS (SELECT issue_id, act_index, k, CASE WHEN k % 4 = 0 THEN 'continuare de text ' || cast(k AS string) WHEN k % 9 = 1 THEN '' ELSE 'ORDIN ' || cast(k AS string) END AS t FROM a2),
r AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY act_index) = 1 AS one FROM f), n AS (SELECT * FROM r WHERE one OR t <> ''), g AS (SELECT *, sum(CASE WHEN one OR NOT starts_with(t, 'continuare') THEN 1 ELSE 0 END) OVER (PARTITION BY issue_id ORDER BY act_index) AS g FROM n)
SELECT issue_id, min(act_index) AS act_index, string_agg(t, chr(10) ORDER BY act_index) AS full_text FROM g GROUP BY issue_id, g""")
def merged_fragments(spark, d):
    t = F.when(F.col("k") % 4 == 0, F.concat(F.lit("continuare de text "), F.col("k").cast("string"))).when(F.col("k") % 9 == 1, "").otherwise(F.concat(F.lit("ORDIN "), F.col("k").cast("string")))
    return segmentation.merge_act_fragments(acts(spark, d).withColumn("full_text", t))


@query(WITH_ACTS + r""", n AS (SELECT issue_id, bool_or((act_number IN ('0', '') AND doc_type <> 'COMUNICAT') OR doc_type = 'UNKNOWN' OR (k % 3 = 0 AND split_part(regexp_replace(regexp_replace(trim(act_number), '^(\d{1,3})\.(\d{3})$', '\1\2'), '^(.*)/((19|20)\d\d)$', '\1'), '/', 1) = cast(k % 300 + 1 AS string))) AS need FROM a2 GROUP BY issue_id)
SELECT issue_id, act_index, CASE WHEN need AND regexp_full_match(regexp_replace(trim(act_number), '^0+', ''), '|[123]|20[0-2]\d') AND NOT regexp_full_match(cast(k AS string), '[123]|20[0-2]\d') THEN cast(k AS string) ELSE act_number END AS act_number FROM a2 JOIN n USING (issue_id)""")
def reextracted_numbers(spark, d):
    a = acts(spark, d)
    return validation.reextract(a, a.withColumn("act_number", F.col("k").cast("string"))).select("issue_id", "act_index", "act_number")


# recovery and audits


@query("""SELECT l_orderkey AS doc_id, round(1 - coalesce(sum(length(l_returnflag || l_linestatus || cast(l_partkey AS VARCHAR))) FILTER (l_linenumber % 3 = 0), 0) * 1.0 / sum(length(l_returnflag || l_linestatus || cast(l_partkey AS VARCHAR))), 6) AS share FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus FROM lineitem) GROUP BY 1""")
def unmapped_sweep(spark, d):
    text = F.concat("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"))
    b = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus").distinct()
    blocks = b.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3 == 0).alias("block_id"), text.alias("text"))
    return recovery.unmapped(blocks, blocks.filter("not block_id").select("doc_id", "block_id").distinct())[1].select("doc_id", "share")


@query(WITH_ACTS + " SELECT k, CASE WHEN title = 'ORDIN' THEN 'cites' ELSE CASE WHEN k % 2 = 0 THEN 'promulgates' ELSE 'approves' END END AS kind FROM a2")
def edge_kinds(spark, d):
    said = F.when(F.col("title") == "ORDIN", "fara").when(F.col("k") % 2 == 0, "pentru promulgarea Legii privind ceva").otherwise("pentru aprobarea Ordonanței")
    return acts(spark, d).select("k", graph.edge_kind(said).alias("kind"))


@query("SELECT l_orderkey AS source_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem WHERE l_orderkey % 5 = 0) WHERE r <= 3 GROUP BY 1")
def edge_expansion(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.lit(False).alias("external"), F.col("l_linenumber").alias("pos"))
    ids = e.filter("source_id % 5 = 0").select(F.col("source_id").alias("id"))
    return graph.expand(ids, e, 3).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query(WITH_ACTS + " SELECT issue_id, count(*) AS acts, count(*) FILTER (title = 'ORDIN') AS generic_titles FROM a2 GROUP BY issue_id")
def issue_audits(spark, d):
    a = acts(spark, d)
    return evaluation.issue_audit(a, a.select("issue_id", "act_index")).select("issue_id", "acts", "generic_titles")


@query(WITH_ACTS + """ SELECT k, CASE WHEN title = 'ORDIN' THEN 'privind seria ' || cast(k AS string) ELSE title END AS title FROM a2""")
def titles_from_body(spark, d):
    body = F.concat(F.lit("ORDIN\nprivind seria "), F.col("k").cast("string"), F.lit("\n"), F.col("full_text"))
    return acts(spark, d).select("k", recovery.title_from_body(F.col("title"), body).alias("title"))


@query()
def recovered_acts(spark, d):
    a = acts(spark, d)
    own = a.select("issue_id", F.col("k").cast("string").alias("act_number"), "full_text", "k")
    layer = own.groupBy("issue_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "full_text"))), lambda x: x["full_text"]), "\n").alias("text"))
    markdown = own.filter("k % 20 <> 0").groupBy("issue_id").agg(F.array_join(F.collect_list("full_text"), "\n").alias("markdown"))
    return recovery.recover_acts(layer, own.filter("k % 10 <> 0"), markdown).select("issue_id", "number")


@query()
def block_roles(spark, d):
    lines = layout.lines(acts(spark, d).select(F.col("k").alias("doc_id"), F.col("full_text").alias("text")))
    return recovery.classify_blocks(lines.select("doc_id", F.lit(1).alias("page_no"), F.col("line_no").alias("order"), F.col("line").alias("text")))
