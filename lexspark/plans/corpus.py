"""A corpus of issues and acts derived from orders and their line items, in SQL
that Spark and DuckDB read alike: integers and strings only.

An issue is a month of orders, an act an order; its type, number form, title,
authority and text follow from its key. The table of contents leaves some acts
out, adds others and has some wrong numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import parts, register_views, table

ACTS = """
a0 AS (
  SELECT o_orderkey AS k, o_custkey AS cust, o_orderstatus AS st, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d,
    row_number() OVER (PARTITION BY year(o_orderdate), month(o_orderdate) ORDER BY o_orderdate, o_orderkey) - 1 AS act_index
  FROM orders
), a1 AS (
  SELECT a0.*, concat('MO_PI_', cast(m AS string), '_', cast(y AS string)) AS issue_id,
    CASE k % 10 WHEN 0 THEN 'LEGE' WHEN 1 THEN 'HG' WHEN 2 THEN 'ORDIN' WHEN 3 THEN 'DECRET' WHEN 4 THEN 'DECIZIE' WHEN 5 THEN 'OUG'
      WHEN 6 THEN 'UNKNOWN' WHEN 7 THEN 'ORDIN' WHEN 8 THEN 'HG' ELSE 'COMUNICAT' END AS doc_type,
    CASE k % 7 WHEN 0 THEN concat(cast(k AS string), '/', cast(y AS string)) WHEN 1 THEN '0' WHEN 2 THEN ''
      WHEN 3 THEN concat('1.', lpad(cast(k % 1000 AS string), 3, '0')) WHEN 4 THEN concat(cast(k AS string), '/', cast(k % 900 + 1 AS string))
      WHEN 5 THEN concat('E ', cast(k AS string)) ELSE cast(k AS string) END AS act_number,
    concat('Ministerul ', n_name) AS issuing_authority,
    CASE WHEN k % 5 = 0 THEN 'ORDIN' ELSE concat('privind regimul ', lower(c_mktsegment), ' pentru ', lower(n_name), ' seria ', cast(k % 97 AS string)) END AS title
  FROM a0 JOIN customer ON cust = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""

#: Romanian month names as both engines can say them.
MONTH = "CASE m WHEN 1 THEN 'ianuarie' WHEN 2 THEN 'februarie' WHEN 3 THEN 'martie' WHEN 4 THEN 'aprilie' WHEN 5 THEN 'mai' WHEN 6 THEN 'iunie' WHEN 7 THEN 'iulie' WHEN 8 THEN 'august' WHEN 9 THEN 'septembrie' WHEN 10 THEN 'octombrie' WHEN 11 THEN 'noiembrie' ELSE 'decembrie' END"

TEXTS = f"""
a2 AS (
  SELECT issue_id, act_index, doc_type, act_number, y AS act_year, issuing_authority, title, k,
    concat(
      CASE doc_type WHEN 'HG' THEN 'HOTARARE' WHEN 'OUG' THEN 'ORDONANTA DE URGENTA' WHEN 'UNKNOWN' THEN 'Anexa' ELSE doc_type END, chr(10),
      title, chr(10), 'In temeiul Legii nr. ', cast(k % 400 + 1 AS string), '/', cast(y - 1 AS string), ', art. ', cast(k % 9 + 1 AS string), chr(10),
      CASE WHEN k % 3 = 0 THEN concat('Se abroga Ordinul nr. ', cast(k % 300 + 1 AS string), '/', cast(y - 2 AS string), '.', chr(10)) ELSE '' END,
      issuing_authority, ' emite prezentul act.', chr(10),
      'Art. 1. - Se aproba regimul ', cast(k % 13 AS string), '.', chr(10),
      '(1) Prima regula are valoarea ', cast(k AS string), '.', chr(10), '(2) A doua regula urmeaza.', chr(10),
      'Art. 2. - Prezentul act intra in vigoare.', chr(10),
      CASE WHEN k % 4 = 0 THEN concat('Judetul ', upper(substr(title, 1, 1)), lower(substr(issuing_authority, 13)), ' aplica.', chr(10)) ELSE '' END,
      CASE WHEN k % 11 = 0 THEN '' ELSE concat('Bucuresti, ', cast(d AS string), ' ', {MONTH}, ' ', cast(y AS string), '.', chr(10), 'Nr. ', cast(k AS string), '.') END
    ) AS full_text
  FROM a1
)"""

TOC = """
t0 AS (
  SELECT issue_id, act_index AS toc_idx, doc_type AS toc_type,
    CASE WHEN k % 31 = 0 THEN cast(k + 7 AS string) ELSE act_number END AS toc_number, title AS toc_title, act_index * 2 + 1 AS page_start
  FROM a1 WHERE k % 17 <> 0
  UNION ALL
  SELECT issue_id, act_index + 10000, 'DECIZIE', concat('9', cast(k AS string)), concat('privind completarea seria ', cast(k AS string)), act_index * 2 + 2
  FROM a1 WHERE k % 19 = 0
)"""

#: Acts with text; the table of contents; lines of the acts of one year.
WITH_ACTS = f"WITH {ACTS}, {TEXTS}"
WITH_ALL = f"WITH {ACTS}, {TEXTS}, {TOC}"


#: Bytes of orders' files whose acts make a task: about 100,000 acts.
ORDERS_BYTES = 2 << 20


def corpus(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql (one of the WITHs above and a query) over the tables of sf_dir. Acts are
    spread by key before their texts are made: the window that numbers them has
    a group for each issue, too few and too small for the work on texts."""
    register_views(spark, sf_dir, ("orders", "customer", "nation"))
    n = parts(table(spark, sf_dir, "orders"), size=ORDERS_BYTES)
    return spark.sql(sql.replace("FROM a1", f"FROM (SELECT /*+ REPARTITION({n}, k) */ * FROM a1) a1"))


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """issue_id, act_index, doc_type, act_number, act_year, issuing_authority,
    title, k, full_text."""
    return corpus(spark, sf_dir, f"{WITH_ACTS} SELECT * FROM a2")


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """issue_id, toc_idx, toc_type, toc_number, toc_title, page_start."""
    return corpus(spark, sf_dir, f"WITH {ACTS}, {TOC} SELECT * FROM t0")
