"""Input tables of the registered queries.

The given tables are clean, so most checks run on ``DIRTY``: one SQL text that
Spark and DuckDB both run over the whole orders table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsift.functions.stage import work_folder

NAME = "orders_dirty"
STAMP = "2026-01-01T00:00:00Z"

DIRTY = """
WITH src AS (SELECT o_orderkey k, o_custkey c, o_totalprice p, o_orderpriority pr,
                    substr(CAST(o_orderdate AS STRING),1,10) d FROM orders),
one AS (SELECT k AS order_id,
 CASE WHEN k % 9 = 0 THEN NULL ELSE c END AS cust_key,
 CASE WHEN k % 400 = 0 THEN p * 100 ELSE p END AS total_price,
 CASE WHEN k % 5 = 0 THEN upper(pr) WHEN k % 5 = 1 THEN concat(' ', lower(pr), '  ') ELSE pr END AS priority,
 CASE WHEN k % 50 = 0 THEN 'unknown' WHEN k % 31 = 0 THEN NULL ELSE CAST(c AS STRING) END AS cust_text,
 CASE WHEN k % 3 = 0 THEN concat(substr(d,6,2),'/',substr(d,9,2),'/',substr(d,1,4))
      WHEN k % 97 = 0 THEN 'n/a?' ELSE d END AS order_day,
 CASE WHEN k % 60 = 0 THEN 'B' ELSE 'A' END AS flag,
 'X' AS region, CAST(NULL AS STRING) AS notes,
 concat('REF-', CAST(k AS STRING)) AS ref_code
 FROM src)
SELECT * FROM one UNION ALL SELECT * FROM one WHERE order_id % 25 = 0
"""
COLUMNS = ["order_id", "cust_key", "total_price", "priority", "cust_text", "order_day", "flag", "region", "notes",
           "ref_code"]
DTYPES = dict(zip(COLUMNS, ["bigint", "bigint", "double"] + ["string"] * 7))

# Documents with faults the orders table does not show: a saved index, long
# texts that differ in spacing only, dates of one format, infinities, a rare
# timestamp and a rare truth value.
DOCS_NAME = "documents_dirty"
DOCS = """
WITH src AS (SELECT doc_id k, text tx, lang lg, source sr, n_chars nc FROM documents),
one AS (SELECT k AS row_no, tx AS body, lg AS lang,
 CASE WHEN k % 3 = 0 THEN upper(sr) ELSE sr END AS origin,
 CASE WHEN k % 40 = 0 THEN 'soon' ELSE concat('20', CAST(10 + k % 15 AS STRING), '/0', CAST(1 + k % 9 AS STRING), '/', CAST(10 + k % 19 AS STRING)) END AS seen,
 CASE WHEN k % 90 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN k % 91 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(nc AS DOUBLE) END AS size,
 CASE WHEN k % 70 = 0 THEN TIMESTAMP '2024-02-29 12:30:00' ELSE TIMESTAMP '2020-01-01 00:00:00' END AS stamp,
 k % 60 = 0 AS checked,
 CASE WHEN k % 80 = 0 THEN 3 ELSE 7 END AS version_code FROM src)
SELECT * FROM one UNION ALL
SELECT row_no, concat(chr(9), ' ', replace(body, ' ', '  ')), upper(lang), origin, seen, size, stamp, checked, version_code FROM one WHERE row_no % 6 = 0
"""
DOCS_COLUMNS = {"row_no": "bigint", "body": "string", "lang": "string", "origin": "string", "seen": "string", "size": "double",
                "stamp": "timestamp", "checked": "boolean", "version_code": "int"}
DOCS_INDEX = "Unnamed: 0"  # the name row_no has in the audited table

NUMERIC = COLUMNS[:3]
TEXT = COLUMNS[3:]

# Small CSV files as one row each: a third of them break some rule. The text is
# the same in both engines; only the bytes of the Windows-1252 files are not.
FILES = """
SELECT c_custkey AS k,
 concat('in/cust-', CAST(c_custkey AS STRING),
        CASE WHEN c_custkey % 11 = 0 THEN '.txt' WHEN c_custkey % 13 = 0 THEN '.CSV' ELSE '.csv' END) AS path,
 CASE WHEN c_custkey % 4 = 0 THEN ';' WHEN c_custkey % 4 = 1 THEN '|' ELSE ',' END AS delim,
 CASE WHEN c_custkey % 17 = 0 THEN 'empty' WHEN c_custkey % 19 = 0 THEN 'blank' WHEN c_custkey % 23 = 0 THEN 'nul'
      WHEN c_custkey % 29 = 0 THEN 'twice' WHEN c_custkey % 31 = 0 THEN 'latin' ELSE 'good' END AS kind,
 c_name, CAST(c_nationkey AS STRING) AS nation, c_mktsegment AS segment
FROM customer
"""
FILE_TEXT = """
SELECT k, path, delim, kind,
 CASE WHEN kind = 'empty' THEN '' WHEN kind = 'blank' THEN concat('  ', chr(10), ' ')
      ELSE concat('name', delim, CASE WHEN kind = 'twice' THEN ' NAME' ELSE 'nation' END, delim, '"a ', delim, ' b"', delim, chr(10),
                  c_name, delim, nation, delim, segment, CASE WHEN kind = 'nul' THEN chr(1) ELSE '' END, delim, '1', chr(10),
                  'caf', CASE WHEN kind = 'latin' THEN chr(233) ELSE 'e' END, delim, nation, delim, 'x', delim, '2', chr(10)) END AS txt
FROM ({files}) f
"""


# Tables cut into files: name, key, columns (SQL, the names they get), delimiter, encoding. Some texts hold line ends and letters beyond ASCII.
FOLDER = [
    ("customer", "c_nationkey", ("c_custkey AS id", "CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, chr(10), '\"x\"') ELSE c_name END AS name", "c_acctbal AS balance", "c_mktsegment AS segment"), ",", "UTF-8"),
    ("supplier", "s_nationkey", ("concat(s_name, chr(233)) AS label", "s_acctbal AS balance", "s_suppkey % 2 = 0 AS even"), ";", "ISO-8859-1"),
    ("part", "p_size", ("p_partkey AS id", "p_brand AS brand", "CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE p_type END AS kind", "p_retailprice AS price", "CAST(NULL AS STRING) AS note"), "|", "UTF-8"),
    ("orders", "substr(CAST(o_orderdate AS STRING), 1, 7)", ("o_orderkey AS id", "concat(o_orderpriority, ',', o_orderstatus) AS state", "o_totalprice AS total"), "\t", "UTF-8"),
]
FOLDER_TYPES = [("long", "string", "double", "string"), ("string", "double", "boolean"), ("long", "string", "string", "double", "double"), ("long", "string", "double")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_view(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    view = f"{name}_{uuid.uuid4().hex}"
    table(spark, sf_dir, name).createOrReplaceTempView(view)
    try:
        return spark.sql(sql.replace(f"FROM {name}", f"FROM {view}"))
    finally:
        spark.catalog.dropTempView(view)


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_view(spark, sf_dir, "orders", DIRTY)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_view(spark, sf_dir, "documents", DOCS).withColumnRenamed("row_no", DOCS_INDEX)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV files of ``FILES`` in the form of the binary source."""
    text = _with_view(spark, sf_dir, "customer", FILE_TEXT.format(files=FILES))
    content = (F.when(F.col("kind") == "latin", F.encode("txt", "ISO-8859-1"))
               .when(F.col("kind") == "nul", F.encode(F.replace("txt", F.lit("\x01"), F.lit("\x00")), "UTF-8"))
               .otherwise(F.encode("txt", "UTF-8")))
    return text.select("path", F.octet_length(content).cast("long").alias("length"), content.alias("content"))


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that all executors share; a local session without one gets its own."""
    return f"{work_folder(spark).rstrip('/')}/colsift-{uuid.uuid4().hex}"
