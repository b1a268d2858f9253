"""Registered queries against their SQL, and the pipeline's stages against plain versions."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from colsift.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_pipeline_stages(spark, docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        if name != "token_files":
            assert docs.columns == columns
        if name == "near_duplicates":
            from test_operators import brute_components
            want = brute_components([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in docs.collect()} == {i for i, c in want.items() if i == c}
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            hit = {r.doc_id for r in before.collect() if any(t in r.text for t in items)}
            left = {r.doc_id for r in docs.collect()}
            assert hit and not hit & left and len(left) >= before.count() - len(hit) - 1
        if name == "mixing":
            assert docs.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
            mixed = docs.count()
    assert docs.count() == mixed


def test_stages_pass_on_columns_with_names_of_their_own(spark, docs):
    from test_operators import prose
    names = ["kept_id", "kept_rows", "kept_digest", "plan_id", "plan_times", "plan_turn", "digest", "component_id", "size", "taken"]
    rows = [(i, f"{prose(i, 30)} number{i}", "en", f"s{i % 2}") for i in range(40)] + [(5, f"{prose(5, 30)} number5", "en", "s1"), (90, None), (91, ""), (None, prose(77, 30), "en", "s0")]
    frame = docs(rows)
    for n in names:
        frame = frame.withColumn(n, F.lit("own"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns and {r[n] for r in out.select(*names).collect() for n in names} == {"own"}
        assert stage(spark, frame.where("false"), SF).count() == 0
    ids = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, SF).collect()]
    assert ids.count(5) == 1 and {90, 91, None} <= set(ids)
