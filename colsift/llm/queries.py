"""Registered queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colsift.llm import decontamination, fill_in_middle, imatch, kmeans_tree, laesa, language, mixing, near_duplicates, personal_data, rollups, token_files, toxicity, warc
from colsift.llm.staging import shared_folder

TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).drop("url", "html")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_offsets(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents"), personal_data.train())


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return imatch.compared(docs, imatch.lexicon(docs))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op10_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = rollups.Rollup(spark, shared_folder(spark))
    return rollups.maintained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), store)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laesa.clustered(table(spark, sf_dir, "embeddings"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.neighbours(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_decontamination, op3_warc, op4_mixing, op5_token_files, op6_personal_data, op7_imatch,
                                   op8_language, op9_near_duplicates, op10_rollups, op11_fill_in_middle, op12_centroids, op13_neighbours)}

WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"



def lloyd_sql(rounds: int = laesa.ROUNDS) -> str:
    """The rounds of op12, one after the other, with exact distances to all centroids."""
    steps = ["""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
   WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)""",
             """m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)) NULLS LAST, e) - 1 AS c, e AS m FROM v QUALIFY c < 40)"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(e) AS e, arg_min(c, d * 64 + c) AS c, min(d) AS d FROM (SELECT r, vec_id, e, c,
   CAST(list_inner_product(e, e) - 2 * list_inner_product(e, m) + list_inner_product(m, m) AS BIGINT) AS d FROM v, m{i}) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""m{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.m, o.m) AS m FROM m{i} o LEFT JOIN (SELECT c, list(x ORDER BY i) AS m FROM
   (SELECT c, i, floor(sum(x) / count(*)) AS x FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{i}) GROUP BY c, i) GROUP BY c) n ON n.c = o.c)""")
    return ",\n ".join(steps) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(list_transform(m, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM a{rounds} a JOIN m{rounds} m ON a.c = m.c"""


ORACLES = {
    "op11_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
 u AS (SELECT *, [CAST('0x' || substr(h, i, 8) AS BIGINT) for i in [1, 9, 17, 25]] AS k FROM d),
 f AS (SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
   CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k[3] % 100 >= 90 THEN 'plain' WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
 p AS (SELECT *, '<P>' || substring(t, 1, a) AS x, '<M>' || substring(t, a + 1, b - a) AS y, '<S>' || substring(t, b + 1, n - b) AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN x || z || y ELSE z || x || y END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op12_centroids": lloyd_sql(),
    "op3_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
 h AS (SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN head IS NULL OR head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN head <> page_id THEN head END AS refers_to
FROM p LEFT JOIN h USING (payload_digest)""",
    "op4_mixing": f"""
WITH d AS (SELECT doc_id, source, {WORDS}::BIGINT AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
 w AS (SELECT *, ([5, 2, 1])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight, source_size * 2 AS lim FROM s),
 r AS (SELECT *, row_number() OVER f AS place, coalesce(sum(lim) OVER b, 0) AS used, coalesce(sum(weight) OVER b, 0) AS used_weight,
   sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight FROM w
   WINDOW f AS (ORDER BY lim / weight, source NULLS LAST),
          b AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 a AS (SELECT *, (all_size::DOUBLE * 1.5::DOUBLE - used::DOUBLE) / (all_weight - used_weight)::DOUBLE AS rate FROM r),
 l AS (SELECT coalesce(arg_min(rate, place) FILTER (rate * weight <= lim), 'infinity'::DOUBLE) AS level, floor(max(all_size)::DOUBLE * 1.5) AS total FROM a),
 g AS (SELECT source, source_size, least(lim::DOUBLE, level * weight) AS target, total FROM a, l),
 q AS (SELECT d.*, source_size, target, total, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS reached
   FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
 t AS (SELECT doc_id, size, total, turn, k, (reached + turn * source_size)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) v(turn) WHERE size > 0),
 c AS (SELECT doc_id, size, total, sum(size) OVER (ORDER BY finish, k, turn ROWS UNBOUNDED PRECEDING) AS upto FROM t),
 n AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM c WHERE upto <= total GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(n.taken, 0)::BIGINT AS taken FROM q LEFT JOIN n ON q.doc_id IS NOT DISTINCT FROM n.doc_id""",
    "op9_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
   ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 75 * (x.n + y.n - both_have)),
 reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
 c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id""",
    "op10_rollups": rf"""
WITH d AS (SELECT doc_id, source, lang, {WORDS}::BIGINT AS words,
   coalesce(len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^\x20\x09-\x0DA-Za-z0-9]')), 0)::BIGINT AS pieces FROM documents
   WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))
SELECT source, lang, 'words-1' AS version, count(*)::BIGINT AS documents, sum(words)::BIGINT AS tokens FROM d GROUP BY 1, 2
UNION ALL SELECT source, lang, 'pieces-1', count(*)::BIGINT, sum(pieces)::BIGINT FROM d GROUP BY 1, 2""",
}
