"""The registered queries of the training-data operators, and DuckDB SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ammlytics.llm import ann, collocations, html_extract, language_id, licenses, line_dedup, ngram_join, packing, sentencepiece_bpe, sharding, substring_dedup, vector_codes, winnowing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.license_scan(_table(spark, sf_dir, "documents")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_lines(_table(spark, sf_dir, "documents"), grams=6, wide=20, least_words=1)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    filters = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.predict(docs, filters)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.round_trip(_table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.main_text(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_collocations(_table(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_winnowing": op1_winnowing, "op2_licenses": op2_licenses, "op3_line_dedup": op3_line_dedup, "op4_language_id": op4_language_id, "op6_substring_dedup": op6_substring_dedup, "op7_packing": op7_packing, "op8_sentencepiece": op8_sentencepiece, "op9_html_text": op9_html_text, "op10_neighbours": op10_neighbours, "op5_ngram_join": op5_ngram_join, "op11_vector_codes": op11_vector_codes, "op12_collocations": op12_collocations, "op13_sharding": op13_sharding}

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op5_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
reach AS (SELECT a AS node, b AS other FROM link UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.other)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(other) AS m FROM reach GROUP BY node) m USING (doc_id)
""",
    "op6_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s + 1:s + 20], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 19, 0))) AS s FROM d)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, s + j AS p FROM rep CROSS JOIN range(0, 20) t(j)),
ws AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
k AS (SELECT ws.doc_id, string_agg(word, ' ' ORDER BY ws.p) AS kept, count(*) AS n FROM ws ANTI JOIN gone USING (doc_id, p) GROUP BY ws.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
""",
    "op11_vector_codes": vector_codes.oracle_sql(),
    "op12_collocations": collocations.oracle_sql(),
    "op13_sharding": sharding.oracle_sql(),
}
