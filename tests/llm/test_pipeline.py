"""The corpus pipeline on a small table, and the registered SQL of its operators."""

import duckdb

import corpus_pipeline
from ammlytics.llm.queries import ORACLE_SQL, QUERIES


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    counts = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        counts.append(docs.count())
        if len(counts) < 5:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    assert counts[0] >= 0.99 * before and counts[1] == counts[0] and counts[3] == counts[2] <= counts[1]
    assert docs.select("sequence_id").distinct().count() < counts[4]


def test_rejects_and_nulls(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(9001, None, None, "s", 0), (9002, "1234 5678", "en", "s", 9), (9003, "", "de", "s", 0)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs.unionByName(odd), sf_dir).collect()}
    assert kept == {r.doc_id for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, odd, sf_dir).count() == 3


def test_sql(spark, sf_dir):
    c = duckdb.connect()
    for table in ("documents", "embeddings"):
        c.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    for name, sql in ORACLE_SQL.items():
        want = c.execute(sql).df()
        frames = want, QUERIES[name](spark, sf_dir).toPandas()[want.columns]
        want, got = (sorted(map(repr, x.astype(object).where(x.notna(), None).values.tolist())) for x in frames)
        assert want == got, name
