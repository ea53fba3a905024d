import hashlib
import os

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from rolloom.llm import bpe, queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the given tables are not here")


def test_stages_keep_columns_and_effects(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (-1, "!!! 12", "en", "s", 6), (-2, "", "en", "s", 0)], docs.schema)
    docs = docs.union(extra).union(docs.limit(2))
    for clash in ("_th", "_id", "node", "row", "id", "h", "t", "lang_pred0", "score0", "_cuts", "new", "class_id"):
        docs = docs.withColumn(clash, F.concat(F.lit("own "), F.col("doc_id").cast("string")))
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        if name != "bpe":
            assert out.columns == docs.columns
            assert out.where("doc_id IS NOT NULL AND (row <> concat('own ', doc_id) OR node <> concat('own ', doc_id) OR lang_pred0 <> concat('own ', doc_id) OR _th <> row OR h <> row OR id <> row)").count() == 0
            out = spark.createDataFrame(out.toPandas(), docs.schema) if name != "language_id" else out
        counts.append(out.count())
        docs = out
    assert counts[0] == spark.read.parquet(f"{DIR}/documents.parquet").count() + 2 and counts[1] < counts[0] and counts[2] <= counts[1] and counts[3] == counts[4] == counts[2]
    assert set(docs.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_run_equals_its_stages_on_the_given_table(spark):
    got = corpus_pipeline.run(spark, DIR).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    library = Tokenizer.from_file(bpe.default_path())
    assert len(got) == len({r["doc_id"] for r in got})
    unmasked = 0
    for r in got:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        unmasked += r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert unmasked > 0.7 * len(got)


def test_numbered_queries_are_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.QUERIES) == set(names) and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_returns_one_row_per_input_row(spark, name):
    got = queries.QUERIES[name](spark, DIR)
    if name.startswith(("op1_", "op4_")):
        assert "doc_id" in got.columns and got.count() > 0
    else:
        table = {"op2": "pages", "op11": "pages", "op12": "embeddings"}.get(name.split("_")[0], "documents")
        rows = 32 if name.startswith("op12_") else 1  # one for each component
        assert got.count() == rows * spark.read.parquet(f"{DIR}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for table in ("documents", "pages"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DIR}/{table}.parquet')")
    got = queries.QUERIES[name](spark, DIR)
    cur = c.execute(queries.ORACLES[name])
    assert [d[0] for d in cur.description] == got.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, cur.fetchall()))
