"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.llm import alignment, bpe, decontaminate, hmm, html_text, langid, licenses, minhash, quality, secrets, toxicity, twins, warc, whitening
from rolloom.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


@query("op1_template_leaks")
def op1_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "kind")


@query("op2_page_text")
def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


@query("op3_toxicity_scores")
def op3_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(langid.remainder("doc_id", 5) == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    model = toxicity.train(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, ["doc_id", "held_out"])


@query("op4_license_paragraphs")
def op4_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


@query("op5_bpe_digests")
def op5_bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.default_path())


@query("op6_linked_secrets", twins.linked_secrets())
def op6_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(langid.remainder("doc_id", 4) == 2, F.lit(False)))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, ["doc_id", "held_out"])


@query("op8_near_duplicates", twins.near_duplicates())
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_rows")


@query("op9_decision_list")
def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = langid.remainder("doc_id", 5) == 0
    found, _ = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return found


@query("op10_hidden_markov_scores")
def op10_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("learn", F.coalesce(langid.remainder("doc_id", 7) != 2, F.lit(True)))
    return hmm.score(docs, "learn").withColumn("held_out", ~F.col("learn")).drop("learn")


@query("op11_warc_archives", twins.archived_pages())
def op11_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    rows = whitening.transform(vectors, model, ["vec_id"]).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(x) for x in model.explained]).cast("array<double>")
    return rows.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"),
        "whitened",
        F.get(explained, "at").alias("explained"),
        F.lit(whitening.identity_error(vectors, model)).alias("identity_error"),
        F.col("deviation").alias("deviation_exact"),
    )


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents"), *alignment.default_paths())
