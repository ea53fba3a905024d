"""Retrieval queries over ``embeddings`` and ``pages``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.operators import retrieval, vectors
from rolloom.plans.registry import as_long, query, table
from rolloom.session import work_path
from rolloom.sources import files, sinks

_HOST = "https?://([^/:?#]+)"


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a passage of a page's host; each seventeenth has no url."""
    e = table(spark, sf_dir, "embeddings")
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", _HOST, 1).alias("host"), "html")
    j = e.withColumn("page_id", F.pmod("vec_id", F.lit(p.count()))).join(p, "page_id")
    return j.select(
        F.col("vec_id").alias("id"), F.when(F.pmod("vec_id", F.lit(17)) != 0, F.col("host")).alias("url"),
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("title"), F.col("html").alias("text"), F.col("embedding").alias("vec"),
    )


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


_PAIRS_SQL = """
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT q.id AS qid, v.id AS id, round(list_dot_product(q.e, v.e), 6) AS score FROM v q, v),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM pairs)
"""


@query("topk_exact", _PAIRS_SQL + "SELECT qid, id, score, rank FROM ranked WHERE rank <= 5")
def topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long(vectors.topk_exact(_queries(spark, sf_dir), _vectors(spark, sf_dir), 5), "rank")


#: Cells of the index, of which a query probes a third; a passage is in up to two of them.
NLIST, NPROBE, COPIES, FACTOR, STEPS = 256, 76, 2, 1.1, 1


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids: the first vectors, moved to the mean of their cell."""
    v = _vectors(spark, sf_dir)
    first = v.where(F.col("id") < NLIST).select(F.col("id").cast("int").alias("cell"), F.col("vec").cast("array<double>").alias("centroid"))
    return vectors.refine_cells(v, first, STEPS, "vec")


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The index, written and read back: centroids and passages by cell."""
    centroids, path = cells(spark, sf_dir), work_path(spark, "index")
    sinks.write_index(centroids, vectors.assign_cells(_vectors(spark, sf_dir), centroids, "vec", copies=COPIES, factor=FACTOR), path)
    return spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/passages")


_CELLS_SQL = f"""
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
old AS (SELECT id AS cell, e AS c FROM v WHERE id < {NLIST}),
own AS (SELECT id, arg_min(cell, (-s, cell)) AS cell FROM (SELECT id, cell, round(list_dot_product(e, c), 12) AS s FROM v, old) GROUP BY id),
mean AS (SELECT cell, j, avg(e[j]) AS m FROM own JOIN v USING (id), (SELECT unnest(range(1, (SELECT max(len(e)) + 1 FROM v))) AS j) GROUP BY cell, j),
cent AS (SELECT cell, list(round(m / n, 9) ORDER BY j) AS c FROM (SELECT cell, j, m, greatest(sqrt(sum(m * m) OVER (PARTITION BY cell)), 1e-12) AS n FROM mean) GROUP BY cell
  UNION ALL SELECT cell, c FROM old WHERE cell NOT IN (SELECT cell FROM mean)),
near AS (SELECT id, cell, s, row_number() OVER (PARTITION BY id ORDER BY s DESC, cell) AS place, max(s) OVER (PARTITION BY id) AS best
  FROM (SELECT id, cell, round(list_dot_product(e, c), 12) AS s FROM v, cent))
"""
_IVF_SQL = (
    _CELLS_SQL
    + f""",
probes AS (SELECT id AS qid, cell FROM near WHERE place <= {NPROBE}),
cells AS (SELECT id, cell FROM near WHERE place = 1 OR place <= {COPIES} AND 1 - s <= {FACTOR} * greatest(1 - best, 0)),
pairs AS (SELECT DISTINCT qid, c.id, round(list_dot_product(q.e, v.e), 6) AS score FROM probes JOIN cells c USING (cell) JOIN v q ON q.id = qid JOIN v ON v.id = c.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM pairs)
"""
)
_EXACT_SQL = """, exact AS (SELECT q.id AS qid, v.id, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.e, v.e), 6) DESC, v.id) AS rank FROM v q, v)"""
_SAMPLE_SQL = "SELECT vec_id AS id, md5(vec_id || ':7') AS h FROM embeddings QUALIFY row_number() OVER (ORDER BY md5(vec_id || ':7'), vec_id) <= (SELECT count(*) // 4 FROM embeddings)"


@query("training_sample", _SAMPLE_SQL)
def training_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the vectors, drawn by a seeded hash."""
    v = _vectors(spark, sf_dir)
    return vectors.training_sample(v, v.count() // 4, seed=7, largest_bin=2).select("id", vectors.sample_hash(F.col("id"), 7).alias("h"))


@query("cell_costs", _CELLS_SQL + "SELECT cell, count(id) AS n, coalesce(sum(round(1 - s, 9)::DECIMAL(20, 9))::DOUBLE, 0) AS cost FROM cent LEFT JOIN (SELECT * FROM near WHERE place = 1) USING (cell) GROUP BY cell")
def cell_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and cost of every trained cell."""
    return as_long(vectors.cell_costs(_vectors(spark, sf_dir), cells(spark, sf_dir), "vec"), "cell")


@query("topk_ivf", _IVF_SQL + "SELECT qid, id, score, rank FROM ranked WHERE rank <= 5")
def topk_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in a third of the cells."""
    centroids, assigned = _index(spark, sf_dir)
    return as_long(vectors.topk_ivf(_queries(spark, sf_dir), assigned, centroids, 5, NPROBE), "rank")


@query(
    "index_check",
    _IVF_SQL
    + _EXACT_SQL
    + f""", t AS ({_SAMPLE_SQL}),
f AS (SELECT count(*) AS n, count(r.id) AS found FROM exact x JOIN t ON t.id = x.qid LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) r ON r.qid = x.qid AND r.id = x.id WHERE x.rank <= 5)
SELECT count(*) AS n_checked, count(*) FILTER (r.id = r.qid) AS self_hits, min(score) AS min_top1, min(score) >= 0.99 AS normalized, (SELECT round(found / n, 4) FROM f) AS recall, (SELECT found / n >= 0.9 FROM f) AS good
FROM ranked r JOIN t ON t.id = r.qid WHERE rank = 1""",
)
def index_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on the index, asked with a quarter of the vectors."""
    centroids, assigned = _index(spark, sf_dir)
    v = _vectors(spark, sf_dir)
    return vectors.check_index(vectors.training_sample(v, v.count() // 4, seed=7), v, assigned, centroids, NPROBE)


@query(
    "ivf_recall",
    _IVF_SQL
    + _EXACT_SQL
    + """ SELECT count(*) AS n, round(avg(CASE WHEN r.id IS NULL THEN 0 ELSE 1 END), 4) AS recall,
(SELECT round(count(*) / ((SELECT count(*) FROM v) * (SELECT count(*) FROM v)), 4) FROM probes JOIN cells USING (cell)) AS share_read
FROM exact x LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) r ON r.qid = x.qid AND r.id = x.id WHERE x.rank <= 5""",
)
def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact top 5 found, and of the passages read for it, copies included."""
    centroids, assigned = _index(spark, sf_dir)
    q, v = _queries(spark, sf_dir), _vectors(spark, sf_dir)
    near = vectors.topk_ivf(q, assigned, centroids, 5, NPROBE).select("qid", "id", F.lit(1).alias("hit"))
    exact = vectors.topk_exact(q, v, 5).select("qid", "id")
    read = vectors.cells_read(q, assigned, centroids, NPROBE).agg(F.sum("n_read")).first()[0] or 0
    share = F.round(F.try_divide(F.lit(read).cast("double"), F.lit(float(v.count()) * q.count())), 4)
    return exact.join(near, ["qid", "id"], "left").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"), F.first(share).alias("share_read"))


_RETRIEVE_SQL = (
    _IVF_SQL
    + """,
p AS (SELECT v.vec_id AS id, CASE WHEN v.vec_id % 17 <> 0 THEN regexp_extract(pg.url, 'https?://([^/:?#]+)', 1) END AS url, 'label ' || v.label AS title, pg.html AS text
  FROM embeddings v JOIN pages pg ON pg.page_id = v.vec_id % (SELECT count(*) FROM pages)),
k AS (SELECT vec_id AS qid, CASE WHEN vec_id % 3 = 0 THEN 3 ELSE CAST(vec_id % 3 AS BIGINT) * 4 END AS k, vec_id % 2 = 0 AS sc FROM embeddings),
h AS (SELECT r.*, p.url, p.title, p.text, k.k, k.sc FROM ranked r JOIN k USING (qid) JOIN p ON p.id = r.id WHERE rank <= greatest(2 * k.k, 6) AND p.url IS NOT NULL),
u AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY qid, url ORDER BY rank) = 1),
d AS (SELECT qid, id, url, title, text, CASE WHEN sc THEN score END AS score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank, k FROM u),
hits AS (SELECT * EXCLUDE (k) FROM d WHERE rank <= k)
"""
)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.pmod("qid", F.lit(3))
    return _queries(spark, sf_dir).select("qid", "qvec", F.when(m != 0, m * 4).alias("topk"), (F.pmod("qid", F.lit(2)) == 0).alias("return_scores"))


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval through the index."""
    centroids, assigned = _index(spark, sf_dir)

    def search(queries: DataFrame, stored: DataFrame, k: int) -> DataFrame:
        return vectors.topk_ivf(queries, stored, centroids, k, NPROBE)

    return retrieval.retrieve(_requests(spark, sf_dir), assigned, passages(spark, sf_dir).drop("vec"), search)


@query("retrieve_dedup", _RETRIEVE_SQL + "SELECT qid, id, url, title, score, rank FROM hits")
def retrieve_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long(_retrieved(spark, sf_dir).select("qid", "id", "url", "title", "score", "rank"), "rank")


@query(
    "hits_text",
    _RETRIEVE_SQL
    + """,
t AS (SELECT qid, trim('Found ' || count(*) || ' results:' || chr(10) || string_agg(rank || '. url: ' || url || chr(10) || 'Title: ' || title || chr(10)
  || coalesce('Score: ' || score || chr(10), '') || 'Snippet: ' || text || chr(10), chr(10) ORDER BY rank), chr(10) || ' ' || chr(9) || chr(13)) AS r FROM hits GROUP BY qid)
SELECT qid, md5(coalesce(r, 'No results found for this query.')) AS result_md5, length(coalesce(r, 'No results found for this query.')) AS n_chars FROM k LEFT JOIN t USING (qid)""",
)
def hits_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _requests(spark, sf_dir).select("qid")
    out = retrieval.format_hits(asked, _retrieved(spark, sf_dir))
    return out.select("qid", F.md5("result").alias("result_md5"), F.length("result").cast("bigint").alias("n_chars"))


# --- urls -------------------------------------------------------------------


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host, whole pages as passages, in page order."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("pos"), F.regexp_extract("url", _HOST, 1).alias("url"), F.col("html").alias("text"))


_CORPUS_SQL = "WITH c AS (SELECT page_id AS pos, regexp_extract(url, 'https?://([^/:?#]+)', 1) AS url, html AS text FROM pages)"


@query("url_index", _CORPUS_SQL + " SELECT url, row_number() OVER (PARTITION BY url ORDER BY pos) AS ord, pos FROM c")
def url_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index written to the document store and read back."""
    c = corpus(spark, sf_dir)
    path = work_path(spark, "doc-store")
    sinks.write_doc_store(c, retrieval.url_index(c), path)
    return spark.read.parquet(f"{path}/url_index").select("url", "ord", "pos")


@query("corpus_stats", _CORPUS_SQL + " SELECT count(*) AS n_docs, count(DISTINCT url) AS n_urls FROM c")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.corpus_stats(corpus(spark, sf_dir))


@query("corpus_sketch", "SELECT count(*) AS n_docs, count(DISTINCT url) AS n_urls, true AS within_bound FROM pages")
def corpus_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique pages told from stored sketches of two arrivals, and whether that is as near the exact number as promised."""
    pages = table(spark, sf_dir, "pages")
    path = work_path(spark, "sketches")
    for half in (0, 1):
        retrieval.add_sketches(pages.where(F.pmod("page_id", F.lit(2)) == half), path)
    told = retrieval.sketched_stats(spark.read.parquet(path)).select("n_docs", F.col("n_urls").alias("told"))
    exact = retrieval.corpus_stats(pages).select(F.col("n_docs").alias("all_docs"), "n_urls")
    near = F.abs(F.col("told") - F.col("n_urls")) <= retrieval.sketch_error() * F.col("n_urls")
    return told.join(exact, told["n_docs"] == exact["all_docs"]).select("n_docs", "n_urls", near.alias("within_bound"))


@query(
    "corpus_roundtrip",
    """SELECT CAST(page_id AS VARCHAR) AS id, url, NULLIF(length(html) % 5, 0)::VARCHAR AS title, md5(html) AS text_md5 FROM pages""",
)
def corpus_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus written as JSON lines and read back."""
    title = F.nullif(F.pmod(F.length("html"), F.lit(5)), F.lit(0)).cast("string")
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", title.alias("title"), F.col("html").alias("text"))
    path = work_path(spark, "corpus")
    sinks.write_corpus(p, path)
    return files.read_corpus(spark, path).select("id", "url", "title", F.md5("text").alias("text_md5"))


def crawl_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per host, numbered by its first page, and per page one for an unknown host."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", _HOST, 1).alias("url"))
    known = p.groupBy("url").agg((F.min("page_id") * 2).alias("request_no")).select("request_no", "url")
    unknown = p.select((F.col("page_id") * 2 + 1).alias("request_no"), F.concat(F.lit("unknown-"), F.col("page_id").cast("string")).alias("url"))
    return known.union(unknown)


_CRAWL_SQL = (
    _CORPUS_SQL
    + """,
r AS (SELECT min(pos) * 2 AS request_no, url FROM c GROUP BY url UNION ALL SELECT pos * 2 + 1, 'unknown-' || pos FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS passage_no, count(*) OVER (PARTITION BY url) AS n_passages FROM c),
j AS (SELECT r.request_no, r.url, coalesce(n.n_passages, 0) AS n_passages, CASE WHEN n.url IS NULL THEN 'No passages found for URL: ' ELSE 'Found ' || n_passages || ' passages for URL: ' END || r.url AS result, passage_no, text
  FROM r LEFT JOIN n ON n.url = r.url)
"""
)


@query("crawl", _CRAWL_SQL + "SELECT request_no, url, n_passages, result, passage_no, md5(text) AS text_md5 FROM j")
def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.crawl(crawl_requests(spark, sf_dir), corpus(spark, sf_dir))
    return rows.select("request_no", "url", "n_passages", "result", "passage_no", F.md5("text").alias("text_md5"))


@query(
    "crawl_text",
    _CRAWL_SQL
    + """, w AS (SELECT request_no, 1 AS line_no, 'url: ' || any_value(url) AS line FROM j GROUP BY request_no
  UNION ALL SELECT request_no, 2, 'Result: ' || any_value(result) FROM j GROUP BY request_no
  UNION ALL SELECT request_no, 3, 'Passages: ' || any_value(n_passages) FROM j WHERE n_passages > 0 GROUP BY request_no
  UNION ALL SELECT request_no, passage_no + 3, CASE WHEN passage_no = n_passages THEN rtrim('Passage ' || passage_no || ': ' || text, chr(10) || ' ') ELSE 'Passage ' || passage_no || ': ' || text END FROM j WHERE passage_no IS NOT NULL)
SELECT request_no, CAST(line_no AS BIGINT) AS line_no, md5(line) AS line_md5 FROM w""",
)
def crawl_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.crawl(crawl_requests(spark, sf_dir), corpus(spark, sf_dir))
    return retrieval.format_crawl(rows).select("request_no", "line_no", F.md5("line").alias("line_md5"))


# --- encoders ---------------------------------------------------------------


def _letter_counts():
    """Stand-in encoder: counts of four letters, for checking the batch path."""
    return lambda texts: np.array([[t.count(c) for c in "aeiq"] for t in texts], dtype=np.float64)


@query(
    "encoder_embeddings",
    "WITH t AS (SELECT doc_id, "
    + ", ".join(f"length('query: ' || text) - length(replace('query: ' || text, '{c}', '')) AS {c}" for c in "aeiq")
    + " FROM documents) SELECT doc_id, "
    + ", ".join(f"round({c} / sqrt(a * a + e * e + i * i + q * q), 6) AS v_{c}" for c in "aeiq")
    + " FROM t",
)
def encoder_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", vectors.encoder_text(F.col("text"), "e5-small", True).alias("text"))
    v = vectors.embed(d, _letter_counts, "text").select("doc_id", vectors.l2_normalize(F.col("embedding")).alias("v"))
    return v.select("doc_id", *[F.round(F.get("v", F.lit(i)), 6).alias(f"v_{c}") for i, c in enumerate("aeiq")])


@query(
    "encoder_text",
    """SELECT doc_id, md5('passage: ' || text) AS e5, md5(text) AS m3, md5('Represent this sentence for searching relevant passages: ' || text) AS bge, md5(text) AS other FROM documents""",
)
def encoder_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(vectors.encoder_text(t, "e5-base", False)).alias("e5"), F.md5(vectors.encoder_text(t, "bge-m3", True)).alias("m3"),
        F.md5(vectors.encoder_text(t, "bge-large", True)).alias("bge"), F.md5(vectors.encoder_text(t, "gte", True)).alias("other"),
    )


@query(
    "pooling",
    """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, vec_id % 8 + 1 AS n FROM embeddings),
d AS (SELECT vec_id, n, j, e FROM e, (SELECT unnest(range(8)) AS j))
SELECT vec_id, round(sum(w * m), 6) AS mean_sum, round(sum(w * c), 6) AS cls_sum FROM (
  SELECT vec_id, j + 1 AS w, list_sum(list_transform(range(n), lambda t: e[t * 8 + j + 1])) / n AS m, e[j + 1] AS c FROM d) GROUP BY vec_id""",
)
def pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector read as eight token vectors, the first ``vec_id % 8 + 1`` of them kept."""
    e = table(spark, sf_dir, "embeddings")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("embedding", t * 8 + 1, 8))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: (t <= F.pmod("vec_id", F.lit(8))).cast("int"))
    p = e.select("vec_id", vectors.pool("mean", tokens, mask).alias("m"), vectors.pool("cls", tokens, mask).alias("c"))

    def weighted(c: str):
        return F.round(F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6)

    return p.select("vec_id", weighted("m").alias("mean_sum"), weighted("c").alias("cls_sum"))
