"""Batch retrieval and url lookup over a passage corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rolloom.functions.text import py_strip
from rolloom.operators import vectors
from rolloom.operators.ordered import CHUNK_ROWS, number_within

# Result sentences.
MISSING_TEXT = "Text field missing"
NO_RESULTS = "No results found for this query."
QUERY_RULE = "---"

#: Hash ranges of urls with a sketch each, and the binary logarithm of a sketch's registers.
URL_PARTS, SKETCH_LG = 64, 12


def _has_url(c: str = "url") -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def overfetch(k: Column) -> Column:
    """How many passages to fetch so that ``k`` distinct urls are likely."""
    return F.greatest(k * vectors.OVERFETCH_FACTOR, F.lit(vectors.OVERFETCH_MIN))


def attach_docs(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Hits with their documents; a hit without a document has no url."""
    return hits.join(corpus, "id", "left")


def dedup_by_url(hits: DataFrame, k: Column) -> DataFrame:
    """Best passage per query and url in score order, at most ``k`` per query."""
    per_url = W.partitionBy("qid", "url").orderBy("rank")
    firsts = hits.where(_has_url()).withColumn("_first", F.row_number().over(per_url)).where("_first = 1").drop("_first")
    ranked = firsts.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("rank")))
    return ranked.where(F.col("rank") <= k)


def retrieve(requests: DataFrame, passages: DataFrame, corpus: DataFrame, search=vectors.topk_exact, default_k: int = vectors.DEFAULT_TOPK) -> DataFrame:
    """Answer ``requests(qid, qvec, topk, return_scores)`` from ``passages`` and ``corpus(id, url, title, text)``.

    Every query uses its own ``topk`` (null means the default). ``search`` is called
    with the largest over-fetch; each query then keeps its own share of it. For search
    through an index, ``passages`` is its table and ``search`` binds its centroids.
    """
    asked = requests.withColumn("_k", F.coalesce("topk", F.lit(default_k)))
    largest = asked.agg(F.max(overfetch(F.col("_k")))).first()[0]
    if largest is None:
        largest = vectors.OVERFETCH_MIN
    hits = search(requests.select("qid", "qvec"), passages, int(largest))
    wanted = asked.select("qid", "_k", "return_scores")
    own = hits.join(wanted, "qid").where(F.col("rank") <= overfetch(F.col("_k")))
    # only urls travel with the over-fetched hits; titles and texts join the final ones
    best = dedup_by_url(attach_docs(own, corpus.select("id", "url")), F.col("_k"))
    out = attach_docs(best, corpus.drop("url"))
    return out.withColumn("score", F.when(F.coalesce("return_scores", F.lit(False)), F.col("score"))).drop("_k", "return_scores")


def format_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Result text per query; a query without hits gets the fixed sentence.

    The body is the first of ``content``, ``text`` and ``snippet`` that is there. A query
    has at most its ``topk`` hits, so the collected group is bounded.
    """
    bodies = [F.nullif(F.col(c), F.lit("")) for c in ("content", "text", "snippet") if c in hits.columns]
    snippet = F.coalesce(*bodies, F.lit("No snippet provided"))
    entry = F.concat(
        F.col("rank").cast("string"), F.lit(". url: "), F.coalesce("url", F.lit("No URL provided")), F.lit("\nTitle: "), F.coalesce("title", F.lit("No title provided")),
        F.lit("\n"), F.coalesce(F.concat(F.lit("Score: "), F.col("score").cast("string"), F.lit("\n")), F.lit("")), F.lit("Snippet: "), snippet, F.lit("\n"),
    )
    grouped = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("t")))).alias("_e"))
    body = F.array_join(F.transform("_e", lambda e: e["t"]), "\n")
    found = py_strip(F.concat(F.lit("Found "), F.size("_e").cast("string"), F.lit(" results:\n"), body))
    texts = grouped.select("qid", found.alias("_text"))
    return queries.join(texts, "qid", "left").withColumn("result", F.coalesce("_text", F.lit(NO_RESULTS))).drop("_text")


def join_queries(formatted: DataFrame, request: str, pos: str) -> DataFrame:
    """Texts of a request's queries in order, with a rule between them: one row per text or rule.

    ``pos`` numbers a request's queries from 1.
    """
    place = F.col(pos).cast("bigint") * 2
    text = F.struct((place - 1).alias("line_no"), F.col("result").alias("line"))
    rule = F.struct((place - 2).alias("line_no"), F.lit(QUERY_RULE).alias("line"))
    return formatted.select(request, F.inline(F.when(F.col(pos) > 1, F.array(rule, text)).otherwise(F.array(text))))


# --- url lookup -------------------------------------------------------------


def url_index(corpus: DataFrame) -> DataFrame:
    """``url, ord, pos``: one row per passage of a url in corpus order (1-based ``ord``).

    One row per posting instead of a list per url: a url owning a third of the corpus
    stays spread over many tasks and rows.
    """
    posted = corpus.where(_has_url()).select("url", "pos")
    return number_within(posted, ["url"], ["pos"], F.floor(F.col("pos") / CHUNK_ROWS), "ord")


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """Documents and unique urls."""
    per_url = corpus.groupBy(F.when(_has_url(), F.col("url")).alias("url")).agg(F.count("*").alias("_n"))
    return per_url.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_docs"), F.count("url").alias("n_urls"))


def url_sketches(corpus: DataFrame, parts: int = URL_PARTS, lg_size: int = SKETCH_LG) -> DataFrame:
    """``part, n_docs, n_with_url, sketch``: counts and a sketch of the urls of each hash range.

    Sketches of the same part merge, so those of new passages are stored beside the old ones.
    """
    url = F.when(_has_url(), F.col("url"))
    part = F.pmod(F.xxhash64(url), F.lit(parts)).cast("int").alias("part")
    return corpus.groupBy(part).agg(F.count("*").alias("n_docs"), F.count(url).alias("n_with_url"), F.hll_sketch_agg(F.coalesce(url, F.lit("")), F.lit(lg_size)).alias("sketch"))


def add_sketches(corpus: DataFrame, path: str, **sizes: int) -> None:
    """Store the sketches of passages that arrived, beside those already there."""
    url_sketches(corpus, **sizes).write.mode("append").parquet(path)


def sketched_stats(sketches: DataFrame) -> DataFrame:
    """Documents, and about how many unique urls, from stored sketches; parts share no url, so their numbers add up.

    Passages without a url are sketched as one empty url in the part of null; it is taken off.
    """
    merged = sketches.groupBy("part").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_with_url").alias("u"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
    without = (F.col("u") < F.col("n_docs")).cast("bigint")
    urls = F.sum(F.when(F.col("u") > 0, F.greatest(F.col("n") - without, F.lit(1))).otherwise(0))
    return merged.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(urls, F.lit(0)).alias("n_urls"))


def sketch_error(lg_size: int = SKETCH_LG) -> float:
    """Three standard errors of a sketch's estimate, as a share of it."""
    return 3 * 1.04 / 2 ** (lg_size / 2)


def crawl(requests: DataFrame, corpus: DataFrame) -> DataFrame:
    """Passages of each requested url, one row each, in corpus order.

    ``requests(request_no, url)`` keeps its order and repeats; a url without passages
    yields one row with a null passage.
    """
    wanted = requests.select("url").where(_has_url()).distinct()
    mine = corpus.join(wanted, "url", "left_semi").select("url", "pos", F.coalesce("text", F.lit(MISSING_TEXT)).alias("text"))
    numbered = number_within(mine, ["url"], ["pos"], F.floor(F.col("pos") / CHUNK_ROWS), "passage_no")
    counts = mine.groupBy("url").agg(F.count("*").alias("n_passages"))
    sized = requests.join(counts, "url", "left").withColumn("n_passages", F.coalesce("n_passages", F.lit(0)))
    result = F.when(F.col("n_passages") > 0, F.concat(F.lit("Found "), F.col("n_passages").cast("string"), F.lit(" passages for URL: "), F.col("url"))).otherwise(
        F.concat(F.lit("No passages found for URL: "), F.col("url"))
    )
    return sized.join(numbered, "url", "left").select("request_no", "url", "n_passages", result.alias("result"), "passage_no", "text")


def format_crawl(rows: DataFrame) -> DataFrame:
    """Lines of the text per requested url: ``request_no, line_no, line``, one row each at every size."""
    head = F.array(
        F.struct(F.lit(1).alias("p"), F.concat(F.lit("url: "), F.col("url")).alias("t")),
        F.struct(F.lit(2).alias("p"), F.concat(F.lit("Result: "), F.col("result")).alias("t")),
        F.struct(F.lit(3).alias("p"), F.concat(F.lit("Passages: "), F.col("n_passages").cast("string")).alias("t")),
    )
    first = rows.where(F.col("passage_no").isNull() | (F.col("passage_no") == 1))
    top = first.select("request_no", "n_passages", F.explode(F.when(F.col("n_passages") > 0, head).otherwise(F.slice(head, 1, 2))).alias("h"))
    top = top.select("request_no", F.col("h.p").cast("bigint").alias("line_no"), F.col("h.t").alias("line"))
    text = F.concat(F.lit("Passage "), F.col("passage_no").cast("string"), F.lit(": "), F.col("text"))
    last = F.when(F.col("passage_no") == F.col("n_passages"), py_strip(text)).otherwise(text)
    body = rows.where(F.col("passage_no").isNotNull()).select("request_no", (F.col("passage_no") + 3).alias("line_no"), last.alias("line"))
    return top.unionByName(body)
