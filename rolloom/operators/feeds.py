"""Paper-feed operators: entries to papers, recency filter, top papers and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rolloom.functions.text import collapse_space

# Limits, fallbacks and the timestamp format of the feed.
MAX_ABSTRACT = 3_000
MAX_CANDIDATES = 24
CANDIDATE_FACTOR = 3
NO_AUTHORS = "(unknown authors)"
NO_PDF = "(no pdf url)"
NO_ABSTRACT = "(no abstract)"
FEED_TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def atom_papers(entries: DataFrame) -> DataFrame:
    """Papers from feed entries; an entry without title or id is dropped."""
    names = F.filter(F.transform(F.coalesce("author", F.array()), lambda a: collapse_space(a["name"])), lambda n: n != "")
    pdf = F.get(F.filter(F.coalesce("link", F.array()), lambda x: F.coalesce(x["_title"] == "pdf", F.lit(False))), F.lit(0))["_href"]
    papers = entries.select(
        collapse_space(F.col("title")).alias("title"),
        F.substring(collapse_space(F.col("summary")), 1, MAX_ABSTRACT).alias("summary"),
        collapse_space(F.col("published")).alias("published"),
        collapse_space(F.col("updated")).alias("updated"),
        F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), F.lit(NO_AUTHORS)).alias("authors"),
        collapse_space(F.col("id")).alias("abs_url"),
        F.coalesce(F.nullif(pdf, F.lit("")), F.lit(NO_PDF)).alias("pdf_url"),
    )
    return papers.where((F.col("title") != "") & (F.col("abs_url") != ""))


def recent(papers: DataFrame, now: Column, days: int) -> DataFrame:
    """Papers updated within ``max(days, 1)`` days of ``now``; no date keeps a paper, a bad one is an error."""
    at = F.to_timestamp_ntz(F.nullif(F.col("updated"), F.lit("")), F.lit(FEED_TIME))
    cutoff = now.cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(max(days, 1)))
    return papers.where(at.isNull() | (at >= cutoff))


def top_papers(papers: DataFrame, n: int, now: Column, days: int) -> DataFrame:
    """Per ``query``: newest ``max(3n, 24)`` candidates, then the recent ones, then the first ``max(1, n)``.

    Adds ``rank``. The rank filters prune each input partition before the shuffle, so a
    query owning most papers sends only its candidates.
    """
    keep = max(1, n)
    newest = W.partitionBy("query").orderBy(F.desc("updated"), "abs_url")
    candidates = papers.withColumn("_c", F.row_number().over(newest)).where(F.col("_c") <= max(keep * CANDIDATE_FACTOR, MAX_CANDIDATES))
    kept = recent(candidates, now, days)
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("_c"))).where(F.col("rank") <= keep).drop("_c")


def format_papers(queries: DataFrame, papers: DataFrame, days: int) -> DataFrame:
    """Text report per query over its ranked papers, of which there are at most ``n``."""
    entry = F.concat_ws(
        "\n",
        F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title"),
        F.concat(F.lit("Authors: "), "authors"),
        F.concat(F.lit("Published: "), "published"),
        F.concat(F.lit("Updated: "), "updated"),
        F.concat(F.lit("Abstract URL: "), "abs_url"),
        F.concat(F.lit("PDF URL: "), "pdf_url"),
        F.concat(F.lit("Abstract: "), F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.lit(NO_ABSTRACT))),
    )
    grouped = papers.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("t")))).alias("_e"))
    j = queries.join(grouped, "query", "left")
    n = F.coalesce(F.size("_e"), F.lit(0))
    head = F.concat_ws(
        "\n", F.concat(F.lit("arXiv query: "), "query"), F.lit(f"Recent window (days): {days}"), F.concat(F.lit("Candidate paper count: "), n.cast("string"))
    )
    body = F.array_join(F.transform("_e", lambda e: e["t"]), "\n\n")
    report = F.when(n > 0, F.concat(head, F.lit("\n\n"), body)).otherwise(F.concat(head, F.lit("\nNo recent papers found.")))
    return j.select("query", report.alias("report"))
