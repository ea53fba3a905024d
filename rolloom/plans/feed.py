"""Paper-feed queries over ``events`` and ``documents``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.operators import feeds
from rolloom.plans.registry import as_long, query, table
from rolloom.session import work_path
from rolloom.sources import files

NOW = "2024-01-30 00:00:00"


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.col("event_id").cast("string")
    return e.select(
        F.concat_ws("-", "event_type", F.pmod("user_id", F.lit(20)).cast("string")).alias("query"), F.concat(F.lit("paper "), text).alias("title"),
        F.when(F.pmod("event_id", F.lit(3)) == 0, "").otherwise(F.col("props")).alias("summary"), F.date_format("ts", "yyyy-MM-dd").alias("published"),
        F.date_format("ts", feeds.FEED_TIME).alias("updated"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("authors"),
        F.concat(F.lit("abs/"), F.lpad(text, 12, "0")).alias("abs_url"), F.lit(feeds.NO_PDF).alias("pdf_url"),
    )


_TOP_SQL = """
WITH p AS (SELECT event_type || '-' || (user_id % 20) AS query, 'paper ' || event_id AS title, CASE WHEN event_id % 3 = 0 THEN '' ELSE props END AS summary, strftime(ts, '%Y-%m-%d') AS published,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS updated, 'user ' || user_id AS authors, 'abs/' || lpad(event_id::VARCHAR, 12, '0') AS abs_url, date_trunc('second', ts) AS tm FROM events),
c AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY updated DESC, abs_url) AS c FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c) AS rank FROM c WHERE c <= 36 AND tm >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 9 DAY),
top AS (SELECT * FROM r WHERE rank <= 12)
"""


@query("recent_top_papers", _TOP_SQL + "SELECT query, title, updated, abs_url, rank FROM top")
def recent_top_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = feeds.top_papers(papers(spark, sf_dir), 12, F.lit(NOW), 9)
    return as_long(top.select("query", "title", "updated", "abs_url", "rank"), "rank")


@query(
    "papers_text",
    _TOP_SQL
    + """,
q AS (SELECT DISTINCT query FROM p UNION ALL SELECT DISTINCT 'none-' || query FROM p),
t AS (SELECT query, count(*) AS n, string_agg('[' || rank || '] ' || title || chr(10) || 'Authors: ' || authors || chr(10) || 'Published: ' || published || chr(10) || 'Updated: ' || updated || chr(10)
  || 'Abstract URL: ' || abs_url || chr(10) || 'PDF URL: (no pdf url)' || chr(10) || 'Abstract: ' || CASE WHEN summary = '' THEN '(no abstract)' ELSE summary END, chr(10) || chr(10) ORDER BY rank) AS b FROM top GROUP BY query)
SELECT q.query, 'arXiv query: ' || q.query || chr(10) || 'Recent window (days): 9' || chr(10) || 'Candidate paper count: ' || coalesce(n, 0) || CASE WHEN n IS NULL THEN chr(10) || 'No recent papers found.' ELSE chr(10) || chr(10) || b END AS report
FROM q LEFT JOIN t USING (query)""",
)
def papers_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir)
    asked = p.select("query").distinct()
    asked = asked.unionByName(asked.select(F.concat(F.lit("none-"), "query").alias("query")))
    return feeds.format_papers(asked, feeds.top_papers(p, 12, F.lit(NOW), 9), 9)


@query(
    "atom_papers",
    """
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, lang, source FROM documents)
SELECT 'Doc ' || doc_id AS title, substr(t, 1, 3000) AS summary, '2024-01-01T00:00:00Z' AS published, '2024-01-02T00:00:00Z' AS updated,
  CASE WHEN lang = 'fr' THEN '(unknown authors)' ELSE source || ', ' || lang END AS authors, 'http://example.org/abs/' || doc_id AS abs_url,
  CASE WHEN lang = 'es' THEN '(no pdf url)' ELSE 'http://example.org/pdf/' || doc_id END AS pdf_url
FROM d WHERE lang <> 'de'""",
)
def atom_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as an Atom feed (German ones without a title) and read back."""
    d = table(spark, sf_dir, "documents")

    def esc(c):
        out = F.replace(c, F.lit("&"), F.lit("&amp;"))
        return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    key = F.col("doc_id").cast("string")
    flat = F.regexp_replace(esc(F.col("text")), "\n", "&#10;")
    authors = F.when(F.col("lang") == "fr", "<author><name> </name></author>").otherwise(
        F.concat(F.lit("<author><name>"), esc(F.col("source")), F.lit("</name></author><author><name>"), F.col("lang"), F.lit("</name></author>"))
    )
    links = F.concat(F.lit('<link title="abs" href="x"/>'), F.when(F.col("lang") == "es", "").otherwise(F.concat(F.lit('<link title="pdf" href="http://example.org/pdf/'), key, F.lit('"/>'))))
    entry = F.concat(
        F.lit("<entry><title>"), F.when(F.col("lang") == "de", " ").otherwise(F.concat(F.lit(" Doc  "), key)), F.lit("</title><summary>"), flat,
        F.lit("</summary><published>2024-01-01T00:00:00Z</published><updated>2024-01-02T00:00:00Z</updated><id>http://example.org/abs/"), key, F.lit("</id>"), authors, links, F.lit("</entry>"),
    )

    def as_feed(frames):
        """One feed document per output file."""
        yield pd.DataFrame({"value": ['<feed xmlns="http://www.w3.org/2005/Atom">']})
        yield from frames
        yield pd.DataFrame({"value": ["</feed>"]})

    path = work_path(spark, "feed")
    d.select(entry.alias("value")).mapInPandas(as_feed, "value string").write.text(path)
    return feeds.atom_papers(files.read_atom(spark, path))
