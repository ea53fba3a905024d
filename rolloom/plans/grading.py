"""Reward and report queries over ``lineitem``, ``orders`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.functions.text import END_MARKER, START_MARKER
from rolloom.operators import reports, rewards
from rolloom.plans.registry import query, table

def _status():
    return F.when(F.col("l_returnflag") == "A", "PASSED").when(F.col("l_returnflag") == "N", "FAILED").otherwise("SKIPPED")


def _position():
    """Order of an order's lines as one number: line, part, supplier, status."""
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return F.col("l_linenumber") * F.lit(10**18) + F.col("l_partkey") * F.lit(10**9) + F.col("l_suppkey") * 4 + code


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log per order, one row per line: markers around a status line per line item.

    Half of the orders use the newer line format; even orders never print the end marker.
    """
    li = table(spark, sf_dir, "lineitem")
    test = F.concat(F.lit("test_"), F.pmod("l_partkey", F.lit(5)).cast("string"))
    newer = F.pmod("l_orderkey", F.lit(4)) >= 2
    old = F.concat_ws(" ", _status(), test, F.when(F.col("l_returnflag") == "N", F.concat(F.lit("- "), F.col("l_returnflag"))))
    new = F.concat(test, F.lit(" "), _status(), F.lit("[0m"))
    body = li.select(F.col("l_orderkey").alias("run_id"), _position().alias("pos"), F.when(newer, new).otherwise(old).alias("line"))
    end = F.when(F.pmod("run_id", F.lit(2)) == 1, f"+ : '{END_MARKER}'").otherwise("stopped")
    rows = [(-1, F.lit("PASSED before_start")), (0, F.lit(f"+ : '{START_MARKER}'")), (9 * 10**18, end)]
    frame = F.array(*[F.struct(F.lit(p).cast("bigint").alias("pos"), line.alias("line")) for p, line in rows])
    runs = li.select(F.col("l_orderkey").alias("run_id")).distinct()
    return body.unionByName(runs.select("run_id", F.explode(frame).alias("x")).select("run_id", "x.*"))


def _parsers(lines: DataFrame) -> DataFrame:
    return rewards.parse_statuses(
        rewards.section_lines(lines),
        F.when(F.pmod("run_id", F.lit(4)) >= 2, "parse_log_pytest_v2").otherwise("parse_log_pytest"),
    )


def _required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five required tests per order; every seventh order belongs to a fail-only repository."""
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id")).distinct()
    t = runs.select("run_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    return t.select(
        "run_id",
        F.concat(F.lit("test_"), F.col("k").cast("string")).alias("test"),
        F.when(F.col("k") < 2, "FAIL_TO_PASS").otherwise("PASS_TO_PASS").alias("list_name"),
        (F.pmod("run_id", F.lit(7)) == 0).alias("fail_only"),
    )


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id")).distinct()
    return runs.withColumn("found_eval_status", F.pmod("run_id", F.lit(2)) == 1)


_STATUS_SQL = """
WITH o AS (SELECT l_orderkey AS run_id, 'test_' || (l_partkey % 5) AS test,
  CASE l_returnflag WHEN 'A' THEN 'PASSED' WHEN 'N' THEN 'FAILED' ELSE 'SKIPPED' END AS status,
  l_linenumber * 1000000000000000000 + l_partkey * 1000000000 + l_suppkey * 4 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS pos FROM lineitem),
statuses AS (SELECT run_id, test, arg_max(status, pos) AS status FROM o WHERE run_id % 2 = 1 GROUP BY ALL),
runs AS (SELECT DISTINCT run_id, run_id % 2 = 1 AS found FROM o),
req AS (SELECT run_id, found, 'test_' || k AS test, k < 2 AS f2p, run_id % 7 = 0 AS fail_only FROM runs, (SELECT unnest(range(5)) AS k)),
j AS (SELECT req.*, s.status FROM req LEFT JOIN statuses s USING (run_id, test))
"""


@query("pytest_status", _STATUS_SQL + "SELECT * FROM statuses")
def pytest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsers(log_lines(spark, sf_dir))


@query(
    "swe_resolution",
    _STATUS_SQL
    + """
SELECT run_id, found AS found_eval_status, count(*) FILTER (found AND f2p AND ok) AS f2p_success, count(*) FILTER (found AND f2p AND NOT ok) AS f2p_failure,
  count(*) FILTER (found AND NOT f2p AND ok) AS p2p_success, count(*) FILTER (found AND NOT f2p AND NOT ok) AS p2p_failure, found AND bool_and(ok) AS resolved
FROM (SELECT *, CASE WHEN fail_only THEN coalesce(status, '') <> 'FAILED' ELSE coalesce(status, '') IN ('PASSED', 'XFAIL') END AS ok FROM j) GROUP BY run_id, found""",
)
def swe_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses = _parsers(log_lines(spark, sf_dir))
    return rewards.score_swe(statuses, _required(spark, sf_dir), _found(spark, sf_dir))


@query(
    "live_resolution",
    _STATUS_SQL
    + """
SELECT *, found_eval_status AND p2p_failure = 0 AND f2p_failure = 0 AND f2p_success > 0 AS resolved FROM (
SELECT run_id, found AS found_eval_status, count(*) FILTER (f2p AND status = 'PASSED') AS f2p_success, count(*) FILTER (f2p AND status = 'FAILED') AS f2p_failure,
  count(*) FILTER (NOT f2p AND status = 'PASSED') AS p2p_success, count(*) FILTER (NOT f2p AND status = 'FAILED') AS p2p_failure FROM j GROUP BY run_id, found)""",
)
def live_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses = _parsers(log_lines(spark, sf_dir))
    return rewards.score_swe_live(statuses, _required(spark, sf_dir), _found(spark, sf_dir))


@query(
    "r2e_match",
    """
WITH o AS (SELECT l_orderkey AS run_id, 'test_' || (l_partkey % 5) || ' - case ' || (l_suppkey % 3) AS test,
  CASE l_returnflag WHEN 'A' THEN 'PASSED' WHEN 'N' THEN 'FAILED' ELSE 'SKIPPED' END AS status, l_partkey % 5 AS k FROM lineitem),
parsed AS (SELECT run_id, test, k, max(status) AS status FROM o GROUP BY ALL),
expected AS (SELECT run_id, test, CASE WHEN run_id % 3 = 2 AND status = 'FAILED' THEN 'PASSED' ELSE status END AS status FROM parsed WHERE NOT (run_id % 3 = 1 AND k = 0)),
p AS (SELECT run_id, split_part(test, ' - ', 1) AS test, arg_max(status, test) AS ps FROM parsed GROUP BY 1, 2),
e AS (SELECT run_id, split_part(test, ' - ', 1) AS test, arg_max(status, test) AS es FROM expected GROUP BY 1, 2),
b AS (SELECT coalesce(p.run_id, e.run_id) AS run_id, coalesce(p.test, e.test) AS test, ps, es FROM p FULL JOIN e ON p.run_id = e.run_id AND p.test = e.test),
c AS (SELECT run_id, count(ps) AS n_parsed, count(es) AS n_expected, count(*) FILTER (ps IS NOT NULL AND test <> '' AND ps IS DISTINCT FROM es) AS n_wrong FROM b GROUP BY run_id)
SELECT *, n_parsed > 0 AS found_eval_status, n_parsed = n_expected AND n_wrong = 0 AS resolved FROM c""",
)
def r2e_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.pmod("l_partkey", F.lit(5))
    test = F.concat(F.lit("test_"), k.cast("string"), F.lit(" - case "), F.pmod("l_suppkey", F.lit(3)).cast("string"))
    o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), test.alias("test"), k.alias("k"), _status().alias("status"))
    parsed = o.groupBy("run_id", "test", "k").agg(F.max("status").alias("status"))
    third = F.pmod("run_id", F.lit(3))
    expected = parsed.where(~((third == 1) & (F.col("k") == 0))).withColumn(
        "status", F.when((third == 2) & (F.col("status") == "FAILED"), "PASSED").otherwise(F.col("status"))
    )
    return rewards.score_r2e(parsed.drop("k"), expected.drop("k"))


@query(
    "test_sections",
    """
SELECT doc_id AS run_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars, max(CASE WHEN starts_with(line, 'PASSED ') THEN split_part(line, ' ', 2) END) AS passed
FROM (SELECT doc_id, unnest(string_split(chr(10) || replace(text, chr(13), '') || chr(10) || 'PASSED doc_' || doc_id || chr(10), chr(10))) AS line FROM documents WHERE lang <> 'de')
GROUP BY doc_id""",
)
def test_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as captured test output; German ones lack the end marker."""
    d = table(spark, sf_dir, "documents")
    end = F.when(F.col("lang") != "de", END_MARKER).otherwise("")
    out = F.concat(
        F.lit(f"FAILED early\n\x1b[32m{START_MARKER}\r\n"), F.col("text"), F.lit("\nPASSED doc_"), F.col("doc_id").cast("string"), F.lit("\n"), end, F.lit("\nlate")
    )
    lines = rewards.log_lines(d.select(F.col("doc_id").alias("run_id"), out.alias("output")))
    passed = F.when(F.col("line").startswith("PASSED "), F.split_part("line", F.lit(" "), F.lit(2)))
    return lines.groupBy("run_id").agg(
        F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.max(passed).alias("passed")
    )


# --- reports over orders ----------------------------------------------------


def order_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as one verification result of the customer's task."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        F.concat(F.lit("task__"), F.col("o_custkey").cast("string")).alias("task"),
        (F.col("o_orderstatus") == "F").alias("resolved"),
        (F.col("o_orderpriority") != "1-URGENT").alias("eval_completed"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")).alias("eval_execution_time"),
    )


_ORDERS_SQL = """
WITH r AS (SELECT o_orderkey AS run_id, 'task__' || o_custkey AS task, o_orderstatus = 'F' AS resolved, o_orderpriority <> '1-URGENT' AS eval_completed,
  CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS t FROM orders)
"""


@query(
    "verify_report",
    _ORDERS_SQL
    + """SELECT count(*) AS total, count(*) FILTER (resolved) AS success, count(*) FILTER (NOT resolved AND eval_completed) AS wrong_answer,
  count(*) FILTER (NOT resolved AND NOT eval_completed) AS timed_out, round(avg(t), 4) AS avg_execution_time, count(t) AS n_timed FROM r""",
)
def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports.verify_report(order_results(spark, sf_dir))
    return r.withColumn("avg_execution_time", F.round("avg_execution_time", 4))


@query(
    "verify_failures",
    _ORDERS_SQL
    + """SELECT CASE WHEN eval_completed THEN 'wrong_answer' ELSE 'timed_out' END AS failure_class, r.task || '#' || run_id AS instance_id, c_mktsegment
FROM r JOIN customer ON r.task = 'task__' || c_custkey WHERE NOT resolved""".replace("c_mktsegment", "CAST(c_nationkey AS BIGINT) AS nation"),
)
def verify_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("task__"), F.col("c_custkey").cast("string")).alias("task"), F.col("c_nationkey").cast("bigint").alias("nation")
    )
    paired = reports.attach_results(samples, order_results(spark, sf_dir), "task").where(F.col("run_id").isNotNull())
    named = paired.withColumn("instance_id", F.concat_ws("#", "task", "run_id"))
    return reports.verify_failures(named, keep=["nation"])


@query(
    "avg_at_n",
    _ORDERS_SQL
    + """SELECT round(avg(rate), 9) AS avg_at_n, count(*) AS n_tasks, min(n) AS min_n, max(n) AS max_n
FROM (SELECT task, avg(CASE WHEN resolved THEN 1.0 ELSE 0.0 END) AS rate, count(*) AS n FROM r GROUP BY task)""",
)
def avg_at_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports.avg_at_n(order_results(spark, sf_dir), value="resolved")
    return r.withColumn("avg_at_n", F.round("avg_at_n", 9))


@query(
    "mean_score",
    """SELECT round(avg(o_totalprice / 1000 + i - 0.5), 6) AS mean_score, count(*) AS n_rows
FROM orders, (SELECT unnest([0, 1, 2]) AS i)""",
)
def mean_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollouts = reports.repeat_rollouts(table(spark, sf_dir, "orders").select("o_totalprice"), 3)
    scores = F.array(F.col("o_totalprice") / 1000, F.col("rollout_idx").cast("double"), F.lit(-0.5))
    return reports.mean_score(rollouts.withColumn("rm_scores", scores)).withColumn("mean_score", F.round("mean_score", 6))


@query(
    "reward_routing",
    _ORDERS_SQL
    + """SELECT name, count(*) AS n, round(CAST(sum(score) AS DOUBLE), 2) AS score FROM (
  SELECT CASE run_id % 6 WHEN 0 THEN 'swe_bench' WHEN 1 THEN 'swe_rebench' WHEN 2 THEN 'r2e_gym' WHEN 3 THEN 'search' WHEN 4 THEN 'swe_bench_live' END AS name,
    CASE run_id % 6 WHEN 5 THEN -100.0 WHEN 3 THEN CASE WHEN eval_completed THEN 1.0 ELSE 0.0 END ELSE CASE WHEN resolved THEN 1.0 ELSE 0.0 END END AS score FROM r)
GROUP BY name""",
)
def reward_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.pmod("run_id", F.lit(6))
    names = ["swe_bench", "swe_rebench", "r2e_gym", "search", "swe_bench_live"]
    name = F.when(m == 0, names[0])
    for i, n in enumerate(names[1:], 1):
        name = name.when(m == i, n)
    rows = order_results(spark, sf_dir).withColumns(
        {
            "reward_name": name,
            "answer": F.when(F.col("eval_completed"), F.concat(F.lit("The "), F.upper("task"))).otherwise("none"),
            "targets": F.array(F.lit("other"), F.col("task")),
        }
    )
    return rewards.score(rows).groupBy(F.col("reward_name").alias("name")).agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("score"))


@query(
    "reward_grading",
    _STATUS_SQL
    + """, swe AS (SELECT run_id, found AND bool_and(CASE WHEN fail_only THEN coalesce(status, '') <> 'FAILED' ELSE coalesce(status, '') IN ('PASSED', 'XFAIL') END) AS ok FROM j GROUP BY run_id, found),
live AS (SELECT run_id, found AND count(*) FILTER (status = 'FAILED') = 0 AND count(*) FILTER (f2p AND status = 'PASSED') > 0 AS ok FROM j GROUP BY run_id, found)
SELECT run_id, CASE run_id % 5 WHEN 0 THEN 'swe_rebench' WHEN 1 THEN 'swe_bench_live' WHEN 2 THEN 'swe_bench' WHEN 3 THEN 'search' END AS reward_name,
  CASE WHEN run_id % 5 = 4 THEN -100.0 WHEN run_id % 5 = 3 THEN CASE WHEN run_id % 2 = 0 THEN 1.0 ELSE 0.0 END WHEN (CASE WHEN run_id % 5 = 1 THEN live.ok ELSE swe.ok END) THEN 1.0 ELSE 0.0 END AS score
FROM runs JOIN swe USING (run_id) JOIN live USING (run_id)""",
)
def reward_grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four kinds of rewards in one table, each graded from its runs' logs or answers."""
    fifth = F.pmod("run_id", F.lit(5))
    names = ["swe_rebench", "swe_bench_live", "swe_bench", "search"]
    named = F.when(fifth == 0, names[0])
    for i, n in enumerate(names[1:], 1):
        named = named.when(fifth == i, n)
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id")).distinct().withColumn("reward_name", named)

    order = F.concat(F.lit("order "), F.col("run_id").cast("string"))
    given = F.when(F.pmod("run_id", F.lit(2)) == 0, F.concat(F.lit("The "), F.upper(order))).otherwise("none")
    tables = {
        "parsed": _parsers(log_lines(spark, sf_dir)), "required": _required(spark, sf_dir), "found": _found(spark, sf_dir),
        "answers": runs.select("run_id", given.alias("answer")), "targets": runs.select("run_id", F.array(order).alias("targets")),
    }
    return rewards.grade(runs, tables)
