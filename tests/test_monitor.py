import re

import pytest
from pyspark.sql import functions as F

from rolloom.functions.text import count_matches
from rolloom.operators import feeds, monitor
from tests.conftest import by


def _lines(spark, logs):
    rows = [(run, src, i + 1, line) for (run, src), text in logs.items() for i, line in enumerate(text.split("\n")[:-1])]
    return spark.createDataFrame(rows, "run_id string, source string, pos bigint, line string")


def test_status_and_step_rules(spark):
    cases = [(["run.log"], "", "queued"), (["run.log"], "Beginning environment startup...", "running"), (["run.log"], "2026-01-01 | reward_spec | INFO | Eval report: {}", "verify"), (["run.log", "interaction_result.json"], "anything", "completed"), ([], "STEP 1", "queued")]
    df = spark.createDataFrame([(i, f, t) for i, (f, t, _) in enumerate(cases)], "i int, f array<string>, t string")
    got = by(df.select("i", monitor.text_status(F.col("f"), F.col("t")).alias("s")), "i")
    assert [got[i]["s"] for i in range(5)] == [c[2] for c in cases]
    log = "| ===== STEP 1 =====\n| ===== STEP 7 ====="
    r = spark.createDataFrame([(log,), ("none",)], "t string").select(monitor.current_step(F.col("t")).alias("s")).collect()
    assert [x.s for x in r] == [7, None]


def test_run_status_from_lines(spark):
    lines = _lines(spark, {("a", "run.log"): "Beginning environment startup...\nSTEP 3\n", ("b", "verify.log"): "verify output\n", ("c", "run.log"): "STEP 1\n", ("d", "run.log"): "hello\n"})
    files = spark.createDataFrame([("a", "run.log", 40, 2.0), ("b", "verify.log", 14, 3.0), ("c", "run.log", 7, 9.0), ("c", "interaction_result.json", 2, 5.0), ("d", "run.log", 6, 1.0)], "run_id string, path string, size bigint, mtime double")
    runs = spark.createDataFrame([(r, 4.0) for r in "abcde"], "run_id string, created_at double")
    got = by(monitor.run_status(runs, files, monitor.tail_lines(lines)), "run_id")
    assert {k: v["status"] for k, v in got.items()} == {"a": "running", "b": "queued", "c": "completed", "d": "queued", "e": "queued"}
    assert got["a"]["current_step"] == 3 and got["c"]["last_update"] == 9.0 and got["a"]["last_update"] == 4.0 and got["e"]["file_count"] == 0
    status = monitor.run_status(runs, files, monitor.tail_lines(lines))
    stats = monitor.run_stats(status).first().asDict()
    assert stats == {"total": 5, "queued": 3, "running": 1, "verify": 0, "completed": 1, "active": 1, "most_recent_update": 9.0}
    assert monitor.run_stats(status.limit(0)).first()["most_recent_update"] == 0.0
    assert [r.run_id for r in monitor.order_for_display(status).collect()] == ["a", "b", "d", "e", "c"]
    assert [r.run_id for r in monitor.order_runs(status).collect()] == list("abcde")
    tail = monitor.tail_lines(lines)
    find = lambda q, m, s="all": sorted(r.run_id for r in monitor.search_runs(status, files, tail, q, m, s).collect())
    assert find("STEP", "logs") == ["a", "c"] and find("verify.LOG", "files") == ["b"] and find("Running", "status") == ["a"]
    assert find("step run.log", "all") == ["a", "c"] and find("step", "all", "completed") == ["c"] and find(" ", "all") == list("abcde") and find("b", "run_id") == ["b"]


def test_tail_is_the_last_characters(spark):
    text = "".join(f"line {i} é\n" for i in range(50))
    lines = _lines(spark, {("a", "run.log"): text, ("b", "run.log"): "x\n"})
    got = by(monitor.tail_text(monitor.tail_lines(lines, 83)), "run_id")
    assert got["a"]["tail"] == text[-83:] and got["b"]["tail"] == "x\n"


def test_file_events_and_merge(spark):
    schema = "run_id string, path string, size bigint, mtime double"
    prev = spark.createDataFrame([("a", "x.json", 1, 1.0), ("a", "same.json", 1, 1.0), ("a", "run.log", 5, 1.0), ("a", "gone.log", 5, 1.0), ("z", "f", 1, 1.0)], schema)
    cur = spark.createDataFrame([("a", "x.json", 1, 2.0), ("a", "same.json", 1, 1.0), ("a", "run.log", 9, 2.0), ("a", "new.txt", 3, 2.0), ("a", "eval.txt", 3, 2.0)], schema)
    ev = {(r.run_id, r.path): (r.action, r.size) for r in monitor.file_events(prev, cur, F.lit(7.0)).collect()}
    assert ev == {("a", "x.json"): ("modified", 1), ("a", "new.txt"): ("created", 3), ("a", "gone.log"): ("deleted", 0), ("z", "f"): ("deleted", 0)}
    assert [r.run_id for r in monitor.removed_runs(prev, cur).collect()] == ["z"]
    m = monitor.merge_runs(spark.createDataFrame([("a", "queued", 1), ("b", "queued", 1)], "run_id string, status string, seq int"), spark.createDataFrame([("a", "running", 2)], "run_id string, status string, seq int"))
    assert {r.run_id: r.status for r in m.collect()} == {"a": "running", "b": "queued"}


@pytest.mark.parametrize("size", [7, 80, 10_000])
def test_pages_rebuild_the_log(spark, size):
    text = "".join(f"line-{i:03d} é\n" for i in range(25))
    raw = text.encode()
    lines = _lines(spark, {("a", "run.log"): text})
    before, pages = None, []
    for _ in range(60):
        p = monitor.log_pages(lines, size, before).first()
        end = p.end_offset
        start = max(0, end - size)
        if start > 0 and b"\n" in raw[start:end]:
            start += raw[start:end].index(b"\n") + 1
        assert (p.start_offset, p.has_more, p.label, p.file_size) == (start, start > 0, "Run log", len(raw))
        assert p.text == raw[start:end].decode("utf-8", errors="replace")
        if size == 7:
            return  # a window inside one line: only the partial-line rule is of interest
        pages.insert(0, p.text)
        if not p.has_more:
            break
        before = spark.createDataFrame([("a", "run.log", p.start_offset)], "run_id string, source string, before bigint")
    assert "".join(pages) == text


def test_a_page_end_inside_a_character(spark):
    lines = _lines(spark, {("a", "run.log"): "日本語\n"})
    before = spark.createDataFrame([("a", "run.log", 4)], "run_id string, source string, before bigint")
    page = monitor.log_pages(lines, 100, before).first()
    assert page.text == "日\ufffd" and page.end_offset == 4


def test_a_record_of_many_lines_stays_whole(spark):
    head = spark.createDataFrame([("a", "run.log", 1, "2026-01-01 00:00:00 | runtime      | INFO     | first")], "run_id string, source string, pos bigint, line string")
    body = spark.range(2, 12_003).selectExpr("'a' AS run_id", "'run.log' AS source", "id AS pos", "concat('line ', id) AS line")
    lines = head.union(body)
    assert monitor.parse_run_log(lines).first().n_lines == 12_002
    got = monitor.record_lines(lines).selectExpr("count(*) AS n", "count(DISTINCT line_no) AS d", "max(line_no) AS m").first()
    assert (got.n, got.d, got.m) == (12_002, 12_002, 12_002)


def test_blocks_records_and_matches(spark):
    log = "orphan\n2026-01-01 00:00:00 | interaction  | INFO     | 🤖 MODEL INPUT\nbody\nTHOUGHT: x\nmore\n2026-01-01 00:00:01 | runtime      | ERROR    | bad\ntrace\n"
    lines = _lines(spark, {("a", "run.log"): log})
    c = by(monitor.classify_lines(lines), "pos")
    assert [c[i]["kind"] for i in range(1, 8)] == ["", "input", "", "thought", "", "", ""]
    assert [c[i]["block"] for i in range(1, 8)] == ["", "", "input", "", "thought", "", ""]
    assert c[6]["classes"] == "log-line level-error name-environment kind-system" and c[7]["classes"] == "log-line" and c[5]["classes"] == "log-line kind-thought kind-body"
    rec = by(monitor.parse_run_log(lines), "record_id")
    assert (rec[1]["name"], rec[1]["level"], rec[1]["n_lines"]) == ("interaction", "INFO", 4)
    assert [r.record_id for r in monitor.parse_run_log(lines, "ERROR").collect()] == [2]
    assert [r.line for r in monitor.record_lines(lines).where("record_id = 2").orderBy("line_no").collect()] == ["bad", "trace"]
    n = spark.createDataFrame([("AaAa",), ("",)], "t string").select(count_matches(F.col("t"), "aa").alias("n")).collect()
    assert [r.n for r in n] == [2, 0]


def test_feed_rules(spark):
    schema = "title string, summary string, published string, updated string, id string, author array<struct<name:string>>, link array<struct<_title:string,_href:string>>"
    rows = [(" A \n b ", "s" * 4000, None, "2026-01-05T00:00:00Z", "id1", [("x  y",), (" ",)], [("doi", "d"), ("pdf", "p"), ("pdf", "q")]), ("", "s", "", "", "id2", None, None), ("t", None, "", None, "id3", [], [])]
    p = by(feeds.atom_papers(spark.createDataFrame(rows, schema)), "abs_url")
    assert set(p) == {"id1", "id3"} and p["id1"]["title"] == "A b" and len(p["id1"]["summary"]) == 3000 and p["id1"]["authors"] == "x y" and p["id1"]["pdf_url"] == "p"
    assert p["id3"]["authors"] == feeds.NO_AUTHORS and p["id3"]["pdf_url"] == feeds.NO_PDF
    df = feeds.atom_papers(spark.createDataFrame(rows, schema)).withColumn("query", F.lit("q"))
    now = F.lit("2026-01-06 00:00:00")
    assert {r.abs_url for r in feeds.recent(df, now, 0).collect()} == {"id1", "id3"}
    assert {r.abs_url for r in feeds.recent(df, F.lit("2026-01-07 00:00:01"), 1).collect()} == {"id3"}
    with pytest.raises(Exception, match="(?i)parse"):
        feeds.recent(df.withColumn("updated", F.lit("yesterday")), now, 3).collect()
    assert feeds.top_papers(df, 0, now, 5).count() == 1
    text = feeds.format_papers(spark.createDataFrame([("q",), ("r",)], "query string"), feeds.top_papers(df, 5, now, 5), 5)
    t = by(text, "query")
    assert t["r"]["report"] == "arXiv query: r\nRecent window (days): 5\nCandidate paper count: 0\nNo recent papers found."
    assert re.search(r"paper count: 2\n\n\[1\] A b\nAuthors: x y\n", t["q"]["report"]) and t["q"]["report"].endswith("Abstract: (no abstract)")
