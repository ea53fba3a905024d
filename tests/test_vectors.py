import numpy as np
import pytest
from pyspark.sql import functions as F

from rolloom.operators import retrieval, vectors
from rolloom.sources import sinks
from tests.conftest import by


def _data(spark, n=400, dim=8, seed=0):
    rnd = np.random.default_rng(seed)
    v = rnd.normal(size=(n, dim))
    v[: n // 3] = v[0] + rnd.normal(scale=1e-3, size=(n // 3, dim))  # a third of all vectors in one spot
    v[5] = v[6]  # an exact tie
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id bigint, vec array<double>").repartition(7)
    return v, df


def _brute(v, k):
    s = np.round(v @ v.T, 6)
    return {i: [int(j) for j in np.lexsort((np.arange(len(v)), -s[i]))[:k]] for i in range(len(v))}


def _lists(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append(r.id)
    return out


def test_blocks_and_tiles_equal_brute_force(spark, monkeypatch):
    v, df = _data(spark)
    q = df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    want = _brute(v, 5)
    assert _lists(vectors.topk_exact(q, df, 5)) == want
    assert _lists(vectors.topk_exact(q, df, 5, block_rows=60)) == want
    ids = np.arange(len(v))
    monkeypatch.setattr(vectors, "TILE_QUERIES", 37)
    monkeypatch.setattr(vectors, "TILE_VECTORS", 53)
    rows, _, best = vectors._candidates(v, v, ids, 5, 6)
    assert {i: best[rows == i].tolist() for i in range(len(v))} == want


def test_search_plans_have_no_nested_loop(spark):
    _, df = _data(spark, 30)
    q = df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    plan = vectors.topk_exact(q, df, 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_text_ids(spark):
    v, df = _data(spark, 40)
    s = df.withColumn("id", F.format_string("p%03d", "id"))
    q = s.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    want = {f"p{i:03d}": [f"p{j:03d}" for j in js] for i, js in _brute(v, 3).items()}
    assert _lists(vectors.topk_exact(q, s, 3)) == want
    assert _lists(vectors.topk_exact(q, s, 3, block_rows=9)) == want


def test_ivf_over_all_cells_equals_exact_and_prunes_folders(spark, tmp_path):
    v, df = _data(spark)
    q = df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    cents = vectors.train_cells(vectors.training_sample(df).withColumnRenamed("vec", "embedding"), 8)
    assigned = vectors.assign_cells(df, cents, "vec")
    assert assigned.count() == len(v)
    assert sinks.write_index(cents, assigned, str(tmp_path / "ix"))
    stored = spark.read.parquet(str(tmp_path / "ix" / "passages"))
    assert _lists(vectors.topk_ivf(q, stored, cents, 4, nprobe=8)) == _brute(v, 4)
    assert _lists(vectors.topk_ivf(q, stored, cents, 4, nprobe=8, block_rows=50)) == _brute(v, 4)
    one = vectors.topk_ivf(q.where("qid = 0"), stored, cents, 4, nprobe=1)
    assert "PartitionFilters: [isnotnull" in one._jdf.queryExecution().toString() or "PartitionFilters: [cell" in one._jdf.queryExecution().toString()
    rep = vectors.check_index(df, df, stored, cents, nprobe=8, k=4).first()
    assert rep.n_checked == len(v) and rep.self_hits > len(v) * 2 / 3 and rep.normalized and rep.recall == 1.0 and rep.good  # near copies tie with themselves


def _recall(found, want, k):
    return np.mean([len(set(found[i]) & set(want[i])) / k for i in want])


def test_copies_at_borders_raise_recall_and_count_once(spark, tmp_path):
    v, df = _data(spark, 600, 24, seed=3)
    q = df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    start = df.where("id >= 200 and id < 230").select((F.col("id") - 200).cast("int").alias("cell"), F.col("vec").alias("centroid"))
    cents = vectors.refine_cells(df, start, 2, "vec")
    want, recalls = _brute(v, 5), []
    for copies, factor in ((1, 1.0), (3, 1.4)):
        assigned = vectors.assign_cells(df, cents, "vec", copies=copies, factor=factor).cache()
        per = assigned.groupBy("id").count().agg(F.min("count"), F.max("count")).first()
        assert per[0] == 1 and per[1] <= copies and assigned.count() >= len(v)
        found = _lists(vectors.topk_ivf(q, assigned, cents, 5, nprobe=4))
        assert all(len(set(f)) == len(f) == 5 for f in found.values())
        recalls.append(_recall(found, want, 5))
        assert vectors.check_index(df, df, assigned, cents, nprobe=4).first().recall == pytest.approx(recalls[-1], abs=1e-4)
    assert recalls[1] > recalls[0] + 0.02
    every = vectors.assign_cells(df, cents, "vec", copies=3, factor=1.4)
    assert _lists(vectors.topk_ivf(q, every, cents, 5, nprobe=30)) == want
    assert _lists(vectors.topk_ivf(q, every, cents, 5, nprobe=30, block_rows=40)) == want


def test_the_index_check_can_fail(spark):
    _, df = _data(spark, 300, 24, seed=4)
    cents = df.where("id >= 150 and id < 190").select((F.col("id") - 150).cast("int").alias("cell"), F.col("vec").alias("centroid"))
    rep = vectors.check_index(df, df, vectors.assign_cells(df, cents, "vec"), cents, nprobe=1).first()
    assert rep.self_hits >= 200 and rep.normalized and not rep.good


def test_cells_move_to_means_and_empty_ones_stay(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    cents = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "cell int, centroid array<double>")
    got = {r.cell: r.centroid for r in vectors.refine_cells(df, cents, 1, "vec").collect()}
    size = np.hypot(0.3, 0.9)
    assert got[2] == [-1.0, 0.0] and got[0] == [1.0, 0.0] and got[1] == pytest.approx([0.3 / size, 0.9 / size], abs=1e-9)
    costs = by(vectors.cell_costs(df, cents, "vec"), "cell")
    assert [(costs[i]["n"], costs[i]["cost"]) for i in range(3)] == [(1, 0.0), (2, 0.2), (0, 0.0)]


def test_files_follow_the_size_of_cells(spark, tmp_path):
    rows = [(i, [1.0, 0.0], 0 if i < 1000 else i % 40 + 1) for i in range(1400)]
    assigned = spark.createDataFrame(rows, "id bigint, vec array<double>, cell int").repartition(9)
    cents = spark.createDataFrame([(0, [1.0, 0.0])], "cell int, centroid array<double>")
    assert sinks.write_index(cents, assigned, str(tmp_path / "ix"), file_rows=100)
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "ix" / "passages").glob("cell=*")}
    assert 10 <= files["cell=0"] <= 20 and all(n == 1 for c, n in files.items() if c != "cell=0") and len(files) == 41
    assert spark.read.parquet(str(tmp_path / "ix" / "passages")).count() == 1400
    assert not sinks.write_index(cents, assigned.where("id < 0"), str(tmp_path / "none")) and not (tmp_path / "none").exists()


def test_training_sample_is_exact_and_seeded(spark):
    _, df = _data(spark)
    order = lambda seed: [r.id for r in df.orderBy(vectors.sample_hash(F.col("id"), seed), "id").select("id").collect()]
    for n, seed, bin_ in ((50, 1, 10_000), (50, 1, 1), (1, 2, 1), (399, 2, 1), (0, 1, 1)):
        assert {r.id for r in vectors.training_sample(df, n, seed, largest_bin=bin_).collect()} == set(order(seed)[:n])
    assert order(1)[:50] != order(2)[:50]
    assert vectors.training_sample(df, 10_000).count() == vectors.training_sample(df).count() == vectors.training_sample(df, 400).count() == 400
    twice = df.union(df)
    assert vectors.training_sample(twice, 101, largest_bin=1).count() == 101
    assert vectors.training_sample(df.where("id < 0"), 5).count() == 0


def test_normalise_pool_and_prefix(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0], [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), (1, [0.0, 0.0], [[1.0, 1.0]], [1])], "i int, v array<float>, t array<array<float>>, m array<int>")
    r = by(df.select("i", vectors.l2_normalize(F.col("v")).alias("n"), vectors.pool("mean", F.col("t"), F.col("m")).alias("p"), vectors.pool("cls", F.col("t"), F.col("m")).alias("c")), "i")
    assert r[0]["n"] == pytest.approx([0.6, 0.8]) and r[1]["n"] == [0.0, 0.0] and r[0]["p"] == [2.0, 3.0] and r[0]["c"] == [1.0, 2.0]
    with pytest.raises(NotImplementedError):
        vectors.pool("max", F.col("t"), F.col("m"))
    t = df.select(vectors.encoder_text(F.lit("x"), "E5-b", True).alias("a"), vectors.encoder_text(F.lit("x"), "bge-m3", True).alias("b"), vectors.encoder_text(F.lit("x"), "bge-l", False).alias("c")).first()
    assert (t.a, t.b, t.c) == ("query: x", "x", "x")


def test_retrieve_never_repeats_a_url_and_uses_own_k(spark):
    v, df = _data(spark, 60)
    corpus = df.select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("u"), (F.col("id") % 9).cast("string"))).alias("url"), F.lit("t").alias("title"), F.lit("body").alias("text"))
    req = df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), F.when(F.col("id") % 2 == 0, 5).alias("topk"), (F.col("id") % 3 == 0).alias("return_scores"))
    got = {}
    for r in retrieval.retrieve(req, df, corpus).collect():
        got.setdefault(r.qid, []).append(r)
    want = _brute(v, 60)
    for qid, rows in got.items():
        k = 5 if qid % 2 == 0 else 3
        seen, expect = set(), []
        for j in want[qid][: max(2 * k, 6)]:
            u = None if j % 7 == 0 else j % 9
            if u is not None and u not in seen and len(expect) < k:
                seen.add(u)
                expect.append(j)
        rows.sort(key=lambda r: r["rank"])
        assert [r.id for r in rows] == expect
        assert all((r.score is not None) == (qid % 3 == 0) for r in rows)


def test_crawl_lines_and_missing_text(spark):
    corpus = spark.createDataFrame([(i, "hot" if i % 3 else "u", None if i == 4 else f" text{i} ") for i in range(30)] + [(99, None, "x"), (98, "", "y")], "pos bigint, url string, text string")
    req = spark.createDataFrame([(0, "u"), (1, "hot"), (2, "none"), (3, "hot")], "request_no bigint, url string")
    rows = retrieval.crawl(req, corpus)
    hot = [r.text for r in sorted(rows.where("request_no = 3").collect(), key=lambda r: r.passage_no)]
    assert hot == [retrieval.MISSING_TEXT if i == 4 else f" text{i} " for i in range(30) if i % 3]
    lines = {}
    for r in sorted(retrieval.format_crawl(rows).collect(), key=lambda r: (r.request_no, r.line_no)):
        lines.setdefault(r.request_no, []).append(r.line)
    assert lines[2] == ["url: none", "Result: No passages found for URL: none"]
    assert lines[0][:4] == ["url: u", "Result: Found 10 passages for URL: u", "Passages: 10", "Passage 1:  text0 "] and lines[0][-1] == "Passage 10:  text27"
    assert len(lines[1]) == 23 and lines[1] == lines[3]
    assert retrieval.corpus_stats(corpus).first().asDict() == {"n_docs": 32, "n_urls": 2}
    assert retrieval.url_index(corpus).where("url = 'u'").count() == 10


def test_hits_text(spark):
    hits = spark.createDataFrame([(1, 1, "u", "T", "body", 0.5), (1, 2, "w", None, "", None)], "qid int, rank int, url string, title string, text string, score double")
    got = by(retrieval.format_hits(spark.createDataFrame([(1,), (2,)], "qid int"), hits), "qid")
    assert got[1]["result"] == "Found 2 results:\n1. url: u\nTitle: T\nScore: 0.5\nSnippet: body\n\n2. url: w\nTitle: No title provided\nSnippet: No snippet provided"
    assert got[2]["result"] == retrieval.NO_RESULTS
    numbered = spark.createDataFrame([(7, 1, "a"), (7, 2, "b")], "request int, pos int, result string")
    assert [r.line for r in retrieval.join_queries(numbered, "request", "pos").orderBy("line_no").collect()] == ["a", "---", "b"]
    bodies = spark.createDataFrame([(3, 1, "u", "T", "", "short", None, "long")], "qid int, rank int, url string, title string, text string, snippet string, score double, content string")
    asked = spark.createDataFrame([(3,)], "qid int")
    assert retrieval.format_hits(asked, bodies).first()["result"].endswith("Snippet: long")
    assert retrieval.format_hits(asked, bodies.drop("content")).first()["result"].endswith("Snippet: short")


def test_sketches_of_arrivals_merge(spark, tmp_path):
    path, shape = str(tmp_path / "sk"), "url string"
    urls = spark.range(60_000).select(F.concat(F.lit("u"), F.col("id") % 20_000).alias("url"))
    none = spark.createDataFrame([(None,), ("",), (None,)], shape)
    retrieval.add_sketches(urls.where("url < 'u5'").union(none), path)
    retrieval.add_sketches(urls.where("url > 'u4'"), path)  # partly the same urls
    n_rows = urls.where("url < 'u5'").count() + urls.where("url > 'u4'").count() + 3
    got = retrieval.sketched_stats(spark.read.parquet(path)).first()
    assert got.n_docs == n_rows and abs(got.n_urls - 20_000) <= retrieval.sketch_error() * 20_000
    retrieval.add_sketches(none, str(tmp_path / "none"))
    assert tuple(retrieval.sketched_stats(spark.read.parquet(str(tmp_path / "none"))).first()) == (3, 0)
    few = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], shape)
    assert tuple(retrieval.sketched_stats(retrieval.url_sketches(few)).first()) == (4, 2)
    assert tuple(retrieval.sketched_stats(retrieval.url_sketches(few.limit(0))).first()) == (0, 0)


def test_an_encoder_gets_bounded_texts_and_other_columns_pass(spark):
    import numpy as np

    texts = ["x" * (vectors.ENCODE_BYTES // 2)] * 5 + ["y" * (vectors.ENCODE_BYTES + 1)] + ["ab"] * 50
    df = spark.createDataFrame([(i, t, [i]) for i, t in enumerate(texts)], "id bigint, text string, other array<bigint>").coalesce(1)

    def told():
        return lambda ts: np.array([[len(t), len(ts), sum(len(x) for x in ts)] for t in ts], float)

    got = vectors.embed(df, told, "text", batch=20).select("id", F.length("text").alias("n"), "other", "embedding").orderBy("id").collect()
    assert [(r.id, r.n, r.other, r.embedding[0]) for r in got] == [(i, len(t), [i], len(t)) for i, t in enumerate(texts)]
    assert all(r.embedding[1] <= 20 and (r.embedding[2] <= vectors.ENCODE_BYTES or r.embedding[1] == 1) for r in got)


def test_a_tile_of_scores_is_not_copied_whole():
    import tracemalloc

    rnd = np.random.default_rng(3)
    q, v = rnd.normal(size=(3_000, 16)), rnd.normal(size=(9_000, 16))
    v[100:140] = v[7]  # equal scores go to the lowest ids
    tile = 8 * vectors.TILE_QUERIES * vectors.TILE_VECTORS
    tracemalloc.start()
    rows, scores, ids = vectors._candidates(q, v, np.arange(9_000), 5, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    s = np.round(q @ v.T, 6)
    want = np.argsort(-s, axis=1, kind="stable")[:, :5]
    assert (ids.reshape(-1, 5) == want).all() and (rows == np.repeat(np.arange(3_000), 5)).all()
    assert np.allclose(scores.reshape(-1, 5), np.take_along_axis(s, want, 1), atol=2e-6)
    assert peak < 2.5 * tile
