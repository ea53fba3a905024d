import random

from pyspark.sql import functions as F

from rolloom.operators.ordered import number_rows, number_within, ranges, running


def _rows():
    rnd = random.Random(3)
    rows = [("hot", i, rnd.choice([None, i % 7])) for i in range(300)]
    return rows + [(f"k{j}", i, rnd.choice([None, i])) for j in range(5) for i in range(j)]


def test_running_matches_a_plain_loop_across_chunks(spark):
    df = spark.createDataFrame(_rows(), "k string, pos int, v int")
    out = running(df, ["k"], "pos", sums={"s": F.coalesce("v", F.lit(0))}, lasts={"l": F.col("v")}, chunk_rows=16)
    got = {(r.k, r.pos): (r.s, r.l) for r in out.collect()}
    plain = running(df, ["k"], "pos", sums={"s": F.coalesce("v", F.lit(0))}, lasts={"l": F.col("v")})
    assert {(r.k, r.pos): (r.s, r.l) for r in plain.collect()} == got
    want, state = {}, {}
    for k, p, v in sorted(_rows(), key=lambda r: (r[0], r[1])):
        s, last = state.get(k, (0, None))
        state[k] = (s + (v or 0), v if v is not None else last)
        want[(k, p)] = state[k]
    assert got == want


def test_running_keeps_null_keys_and_input_columns(spark):
    df = spark.createDataFrame([(None, 0, 1, "a"), (None, 1, 2, "b")], "k string, pos int, v int, t string")
    out = running(df, ["k"], "pos", sums={"s": F.col("v")}, chunk_rows=1)
    assert sorted((r.t, r.s) for r in out.collect()) == [("a", 1), ("b", 3)]
    assert out.columns == ["k", "pos", "v", "t", "s"]


def test_number_within_and_number_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 1000).alias("v"))
    n = number_within(df, ["k"], ["v"], F.floor(F.col("v") / 10)).collect()
    ranged = ranges(df, "v", "_r", 7)
    chunked = number_within(ranged, ["k"], ["v"], F.col("_r")).drop("_r").collect()
    assert sorted(map(tuple, n)) == sorted(map(tuple, chunked))
    for k in range(3):
        mine = sorted((r.v, r.rn) for r in n if r.k == k)
        assert [x[1] for x in mine] == list(range(1, len(mine) + 1))
    g = sorted((r.v, r.rn) for r in number_rows(df, "v", buckets=7).collect())
    assert [x[1] for x in g] == list(range(1, 1001))


def test_ranges_bound_a_skewed_order(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2900, F.col("id") / 1e6).otherwise(F.col("id")).alias("v"))
    sizes = [r["count"] for r in ranges(df, "v", "_r", 30).groupBy("_r").count().collect()]
    assert max(sizes) < 3000 / 10


def test_one_value_of_a_third_of_the_rows_is_cut_by_the_tie_break(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("t"), F.col("id") * 7919 % 6000)).alias("t"), (F.col("id") * 31 % 6000).alias("tie"))
    ranged = ranges(df, ["t", "tie"], "_r", 24)
    sizes = [r["count"] for r in ranged.groupBy("_r").count().collect()]
    assert len(sizes) >= 20 and max(sizes) < 600 and ranged.where("t = 'same'").select("_r").distinct().count() >= 6
    got = number_rows(df, ["t", "tie"], buckets=24).orderBy("rn").collect()
    assert [r["rn"] for r in got] == list(range(1, 6001)) and [(r["t"], r["tie"]) for r in got] == sorted((r["t"], r["tie"]) for r in got)
    keyed = ranged.withColumn("k", F.lit("hot"))
    inside = number_within(keyed, ["k"], ["t", "tie"], F.col("_r")).orderBy("rn").collect()
    assert [(r["t"], r["tie"], r["rn"]) for r in inside] == [(r["t"], r["tie"], r["rn"]) for r in got]


def test_orders_of_any_type_and_direction_nulls_and_repeats(spark):
    rows = [(None, 1), ("b", None), ("a", 2), ("a", 2), ("a", 1), (None, None)]
    df = spark.createDataFrame(rows, "s string, n int")
    got = number_rows(df, [F.desc("s"), "n"], buckets=3).orderBy("rn").collect()
    assert [(r["s"], r["n"]) for r in got] == [("b", None), ("a", 1), ("a", 2), ("a", 2), (None, None), (None, 1)]
    assert number_rows(df.limit(0), "s").collect() == [] and number_rows(df, F.col("n"), buckets=50).count() == 6
