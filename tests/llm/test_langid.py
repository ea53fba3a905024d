import random

import numpy as np
from pyspark.sql import functions as F

from rolloom.llm import langid

EN = ["the cat sat on the mat and the dog ran to the house", "this is what they said about the weather and the world", "she will have been there with all of them"]
DE = ["der hund und die katze sind nicht in dem haus", "das ist ein schönes wetter für die ganze welt", "wir haben uns gestern mit ihnen getroffen"]


def _table(spark):
    rows = [(i, t + f" {w}", lang) for lang, texts in (("en", EN), ("de", DE)) for i, t in enumerate(texts) for w in ("", "eins", "one")]
    return spark.createDataFrame([*rows, (90, None, "en"), (91, "text ohne", None), (None, EN[0], "en")], "doc_id long, text string, lang string")


def test_languages_and_edges(spark):
    model = langid.train(_table(spark))
    asked = [(1, "the dog and the house"), (2, "die katze und das haus"), (3, None), (4, ""), (5, "123 !!"), (None, "THE DOG"), (1, "the dog and the house")]
    docs = spark.createDataFrame(asked, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = sorted(((r[0] is None, r[0] or 0, r[1], r[2]) for r in langid.predict(docs, model, ["doc_id"]).collect()))
    assert [(g[1], g[2]) for g in got] == [(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (0, "en")]
    assert all(0 <= g[3] <= 1 for g in got) and got[0][3] == got[1][3] > 0.5 and got[3][3] == 0


def test_no_labels_and_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.train(empty)
    assert langid.predict(empty, model, ["doc_id"]).collect() == []
    assert [r[1] for r in langid.predict(_table(spark), model, ["doc_id"]).collect()] == ["und"] * 21


def test_no_language_is_left_out(spark):
    """Seventy languages, the rarest too: each has letters of its own."""
    import random

    rng = random.Random(2)
    alphabets = [[rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)] for _ in range(70)]
    text = lambda k: " ".join("".join(rng.choice(alphabets[k]) for _ in range(6)) for _ in range(40))
    rows = [(k, text(k), f"l{k:02d}") for k in range(70) for _ in range(4 if k % 10 else 3)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == [f"l{k:02d}" for k in range(70)]
    asked = spark.createDataFrame([(k, text(k)) for k in range(70)], "doc_id long, text string")
    got = {r[0]: r[1] for r in langid.predict(asked, model, ["doc_id"]).collect()}
    assert sum(got[k] == f"l{k:02d}" for k in range(70)) >= 68 and len(set(got.values())) > 64


def test_kernel_scores_equal_brute_force(spark):
    import math

    import numpy as np
    import pyarrow as pa

    table = langid.symbols()
    a, b = "ab cab", "cab abd"
    rows, codes, _ = langid.grams(pa.array([a, b]), table)
    mine = [set(codes[rows == i].tolist()) for i in (0, 1)]

    def brute(t):
        s = "".join(c if c.isalpha() else " " for c in t)
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)} - {" "}

    assert [len(m) for m in mine] == [len(brute(a)), len(brute(b))]
    kernel = len(mine[0] & mine[1]) / math.sqrt(len(mine[0]) * len(mine[1]))
    assert np.isclose(kernel, len(brute(a) & brute(b)) / math.sqrt(len(brute(a)) * len(brute(b))))


def test_many_languages_share_a_fixed_number_of_landmarks(spark, monkeypatch):
    """Dirty labels: the driver's share does not grow with their square."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    tongues = {f"l{i:03d}": rng.sample(letters, 6) for i in range(300)}
    rows = [(k, "".join(rng.choice(v) for _ in range(80))) for k, v in tongues.items() for _ in range(3)]
    widths = []
    solve = np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda m: widths.append(m.shape) or solve(m))
    docs = spark.createDataFrame(rows, "lang string, text string")
    model = langid.train(docs, landmarks=64)
    assert len(model.languages) == 300 and widths == [(64, 64)]
    told = langid.predict(docs, model, ["lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in told) > 60 * len(told) / 300  # chance is one in 300
