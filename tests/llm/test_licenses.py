import random
import textwrap

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rolloom.llm import licenses

SHAPE = "doc_id long, text string, line string"
GPL2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"


def test_families_unknown_and_edges(spark):
    rows = [
        (1, "hello\n" + GPL2 + "\nx"), (2, "licensed under the Foo Weird License version 9"), (3, None), (4, ""), (5, "He drives with a license."),
        (6, "Licensed under CC BY-SA 4.0"), (6, "Licensed under CC BY-SA 4.0"), (None, "a\n\nReleased under the MIT License."), (7, "word " * 300 + "Licensed under the Apache License, Version 2.0. " + "other " * 300),
    ]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], SHAPE)
    got = sorted((repr(r["doc_id"]), r["line"], r["family"], r["confirmed"]) for r in licenses.scan(docs, licenses.train(docs)).collect())
    want = [("1", 1, "gpl-2.0", True), ("2", 0, "unknown", False), ("6", 0, "cc-by-sa", True), ("6", 0, "cc-by-sa", True), ("None", 2, "mit", True)]
    assert [g for g in got if g[0] != "7"] == want
    assert [g for g in got if g[0] == "7"] == [("7", 0, "apache-2.0", True)]


def test_every_template_is_found(spark):
    given = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts]
    docs = spark.createDataFrame([(i, f"line\n{t}\nline", "x") for i, (_, t) in enumerate(given)], SHAPE)
    got = {r["doc_id"]: (r["family"], r["confirmed"]) for r in licenses.scan(docs, licenses.train(docs.limit(0))).collect() if r["line"] == 1}
    right = sum(got.get(i) == (f, True) for i, (f, _) in enumerate(given))
    assert right >= 0.95 * len(given)


HEADERS = {
    "mit": licenses.TEMPLATES["mit"][2] + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "gpl-3.0": licenses.TEMPLATES["gpl-3.0"][1] + " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.",
    "bsd": licenses.TEMPLATES["bsd"][2] + " 1. Redistributions of source code must retain the above copyright notice.",
    "apache-2.0": licenses.TEMPLATES["apache-2.0"][1],
}


@pytest.mark.parametrize("columns", [50, 70, 79])
def test_wrapped_notices_with_and_without_comment_marks(spark, columns):
    frames = [("", "", ""), ("", "# ", ""), ("", "// ", ""), ("/*\n", " * ", "\n */")]
    rows, want = [], {}
    for family, text in HEADERS.items():
        for head, mark, tail in frames:
            body = "\n".join(mark + x for x in textwrap.wrap(text, columns))
            for lead, first in (("", 0), ("some words of prose here\nand more of it\n\n", 3), ("prose right above the notice\n", 1)):
                want[len(rows)] = (family, first + head.count("\n"))
                rows.append((len(rows), lead + head + body + tail + "\n\nint main() { return 0; }", "x"))
    docs = spark.createDataFrame(rows, SHAPE)
    got = {}
    for r in licenses.scan(docs, licenses.train(docs.limit(0))).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, (family, first) in want.items():
        sure = [(r["family"], r["line"]) for r in got.get(i, []) if r["confirmed"]]
        assert sure == [(family, first)], (rows[i][1], got.get(i))
        assert not [r for r in got[i] if r["family"] not in (family, "unknown")]


def test_units_and_features_equal_brute_force():
    rng = random.Random(3)
    texts = ["\n".join(" ".join(rng.choice(["software", "license", "the", "x", "#", "//", "under", "é"]) for _ in range(rng.choice([0, 1, 5, 40, 130]))) for _ in range(rng.randint(1, 6))) for _ in range(40)] + ["", "\n\n"]
    column = pa.array(texts)
    h, row, line, _ = licenses.tokens(column)
    u = licenses.units(row, line)
    words = []
    for i, t in enumerate(texts):
        for j, x in enumerate(t.split("\n")):
            words += [(i, j, w.strip("#/")) for w in x.split() if w.strip("#/")]
    assert list(zip(row.tolist(), line.tolist(), strict=True)) == [w[:2] for w in words]
    groups, lines = [], {}
    for k, (i, j, _) in enumerate(words):
        if not groups or words[k - 1][0] != i or j - words[k - 1][1] > 1:
            groups.append([])
        groups[-1].append(k)
        lines.setdefault((i, j), []).append(k)
    want = sorted((ks[0], ks[-1] + 1, True) for ks in lines.values())
    for ks in groups:
        if len({words[k][1] for k in ks}) > 1 or len(ks) > licenses.WINDOW:
            at = 0
            while True:
                want.append((ks[0] + at, min(ks[0] + at + licenses.WINDOW, ks[-1] + 1), False))
                if at + licenses.WINDOW >= len(ks):
                    break
                at += licenses.STRIDE
    assert sorted(zip(u.start.tolist(), u.end.tolist(), u.is_line.tolist(), strict=True)) == sorted(want)
    pair = lambda a, b: licenses.mix(a * licenses._PAIR + b)
    with np.errstate(over="ignore"):
        feature = np.unique(np.concatenate([h[:3], pair(h[:4], h[1:5])]))
        chosen, owner, x = licenses.features_of(u, h, feature)
        got = {int(k): set(x[owner == n].tolist()) for n, k in enumerate(chosen)}
        for k, (s, e) in enumerate(zip(u.start, u.end, strict=True)):
            here = {*h[s:e].tolist(), *pair(h[s : e - 1], h[s + 1 : e]).tolist()}
            assert got.get(k, set()) == {i for i, f in enumerate(feature.tolist()) if f in here}


def test_many_rows_in_one_slice(spark):
    n = 40_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 7, "Released under the MIT License.").otherwise("a b").alias("text")).coalesce(1)
    got = licenses.scan(docs, licenses.train(docs.limit(0))).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(7, n, 1000)) and all(r["confirmed"] for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SHAPE)
    assert licenses.scan(docs, licenses.train(docs)).collect() == []
