import random
import time
import tracemalloc

from rolloom.llm import html_text

PAGE = (
    '<html><head><title>T</title></head><body class="has-sidebar"><div id="topbar">Top</div><div class=wrap><p>Site motto for everyone</p>'
    "<div><p>Main <i>text</i> of page %d is here &amp; good.<br>Second&nbsp;line</p><ul><li>one %d<li>two %d</ul></div><p>Write to the editors</p>"
    '<div class="post-comments"><p>nice!</p></div><form><p>name</p></form><a href=x>more links go here</a></div><script>if(a<b){"<p>"}</script></body></html>'
)
SHAPE = "page_id long, url string, html string, text string"


def test_differencing_and_edges(spark):
    rows = [(i, f"http://a.org/x/{i}", PAGE % (i, i, i)) for i in range(6)]
    rows += [
        (50, "http://b.org/only", "<p>alone<p>page"), (51, None, None), (52, "http://b.org/2", ""),
        (53, "x", "<article class='post'><header><h1>T</h1></header><p>a<div class='ad'>buy</div><aside>q</aside><p>b <b>c</b>d</article><p>after"),
        (7, "http://c.org", '1 < 2 <b>&lt;x&gt;</b> <p title="a>b">q</p><unclosed "quote'), (5, "http://a.org/x/5", PAGE % (5, 5, 5)), (None, "http://a.org/x/9", PAGE % (9, 9, 9)),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SHAPE)
    got = html_text.main_text(docs).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {r["page_id"]: r["text"] for r in got}
    for i in range(6):
        assert text[i] == f"Main text of page {i} is here & good. Second line\n\none {i}\n\ntwo {i}"
    assert text[None].startswith("Main text of page 9") and text[50] == "alone\n\npage" and text[51] == text[52] == ""
    assert text[53] == "T\n\na\n\nb cd" and text[7] == '1 < 2 <x>\n\nq\n\n<unclosed "quote'


def _texts(spark, rows):
    return {r["page_id"]: r["text"].split("\n\n") for r in html_text.main_text(spark.createDataFrame([(*r, "x") for r in rows], SHAPE)).collect()}


def test_declared_articles_are_differenced_too(spark):
    page = "<title>T %d</title><article><p>Share this page<p>text %d<p>a quoted passage%s</article>"
    rows = [(i, f"http://d.org/{i}", page % (i, i, "" if i < 2 else f" {i}")) for i in range(5)]
    got = _texts(spark, rows)
    # the pages at the ends have one neighbour; a passage that one neighbour has stays
    assert got[0] == ["Share this page", "text 0", "a quoted passage"] and got[1] == ["text 1", "a quoted passage"] and got[3] == ["text 3", "a quoted passage 3"]
    alike = [(i, u, h.replace(f"T {i}", "T")) for i, u, h in rows]
    assert all(x[0] == "Share this page" for x in _texts(spark, alike).values())


def test_copies_are_passed_over(spark):
    frame = "".join(f"<p>template {k}" for k in range(8))
    short = [(i, f"http://e.org/{i}", f"<title>T {i}</title>{frame}<p>own {i}<p>more {i}") for i in range(5)]
    body = lambda n: "<p>top of the site" + "".join(f"<p>line {n} {k}" for k in range(9))
    copies = [(10 + i, f"http://f.org/a/{i}", body(1)) for i in range(4)]
    edited = [(20 + i, f"http://f.org/b/{i}", body(2).replace("line 2 8", f"line 2 8 edit {i}")) for i in range(3)]
    rest = [(30 + i, f"http://f.org/c/{i}", body(3 + i)) for i in range(3)]
    links = [(40 + i, f"http://g.org/{i}", f"<p>motto<p><a href=x>a linked sentence {i}</a><p>words {i}") for i in range(3)]
    got = _texts(spark, short + copies + edited + rest + links)
    assert all(got[i] == [f"own {i}", f"more {i}"] for i in range(5))
    assert all(got[10 + i] == [f"line 1 {k}" for k in range(9)] for i in range(4))
    assert all(got[20 + i] == [f"line 2 {k}" for k in range(8)] + [f"line 2 8 edit {i}"] for i in range(3))
    assert all(got[40 + i] == [f"a linked sentence {i}", f"words {i}"] for i in range(3))


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(200):
        a = [rng.randint(0, 6) for _ in range(rng.randint(0, 14))]
        b = [rng.randint(0, 6) for _ in range(rng.randint(0, 14))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = html_text.shared_lines(a, b)
        assert len(got) == table[-1][-1] and got == sorted(set(got))
        rest = iter(b)
        assert all(a[i] in rest for i in got)


def test_neighbours_cross_partitions(spark):
    pages = [(h, f"/{i:03d}", i + 1000 * n) for n, h in enumerate(["a", "b", "c"]) for i in range(40 if h == "b" else 3)]
    order = sorted(pages)
    df = spark.createDataFrame(pages, "host string, path string, row long").repartitionByRange(5, "host", "path", "row").selectExpr("*", "spark_partition_id() AS part")
    got = {r["row"]: (r["before"], r["after"]) for r in html_text.neighbours(df.cache()).collect()}
    for k, (h, _, row) in enumerate(order):
        before = order[k - 1][2] if k and order[k - 1][0] == h else None
        after = order[k + 1][2] if k + 1 < len(order) and order[k + 1][0] == h else None
        assert got[row] == (before, after)


def test_empty_table(spark):
    assert html_text.main_text(spark.createDataFrame([], SHAPE)).collect() == []


def _length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_halving_finds_a_longest_common_subsequence():
    rng = random.Random(9)
    for _ in range(150):
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        a, b = ([rng.choice(letters) for _ in range(rng.randint(0, 70))] for _ in range(2))
        for solve in (html_text._halved, html_text._paired):
            got = solve(a, b)
            assert got == sorted(set(got)) and len(got) == _length(a, b)
            picked, rest = [a[i] for i in got], iter(b)
            assert all(x in rest for x in picked)


def test_long_repetitive_pages_take_little_time_and_memory():
    rng = random.Random(2)
    a, b = ([rng.choice(["0", "0", "0", "1", f"x{rng.randint(0, 9)}"]) for _ in range(20_000)] for _ in range(2))
    tracemalloc.start()
    began = time.time()
    got = html_text.shared_lines(a, b)
    took, (_, peak) = time.time() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert took < 8 and peak < 60e6 and len(got) > 13_000  # with tracing on; about 1 s without


def test_inline_skips_unclosed_parts_and_headlines():
    for page, want in [
        ('<p>foo <span class="ad">x</span> bar</p>', ["foo bar"]),
        ('<article><p>foo <span class="ad">x<b>y</b></span> bar<div>z</div></article>', ["foo bar", "z"]),
        ('<p>foo <span class="ad">x</p><p>bar</p>', ["foo", "bar"]),
        ("<p>one<object data=x><p>two</p>", ["one", "two"]),
        ("<p>one<svg><p>two</p>", ["one", "two"]),
        ("<p>one<object data=x>in</object><p>two</p>", ["one", "two"]),
        ("<p>one<script>x<p>two</p>", ["one"]),
        ('<article><div class="entry-header"><h1>Head</h1></div><p>text</article>', ["Head", "text"]),
        ("<article><header><h1>Head</h1></header><p>text</article>", ["Head", "text"]),
        ('<div class="page-header">site</div><p>text', ["text"]),
        ('<article><div class="entry-header share">buttons</div><p>text</article>', ["text"]),
        ("<div>a <span hidden>x <div>y</div></span> b</div>", ["a b"]),
    ]:
        assert html_text.lines(page)[0] == want, page


def test_shared_line_numbers(spark):
    rows = [(i, f"http://a.org/x/{i}", PAGE % (i, i, i), "x") for i in range(4)]
    got = {r["page_id"]: r["n_shared"] for r in html_text.main_text(spark.createDataFrame(rows, SHAPE)).collect()}
    assert all(n >= 2 for n in got.values())
