"""Hard negatives, filter interactions and main texts of pages, against brute force."""

import math
import random
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import filter_audit, html_pages, negatives
from ledgerloom.llm.catalog import ORACLE_SQL

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows, anchor, positives=5, k=10):
    """Rows of the contract, one pair at a time in Python integers; equal rows count once."""
    known = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in known:
        if not anchor(i):
            continue
        scored = [(-dot(v, w), j, other) for j, other, w in known if j != i]
        for negated, positive, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fits = sorted(x for x in scored if x[2] != label and -30 * negated <= -100 * x[0] <= -90 * negated)[:k]
            out += [(i, positive, rank, j, -negated, -s) for rank, (s, j, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, anchor, **settings):
    df = spark.createDataFrame(rows, VECTORS).withColumn("norm", F.lit("clash")).withColumn("slice", F.lit("clash"))
    return sorted(tuple(r) for r in negatives.mine_hard_negatives(df, anchor, negatives.Mining(**settings)).collect())


def test_hard_negatives_equal_brute_force(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(0, 0.02 + (i % 9) ** 2 / 20, 6)], i % 4) for i in range(600)]
    rows += [(600 + i, rows[10][1], i % 3) for i in range(60)]  # ties
    rows += [(20, rows[20][1], 0), (20, rows[20][1], 0)]  # repeats
    rows += [(700, None, 1), (None, [1.0] * 6, 1), (701, [1.0] * 6, None), (702, [1.0, None], 1), (703, [float("nan")] * 6, 1), (704, [float("inf")] * 6, 1), (705, [], 1), (706, [0.5], 2), (707, [3e3] * 6, 3), (708, [3e38] * 6, 3)]
    expected = brute_negatives([r for r in rows if r[0] != 708], lambda i: i % 20 == 0)
    assert len(expected) > 500
    assert mined(spark, rows, F.col("vec_id") % 20 == 0) == expected


def test_hard_negatives_without_rows(spark):
    assert mined(spark, [], F.lit(True)) == []
    assert mined(spark, [(0, [1.0], 0)], F.lit(True)) == []
    assert mined(spark, [(0, [1.0], 0), (1, [-1.0], 0), (2, [1.0], 1)], F.lit(True)) == []  # the window of a negative score


def test_search_prunes_short_buckets_and_stays_exact():
    draw = np.random.default_rng(5)
    lengths = np.geomspace(1, 1000, 40_000)
    vectors = draw.normal(0, 1, (40_000, 8))
    vectors = np.floor(vectors / np.linalg.norm(vectors, axis=1)[:, None] * lengths[:, None] * 16).astype(np.int64)
    anchors, ids = vectors[::4000], draw.permutation(40_000)
    scores = anchors @ vectors.T
    least, most = np.quantile(scores, [0.995, 0.9999], axis=1).astype(np.int64)
    best, scored = negatives.search(anchors, least[:, None], most[:, None], 10, vectors, ids, lambda block, inside: np.ones((len(range(*block.indices(len(anchors)))), len(inside)), bool))
    for i in range(len(anchors)):
        expected = sorted((-s, j) for s, j in zip(scores[i], ids) if least[i] <= s <= most[i])[:10]
        assert [(-s, j) for s, j in zip(best.scores[i, 0], best.ids[i, 0])] == expected
    assert scored < 0.7 * scores.size


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(i, [float(v)], i % 2) for i, v in enumerate([100_001.0, 100_003.0, 90_001.0, 50_003.0, 7_000_001.0, 0.0])]
    assert mined(spark, rows, F.lit(True)) == brute_negatives(rows, lambda i: True)


def test_slices_deal_equal_norms(spark):
    vectors = spark.createDataFrame([(i, 1.0 if i % 3 else 1.0 + i, bytes([i % 251])) for i in range(3000)], "vec_id long, norm double, packed binary")
    own, known = negatives.slices(vectors, 100, 3000)
    sizes = {r[0]: r[1] for r in vectors.groupBy(own.alias("slice")).count().collect()}
    assert set(sizes) <= {number for number, _ in known} and max(sizes.values()) < 200 and sum(sizes.values()) == 3000
    longest = {r[0]: r[1] for r in vectors.groupBy(own.alias("slice")).agg(F.max("norm")).collect()}
    assert all(longest[s] <= dict(known)[s] for s in longest)


def test_filter_audit_equals_sql(spark):
    draw = random.Random(2)
    texts = [None, "", "plain words " * 60, "SHOUT " * 3, "a#b", " ".join(f"w{i}" for i in range(150)), " ".join(f"w{i % 90}" for i in range(110)), "é" * 500, "X\x0by\tz | &"]
    rows = [(draw.choice([None, *range(40)]), draw.choice(texts), draw.choice([None, "en", "de", ""])) for _ in range(300)]
    labels = [(draw.randrange(40), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n", F.lit("clash")).withColumn("mask", F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    got = filter_audit.interaction_audit(filter_audit.mask_histograms(docs, marks))
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR); CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    connection.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    connection.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    expected = connection.execute(ORACLE_SQL["op12_filter_audit"])
    assert [c[0] for c in expected.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(expected.fetchall())
    assert got.count() == 3 * 600


def test_filter_audit_without_rows(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interaction_audit(filter_audit.mask_histograms(docs, labels)).count() == 0


def test_outcomes_of_every_mask_by_applying_the_filters():
    columns, matrices = filter_audit.outcome_matrices("ABCDE")
    assert len(columns) == 600 and sorted({c[0] for c in columns}) == ["".join(p) for p in permutations("ABCDE")]
    for column, (order, step) in enumerate(columns):
        for mask in range(32):
            fails = [bool(mask >> "ABCDE".index(f) & 1) for f in order]
            gone, now = any(fails[: step - 1]), fails[step - 1]
            expected = (not gone and not now, now and not gone, now and gone, now and sum(fails) == 1)
            assert tuple(matrices[m][mask, column] for m in ("kept", "removed", "redundant", "unique")) == expected
    # every document is removed once under each order, or kept
    assert (matrices["removed"].reshape(32, 120, 5).sum(2) == (np.arange(32) > 0)[:, None]).all()


BODY = "<p>The first paragraph of the piece, long enough.</p><p>Its second&nbsp;one &amp; the\n last &lt;one&gt;.</p>"
TEXT = "The first paragraph of the piece, long enough.\n\nIts second one & the last <one>."
REMARKS = "".join(f"<p>A remark of reader {i} that goes on and on for quite a while.</p>" for i in range(6))
PAGES = {
    "semantic": f"<html><head><title>x</title><style>p{{}}</style></head><body><nav><a href=/>home</a></nav><article><h1>Head</h1>{BODY}</article><footer>&copy; us</footer>",
    "classes": f"<body class='has-sidebar'><div id=top-nav><a href=/>home</a> text</div><div class='post-content'><h1>Head</h1>{BODY}<div class='share-buttons'>Share this</div></div><div class='sidebar'><p>{'Side text. ' * 40}</p></div></body>",
    "comments": f"<article><h1>Head</h1>{BODY}</article><section id='comments'>{REMARKS * 3}</section>",
    "wrapped in a side": f"<div class='content sidebar'><article><h1>Head</h1>{BODY}</article></div>",
    "notices": f"<div class='cookie-notice'>We use cookies.</div><main><h1>Head</h1><aside>By the way</aside>{BODY}<form><label>Mail</label><input name=x></form></main>",
    "header in article": f"<header>Site name</header><article><header><h1>Head</h1><p>By someone</p></header>{BODY}<footer>Filed under x</footer></article>",
    "upper case, bare attributes": f"<BODY><DIV CLASS=ad>Buy</DIV><ARTICLE><H1>Head</H1>{BODY}</ARTICLE><FOOTER>x</FOOTER></BODY>",
    "never closed": f"<body><nav><ul><li>a<li>b</ul></nav><article><h1>Head<p><b>{BODY[3:]}",
    "scripts and comments": f"<article><!-- <p>no</p> --><h1>Head</h1><script>var t='</p><p>no';if(a<b)x()</script>{BODY}<noscript>no</noscript><svg><text>no</text></svg></article>",
    "hidden": f"<article><h1>Head</h1><p hidden>no</p><div style='display: none'>no</div><p aria-hidden=true>no</p>{BODY}</article>",
    "link list": f"<article><h1>Head</h1>{BODY}<ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li><li><a href=/c>Three</a></li></ul></article>",
    "sections": f"<div><div><h1>Head</h1><p>The first paragraph of the piece, long enough.</p></div><div><p>Its second one &amp; the last &lt;one&gt;.</p></div></div>",
    "nested divs": "<div>" * 3000 + f"<article><h1>Head</h1>{BODY}</article>",
    "stray end tags": f"</div></p><article></b></section><h1>Head</h1>{BODY}</span></article></div>",
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    assert html_pages.main_text(PAGES[name], []) == f"Head\n\n{TEXT}"


def test_blocks_and_white_space():
    text = html_pages.main_text("<article><p>a<br>b <b>c</b>d &#101;&#x66;&ampg</p>loose <i>text</i><ul><li>one<li>two <ul><li>in</ul></ul><pre>x\n  y</pre><table><tr><td>1<td>2</table>5 < 6</article>", [])
    assert text == "a b cd ef&g\n\nloose text\n\none\n\ntwo\n\nin\n\nx y\n\n1\n\n2\n\n5 < 6"
    assert [html_pages.main_text(m, []) for m in ("", "<p", "<article></article>", "plain", "<script>x", "<!-- x")] == ["", "", "", "plain", "", ""]


def test_time_is_linear():
    import time

    unit = "<div class='a1'><p>some words here <a href='x'>and a link</a>"
    html_pages.main_text(unit * 100, [])
    took = []
    for n in (2000, 8000):
        start = time.process_time()
        html_pages.main_text(unit * n, ["div.a#>p"])
        took.append(time.process_time() - start)
    assert took[1] < 12 * took[0] + 0.2


def test_pages_follow_their_host(spark):
    page = lambda i, remarks=0: f"<body><div class='txt{i}'><h1>Head {i}</h1>{BODY}</div><div class='below'>{REMARKS * remarks}</div></body>"
    rows = [(i, f"http://a.example/{i}", page(i), "clash") for i in range(20)] + [(20, "https://A.example/20", page(20, 3), "clash"), (20, "https://A.example/20", page(20, 3), "clash")]
    rows += [(21, "http://b.example/", page(21, 3), "clash"), (22, None, page(22, 3), "clash"), (23, "no host", None, "clash"), (None, "http://a.example/x", "<p>Other template, but with text.</p>", "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {(r.page_id, r.url, r.text, r.n_chars) for r in html_pages.extract_main_text(pages).collect()}
    texts = {k[0]: k[2] for k in got}
    assert all(texts[i] == f"Head {i}\n\n{TEXT}" for i in range(21))
    assert "remark" in texts[21] and "remark" in texts[22] and texts[23] == "" and texts[None] == "Other template, but with text."
    assert all(n == len(t) for _, _, t, n in got)
    assert html_pages.extract_main_text(pages).count() == len(rows)
    # beyond the bound of a broadcast the paths are joined by host
    joined = html_pages.extract_main_text(pages, broadcast_bytes=0)
    assert {(r.page_id, r.url, r.text, r.n_chars) for r in joined.collect()} == got and joined.count() == len(rows)
    assert html_pages.extract_main_text(pages.limit(0)).count() == 0


def test_votes_add_up_by_host(spark):
    pages = spark.createDataFrame([("a", "<article><p>text of it</p></article>")] * 3 + [("a", "<div class='x 12'><p>text of it</p></div>")] + [("", "<p>x</p>")], "host string, html string")
    votes = {(r.host, r.path): r.votes for r in html_pages.path_votes(pages).collect()}
    assert votes[("a", "article")] == 3000 and votes[("a", "div.#.x")] == 1000 and all(h == "a" for h, _ in votes)
    assert {r.host: r.winners for r in html_pages.winning_paths(html_pages.path_votes(pages), pages).collect()}["a"][:2] == ["article", "div.#.x"]
