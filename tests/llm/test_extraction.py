from __future__ import annotations

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.llm import dom
from lumora.llm import extraction as X

DIR = "/root/testdata/sf0.001"
SCHEMA = "page_id bigint, url string, html string, _html string, _u bigint"
needs_pages = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
S1, S2, S3 = "The river rose through the night and reached the old bridge.", "Nobody in the village slept.", "At noon the water fell again."
#: (page, its main text): structures that the test tables don't have.
PAGES = [
    (f"<body><div id=masthead><a href=/>Site</a></div><div class='entry-content'><h2>Flood</h2><p>{S1}<p>{S2}</div><div class=sidebar><h3>More</h3><p>{S3}</p></div><div id='footer'>&copy; 2024</div>", f"Flood\n{S1}\n{S2}"),
    (f"<main><nav><a href=1>Up</a> <a href=2>Down</a></nav><h1>Flood</h1><p>{S1}</p><div class='advert'>Buy boats now.</div><p>{S2} &amp; &#233;&eacute;</p><section class=comments><h3>Comments</h3><p>{S3}</p><p>I agree with this.</p></section></main>", f"Flood\n{S1}\n{S2} & éé"),
    (f"<article><h1>Flood</h1><ul><li>{S1}</li><li>{S2}</li></ul><blockquote>{S3}</blockquote><form><label>Mail</label><input><button>Go</button></form><script>var x = '</p>';</script><style>p{{}}</style></article><aside>{S3}</aside>", f"Flood\n{S1}\n{S2}\n{S3}"),
    (f"<div class=cookie-notice><p>We use cookies. Read on.</p></div><div class='menu'><ul><li><a href=a>A</a><li><a href=b>B</a></ul></div><article><p>{S1}<br>\n  {S2}</p><table><tr><td>{S3}</table></article>", f"{S1} {S2}\n{S3}"),
]


def test_marginals_are_exact():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        n = int(rnd.integers(1, 9))
        parents = [-1] + [int(rnd.integers(0, i)) for i in range(1, n)]
        if n > 4:
            parents[3] = -1
        depths = []
        for p in parents:
            depths.append(0 if p < 0 else depths[p] + 1)
        levels = [np.array([i for i in range(n) if depths[i] == d]) for d in range(max(depths) + 1)]
        edges, unary, pair = rnd.integers(0, X.N_EDGES, n), rnd.normal(0, 2, n), rnd.normal(0, 2, (X.N_EDGES, 2, 2))
        got, joint, total = X.marginals(X.Forest([], np.zeros(1), np.array(parents), levels, np.zeros((n, 1), int), edges), unary, pair)
        mass, one, two = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(unary[i] * y[i] for i in range(n)) + sum(pair[edges[i], y[parents[i]], y[i]] for i in range(n) if parents[i] >= 0))
            mass += w
            one += w * np.array(y)
            for i in range(n):
                if parents[i] >= 0:
                    two[i, y[parents[i]], y[i]] += w
        assert np.allclose(got, one / mass) and np.allclose(joint, two / mass) and np.isclose(total, np.log(mass))


def test_reader():
    d = dom.read("<p>a<b>b<p>c</p><ul><li>d<li>e</ul><table><tr><td>f<td>g</table><!-- x -->h<script>i</script>&lt;j<k")
    assert dom.lines(d, np.ones(99, bool)) == "ab\nc\nd\ne\nf\ng\nh<j"
    assert d.tags == ["#page", "p", "p", "ul", "li", "li", "table", "tr", "td", "td"] and d.parents == [-1, 0, 0, 0, 3, 3, 0, 6, 7, 7]
    assert dom.lines(dom.read("<div>" * 3000 + "x" + "</div>" * 10 + "y"), np.ones(4000, bool)) == "x\ny"
    assert dom.lines(dom.read("a<script>never closed <p>b</p>"), np.ones(9, bool)) == "a"
    assert dom.lines(dom.read('a<x "' * 2000 + "<" * 300), np.ones(9, bool)).startswith("a")
    assert dom.lines(dom.read(""), np.ones(1, bool)) == "" and dom.lines(dom.read("1 < 2 &amp &am"), np.ones(1, bool)) == "1 < 2 & &am"


@pytest.fixture(scope="module")
def model(spark):
    return X.fit_pages(spark.read.parquet(f"{DIR}/pages.parquet"))


@needs_pages
def test_other_structures(model):
    for page, want in PAGES:
        d = dom.read(page, X._wanted)
        assert dom.lines(d, model.content(X.plant([d])) >= 0.5) == want, page


@needs_pages
def test_held_out_structures(spark, model):
    pages = [r["html"] for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()]
    rebuilt = [X.label_page(h, random.Random(f"{i}-{k}")) for i, h in enumerate(pages) for k in range(2)]
    forest = X.plant([dom.read(p, X._wanted) for p in rebuilt])
    assert ((model.content(forest) >= 0.5) == X.labels(forest)).mean() > 0.98


@needs_pages
def test_articles_whole(spark, model):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{DIR}/pages.parquet')")
    want = {r[0]: r[1:] for r in con.execute(X.oracle()).fetchall()}
    assert {r["page_id"]: tuple(r)[1:] for r in X.extract(spark.read.parquet(f"{DIR}/pages.parquet"), model).collect()} == want


@needs_pages
def test_odd_pages(spark, model):
    long = "<article>" + f"<p>{S1}</p>" * 30000 + "</article>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<"), (None, "u", f"<article><p>{S1}"), (5, "u", long), (6, "u", f"<article><p>{S1}</p></article>"), (6, "u", f"<article><p>{S1}</p></article>"), (7, "u", "<div>" * 5000 + "x"), (8, "u", "<nav><a href=x>x</a></nav>")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = X.extract(df, model, keep=("page_id", "url", "_html")).collect()
    by_id = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and by_id[1] == by_id[2] == by_id[8] == "" and by_id[None] == by_id[6] == S1 and by_id[5] == "\n".join([S1] * 30000)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert X.extract(df.where(F.lit(False)), model).collect() == []
    with pytest.raises(ValueError):
        X.extract(df.withColumn("text", F.lit("")), model, keep=("page_id", "text"))


def test_without_labelled_pages(spark):
    df = spark.createDataFrame([(1, "u", f"<nav>Menu</nav><div class=content><p>{S1}</p></div>", "x", 1)], SCHEMA)
    model = X.fit_pages(df)
    assert [r["text"] for r in X.extract(df, model).collect()] == [S1]
    assert X.fit_pages(df.where(F.lit(False))).pair.shape == (X.N_EDGES, 2, 2)
