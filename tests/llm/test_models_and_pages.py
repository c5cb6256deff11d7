"""Classifiers by held-out accuracy, page extraction by cases, registered queries against SQL, the pipeline by stages."""

import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from promptmill.llm import decontaminate, exact_dedup, html_extract, near_dedup, quality, toxicity
from promptmill.llm.oracles import ORACLES
from promptmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
TABLES = ["documents", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    want = relation.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(want)


def _accuracy(spark, scored, label, modulus, rest):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = scored.collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    unseen = [r for r in rows if r.held_out and r.doc_id in labels]
    good = sorted((r.score for r in unseen if labels[r.doc_id] == 1), reverse=True)
    bad = [r.score for r in unseen if labels[r.doc_id] == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    return wins, sum(r.predicted == labels[r.doc_id] for r in unseen) / len(unseen)


def test_quality_of_unseen_texts(spark):
    ranked, right = _accuracy(spark, QUERIES["op9_quality"](spark, LARGER), "quality", 5, 0)
    assert ranked > 0.97 and right > 0.95


def test_toxicity_of_unseen_texts(spark):
    ranked, right = _accuracy(spark, QUERIES["op8_toxicity"](spark, LARGER), "toxic", 4, 2)
    assert ranked > 0.75 and right > 0.88


@pytest.mark.parametrize("score, label", [(toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")])
def test_scores_of_dirty_rows(spark, score, label):
    schema = "doc_id long, text string, label int, features string, held_out string, score string, language string"
    rows = [(i, t, 1, "f", "h", "s", "l") for i, t in [(1, None), (2, ""), (None, "a b"), (3, "x " * 50000), (3, "x"), (4, "bad word"), (5, "...")]]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, None), (None, 1), (4, 1), (4, 0), (3, 7), (5, 1)], f"doc_id long, {label} int")
    for known in (labels, labels.limit(0)):
        scored = score(docs, known).collect()
        assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert score(docs.limit(0), labels).count() == 0
    kept = toxicity.remove_toxic(docs, labels.limit(0).withColumnRenamed(label, "toxic"))
    assert kept.columns == docs.columns and kept.count() == len(rows)


PAGES = [
    ("<nav><a>menu</a></nav><article><h1>T &amp; x</h1><p>a\n b<br>c<p class='ad'>buy<p>d</article><div class=comments>hi</div>", "T & x a b c d"),
    ("<div class='cookie-notice'><div>acc</div>ept</div><p>main <b>bo</b>ld &lt;tag&gt; 1 < 2</p><!-- c --><script>var t='</p>';</script><footer>f</footer>", "main bold <tag> 1 < 2"),
    ("<div class='ad'>left open <article>body&nbsp;text</article>", "body text"),
    ("<main><header><h1>H</h1></header><aside>s</aside><p>x</p><form><input name=a>go</form></main>tail", "H x"),
    ("<p title='a > b'>one</p><p hidden>two</p><style>p{}</style><ul><li>three<li>four</ul>", "one three four"),
    ("", ""), (None, ""), ("plain  text", "plain text"), ("<article></article><p>outside", "outside"),
    ("<article><p>x &eacute; &#233;</p><div class='share'>s<div>t</div></div><p>y</article>", "x é é y"),
]


def test_pages_by_structure(spark):
    rows = [(i, f"http://h{i}.org/", page, 1, "s") for i, (page, _) in enumerate(PAGES)]
    pages = spark.createDataFrame(rows + rows[:1] + [(None, None, "<p>z", 1, "s")], "page_id long, url string, html string, page int, stream string")
    got = Counter((r.page_id, r.text, r.n_chars) for r in html_extract.extract(pages).collect())
    want = Counter((i, text, len(text)) for i, (_, text) in enumerate(PAGES))
    want[(0, PAGES[0][1], len(PAGES[0][1]))] += 1
    want[(None, "z", 1)] += 1
    assert got == want
    assert html_extract.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article>Body</article><section class='comments'><article class='comment'>Reader</article></section>", "Body"),
        ("<main><p>Body</p><div id=comments><article><p>One</p></article><article><p>Two</p></article></div><p>end</p></main>", "Body end"),
        ("<article><p>Body</p><article class='comment-body'>One</article><article class='comment'>Two</article><p>end</p></article>", "Body end"),
        ("<article class='post comments-open'>Body</article><article class='related-post'>Other</article>", "Body"),
        ("<div><div class='ad'>left open <article>Body</article></div>", "Body"),
        ("<article>Body<div class='share'>left open</article><p>outside", "Body"),
    ],
)
def test_comments_as_nested_articles(page, text):
    main, _, marked = html_extract.page_blocks(page)
    assert (" ".join(main), marked) == (text, True)


def test_boilerplate_of_a_host_by_shared_runs(spark):
    top, end = "Daily Herald of the northern coast", "write to the editor at the usual address"
    rows = [(i, "http://x.org/%d" % i, f"<div>{top}</div><div>story {i} tells what {i} saw in town {i}</div><div>{end}</div>") for i in range(30)]
    rows += [(90, "http://y.org/", f"<div>{top}</div><div>alone</div>")]
    rows += [(91 + i, "http://z.org/", "<div>the very same page of a host, stored many times over</div>") for i in range(5)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"story {i} tells what {i} saw in town {i}" for i in range(30))
    assert got[90] == f"{top} alone"
    assert got[92] == "the very same page of a host, stored many times over"


def test_boilerplate_counts_distinct_pages_and_is_cut_inside_blocks(spark):
    menu, end = "home news sport weather letters contact", "write to the editor at the usual address"
    rows = [(i, "http://x.org/%d" % i, f"<div>{menu}</div><article>article number {i}</article>") for i in range(3)]
    rows += [(10, "http://x.org/p", f"<div>{menu}</div><div>a page that marks nothing</div>")]
    long = [" ".join(f"word{i}x{k}" for k in range(40)) for i in range(2)]
    rows += [(20 + i, "http://y.org/%d" % i, f"<p>{t} {end}</p><div>today</div><div>{menu}</div>") for i, t in enumerate(long)]
    rows += [(30 + i, "http://z.org/%d" % i, f"<div>{menu}</div><p>the {i} story</p><p>{menu.upper()}</p>") for i in range(2)]
    rows += [(40, "http://one.org/", f"<div>{menu}</div><nav>a</nav>"), (41, "http://one.org/", f"<div>{menu}</div><nav>b</nav>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {
        **{i: f"article number {i}" for i in range(3)}, 10: "a page that marks nothing", 20: long[0], 21: long[1],
        30: "the 0 story", 31: "the 1 story", 40: menu, 41: menu,
    }


def test_token_suffix_array():
    import numpy as np

    tokens = np.random.RandomState(2).randint(0, 4, 200).astype(np.uint64)
    order = html_extract.token_suffix_array(tokens, 200)
    assert order.tolist() == sorted(range(200), key=lambda i: tokens[i:].tolist())


def test_pipeline_by_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "exact dedup", "near dedup", "decontamination", "mixing"]
    dropped = {
        "toxicity": lambda d: toxicity.score_toxicity(d, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1"),
        "exact dedup": lambda d: exact_dedup.exact_duplicates(d).where("not kept"),
        "near dedup": lambda d: near_dedup.near_duplicates(d).where("not kept"),
        "decontamination": lambda d: decontaminate.contamination(d, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated"),
    }
    for name, out in dropped.items():
        gone = {r.doc_id for r in out(docs).select("doc_id").collect()}
        docs = steps[name](spark, docs, SF).cache()
        assert docs.columns == columns
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left == kept - gone, name
        kept = left
    mixed = steps["mixing"](spark, docs, SF)
    assert {r.doc_id for r in mixed.collect()} == kept
    whole = corpus_pipeline.run(spark, SF).select("doc_id", "taken")
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, mixed.select("doc_id", "taken").collect()))
