"""Pages, media, vectors, and the registered queries as a whole."""

import hashlib
import itertools
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__
from riskgraph.llm import html_extract, media, topk_search
from riskgraph.llm import queries as corpus

ARTICLE = "<p>The article begins with a paragraph that has more words than any other block of it.</p><p>A <b>bo</b>ld end &amp; so on.</p>"
MAIN = "The article begins with a paragraph that has more words than any other block of it. A bold end & so on."


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav><a href=/>Home</a></nav><article>{ARTICLE}</article><footer>&copy; us</footer></body>",
        f'<header><h1>Site</h1></header><div class="sidebar"><p>A long text beside the article, which is prose without links and goes on for long.</p></div><div>{ARTICLE}</div>',
        f'<main>{ARTICLE}</main><section id="comments"><p>A reader says something that is long enough to look like the article, or so it seems.</p></section>',
        f'<article>{ARTICLE}<aside>An aside that has quite a few words in it and no links at all.</aside><script>var a = "<p>no</p>";</script><form>Your name <input> and more words in the form</form></article>',
        f"<style>p{{}}</style><!-- <p>gone</p> --><article>{ARTICLE.replace('</p>', '')}",
        f"<div role=banner>A notice with a good number of words but no link, set by its role.</div><article>{ARTICLE}</article>",
        f'<div class="layout has-sidebar"><article>{ARTICLE}</article><div id="sidebar">A long text beside the article, which is prose without any links.</div></div>',
        f'<article>{ARTICLE}<div class="cookie-notice">We use cookies and ask that you accept them all, please.</div></article>',
    ],
)
def test_main_text(page):
    assert html_extract.main_text(page) == MAIN


def test_tree_fits_its_table():
    tree = html_extract.train_tree()
    assert all(html_extract.classify(tree, r) == r[-1] for r in html_extract.labelled_rows())


def test_page_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (2, None, ""), (None, "u", "<p"), (3, "u", "<article>" + "<p>word</p>" * 20_000), (4, "u", "<article><p>a  b<br>c &lt;i&gt;&amp;amp; &#233;</p></article>")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert [r.text for r in got][:3] == ["", "", ""] and got[5].text == "a b c <i>&amp; é" and got[5].n_chars == len(got[5].text)
    assert got[4].n_chars == 20_000 * 5 - 1


PROSE = " ".join(["Some plain words that stand in a row"] * 6)  # 48 words
LAYOUTS = [
    f"<div class=post><p>{PROSE} one.</p><p>{PROSE} two.</p></div><article class=comment><p>A reader says this.</p></article>",
    f"<div><p>{PROSE} one.</p><p>{PROSE} two.</p></div><aside><article><p>A teaser of some other page.</p></article></aside>",
    f"<div><p>{PROSE} one.</p><p>{PROSE} two.</p></div><div><a href=/more>Read more</a></div>",
    f"<body><p>{PROSE} one.</p><p>{PROSE} two.</p><ul><li><a href=/a>Another page</a></li><li><a href=/b>One more</a></li></ul></body>",
    f"<ul><li><a href=/>Home</a></li></ul><p>{PROSE} one.</p><p>{PROSE} two.</p>",
]


@pytest.mark.parametrize("page", LAYOUTS)
def test_main_text_without_an_article(page):
    assert html_extract.main_text(page) == f"{PROSE} one. {PROSE} two."


def test_paragraph_after_a_short_heading():
    assert f"{PROSE} one." in html_extract.main_text(f"<div><h2>Two words</h2><p>{PROSE} one.</p><h2>More</h2><p>{PROSE} two.</p></div>")


P40 = "w " * 39 + "w"


@pytest.mark.parametrize(
    ("page", "words"),
    [
        (f"<article><p>{P40}</p><p>{P40}</p><p><a href=x>see also this</a></p></article>", 83),
        (f"<div><p>{P40}</p><p>{P40}</p></div><article>a small teaser</article>", 80),
        (f'<div class="search-results-page"><p>{P40}</p><p>{P40}</p></div>', 80),
        (f'<div class="post-header-ad related-story"><article><p>{P40}</p><p>{P40}</p></article></div>', 80),
        (f"<a href=x><div>All of our products and many other things that we sell</div></a><div><p>{P40}</p><p>{P40}</p></div>", 80),
        (f"<main><ul><li><a href=x>One</a></li><li><a href=x>Two</a></li></ul><h1>Head line</h1><p>{P40}</p><p>{P40}</p></main>", 82),
        (f"<article><p>{P40}</p><p class=advert>buy this now or never</p><p>{P40}</p></article>", 80),
    ],
)
def test_words_of_the_main_text(page, words):
    assert len(html_extract.main_text(page).split()) == words


MENUS = [
    "",
    "<ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li><li><a href=/n>News</a></li></ul>",
    "<nav><a href=/>Home</a> <a href=/a>About</a></nav><header><h2>The site of a town</h2></header>",
    "<div><a href=/>Home</a></div><div><a href=/b>Books and papers</a></div><div><a href=/c>Contact</a></div>",
    "<a href=/all><div>All of our products and services that you can buy here today</div></a>",
]
LINES = [
    "Some plain words that stand in a row and tell of one thing after another until the line ends here at last.",
    "A second paragraph follows the first one, with a <a href=/x>linked phrase</a> within it, and goes on for a while so that nobody takes it for a title or a label of a button, which are much shorter.",
    "The last paragraph is of middle length and closes the text.",
]
BODIES = [
    "<div><p>{}</p><p>{}</p><p>{}</p></div>",
    '<div class="post"><h1>A title of five words</h1><p>{}</p><p>{}</p><p>{}</p></div>',
    '<div id="content">{}<br><br>{}<br><br>{}</div>',
    "<div><div>{}</div><div>{}</div><div>{}</div></div>",
    "<table><tr><td>{}</td></tr><tr><td>{}</td></tr><tr><td>{}</td></tr></table>",
]
ENDS = [
    "",
    '<div class="footer">Copyright of the owners, all rights reserved.</div>',
    "<ul><li><a href=/p>Another page of ours</a></li><li><a href=/q>One more page</a></li><li><a href=/r>The last page of the list</a></li></ul><div class=copyright-footer>All rights reserved</div>",
    "<section id=comments><p>A reader says that this is long enough to look like a part of the text above, and it does.</p></section><footer>Us</footer>",
]


def test_layouts_without_an_article():
    hit = got = want = 0
    for menu, body, end in itertools.product(MENUS, BODIES, ENDS):
        found = Counter(html_extract.main_text(menu + body.format(*LINES) + end).split())
        true = Counter(re.sub("<[^>]*>", " ", body.format(*LINES)).split())
        hit, got, want = hit + (found & true).total(), got + found.total(), want + true.total()
    assert hit >= 0.95 * got and hit >= 0.95 * want


@pytest.mark.parametrize("page", ["<div>x" * 4000 + "</i>" * 4000, "<b>" * 4000 + "</i>x" * 4000, "<span hidden>" * 4000 + "</i></span>" * 4000, "<p>x" * 4000 + "<li>x" * 4000 + "</li></p>" * 4000])
def test_time_does_not_grow_with_depth(page):
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 1


def test_pages_with_clashing_columns_and_none(spark):
    df = spark.createDataFrame([(1, "u", "<p>one two", "x", 5, "y")], "page_id bigint, url string, html string, text string, n_chars int, __html string")
    assert html_extract.extract(df, keep=("page_id", "url")).columns == ["page_id", "url", "text", "n_chars"]
    assert html_extract.extract(df.limit(0)).collect() == []


def test_page_tables_agree_with_the_marked_article(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_extract.extract(pages, keep=("page_id", "html")).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|br|h1)>", " ", body)))).strip()
        assert r.text == want


def test_codecs_round_trip():
    rng = np.random.default_rng(0)
    for h, w, c in ((1, 1, 1), (5, 7, 3), (3, 64, 3), (2, 5, 1)):
        image = rng.integers(0, 256, (h, w, c), np.uint8)
        assert (media.decode(media.encode_pnm(image)) == image).all()
        assert (media.decode(media.encode_bmp(image)) == np.broadcast_to(image, (h, w, 3))).all()
    assert media.decode(b"P2 # note\n2 1\n255\n7 8\n").tolist() == [[[7], [8]]]
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_area_resize_equals_oversampling():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (6, 10, 3), np.uint8)
    big = np.repeat(np.repeat(image.astype(float), 4, 0), 3, 1)
    want = big.reshape(8, 3, 5, 6, 3).mean((1, 3))
    assert np.allclose(media.area_resize(image, 8, 5), want)


def test_media_columns(spark):
    texts = [None, "", "a", "é" * 500, "x" * 192, "x" * 193, "a", "y" * 300_000]
    got = media.media_columns(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for r, t in zip(sorted(got, key=lambda r: r.doc_id), texts):
        raw = (t or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        _, stored = media.text_image(t)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and len(r.feature) == 16
        assert r.tile[:6] == b"\x93NUMPY" and r.tile == media.npy_tile(media.decode(stored))
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
        assert r.bmp_sha256 == hashlib.sha256(media.encode_bmp(image)).hexdigest()
        grey = np.floor(media.area_resize(image, 8, 9).mean(2) * 256 + 0.5)
        bits = "".join("1" if grey[y, x + 1] > grey[y, x] else "0" for y in range(8) for x in range(8))
        assert r.feature == f"{int(bits, 2):016x}"
    df = spark.createDataFrame([(None, "a", "x", b"y")], "doc_id bigint, text string, feature string, tile binary")
    assert media.media_columns(df).count() == 1 and media.media_columns(df.limit(0)).collect() == []


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 300)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 8)).round(1)
    x[:400] = x[0]  # a vector that many rows have
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (903, [1.0, 2.0]), (None, [0.0] * 8), (905, [])]
    vectors = topk_search.quantised(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = {}
    for r in topk_search.top_k(vectors, vectors.where("vec_id % 20 = 0"), 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    q = np.floor(64 * x).astype(int)
    for i in range(0, 900, 20):
        s = q @ q[i]
        want = sorted(((int(-s[j]), j) for j in range(900) if j != i))[:7]
        assert got[i] == [(j, -m) for m, j in want]
    assert set(got) == set(range(0, 900, 20))


def test_top_k_with_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0])]
    vectors = topk_search.quantised(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = [tuple(r) for r in topk_search.top_k(vectors, vectors.where("vec_id = 0"), 5).orderBy("rank").collect()]
    q = 64 if got[0][3] == 64 * 192 else 128  # of two vectors of one id the smaller by its bytes asks
    assert got == [(0, 1, 2, q * 192), (0, 2, 1, q * 64), (0, 3, 1, q * 64)]


def test_top_k_of_nothing(spark):
    vectors = topk_search.quantised(spark.createDataFrame([], "vec_id bigint, embedding array<float>"))
    assert topk_search.top_k(vectors, vectors).collect() == []


@pytest.mark.parametrize("name", sorted(corpus.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    got = __spark_entry__.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(corpus.ORACLES[name]).df()
    a, b = (df[sorted(df.columns)].sort_values(sorted(df.columns)).reset_index(drop=True) for df in (got.toPandas(), want))
    assert list(a.columns) == list(b.columns)
    for c in a.columns:
        assert (a[c].fillna(-1).to_numpy() == b[c].fillna(-1).to_numpy()).all()


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_pipeline_with_clashing_columns_nulls_repeats_and_no_rows(spark, sf_dir, tmp_path):
    import corpus_pipeline

    names = ("settled", "open", "late", "weight", "p", "bucket", "label", "node", "score", "rank", "predicted", "held_out", "n_bytes", "kept_text", "mix_kept", "topic")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", *(f"doc_id % 7 AS {n}" for n in names))
    odd = docs.limit(3).selectExpr(*(f"CASE WHEN '{c}' = 'doc_id' AND doc_id % 2 = 0 THEN doc_id END AS {c}" if c == "doc_id" else f"CAST(NULL AS {t}) AS {c}" for c, t in docs.dtypes))
    docs = docs.union(docs.limit(5)).union(odd)
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.cut(stage(spark, df, sf_dir))
            if name != "token_ids":
                assert out.columns == docs.columns and out.where("doc_id IS NOT NULL AND settled <> doc_id % 7").count() == 0
                df = out
        assert (out.count() > 0) == (df is not docs and df.count() > 0)


def test_pipeline_keeps_clean_documents(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    df = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in df.select("doc_id").collect()}
        df = corpus_pipeline.cut(stage(spark, df, sf_dir))
        after = {r.doc_id for r in df.select("doc_id").collect()}
        assert after <= before
        if name != "token_ids":
            assert df.columns == docs.columns
        if name == "quality_filter":
            assert len(good & after) >= 0.97 * len(good & before) and len(bad & after) <= 0.2 * len(bad & before)
        if name == "repeated_passages":
            assert len(after) >= 0.97 * len(before)
    assert df.where("NOT round_trip").count() == 0


def test_pipelines_mixture_leaves_no_document_out(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = corpus_pipeline.cut(corpus_pipeline.mixture(spark, docs, sf_dir))
    assert docs.exceptAll(mixed).count() == 0 and mixed.join(docs, "doc_id", "left_anti").count() == 0
    tokens = corpus_pipeline.token_ids(spark, mixed, sf_dir)
    assert tokens.count() == mixed.count() and tokens.select("doc_id").distinct().count() == docs.count()


def some_words(n, of):
    return " ".join(f"{of}{i}" for i in range(n))


FRAMES = {"article": "<body><nav><a href=a>Home</a></nav><article>%s</article></body>", "post": "<body><nav><a href=a>Home</a></nav><div class=post>%s</div></body>", "bare": "<body>%s</body>", "main": "<body><header>Site</header><main>%s</main><footer>foot words</footer></body>", "form": "<body><form action=x>%s</form></body>"}
BOXES = ("<div class=related><a href=x>box link</a></div>", "<ul><li><a href=a>One</a></li></ul>", "<aside><p>box text</p></aside>", "<ul><li><a href=a>One two</a></li><li><a href=b>Three four five</a></li></ul>", "<div><a href=x>Buy this now today</a></div>")


@pytest.mark.parametrize("frame", FRAMES)
def test_no_paragraph_is_lost_beside_a_box(frame):
    from riskgraph.llm.html_extract import main_text

    for box in BOXES:
        for n in (60, 100, 200) if frame == "form" else (20, 35, 60, 100, 200):  # a form of few words is none of the page
            for m in (5, 8, 12, 20, 35, 60, 100, 300):
                got = main_text(FRAMES[frame] % f"<h1>A title here</h1><p>{some_words(n, 'a')}</p>{box}<p>{some_words(m, 'z')}</p>").split()
                assert set(got) >= set(f"{some_words(n, 'a')} {some_words(m, 'z')}".split()), (box, n, m)


def test_forms_and_blocks_outside_main():
    from riskgraph.llm.html_extract import main_text

    assert main_text("<body><form><label>User</label><input><label>Password please</label></form></body>") == ""
    assert "f0" not in main_text(f"<body><article><p>{some_words(80, 'a')}</p></article><form><p>{some_words(9, 'f')}</p></form></body>")
    for n in (3, 5, 8, 12, 16, 20, 21, 25, 30):
        around = f"<div><p>{some_words(n, 'o')}</p></div>"
        inner = f"<main><h1>T title</h1><p>{some_words(90, 'w')}</p><p>{some_words(40, 'b')}</p></main>"
        assert "o0" not in main_text(f"<body>{around}{inner}</body>") and "o0" not in main_text(f"<body>{inner}{around}</body>")
