import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkiln.llm import forest, html, warc
from panelkiln.llm.shared import new_path

SF = "/root/testdata/sf0.001"


def test_warc_round_trip_with_magic_inside(spark):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    payloads = {1: "x" * 2000, 2: "x" * 2000, 3: inner * 3, 4: None, 5: "", 6: "tail WARC/1.0\r\n", 7: "é" * 700, 8: "WARC/1.0\r\n" * 400, 9: "x" * 2000, 10: inner + "y" * 3000, 11: "x" * 10, 12: "x" * 10}
    d = spark.createDataFrame([(k, f"http://a/{k}\r\nX: y", v) for k, v in payloads.items()], "page_id long, url string, html string").repartition(3)
    path = new_path(spark, "warc")
    warc.write_warc(d, path)
    for split in ("128m", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        records = warc.read_warc(spark, path, payloads=True).collect()
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len(records) == len(payloads)
        for r in records:
            k = int(r.headers["warc-record-id"][12:-1])
            if k in (1, 2):
                assert r.headers["warc-type"] == "revisit" and r.headers["warc-refers-to"] == "<urn:x-page:9>" and r.declared == 2000
            else:
                assert bytes(r.payload).decode() == (payloads[k] or "") and "sha1:" + r.sha1 == r.headers["warc-payload-digest"]


def test_warc_ids_and_empty(spark):
    d = spark.createDataFrame([(None, "u", "x" * 1500), (5, None, "x" * 1500), (5, "u", "x" * 1500), (4, "u", "x" * 1500)], "page_id long, url string, html string")
    out = warc.revisits(d, "page_id", "html").collect()
    assert sorted((r.page_id or 0, r.refers_to or 0) for r in out) == [(0, 5), (4, 5), (5, 0), (5, 0)]
    path = new_path(spark, "warc")
    warc.write_warc(d.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


def test_reachable_follows_the_chain_only(spark):
    d = spark.createDataFrame([(1, 0, 10), (1, 10, 30), (1, 20, 25), (1, 25, 30), (1, 30, 99), (2, 5, 9), (2, 9, 12)], "fid long, at long, next long")
    assert sorted(map(tuple, warc.reachable(d).collect())) == [(1, 0), (1, 10), (1, 30)]


def test_nearest_recall_and_scores(spark):
    got = forest.op2_prefix_forest(spark, SF).toPandas()
    t = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids = np.array(t.embedding.tolist(), dtype=np.float64), t.vec_id.to_numpy()
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        want = [v for v in ids[np.lexsort((ids, -s))] if v != q][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine.score, [s[ids == v][0] for v in mine.vec_id], atol=1e-12)
        hits += len(set(want) & set(mine.vec_id))
        total += 20
    assert hits / total >= 0.9


def test_recall_of_candidates():
    """Where the forest leaves rows out: the queries of sf0.1."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pandas()
    x, asks = np.array(t.embedding.tolist(), dtype=np.float64), np.flatnonzero(t.vec_id.to_numpy() % 20 == 0)
    extra = np.sqrt(np.maximum(0.0, (x * x).sum(1).max() - (x * x).sum(1)))
    mask = forest._candidates(forest._strings(np.hstack((x, extra[:, None]))), forest._strings(np.hstack((x[asks], np.zeros((len(asks), 1))))), max(800, int(0.3 * len(x))))
    hits = 0
    for k, i in enumerate(asks):
        s = x @ x[i]
        s[i] = -np.inf
        hits += mask[k, np.argpartition(-s, 19)[:20]].sum()
    assert hits >= 0.9 * 20 * len(asks) and mask.mean() < 0.6


def test_nearest_of_repeated_rows(spark):
    """Repeated rows are one, an id with 40 equal rows hides no other id, and an id with two
    vectors has its better score."""
    rows = [(0, [1.0, 0.0])] * 3 + [(1, [0.9, 0.0])] * 40 + [(2, [0.9, 0.0]), (3, [0.2, 0.0]), (3, [0.8, 0.0]), (4, [0.1, 5.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = forest.nearest(d, F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in out] == [(1, 0.9), (2, 0.9), (3, 0.8)]
    out = forest.nearest(d, F.col("vec_id") == 3, k=9).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 6)) for r in out] == [(0, 0.8), (1, 0.72), (2, 0.72), (4, 0.08)]


def test_nearest_edge_rows(spark):
    rows = [(20, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.5, 0.5]), (8, [1.0]), (None, [1.0, 1.0]), (40, [0.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit(1))
    out = forest.nearest(d, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in out] == [(20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 7, 0.5)]
    assert forest.nearest(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_a_hot_vector_fills_no_shard(spark):
    d = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    out = forest.nearest(d, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in out] == list(range(1, 21))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header class="masthead"><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div id="cookie-notice">We use cookies; accept them, please.</div><!-- <p>hidden</p> -->@@
<aside>Side bar, with text.</aside><section class="comments"><p>I like it, really. A long comment, is it not?</p></section>
<form><p>Your mail, please.</p><input></form><div class="ad">Buy this, now.</div><footer>&copy; 2020, all rights.</footer></body></html>"""
BODY = """<h1>Head&amp;line</h1><p>First <b>bold</b>
 text&nbsp;here, with words; and more of it.<br>Next line.<p>Second one is <a href=x>a link</a>, too.
<ul><li>One</li><li>Two</ul><table><tr><td>Cell</td></tr></table>"""
WANT = "Head&line\n\nFirst bold text here, with words; and more of it. Next line.\n\nSecond one is a link, too.\n\nOne\n\nTwo\n\nCell"


def test_main_text():
    assert html.main_text(PAGE.replace("@@", f"<article>{BODY}</article>", 1)) == WANT
    assert html.main_text(PAGE.replace("@@", f'<div class="wrap"><div class="content">{BODY}</div></div>', 1)) == WANT
    for page in (None, "", "   ", "<html></html>", "<nav>only a menu</nav>", "<p", "<!--", "<script>"):
        assert html.main_text(page) == ""
    assert html.main_text("<article><p>cut off in the mid") == "cut off in the mid"
    assert html.main_text("<article><p>" + "word " * 200_000 + "</p></article>").count("word") == 200_000


def test_slugs_links_and_formulas_stay():
    names = ['h2 id="search-engines"', 'section id="related-work"', 'h2 id="social-history"', 'div id="ad-hoc-queries"', 'section id="responses"']
    words = "Some words of the text, which has several clauses; and an end."
    inner = "".join(f"<{n}>Part {k}</{n.split()[0]}><p>{words}</p>" for k, n in enumerate(names))
    got = html.main_text(f'<body><article>{inner}<div class="comments">No.</div><div id="sidebar">No.</div></article></body>')
    assert all(f"Part {k}" in got for k in range(5)) and "No." not in got
    got = html.main_text(f'<body><div><h2 id="search-engines">Head</h2><p>{words}</p><p><a href="x">A paragraph that is a link</a></p><p>{words}</p></div></body>')
    assert got.startswith("Head") and "A paragraph that is a link" in got
    assert "x+1" in html.main_text(f"<article><p>{words} <math><mi>x</mi><mo>+</mo><mn>1</mn></math></p></article>")


def test_class_words_in_an_article():
    """Listed words on pieces of its text, or with others in a name, do not drop them; boxes
    that they name go, however long their text."""
    words = "Some words of the text, which has several clauses; and an end."
    inner = f'<p>{words}</p><p class="related-work">Work: {words}</p><blockquote class="announcement">Quote: {words}</blockquote><div class="ad-hoc">Query: {words}</div><h2 class="search">Head</h2>'
    noise = f'<div class="comment-list"><p>Comment: {words * 2}</p></div><p class="ad">Buy.</p><div class="newsletter">Mail: {words}</div><ul class="share-buttons"><li>Share</li></ul>'
    got = html.main_text(f"<body><article>{inner}{noise}<p>{words}</p></article></body>")
    assert all(x in got for x in ("Work:", "Quote:", "Query:", "Head")) and not any(x in got for x in ("Comment:", "Buy", "Mail:", "Share"))


def test_deep_pages():
    words = "deep text, which is here."
    assert html.main_text("<div>" * 50_000 + words + "</div>" * 50_000) == words
    assert html.main_text("<div>" * 50_000 + f"<p>{words}</p>" * 2000).count(words) == 2000
    assert words in html.main_text("<ul><li>" * 20_000 + "</b></dl></p>" * 20_000 + words)


def test_path_scores_against_plain_ratios():
    """The smoothed, weighted ratios by whole paths, block by block."""
    import math

    rng = np.random.default_rng(4)
    kinds = ["<p>{}</p>", "<div class='x y'>{}</div>", "<ul><li>{}</li></ul>", "<div class='comments'><p>{}</p></div>", "<section><h2>{}</h2></section>", "<p><a href=z>{}</a> more.</p>", "<nav>{}</nav>"]
    for _ in range(20):
        page = "<body>" + "".join(kinds[rng.integers(len(kinds))].format("word, " * rng.integers(1, 30) + "end.") for _ in range(25))
        found = html.blocks(page)

        def whole(e):
            return (whole(e.parent) if e.parent else ()) + ((e.tag, "comments" if e.weight < (e.parent.weight if e.parent else 1) else e.tag == "div"),)

        def ratio(path):
            same = [(t, n) for e, t, n in found if whole(e) == path]
            chars = sum(len(t) for t, _ in same)
            return chars / len(same) * (1 + sum(c in ".,;:!?" for t, _ in same for c in t) / len(same)) * (1 - sum(n for _, n in same) / chars)

        for k, (e, _, _) in enumerate(found):
            near = [(math.exp(-((j - k) ** 2) / 2), ratio(whole(found[j][0])) * (found[j][0].weight if j != k else 1)) for j in (k - 1, k, k + 1) if 0 <= j < len(found) and not found[j][0].around]
            want = 0.0 if e.around else e.weight * sum(a * b for a, b in near) / sum(a for a, _ in near)
            assert math.isclose(html.path_scores(found)[k], want, rel_tol=1e-9)


def test_extract_keeps_rows(spark):
    d = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<p>Hi there.</p>", "x"), (None, None, "<p>Hi there.</p>", None)], "page_id long, url string, html string, text string")
    out = html.extract(d, carry=["page_id", "url"])
    assert sorted(r.text for r in out.collect()) == ["", "Hi there.", "Hi there."] and out.columns == ["page_id", "url", "text"]
    assert html.extract(d.limit(0)).count() == 0


STORY = "".join(f"<p>Sentence {k} of the story, which goes on for a while, and ends here.</p>" for k in range(6))


@pytest.mark.parametrize("anchor", ['<a name="top">', '<a name="top"></a>', '<a href="#x">', '<p><a href="/">home</p>'])
def test_an_anchor_without_end_keeps_the_article(anchor):
    assert html.main_text(f"<html><body>{anchor}<div>{STORY}</div></body></html>").count("Sentence") == 6


def test_pages_of_links_only_are_scored_by_length():
    assert "Sentence" in html.main_text('<body><p><a href="/a">Sentence one, of a link that is a whole text.</a></p></body>')


def test_comments_longer_than_the_story():
    comments = "".join(f'<p>Reader {k} says so, and more, and more again, at length, because there is time for it.</p>' * 5 for k in range(6))
    text = html.main_text(f'<body><div>{STORY}</div><div class="comments">{comments}</div></body>')
    assert "Reader" not in text and text.count("Sentence") == 6


def test_a_notice_inside_the_article_goes():
    text = html.main_text(f'<body><article>{STORY}<p class="notice">We use things.</p></article></body>')
    assert "We use" not in text and text.count("Sentence") == 6
