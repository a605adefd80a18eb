"""Archives and main text."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stridelake.llm import html_text, warc
from stridelake.llm.common import Scratch

BIG = "<p>" + "é" * 600 + "</p>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/1", BIG), (2, "http://a/2\r\nX: y", BIG), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", BIG), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 200), (None, None, "z" * 2000), (None, None, "z" * 2000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("sha1", F.lit(1)).repartition(3)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archive_round_trip(spark, pages, compression):
    warc.register(spark)
    path = Scratch(spark, "test").path("archive")
    warc.archive_pages(pages, path, compression=compression)
    got = {r["page_id"]: r for r in warc.page_records(spark, path).collect()}
    assert warc.page_records(spark, path).count() == pages.count()
    for r in pages.filter("page_id is not null").collect():
        body = (r["html"] or "").encode()
        g = got[r["page_id"]]
        assert (g["payload_bytes"], g["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
        assert (g["record_type"], g["refers_to"]) == (("revisit", 7) if r["page_id"] in (1, 2) else ("response", None))
    stored = {r["record_id"]: r["payload"] for r in warc.read_archive(spark, path).collect()}
    assert bytes(stored["<urn:page:7>"]) == BIG.encode() and stored["<urn:page:1>"] is None and bytes(stored["<urn:page:6>"]) == b""


def test_predicates_reach_the_reader(spark, pages):
    warc.register(spark)
    path = Scratch(spark, "test").path("archive")
    warc.archive_pages(pages, path)
    df = warc.read_archive(spark, path).filter("record_type = 'revisit' and target_uri like 'http://a/%'")
    assert {r["record_id"] for r in df.collect()} == {"<urn:page:1>", "<urn:page:2>"}
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_length",), 5)]))
    assert len(left) == 1 and reader.tests == [("record_type", "EqualTo", "response")]


def test_files_are_planned_and_unlisted_ones_ignored(spark, pages, tmp_path):
    warc.register(spark)
    path = str(tmp_path / "archive")
    warc.archive_pages(pages, path)
    (tmp_path / "archive" / "part-lost.warc").write_bytes(b"half a record")
    assert warc.read_archive(spark, path).count() == pages.count()
    assert len(warc.WarcReader({"path": path, "splitBytes": "1"}).partitions()) == len(list((tmp_path / "archive").glob("part-*.warc"))) - 1


def test_empty_archive(spark, pages):
    warc.register(spark)
    path = Scratch(spark, "test").path("archive")
    warc.archive_pages(pages.limit(0), path)
    assert warc.page_records(spark, path).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<!-- <p>hidden</p> --><div class="cookie-notice">We use cookies on this site to make it work well for all of you.</div><div class="ad">Buy this now, a very good thing at a very good price for you.</div>
<article><h1>Title &amp; more</h1><p><b>First   part.<br><p>Second&nbsp;part of the text, with a <a href="/x">link</a> inside and enough words.</p><ul><li>One item of a list</li><li>Another item</li></ul></p>
<aside>Related stories you may like to read on this site today.</aside><form><input><button>Send</button> Your mail</form>
<section id="comments"><p>I think this is a great article and I agree with all of it, thanks for writing it.</p></section></article>
<div class="sidebar"><p>Popular posts of the week on this site for you to read.</p></div><footer>&copy; 2020 Site. All rights reserved in all the places.</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst part.\n\nSecond part of the text, with a link inside and enough words.\n\nOne item of a list\n\nAnother item"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("<p>" + "word " * 30_000) == ("word " * 30_000).strip()
    assert "1 < 2" in html_text.main_text("<article><p>It is known that 1 < 2 holds, and a page may say so without care.</p></article>")


def test_plain_divisions_without_article():
    body = "".join(f"<p>Paragraph {i} has a good number of words in it, as text of an article does.</p>" for i in range(5))
    page = f"<body><div id='menu'><a href='/'>x</a></div><div>{body}</div><div class='footer'>Contact and imprint of the site</div></body>"
    assert html_text.main_text(page).count("\n\n") == 4


def test_cut_is_minimal():
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(150):
        n = rng.randint(1, 8)
        cost = [round(rng.uniform(-2, 2), 2) for _ in range(n)]
        edges = [(i, j, round(rng.uniform(0.1, 1.5), 2)) for i in range(n) for j in range(i) if rng.random() < 0.4]

        def energy(x):
            return sum(max(c, 0) if not k else max(-c, 0) for c, k in zip(cost, x)) + sum(w for i, j, w in edges if x[i] != x[j])

        best = min(energy(x) for x in itertools.product([False, True], repeat=n))
        assert abs(energy(html_text.min_cut(cost, edges)) - best) < 1e-6


def test_every_page_has_a_row(spark, pages):
    got = html_text.extract_main_text(pages).collect()
    assert len(got) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


P = "A paragraph with enough words that it reads like the text of an article and not like a menu. "
HOSTILE = {
    "body in a class that sounds like a notice": (f"<body><nav><a>Home</a></nav><div class='post notice-board-story'><h1>Title here</h1><p>{P * 2}</p><p>{P}</p><p>Short one.</p></div><footer>Imprint</footer></body>", ["Title here", P * 2, P, "Short one."]),
    "related-content in an article": (f"<article><h1>Head</h1><p>{P}</p><div class='related-content'><p>{P * 2}</p></div><p>{P}</p></article>", ["Head", P, P * 2, P]),
    "related links": (f"<article><h1>Head</h1><p>{P}</p><div class='related'><a>{P}</a> <a>More of it</a></div></article>", ["Head", P]),
    "formula and fall-back text": (f"<article><p>It is <math><mi>a</mi><mo>+</mo><mi>b</mi></math> here. {P}</p><noscript><p>{P}</p></noscript></article>", ["It is a+b here. " + P, P]),
    "an unclosed quote": (f"<article><p title=\"bad>Second part. {P}</p><p class=\"x\">More {P}</p></article>", ["Second part. " + P, "More " + P]),
    "markup in a closed quote": (f"<article><p title=\"a > b <b>c</b>\">{P}</p></article>", [P]),
    "comments": (f"<article><h1>H</h1><p>{P}</p><div class='comments'><h3>Comments</h3><div class='comment'><p>I think {P}</p><p>ok</p></div><div class='comment'><p>{P * 4}</p></div></div></article>", ["H", P]),
    "aside and form": (f"<article><p>{P * 2}</p><aside><h3>More</h3><p>{P * 3}</p></aside><p>{P}</p><form>Your mail {P}<button>ok</button></form></article>", [P * 2, P]),
    "a long advert": (f"<article><p>{P}</p><div class='ad'>{P * 4}</div><p>{P}</p></article>", [P, P]),
    "no article, a list and a table": (f"<body><div><h2>S</h2><p>{P * 2}</p><ul><li>One</li><li>Two</li><li>Three</li><li>Four</li></ul><table><tr><td>a</td><td>b</td></tr></table><p>{P}</p></div></body>", ["S", P * 2, "One", "Two", "Three", "Four", "a", "b", P]),
    "a phrase of footers in the text": (f"<article><p>{P}</p><p>All rights reserved.</p></article>", [P, "All rights reserved."]),
    "a number beyond all": ("<article><p>Big &#" + "9" * 6000 + f"; and &#0000000065; in {P}</p></article>", ["Big � and A in " + P]),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages(name):
    page, want = HOSTILE[name]
    assert html_text.main_text(page) == "\n\n".join(w.strip() for w in want)


@pytest.mark.parametrize("page", ["<a " * 20_000, "<p title='" * 20_000, "<p a='>" * 20_000 + "'x", "<div>" * 20_000 + "</b>" * 20_000, "<b>" * 20_000 + "<li>" * 20_000, "<style>" + "</style " * 20_000, "<p>x</p><p>" + "<!--" * 20_000, "<p>short</p><div><a>link link</a></div>" * 3_000])
def test_no_page_is_slow(page):
    import time

    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 1.5


SF = "/root/testdata/sf0.01"


def article_blocks(page):
    """The blocks of the article element, by the standard library's parser."""
    from html.parser import HTMLParser

    class Parser(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag in html_text.BLOCKS:
                self.blocks.append("")
            elif tag == "br":
                self.blocks[-1] += " "

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            if tag in html_text.BLOCKS:
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    parser = Parser()
    parser.feed(page or "")
    return "\n\n".join(t for b in parser.blocks if (t := " ".join(b.split())))


def test_query_on_the_table(spark):
    import os

    from stridelake.llm.queries import op8_html_main_text

    if not os.path.isdir(SF):
        pytest.skip("test tables are absent")
    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op8_html_main_text(spark, SF).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: article_blocks(v) for k, v in rows.items()} and len(got) == len(rows)


def test_cut_decides_labels(spark):
    """Blocks of the table whose own cost has the other sign than their label, and of a page of short blocks."""
    import os

    blocks = html_text.blocks_of(f"<div><h2>S</h2><p>{P * 2}</p><h3>T</h3><p>No.</p><p>{P}</p></div>")
    costs = html_text.block_costs(blocks)
    assert min(costs) < 0 and all(html_text.min_cut(costs, html_text.smoothness(blocks)))
    if os.path.isdir(SF):
        flipped = 0
        for r in spark.read.parquet(f"{SF.replace('0.01', '0.1')}/pages.parquet").select("html").collect():
            blocks = html_text.blocks_of(r["html"] or "")
            costs = html_text.block_costs(blocks)
            flipped += sum((c > 0) != k for c, k in zip(costs, html_text.min_cut(costs, html_text.smoothness(blocks))))
        assert flipped >= 10
