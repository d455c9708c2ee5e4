import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import htmltree, wrapper

WORDS = "river stone wall lamp north seed glass iron door field ring".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(n)).capitalize() + "."


def plain_page(rng, host):
    """A page of a template without telling names: only what varies from page to page is the article."""
    lines = [prose(rng, 6), *(prose(rng, rng.randrange(5, 60)) for _ in range(rng.randrange(1, 9)))]
    notice = ("We use crumbs on this site.", "Buy our calendar now!", "Our shop is closed on Monday.")[rng.randrange(3)]
    links = "".join(f'<span><a href="/{w}">{w}</a></span>' for w in rng.sample(WORDS, 4))
    body = f"<div>{links}</div><div><div><h2>{lines[0]}</h2><div>{notice}</div>{''.join(f'<p>{x}' for x in lines[1:])}</div></div><div>All rights with {host}. <b>Imprint</b></div>"
    return f"<!doctype html><html><head><title>x</title></head><body>{body}</body></html>", "\n".join(lines)


def marked_page(rng, host):
    lines = [prose(rng, 6), *(prose(rng, rng.randrange(5, 40)) for _ in range(rng.randrange(1, 7)))]
    paragraphs = "".join(f"<p>{x.replace(' ', '  &#32;', 1)}</p>" for x in lines[1:])
    junk = [prose(rng, 12) for _ in range(8)]
    return f"""<HTML><head><title>{junk[0]}</title><style>p {{}}</style></head><body class="page-{rng.randrange(9)}"><header><h1>{junk[1]}</h1></header>
    <nav><ul><li><a href="/a">{junk[2]}</a><li><a href="/b">b</a></ul></nav><div class='main-wrap'><aside>{junk[3]}</aside>
    <main><article><header><h1>{lines[0]}</h1><p>{junk[4]}</p></header><script>if (a < b) "</p>";</script>{paragraphs}<div class="share-buttons">{junk[5]}</div><form><p>{junk[6]}</form></article>
    <section id="comments"><p>{junk[7]}</section></main></div><div class="cookieNotice">{junk[0]}</div><footer>{host} &copy;</footer>""", "\n".join(lines)


@pytest.fixture(scope="module")
def pages(spark):
    rng, rows = random.Random(11), []
    for i in range(260):
        host = ("www.plain.example", "marked.example", "Plain.Two.example")[i % 3]
        html, text = (marked_page if "marked" in host else plain_page)(rng, host)
        rows.append((i, f"https://{host}/p/{i}", html, text))
    rows += [(500, "http://marked.example/none", None, ""), (501, "http://marked.example/e", "", ""), (502, None, "<p>lone &amp; only<br>page</p><!-- x --><p>two", "lone & only page\ntwo")]
    rows += [(503, "http://alone.example/", "<div><p>a  b\n c<p>d</div>", "a b c\nd"), rows[0], rows[0], (None, "https://marked.example/cut", marked_page(rng, "x")[0].split("</article>")[0] + "</article><foot", None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, want string").repartition(5)


def test_text_of_every_page(pages):
    out = wrapper.extract(pages.withColumns({"text": F.lit(1), "a.b": F.lit(2), "host": F.lit("x"), "row": F.lit(3)}))
    assert set(out.columns) == {"page_id", "url", "html", "want", "a.b", "host", "row", "text", "n_chars"}
    rows = out.collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert r.want is None or r.text == r.want, (r.page_id, r.text, r.want)
        assert r.n_chars == len(r.text) and (r["a.b"], r.host, r.row) == (2, "x", 3)
    assert next(r.text for r in rows if r.page_id is None)


def test_needs_the_wrapper(pages):
    """Without its host's template a plain page keeps the notice."""
    plain = pages.where("url LIKE '%plain%'").collect()
    assert all(wrapper.article(r.html, None) != r.want for r in plain)


def test_templates_merge_in_any_parts(pages):
    one, many = (wrapper.induce(pages.repartition(n).selectExpr("substring_index(url, '/', 3) AS host", "html").where("host IS NOT NULL"), salts) for n, salts in ((1, 1), (9, 4)))
    assert {(r.host, r.pages) for r in one.collect()} == {(r.host, r.pages) for r in many.collect()}


def test_matching_is_the_largest_that_does_not_cross():
    def tree(x):
        return wrapper.Node(x[0], x[0], False, 0, 1, 0, 0, [hash(str(x)) % 1000], [tree(c) for c in x[1:]])

    a, b = [tree(x) for x in (["div", ["p"], ["p"]], ["div", ["ul", ["li"]]], ["table"])], [tree(x) for x in (["div", ["ul", ["li"]]], ["hr"], ["table"])]
    assert wrapper.matching(a, b) == [(1, 0), (2, 2)]
    merged = wrapper.overlaid([tree(x) for x in (["div", ["p"]], ["table"])], b)
    assert [x.key for x in merged] == ["div", "hr", "table"] and merged[0].pages == 2


def test_odd_markup():
    text = lambda html: "\n".join(htmltree.blocks(htmltree.parse(html), set()))
    assert text("a<p>b<div>c<p>d</div>e") == "a\nb\nc\nd\ne"
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "a\nb\nc\nd"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert text("x <span class=ad>buy <span>now</span> or <a href=x>later</a></span> y <i>z</i>") == "x y z"
    assert text('<p title="a>b" class=\'x\'>1 &lt; 2 &copy 3 &#x41; <script>"</p>"</SCRIPT>4') == "1 < 2 © 3 A 4"
    assert text("<p>a <b>b</p><p>c</b> d") == "a b\nc d"
    assert text("<div hidden>a</div><p style='display: none'>b</p>c<div") == "c"
    assert text("1 < 2 <!-- <p>no --> and <![CDATA[3 & 4]]>") == "1 < 2 and 3 & 4"
    deep = text("<div>" * 5000 + "deep" + "</div>" * 5000 + "end")
    assert deep.split() == ["deep", "end"]
    assert text(None) == "" and text('<a href="' + "x" * 100_000) == ""
    assert len(text("<p>" + "word " * 300_000)) == 5 * 300_000 - 1


def test_copies_are_no_template(spark):
    """A host whose pages are nearly all copies of one article keeps it."""
    rng = random.Random(2)
    html, text = marked_page(rng, "c")
    rows = [(i, "http://c.example/", html, text) for i in range(300)] + [(300 + i, "http://c.example/", *marked_page(rng, "c")) for i in range(40)]
    rows += [(900 + i, "http://same.example/", *plain_page(random.Random(9), "s")) for i in range(30)]
    out = wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string, want string"))
    assert out.where("page_id < 900 AND text <> want").count() == 0
    assert all(set(r.want.split("\n")) <= set(r.text.split("\n")) for r in out.where("page_id >= 900").collect())


def test_empty_table(pages):
    assert wrapper.extract(pages.limit(0)).count() == 0
    assert Counter(wrapper.extract(pages.limit(0)).columns) == Counter([*pages.columns, "text", "n_chars"])
