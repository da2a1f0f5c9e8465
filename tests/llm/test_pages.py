"""Main texts of pages: templates counted over a host, markup in disorder, odd inputs."""

import random
import re
from html import unescape

import pytest

from bourse.llm import common, pages, queries

DDL = "page_id long, url string, html string, host long, text string, k1 int"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, 5, "x", 1) for i, (u, h) in enumerate(rows)], DDL)


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def alone(html):
    return pages.read(html).extract({})[0]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<article><h1>A &amp; B</h1><p><b>one<br>two  \n three<p>four</article>", "A & B\none two three\nfour"),
        ("<article><p>a<script>var x='</p>'</script>b<!-- <p> --><style>p{}</style></p></article>", "ab"),
        ("<nav>menu</nav><article><header><h1>Title</h1></header><p>x</p><footer>by</footer><section id='comments'><p>nice</p></section></article>", "Title\nx"),
        ("<header>site</header><main><p>x <i>y</i>z</p><div class='cookie-notice'>ok?</div></main><aside>s</aside>", "x yz"),
        ("<body><div class=topMenu>m</div><p>a</p><p hidden>b</p><form><p>c</p></form><p style='display: none'>d</p>e</body>", "a\ne"),
        ("<article>a&nbsp;&#8212;&lt;b&gt; &copy 1 < 2 <a href='x>y' title=\"it's\">link</a></article>", "a —<b> © 1 < 2 link"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><p>x</p><article class='comment'><p>y</p></article></article><article class=comment>z</article>", "x"),
        ("<article><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><td>f</table></article>", "a\nb\nc\nd\ne\nf"),
        ("<article><p>a</b></div>b</p></span>c<b><p>d</b>e</p></article>tail", "ab\nc\nde"),
        ("<div itemprop='articleBody'><p>x</p></div><p>y</p>", "x"),
        ("<body class='has-sidebar'><p>x</p><br/><hr/>y<wbr>z</body>", "x\nyz"),
        ("<article></article><p>x</p>", "x"),
        ("", ""),
        ("just text & more", "just text & more"),
        ("<p title=\"a>b\" class=x\">t</p>", "t"),
        ("<!-- never closed <p>x</p>", ""),
        ("<article><p>x</p><script>never closed", "x"),
    ],
)
def test_one_page(html, text):
    assert alone(html) == text


def test_any_nesting_and_length():
    assert alone("<div>" * 60_000 + "x") == "x"
    assert alone("<b>" * 60_000 + "x") == "x"
    assert alone("<p>x" * 60_000).count("x") == 60_000
    assert alone("</div>" * 60_000 + "x < " * 10 + "<a \"" * 60_000) == "x < " * 9 + "x <"
    assert alone("<a b='" * 30_000 + "<!" * 30_000 + "y") == ""


def site(rng, n):
    """Pages of a large host without telling markup, with copies of one article and passages that articles share."""
    shared, copied, rows, expected = "Passage " + "that articles share " * 9, "Copied " * 30, [], []
    menus = [f"<div><ul><li><a href=/{k}>home {k}</a></li><li>all</li></ul></div>" for k in range(3)]
    for i in range(n):
        own = copied if i % 3 == 0 else " ".join(f"w{rng.randrange(500)}" for _ in range(30))
        blocks = [own, shared] if i % 5 == 1 else [own]
        body = "".join(f"<p>{b}</p>" for b in blocks)
        rows.append(("http://big.example/%d" % i, f"<html><body>{rng.choice(menus)}<div class=x{i % 2}>{body}</div><div>About <b>us</b></div></body></html>"))
        expected.append("\n".join(" ".join(b.split()) for b in blocks))
    return rows, expected


@pytest.mark.parametrize("bound", [10**6, 0])
def test_templates(spark, monkeypatch, bound):
    monkeypatch.setattr(pages, "BROADCAST_SUBTREES", bound)
    monkeypatch.setattr(common, "SPLIT", 20)
    rows, expected = site(random.Random(1), 120)
    few = [("http://few.example/%d" % i, rows[i][1]) for i in range(2)]
    inside = [("https://box.example/", f"<article><p>{'own %d ' % i * 9}</p><div>Follow us</div><p>Licence line.</p></article>") for i in range(9)]
    odd = [(None, rows[0][1]), ("no host", rows[0][1]), ("http://big.example/", None), ("http://big.example/", ""), rows[0], rows[0]]
    got = texts(pages.main_texts(frame(spark, rows + few + inside + odd)))
    assert [got[i] for i in range(120)] == expected
    assert all("About us" in got[120 + i] and "home" in got[120 + i] for i in range(2))  # two pages tell no template
    assert [got[122 + i] for i in range(9)] == [" ".join(f"own {i}" for _ in range(9)) + "\nLicence line." for i in range(9)]
    assert "About us" in got[131] and "About us" in got[132] and got[133] == got[134] == "" and got[135] == got[136] == expected[0]


def test_no_pages(spark):
    assert pages.main_texts(frame(spark, [])).columns == ["page_id", "url", "text", "n_chars", "n_template", "n_labelled"]
    assert pages.main_texts(frame(spark, [])).count() == 0


def test_main_text_of_the_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    want = {}
    for r in common.table(spark, sf_dir, "pages").collect():
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        want[r.page_id] = "\n".join(b for b in blocks if b)
    out = queries.op12_main_text(spark, sf_dir).collect()
    assert {r.page_id: r.text for r in out} == want and all(r.n_chars == len(r.text) for r in out)
    assert sum(r.n_template for r in out) > 100 and sum(r.n_labelled for r in out) > 100
