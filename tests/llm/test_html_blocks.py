import html
import re

import duckdb

from trialmill.llm import html_blocks, queries

PAGE = """<!DOCTYPE html><html><head><title>No &lt; title</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body class="page"><header><h2>Site name</h2></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie notice"><p>We use cookies on this site to make it work better for you.</p></div>
<article><header><h1>The   title&nbsp;&amp; more</h1></header><p class="lead">First<b> bold</b><br>line <a href="x>y">link</a>.<p>El.
<div class="ad">Buy this thing today for a small price of nothing.</div><ul><li>one</li><li><a href="#">two</a></li></ul>
<form><label>Mail</label><button>Send</button></form><!-- <p>gone</p> --><table><tr><td>a</td><td>b</td></tr></table>
<aside>Not this one either.</aside><p hidden>Never.</p><pre>x  &lt;y&gt; &#65;&#x42;</pre>
<section id="comments"><p>First comment says a lot of things about the text above.</p></section></article>
<footer>&copy; site</footer></body></html>"""


def test_article_without_the_frame():
    assert html_blocks.main_text(PAGE).split("\n") == ["The title & more", "First bold line link.", "El.", "one", "two", "a", "b", "x <y> AB"]


def test_page_without_article():
    page = '<body><div id="menu"><a href="/">Home</a> <a href="/b">About us</a></div><div><p>' + "some words of text " * 10 + "</p><p>More of it here.</p></div><div><a>a</a> <a>b</a></div></body>"
    assert html_blocks.main_text(page) == ("some words of text " * 10).strip() + "\nMore of it here."


def test_tree_fits_its_table():
    tree = html_blocks.block_tree()
    assert all(html_blocks.classify(tree, row[:-1]) == row[-1] for row in html_blocks.LABELLED)


def test_tree_uses_words_and_links():
    used, tree = set(), [html_blocks.block_tree()]
    while tree:
        node = tree.pop()
        if not isinstance(node, int):
            used.add(html_blocks.FEATURES[node.feature])
            tree += [node.low, node.high]
    assert {"words", "link_density"} <= used and used & {"words_before", "links_before", "words_after", "links_after"}


def test_layout_words_do_not_hide_the_page():
    text = "<p>" + "some words of text " * 10 + "</p>"
    whole = ("some words of text " * 10).strip()
    for page in (f'<body class="no-sidebar">{text}</body>', f'<article class="post comments-open">{text}</article>', f'<main id="search-page">{text}</main>'):
        assert html_blocks.main_text(page) == whole
    assert html_blocks.main_text(f'<body><div class="sidebar">{text}</div><article>{text}</article></body>') == whole


def test_hard_rows(spark):
    long = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    pages = [None, "", "plain text without any tag but with enough words to be one block of it", "<p>cut <b", "<!-- open", "<article><p>a</article", "<<p>>", long, long, "<script>x"]
    df = spark.createDataFrame([(i, "u", p, "t") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    out = {r.page_id: r.text for r in html_blocks.extract(df).collect()}
    assert out[0] == out[1] == out[4] == out[9] == ""
    assert out[2] == pages[2] and out[3] == "cut" and out[5] == "a" and out[7] == out[8] == "\n".join(["word"] * 20_000)
    assert html_blocks.extract(df.limit(0)).count() == 0


def test_given_pages(spark, data):
    given = dict(duckdb.sql(f"SELECT page_id, html FROM '{data}/pages.parquet'").fetchall())
    for r in queries.op4_html_blocks(spark, data).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", given[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>|<br>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
