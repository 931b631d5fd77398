"""Main texts of pages with known articles, and the inferred expressions."""

import html
import re

import pyarrow.parquet as pq

from gleaner.llm import wrapper


def infer(pages):
    out = None
    for p in pages:
        w = wrapper.as_wrapper(wrapper.read_page(p))
        out = w if out is None else wrapper.merged(out, w)
    return out


def test_expression_of_a_host():
    pages = [
        "<body><h1>Same</h1><p>a</p><p>b</p></body>",
        "<body><h1>Same</h1><p>c</p><ul><li>x<li>y</ul></body>",
        "<body><h1>Same</h1><img><p>d</p></body>",
    ]
    assert wrapper.shape(infer(pages)) == '( (body (h1 "Same") (p #)+ (ul (li #)+)?))'
    assert wrapper.shape(infer(pages[::-1])) == wrapper.shape(infer(pages))


def test_layout_without_article_tags():
    def page(i):
        return f"""<html><body class="has-sidebar"><div id=top><a href=1>Home</a> <a href=2>News</a></div>
        <ul><li><a href="">One</a><li><a>Two</a></ul><div class="with-sidebar"><div id="content{i}"><h1>Title {i}</h1>
        <p>First &amp; para {i} &eacute;&#8217;s\n\t text <p>Second <b>bold</b> para{" x" * i}<div class="share">Share</div>
        <p>Subscribe today</div><div class="sidebar"><p>side {i}</p></div></div><div class="cookie-notice">We {i}</div>
        <form><input><label>Mail</label></form><section id="commentlist"><p>Nice {i} post, a very long comment</p></section>
        <div class=footer>Copyright {i}</div><script>if (a < b) {{ p("</p>") }}</script></body></html>"""

    pages = [page(i) for i in range(8)]
    found = wrapper.rule(8, infer(pages))
    for i, p in enumerate(pages):
        assert wrapper.extract(p, found) == f"Title {i}\nFirst & para {i} é’s text\nSecond bold para{' x' * i}"


def test_odd_markup():
    cases = {
        None: "", "": "", "plain < text &lt;b": "plain < text <b", "<p>a<p>b<!-- open": "a\nb", "<div>a<script>x": "a",
        "<p>a&nbsp;b&copy;&notanentity; &#x41;</p>": "a b©¬anentity; A", "<ul><li>a<li>b</ul>c": "a\nb\nc", "</p></b>x<": "x<",
        "<p title='>'>q</p><P hidden>no</P>": "q", "<td>1<td>2": "1\n2", "a<br>b<b>c</b>d": "a bcd", "<style>p{}</style>t": "t",
    }
    for page, want in cases.items():
        assert wrapper.extract(page, None) == want, page
    deep = "<div>" * 300 + "x"
    assert wrapper.extract(deep, wrapper.rule(1, infer([deep]))) == "x"


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in wrapper.main_text(pages).collect()}
    for r in pages.collect():
        article = r.html.split("<article>")[1].split("</article>")[0]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article))
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def test_odd_rows(spark):
    page = "<body><nav>menu</nav><main><p>text</p></main></body>"
    rows = [(1, "http://a.com/x", page, "mine", 1), (1, "http://a.com/x", page, "mine", 1), (None, None, page, "mine", 1), (3, "http://b.com", None, "mine", 1), (4, "", "<p>" + "long " * 100_000, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule int")
    got = wrapper.main_text(df).collect()
    assert sorted(((r.page_id, r.text[:9]) for r in got), key=str) == sorted([(1, "text"), (1, "text"), (None, "text"), (3, ""), (4, "long long")], key=str)
    assert wrapper.main_text(df.where("false")).count() == 0


def test_texts_of_one_page_are_no_layout():
    def page(i, own=""):
        return f"<body><article><h1>Title {i}</h1><h2 id=slug-{'abcdefg'[i]}>Heading {i}</h2><p>Text {i}</p>{own}<div><p>Read on</p></div></article></body>"

    own = "<h2>Background</h2><p>b</p><pre>code</pre><blockquote><p>quoted</p></blockquote><p>Read on</p>"
    for n in (2, 4, 5, 7):
        pages = [page(0, own), *[page(i) for i in range(1, n)]]
        found = wrapper.rule(n, infer(pages))
        assert wrapper.extract(pages[0], found) == "Title 0\nHeading 0\nText 0\nBackground\nb\ncode\nquoted\nRead on"
        assert wrapper.extract(pages[1], found) == "Title 1\nHeading 1\nText 1"
    same = ["<body><article><h1>T</h1><p>a</p><p>b</p></article></body>"] * 6
    assert wrapper.extract(same[0], wrapper.rule(6, infer(same))) == "T\na\nb"


def test_all_places_of_the_article():
    def texts(pages):
        found = wrapper.rule(len(pages), infer(pages))
        return [wrapper.extract(p, found) for p in pages]

    two = [f'<body><nav>m</nav><article class="a"><p>long text {i} {i}</p></article><article class="b"><p>note {i}</p></article></body>' for i in range(6)]
    assert texts(two) == [f"long text {i} {i}\nnote {i}" for i in range(6)]
    slugs = [f'<body><div>Site</div><article id="s-{c}"><header><h1>T {c}</h1></header><p>text {c}</p></article><div>more {c}</div></body>' for c in "abcdef"]
    assert texts(slugs) == [f"T {c}\ntext {c}" for c in "abcdef"]
    boxes = [f'<body><div id="top">Site</div><div id="page"><h1>T {i}</h1><div id="intro"><p>In short {i}</p></div><div id="body"><p>a {i}{" long" * 50}</p><p>b</p></div></div></body>' for i in range(6)]
    assert texts(boxes) == [f"T {i}\nIn short {i}\na {i}{' long' * 50}\nb" for i in range(6)]
    cards = '<aside><article><a href="">Other</a><p>in short</p></article></aside><article class="card"><a href="">Next</a></article>'
    assert texts([f"<body><article><p>text {i}</p></article>{cards}</body>" for i in range(2)]) == ["text 0", "text 1"]


def test_names_do_not_cut_an_article():
    body = """<article><h1>T</h1><h2 id="related-work">Related work</h2><p>a</p><h2 id="search">Search</h2><p class="legal">b</p>
    <ul><li><a href=1>First reference</a><li><a href=2>Second reference</a></ul><section id="comments-on-method"><p>c</p></section>
    <blockquote class="notice-text">d</blockquote>{}<p>last</p></article>"""
    want = "T\nRelated work\na\nSearch\nb\nFirst reference\nSecond reference\nc\nd\nlast"
    cut = """<section id="comments"><p>Nice</p></section><div class="share-bar"><a>x</a></div><p class="ad">Buy</p><div class="adBox">Buy</div>
    <aside>e</aside><form><p>f</p></form><div class="cookie-notice">g</div><div class="commentList">h</div><div hidden>i</div>"""
    assert wrapper.extract(body.format(""), None) == want
    assert wrapper.extract(body.format(cut), None) == want


def test_the_wrapper_finds_articles_without_names():
    """Boxes of the tables' pages without tag names, classes and ids: only the inferred place is left."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    hosts = {}
    for r in pages:
        hosts.setdefault(r["url"].split("://")[1].split("/")[0].lower(), []).append(r["html"])
    seen = 0
    for of_host in hosts.values():
        if len(of_host) < 3:
            continue
        bare = [re.sub(r"<(/?)(?:nav|footer|article|div)\b[^>]*>", r"<\1div>", p) for p in of_host]
        for order in (bare, bare[::-1]):
            found = wrapper.rule(len(bare), infer(order))
            assert found["tags"][-1] == "div"
            for p, b in zip(of_host, bare, strict=True):
                assert wrapper.extract(b, found) == wrapper.extract(p, None) != wrapper.extract(b, None)
        seen += len(bare)
    assert seen == 222


def test_links_that_all_pages_share_are_a_menu():
    def page(i):
        return f'<article><h1>T {i}</h1><div class="x"><ul><li><a>Top</a><li><a>Index</a></ul></div><p>text {i}</p><div class="y"><ul><li><a>Ref {i}</a><li><a>Ref {i} b</a></ul></div></article>'

    pages = [page(i) for i in range(4)]
    found = wrapper.rule(4, infer(pages))
    assert wrapper.extract(pages[1], found) == "T 1\ntext 1\nRef 1\nRef 1 b"
    assert wrapper.extract(pages[1], None) == "T 1\nTop\nIndex\ntext 1\nRef 1\nRef 1 b"


def test_a_wrapper_is_bounded_by_the_layout():
    """One host, ids and classes that no two pages share: the wrapper stops growing."""

    def page(i):
        name = "".join(chr(97 + i // 26**k % 26) for k in range(3))
        parts = "".join(f'<h2 id="{name}{"abcdef"[j]}">H {i} {j}</h2><p>p {i}</p><section id="s{name}{"abcdef"[j]}"><p>q {i}</p></section>' + "<ul><li>x</ul>" * (i >> j & 1) for j in range(1 + i % 6))
        return f'<body><div id="top">Site</div><div class="of-{name}"><h1>T {i}</h1>{parts}</div><div>more {i}</div></body>'

    pages = [page(i) for i in range(2_000)]
    small, large = infer(pages[:100]), infer(pages)
    assert len(wrapper.shape(large)) < 1.1 * len(wrapper.shape(small)) < 2_000
    found = wrapper.rule(len(pages), large)
    assert wrapper.extract(pages[7], found) == "T 7\nH 7 0\np 7\nq 7\nx\nH 7 1\np 7\nq 7\nx"
    many = "<body>" + "".join(f'<div id="{"".join(chr(97 + i // 26**k % 26) for k in range(3))}"><p>{i}</p></div>' for i in range(2_000))
    assert len(wrapper.shape(infer([many]))) < 100
    deep = "<div>" * 5_000 + "x" + "</div>" * 5_000 + "<p>y</p>"
    assert wrapper.extract(deep, wrapper.rule(1, infer([deep]))) == "x\ny"
