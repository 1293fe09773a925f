import html
import random
import re

from keyloom.llm import html_wrapper as W
from keyloom.llm.html_wrapper import aligned, expression, main_text, main_texts, parse, rules_of, wrapper_of

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no";</script></head><body>
<header>Site head</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- x <p>no</p> --><div class="ad big">Buy</div>
<article><h1>Title &amp; more</h1><p><b>One <i>t</i>wo<br>three.<br><p>Four&nbsp;\n five &lt;b&gt; &#233;</p><div class="notice">Note</div><form>f<input></form>
<aside>side</aside><ul><li>a<li>b</ul><div id="comments"><p>First!</p></div></article><div class="sidebar">s</div><footer>&copy; x</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "Title & more\n\nOne two three.\n\nFour five <b> é\n\na\n\nb"


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    assert main_text("plain <b>text") == "plain text"
    assert main_text("<article><p>cut here</p><p>and <foo") == "cut here\n\nand"
    assert main_text("<article>1 < 2 &am</article>") == "1 < 2 &am"
    assert main_text("<main><p>m</p></main>") == "m"
    assert main_text("<div>" * 3000 + "deep") == "deep"
    assert len(main_text("<article>" + "<p>word</p>" * 20_000)) == 20_000 * 6 - 2


def test_classes():
    page = """<body class="page with-sidebar"><div class="content-with-sidebar"><article class="post has-comments"><header><h1>T</h1></header><p>x</p>
    <div class="adsbygoogle">buy</div><section id="reader-comments"><article class="comment">me</article></section></article></div>
    <div class="left-sidebar">s</div><div id="cookie_notice">c</div><div role="search">q</div><div style="display: none">h</div></body>"""
    assert main_text(page) == "T\n\nx"
    plain = "<body><div id=top-menu>m</div><div id=address>a st</div><h2>H</h2>t<table><tr><td>1<td>2</table><p hidden>z</p></body>"
    assert main_text(plain) == "a st\n\nH\n\nt\n\n1\n\n2"


def host_pages(n):
    return [f"<body><div class=top>Always here</div><div class=c><h1>Head {i}</h1>{'<p>Text %d goes on and on.</p>' % i * (i % 3 + 1)}{'<em>opt</em>' * (i % 2)}</div><div class=low>Same {'x'}</div></body>" for i in range(n)]


def test_wrapper():
    ws = [wrapper_of(parse(p)) for p in host_pages(6)]
    w = ws[0]
    for x in ws[1:]:
        w = aligned(w, x)
    assert re.sub(r"'\w{8}'", "FIXED", expression(w)) == "<><body><div.top>FIXED</div.top> <div.c><h1>TEXT</h1> (<p>TEXT</p>)+ (<em>FIXED</em>)?</div.c> <div.low>FIXED</div.low></body></>"
    assert rules_of(w) == ([">body>div.low", ">body>div.top"], ">body>div.c")


def test_frame(spark):
    rows = [(i, f"http://H.example/{i}", p) for i, p in enumerate(host_pages(8))] + [(50, None, None), (51, "x", ""), (52, "http://a.b/c", PAGE), (52, "http://a.b/c", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text").repartition(3)
    got = {r.page_id: r for r in main_texts(df).collect()}
    assert main_texts(df).count() == len(rows)
    assert got[50].text == got[51].text == "" and got[52].text == main_text(PAGE) and got[50].url is None
    for i in (0, 2, 7):
        assert got[i].text.split("\n\n")[:2] == [f"Head {i}", f"Text {i} goes on and on."] and "Same" not in got[i].text and got[i].n_chars == len(got[i].text)
    assert main_texts(df.limit(0)).count() == 0


def test_given_pages(spark):
    """Pages whose articles are known to be one h1 and paragraphs: a plain cut of the markup gives the same."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in main_texts(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"(?s).*<article>|</article>.*", "", r.html)
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n\n".join(x for x in parts if x)


def marked_pages(n, tag="article"):
    return [f"<body><{tag} class=post><h1>Head {i}</h1><div class=kicker>Our house line</div><p>Text {i} is new.</p>{'<ul class=w><li>yes<li>yes<li>yes<li>yes<li>yes</ul>' * (i == 3)}<p>And {i} more.</p></{tag}><div>{i}</div></body>" for i in range(n)]


def test_template_inside_articles(spark):
    """Unchanging texts of an article go, whatever their class; five repeats on one page are not five pages; two pages are too few."""
    plain = [f"<body><div class=top>Always here</div><div class=c><h1>Plain {i}</h1><p>Words {i}.</p></div></body>" for i in range(6)]
    few = [f"<body><article><p>Few {i}</p><div class=kicker>Our house line</div></article></body>" for i in range(2)]
    same = ["<body><article><h1>Same</h1><p>copy</p></article></body>"] * 6
    rows = [*(("h", p) for p in marked_pages(6)), *(("m", p) for p in marked_pages(6, "main")), *(("h", p) for p in plain), *(("p", p) for p in plain), ("p", "<main>One marked page</main>"), *(("f", p) for p in few), *(("s", p) for p in same)]
    df = spark.createDataFrame([(i, f"http://{h}.example/{i}", p) for i, (h, p) in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    got = [r.text for r in sorted(main_texts(df).collect(), key=lambda r: r.page_id)]
    for at in (0, 6):
        assert got[at + 1] == "Head 1\n\nText 1 is new.\n\nAnd 1 more."
        assert got[at + 3] == "Head 3\n\nText 3 is new.\n\n" + "yes\n\n" * 5 + "And 3 more."
    for at in (12, 18):  # marked pages of the host leave the unmarked ones' rules alone
        assert got[at : at + 6] == [f"Plain {i}\n\nWords {i}." for i in range(6)]
    assert got[24] == "One marked page"
    assert got[25] == "Few 0\n\nOur house line"
    assert got[27] == "Same\n\ncopy"


def test_deep_pages():
    """Marks hold at any depth."""
    for n in (300, 30_000):
        assert main_text("<div>" * n + "<nav>menu</nav>in") == "in"
        assert main_text("<div>" * n + "<nav>menu</nav><article><p>a<p>b</article>") == "a\n\nb"
        assert expression(W.page_wrapper(parse("<div>" * n + "in")))


def test_long_alternations_align_in_linear_time():
    page = lambda n, k: "<article>" + "".join(f"<h2>a{i}</h2><p>b{i} {k}" for i in range(n)) + "</article>"
    tags = random.Random(1).choices(["h2", "p", "pre", "ul", "ol", "dl", "div", "table"], k=40_000)
    odd = lambda n, k: "<article>" + "".join(f"<{tags[i * k]}>{i}</{tags[i * k]}>" for i in range(n))
    w = aligned(W.page_wrapper(parse(page(10_000, 1))), W.page_wrapper(parse(page(9_000, 2))))
    assert expression(w) == "<article><article>(<h2>TEXT</h2> <p>TEXT</p>)+</article></article>"
    w = aligned(W.page_wrapper(parse(odd(20_000, 1))), W.page_wrapper(parse(odd(20_000, 2))))
    assert w[3] == 2 and len(expression(w)) > 20_000


def test_matches():
    rng = random.Random(5)
    for _ in range(300):
        x, y = (["abcdef"[rng.randrange(rng.choice([2, 6]))] for _ in range(rng.randrange(12))] for _ in range(2))
        pairs, short = W._matches(x, y), None
        W.CELLS, kept = -1, W.CELLS
        try:
            short = W._matches(x, y)
        finally:
            W.CELLS = kept
        for found in (pairs, short):
            assert all(x[i] == y[j] for i, j in found) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(found, found[1:]))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) == best[-1][-1]


def test_outcome_depends_on_no_order(spark):
    """The same wrappers however pages are dealt, and another text without them; classes are unknown words."""
    rng = random.Random(2)
    rows = []
    for i in range(60):
        more = "".join(f"<p class=q>{i} {k}</p>" + ("<em>wow</em>" if rng.random() < 0.4 else "") + ("<h2>part</h2>" if rng.random() < 0.3 else "") for k in range(rng.randrange(1, 5)))
        rows.append((i, f"http://h{i % 2}.example/{i}", f"<article><div class=zork>Read on the go</div><h1>{i}</h1>{more}<div class=blip>Never changes</div></article>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = []
    for parts in (1, 3, 7):
        dealt = df.orderBy("url" if parts == 3 else "page_id").repartition(parts)
        seen.append(({(r.host, r.branch, bytes(r.wrapper)) for r in W.wrappers(dealt).collect()}, sorted(map(tuple, main_texts(dealt).collect()))))
    assert seen[0] == seen[1] == seen[2] and len(seen[0][0]) == 2
    for i, _, text, _ in seen[0][1]:
        assert text.startswith(f"{i}\n\n{i} 0") and "go" not in text and "changes" not in text
        assert "Never changes" in main_text(rows[i][2])
