import time

from cohorte.llm.html_text import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar comments-open"><header class="site"><h1>Site</h1></header><div id=menu><a href=1>A</a> <a>B</a></div>
<form action=x><div class=content><article class=post><h1>Title &eacute; &amp;</h1><p class=lead>First, para<br>graph <a href=x>link</a>.
<p><b>bold</b> text &lt;kept&gt;<ul><li>one<li>two</ul><!-- no <p>comment</p> --><div class="ad-slot">Buy</div>
<table><tr><td>a<td>b</table><aside>side</aside><p hidden>no</p><div style="display: none">no</div><pre>x  y</pre></article></div></form>
<div class="comments"><article class=comment><p>I think, well, that this is a very long comment with many, many commas, and words, and so on.</p></article></div>
<div class=cookie-notice>We use</div><footer>f</footer></body>"""


def test_article_only():
    want = ["Title é &", "First, para graph link.", "bold text <kept>", "one", "two", "a", "b", "x y"]
    assert main_text(PAGE) == "\n\n".join(want)


def test_without_article_the_best_container_and_siblings():
    p = "<p>Some words, quite a few of them, that make a paragraph long enough to matter for the score, as it should be.</p>"
    page = f"<body><div><a>Home</a> <a>About</a> <a>More</a></div><div><div>{p * 4}</div><div>{p * 2}</div></div><div class=sidebar>{p}</div></body>"
    assert main_text(page).count("Some words") == 6 and "Home" not in main_text(page) and main_text(page).count("\n\n") == 5


P = "<p>Some words, quite a few of them, that make a paragraph long enough to matter for the score, as it should be.</p>"


def test_names_mark_as_a_whole_and_never_headings():
    kept = "<h2 id=related-work>A</h2><h2 id=cookies>B</h2><h2 id=search>C</h2><section id=comments-on-the-proof><p>D</p></section><p class=sharing-economy>E</p>"
    gone = "<div class='ad-slot-2'>x</div><div id=relatedPosts>x</div><section class='box newsletter-signup'>x</section><p class=advert>x</p><div class=cookie_notice>x</div>"
    assert main_text(f"<article>{P}{kept}{gone}</article>").split("\n\n")[1:] == list("ABCDE")


def test_what_stands_beside_the_best_element():
    page = f"<body><div class=nav><a>x</a></div><div class=page><h1>Title</h1><div class=body>{P * 4}</div><ul><li>one<li>two</ul><table><tr><td>c</table><pre>code</pre><p>Short end</p><div><a>l1</a> <a>l2</a></div></div><div class=footer>f</div>"
    assert [b[:9] for b in main_text(page).split("\n\n")] == ["Title", *["Some word"] * 4, "one", "two", "c", "code", "Short end"]


def test_headline_and_links_of_an_article():
    page = f"<header><h1>Site</h1></header><article><header><h1>Headline</h1></header>{P}<ul><li><a>one</a><li><a>two</a><li><a>three</a></ul></article>"
    assert main_text(page).split("\n\n")[0] == "Headline" and main_text(page).endswith("one\n\ntwo\n\nthree")


def test_long_attributes_are_no_text():
    data = "x > y < z " * 5000
    for q in "\"'":
        assert main_text(f"<article><div data-x={q}{data}{q}><p>text <img alt = {q}a > b{q}> more</p></div></article>") == "text more"
    assert main_text('<article><p a"b>quote</p></article>') == "quote"


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text("just text &amp more") == "just text & more"
    assert main_text("<article><p>cut &am") == "cut &am"
    assert main_text("<article><p>a</div></b>b<script>x") == "ab"
    assert main_text("<article><p>one<p>one</article>") == "one\n\none"


def test_hostile_pages_are_fast():
    began = time.time()
    for page in ("<" * 50_000, "<a " * 30_000, "<div>" * 30_000 + "x", "<p>" * 30_000, '<a "' * 20_000, "&" * 100_000, "<b>" * 20_000 + "t", "<!--" * 20_000, "</p>" * 50_000, '<a ="' * 20_000, "<a ='<b =\"" * 15_000, "<a " + '="x' * 30_000, "<a =" * 30_000):
        main_text(page)
    assert time.time() - began < 30


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "<article><p>" + "long " * 100_000, "x")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got[2:4]] == [(2, None, 0), (None, "v", 0)]
    assert got[0] == got[1] and got[0].n_chars == len(got[0].text) and got[4].n_chars == 499_999
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
