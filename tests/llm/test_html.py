import random

import pytest

from assetweave.llm import html as d

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy now, it is cheap.</div>
<{tag}><h1>Head &amp;amp; &quot;line&quot;</h1><p><b>Bold <i>text</i><br>goes&nbsp; on.<br><p>Second
 par &lt;b&gt;.</p><div class="cookie-notice">Cookies!</div><p>Third {extra}</p><ul><li>one<li>two</ul>
<section id="comments"><p>First!</p></section></{end}><aside>Side</aside><form><p>Mail</p></form><footer>&copy; me</footer></body></html>"""
TEXT = 'Head &amp; "line"\n\nBold text goes on.\n\nSecond par <b>.\n\nThird {extra}\n\none\n\ntwo'


def run(spark, rows):
    got = d.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return {r.page_id: r.text for r in got.collect()}


def test_article_of_hosts_with_different_layouts(spark):
    rows, want = [], {}
    for i in range(30):
        tag = ["article", 'div class="post body-12"', "main"][i % 3]
        extra = f"number {i} " * (i + 1)
        rows.append((i, f"https://h{i % 3}.example.com/{i}", PAGE.format(tag=tag, end=tag.split()[0], extra=extra)))
        want[i] = TEXT.format(extra=extra.strip())
    assert run(spark, rows) == want


def test_consensus_beats_a_page_of_its_own(spark):
    """A page whose longest container is another one follows its host."""
    usual = "<body><div class='a'><p>{}</p></div><div class='b'><p>{}</p></div></body>"
    rows = [(i, "http://h.example.com/", usual.format("long text here " * 9, "short")) for i in range(8)]
    rows.append((8, "http://h.example.com/", usual.format("brief", "this one is much longer " * 20)))
    got = run(spark, rows)
    assert got[8] == "brief" and got[0] == ("long text here " * 9).strip()
    mark = bytes(d.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).first().mark)
    page = d.Page(rows[0][2])
    assert page.path(page.find(mark)) == "body/div.a"


def test_cut_and_broken_pages():
    read = lambda h: [b[1] for b in d.Page(h).blocks if not b[3] & d.HARD]
    assert read("<article><p>One &am") == ["One &am"]
    assert read("<article><p>One &amp") == ["One &"]
    assert read("<article><p>One</p><p clas") == ["One"]
    assert read('<article><p>One</p><a href="x') == ["One"]
    assert read("<p>a < b and 1 <2</p><script>if (a") == ["a < b and 1 <2"]
    assert read("<p>x<!-- never closed <p>y") == ["x"]
    assert read("</div></p>a<p>b</section>c") == ["a", "b", "c"]
    assert read("<p title=\"a>b\" data-x='<p>'>in</p>") == ["in"]
    assert read("<P>Up</P><TEXTAREA><p>no</p></TEXTAREA><p>yes") == ["Up", "yes"]
    assert read("<p>&#233;&#x20ac;&notin;&unknown;</p>") == ["é€∉&unknown;"]
    assert read("<p><a href=x>linked <p>not") == ["linked", "not"]


def test_null_empty_repeated_and_long(spark):
    long = "<body><article>" + "".join(f"<p>word {i}</p>" for i in range(20_000)) + "</article></body>"
    got = run(spark, [(1, "http://a.example/", None), (2, None, ""), (3, None, "<nav>only menu</nav>"), (4, "bad url", "<p>plain</p>"), (4, "bad url", "<p>plain</p>"),
                      (5, "http://l.example/", long), (None, "http://l.example/", "no markup")])
    assert got[1] == got[2] == got[3] == "" and got[4] == "plain" and got[None] == "no markup"
    assert got[5] == "\n\n".join(f"word {i}" for i in range(20_000))


def test_deep_nesting_and_empty_table(spark):
    assert len(d.Page("<div>" * 3000 + "x").blocks) == 1
    assert run(spark, []) == {}
    df = spark.sql("select 1L page_id, 'http://a.example/' url, '<p>x</p>' html, 'mine' path, 'h' host, 't' text")
    assert d.extract(df).first().text == "x"


def brute_text(html, mark=None):
    """Scores by slicing every path of every block, as the definition says."""
    page = d.Page(html)
    blocks = [(page.path(n).split("/") if n else [], *rest) for n, *rest in page.blocks]
    scores = {}
    for path, text, linked, why, _ in blocks:
        if why & (page._never | d.HEAD):
            continue
        worth = max(0, len(text) - 2 * linked)
        own = path[:-1] if path and path[-1].split(".")[0] in d.LEAVES else path
        for k in range(len(own), 0, -1):
            if own[k - 1].split(".")[0] in ("html", "body") and k < len(own):
                break
            scores[tuple(own[:k])] = scores.get(tuple(own[:k]), 0) + worth
            worth /= 2
    best = max(scores.values(), default=0)
    return {"/".join(p): s / best for p, s in scores.items() if s > 0} if best > 0 else {}


def test_scores_equal_their_definition():
    made = random.Random(3)
    tags = ["div", "div class=a", "section", "p", "li", "ul", "article", "body", "header", "h1", "div class='menu'", "b", "a href=x", "nav", "/div", "/p", "/ul", "/a"]
    for _ in range(300):
        html = "".join(f"<{made.choice(tags)}>" + "word " * made.randrange(4) for _ in range(made.randrange(40)))
        page = d.Page(html)
        got = {page.path(page.find(m)): s for m, _, s in page.votes()}
        want = brute_text(html)
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


@pytest.mark.parametrize("name, kept", [
    ("content no-sidebar", True), ("has-menu", True), ("post social-science", True), ("ad-free", True), ("comment-free", True), ("sidebar", False),
    ("left sidebar2", False), ("cookie-notice", False), ("sidebar-left", False), ("entry post-content", True), ("cookieBanner", False),
    ("shared-values", True), ("header-image-article", True), ("adventure", True), ("post-comments", False)])
def test_class_names_count_as_a_whole(name, kept):
    html = f'<body><div class="{name}"><p>{"An article goes here. " * 3}</p></div><div><p>Other text.</p></div></body>'
    assert ("An article" in " ".join(d.Page(html).under(0))) == kept
    marked = f'<body><section id="{name}"><p>Long text.</p></section><p>Other.</p></body>'
    assert ("Long" in " ".join(d.Page(marked).under(0))) == kept


def test_class_names_that_would_leave_nothing_do_not_count():
    html = '<body><div class="sidebar"><p>' + "The whole article is in here. " * 9 + '</p></div><nav>Menu</nav></body>'
    assert d.Page(html).text(None).startswith("The whole article") and "Menu" not in d.Page(html).text(None)
    assert d.Page('<body><div class="menu">Home</div></body>').text(None) == ""


def test_headers_of_page_and_article():
    assert d.Page("<body><header>Tagline</header><p>One text.</p></body>").text(None) == "One text."
    assert d.Page("<body><header><h1>Site</h1></header><p>One text.</p></body>").text(None) == "One text."
    assert d.Page("<body><header>Site</header><article><header><h1>Title</h1></header><p>One text.</p></article></body>").text(None) == "Title\n\nOne text."
    assert d.Page("<body><header>Site</header><div class=post><header><h1>Title</h1></header><p>One text.</p></div></body>").text(None) == "Title\n\nOne text."


def test_deep_pages_take_time_in_proportion():
    import time
    begun = time.time()
    page = d.Page("".join(f"<div>x{i}" for i in range(3000)))
    assert len(page.blocks) == 3000 and len(page.votes()) > 10
    page.text(None)
    assert time.time() - begun < 1
    begun = time.time()
    d.Page("<ul><li>" * 3000 + "x" + "</li></ul>" * 3000).text(None)
    d.Page("<b class=ad><p>" * 3000 + "</i>" * 3000).text(None)
    assert time.time() - begun < 2
