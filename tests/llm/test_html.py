import pytest

from palisade.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<!-- ad --><div class="ad">Buy &amp; save</div><article class="post p%d"><h1>Head &amp; tail</h1><p><b>First&nbsp; words<br><p>A  &lt;second&gt;
block <a href="#">linked</a></p><aside>side</aside><form>mail <input></form></article><div id="comments"><p>A reader's long comment, longer than the whole article, goes on and on and on and on.</p></div><footer>&copy; x</footer>"""


def test_article():
    page = PAGE % 7
    (path, _), *_ = html.score_containers(page)
    assert path == ">html>body>article.post"
    assert html.extract(page, path) == "Head & tail\nFirst words\nA <second> block linked"


@pytest.mark.parametrize(("page", "text"), [("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<div>a<br>b</div>", "a b"), ("<p title='x>y'>a</p><p", "a"), ("<script>x", ""), ("a &#8364; &amp;amp; b", "a € &amp; b"), ("<ul><li>a<li>b</ul>", "a\nb"), ("<p>a<!-- b --></p><![CDATA[c]]>", "a\nc"), ("<main><div class='cookie-notice'>x</div><p>y</main>", "y")])
def test_pages(page, text):
    assert html.extract(page, None) == text


def test_votes_decide(spark):
    good = "<html><body><div class='main%d'><p>%s</p></div><div class='box'><p>%s</p></div></body></html>"
    rows = [(i, "https://u:p@Host.example:80/a", good % (i, "article " * 30, "box " * 3)) for i in range(9)]
    # one page whose box is longer than its article: the host's other pages decide
    rows += [(9, "http://host.example", good % (9, "article " * 5, "box " * 60)), (10, None, "<p>own</p>"), (11, "http://b.example/", None), (12, "http://host.example", "<section><p>no such path</p></section>"), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in html.main_text(df).collect()}
    assert html.main_text(df).count() == 14
    assert got[9].text == ("article " * 5).strip() and got[10].text == "own" and got[11].text == "" and got[11].n_chars == 0 and got[12].text == "no such path"
    assert {r.host: r.path for r in html.host_paths(df).collect()}["host.example"] == ">html>body>div.main"
    assert html.main_text(df.limit(0)).count() == 0


def test_shuffled_way(spark, monkeypatch):
    monkeypatch.setattr(html, "small", lambda df, rows=0: df)
    df = spark.createDataFrame([(i, "http://h/", PAGE % i) for i in range(20)], "page_id long, url string, html string")
    assert {r.text for r in html.main_text(df).collect()} == {"Head & tail\nFirst words\nA <second> block linked"}


TEXT = "long text of the page " * 20


@pytest.mark.parametrize(("page", "text"), [
    (f"<body><article><h1>T</h1><p>lead</p><div class=body>{TEXT}</div></article><div>x</div></body>", f"T\nlead\n{TEXT.strip()}"),
    (f"<body><main><section class=a><p>one</p></section><p>between</p><section class=b>{TEXT}</section></main></body>", f"one\nbetween\n{TEXT.strip()}"),
    (f"<body><div class=post><h1>T</h1><div class=wrap><div class=body>{TEXT}</div></div></div><div class=box>box</div></body>", f"T\n{TEXT.strip()}"),
    (f"<body><div class='content has-sidebar'><p>{TEXT}</p></div></body>", TEXT.strip()),
    (f"<body><article><div class=post-header><h1>T</h1></div><p>{TEXT}</p></article></body>", f"T\n{TEXT.strip()}"),
    (f"<body><p>x</p><div class=widget><p>{TEXT}</p><nav>menu</nav></div></body>", f"x\n{TEXT.strip()}"),
])
def test_whole_text_around_the_best_container(spark, page, text):
    assert html.extract(page, html.score_containers(page, 1)[0][0]) == text
    df = spark.createDataFrame([(1, "http://h/", page)], "page_id long, url string, html string")
    assert [r.text for r in html.main_text(df).collect()] == [text]


@pytest.mark.parametrize("name", ["elementor-widget", "content-header", "widget widget_text", "social-study", "wrap share-wrapper"])
def test_weak_words_do_not_drop_the_article(name):
    page = f"<body><h1>Title</h1><p>{'A lead of some length. ' * 8}</p><div class='{name}'><p>{TEXT}</p></div><div class='{name}'><a href=x>one link</a> | <a href=y>another</a></div><div class=comments><p>{TEXT * 3}</p></div></body>"
    got = html.extract(page, html.score_containers(page, 1)[0][0])
    assert TEXT.strip() in got and got.count(TEXT.strip()) == 1 and "Title" in got


def test_own_header_stays():
    for page in (f"<body><article><header class='entry-header'><h1>T</h1></header><p>{TEXT}</p></article></body>", f"<body><header>Site</header><div class=post><header class='entry-header'><h1>T</h1></header><p>{TEXT}</p></div></body>"):
        assert html.extract(page, html.score_containers(page, 1)[0][0]) == f"T\n{TEXT.strip()}"


def test_all_parts_of_an_article():
    page = f"<body><article><div class=a>{TEXT}</div><pre>code here</pre><div class=b>{TEXT}</div></article></body>"
    assert html.extract(page, html.score_containers(page, 1)[0][0]) == f"{TEXT.strip()}\ncode here\n{TEXT.strip()}"


def test_clashing_columns_and_long_pages(spark):
    long = "<body><article>" + "".join(f"<p>paragraph {i} &amp; more</p>" for i in range(20_000)) + "</article></body>"
    df = spark.createDataFrame([(1, "http://h/", long, "x", "y", "z", 7), (2, "http://h/", None, None, None, None, None)], "page_id long, url string, html string, text string, host string, path string, n_chars int")
    got = {r.page_id: r for r in html.main_text(df).collect()}
    assert got[1].text == "\n".join(f"paragraph {i} & more" for i in range(20_000)) and got[1].n_chars == len(got[1].text)
    assert (got[1].host, got[1].path, got[2].text, got[2].n_chars) == ("y", "z", "", 0)


def test_random_pages_equal_their_articles(spark):
    """Pages put together from known parts: what comes out is the article's own blocks, all of them."""
    import random

    rng = random.Random(4)
    word = lambda: rng.choice(["stone", "r&eacute;sum&eacute;", "a&amp;b", "light", "paper", "green"])
    plain = lambda t: t.replace("&eacute;", "é").replace("&amp;", "&")
    rows, want = [], {}
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 9))]
        wrap = [rng.choice(["<p>{}</p>", "<div class=x%d>{}</div>" % i, "<pre>{}</pre>", "<ul><li>{}</ul>", "<blockquote><p>{}</blockquote>", "<table><tr><td>{}</table>"]).format(p.replace(" ", rng.choice([" ", "\n ", "&nbsp;", " <b></b>"]))) for p in parts]
        noise = lambda: rng.choice(["<nav><a href=x>menu</a></nav>", "<aside>side</aside>", "<div class=ads>buy</div>", "<!-- c -->", "<script>if (a<b) {}</script>", "<form>mail</form>"])
        rows.append((i, f"http://host{i % 3}/", f"<html><body><header><h2>Site</h2></header>{noise()}<article>{''.join(w + (noise() if rng.random() < 0.3 else '') for w in wrap)}</article>{noise()}<footer>foot</footer></body></html>"))
        want[i] = "\n".join(map(plain, parts))
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
