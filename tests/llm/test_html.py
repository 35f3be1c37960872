import pytest

from tierline.llm import html

PARAGRAPHS = "<p>First paragraph, with some words in it; and more.</p><p>Second one, also long enough, I say. Yes!</p>"
TEXT = "First paragraph, with some words in it; and more. Second one, also long enough, I say. Yes!"
AROUND = (
    '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><header>Site name</header>{}'
    '<aside>Side, bar text.</aside><form><label>Mail</label><input></form><footer>&copy; Site. All rights reserved.</footer>'
)


@pytest.mark.parametrize(
    "body",
    [
        "<article>{}</article>",
        "<main>{}</main>",
        '<div id="content">{}</div>',
        '<div class="wrap"><div class="post-body"><div>{}</div></div><div class="comments"><p>Great text, really. Thanks!</p></div></div>',
        '<article>{}<aside class="related">See also this, and that.</aside><div class="ad-box">Buy now!</div></article>',
        '<article>{}</article><section id="comments"><article class="comment"><p>A much longer comment than the text, with commas, and more and more of it, on and on, until it is the longest.</p></article></section>',
        '<div class="cookie-notice">We use cookies, as everybody does.</div><section class="story">{}</section>',
        "{}",
    ],
)
def test_layouts(body):
    page = "<html><head><title>T</title><style>p{}</style></head><body>" + AROUND.replace("{}", body) + "</body></html>"
    assert html.main_text(page.replace("{}", PARAGRAPHS)) == TEXT


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html></html>", ""),
        ("<script>if (a</b>) {}</script>", ""),
        ("plain text", "plain text"),
        ("<article><h1>Title</h1><p>One<br>two&nbsp;&amp;&#233; <b>bold</b>ly.<p>Three\n four</article>", "Title One two &é boldly. Three four"),
        ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
        ("<article><p>cut <b", "cut"),
        ('<article><p title="x > y">in</p><!-- <p>out</p> --></article>', "in"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>3<td>4</table></article>", "one two 3 4"),
        ("<article><p>" + "word, " * 50_000 + "</p></article>", ("word, " * 50_000).strip()),
    ],
)
def test_odd_pages(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    "wrapper",
    [
        '<article class="post comments-open">{}</article>',
        '<div id="content" class="content has-sidebar">{}</div>',
        '<main class="main no-sidebar">{}</main>',
        '<article class="sponsored">{}</article>',
        '<div class="content-sidebar-wrap"><div class="entry-content">{}</div></div>',
        '<div class="wrapper has-sidebar"><div class="post related">{}</div></div>',
        '<div style="overflow: hidden">{}</div>',
        '<article data-title="the hidden city">{}</article>',
        "<article data-x='role=menu class=\"ad\" hidden'>{}</article>",
        '<div data-hidden-by=nobody aria-label="id = search">{}</div>',
        "<section title=hidden/>{}</section>",
    ],
)
def test_words_that_name_no_landmark(wrapper):
    page = "<html><body>" + AROUND.replace("{}", wrapper) + "</body></html>"
    assert html.main_text(page.replace("{}", PARAGRAPHS)) == TEXT


@pytest.mark.parametrize(
    "landmark",
    [
        '<div title="first class trip" class="sidebar">{}</div>',
        "<div data-class='post' id=comments>{}</div>",
        '<div class="post-comments">{}</div>',
        '<div class="sidebar-content">{}</div>',
        '<div class="Menu menu-open">{}</div>',
        "<div data-x=1 HIDDEN>{}</div>",
        '<p title="x"hidden="">{}</p>',
    ],
)
def test_landmarks_among_other_attributes(landmark):
    page = "<html><body>" + AROUND.replace("{}", "<main>" + PARAGRAPHS + landmark.replace("{}", "Other text, out. Of it!") + "</main>") + "</body></html>"
    assert html.main_text(page) == TEXT


LONG = "<p>A long paragraph, with commas; and more of it. So on.</p>" * 12
SHORT = "<p>The rest of the text, much shorter, is here. It ends.</p>"


@pytest.mark.parametrize(
    "body",
    [
        '<div class="intro">{}{}</div><div class="rest">[]</div>',
        '<div class="entry-title">Title of it</div><div class="entry-content">{}[]</div>',
        '<article class="part1">{}{}</article><article class="part2">[]</article>',
        "<main><h1>Title of it</h1><article>{}[]</article></main>",
        '<div class="a"><h2>Title of it</h2><div class="b">{}{}{}</div><div class="c">[]</div></div>',
        '<div class="x">{}<div class="rest"><h3>Title of it</h3>[]</div></div>',
        "<h1>Title of it</h1><div class=one>{}</div><article>[]</article>",
    ],
)
def test_text_outside_the_heaviest_node(body):
    page = "<html><body>" + AROUND.replace("{}", body).replace("{}", LONG).replace("[]", SHORT) + "</body></html>"
    got = html.main_text(page)
    assert got.count("A long paragraph") == 12 * body.count("{}")
    assert "The rest of the text, much shorter, is here. It ends." in got
    assert ("Title of it" in got) == ("Title" in body)
    assert not {"Home", "Site", "Side", "Mail"} & set(got.replace(",", " ").split())


def test_extract_keeps_columns(spark):
    rows = [(1, "u", "<article><p>x</p></article>", "old", 9, "r"), (1, "u", "<article><p>x</p></article>", "old", 9, "r"), (None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, raw_html string")
    got = html.extract(pages)
    assert got.columns == ["page_id", "url", "raw_html", "text", "n_chars"]
    assert sorted((r.text, r.n_chars) for r in got.collect()) == [("", 0), ("x", 1), ("x", 1)]
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["research-notice", "share-price", "search-results", "widget"])
def test_no_article_is_lost_to_a_word_of_its_wrapper(name):
    for inner in ("<article>{}</article>", "{}", "<div>{}</div>"):
        page = f"<body><nav>Home</nav><div class='{name}'>{inner}</div><div class='share-box'>Tell a friend.</div></body>"
        assert html.main_text(page.replace("{}", PARAGRAPHS)) == TEXT


def test_long_landmarks_beside_content_stay_out():
    long = "<p>We use cookies, all of us, and so on and on.</p>" * 9
    for word in ("cookie-notice", "advert", "sidebar"):
        assert html.main_text(f"<body><div class='{word}'>{long}</div><article>{PARAGRAPHS}</article></body>") == TEXT
        assert html.main_text(f"<body><div class='{word}'>{long}</div><div class='post'>{PARAGRAPHS}</div></body>") == TEXT
    assert html.main_text(f"<body><div>{PARAGRAPHS}</div><div class='comments'>{long * 9}</div></body>") == TEXT


@pytest.mark.parametrize(
    "advert",
    ["<span class='advert'>Buy, now!</span>", "<ins class='adsbygoogle'>Buy <ins>more</ins>, now!</ins>", "<span hidden>Not <b>seen</b></span>", "<a class='sponsored-link' href='/x'>Buy</a>"],
)
def test_inline_adverts_and_hidden_text(advert):
    page = f"<article><p>First paragraph, {advert}with some words in it; and more.</p><p>Second one, also long enough, I say. Yes!</p></article>"
    assert html.main_text(page) == TEXT
    assert html.main_text(page.replace("</span>", "").replace("</ins>", "").replace("</a>", "")).endswith("Second one, also long enough, I say. Yes!")


@pytest.mark.parametrize("piece", ["<div>x", "<center>x", "<li>x", "<p>x", "<section>x</p>", "<font>x</b>", "<div class='post'>x", "<td>x", "<b class=ad>x"])
def test_time_grows_with_the_page_however_deep_it_nests(piece):
    import time

    start = time.perf_counter()
    found = html.main_text(piece * 20_000)
    assert time.perf_counter() - start < 3
    assert found.count("x") in (20_000, 0) or piece.startswith("<b")


def test_paths_as_tuples():
    """Path numbers against tuples of labels on a page of every kind of nesting."""
    paths, found = html.blocks("<body><div class=a><p>1<p>2<ul><li>3<li>4<ul><li>5</ul></ul></div><div class=a><p>6</div>7<table><tr><td>8<td>9</table>")

    def labels(path):
        return (*labels(paths.parent[path]), paths.label[path]) if path else ()

    assert [(labels(b.path), b.text) for b in found] == [
        (("body", "div.a", "p"), "1"),
        (("body", "div.a", "p"), "2"),
        (("body", "div.a", "ul", "li"), "3"),
        (("body", "div.a", "ul", "li"), "4"),
        (("body", "div.a", "ul", "li", "ul", "li"), "5"),
        (("body", "div.a", "p"), "6"),
        (("body",), "7"),
        (("body", "table", "td"), "8"),
        (("body", "table", "td"), "9"),
    ]
    assert all(p < i for i, p in enumerate(paths.parent) if i)
    top = next(b.path for b in found if b.text == "1")
    assert [labels(i)[:3] == labels(top) for i in range(len(paths.parent))] == paths.below({top})
    assert paths.above({top}) == {i for i in range(len(paths.parent)) if labels(top)[: len(labels(i))] == labels(i)}
