import re
import time

from stridegrid.llm.html_text import blocks_of, extract_text, main_text, path_scores

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div class="ad">Buy now, today.</div><!-- a > b --><div class="cookie-notice"><p>We use cookies, ok?</p></div>
<article><header><h1>Head &amp; tail</h1></header><p><b>One<br>two&nbsp;three, four.<p>Long   paragraph of text,
 with more words; and more.</p><ul><li>first<li>second</ul><form><input><button>Send</button></form>
<table><tr><td>a<td>b</table><p>x<div class="comments"><p>Reader words, many of them, here.</p></div></article>
<aside>Side</aside><section id="comments"><p>More reader words, more.</p></section><footer>&copy; me</footer></body></html>"""


def test_article_without_page_furniture():
    assert main_text(PAGE).split("\n") == [
        "Head & tail",
        "One two three, four.",
        "Long paragraph of text, with more words; and more.",
        "first",
        "second",
        "a",
        "b",
        "x",
    ]


def test_page_without_article_takes_the_content_paths():
    page = """<body><div id="menu"><a href=a>Home page of us</a> <a href=b>About all of us</a></div>
    <div class="story"><h2>Title here</h2><p>First paragraph, long enough, of text.</p><p>Second one, as long, of text.</p>
    <p>Short.</p></div><div class="links"><a href=c>One link of many</a> <a href=d>And another link</a></div></body>"""
    assert main_text(page).split("\n") == [
        "Title here",
        "First paragraph, long enough, of text.",
        "Second one, as long, of text.",
        "Short.",
    ]


STORY = [f"Part {i} of the story, long enough to count as text, with marks; and with more words." for i in range(4)]


def test_all_articles_of_a_story_and_the_head_of_main_are_kept():
    several = "".join(f"<article><p>{x}</p></article>" for x in STORY)
    assert main_text(f"<body>{several}</body>").split("\n") == STORY
    assert main_text(f"<body><div><article><p>{STORY[0]}</p></article></div><p>{STORY[1]}</p></body>").split("\n") == STORY[:2]
    story = "".join(f"<p>{x}</p>" for x in STORY)
    page = f"""<body><nav>Menu</nav><main><header><h1>Head</h1></header><p class="lede">Short lede.</p><article>{story}
    <ul><li>a<li>b</ul></article><div class="cards"><p>Other.</p></div><p><a href=x>more</a></p></main></body>"""
    assert main_text(page).split("\n") == ["Head", "Short lede.", *STORY, "a", "b"]


def test_a_teaser_card_does_not_replace_the_story():
    story = "".join(f"<p>{x}</p>" for x in STORY)
    page = f"""<body><div class="story"><h2>Head</h2>{story}</div>
    <div class="cards"><article class="card"><h3>Card</h3><p>Read.</p></article></div></body>"""
    assert main_text(page).split("\n") == ["Head", *STORY]


def test_path_scores_put_text_over_links():
    blocks, _ = blocks_of("<body><p>Some text, some more.</p><ul><li><a>link</a></li></ul></body>")
    scores = path_scores(blocks)
    assert scores[("#page", "body", "p")] > scores[("#page", "body", "ul", "li")] == 0


def test_names_that_tell_of_the_page_do_not_hide_the_story():
    story = "".join(f"<p>{x}</p>" for x in STORY)
    for names in ('class="content no-sidebar"', 'class="post comments-open"', 'id="with-sidebar"', 'class="has-nav"'):
        assert main_text(f"<body><nav>Menu</nav><div {names}>{story}</div></body>").split("\n") == STORY


def test_wrappers_of_the_page_stay_and_listed_parts_go():
    story = "".join(f"<p>{x}</p>" for x in STORY)
    form = f"""<body><div class="top">Site</div><form id="aspnetForm"><div class="menu">Menu</div><h1>Head</h1><div>{story}</div>
    <form><p>Search here, now.</p></form></form></body>"""
    assert main_text(form).split("\n")[:5] == ["Head", *STORY]
    assert "Menu" not in main_text(form)
    area = f'<body><div class="widget-area"><article>{story}</article><div class="comments">{story * 9}</div></div></body>'
    assert main_text(area).split("\n") == STORY
    for words in ("comments", "ad", "newsletter"):
        assert main_text(f'<body><article><p>Short, yes.</p></article><div class="{words}">{story}</div></body>') == "Short, yes."
    assert main_text(f'<body><h1>Head</h1><p>Short, yes.</p><section id="comments">{story}</section></body>') == "Head\nShort, yes."


def test_stray_quotes_in_tags():
    story = "".join(f"<p>{x}</p>" for x in STORY)
    assert main_text(f"<body><p title=Bob's>One, two, three.</p>{story}<p>It isn't so, it is.</p></body>").count("\n") == 5
    page = f"""<body><p class="a"">One, two.</p>{story}</body>"""
    assert "<" not in main_text(page) and '"' not in main_text(page)
    assert main_text(f'<article><p title="never closed>One, two.</p>{story}</article>').startswith("One, two.")
    assert main_text("<article><p data-x='a > b' hidden=\"\">x</p><p>y</p></article>") == "y"


def test_deep_and_broken_pages_take_linear_time():
    for page in (
        "<div>" * 20_000 + "x, y." + "</div>" * 20_000,
        "<div>a, b." * 20_000,
        "<div>" * 20_000 + "</b>" * 20_000 + "x",
        "<li>" * 20_000,
        "<p title='x\">" * 20_000,
        "<a b=c" * 50_000,
    ):
        begun = time.monotonic()
        main_text(page)
        assert time.monotonic() - begun < 12


def _scores_by_hand(blocks):
    """The rule of the paths, block by block, without arrays."""
    paths = [b.element.path.labels() for b in blocks]
    order = list(dict.fromkeys(paths))
    raw = {}
    for p in order:
        texts = [b.text for b, q in zip(blocks, paths, strict=True) if q == p]
        raw[p] = (sum(map(len, texts)) / len(texts), sum(len(re.findall(r"[.,;:!?…]", t)) for t in texts) / len(texts))
    out = {}
    for p in order:
        row = [q for q in order if q[:-1] == p[:-1]]
        i = row.index(p)
        left, right = row[max(0, i - 1)], row[min(len(row) - 1, i + 1)]
        text, marks = (0.5 * raw[p][k] + 0.25 * raw[left][k] + 0.25 * raw[right][k] for k in (0, 1))
        mine = [b for b, q in zip(blocks, paths, strict=True) if q == p]
        links = sum(b.link_chars for b in mine) / sum(len(b.text) for b in mine)
        out[p] = 0.0 if any(b.element.firm for b in mine) else text * (1 + marks) * (1 - min(1, links))
    return out


def test_path_scores_equal_the_rule_by_hand():
    story = "".join(f"<p class=k{i % 2}>{x}</p><h{i % 3 + 1}>Head {i}!</h{i % 3 + 1}>" for i, x in enumerate(STORY * 3))
    page = f"<body><nav><a>Menu, menu</a></nav><div>{story}</div><ul><li><a>one</a> two, three.<li>four</ul><p>End.</p></body>"
    blocks, _ = blocks_of(page)
    got, wanted = path_scores([b for b in blocks if not b.element.firm]), _scores_by_hand([b for b in blocks if not b.element.firm])
    assert got.keys() == wanted.keys()
    assert all(abs(got[p] - wanted[p]) < 1e-9 for p in got)


def test_broken_markup_is_read_as_far_as_it_goes():
    assert main_text("<article><p>cut <b>short") == "cut short"
    assert main_text("plain text only") == "plain text only"
    assert main_text("<p>a < b &lt; c &#x41; &bogus;</p>") == "a < b < c A &bogus;"
    assert main_text("<script>never closed") == ""
    assert main_text("<p hidden>x</p>") == ""
    assert main_text("<article><!-- open comment <p>x</p>") == ""


def test_rows(spark):
    rows = [(1, "u", PAGE, "a"), (1, "u", PAGE, "a"), (2, None, None, "b"), (None, "v", "", "c"), (3, "w", "<p>é😀</p>" * 3000, "d")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = extract_text(pages).collect()
    assert [(r.page_id, r.url) for r in got] == [(1, "u"), (1, "u"), (2, None), (None, "v"), (3, "w")]
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0
    assert got[4].n_chars == 3 * 3000 - 1
    assert extract_text(pages.where("false")).count() == 0
