import random
import time

import pytest

from marlstone.llm.maintext import extract, main_text

LONG = "A sentence that is long enough, with commas, to be a paragraph of an article, as it were."
PAGES = {
    "plain text": ("just  text &amp; more", "just text & more"),
    "article": (f"<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>Head</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; x</footer></body></html>", f"Head {LONG} Short."),
    "no article element": (f'<body><div id="menu"><a>One</a><a>Two</a></div><div class="content"><h2>Head</h2><p>{LONG}</p><ul><li>one</li><li>two</li></ul></div><div class="sidebar"><p>{LONG}</p></div></body>', f"Head {LONG} one two"),
    "unclosed": (f"<body><article><h1>Head</h1><p><b>{LONG}<br><p>Second<p>Third", f"Head {LONG} Second Third"),
    "left-out parts inside": (
        f'<main><p>{LONG}</p><div class="ad">Buy</div><aside>Side</aside><form><input><button>Go</button></form><script>var x = "<p>no</p>";</script><style>p{{}}</style><!-- <p>no</p> --><p>End &lt;p&gt;.</p><section id="comments"><p>{LONG}</p></section></main>',
        f"{LONG} End <p>.",
    ),
    "cookie notice and share links": (f'<div class="cookie-notice"><p>{LONG} {LONG}</p></div><div class="post"><p>{LONG}</p><p>{LONG}</p><ul class="share-buttons"><li><a>t</a></li></ul></div>', f"{LONG} {LONG}"),
    "header inside the article": (f"<header>Site</header><article><header><h1>Title</h1></header><p>{LONG}</p></article>", f"Title {LONG}"),
    "title beside the text": (f"<body><h1>Title</h1><div class=text><p>{LONG}</p><p>{LONG}</p></div></body>", f"Title {LONG} {LONG}"),
    "hidden": (f'<article><p>{LONG}</p><p hidden>no</p><div style="display: none">no</div><span aria-hidden="true">no</span><p>yes</p></article>', f"{LONG} yes"),
    "sections": (f"<main><section><p>{LONG}</p></section><section><p>{LONG}</p><p>b</p></section></main>", f"{LONG} {LONG} b"),
    "table and quote": (f"<article><p>{LONG}</p><table><tr><td>a<td>b</tr></table><blockquote>q</blockquote><pre>c\n  d</pre></article>", f"{LONG} a b q c d"),
    "inline marks join": (f"<article><p>{LONG}</p><p>in<b>li</b>ne and <a href=x>link</a>.</p></article>", f"{LONG} inline and link."),
    "layout class": (f'<div class="content-with-sidebar"><p>{LONG}</p></div>', LONG),
    "crossing and stray tags": (f"<article><p>{LONG}</b></i></p></div></span><p>x</article>", f"{LONG} x"),
    "loose angle brackets": (f"<article><p>1 < 2 and 3 > 2, {LONG}</p></article>", f"1 < 2 and 3 > 2, {LONG}"),
    "references": ("<article><p>&eacute;&#233;&#xe9;&nbsp;x &unknown; &amp;amp;</p></article>", "ééé x &unknown; &amp;"),
    "markup only": ("<html><body><div></div><img src=x></body></html>", ""),
    "empty": ("", ""),
    "null": (None, ""),
    "menu only": ("<nav>a</nav><footer>b</footer>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    html, want = PAGES[name]
    assert main_text(html) == want


@pytest.mark.parametrize("outer", ["article", "main", "div class=content"])
@pytest.mark.parametrize("many,few", [(20, 2), (5, 1), (60, 1), (1, 1)])
def test_short_sections_beside_long_ones(outer, many, few):
    section = lambda name, n: f"<section><h2>{name}</h2>{f'<p>{LONG} {LONG} {LONG}</p>' * n}<p>{name} end.</p></section>"
    close = outer.split()[0]
    head = "<header><h1>Title</h1></header>" if outer != "div class=content" else "<h1>Title</h1>"
    html = f"<body><nav><a href=/>Home</a></nav><{outer}>{head}<div>{section('Long', many)}{section('Short', few)}</div><div><p>Last.</p></div></{close}><footer>x</footer></body>"
    text = main_text(html)
    assert text.count(LONG) == 3 * (many + few)
    assert text.startswith("Title Long") and text.endswith("Short end. Last.")


def test_short_container_beside_a_long_one_without_marks():
    html = f"<body><div><div>{f'<p>{LONG} {LONG}</p>' * 30}</div><div><p>{LONG} {LONG}</p></div><div><a href=/a>{LONG}</a></div></div></body>"
    assert main_text(html).count(LONG) == 62


TEXT = f"{LONG} " * 18
WRAPPERS = [
    'div class="content-sidebar-wrap"', 'div class="post share-enabled"', 'div class="article-content social"', 'div class="content sidebar-right"', 'div class="post-content related-posts-on"',
    'div class="main-column ad-free"', 'div class="story hidden-print"', 'div class="article widget-area"', 'div id="main-content-ads-free"', 'form id="aspnetForm"', 'div class="post comments-open"', 'div class="sidebar-layout"', 'div class="page widget" id="banner"',
]
BESIDE = (
    '<nav><a href="/">Home</a></nav><div class="menu main-menu"><p>Menu menu menu</p></div><div class="content-ad"><p>Buy this.</p></div><div class="sidebar"><p>Aside.</p></div><div class="sidebar-content"><p>More aside.</p></div>'
    f'<form><p>Sign up here.</p></form><div class="post-comments"><p>{LONG}</p><p>{LONG}</p></div><ol class="comments"><li><article class="comment-body"><p>{LONG}</p></article></li></ol><div class="related-posts"><p>Read on.</p></div>'
)


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("inner", ["", "main article", "article"])
def test_words_of_wrappers_lose_no_article(wrapper, inner):
    opened, closed = "".join(f"<{t}>" for t in inner.split()), "".join(f"</{t}>" for t in reversed(inner.split()))
    article = f"<h1>Head</h1><p>{TEXT}</p><p>{LONG}</p>"
    html = f"<body><header>Site</header><{wrapper}>{opened}{article}{closed}</{wrapper.split()[0]}>{BESIDE}<footer>End</footer></body>"
    assert main_text(html) == f"Head {TEXT}{LONG}"
    within = f"<body><{wrapper}>{opened}{article}{BESIDE}{closed}</{wrapper.split()[0]}></body>"
    assert main_text(within) == f"Head {TEXT}{LONG}"


def test_nothing_but_what_is_left_out():
    assert main_text(BESIDE.replace("article", "div").replace("form", "nav").replace("sidebar", "nav").replace("-ad", "-menu").replace("related", "menu")) == ""
    assert main_text('<div class="widget"><a href="/">one</a> <a href="/">two</a></div><div class="comments"><p>Nice, all of it.</p></div>') == ""
    assert main_text(f'<div class="widget"><p>{LONG}</p></div><div class="comments"><p>Nice, all of it.</p></div>') == LONG


def test_very_long_and_deep_pages():
    many = "".join(f"<p>Paragraph {i}, of many.</p>" for i in range(20000))
    assert main_text(f"<article>{many}</article>").count("Paragraph") == 20000
    assert main_text("<div>" * 3000 + LONG) == LONG
    assert main_text("<a " * 2000 + "'") is not None


def test_spark_rows(spark):
    rows = [(i, f"http://x/{i}", h, "t") for i, (h, _) in enumerate(PAGES.values())] + [(None, None, "dup", "t"), (0, "u", "dup", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    want = [(i, f"http://x/{i}", t) for i, (_, t) in enumerate(PAGES.values())] + [(None, None, "dup"), (0, "u", "dup")]
    assert sorted(map(str, [tuple(r) for r in extract(df).collect()])) == sorted(map(str, want))
    assert extract(df.limit(0)).collect() == []


def test_work_grows_with_the_page_only():

    def took(html):
        began = time.perf_counter()
        main_text(html)
        return time.perf_counter() - began

    for piece, end in (("<div>some words, and more", ""), ("<a \"", ""), ("<script ", ""), ("<div><li>item", ""), ("</b>", ""), ("<i hidden>", ""), ("<p>text <b title='a < b > c'>bold</b>", "</p>")):
        took(piece * 2000 + end)
        small, large = (min(took(piece * n + end) for _ in range(3)) for n in (2000, 20000))
        assert large < 40 * small + 0.05, piece


def scored(html):
    """The tree scoring by its definition, over ElementTree: paragraphs of plain containers, without marks that leave out or keep."""
    import xml.etree.ElementTree as ET

    root = ET.fromstring(html)
    above = {c: p for p in root.iter() for c in p}
    blocks = [(p, " ".join("".join(p.itertext()).split()), sum(len(a.text) for a in p.iter("a"))) for p in root.iter("p")]
    points = {n: {"div": 2.0, "section": 2.0, "td": 1.0, "ul": -3.0, "body": -5.0, "html": -10.0}.get(n.tag, 0.0) for n in root.iter()}
    size, linked = dict.fromkeys(points, 0), dict.fromkeys(points, 0)
    for p, text, link in blocks:
        value = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - link / len(text))
        for level, n in enumerate(ancestors := [x for x in chain_of(above, p)][1:]):
            if level < 6:
                points[n] += value / (1 if level == 0 else 2 if level == 1 else 2 * (level + 1))
        for n in [p, *ancestors]:
            size[n] += len(text)
            linked[n] += link
    worth = {n: points[n] * (1 - linked[n] / size[n]) if size[n] else 0 for n in points}
    order = list(root.iter())
    best = max((n for n in order if n.tag != "p" and size[n]), key=lambda n: (worth[n], -order.index(n)))
    if worth[best] <= 0:
        return " ".join(t for _, t, _ in blocks)
    keep = [best]
    for n in above.get(best, []):
        few = linked[n] <= size[n] / 4
        if n is not best and size[n] and few and (n.tag == "p" or worth[n] >= 3):
            keep.append(n)
    return " ".join(t for p, t, _ in blocks if any(x in keep for x in chain_of(above, p)))


def chain_of(above, n):
    while n is not None:
        yield n
        n = above.get(n)


def test_scoring_matches_brute_force():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["word", "other,", "longer", "x,"]) for _ in range(n))

    def tree(depth):
        out = []
        for _ in range(rng.randrange(1, 4)):
            if depth and rng.random() < 0.6:
                tag = rng.choice(["div", "section"])
                out.append(f"<{tag}>{tree(depth - 1)}</{tag}>")
            else:
                link = f" <a href='x'>{say(rng.randrange(1, 9))}</a>" if rng.random() < 0.4 else ""
                out.append(f"<p>{say(rng.randrange(1, 40))}{link}</p>")
        return "".join(out)

    for _ in range(300):
        html = f"<html><body>{tree(4)}</body></html>"
        assert main_text(html) == scored(html), html
