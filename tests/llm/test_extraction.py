"""op10 where the template decides: pages without an article, furniture words inside it, hostile markup."""

import time

import pytest

from turnlake.llm import html_template as H

LAYOUT = """<html><head><title>Site</title></head><body><div class="top"><span>Brand</span></div><div id="left"><ul class="links"><li><a>Home</a></li><li><a>News {i}</a></li></ul></div>
<div class="page has-sidebar"><div class="crumbs">You are here: {i}</div><div class="content">{main}</div></div><div id="bottom"><p>About this site</p></div></body></html>"""
MAIN = "<h1>Title {i}</h1><div class='long-form'><p>{a} first words of number {i} that go on for quite a while, as texts do</p><p>Shared sentence of all pages.</p></div><div class='more-link'><p>Read on in our shop</p></div>"
OTHER = """<html><body><table><tr><td class="rail"><p>Rail {i}</p></td><td class="story"><p>{a} other layout {i} with a long enough text to be the main one here</p></td></tr></table></body></html>"""


def pages():
    rows = [(i, f"http://one.example/{i}", LAYOUT.format(i=i, main=MAIN.format(i=i, a="alpha beta " * (i + 3)))) for i in range(8)]
    return rows + [(100 + i, f"http://one.example/o{i}", OTHER.format(i=i, a="gamma delta " * (i + 4))) for i in range(6)]


def test_templates_choose_the_main_slot(spark):
    rows = pages()
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    for i in range(8):
        assert got[i] == f"Title {i} {('alpha beta ' * (i + 3)).strip()} first words of number {i} that go on for quite a while, as texts do Shared sentence of all pages."
    for i in range(6):
        assert got[100 + i] == f"{('gamma delta ' * (i + 4)).strip()} other layout {i} with a long enough text to be the main one here"
    alone = {i: H.main_text(html) for i, _, html in rows}
    assert sum(alone[i] != got[i] for i in got) >= 8  # without the host's template the texts are others


@pytest.mark.parametrize(
    "html, want",
    [
        ('<article><div class="long-form"><p>Body text</p></div></article>', "Body text"),
        ('<article><div class="article-header"><h1>Head</h1></div><p>x</p></article>', "Head x"),
        ('<article><p>a</p><section id="related-work"><p>b</p></section></article>', "a b"),
        ('<body><div class="has-sidebar"><article><p>c</p></article></div></body>', "c"),
        ('<body class="sidebar"><nav>n</nav><main><header><h1>H</h1></header><p>d</p></main><footer>f</footer></body>', "H d"),
        ('<article><p>e<div class="share">s</div><ul><li>one<li>two</ul></article>', "e one two"),
        ('<article><p>a</p><section id="ads"><h2>ADS</h2><p>Anti de Sitter</p></section></article>', "a ADS Anti de Sitter"),
        ('<article><p>a</p><div id="share"><p>share of votes</p></div></article>', "a share of votes"),
        ('<article><p>a</p><section class="related"><p>related work text</p></section></article>', "a related work text"),
        ('<article><p>a</p><div class="comment"><p>the editors add</p></div></article>', "a the editors add"),
        ('<article><blockquote><p>Q</p><footer>By X</footer></blockquote><footer>f</footer></article>', "Q By X"),
        ("<main><form><p>all of the text</p><input></form></main>", "all of the text"),
        ("<main><p>a long enough first text</p><form><p>Sign up</p><input></form></main>", "a long enough first text"),
        ('<article><p>a</p><div class="ad">Buy</div><div class="related"><p><a>One</a></p><p><a>Two</a></p></div></article>', "a"),
        ('<article><p>a</p><div class="comment"><p>me too</p></div><div class="comment"><p>first</p></div></article>', "a"),
        ('<article><p>a</p><section class="comments"><p>Said</p><div class="comment"><p>me</p></div></section><div class="newsletter"><p>Join</p><input></div></article>', "a"),
        ('<div id="top"><ul><li><a>Home</a><li><a>News</a></ul></div><div><h1>H</h1><p>text of the page that is long</p></div><div class="foot">(c) us</div>', "H text of the page that is long"),
        ("<article><p>a<b>b</b>c<br>d&amp;e&#233;&nbsp;f\n g</article>", "abc d&eé f g"),
        ("<p>no body", "no body"),
        ("<article></article><nav>x</nav>", ""),
        ("<div><p>a</div></p></b>b", "a b"),
    ],
)
def test_single_pages(html, want):
    assert H.main_text(html) == want


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "</x>" * 100_000, "<div><b>" * 60_000 + "</span>" * 60_000 + "</b></div>" * 60_000, "<a '" * 150_000, "<p>x" * 150_000, "<td><h1>y" * 60_000, "<" * 400_000, "<!--" * 100_000, "&amp" * 200_000])
def test_hostile_markup_takes_linear_time(html):
    t = time.time()
    H.main_text(html)
    assert time.time() - t < 20


def test_one_article_among_copies(spark):
    html = "<html><body><nav>n</nav><article><h1>T</h1><div class='x'><p>same on all</p></div></article><div class='box'><p>p</p></div></body></html>"
    rows = [(i % 3, "http://h/", html) for i in range(6)]
    out = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 6 and {r.text for r in out} == {"T same on all"}


def test_repeated_pages_do_not_cancel(spark):
    rows = [("h", LAYOUT.format(i=i, main=MAIN.format(i=i, a="z " * i))) for i in range(4)] * 2
    one = H.templates(spark.createDataFrame(rows, "host string, html string")).first()
    two = H.templates(spark.createDataFrame(rows[:4], "host string, html string")).first()
    assert set(one.template) == set(two.template) and one.mains == two.mains


def test_classes_nest():
    T = lambda place, parent, depth, cls, pages: H.Token(place, parent, depth, 0, cls, pages, 1, 1, True)
    outer = [T(1, 0, 0, "A", 9), T(2, 1, 1, "A", 9), T(3, 2, 2, "A", 9)]
    inner = [T(4, 2, 2, "B", 5), T(5, 4, 3, "B", 5), T(6, 4, 3, "B", 5)]
    astray = [T(7, 1, 1, "C", 6), T(8, 5, 4, "C", 6), T(9, 1, 1, "C", 6)]  # partly in B, which is on fewer pages
    assert [t.place for t in H.nested([*astray, *inner, *outer])] == [1, 2, 3, 4, 5, 6]


def plain_template(pages):
    """A host's template with all pages in memory: equal occurrence vectors, nested by their elements."""
    seen = [H.Page(html).seen() for html in pages]
    vector, info = {}, {}
    for i, s in enumerate(seen):
        for place, row in s.items():
            vector.setdefault(place, {})[i] = row[0]
            t = info.setdefault(place, [row[3], row[4], row[5], 0, 0, set()])
            t[3], t[4] = max(t[3], row[0]), t[4] + row[2]
            t[5].add(row[1])
    shared = [p for p, v in vector.items() if len(v) >= H.LEAST_PAGES and len(v) >= H.LEAST_SHARE * len(pages)]
    cls = {p: tuple(sorted(vector[p].items())) for p in shared}
    members = {}
    for p in shared:
        members.setdefault(cls[p], []).append(p)
    valid = {c for c, m in members.items() if len(m) >= H.LEAST_TOKENS}

    def outside(p):
        """The nearest valid class around p's class."""
        q = info[p][0]
        while q in cls and (cls[q] == cls[p] or cls[q] not in valid):
            q = info[q][0]
        return cls.get(q)

    good = set()
    for c in valid:
        around = {outside(p) for p in members[c] if cls.get(info[p][0]) != c}
        if len(around) == 1 and all(o is None or len(o) >= len(c) for o in around):
            good.add(c)
    return {p for p in shared if cls[p] in good}, info, cls


def test_templates_equal_plain_deduction(spark):
    """Pages under neutral names, so that only the host's template tells the article."""
    import random
    import re

    rng, rows = random.Random(5), []
    say = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet elit sed do".split()) for _ in range(n))
    for h in range(3):
        for i in range(12):
            items = "".join(f"<div class='i'><span>{w}</span></div>" for w in ("one", "two", "three"))
            body = "".join(f"<div class='t'>{say(30)}</div>" for _ in range(rng.randrange(2, 6)))
            extra = f"<div class='n{h}'><ul class='u'><li class='v'>same on most</li></ul></div>" if i % 4 else ""
            rows.append((f"h{h}", f"<html><body><div class='a'>{items}</div><div class='b{h}'><div class='k'>{say(4)}</div>{body}{extra}</div><div class='c'>{say(2) if i % 5 == 0 else 'us'}</div></body></html>"))
    got = {r.host: r for r in H.templates(spark.createDataFrame(rows, "host string, html string").repartition(4)).collect()}
    for h in range(3):
        pages = [html for host, html in rows if host == f"h{h}"]
        places, info, cls = plain_template(pages)
        assert set(got[f"h{h}"].template) == places and places
        for html in pages:
            want = re.search(rf"<div class='b{h}'>(.*)</div><div class='c'>", html)[1].replace("same on most", "")
            text = H.main_text(html, got[f"h{h}"].mains, frozenset(got[f"h{h}"].constants))
            assert text == " ".join(re.sub("<[^>]*>", " ", want).split())
