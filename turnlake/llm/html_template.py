"""Main text of pages by equivalence-class template deduction.

Pages of a host come from templates. A token is an element in its place: the path of open
elements with their class, id and role names, digits left out. Tokens that occur equally
often on the same pages of a host share an occurrence vector and so an equivalence class.
Vectors are compared by two sums of page hashes, so a host of any size is a plain
aggregate, and repeated pages do not cancel. A class is valid with several tokens on
enough pages; classes nest where their tokens lie: all of a class's outer tokens must lie
in one class on at least as many pages. What nests in order is the host's template.

An element of the template is a slot where its text differs between pages. The main slot
is found from the root down: into the inner slot that holds nearly all page-specific text, or
into one for each layout of the host, as long as no page-specific heading stays outside. An
article or main element is a cue: it may hold less of the text, and the search ends there. A page's text is what its main slot holds, without elements that
are furniture by role (navigation, forms, adverts, comments, scripts; in an article a
name needs a second sign, such as links) and without named
blocks that say the same on most pages of the host. Other repeated text stays: articles
may quote each other. A page of a host without a template is treated as a template of its
own, all of whose text is page-specific.

Edge cases: null html is an empty page with text ''; a null or odd URL is a host of its
own; tags left open, closed twice or nested to any depth cost time in proportion; a host
whose pages are all the same keeps its main slot by length; repeated rows and repeated
page_ids repeat; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from turnlake.llm.common import bounded_batches, materialize

#: A class is valid with so many tokens, on so many pages and on this share of the host's.
LEAST_TOKENS, LEAST_PAGES, LEAST_SHARE = 3, 3, 0.3
#: Of the page-specific text around it, what an inner slot must hold to be the main one; as an article.
MAIN_SHARE, ARTICLE_SHARE = 0.8, 0.5
#: A named block that says the same on this share of the main slot's pages is template.
CONSTANT_SHARE = 0.5

#: Elements and whole class, id or role names of page furniture; fixed values.
FURNITURE_TAGS = frozenset("aside button datalist dialog footer form header iframe menu nav noscript object select style script svg template textarea title head".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments cookie cookies cookie-banner cookie-consent cookie-notice consent disqus gdpr modal nav navbar navigation newsletter popup promo promoted related related-articles related-posts share sharing sidebar signup social social-share sponsor sponsored subscribe toolbar widget".split()
)
#: Furniture outside articles only.
OUTER_NAMES = frozenset("banner colophon copyright foot footer header login masthead menu notice notices search site-footer site-header".split())
ARTICLE_TAGS = frozenset(("article", "main"))
CONTAINERS = frozenset("#root html body div main section article center table tbody tr td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag closes these open elements first.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)} | {
    t: ("p",) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()
}
#: Closing tags of inline elements, paragraphs and list items do not reach beyond these.
_STOP = frozenset(("article", "aside", "body", "div", "dl", "footer", "form", "header", "html", "main", "nav", "ol", "section", "table", "td", "th", "ul"))
_SCOPED = INLINE | {"p", "li"}

_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<close>/)?(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|[!?/][^>]*(?:>|\Z))", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile(r"[0-9]+")
_MASK = (1 << 31) - 1

CONTAINER, ARTICLE, HEADING, NAMED, FURNITURE = 1, 2, 4, 8, 16


#: Why an element may be furniture: surely, by a name inside an article, a form, a menu by its links.
SURE, NAME, FORM, LINKS = 1, 2, 3, 4
#: Text in links that makes a block a menu: of a named one in an article, of any outside one.
NAMED_LINKS, MENU_LINKS = 0.5, 0.8
CONTROLS = frozenset("button input option select textarea".split())
PROSE = frozenset("blockquote dd figure h1 h2 h3 h4 h5 h6 p pre table".split())


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) >> 1


class Page:
    """A page's elements in document order and its pieces of text (None: a block's border).

    An element holds pieces first to last; kind is a set of the bits above."""

    __slots__ = ("tags", "places", "parents", "depths", "kinds", "in_article", "first", "last", "pieces", "owners", "whys", "quoted")

    def __init__(self, html: str):
        self.tags: list[str] = []
        self.places: list[int] = []
        self.parents: list[int] = []
        self.depths: list[int] = []
        self.kinds: list[int] = []
        self.in_article: list[bool] = []
        self.first: list[int] = []
        self.last: list[int] = []
        self.pieces: list[str | None] = []
        self.owners: list[int] = []
        self.whys: list[int] = []
        self.quoted: list[bool] = []
        self._parse(html)
        self._judge()

    def _open(self, tag: str, rest: str, parent: int) -> int:
        names = []
        if rest and "=" in rest:
            for m in _NAMES.finditer(rest):
                names += (m[1] or m[2] or m[3] or "").lower().split()
        names = sorted(n for n in (_DIGITS.sub("", x) for x in names) if n)
        inside = parent >= 0 and self.in_article[parent]
        kind = CONTAINER if tag in CONTAINERS else 0
        if tag in ARTICLE_TAGS:
            kind |= ARTICLE
        elif tag in ("h1", "h2"):
            kind |= HEADING
        if names and tag not in INLINE and tag not in ("html", "body"):
            kind |= NAMED
        why = 0
        if tag == "form":
            why = FORM
        elif tag in FURNITURE_TAGS and not (inside and (tag == "header" or tag == "footer" and self.quoted[parent])):
            why = SURE
        elif tag not in ("html", "body") and tag not in ARTICLE_TAGS:
            if any(n in FURNITURE_NAMES for n in names):
                why = NAME if inside else SURE
            elif not inside and any(n in OUTER_NAMES for n in names):
                why = SURE
        self.whys.append(why)
        self.quoted.append(tag == "blockquote" or parent >= 0 and self.quoted[parent])
        self.tags.append(tag)
        self.places.append(_hash(f"{self.places[parent] if parent >= 0 else 0}/{tag}.{'.'.join(names)}"))
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1 if parent >= 0 else 0)
        self.kinds.append(kind)
        self.in_article.append(inside or tag in ARTICLE_TAGS)
        self.first.append(len(self.pieces))
        self.last.append(len(self.pieces))
        return len(self.tags) - 1

    def _parse(self, html: str) -> None:
        stack = [self._open("#root", "", -1)]
        where: dict[str, list[int]] = defaultdict(list)  # tag -> places of its open elements in the stack
        stops: list[int] = []

        def close(k: int) -> None:
            while len(stack) > k:
                e = stack.pop()
                self.last[e] = len(self.pieces)
                where[self.tags[e]].pop()
                if self.tags[e] in _STOP:
                    stops.pop()

        def piece(x: str | None) -> None:
            self.pieces.append(x)
            self.owners.append(stack[-1])

        at, n = 0, len(html)
        while at < n:
            m = _TAG.search(html, at)
            if m is None:
                piece(html[at:])
                break
            if m.start() > at:
                piece(html[at : m.start()])
            at = m.end()
            if not m["name"]:
                continue
            tag = m["name"].lower()
            if tag not in INLINE:
                piece(None)
            stop = stops[-1] if stops else 0
            if m["close"]:
                if where[tag] and not (tag in _SCOPED and where[tag][-1] < stop):
                    close(where[tag][-1])
                continue
            if tag in CLOSES:
                k = max((where[t][-1] for t in CLOSES[tag] if where[t]), default=0)
                if k and k >= stop:
                    close(k)
            e = self._open(tag, m["rest"], stack[-1])
            if tag in VOID or m["rest"].rstrip().endswith("/"):
                continue
            if tag in RAW:
                end = _raw_end(tag)(html, at)
                at = end.end() if end else n
                continue
            where[tag].append(len(stack))
            if tag in _STOP:
                stops.append(len(stack))
            stack.append(e)
        close(0 + 1)
        self.last[0] = len(self.pieces)

    def _judge(self) -> None:
        """Mark furniture. A name inside an article needs a second sign: links, form controls,
        repeated items, another such name in it, or bare text without paragraphs. A form that
        wraps an article, a heading of the page or most of its text is none. On pages without
        an article, blocks of links are menus."""
        n = len(self.tags)
        chars, linked, links, controls, prose, wraps, names = ([0] * n for _ in range(7))
        children: list[Counter] = [Counter() if self.whys[e] == NAME else None for e in range(n)]
        for x, o in zip(self.pieces, self.owners):
            if x and not x.isspace():
                chars[o] += len(x.strip())
        twins = Counter(zip(self.parents, self.places))
        for e in range(n - 1, 0, -1):
            tag, p = self.tags[e], self.parents[e]
            if tag == "a":
                linked[e], links[e] = chars[e], 1
            for sums, own in ((chars, 0), (linked, 0), (links, 0), (controls, tag in CONTROLS), (prose, tag in PROSE), (wraps, tag in ARTICLE_TAGS or tag == "h1"), (names, self.whys[e] == NAME)):
                sums[p] += sums[e] + own
            if children[p] is not None and tag not in PROSE and tag not in INLINE and tag not in VOID:
                children[p][self.places[e]] += 1
        article = any(self.in_article)
        menus = not article and linked[0] < NAMED_LINKS * chars[0]
        for e in range(n):
            p, why = self.parents[e], self.whys[e]
            if not why and menus and links[e] > 1 and linked[e] >= MENU_LINKS * chars[e] and self.tags[e] not in INLINE and not prose[e]:
                why = LINKS
            if why == NAME:
                items = max(children[e].values(), default=0) > 1 or twins[p, self.places[e]] > 1
                own = linked[e] >= NAMED_LINKS * max(chars[e], 1) or controls[e] or items or names[e] or not prose[e]
            elif why == FORM:
                own = not (wraps[e] or 2 * chars[e] > chars[0] and prose[e])
            else:
                own = bool(why)
            if own or p >= 0 and self.kinds[p] & FURNITURE:
                self.kinds[e] |= FURNITURE

    def seen(self) -> dict[int, list]:
        """place -> [times, hash of its text, characters without furniture, parent's place, depth, kind],
        parents first; what lies inside furniture is left out."""
        sums, chars, s, c = [0], [0], 0, 0
        for x, o in zip(self.pieces, self.owners):
            if x and not x.isspace():
                words = " ".join(x.split())
                s = (s + _hash(words)) & _MASK
                if not self.kinds[o] & FURNITURE:
                    c += len(words)
            sums.append(s)
            chars.append(c)
        out: dict[int, list] = {}
        for e, place in enumerate(self.places):
            p = self.parents[e]
            if p >= 0 and self.kinds[p] & FURNITURE:
                continue
            a, b = self.first[e], self.last[e]
            row = out.get(place)
            if row is None:
                row = out[place] = [0, 0, 0, self.places[p] if p >= 0 else 0, self.depths[e], self.kinds[e]]
            row[0] += 1
            row[1] = (row[1] + sums[b] - sums[a]) & _MASK
            row[2] += chars[b] - chars[a]
        return out

    def text(self, mains: list[int], constants: frozenset[int]) -> str:
        """The text of the first of mains that the page has."""
        at = {}
        for e, place in enumerate(self.places):
            at.setdefault(place, e)
        main = next((at[p] for p in mains if p in at), 0)
        skip = []
        for e, p in enumerate(self.parents):
            skip.append(bool(p >= 0 and skip[p]) or bool(self.kinds[e] & FURNITURE) or (self.places[e] in constants and e != main))
        blocks, block = [], []
        for k in range(self.first[main], self.last[main]):
            x, o = self.pieces[k], self.owners[k]
            if x is None:
                blocks.append("".join(block))
                block = []
            elif not skip[o]:
                block.append(entities.unescape(x))
        blocks.append("".join(block))
        return " ".join(t for b in blocks if (t := " ".join(b.split())))


@functools.cache
def _raw_end(tag: str):
    return re.compile(rf"</{tag}\s*>", re.I).search


def tokens(html: str) -> Counter:
    """token -> how often the page has it."""
    return Counter({place: row[0] for place, row in Page(html).seen().items()})


class Token:
    """A place over all pages of a host (or of one page)."""

    __slots__ = ("place", "parent", "depth", "kind", "cls", "pages", "most", "chars", "varies")

    def __init__(self, place: int, parent: int, depth: int, kind: int, cls: object, pages: int, most: int, chars: int, varies: bool):
        self.place, self.parent, self.depth, self.kind, self.cls = place, parent, depth, kind, cls
        self.pages, self.most, self.chars, self.varies = pages, most, chars, varies


def nested(tokens: list[Token]) -> list[Token]:
    """The tokens, parents first, of valid classes that nest in order."""
    tokens = sorted(tokens, key=lambda t: (t.depth, t.place))
    size = Counter(t.cls for t in tokens)
    by = {t.place: t for t in tokens}
    around: dict[int, object] = {}  # place -> the nearest valid class of its ancestors, but its own
    outer: dict[object, set] = defaultdict(set)
    for t in tokens:
        p = by.get(t.parent)
        if p is None:
            around[t.place] = None
        else:
            around[t.place] = around[p.place] if size[p.cls] < LEAST_TOKENS or p.cls == t.cls else p.cls
        if p is None or p.cls != t.cls:
            outer[t.cls].add(around[t.place])
    pages = {t.cls: t.pages for t in tokens}
    good = {c for c in size if size[c] >= LEAST_TOKENS and len(outer[c]) == 1 and all(o is None or pages[o] >= pages[c] for o in outer[c])}
    return [t for t in tokens if t.cls in good]


def slots(template: list[Token]) -> tuple[list[int], list[int]]:
    """Main slots, inner ones first, and blocks that say the same on most of their pages.
    template: tokens, parents first."""
    if not template:
        return [], []
    some = any(t.varies for t in template)
    weight = {t.place: t.chars if t.varies or not some else 0 for t in template}
    by = {t.place: t for t in template}
    near: dict[int, int | None] = {}  # place -> nearest container that holds it
    inside: dict[int, list[Token]] = defaultdict(list)
    headings: Counter = Counter()  # container -> pages of headings in it
    roots: list[Token] = []
    is_slot = lambda t: t.kind & CONTAINER and not t.kind & FURNITURE and t.most == 1
    for t in template:
        p = by.get(t.parent)
        near[t.place] = None if p is None else (p.place if is_slot(p) else near[p.place])
        if is_slot(t):
            up = near[t.place]
            (roots if up is None else inside[up]).append(t)
    for t in reversed(template):
        up = near[t.place]
        if up is not None:
            if t.kind & HEADING and not t.kind & FURNITURE and (t.varies or not some):
                headings[up] += t.pages
            elif is_slot(t):
                headings[up] += headings[t.place]
    order: list[Token] = []
    todo = sorted(roots, key=lambda t: weight[t.place])
    while todo:
        c = todo.pop()
        order.append(c)
        if c.kind & ARTICLE:
            continue
        # inner slots that no page has two of, the fullest first: one, or one for each layout
        into: list[Token] = []
        for k in sorted(inside[c.place], key=lambda t: -weight[t.place]):
            if weight[k.place] and sum(x.pages for x in into) + k.pages <= c.pages:
                into.append(k)
        articles = all(k.kind & ARTICLE for k in into)
        held, apart = sum(weight[k.place] for k in into), headings[c.place] - sum(headings[k.place] for k in into)
        beside = apart > c.pages - sum(k.pages for k in into)  # a heading beside them on their pages
        if held and held >= (ARTICLE_SHARE if articles else MAIN_SHARE) * weight[c.place] and (articles or not beside):
            todo += into
    mains = [t.place for t in reversed(order)]
    first = by[mains[0]]
    same = [t.place for t in template if t.kind & NAMED and not t.varies and t.chars and t.pages >= max(LEAST_PAGES, CONSTANT_SHARE * first.pages)] if first.varies else []
    return mains, same


def own_slots(page: Page) -> list[int]:
    """The main slots of a page without a template."""
    return slots([Token(place, r[3], r[4], r[5], None, 1, r[0], r[2], True) for place, r in page.seen().items()])[0]


def main_text(html: str, mains: list[int] | None = None, constants: frozenset[int] = frozenset()) -> str:
    """The page's main text; without mains by its own structure alone."""
    page = Page(html)
    return page.text(own_slots(page) if not mains else mains, constants)


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit(""))), F.concat(F.lit("?"), F.coalesce(url, F.lit(""))))


#: Per (host, token): sums of two hashes of (page, times) over its pages, and what slots() asks.
SEEN = "host string, token long, a long, b long, pages long, most long, lo long, hi long, chars long, parent long, depth long, kind long"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and (host, token) the row of SEEN."""
    for batch in batches:
        rows: dict[tuple[str, int], list[int]] = {}
        for host, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            html = x.as_py() or ""
            page = _hash(html)
            for token, (n, text, chars, parent, depth, kind) in Page(html).seen().items():
                h = _hash(f"{page}:{n}")
                r = rows.get((host, token))
                if r is None:
                    rows[host, token] = [h & _MASK, h >> 31 & _MASK, 1, n, text, text, chars, parent, depth, kind]
                else:
                    r[0] += h & _MASK
                    r[1] += h >> 31 & _MASK
                    r[2] += 1
                    r[3], r[4], r[5] = max(r[3], n), min(r[4], text), max(r[5], text)
                    r[6] += chars
        cols = [[k[0] for k in rows], [k[1] for k in rows], *(list(c) for c in zip(*rows.values()))] if rows else [[]] * 12
        names = [f.split()[0] for f in SEEN.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(cols)], names)


def _deduced(tokens: pa.Array) -> pa.Array:
    out = []
    for rows in tokens.to_pylist():
        t = nested([Token(r["token"], r["parent"], r["depth"], r["kind"], (r["a"], r["b"], r["pages"]), r["pages"], r["most"], r["chars"], r["lo"] != r["hi"]) for r in rows])
        mains, same = slots(t)
        out.append({"template": [x.place for x in t], "mains": mains, "constants": same})
    longs = pa.list_(pa.int64())
    return pa.array(out, pa.struct([("template", longs), ("mains", longs), ("constants", longs)]))


def templates(pages: DataFrame) -> DataFrame:
    """(host, html) to (host, template, mains, constants) of the hosts that have a template:
    its tokens, its main slots and its constant blocks. A host's tokens on a given share of
    its pages are no more than a page's tokens divided by that share, so a list stays small."""
    bounded_batches(pages.sparkSession)
    seen = pages.select("host", "html").mapInArrow(_vectors, SEEN).groupBy("host", "token").agg(
        *(F.sum(c).alias(c) for c in ("a", "b", "pages", "chars")), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *(F.max(c).alias(c) for c in ("most", "parent", "depth", "kind"))
    )
    seen = materialize(seen.where(F.col("pages") >= LEAST_PAGES))
    all_pages = seen.groupBy("host").agg(F.max("pages").alias("n"))  # the root is on every page
    shared = seen.join(all_pages, "host").where(F.col("pages") >= LEAST_SHARE * F.col("n")).drop("n")
    one = F.struct(*(c for c in shared.columns if c != "host"))
    found = shared.groupBy("host").agg(F.collect_list(one).alias("tokens"))
    return found.select("host", arrow_udf(_deduced, "struct<template: array<long>, mains: array<long>, constants: array<long>>")("tokens").alias("t")).select("host", "t.*").where(F.size("mains") > 0)


def _extracted(html: pa.Array, mains: pa.Array, constants: pa.Array) -> pa.Array:
    return pa.array([main_text(x.as_py() or "", m, frozenset(c or ())) for x, m, c in zip(html, mains.to_pylist(), constants.to_pylist(), strict=True)], pa.string())


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) to page_id, url, text, n_chars."""
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    found = materialize(templates(rows).select(F.col("host").alias("h"), "mains", "constants"))
    bounded_batches(pages.sparkSession)
    joined = rows.join(found, rows["host"] == found["h"], "left")  # a few numbers a host: broadcast if small, else a join that splits hot hosts
    return joined.select("page_id", "url", arrow_udf(_extracted, "string")("html", "mains", "constants").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
