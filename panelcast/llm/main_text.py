"""Main text of web pages by gradient-boosted trees over the features of DOM nodes.

Pages are read into trees of elements. Each element gets features: densities of text, links and marks in its
subtree, words of its class, id and role (its own and its ancestors'), tags, depth and what its siblings are
like. Boosted trees give the probability that its text is main text. Decoding goes over the tree as a whole:
an element is kept whole, dropped whole or left open for its children to decide, so no choice contradicts
that of an ancestor; the most likely consistent choice is taken.

There are no labels of pages. The model learns from SAMPLE pages at most (least hash of page_id): the blocks
of their article elements are main text, the rest isn't. Each sampled page is also dressed anew several times,
its blocks put in layouts with other containers, menus, notices, adverts, forms, sidebars and comments.

Null and empty html give ''. Broken html is read as far as it goes: open elements end with the page, what
isn't closed in a tag is dropped. Repeated rows give the same text each.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.trees import BoostedTrees
from panelcast.llm.words import Local

SAMPLE, DRESSINGS, TOGETHER = 96, 7, 64
#: What leaving an element open costs, in log probability.
OPEN_COST = 0.5
#: What scripts, styles and text fields hold is never text, to the end of the page if need be. Of the embedded
#: elements only what is closed goes; unclosed ones are elements as others, self-closed ones are empty.
#: No part of a tag is tried twice: an unquoted `<` ends what can be its attributes, and the rest is read possessively.
_ATTRIBUTES = r"(?:\"[^\"]*+\"|'[^']*+'|[^'\"<>])*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea)(?=[\s/>]).*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    rf"|<(template|noscript|svg|iframe|object|select|canvas|audio|video)(?=[\s/>]){_ATTRIBUTES}(?<!/)>(?:(?!<\2[\s/>]).)*?</\2\s*>"
    rf"|<(/?)([a-zA-Z][^\s/<>]*+)({_ATTRIBUTES})>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_EMBEDDED = frozenset("template noscript svg iframe object select canvas audio video math".split())
_HEAD = frozenset("head html title meta link base basefont bgsound noframes template noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: An opening tag of the key ends open elements of these tags, up to the nearest of the stoppers.
_BLOCKS = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
_ENDS = {t: ("p",) for t in _BLOCKS} | {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
_STOPPERS = frozenset("ul ol table div article section main aside nav header footer form body html dl blockquote td th".split())
_TAGS = ["p", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "a", "button", "label", "h1", "h2", "h3", "table", "td", "blockquote", "pre", "span", "body", "figure"]
_TAG_BIT = {t: 1 << i for i, t in enumerate(_TAGS)}
#: Words of class, id and role by what they tell.
_NAMES = {
    "main": "article body content entry main post story text blog page single hentry prose",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topbar toolbar tabs skip",
    "advert": "ad ads advert advertisement adbox adslot sponsor sponsored promo promotion banner sponsoredcontent dfp adsense",
    "comment": "comment comments reply replies respond discussion disqus reader readers responses thread feedback commentlist",
    "footer": "footer foot copyright colophon legal imprint bottom",
    "header": "header head masthead logo brand site top tagline hero",
    "side": "sidebar side aside widget related recommended more trending popular teaser complementary rail secondary",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay warning message announcement dialog privacy toast",
    "form": "form login signin signup subscribe newsletter search register contact input",
    "share": "share social sharing follow twitter facebook pagination pager meta tags byline author date hidden",
}
_NAME_BIT = {w: 1 << i for i, words in enumerate(_NAMES.values()) for w in words.split()}
GOLD = "data-gold"


@dataclass
class Page:
    """Elements in page order and the texts between tags; text k lies in element owner[k]."""

    parent: list[int]
    tag: list[int]  # bit of the tag
    name: list[int]  # bits of the words of class, id and role
    above: list[int]  # tag bits of the ancestors
    named: list[int]  # name bits of the ancestors
    depth: list[int]
    begin: list[int]  # first text in it
    end: list[int]
    last: list[int]  # first element after its subtree
    gold: list[bool]
    owner: list[int]
    block: list[int]
    texts: list[str]


_attributes: dict[str, tuple[int, bool]] = Local()


def _names(attributes: str) -> tuple[int, bool]:
    known = _attributes.get(attributes)
    if known is None:
        bits = 0
        for value in re.findall(r"(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", attributes.lower()):
            for word in re.findall("[a-z]+", value):
                bits |= _NAME_BIT.get(word, 0)
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden|\bhidden\b|aria-hidden\s*=\s*.?true", attributes, re.I):
            bits |= _NAME_BIT["hidden"]
        if len(_attributes) > 10_000:
            _attributes.clear()
        known = _attributes[attributes] = (bits, GOLD in attributes)
    return known


def read_page(html: str) -> Page:
    p = Page([-1], [0], [0], [0], [0], [0], [0], [0], [0], [False], [], [], [])
    stack, names, block, at = [0], ["#"], 0, 0
    head = title = False  # a head ends with its tag, or with the first text or element of the body

    def text(raw: str) -> None:
        if raw:
            p.owner.append(stack[-1])
            p.block.append(block)
            p.texts.append(entities.unescape(raw) if "&" in raw else raw)

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            i = stack.pop()
            names.pop()
            p.end[i], p.last[i] = len(p.texts), len(p.parent)

    for m in _TOKEN.finditer(html):
        between, at = html[at : m.start()], m.end()
        if head and not title and between.strip():
            head = False
        if not head:
            text(between)
        name = m[4]
        if name is None:
            continue
        name = name.lower()
        if head:
            title = name == "title" and not m[3]
            head = name in _HEAD if not m[3] else name not in ("head", "body", "html")
            if head or m[3]:
                continue
        elif name == "head" and not m[3] and len(p.parent) <= 2 and names[-1] in ("#", "html"):
            head = True
            continue
        if name not in _INLINE:
            block += 1
        if m[3]:
            if name in names:
                close(len(names) - 1 - names[::-1].index(name))
            continue
        if name in _VOID or (name in _EMBEDDED and m[5].endswith("/")):
            continue
        ended = _ENDS.get(name)
        if ended:
            for k in range(len(names) - 1, 0, -1):
                if names[k] in ended:
                    close(k)
                    break
                if names[k] in _STOPPERS:
                    break
        up = stack[-1]
        bits, gold = _names(m[5]) if m[5] else (0, False)
        p.parent.append(up)
        p.tag.append(_TAG_BIT.get(name, 0))
        p.name.append(bits)
        p.above.append(p.above[up] | p.tag[up])
        p.named.append(p.named[up] | p.name[up])
        p.depth.append(p.depth[up] + 1)
        p.begin.append(len(p.texts))
        p.end.append(len(p.texts))
        p.last.append(0)
        p.gold.append(gold or p.gold[up])
        stack.append(len(p.parent) - 1)
        names.append(name)
    if not title:
        text(html[at:])
    close(0)
    return p


def _bits(values: list[int], n: int) -> np.ndarray:
    return ((np.array(values, "int64")[:, None] >> np.arange(n)) & 1).astype("float32")


def features(p: Page) -> tuple[np.ndarray, np.ndarray]:
    """A row for each element, and the number of characters in its subtree."""
    n = len(p.parent)
    parent, begin, end, last = (np.array(x) for x in (p.parent, p.begin, p.end, p.last))
    link = _TAG_BIT["a"]
    in_link = np.array([bool((p.tag[o] | p.above[o]) & link) for o in p.owner], bool)

    def sums(values: Iterable[float]) -> np.ndarray:
        total = np.r_[0.0, np.cumsum(np.fromiter(values, float, len(p.texts)))]
        return total[end] - total[begin]

    size = np.fromiter((len(t.strip()) for t in p.texts), float, len(p.texts))
    chars, linked = sums(size), sums(np.where(in_link, size, 0.0))
    words = sums(t.count(" ") + 1 if t.strip() else 0 for t in p.texts)
    stops = sums(t.count(". ") + t.count(",") + (t.rstrip()[-1:] in ".!?") for t in p.texts)
    total = max(chars[0], 1.0)
    below = last - np.arange(n)
    up = np.maximum(parent, 0)
    order = np.argsort(parent, kind="stable")
    index = np.empty(n)
    starts = np.r_[True, parent[order][1:] != parent[order][:-1]]
    index[order] = np.arange(n) - np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    siblings = np.bincount(up, minlength=n)[up]
    sib_chars = (np.bincount(up, chars, n)[up] - chars) / np.maximum(siblings - 1, 1)
    sib_link = (np.bincount(up, linked, n)[up] - linked) / np.maximum(sib_chars * np.maximum(siblings - 1, 1), 1)
    before = np.r_[0.0, np.cumsum(size)][begin] / total
    kids_a = np.bincount(up, (np.array(p.tag) & link) > 0, n)
    plain = [
        np.log1p(chars), chars / total, linked / np.maximum(chars, 1), chars / below, np.log1p(words), chars / np.maximum(words, 1),
        stops / np.maximum(words, 1), np.log1p(stops), np.array(p.depth, float), index, siblings, np.log1p(sib_chars), sib_link,
        before, np.log1p(below), kids_a, chars[up] / total, linked[up] / np.maximum(chars[up], 1),
    ]
    k, t = len(_NAMES), len(_TAGS)
    return np.concatenate([np.stack(plain, axis=1), _bits(p.tag, t), _bits(p.above, t), _bits(p.name, k), _bits(p.named, k)], axis=1), chars


def decode(p: Page, probability: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Which texts are kept: the likeliest choice in which no element contradicts an ancestor."""
    n = len(p.parent)
    q = np.clip(probability, 1e-6, 1 - 1e-6)
    told = chars > 0
    yes, no = np.where(told, np.log(q), 0.0), np.where(told, np.log(1 - q), 0.0)
    own = np.zeros(n, bool)
    own[p.owner] = True
    last = np.array(p.last)
    all_yes, all_no = (np.r_[0.0, np.cumsum(x)] for x in (yes, no))
    keep, drop = all_yes[last] - all_yes[:-1], all_no[last] - all_no[:-1]
    mixed = np.maximum(yes, no) - OPEN_COST
    best = np.empty(n)
    for i in range(n - 1, -1, -1):  # children come after their parent
        best[i] = max(keep[i], drop[i], mixed[i])
        if i:
            mixed[p.parent[i]] += best[i]
    state = np.zeros(n, "int8")  # 1 kept whole, 2 dropped whole, 0 open
    for i in range(n):
        up = state[p.parent[i]] if i else 0
        state[i] = up or (1 if keep[i] >= best[i] else 2 if drop[i] >= best[i] else 0)
    stays = (state == 1) | ((state == 0) & (q >= 0.5))
    return stays[p.owner] if p.owner else np.zeros(0, bool)


def kept_text(p: Page, stays: np.ndarray) -> str:
    parts, block = [], -1
    for k in np.flatnonzero(stays).tolist():
        if p.block[k] != block:
            parts.append(" ")
            block = p.block[k]
        parts.append(p.texts[k])
    return " ".join("".join(parts).split())


def extract(htmls: Iterable[str | None], model: BoostedTrees) -> list[str]:
    """Main texts; the trees judge the elements of TOGETHER pages at once."""
    out: list[str] = []
    group: list[tuple[Page, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        likely = model.probability(np.concatenate([x for _, x, _ in group])) if group else np.zeros(0)
        at = 0
        for p, x, chars in group:
            out.append(kept_text(p, decode(p, likely[at : at + len(x)], chars)))
            at += len(x)
        group.clear()

    for html in htmls:
        p = read_page(html or "")
        group.append((p, *features(p)))
        if len(group) >= TOGETHER:
            flush()
    flush()
    return out


def _element(rng: np.random.Generator, tag: str, inside: str, names: str = "") -> str:
    at = f' {rng.choice(["class", "id"], p=[0.8, 0.2])}="{names}"' if names else ""
    return f"<{tag}{at}>{inside}</{tag}>"


def dress(rng: np.random.Generator, blocks: list[str], snippets: list[str]) -> str:
    """A page with the blocks as main text (marked) in a layout drawn anew, with other parts around it."""
    pick = lambda *x: str(rng.choice(x))
    some = lambda: entities.escape(" ".join(pick(*snippets).split()[: int(rng.integers(1, 14))]))
    long_ = lambda: entities.escape(pick(*blocks, *snippets))
    para = lambda: _element(rng, pick("p", "p", "div", "span"), long_() if rng.random() < 0.5 else some())
    maybe = lambda names: names if rng.random() < 0.8 else ""

    def menu(names: str) -> str:
        items = "".join(_element(rng, "li", f'<a href="/{k}">{some()}</a>') for k in range(int(rng.integers(2, 9))))
        return _element(rng, pick("nav", "nav", "div", "header"), _element(rng, "ul", items), maybe(names))

    def side() -> str:
        head = _element(rng, pick("h2", "h3", "h4"), some())
        body = menu("") if rng.random() < 0.5 else "".join(para() for _ in range(int(rng.integers(1, 4))))
        return _element(rng, pick("aside", "div", "section"), head + body, pick("sidebar", "widget", "related", "related-posts", "side", "trending", "more-stories"))

    def advert() -> str:
        return _element(rng, pick("div", "aside", "section", "p", "ins"), long_() if rng.random() < 0.4 else some(), pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad"))

    def notice() -> str:
        return _element(rng, pick("div", "section", "p", "aside"), para() + _element(rng, "button", some()), pick("cookie-notice", "notice", "alert", "cookie-banner", "consent", "gdpr", "popup"))

    def form() -> str:
        inside = _element(rng, "label", some()) + '<input type="text">' + _element(rng, "button", some())
        return _element(rng, "form", (para() if rng.random() < 0.5 else "") + inside, maybe(pick("newsletter", "login", "search-form", "subscribe", "contact")))

    def comments() -> str:
        one = lambda: _element(rng, pick("li", "div", "article"), _element(rng, "b", some()) + _element(rng, "p", long_()), maybe(pick("comment", "reply", "comment-body")))
        inside = _element(rng, pick("h2", "h3"), some()) + "".join(one() for _ in range(int(rng.integers(1, 6))))
        return _element(rng, pick("section", "div", "ol", "ul"), inside, pick("comments", "comment-list", "discussion", "responses", "reader-comments"))

    def share() -> str:
        return _element(rng, pick("div", "ul", "p"), "".join(f'<a href="#">{some()}</a> ' for _ in range(int(rng.integers(1, 5)))), pick("share", "social", "breadcrumb", "pagination", "tags", "meta"))

    others = [advert, notice, form, share, side]
    if rng.random() < 0.3:  # a short text, or one of short blocks
        blocks = [" ".join(b.split()[: int(rng.integers(1, 9))]) for b in blocks[: int(rng.integers(1, 8))]]
    between = 0.06 if rng.random() < 0.6 else 0.25
    body = [_element(rng, pick("h1", "h1", "h2"), f'<span {GOLD}="1">{entities.escape(" ".join(blocks[0].split()[:12]))}</span>')]
    style = pick("p", "p", "p", "div", "mixed")
    for b in blocks:
        tag = style if style != "mixed" else pick("p", "p", "blockquote", "h2", "h3", "pre", "li", "td")
        if tag in ("h2", "h3", "td", "li") and rng.random() < 0.7:
            b = " ".join(b.split()[: int(rng.integers(1, 12))])
        inner = entities.escape(b)
        if rng.random() < 0.15:
            words = inner.split(" ")
            k = int(rng.integers(0, len(words)))
            words[k] = f'<a href="/x">{words[k]}</a>'
            inner = " ".join(words)
        made = f'<{tag} {GOLD}="1">{inner}</{tag}>'
        more = "".join(f'<{tag} {GOLD}="1">{entities.escape(" ".join(b.split()[: int(rng.integers(1, 10))]))}</{tag}>' for _ in range(int(rng.integers(0, 4))))
        made = f"<ul>{made}{more}</ul>" if tag == "li" else f"<table><tr>{made}{more}</tr></table>" if tag == "td" else made
        body.append(made)
        if rng.random() < between:
            body.append(others[int(rng.integers(0, len(others)))]())
    if rng.random() < 0.4:
        body.append(comments())
    main = _element(rng, pick("article", "article", "main", "div", "div", "section"), "".join(body), maybe(pick("content", "post", "entry-content", "article-body", "story", "main-content", "post-content", "text", "hentry")))
    if rng.random() < 0.4:
        main = _element(rng, pick("main", "div", "section"), main + (side() if rng.random() < 0.3 else ""), maybe(pick("content", "main", "page", "wrap", "container")))
    top = [menu("menu")] if rng.random() < 0.8 else []
    if rng.random() < 0.6:
        top.insert(0, _element(rng, pick("header", "header", "div"), _element(rng, pick("h1", "h2", "div", "p"), some()) + (para() if rng.random() < 0.4 else ""), maybe(pick("header", "site-header", "masthead", "top"))))
    top += [f() for f in others if rng.random() < 0.25]
    tail = [f() for f in [*others, comments] if rng.random() < 0.3]
    if rng.random() < 0.85:
        tail.append(_element(rng, pick("footer", "footer", "div"), "&copy; " + some() + (para() if rng.random() < 0.4 else ""), maybe(pick("footer", "site-footer", "copyright"))))
    return f"<html><head><title>{some()}</title></head><body>{''.join(top)}{main}{''.join(tail)}</body></html>"


def _sampled(html: str) -> tuple[str, list[str], list[str]]:
    """The page with its article marked, the article's blocks, and the other blocks."""
    p = read_page(html)
    inside = np.array([bool((p.tag[o] | p.above[o]) & (_TAG_BIT["article"] | _TAG_BIT["main"])) for o in p.owner], bool)
    by: dict[tuple[bool, int], list[str]] = {}
    for k, text in enumerate(p.texts):
        by.setdefault((bool(inside[k]), p.block[k]), []).append(text)
    clean = {k: " ".join("".join(v).split()) for k, v in by.items()}
    main, rest = ([t for (i, _), t in clean.items() if t and i == want] for want in (True, False))
    marked = re.sub(r"<(article|main)\b", rf'<\1 {GOLD}="1"', html, flags=re.I)
    return marked, main, rest


def fit(pages: list[str]) -> BoostedTrees:
    """Boosted trees from sampled pages and their dressings."""
    rng = np.random.default_rng(11)
    made: list[str] = []
    for marked, main, rest in map(_sampled, pages):
        if main:
            made.append(marked)
        blocks = (main or rest)[:60]
        if blocks:
            made += [dress(rng, blocks[: int(rng.integers(1, len(blocks) + 1))], rest or blocks) for _ in range(DRESSINGS)]
    xs, ys = [np.zeros((0, 18 + 2 * len(_TAGS) + 2 * len(_NAMES)))], [np.zeros(0)]
    for html in made:
        p = read_page(html)
        x, chars = features(p)
        size = np.fromiter((len(t.strip()) for t in p.texts), float, len(p.texts))
        gold = np.array([p.gold[o] for o in p.owner], bool)
        total = np.r_[0.0, np.cumsum(size * gold)]
        share = (total[p.end] - total[p.begin]) / np.maximum(chars, 1)
        xs.append(x[chars > 0])
        ys.append((share >= 0.5)[chars > 0].astype(float))
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys))


def fit_pages(pages: DataFrame, sample: int = SAMPLE) -> BoostedTrees:
    """The model of at most `sample` pages, chosen by a hash of page_id."""
    ids = pages.where("page_id is not null and html is not null").select("page_id")
    few = ids.orderBy(F.xxhash64(F.col("page_id").cast("string")), "page_id").limit(sample)
    chosen = [r[0] for r in few.collect()]  # at most `sample` ids
    rows = pages.where(F.col("page_id").isin(chosen)).dropDuplicates(["page_id"]).select("page_id", "html").collect() if chosen else []
    return fit([r[1] for r in sorted(rows) if r[1]][:sample])


def main_text(pages: DataFrame, model: BoostedTrees) -> Column:
    """The main text of the column html."""
    shared: Broadcast = pages.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(htmls: pa.Array) -> pa.Array:
        return pa.array(extract((h.as_py() for h in htmls), shared.value), pa.string())

    return F.arrow_udf(run, "string")("html")
