"""Main text of web pages: the maximum-scoring contiguous region of words and tags.

A page is a stream of tags and words. Words score by the elements they stand in,
tags are negative; the weights are log odds from a labelled table of pages whose
content region is known. One linear scan finds the best contiguous region; within
it, blocks in elements whose weight is negative (menus, adverts, forms, comments
in the midst of an article) are left out.

What an element's class or role says against its contents holds for boxes beside the
content, not for what encloses it: html, body, main, the elements around a main or
around an article with a quarter of the page's words, and elements with nine tenths
of them (but nav, header, footer and aside) say nothing against theirs. An id of a heading or paragraph is an anchor, a
class like has-sidebar or no-menu a state, and neither says anything.

White space inside a block becomes one space, blocks are joined by a newline,
character references are decoded. Scripts, styles, templates, form controls and
HTML comments are never text. Null html counts as empty; a page without a positive
word has an empty text. Repeated rows give repeated results, extra columns are
ignored, an empty table gives an empty result. An unclosed element ends where its
parent ends, an unclosed tag, comment or script where the page ends. The time is
in proportion to the page's length, however deep its elements are nested.
"""

from __future__ import annotations

import bisect
import html
import math
import pickle
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from memlake.llm.common import chunks, fields

#: A tag without attributes.
_BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
#: An attribute's name, which may begin with an equals sign, and the sign before its value.
_ATTRIBUTE = re.compile(r"(=?[^\s/>=]*)(\s*=\s*)?")
_UNQUOTED = re.compile(r"[^\s>]*")
#: Elements whose contents are no text of the page, up to their end tag.
_RAW = frozenset("script style noscript noframes noembed template iframe svg textarea select button datalist title".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
_LONG_NUMBER = re.compile(r"&#([xX]?)0*([0-9a-fA-F]*)(;?)")
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_NAMING = frozenset(("class", "id", "role", "itemprop", "aria-label"))
#: A name that begins with one of these tells a state of the page, not what the element is.
_STATE = re.compile(r"\b(?:has|have|is|no|not|non|with|without)[-_][\w-]*", re.I)
_ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_FRAMES = frozenset(("html", "body", "main"))
#: Elements that text is made of, wherever it stands: none of them speaks against its contents.
_TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption div section span center".split())
#: Elements that are beside the content even where they hold all words of a page.
_BESIDE = frozenset(("nav", "footer", "header", "aside"))
#: Shares of the page's words: of an article that is the content, of an element that encloses all of it.
ARTICLE_SHARE, ENCLOSING_SHARE = 0.25, 0.9
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark object output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr img"
    " math mi mn mo ms mtext mspace mrow msup msub msubsup mfrac msqrt mroot mstyle mfenced munder mover munderover mmultiscripts mpadded mphantom semantics annotation".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of these ends an open paragraph.
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_P_LIMITS = ("article", "section", "div", "main", "td", "li", "blockquote", "aside", "form", "table")
#: A start tag ends an open element of the same group.
_SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
TABLE_PAGES = 400


def _attributes(page: str, at: int) -> tuple[int, list[tuple[str, str]]]:
    """Where the tag whose attributes begin at ``at`` ends (-1: nowhere), and its attributes. A quote counts after an equals sign alone."""
    found, n = [], len(page)
    while True:
        at = _GAP.match(page, at).end()
        if at >= n:
            return -1, found
        if page[at] == ">":
            return at + 1, found
        m = _ATTRIBUTE.match(page, at)
        name, at, value = m[1], m.end(), ""
        if m[2]:
            quote = page[at : at + 1]
            if quote in ("'", '"') and quote:
                end = page.find(quote, at + 1)
                if end < 0:
                    return -1, found
                value, at = page[at + 1 : end], end + 1
            else:
                end = _UNQUOTED.match(page, at).end()
                value, at = page[at:end], end
        found.append((name.lower(), value))


def tags(page: str):
    """(start, end, end tag?, name, attributes) of every tag, and of what else is no text with an empty name.

    One pass: each character is looked at a bounded number of times, as what has no
    end reaches to the end of the page.
    """
    at, n = page.find("<"), len(page)
    while at >= 0:
        if m := _BARE.match(page, at):
            end, closing, name, attributes = m.end(), bool(m[1]), m[2].lower(), ()
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end, closing, name, attributes = (n if end < 0 else end + 3), False, "", ()
        else:
            closing = page.startswith("</", at)
            if m := _NAME.match(page, at + 1 + closing):
                end, attributes = _attributes(page, m.end())
                name = m[0].lower()
                if end < 0:
                    end, name = n, ""
            elif closing or page.startswith(("<!", "<?"), at):
                end = page.find(">", at + 2)
                end, name, attributes = (n if end < 0 else end + 1), "", ()
            else:  # a plain character
                at = page.find("<", at + 1)
                continue
        if name in _RAW and not closing:
            stop = _RAW_END[name].search(page, end)
            if stop:
                last, _ = _attributes(page, stop.end())
                end = last if last >= 0 else n
            else:
                end = n
        yield at, end, closing, name, attributes
        at = page.find("<", end)


def _features(tag: str, attributes) -> tuple[str, ...]:
    """What an element says of its contents: its name and the words of its class, id and role."""
    if not attributes:
        return (tag,)
    words, hidden = set(), False
    for name, value in attributes:
        if name in _NAMING and not (name == "id" and tag in _ANCHORED):
            words.update("." + w for w in _PARTS.findall(_CAMEL.sub(r"\1 \2", _STATE.sub(" ", value)).lower()))
        hidden |= name == "hidden" or name == "style" and bool(_NO_DISPLAY.search(value)) or name == "aria-hidden" and value.strip().lower() == "true"
    return (tag, *sorted(words), *(("=hidden",) if hidden else ()))


class Element:
    """An open element; its parents lead to the root. low and high: bounds of the weights on that way, once known."""

    __slots__ = ("parent", "tag", "features", "low", "high", "words", "encloses")

    def __init__(self, parent: Element | None, tag: str, features: tuple[str, ...]):
        self.parent, self.tag, self.features, self.low, self.high, self.words, self.encloses = parent, tag, features, None, None, 0, False

    def path(self):
        """The element and its parents up to the root."""
        at = self
        while at is not None:
            yield at
            at = at.parent


def settle(blocks: list[tuple]) -> list[tuple]:
    """Counts the words of each element and marks those that enclose the content. Each element is looked at a bounded number of times."""
    found: dict[int, Element] = {}
    for text, element, _, _ in blocks:
        if element is not None:
            element.words += 1 + text.count(" ")
        while element is not None and id(element) not in found:
            found[id(element)] = element
            element = element.parent
    depth: dict[int, int] = {}
    for element in found.values():
        way = []
        while element is not None and id(element) not in depth:
            way.append(element)
            element = element.parent
        base = depth[id(element)] if element is not None else 0
        for k, x in enumerate(reversed(way)):
            depth[id(x)] = base + k + 1
    inner_first = sorted(found.values(), key=lambda x: -depth[id(x)])
    for x in inner_first:
        if x.parent is not None:
            x.parent.words += x.words
    total = sum(1 + text.count(" ") for text, *_ in blocks)
    articles = [x for x in inner_first if x.tag == "article" and x.words >= ARTICLE_SHARE * total]
    core = [x for x in inner_first if x.tag == "main"] + ([max(articles, key=lambda x: x.words)] if articles else [])
    for x in core:
        while x is not None and not x.encloses:
            x.encloses = True
            x = x.parent
    for x in inner_first:
        x.encloses |= x.tag in _FRAMES or (x.tag not in _BESIDE and x.words >= ENCLOSING_SHARE * total)
    return blocks


def _number(m: re.Match) -> str:
    digits = m[2] if m[1] else re.match("[0-9]*", m[2])[0]
    rest = m[2][len(digits) :]
    if len(digits) <= 7:
        return f"&#{m[1]}{digits or '0'}{rest}{m[3]}"
    return f"&#1114112;{rest}{m[3] if rest else ''}"  # beyond Unicode


def _decoded(raw: str) -> str:
    if "&" not in raw:
        return raw
    return html.unescape(_LONG_NUMBER.sub(lambda m: _number(m) if len(m[0]) > 9 else m[0], raw) if "&#" in raw else raw)


def stream(page: str):
    """Blocks of the page: (text, innermost element or None, tags since the last block, share of the text in links)."""
    stack: list[Element] = []
    places: dict[str, list[int]] = {}  # of the open elements of each name
    text: list[str] = []
    linked = total = count = at = 0

    def cut(size: int) -> None:
        while len(stack) > size:
            places[stack.pop().tag].pop()

    def top(names) -> int:
        return max([places[x][-1] for x in names if places.get(x)], default=-1)

    for start, end, closing, tag, attributes in (*tags(page), (len(page), len(page), False, None, ())):
        if start > at:
            raw = page[at:start]
            text.append(raw)
            if not raw.isspace():
                total += len(raw)
                if places.get("a"):
                    linked += len(raw)
        at = end
        if tag == "" or tag in _RAW:
            continue
        if tag in _INLINE:
            if tag == "a":
                if not closing:
                    places.setdefault("a", []).append(len(stack))
                    stack.append(Element(stack[-1] if stack else None, "a", ("a",)))
                elif places.get("a"):
                    cut(places["a"][-1])
            continue
        if text:
            joined = " ".join(_decoded("".join(text)).split())
            text.clear()
            if joined:
                yield joined, stack[-1] if stack else None, count, linked / max(total, 1)
                count = 0
            linked = total = 0
        if tag is None:
            return
        count += 1
        if closing:
            if places.get(tag):
                cut(places[tag][-1])
            continue
        if tag in _ENDS_P and (k := top(("p",))) > top(_P_LIMITS):
            cut(k)
        if tag in _SIBLINGS:
            names, limits = _SIBLINGS[tag]
            # the outermost of the group inside the limit
            limit = top(limits)
            inside = [k for x in names if places.get(x) for k in (places[x][bisect.bisect_right(places[x], limit) :][:1])]
            if inside:
                cut(min(inside))
        if tag in _VOID or page[end - 2] == "/" and tag not in ("div", "p", "section", "article"):
            continue
        places.setdefault(tag, []).append(len(stack))
        stack.append(Element(stack[-1] if stack else None, tag, _features(tag, attributes)))


# --- the labelled table ----------------------------------------------------


def labelled_pages(pages: int = TABLE_PAGES, seed: int = 11) -> list[tuple[str, list[str]]]:
    """(html, blocks of the content region) of pages made by rule from common layouts."""
    r = random.Random(seed)
    syllables = "an er on the re in ti ha es en de la que ou ment der ung sch ein ado ra lo".split()

    def prose(a: int, b: int) -> str:
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(r.randint(a, b))).capitalize() + "."

    def heading(p: str) -> str:
        n = r.randint(2, 5)
        return f"<h{n}>{p}</h{n}>"

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{prose(1, 2)}</a></li>' for k in range(n)) + "</ul>"

    def box(kind: str) -> str:
        name = r.choice(kind.split("|"))
        body = r.choice((f"<p>{prose(3, 30)}</p>", links(r.randint(2, 6)), prose(2, 12), f"{heading(prose(1, 3))}<p>{prose(5, 40)}</p>"))
        if name == "hidden":
            return f"<{(tag := r.choice(('div', 'p')))} {r.choice(('hidden', 'style="display: none"', 'aria-hidden="true"'))}>{prose(3, 30)}</{tag}>"
        if name.startswith("<"):
            tag = name.strip("<>")
            return f"<{tag}>{body}</{tag}>"
        return f'<{r.choice(("div", "section", "div"))} {r.choice(("class", "class", "id"))}="{name}">{body}</div>'.replace("<section", "<div")

    outside = "<nav>|<nav>|<footer>|<footer>|<header>|<aside>|<form>|ad|ads|advert|banner|sidebar|menu|navbar|breadcrumb|cookie|notice|consent|promo|sponsored|related|share|social|newsletter|subscribe|popup|comments|comment|disqus|replies|pagination|copyright|widget|login|search|hidden"
    inside = "<aside>|<form>|ad|advert|share|related|promo|newsletter|sponsored|comments|hidden"
    table = []
    for _ in range(pages):
        blocks, body = [], ""
        title = prose(2, 8)
        blocks.append(title)
        body += r.choice((f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>" if r.random() < 0.2 else f"<h1>{title}</h1>"))
        for _ in range(r.randint(1, 12)):
            p = prose(1, 80)
            blocks.append(p)
            body += r.choice((f"<p>{p}</p>", f"<p>{p}</p>", f"<p><b>{p}</b></p>", heading(p), heading(p), f"<ul><li>{p}</li></ul>", f"<blockquote><p>{p}</p></blockquote>", f"<div>{p}</div>", f"<pre>{p}</pre>", f"<table><tr><td>{p}</td></tr></table>", f'<p>{p} <a href="/x">{prose(1, 2)}</a></p>'))
            if body.endswith("</a></p>"):
                blocks[-1] = " ".join(re.sub(r"<[^>]*>", "", body[body.rindex("<p>") :]).split())
            if r.random() < 0.08:
                body += box(inside)
        frame = r.choice(("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main" class="post article entry"><div class="body text">{}</div></div>', '<div class="story">{}</div>'))
        body_name = r.choice(("", "", f' class="{r.choice(outside.replace("<", "").replace(">", "").split("|"))}-{r.choice(("open", "closed", "on", "page", "enabled"))} page"'))
        before = "".join(box(outside) for _ in range(r.randint(1, 5)))
        after = "".join(box(outside) for _ in range(r.randint(1, 5)))
        table.append((f"<html><head><title>{title}</title></head><body{body_name}>{before}{frame.format(body)}{after}</body></html>", blocks))
    return table


class PageModel:
    """Weights of features: log odds that a word in such an element is content."""

    def __init__(self, weights: dict[str, float], prior: float, tag: float, linked: float):
        self.weights, self.prior, self.tag, self.linked = weights, prior, tag, linked

    def bounds(self, element: Element | None) -> tuple[float, float]:
        """Least and greatest weight of the features on the way to the root, each element's own found once."""
        open_ = []
        while element is not None and element.low is None:
            open_.append(element)
            element = element.parent
        low, high = (element.low, element.high) if element is not None else (math.inf, -math.inf)
        for x in reversed(open_):
            own = [self.weights.get(f, 0.0) for f in x.features]
            if x.encloses:
                own = [max(w, 0.0) for w in own]
            low, high = min(low, *own), max(high, *own)
            x.low, x.high = low, high
        return (low, high) if low <= high else (0.0, 0.0)

    def word_weight(self, element: Element | None, share: float) -> float:
        """Of a word: its elements' weights, the strongest denial counting in full."""
        low, high = self.bounds(element)
        # bounded, so that a box in the midst of an article costs less than the paragraphs after it bring
        return max(-0.4, min(self.prior + max(high, 0.0) + 3 * min(low, 0.0) - self.linked * (share > 0.6), 3.0))

    def extract(self, page: str) -> str:
        """Text of the best region."""
        blocks = settle(list(stream(page)))
        scored = self.scores(blocks)
        low, high = best_region(scored)
        return "\n".join(blocks[k][0] for k in range(low, high) if scored[k][2] > 0)

    def scores(self, blocks: list[tuple]) -> list[tuple[float, float, float]]:
        """Of each block: its words' score, that of the tags before it, the weight of one of its words."""
        out = []
        for text, element, n_tags, share in blocks:
            w = self.word_weight(element, share)
            out.append((w * (1 + text.count(" ")), -self.tag * n_tags, w))
        return out


def best_region(scored: list[tuple[float, float, float]]) -> tuple[int, int]:
    """First and end of the contiguous blocks of greatest score, words and the tags between them; none if no score is above 0."""
    best, low, high = 0.0, 0, 0
    total, start = 0.0, 0
    for k, (words, cost, _) in enumerate(scored):
        if total + cost <= 0:
            total, start = 0.0, k
        else:
            total += cost
        total += words
        if total > best:
            best, low, high = total, start, k + 1
        if total <= 0:
            total, start = 0.0, k + 1
    return low, high


def train_pages(table: list[tuple[str, list[str]]] | None = None) -> PageModel:
    """Smoothed log odds of every feature over the table's blocks (a block: one count for each square root of its words)."""
    seen: dict[str, list[float]] = {}
    sides, link_sides = [1.0, 1.0], [1.0, 1.0]
    for page, content in table if table is not None else labelled_pages():
        wanted = set(content)
        for text, element, _, share in settle(list(stream(page))):
            good = int(text in wanted)
            n = math.sqrt(1 + text.count(" "))
            sides[good] += n
            link_sides[good] += share > 0.6
            # of what encloses the content, only the name counts: its classes say nothing of what is inside
            for f in {f for x in (element.path() if element else ()) for f in (x.features[:1] if x.encloses and x.tag in _FRAMES else x.features)}:
                seen.setdefault(f, [0.0, 0.0])[good] += n
    base = math.log(sides[1] / sides[0])
    weights = {f: math.log((a[1] + 0.5) / (a[0] + 0.5)) - base for f, a in seen.items()}
    linked = max(0.0, math.log((link_sides[0] / sides[0]) / (link_sides[1] / sides[1])))
    # structure that holds both kinds says nothing
    weights = {f: w for f, w in weights.items() if abs(w) > 0.7 and not (w < 0 and f in _TEXTUAL)}
    return PageModel(weights, 1.0, 0.1, linked)


def extract_text(pages: DataFrame, model: PageModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    packed = pickle.dumps(model or train_pages())

    def run(batches):
        fitted = pickle.loads(packed)
        for part in chunks(batches, "html"):
            out = [fitted.extract(x) if x else "" for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, fields(pages.select("page_id", "url").schema, "text string, n_chars bigint"))
