"""Main text of web pages by boosted trees over the features of DOM nodes.

A tolerant parser builds the tree of block elements. Trees fitted on generated pages, whose main text is known, give
each node the log odds that it leads to main text. Decoding is hierarchical: a node can only be kept if its parent is,
and of all such labellings of the page's tree the likeliest is taken, so ancestors and descendants never contradict each
other. The text of kept nodes, block by block in page order, is the result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from libraryloom.llm import boosting
from libraryloom.llm.common import runs_by_size, texts_of

#: Fixed values of the language.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Inside a formula everything is inline; its annotations hold its source, which is not shown.
FORMULA = frozenset("maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr mlabeledtr munder munderover none semantics".split())
INLINE |= FORMULA | {"math"}
RAW = frozenset("script style title textarea template noscript iframe svg noembed annotation annotation-xml".split())
RAW_END = {name: re.compile("</" + name, re.I | re.A) for name in RAW | {"xmp"}}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul xmp".split())
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of class, id and role values that page authors give to what is not, and to what is, main text.
AWAY = frozenset("ad ads adv advert advertisement banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disqus dropdown footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted related replies reply search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split())
TOWARDS = frozenset("article articlebody blog body content entry main maincontent page post story text".split())

#: One token at a ``<``. An attribute's value is quoted only right after its equals sign; a quote that nothing closes is a
#: plain character.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?>[\s/]++|[^\s/>][^\s/>=]*+(?>\s*+=\s*+(?>"[^"]*"|'[^']*'|[^\s>]*+))?+)*+)>""", re.S)
#: A tag by its first ``>``, for what follows a tag that does not end outside quotes (a page cut off inside a value).
LOOSE = re.compile(r"""</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)([^>]*)>""")
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?>\s*+=\s*+(?>"([^"]*)"|'([^']*)'|([^\s>]*+)))?+""")
NAMED = frozenset("class id role".split())
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile("[ \t\n\r\f\v\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    away: int = 0
    towards: int = 0
    place: int = 0  # among its siblings
    children: list[int] = field(default_factory=list)
    chars: int = 0
    words: int = 0
    links: int = 0  # characters inside links
    marks: int = 0  # full stops and commas
    digits: int = 0
    tags: int = 0
    own: int = 0  # characters not inside a child


@dataclass
class Page:
    nodes: list[Node]
    blocks: list[tuple[int, str]]  # node and its text, in page order


def parse(source: str) -> Page:
    """The tree of block elements of a page and its blocks of text. Anything parses; node 0 is the page.

    The time is linear in the length of the page, however deep it is and whatever it leaves open.
    """
    nodes = [Node("#page", -1, 0)]
    stack: list[tuple[str, int]] = [("#page", 0)]  # every open element with the node it belongs to
    places: dict[str, list[int]] = {}  # of each name, where it is on the stack
    blocks: list[tuple[int, str]] = []
    parts: list[str] = []
    linked = 0
    at = 0

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip(" ")
            parts.clear()
            if text:
                blocks.append((stack[-1][1], text))

    def pop_to(depth: int) -> None:
        nonlocal linked
        while len(stack) > depth:
            name, _ = stack[-1]
            if name not in INLINE:
                flush()
            elif name == "a":
                linked -= 1
            stack.pop()
            places[name].pop()

    def push(name: str, node: int) -> None:
        places.setdefault(name, []).append(len(stack))
        stack.append((name, node))

    def last(names) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def close(names, until=frozenset()) -> None:
        """Close the innermost of ``names`` with all in it, unless one of ``until`` is open further in."""
        k = last(names)
        if k > last(until):
            pop_to(k)

    def text(raw: str) -> None:
        if raw:
            parts.append(raw)
            if linked and (n := len(raw.strip())):
                nodes[stack[-1][1]].links += n

    size, ends, token = len(source), source.rfind(">"), TOKEN
    while at < size:
        place = source.find("<", at)
        if place > ends:  # no tag ends any more; what an open comment holds is not shown
            place = source.find("<!--", place)
            text(source[at : place if place >= 0 else size])
            break
        text(source[at : place if place >= 0 else size])
        if place < 0:
            break
        m = token.match(source, place)
        if not m and token is TOKEN and source[place + 1].isalpha() and source[place + 1].isascii():
            token = LOOSE
            m = token.match(source, place)
        if not m and token is LOOSE and source[place + 1] in "!?":
            m = TOKEN.match(source, place)
        if not m:
            text("<")
            at = place + 1
            continue
        at = m.end()
        end, start = m.group(1), m.group(2)
        if end:
            name = end.lower()
            if name == "br":
                parts.append(" ")
            else:
                close({name}, {"td", "th", "table"} if name in ("p", "li") else frozenset())
            continue
        if not start:
            continue
        name = start.lower()
        if name in RAW:
            nodes[stack[-1][1]].tags += 1
            if not m.group(3).endswith("/"):
                found = RAW_END[name].search(source, at)
                at = source.find(">", found.end() if found else size) + 1 or size
            continue
        if name in VOID:
            nodes[stack[-1][1]].tags += 1
            if name == "hr":
                flush()
            else:
                parts.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                close({"a"}, ENDS_P | {"td", "th", "li"})
                linked += 1
            nodes[stack[-1][1]].tags += name not in FORMULA  # a formula counts once
            if not (name in FORMULA or name == "math") or not m.group(3).endswith("/"):
                push(name, stack[-1][1])
            continue
        if name in ENDS_P:
            close({"p"}, {"td", "th", "table", "button"})
        if name in CLOSED_BY:
            close(*CLOSED_BY[name])
        flush()
        parent = stack[-1][1]
        node = Node(name, parent, nodes[parent].depth + 1, place=len(nodes[parent].children))
        for key, *found in ATTRIBUTE.findall(m.group(3)):
            if key.lower() not in NAMED:
                continue
            own = WORDS.findall("".join(found).lower())
            node.away += sum(w in AWAY for w in own)
            node.towards += sum(w in TOWARDS for w in own)
        nodes[parent].children.append(len(nodes))
        push(name, len(nodes))
        nodes.append(node)
        if name == "xmp":  # its text is as it stands, without tags and entities
            found = RAW_END[name].search(source, at)
            block = SPACE.sub(" ", source[at : found.start() if found else size]).strip(" ")
            at = source.find(">", found.end() if found else size) + 1 or size
            if block:
                blocks.append((stack[-1][1], block))
            pop_to(len(stack) - 1)
    pop_to(1)
    flush()
    for i, block in blocks:
        node = nodes[i]
        node.own += len(block)
        node.chars += len(block)
        node.words += block.count(" ") + 1
        node.marks += block.count(".") + block.count(",")
        node.digits += sum(block.count(d) for d in "0123456789")
    for node in reversed(nodes[1:]):  # children come after their parents
        up = nodes[node.parent]
        up.chars += node.chars
        up.words += node.words
        up.links += node.links
        up.marks += node.marks
        up.digits += node.digits
        up.tags += node.tags + 1
    return Page(nodes, blocks)


GROUPS = ({"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "menu", "dl"}, {"li", "dt", "dd"}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "button", "select", "option", "dialog"}, {"article", "main"}, {"div", "section"}, {"table", "tbody", "thead", "tr", "td", "th"}, {"blockquote", "pre", "xmp", "figure", "figcaption"}, {"html", "body", "#page"}, {"head"})
_group = {tag: k for k, tags in enumerate(GROUPS) for tag in tags}


def features(page: Page) -> np.ndarray:
    """A row for each node: kind, attribute words, depth, subtree density, its siblings, and what its ancestors are."""
    nodes = page.nodes
    whole = max(1, nodes[0].chars)
    rows = np.zeros((len(nodes), len(GROUPS) + 24), dtype=np.float32)
    above = np.zeros((len(nodes), 5), dtype=np.float32)
    for i, n in enumerate(nodes):
        k = _group.get(n.tag)
        if k is not None:
            rows[i, k] = 1
        if i:
            up = nodes[n.parent]
            above[i] = above[n.parent]
            above[i, 0] += up.away
            above[i, 1] += up.towards
            g = _group.get(up.tag, -1)
            above[i, 2] += g in (4, 5, 6, 7)
            above[i, 3] += g == 8
            above[i, 4] += g == 9
        else:
            up = n
        beside = len(up.children)
        before = nodes[up.children[n.place - 1]] if i and n.place else None
        after = nodes[up.children[n.place + 1]] if i and n.place + 1 < beside else None
        chars = max(1, n.chars)
        rows[i, len(GROUPS) :] = (
            np.log1p(n.chars), np.log1p(n.words), n.links / chars, 100 * n.tags / chars, len(n.children), n.depth,
            n.place / max(1, beside), beside, n.chars / whole, n.chars / max(1, n.words), n.marks / max(1, n.words), n.digits / chars,
            n.own / chars, n.away, n.towards, *above[i], np.log1p(up.chars), n.chars / max(1, up.chars),
            np.log1p(before.chars) if before else -1, np.log1p(after.chars) if after else -1,
        )
    return rows


def decode(page: Page, logits: np.ndarray) -> np.ndarray:
    """The likeliest labelling in which no node is kept under one that is not."""
    nodes = page.nodes
    keep = logits.astype(np.float64).copy()  # gain of keeping a node with the best below it, over dropping all of it
    for i in range(len(nodes) - 1, 0, -1):
        if keep[i] > 0:
            keep[nodes[i].parent] += keep[i]
    out = np.zeros(len(nodes), dtype=bool)
    out[0] = keep[0] > 0
    for i in range(1, len(nodes)):
        out[i] = out[nodes[i].parent] and keep[i] > 0
    return out


# -- generated pages with known main text -------------------------------------------------------------------------------

MARK = "\ue000"


def generated_page(rng: np.random.Generator) -> str:
    """A page of a random layout; MARK stands at the start of each block of its main text."""
    syllables = "an er in on the st re en ti es al or ar ou le ma vi so ke lu".split()

    def word(a: int = -1) -> str:
        a = int(rng.integers(9261)) if a < 0 else a
        return "".join(syllables[k - 1] for k in (a % 21, a // 21 % 21, a // 441) if k) or "a"

    def prose(low: int, high: int) -> str:
        n = int(rng.integers(low, high + 1))
        out = [word(a) + ("" if m > 11 else "," if m > 5 else ".") for a, m in zip(rng.integers(9261, size=n).tolist(), rng.integers(100, size=n).tolist(), strict=True)]
        return (" ".join(out) + ("." if rng.random() < 0.8 else "")).capitalize()

    def pick(*options: str) -> str:
        return options[rng.integers(len(options))]

    def attribute(*names: str) -> str:
        return f' {pick("class", "id")}="{pick(*names)}"' if rng.random() < 0.9 else ""

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{prose(1, 3)}</a></li>' for _ in range(n))

    def main_blocks() -> str:
        out = []
        if rng.random() < 0.8:
            out.append(f"<h1>{MARK}{prose(2, 12)}</h1>")
        for _ in range(int(rng.integers(1, 12))):
            kind = rng.random()
            if kind < 0.75:
                inside = prose(1, 5) if rng.random() < 0.2 else prose(8, 150)
                if rng.random() < 0.2:
                    inside = f"<b>{inside}" + pick("</b>", "<br>", "")
                if rng.random() < 0.15:
                    inside += f' <a href="/{word()}">{prose(1, 4)}</a> {prose(2, 20)}'
                out.append(f"<p>{MARK}{inside}" + ("" if rng.random() < 0.15 else "</p>"))
            elif kind < 0.83:
                out.append(f"<h{rng.integers(2, 5)}>{MARK}{prose(1, 8)}</h2>")
            elif kind < 0.91:
                out.append("<ul>" + "".join(f"<li>{MARK}{prose(2, 25)}</li>" for _ in range(rng.integers(2, 6))) + "</ul>")
            elif kind < 0.95:
                out.append(f"<blockquote>{MARK}{prose(5, 40)}</blockquote>")
            elif kind < 0.97:
                out.append("<table>" + "".join(f"<tr><td>{MARK}{prose(1, 5)}</td><td>{MARK}{prose(1, 5)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                out.append(f'<div class="{pick("ad", "advert", "promo", "share", "sponsored")}">{prose(3, 25)}</div>')
        return "".join(out)

    def before() -> list[str]:
        return [
            f"<nav{attribute('nav', 'menu', 'navbar')}><ul>{links(int(rng.integers(2, 10)))}</ul></nav>" if rng.random() < 0.7 else f'<div class="{pick("menu", "nav", "navigation")}"><ul>{links(int(rng.integers(2, 10)))}</ul></div>',
            f"<header{attribute('header', 'masthead', 'top')}><h1>{prose(1, 5)}</h1><p>{prose(2, 12)}</p></header>" if rng.random() < 0.5 else "",
            f'<div class="{pick("ad", "ads", "advert", "banner", "promo")}">{prose(2, 40)}</div>' if rng.random() < 0.7 else "",
            f'<div class="{pick("cookie", "cookie-notice", "notice", "consent", "gdpr banner")}"><p>{prose(5, 40)}</p><button>{prose(1, 2)}</button></div>' if rng.random() < 0.4 else "",
            f'<form action="/q">{prose(1, 3)}<input name="q"><button>{prose(1, 2)}</button></form>' if rng.random() < 0.3 else "",
            f'<div class="breadcrumbs"><a href="/">{prose(1, 2)}</a> <a href="/x">{prose(1, 2)}</a></div>' if rng.random() < 0.3 else "",
        ]

    def after() -> list[str]:
        comments = "".join(f"<div{attribute('comment', 'reply')}><p>{prose(4, 60)}</p></div>" for _ in range(int(rng.integers(1, 6))))
        return [
            f"<aside{attribute('sidebar', 'related', 'widget')}><h3>{prose(1, 3)}</h3><ul>{links(int(rng.integers(2, 8)))}</ul><p>{prose(3, 30)}</p></aside>" if rng.random() < 0.6 else f'<div class="{pick("sidebar", "related", "widget")}"><p>{prose(3, 40)}</p></div>',
            f"<{pick('section', 'div')} {pick('class', 'id')}=\"{pick('comments', 'comment-list', 'replies', 'disqus')}\"><h2>{prose(1, 2)}</h2>{comments}<form>{prose(1, 4)}<textarea></textarea><button>ok</button></form></div>" if rng.random() < 0.5 else "",
            f'<div class="{pick("newsletter", "subscribe", "signup")}"><form><p>{prose(4, 25)}</p><input><button>{prose(1, 2)}</button></form></div>' if rng.random() < 0.3 else "",
            f"<footer{attribute('footer', 'bottom')}>&copy; {word()}.example &middot; {prose(2, 40)}</footer>" if rng.random() < 0.75 else f'<div class="footer"><p>&copy; {prose(2, 30)}</p></div>',
        ]

    kind = rng.random()
    if kind < 0.03:
        return f"{MARK}{prose(3, 200)}"
    if kind < 0.07:
        return "<html><body>" + main_blocks() + "</body></html>"
    core = main_blocks()
    core = pick(f"<article>{core}</article>", f"<main>{core}</main>", f'<main><article class="post">{core}</article></main>', f'<div class="{pick("content", "entry-content", "post", "story", "article-body", "main-content")}">{core}</div>', f"<article>{core}</article>", f"<div><div>{core}</div></div>", f'<section id="{pick("content", "main", "text")}">{core}</section>')
    first, last = before(), after()
    rng.shuffle(first)
    body = "".join(first) + core + "".join(last)
    if rng.random() < 0.3:
        body = f'<div id="{pick("page", "wrapper", "container")}">{body}</div>'
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{prose(2, 8)}</title><style>p{{margin:0}}</style><script>var t = "</p>";</script></head><body>{body}</body></html>'


PAGES = 900


@lru_cache(maxsize=4)
def fit_model(pages: int = PAGES, seed: int = 5) -> boosting.Trees:
    """Trees fitted on generated pages, once in a process; no page of any table is used, so nothing needs labels."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        page = parse(generated_page(rng))
        y = np.zeros(len(page.nodes))
        for i, text in page.blocks:
            if text.startswith(MARK):
                while i >= 0 and not y[i]:
                    y[i] = 1
                    i = page.nodes[i].parent
        xs.append(features(page))
        ys.append(y)
    return boosting.fit(np.concatenate(xs), np.concatenate(ys))


def extract(sources: list[str], model: boosting.Trees) -> list[str]:
    """The main text of each page: kept blocks in page order, one line each."""
    pages = [parse(s) for s in sources]
    out = []
    logits = model.logits(np.concatenate([features(p) for p in pages])) if pages else np.zeros(0)
    at = 0
    for page in pages:
        keep = decode(page, logits[at : at + len(page.nodes)])
        at += len(page.nodes)
        out.append("\n".join(text for i, text in page.blocks if keep[i]))
    return out


def extract_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    A null or empty page, or one without main text, has an empty text; pages of any length are read whole. Rows are
    independent of each other: repeated rows give equal results, nulls in page_id and url are handed on, and other
    columns are ignored. An empty table gives an empty result.
    """
    shared = spark.sparkContext.broadcast(fit_model())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = texts_of(batch.column(2))
            for i, j in runs_by_size([len(x) for x in body], 500_000):
                text = extract(body[i:j], shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
