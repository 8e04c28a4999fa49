"""Main text of web pages by tag-path ratios.

Every text node has a path of tags from the root. Text length and punctuation are summed for each path, divided by
the path's nodes, smoothed along the page and fused; nodes whose fused ratio reaches a threshold are content. The
article is the smallest part of the page that covers them. In it, lists of links go whose path stays under the
threshold, and so does what mark-up names as something else, unless its path shows that it is prose.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded

#: Fixed values of the HTML standard: elements by their content and by the end tags that they imply.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body head html option tbody td tfoot th thead tr legend".split())
IMPLIED = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table")}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
#: Elements that are never article text.
DROPPED = frozenset("head script style title template noscript iframe object svg math canvas audio video nav footer aside form button select textarea input dialog menu search noembed noframes xmp".split())
#: Words of class, id and role that name readers' comments and adverts; those that name menus, notices and the like; and words that go with either.
NEVER = frozenset("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored comment comments commentlist reply replies respond disqus".split())
NAMED = frozenset(
    "promo promos promotion promotions banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars widget widgets footer masthead discussion cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login paywall share sharing social related recommended recommendations toolbar pagination pager skip copyright disclaimer hidden complementary contentinfo search".split()
)
PLAIN = frozenset("area article articles bar block bottom box button buttons container content form group header icon icons inner item items left link links list main message more outer page panel post posts right section site slot stories text thread title top unit wrap wrapper".split())
COLUMN = frozenset("div section td".split())
MAIN, HEADINGS = frozenset("article main".split()), frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of names that tell readers' comments where nothing of the article follows, whatever stands beside them; words of cookie notices; how a line of rights begins.
TALK = frozenset("comment comments commentlist replies responses reactions feedback thread threads discussion discussions reviews disqus".split())
CONSENT, RIGHTS = frozenset("cookie cookies consent gdpr".split()), re.compile(r"\s*(?:©|\(c\)\s*\d{4}|copyright\s*(?:©|\(c\)|\d{4}))", re.I)
#: Elements whose names are no hints, as their ids come from titles; and those in which a text that is all link is no list of links.
UNNAMED, WORDED = frozenset("html body article main p".split()) | HEADINGS, HEADINGS | frozenset("p blockquote figcaption td th caption pre".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)|<(?=/?\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s\"'>/=]*+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
READ = frozenset("class id role itemprop hidden aria-hidden".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SIGNS = re.compile(r"[.,;:!?…。、，；：！？¡¿]")
#: Spread of the smoothing along the page, in nodes; the threshold's share of the mean ratio of a letter; nodes of a path that make a list of links; and letters of named content, to one of other content, that make a name a wrapper's.
SPREAD, SHARE, LISTED, WRAPPED = 1.0, 0.1, 3, 4
SCHEMA = "page_id long, url string, text string, n_chars long"


class Node:
    """An element. path: a number that elements with the same tags from the root share; hint: 0, or 1 in what is named as
    no article, 2 in comments and adverts; link: in a link; worded: in a heading, paragraph, cell and the like; talk: its name
    may be that of comments; name: its class."""

    __slots__ = ("body", "content", "dropped", "hint", "inside", "link", "name", "parent", "path", "tag", "talk", "worded")

    def __init__(self, tag: str, parent: Node | None, paths: dict[tuple[int, str, int], int], dropped: bool = False, body: bool = False, hint: int = 0):
        self.tag, self.parent, self.dropped, self.body, self.hint, self.content, self.inside = tag, parent, dropped, body, hint, 0, False
        self.talk, self.name = False, ""
        self.link = tag == "a" or parent is not None and parent.link
        self.worded = tag in WORDED or parent is not None and parent.worded
        self.path = paths.setdefault((parent.path if parent else -1, tag, hint), len(paths))


def hinted(value: str) -> int:
    """2 if a name is made of words for comments, adverts and cookies, 1 if of words for menus, notices and the like, else 0."""
    out = 0
    for token in value.split():
        found = {w.lower() for w in WORD.findall(token)}
        if found <= NEVER | NAMED | PLAIN:
            out = max(out, 2 * (not (NEVER | CONSENT).isdisjoint(found)), int(not NAMED.isdisjoint(found)))
    return out


def talked(value: str) -> bool:
    """Whether a name may be that of readers' comments: its last word, or its only known one, says so."""
    return any((found := [w.lower() for w in WORD.findall(token)]) and found[-1] in TALK for token in value.split())


def parsed(page: str) -> tuple[list[Node], list[tuple[Node, int, str]]]:
    """All elements in page order, and (element, block number, raw text) of the text nodes outside dropped elements."""
    paths: dict[tuple[int, str, int], int] = {}
    root = Node("", None, paths)
    every, stack, out, at, block = [root], [root], [], 0, 0
    still: Counter[str] = Counter()

    def pop() -> None:
        still[stack.pop().tag] -= 1

    def close(tags, stops) -> None:
        if not any(still[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                while len(stack) > i:
                    pop()
                if tags.isdisjoint(("td", "th", "tr")):
                    return
            elif stack[i].tag in stops:
                return

    def text(s: str) -> None:
        if s and not stack[-1].dropped:
            out.append((stack[-1], block, s))

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            block += 1
        if m[1]:
            if not still[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i].tag in BLOCK and tag not in BLOCK:
                    break
            continue
        if tag in CLOSES_P and still["p"]:
            close(frozenset(("p",)), frozenset(("td", "th", "table", "button", "object")))
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag == "br" or tag == "hr" or tag == "img":
            text(" ")
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        top = stack[-1]
        dropped, body, hint, talk, own = top.dropped or tag in DROPPED, top.body or tag in MAIN, top.hint, False, ""
        if m[3]:
            for a in ATTRIBUTE.finditer(m[3]):
                name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if name not in READ:
                    continue
                if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                    dropped = True
                elif name == "itemprop" and value.lower() == "articlebody" or name == "role" and value.lower() == "main":
                    body = True
                elif tag not in UNNAMED:
                    hint, talk, own = max(hint, hinted(value)), talk or talked(value), value if name == "class" else own
                elif tag in MAIN and "comment" in value.lower():
                    hint = 2
        if tag == "header" and not top.body:
            dropped = True
        if tag in RAW:
            close_at = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            if not dropped and close_at:
                text(page[at : close_at.start()])
            at = close_at.start() if close_at else end
            continue
        stack.append(Node(tag, top, paths, dropped, body, hint))
        stack[-1].talk, stack[-1].name = talk, own
        every.append(stack[-1])
        still[tag] += 1
    return every, out


def smoothed(x: list[float]) -> list[float]:
    weight = [math.exp(-(d * d) / (2 * SPREAD * SPREAD)) for d in range(-2, 3)]
    out = []
    for i in range(len(x)):
        near = [(weight[d + 2], x[i + d]) for d in range(-2, 3) if 0 <= i + d < len(x)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def ratios(nodes: list[tuple[Node, int, str]]) -> tuple[list[float], list[float]]:
    """The fused ratio of each text node, smoothed and as its path has it: of letters, and of signs, a node of the path."""
    total = defaultdict(lambda: [0, 0, 0])
    for element, _, s in nodes:
        sums = total[element.path]
        sums[0] += len(s)
        sums[1] += len(SIGNS.findall(s))
        sums[2] += 1
    length = [total[e.path][0] / total[e.path][2] for e, _, _ in nodes]
    signs = [total[e.path][1] / total[e.path][2] for e, _, _ in nodes]
    fuse = lambda a, b: [n * (1 + s) for n, s in zip(a, b, strict=True)]
    return fuse(smoothed(length), smoothed(signs)), fuse(length, signs)


def article(every: list[Node], nodes: list[tuple[Node, int, str]], content: list[bool]) -> None:
    """Marks as inside the smallest part of the page that covers the content nodes: every outermost marked main part that
    holds any, or their one article; else the smallest element that holds all, and headings of the first order before it."""
    for e in every:
        e.content = 0
    for (element, _, s), good in zip(nodes, content, strict=True):
        element.content += len(s) * good
    for e in reversed(every[1:]):
        e.parent.content += e.content
    marked = [e for e in every[1:] if e.body and not e.parent.body and e.content]
    for e in [x for x in every if x.tag == "article" and x.parent.tag != "article"] if len(marked) == 1 and marked[0].tag != "article" else ():
        if e.content == marked[0].content:
            marked = [e]
            break
    if not marked:
        # Down from the root while one child holds all.
        top = every[0]
        for e in every[1:]:
            if e.parent is top and e.content == top.content and e.tag != "p" and e.tag in BLOCK | {"html"}:
                top = e
        marked = [top]
    own = set(marked)
    first = marked[0]
    seen = False
    for e in every:
        seen = seen or e is first
        e.inside = e in own or bool(e.parent and e.parent.inside) or not seen and e.tag == "h1" and e.parent is first.parent and not e.hint


def placed(every: list[Node], nodes: list[tuple[Node, int, str]], content: list[bool]) -> None:
    """Hints by place: what follows the article on another path is none of it, however it is called.

    Parts whose name may be that of comments are so if content stands before them and none after. Of articles in an
    article, those are cards of other stories whose heading is a link and that are short beside it. Of two columns beside
    each other, the later one goes if it has a heading and the first has the headings of first order and most letters.
    """
    number = {id(e): i for i, e in enumerate(every)}
    # Each element's end in page order, and what it holds: content letters, letters of headings in links, and the like.
    end = list(range(len(every)))
    for i in range(len(every) - 1, 0, -1):
        up = number[id(every[i].parent)]
        end[up] = max(end[up], end[i])
    at = [number[id(e)] for e, _, _ in nodes]
    weight = [0] * (len(every) + 1)
    for i, (_, _, s), good in zip(at, nodes, content, strict=True):
        weight[i + 1] += len(s) * good
    for i in range(len(every)):
        weight[i + 1] += weight[i]
    held = lambda i: weight[end[i] + 1] - weight[i]
    total = weight[-1]

    def drop(i: int) -> None:
        for e in every[i : end[i] + 1]:
            e.hint = 2

    for i, e in enumerate(every):
        if e.talk and e.hint < 2 and weight[i] and weight[i] + held(i) == total and not e.parent.link:
            drop(i)
    articles = [i for i, e in enumerate(every) if e.tag == "article"]
    inner = [i for i in articles if every[i].parent.body]
    headed: dict[int, list[bool]] = {i: [] for i in inner}
    for e, _, _ in nodes:
        if in_heading(e):
            up = e
            while up is not None and number[id(up)] not in headed:
                up = up.parent
            if up is not None:
                headed[number[id(up)]].append(e.link)
    for i in inner:
        if headed[i] and all(headed[i]) and 4 * held(i) < total:
            drop(i)
    first = [e for e in every if e.tag == "h1"]
    if len(first) == 1 and not first[0].hint:
        h = number[id(first[0])]
        up = first[0].parent
        while up is not None and up.parent is not None:
            i = number[id(up)]
            if up.tag in COLUMN and 10 * held(i) >= 7 * total:
                for j in range(end[i] + 1, end[number[id(up.parent)]] + 1):
                    e = every[j]
                    if e.parent is up.parent and e.tag in COLUMN and e.name != up.name and 4 * held(j) < held(i):
                        begins = next((x for x in every[j + 1 : end[j] + 1] if x.tag in HEADINGS), None)
                        if begins is not None and begins.tag not in ("h1", "h2"):
                            drop(j)
            up = up.parent
    for k, (e, _, _) in enumerate(nodes):
        content[k] = content[k] and not e.hint


def in_heading(e: Node | None) -> bool:
    while e is not None and e.tag not in HEADINGS and e.tag in ("a", "b", "em", "i", "span", "strong"):
        e = e.parent
    return e is not None and e.tag in HEADINGS


def main_text(page: str) -> str:
    """Blocks of the article, in page order, one to a line."""
    every, nodes = parsed(page)
    read = [(e, b, t) for e, b, s in nodes if (t := html.unescape(s)).strip()]
    if not read:
        return ""
    smooth, plain = ratios(read)
    fused = [math.sqrt(x * y) for x, y in zip(smooth, plain, strict=True)]
    letters = sum(len(s) for _, _, s in read)
    least = SHARE * sum(x * len(s) for x, (_, _, s) in zip(plain, read, strict=True)) / letters
    good = [sum(len(s) for x, (e, _, s) in zip(fused, read, strict=True) if x >= least and e.hint == k and not (k and e.body)) for k in range(3)]
    for e in every:  # a wrapper may be named after a part of the page
        if WRAPPED * good[0] < good[1] and e.hint == 1 or not good[0] + good[1]:
            e.hint = 0
    content = [x >= least and not e.hint for x, (e, _, _) in zip(fused, read, strict=True)]
    if not any(content):
        content = [True] * len(read)
    placed(every, read, content)
    article(every, read, content)
    lines: dict[int, list[str]] = {}
    known = {id(e): x for x, (e, _, _) in zip(plain, read, strict=True)}
    times = Counter(e.path for e, _, _ in read)
    alone: dict[int, bool] = {}
    menus = Counter(id(e.parent.parent) for e, _, _ in read if e.tag == "a" and e.parent.tag == "li")
    linked = {b: menus[id(e.parent.parent)] for e, b, _ in read if e.tag == "a" and e.parent.tag == "li"}
    for e, b, _ in read:
        alone[b] = alone.get(b, True) and e.link and not e.worded and known[id(e)] < least and times[e.path] >= LISTED
    rights: dict[int, bool] = {}
    for _, block, s in read:
        rights.setdefault(block, bool(RIGHTS.match(s)))
    good = [b for (_, b, _), g in zip(read, content, strict=True) if g and not rights[b]]
    first, last = (min(good), max(good)) if good else (0, read[-1][1])
    for element, block, s in nodes:
        # Beside the content, a list of links is a menu from two on, and a line of rights is none of the article.
        beside = block < first and linked.get(block, 0) > 1 or block > last and rights.get(block, False)
        if element.inside and not beside and not alone.get(block) and (not element.hint or element.hint == 1 and element.body and known.get(id(element), 0) >= least):
            lines.setdefault(block, []).append(s)
    out = [" ".join(html.unescape("".join(parts)).split()) for parts in lines.values()]
    return "\n".join(x for x in out if x)


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py() or "") for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its code points for every page. One pass without a shuffle.

    A null or empty page, and one without article text, has an empty text. Mark-up that names a part as menu, notice or
    the like drops it outside a marked article, and inside only where its path's ratio is low too; comments and adverts
    go from both. Headings, cells and short items of the article stay, whatever their ratio. A page that breaks off is read as far as it
    goes. page_id and url may be null or repeated: each row gives one row. Other columns of `pages` are not read.
    """
    return bounded(pages).select("page_id", "url", "html").mapInArrow(extracted, SCHEMA)
