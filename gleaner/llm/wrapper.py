"""Main text of pages by wrappers: union-free regular expressions inferred per host.

A page is a stream of tags and texts; balanced tags make it nested. A wrapper is such a stream in
which every element may be optional or repeated, and every text is either fixed or a slot. Streams
of one host are aligned one after the other: elements are matched in order by tag, label (the words
of class, id and role) and the tags inside them; elements that only one side has become optional;
neighbours that are alike, and paragraphs, headings and lists that take turns, become repeated
groups; texts that differ become slots, and so do labels, of which only the common words stay.
Merging is associative enough to be done in any order: inside each task over its pages, then over
the tasks' different wrappers, first by salt, then by host.

A page's ``article`` and ``main`` elements are its article, but for nested ones and for teasers (all
text in links, or inside furniture while others are not). For pages without them the wrapper tells
which element is the article. Going down from the root, text that is the same on all pages and text
of links do not count. A single child with text that counts is entered; of several boxes one is,
if it has the heading and each of the others has less than a third of its text. Else all of them
are the article.

Inside the article texts are layout, and left out, that stand on every page of the host, in the same
place and with the same text, where other text of the article changes from page to page; so menus
that all pages share go, while lists of links that differ stay. What only some pages have is never
layout. Names decide little there: of boxes and lists, those go whose class or id is a name of
furniture as a whole (``comments``, ``share-bar``, not ``comments-on-method``); headings, paragraphs
and quotes stay. Outside any known place of an article every word of class and id counts, and boxes
of links alone are menus.

Pages are read by a small reader of tokens; wrappers hold no page text but fixed strings. A wrapper
has a size set by the layout, not by the number of pages: labels that differ from page to page drop
out, so their elements meet in one group.

Defined cases: null html is empty and gives an empty text; a null url has its own host ''; cut-off
pages end all open elements; unknown or stray tags are kept or skipped as they come; elements nested
deeper than ``DEPTH`` count as side by side; repeated rows give repeated results; a host of one page,
or of equal ones, has a wrapper without slots, whose texts all count. Columns other than the three
named ones are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.base import small_batches, stored

# One token: a comment, a declaration, a tag, or text. An unclosed one reaches the end.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|([^<]+|<)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"[ \t\n\x0b\x0c\r\x85\xa0  -     　]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Contents that are no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
# Elements that text flows through.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
# A start tag of the key ends open elements of the value, up to the limit.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# What no article holds: elements, roles, and words of class and id.
FURNITURE_TAGS = frozenset("nav footer aside form script style noscript template iframe svg canvas object button select textarea dialog menu head title fieldset audio video math".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead topbar footer foot sidebar side aside widget related recommended comment comments "
    "respond replies disqus share sharing social cookie cookies consent notice notices popup modal overlay newsletter subscribe "
    "subscription signup login form search pagination pager toolbar skip legal copyright disclaimer alert gdpr paywall toc".split()
)
FURNITURE_STARTS = ("advert", "breadcrumb", "comment", "cookie", "footer", "navbar", "newsletter", "sidebar", "subscri")
# Those that do as a name inside an article, and words that may stand beside them in a name.
NAMES = FURNITURE_WORDS - frozenset("alert copyright disclaimer foot form header legal masthead search side skip toc topbar".split())
BESIDE_NAMES = frozenset("area article bar block box button buttons container content inner items links list outer post section site slot this thread top unit wrap wrapper".split())
# What a name never cuts inside an article, but for adverts.
TEXT_TAGS = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 li dt dd code em strong b i a".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored".split())
# Words that only say what the element stands beside.
BESIDE = re.compile(r"\b(?:has|with|without|no|is)[-_]\w+(?:[-_]\w+)*")
ARTICLE_TAGS = ("article", "main")
# Lists and boxes that hold nothing but several links are menus.
LINK_BOXES = frozenset("ul ol div section table".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# Boxes are alike by what is in them; of all other elements the tag is enough.
BOXES = frozenset("div section article main header body html table tbody tr td center".split())
# Boxes are matched that have this share of their tags in common, and folded with this one.
MATCHED, FOLDED = 0.25, 0.75
# Neighbours of one tag with more labels than these have labels that vary.
LABELS = 32
# Beside the article's box, others hold less than this share of its text.
OTHERS = 1 / 3
# Elements nested deeper are read as side by side.
DEPTH = 200
# Wrappers kept in a task before they are sent on, and tasks' wrappers of one host merged at once.
HELD_HOSTS, HELD_CHARS = 5_000, 64_000_000
SALTS = 16


class Element:
    """An element of a page: tag, label, what its name says, children and texts."""

    __slots__ = ("tag", "label", "furniture", "named", "aside", "items", "cleared")

    def __init__(self, tag: str, label: list[str], furniture: bool, named: bool, aside: bool) -> None:
        self.tag, self.label, self.items = tag, label, []
        self.furniture = furniture  # by tag, role or being hidden
        self.named = named  # a word of its name is one of furniture
        self.aside = aside  # its name is one of furniture
        self.cleared = False  # called furniture, but holds an article


def is_name(token: str, names: frozenset[str]) -> bool:
    """Is a class or id, as a whole, a name of furniture?"""
    words = [w for w in re.split(r"[^a-z]+", token) if w]
    return any(w in names for w in words) and all(w in names or w in BESIDE_NAMES for w in words)


def describe(tag: str, raw: str) -> Element:
    """An element by its start tag."""
    if not raw or "=" not in raw and "hidden" not in raw:
        return Element(tag, [], tag in FURNITURE_TAGS, False, False)
    attributes = {}
    for m in ATTRIBUTE.finditer(raw):
        attributes.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    label = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    tokens = re.sub(r"([a-z])([A-Z])", r"\1 \2", label).lower()
    words = set(re.split(r"[^a-z]+", BESIDE.sub(" ", tokens)))
    named = bool(words & FURNITURE_WORDS) or any(w.startswith(FURNITURE_STARTS) for w in words)
    names = ADVERTS if tag in TEXT_TAGS else NAMES
    aside = named and any(is_name(t, names) for t in re.sub(r"([a-z])([A-Z])", r"\1-\2", label).lower().split())
    role = attributes.get("role", "").lower()
    style = attributes.get("style", "").replace(" ", "").lower()
    furniture = (
        tag in FURNITURE_TAGS
        or role in FURNITURE_ROLES
        or "hidden" in attributes
        or attributes.get("aria-hidden", "").lower() == "true"
        or "display:none" in style
        or "visibility:hidden" in style
    )
    outer = tag in ("html", "body", *ARTICLE_TAGS)
    # numbers in class and id differ from page to page
    found = sorted({re.sub(r"\d+", "0", w) for w in label.split()}) + ([f"role={role}"] if role else [])
    return Element(tag, found, furniture, named and not outer and tag not in HEADINGS, aside and not outer)


def read_page(html: str | None) -> Element:
    """Nested elements of a page."""
    root = Element("", [], False, False, False)
    stack = [root]
    source = html or ""
    at = deeper = 0
    while at < len(source):
        m = TOKEN.match(source, at)
        at = m.end()
        if m[4] is not None:
            stack[-1].items.append(m[4])
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if deeper and tag not in VOID:
                deeper -= 1
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        if tag not in INLINE and not deeper:
            _close(stack, tag)
        element = describe(tag, m[3])
        stack[-1].items.append(element)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
            at = end.end() if end else len(source)
        elif tag not in VOID and not m[3].endswith("/"):
            if len(stack) > DEPTH:
                deeper += 1
            else:
                stack.append(element)
        if tag in ARTICLE_TAGS:  # what holds an article is no furniture, whatever its name
            for above in stack[:-1]:
                above.cleared = above.cleared or above.furniture or above.named
                above.furniture = above.named = above.aside = False
    return root


def only_links(element: Element) -> bool:
    """Does a box hold several links and no other text?"""

    def look(e: Element, linked: bool) -> tuple[int, bool]:
        links, other = 0, False
        for item in e.items:
            if isinstance(item, str):
                other = other or (not linked and bool(plain(item)))
            else:
                n, o = look(item, linked or item.tag == "a")
                links, other = links + n + (item.tag == "a"), other or o
            if other:
                break
        return links, other

    links, other = look(element, False)
    return links > 1 and not other


def _close(stack: list[Element], tag: str) -> None:
    """End what a block's start tag ends: an open paragraph, and neighbours of its kind."""
    for depth in range(len(stack) - 1, 0, -1):
        open_tag = stack[depth].tag
        if open_tag in ("p", *HEADINGS) if tag not in HEADINGS else open_tag == "p" or open_tag in HEADINGS:
            del stack[depth:]
            break
        if open_tag not in INLINE:
            break
    if tag in ENDS:
        ended, limit = ENDS[tag]
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in limit:
                break
            if stack[depth].tag in ended:
                del stack[depth:]
                break


def plain(text: str) -> str:
    """Text with character references decoded and white space turned into single blanks."""
    if "&" in text:
        text = entities.unescape(text)
    return SPACE.sub(" ", text).strip(" ")


# A wrapper element as plain data, so that it can be stored: tag, label, furniture by tag or role,
# furniture by a word of its name, optional, repeated, characters outside links, text if fixed (one
# line per element of a group), children
TAG, LABEL, FURNITURE, NAMED, OPTIONAL, REPEATED, CHARS, FIXED, CHILDREN = range(9)


def own_text(element: Element) -> tuple[str, int]:
    """Text of an element outside its block children, inline ones included, and its length without links."""
    parts: list[str] = []
    linked: list[str] = []

    def collect(e: Element, link: bool) -> None:
        for item in e.items:
            if isinstance(item, str):
                parts.append(item)
                if link:
                    linked.append(item)
            elif item.tag in INLINE and not item.furniture:
                collect(item, link or item.tag == "a")

    collect(element, element.tag == "a")
    text = plain("".join(parts))
    return text, max(0, len(text) - len(plain("".join(linked)))) if linked else len(text)


def block_children(element: Element) -> Iterator[Element]:
    for item in element.items:
        if not isinstance(item, str):
            if item.tag in INLINE and not item.furniture:
                yield from block_children(item)
            else:
                yield item


def as_wrapper(element: Element) -> list:
    """The wrapper of one page's element: its own text is fixed until another page differs."""
    below = [] if element.furniture else block_children(element)
    children = [as_wrapper(c) for c in below if c.tag not in VOID and c.tag not in RAW]
    text, chars = ("", 0) if element.furniture else own_text(element)
    return [element.tag, element.label, element.furniture, element.named, False, False, chars, text, folded(children)]


def inside(w: list) -> tuple[set[str], set[str]]:
    """Tags of the children that every such element has, and of all."""
    return {c[TAG] for c in w[CHILDREN] if not c[OPTIONAL]}, {c[TAG] for c in w[CHILDREN]}


def likeness(a: list, b: list) -> float:
    """Share of tags that both have, of those that one always has: 1 for two elements without children."""
    (need_a, all_a), (need_b, all_b) = inside(a), inside(b)
    need = need_a | need_b
    return 1 - len((need_a - all_b) | (need_b - all_a)) / len(need) if need else 1.0


def affinity(a: list, b: list) -> float:
    """How well two elements match, 0 if they are not one of the other's kind."""
    if a[TAG] != b[TAG] or a[FURNITURE] != b[FURNITURE]:
        return 0.0
    label = 1.0 if a[LABEL] == b[LABEL] else 0.5 if set(a[LABEL]) & set(b[LABEL]) else 0.0
    alike = likeness(a, b)
    if a[TAG] in BOXES and alike <= MATCHED and not set(a[LABEL]) & set(b[LABEL]):
        return 0.0
    return 1 + label + 2 * alike


def folded(children: list[list]) -> list[list]:
    """Children with neighbours that are alike, and texts that take turns, as repeated groups."""
    labels: dict[str, set] = {}
    for c in children:
        if c[TAG] in BOXES:
            labels.setdefault(c[TAG], set()).add(tuple(c[LABEL]))
    out: list[list] = []
    run = 0  # where the present run of other elements than boxes starts
    for c in children:
        if len(labels.get(c[TAG], ())) > LABELS:
            c = [c[TAG], [], *c[FURNITURE:]]
        if c[TAG] in BOXES or c[FURNITURE]:
            last = out[-1] if out else None
            if last and last[TAG] == c[TAG] and last[FURNITURE] == c[FURNITURE] and last[LABEL] == c[LABEL] and likeness(last, c) >= FOLDED:
                out[-1] = grouped(last, c)
            else:
                out.append(c)
            run = len(out)
            continue
        same = next((i for i in range(run, len(out)) if out[i][TAG] == c[TAG]), None)
        if same is None:
            out.append(c)
        else:  # all from the first of its tag on take turns
            out[same] = grouped(out[same], c)
            for i in range(same + 1, len(out)):
                out[i] = [*out[i][:REPEATED], True, *out[i][CHARS:]]
    return out


def grouped(a: list, b: list) -> list:
    """Two elements of a page as one repeated group; its fixed text has a line for each."""
    w = merged(a, b)
    fixed = None if a[FIXED] is None or b[FIXED] is None else "\n".join(filter(None, (a[FIXED], b[FIXED])))
    return [*w[:OPTIONAL], a[OPTIONAL] and b[OPTIONAL], True, w[CHARS], fixed, w[CHILDREN]]


def merged(a: list, b: list) -> list:
    """The wrapper of two elements that match."""
    label = a[LABEL] if a[LABEL] == b[LABEL] else sorted(set(a[LABEL]) & set(b[LABEL]))
    return [
        a[TAG], label, a[FURNITURE], a[NAMED] and b[NAMED], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED],
        a[CHARS] + b[CHARS], a[FIXED] if a[FIXED] == b[FIXED] else None, folded(aligned(a[CHILDREN], b[CHILDREN])),
    ]


def aligned(a: list[list], b: list[list]) -> list[list]:
    """Children of two elements, matched in order where it is best; what only one side has is optional."""
    if [c[:NAMED] for c in a] == [c[:NAMED] for c in b] and all(affinity(x, y) for x, y in zip(a, b, strict=True)):
        return [merged(x, y) for x, y in zip(a, b, strict=True)]
    # repeated groups keep both lists short
    match = [[affinity(x, y) for y in b] for x in a]
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            both = best[i + 1][j + 1] + match[i][j] if match[i][j] else 0.0
            best[i][j] = max(both, best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and match[i][j] and best[i][j] == best[i + 1][j + 1] + match[i][j]:
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i][j] == best[i + 1][j]):
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    return out


def optional(w: list) -> list:
    """An element that only some pages have; its texts can't be layout and are slots."""
    w = without_text(w)
    return [*w[:OPTIONAL], True, *w[REPEATED:]]


def without_text(w: list) -> list:
    return [*w[:FIXED], None if w[FIXED] != "" else "", [without_text(c) for c in w[CHILDREN]]]


def shape(w: list) -> str:
    """The wrapper as the regular expression it stands for; texts as #, fixed ones quoted."""
    inner = [] if w[FIXED] == "" else ["#" if w[FIXED] is None else json.dumps(w[FIXED])]
    inner += [shape(c) for c in w[CHILDREN]]
    mark = {(True, True): "*", (True, False): "?", (False, True): "+"}.get((w[OPTIONAL], w[REPEATED]), "")
    return f"({' '.join([w[TAG], *w[LABEL]])}{''.join(f' {x}' for x in inner)}){mark}"


def chars(w: list, everything: bool) -> int:
    """Characters outside links and furniture; without ``everything`` only of texts that change."""
    if w[FURNITURE] or w[NAMED]:
        return 0
    own = w[CHARS] if everything or w[FIXED] is None else 0
    return own + sum(chars(c, everything) for c in w[CHILDREN])


def headings(w: list, everything: bool) -> set[str]:
    """Tags of the headings whose text counts."""
    if w[FURNITURE] or w[NAMED]:
        return set()
    own = {w[TAG]} if w[TAG] in HEADINGS and chars(w, everything) else set()
    return own.union(*(headings(c, everything) for c in w[CHILDREN]))


def article_path(w: list) -> list[int]:
    """Positions, from the root down, of the element that is the article."""
    everything = not chars(w, False)
    title = min(headings(w, everything), default=None)
    path: list[int] = []
    while not w[CHARS] or not (everything or w[FIXED] is None):
        holders = [(chars(c, everything), i) for i, c in enumerate(w[CHILDREN]) if chars(c, everything)]
        if not holders:
            break
        size, at = max(holders, key=lambda x: (x[0], -x[1]))
        found, others = w[CHILDREN][at], [(n, w[CHILDREN][i]) for n, i in holders if i != at]
        # a paragraph is not a place for an article: stop above single blocks of text
        if found[REPEATED] or not found[CHILDREN] or found[TAG] not in BOXES:
            break
        if others:
            split = title is None or title not in headings(found, everything) or any(title in headings(c, everything) for _, c in others)
            if split or any(c[TAG] not in BOXES or n >= OTHERS * size for n, c in others):
                break
        w = found
        path.append(at)
    return path


def fixed_texts(w: list, path: list[str], articles: bool = True) -> list[str]:
    """Places and texts of elements that every page of a host has with the same text."""
    out = []
    for c in w[CHILDREN]:
        if not c[OPTIONAL] and not c[FURNITURE] and (articles or c[TAG] not in ARTICLE_TAGS):
            here = [*path, c[TAG]]
            if c[FIXED]:
                out += [placed(here, text) for text in c[FIXED].split("\n")]
            out += fixed_texts(c, here, articles)
    return out


def placed(path: list[str], text: str) -> str:
    return "\n".join([*path, text])


def varies(w: list) -> bool:
    """Do texts change from page to page?"""
    return any(c[OPTIONAL] or c[FIXED] is None or varies(c) for c in w[CHILDREN] if not c[FURNITURE])


def named_articles(w: list) -> Iterator[list]:
    """The ``article`` and ``main`` elements that every page of a host has once."""
    for c in w[CHILDREN]:
        if not c[OPTIONAL] and not c[REPEATED] and not c[FURNITURE]:
            if c[TAG] in ARTICLE_TAGS:
                yield c
            else:
                yield from named_articles(c)


def stub(w: list) -> list:
    """An element without texts and with the bare tags of its children: enough to tell what matches it."""
    below = [[c[TAG], [], False, False, c[OPTIONAL], False, 0, "", []] for c in w[CHILDREN]]
    return [*w[:CHARS], 0, "", below]


def rule(pages: int, w: list) -> dict:
    """What extraction needs of a wrapper: the steps to the article's place and the texts to leave out."""
    main, steps, tags = w, [], []
    for at in article_path(w):
        steps.append([at, [stub(c) for c in main[CHILDREN]]])
        main = main[CHILDREN][at]
        tags.append(main[TAG])
    layout = []
    if pages > 1:
        for place in named_articles(w):
            layout += fixed_texts(place, [place[TAG]]) if varies(place) else []
        if varies(main) and not set(tags) & set(ARTICLE_TAGS):
            layout += fixed_texts(main, tags[-1:], articles=False)
    return {"steps": steps, "tags": tags, "layout": sorted(layout)}


def follow(root: Element, found: dict) -> Element | None:
    """The element of a page that is in the place of the article, if it has the place."""
    for at, kinds in found["steps"]:
        best: tuple[float, int] = (0.0, 0)
        chosen = None
        for c in block_children(root):
            w = stub(as_wrapper(c))
            fits = [affinity(w, k) for k in kinds]
            size = chars(as_wrapper(c), True)
            if fits[at] and fits[at] == max(fits) and (fits[at], size) > best:
                best, chosen = (fits[at], size), c
        if chosen is None:
            return None
        root = chosen
    return root


def page_articles(root: Element) -> list[Element]:
    """A page's ``article`` and ``main`` elements: outermost ones that are no teasers."""
    found: list[tuple[Element, bool]] = []

    def look(element: Element, beside: bool) -> None:
        for item in block_children(element):
            if item.furniture or item.named:
                continue
            if item.tag in ARTICLE_TAGS and not_linked(item):
                found.append((item, beside))
            elif item.tag not in ARTICLE_TAGS:
                look(item, beside or item.cleared)

    look(root, False)
    return [e for e, beside in found if not beside] or [e for e, _ in found]


def not_linked(element: Element) -> bool:
    """Is there text outside links and furniture?"""
    for item in element.items:
        if isinstance(item, str):
            if plain(item):
                return True
        elif item.tag != "a" and not item.furniture and not item.aside and not_linked(item):
            return True
    return False


def extract(html: str | None, found: dict | None) -> str:
    """Main text of one page, its blocks joined by line breaks."""
    root = read_page(html)
    places = page_articles(root)
    known = bool(places)
    if not places and found and found["steps"]:
        place = follow(root, found)
        places = [place] if place is not None else []
        # html and body are no place of their own
        known = bool(places) and bool(set(found["tags"]) - {"html", "body"})
    if not places:  # this page lacks the place: take all that is no furniture
        places = [root]
    layout = Counter((found or {}).get("layout", []))
    blocks: list[str] = []
    current: list[str] = []

    def end(path: list[str]) -> None:
        text = plain("".join(current))
        current.clear()
        if text and layout:
            place = placed(path, text)
            if layout[place] > 0:
                layout[place] -= 1
                return
        if text:
            blocks.append(text)

    def walk(element: Element, path: list[str]) -> None:
        for item in element.items:
            if isinstance(item, str):
                current.append(item)
            elif item.furniture or (item.aside if known else item.named or item.tag == "header"):
                continue
            elif not known and item.tag in LINK_BOXES and only_links(item):
                end(path)
            elif item.tag == "br":
                current.append(" ")
            elif item.tag in INLINE:
                walk(item, path)
            else:
                end(path)
                below = [*path, item.tag]
                walk(item, below)
                end(below)

    for element in places:
        at = [element.tag] if element is not root else []
        walk(element, at)
        end(at)
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(F.substring_index(F.regexp_extract(F.coalesce(url, F.lit("")), r"://(.*)$", 1), "/", 1), "?", 1), "#", 1)
    return F.lower(rest)


def page_wrappers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Wrappers of a task's pages, one per host; pages already covered by it change nothing."""
    held: dict[str, tuple[int, list]] = {}
    size = 0

    def send() -> pd.DataFrame:
        rows = [(h, n, json.dumps(w, ensure_ascii=False)) for h, (n, w) in sorted(held.items())]
        held.clear()
        return pd.DataFrame(rows, columns=["host", "pages", "wrapped"])

    for f in frames:
        for host, page in zip(f["host"], f["html"], strict=True):
            w = as_wrapper(read_page(page))
            if host in held:
                n, old = held[host]
                held[host] = n + 1, merged(old, w)
            else:
                held[host] = 1, w
                size += len(page or "")
            if len(held) > HELD_HOSTS or size > HELD_CHARS:
                yield send()
                size = 0
    if held:
        yield send()


def merge_wrappers(frame: pd.DataFrame) -> pd.DataFrame:
    pages, out = 0, None
    for n, text in sorted(zip(frame["pages"], frame["wrapped"], strict=True), key=lambda x: x[1]):
        w = json.loads(text)
        out = w if out is None else merged(out, w)
        pages += int(n)
    return pd.DataFrame({"host": [frame["host"].iloc[0]], "pages": [pages], "wrapped": [json.dumps(out, ensure_ascii=False)]})


def infer(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, pages, wrapped): one wrapper per host, from all its pages."""
    small_batches(pages.sparkSession)
    schema = "host string, pages long, wrapped string"
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    parts = rows.mapInPandas(page_wrappers, schema)
    # equal wrappers of many tasks count as one, and a host's others meet in two steps
    parts = parts.groupBy("host", "wrapped").agg(F.sum("pages").alias("pages")).select("host", "pages", "wrapped")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapped"), F.lit(SALTS)))
    some = salted.groupBy("host", "salt").applyInPandas(merge_wrappers, schema)
    return some.groupBy("host").applyInPandas(merge_wrappers, schema)


def rules(wrappers: DataFrame) -> DataFrame:
    """(host, rule): what extraction needs of each wrapper."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [json.dumps(rule(int(n), json.loads(w)), ensure_ascii=False) for n, w in zip(f["pages"], f["wrapped"], strict=True)]
            yield pd.DataFrame({"host": f["host"], "rule": found})

    return wrappers.mapInPandas(run, "host string, rule string")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) for every page."""
    found = stored(rules(infer(pages, url, html)))
    copies = found.select(F.col("host").alias("_host"), "rule", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_copy"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("_h"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = rows.join(copies, (F.col("_h") == F.col("_host")) & (F.col("_salt") == F.col("_copy")), "left")

    @F.pandas_udf("string")
    def text_of(htmls: pd.Series, found: pd.Series) -> pd.Series:
        read: dict[str, dict] = {}
        out = []
        for h, r in zip(htmls, found, strict=True):
            if r is not None and r not in read:
                read[r] = json.loads(r)
            out.append(extract(h, read.get(r)))
        return pd.Series(out, dtype=object)

    return joined.select("page_id", "url", text_of(F.col("html"), F.col("rule")).alias("text"))
