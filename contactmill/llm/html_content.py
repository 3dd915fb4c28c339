"""Main text of web pages by tag-path ratios.

Every text of a page hangs at the end of a path of tags from the root. Template parts (menus, lists of links, notes)
share paths with short texts without punctuation, the article's paragraphs share paths with long punctuated ones. So for
every path the text length and the punctuation per text are taken, spread over the page in text order, smoothed with a
Gaussian, multiplied, and cut at a share of their standard deviation. The smallest element that holds most of what passes is
the content; its short paragraphs and headings, which no ratio could keep, belong to it. Whatever else passes is content too:
its whole paragraph joins in page order, and so do the headings right before content and the headline above it. Where
article or main elements hold the content, what passes outside of them joins only if its tag path is one of theirs, or if it
is a paragraph beside them in what encloses them. Repeated sibling blocks of prose that follow content and end with links, or
have a time each, and articles repeated inside an article, are reader comments.

What is never article text, whatever its ratios, has no path: scripts, forms, navigation and the like by their tags, role or
hidden state. Adverts, notices, sidebars and comments are left out by their class or id, but a name only votes: an element
that holds most of the text with high ratios stays, whatever it is called, and so does everything where nothing would be left.

Time and memory are linear in the page, however deep or broken it is: tags are scanned once, paths are numbers, elements are
rows of lists with parents before children, sums go up and flags come down these lists once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmill.llm.common import whole_text

#: Share of the standard deviation of the fused ratios above which a text counts as content.
CUT = 0.6
#: Share of the content's length that the content element has to hold.
MOST = 0.85
#: Share of what passes that article or main elements without a headline have to hold to be taken for the content.
HALF = 0.5
#: The same for those with a headline; what passes around them may be comments, as long as they like.
TITLED = 0.2
#: Length up to which a block of links is the last line of a comment.
LINKS = 60

# The element names of HTML by how they are closed and laid out.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noframes iframe".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded "
    "mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none".split()
)
_ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre search section table ul".split()
)
_CLOSED_BY_SIBLING = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
_SCOPES = frozenset("table ul ol dl select article section div main body html".split())
_NEVER = frozenset(
    "head script style noscript template nav footer aside form button select textarea input iframe object svg canvas "
    "audio video dialog menu title noframes xmp search annotation annotation-xml".split()
)
_NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Words that name parts around an article in class and id attributes.
_NEVER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promotion "
    "promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login register paywall sidebar sidebars aside widget widgets menu menus nav navbar navigation breadcrumb "
    "breadcrumbs pagination pager toc footer footnav masthead topbar toolbar skip share sharing social follow related "
    "recommended recommendations more-stories trending popular comment comments comment-list respond reply replies disqus "
    "discussion reactions tags tagcloud taglist hidden".split()
)
_COMMENT_NAMES = frozenset("comment comments comment-list respond reply replies disqus discussion reactions".split())
#: Parts of a name that say something about the element they stand on; what follows does not name it (has-sidebar).
_ABOUT = frozenset("has no not non with without is in category cat tag tagged topic format type".split())
_MARKS = frozenset("h1 article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTENT_NAMES = frozenset("article content main body text story post entry".split())

_PARAGRAPHS = _HEADINGS | frozenset("p li blockquote dd dt td th pre figcaption".split())
_REPEATED = frozenset("div section article li".split())

_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_UNQUOTED = re.compile(r"[^>=]*")
_EQUALS = re.compile(r"=\s*")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_NAME = re.compile(r"[a-z]+(?:-[a-z]+)*")
_PUNCTUATION = re.compile(r"[.,;:!?。、，；：！？¿¡…]")


def _decoded(text: str) -> str:
    """Character references decoded; numbers too long for Python are no code points."""
    try:
        return unescape(text)
    except ValueError:
        return unescape(re.sub(r"&#\d{8,};?", "\ufffd", re.sub(r"&#0+(?=\d)", "&#", text)))


@dataclass
class _Text:
    element: int
    block: int
    text: str
    n_chars: int = 0
    marks: int = 0


class _Scanner:
    """Finds tags from left to right; no character is searched again for an end that is missing."""

    def __init__(self, html: str):
        self.html = html
        self.plain_until = 0  # tags that begin before it end at the next >, quoted or not
        self.next_end = html.find(">")

    def next(self, here: int) -> tuple[int, int, str | None, str, str] | None:
        """(start, end, tag or None for comments, "/" if it closes, attributes) of the next tag, None if there is none."""
        html = self.html
        while (start := html.find("<", here)) >= 0:
            sign = html[start + 1 : start + 2]
            if sign and sign in "!?":
                if html.startswith(("<!-->", "<!--->"), start):
                    return start, html.index(">", start) + 1, None, "", ""
                if html.startswith("<!--", start):
                    end = _COMMENT_END.search(html, start + 4)
                    return start, end.end() if end else len(html), None, "", ""
                end = html.find(">", start)
                return start, end + 1 if end >= 0 else len(html), None, "", ""
            closing = "/" if sign == "/" else ""
            name = _TAG_NAME.match(html, start + 1 + len(closing)) if self._ends(start) else None
            if name:
                end = self._end(start, name.end())
                return start, end + 1, name[0], closing, html[name.end() : end]
            here = start + 1
        return None

    def _ends(self, start: int) -> bool:
        """Whether a > follows; the place of the next one is kept."""
        if 0 <= self.next_end < start:
            self.next_end = self.html.find(">", start)
        return self.next_end >= 0

    def _end(self, start: int, first: int) -> int:
        """Position of the > that ends a tag. Quoted values hide a >; with one that is never closed, the first > counts."""
        html, at = self.html, first
        while start >= self.plain_until:
            at = _UNQUOTED.match(html, at).end()
            if html.startswith(">", at):
                return at
            if equals := _EQUALS.match(html, at):
                at = equals.end()
                if html[at : at + 1] not in ("'", '"'):
                    continue
                close = html.find(html[at], at + 1)
                if close >= 0:
                    at = close + 1
                    continue
            # the last quote of its kind, or the end of the page: one such scan for each
            self.plain_until = max(at, start + 1)
        return html.index(">", first)


class _Page:
    """Texts of a page in order, with the element each stands in; block numbers tell where a new block begins.

    Elements are rows of lists, parents before children; the first one encloses the page.
    """

    def __init__(self, html: str):
        self.texts: list[_Text] = []
        self.block = 0
        self.tag, self.path, self.up, self.excluded, self.votes = [""], [0], [-1], [False], [frozenset()]
        self.paths: dict[tuple[int, str], int] = {}
        self.stack = [0]  # the open elements
        self.depths: dict[str, list[int]] = {}  # places in the stack by tag
        scanner, here = _Scanner(html), 0
        while found := scanner.next(here):
            start, end, tag, closing, attributes = found
            self._add(html[here:start])
            here = end
            if tag is None:
                continue
            tag = tag.lower()
            if closing:
                self._close(tag)
                continue
            self._open(tag, attributes)
            if tag in _RAW:
                raw_end = re.compile(rf"</{re.escape(tag)}\b", re.IGNORECASE).search(html, here)
                here = html.find(">", raw_end.end()) + 1 if raw_end else 0
                here = here or len(html)
                self._close(tag)
        self._add(html[here:])

    def down(self, own: Callable[[int], bool]) -> list[bool]:
        """For every element whether `own` holds for it or for one that it stands in."""
        flags: list[bool] = []
        for e, up in enumerate(self.up):
            flags.append((up >= 0 and flags[up]) or bool(own(e)))
        return flags

    def nearest(self, own: Callable[[int], bool], through: Callable[[int], bool] = lambda e: True) -> list[int]:
        """For every element the nearest one, itself or around it, for which `own` holds, -1 if there is none."""
        found: list[int] = []
        for e, up in enumerate(self.up):
            found.append(e if own(e) else found[up] if up >= 0 and through(e) else -1)
        return found

    def sums(self, texts: list[_Text], values: list[int]) -> list[int]:
        """For every element the sum of the values of the texts in it."""
        total = [0] * len(self.up)
        for t, value in zip(texts, values, strict=True):
            total[t.element] += value
        for e in range(len(total) - 1, 0, -1):
            total[self.up[e]] += total[e]
        return total

    def _add(self, text: str) -> None:
        if text and not self.excluded[self.stack[-1]]:
            self.texts.append(_Text(self.stack[-1], self.block, _decoded(text)))

    def _open(self, tag: str, attributes: str) -> None:
        if tag in _ENDS_PARAGRAPH:
            self._leave({"p"})
        if tag in _CLOSED_BY_SIBLING:
            self._leave(_CLOSED_BY_SIBLING[tag])
        if tag not in _INLINE:
            self.block += 1
        if tag in _VOID:
            return
        up = self.stack[-1]
        names, excluded, votes = "", self.excluded[up] or tag in _NEVER, frozenset()
        if attributes and not excluded:
            names, excluded, votes = _described(tag, attributes)
        excluded = excluded or (tag == "header" and not self.depths.get("article") and not self.depths.get("main"))
        self.depths.setdefault(tag, []).append(len(self.stack))
        self.stack.append(len(self.tag))
        self.tag.append(tag)
        self.path.append(self.paths.setdefault((self.path[up], tag + names), len(self.paths) + 1))
        self.up.append(up)
        self.excluded.append(excluded)
        self.votes.append(votes)

    def _cut(self, depth: int) -> None:
        """Close the open elements from a place in the stack on."""
        while len(self.stack) > depth:
            self.depths[self.tag[self.stack.pop()]].pop()

    def _leave(self, tags: set[str]) -> None:
        """Close the outermost open element of `tags` that no other scope encloses more closely."""
        scope = max((self.depths[s][-1] for s in _SCOPES if s not in tags and self.depths.get(s)), default=0)
        found = [places[i] for places in map(self.depths.get, tags) if places and (i := bisect_right(places, scope)) < len(places)]
        if found:
            self._cut(min(found))
            self.block += 1

    def _close(self, tag: str) -> None:
        if tag not in _INLINE:
            self.block += 1
        if self.depths.get(tag):
            self._cut(self.depths[tag][-1])


def _listed(word: str) -> set[str]:
    """The listed names that a class or id consists of; parts behind has-, no-, with- and the like are not its names."""
    own = []
    for part in word.split("-"):
        if part in _ABOUT:
            break
        own.append(part)
    return {word, *own} & _NEVER_NAMES


def _described(tag: str, attributes: str) -> tuple[str, bool, frozenset[str]]:
    """(what of the class and id goes into the path, whether the attributes exclude the element, names that vote against it)."""
    found = {}
    for match in _ATTRIBUTE.finditer(attributes):
        found.setdefault(match[1].lower(), next((unescape(v) for v in match.groups()[1:] if v is not None), ""))
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    words = set(_NAME.findall(names))
    style = found.get("style", "").replace(" ", "").lower()
    excluded = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    excluded = excluded or bool(set(found.get("role", "").lower().split()) & _NEVER_ROLES)
    votes: set[str] = set()
    if not excluded and tag not in ("html", "body", "main"):
        votes = {name for word in _NAME.findall(names.replace("_", "-")) for name in _listed(word)}
        if votes and tag == "article":
            parts = {part for word in words for part in word.split("-")}
            votes = set() if parts & _CONTENT_NAMES and not parts & {"comment", "comments", "reply"} else votes
    path = f".{' '.join(sorted(words))}" if words and tag in ("div", "section", "td", "ul") else ""
    return path, excluded, frozenset(votes)


def _smoothed(values: np.ndarray) -> np.ndarray:
    """A Gaussian over two neighbours on either side."""
    if len(values) < 2:
        return values
    kernel = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
    weight = np.convolve(np.ones(len(values)), kernel, "full")[2:-2]
    return np.convolve(values, kernel, "full")[2:-2] / weight


def _ratios(page: _Page, texts: list[_Text]) -> np.ndarray:
    """Fused ratio of every text: its path's text length and punctuation per text, both smoothed."""
    totals: dict[int, list[float]] = {}
    for t in texts:
        total = totals.setdefault(page.path[t.element], [0, 0, 0])
        total[0] += 1
        total[1] += t.n_chars
        total[2] += t.marks
    of = [totals[page.path[t.element]] for t in texts]
    length = _smoothed(np.array([chars / n for n, chars, _ in of]))
    marks = _smoothed(np.array([marks / n for n, _, marks in of]))
    return length * (1.0 + marks)


def _passing(page: _Page, texts: list[_Text], cut: float) -> list[bool]:
    if not texts:
        return []
    fused = _ratios(page, texts)
    return (fused >= min(cut * fused.std(), fused.max())).tolist()


def _weights(texts: list[_Text], good: list[bool]) -> list[int]:
    return [t.n_chars if passes else 0 for t, passes in zip(texts, good, strict=True)]


def _unnamed(page: _Page, texts: list[_Text], cut: float, most: float) -> list[bool]:
    """For every element whether it is dropped for its name or the name of one that it stands in.

    A named element is a wrapper, and stays, if it holds most of what passes in it and in the page without names. Where a
    wrapper holds a headline, article or main element, only such wrappers stay; without one, comments do not, nor does
    anything beside an article or main element with passing text. If nothing would stay, names count for nothing.
    """
    holds = page.sums(texts, [1] * len(texts))
    named = [e for e, votes in enumerate(page.votes) if votes and holds[e]]
    if not named:
        return [False] * len(page.up)
    good = page.sums(texts, _weights(texts, _passing(page, texts, cut)))
    marked = [bool(n) and tag in _MARKS and not votes & _COMMENT_NAMES for n, tag, votes in zip(holds, page.tag, page.votes, strict=True)]
    for e in range(len(marked) - 1, 0, -1):
        marked[page.up[e]] |= marked[e]
    apart = page.down(lambda e: page.votes[e] or page.tag[e] in _HEADINGS)
    anchor = page.down(lambda e: page.tag[e] in ("article", "main"))
    others = [t for t in texts if not apart[t.element]]
    passing = [t for t, passes in zip(others, _passing(page, others, cut), strict=True) if passes]
    free, anchored = sum(t.n_chars for t in passing), any(anchor[t.element] for t in passing)
    wrappers = [e for e in named if good[e] and good[e] >= most * (good[e] + free)]
    if any(marked[e] for e in wrappers):
        wrappers = [e for e in wrappers if marked[e]]
    else:
        wrappers = [] if anchored else [e for e in wrappers if not page.votes[e] & _COMMENT_NAMES]
    stays = set(wrappers)
    dropped = page.down(lambda e: page.votes[e] and e not in stays)
    return [False] * len(page.up) if all(dropped[t.element] for t in texts) else dropped


def _comments(page: _Page, texts: list[_Text], good: list[bool]) -> list[bool]:
    """For every element whether it belongs to reader comments that no name gives away.

    Comments are two or more sibling blocks of one tag path without headings that hold punctuated text, some of it passing, and
    all end with a short block of links, or hold a time element outside of articles, or are articles inside an article.
    Passing text must come before them: a group without any is the content itself (forum pages, lists of posts).
    """
    groups: dict[tuple[int, int], list[int]] = {}
    for e, tag in enumerate(page.tag):
        if tag in _REPEATED:
            groups.setdefault((page.up[e], page.path[e]), []).append(e)
    groups = {k: members for k, members in groups.items() if len(members) > 1}
    if not groups:
        return [False] * len(page.up)
    in_article = page.down(lambda e: page.tag[e] == "article")
    linked = page.down(lambda e: page.tag[e] == "a")
    timed = page.down(lambda e: page.tag[e] == "time")
    last, blocks = [-1] * len(page.up), {}
    for t in texts:
        last[t.element] = t.block
        block = blocks.setdefault(t.block, [0, 0])
        block[0] += t.n_chars
        block[1] += t.n_chars if linked[t.element] else 0
    for e in range(len(last) - 1, 0, -1):
        last[page.up[e]] = max(last[page.up[e]], last[e])
    links = {b for b, (n, of_links) in blocks.items() if n <= LINKS and 2 * of_links >= n}
    times = page.sums(texts, [int(timed[t.element]) for t in texts])
    in_heading = page.down(lambda e: page.tag[e] in _HEADINGS)
    headings = page.sums(texts, [int(in_heading[t.element]) for t in texts])
    held, marks = page.sums(texts, _weights(texts, good)), page.sums(texts, [t.marks for t in texts])
    found: set[int] = set()
    for (up, _), members in groups.items():
        answers = page.tag[members[0]] == "article" and in_article[up]
        members = [e for e in members if marks[e]]
        signed = all(not headings[e] and (answers or last[e] in links or (times[e] and not in_article[up])) for e in members)
        if len(members) > 1 and signed and any(held[e] for e in members):
            found.update(members)
    if not found:
        return [False] * len(page.up)
    inside = page.down(found.__contains__)
    outermost = page.nearest(lambda e: inside[e] and not inside[page.up[e]])
    early: set[tuple[int, int]] = set()
    for t, passes in zip(texts, good, strict=True):
        e = outermost[t.element]
        if e >= 0:
            early.add((page.up[e], page.path[e]))
        elif passes:
            break
    return page.down(lambda e: outermost[e] == e and (page.up[e], page.path[e]) not in early)


def _anchors(page: _Page, texts: list[_Text], good: list[bool]) -> list[int]:
    """The outermost article elements, else main ones, that hold a headline and passing text, or half of what passes."""
    held = page.sums(texts, _weights(texts, good))
    in_headline = page.down(lambda e: page.tag[e] == "h1")
    headlines = page.sums(texts, [int(in_headline[t.element]) for t in texts])
    for tag in (tag for tag in ("article", "main") if tag in page.depths):
        same = page.down(lambda e: page.tag[e] == tag)  # noqa: B023
        outer = [e for e in range(1, len(page.up)) if page.tag[e] == tag and held[e] and not same[page.up[e]]]
        titled = [e for e in outer if headlines[e]]
        if titled and sum(held[e] for e in titled) >= TITLED * held[0]:
            return titled
        if outer and sum(held[e] for e in outer) >= HALF * held[0]:
            return outer
    return []


def main_text(html: str | None, cut: float = CUT, most: float = MOST) -> str:
    """The main text of a page; white space inside a block is one space, blocks are joined by one space."""
    page = _Page(html or "")
    texts = []
    for t in page.texts:
        bare = t.text.split()
        t.n_chars = sum(map(len, bare))
        if t.n_chars:
            t.marks = len(_PUNCTUATION.findall(t.text))
            texts.append(t)
    if not texts:
        return ""
    dropped = _unnamed(page, texts, cut, most)
    texts = [t for t in texts if not dropped[t.element]]
    comments = _comments(page, texts, _passing(page, texts, cut))
    dropped = [a or b for a, b in zip(dropped, comments, strict=True)]
    texts = [t for t in texts if not dropped[t.element]]
    good = _passing(page, texts, cut)
    roots = _anchors(page, texts, good)
    anchored = bool(roots)
    roots = roots or [_content(page, texts, good, most)]
    paragraphs = page.nearest(lambda e: page.tag[e] in _PARAGRAPHS, lambda e: page.tag[e] in _INLINE)
    content = page.down(set(roots).__contains__)
    outside = [t for t, passes in zip(texts, good, strict=True) if passes and not content[t.element]]
    if anchored and outside:
        outside = _beside(page, texts, good, outside, roots, content, paragraphs)
    kept = {*roots, *(paragraphs[t.element] for t in outside)} - {-1}
    kept |= _headings(page, texts, kept, _common(page, [*roots, *(t.element for t in outside)]))
    blocks = {t.block for t in outside}  # a paragraph without an element of its own
    stays = page.down(kept.__contains__)
    parts, block = [], None
    for t in page.texts:
        if (t.block in blocks or stays[t.element]) and not dropped[t.element]:
            if block is not None and t.block != block:
                parts.append(" ")
            parts.append(t.text)
            block = t.block
    return " ".join("".join(parts).split())


def _beside(
    page: _Page, texts: list[_Text], good: list[bool], outside: list[_Text], roots: list[int], content: list[bool], paragraphs: list[int]
) -> list[_Text]:
    """Of the passing texts outside of article or main elements, those that belong to the content.

    Their tag path is one of the content's, or they are paragraphs right in an element that encloses the content: any below
    body, and right in body those between a headline there and the content.
    """
    paths = {page.path[t.element] for t, passes in zip(texts, good, strict=True) if passes and content[t.element]}
    encloses: set[int] = set()
    e = _common(page, roots)
    e = page.up[e] if e in roots else e
    while e >= 0:
        encloses.add(e)
        e = page.up[e]
    blocks = page.nearest(lambda e: page.tag[e] not in _INLINE)
    headline = page.nearest(lambda e: page.tag[e] == "h1")
    in_main = page.down(lambda e: page.tag[e] == "main")
    within_main = all(in_main[page.up[e]] for e in roots)
    candidates = {id(t) for t in outside}
    titled: set[int] = set()
    begun, found = False, []
    for t in texts:
        begun = begun or content[t.element]
        if headline[t.element] >= 0:
            titled.add(page.up[headline[t.element]])
        if id(t) not in candidates:
            continue
        p = paragraphs[t.element]
        holder = page.up[p] if p >= 0 else blocks[t.element]
        below_body = page.tag[holder] not in ("", "html", "body")
        near = holder in encloses and (in_main[holder] or not within_main) and (below_body or (not begun and holder in titled))
        if page.path[t.element] in paths or near:
            found.append(t)
    return found


def _common(page: _Page, elements: list[int]) -> int:
    """The smallest element that all the elements stand in."""
    count = [0] * len(page.up)
    for e in elements:
        count[e] += 1
    for e in range(len(count) - 1, 0, -1):
        count[page.up[e]] += count[e]
    return max(e for e, n in enumerate(count) if n == len(elements))


def _headings(page: _Page, texts: list[_Text], kept: set[int], common: int) -> set[int]:
    """Headings with nothing but headings between them and content, and first-level ones in what encloses all content."""
    stays, within = page.down(kept.__contains__), page.down(lambda e: e == common)
    heading = page.nearest(lambda e: page.tag[e] in _HEADINGS)
    found, follows, below = set(), False, False
    for t in reversed(texts):
        h = heading[t.element]
        if stays[t.element]:
            follows = below = True
        elif h >= 0 and (follows or below and page.tag[h] == "h1" and within[h]):
            found.add(h)
        else:
            follows = False
    return found


def _content(page: _Page, texts: list[_Text], good: list[bool], most: float) -> int:
    """The smallest element that holds most of the content, an enclosing article or main element rather than a part of it."""
    held, length = page.sums(texts, _weights(texts, good)), page.sums(texts, [t.n_chars for t in texts])
    enough = page.nearest(lambda e: held[e] >= most * held[0])
    best = min((enough[t.element] for t in texts), key=length.__getitem__)
    e = page.nearest(lambda e: page.tag[e] in ("article", "main"))[best]
    if e >= 0:
        return e
    while page.up[best] > 0 and page.tag[best] in _INLINE | {"p", "blockquote", "h1", "h2", "h3", "li"}:
        best = page.up[best]
    return best


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points of text).

    Null and empty html, and pages without text outside the parts that their tags exclude, give the empty text. Deep and broken
    pages (unclosed tags, quotes and comments) take time and memory in proportion to their length; without a > nothing is a tag. Repeated rows and null
    identifiers keep their rows; no rows give none. The html is read whole. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()),
            ], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), whole_text(html_col).alias("html")
    )
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
