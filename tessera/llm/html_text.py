"""Main text of web pages by composite text density.

Every DOM node gets the characters per tag of its subtree, adjusted for how much of it is link text; a node's density sum
adds up its children's densities. The subtree of the largest sum is the core of the article, which may be a part of it only: the
article is the block around it that the page names so (``article``, ``main``, or a class or id such as ``content``), or else that
holds its main heading too, and all of that is kept. The least density on the path from the core up to the body is the threshold
for what else counts as content outside. Elements that are boilerplate by their meaning (menus, forms, scripts, adverts,
comments and so on) take no part. A class, id or role alone doesn't drop what can be the article: an element around an ``article``
or ``main``, or, where the page has none, around the largest sum, unless it names reader comments and there is other text. A form
that goes around an ``article``, ``main`` or ``h1`` is the page's, and stays but for its controls.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import table

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NONE = re.compile(r"display\s*:\s*none", re.I)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold the article's text.
DROPPED = frozenset("aside button canvas datalist dialog footer frame frameset head header iframe input menu nav noembed noframes noscript object script select style svg template textarea title xmp".split())
#: Words of classes, ids and roles that mark boilerplate. A name marks it if it has one and no words but these and the plain ones.
MARKS = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs complementary colophon consent contentinfo cookie cookies copyright footer gdpr header masthead menu modal nav navbar navigation newsletter notice notification overlay pagination popup promo promoted promotion recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar trending".split()
)
#: Words, or beginnings of them, that mark what readers wrote.
COMMENTS = ("comment", "disqus", "respond", "replies")
#: Words that say where on a page something is or what shape it has.
PLAIN = frozenset("area bar block bottom box button buttons container form global icons inner left links list main page posts primary right secondary section site slot stories top unit wrap wrapper".split())
#: Words that name the article, or say that boilerplate is the article's own; its header, though, holds its heading.
NAMES = frozenset("article body content entry main post story text".split())
#: Elements that may be the article: those that hold blocks. Others count by their density, as the children of these.
CONTAINERS = frozenset("#root html body main article section div form center blockquote details dl fieldset figure ol ul li table tbody tr td".split())
#: Elements that menus are made of.
LISTS = frozenset("div section ul ol dl table menu p details center".split())
#: These start tags end an open element of the same group.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}


#: What the names of an element say that it is: nothing, the article, boilerplate, or reader comments.
_UNNAMED, _NAMED, _MARKED, _COMMENTS = range(4)


def _says(name: str) -> int:
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
    comments = any(w.startswith(COMMENTS) for w in words)
    marks = [w for w in words if w in MARKS or w.startswith(COMMENTS)]
    if marks and all(w in marks or w in PLAIN or w in NAMES and marks != ["header"] for w in words):
        return _COMMENTS if comments else _MARKED
    return _NAMED if not marks and any(w in NAMES for w in words) and all(w in NAMES or w in PLAIN for w in words) else _UNNAMED


def _boilerplate(tag: str, attrs: str) -> tuple[bool, int, bool]:
    """Whether an element is boilerplate whatever it holds, what its names say that it is, and whether its role is to be the main part."""
    if tag in DROPPED:
        return True, _UNNAMED, False
    if not attrs or tag in ("html", "body"):
        return False, _UNNAMED, False
    says, main = _UNNAMED, False
    for m in _ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _NONE.search(value):
            return True, _UNNAMED, False
        if name in ("class", "id", "role"):
            says = max(says, *map(_says, value.split()), 0)
            main = main or name == "role" and value.strip().lower() == "main"
    # A name does not make an article or main part boilerplate, but for the articles that are comments.
    if tag in ("article", "main") and says == _MARKED:
        says = _UNNAMED
    return False, says, main


class _Page:
    """The elements of a page in order of their start tags, and its pieces of text, each with the element around it."""

    def __init__(self, source: str):
        self.tag, self.parent, self.drop, self.says, self.main = ["#root"], [-1], [False], [_UNNAMED], [False]
        self.pieces: list[tuple[int, str]] = []  # text; a break between blocks is the empty string
        #: Where in the stack the open elements of each name are, so that no tag searches a deep stack in vain.
        self.open: dict[str, list[int]] = {}
        stack, at, end = [0], 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            if m is None or m.start() > at:
                self.pieces.append((stack[-1], source[at : m.start() if m else end]))
            if m is None:
                return
            at = m.end()
            name = m[2]
            if name is None or not m[4]:
                continue  # a comment, a declaration, or a tag that the page ends in
            tag = name.lower()
            if m[1]:
                self.close(stack, tag)
                continue
            if tag in BLOCK:
                if tag in _ENDS:
                    self.end_open(stack, _ENDS[tag], _SCOPE[tag])
                if tag not in ("br", "option", "html", "body"):
                    self.end_open(stack, {"p"}, {"table", "div", "section", "article", "aside", "nav", "form", "li", "td", "button"})
            self.tag.append(tag)
            self.parent.append(stack[-1])
            drop, says, main = _boilerplate(tag, m[3])
            self.drop.append(self.drop[stack[-1]] or drop)
            self.says.append(says)
            self.main.append(main or tag == "main")
            node = len(self.tag) - 1
            if tag in BLOCK:
                self.pieces.append((node, ""))
            if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = close.end() if close else end
                continue
            self.open.setdefault(tag, []).append(len(stack))
            stack.append(node)

    def _last(self, tags: set[str]) -> int:
        """The place in the stack of the innermost open element of one of these names, or 0."""
        return max((at[-1] for t in tags if (at := self.open.get(t))), default=0)

    def _cut(self, stack: list[int], at: int) -> None:
        for node in stack[at:]:
            self.open[self.tag[node]].pop()
        del stack[at:]

    def end_open(self, stack: list[int], tags: set[str], scope: set[str]) -> None:
        at = self._last(tags)
        if at > self._last(scope):
            self.pieces.append((self.parent[stack[at]], ""))
            self._cut(stack, at)

    def close(self, stack: list[int], tag: str) -> None:
        if tag in BLOCK:
            self.pieces.append((stack[-1], ""))
        if at := self._last({tag}):
            self._cut(stack, at)


class _Scores:
    """Characters, in links and at all, density, density sum and best node of each node, the body and the best node in it."""

    def __init__(self, page: _Page, texts: list[tuple[int, str]], drop: list[bool]):
        tag, parent, n = page.tag, page.parent, len(page.tag)
        self.chars, self.links = chars, links = [0] * n, [0] * n
        tags, self.n_links = [0] * n, [0] * n
        link_tags = self.n_links
        for node, t in texts:
            if not drop[node]:
                chars[node] += len("".join(t.split()))
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = tag[i] == "a" or in_link[parent[i]]
            links[i] = chars[i] if in_link[i] else 0
        for i in range(n - 1, 0, -1):
            if not drop[i]:
                p = parent[i]
                chars[p] += chars[i]
                links[p] += links[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (tag[i] == "a")
        share = links[0] / max(chars[0], 1)
        self.density = density = [0.0] * n
        for i in range(n):
            if c := 0 if drop[i] else chars[i]:
                t, lc, lt = max(tags[i], 1), max(links[i], 1), max(link_tags[i], 1)
                base = log(c / max(c - links[i], 1) * links[i] + share * c + e)
                density[i] = c / t * log(max(c / lc * t / lt, 1.0) + 1e-9) / log(base) if base > 1 + 1e-9 and log(base) > 1e-9 else c / t * log(max(c / lc * t / lt, 1.0) + 1e-9)
        self.sums = sums = [0.0] * n
        for i in range(1, n):
            if tag[parent[i]] in CONTAINERS:
                sums[parent[i]] += density[i]
        # The best node of each subtree: on a tie the outer one, which comes first.
        self.best = best = list(range(n))
        for i in range(n - 1, 0, -1):
            if not drop[i]:
                a, b = best[i], best[parent[i]]
                if (sums[a], -a) > (sums[b], -b):
                    best[parent[i]] = a
        self.body = next((i for i in range(n) if tag[i] == "body"), 0)
        self.top = self.core(self.body)

    def core(self, node: int) -> int:
        return self.best[node] if self.sums[self.best[node]] > 0 else node

    def text(self, node: int) -> int:
        """Characters of a node that aren't links."""
        return self.chars[node] - self.links[node]


def _forms(page: _Page) -> None:
    """Drops the forms and what is in them, but for those around the page's article, main or heading."""
    tag, parent, n = page.tag, page.parent, len(page.tag)
    if "form" not in tag:
        return
    holds = [not page.drop[i] and tag[i] in ("article", "main", "h1") for i in range(n)]
    for i in range(n - 1, 0, -1):
        holds[parent[i]] = holds[parent[i]] or holds[i]
    for i in range(1, n):
        page.drop[i] = page.drop[i] or page.drop[parent[i]] or tag[i] == "form" and not holds[i]


#: Characters outside of reader comments that make a page more than them.
OTHER_TEXT = 80


def _dropped(page: _Page, texts: list[tuple[int, str]]) -> list[bool]:
    """What takes no part: also the elements that their names mark, but for those that can hold the article."""
    tag, parent, n = page.tag, page.parent, len(page.tag)
    marked = [i for i in range(n) if page.says[i] >= _MARKED and not page.drop[i]]
    if not marked:
        return page.drop
    scores = _Scores(page, texts, page.drop)
    sums, best = scores.sums, scores.best
    holds = [int(not page.drop[i] and page.says[i] != _COMMENTS and (tag[i] == "article" or page.main[i])) for i in range(n)]
    outside = list(page.drop)
    for i in range(1, n):
        outside[i] = outside[i] or outside[parent[i]] or page.says[i] >= _MARKED
    rest = sum(len("".join(t.split())) for node, t in texts if not outside[node])
    for i in range(n - 1, 0, -1):
        if page.says[i] != _COMMENTS:
            holds[parent[i]] += holds[i]
    drop = list(page.drop)
    for i in marked:
        # Where no element is named the article, the largest sum is it.
        drop[i] = not holds[i] and (holds[0] > 0 or sums[best[i]] < sums[scores.top] or page.says[i] == _COMMENTS and rest >= OTHER_TEXT)
    for i in range(1, n):
        drop[i] = drop[i] or drop[parent[i]]
    return drop


def _within(parent: list[int], is_one: list[bool]) -> list[bool]:
    """Of each node, whether it or one around it is one."""
    out = list(is_one)
    for i in range(1, len(out)):
        out[i] = out[i] or out[parent[i]]
    return out


def _around(parent: list[int], is_one: list[bool]) -> list[bool]:
    """Of each node, whether it or one inside it is one."""
    out = list(is_one)
    for i in range(len(out) - 1, 0, -1):
        out[parent[i]] = out[parent[i]] or out[i]
    return out


def _named(page: _Page, s: _Scores, drop: list[bool]) -> list[int]:
    """The elements that the page says its article is: an ``article``, a main part, or several articles. None if they hold little."""
    n, all_text = len(page.tag), s.text(s.body)
    inside = lambda is_one, top: [i for i in range(n) if is_one[i] and (i == top or not within[page.parent[i]])]
    mains = [not drop[i] and page.main[i] and s.chars[i] > 0 for i in range(n)]
    within = _within(page.parent, mains)
    main = max(inside(mains, 0), key=s.text, default=None)
    if main is not None and 4 * s.text(main) < all_text:
        main = None
    scope = s.body if main is None else main
    in_scope = _within(page.parent, [i == scope for i in range(n)])
    articles = [in_scope[i] and not drop[i] and page.tag[i] == "article" and s.chars[i] > 0 for i in range(n)]
    within = _within(page.parent, articles)
    articles = inside(articles, 0)
    first = max(articles, key=s.text, default=None)
    if first is not None and 2 * s.text(first) >= s.text(scope):
        return [first]
    if main is not None:
        return [main]
    if first is not None and 2 * sum(map(s.text, articles)) >= all_text:
        return articles
    return [first] if first is not None and 4 * s.text(first) >= all_text else []


def _content(page: _Page, s: _Scores, drop: list[bool]) -> list[bool]:
    """Of each node, whether its text is the article's."""
    tag, parent, n = page.tag, page.parent, len(page.tag)
    content, heading = [False] * n, [tag[i] == "h1" and not drop[i] and s.chars[i] > 0 for i in range(n)]
    has_heading = _around(parent, heading)
    named = _named(page, s, drop)
    if named:
        for i in named:
            content[i] = True
        # The heading may stand before its article, in the same main part.
        if not any(has_heading[i] for i in named):
            main = _within(parent, [page.main[i] and not drop[i] for i in range(n)])
            for i in range(named[0]):
                content[i] = content[i] or heading[i] and main[i]
        return _within(parent, content)
    path = [s.top]
    while path[-1] > s.body:
        path.append(parent[path[-1]])
    threshold = min(s.density[i] for i in path)
    below = path[:-1] or path
    root = next((i for i in path if has_heading[i]), path[-1])
    called = [i for i in below if page.says[i] == _NAMED]
    if called and (root == path[-1] or called[-1] < root):
        root = called[-1]
    content[root] = True
    for i in range(n):
        # The heading of an article that the page calls so may stand above it.
        content[i] = content[i] or heading[i] and (not has_heading[root]) and i < root
    sections = _around(parent, [tag[i] in ("h2", "h3", "h4") and not drop[i] for i in range(n)])
    is_list = lambda i: s.n_links[i] >= 2 and 2 * s.links[i] > s.chars[i] and tag[i] in LISTS
    on_path, skip = set(path), [False] * n
    for i in range(1, n):
        if i in on_path or drop[i] or parent[i] not in on_path or parent[i] == s.top > s.body:
            continue
        if parent[i] >= root and (root not in called):
            # Beside the core, or in a body that is the core, where nothing is called the article: lists of links are menus.
            skip[i] = is_list(i) and not heading[i]
        elif parent[i] < root and not is_list(i):
            # Outside of the article's block: what is as dense as the way to it, and what is headed like its sections.
            content[i] = content[i] or s.density[i] >= threshold and s.text(i) > 0 or sections[i] and s.text(i) > 0
    content = _within(parent, content)
    skip = _within(parent, skip)
    return [c and not k for c, k in zip(content, skip, strict=True)]


def extract(source: str | None) -> str:
    """The page's main text: blocks of single-spaced text, one on each line. Empty for null or empty pages."""
    page = _Page(source or "")
    _forms(page)
    texts = [(node, html.unescape(t) if t else "") for node, t in page.pieces if not page.drop[node]]
    drop = _dropped(page, texts)
    texts = [(node, t) for node, t in texts if not drop[node]]
    scores = _Scores(page, texts, drop)
    if not scores.chars[0]:
        return ""
    content = _content(page, scores, drop)
    blocks, now = [], []
    for node, t in texts:
        if not t:
            blocks.append(" ".join("".join(now).split()))
            now = []
        elif content[node]:
            now.append(t)
    blocks.append(" ".join("".join(now).split()))
    return "\n".join(b for b in blocks if b)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages.

    Null and empty pages, and pages of boilerplate only, have an empty text. Null ids and urls stay null, repeated rows are
    extracted each, other columns are ignored, an empty table gives no rows. No shuffle; a task holds one batch of pages.
    """
    kept = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    schema = T.StructType([kept.schema["page_id"], kept.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py()) for h in b["html"]]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return kept.mapInArrow(run, schema)


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
