"""Main text of web pages by consensus paths: containers are scored per page and voted on per host."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from inkprobe.llm.arrow import without
from inkprobe.llm.frames import packed
from inkprobe.session import stage

# Element names by their role in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul".split()
)
CONTAINERS = frozenset("article body blockquote center div main section table tbody td tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BARRED = frozenset(
    "button canvas datalist dialog head iframe input label noscript object option optgroup script select style "
    "svg template textarea audio video math".split()
)
# Left out unless they turn out to hold the page.
SUSPECT = frozenset("aside footer form menu nav".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript template xmp noframes".split())
SUSPECT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words of class and id that mark what isn't the article, if all words of a class or id are of these or of the plain ones below.
MARK_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs colophon comment comments consent cookie cookies copyright "
    "disclaimer discussion disqus footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice notification overlay "
    "pager pagination popup promo promotion recommended related replies reply respond responses search share sharing sidebar signin signup "
    "social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
COMMENT_WORDS = frozenset("comment comments discussion disqus replies reply respond response responses".split())
PLAIN_WORDS = frozenset(
    "area article articles bar block bottom box btn button buttons col column component container content count desktop entry field fixed form global group heading "
    "icon icons inline inner item items js label left link links list main message mobile module outer page panel policy post posts primary right row secondary section "
    "site slot space sticky text title top unit wrap wrapper zone".split()
)
FAVOURED_WORDS = frozenset("article body content entry main post story text".split())
# What an opening tag closes: the elements, and those that the search doesn't go beyond.
CLOSES = {
    "p": ({"p"}, {"div", "article", "section", "td", "th", "li", "blockquote", "body", "main"}),
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "a": ({"a"}, BLOCKS),
}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")

# Ranked paths kept for each host.
PATHS = 3
# Headings that are often links to the page itself.
_TITLES = frozenset({"h1", "h2"})
# Part of a container's score that the one around it gets: enough for two uneven sections to stay together.
_SHARE = 0.7


@dataclass
class Node:
    tag: str
    parent: int
    path: int
    hidden: bool = False
    in_article: bool = False
    favoured: bool = False
    # "": no doubt; "mark": left out unless it holds the page; "comment": likewise, but however much it holds; "hint": scores less.
    doubt: str = ""


@dataclass
class Page:
    """Block texts of a page in order, each with its element, and the elements, parents first."""

    nodes: list[Node] = field(default_factory=list)
    # Element, text and characters inside links of each block.
    blocks: list[tuple[int, str, int]] = field(default_factory=list)
    # Paths as links to the path of the parent and the last step.
    paths: dict[tuple[int, str], int] = field(default_factory=dict)
    steps: list[tuple[int, str]] = field(default_factory=lambda: [(-1, "")])

    def step(self, path: int, name: str) -> int:
        at = self.paths.get((path, name))
        if at is None:
            at = self.paths[path, name] = len(self.steps)
            self.steps.append((path, name))
        return at

    def path_of(self, node: int) -> str:
        out, path = [], self.nodes[node].path
        while path > 0:
            path, name = self.steps[path]
            out.append(name)
        return "".join(f"/{name}" for name in reversed(out))

    def find(self, path: str) -> int | None:
        at = 0
        for name in path.split("/")[1:]:
            at = self.paths.get((at, name))
            if at is None:
                return None
        return at

    def totals(self) -> tuple[list[int], list[int]]:
        """Characters of text, and of those in links (but for titles), in and below each element."""
        total, links = [0] * len(self.nodes), [0] * len(self.nodes)
        for at, text, linked in self.blocks:
            total[at] += len(text)
            links[at] += 0 if self.nodes[at].tag in _TITLES else linked
        for i in range(len(self.nodes) - 1, 0, -1):
            total[self.nodes[i].parent] += total[i]
            links[self.nodes[i].parent] += links[i]
        return total, links

    def below(self, roots: set[int]) -> set[int]:
        """Blocks in or below some elements."""
        inside = [False] * len(self.nodes)
        for i, n in enumerate(self.nodes):
            inside[i] = i in roots or n.parent >= 0 and inside[n.parent]
        return {k for k, (at, _, _) in enumerate(self.blocks) if inside[at]}


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)} if source.strip() else {}


def _words(value: str) -> set[str]:
    return {w.lower() for w in _WORD.findall(value)}


def _hidden(tag: str, attributes: dict[str, str]) -> bool:
    style = attributes.get("style", "").replace(" ", "").lower()
    return tag in BARRED or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style


def _doubt(tag: str, attributes: dict[str, str], in_article: bool) -> str:
    if tag in SUSPECT or tag == "header" and not in_article or attributes.get("role", "").lower() in SUSPECT_ROLES:
        return "mark"
    if tag in ("html", "body", "main"):
        return ""
    hint = ""
    for name in [*attributes.get("class", "").split(), attributes.get("id", "")]:
        own = {w for w in _words(name) if not w.isdigit()}
        marks = own & MARK_WORDS or (own & {"header"} if not in_article and tag not in HEADINGS else set())
        if marks and own <= MARK_WORDS | PLAIN_WORDS | marks:
            if marks & COMMENT_WORDS:
                return "comment"
            hint = "mark"
        elif marks and not hint:
            hint = "hint"
    return hint


class _Tags:
    """Finds tags, comments and declarations of a page, in one pass over it."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.quote = {'"': -1, "'": -1}

    def _next(self, quote: str, at: int) -> int:
        """The next such quote; searched on only when the last one found has been passed."""
        if self.quote[quote] < at:
            found = self.html.find(quote, at)
            self.quote[quote] = found if found >= 0 else len(self.html)
        return self.quote[quote]

    def _end(self, at: int) -> int:
        """The ``>`` that ends a tag; quotes with a partner before the last ``>`` hide what is between."""
        while True:
            found = _STOP.search(self.html, at)
            if found is None or found.start() > self.last:
                return self.last
            if found[0] == ">":
                return found.start()
            other = self._next(found[0], found.end())
            at = other + 1 if other < self.last else found.end()

    def __iter__(self):
        """``begin, end, closing, name, attributes`` of each; the name is empty for what has no element."""
        html, at = self.html, 0
        while True:
            begin = html.find("<", at)
            if begin < 0 or begin > self.last and not html.startswith("<!--", begin):
                return
            if html.startswith("<!--", begin):
                end = html.find("-->", begin + 4)
                found = (begin, end + 3 if end >= 0 else len(html), False, "", "")
            elif html.startswith(("<!", "<?"), begin):
                found = (begin, html.find(">", begin) + 1, False, "", "")
            else:
                closing = html.startswith("/", begin + 1)
                name = _NAME.match(html, begin + 1 + closing)
                if not name:
                    at = begin + 1
                    continue
                end = self._end(name.end())
                found = (begin, end + 1, closing, name[0].lower(), html[name.end() : end])
            at = found[1]
            skip = yield found
            if skip is not None:
                at = skip
                yield


def parse(html: str) -> Page:
    """Read a page with the usual leniency: missing end tags, stray ones, raw script text. Its time grows with the page's length."""
    page = Page()
    nodes, stack, opened = page.nodes, [0], Counter()
    nodes.append(Node("#", -1, 0))
    parts: list[str] = []
    linked = 0
    endless: set[str] = set()  # raw elements of which no end follows

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                at = stack[-1]
                while nodes[at].tag not in BLOCKS and nodes[at].parent >= 0:
                    at = nodes[at].parent
                page.blocks.append((at, text, linked))
            parts.clear()
        linked = 0

    def pop(tags: set[str] | frozenset[str], until: set[str] | frozenset[str] = frozenset()) -> None:
        if not any(opened[tag] for tag in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[depth]].tag
            if tag in tags:
                if any(nodes[i].tag in BLOCKS for i in stack[depth:]):
                    flush()
                opened.subtract(nodes[i].tag for i in stack[depth:])
                del stack[depth:]
                return
            if tag in until:
                return

    def say(text: str) -> None:
        nonlocal linked
        if text and not nodes[stack[-1]].hidden:
            text = unescape(text)
            parts.append(text)
            if opened["a"]:
                linked += len(text.strip())

    at, end = 0, len(html)
    tags = iter(_Tags(html))
    for begin, after, closing, tag, source in tags:
        say(html[at:begin])
        at = after
        if not tag:
            continue
        if closing:
            if tag == "p" and not opened["p"]:
                flush()
            pop({tag})
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        attributes = _attributes(source) if source else {}
        if tag in BLOCKS and tag != "p":
            pop({"p"}, CLOSES["p"][1])  # a block ends an open paragraph
        if tag in ("main", "article", "h1"):
            pop({"nav"}, {"main", "article"})  # nor does the article stand in a menu
        if tag in CLOSES:
            pop(*CLOSES[tag])
        if tag in BLOCKS:
            flush()
        if source.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        up = nodes[stack[-1]]
        if attributes:
            hidden, doubt = up.hidden or _hidden(tag, attributes), _doubt(tag, attributes, up.in_article)
        else:
            hidden, doubt = up.hidden or tag in BARRED, "mark" if tag in SUSPECT or tag == "header" and not up.in_article else ""
        if tag in BLOCKS or hidden or doubt or tag == "a" or tag in RAW:
            path, favoured = up.path, False
            if tag in BLOCKS:
                classes = sorted({_DIGITS.sub("#", c).replace("/", "|") for c in attributes.get("class", "").split()}) if attributes else ()
                path = page.step(path, ".".join([tag, *classes]))
            if attributes:
                favoured = bool((_words(attributes.get("class", "")) | _words(attributes.get("id", ""))) & FAVOURED_WORDS)
            nodes.append(Node(tag, stack[-1], path, hidden, up.in_article or tag in ("article", "main"), favoured, doubt))
            stack.append(len(nodes) - 1)
            opened[tag] += 1
        if tag in RAW:
            close = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(html, at)
            if close is None:
                endless.add(tag)
            if close or tag in ("script", "style"):
                at = close.end() if close else end
                pop({tag})
                tags.send(at)
    say(html[at:])
    flush()
    return _without_doubtful(page)


def _without_doubtful(page: Page) -> Page:
    """Leave out the blocks of marked elements, but for those that hold the page.

    These hold a ``main``; or half of the text, with the first-level heading or outside of comments nearly nothing beside them; and are not mostly links. What a
    class or id only hints at goes if it's mostly links and holds less than half.
    """
    nodes = page.nodes
    total, links = page.totals()
    holds: list[set[str]] = [set() for _ in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].tag in ("main", "h1"):
            holds[i].add(nodes[i].tag)
        holds[nodes[i].parent] |= holds[i]
    out = [False] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        all_, own = total[0], total[i]
        linked = 2 * links[i] >= own
        if n.doubt == "hint":
            goes = linked and 2 * own < all_
        elif n.doubt:
            half = 2 * own >= all_ and ("h1" in holds[i] or n.doubt != "comment" and 50 * (all_ - own) <= all_)
            goes = "main" not in holds[i] and (linked or not half)
        else:
            goes = False
        out[i] = out[n.parent] or goes
    page.blocks = [b for b in page.blocks if not out[b[0]]]
    return page


def scored(page: Page) -> dict[int, float]:
    """Score of each container: text outside links of its own blocks, a part of its children's, and so on; less for a doubtful name."""
    carried = [0.0] * len(page.nodes)
    for at, text, linked in page.blocks:
        carried[at] += max(0, len(text) - 2 * linked)
    scores: dict[int, float] = {}
    for i in range(len(page.nodes) - 1, 0, -1):
        n = page.nodes[i]
        if not carried[i]:
            continue
        if n.tag in CONTAINERS:
            scores[i] = carried[i] * (1.3 if n.tag in ("article", "main") else 1.15 if n.favoured else 1.0) * (0.7 if n.doubt else 1.0)
        # A block that isn't a container counts for the container that holds it.
        carried[n.parent] += carried[i] * (_SHARE if n.tag in CONTAINERS else 1.0)
    if carried[0]:
        scores[0] = carried[0]
    return scores


def main_elements(page: Page) -> tuple[int, int]:
    """The best container, widened below the body, and widened up to the whole page.

    The body comes after all others, which the paths of the host may prefer to it. The container is widened to the nearest article or main around it, and from there to every container whose further text isn't mostly
    links (those in a title don't count), until a main. Without containers it is the whole page.
    """
    scores = scored(page)
    at = best = min((i for i in scores if i > 0), key=lambda i: (page.nodes[i].tag == "body", -scores[i], i), default=0)
    total, links = page.totals()
    if page.nodes[at].in_article:
        while page.nodes[at].tag not in ("article", "main"):
            at = page.nodes[at].parent
    inner, node = at, at
    while page.nodes[node].tag != "main" and node > 0:
        node = page.nodes[node].parent
        n = page.nodes[node]
        more = total[node] - total[at]
        text = 2 * (links[node] - links[at]) <= more or node > 0 and scores.get(node, 0) > scores[best]
        if more and text and (node == 0 or n.tag in CONTAINERS):
            at = node
            if node > 0 and n.tag != "body":
                inner = node
    return inner, at


def votes(page: Page) -> Counter:
    """Vote of a page for the path of its main element, in thousandths of the text it holds."""
    _, at = main_elements(page)
    total = sum(len(t) for _, t, _ in page.blocks)
    if at == 0 or not total:
        return Counter()
    return Counter({page.path_of(at): round(1000 * sum(len(page.blocks[k][1]) for k in page.below({at})) / total)})


def text_of(page: Page, paths: list[str]) -> str:
    """Text of the elements on the first of ``paths`` that holds nearly all of the page's main element.

    That is 95 in 100 characters and all headings; a first-level heading of the whole page counts too. Elements apart from the main one must
    hold three quarters as much. Without such a path, the text of the main element.
    """
    inner, outer = main_elements(page)

    def size(blocks: set[int]) -> int:
        return sum(len(page.blocks[k][1]) for k in blocks)

    def tags(blocks: set[int]) -> set[str]:
        return {page.nodes[page.blocks[k][0]].tag for k in blocks}

    own, taken = page.below({inner}), page.below({outer})
    for path in paths:
        wanted = page.find(path)
        roots = {i for i, n in enumerate(page.nodes) if n.path == wanted and n.tag in CONTAINERS} if wanted else set()
        found = page.below(roots) if roots else set()
        if not found or "h1" in tags(taken - found):
            continue
        if 4 * size(found) >= 3 * size(own) if not found & own else 20 * size(own - found) <= size(own) and not tags(own - found) & HEADINGS:
            taken = found
            break
    return "\n".join(page.blocks[k][1] for k in sorted(taken))


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, paths``: the paths with most votes among the pages of each host, best first.

    Votes are counted batch by batch, then by host and path, so a host with most of the pages is no large group:
    what meets is one number per batch and path, and three paths per host.
    """
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).filter("host IS NOT NULL AND html IS NOT NULL")

    def count(batches):
        for batch in batches:
            total: Counter[tuple[str, str]] = Counter()
            for host, html in zip(batch.column(0), batch.column(1)):
                for path, n in votes(parse(html.as_py())).items():
                    total[host.as_py(), path] += n
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in keys], pa.string()), pa.array([p for _, p in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())],
                names=["host", "path", "votes"],
            )

    counted = rows.mapInArrow(count, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    best = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PATHS)
    listed = F.array_sort(F.collect_list(F.struct("place", "path")))
    return best.groupBy("host").agg(F.transform(listed, lambda p: p["path"]).alias("paths"))


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add ``text``, the main text of each page, to ``pages``.

    Two passes: pages vote for the generalised paths (tags and classes, numbers masked) of their main elements, the best
    containers widened to the article around them; the paths that win in a host are used to extract all its pages. A page on which no
    winning path holds nearly all of its own main element (see ``text_of``) is extracted by the latter. Menus, headers, footers, sidebars, notices, adverts,
    forms, scripts, styles and reader comments are left out wherever they stand.

    Blocks are joined by one line feed, white space inside a block becomes one blank, character references are decoded.
    Null or empty html gives an empty text. A page without host has no consensus and goes by its own best container.
    Repeated pages each get a row and each vote. A column named ``text`` is replaced; ``keep`` names the columns to return.
    The table of paths is written to the staging folder, so html is shuffled only if it's too large to broadcast.
    """
    pages = without(pages, ["text"])
    kept = pages.columns if keep is None else keep
    paths = stage(host_paths(pages, url_col, html_col), "host-paths")
    rows = pages.select(packed(pages, kept).alias("row"), host_of(F.col(f"`{url_col}`")).alias("own"), F.col(f"`{html_col}`").alias("page"))
    joined = rows.join(paths, F.col("own") == F.col("host"), "left")
    ready = joined.select(*[F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(kept)], "page", "paths")
    n = len(kept)
    schema = StructType([pages.schema[c] for c in kept] + [StructField("text", StringType())])

    def extract(batches):
        for batch in batches:
            texts = [
                text_of(parse(html.as_py()), found.as_py() or []) if html.is_valid else ""
                for html, found in zip(batch.column(n), batch.column(n + 1))
            ]
            yield pa.RecordBatch.from_arrays(batch.columns[:n] + [pa.array(texts, pa.string())], names=schema.names)

    return ready.mapInArrow(extract, schema)
