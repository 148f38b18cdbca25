"""Main text of web pages by tree scoring.

A page becomes a tree, whatever its markup lacks. Menus, footers, controls and what is hidden are left out by their tags
and attributes. Names only raise a doubt, and only if each word of one is a word of page furniture (related-posts, not
related-work); what the subtree holds then decides: links, controls, headings, how short it is, and whether there is a text
without it. A form is left out unless it wraps the page. Each run of text then passes points for its length and its commas to the containers
around it, less the further they are and the more of the run is links. The container of most points, after a discount
for its own links, is kept, or the whole article or main element around it, and siblings that look like parts of the same text or are
articles of its kind.
Time and memory are in proportion to the page, whatever its markup.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound_batches, lean, read

MARK = re.compile(r"<(?:(?P<note>!--)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)|[!?/])")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>"']|$)""", re.IGNORECASE)

# The element names of HTML by kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template xmp noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var img br wbr picture source input".split())
#: Cells of a row are parts of one block, with a space between them.
CELLS = {"td", "th"}
LEFT_OUT = set("nav footer aside button select option datalist dialog menu svg canvas object audio video map head".split())
#: What a reader fills in or presses.
CONTROLS = {"input", "select", "textarea", "button"}
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
PARAGRAPHS = set("p pre li dt dd blockquote h1 h2 h3 h4 h5 h6 tr caption figcaption summary address".split())
NEVER = {"html", "body", "main"}
#: What a head may hold; any other element ends it.
OF_HEAD = set("title meta link script style base basefont bgsound noscript template noframes".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Siblings that are part of a text if they are next to it, and elements that are one as a whole.
PARTS = PARAGRAPHS - {"address", "summary"} | set("ul ol dl figure table section hgroup details".split())
WHOLE = {"article", "main"}
#: An opening tag ends these open elements, up to the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = {"table", "td", "th", "button", "object", "html"}
#: What tags end beside open paragraphs: nothing, or one of ENDS; the place of a tag among these; tags that change any.
KINDS = [(set(), set()), *ENDS.values()]
PLACE = {name: i for i, name in enumerate(ENDS, 1)}
SPECIAL = {"p"} | SCOPE | {name for kinds in KINDS for own in kinds for name in own}
# Words of the names of page furniture. A name is in doubt if all its words are here and one is no FILLER.
FIRM = set("ad ads adv advert adverts advertisement advertisements adsense adsbygoogle adslot adbox sponsor sponsored promo promos outbrain taboola sidebar sidenav navbar breadcrumb breadcrumbs masthead footer cookie gdpr popup modal newsletter subscribe comment comments commentlist disqus respond paywall".split())
SOFT = set("menu menus nav navigation consent login signin signup register share sharing social related recommend recommended recommendation recommendations widget widgets toolbar pagination pager skip promotion promotions advertising sponsors subscription subscriptions cookies".split())
NOTICE = {"notice", "notices"}
REPLIES = set("reply replies response responses".split())
MILD = set("banner banners header headers topbar overlay alert alerts discussion discussions disclaimer disclaimers".split())
FILLER = set("a an and the of to us me you your our my box bar list links link area section wrapper wrap container content block item items inner outer holder panel post posts page pages site top bottom left right main global module region group row col column button buttons icon icons form title heading head more read text article articles story stories entry user reader readers thread count wp js fixed sticky mobile desktop primary secondary media network buttonbar slot unit body view".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_a-zA-Z]+")
#: Characters of a subtree in doubt up to which it is short, and for each of its controls.
SHORT, EACH = 300, 400
#: Characters for each control from which a form or a part of one is a text with controls in it.
PROSE = 200
#: Characters that a box with a main heading has at most to be a title.
TITLE = 400
#: Elements that are nested deeper become siblings, as browsers do it.
DEPTH = 512
BONUS = {"article": 25.0, "main": 15.0, "section": 3.0, "div": 3.0, "td": 2.0}


# Doubts about a subtree: it is left out at once, or by what it holds.
NO, OUT, BY_MILD, BY_REPLIES, BY_FIRM, BY_SOFT, BY_NOTICE, BY_FORM, BY_FIELDS = range(9)
DOUBTS = ((FIRM, BY_FIRM), (REPLIES, BY_REPLIES), (NOTICE, BY_NOTICE), (SOFT, BY_SOFT), (MILD, BY_MILD))


def named(value: str) -> int:
    """The doubt that a class or id raises: of its names, the first that are all furniture."""
    found = NO
    for name in value.split():
        words = {w.lower() for w in WORD.findall(name)} - FILLER
        kinds = [next((doubt for own, doubt in DOUBTS if w in own), NO) for w in words]
        if kinds and NO not in kinds and (not found or BY_FIRM in kinds):
            found = BY_FIRM if BY_FIRM in kinds else min(kinds)
    return found


def unwanted(tag: str, rest: str, inside: bool) -> int:
    """The doubt about a subtree by its tag and attributes."""
    if tag in LEFT_OUT or tag == "header" and not inside:
        return OUT
    found = BY_FORM if tag == "form" else BY_FIELDS if tag == "fieldset" else NO
    if len(rest) < 5 or tag in NEVER or found == BY_FORM:
        return found
    for name, value in ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return OUT
        if name == "role" and value.lower() in ROLES:
            found = BY_FORM if value.lower() == "form" else BY_FIRM
        elif name in ("class", "id") and found != BY_FIRM:
            found = named(value) or found
    return found if tag not in WHOLE or found == BY_FIRM else NO


class Page:
    """The tree of a page as lists by node, parents first, and the runs of text that are not left out."""

    def __init__(self, html: str):
        self.tag, self.up, self.out = ["html"], [-1], [False]
        self.links: list[bool] = [False]
        #: Whether a node is part of an article or of the main part, and its depth.
        self.inside, self.depth = [False], [0]
        #: The doubt about a node, and the controls right in it.
        self.doubt, self.controls = [NO], [0]
        #: By node, for each of KINDS: the outermost open element that such a tag ends, before a scope and beyond it.
        self.ended: list[tuple[int, ...]] = [(-1,) * len(KINDS)]
        self.beyond: list[tuple[int, ...]] = [(-1,) * len(KINDS)]
        #: The open elements by depth, and by name those that were opened; what is no longer open is dropped when met.
        self.path, self.opened = [0], {"html": [0]}
        #: Characters that may still be read in vain for a quote that nothing closes.
        self.patience = 4 * len(html) + 1000
        #: (node, text, in a link) by run; a run ends where a block starts or ends.
        self.runs: list[list[tuple[int, str, bool]]] = [[]]
        self.parse(html)

    def add(self, node: int, text: str) -> None:
        if text and not self.out[node]:
            self.runs[-1].append((node, unescape(text) if "&" in text else text, self.links[node]))

    def cut(self) -> None:
        if self.runs[-1]:
            self.runs.append([])

    def tag_end(self, html: str, at: int) -> int:
        """Behind the mark that ends a tag, not counting marks in quotes, unless these are never closed; -1 if none is."""
        i = at
        while self.patience > 0 and (m := STOP.search(html, i)):
            if m[0] == ">":
                return m.end()
            i = html.find(m[0], m.end()) + 1
            if not i:
                break
        else:
            m = None
        if m or i > at:
            self.patience -= len(html) - at
        return html.find(">", at) + 1 or -1

    def parse(self, html: str) -> None:
        at, here = 0, 0
        while m := MARK.search(html, at):
            start = m.start()
            if m["note"]:
                self.add(here, html[at:start])
                if html.startswith((">", "->"), m.end()):
                    at = html.index(">", m.end()) + 1
                else:
                    end = html.find("-->", m.end())
                    at = len(html) if end < 0 else end + 3
                continue
            end = self.tag_end(html, m.end())
            if end < 0:
                break
            self.add(here, html[at:start])
            at, name, rest = end, m["name"], html[m.end() : end]
            if name is None:
                continue
            name = name.lower()
            if m["end"]:
                here = self.close(here, name)
                continue
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(html, at)
                at = (html.find(">", close.end()) + 1 if close else 0) or len(html)
                continue
            if name not in OF_HEAD:
                here = self.out_of_head(here)
            if name in CELLS:
                here = self.implied(here, name)
                self.add(here, " ")
            elif name not in INLINE:
                self.cut()
                here = self.implied(here, name)
            elif name == "br":
                self.add(here, " ")
            if name in CONTROLS and "hidden" not in rest.lower():
                self.controls[here] += 1
            if name in VOID or name == "html":
                continue
            if self.depth[here] >= DEPTH:
                here = self.up[here]
            here = self.open(here, name, rest)
        self.add(here, html[at:])

    def open(self, up: int, name: str, rest: str) -> int:
        here, depth = len(self.tag), self.depth[up] + 1
        self.tag.append(name)
        self.up.append(up)
        self.depth.append(depth)
        doubt = unwanted(name, rest, self.inside[up])
        self.out.append(self.out[up] or doubt == OUT)
        self.doubt.append(doubt if doubt != OUT else NO)
        self.controls.append(0)
        self.inside.append(self.inside[up] or name in WHOLE)
        self.links.append(self.links[up] or name == "a")
        ended, beyond = self.ended[up], self.beyond[up]
        if name in SPECIAL:
            first = lambda old: old if old >= 0 else here
            ended = tuple(-1 if name in SCOPE | stop else first(e) if name == "p" or name in ends else e for e, (ends, stop) in zip(ended, KINDS, strict=True))
            beyond = tuple(-1 if name in stop else first(e) if name in ends else e for e, (ends, stop) in zip(beyond, KINDS, strict=True))
        self.ended.append(ended)
        self.beyond.append(beyond)
        del self.path[depth:]
        self.path.append(here)
        self.opened.setdefault(name, []).append(here)
        return here

    def nearest(self, here: int, *names: str) -> int:
        """The innermost open element of these names, -1 if none is open; closed ones are forgotten."""
        found = -1
        for name in names:
            own = self.opened.get(name, [])
            while own and (self.depth[own[-1]] > self.depth[here] or self.path[self.depth[own[-1]]] != own[-1]):
                own.pop()
            found = max(found, own[-1] if own else -1)
        return found

    def out_of_head(self, here: int) -> int:
        """The open element, once a head that is still open is closed."""
        head = self.nearest(here, "head")
        return self.up[head] if head > 0 and head > self.nearest(here, *NEVER, "article") else here

    def implied(self, here: int, name: str) -> int:
        """The open element once those that this tag ends are closed."""
        kind = PLACE.get(name, 0)
        if (at := self.ended[here][kind]) >= 0:
            here = self.up[at]
        if kind and (at := self.beyond[here][kind]) >= 0:
            here = self.up[at]
        return here

    def close(self, here: int, name: str) -> int:
        if name not in INLINE and name not in CELLS:
            self.cut()
        node = self.nearest(here, name)
        if node <= 0:
            return here
        if name not in ("table", "tr", "tbody", "thead", "tfoot", "html", "body") and self.nearest(here, "td", "th", "table") > node:
            return here
        return self.up[node]

    def sums(self, blocks: list[tuple[int, str, float]]) -> tuple[list[float], list[float], list[int], list[bool], list[int]]:
        """By node: characters, those in links, blocks that are no heading, whether it holds a main heading, headings."""
        n = len(self.tag)
        size, linked, plain, first, heads = [0.0] * n, [0.0] * n, [0] * n, [False] * n, [0] * n
        for node, t, links in blocks:
            size[node] += len(t)
            linked[node] += len(t) * links
            plain[node] += self.tag[node] not in HEADINGS
            heads[node] += self.tag[node] in HEADINGS
            first[node] = first[node] or self.tag[node] == "h1"
        for node in range(n - 1, 0, -1):
            up = self.up[node]
            size[up] += size[node]
            linked[up] += linked[node]
            plain[up] += plain[node]
            heads[up] += heads[node]
            first[up] = first[up] or first[node]
        return size, linked, plain, first, heads

    def blocks(self) -> list[tuple[int, str, float]]:
        """Node, text and share of links of each block, but for those in a subtree that is no part of the text."""
        out = []
        for run in self.runs:
            t = " ".join("".join(x[1] for x in run).split())
            if t:
                out.append((self.block(run[0][0]), t, sum(len(x[1]) for x in run if x[2]) / sum(len(x[1]) for x in run)))
        if any(self.doubt):
            gone = self.refused(out)
            out = [x for x in out if not gone[x[0]]]
        return out

    def refused(self, blocks: list[tuple[int, str, float]]) -> list[bool]:
        """By node, whether it is left out for what it holds, or is in a subtree that is."""
        size, linked, _, first, heads = self.sums(blocks)
        controls, whole = self.controls[:], any(x in WHOLE for x in self.tag)
        for node in range(len(controls) - 1, 0, -1):
            controls[self.up[node]] += controls[node]
        free = [a - b for a, b in zip(size, linked, strict=True)]

        def refuse(i: int) -> bool:
            doubt, each = self.doubt[i], size[i] / controls[i] if controls[i] else float("inf")
            if doubt in (BY_MILD, BY_REPLIES):
                own = self.inside[i] or doubt == BY_MILD and not whole and heads[i] > 0 and size[i] > SHORT or first[i] and size[i] <= TITLE
                return linked[i] > size[i] / 2 or not own
            if doubt == BY_FIRM:
                return free[0] - free[i] >= max(1.0, free[i] / 20)
            if doubt == BY_FORM:
                return each < PROSE or size[i] < size[0] and (size[i] <= SHORT or 2 * size[i] < size[0])
            if doubt == BY_FIELDS:
                return each < PROSE
            short = size[i] <= SHORT and (doubt == BY_NOTICE or not heads[i])
            return short or linked[i] > size[i] / 3 or each < EACH

        gone = [False] * len(self.tag)
        for i in range(1, len(gone)):
            gone[i] = gone[self.up[i]] or self.doubt[i] != NO and refuse(i)
        return gone

    def text(self) -> str:
        """Blocks of the best container and of its siblings, one a line."""
        blocks = self.blocks()
        if not blocks:
            return ""
        n = len(self.tag)
        points, (size, linked, plain, first, _) = [0.0] * n, self.sums(blocks)
        for node, t, links in blocks:
            s = (t.count(",") + t.count("，") + t.count("、") + min(len(t) / 100, 3) + (len(t) >= 25)) * (1 - links)
            to, share = (self.up[node] if self.tag[node] in PARAGRAPHS and node else node), 1
            while to >= 0 and share <= 6:
                points[to] += s / share
                to, share = self.up[to], share + 1
        pure = lambda i: 1 - linked[i] / size[i] if size[i] else 0.0
        score = [(points[i] + BONUS.get(self.tag[i], 0.0)) * pure(i) if size[i] and self.tag[i] not in PARAGRAPHS and self.tag[i] not in INLINE else 0.0 for i in range(n)]
        top = max(range(n), key=lambda i: (score[i], -i))
        whole = top
        while whole > 0 and self.tag[whole] not in WHOLE:
            whole = self.up[whole]
        root = whole or top
        kept = {root}
        if self.up[root] >= 0 and not whole:
            least = max(10.0, score[top] * 0.2)
            for i in range(n):
                if self.up[i] == self.up[root] and i != root and size[i] and (score[i] >= least or self.tag[i] == "p" and pure(i) > 0.75 and size[i] > 80):
                    kept.add(i)
        title = lambda i: first[i] and size[i] <= TITLE
        kind = lambda i: "h1" if title(i) else "h2" if size[i] and not plain[i] else self.tag[i]
        own = self.neighbours(kept, blocks, self.up[root], pure, kind, bool(whole) and not self.inside[self.up[root]])
        if whole and self.tag[root] == "article":
            kept |= {i for i in range(n) if self.up[i] == self.up[root] and self.tag[i] == "article" and 2 * size[i] >= size[root] and pure(i) > 0.75}
        keep = [False] * n
        for i in range(n):
            keep[i] = i in kept or self.up[i] >= 0 and keep[self.up[i]]
        return "\n".join(t for j, (node, t, _) in enumerate(blocks) if keep[node] or j in own)

    def neighbours(self, kept: set[int], blocks: list[tuple[int, str, float]], parent: int, pure: Callable[[int], float], kind: Callable[[int], str], marked: bool) -> set[int]:
        """Adds to kept what stands between its members or next to them, and returns such blocks of the parent's own.

        Between is all from a main heading, or a box with one, before them to the last one. Next to them, parts of a text
        count, or only headings before an element that is marked as an article by itself. Nothing that is mostly links
        counts.
        """
        if parent < 0:
            return set()
        items: list[tuple[int, int]] = []
        child = [-1] * len(self.tag)
        for i in range(1, len(self.tag)):
            child[i] = i if self.up[i] == parent else child[self.up[i]]
        for j, (node, _, _) in enumerate(blocks):
            if child[node] >= 0 and not (items and items[-1][0] == child[node]):
                items.append((child[node], -1))
            elif node == parent:
                items.append((-1, j))
        tag = lambda x: kind(x[0]) if x[0] >= 0 else "p"
        fit = lambda x: (pure(x[0]) if x[0] >= 0 else 1 - blocks[x[1]][2]) > 0.5
        at = [k for k, x in enumerate(items) if x[0] in kept]
        first, last = at[0], at[-1]
        first = first if marked else next((k for k in range(first) if tag(items[k]) == "h1" and fit(items[k])), first)
        while first > 0 and tag(items[first - 1]) in (HEADINGS if marked else PARTS) and fit(items[first - 1]):
            first -= 1
        while not marked and last + 1 < len(items) and tag(items[last + 1]) in PARTS and fit(items[last + 1]):
            last += 1
        more = [x for x in items[first : last + 1] if fit(x)]
        kept |= {x[0] for x in more if x[0] >= 0}
        return {x[1] for x in more if x[0] < 0}

    def block(self, node: int) -> int:
        while node > 0 and (self.tag[node] in INLINE or self.tag[node] in CELLS):
            node = self.up[node]
        return node


def main_text(html: str | None) -> str:
    """The main text of one page; empty for a page that is null, empty or without text. Elements nested deeper than DEPTH
    count as siblings."""
    return Page(html).text() if html else ""


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns with text and n_chars, a row a page, repeated rows as well; no rows in, no rows out.

    A null or empty page has an empty text; a page of any length is read whole. Other columns of pages, whatever their
    names, are neither read nor returned; keep must not name text or n_chars.
    """
    bound_batches(pages.sparkSession)
    names = [*keep, "text", "n_chars"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts))], names=names)

    rows = pages.select(*keep, F.col(html).alias("_html"))
    return rows.mapInArrow(lean(work), rows.withColumns({"text": F.lit("").cast("string"), "n_chars": F.lit(0).cast("long")}).drop("_html").schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))
