"""Main text of web pages by consensus host paths.

Each page scores its containers by the text they hold less the text of links, picks the
deepest one that holds most of it, and votes for that container's generalised
tag-and-class path. Votes are summed by host in Spark, and every page is read again with
the winning path of its host; a page without that path uses its own best container, in
the end the page itself. Menus, headers, footers, sidebars, notices, adverts, forms,
reader comments and the like are left out wherever they stand; a section of an article named by one word like
"discussion" goes by what it holds.

Reading is linear in the page in time and memory, however deep or broken its markup: open
elements are found by their names' own stacks, what an element inherits lies on the stack,
and a path is one number folded from its labels.

Scale: a page gives one vote row; the paths that win are one row a host, joined by
host (broadcast by Spark when small). Nothing else is shuffled.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache
from itertools import takewhile

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written

# fixed values: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption dd dt legend li option optgroup summary tbody td tfoot th thead tr".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "option": ("select", "datalist")}
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks whose end tag may be left out, controls that end with their own tag whatever is open in them, and inline elements that go on behind a block's end.
OPEN_ENDED = frozenset("option optgroup li p dt dd tr td th tbody thead tfoot caption".split())
CONTROLS = frozenset("select button datalist".split())
FORMATTING = frozenset("b big code em font i nobr s small strike strong tt u".split())

#: Elements that may be a page's main text.
CONTAINER = frozenset("article main section div td center".split())
#: Elements whose kind alone says that they are no main text.
DROPPED = frozenset("nav footer aside form script style noscript iframe template button select datalist textarea dialog menu search head title".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Elements no class or id can take out.
NEVER_DROPPED = frozenset("html body article main".split())
#: Words of a class or id that name other parts of a page, ...
UNWANTED = frozenset("ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsors sponsored promo promos promotion banner cookie cookies consent gdpr notice notices notification notifications alert alerts popup popover modal overlay toast newsletter subscribe subscription signup login register searchbox searchform share sharing social related recommended recommendations breadcrumb breadcrumbs menu menus nav navs navbar navigation navmenu topnav sitenav subnav sidebar sidebars sidenav widget widgets footer colophon copyright topbar toolbar pagination pager comment comments commentlist respond reply replies responses disqus discussion skip relatedposts relatedarticles relatedstories recommendedposts recommendedarticles recommendedstories readercomments usercomments commentthread commentsthread disqusthread privacynotice alertinfo alertwarning alertdanger alertsuccess".split())
#: ... those of them that, alone, may as well name a section of an article: there it goes by what the section holds, ...
WEAK = frozenset("discussion responses replies alerts social share sharing recommended recommendations related".split())
#: Inside an article, a part with a weak name stays if it has this many characters, at most this share of them in links, and no form, control or other unwanted part.
SECTION_CHARS, SECTION_LINKS = 200, 0.2
#: ... of a page's header, which inside an article is its headline's place, ...
HEADER = frozenset("header masthead".split())
#: ... and words that say nothing beside them. A name counts only if all its words are of these kinds, so "related-work" or "share-prices" stays.
PLAIN = frozenset("site page global main top bottom left right center side primary secondary first second third wrapper wrap container holder outer inner box bar block area zone region section panel pane group grid list items item link links button buttons icon icons row col column content text body title heading form fixed sticky floating small large big mobile desktop slot unit rail leaderboard skyscraper google js el m".split())
#: Headings under which readers' comments follow.
COMMENTS = re.compile(r"(?:\d+ )?(?:reader |readers' |user )?comments?(?: \(?\d+\)?)?:?|leave a (?:reply|comment)|(?:\d+ )?(?:kommentare|leserkommentare|commentaires|comentarios)(?: \(?\d+\)?)?:?", re.I)

#: Share of a page's text that the chosen container must hold.
MOST = 0.6

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")
_PART = re.compile(r"[a-z]+")


@lru_cache(4096)
def _kind(name: str) -> int:
    """Of one class or id: 3 if it is one weak word, 2 if it names an unwanted part, 1 if a header, else 0."""
    words = _PART.findall(_HUMP.sub(" ", name).lower())
    words.append("".join(words))  # "side-bar" is "sidebar"
    if words[-1] in WEAK:
        return 3
    if words[-1] in UNWANTED:
        return 2
    if words[-1] in HEADER:
        return 1
    own = set(words[:-1])
    if not own or own - UNWANTED - HEADER - PLAIN:
        return 0
    return 2 if own & UNWANTED else 1 if own & HEADER else 0


@lru_cache(8192)
def _read_tag(name: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """The generalised label of an element, whether it is dropped by itself, whether it is a header and whether its name is a weak one."""
    label, drop, header, weak = name, name in DROPPED, name == "header", False
    if "=" in attributes:
        found = {k.lower(): a or b or c for k, a, b, c in _NAMED.findall(attributes)}
        own = entities.unescape(found.get("class", "")).split()
        if own:
            label = ".".join([name, *sorted({_DIGITS.sub("", c.lower()) for c in own})])
        if name not in NEVER_DROPPED:
            kinds = {_kind(c) for c in (*own, *entities.unescape(found.get("id", "")).split()) if len(c) <= 100}
            drop = drop or 2 in kinds or found.get("role", "").strip().lower() in DROPPED_ROLES
            header = header or 1 in kinds and name not in HEADING
            weak = not drop and 3 in kinds
    return label, drop, header, weak


def _ends_in_value(attributes: str) -> bool:
    """Whether the slash at the end belongs to an unquoted value, as in ``href=/``; then it ends no element."""
    _, has_value, value = attributes.rsplit(None, 1)[-1].partition("=")
    return bool(has_value) and value[0] not in "\"'"


class Page:
    """A page's containers and its blocks of text, in page order."""

    def __init__(self, source: str):
        # of each container: the one around it, its path, the nearest article or main (itself included) or -1
        self.parent, self.path, self.semantic = [-1], [0], [-1]
        self.blocks: list[tuple[int, str, int, bool]] = []  # container, text, characters in links, whether a heading
        self._read(source)

    def _read(self, source: str) -> None:
        # of each open element: name, dropped, in a header, path, container, in an article or main, section with a weak name, blocks before it
        stack = [("", False, False, 0, 0, False, 0, 0)]
        sections: list[int] = []  # of each block, the innermost section with a weak name, 0 for none
        around, spoiled = [0], [False]  # of each such section, the one around it and whether it holds other unwanted parts
        at_name: dict[str, list[int]] = {}  # depths of the open elements of each name
        blocks: list[int] = [0]  # depths of the open blocks
        text: list[str] = []
        links, lower = 0, None

        def depth_of(names) -> int:
            return max((at_name[n][-1] for n in names if at_name.get(n)), default=0)

        def close_to(depth: int) -> None:
            while len(stack) > depth:
                at_name[stack.pop()[0]].pop()
            while blocks[-1] >= depth:
                blocks.pop()

        def flush() -> None:
            nonlocal links
            if not text:
                return
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                at = blocks[-1]
                name, _, header, _, container, _, section, _ = stack[at]
                outer = stack[at - 1]
                if name in HEADING and COMMENTS.fullmatch(joined) and not (outer[0] in ("article", "main") and outer[7] == len(self.blocks)):
                    stack[at - 1] = (outer[0], True, *outer[2:])  # its rest is dropped
                elif name in HEADING or not header:
                    self.blocks.append((container, joined, links, name in HEADING))
                    sections.append(section)
            links = 0

        def add(raw: str) -> None:
            nonlocal links
            if raw and not stack[-1][1]:
                clean = entities.unescape(raw) if "&" in raw else raw
                text.append(clean)
                if at_name.get("a"):
                    links += len(clean.strip())

        at = 0
        for m in iter(lambda: _TAG.search(source, at), None):
            add(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if closing:
                depth = depth_of((name,))
                if depth:
                    if name in BLOCK:
                        flush()
                    elif blocks[-1] > depth:
                        drops = stack[depth][1] and not stack[depth - 1][1]
                        inner = takewhile(lambda b: b > depth, reversed(blocks))
                        if name not in CONTROLS and (name in FORMATTING and not drops or any(stack[b][0] not in OPEN_ENDED for b in inner)):
                            continue
                        flush()
                    close_to(depth)
                elif name == "p":
                    flush()
                continue
            if name in BLOCK:
                flush()
                control = depth_of(CONTROLS)  # nothing in a control ends what is around it
                if name in CLOSES_P and stack[blocks[-1]][0] == "p" and blocks[-1] > control:
                    close_to(blocks[-1])
                if name in SIBLINGS:
                    scope, again = max(control, depth_of(SCOPE[name])), True
                    while again and (depth := depth_of(SIBLINGS[name])) > scope:
                        close_to(depth)
                        again = name in ("tr", "tbody", "tfoot")
                if name in ("html", "body") and at_name.get(name):
                    continue
                if name == "body" and at_name.get("head"):
                    close_to(at_name["head"][-1])
            elif name == "br":
                add(" ")
                continue
            elif name == "button" and at_name.get(name):
                flush()
                close_to(at_name[name][-1])
            if name in VOID or attributes.endswith("/") and name not in BLOCK and name not in RAW and not _ends_in_value(attributes):
                continue
            if name in RAW:
                lower = lower or source.lower()
                end = lower.find(f"</{name}", at)
                while end >= 0 and lower[end + len(name) + 2 : end + len(name) + 3] not in ("", ">", "/", " ", "\t", "\n", "\r", "\f"):
                    end = lower.find(f"</{name}", end + 1)
                at = len(source) if end < 0 else (source.find(">", end) + 1 or len(source))
                continue
            _, drop, header, path, container, inside, section, _ = stack[-1]
            if len(attributes) > 400:
                label, own_drop, own_header, weak = _read_tag.__wrapped__(name, attributes)
            else:
                label, own_drop, own_header, weak = _read_tag(name, attributes if _NAMED.search(attributes) else "")
            if weak and inside and name in CONTAINER:
                around.append(section)
                spoiled.append(False)
                section = len(around) - 1
            elif weak or own_drop:
                own_drop = spoiled[section] = True
            inside = inside or name in ("article", "main")
            if name not in ("html", "body"):
                path = xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), path)
            if name in CONTAINER:
                self.parent.append(container)
                self.path.append(path)
                self.semantic.append(len(self.path) - 1 if name in ("article", "main") else self.semantic[container])
                container = len(self.path) - 1
            drop = drop or own_drop or own_header and not inside
            at_name.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                blocks.append(len(stack))
            stack.append((name, drop, header or own_header, path, container, inside, section, len(self.blocks)))
        add(source[at:])
        flush()
        if len(around) > 1:
            self._without_parts(sections, around, spoiled)

    def _without_parts(self, sections: list[int], around: list[int], spoiled: list[bool]) -> None:
        """Leaves out the blocks of sections with a weak name that do not read like a section of the text."""
        chars, linked = [0] * len(around), [0] * len(around)
        for section, (_, text, links, _) in zip(sections, self.blocks):
            chars[section] += len(text)
            linked[section] += links
        for k in range(len(around) - 1, 0, -1):
            chars[around[k]] += chars[k]
            linked[around[k]] += linked[k]
            spoiled[around[k]] = spoiled[around[k]] or spoiled[k]
        gone = [False]
        for k in range(1, len(around)):
            gone.append(gone[around[k]] or spoiled[k] or chars[k] < SECTION_CHARS or linked[k] > SECTION_LINKS * chars[k])
        self.blocks = [b for s, b in zip(sections, self.blocks) if not gone[s]]

    def best(self) -> tuple[int, float]:
        """The path of the deepest container that holds most of the text besides links, and how much it holds; path 0 is the page itself.

        A container inside an article or main gives way to that. Otherwise it gives
        way to the one around it while that adds headings only.
        """
        held, plain = [0] * len(self.path), [0] * len(self.path)
        for container, text, links, heading in self.blocks:
            held[container] += max(0, len(text) - 2 * links)
            plain[container] += 0 if heading else len(text)
        for c in range(len(self.path) - 1, 0, -1):
            held[self.parent[c]] += held[c]
            plain[self.parent[c]] += plain[c]
        whole, top = held[0], 0
        if whole:
            for c in range(1, len(self.path)):  # a container that holds most lies in the one found before
                if held[c] >= MOST * whole:
                    top = c
        if self.semantic[top] >= 0:
            top = self.semantic[top]
        else:
            while top and plain[self.parent[top]] == plain[top]:
                top = self.parent[top]
        return self.path[top], float(held[top])

    def text(self, path: int) -> str:
        """Blocks inside the containers with this path, joined by line feeds."""
        inside = [path == 0]
        for c in range(1, len(self.path)):
            inside.append(inside[self.parent[c]] or self.path[c] == path)
        return "\n".join(t for c, t, _, _ in self.blocks if inside[c])


def main_text(source: str | None, path: int | None) -> str:
    """The text under ``path``; under the page's own best container if there is none, of the whole page if that is empty too."""
    if not source:
        return ""
    page = Page(source)
    return (page.text(path) if path else "") or page.text(page.best()[0]) or page.text(0)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars) for every row of ``pages``.

    A null or empty html gives an empty text, as does a page all of whose text is in
    parts that are left out; text outside any container belongs to the page itself.
    White space is white space in Unicode, so a no-break space is one; a line break
    element is white space inside its block. Of a header inside an article only the
    headings stay. After a heading like "Comments" the rest of the element around it
    is reader comments, unless the heading opens an article or main. A section of an
    article whose class or id is one word like "discussion" or "share" stays if it
    reads like prose. A control ends with its own tag, other inline elements with theirs
    if only elements whose end tag may be left out are open in them. A tag cut off by the end of the page is markup. Pages with a
    null url, or one without a host, vote together. Ties between paths go to the one
    with more text, then to the smaller path. Repeated rows are returned as often as
    they come in, null ids too; an empty table gives an empty result; other columns
    are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def vote():
        def step(batch: pa.RecordBatch):
            best = [Page(x).best() if x else (0, 0.0) for x in batch.column(1).to_pylist()]
            paths = [b[0] - (1 << 64) if b[0] >> 63 else b[0] for b in best]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.int64()), pa.array([b[1] for b in best], pa.float64())], names=["host", "path", "score"])

        return step

    votes = map_batches(rows.select(host_of(F.col("url")).alias("host"), "html"), vote, "host string, path long, score double").where("path <> 0")
    sums = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    first = F.min(F.struct(-F.col("n"), -F.col("score"), "path"))
    won = written(sums.groupBy("host").agg(first.alias("x")).select(F.col("host").alias("h"), F.col("x.path").alias("path")), "html-paths")

    def read():
        def step(batch: pa.RecordBatch):
            texts = [main_text(x, None if p is None else p % (1 << 64)) for x, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return step

    joined = rows.join(won, host_of(F.col("url")) == F.col("h"), "left").select("page_id", "url", "html", "path")
    return map_batches(joined, read, "page_id long, url string, text string, n_chars long")
