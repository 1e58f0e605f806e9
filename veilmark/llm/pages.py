"""Main text of HTML pages by consensus of each host.

Each page is read into its containers; the best one by text, links and hints
votes for its generalised path (tags with a class or id, digits removed).  The
votes are counted per host in Spark; then each page is read again and gives the
text of the containers on its host's winning path, or of its own best one if it
has none there.  Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are passed over by tag, role and name.
Elements whose names only hint at a list of links (shares, related or popular
stories) go where at least half of their text is linked, and stay elsewhere.
Formulas, captions and the text that stands in for media, scripts or frames are kept.

Character references are decoded, white space inside a block becomes one space,
blocks are joined by one space.  Null or empty html gives an empty text.  A null
or odd url counts under the host ''.  Repeated pages each vote and each get a row.
Columns other than the named ones are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import column_ddl, pa_schema, settled, text_batches

#: A comment, declaration or instruction; or a tag with quoted attributes; or what a cut page leaves of one.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([A-Za-z-]+)""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title iframe".split())
CONTAINERS = frozenset("html body article main section div td center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th blockquote pre figure figcaption address header footer nav aside form fieldset details summary hr dialog menu caption head hgroup search template svg canvas object select button video audio picture legend option noscript textarea".split())
CLOSES_P = BLOCKS - frozenset("caption td th tr tbody thead tfoot button option legend picture video audio canvas object select svg head noscript textarea".split())
#: An opening tag ends an open one of the set, but not beyond the tags that hold such.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}

JUNK_TAGS = frozenset("nav footer aside form button select template dialog menu head search".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
JUNK_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle adslot sponsor sponsored sponsors
    promo promos promotion promoted banner cookie cookies consent gdpr privacy notice notices notification notifications alert
    popup modal overlay newsletter subscribe subscription signup comment comments commentlist disqus
    sidebar sidebars sidenav menu menus nav navbar navigation breadcrumb breadcrumbs
    crumbs footer masthead topbar toolbar pagination pager login search form copyright paywall""".split()
)
#: Names that speak against an element only where its text is mostly links.
LINK_WORDS = frozenset(
    """share sharing sharebar social related recommended recommendations popular trending rail widget widgets skip feedback survey
    respond responses reply replies discussion""".split()
)
#: Within an article these names, with no more than ``PLACE_WORDS`` beside them, still speak against an element; the rest of
#: ``JUNK_WORDS`` only raise a doubt there, which links settle: an article may well have a part on privacy, menus or search.
STRONG_WORDS = JUNK_WORDS - frozenset("privacy search menu menus consent alert banner promotion promoted login copyright form overlay masthead".split())
PLACE_WORDS = frozenset(
    """area article bar block body bottom box container content first form header inline inner item items last left link links list main
    page panel post reader right section site slot text thread title top unit user wrap wrapper""".split()
)
GOOD_WORDS = frozenset("article content entry post story main text body maincontent bodytext".split())
NEUTRAL_STARTS = frozenset("has with no is without hide show".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.coalesce(host, F.lit(""))


class Node:
    """A container.  ``at``: how many names from the root on agree with the wanted path, or -1."""

    __slots__ = ("at", "doubted", "good", "head", "inside", "key", "linked", "own", "parent", "tag", "total")

    def __init__(self, tag: str, parent: Node | None, key: str, good: bool, doubted: bool = False):
        self.tag, self.parent, self.key, self.good, self.doubted = tag, parent, key, good, doubted
        self.own = self.total = self.linked = self.at = 0
        self.head = self.inside = False

    def path(self) -> str:
        parts, node = [], self
        while node is not None:
            parts.append(node.key)
            node = node.parent
        return ">".join(reversed(parts))


def names_of(attributes: str) -> tuple[dict[str, str], list[list[str]]]:
    """Attributes, and the words of each class and id."""
    found = {m[1].lower() if m[1] else m[5].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    names = [n for key in ("class", "id") for n in found.get(key, "").split()]
    return found, [[w.lower() for w in WORD.findall(n)] for n in names]


def is_junk(tag: str, inside: bool, found: dict[str, str], names: list[list[str]]) -> tuple[bool, bool, bool]:
    """Whether an element is passed over, whether a name speaks for it, and whether it goes if its text is links. ``inside``: within an article or main."""
    good = any(len(n) <= 2 and n and n[-1] in GOOD_WORDS for n in names)
    if tag in JUNK_TAGS or tag == "header" and not inside:
        return True, good, False
    if tag in ("html", "body", "article", "main") or tag in HEADINGS:
        return False, good, False
    if found.get("role", "").lower() in JUNK_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True, good, False
    ends = [(n, {n[0], n[-1]}) for n in names if n and n[0] not in NEUTRAL_STARTS]
    bad = any(e & JUNK_WORDS or n in (["header"], ["site", "header"], ["page", "header"]) and not inside for n, e in ends)
    if inside:
        strong = any(set(n) <= STRONG_WORDS | PLACE_WORDS and set(n) & STRONG_WORDS for n, _ in ends)
        return strong and not (good and not any(len(n) == 1 and n[0] in STRONG_WORDS for n in names)), good, bad or any(e & LINK_WORDS for _, e in ends)
    return bad and not (good and not any(len(n) == 1 and n[0] in JUNK_WORDS for n in names)), good, any(e & LINK_WORDS for _, e in ends)


class Page:
    """Blocks of text with the container that holds each, in page order."""

    def __init__(self, source: str):
        self.nodes: list[Node] = []
        self.blocks: list[tuple[str, Node]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        root = Node("html", None, "html", False)
        self.nodes.append(root)
        #: (tag, container in force, junk in force)
        stack: list[tuple[str, Node, bool]] = [("html", root, False)]
        text: list[str] = []
        linked = link = 0
        heading = False
        at, end = 0, len(source)

        def flush() -> None:
            nonlocal linked
            if text:
                words = " ".join(entities.unescape("".join(text)).split())
                text.clear()
                if words:
                    node = stack[-1][1]
                    node.own += len(words)
                    node.linked += min(linked, len(words))
                    node.head = node.head or heading
                    self.blocks.append((words, node))
            linked = 0

        while at < end:
            m = MARKUP.search(source, at)
            stop = m.start() if m else end
            if stop > at and not stack[-1][2]:
                piece = source[at:stop]
                text.append(piece)
                linked += len(piece) * (link > 0)
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing = m[1] or m[4]
            if tag == "a":
                link = 0 if closing else 1
                continue
            if tag == "br":
                text.append(" ")
                continue
            if tag in RAW and not closing:
                over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                at = over.start() if over else end
                continue
            if tag not in BLOCKS:
                continue
            flush()
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                heading = stack[-1][0] in HEADINGS
                continue
            if tag in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] in CONTAINERS:
                        break
            if tag in ENDS:
                own, holders = ENDS[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in holders:
                        break
                    if stack[i][0] in own:
                        del stack[i:]
                        break
            if tag in VOID or tag in ("html",):
                continue
            _, node, junk = stack[-1]
            attributes = m[3] or m[6] or ""
            found, names = names_of(attributes) if attributes.strip(" /") else ({}, [])
            inside = any(s[0] in ("article", "main") for s in stack) if tag == "header" or names else False
            bad, good, doubted = is_junk(tag, inside, found, names)
            if (tag in CONTAINERS or doubted) and not (junk or bad):
                name = next((".".join(n) for n in names if n), "")
                node = Node(tag, node, f"{tag}.{name}" if name else tag, good, doubted)
                self.nodes.append(node)
            if not (attributes.rstrip().endswith("/") and tag == "svg"):
                stack.append((tag, node, junk or bad))
            heading = tag in HEADINGS
        flush()
        linked: dict[int, int] = {}
        for n in reversed(self.nodes):
            n.total += n.own
            linked[id(n)] = linked.get(id(n), 0) + n.linked
            if n.doubted and 2 * linked[id(n)] < n.total:
                n.doubted = False
            if n.parent is not None:
                n.parent.total += n.total
                n.parent.head = n.parent.head or n.head
                linked[id(n.parent)] = linked.get(id(n.parent), 0) + linked[id(n)]
        for n in self.nodes:  # what a list of links holds goes with it
            n.doubted = n.doubted or n.parent is not None and n.parent.doubted

    def best(self) -> Node:
        """The container with the most text of its own and of the containers in it, hints weighed in."""
        below: dict[int, float] = {}
        for n in self.nodes:
            if n.parent is not None and not n.doubted:
                below[id(n.parent)] = below.get(id(n.parent), 0) + n.own - n.linked

        def score(n: Node) -> float:
            hint = 1.5 if n.tag in ("article", "main") else 1.25 if n.good else 1.0
            return -1.0 if n.doubted else (n.own - n.linked + 0.5 * below.get(id(n), 0.0)) * hint

        top = max(self.nodes, key=score)
        self.score = int(score(top))
        around = top
        while around is not None:  # the article that holds it
            if around.tag == "article":
                return around
            around = around.parent
        while top.parent is not None and not top.head and top.parent.head and top.parent.total <= 1.25 * top.total:
            top = top.parent
        return top

    def text(self, path: str | None) -> tuple[str, str]:
        """The text of the containers on ``path``, or of the page's own best one; and the path taken."""
        if path is not None:
            keys = path.split(">")
            for n in self.nodes:  # a container stands after the one that holds it
                up = 0 if n.parent is None else n.parent.at
                n.at = up + 1 if 0 <= up < len(keys) and keys[up] == n.key else -1
            if words := self._of(lambda n: n.at == len(keys)):
                return words, path
        best = self.best()
        return self._of(lambda n: n is best), best.path()

    def _of(self, chosen: Callable[[Node], bool]) -> str:
        for n in self.nodes:
            n.inside = chosen(n) or n.parent is not None and n.parent.inside
        return " ".join(words for words, n in self.blocks if n.inside and not n.doubted)


#: Rows of hosts and paths up to which they are broadcast (about 100 bytes each); more are joined by host and salt.
BROADCAST_HOSTS = 50_000
SALTS = 64


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, path``: the path with the most votes; ties by summed score, then by path."""

    def run(batches):
        schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("score", pa.int64())])
        for hosts, sources in text_batches(batches):
            read = [Page(s) for s in sources]
            paths = [p.best().path() for p in read]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths), pa.array([p.score for p in read], pa.int64())], schema=schema)

    votes = pages.select(host_of(F.col(url_col)).alias("host"), html_col).mapInArrow(run, "host string, path string, score long").where("score > 0")
    counts = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    return counts.groupBy("host").agg(F.max_by("path", F.struct("n", "score", "path")).alias("path"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``text``, its length in code points and the path taken, for each row."""
    winners = settled(host_paths(pages, url_col, html_col))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host_of(F.col(url_col)).alias("host"))
    if winners.count() <= BROADCAST_HOSTS:
        rows = rows.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("_id", "_url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    id_type, url_type = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()
    ddl = f"`{id_col}` {id_type}, `{url_col}` {url_type}, text string, n_chars long, path string"
    schema = pa_schema(ddl)

    def run(batches):
        for keys, sources in text_batches(batches):
            read = [Page(s).text(k["path"]) for k, s in zip(keys, sources, strict=True)]
            columns = [k["_id"] for k in keys], [k["_url"] for k in keys], [t for t, _ in read], [len(t) for t, _ in read], [p for _, p in read]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.select(F.struct("_id", "_url", "path").alias("key"), "_html").mapInArrow(run, ddl)
