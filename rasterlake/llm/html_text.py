"""Main text of web pages: a tree-structured graphical model over the DOM, by sum-product message passing."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags that end a block of text.
BLOCK_TAGS = set(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript object ol optgroup option p pre script search section select style summary "
    "svg table tbody td template textarea tfoot th thead title tr ul video audio".split()
)
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as running text.
HIDDEN_TAGS = {"script", "style", "head", "title", "noscript", "template", "svg", "iframe", "object", "textarea", "select", "button", "canvas", "video", "audio"}
#: What an opening tag ends, if it is open and no tag of the second set is nearer.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_P_STAYS = {"button", "script", "style", "template", "iframe", "object", "svg", "canvas", "video", "audio", "noscript", "select", "option", "textarea", "title", "head", "html", "body", "td", "th", "caption", "tr", "tbody", "thead", "tfoot", "legend", "optgroup", "summary"}
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")


class Node:
    """An element, or a block of text (`tag` None)."""

    __slots__ = ("tag", "names", "parent", "text", "linked", "label")

    def __init__(self, tag: str | None, names: str, parent: int, text: str = "", linked: int = 0) -> None:
        self.tag, self.names, self.parent, self.text, self.linked, self.label = tag, names, parent, text, linked, None


class _Tree:
    """Nodes in page order, parents before children. Inline tags only leave their text; br is white space."""

    def __init__(self) -> None:
        self.nodes = [Node("html", "", -1)]
        self.open = [0]
        self.count: Counter = Counter()  # of open elements by tag, so that no tag searches the stack in vain
        self.parts: list[str] = []
        self.linked = self.links = 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.nodes.append(Node(None, "", self.open[-1], text, min(self.linked, len(text))))
        self.parts, self.linked, self.links = [], 0, 0

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.links = 1
        if tag not in BLOCK_TAGS:
            return
        self.flush()
        if tag == "html" or tag == "body" and self.count[tag]:
            return
        if tag == "body":
            self.close({"head"}, set())
        if tag not in _P_STAYS:
            self.close({"p"}, {"td", "th", "button", "object", "table"})
        if tag in CLOSES:
            self.close(*CLOSES[tag])
        if tag in VOID_TAGS:
            return
        names = " ".join(unescape((m[2] or m[3] or m[4] or "")) for m in _NAMED.finditer(attributes))
        self.nodes.append(Node(tag, names, self.open[-1]))
        self.open.append(len(self.nodes) - 1)
        self.count[tag] += 1

    def close(self, tags: set[str], stop: set[str]) -> None:
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.nodes[self.open[i]].tag
            if tag in tags:
                for j in self.open[i:]:
                    self.count[self.nodes[j].tag] -= 1
                del self.open[i:]
                return
            if tag in stop:
                return

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        if tag in BLOCK_TAGS and tag not in VOID_TAGS:
            self.flush()
            if tag not in ("html", "body"):
                self.close({tag}, set() if tag != "p" else {"article", "div", "section", "main", "td"})

    def text(self, data: str) -> None:
        data = unescape(data)
        self.parts.append(data)
        if self.links:
            self.linked += len(data)


#: A tag with its attributes; what follows an unclosed one up to the next < is part of it.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*)((?:[^"'<>]++|"[^"<]*+"|'[^'<]*+'|["'])*+)(>|(?=<)|\Z)""")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_RAW_TAGS = {t: re.compile(f"</{t}(?=[\\s/>]|\\Z)", re.IGNORECASE) for t in ("script", "style", "textarea", "title")}


def tree(html: str) -> list[Node]:
    """The nodes of a page, read once from start to end; a tag that the page's end cuts off is markup, not text."""
    out, at, n = _Tree(), 0, len(html)
    while at < n:
        i = html.find("<", at)
        if i != at:
            out.text(html[at : i if i >= 0 else n])
            if i < 0:
                break
        if m := _TAG.match(html, i):
            tag = m[2].lower()
            at = m.end()
            if m[1]:
                out.end(tag)
            else:
                out.start(tag, m[3])
                if tag in _RAW_TAGS:
                    close = _RAW_TAGS[tag].search(html, at)
                    if tag in ("title", "textarea"):
                        out.text(html[at : close.start() if close else n])
                    at = close.start() if close else n
        elif html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            at = end + 3 if end >= 0 else n
        elif html[i + 1 : i + 2] in ("!", "?", "/"):
            end = html.find(">", i)
            at = end + 1 if end >= 0 else n
        else:
            out.text("<")
            at = i + 1
    out.flush()
    return out.nodes


#: Names of elements are counted in so many hashed classes, all of them, however many names pages use.
NAME_CLASSES = 1 << 15


def _bin(n: float, ends: tuple[float, ...]) -> int:
    return sum(n > e for e in ends)


def node_features(nodes: list[Node]) -> list[list[str]]:
    """What each node shows of itself: its tag and the parts of its names, or its text's form; its share of linked text; and whether it is set apart."""
    size, linked = [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        size[i] += len(nodes[i].text)
        linked[i] += nodes[i].linked
        if nodes[i].parent >= 0:
            size[nodes[i].parent] += size[i]
            linked[nodes[i].parent] += linked[i]
    out = []
    for i, node in enumerate(nodes):
        links = f"links{_bin(linked[i] / size[i], (0.05, 0.3, 0.6, 0.9)) if size[i] else 'none'}"
        if node.tag is None:
            text = node.text
            mark = "copyright" if "©" in text or "all rights reserved" in text.lower() else "plain"
            out.append(["text", f"size{_bin(len(text), (20, 60, 150, 400))}", f"end{text[-1] in '.!?:;\"'}", mark, links])
        else:
            out.append([f"tag={node.tag}", links, *dict.fromkeys(f"name={zlib.crc32(n.encode()) % NAME_CLASSES}" for n in _NAME.findall(node.names.lower()))])
    for found, apart in zip(out, set_apart(nodes), strict=True):
        if apart:
            found.append("apart")
    return out


#: Parts that are never main text, by tag and by name; what is in them is not either, whatever counts say. Fixed values.
APART_TAGS = {"nav", "footer", "aside", "form", "dialog"}
APART_NAMES = set(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion adsense banner cookie cookies consent gdpr popup modal "
    "nav navbar navigation menu topnav subnav breadcrumb breadcrumbs pagination pager sidebar complementary widget widgets footer contentinfo masthead "
    "comment comments reply replies respond disqus newsletter subscribe signup login search share sharing social related recommended notice disclaimer".split()
)
#: How much less likely all or some of such a part is content.
APART = 1e-9


def set_apart(nodes: list[Node]) -> list[bool]:
    """Whether each node is, or lies in, a part that is never main text.

    An element whose tag or name says so is none if it holds an article, a main part or the first heading, or
    over half of the page's text that is not linked: then it is a frame around the page.
    """
    n = len(nodes)
    plain, frame = [0] * n, [False] * n
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        plain[i] += len(node.text) - node.linked
        frame[i] |= node.tag in ("article", "main", "h1")
        if node.parent >= 0:
            plain[node.parent] += plain[i]
            frame[node.parent] |= frame[i]
    apart = [False] * n
    for i, node in enumerate(nodes):
        if node.parent >= 0 and apart[node.parent]:
            apart[i] = True
        elif node.tag in APART_TAGS or node.tag not in (None, "html", "body", "main", "article") and not APART_NAMES.isdisjoint(_NAME.findall(node.names.lower())):
            apart[i] = not frame[i] and 2 * plain[i] <= plain[0]
    return apart


#: Labels of an element: none of its text is content, all is, or some is. A block of text has one of the first two.
NONE, ALL, SOME = 0, 1, 2
#: What is assumed of children before any is counted: under none, all and some.
_EDGES = ((8.0, 0.05, 0.05), (0.05, 8.0, 0.05), (1.0, 1.0, 1.0))
#: A single mark or tag tells labels apart by at most this factor, and a name by at most that one, so
#: that no count of a site's habits overrules what several nodes say together.
MARK_MOST, NAME_MOST = 6.0, 100.0


class Model:
    """Counts of labelled nodes: labels of children by their parent's label, and what nodes of a label show."""

    def __init__(self, counts: dict[str, float], smooth: float = 0.5) -> None:
        get = counts.get
        edge = [[get(f"edge:{p}:{c}", 0) + _EDGES[p][c] for c in range(3)] for p in range(3)]
        self.edge = [[max(v / sum(row), 0.002) for v in row] for row in edge]
        total = [get(f"label:{y}", 0) + 1.0 for y in range(3)]
        self.shows = {}
        for n in {k[8:] for k in counts if k.startswith("shows:")}:
            p = [(get(f"shows:{y}:{n}", 0) + smooth) / (total[y] + 2 * smooth) for y in range(3)]
            least = max(p) / (NAME_MOST if n.startswith("name=") else MARK_MOST)
            self.shows[n] = tuple(max(v, least) for v in p)

    def own(self, node: Node, found: list[str]) -> list[float]:
        """What a node shows of itself, as odds of its labels that add up to 1."""
        if "apart" in found:
            return [1.0, APART, APART]
        a = b = c = 1.0
        for f in found:
            if shows := self.shows.get(f):
                a *= shows[0]
                b *= shows[1]
                c *= shows[2]
        if node.tag is None:  # a text's marks go together, so that each counts for half
            a, b, c = a**0.5, b**0.5, 0.0
        t = a + b + c
        return [a / t, b / t, c / t]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(all content) of each node: messages from the leaves to the root, then back."""
        n = len(nodes)
        (e00, e01, e02), (e10, e11, e12), (e20, e21, e22) = self.edge
        belief = [self.own(node, found) for node, found in zip(nodes, node_features(nodes), strict=True)]
        up = [(1.0, 1.0, 1.0)] * n  # message of a node to its parent
        for i in range(n - 1, 0, -1):  # children come after parents; a node's belief holds its subtree's by then
            a, b, c = belief[i]
            m0, m1, m2 = e00 * a + e01 * b + e02 * c, e10 * a + e11 * b + e12 * c, e20 * a + e21 * b + e22 * c
            s = m0 + m1 + m2
            up[i] = m0, m1, m2 = m0 / s, m1 / s, m2 / s
            p = belief[nodes[i].parent]
            p[0] *= m0
            p[1] *= m1
            p[2] *= m2
            if (t := p[0] + p[1] + p[2]) < 1e-100:
                p[0], p[1], p[2] = p[0] / t, p[1] / t, p[2] / t
        out = [0.0] * n
        for i in range(n):
            a, b, c = belief[i]
            if i:
                p, m = belief[nodes[i].parent], up[i]
                d0, d1, d2 = p[0] / m[0], p[1] / m[1], p[2] / m[2]  # the parent without this child
                a *= d0 * e00 + d1 * e10 + d2 * e20
                b *= d0 * e01 + d1 * e11 + d2 * e21
                c *= d0 * e02 + d1 * e12 + d2 * e22
            s = a + b + c
            belief[i] = [a / s, b / s, c / s] if s > 0 else [1 / 3] * 3
            out[i] = belief[i][1]
        return out


def main_text(html: str | None, model: Model) -> str:
    """Blocks whose marginal of being content is above one half, outside elements that are not shown."""
    nodes = tree(html or "")
    hidden = [False] * len(nodes)
    for i, node in enumerate(nodes):
        hidden[i] = node.tag in HIDDEN_TAGS or (node.parent >= 0 and hidden[node.parent])
    return "\n\n".join(n.text for n, p, h in zip(nodes, model.marginals(nodes), hidden, strict=True) if n.tag is None and not h and p > 0.5)


def count_labels(nodes: list[Node]) -> Counter:
    """Counts for a model from a page whose text blocks have labels; elements are labelled by the text in them, empty ones as pure parents."""
    weight = [[0, 0] for _ in nodes]
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if node.tag is None:
            weight[i][node.label] += len(node.text)
        if node.parent >= 0:
            weight[node.parent][0] += weight[i][0]
            weight[node.parent][1] += weight[i][1]
    out: Counter = Counter()
    for i, (node, found) in enumerate(zip(nodes, node_features(nodes), strict=True)):
        if node.tag is not None:
            other, content = weight[i]
            node.label = SOME if other and content else ALL if content else NONE if other else nodes[node.parent].label % SOME if i else NONE
        out[f"label:{node.label}"] += 1
        if i:
            out[f"edge:{nodes[node.parent].label}:{node.label}"] += 1
        for f in found:
            out[f"shows:{node.label}:{f}"] += 1
    return out


def label_by_text(nodes: list[Node], text: str) -> None:
    """Content is a block that is a line of the page's known text, starts that text, or is a longer part of it."""
    whole = _SPACE.sub(" ", text).strip()
    lines = {_SPACE.sub(" ", x).strip() for x in text.split("\n")}
    for node in nodes:
        if node.tag is None:
            t = node.text
            node.label = int(t in lines or (len(t) >= 15 and (whole.startswith(t) or (len(t) >= 60 and t in whole))))


#: Small labelled pages, so that a model knows common names before it has seen any page: content blocks start with "+".
SEED_PAGES = [
    '<html><head><title>t</title></head><body><header class="site-header masthead banner"><div class="logo brand">-Site</div><nav class="menu navbar navigation" role="navigation"><ul><li><a href="/">-Home</a></li><li><a href="/a">-About us</a></li></ul></nav></header>'
    '<div class="cookie consent notice banner popup alert modal overlay" role="dialog"><p>-We use cookies. Accept all of them.</p></div><main id="content"><article class="post entry article"><header class="entry-header"><h1>+A title of a page</h1></header><div class="content body text entry-content"><p>+A first paragraph of some length, with a clause and an end.</p><p>+Short.</p><h2>+Part</h2><ul><li>+an item</li><li>+another item</li></ul><blockquote><p>+Words of another.</p></blockquote><table><tr><td>+cell</td><td>+cell two</td></tr></table></div>'
    '<div class="share social tools"><a href="/s">-Share</a></div></article><section class="comments comment-list" id="comments"><h3>-Comments</h3><div class="comment reply"><p>-I read this with interest and wish to add a remark of my own.</p></div></section></main><aside class="sidebar widget related recommended" role="complementary"><h3>-Related</h3><ul><li><a href="/b">-Other page</a></li></ul></aside><footer class="footer site-footer copyright" role="contentinfo"><p>-© 2020 Site. All rights reserved.</p></footer></body></html>',
    '<html><body><div id="nav" class="topnav breadcrumb breadcrumbs pagination pager"><a href="/">-Home</a> <a href="/x">-News</a></div><div class="ad ads advert advertisement sponsor sponsored promo promotion"><p>-Buy this fine thing today and save.</p></div><div id="main" class="main story"><h1>+Another title</h1><p>+Some text that is long enough to be a paragraph of an article, as most are.</p><div class="ad advert"><p>-Sponsored words in the middle.</p></div><p>+More text follows here, and it ends.</p><figure><figcaption>+A caption of a picture</figcaption></figure></div><form class="search newsletter subscribe signup login"><p>-Enter your address to subscribe.</p><label>-Name</label></form><div class="footer bottom legal disclaimer"><p>-Terms, privacy and imprint.</p></div></body></html>',
    '<html><body><nav><ul><li><a href="/1">-One</a></li><li><a href="/2">-Two</a></li></ul></nav><aside><p>-A text at the side that is not the article.</p></aside><article><h1>+Heading</h1><section><p>+Paragraph one of the article.</p><p>+Paragraph two, which is longer than the first, and says more.</p><pre>+code</pre><dl><dt>+term</dt><dd>+meaning</dd></dl></section></article><form><p>-Fill in this form.</p></form><footer>-© host · some words of the host.</footer></body></html>',
]
#: Each seed page counts as so many pages.
SEED_WEIGHT = 20.0


def seed_counts() -> Counter:
    out: Counter = Counter()
    for page in SEED_PAGES:
        nodes = tree(page)
        for node in nodes:
            if node.tag is None:
                node.label, node.text = int(node.text[0] == "+"), node.text[1:] if node.text[0] in "+-" else node.text
        out.update({k: v * SEED_WEIGHT for k, v in count_labels(nodes).items()})
    return out


def fit(labelled: DataFrame) -> Model:
    """A model from pages with known text (`html`, `text`), counted by tasks, and from the seed pages.

    The counts have one row per edge, label, tag, form and class of names that occurs: at most
    some 2 * NAME_CLASSES, whatever the pages hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for html, text in zip(batch.column(0), batch.column(1), strict=True):
                nodes = tree(html.as_py() or "")
                label_by_text(nodes, text.as_py() or "")
                if any(n.label for n in nodes):
                    total += count_labels(nodes)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["what", "n"])

    counted = labelled.select("html", "text").mapInArrow(run, "what string, n long").groupBy("what").agg(F.sum("n").alias("n"))
    counts = seed_counts()
    for row in counted.collect():
        counts[row["what"]] += row["n"]
    return Model(counts)


def labelled_pages(pages: DataFrame, documents: DataFrame, most: int = 2000) -> DataFrame:
    """Pages whose address names a document, with that document's text as label: the `most` pages of least hash."""
    number = F.regexp_extract("url", r"^[a-zA-Z]+://[^/]+/(?:[^/?#]+/)*([0-9]{1,18})", 1)
    named = pages.select("html", F.when(number != "", number).cast("long").alias("doc_id"), "page_id").where("doc_id is not null and html is not null")
    sample = named.select("page_id", "doc_id").orderBy(F.xxhash64("page_id"), "page_id").limit(most)
    sample = F.broadcast(sample.distinct())  # at most `most` rows of 16 bytes
    chosen = named.join(sample, ["page_id", "doc_id"]).select("doc_id", "html")
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample.select("doc_id").distinct()), "doc_id")
    return chosen.join(texts, "doc_id").select("html", "text")


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`text` and `n_chars` of every whole page, one row per input row, by a map without a shuffle. Null or empty html: an empty text."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), shared.value) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string"))
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
