"""Main text of web pages by wrapper induction.

Pages of one host are aligned with the host's reference page (its smallest
page id) by simple tree matching: the largest order-preserving mapping of
nodes with equal tag and class below equal parents. Over all pages of the
host, a reference node whose text is the same on CONSTANT of the differing
pages is template; the others are slots whose text varies. The wrapper of
a host is its set of template nodes.

The main text of a page is made of its blocks in page order, minus
- elements that never are content: scripts, styles, forms, navigation,
  asides, page headers and footers, and elements whose class, id or role
  says advert, menu, side bar, notice, sharing, related links or comments;
- blocks aligned with template nodes of the host's wrapper.
Where the page marks its article (article, main, role=main), only that
part counts.

A class or id word counts only if it names the element: words after has-,
no- or with- and names of layouts say what stands inside or beside it.
Words never exclude an element around main, nor around the page's
articles (those below the fewest marked elements; a nested article that
calls itself a comment is none). Inside an article the id of a heading is
the slug of its title and says nothing; that of a section counts only if
it is made of such words alone ("comments", not "social-history").

Parsing follows the usual recovery rules in short form: void elements,
implied ends of paragraphs, list and table parts, raw text of scripts and
styles, character references without semicolon, unclosed tags closed by
their parent's end.

Scale: the reference joins its host's pages as a skew-split join, so one
host may hold a third of all pages; what is gathered is one count per
(host, reference node, text), pre-aggregated. Alignment state is per page.

Defined cases: null or empty html gives an empty text; a host with fewer
than MIN_PAGES differing pages has no template; pages without host (null
or odd url) share the empty host; rows that share a page id are judged one
by one; repeated pages count once for the template; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
import sys
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stage

CONSTANT = 0.9          # share of differing pages that makes a node template
MIN_PAGES = 10          # differing pages that a template needs
REFS_CHARS = 1 << 20    # html characters of the parsed references that a task keeps

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Names of HTML (fixed values)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("body html caption td th tr tbody thead tfoot option optgroup legend".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"),
          "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",),
         "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
NEVER = frozenset(
    "head script style noscript template iframe object embed svg canvas math audio video form button input select "
    "textarea fieldset nav aside footer menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar "
                  "toolbar form".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus footer gdpr menu modal nav navbar navigation newsletter notice notices overlay "
    "pager pagination popup promo promoted promotion related respond reply replies sharing share sidebar sidebars "
    "signup skip social sponsor sponsored subscribe subscription toc toolbar widget widgets".split())
_HEADS = frozenset("header masthead topbar sitehead siteheader".split())
_BESIDE = frozenset("has have no non not with without".split())     # the words after them do not name the element
_TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_GAP = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "mark", "ident", "children", "parent", "texts", "role", "shape", "size")

    def __init__(self, tag, parent, mark="", role="", ident=""):
        self.tag, self.parent, self.mark, self.role, self.ident = tag, parent, mark, role, ident
        self.children, self.texts = [], []      # texts: (children before it, text)
        self.shape, self.size = None, 1


def parse(source: str) -> Node:
    """Element tree of a page; the root has tag ''."""
    root = cur = Node("", None)
    at, n = 0, len(source)

    def text(s):
        if s:
            cur.texts.append((len(cur.children), s))

    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            text(_html.unescape(source[at:]))
            break
        if m.start() > at:
            text(_html.unescape(source[at:m.start()]))
        at = m.end()
        if m.group("cdata") is not None:
            text(m.group("cdata"))
            continue
        tag = m.group("tag")
        if tag is None:
            continue
        tag = tag.lower()
        if m.group("end"):
            up = cur
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                cur = up.parent
            continue
        mark = role = ident = ""
        if m.group("attrs"):
            got = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(m.group("attrs"))}
            mark, ident = (got.get("class") or "").strip(), (got.get("id") or "").strip()
            role = (got.get("role") or "").lower()
            if "hidden" in got:
                role = role or "alert"
        stop = CLOSES.get(tag)
        if stop:
            up, last = cur, None
            while up.parent is not None and up.tag not in SCOPE[tag]:
                if up.tag in stop:
                    last = up
                up = up.parent
            if last is not None:
                cur = last.parent
        if tag in ENDS_P:
            up = cur
            while up.parent is not None and up.tag != "p" and up.tag not in BLOCK:
                up = up.parent
            if up.tag == "p":
                cur = up.parent
        node = Node(tag, cur, mark, role, ident)
        cur.children.append(node)
        if tag in RAW and not m.group("attrs").endswith("/"):
            close = re.compile(r"</" + re.escape(tag) + r"\s*>", re.I).search(source, at)
            stop_at = close.start() if close else n
            node.texts.append((0, source[at:stop_at]))
            at = close.end() if close else n
        elif tag not in VOID and not (m.group("attrs") or "").endswith("/"):
            cur = node
        elif tag not in VOID and tag not in ("svg", "path", "g"):
            cur = node          # "<div/>" opens a div
    return root


def nodes(root: Node) -> list[Node]:
    """Document order; also sets each node's shape (class of equal
    subtrees by tag and class) and size, bottom up."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(reversed(x.children))
    for x in reversed(out):
        x.shape = hash((x.tag, x.mark, tuple(c.shape for c in x.children)))
        x.size = 1 + sum(c.size for c in x.children)
    return out


def _depth(root: Node) -> int:
    deepest, todo = 0, [(root, 1)]
    while todo:
        x, d = todo.pop()
        deepest = max(deepest, d)
        todo.extend((c, d + 1) for c in x.children)
    return deepest


def match_trees(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching of two trees with equal roots: the pairs of the
    largest mapping that keeps order and parents."""
    weight: dict = {}

    def same(x, y):
        return x.tag == y.tag and x.mark == y.mark

    def table(x, y):
        """Choices of the children's alignment and its weight (row by row;
        up = skip x's child, left = skip y's)."""
        rows, prev = [], np.zeros(len(y.children) + 1, dtype=np.int64)
        for c in x.children:
            w = np.array([value(c, d) for d in y.children], dtype=np.int64)
            take = prev[:-1] + w
            best = np.maximum(prev[1:], take)
            row = np.concatenate([[0], np.maximum.accumulate(best)]) if len(w) else prev
            rows.append((np.packbits((w > 0) & (take == row[1:])), np.packbits(row[1:] == prev[1:])))
            prev = row
        return rows, int(prev[-1])

    def value(x, y):
        if not same(x, y):
            return 0
        if x.shape == y.shape:
            return x.size
        key = (x.shape, y.shape)
        got = weight.get(key)
        if got is None:
            got = weight[key] = 1 + (table(x, y)[1] if x.children and y.children else 0)
        return got

    deep = min(_depth(a), _depth(b))        # value and table call each other once a level
    if 3 * deep + 500 > sys.getrecursionlimit():
        sys.setrecursionlimit(3 * deep + 500)
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        if x.shape == y.shape:
            todo.extend(zip(x.children, y.children))
            continue
        if not (x.children and y.children):
            continue
        rows, _ = table(x, y)
        i, j = len(x.children), len(y.children)
        while i and j:
            take, up = rows[i - 1]
            bit, mask = (j - 1) >> 3, 128 >> ((j - 1) & 7)
            if take[bit] & mask:
                todo.append((x.children[i - 1], y.children[j - 1]))
                i, j = i - 1, j - 1
            elif up[bit] & mask:
                i -= 1
            else:
                j -= 1
    return pairs


@lru_cache(1 << 14)
def _names(value: str) -> frozenset:
    """The words of a class or id that name the element."""
    out = set()
    for token in value.split():
        words = [p.lower() for p in _PART.findall(token)]
        if "layout" in words:
            continue
        for w in words:
            if w in _BESIDE:
                break
            out.add(w)
    return frozenset(out)


def _never(x: Node, inside: bool) -> bool:
    """Whether tag or role say that an element never is content; ``inside``
    an article, a header may hold its title."""
    return x.tag in NEVER or x.role in ROLES or (x.tag == "header" and not inside)


def _marked(x: Node, inside: bool) -> bool:
    """Whether class or id name an element that never is content."""
    if not (x.mark or x.ident) or x.tag in ("html", "body", "article", "main"):
        return False
    words = _names(x.mark)
    if x.ident:
        own = _names(x.ident)
        if inside and (x.tag in _TITLES or x.parent.tag in _TITLES):
            own = frozenset()
        elif inside and (x.tag == "section" or "section" in words) and not own <= MARKS:
            own = frozenset()
        words = words | own
    return not words.isdisjoint(MARKS) or (not inside and not words.isdisjoint(_HEADS))


def _article(all_nodes: list[Node]) -> tuple[list[Node], set]:
    """Outermost article / main elements that are not inside excluded ones,
    and the ids of the marked elements that stay as they hold them."""
    def is_main(x):
        return x.tag == "main" or x.role == "main"

    def is_article(x):
        return x.tag == "article" or x.role == "article"
    if not any(is_main(x) or is_article(x) for x in all_nodes):
        return [], set()
    dead, marked, inner = set(), set(), set()
    for x in all_nodes:
        p = x.parent
        if p is None or x.tag in ("html", "body", "head"):
            continue
        if id(p) in inner or is_main(x) or is_article(x):
            inner.add(id(x))
        if id(p) in dead or _never(x, id(p) in inner):
            dead.add(id(x))
        elif not is_main(x) and _marked(x, id(p) in inner):
            marked.add(id(x))
    kept: set = set()

    def keep(x):
        x = x.parent
        while x is not None:
            if id(x) in marked:
                kept.add(id(x))
            x = x.parent
    for x in all_nodes:
        if is_main(x) and id(x) not in dead:
            keep(x)
    # the page's articles are those below the fewest marked elements
    above = {}
    for x in all_nodes:
        above[id(x)] = above.get(id(x.parent), 0) + (id(x) in marked and id(x) not in kept)
    articles = [x for x in all_nodes if is_article(x) and id(x) not in dead and _names(x.mark).isdisjoint(MARKS)]
    least = min((above[id(x)] for x in articles), default=0)
    if least:
        for x in articles:
            if above[id(x)] == least:
                keep(x)
    found, skip = [], set()
    for x in all_nodes:
        if x.parent is not None and id(x.parent) in skip:
            skip.add(id(x))
        elif id(x) in dead or (id(x) in marked and id(x) not in kept):
            skip.add(id(x))
        elif is_main(x) or is_article(x):
            found.append(x)
            skip.add(id(x))
    mains = [x for x in found if is_main(x)]
    return mains or found, kept


def _tidy(s: str) -> str:
    return _GAP.sub(" ", s).strip()


def blocks(root: Node, template: set | None = None) -> list[tuple[Node, str]]:
    """(element, text) of the content blocks in page order; text between
    block elements belongs to the nearest block around it. ``template``:
    ids of nodes to leave out."""
    everything = nodes(root)
    tops, kept = _article(everything)
    inside = bool(tops)
    out: list = []
    run: list[str] = []
    owner = [root]

    def flush():
        s = _tidy("".join(run))
        run.clear()
        if s and not (template and id(owner[0]) in template):
            out.append((owner[0], s))

    def walk(top):
        # explicit stack: (node, next child, next text)
        stack = [[top, 0, 0]]
        enter(top)
        while stack:
            x, c, t = stack[-1]
            if t < len(x.texts) and x.texts[t][0] <= c:
                run.append(x.texts[t][1])
                stack[-1][2] += 1
            elif c < len(x.children):
                stack[-1][1] += 1
                child = x.children[c]
                if child.tag in ("br", "hr"):
                    run.append(" ")
                    if child.tag == "hr":
                        flush()
                    continue
                if _never(child, inside) or child.tag in RAW or (id(child) not in kept and _marked(child, inside)):
                    if child.tag in BLOCK:
                        flush()
                    continue
                if child.tag in VOID:
                    continue
                enter(child)
                stack.append([child, 0, 0])
            else:
                stack.pop()
                if x.tag in BLOCK or x is top:
                    flush()
                    owner[0] = next_block(x.parent) or root

    def next_block(x):
        while x is not None and x.tag not in BLOCK:
            x = x.parent
        return x

    def enter(x):
        if x.tag in BLOCK:
            flush()
            owner[0] = x

    for top in tops or [root]:
        walk(top)
    flush()
    return out


def _digest(s: str) -> str:
    return hashlib.blake2b(s.encode("utf-8"), digest_size=8).hexdigest()


class _References:
    """Parsed reference pages, those used last, up to REFS_CHARS of html."""

    def __init__(self):
        self.kept: dict = {}        # oldest use first
        self.chars = 0

    def get(self, source: str):
        got = self.kept.pop(source, None)
        if got is None:
            root = parse(source)
            got = (root, {id(x): i for i, x in enumerate(nodes(root))})
            self.chars += len(source)
            while self.kept and self.chars > REFS_CHARS:
                oldest = next(iter(self.kept))
                del self.kept[oldest]
                self.chars -= len(oldest)
        self.kept[source] = got
        return got


def _aligned(page: Node, ref: Node) -> dict:
    """id of a page node -> reference node."""
    return {id(x): y for x, y in match_trees(page, ref)}


def _slot_batches(batches):
    import pyarrow as pa

    refs = _References()
    for batch in batches:
        host, content, place, text = [], [], [], []
        for h, page, ref in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if not page or not ref:
                continue
            root = parse(page)
            got = blocks(root)
            ref_root, number = refs.get(ref)
            to = _aligned(root, ref_root)
            whole = _digest("\n".join(s for _, s in got))
            for x, s in got:
                y = to.get(id(x))
                if y is not None:
                    host.append(h)
                    content.append(whole)
                    place.append(number[id(y)])
                    text.append(_digest(s))
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(content, pa.string()),
                                          pa.array(place, pa.int32()), pa.array(text, pa.string())],
                                         names=["host", "content", "node", "text"])


def _text_batches(batches):
    import pyarrow as pa

    refs = _References()
    for batch in batches:
        out = []
        for page, ref, constant in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5))):
            if not page:
                out.append("")
                continue
            root = parse(page)
            if not constant or not ref:
                got = blocks(root)
            else:
                nodes(root)
                ref_root, number = refs.get(ref)
                known = set(constant)
                to = _aligned(root, ref_root)
                template = {x for x, y in to.items() if number[id(y)] in known}
                got = blocks(root, template)
            out.append("\n\n".join(s for _, s in got))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2),
                                          pa.array(out, pa.string())], names=["page_id", "url", "host", "text"])


def wrappers(pages: DataFrame, constant: float = CONSTANT, least: int = MIN_PAGES) -> DataFrame:
    """(host, ref, nodes): the reference page and the numbers (document
    order) of its template nodes, one row per host. ``pages``: host,
    page_id, html."""
    refs = pages.where("html <> ''").groupBy("host").agg(F.min(F.struct("page_id", "html"))["html"].alias("ref"))
    refs = stage(refs)
    slots = pages.join(refs, "host").select("host", "html", "ref").mapInArrow(
        _slot_batches, "host string, content string, node int, text string")
    per = slots.groupBy("host", "node", "content").agg(F.min("text").alias("text")) \
        .groupBy("host", "node", "text").agg(F.count("*").alias("same"))
    top = per.groupBy("host", "node").agg(F.max("same").alias("same"), F.sum("same").alias("pages")) \
        .where(f"pages >= {least} AND same >= {constant} * pages")
    return refs.join(top.groupBy("host").agg(F.collect_list("node").alias("nodes")), "host", "left")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            constant: float = CONSTANT, least: int = MIN_PAGES) -> DataFrame:
    """Per row of ``pages``: ``id_col``, ``url_col``, ``host``, ``text``."""
    prepare(pages.sparkSession)
    url = F.col(url_col)
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1),
                              F.lit("")))
    base = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host.alias("host"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    found = stage(wrappers(base, constant, least))
    out = base.join(found, "host", "left").select("page_id", "url", "host", "html", "ref", "nodes")
    kind = pages.schema[id_col].dataType.simpleString()
    return out.mapInArrow(_text_batches, f"page_id {kind}, url string, host string, text string") \
        .withColumnRenamed("page_id", id_col).withColumnRenamed("url", url_col)
