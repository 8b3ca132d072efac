"""Main text of web pages by wrapper induction.

Pages are parsed to trees.  For each host a bounded sample of different pages is aligned with one of them by simple tree
matching.  Parts that share no text match by their shape alone, so shapes are matched once, and lists of children are aligned
a row at a time; nothing recurses, however deep a page is nested.  Text nodes that stand at matched places with the same text on most of the sample are constant: the host's
template.  All other text is in varying slots.  The region of the main text is induced from the slots: the deepest
container that stands once on a page and holds nearly all slot text of the sample.  A wrapper is this region and
the constants, both by their path of tags and classes.  Extraction parses each page once, goes to the region (and
to a marked article in it, if there is one) and drops blocks that consist of constants only, in a marked article too.  A constant heading in a region or
article stays if text of its own follows it in its section.

Word lists of tags and class names are a prior, for parts that vary from page to page but are never main text (menus,
page headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments).  They never apply to
``html``, ``body``, ``article``, ``main`` and headings, and class names count as a whole: ``share-price`` is no
``share``.  The header of an article or induced region (its title) belongs to it; other
headers do not.  A host with fewer than
``LEAST`` different pages in the sample has no wrapper: there only the prior works.

Blocks are the runs of text between block-level tags; character references are decoded, white space
inside a block becomes one space, blocks are trimmed and joined by an empty line.

Defined results: null and empty html give an empty text; a null or odd url has an empty host, whose pages are not
aligned; broken or unclosed markup is read as far as it goes; the sample of a host are the pages with the smallest
hashes, equal pages (ties) count once; a very long page is one tree, whose memory grows with it; each input row gives
one output row; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import cut, frugal

#: Pages of a host that are aligned, at most (those with the smallest hashes).
SAMPLE = 12
#: An alignment of two lists keeps a table of so many cells at most; longer lists are halved, which gives the same result.
CELLS = 1 << 22
#: Wrappers are broadcast to the pages up to so many characters in all; beyond, pages are joined salted.
BROADCAST_CHARS, SALTS = 8 << 20, 32
#: Share of the sample that must agree for a text to be constant, with at least LEAST pages; share of the slots' text
#: that the region holds.
SHARE, LEAST, MASS = 0.6, 3, 0.95
#: Wrappers that a task remembers.
KNOWN_HOSTS = 256

#: Element groups of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = RAW | frozenset("head nav header footer aside form select menu dialog title input".split())
CONTAINERS = frozenset("html body article main section div center td table tbody tr dl".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER_DROPPED = frozenset("#root html body article main h1 h2 h3 h4 h5 h6".split())
#: Names in class, id or role that mark a part as something other than main text, and words that may go with them.
NOT_MAIN = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside related recommended comment comments disqus discussion reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social toolbar widget widgets pagination pager search form hidden complementary contentinfo".split()
)
QUALIFIERS = frozenset("site page main top bottom left right side box block area section container wrapper wrap inner list item items links link bar button buttons icons posts post articles user reader global primary secondary unit slot text".split())
CLOSES_P = BLOCK - {"br", "body", "html", "head", "title", "option", "optgroup", "legend", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt", "summary", "figcaption"}
#: An element that ends an open element of the given names, within the nearest of the given scopes.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr"}),
    "th": ({"td", "th"}, {"tr"}),
    "option": ({"option"}, {"select", "optgroup"}),
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)[^<>]*>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|([^\s=/>"']+)""")
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    marks: frozenset = frozenset()  # class names, id and role that may mark a part
    step: str = ""  # tag and classes, as part of a path
    children: list = field(default_factory=list)  # Node or str


def _marks(tag: str, attributes: str) -> tuple[frozenset, str]:
    """(names of the element, its step in a path)."""
    found, classes = set(), []
    for name, value, alone in _ATTRIBUTE.findall(attributes):
        name = (name or alone).lower()
        if name in ("class", "id", "role", "itemprop"):
            names = unescape(value.strip("\"'")).lower().split()
            if name == "class":
                classes = sorted(n for n in names if not any(c.isdigit() for c in n))
            if name != "id" or tag in CONTAINERS:
                found.update(names)
        elif name == "hidden" or (name == "aria-hidden" and "true" in value.lower()):
            found.add("hidden")
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            found.add("hidden")
    return frozenset(found), ".".join([tag, *classes])


def parse(html: str) -> Node:
    """A tree of the page; end tags without a start are ignored, open elements end with their parent."""
    root = Node("#root", step="#root")
    stack, at = [root], 0

    def text(part: str) -> None:
        if part:
            stack[-1].children.append(part)

    while m := _TOKEN.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]  # the second form: a tag whose quotes do not close
        if not name:
            continue
        tag, attributes = name.lower(), m[3] or ""
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            stack[-1].children.append(Node(tag, step=tag))
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in IMPLIED:
            ended, scope = IMPLIED[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended:
                    del stack[i:]
                    break
                if stack[i].tag in scope:
                    break
        node = Node(tag, *_marks(tag, attributes))
        stack[-1].children.append(node)
        if tag not in VOID and not (attributes.rstrip().endswith("/") and tag not in BLOCK):
            stack.append(node)
    text(html[at:])
    return root


@lru_cache(maxsize=1 << 16)
def _names_other(marks: frozenset) -> bool:
    """True if a whole name, or all words of one with a qualifier, mark something other than main text."""
    for name in marks:
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if words and any(w in NOT_MAIN for w in words) and all(w in NOT_MAIN or w in QUALIFIERS for w in words):
            return True
    return False


def _is_main(node: Node, inside: bool = False) -> bool:
    """The prior; ``inside`` an article its header is main text."""
    if node.tag in NEVER_DROPPED:
        return "hidden" not in node.marks
    return (node.tag not in DROPPED or (inside and node.tag == "header")) and not _names_other(node.marks)


def _squeeze(text: str) -> str:
    return _SPACE.sub(" ", unescape(text)).strip()


# --- alignment ------------------------------------------------------------------------------------


def _kept(node: Node) -> list:
    return [c for c in node.children if not isinstance(c, str) or c.strip()]


def _post_order(root: Node) -> list[Node]:
    """All elements, children before their parents."""
    out, todo = [], [root]
    while todo:
        out.append(todo.pop())
        todo.extend(c for c in out[-1].children if not isinstance(c, str))
    return out[::-1]


class _Match:
    """Simple tree matching of two trees: an element matches one of the same tag, a text any text (better the same one), and
    the best order-keeping alignment of their children counts.

    Each part has a class: its shape (tags alone) if none of its texts is in the other tree, else its shape and texts.  The
    score of two parts follows from their classes, so each pair of classes is scored once."""

    def __init__(self, a: Node, b: Node) -> None:
        texts = [{_squeeze(c) for n in _post_order(t) for c in n.children if isinstance(c, str)} for t in (a, b)]
        self.shared, self.names, self.scores = texts[0] & texts[1], {}, {}
        self.text_of, self.class_of = {}, {}
        self.children = {id(n): _kept(n) for t in (a, b) for n in _post_order(t)}
        self.parts: list = []  # one of each class
        for tree in (a, b):
            for node in _post_order(tree):
                self.class_of[id(node)] = self._name((node.tag, *(self._class(c) for c in self.children[id(node)])), node)

    def _name(self, key: tuple, part) -> int:
        if key not in self.names:
            self.names[key] = len(self.parts)
            self.parts.append(part)
        return self.names[key]

    def _class(self, part) -> int:
        if not isinstance(part, str):
            return self.class_of[id(part)]
        if part not in self.text_of:
            text = _squeeze(part)
            self.text_of[part] = self._name(("#text", text if text in self.shared else None), part)
        return self.text_of[part]

    def _classes(self, node: Node) -> np.ndarray:
        return np.fromiter((self._class(c) for c in self.children[id(node)]), np.int64, len(self.children[id(node)]))

    def _weights(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """Scores of the distinct classes, the row and column of each child there, and pairs not scored yet."""
        ux, row = np.unique(x, return_inverse=True)
        uy, column = np.unique(y, return_inverse=True)
        table, missing = np.zeros((len(ux), len(uy)), np.int32), []
        by_tag: dict[str, list[int]] = {}
        tag = lambda c: "#text" if isinstance(self.parts[c], str) else self.parts[c].tag
        for j, c in enumerate(uy.tolist()):
            by_tag.setdefault(tag(c), []).append(j)
        for i, c in enumerate(ux.tolist()):
            for j in by_tag.get(tag(c), ()):
                d = int(uy[j])
                if isinstance(self.parts[c], str):
                    table[i, j] = 1 + (c == d and _squeeze(self.parts[c]) in self.shared)
                elif (c, d) in self.scores:
                    table[i, j] = self.scores[c, d]
                else:
                    missing.append((c, d))
        return table, row, column, missing

    def score(self, a: Node, b: Node) -> int:
        """The number of matched parts, with 1 more for each text that is the same."""
        first = (self.class_of[id(a)], self.class_of[id(b)])
        todo = [first]
        while todo:
            c, d = todo[-1]
            if (c, d) not in self.scores:
                table, row, column, missing = self._weights(self._classes(self.parts[c]), self._classes(self.parts[d]))
                if missing:
                    todo.extend(missing)
                    continue
                self.scores[c, d] = 1 + (int(_last_row(table, row, column)[-1]) if len(row) and len(column) else 0)
            todo.pop()
        return self.scores[first]

    def texts(self, a: Node, b: Node) -> list[tuple[str, str, str]]:
        """(path, text, text) of the matched texts."""
        self.score(a, b)
        found, todo = [], [(a, b, "")]
        while todo:
            x, y, path = todo.pop()
            path = f"{path}/{x.step}"
            left, right = self.children[id(x)], self.children[id(y)]
            table, row, column, missing = self._weights(self._classes(x), self._classes(y))
            assert not missing
            for i, j in _aligned(table, row, column):
                if isinstance(left[i], str):
                    found.append((path, left[i], right[j]))
                else:
                    todo.append((left[i], right[j], path))
        return found


def _last_row(table: np.ndarray, row: np.ndarray, column: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Best scores of the whole left list with each beginning of the right one; ``keep`` gets the rows before."""
    best = np.zeros(len(column) + 1, np.int32)
    for i in row.tolist():
        if keep is not None:
            keep.append(best)
        with_i = np.maximum(best[1:], best[:-1] + table[i][column])
        best = np.concatenate([[0], np.maximum.accumulate(with_i)]).astype(np.int32)
    return best


def _aligned(table: np.ndarray, row: np.ndarray, column: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of a best alignment.  Tables beyond ``CELLS`` are halved by the left list (Hirschberg)."""
    found, todo = [], [(0, len(row), 0, len(column))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        x, y = row[a:b], column[c:d]
        if b - a > 1 and (b - a) * (d - c) > CELLS:
            middle = (b - a) // 2
            rest = _last_row(table, x[middle:][::-1], y[::-1])
            cut = int((_last_row(table, x[:middle], y) + rest[::-1]).argmax())
            todo += [(a, a + middle, c, c + cut), (a + middle, b, c + cut, d)]
            continue
        rows: list[np.ndarray] = []
        rows.append(_last_row(table, x, y, rows))
        i, j = len(x), len(y)
        while i and j:
            weight = table[x[i - 1], y[j - 1]]
            if weight and rows[i][j] == rows[i - 1][j - 1] + weight:
                i, j = i - 1, j - 1
                found.append((a + i, c + j))
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return found


def tree_match(a: Node, b: Node) -> tuple[int, list[tuple[str, str, str]]]:
    """The size of the best order-keeping alignment of two trees, and its text nodes (path, text, text)."""
    match = _Match(a, b)
    return match.score(a, b), match.texts(a, b)


@dataclass(frozen=True)
class Wrapper:
    """The path of the region of the main text ('' if none), and the constant texts by path."""

    region: str = ""
    constants: frozenset = frozenset()


def _slots(tree: Node, constants: set) -> tuple[dict[str, int], Counter]:
    """Characters of slot text by path of containers, inside parts that may be main text, and how often each path occurs."""
    mass: dict[str, int] = {}
    times: Counter = Counter()
    order, todo = [], [(tree, "", False, -1)]  # with the place of the parent
    while todo:
        node, above, inside, parent = todo.pop()
        path, inside = f"{above}/{node.step}", inside or node.tag in ("article", "main")
        texts = map(_squeeze, (c for c in node.children if isinstance(c, str)))
        order.append([node, path, parent, sum(len(t) for t in texts if (path, t) not in constants)])
        todo.extend((c, path, inside, len(order) - 1) for c in node.children if not isinstance(c, str) and _is_main(c, inside))
    for node, path, parent, total in reversed(order):
        if parent >= 0:
            order[parent][3] += total
        if node.tag in CONTAINERS or node.tag == "#root":
            mass[path] = mass.get(path, 0) + total
            times[path] += 1
    return mass, times


def induce(pages: list[str]) -> Wrapper:
    """The wrapper of a host from some of its pages."""
    pages = list(dict.fromkeys(pages))
    if len(pages) < LEAST:
        return Wrapper()
    trees = [parse(p) for p in pages]
    same: Counter = Counter()
    for other in trees[1:]:
        matched = tree_match(trees[0], other)[1]
        same.update({(path, _squeeze(x)) for path, x, y in matched if _squeeze(x) == _squeeze(y)})
    need = max(LEAST - 1, SHARE * (len(trees) - 1))
    constants = {key for key, n in same.items() if n >= need and key[1]}
    mass: Counter = Counter()
    most, on = Counter(), Counter()
    for tree in trees:
        own, times = _slots(tree, constants)
        mass.update(own)
        on.update(times.keys())
        for path, n in times.items():
            most[path] = max(most[path], n)
    region, total = "", mass["/#root"]
    fit = [p for p in mass if p != "/#root" and most[p] == 1 and on[p] >= SHARE * len(trees) and total and mass[p] >= MASS * total]
    for path in sorted(fit, key=lambda p: (p.count("/"), p)):
        if not region or path.startswith(region + "/"):
            region = path
    return Wrapper(region, frozenset(constants))


# --- extraction -----------------------------------------------------------------------------------


def _find(node: Node, wanted: str) -> list[tuple[Node, str]]:
    """(element, path above it) at a path, inside parts that may be main text."""
    found, todo = [], [(node, "")]
    while todo:
        here, above = todo.pop()
        path = f"{above}/{here.step}"
        if path == wanted:
            found.append((here, above))
        elif wanted.startswith(path + "/"):
            todo.extend((c, path) for c in reversed(here.children) if not isinstance(c, str))
    return found


def _articles(node: Node, above: str) -> list[tuple[Node, str]]:
    """Outermost article elements (or else main elements) outside parts that are never main text."""
    for wanted in ("article", "main"):
        found, todo = [], [(node, above)]
        while todo:
            here, path = todo.pop()
            if here.tag == wanted or (wanted == "main" and "articlebody" in here.marks):
                found.append((here, path))
                continue
            path = f"{path}/{here.step}"
            todo.extend((c, path) for c in reversed(here.children) if not isinstance(c, str) and _is_main(c))
        if found:
            return found
    return []


def _blocks(node: Node, above: str, constants: frozenset, out: list[list]) -> None:
    """Adds the blocks of a part: each [text pieces, whether any of them is a slot, level of a heading or 0]."""
    todo: list = [(node, above, node.tag not in ("#root", "html", "body"), 0)]  # an induced region is an article
    while todo:
        here, path, inside, level = todo.pop()
        if here is None:
            out.append([[], False, level])
        elif isinstance(here, str):
            out[-1][0].append(here)
            text = _squeeze(here)
            out[-1][1] |= bool(text) and (path, text) not in constants
        elif here is node or _is_main(here, inside):
            inside = inside or here.tag in ("article", "main")
            if here.tag in BLOCK or here is node:
                todo.append((None, "", False, level))
                level = int(here.tag[1]) if inside and here.tag in HEADINGS else level
                out.append([[], False, level])
            path = f"{path}/{here.step}"
            todo.extend((c, path, inside, level) for c in reversed(here.children))


def _stay(blocks: list[list]) -> list[bool]:
    """Blocks with text of their own, and headings whose section has such a block."""
    stay, follows, least = [False] * len(blocks), False, 7
    for i in range(len(blocks) - 1, -1, -1):
        pieces, slot, level = blocks[i]
        if level:
            stay[i] = slot or (follows and level < least)
            least = min(least, level) if _squeeze("".join(pieces)) else least
        else:
            stay[i] = slot
            follows, least = (True, 7) if slot else (follows, least)
    return stay


def main_text(html: str, wrapper: Wrapper = Wrapper()) -> str:
    root = parse(html)
    region = _find(root, wrapper.region) if wrapper.region else []
    parts = [x for part, above in region for x in _articles(part, above) or [(part, above)]] or _articles(root, "") or [(root, "")]
    blocks: list[list] = [[[], False, 0]]
    for part, above in parts:
        _blocks(part, above, wrapper.constants, blocks)
    texts = (_squeeze("".join(block[0])) for block, stays in zip(blocks, _stay(blocks), strict=True) if stays)
    return "\n\n".join(t for t in texts if t)


def _host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, region, constants) of every host with enough pages.  Only so many pages of a host leave a task."""
    rows = pages.select(_host(url_col).alias("host"), F.xxhash64(html_col).alias("pick"), F.col(html_col).cast("string").alias("html"))
    rows = rows.where((F.col("host") != "") & F.col("html").isNotNull())
    # equal pages count once: hashes are chosen first, then one page of each
    rank = F.row_number().over(Window.partitionBy("host").orderBy("pick"))
    chosen = rows.select("host", "pick").distinct().withColumn("rank", rank).where(F.col("rank") <= SAMPLE)
    sample = rows.join(chosen, ["host", "pick"]).groupBy("host", "pick", "rank").agg(F.min("html").alias("html"))
    kind = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))

    def run(table: pa.Table) -> pa.Table:
        frugal()
        found = induce(table.sort_by("rank")["html"].to_pylist())
        constants = [{"path": path, "text": text} for path, text in sorted(found.constants)]
        return pa.table({"host": table["host"][:1], "region": pa.array([found.region]), "constants": pa.array([constants], kind)})

    found = sample.groupBy("host").applyInArrow(run, "host string, region string, constants array<struct<path:string,text:string>>")
    return found.where((F.size("constants") > 0) | (F.col("region") != ""))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The id, url and main text of every page."""
    found = cut(wrappers(pages, url_col, html_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), _host(url_col).alias("page_host"))
    chars = F.aggregate("constants", F.lit(100).cast("bigint"), lambda n, c: n + F.length(c["path"]) + F.length(c["text"]))
    if (found.agg(F.sum(chars)).first()[0] or 0) <= BROADCAST_CHARS:
        joined = rows.join(F.broadcast(found), F.col("page_host") == F.col("host"), "left")
    else:  # a host with many pages is spread over SALTS keys
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = rows.withColumn("own_salt", F.pmod(F.xxhash64("url", "html"), F.lit(SALTS)).cast("int"))
        joined = own.join(salted, (F.col("page_host") == F.col("host")) & (F.col("own_salt") == F.col("salt")), "left")
    joined = joined.select("id", "url", "html", "host", "region", "constants")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        known: dict = {None: Wrapper()}
        for batch in batches:
            hosts, texts = batch.column(3).to_pylist(), []
            for i, (html, host) in enumerate(zip(batch.column(2).to_pylist(), hosts, strict=True)):
                if host not in known:
                    if len(known) > KNOWN_HOSTS:
                        known = {None: Wrapper()}
                    known[host] = Wrapper(batch.column(4)[i].as_py(), frozenset((c["path"], c["text"]) for c in batch.column(5)[i].as_py()))
                texts.append(main_text(html or "", known[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    id_type, url_type = (joined.schema[c].dataType.simpleString() for c in ("id", "url"))
    return joined.mapInArrow(run, f"id {id_type}, url {url_type}, text string").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def extraction_report(pages: DataFrame) -> DataFrame:
    """Text and length of every page, as the query returns them."""
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))
