"""Operator 8: main text of web pages by wrapper induction.

Pages of one host are cut into groups; in each group every page's tree of
blocks is aligned with the group's first two pages by simple tree matching.
Below two aligned nodes, a text that both have under the same path of labels
(tag, class, id) is constant, whatever stands beside it; any other varies.  The
evidence is summed by host.  A text that is constant wherever its node is
aligned is template, that very text and no other one of the path; all else
stays, so a heading that differs on one page is kept there.  Blocks whose text
is mostly constant, with a little that varies, are template as well.  Pages
with equal content count once, and pages that are nearly the same as the first
ones are no evidence, so copies do not look like template.

A page's text is what varies within its ``article`` and ``main`` elements, if
the host's varying text lies there or most of the page's; else all that varies.

Menus, headers, footers, sidebars, notices, adverts, forms and comments often
vary from page to page as content does; their elements are known by tag, role or
class and are no slots.

Alignment is exact where it costs at most ``CELLS`` cells of tables a page;
beyond that, children are paired greedily in order, so very long lists and very
deep trees take about linear time.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, small_batches, staged

#: Pages of a host that are aligned with one another.
GROUP_PAGES = 64
#: Cells of the tables of one alignment.
CELLS = 200_000
#: Template: aligned at least so often, with the same text in such a share.
LEAST_ALIGNED, SAME_SHARE = 3, 0.9
#: Pages of which more text is the same are copies of one another, not pages of one template.
COPY_SHARE = 0.8
#: Blocks with less of a host's varying text than this, and at least half as much constant text, are template;
#: articles with less of it than this are no articles.
MINOR_SHARE, ARTICLE_SHARE = 0.05, 0.2
GROUP_BYTES = 2_000_000
#: Wrappers up to this many bytes are broadcast; more are joined.
BROADCAST_BYTES = 16_000_000

# Element names of the HTML standard, and words that name parts of pages.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCKS - {"option", "button", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "select", "head", "title", "body", "html"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "audio", "video", "title", "noframes", "xmp")
CLOSERS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
FENCES = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "body": ("html",)}
BOILER_TAGS = frozenset("nav header footer aside form button select option dialog menu head title fieldset search".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form note status".split())
BOILER_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored promo promos promoted promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager "
    "header masthead topbar footer foot sidebar side aside widget widgets related recommended recommendations teaser teasers comment comments commentlist disqus replies reply respond discussion "
    "notice notices cookie cookies consent gdpr alert alerts popup modal overlay newsletter subscribe subscription signup login register search searchbox share sharing social copyright legal disclaimer skip outbrain taboola toolbar form".split()
)
#: Words that name a part even beside words of layout, as in ``comments-area``; and these words.
PART_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promos breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr menu menus modal nav navbar navigation newsletter pager pagination popup rail recommended recommendations related share sharing sidebar social subscribe taboola outbrain".split())
LAYOUT_WORDS = frozenset("area bar block bottom box button buttons column container group holder icons inner item items left link links list module page post posts reader right row section site slot stories story tools top unit user users widget wrap wrapper zone".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"))
TEXT_TAGS = HEADINGS | frozenset("p li blockquote pre dd dt td th figcaption".split())

TAG = re.compile(r"<(?:!--.*?(?:-->|$)|![^>]*(?:>|$)|\?[^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|$))", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("boiler", "inner", "label", "main", "parent", "path", "strict", "tag")

    def __init__(self, tag: str, label: str, parent: int, path: int, boiler: bool, main: bool, inner: bool = False, strict: bool = False):
        self.tag, self.label, self.parent, self.path, self.boiler, self.main = tag, label, parent, path, boiler, main
        self.inner, self.strict = inner, strict  # boiler whatever the names around the article say; boiler by more than names


@lru_cache(100_000)
def _path(parent: int, label: str) -> int:
    """A 63-bit number for a path of labels."""
    return int.from_bytes(hashlib.blake2b(f"{parent}/{label}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


def _names_a_part(token: str) -> bool:
    """Whether a whole class or id is made of listed words (and numbers).

    ``cookie-notice`` and ``ad-1`` are, and ``comments-area`` with a word of
    layout; any other word, as in ``has-sidebar`` or ``entry-header``, makes it
    the name of another thing.
    """
    words = WORDS.findall(token)
    if not words or not all(w in BOILER_WORDS or w in LAYOUT_WORDS or w in PART_WORDS for w in words):
        return False
    return all(w in BOILER_WORDS or w in PART_WORDS for w in words) or any(w in PART_WORDS for w in words)


@lru_cache(20_000)
def _label(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Label of an element, whether it is a part that holds no main text, and whether only a name says so."""
    found = {k.lower(): (a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    label = " ".join([tag, *sorted({re.sub(r"\d+", "#", x) for x in names.split()})])
    strict = (
        tag in BOILER_TAGS or found.get("role", "").lower() in BOILER_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(found.get("style", "")))
    )
    named = tag not in ("body", "html", "article", "main") and any(_names_a_part(x) for x in names.split())
    return label, strict or named, named and not strict


@lru_cache(50)
def _raw_end(tag: str):
    return re.compile(rf"</{tag}(?=[\s/>]|$)[^>]*>?", re.I)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str, int]]]:
    """Blocks of a page: its block elements, and (element, text, link chars) runs.

    Inline elements are transparent; a run of inline content between block
    tags is one text.  Unclosed and cut elements end where the page ends.
    """
    nodes = [Node("", "", -1, 0, False, False)]
    texts: list[tuple[int, str, int]] = []
    stack, run, link_chars, links = [0], [], 0, 0
    at, n = 0, len(page)

    def flush():
        nonlocal link_chars
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                texts.append((stack[-1], text, link_chars))
            run.clear()
        link_chars = 0

    def close(tags: tuple[str, ...], fences: tuple[str, ...] = ()):
        """Close the innermost open element of these, unless a fence is nearer."""
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in tags:
                flush()
                del stack[k:]
                return
            if tag in fences:
                return

    while at < n:
        found = TAG.search(page, at)
        if not found:
            run.append(page[at:])
            break
        if found.start() > at:
            piece = page[at : found.start()]
            run.append(piece)
            if links:
                link_chars += len(piece)
        at = found.end()
        closing, tag, attributes, end = found.group(1), found.group(2), found.group(3), found.group(4)
        if tag is None or not end:  # a comment, a declaration, or a tag cut by the end
            continue
        tag = tag.lower()
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                close((tag,))
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/") or tag not in ("svg", "math"):
                until = _raw_end(tag).search(page, at)
                at = until.end() if until else n
            continue
        if tag == "a":
            links += 1
        elif tag in ("br", "img", "input"):
            run.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if tag in CLOSES_P:
            close(("p",), ("td", "th", "button", "table", "caption"))
        if tag in CLOSERS:
            close(CLOSERS[tag], FENCES[tag])
        if tag in HEADINGS and nodes[stack[-1]].tag in HEADINGS:
            stack.pop()
        flush()
        if tag in VOID:
            continue
        label, boiler, named = _label(tag, attributes)
        parent = nodes[stack[-1]]
        if tag == "header" and parent.main and not parent.boiler:  # an article's own head: its title counts
            boiler = False
        main = parent.main or tag in ("article", "main") or 'role="main"' in attributes or 'itemprop="articleBody"' in attributes
        above = parent.strict if tag == "main" else parent.boiler  # a name does not veto the page's main element
        inner = parent.strict if tag in ("article", "main") else parent.inner
        nodes.append(Node(tag, label, stack[-1], _path(parent.path, label), above or boiler, main, inner or boiler, parent.strict or (boiler and not named)))
        stack.append(len(nodes) - 1)
    flush()
    return nodes, texts


def _inside_head(nodes: list[Node], x: int) -> bool:
    """Within an article's header but not within a heading of it."""
    heading = False
    while x > 0:
        heading |= nodes[x].tag in HEADINGS
        if nodes[x].tag == "header":
            return not heading
        x = nodes[x].parent
    return False


def slots(nodes: list[Node], texts: list[tuple[int, str, int]]) -> list[tuple[int, str]]:
    """Texts that may be main text, whatever the host's wrapper says.

    Runs that are mostly links are none, but for those of an article.  Where
    class names leave nothing of a page, they do not count around an article.
    """
    linked = lambda x, t, links: links * 2 > len(t) and not nodes[x].main and nodes[x].tag not in TEXT_TAGS
    able = [(x, t) for x, t, links in texts if not nodes[x].boiler and not linked(x, t, links) and not _inside_head(nodes, x)]
    return able or [(x, t) for x, t, links in texts if nodes[x].main and not nodes[x].inner and not _inside_head(nodes, x)]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


def text_key(path: int, text: int) -> int:
    """A 63-bit number for a text under a path."""
    return (path * 0x9E3779B97F4A7C15 + text * 0xD6E8FEB86659FD93) % (1 << 63)


def own_texts(able: list[tuple[int, str]]) -> dict[int, str]:
    """The text of each node that has one."""
    own: dict[int, list[str]] = {}
    for x, t in able:
        own.setdefault(x, []).append(t)
    return {x: "\n".join(t) for x, t in own.items()}


def extract(page: str | None, constants: frozenset[int] = frozenset(), minor: frozenset[int] = frozenset(), in_article: bool | None = None) -> str:
    """Main text of a page: its blocks in order, one line each.

    ``constants`` are ``text_key`` of template, ``minor`` paths of blocks that
    are template, ``in_article`` tells whether the host's text is in articles.
    """
    if not page:
        return ""
    nodes, texts = parse(page)
    able = slots(nodes, texts)
    template = {x for x, t in own_texts(able).items() if constants and text_key(nodes[x].path, _hash(t)) in constants}
    varying = [(x, t) for x, t in able if x not in template]
    size = lambda rows: sum(len(t) for _, t in rows)
    inside = [(x, t) for x, t in varying if nodes[x].main] or [(x, t) for x, t in able if nodes[x].main]
    if inside and (in_article is not False or 2 * size(inside) >= size(varying)):
        return "\n".join(t for _, t in inside)
    kept = [(x, t) for x, t in varying if nodes[x].parent < 0 or nodes[nodes[x].parent].path not in minor]
    return "\n".join(t for _, t in kept or varying)


class Skeleton:
    """A page's tree of blocks, parents first: children, paths, own text.

    ``shapes`` are equal for subtrees of equal paths; a subtree is the run of
    nodes from its root to before ``ends`` of it.
    """

    __slots__ = ("children", "ends", "mains", "parents", "paths", "shapes", "sizes", "texts")

    def __init__(self, parents, paths, texts, sizes, mains=None):
        self.parents, self.paths, self.texts, self.sizes, self.mains = parents, paths, texts, sizes, mains or [0] * len(parents)
        n = len(parents)
        self.children: list[list[int]] = [[] for _ in parents]
        for x, p in enumerate(parents):
            if p >= 0:
                self.children[p].append(x)
        self.ends, self.shapes = [0] * n, [0] * n
        for x in range(n - 1, -1, -1):
            own = self.children[x]
            self.ends[x] = self.ends[own[-1]] if own else x + 1
            self.shapes[x] = hash((paths[x], *(self.shapes[c] for c in own)))


def _pair_children(a: Skeleton, b: Skeleton, x: int, y: int, size, most: int) -> tuple[list[tuple[int, int]], int]:
    """Children of two matched nodes that match, in order; and the cells that took.

    ``size(u, v)`` is how many nodes match below and at a pair.  Children of
    equal shape at either end match without a table.
    """
    left, right = a.children[x], b.children[y]
    i, j, m, n = 0, 0, len(left), len(right)
    pairs, tail = [], []
    while i < m and j < n and a.shapes[left[i]] == b.shapes[right[j]]:
        pairs.append((left[i], right[j]))
        i, j = i + 1, j + 1
    while i < m and j < n and a.shapes[left[m - 1]] == b.shapes[right[n - 1]]:
        m, n = m - 1, n - 1
        tail.append((left[m], right[n]))
    left, right = left[i:m], right[j:n]
    cells = len(left) * len(right)
    if cells > most:  # the next child of the same path
        places: dict[int, list[int]] = {}
        for k, v in enumerate(right):
            places.setdefault(b.paths[v], []).append(k)
        at = 0
        for u in left:
            able = places.get(a.paths[u], ())
            k = bisect_left(able, at)
            if k < len(able):
                pairs.append((u, right[able[k]]))
                at = able[k] + 1
        return pairs + tail[::-1], 0
    table = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, u in enumerate(left, 1):
        row, above = table[i], table[i - 1]
        for j, v in enumerate(right, 1):
            best = max(above[j], row[j - 1])
            row[j] = max(best, above[j - 1] + size(u, v)) if a.paths[u] == b.paths[v] else best
    middle = []
    i, j = len(left), len(right)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            middle.append((left[i], right[j]))
    return pairs + middle[::-1] + tail[::-1], cells


def tree_match(a: Skeleton, b: Skeleton) -> list[tuple[int, int]]:
    """Simple tree matching: pairs of nodes of a largest order-keeping match.

    Nodes match only if their paths are equal and their parents match.  Works
    off a list of pairs, not by recursion.
    """
    known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    cells = 0

    def simple(u: int, v: int) -> int:
        """Size of a match that needs no table; 0: it does."""
        if a.shapes[u] == b.shapes[v]:
            return a.ends[u] - u
        return 0 if a.children[u] and b.children[v] else 1

    todo = [(0, 0)] if not simple(0, 0) else []
    waiting: set[tuple[int, int]] = set()
    while todo:
        x, y = todo[-1]
        if (x, y) in known:
            todo.pop()
            continue
        if (x, y) not in waiting:  # first the pairs below it that a table may ask for
            waiting.add((x, y))
            left, right = a.children[x], b.children[y]
            if len(left) * len(right) <= CELLS - cells:
                cells += len(left) * len(right)
                todo += [(u, v) for u in left for v in right if a.paths[u] == b.paths[v] and not simple(u, v) and (u, v) not in known]
                continue
            known[x, y] = (1, _pair_children(a, b, x, y, None, -1)[0])
            todo += [(u, v) for u, v in known[x, y][1] if not simple(u, v) and (u, v) not in known]
            continue
        size = lambda u, v: simple(u, v) or known[u, v][0]
        pairs, _ = _pair_children(a, b, x, y, size, CELLS)
        known[x, y] = (1 + sum(size(u, v) for u, v in pairs), pairs)
        todo.pop()
    out, todo = [], [(0, 0)]
    while todo:
        x, y = todo.pop()
        if a.shapes[x] == b.shapes[y]:
            out += zip(range(x, a.ends[x]), range(y, b.ends[y]))
        else:
            out.append((x, y))
            if (x, y) in known:
                todo += known[x, y][1]
    return out


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


SKELETON = "host string, content long, parents array<long>, paths array<long>, texts array<long>, sizes array<long>, mains array<long>"


def skeletons(pages: DataFrame) -> DataFrame:
    """``host, content, parents, paths, texts, sizes, mains`` of pages ``host, html``; one row for equal contents of a host."""

    def run(batches):
        for batch in batches:
            for small in byte_slices(batch, "html", GROUP_BYTES):
                rows: list[tuple] = []
                for page in small.column(1).to_pylist():
                    nodes, texts = parse(page)
                    own = own_texts(slots(nodes, texts))
                    hashes = {x: _hash(t) for x, t in own.items()}
                    rows.append((
                        _hash(",".join(map(str, hashes.values()))), [x.parent for x in nodes], [x.path for x in nodes], [hashes.get(i, 0) for i in range(len(nodes))],
                        [len(own.get(i, "")) for i in range(len(nodes))], [int(x.main) for x in nodes],
                    ))
                types = [pa.int64(), *[pa.list_(pa.int64())] * 5]
                columns = zip(*rows) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([small.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types))], ["host", "content", "parents", "paths", "texts", "sizes", "mains"])

    found = pages.where("html is not null and html <> ''").select("host", "html").mapInArrow(run, SKELETON)
    return found.dropDuplicates(["host", "content"])


class Evidence:
    """Sums over the alignments of pages with one first page."""

    def __init__(self, first: Skeleton):
        self.first = first
        self.aligned, self.pairs = {}, {}
        #: Texts below each node of the first page: (node, path, text) -> pages that have them too.
        self.same = {(p, first.paths[x], t): 0 for x, (p, t) in enumerate(zip(first.parents, first.texts)) if t}
        self.times = [0] * len(first.paths)
        #: Of each parent's path: varying text, constant text, varying text in articles.
        self.blocks: dict[int, list[int]] = {}

    def add(self, page: Skeleton) -> None:
        shape = page.shapes[0]
        if shape not in self.pairs:
            self.pairs[shape] = tree_match(self.first, page)
        partner = {v: u for u, v in self.pairs[shape]}
        partner[-1] = -1
        known = [(x, (partner.get(p, -2), page.paths[x], t)) for x, (p, t) in enumerate(zip(page.parents, page.texts)) if t]
        total = sum(page.sizes)
        if sum(page.sizes[x] for x, k in known if k in self.same) > COPY_SHARE * total:
            return
        for u in partner.values():
            if u >= 0:
                self.times[u] += 1
        for k in {k for _, k in known if k in self.same}:
            self.same[k] += 1
        for x, k in known:
            parent = page.parents[x]
            sums = self.blocks.setdefault(page.paths[parent] if parent >= 0 else 0, [0, 0, 0])
            if k in self.same:
                sums[1] += page.sizes[x]
            else:
                sums[0] += page.sizes[x]
                sums[2] += page.sizes[x] * page.mains[x]

    def rows(self):
        """(0, text key, times aligned, times the same, 0) and (1, path, varying, constant, varying in articles)."""
        for (u, path, text), n in self.same.items():
            times = self.times[u] if u >= 0 else self.times[0]
            if times:
                yield 0, text_key(path, text), times, n, 0
        for path, sums in self.blocks.items():
            yield 1, path, *sums


def evidence(groups: DataFrame) -> DataFrame:
    """``host, kind, key, a, b, c``: the rows of ``Evidence`` of each group (host, salt)."""

    def run(batches):
        firsts: list[Evidence] = []
        last = None

        def closed():
            rows = [(last[0], *row) for e in firsts for row in e.rows()]
            types = [pa.string(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["host", "kind", "key", "a", "b", "c"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if row[:2] != last:
                    if last is not None:
                        yield closed()
                    last, firsts = row[:2], []
                page = Skeleton(*row[2:])
                if len(firsts) < 2:
                    for e in firsts:
                        e.add(page)
                    firsts.append(Evidence(page))
                    if len(firsts) == 2:
                        firsts[1].add(firsts[0].first)
                else:
                    for e in firsts:
                        e.add(page)
        if last is not None:
            yield closed()

    return groups.select("host", "salt", "parents", "paths", "texts", "sizes", "mains").mapInArrow(run, "host string, kind long, key long, a long, b long, c long")


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, constants, minor, in_article`` induced from pages ``host, html``: what ``extract`` takes."""
    found = staged(skeletons(pages))
    counts = found.groupBy("host").agg(F.count("*").alias("n"))
    salted = found.join(counts, "host").withColumn("salt", F.pmod("content", F.ceil(F.col("n") / GROUP_PAGES)))
    grouped = salted.drop("n").repartition("host", "salt").sortWithinPartitions("host", "salt", "content")
    sums = staged(evidence(grouped).groupBy("host", "kind", "key").agg(*(F.sum(c).alias(c) for c in "abc")))
    constant = (F.col("kind") == 0) & (F.col("a") >= LEAST_ALIGNED) & (F.col("b") >= SAME_SHARE * F.col("a"))
    whole = sums.where("kind = 1").groupBy("host").agg(F.sum("a").alias("varying"), F.sum("c").alias("within"))
    minor = (F.col("kind") == 1) & (F.col("a") < MINOR_SHARE * F.col("varying")) & (F.col("a") < 2 * F.col("b"))
    keys = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("key"))))
    parts = sums.join(whole, "host", "left").groupBy("host").agg(keys(constant).alias("constants"), keys(minor).alias("minor"), F.first("varying").alias("varying"), F.first("within").alias("within"))
    return parts.select("host", "constants", "minor", F.when(F.col("varying") > 0, F.col("within") >= ARTICLE_SHARE * F.col("varying")).alias("in_article"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, ``text``, ``n_chars`` (code points).

    Null and empty pages have an empty text; pages without a host (null or odd
    urls) share one wrapper; repeated rows count once for the wrapper and come
    back as often as they are; an empty table gives an empty result; other
    columns are not read.
    """
    rows = small_batches(pages).select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(F.col(url_col)).alias("host"))
    induced = staged(wrappers(rows.select("host", "html")))
    size = induced.agg(F.sum(F.octet_length("host") + 8 * (F.size("constants") + F.size("minor")) + 16)).first()[0] or 0
    wide = rows.join(F.broadcast(induced) if size <= BROADCAST_BYTES else induced, "host", "left").select("id", "url", "html", "constants", "minor", "in_article")

    def run(batches):
        sets: dict[tuple, frozenset] = {}

        def held(keys) -> frozenset:
            key = tuple(keys or ())
            if key not in sets:
                if len(sets) > 10_000:
                    sets.clear()
                sets[key] = frozenset(key)
            return sets[key]

        for batch in batches:
            for small in byte_slices(batch, "html", GROUP_BYTES):
                out = [extract(page, held(constants), held(minor), within) for page, constants, minor, within in zip(*(small.column(i).to_pylist() for i in (2, 3, 4, 5)))]
                yield pa.RecordBatch.from_arrays([small.column(0), small.column(1), pa.array(out, pa.string())], ["id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = wide.mapInArrow(run, f"id {kinds['id']}, url string, text string")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
