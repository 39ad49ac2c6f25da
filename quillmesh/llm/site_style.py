"""Main text of web pages by a site style tree.

Pass 1 parses every page and merges the trees of one host: elements with the same path of tags and class names are
one style node, named by a running hash (the parent's hash and the own style), with paths of any length. Per node it counts the presentation styles (the sequence of child tags) and the contents (texts of
its leaves) over the host's pages. The presentation importance of a node is the entropy of its styles to base
m, the number of pages; the content importance is one minus the mean of ``log c / log m``, c pages having a leaf's text.
They are combined as ``(1 - g**l) * presentation + g**l * content`` for a node with l child styles, g = 0.9.
Nodes below ``LEAST`` that occur on at least ``SUPPORT`` of the host's pages are branches to remove, if all nodes below
them are below ``LEAST`` too.

Written roles (``nav``, ``footer``, ``aside``, class names such as ``ad`` or ``comments``; ``article`` and ``main``) shift the
importance of a node, by ``NOISE_SHIFT`` down and ``MAIN_SHIFT`` up; statistics alone cannot tell menus of ever-changing links from
text. A node without statistics (small host, rare branch) counts as text unless its role is noise. Hidden elements
and ``head`` are never text. Names do not speak for ``html`` and ``body``, nor for an element around half of a page's
``article`` or ``main`` text, nor for the largest one where all text is below such names; the same holds for ``form``.
Pass 2 parses again and removes each page's unimportant branches. A page all of whose text would go by
statistics (a copy, say) keeps what the roles leave.

Counts are combined inside each task and again before the shuffle, contents are summed up per node before anything is
joined by host, and page counts meet the nodes under salted keys, so a host with a third of all pages is no hot key;
the lists of removed and restored nodes (at most ``pages' nodes / SUPPORT`` per host) meet the pages under salted keys.

Defined cases: null html is empty and has empty text; a null URL has the empty host; repeated rows are kept and each
counts as a page; an empty table gives no rows; columns other than the three are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.url_filter import split_url
from quillmesh.session import materialize, ship_package

LEAST, SUPPORT, LEAST_PAGES, DAMPING = 0.25, 0.3, 5, 0.9
#: Importance that a role takes or gives; with the latter a main node is never below ``LEAST``.
NOISE_SHIFT, MAIN_SHIFT = 0.7, LEAST
SALTS = 64
FLUSH = 200_000
#: Ancestor hashes in one Arrow batch.
STEPS = 1_000_000

# Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template iframe svg math textarea select object canvas audio video".split())
NOISE = frozenset("nav footer aside header menu dialog search button".split())
MAIN = frozenset("article main".split())
#: An opening tag of the key's kind closes an open element of these kinds.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
FRAME = frozenset("html body head".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
NOISE_NAME = re.compile(
    r"(?:^|[-_])(?:ads?|advert\w*|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|sidebar\w*|footer|breadcrumbs?|cookies?|consent|gdpr"
    r"|notices?|popup|modal|newsletter|subscribe|subscription|social|share|sharing|comments?|commentlist|respond|repl(?:y|ies)|disqus"
    r"|related|pagination|pager|widget|masthead|toolbar|login|signup|banner|skip-link)(?:$|[-_\d])"
)
HEADER_NAME = re.compile(r"(?:^|[-_])header(?:$|[-_\d])")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>"']+|"[^"]*"|'[^']*'|["'])*+)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


#: What an element's own tag and names say: by its names only, by tag or role, or never text.
NAMED, WRITTEN, HIDDEN = 1, 2, 3


class Element:
    __slots__ = ("tag", "node", "parent", "role", "noise", "main", "children", "chars")

    def __init__(self, tag: str, node: int, parent: Element | None, role: int, main: bool):
        self.tag, self.node, self.parent, self.role, self.main, self.children = tag, node, parent, role, main, []
        self.noise, self.chars = role > 0 or (parent is not None and parent.noise), 0

    def above(self) -> list[int]:
        """The nodes of this element and of all above it, without the root."""
        nodes, e = [], self
        while e.parent is not None:
            nodes.append(e.node)
            e = e.parent
        return nodes


def _number(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), seed & (1 << 64) - 1) - (1 << 63)


def _open(tag: str, rest: str, parent: Element) -> Element:
    """The element of an opening tag: its style node and what its own name says about its role."""
    names, roles, hidden = [], [], False
    if rest:
        for name, *values in _ATTRIBUTE.findall(rest):
            value = "".join(values).lower()
            if name.lower() in ("class", "id"):
                names += value.split()
            elif name.lower() == "role":
                roles += value.split()
            else:
                hidden |= name.lower() == "hidden" or value == "true"
    main = parent.main or tag in MAIN or "main" in roles
    role = 0
    if hidden or tag == "head":
        role = HIDDEN
    elif (tag in NOISE and not (tag == "header" and parent.main)) or any(r in NOISE_ROLES for r in roles):
        role = WRITTEN
    elif tag not in FRAME and (
        tag == "form" or "form" in roles or any(NOISE_NAME.search(n) for n in names) or (not parent.main and any(HEADER_NAME.search(n) for n in names))
    ):
        role = NAMED
    style = tag + "".join("." + re.sub(r"\d+", "0", n) for n in sorted(set(names)))
    return Element(tag, _number(style, parent.node), parent, role, main)


class Page:
    """A parsed page: ``blocks`` of (element, text) in page order, and the block elements met."""

    def __init__(self, html: str):
        self.blocks: list[tuple[Element, str]] = []
        self.elements: list[Element] = []
        root = Element("", 0, None, 0, False)
        self.elements.append(root)
        self.all = [root]
        stack = [root]
        parts: list[str] = []
        at, n = 0, len(html)

        def settle():
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                parts.clear()
                if text:
                    self.blocks.append((stack[-1], text))

        while at < n:
            m = _TOKEN.search(html, at)
            if m is None:
                parts.append(html[at:])
                break
            if m.start() > at:
                parts.append(html[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in RAW:
                if not m["end"] and not m["rest"].endswith("/"):
                    close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                    at = close.end() if close else n
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag not in BLOCK and not m["rest"]:
                continue
            if m["end"]:
                if tag in BLOCK:
                    settle()
                    if any(e.tag == tag for e in stack):
                        while stack.pop().tag != tag:
                            pass
                else:
                    self._close_inline(tag, stack, settle)
                continue
            if tag not in BLOCK:
                element = _open(tag, m["rest"], stack[-1]) if tag not in VOID else None
                if element is not None and element.role:
                    # an inline element with a role of its own is a branch too
                    settle()
                    self.all.append(element)
                    stack.append(element)
                continue
            settle()
            if stack[-1].tag == "p":
                stack.pop()
            shut = CLOSES.get(tag)
            if shut:
                while stack[-1].tag in shut:
                    stack.pop()
            element = _open(tag, m["rest"], stack[-1])
            stack[-1].children.append(tag)
            self.elements.append(element)
            self.all.append(element)
            if tag not in VOID and not m["rest"].endswith("/"):
                stack.append(element)
        settle()
        if any(e.role == NAMED for e in self.all):
            self._weigh_names()

    def _weigh_names(self) -> None:
        """Take back names that would remove the page's main text."""
        for e, text in self.blocks:
            e.chars += len(text)
        firm, inner, spoken = set(), set(), {}
        for e in self.all:
            if e.role > NAMED or e.parent in firm:
                firm.add(e)
            if e.main and (e.role or e.parent in inner):
                inner.add(e)
            spoken[e] = e.chars if e.main and e not in firm and e not in inner else 0
        for e in reversed(self.all[1:]):
            spoken[e.parent] += spoken[e]
        for e in self.all:
            if e.role == NAMED and 2 * spoken[e] >= spoken[self.all[0]] > 0:
                e.role = 0
        # text below an element outside named ones, all its text, and the largest named element outside others
        plain, total, largest = {}, {}, {}
        for e in self.all:
            plain[e] = total[e] = 0 if e in firm else e.chars
            largest[e] = None
        for e in reversed(self.all[1:]):
            up, total_up = e.parent, total[e]
            total[up] += total_up
            plain[up] += 0 if e.role else plain[e]
            best = e if e.role == NAMED and e not in firm else largest[e]
            if best is not None and e not in firm and (largest[up] is None or total[best] >= total[largest[up]]):
                largest[up] = best
        at = self.all[0]
        while not plain[at] and total[at] and largest[at] is not None:
            at = largest[at]
            at.role = 0
        for e in self.all[1:]:
            e.noise = e.role > 0 or e.parent.noise

    @staticmethod
    def _close_inline(tag: str, stack: list[Element], settle) -> None:
        if stack[-1].tag == tag:
            settle()
            stack.pop()


def style_of(element: Element) -> str:
    """The sequence of child tags, runs of one tag written once."""
    return " ".join(t for i, t in enumerate(element.children) if i == 0 or element.children[i - 1] != t)


def main_text(html: str, removed: frozenset[int] | set[int] = frozenset(), restored: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks of the main text, one per line; ``removed`` are style nodes of unimportant branches of the host,
    ``restored`` those that are important in spite of a role as noise."""
    page = Page(html)
    text = _kept(page, removed, restored)
    return text if text or not removed else _kept(page, frozenset(), restored)


def _kept(page: Page, removed, restored) -> str:
    out: set[Element] = set()
    for e in page.all[1:]:
        noise = e.role == HIDDEN or (e.role and e.node not in restored)
        if noise or e.parent in out or (e.tag not in FRAME and e.node in removed):
            out.add(e)
    return "\n".join(t for e, t in page.blocks if e not in out)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (host, node, kind, value): kind 0 pages, 1 styles, 2 leaf texts, 3 main elements, 5 noise, 6 all elements; 4 has the nodes above a node."""
    counts: Counter = Counter()
    met: dict[tuple[str, int], Element] = {}

    def batch_of(keys, n, above):
        columns = [pa.array(c, t) for c, t in zip(keys, (pa.string(), pa.int64(), pa.int32(), pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(above, pa.list_(pa.int64()))], names=["host", "node", "kind", "value", "n", "above"])

    def flush():
        if counts:
            yield batch_of(list(zip(*counts)), list(counts.values()), [None] * len(counts))
        own, lists, steps = [], [], 0
        for (host, node), e in met.items():
            own.append((host, node, 4, 0))
            lists.append(e.above())
            steps += len(lists[-1])
            if steps >= STEPS:
                yield batch_of(list(zip(*own)), [1] * len(own), lists)
                own, lists, steps = [], [], 0
        if own:
            yield batch_of(list(zip(*own)), [1] * len(own), lists)
        counts.clear()
        met.clear()

    for batch in batches:
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = Page(html)
            counts[host, 0, 0, 0] += 1
            styles: dict[int, list[str]] = {}
            for e in page.elements[1:]:
                styles.setdefault(e.node, []).append(style_of(e))
                met.setdefault((host, e.node), e)
                counts[host, e.node, 6, 0] += 1
                if e.noise:
                    counts[host, e.node, 5, 0] += 1
                elif e.main:
                    counts[host, e.node, 3, 0] += 1
            for node, own in styles.items():
                counts[host, node, 1, _number("|".join(dict.fromkeys(own)))] += 1
            for e, _ in page.blocks:
                if e.parent is not None:
                    met.setdefault((host, e.node), e)
            for node, text in {(e.node, t) for e, t in page.blocks if e.parent is not None}:
                counts[host, node, 2, _number(text)] += 1
            if len(counts) >= FLUSH:
                yield from flush()
    yield from flush()


def style_tree(pages: DataFrame) -> DataFrame:
    """``host, node, above, pages, presentation, content, importance, support, main, noise`` of the style nodes of every host.

    ``main`` and ``noise`` are the shares of a node's elements with that role; ``importance`` is before any shift.
    """
    ship_package(pages.sparkSession)
    host, _ = split_url(F.col("url").cast("string"))
    rows = pages.select(host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    counts = rows.mapInArrow(_statistics, "host string, node bigint, kind int, value bigint, n bigint, above array<bigint>")
    # the nodes above a node follow from the node, so as a key they part no group
    counts = materialize(counts.groupBy("host", "node", "kind", "value", "above").agg(F.sum("n").alias("n")), "styles")
    # sums of n and of n log n are all that both entropies need, so the page counts join the few nodes, never the contents
    own = counts.where("kind > 0").groupBy("host", "node", "kind", "above").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("n_log_n"), F.count("*").alias("values")
    )
    of = lambda kind, column: F.sum(F.when(F.col("kind") == kind, F.col(column)))
    single = own.groupBy("host", "node").agg(
        of(1, "n").alias("seen"), of(1, "n_log_n").alias("seen_log"), of(1, "values").alias("styles"), of(2, "n").alias("texts"), of(2, "n_log_n").alias("texts_log"),
        *[F.coalesce(of(k, "n") / of(6, "n"), F.lit(0.0)).alias(name) for k, name in ((3, "main"), (5, "noise"))], F.max("above").alias("above"),
    )
    # a leaf's texts count for all nodes above it
    # only a node's own row has its list of nodes above, or deep pages would hold a list per pair
    own_row = lambda column: F.when(F.col("at") == F.col("node"), F.col(column)).alias(column)
    kept = ("seen", "seen_log", "styles", "main", "noise", "above")
    spread = single.select("*", F.explode("above").alias("at")).select("host", "at", "texts", "texts_log", *[own_row(c) for c in kept])
    nodes = spread.groupBy("host", "at").agg(*[F.max(c).alias(c) for c in kept], F.sum("texts").alias("texts"), F.sum("texts_log").alias("texts_log"))
    nodes = nodes.withColumnRenamed("at", "node").where("seen is not null")
    m = counts.where("kind = 0").select("host", F.col("n").alias("pages"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    nodes = nodes.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(m, ["host", "salt"])
    log_m = F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double"))
    presentation = (F.col("seen") * F.log(F.col("pages").cast("double")) - F.col("seen_log")) / (F.col("pages") * log_m)
    content = F.coalesce(1 - F.col("texts_log") / (F.col("texts") * log_m), F.lit(0.0))
    damp = F.pow(F.lit(DAMPING), F.col("styles"))
    return nodes.select("*", presentation.alias("presentation"), content.alias("content")).select(
        "host", "node", "above", "pages", "presentation", "content", ((1 - damp) * F.col("presentation") + damp * F.col("content")).alias("importance"),
        (F.col("seen") / F.col("pages")).alias("support"), "main", "noise",
    )


def judged(tree: DataFrame) -> DataFrame:
    """``host, removed array<bigint>, restored array<bigint>`` of nodes on enough pages, importances shifted by roles.

    Removed are nodes below which (themselves included) all is below the bound; restored are nodes with a role as noise
    that are not below it.
    """
    common = (F.col("support") >= SUPPORT) & (F.col("pages") >= LEAST_PAGES)
    shifted = F.col("importance") + MAIN_SHIFT * F.col("main") - NOISE_SHIFT * F.col("noise")
    marked = tree.select("host", "node", "above", (shifted >= LEAST).alias("keeps"), (common & (shifted < LEAST)).alias("low"), (common & (shifted >= LEAST) & (F.col("noise") > 0)).alias("high"))
    own = lambda column: F.when(F.col("at") == F.col("node"), F.col(column)).otherwise(False).alias(column)
    spread = marked.select("*", F.explode("above").alias("at")).select("host", "at", "keeps", own("low"), own("high"))
    nodes = spread.groupBy("host", "at").agg(*[F.bool_or(c).alias(c) for c in ("keeps", "low", "high")]).where("high or (low and not keeps)")
    return nodes.groupBy("host").agg(F.collect_list(F.when(~F.col("high"), F.col("at"))).alias("removed"), F.collect_list(F.when(F.col("high"), F.col("at"))).alias("restored"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of ``pages(page_id, url, html)``: one row per page row."""
    pages = pages.select("page_id", "url", "html")
    lists = judged(style_tree(pages))
    salts = lists.select(F.col("host").alias("_host"), "removed", "restored", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    host, _ = split_url(F.col("url").cast("string"))
    salted = pages.withColumn("host", host).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    joined = salted.join(salts, (F.col("host") == F.col("_host")) & (F.col("salt") == F.col("_salt")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = zip(*[batch.column(c).to_pylist() for c in ("html", "removed", "restored")])
            texts = [main_text(h or "", frozenset(low or ()), frozenset(high or ())) for h, low, high in own]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = dict(pages.dtypes)
    return joined.select("page_id", "url", "html", "removed", "restored").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
