"""Main text of web pages by wrapper induction.

1. Every page becomes a tree of its block elements (labels are tag and class, inline elements belong to their block's text).
2. Trees of one host are aligned by simple tree matching: labels must agree, and an order-preserving matching of
   children with the most matched nodes is found by dynamic programming. What has no match in the grown tree becomes a slot of
   its own. Large hosts are aligned in groups of about GROUP pages, each with a wrapper of its own, so all pages take part and
   no task holds a whole host.
3. A text of a slot is template if pages with at least half of the group's votes, LEAST_PAGES of them mostly of their own text,
   have it there. A page's vote is the share of its text that no other page of the group has, so copies and near copies of an
   article do not make it template, however many they are. All other texts are content.
4. A page is aligned with its group's wrapper. Its text is what is in its main region (``article``, ``main`` or else the
   body), without elements that by tag, role or class are menus, headers, footers, sidebars, notices, adverts, forms or comments
   (within an article few classes count, and only on containers), and without the texts that its slots call template.

Edge cases: null html is empty; pages that end anywhere, unclosed and stray tags are read as browsers do, roughly; nesting of
any depth is walked without recursion; a page without a host, or with fewer than LEAST_PAGES others of its host, has no
wrapper; very long pages are read whole; a page without text gives an empty string; repeated rows are extracted each and
vote once; of equally good alignments one is taken that keeps equal texts at the beginnings and ends of lists together; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.shipping import ship_package, then_released, written

GROUP, LEAST_PAGES, LEAST_SHARE = 256, 5, 0.5
#: Remembered matchings of a wrapper's subtrees, beyond which they are forgotten.
MEMO_SIZE = 200_000
#: Host rows, and bytes of wrappers, up to which they are broadcast; more are joined by shuffle.
BROADCAST_HOSTS, BROADCAST_BYTES = 100_000, 32_000_000
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"\d+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select xmp".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NOISE_TAGS = frozenset("nav footer aside form button dialog menu head fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Outside of articles and main elements, classes and ids with one of these words are furniture.
_NOISE_WORDS = (
    "ads? adv advert\\w* adsense sponsor\\w* promo\\w* banner comments? commentlist disqus respond repl(?:y|ies) cookies? consent gdpr notice "
    "notification alert popup modal overlay newsletter subscribe subscription sidebar side-bar widget menu nav navbar navigation topnav "
    "breadcrumbs? footer header masthead shar(?:e|ing) social related recommend\\w* pagination pager toolbar login signin signup search "
    "copyright legal disclaimer skip toc tags? byline meta"
).split()
_NOISE_CLASS = re.compile(rf"(?:^|[\s_-])(?:{'|'.join(_NOISE_WORDS)})(?:$|[\s_-])", re.I)
#: Within articles, containers of one of these classes or ids are furniture.
_ARTICLE_NOISE = frozenset(
    "ad ads advert advertisement adsense sponsored comment comments comment-list commentlist disqus respond cookie-notice cookie-banner consent "
    "newsletter share sharing share-buttons social social-share sidebar related related-posts menu nav navbar breadcrumb breadcrumbs".split()
)
_CONTAINERS = frozenset("div section ul ol dl table article details".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})
}


#: What a node is: text, furniture outside of articles, furniture everywhere.
TEXT, SOFT, HARD = 0, 1, 2


class Node:
    """A block element: its label, what it is, and its texts and children in page order."""

    __slots__ = ("tag", "label", "noise", "parts", "template")

    def __init__(self, tag: str, label: int, noise: int):
        self.tag, self.label, self.noise, self.parts, self.template = tag, label, noise, [], False

    def children(self) -> list[Node]:
        return [x for x in self.parts if isinstance(x, Node)]

    def blocks(self) -> list[str]:
        """Its own texts between its children, as text."""
        out, held = [], []
        for x in [*self.parts, None]:
            if isinstance(x, str):
                held.append(x)
            elif held:
                if text := _SPACE.sub(" ", html_module.unescape("".join(held))).strip():
                    out.append(text)
                held = []
        return out


def _noise(tag: str, attributes: dict[str, str]) -> int:
    if tag in NOISE_TAGS or attributes.get("role", "").lower() in NOISE_ROLES:
        return HARD
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return HARD
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return HARD
    names = [attributes[k].lower() for k in ("class", "id") if k in attributes]
    if not names or tag in ("html", "body", "main"):
        return TEXT
    if tag in _CONTAINERS and not _ARTICLE_NOISE.isdisjoint(w for x in names for w in x.split()):
        return HARD
    return SOFT if tag != "article" and any(map(_NOISE_CLASS.search, names)) else TEXT


def parse(page: str) -> Node:
    root = Node("", 0, TEXT)
    stack, at, end = [root], 0, len(page)
    inline: list[bool] = []  # for open inline elements: whether they are noise

    def close(upto: int) -> None:
        del stack[upto:]

    match = _TOKEN.search
    while at < end:
        m = match(page, at)
        if not m:
            if not any(inline):
                stack[-1].parts.append(page[at:])
            break
        if m.start() > at and not any(inline):
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in INLINE:
                if inline and tag not in VOID:
                    inline.pop()
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    inline.clear()
                    break
            continue
        if tag in RAW and not m[3].rstrip().endswith("/"):
            closing = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            at = closing.end() if closing else end
            continue
        attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(m[3])} if "=" in m[3] or m[3].strip() else {}
        if tag in INLINE:
            if tag == "br":
                stack[-1].parts.append(" ")
            elif tag not in VOID:
                inline.append(bool(attributes) and _noise(tag, attributes) == HARD)
            continue
        inline.clear()
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in ("td", "th", "table", "article", "section", "div", "li"):
                    break
        elif tag in _CLOSES:
            ends, walls = _CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    close(i)
                    break
                if stack[i].tag in walls:
                    break
        node = Node(tag, crc32(f"{tag} {_NUMBER.sub('', attributes.get('class', ''))}".encode("utf-8", "replace")), _noise(tag, attributes))
        stack[-1].parts.append(node)
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
    return root


def in_order(root: Node) -> Iterator[tuple[int, Node]]:
    """Depth and node, in page order."""
    stack = [(0, root)]
    while stack:
        depth, node = stack.pop()
        yield depth, node
        stack += [(depth + 1, c) for c in reversed(node.children())]


_ROW = "<u4,<u4,<u8,<u4"


def pack_tree(root: Node) -> bytes:
    """Depth, label, hash and length of the own text of each node in page order, 20 bytes a node."""
    rows = []
    for depth, node in in_order(root):
        own = "\n".join(node.blocks())
        rows.append((depth, node.label, xxhash.xxh64_intdigest(own) if own else 0, len(own)))
    return np.array(rows, _ROW).tobytes()


class Slot:
    """A node of a page's tree or of a grown tree. texts: which pages have which text there."""

    __slots__ = ("label", "texts", "children", "shape", "size", "pages")

    def __init__(self, label: int):
        self.label, self.texts, self.children, self.shape, self.size, self.pages = label, {}, [], 0, 1, 1


def seal(root: Slot) -> Slot:
    """Sets each slot's number of nodes, and its shape: equal for subtrees of equal labels."""
    order, stack = [], [root]
    while stack:
        slot = stack.pop()
        order.append(slot)
        stack += slot.children
    for slot in reversed(order):
        slot.size = 1 + sum(c.size for c in slot.children)
        slot.shape = hash((slot.label, *(c.shape for c in slot.children)))
    return root


def unpack_tree(packed: bytes, page: int = 0) -> tuple[Slot, list[Slot]]:
    """The tree, and its slots in page order."""
    slots, stack = [], []
    for depth, label, text, _ in np.frombuffer(packed, _ROW).tolist():
        slot = Slot(label)
        if text:
            slot.texts[text] = [page]
        del stack[depth:]
        if stack:
            stack[-1].children.append(slot)
        stack.append(slot)
        slots.append(slot)
    return seal(slots[0]), slots


Memo = dict[tuple[int, int], int]


def _alike(x: Slot, y: Slot) -> bool:
    """Of one shape, and with a text of the other's where y has one."""
    return x.shape == y.shape and (not y.texts or not x.texts.keys().isdisjoint(y.texts))


def _trim(xs: list[Slot], ys: list[Slot]) -> tuple[int, int]:
    """How many slots at the beginnings and at the ends match each other.

    Two of one shape match whole, so no other partner of either is worth more, and as they are first (last) in both lists
    their match keeps none from others: some best matching has it. Those of equal text come first, as they decide between
    equally good matchings.
    """
    head, tail, most = 0, 0, min(len(xs), len(ys))
    for same in (_alike, lambda x, y: x.shape == y.shape):
        while head + tail < most and same(xs[head], ys[head]):
            head += 1
        while head + tail < most and same(xs[-1 - tail], ys[-1 - tail]):
            tail += 1
    return head, tail


def _known(x: Slot, y: Slot, memo: Memo) -> int | None:
    """The most matched nodes of two subtrees, where it need not be searched."""
    if x.label != y.label:
        return 0
    if x.shape == y.shape:
        return x.size
    if not x.children or not y.children:
        return 1
    return memo.get((x.shape, y.shape))


def _table(xs: list[Slot], ys: list[Slot], memo: Memo) -> list[list[int]]:
    """table[i][j]: the most matched nodes among the first i and j children."""
    table = [[0] * (len(ys) + 1)]
    for x in xs:
        above, row = table[-1], [0]
        for j, y in enumerate(ys):
            row.append(max(above[j + 1], row[j], above[j] + _known(x, y, memo)))
        table.append(row)
    return table


def matched_nodes(a: Slot, b: Slot, memo: Memo) -> int:
    """Simple tree matching: the most node pairs that keep labels, parents and order. memo is by shapes."""
    stack = [(a, b)]
    while stack:
        x, y = stack[-1]
        if _known(x, y, memo) is not None:
            stack.pop()
            continue
        head, tail = _trim(x.children, y.children)
        xs, ys = x.children[head : len(x.children) - tail], y.children[head : len(y.children) - tail]
        open_ = {(c.shape, d.shape): (c, d) for c in xs for d in ys if _known(c, d, memo) is None}
        if open_:
            stack += open_.values()
            continue
        ends = x.children[:head] + x.children[len(x.children) - tail :]
        memo[x.shape, y.shape] = 1 + sum(c.size for c in ends) + _table(xs, ys, memo)[-1][-1]
        stack.pop()
    return _known(a, b, memo)


def matched_children(xs: list[Slot], ys: list[Slot], memo: Memo) -> list[tuple[int, int]]:
    """Places of the children that a best matching pairs, in order."""
    head, tail = _trim(xs, ys)
    pairs = [(i, i) for i in range(head)]
    mx, my = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
    if mx and my:
        for x in mx:
            for y in my:
                matched_nodes(x, y, memo)
        table = _table(mx, my, memo)
        i, j, back = len(mx), len(my), []
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                back.append((head + i, head + j))
        pairs += back[::-1]
    return pairs + [(len(xs) - tail + i, len(ys) - tail + i) for i in range(tail)]


def aligned(tree: Slot, page: Slot, memo: Memo) -> Iterator[tuple[Slot, Slot, list[tuple[int, int]]]]:
    """Matched slots of two trees whose roots agree, each with the places of their children's pairs; parents first."""
    stack = [(tree, page)]
    while stack:
        a, b = stack.pop()
        pairs = matched_children(a.children, b.children, memo) if a.children and b.children else []
        below = [(a.children[i], b.children[j]) for i, j in pairs]
        yield a, b, pairs
        stack += below


def merge(tree: Slot, page: Slot, memo: Memo) -> None:
    """Adds a page to the grown tree; what has no match becomes an own slot beside its neighbours."""
    for a, b, pairs in aligned(tree, page, memo):
        a.pages += b.pages
        for text, pages in b.texts.items():
            a.texts.setdefault(text, []).extend(pages)
        if len(pairs) < len(b.children):
            match, grown, done = {j: i for i, j in pairs}, [], 0
            for j, y in enumerate(b.children):
                if j in match:
                    grown += a.children[done : match[j] + 1]
                    done = match[j] + 1
                else:
                    grown.append(y)
            a.children = grown + a.children[done:]
    seal(tree)


_WRAPPER_ROW = "<u4,<u4,<u8,<u8"


def induce(trees: list[bytes]) -> bytes | None:
    """The wrapper of different pages: slots of more than one page and their template texts, if there is any such text.

    At most two texts of a slot can each have half of the votes.
    """
    if len(trees) < LEAST_PAGES:
        return None
    root, memo = unpack_tree(trees[0])[0], {}
    for page, packed in enumerate(trees[1:], 1):
        merge(root, unpack_tree(packed, page)[0], memo)
    rows = [np.frombuffer(packed, _ROW) for packed in trees]
    everywhere = Counter(t for r in rows for t in set(r["f2"].tolist()))
    votes = []
    for r in rows:
        own = sum(n for t, n in zip(r["f2"].tolist(), r["f3"].tolist()) if everywhere[t] == 1)
        votes.append(own / max(1, int(r["f3"].sum())))
    least = LEAST_SHARE * sum(votes)

    def constant(pages: list[int]) -> bool:
        pages = set(pages)
        return sum(votes[p] >= 0.5 for p in pages) >= LEAST_PAGES and sum(votes[p] for p in pages) >= least

    out, stack, some = [], [(0, root)], False
    while stack:
        depth, slot = stack.pop()
        found = sorted(t for t, pages in slot.texts.items() if len(pages) >= LEAST_PAGES and constant(pages))
        some |= bool(found)
        out.append((depth, slot.label, *[*found, 0, 0][:2]))
        stack += [(depth + 1, c) for c in reversed(slot.children) if c.pages > 1]
    return np.array(out, _WRAPPER_ROW).tobytes() if some else None


def unpack_wrapper(packed: bytes) -> Slot:
    stack, root = [], None
    for depth, label, *texts in np.frombuffer(packed, _WRAPPER_ROW).tolist():
        slot = Slot(label)
        slot.texts = {t: [] for t in texts if t}
        del stack[depth:]
        if stack:
            stack[-1].children.append(slot)
        root = root or slot
        stack.append(slot)
    return seal(root)


def mark_template(root: Node, wrapper: Slot, memo: Memo) -> None:
    """Marks the nodes of a page whose own text is template in the slot that they are aligned with."""
    nodes = [node for _, node in in_order(root)]
    tree, slots = unpack_tree(pack_tree(root))
    place = {id(slot): i for i, slot in enumerate(slots)}
    for a, b, _ in aligned(wrapper, tree, memo):
        if a.texts and not a.texts.keys().isdisjoint(b.texts):
            nodes[place[id(b)]].template = True


def main_regions(root: Node) -> list[Node]:
    """Articles that are no furniture, else main elements, else the body, else all; such as have text."""
    found: dict[tuple[str, int], list[Node]] = {}
    stack = [(root, False, TEXT)]
    while stack:
        node, inside, soft = stack.pop()
        if node.noise == HARD and node.tag != "header":
            continue
        soft = max(soft, node.noise if node.tag != "header" else TEXT)
        took = node.tag in ("article", "main", "body") and not (node.tag == "article" and inside)
        if took:
            found.setdefault((node.tag, soft), []).append(node)
        stack += [(c, inside or took and node.tag == "article", soft) for c in reversed(node.children())]
    for key in (("article", TEXT), ("main", TEXT), ("article", SOFT), ("main", SOFT), ("body", TEXT), ("body", SOFT)):
        if regions := [n for n in found.get(key, []) if any(x.blocks() for _, x in in_order(n))]:
            return regions
    return [root]


def main_text(page: str, wrapper: Slot | None = None, memo: Memo | None = None) -> str:
    """The blocks of the main regions that are neither furniture nor template, joined by line feeds."""
    root, out = parse(page), []
    if wrapper is not None:
        mark_template(root, wrapper, {} if memo is None else memo)
    for region in main_regions(root):
        least = HARD if region.tag in ("article", "main") else SOFT
        # what is still to be read, the next at the end: nodes, or texts of a node; only headings count within a header
        stack: list[tuple[Node | str, bool]] = [(region, False)]
        while stack:
            x, heading_only = stack.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            heading_only = heading_only or x.tag == "header"
            shown = not x.template and (not heading_only or x.tag in ("h1", "h2", "h3"))
            parts, held = [], []
            for part in [*x.parts, None]:
                if isinstance(part, str):
                    held.append(part)
                    continue
                if held and shown and (text := _SPACE.sub(" ", html_module.unescape("".join(held))).strip()):
                    parts.append((text, False))
                held = []
                if part is not None and part.noise < least:
                    parts.append((part, heading_only))
            stack += reversed(parts)
    return "\n".join(out)


_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"


def _grouped(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """page_id, url, html, host, salt. Equal pages of a host have one salt; about GROUP different pages share one."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), _HOST, 1)), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    counts = rows.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP)
    large = written(counts.select("host", F.ceil(F.col("n") / GROUP).cast("int").alias("salts")), "hosts")
    small = large.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    salt = F.pmod(F.xxhash64("html"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
    return rows.join(F.broadcast(large) if small else large, "host", "left").select("page_id", "url", "html", "host", salt)


def _wrappers(rows: DataFrame) -> DataFrame:
    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [pack_tree(parse(x.as_py() or "")) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary())], names=["host", "salt", "tree"])

    def wrapper(group: pa.Table) -> pa.Table:
        found = induce(sorted(group.column("tree").to_pylist()))
        return group.slice(0, int(found is not None)).select(["host", "salt"]).append_column("wrapper", pa.array([found] if found else [], pa.binary()))

    named = rows.filter("host <> ''").select("host", "salt", "html").mapInArrow(then_released(trees), "host string, salt int, tree binary")
    # one row for all pages of a group that have equal trees
    return written(named.distinct().groupBy("host", "salt").applyInArrow(wrapper, "host string, salt int, wrapper binary"), "wrappers")


def host_wrappers(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """host, salt, wrapper: of the groups that have template texts."""
    ship_package(pages.sparkSession)
    return _wrappers(_grouped(pages, page_id, url, html))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    ship_package(pages.sparkSession)
    rows = _grouped(pages, page_id, url, html)
    wrappers = _wrappers(rows)
    n = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    if n:
        rows = rows.join(F.broadcast(wrappers) if n <= BROADCAST_BYTES else wrappers, ["host", "salt"], "left")
    else:
        rows = rows.withColumn("wrapper", F.lit(None).cast("binary"))
    rows = rows.select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[Slot, Memo]] = {}
        for batch in batches:
            texts = []
            for page, packed in zip(batch.column(2), batch.column(3)):
                packed = packed.as_py()
                if packed is not None and (packed not in known or len(known[packed][1]) > MEMO_SIZE):
                    known = {} if len(known) > 1000 else known
                    known[packed] = unpack_wrapper(packed), {}
                texts.append(main_text(page.as_py() or "", *known.get(packed, (None, None))))
            sizes = pa.array([len(t) for t in texts], pa.int64())
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    kinds = {name: rows.schema[name].dataType.simpleString() for name in ("page_id", "url")}
    return rows.mapInArrow(then_released(run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
