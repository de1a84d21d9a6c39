"""Main text of pages by wrapper induction.

Pages of a host are made by one template.  The element trees of its pages are
aligned by simple tree matching (the largest top-down matching of ordered trees)
into one tree per host.  Text that stands unchanged at a node on most of the
host's pages belongs to the template; nodes whose text varies are slots.  The main
text of a page is what its slots under the content element hold, without parts
that are set apart by their element or by what its class or id says (menus,
headers, footers, sidebars, notices, adverts, forms, comments).

1. Each page becomes a shape: its tree with equal neighbours as one, so that pages
   that differ in the number of paragraphs have the same shape.
2. Distinct shapes of a host are folded into its tree by matching, about ``FAN``
   trees a task and level (by a hash of the tree), in as many levels as it takes.
3. Texts are counted per host, node and text over pages with different texts, so
   copies of a page count once; a text is template when most of these pages have
   it at one node.  These counts are sums, so a hot host is spread out.
4. A part that only its class or id sets apart is taken back where it is the
   host's main slot: where it holds more varying text than the parts not set apart.
5. Pages meet their host's tree in a join that Spark may split.

Elements that are nested more than ``DEEP`` levels deep stand side by side on that
level, with what they inherit; their text stays in its order.  A page is handled as one value in a task.

Null and empty pages have no text.  A page without a host is its own host "".
Hosts with fewer than ``FEWEST`` different pages have no template nodes.  A page's
content element is kept whole when all its text would go as template; and a page
where names set all text apart keeps it.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import kept

FEWEST, SHARE, FAN = 5, 0.8, 64
#: Levels of a page's tree; elements that are nested deeper stand side by side on the last level.
DEEP = 150
#: Children of a node from which on equal ones count once in its shape.
WIDE = 300

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
APART = frozenset("nav footer aside form header menu button select option input label dialog head".split())
APART_WORDS = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|advert\w*|adslot|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice\w*|gdpr|popup|modal|overlay|subscribe|newsletter|signup|login|sidebar|side|rail|related|recommend\w*|more-stories|trending|widget|nav\w*|menu|breadcrumb\w*|crumbs|pager|pagination|toolbar|topbar|header|masthead|footer|foot|copyright|legal|comment\w*|reply|replies|discussion|disqus|respond|share|sharing|social|follow|tags|meta|byline|skip|search)(?:$|[-_ \d])"
)
#: Words that only say where or in what form a part stands: beside them a name is still that of a part set apart.
FORM_WORDS = frozenset("area article articles bar block blocks body bottom box btn button buttons center col column container content count desktop div entry fixed float global group heading holder icon icons img inline inner item items label large left link links list local main mobile module more news outer page panel position post posts primary region right row secondary section single site slot small sticky stories story sub text the title toggle top unit us view wrap wrapper".split())
#: Elements that hold a page or its content: what they are called sets nothing apart.
HOLDERS = frozenset("html body main article".split())
CONTENT_WORDS = re.compile(r"(?:^|[-_ ])(?:article|post|entry|story|content|main|body-text|text)(?:$|[-_ ])")
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CLOSES = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
PAIR = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("apart", "children", "label", "named", "shape", "tag", "text")

    def __init__(self, tag: str, label: str, apart: bool, named: bool = False):
        #: set apart by element or attribute; by class, id or role
        self.tag, self.label, self.apart, self.named = tag, label, apart, named
        self.children: list[Node] = []
        self.shape: Shape | None = None
        #: the node's own blocks of text, in page order among its children: (child number, text)
        self.text: list[tuple[int, str]] = []


def tree(page: str) -> Node:
    """The element tree of a page; inline elements are part of the text around them."""
    root = Node("", "", False)
    stack, at, size = [root], 0, len(page)
    said: list[str] = []

    def flush() -> None:
        words = WHITE.sub(" ", html.unescape("".join(said))).strip()
        said.clear()
        if words:
            if len(stack) > DEEP and stack[DEEP - 1].children[-1] is not stack[-1]:
                # text behind an element that stands beside its parent: the parent goes on behind it
                over = stack[-1]
                stack[-1] = Node(over.tag, over.label, over.apart, over.named)
                stack[DEEP - 1].children.append(stack[-1])
            stack[-1].text.append((len(stack[-1].children), words))

    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            said.append(page[at:])
            break
        said.append(page[at : m.start()])
        at = m.end()
        if not m.group(2):
            continue
        closing, tag, rest = m.group(1), m.group(2).lower(), m.group(3) or ""
        if tag in INLINE and not (rest and not closing and set_apart(tag, rest)):
            # an inline element that is set apart is a node like others
            if closing and any(n.tag == tag for n in stack[1:]):
                flush()
                while stack[-1].tag != tag:
                    stack.pop()
                stack.pop()
            continue
        if tag in ("br", "wbr"):
            said.append(" " if tag == "br" else "")
            continue
        if closing:
            if any(n.tag == tag for n in stack[1:]):
                flush()
                while stack[-1].tag != tag:
                    stack.pop()
                stack.pop()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|$)", re.I).search(page, at)
            if not rest.rstrip().endswith("/"):
                at = end.end() if end else size
            continue
        if tag in VOID:
            if tag in BLOCKS:
                flush()
            continue
        flush()
        while len(stack) > 1 and tag in CLOSES.get(stack[-1].tag, ()):
            stack.pop()
        names = attributes(rest)
        node = Node(tag, tag + "." + names if names else tag, tag in APART or hidden(rest), named_apart(tag, names))
        if len(stack) >= DEEP:
            # on the last level elements inherit from those they are nested in by copying
            if len(stack) > DEEP:
                node.apart, node.named = node.apart or stack[-1].apart, node.named or stack[-1].named
            stack[DEEP - 1].children.append(node)
        else:
            stack[-1].children.append(node)
        stack.append(node)
    flush()
    return root


def attributes(rest: str) -> str:
    """Class, id and role of an element in lower case; numbers, which count things, as 0."""
    if "=" not in rest:
        return ""
    found = " ".join(x for m in ATTRIBUTE.finditer(rest) for x in m.groups()[1:] if x)
    return re.sub(r"\d+", "0", WHITE.sub(" ", found).strip().lower())


def hidden(rest: str) -> bool:
    """An element with the attribute ``hidden`` or the style display: none."""
    low = rest.lower()
    if "hidden" not in low and "display" not in low:
        return False
    for m in PAIR.finditer(low):
        value = "".join(x for x in m.groups()[1:] if x)
        if m.group(1) == "hidden" and value != "false" or m.group(1) == "style" and re.search(r"(?:^|;)\s*display\s*:\s*none", value):
            return True
    return False


def apart_name(name: str) -> bool:
    """A name all of whose parts speak of a part set apart or of its form: "ad-slot" and "site-footer", not "related-work"."""
    if not APART_WORDS.search(name):
        return False
    rest = name.replace("more-stories", "trending")
    return all(p in FORM_WORDS or p.isdigit() or APART_WORDS.fullmatch(p) for p in re.split(r"[-_]+|(?<=[^\d])(?=\d)", rest) if p)


def named_apart(tag: str, names: str) -> bool:
    return bool(names) and tag not in HOLDERS and bool(APART_WORDS.search(names)) and any(apart_name(x) for x in names.split())


def set_apart(tag: str, rest: str) -> bool:
    return tag in APART or hidden(rest) or named_apart(tag, attributes(rest))


Shape = list  # [label, [shape, ...]]


def shape(node: Node) -> Shape:
    """The tree of labels with equal neighbours as one."""
    if node.shape is None:
        node.shape = [node.label, []]
        numbered_children(node)
    return node.shape


def numbered_children(node: Node) -> list[int]:
    """For each child its number among the children of the node's shape, which are made here.

    Equal neighbours are one child of the shape.  Of more than ``WIDE`` children equal
    ones are one wherever they stand, so a long list of alternating elements is as
    narrow a shape as its pattern.
    """
    own = [shape(c) for c in node.children]
    children: list[Shape] = []
    numbers = []
    for s in own:
        if not children or children[-1] != s:
            children.append(s)
        numbers.append(len(children) - 1)
    if len(children) > WIDE:
        met: dict[str, int] = {}
        children, renumbered = [], {}
        for k, s in zip(numbers, own, strict=True):
            if k not in renumbered:
                key = json.dumps(s)
                if key not in met:
                    met[key] = len(children)
                    children.append(s)
                renumbered[k] = met[key]
        numbers = [renumbered[k] for k in numbers]
    shape(node)[1] = children
    return numbers


def matching(a: Shape, b: Shape, known: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two nodes with one label: size of the largest matching and the matched children."""
    key = (id(a), id(b))
    if key in known:
        return known[key]
    m, n = len(a[1]), len(b[1])
    best = [[0] * (n + 1) for _ in range(m + 1)]
    worth = [[matching(x, y, known)[0] if x[0] == y[0] else 0 for y in b[1]] for x in a[1]]
    for i in range(m):
        for j in range(n):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + worth[i][j])
    pairs, i, j = [], m, n
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    known[key] = (best[m][n] + 1, pairs[::-1])
    return known[key]


def merge(a: Shape, b: Shape, known: dict | None = None) -> Shape:
    """The tree of both: matched nodes once, others in their place."""
    known = {} if known is None else known
    out, i, j = [], 0, 0
    for x, y in [*matching(a, b, known)[1], (len(a[1]), len(b[1]))]:
        out += [*a[1][i:x], *b[1][j:y]]
        if x < len(a[1]):
            out.append(merge(a[1][x], b[1][y], known))
        i, j = x + 1, y + 1
    return [a[0], out]


def fold(shapes: list[str]) -> str:
    """All shapes as one tree, in a fixed order."""
    whole: Shape = ["", []]
    for s in sorted(shapes, key=lambda s: (-len(s), s)):
        whole = merge(whole, json.loads(s))
    return json.dumps(whole, separators=(",", ":"), ensure_ascii=False)


def places(node: Node, template: Shape, path: str, known: dict, out: dict[int, str]) -> None:
    """The template's place of each node of a page, by matching; unmatched nodes have none."""
    own = shape(node)
    pairs = dict(matching(own, template, known)[1])
    out[id(node)] = path
    for k, child in zip(numbered_children(node), node.children, strict=True):
        if k in pairs:
            places(child, template[1][pairs[k]], f"{path}/{pairs[k]}", known, out)


def blocks(node: Node, apart: bool = False, content: bool = False, named: tuple[Node, ...] = ()) -> Iterator[tuple[Node, str, bool, bool, tuple[Node, ...]]]:
    """(node, text, set apart, under a content element, elements around it that are apart by name) of the blocks of a page, in page order."""
    apart = apart or node.apart
    content = content or node.tag in ("article", "main") or "main" in node.label.split()
    named = (*named, node) if node.named else named
    said = list(node.text)
    for k, child in enumerate([*node.children, None]):
        while said and said[0][0] == k:
            yield node, said.pop(0)[1], apart, content, named
        if child is not None:
            yield from blocks(child, apart, content, named)


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", (url or "").strip().lower())
    return m.group(1) if m else ""


def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[tuple[str, str], int] = {}
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            key = (host_of(url), json.dumps(shape(tree(page or "")), separators=(",", ":"), ensure_ascii=False))
            seen[key] = seen.get(key, 0) + 1
        if seen:
            yield pa.record_batch([pa.array([h for h, _ in seen]), pa.array([s for _, s in seen]), pa.array(list(seen.values()), pa.int64())], names=["host", "tree", "pages"])


def fold_group(part: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": [part["host"].iloc[0]], "tree": [fold(part["tree"].tolist())], "pages": [int(part["pages"].sum())]})


class Aligner:
    """Places of a page's nodes in its host's tree; shapes and trees are read once."""

    def __init__(self) -> None:
        self.trees: dict[str, Shape] = {}

    def of(self, page: Node, template: str) -> dict[int, str]:
        if template not in self.trees:
            if len(self.trees) > 1000:
                self.trees.clear()
            self.trees[template] = json.loads(template)
        out: dict[int, str] = {}
        places(page, self.trees[template], "", {}, out)
        return out


def page_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, digest of the page's texts, its texts at matched nodes) of pages; equal pages of a partition once.

    A text has a key (place and text), a length (0 if it is set apart for good) and the
    place of the one element that sets it apart by name, or 0.
    """
    import xxhash

    aligner, met = Aligner(), set()
    for batch in batches:
        hosts, digests, sizes, key, chars, names = [], [], [0], [], [], []
        for host, page, template in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            same = xxhash.xxh3_128_digest(f"{host}\n{page or ''}".encode("utf-8", "replace"))
            if same in met:
                continue
            met.add(same)
            root = tree(page or "")
            where = aligner.of(root, template)
            found, whole = {}, xxhash.xxh3_128()
            for node, text, apart, _, named in blocks(root):
                place = where.get(id(node))
                whole.update(f"{place}\n{text}\n".encode("utf-8", "replace"))
                if place is not None:
                    lost = apart or len(named) > 1 or named and id(named[0]) not in where
                    found.setdefault(text_key(place, text), (0 if lost else len(text), 0 if lost or not named else stable_hash(where[id(named[0])])))
            hosts.append(host)
            digests.append(whole.digest())
            sizes.append(sizes[-1] + len(found))
            key += found
            chars += [c for c, _ in found.values()]
            names += [x for _, x in found.values()]
        if hosts:
            texts = pa.StructArray.from_arrays([pa.array(key, pa.int64()), pa.array(chars, pa.int64()), pa.array(names, pa.int64())], names=["key", "chars", "named"])
            yield pa.record_batch([pa.array(hosts), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), texts)], names=["host", "digest", "texts"])


def stable_hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def text_key(place: str, text: str) -> int:
    return stable_hash(f"{place}\n{text}")


def main_text(root: Node, where: dict[int, str], constant: set[int], free: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks of varying slots that are not set apart; under the content element if the page has one."""
    open_blocks = [(node, text, content, named) for node, text, apart, content, named in blocks(root) if not apart]
    main_slot = lambda node: bool(free) and id(node) in where and stable_hash(where[id(node)]) in free
    found = [x for x in open_blocks if all(map(main_slot, x[3]))] or open_blocks
    inside = [x for x in found if x[2]]
    varying = [text for node, text, _, _ in inside or found if not (constant and id(node) in where and text_key(where[id(node)], text) in constant)]
    # a content element that would lose all its text holds a page that others copy
    return "\n".join(varying or [text for _, text, _, _ in inside])


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    aligner = Aligner()
    for batch in batches:
        at = batch.schema.get_field_index
        out = []
        for page, template, fixed, free in zip(*(batch.column(at(c)).to_pylist() for c in ("html", "tree", "fixed", "free")), strict=True):
            root = tree(page or "")
            where = aligner.of(root, template) if template and (fixed or free) else {}
            out.append(main_text(root, where, set(fixed or ()), set(free or ())))
        yield pa.record_batch([batch.column(at("page_id")), batch.column(at("url")), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def host_column(url: str) -> Column:
    return F.regexp_extract(F.lower(F.trim(F.coalesce(F.col(url).cast("string"), F.lit("")))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)


def host_trees(pages: DataFrame) -> DataFrame:
    """Written table (host, tree, pages): each host's tree and how many rows it has."""
    kind = "host string, tree string, pages long"
    found = pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(shapes, kind)
    trees, level = kept(found.groupBy("host", "tree").agg(F.sum("pages").alias("pages")), "host-shapes"), 0
    while True:
        sizes = trees.groupBy("host").agg(F.count(F.lit(1)).alias("trees"))
        if (sizes.agg(F.max("trees")).first()[0] or 0) <= 1:
            return trees
        level += 1
        part = F.pmod(F.xxhash64("tree"), F.ceil(F.col("trees") / FAN))
        parts = trees.join(sizes, "host").withColumn("part", part).groupBy("host", "part")
        trees = kept(parts.applyInPandas(fold_group, kind), f"host-trees-{level}")


def host_slots(whole: DataFrame, trees: DataFrame) -> DataFrame:
    """(host, fixed, free): the keys of each host's template texts, and the places that are its main slot though a name sets them apart."""
    aligned = whole.join(trees.where(F.col("pages") >= FEWEST), "host").select("host", "html", "tree")
    found = aligned.mapInArrow(page_texts, "host string, digest binary, texts array<struct<key:long,chars:long,named:long>>")
    # copies of a page have the same texts: a host's pages are those that differ
    different = kept(found.groupBy("host", "digest").agg(F.first("texts").alias("texts")), "page-texts")
    sizes = different.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= FEWEST)
    counts = kept(different.select("host", F.explode("texts").alias("t")).groupBy("host", "t.key").agg(F.count(F.lit(1)).alias("n"), F.sum("t.chars").alias("chars"), F.max("t.named").alias("named")), "text-counts")
    # written, so that Spark may split this join at a hot host
    template = kept(counts.join(sizes, "host").where(F.col("n") >= F.col("pages") * SHARE).select("host", "named", "key", "chars"), "template-texts")
    fixed = template.groupBy("host", "named").agg(F.collect_list("key").alias("fixed"), (-F.sum("chars")).alias("chars"))
    slots = counts.groupBy("host", "named").agg(F.sum("chars").alias("chars")).unionByName(fixed, True).groupBy("host", "named").agg(F.flatten(F.collect_list("fixed")).alias("fixed"), F.sum("chars").alias("chars"))
    hosts = slots.groupBy("host").agg(F.flatten(F.collect_list("fixed")).alias("fixed"), F.sum(F.when(F.col("named") == 0, F.col("chars")).otherwise(0)).alias("own"), F.collect_list(F.struct("named", "chars")).alias("held"))
    return hosts.join(sizes, "host").select("host", "fixed", F.expr("transform(filter(held, x -> x.named != 0 and x.chars > own), x -> x.named)").alias("free"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """A row per row of ``pages``: page_id, url and the main text."""
    trees = host_trees(pages)
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_column("url"))
    wrappers = kept(trees.join(host_slots(whole, trees), "host", "left").select("host", "tree", "fixed", "free"), "wrappers")
    return whole.join(wrappers, "host", "left").select("page_id", "url", "html", "tree", "fixed", "free").mapInArrow(extract, "page_id long, url string, text string")
