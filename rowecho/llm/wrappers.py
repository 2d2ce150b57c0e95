"""Main text of web pages by wrappers inferred per host.

Pages of a host are token streams of one template. A page is parsed and folded: siblings of equal
structure become a repeated group. The folded pages of a host are aligned one after another into a
union-free regular expression: what only some of them have becomes optional, what one repeats
becomes repeated, and a text that differs becomes a slot. The expression tells which texts are
template and where the main text lies, and so which texts of each page are extracted.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowecho.llm.common import bounded_batches, cut, table, text_or_empty

BROADCAST_BYTES = 32 << 20  # of wrappers; more are joined
PARTIAL = 400  # folded pages aligned in one task before their wrappers are aligned with each other
LONGEST_GROUP = 3  # siblings in a repeated group
LEAST_PAGES = 3  # different ones with the same text before it counts as template
TEMPLATE_SHARE = 0.4  # of a host's different pages, too
SHARE = 0.6  # of a node's text in one child before the search for the main text goes down
SCRAP = 0.1  # of the text its own template has as main text: a page with less of the host's is of another template
HELD_SKELETONS = 20_000

# fixed values: names of HTML elements
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q "
                   "rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("aside audio button canvas dialog figcaption footer form head header iframe menu nav noscript object "
                    "option select svg template textarea title video".split())
ARTICLE = ("article", "main")
#: words of class, id or role that mark what is not the article
ASIDE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
                  "complementary consent contentinfo cookie cookies disclaimer disqus footer gdpr header login "
                  "masthead menu modal nav navbar navigation newsletter notice notification outbrain paywall popup "
                  "promo promoted promotion related replies reply respond search share sharing sidebar signup social "
                  "sponsor sponsored subscribe subscription taboola toolbar topbar widget widgets".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main "
                     "menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "thead": {"table"}, "tbody": {"table"}, "option": {"select"}}

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(script|style|title|textarea|iframe|xmp|noembed|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r".*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
MARKS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HOST = "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


@dataclass
class Node:
    """An element (or, with the name ``*``, a repeated group of siblings, or, ``#`` and ``#a``, a
    text, the latter all link) of a folded page or a wrapper."""

    name: str
    mark: str = ""  # the words of class, id and role that matter
    children: list["Node"] = field(default_factory=list)
    key: str = ""  # of a folded page: its structure
    texts: list[tuple[int, str]] = field(default_factory=list)  # of a folded page: (place, text) of a text
    repeated: bool = False
    optional: bool = False
    constant: str | None = None  # hash of a text that was the same so far
    pages: int = 0
    chars: int = 0

    def sign(self) -> str:
        return f"{self.name}.{self.mark}" if self.mark else self.name


def parse(page: str) -> Node:
    """The folded tree of a page."""
    root = Node("")
    stack, names, place = [root], [""], 0
    piece, linked, links, at = [], 0, 0, 0

    def text_ends():
        nonlocal piece, linked, place
        if piece:
            text = " ".join(entities.unescape("".join(piece)).split())
            if text:
                leaf = Node("#a" if linked >= len("".join("".join(piece).split())) else "#", texts=[(place, text)])
                leaf.key = leaf.name
                place += 1
                _append(stack[-1].children, leaf)
            piece, linked = [], 0

    def up_to(depth: int):
        text_ends()
        while len(stack) > depth:
            node = stack.pop()
            names.pop()
            node.key = f"{node.sign()}({','.join(c.key + '+' * c.repeated for c in node.children)})"
            _append(stack[-1].children, node)

    def last(found: set | frozenset, within: set | frozenset = frozenset()) -> int:
        for i in range(len(names) - 1, 0, -1):
            if names[i] in found:
                return i
            if names[i] in within:
                return 0
        return 0

    for token in TOKEN.finditer(page):
        if token.start() > at:
            piece.append(page[at:token.start()])
            if links:
                linked += len("".join(piece[-1].split()))
        at = token.end()
        name = token.group(3)
        if name is None:
            continue
        name = name.lower()
        closing = token.group(2)
        if name == "br" or name == "hr":
            text_ends()
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            continue
        links = 0
        if closing:
            if depth := last({name}, {"table", "article", "body"} if name in ("p", "div", "li") and name not in names else frozenset()):
                up_to(depth)
            continue
        text_ends()
        if name in CLOSES_P and (depth := last({"p"}, {"table", "td", "button"})):
            up_to(depth)
        elif name in CLOSES and (depth := last(CLOSES[name], SCOPES[name])):
            up_to(depth)
        if name in VOID:
            continue
        words = {w for m in MARKS.finditer(token.group(4) or "")
                 for w in re.split(r"[^a-z]+", (m.group(1) or m.group(2) or m.group(3) or "").lower())} & ASIDE
        stack.append(Node(name, " ".join(sorted(words))))
        names.append(name)
    if at < len(page):
        piece.append(page[at:])
    up_to(1)
    root.key = f"({','.join(c.key + '+' * c.repeated for c in root.children)})"
    return root


def _append(siblings: list[Node], node: Node) -> None:
    """Add a folded node; if it completes a repetition of the siblings before it, fold them."""
    if siblings and siblings[-1].key == node.key:
        siblings[-1].repeated = True
        _gather(siblings[-1], node)
        return
    siblings.append(node)
    for n in range(2, LONGEST_GROUP + 1):
        tail = siblings[-n:]
        if len(siblings) > n and (group := siblings[-n - 1]).name == "*" and len(group.children) == n and all(
                a.key == b.key and a.repeated == b.repeated for a, b in zip(group.children, tail)):
            for a, b in zip(group.children, tail):
                _gather(a, b)
            del siblings[-n:]
            return
        if len(siblings) >= 2 * n and all(
                a.key == b.key and a.repeated == b.repeated for a, b in zip(siblings[-2 * n:-n], tail)):
            group = Node("*", children=siblings[-2 * n:-n], repeated=True)
            group.key = f"*({','.join(c.key + '+' * c.repeated for c in group.children)})"
            for a, b in zip(group.children, tail):
                _gather(a, b)
            siblings[-2 * n:] = [group]
            return


def _gather(into: Node, node: Node) -> None:
    """Texts of a node that has the same structure."""
    into.texts += node.texts
    for a, b in zip(into.children, node.children):
        _gather(a, b)


def leaves(node: Node) -> Iterator[Node]:
    if not node.children and node.name in ("#", "#a"):
        yield node
    for child in node.children:
        yield from leaves(child)


def to_json(node: Node) -> list:
    return [node.name, node.mark, node.repeated, node.optional, node.constant, node.pages, node.chars,
            [to_json(c) for c in node.children]]


def from_json(data: list) -> Node:
    name, mark, repeated, optional, constant, pages, chars, children = data
    return Node(name, mark, [from_json(c) for c in children], "", [], repeated, optional, constant, pages, chars)


def skeleton_of(page: Node) -> str:
    """The folded structure alone."""
    def bare(node):
        return [node.name, node.mark, int(node.repeated), [bare(c) for c in node.children]]

    return json.dumps(bare(page), separators=(",", ":"))


def page_of(skeleton: str, constants: list[str | None], chars: list[int], pages: int) -> Node:
    """A skeleton as a wrapper of its pages."""
    texts = iter(zip(constants, chars))

    def build(data):
        name, mark, repeated, children = data
        node = Node(name, mark, repeated=bool(repeated), pages=pages)
        if name in ("#", "#a") and not children:
            node.constant, node.chars = next(texts)
        node.children = [build(c) for c in children]
        return node

    return build(json.loads(skeleton))


def _paired(left: list[Node], right: list[Node]) -> list[tuple[int | None, int | None]]:
    """The longest common order of siblings of the same sign; (left, None) and (None, right) for others."""
    n, m = len(left), len(right)
    a, b = [x.sign() for x in left], [x.sign() for x in right]
    if a == b:
        return [(i, i) for i in range(n)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def align(wrapper: Node, page: Node) -> Node:
    """The wrapper generalised to what ``page`` (a wrapper as well) stands for."""
    wrapper.repeated |= page.repeated
    wrapper.optional |= page.optional
    wrapper.pages += page.pages
    wrapper.chars += page.chars
    if wrapper.constant != page.constant:
        wrapper.constant = None
    merged: list[Node] = []
    for i, j in _paired(wrapper.children, page.children):
        if i is not None and j is not None:
            node = align(wrapper.children[i], page.children[j])
        else:
            node = wrapper.children[i] if j is None else page.children[j]
            if merged and merged[-1].sign() == node.sign() and node.name != "*":
                # one more of the kind before it: repeated, not a further element
                before = merged[-1]
                pages, optional = before.pages, before.optional
                merged[-1] = align(before, node)
                merged[-1].repeated, merged[-1].pages, merged[-1].optional = True, max(pages, node.pages), optional
                continue
            node.optional = True
        merged.append(node)
    wrapper.children = merged
    return wrapper


def main_texts(wrapper: Node, met: set[int] | None = None) -> set[int]:
    """Ids (by ``id``) of the texts of a wrapper that belong to the main text; with ``met``, of the nodes with
    these ids alone, weighed by what a page that has them has in them and without what many pages of the host say."""
    def below(node: Node) -> list[Node]:
        return node.children if met is None else [c for c in node.children if id(c) in met]

    def candidates(node: Node, inside: bool) -> list[Node]:
        """The texts outside of what its name or marks set aside."""
        inside = inside or node.name in ARTICLE
        aside = node.name in SKIPPED and not (inside and node.name in ("header", "figcaption"))
        if aside or set(node.mark.split()) - {"header"} or (node.mark and not inside):
            return []
        own = [node] if node.name in ("#", "#a") and not node.children else []
        if met is not None and own and _everywhere(node, wrapper):
            own = []
        return own + [t for c in below(node) for t in candidates(c, inside)]

    def holders(node: Node, name: str) -> list[Node]:
        if node.name == name and candidates(node, True):
            return [node]
        if node.name in SKIPPED or node.mark:
            return []
        return [h for c in below(node) for h in holders(c, name)]

    def size(text: Node) -> float:
        return text.chars if met is None else text.chars / max(text.pages, 1)

    def weight(texts: list[Node]) -> float:
        return sum(size(t) for t in texts if t.name == "#")

    found = next((h for name in ARTICLE if (h := holders(wrapper, name))), [])
    if found:
        kept = [t for h in found for t in candidates(h, True)]
    else:
        node = wrapper
        while True:
            total = weight(candidates(node, False))
            heavy = [c for c in below(node) if c.children and weight(candidates(c, False)) >= SHARE * max(total, 1)]
            if not heavy or heavy[0].repeated:
                break
            node = heavy[0]
        kept = [t for t in candidates(node, False) if t.name == "#"] or candidates(node, False)
    varying = [t for t in kept if not _everywhere(t, wrapper)]
    if 2 * sum(size(t) for t in varying) >= sum(size(t) for t in kept):
        kept = varying  # what every page says is template, unless the pages are all alike
    return {id(t) for t in kept}


def _everywhere(text: Node, wrapper: Node) -> bool:
    """Whether a sizeable share of the host's pages, and not a few, have the same text here."""
    return text.constant is not None and text.pages >= max(LEAST_PAGES, TEMPLATE_SHARE * wrapper.pages)


def chosen_texts(wrapper: Node, page: Node, kept: set[int]) -> list[bool]:
    """For each text of a folded page whether the wrapper's text it falls on is main text.

    ``kept`` is the main text of the host as a whole. A page of another template has none of it, or
    a mere scrap besides its own: what is main text is then told by the wrapper's nodes the page has."""
    texts: list[Node | None] = []
    met: set[int] = set()

    def walk(node: Node, by: Node | None):
        if by is not None:
            met.add(id(by))
        if node.name in ("#", "#a") and not node.children:
            texts.append(by)
            return
        to: list[Node | None] = [None] * len(node.children)
        if by is not None:
            for i, j in _paired(by.children, node.children):
                if i is not None and j is not None:
                    to[j] = by.children[i]
            for j, child in enumerate(node.children):  # one more of a repeated kind
                if to[j] is None:
                    to[j] = next((w for w in [*to[j - 1::-1], *by.children] if w is not None
                                  and w.sign() == child.sign()), None) if j else next(
                        (w for w in by.children if w.sign() == child.sign()), None)
        for child, match in zip(node.children, to):
            walk(child, match)

    walk(page, wrapper)
    here = {id(t): t.chars / max(t.pages, 1) for t in texts if t is not None}
    own = main_texts(wrapper, met)
    if sum(here[t] for t in kept & here.keys()) < SCRAP * sum(here[t] for t in own & here.keys()):
        kept = kept | own
    return [t is not None and id(t) in kept for t in texts]


def _hash(text: str) -> str:
    return xxhash.xxh64_hexdigest(text.encode())


def different(pages: DataFrame) -> DataFrame:
    """(host, html): every page of a host once, however many copies it has. Only pages with copies are moved."""
    pages = pages.select("host", "html", F.xxhash64("html").alias("digest"))
    copied = cut(pages.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "copied")
    size = copied.agg(F.sum(F.octet_length("host") + 64)).head()[0] or 0
    if size > BROADCAST_BYTES:
        return pages.select("host", "html").dropDuplicates(["host", "html"])
    copied = F.broadcast(copied)
    single = pages.join(copied, ["host", "digest"], "left_anti").select("host", "html")
    return single.unionByName(pages.join(copied, ["host", "digest"], "left_semi").select("host", "html").dropDuplicates(
        ["host", "html"]))


def skeletons(pages: DataFrame) -> DataFrame:
    """(host, skeleton, constants, chars, pages): folded pages of a task, equal ones together."""
    def run(batches):
        held: dict[tuple[str, str], list] = {}

        def flush():
            rows = [(h, s, *v) for (h, s), v in held.items()]
            held.clear()
            names = ["host", "skeleton", "constants", "chars", "pages"]
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tree = parse(page)
                found, chars = [], []
                for leaf in leaves(tree):
                    found.append(_hash(leaf.texts[0][1]) if len({t for _, t in leaf.texts}) == 1 else None)
                    chars.append(sum(len(t) for _, t in leaf.texts))
                known = held.get(key := (host, skeleton_of(tree)))
                if known is None:
                    held[key] = [found, chars, 1]
                else:
                    known[0] = [a if a == b else None for a, b in zip(known[0], found)]
                    known[1] = [a + b for a, b in zip(known[1], chars)]
                    known[2] += 1
            if len(held) > HELD_SKELETONS:
                yield flush()
        if held:
            yield flush()

    return pages.select("host", "html").mapInArrow(
        run, "host string, skeleton string, constants array<string>, chars array<bigint>, pages bigint")


def _aligned(rows: list[str]) -> str:
    """The wrappers in ``rows`` (JSON) aligned one after another, the most frequent structure first."""
    trees = sorted((from_json(json.loads(r)) for r in rows), key=lambda t: -t.pages)
    wrapper = trees[0]
    for tree in trees[1:]:
        wrapper = align(wrapper, tree)
    return json.dumps(to_json(wrapper), separators=(",", ":"))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from all pages (host, html); copies of a page count once."""
    partial = cut(skeletons(different(pages)), "skeletons")
    # equal structures of all tasks together, text by text: no group is gathered anywhere
    texts = partial.select("host", "skeleton", "pages", F.posexplode_outer(
        F.arrays_zip("constants", "chars")).alias("at", "text"))
    each = texts.groupBy("host", "skeleton", "at").agg(
        F.sum("pages").alias("pages"), F.sum("text.chars").alias("chars"),
        F.min("text.constants").alias("low"), F.max("text.constants").alias("high"),
        F.count_if(F.col("text.constants").isNull()).alias("open"))
    constant = F.when((F.col("open") == 0) & (F.col("low") == F.col("high")), F.col("low"))
    whole = each.groupBy("host", "skeleton").agg(
        F.max("pages").alias("pages"),
        F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", constant.alias("constant"), "chars")))).alias("texts"))

    def as_wrapper(batches):
        for batch in batches:
            out = []
            for skeleton, pages_, found in zip(*(c.to_pylist() for c in batch.columns[1:])):
                tree = page_of(skeleton, [t["constant"] for t in found], [t["chars"] for t in found], pages_)
                out.append(json.dumps(to_json(tree), separators=(",", ":")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["host", "wrapper"])

    def together(group: pa.Table) -> pa.Table:
        return pa.table({"host": group["host"][:1], "wrapper": pa.array([_aligned(group["wrapper"].to_pylist())])})

    single = whole.select("host", "skeleton", "pages", "texts").mapInArrow(as_wrapper, "host string, wrapper string")
    single = cut(single, "single")
    most = single.groupBy("host").count().agg(F.max("count")).head()[0] or 0
    while most > PARTIAL:
        part = F.pmod(F.xxhash64("wrapper"), F.lit(-(-most // PARTIAL)))
        single = cut(single.groupBy("host", part.alias("part")).applyInArrow(
            lambda key, group: together(group), "host string, wrapper string"), "single")
        most = single.groupBy("host").count().agg(F.max("count")).head()[0]
    return cut(single.groupBy("host").applyInArrow(together, "host string, wrapper string"), "wrappers")


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
            html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Pages with a null or hostless url form a host of their own. A null or empty html, and a page without main
    text, gives an empty text. Rows repeated with their id give a row each; other columns are not read.
    An empty table gives an empty result."""
    spark = pages.sparkSession
    bounded_batches(spark)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_column).cast("string"), F.lit("")), HOST, 1))
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), host.alias("host"),
                        text_or_empty(html_column).alias("html"))
    learnt = wrappers(rows)
    size = learnt.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host") + 64)).head()[0] or 0
    met = rows.join(F.broadcast(learnt) if size <= BROADCAST_BYTES else learnt, "host", "left")

    def run(batches):
        known: dict[tuple[str, str], tuple[Node, set[int], dict]] = {}
        for batch in batches:
            texts = []
            for host_, page, wrapper in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                if len(known) > 2_000:
                    known.clear()
                if host_ not in known:
                    tree = from_json(json.loads(wrapper))
                    known[host_] = tree, main_texts(tree), {}
                tree, kept, choices = known[host_]
                folded = parse(page)
                found = list(leaves(folded))
                if folded.key not in choices:
                    if len(choices) > 5_000:
                        choices.clear()
                    choices[folded.key] = chosen_texts(tree, folded, kept)
                blocks = sorted(t for leaf, keep in zip(found, choices[folded.key]) if keep for t in leaf.texts)
                texts.append(" ".join(t for _, t in blocks))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return met.select("page_id", "url", "host", "html", "wrapper").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars bigint")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
