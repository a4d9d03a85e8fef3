"""Main text of web pages by site template removal.

Each element subtree is hashed together with its slot, which is the chain of tags and
classes that leads to it; of lists of links only the tags are hashed, so that menus with other
entries on each page recur too. Spark counts in how many distinct contents of a host each hash
occurs, and how much of a slot such recurring subtrees make up. Subtrees that recur in a slot
of recurring subtrees are the site's template and are deleted, along with elements that by
their tag or name are never part of an article. What is left gives the text, block by block.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoform.llm.common import join_groups_of, stage

#: HTML element classes of the public standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head nav header footer aside form script style noscript template iframe svg canvas object audio video select button menu dialog textarea title datalist noembed noframes input fieldset".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption tr tbody thead table ul ol dl".split())
CLOSED_BY_BLOCK = frozenset("p".split())
#: Neither inline nor the end of a paragraph.
WITHIN = frozenset("noscript template svg canvas object audio video button select option optgroup picture head body html map math".split())
#: Left out without breaking the line that they stand in.
UNSEEN = frozenset("script style noscript template link meta".split())
#: Words in class, id or role that mark what isn't the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar aside widget footer masthead topbar "
    "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments respond reply replies disqus "
    "pagination pager complementary contentinfo search".split()
)
#: Words by which a name only says what an element has or lacks.
ABOUT = frozenset("no has with without not is if".split())
#: Elements whose id is an anchor in the text.
ANCHORED = frozenset("section h1 h2 h3 h4 h5 h6 p".split())
#: Elements that tell where the article is.
LANDMARKS = frozenset("article main h1".split())
#: A subtree of so many links that make up this share of its text is a list of links.
LINKS, LINK_SHARE = 3, 0.8
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_START = re.compile(r"<(?:[a-zA-Z!?]|/[a-zA-Z])")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LAX_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))""", re.IGNORECASE)
_DIGITS = re.compile(r"[0-9]+")
_RAW_ENDS = {tag: re.compile(rf"</{tag}\b", re.IGNORECASE) for tag in RAW}
_REPEATED = frozenset("li dt dd tr td th option".split())


class Node:
    __slots__ = ("tag", "noise", "named", "parts", "digest", "main", "label", "slot", "chars", "large", "skeleton", "links", "linked", "bare")

    def __init__(self, tag: str, attributes: str):
        self.tag = self.label = tag
        self.parts: list = []
        self.digest = self.slot = self.chars = self.skeleton = self.links = self.linked = 0
        self.noise, self.main, self.large, self.named, self.bare = tag in NEVER, tag in ("article", "main"), False, False, False
        if attributes:
            for name, *values in _ATTRIBUTE.findall(attributes):
                value = "".join(values)
                kind = name.lower()
                self.named = self.named or (tag not in INLINE and tag not in ("body", "html", "article", "main") and not (kind == "id" and tag in ANCHORED) and any(map(_says_noise, value.split())))
                if kind == "role":
                    self.main = self.main or value == "main"
                else:
                    self.label += "." + _DIGITS.sub("", value)

    def is_link_list(self) -> bool:
        return self.links >= LINKS and self.linked >= LINK_SHARE * self.chars > 0


def _says_noise(name: str) -> bool:
    """Whether the first or the last word of a class name marks noise; names such as
    "no-sidebar" say nothing."""
    words = [w.lower() for w in _NAME_WORDS.findall(name)]
    return bool(words) and (words[0] in NOISE or words[-1] in NOISE) and not ABOUT.intersection(words)


def parse(page: str) -> Node:
    """The element tree, in time that grows with the length of the page. An open paragraph
    ends where a block starts; an end tag closes up to the element that it names, or
    nothing; the rest closes at the end. After a tag whose quotes never close, every tag
    ends at its first ">"."""
    root = Node("#root", "")
    # of the open elements: all; places of those that aren't inline; how many by tag of those;
    # and, since each of those, how many inline ones by tag
    stack, blocks, opened, inline = [root], [0], {}, [{}]

    def close(place: int) -> None:
        while len(stack) > place:
            tag = stack.pop().tag
            if tag in INLINE:
                inline[-1][tag] -= 1
            else:
                inline.pop()
                blocks.pop()
                opened[tag] -= 1

    at, n, pattern = 0, len(page), _TAG
    while at < n:
        start = _START.search(page, at)
        if start is None:
            stack[-1].parts.append(page[at:])
            break
        here, kind = start.start(), page[start.start() + 1]
        if here > at:
            stack[-1].parts.append(page[at:here])
        if kind in "!?":
            comment = page.startswith("<!--", here)
            end = page.find("-->", here + 4) if comment else page.find(">", here)
            if end < 0:
                if not comment:
                    stack[-1].parts.append(page[here:])
                break
            at = end + (3 if comment else 1)
            continue
        m = pattern.match(page, here)
        if m is None and pattern is _TAG:
            pattern = _LAX_TAG
            m = pattern.match(page, here)
        if m is None:  # no ">" in the rest
            stack[-1].parts.append(page[here:])
            break
        at, tag = m.end(), m.group(2).lower()
        if m.group(1):
            if tag in INLINE:
                if inline[-1].get(tag):
                    while stack[-1].tag != tag:
                        close(len(stack) - 1)
                    close(len(stack) - 1)
            elif opened.get(tag):
                while stack[blocks[-1]].tag != tag:
                    close(blocks[-1])
                close(blocks[-1])
            continue
        if tag not in INLINE and tag not in VOID and tag not in RAW and tag not in WITHIN:
            top = stack[blocks[-1]].tag
            if top in CLOSED_BY_BLOCK or (tag == top and tag in _REPEATED):
                close(blocks[-1])
        node = Node(tag, m.group(3))
        stack[-1].parts.append(node)
        if tag in RAW:
            end = _RAW_ENDS[tag].search(page, at)
            node.parts.append(page[at : end.start() if end else n])
            shut = page.find(">", end.start()) if end else -1
            at = shut + 1 if shut >= 0 else n
        elif tag not in VOID and not m.group(3).endswith("/"):
            if tag in INLINE:
                inline[-1][tag] = inline[-1].get(tag, 0) + 1
            else:
                blocks.append(len(stack))
                opened[tag] = opened.get(tag, 0) + 1
                inline.append({})
            stack.append(node)
    return root


def seal(node: Node) -> int:
    """Fill in what is known of each subtree, without recursion: its hash (its tag, its text
    and its children's hashes), the hash of its skeleton (tags alone, equal neighbours once),
    its slot, its number of characters and of links (of itself, without noise), and whether it
    is large: half of the page's text, or prose that stands in an element whose own prose is
    half of it. A div is bare if it has text outside of any prose element, less than a quarter
    of the page's, where most of the page's text is prose.

    An element whose name says noise isn't noise if it holds at least half of the page's text
    and each landmark (article, main or h1 with text) that the page has.
    """
    order, todo = [], [node]
    while todo:
        x = todo.pop()
        order.append(x)
        for p in x.parts:
            if isinstance(p, Node):
                p.slot = xxhash.xxh64_intdigest(p.label, x.slot)
                todo.append(p)
    if any(x.named for x in order):
        _clear_names(order)
    own = {}
    for x in reversed(order):
        h, chars, prose, last = xxhash.xxh64(x.tag), 0, 0, 0
        shape = xxhash.xxh64(x.tag)
        for p in x.parts:
            if isinstance(p, Node):
                h.update(p.digest.to_bytes(8, "little", signed=True))
                if p.skeleton != last:
                    last = p.skeleton
                    shape.update(last.to_bytes(8, "little"))
                if not p.noise:
                    chars += p.chars
                    x.links += p.links
                    x.linked += p.linked
                    if p.tag in PROSE:
                        prose += p.chars
            else:
                words = p.split()
                h.update(" ".join(words))
                chars += sum(map(len, words))
            h.update(b"\0")
        if x.tag == "a":
            x.links, x.linked = 1, chars
        x.digest, x.chars, x.skeleton = h.intdigest() - (1 << 63), chars, shape.intdigest()
        own[id(x)] = prose
        x.bare = 0 < chars and x.tag == "div" and not any(isinstance(p, Node) and p.tag not in INLINE and p.chars for p in x.parts)
    in_prose = sum(own[id(x)] for x in order if x.tag not in PROSE)
    for x in order:
        x.bare = x.bare and 2 * in_prose >= node.chars and 4 * x.chars < node.chars
        holder = 2 * own[id(x)] >= node.chars
        for p in x.parts:
            if isinstance(p, Node):
                p.large = 2 * p.chars >= node.chars or (holder and p.tag in PROSE)
    return node.digest


def _clear_names(order: list[Node]) -> None:
    """Turn names into noise; ``order`` has parents before children."""
    held: dict[int, tuple[int, int]] = {}
    for x in reversed(order):
        chars = marks = 0
        for p in x.parts:
            if isinstance(p, str):
                chars += len("".join(p.split()))
            elif p.tag not in NEVER:
                chars += held[id(p)][0]
                marks += held[id(p)][1]
        held[id(x)] = chars, marks + (chars > 0 and (x.main or x.tag in LANDMARKS))
    chars, marks = held[id(order[0])]
    for x in order:
        if x.named:
            x.noise = x.noise or not (0 < chars <= 2 * held[id(x)][0] and held[id(x)][1] == marks)


def _may_be_template(x: Node, inside: bool) -> bool:
    """Block elements; in a marked article those that aren't prose."""
    return x.tag not in INLINE and x.tag not in VOID and not (inside and x.tag in PROSE) and not x.main and x.tag not in ("html", "body", "#root")


#: Lists of links and bare blocks have slots of their own.
LISTS, BARE = 0x5DEECE66D, 0x27D4EB2F165667C5


def _keys_of(x: Node, inside: bool) -> list[tuple[int, int, bool]]:
    """(slot, key, large) of a subtree; a key is its hash and slot in one number. A list of
    links is known by its skeleton, as a menu's entries may differ from page to page. A bare
    block outside of a marked article is known by its text and, as adverts and notices may
    differ too, by being bare, which must recur like a large subtree to count."""
    if x.is_link_list():
        return [(_signed(x.slot ^ LISTS), _mixed(_signed(x.skeleton), x.slot ^ LISTS), x.large)]
    own = [(_signed(x.slot), _mixed(x.digest, x.slot), x.large)]
    return own + [(_signed(x.slot ^ BARE), _mixed(0, x.slot ^ BARE), True)] if x.bare and not inside else own


def subtrees(root: Node) -> set[tuple[int, int, bool]]:
    """(slot, key, large) of the subtrees that may be template; a key is a slot and a hash."""
    out, todo = set(), [(root, False)]
    while todo:
        x, inside = todo.pop()
        inside = inside or x.main
        for p in x.parts:
            if isinstance(p, Node):
                if _may_be_template(p, inside):
                    out.update(_keys_of(p, inside))
                todo.append((p, inside))
    return out


def _signed(h: int) -> int:
    return h - (1 << 63)


def _mixed(a: int, b: int) -> int:
    """Two hashes in one signed 64-bit number."""
    return _signed((a ^ b) * 0x9E3779B97F4A7C15 + b & (1 << 64) - 1)


#: Stands in a host's template for the host itself: it has one.
KNOWN = 0


def article(root: Node, template: set[int], host: int = 0) -> str:
    """The text of the page without noise and without ``template`` (keys on the host).

    On a host without a template only the marked article or main part counts, if the page
    has one. Prose inside a marked part is never template, nor is a container of prose or of
    half of the part's text. A page isn't left empty by its template.
    """
    starts = [root] if _mixed(KNOWN, host) in template else _marked(root) or [root]
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        line.clear()
        if text:
            blocks.append(text)

    held: dict[int, tuple[int, bool]] = {}
    for start in starts:
        todo: list = [(start, start if start.main else None)]
        while todo:
            x, inside = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            elif (x.noise and x is not start) or (template and _is_template(x, inside is not None, template, host) and not (inside is not None and _holds_prose(x, inside, held))):
                if x.tag not in INLINE and x.tag not in UNSEEN:
                    flush()
            else:
                if x.main and inside is None:
                    inside, held = x, {}
                if x.tag in ("br", "hr") or x.tag not in INLINE:
                    flush()
                    todo.append((None, inside))
                todo += [(p, inside) for p in reversed(x.parts)]
        flush()
    if template and not blocks:
        return article(root, set(), host)
    return "\n".join(blocks)


def _holds_prose(x: Node, start: Node, held: dict[int, tuple[int, bool]]) -> bool:
    """Whether ``x`` has an element of prose with text, or half of the text of ``start``.
    ``held`` keeps length of text and presence of prose of each node, found at first use."""
    if not held:
        order, todo = [], [start]
        while todo:
            y = todo.pop()
            order.append(y)
            todo += [p for p in y.parts if isinstance(p, Node) and not p.noise]
        for y in reversed(order):
            n, prose = 0, False
            for p in y.parts:
                if isinstance(p, str):
                    n += len("".join(p.split()))
                elif not p.noise:
                    n += held[id(p)][0]
                    prose = prose or held[id(p)][1]
            held[id(y)] = n, prose or (n > 0 and y.tag in PROSE)
    n, prose = held[id(x)]
    return prose or (n > 0 and 2 * n >= held[id(start)][0])


def _is_template(x: Node, inside: bool, template: set[int], host: int) -> bool:
    return _may_be_template(x, inside) and any(_mixed(key, host) in template for _, key, _ in _keys_of(x, inside))


def _marked(root: Node) -> list[Node]:
    """The outermost article or main elements; an article inside main is preferred."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.main and x is not root:
            out += _articles(x) or [x]
            continue
        todo += [p for p in reversed(x.parts) if isinstance(p, Node) and not p.noise]
    return out


def _articles(x: Node) -> list[Node]:
    out, todo = [], [p for p in reversed(x.parts) if isinstance(p, Node) and not p.noise] if x.tag != "article" else []
    while todo:
        y = todo.pop()
        if y.tag == "article":
            out.append(y)
        else:
            todo += [p for p in reversed(y.parts) if isinstance(p, Node) and not p.noise]
    return out


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))


RESULT = "page_id long, url string, text string, n_chars long"


#: The subtrees of a host with more contents are joined in parts of so many contents.
PART = 1_000


def main_text(pages: DataFrame, least_pages: int = 3, most_hashes: int = 1_000_000, least_share: float = 0.01, least_share_large: float = 0.5) -> DataFrame:
    """page_id, url, text and n_chars of each page.

    A page's content is its text with the template, so copies of an article count once. A
    subtree recurs on a host if it stands in ``least_pages`` of its distinct contents and in
    ``least_share`` of them, or ``least_share_large`` if it mostly is large (see ``seal``).
    It is template if, besides, at least half of what stands in its slot recurs: a passage
    that some articles share stands among paragraphs that don't, and stays. A host with fewer
    than ``least_pages`` distinct contents has no template.

    Hashes are counted by host in Spark. Up to ``most_hashes`` template hashes are broadcast
    (8 bytes each); more are joined to the pages, with the same result. Null html gives an
    empty text; a null or odd url counts as one host; null page_id stays null; repeated rows
    give a row each; an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.xxhash64(host_of(F.col("url"))).alias("host"), F.col("html").cast("string").alias("html"))
    # one row for a content's subtree, and one without a key for the content itself
    found = own.select("host", "html").mapInArrow(_keys, "host long, content long, slot long, key long, large boolean").distinct()
    counted = stage(found.groupBy("host", "slot", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if("large").alias("large")), "subtrees")
    contents = counted.where(F.col("key").isNull() & (F.col("n") >= least_pages)).select("host", F.col("n").alias("contents"))
    share = F.when(2 * F.col("large") < F.col("n"), least_share).otherwise(least_share_large)
    often = (F.col("n") >= least_pages) & (F.col("n") >= F.col("contents") * share)
    # a host has some ten subtrees a content: those of a large one are dealt to parts
    ranked = join_groups_of(counted.where("key is not null").withColumn("rid", F.col("key")), contents, "host", "contents", PART).drop("rid").withColumn("often", often)
    slots = ranked.groupBy("host", "slot").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("often"), F.col("n")).otherwise(0)).alias("recurring"))
    chosen = ranked.where("often").join(slots.where(2 * F.col("recurring") >= F.col("all")), ["host", "slot"]).select("host", "key")
    template = stage(_on_host(chosen.unionByName(contents.select("host", F.lit(KNOWN).cast("long").alias("key")))), "template")
    if template.count() > most_hashes:
        return _joined(own, template)
    keys = np.sort(np.fromiter((r["key"] for r in template.toLocalIterator()), np.int64))
    shared_keys = spark.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared_keys.value
        for batch in batches:
            yield _texts(batch, lambda own: own[np.searchsorted(keys, own, "right") > np.searchsorted(keys, own)])

    return own.mapInArrow(run, RESULT)


def _on_host(rows: DataFrame) -> DataFrame:
    """(key) of (host, key): both in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mixed = [_mixed(k, h) for h, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(mixed, pa.int64())], ["key"])

    return rows.select("host", "key").mapInArrow(run, "key long").distinct()


def _own_keys(root: Node, host: int) -> list[int]:
    """What the page asks its host's template for."""
    return [_mixed(KNOWN, host), *{_mixed(k, host) for _, k, _ in subtrees(root)}]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, content, slot, key, large) of each page's subtrees, and a row without a key for
    the page."""
    names, kinds = ["host", "content", "slot", "key", "large"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    for batch in batches:
        rows: list[tuple] = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root = parse(page or "")
            seal(root)
            content = _signed(xxhash.xxh64_intdigest(article(root, set())))
            rows.append((host, content, None, None, False))
            rows += [(host, content, *x) for x in subtrees(root)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names)


def _texts(batch: pa.RecordBatch, known) -> pa.RecordBatch:
    """The texts of a batch (page_id, url, host, html); ``known`` keeps the template's of an
    array of keys, or is None if the batch has them as its last column."""
    texts = []
    for i, (host, page) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
        root = parse(page or "")
        seal(root)
        mine = batch.column(4)[i].as_py() if known is None else known(np.array(_own_keys(root, host), np.int64)).tolist()
        texts.append(article(root, set(mine or ()), host))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


#: A key that many pages ask for is asked for in so many parts.
SALTS = 16


def _joined(own: DataFrame, template: DataFrame) -> DataFrame:
    """Texts of the pages, with the template keys among their own found by joins. A hot host's
    keys are on all of its pages, so the pages' keys are salted and the template repeated."""
    rows = stage(own.withColumn("rid", F.monotonically_increasing_id()), "pages")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, found = [], []
            for rid, host, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                root = parse(page or "")
                seal(root)
                mine = _own_keys(root, host)
                found += mine
                rids += [rid] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(found, pa.int64())], ["rid", "key"])

    asked = rows.select("rid", "host", "html").mapInArrow(keys, "rid long, key long").withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int"))
    repeated = template.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hits = stage(asked.join(repeated, ["key", "salt"]).select("rid", "key"), "template-hits")
    listed = hits.groupBy("rid").agg(F.collect_set("key").alias("keys"))  # at most a page's subtrees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _texts(batch, None)

    return rows.join(listed, "rid", "left").select("page_id", "url", "host", "html", "keys").mapInArrow(run, RESULT)
