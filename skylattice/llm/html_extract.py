"""Main text of web pages by a site style tree.

The pages of a host are merged into one style tree: a node is a path of elements (tag, classes, id and role, digits
dropped), containers also by their place in the sequence of containers that they are in; copies of a page count once.
Two entropies over the pages of a host make up a node's importance: of its presentation (the sequence of child
elements) and of its content (how many pages each of its blocks is spread over). A block that comes back on page after
page has little content; a menu, an advert or a footer has the same presentation on all pages even if its links and
words differ, while articles differ in theirs. With few pages the entropies say little, and the importance is drawn
towards 1 by as much as EVIDENCE pages weigh. A page loses every branch whose importance is small beside the mean of
its text.

What an element's tag, class or role says of it is a prior: menus, adverts, forms and the like weigh far less, and
`article` and `main` more if they carry the page. A branch that is named like a form or a notice but outweighs all other
text is kept, and so is running text inside an article whose name may as well be that of a part of a text.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from functools import wraps
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.common import checkpoint, small_batches

#: A tag with its attributes; quotes count only behind `=`, and nothing is tried twice, so the time is linear.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
#: The same where a quote was never closed before: the tag ends at the next `>`.
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?+")
DIGITS = re.compile(r"\d+")
#: Elements that hold text of their own block; the rest is inline. Fixed values of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup and no text of the page, and those whose content is markup without shown text.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
MUTE = frozenset("noscript template svg select button datalist".split())
#: What an opening tag closes, up to the element named by its scope.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_PARAGRAPH = BLOCKS - frozenset("body caption head html legend optgroup option tbody td tfoot th thead tr".split())
#: Elements and roles that are no main text, those of the text itself (their classes and ids are anchors and sections),
#: and containers, which are the branches that the entropies can remove.
SIDE_TAGS = frozenset("nav aside footer header form head dialog menu fieldset search".split())
NAMED_FREELY = frozenset("html body article main section p h1 h2 h3 h4 h5 h6".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert toolbar".split())
CONTAINERS = frozenset("div section ul ol dl table center aside form header footer nav details figure fieldset".split())
#: Words of classes and ids, alone or before or behind a word of structure. Those of the second kind also name parts of a
#: text: inside `article` or `main` an element so named that holds running text is text.
SIDE_WORDS = r"ads?|advert|adverts|advertisement|advertising|adsense|adslot|banner|promo|promos|promotion|sponsor|sponsored|sponsors|nav|navbar|navigation|menu|menus|breadcrumbs?|sidebar|masthead|cookies?|consent|gdpr|notice|notification|popup|modal|overlay|newsletter|subscribe|subscription|signup|toolbar|pagination|pager|login|skip|widget|widgets"
TEXT_WORDS = r"side|header|footer|alert|share|sharing|social|related|recommended|recommendations|search|copyright|legal|teasers?|cards?"
READER_WORDS = r"comments?|commentlist|disqus|replies|reply|respond"
STRUCTURE = r"box|bar|block|section|area|wrap|wrapper|container|list|links?|buttons?|form|unit|slot|item|thread|inner|outer|main|top|bottom|left|right|main|site|page|global|primary|secondary|mobile|link"


def _named(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|\s)(?:(?:{STRUCTURE})[-_]+)*(?:{words})(?:[-_]+(?:{STRUCTURE}|{words}))*[-_]*(?=\s|$)")


SIDE_NAMES, TEXT_NAMES, READERS = _named(SIDE_WORDS), _named(TEXT_WORDS), _named(READER_WORDS)
#: Priors: of elements that are named as no main text, of navigation and readers' comments (never main text), and of
#: what lies outside of the articles if they carry the page, or of articles if they don't.
NAMED, NEVER, BESIDE = 0.15, 0.01, 0.3
#: Importance beside the page's mean below which a branch goes; pages that the first guess of 1 weighs as much as; what
#: remains if all is alike.
LOW, EVIDENCE, FLOOR = 0.5, 2.0, 0.05
#: A block that is running text has this many words; a branch that outvotes its name has blocks and words of them.
RUNNING, RUNNING_BLOCKS, RUNNING_WORDS = 10, 2, 40
#: Rows of the tree that are broadcast: those of the nodes with most pages; the rest is joined to the pages that need it.
BROADCAST_ROWS = 100_000


class Node:
    """An element of a page. parts: its child elements, whose signs are its presentation. The rest is for `extract`."""

    __slots__ = ("article", "best", "boxed", "content", "flows", "inside", "key", "kind", "least", "named", "own", "parent", "parts", "prior", "runs", "score", "sign", "style", "weak", "words")

    def __init__(self, sign: str, parent: Node | None, prior: float, weak: bool, kind: str):
        self.sign, self.parent, self.prior, self.weak, self.kind, self.key, self.parts = sign, parent, prior, weak, kind, 0, ()

    @property
    def children(self) -> list[str]:
        return [y.sign for y in self.parts]


def _undisturbed(f: Callable) -> Callable:
    """Without the collector of cycles, which looks at all elements of a large page again and again while they are made."""

    @wraps(f)
    def run(*args):
        on = gc.isenabled()
        gc.disable()
        try:
            return f(*args)
        finally:
            if on:
                gc.enable()

    return run


_signs: dict[tuple[str, str], tuple[str, float, bool]] = {}


def _sign(tag: str, attributes: str) -> tuple[str, float, bool]:
    """The element as the style tree names it, the prior that its tag, name and role give it, and whether the name alone
    does so and may as well name a part of a text."""
    by_tag = NEVER if tag in ("nav", "head", "menu") else NAMED if tag in SIDE_TAGS else 1.0
    if not attributes or attributes.isspace():
        return tag, by_tag, False
    if (known := _signs.get((tag, attributes))) is not None:
        return known
    found: dict[str, str] = {}
    for k, v in ATTRIBUTE.findall(attributes):
        found.setdefault(k.lower(), v.strip("\"'") if v[:1] in "\"'" else v)
    name = DIGITS.sub("", " ".join(found[k] for k in ("class", "id") if k in found)).lower()
    role = found.get("role", "").lower()
    style = found.get("style", "").replace(" ", "").lower()
    prior, weak = by_tag, False
    free = tag in NAMED_FREELY
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        prior = 0.0
    elif READERS.search(name) and (not free or tag in ("article", "main", "section")):
        prior = NEVER
    elif role in ("navigation", "menu", "menubar"):
        prior = NEVER
    elif role in SIDE_ROLES or (SIDE_NAMES.search(name) and not free) or (tag == "article" and re.search(r"\b(?:related|teasers?|promo|ad|cards?)\b", name)):
        prior = min(prior, NAMED)
    elif TEXT_NAMES.search(name) and not free:
        weak, prior = prior == 1.0, min(prior, NAMED)
    out = (f"{tag}.{'.'.join(sorted(name.split()))}" + (f"[{role}]" if role else ""), prior, weak)
    if len(_signs) > 50_000:
        _signs.clear()
    if len(attributes) < 2000:
        _signs[(tag, attributes)] = out
    return out


def parse(html: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The page's elements, parents first, each with the key of its node in the style tree, and its blocks in page order
    with the element of each.

    As browsers do, a tag ends at the first `>` outside of a quoted value. A page with a quote that never closes is read
    on with tags that end at the next `>`. The time is linear in the page's length.
    """
    root = Node("", None, 1.0, False, "")
    order: list[Node] = []
    stack: list[tuple[str, Node]] = [("", root)]
    blocks: list[tuple[Node, str]] = []
    held: list[str] = []
    last_end: dict[str, int] = {}
    open_tags: dict[str, int] = {}
    muted = 0
    tag_at = TAG
    lower = None

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                blocks.append((stack[-1][1], text))
            held.clear()

    def pop_to(i: int) -> None:
        nonlocal muted
        for t, _ in stack[i:]:
            open_tags[t] -= 1
            muted -= t in MUTE
        del stack[i:]

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not muted:
            held.append(html[at:lt])
        at = lt
        if at >= n:
            break
        following = html[at + 1 : at + 2]
        if following in ("!", "?"):
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                at = n if end < 0 else end + 3
            else:
                end = html.find(">", at)
                at = n if end < 0 else end + 1
            continue
        if not (following.isascii() and following.isalpha()) and following != "/":
            held.append("" if muted else "<")
            at += 1
            continue
        m = tag_at.match(html, at)
        if m is None and following == "/" and not html[at + 2 : at + 3].isalpha():
            end = html.find(">", at)  # </ and no name is a comment
            at = n if end < 0 else end + 1
            continue
        if m is None and tag_at is TAG:
            tag_at = LOOSE_TAG  # no tag ends from here on with quotes as they stand
            m = tag_at.match(html, at)
        if m is None:
            break  # a tag that never ends
        at = m.end()
        closing, tag, attributes = m.group(1), m.group(2).lower(), m.group(3)
        if tag in RAW:
            if not closing:
                if lower is None:
                    lower = html.lower()
                    if len(lower) != n:  # letters whose lower case is longer
                        lower = re.sub("[A-Z]", lambda x: x.group().lower(), html)
                end = lower.find(f"</{tag}", at)
                end = n if end < 0 else lower.find(">", end)
                at = n if end < 0 or end == n else end + 1
            if not muted:
                held.append(" ")
            continue
        if tag in MUTE:
            if closing:
                if open_tags.get(tag):
                    pop_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            elif not attributes.endswith("/"):
                if tag not in last_end:
                    if lower is None:
                        lower = html.lower()
                        if len(lower) != n:
                            lower = re.sub("[A-Z]", lambda x: x.group().lower(), html)
                    last_end[tag] = lower.rfind(f"</{tag}")
                if last_end[tag] >= at:  # one that is never closed hides nothing
                    stack.append((tag, stack[-1][1]))
                    open_tags[tag] = open_tags.get(tag, 0) + 1
                    muted += 1
            continue
        if tag not in BLOCKS:
            if tag in ("br", "img", "input") and not muted:
                held.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            if open_tags.get(tag):
                pop_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            continue
        for t in ("p", "head"):  # a block ends an open paragraph
            if open_tags.get(t) and (tag in ENDS_PARAGRAPH or tag == "body"):
                pop_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == t))
        if tag in CLOSES and any(open_tags.get(t) for t in CLOSES[tag][0]):
            closed, scope = CLOSES[tag]
            cut = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in scope:
                    break
                if stack[i][0] in closed:
                    cut = i
            if cut is not None:
                pop_to(cut)
        parent = stack[-1][1]
        sign, prior, weak = _sign(tag, attributes)
        if tag == "header" and prior == NAMED and (open_tags.get("article") or open_tags.get("main")):
            prior = 1.0  # the head of the article itself
        node = Node(sign, parent, prior, weak, tag)
        if parent.parts:
            parent.parts.append(node)
        else:
            parent.parts = [node]
        order.append(node)
        stack.append((tag, node))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    for x in (root, *order):
        if x.parts:
            boxes, place = " ".join([y.sign for y in x.parts if y.kind in CONTAINERS]), 0
            style = _key(boxes) if boxes else 0
            for y in x.parts:  # containers by their place among the element's containers, others by what they are
                if y.kind in CONTAINERS:
                    y.key = _key(f"{x.key}>{style}>{place}>{y.sign}")
                    place += 1
                else:
                    y.key = _key(f"{x.key}>{y.sign}")
    return order, blocks


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m.group(1).lower() if m else ""


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


@_undisturbed
def features(html: str) -> tuple[int, set[tuple[int, int, int]]]:
    """Digest of what follows, and (node, kind, hash): 0 for a block of the node, 1 for its sequence of child elements."""
    order, blocks = parse(html)
    out = {(b.key, 0, _key(t)) for b, t in blocks} | {(x.key, 1, _key(" ".join(x.children))) for x in order}
    return xxhash.xxh64_intdigest(np.array(sorted(out), np.int64).tobytes()) - (1 << 63), out


#: What a node that isn't in the tree has.
NOTHING = (None, None)


def _importance(order: list[Node], tree: dict[int, tuple[float | None, float | None]]) -> None:
    """Importance `own` of the text of each element.

    Its content is that of the least important container that it is in, where all text of a container counts by words. Its
    presentation is that of the most important one: what has the same form on all pages is text if it is in something
    that hasn't. Presentations are taken relative to the mean of the page, so that where no form differs between pages
    none loses by it.
    """
    for x in reversed(order):  # children before parents
        c = tree.get(x.key, NOTHING)[0]
        x.content += x.words * (1.0 if c is None else c)
        x.inside += x.words
        x.parent.content += x.content
        x.parent.inside += x.inside
        x.parent.flows |= x.flows
    total = weight = 0.0
    for x in order:  # parents before children
        up = x.parent
        box = x.kind in CONTAINERS
        x.style, x.own, x.boxed = up.style, up.own, up.boxed or box
        if box or x.kind in ("body", "article", "main"):
            form = tree.get(x.key, NOTHING)[1]
            x.style = max(x.style, FLOOR + (1 - FLOOR) * (1.0 if form is None else form))
        if box and x.inside:
            x.own = min(x.own, FLOOR + (1 - FLOOR) * x.content / x.inside)
        x.article = up.article or x.kind in ("article", "main") or x.sign.endswith("[main]")
        total += x.words * x.style
        weight += x.words
    mean = total / weight if weight else 1.0
    for x in order:
        if x.words and x.boxed:
            x.own *= min(1.0, x.style / mean)


@_undisturbed
def extract(html: str, tree: dict[int, tuple[float | None, float | None]]) -> str:
    """Main text of a page. tree: node -> importance of content and of presentation; what isn't listed has 1."""
    order, blocks = parse(html)
    root = order[0].parent if order else blocks[0][0] if blocks else Node("", None, 1.0, False, "")
    for x in (root, *order):
        x.words = x.runs = x.inside = 0
        x.content, x.flows, x.article, x.boxed, x.style, x.own, x.least, x.named = 0.0, False, False, False, FLOOR, 1.0, 1.0, None
    holders: list[Node] = []
    running: dict[int, int] = {}
    for x, t in blocks:
        if not x.words:
            holders.append(x)
        k = t.count(" ") + 1
        x.words += k
        if k >= RUNNING:
            x.runs, x.flows = x.runs + 1, True
            running[id(x)] = running.get(id(x), 0) + k
    _importance(order, tree)

    # names are believed unless a branch outweighs all text outside of named branches, and no article is elsewhere
    for x in order:  # a name that may be one of a text's parts isn't believed of running text in an article
        x.best = x.prior < 1 and not (x.weak and x.parent.article and x.flows)
        x.least = min(x.parent.least, x.prior if x.best else 1.0)
    lifted: set[int] = set()
    while True:
        named: dict[int, list[float]] = {}
        free = 0.0
        for x in order:
            x.named = x.parent.named or (x if x.best and x.key not in lifted else None)
        for x in holders:
            x.score = x.own if x.named is None else 0.0
            free += x.words * x.score
            if x.named is not None and x.least >= NAMED:
                s = named.setdefault(x.named.key, [0.0, 0, 0])
                s[0] += NAMED * x.words * x.own
                s[1] += x.runs
                s[2] += running.get(id(x), 0)
        best = max((k for k, s in named.items() if s[0] > free and s[1] >= RUNNING_BLOCKS and s[2] >= RUNNING_WORDS), key=lambda k: (named[k][0], k), default=None)
        if best is None or any(x.kind in ("article", "main") and x.prior == 1 and not _within(x, best) for x in order):
            break
        lifted.add(best)

    # articles and main elements: more than the rest if they carry the page, less if they are teasers beside it
    inside = sum(x.words * x.score for x in holders if x.article)
    outside = sum(x.words * x.score for x in holders if not x.article)
    if inside and outside:
        for x in holders:
            if x.article != (3 * inside >= outside):
                x.score *= BESIDE
    level = LOW * sum(x.words * x.score * x.score for x in holders) / (sum(x.words * x.score for x in holders) or 1.0)
    return "\n\n".join(t for x, t in blocks if x.score > 0 and x.score >= level)


def _within(x: Node | None, key: int) -> bool:
    while x is not None:
        if x.key == key:
            return True
        x = x.parent
    return False


def style_tree(spark: SparkSession, pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, node, pages, content, style: the nodes of two pages or more that aren't fully important, with how many
    different pages of the host have them."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, page, node, kind, value = [], [], [], [], []
            for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                digest, found = features(h or "")
                host += [_key(host_of(u))] * len(found)
                page += [digest] * len(found)
                for x, k, v in found:
                    node.append(x)
                    kind.append(k)
                    value.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.int64()), pa.array(page, pa.int64()), pa.array(node, pa.int64()), pa.array(kind, pa.int32()), pa.array(value, pa.int64())], ["host", "page", "node", "kind", "value"])

    seen = pages.select(F.col(f"`{url_col}`"), F.col(f"`{html_col}`")).mapInArrow(run, "host long, page long, node long, kind int, value long")
    # every aggregate combines before its shuffle, so that a host may hold a third of all pages
    spread = seen.groupBy("host", "node", "kind", "value", "page").agg(F.lit(1).alias("one")).groupBy("host", "node", "kind", "value").agg(F.count("*").alias("c"))
    sums = spread.groupBy("host", "node").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("c"))).alias(f"n{k}") for k in (0, 1)],
        *[F.sum(F.when(F.col("kind") == k, F.col("c") * F.ln("c"))).alias(f"s{k}") for k in (0, 1)],
    )
    # n1 is the number of pages that have the node
    plain = lambda k: 1 - F.col(f"s{k}") / (F.col(f"n{k}") * F.ln("n1"))
    part = lambda k: ((F.col("n1") * plain(k) + EVIDENCE) / (F.col("n1") + EVIDENCE)).alias(("content", "style")[k])
    return sums.where("n1 >= 2").select("host", "node", F.col("n1").alias("pages"), part(0), part(1)).where("content < 0.95 or style < 0.95")


def main_text(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null html is empty and gives an empty text. A null or odd url is a host of its own kind (the empty one). Rows are
    kept one for one, repeated ones too; an empty table gives an empty result; other columns aren't read.

    The nodes with most pages, `broadcast_rows` at most, are broadcast. What else a page needs is joined to it by its
    content: no key of that join has more pages than those nodes have.
    """
    small_batches(spark)
    tree = checkpoint(spark, style_tree(spark, pages, url_col, html_col))
    kept = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    schema = f"page_id {kept.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    by_host: dict[int, dict] = {}
    for r in tree.orderBy(F.desc("pages"), "host", "node").limit(broadcast_rows).collect():  # five numbers a row
        by_host.setdefault(r["host"], {})[r["node"]] = (r["content"], r["style"])
    shared = spark.sparkContext.broadcast(by_host)
    complete = tree.count() <= broadcast_rows

    def out(batch: pa.RecordBatch, own: list[dict]) -> pa.RecordBatch:
        texts = [extract(h or "", {**shared.value.get(_key(host_of(u)), {}), **more} if more else shared.value.get(_key(host_of(u)), {})) for u, h, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), own, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if complete:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield out(batch, [{}] * batch.num_rows)

        return kept.mapInArrow(run, schema)

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for u, h, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                host = _key(host_of(u))
                known = shared.value.get(host, {})
                rows += [{"a": a, "b": b, "host": host, "node": x.key} for x in parse(h or "")[0] if x.key not in known]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("host", pa.int64()), ("node", pa.int64())]))

    content = [F.xxhash64("url", "html").alias("a"), F.xxhash64(F.lit(1), F.col("html"), F.col("url")).alias("b")]
    wanted = kept.select("url", "html", *content).mapInArrow(needs, "a long, b long, host long, node long").distinct()
    more = wanted.join(tree.drop("pages"), ["host", "node"]).groupBy("a", "b").agg(F.collect_list(F.struct("node", "content", "style")).alias("tree"))  # nodes of one page
    joined = kept.select("*", *content).join(more, ["a", "b"], "left").select("page_id", "url", "html", "tree")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield out(batch, [{x["node"]: (x["content"], x["style"]) for x in t or []} for t in batch.column(3).to_pylist()])

    return joined.mapInArrow(run_joined, schema)
