"""Main text of web pages (operator 11), by site style trees.

Each page becomes a tree of its block elements (elements inside a line of text are transparent, unclosed ones are closed as
the standard implies). An element's way is its tag and its classes and id without digits, from the body down. The trees of
one host are merged: elements with the same way are one node, and so are runs of like siblings. Pages of a host that hold
exactly the same blocks count once. A node has

- presentation: how often which sequence of children stands under it. Its importance is the entropy of these sequences over
  the host's pages, to the base of their number: templates are alike on all pages, written content varies;
- content: the sentences that stand in it. Its importance is 1 less the mean entropy of its sentences over pages, again to
  the base of the number of pages: one that stands on one page alone has entropy 0, one that all pages share entropy 1.

A text's branch has the importance (1 - SHARE) * content + SHARE * presentation of the branch above it, and what the page's
names say counts as PRIOR pages more. It is computed in the host's tree and in the one that all hosts make together, which
knows templates that each host has few pages of; the lower value holds. Branches of importance below LEAST are removed from
each page. Nodes are keyed by hashes, and the tables of nodes are joined to pages by host and node:
no host's pages or nodes meet in one task.

Names settle what no statistics can, as readers' comments differ from page to page as articles do: of what the tree leaves,
elements for menus, footers, sidebars, dialogs and forms, headers outside the article, hidden elements, and classes, ids and
roles that say so, go with all that is in them (but not an element that holds the article itself or, of headers inside it,
the headings); what is left inside article or main stays. Both lists are below. Each page's row says how many texts went by
the tree, and how many by names alone.

What stays: texts block by block in page order, character references decoded, white space inside a block (that of Unicode,
<br> too) as one space, trimmed, joined by two line feeds. Nothing else is dropped or cut. Null and empty html, and pages of
nothing but branches that go, give an empty text; each row gives a row, also where page_ids repeat or are null; a null url
is a host of its own; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.html import INLINE, VOID, tokens
from lakeloom.llm.common import give_back, materialise

LEAST, SHARE, PRIOR = 0.65, 0.2, 5
#: What names say of a text that the statistics know nothing of: on a page without an article, beside one, and in a named
#: element.
ALONE, BESIDE, NAMED_SO = 1.0, 0.3, 0.1
#: Rows of the table of removed branches up to which it is broadcast, 16 bytes each.
SMALL = 500_000

# Elements and words that name what isn't the article.
_OTHER = frozenset("nav aside footer dialog menu button fieldset noscript object svg canvas video audio map".split())
_SILENT = frozenset("head title script style template select textarea iframe noembed noframes xmp".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc masthead topbar toolbar "
    "footer copyright legal sidebar aside rail widget widgets notice notices cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe subscription paywall comment comments disqus respond reply replies discussion "
    "share sharing social related recommended login signin signup search form hidden".split()
)
_ARTICLE = frozenset(("article", "main"))
#: Words that name an article element that isn't the article.
_REPLIES = frozenset("comment comments reply respond related".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Which start tags close which open elements.
_P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "optgroup": ("option optgroup", "select"), "tbody": ("tr td th thead tbody tfoot", "table"), "tfoot": ("tr td th thead tbody tfoot", "table")}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _CLOSES.items()}

_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[a-z]+")
_HOST = re.compile(r"(?:[^:/?#]*:)?//(?:[^/?#]*@)?([^/?#:]*)")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

#: Whether a text goes by its names, is kept whatever the statistics say, or is judged by them alone, on a page without or
#: with an article.
NAMED, KEPT, JUDGED, JUDGED_BESIDE = 0, 1, 2, 3
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\s[·|•]\s")


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - 2**63


class _Element:
    __slots__ = ("tag", "way", "named", "sure", "silent", "article", "heading", "header", "children", "blocks")

    def __init__(self, tag: str, attributes: dict[str, str], above: _Element | None):
        step, said, role, unseen = tag, set(), "", False
        if attributes:
            own = sorted({_DIGITS.sub("", c) for x in ("class", "id") for c in attributes.get(x, "").lower().split()})
            said = {w for c in own for w in _WORD.findall(c)}
            unseen = "hidden" in attributes or _UNSEEN.search(attributes.get("style", "")) is not None
            # all that names are read from is part of the way, so that a node has one kind of name
            step = ".".join([tag, *own, role := attributes.get("role", "").lower(), "hidden" * unseen])
        self.tag, self.way = tag, _hash(f"{above.way if above else ''}/{step}")
        # sure: by the element itself; named: by words, unless the article turns out to be inside
        self.sure = bool(above and above.sure) or tag in _OTHER or unseen
        self.silent = bool(above and above.silent) or tag in _SILENT
        self.named = tag == "form" or not said.isdisjoint(_REPLIES if tag in _ARTICLE else _WORDS) or role in _ROLES
        self.header = tag == "header" or "header" in said and tag not in _ARTICLE
        self.article = bool(above and above.article) or tag in _ARTICLE
        self.heading = bool(above and above.heading) or tag in _HEADINGS
        self.children: list[int] = []
        self.blocks: list[list] = []  # the texts in it, if it is named or a header


def parsed(html: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int]]]:
    """Of a page the texts (node, kind, text), and its nodes (node, the node above, hash of the children's sequence)."""
    body = _Element("body", {}, None)
    stack, watching = [body], []
    open_tags: Counter = Counter()
    nodes: list[tuple[_Element, _Element | None]] = [(body, None)]
    texts: list[list] = []  # node, goes, text, heading, in an article
    run: list[str] = []
    has_article = has_title = False

    def flush() -> None:
        at, text = stack[-1], " ".join("".join(run).split())
        run.clear()
        if text and not at.silent:
            texts.append([at.way, at.sure, text, at.heading, at.article])
            for e in watching:
                e.blocks.append(texts[-1])

    def pop() -> None:
        e = stack.pop()
        open_tags[e.tag] -= 1
        if watching and watching[-1] is e:
            # what its words say, now that all that is inside is known
            watching.pop()
            spared = e.header and stack[-1].article
            for text in e.blocks if e.named or e.header else ():
                text[1] |= not (spared and text[3])

    for kind, name, attributes in tokens(html):
        if kind == "text":
            run.append(name)
        elif name in INLINE:
            if name == "br":
                run.append(" ")
        elif name in VOID or name in ("html", "body"):
            flush()
        elif kind == "end":
            flush()
            if open_tags[name]:
                while stack[-1].tag != name:
                    pop()
                pop()
        else:
            flush()
            if name in _P_ENDS and stack[-1].tag == "p":
                pop()
            ends, within = _CLOSES.get(name, (frozenset(), frozenset()))
            if any(open_tags[x] for x in ends):
                i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag in within or stack[i].tag in ends or i == 0)
                if stack[i].tag in ends:
                    while len(stack) > i:
                        pop()
            made = _Element(name, attributes, stack[-1])
            first = not has_article and name in _ARTICLE or not has_article and not has_title and name == "h1"
            if first and not made.sure:  # what holds the article isn't beside it
                for e in [made, *watching]:
                    e.named = False
                has_title = True
            has_article |= name in _ARTICLE
            above = stack[-1]
            if not above.children or above.children[-1] != made.way:
                above.children.append(made.way)
            stack.append(made)
            open_tags[name] += 1
            if (made.named or made.header) and not made.sure:
                watching.append(made)
            nodes.append((made, above))
    flush()
    while len(stack) > 1:
        pop()
    judged = JUDGED_BESIDE if has_article else JUDGED
    out = [(way, NAMED if goes else KEPT if article else judged, text) for way, goes, text, _, article in texts]
    seen: dict[int, tuple[int, int]] = {}
    for e, above in nodes:
        seen.setdefault(e.way, (above.way if above else 0, _hash(",".join(map(str, e.children)))))
    return out, [(way, up, style) for way, (up, style) in seen.items()]


_PARSED = "row long, page_id {}, url string, host string, digest long, blocks array<struct<node: long, kind: int, features: array<long>, text: string>>, nodes array<struct<node: long, above: long, style: long>>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    made = TaskContext.get().partitionId() << 40
    block = pa.list_(pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("features", pa.list_(pa.int64())), ("text", pa.string())]))
    node = pa.list_(pa.struct([("node", pa.int64()), ("above", pa.int64()), ("style", pa.int64())]))
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            rows, hosts, digests, texts, nodes = [], [], [], [], []
            for url, html in zip(part.column(1), part.column(2)):
                said = _HOST.match(url.as_py() or "")
                found, tree = parsed(html.as_py() or "")
                found = [{"node": n, "kind": k, "features": [_hash(x) for x in _SENTENCE.split(t)] if k != KEPT else [_hash(t)], "text": t} for n, k, t in found]
                rows.append(made)
                made += 1
                hosts.append(said[1].lower() if said else "")
                digests.append(_hash(",".join(f"{b['node']} {b['features']}" for b in found)))
                texts.append(found)
                nodes.append([{"node": n, "above": a, "style": s} for n, a, s in tree])
            values = [pa.array(rows, pa.int64()), part.column(0), part.column(1), pa.array(hosts, pa.string()), pa.array(digests, pa.int64()), pa.array(texts, block), pa.array(nodes, node)]
            yield pa.RecordBatch.from_arrays(values, names=["row", "page_id", "url", "host", "digest", "blocks", "nodes"])
        del batch, part
        give_back()


def parse(pages: DataFrame) -> DataFrame:
    """Pages as texts and nodes, written in the shared folder."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return materialise(rows.mapInArrow(_parse, _PARSED.format(rows.schema["page_id"].dataType.simpleString())), "parsed")


def _entropy(n: Column, logs: Column, pages: Column) -> Column:
    """Of counts with sum n and sum of n * ln(n) logs, to the base of the number of pages; 0 where there is one page."""
    return F.when(pages <= 1, 0.0).otherwise(F.greatest(F.lit(0.0), (F.ln(n) - logs / n) / F.ln(pages)))


def importances(found: DataFrame) -> DataFrame:
    """(host, node, importance) of the nodes that hold texts other than the article's, from parsed pages."""
    judged = F.transform(F.filter("blocks", lambda b: b["kind"] != KEPT), lambda b: F.struct(b["node"].alias("node"), b["kind"].alias("kind"), b["features"].alias("features")))
    once = materialise(found.select("host", "digest", judged.alias("texts"), "nodes").dropDuplicates(["host", "digest"]), "pages-once")
    log = lambda c: F.col(c) * F.ln(c)

    # presentation: pages by sequence of children
    styles = once.select("host", F.explode("nodes").alias("x")).groupBy("host", "x.node", "x.above", "x.style").agg(F.count("*").alias("n"))
    styles = materialise(styles, "styles")
    # content: how often a sentence stands on a page, then over pages
    said = once.select("host", "digest", F.explode("texts").alias("x")).select("host", "digest", "x.node", "x.kind", F.explode("x.features").alias("feature"))
    prior = F.when(F.col("kind") == NAMED, NAMED_SO).when(F.col("kind") == JUDGED_BESIDE, BESIDE).otherwise(ALONE)
    texts = said.groupBy("host", "digest", "node", "feature").agg(F.count("*").alias("n"), F.min(prior).alias("prior"))
    texts = texts.groupBy("host", "node", "feature").agg(F.sum("n").alias("n"), F.sum(log("n")).alias("logs"), F.min("prior").alias("prior"))
    texts = materialise(texts, "features")

    def tree(host: Column) -> tuple[DataFrame, DataFrame]:
        by_style = styles.groupBy(host.alias("host"), "node", "above", "style").agg(F.sum("n").alias("n"))
        nodes = by_style.groupBy("host", "node", "above").agg(F.sum("n").alias("m"), F.sum(log("n")).alias("logs"))
        nodes = nodes.select("host", "node", "above", "m", _entropy(F.col("m"), F.col("logs"), F.col("m")).alias("presentation"))
        by_text = texts.groupBy(host.alias("host"), "node", "feature").agg(F.sum("n").alias("n"), F.sum("logs").alias("logs"), F.min("prior").alias("prior"))
        with_m = by_text.join(nodes.select("host", "node", "m"), ["host", "node"])
        content = with_m.groupBy("host", "node").agg((1 - F.avg(_entropy(F.col("n"), F.col("logs"), F.col("m")))).alias("content"), F.min("prior").alias("prior"))
        return nodes, content

    def valued(nodes: DataFrame, content: DataFrame) -> DataFrame:
        up = nodes.select("host", F.col("node").alias("above"), F.col("presentation").alias("branch"))
        joined = content.join(nodes, ["host", "node"]).join(up, ["host", "above"], "left")
        value = (1 - SHARE) * F.col("content") + SHARE * F.greatest(F.col("presentation"), F.coalesce("branch", F.lit(0.0)))
        m = F.when(F.col("m") > 1, F.col("m")).otherwise(0)  # one page alone says nothing
        return joined.select("host", "node", ((value * m + F.col("prior") * PRIOR) / (m + PRIOR)).alias("importance"))

    own = valued(*tree(F.col("host")))
    pooled = valued(*tree(F.lit("*"))).select("node", F.col("importance").alias("pooled"))
    return own.join(pooled, "node").select("host", "node", F.least("importance", "pooled").alias("importance"))


def extract(pages: DataFrame, *, small: int = SMALL) -> DataFrame:
    """(page_id, url, text, n_chars, n_tree, n_named) of each page."""
    found = parse(pages)
    removed = materialise(importances(found).filter(F.col("importance") < LEAST).select("host", "node"), "removed")
    if removed.count() <= small:
        by_host = F.broadcast(removed.groupBy("host").agg(F.collect_list("node").alias("gone")))
        marked = found.join(by_host, "host", "left")
    else:
        # pages' nodes without their texts meet the removed ones; a host's pages are no group here
        asked = found.select("row", "host", F.explode(F.array_distinct(F.transform("blocks", lambda b: b["node"]))).alias("node"))
        gone = asked.join(removed, ["host", "node"]).groupBy("row").agg(F.collect_set("node").alias("gone"))
        marked = found.join(gone, "row", "left")
    low = lambda b: (b["kind"] != KEPT) & F.coalesce(F.array_contains("gone", b["node"]), F.lit(False))
    stays = F.filter("blocks", lambda b: (b["kind"] != NAMED) & ~low(b))
    by_tree, by_name = F.size(F.filter("blocks", low)), F.size(F.filter("blocks", lambda b: (b["kind"] == NAMED) & ~low(b)))
    text = F.array_join(F.transform(stays, lambda b: b["text"]), "\n\n")
    found = marked.select("page_id", "url", text.alias("text"), by_tree.cast("long").alias("n_tree"), by_name.cast("long").alias("n_named"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_tree", "n_named")
