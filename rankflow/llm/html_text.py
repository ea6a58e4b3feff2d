"""Main text of web pages by tag-path ratios.

A page is read as a sequence of blocks: runs of text between block-level tags, each under the path of the elements around
it. Then

1. ratios: per path, text length and punctuation of all its blocks are summed up and divided by their number. Link text
   counts as none.
2. smoothing: both ratios of a block are averaged with those of its neighbours on the page, which count the more the
   more of its path they share.
3. fusing: the product of their logarithms, times the share of the path's text that is no link. A heading has the ratio of
   what it heads, if that is greater. Where a class, id or role says that an element is something else (an advert, a notice, reader
   comments), the ratio is lowered to a twentieth; it is still for the ratios to decide, and such a name does not count on a heading,
   nor where it stands around most of the page's text or around its largest <article> or <main>. Inside of that, it counts
   only for what falls short of the core by itself (readers' comments always do).
4. thresholds: paths whose best fused ratio is at least CORE of the page's best are its core. The content node is the
   innermost element around all of the core that is more than a piece of text itself, or the <article> or <main> that
   holds most of it. Inside it, each block is kept if its path's ratio reaches a share of the page's best: LEAST for
   elements that are made for text (paragraphs, headings, list items, cells, quotes), BOX for boxes of any use, whose path must hold some
   punctuation too, unless it comes first and may be the title, or the page has none at all. A box that lies between two blocks
   that are kept (code, verses) stays with them, unless it is named as something else or mostly links.

Only HTML itself bars text from taking part: nav, footer, aside, head, menu, dialog, button, label, fieldset, a header
outside of articles, what is hidden (by an attribute of that exact name, or its style), scripts and styles, and forms, except for one around most of
the page's text.

Pages may be cut off or badly nested, to any depth: every step is linear in the page. A script or the like that is not
closed ends where a page's text plainly begins again (the head's end, the body, an article, a paragraph, a heading).

Defined cases: null html is empty; a page without content gives empty text; a row gives a row, whatever ids repeat or
are missing; very long pages are read as a whole; equal ratios are all kept; an empty table gives an empty result; only
page_id, url and html are read, whatever other columns are called.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no markup; they are taken out as a whole.
_RAW = frozenset("script style noscript template iframe svg textarea select title".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<rest>(?:[^<>"']|"[^"<]*"|'[^'<]*')*+|[^<>]*)>"""
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^<>]*\Z"
    r"|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
#: Where the text of a page begins again after something that was not closed.
_AGAIN = re.compile(r"<(?:/head|body|article|main|p|h1)\b", re.IGNORECASE)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold the article's text, by what HTML means them for.
_OUTSIDE = frozenset("nav footer aside head menu dialog button label fieldset".split())
#: Parts of a class, id or role that speak for something else than the article.
_NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer disqus feedback footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification "
    "notices outbrain overlay pager pagination paywall popup promo promoted promotion recommended related replies reply search share sharing sidebar signin signup skip social sponsor sponsored sponsors subscribe subscription survey taboola tags toolbar tracking trending warning widget widgets".split()
)
#: Those of them that mark what readers wrote.
_READERS = frozenset("comment comments disqus feedback replies reply".split())
#: An attribute's name and value. Values are read over, so that no word inside of one is taken for a name.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_POINTS = re.compile("[.,;:!?…。，、！？؟।]")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose own names do not count.
_NAMELESS = _HEADINGS | {"html", "body", "article", "main"}
#: Elements made for text: a piece of an article, not an article.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 hgroup li dd dt pre blockquote figcaption td th caption".split())
_PIECES = _TEXT | frozenset("ul ol dl figure tr tbody thead tfoot table".split())
_CLOSES_P = _BLOCK - {"body", "html", "head"}
_CLOSED_BY_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: Shares of the page's best ratio: core paths; blocks of text elements, and of boxes, inside the content node. How a name lowers a ratio.
CORE, LEAST, BOX, NAME = 0.6, 0.07, 0.2, 0.05
#: Neighbours on each side that smoothing takes in.
REACH = 2


class _Node:
    """An element that is open or was. named: it, or the innermost element around it, whose name speaks against it."""

    __slots__ = ("article", "bad", "barred", "depth", "form", "key", "main", "mass", "named", "parent", "path", "readers", "resume", "tag")

    def __init__(self, parent: _Node | None, tag: str, path: int, barred: bool, key: tuple[str, frozenset[str]] | None):
        self.parent, self.tag, self.path, self.barred, self.key = parent, tag, path, barred, key
        self.named = self if key else parent.named if parent else None
        self.readers = bool(key and key[1] & _READERS) or bool(parent and parent.readers)
        self.mass, self.bad, self.resume = 0.0, False, None
        self.depth = parent.depth + 1 if parent else 1
        self.article = (parent.article if parent else None) or (self if tag == "article" else None)
        self.main = (parent.main if parent else None) or (self if tag == "main" else None)
        self.form = (parent.form if parent else None) or (self if tag == "form" else None)


class _Block:
    __slots__ = ("apart", "linked", "node", "parts", "plain", "text")

    def __init__(self, node: _Node, apart: int):
        #: apart: the depth of the innermost element around both this block and the one before.
        self.node, self.apart, self.parts, self.linked, self.text, self.plain = node, apart, [], 0, "", 0.0


def _marks(name: str, rest: str, in_article: bool) -> tuple[str, bool, frozenset[str]]:
    """The element's step in a path, whether HTML bars what is in it, and the words that speak against it. A heading's own name is its anchor and speaks for nothing."""
    step, barred, words = name, name in _OUTSIDE or (name == "header" and not in_article), set()
    for key, value in _ATTRIBUTE.findall(rest) if rest.strip(" /") else ():
        key = key.lower()
        value = value[1:-1] if value[:1] in ("'", '"') else value
        if key == "class":
            step += "." + ".".join(sorted(value.split()))
        if key in ("class", "id", "role"):
            if name not in _NAMELESS:
                words |= _NAMED.intersection(w.lower() for w in _WORD.findall(value))
        elif key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true") or (key == "style" and _UNSEEN.search(value)):
            barred = True
    return step, barred, frozenset(words)


def _raw_end(page: str, name: str, at: int, closed: dict[str, int]) -> int:
    """Where a raw element that opened before `at` ends."""
    if name not in closed:
        closed[name] = max((m.start() for m in re.finditer(rf"</{name}\s*>", page, re.IGNORECASE)), default=-1)
    if closed[name] >= at:
        return re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at).end()
    m = _AGAIN.search(page, at)
    return m.start() if m else len(page)


def blocks(page: str) -> list[_Block]:
    top = _Node(None, "", 0, False, None)
    paths: dict[tuple[int, str], int] = {}
    stack, open_names = [top], {}
    out: list[_Block] = []
    block: _Block | None = None
    lowest, link, at, closed = 1, 0, 0, {}

    def push(name: str, step: str, barred: bool, words: frozenset[str]) -> None:
        around = stack[-1]
        path = paths.setdefault((around.path, step), len(paths) + 1)
        stack.append(_Node(around, name, path, barred or around.barred, (step, words) if words else None))
        open_names[name] = open_names.get(name, 0) + 1

    def pop() -> str:
        nonlocal lowest
        gone = stack.pop()
        open_names[gone.tag] -= 1
        lowest = min(lowest, len(stack))
        return gone.tag

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m["name"]
        if name is None:
            piece = m[0]
            if piece[0] == "<" and piece != "<":
                continue
            if block is None:
                if not piece.strip():
                    continue
                block = _Block(stack[-1], lowest)
                lowest = len(stack)
                out.append(block)
            block.parts.append(piece)
            if link:
                block.linked += len(piece)
            continue
        name, closing = name.lower(), bool(m["end"])
        if name in _RAW:
            if not closing:
                at = _raw_end(page, name, at, closed)
            continue
        if name == "a":
            link = 0 if closing else 1
        if name == "br" and block is not None:
            block.parts.append(" ")
        if name not in _BLOCK:
            # Inline elements part no blocks; one that is hidden or named as something else has a path of its own, and the block
            # around a hidden one goes on behind it. Amid a text, only a whole name counts, not a part of one.
            if not closing and name not in _VOID and (m["rest"] or name in _OUTSIDE):
                step, barred, words = _marks(name, m["rest"], True)
                if barred or (words and (block is None or not words.isdisjoint(step.lower().split(".")))):
                    push(name, step, barred, words)
                    stack[-1].resume, block = block if barred else None, None
            elif closing and stack[-1].tag == name:
                block = stack[-1].resume
                pop()
            continue
        block, link = None, 0
        if closing:
            if open_names.get(name):
                while pop() != name:
                    pass
            continue
        if open_names.get("head") and name not in ("head", *_VOID):  # what is no part of a head ends it
            while pop() != "head":
                pass
        if name in _CLOSES_P:
            while len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag not in _BLOCK):
                pop()
        while len(stack) > 1 and stack[-1].tag in _CLOSED_BY_SELF.get(name, ()):
            pop()
        if name not in _VOID:
            push(name, *_marks(name, m["rest"], stack[-1].article is not None or stack[-1].main is not None))
    return out


def _around(node: _Node, depth: int) -> _Node:
    while node.depth > depth:
        node = node.parent
    return node


def _judge_names(free: list[_Block], largest: _Node | None) -> None:
    """Set `bad` of named nodes: whether their name, or one around it, speaks against what is in them.

    Elements of one step and one set of words count together; a name around over half of the text does not count, one for
    readers' comments only if around nine tenths, since comments may well be longer than the article. Inside of the
    largest <article> or <main>, names around that do not count; outside of it, all do.
    """
    nodes: dict[int, _Node] = {}
    for b in free:
        node = b.node.named
        if node:
            node.mass += b.plain
        while node and id(node) not in nodes:
            nodes[id(node)] = node
            node = node.parent.named if node.parent else None
    order = sorted(nodes.values(), key=lambda n: n.depth)
    for node in reversed(order):
        if up := node.parent.named:
            up.mass += node.mass
    # By step and words; an element inside one of its own kind is counted there.
    inner: dict[int, list[_Node]] = {}
    for node in order:
        inner.setdefault(id(node.parent.named), []).append(node)
    by_key: dict[tuple, float] = {}
    around: dict[tuple, int] = {}
    walk = [(n, True) for n in inner.get(id(None), ())]
    while walk:
        node, entering = walk.pop()
        if not entering:
            around[node.key] -= 1
            continue
        if not around.get(node.key):
            by_key[node.key] = by_key.get(node.key, 0.0) + node.mass
        around[node.key] = around.get(node.key, 0) + 1
        walk.append((node, False))
        walk.extend((n, True) for n in inner.get(id(node), ()))
    total = sum(b.plain for b in free)
    for node in order:
        up = node.parent.named
        inside = largest is not None and largest in (node.article, node.main)
        if inside and up and largest not in (up.article, up.main):
            up = None
        widest = total * (0.9 if node.key[1] & _READERS else 0.5)
        node.bad = by_key[node.key] <= widest or (largest is not None and not inside) or bool(up and up.bad)


def main_text(page: str) -> str:
    """The content's blocks, one a line."""
    found = []
    for b in blocks(page):
        text = " ".join(html.unescape("".join(b.parts)).split())
        if text and not b.node.barred:
            b.text = text
            b.plain = len(text) * max(0.0, 1 - b.linked / max(1, sum(map(len, b.parts))))
            found.append(b)
        elif found or not b.node.barred:
            b.text = ""
            found.append(b)  # kept for what lies between blocks; it takes no part
    # What two blocks that take part share, where others lie between them.
    kept, lowest = [], 1 << 60
    for b in found:
        lowest = min(lowest, b.apart)
        if b.text:
            b.apart, lowest = lowest, 1 << 60
            kept.append(b)
    total = sum(b.plain for b in kept)
    wide: dict[int, float] = {}
    for b in kept:
        if b.node.form:
            wide[id(b.node.form)] = wide.get(id(b.node.form), 0.0) + b.plain
    out_of_form = [b for b in kept if not b.node.form or wide[id(b.node.form)] > 0.5 * total]
    if len(out_of_form) < len(kept):
        free, lowest = [], 1 << 60
        stays = set(map(id, out_of_form))
        for b in kept:
            lowest = min(lowest, b.apart)
            if id(b) in stays:
                b.apart, lowest = lowest, 1 << 60
                free.append(b)
    else:
        free = kept
    if not free:
        return ""
    # The largest <article> or <main>: names around it do not count for what is in it.
    sizes, nodes = {}, {}
    for b in free:
        for own in (b.node.article, b.node.main):
            if own and not own.readers:
                sizes[id(own)] = sizes.get(id(own), 0.0) + b.plain
                nodes[id(own)] = own
    largest = nodes[max(sizes, key=sizes.get)] if sizes and max(sizes.values()) >= 0.25 * sum(b.plain for b in free) else None

    _judge_names(free, largest)

    def lowered(b: _Block) -> bool:
        named = b.node.named
        if named and largest is not None and largest in (b.node.article, b.node.main) and largest not in (named.article, named.main):
            return False
        return bool(named and named.bad)

    def of_largest(b: _Block) -> bool:
        """Whether a name inside the largest <article> or <main> speaks against it, other than its own or that of readers' comments."""
        return largest is not None and largest in (b.node.article, b.node.main) and not b.node.readers and b.node.tag in _TEXT and b.node.named is not b.node

    # Ratios of each path.
    sums: dict[int, list[float]] = {}
    for b in free:
        own = sums.setdefault(b.node.path, [0.0, 0.0, 0.0, 0])
        own[0] += 1
        own[3] += len(b.text)
        own[1] += b.plain
        own[2] += len(_POINTS.findall(b.text)) * b.plain / max(1, len(b.text))
    lengths = [sums[b.node.path][1] / sums[b.node.path][0] for b in free]
    points = [sums[b.node.path][2] / sums[b.node.path][0] for b in free]
    n = len(free)
    fused = []
    for i, b in enumerate(free):
        weight, length, point = 1.0, lengths[i], points[i]
        for step in (-1, 1):
            shared = b.node.depth
            for k in range(1, REACH + 1):
                j = i + step * k
                if not 0 <= j < n:
                    break
                shared = min(shared, free[j].node.depth, (free[j] if step > 0 else free[j + 1]).apart)
                w = math.exp(-k * k / 2) * shared / max(b.node.depth, free[j].node.depth)
                weight, length, point = weight + w, length + w * lengths[j], point + w * points[j]
        fused.append(math.log1p(length / weight) * math.log1p(1 + point / weight) * sums[b.node.path][1] / sums[b.node.path][3])
    # A name lowers the ratio; inside the largest <article> only of what falls short of the core by itself, without its neighbours.
    alone = [math.log1p(x) * math.log1p(1 + y) * sums[b.node.path][1] / sums[b.node.path][3] for b, x, y in zip(free, lengths, points, strict=True)]
    core_of_all = CORE * max((f for b, f in zip(free, alone, strict=True) if not lowered(b)), default=0.0)
    named_bad = [lowered(b) and not (of_largest(b) and f >= core_of_all) for b, f in zip(free, alone, strict=True)]
    for i in range(n - 2, -1, -1):  # a heading there goes with what it heads
        if named_bad[i] and free[i].node.tag in _HEADINGS and of_largest(free[i]) and free[i + 1].node.named is free[i].node.named:
            named_bad[i] = named_bad[i + 1]
    fused = [f * (NAME if bad else 1.0) for f, bad in zip(fused, named_bad, strict=True)]
    by_path: dict[tuple[int, bool], float] = {}
    key = [(b.node.path, bad) for b, bad in zip(free, named_bad, strict=True)]
    for k, f in zip(key, fused, strict=True):
        by_path[k] = max(f, by_path.get(k, 0.0))
    score = [by_path[k] for k in key]
    for i in range(n - 2, -1, -1):  # a heading has the ratio of what it heads
        if free[i].node.tag in _HEADINGS and not key[i][1] and free[i].plain > 0 and free[i + 1].apart >= free[i].node.depth - 1:
            score[i] = max(score[i], score[i + 1])
    best = max(score)
    if best <= 0:  # nothing but links
        return ""
    core = [i for i in range(n) if score[i] >= CORE * best]
    # The content node.
    first, last = free[core[0]], core[-1]
    depth = min([first.node.depth, *(free[i].apart for i in range(core[0] + 1, last + 1))])
    if len(core) == 1 and depth > 1:
        depth -= 1
    node = _around(first.node, depth)
    # A cell around several elements of the core is one of a page's layout, not of a table.
    layout = len(core) > 1 and all(free[i].node is not node for i in core)
    while node.depth > 1 and (node.tag in _PIECES or node.tag not in _BLOCK) and not (layout and node.tag == "td"):
        node = node.parent
    mass = sum(len(free[i].text) for i in core)
    for name in ("article", "main"):
        held: dict[int, float] = {}
        for i in core:
            if own := getattr(free[i].node, name):
                held[id(own)] = held.get(id(own), 0.0) + len(free[i].text)
                if held[id(own)] >= 0.5 * mass:
                    node = own
                    break
        else:
            continue
        break
    # Blocks inside it lie next to each other on the page: from the first to the last that it is around.
    start = stop = core[next(k for k, i in enumerate(core) if _around(free[i].node, node.depth) is node)]
    while start > 0 and free[start].apart >= node.depth:
        start -= 1
    while stop + 1 < n and free[stop + 1].apart >= node.depth:
        stop += 1
    pointed = any(points)
    kept_at = []
    for i in range(start, stop + 1):
        of_text = free[i].node.tag in _TEXT
        # Boxes without punctuation may be labels; not where no text has any, nor for the first, which may be the title.
        kept_at.append(score[i] >= (LEAST if of_text else BOX) * best and (of_text or points[i] > 0 or not pointed or not any(kept_at)))
    # A box between two blocks that are kept belongs to them, unless a name speaks against it or it is all links: code, verses, captions.
    for k in range(1, len(kept_at) - 1):
        if not kept_at[k] and kept_at[k - 1] and any(kept_at[k + 1 : k + 2 + REACH]) and not key[start + k][1] and free[start + k].plain > 0.5 * len(free[start + k].text):
            kept_at[k] = score[start + k] >= LEAST * best
    return "\n".join(free[start + k].text for k, keep in enumerate(kept_at) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return base.mapInArrow(run, "page_id long, url string, text string, n_chars long")
