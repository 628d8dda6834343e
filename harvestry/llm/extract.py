"""Main text of web pages by minimum-cut labelling (operator 6).

A page is read once into blocks of text, each with its place in the element tree. A linear classifier turns a block's
length, punctuation, links and enclosing elements into the log odds of being content; its two costs become the capacities
of the block's edges to the terminals. Names of classes are one weak feature of it: no name outweighs a long paragraph. Blocks
that follow each other, and blocks of one container, are joined by edges that cost something to cut, more the closer they are
in the tree and the more alike their surroundings and their links. The minimum cut is the labelling of least cost; it separates
content from boilerplate. Blocks whose own evidence outweighs all their edges are settled first, which never changes the
minimum; maximum flow (Dinic's method) labels the rest.

Cases: a null or empty page has an empty text, and so has one without content. Unclosed tags, stray end tags, tags in
scripts, unbalanced quotes and truncated pages are read as far as they go. Rows are independent: repeated rows and null ids
are kept as they are. A page of any length is read whole; the work grows with its length. Empty input gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm.texts import pieces, small_batches

# The element names of HTML by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset("applet audio canvas embed iframe math noembed noframes noscript object script style svg template textarea title video xmp".split())
VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
FURNITURE = frozenset("aside button dialog dir fieldset footer form header menu nav optgroup option search select".split())
CONTENT = frozenset("article main".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article aside body button dialog div dl fieldset figure footer form header html main menu nav ol section table ul".split())
# Words in class, id and role that mark parts of a page.
FURNITURE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense alert announcement author-box banner bio breadcrumb breadcrumbs byline captcha combx comment comments commentlist complementary consent contentinfo cookie cookies "
    "copyright disclaimer discussion disqus donate dropdown extra flyout foot footer footnav gdpr head header hidden legal login masthead menu menubar message modal nav navbar navigation newsletter notice notification overlay pager "
    "pagination paywall popup promo promoted promotion rail reader reactions recommended register related replies reply respond sharing share shoutbox sidebar sidenav signin signup skip social sponsor sponsored "
    "subscribe subscription survey tags teaser teasers ticker toolbar topbar trending popular recent latest warning widget".split()
)
# Words among them that name a part of the article too, inside one or beside a word of content.
MIXED_WORDS = frozenset("header head text".split())
CONTENT_WORDS = frozenset("article articlebody body content entry main maincontent post story text".split())
STRONG_WORDS = frozenset("article articlebody entry post story".split())

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|[!?/][^>]*(?:>|\Z))""", re.S)
LOOSE = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*(?:>|\Z))", re.S)
NAMES = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD_BREAK = re.compile(r"[\s_]+|(?<=[a-z])(?=[A-Z])")
#: Weights of the classifier (log odds) and of the edges.
WEIGHTS = {"base": -2.0, "words": 1.0, "sentence": 1.0, "links": -5.0, "heading": 1.5, "inside": 2.0, "furniture": -4.0, "rights": -3.0, "named": 1.5, "wrapped": 0.5}
#: Edges of blocks that follow each other (in one container, or not) and of the next ones of a container of containers.
BESIDE, APART, CONTAINER = 3.0, 0.1, 2.0


class Element:
    __slots__ = ("tag", "parent", "names", "chars", "holds", "score", "settled")

    def __init__(self, tag: str, parent: int, names: str):
        self.tag, self.parent, self.names, self.chars, self.holds, self.score, self.settled = tag, parent, names, 0, False, 0.0, False


def read(html: str) -> tuple[list[Element], list[tuple[int, str, int]]]:
    """Elements, and blocks as (element, text, characters of it in links)."""
    elements, stack, blocks = [Element("", -1, "")], [0], []
    parts: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                blocks.append((stack[-1], text, linked))
            parts.clear()
        linked = 0

    def close(tags, within) -> None:
        """Close the innermost open element of these names, if nothing in within is nearer."""
        for i in range(len(stack) - 1, 0, -1):
            tag = elements[stack[i]].tag
            if tag in tags:
                del stack[i:]
                return
            if tag in within:
                return

    at, end, pattern = 0, len(html), TAG
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            parts.append(html[at:])
            break
        if lt > at:
            parts.append(html[at:lt])
            if in_link:
                linked += lt - at
        m = pattern.match(html, lt)
        if m is None and pattern is TAG and html[lt + 1 : lt + 2].isalpha() | (html[lt + 1 : lt + 2] == "/"):
            pattern = LOOSE  # a quote is never closed: from here on tags end at the next >
            m = pattern.match(html, lt)
        if m is None:
            if html[lt + 1 : lt + 2].isalpha():
                break  # a tag that is cut off
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = False
            elif tag in BLOCKS:
                flush()
                in_link = False
                close((tag,), () if tag in SCOPE else SCOPE)
            continue
        if tag in SKIPPED:
            if not m[3].endswith("/"):
                found = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = found.end() if found else end
            parts.append(" ")
            continue
        if tag == "a":
            in_link = True
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            flush()
            in_link = False
            if tag not in VOID:
                close(("p",), SCOPE)
                if tag in CLOSED_BY:
                    close(CLOSED_BY[tag], SCOPE - {tag})
                elif tag[0] == "h" and tag[1:].isdigit():
                    close(("h1", "h2", "h3", "h4", "h5", "h6"), SCOPE)
                elements.append(Element(tag, stack[-1], m[3]))
                stack.append(len(elements) - 1)
    flush()
    return elements, blocks


def judge(elements: list[Element], blocks: list[tuple[int, str, int]]) -> None:
    """Each element's share of the log odds of the blocks in it."""
    total = 0
    for e, text, _ in blocks:
        elements[e].chars += len(text)
        total += len(text)
    for e in reversed(elements[1:]):
        elements[e.parent].chars += e.chars
    # the largest article is the page's, if it has a good part of its text; what holds it is no furniture
    largest = max((e for e in elements[1:] if e.tag in CONTENT), key=lambda e: e.chars, default=None)
    if largest is not None and largest.chars > 0.25 * total:
        at = largest.parent
        while at >= 0:
            elements[at].holds = True
            at = elements[at].parent
    for e in elements[1:]:
        up = elements[e.parent]
        e.score, e.settled = up.score, up.settled
        if e.tag in ("html", "body", "head"):
            continue
        names, hidden = set(), False
        if e.names:
            for name, value in NAMES.findall(e.names):
                name, value = name.lower(), value.strip("\"'")
                if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                    hidden = True
                elif name in ("class", "id", "role"):
                    whole = [w.lower() for w in WORD_BREAK.split(value) if w]
                    names.update(whole)
                    names.update(x for w in whole for x in w.split("-"))
        most = e.holds or e.chars > 0.6 * total and e.tag not in FURNITURE
        in_article = up.score > 0
        if in_article or names & CONTENT_WORDS:
            names -= MIXED_WORDS
        whole_form = e.tag == "form" and (e.holds or e.chars > 0.6 * total)  # some pages are one form
        if hidden or e.tag in FURNITURE and not (e.tag == "header" and in_article) and not whole_form:
            e.score, e.settled = WEIGHTS["furniture"], True
        elif names & FURNITURE_WORDS and not most and not (e.tag in ("p", "h1", "h2") and not names & {"ad", "ads"} and in_article):
            e.score, e.settled = WEIGHTS["furniture"], True
        elif e.tag in CONTENT and not e.settled:
            e.score = WEIGHTS["inside"]
        elif names & CONTENT_WORDS and not e.settled:
            e.score = max(e.score, WEIGHTS["named" if names & STRONG_WORDS else "wrapped"])


def odds(e: Element, text: str, linked: int) -> float:
    """Log odds that a block is content."""
    w = WEIGHTS
    score = w["base"] + e.score + w["words"] * math.log1p(text.count(" ") + 1)
    if text[-1] in ".!?:;\"'”»)…。":
        score += w["sentence"]
    if linked:
        score += w["links"] * min(1.0, linked / len(text))
    if len(e.tag) == 2 and e.tag[0] == "h" and e.tag[1].isdigit():
        score += w["heading"]
    if ("©" in text or "all rights reserved" in text.lower()) and len(text) < 300:
        score += w["rights"]
    return score


def minimum_cut(score: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """For each node whether it is on the content side of the minimum cut; score is the log odds, edges cost their weight."""
    near: list[dict[int, float]] = [{} for _ in score]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    score, label = list(score), [None] * len(score)
    weight = [sum(n.values()) for n in near]
    ready = deque(range(len(score)))
    while ready:  # a node that outweighs its edges has its label in every minimum cut
        i = ready.popleft()
        if label[i] is None and abs(score[i]) > weight[i]:
            label[i] = score[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    score[j] += w if label[i] else -w
                    weight[j] -= w
                    ready.append(j)
    rest = [i for i, x in enumerate(label) if x is None]
    if rest:
        for i, inside in zip(rest, _flow(rest, score, near, label), strict=True):
            label[i] = inside
    return [bool(x) for x in label]


def _flow(rest: list[int], score: list[float], near: list[dict[int, float]], label: list) -> list[bool]:
    """Dinic's method between a source (content) and a sink over the nodes without a label."""
    n = len(rest)
    place = {i: k for k, i in enumerate(rest)}
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forward: float, back: float) -> None:
        out[a].append(len(to)), to.append(b), room.append(forward)
        out[b].append(len(to)), to.append(a), room.append(back)

    for i in rest:
        if score[i] > 0:
            edge(source, place[i], score[i], 0.0)
        else:
            edge(place[i], sink, -score[i], 0.0)
        for j, w in near[i].items():
            if label[j] is None and i < j:
                edge(place[i], place[j], w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                path, a = [], source
                continue
            while tried[a] < len(out[a]):
                e = out[a][tried[a]]
                if room[e] > 1e-12 and level[to[e]] == level[a] + 1:
                    break
                tried[a] += 1
            if tried[a] < len(out[a]):
                path.append(out[a][tried[a]])
                a = to[path[-1]]
            elif a == source:
                break
            else:
                e = path.pop()
                a = to[e ^ 1]
                tried[a] += 1


def smoothness(elements: list[Element], blocks: list[tuple[int, str, int]]) -> dict[tuple[int, int], float]:
    """Edges between blocks near each other, cheaper to cut the less alike their surroundings and their shares of links are."""

    def alike(i: int, j: int) -> float:
        (a, text, linked), (b, other, also) = blocks[i], blocks[j]
        return max(0.0, 1 - abs(elements[a].score - elements[b].score) / 2) * (1 - abs(linked / len(text) - also / len(other)))

    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, (e, _, _) in enumerate(blocks):
        up = elements[e].parent
        if i:
            before = blocks[i - 1][0]
            near = up == elements[before].parent or up == before or e == elements[before].parent
            edges[i - 1, i] = APART + (BESIDE * alike(i - 1, i) if near else 0.0)
        container = elements[up].parent if up > 0 else up
        if container in last and last[container] != i - 1:
            edges[last[container], i] = CONTAINER * alike(last[container], i)
        last[container] = i
    return edges


def main_text(html: str) -> str:
    """The content blocks of a page in page order, two newlines between them."""
    if not html:
        return ""
    elements, blocks = read(html)
    if not blocks:
        return ""
    judge(elements, blocks)
    score = [odds(elements[e], text, linked) for e, text, linked in blocks]
    inside = minimum_cut(score, smoothness(elements, blocks))
    return "\n\n".join(text for (_, text, _), keep in zip(blocks, inside, strict=True) if keep)


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        texts = [main_text(h or "") for h in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*b.schema.names[:-1], "text", "n_chars"])


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep, text, n_chars for each row of pages."""
    small_batches(pages.sparkSession)
    own = pages.select(*[F.col(k).alias(k) for k in keep], F.col(html).alias("__html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(_extractor, f"{fields}, text string, n_chars long")
