"""A small element tree and selector engine on the standard library, for Arrow workers.

Selectors: tag, #id, .class, [attr], [attr=value], :nth-child(n), joined by descendant (space) and child (>); alternatives by
comma. Trees are forgiving: unclosed paragraphs and list items close where HTML closes them.
"""

from __future__ import annotations

import re
from hashlib import sha256
from html import escape, unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

# Elements without content, and what their start closes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"li": ("li",), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
P_ENDS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
UNSAFE = frozenset("script style iframe object embed form input button select textarea base link".split())
# Attributes that hold a URL, the schemes that a preview keeps, and what browsers leave out of a scheme.
URL_ATTRIBUTES = frozenset("action background cite data formaction href longdesc ping poster src srcset usemap xlink:href".split())
SAFE_SCHEMES = frozenset("http https mailto tel ftp".split())
NOT_IN_SCHEMES = re.compile(r"[\x00-\x20\x7f-\x9f\u200b-\u200f\ufeff]+")
SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
REFERENCE = re.compile(r"&#?[0-9A-Za-z]*\Z")
STEP = re.compile(r"\s*(>?)\s*([A-Za-z][\w-]*|\*)?((?:[#.][\w-]+|\[[^\]]+\]|:nth-child\(\d+\))*)")
SIMPLE = re.compile(r"([#.])([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]|:nth-child\((\d+)\)")


class Written(str):
    """Text as a page has it, its character references not decoded."""

    __slots__ = ()


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "place", "count")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children, self.place, self.count = tag, attrs, parent, [], 0, 0

    def elements(self):
        """All elements below, in document order; trees may be deeper than Python's stack."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            x = todo.pop()
            yield x
            todo += [c for c in reversed(x.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style"):
                todo += reversed(x.children)
        return " ".join("".join(out).split())

    def html(self, outer: bool = True) -> str:
        out: list[str] = []
        todo: list = [self] if outer and self.tag else list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):  # an end tag
                out.append(x[0])
            elif isinstance(x, Written):
                if out and isinstance(out[-1], Written) and (cut := REFERENCE.search(out[-1])):  # what was between is gone: no reference may arise
                    out[-1] = Written(out[-1][: cut.start()] + escape(unescape(cut[0]), quote=False))
                out.append(Written(x.replace("<", "&lt;").replace(">", "&gt;")))
            elif isinstance(x, str):
                out.append(escape(x, quote=False))
            else:
                out.append("<" + x.tag + "".join(f' {k}="{escape(v or "")}"' for k, v in x.attrs.items()) + ">")
                if x.tag not in VOID:
                    todo.append((f"</{x.tag}>",))
                    todo += reversed(x.children)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", {}, None)

    def _close(self, tags, stop=("table", "ul", "ol", "dl", "div", "body")) -> None:
        at = self.now
        while at.parent is not None:
            if at.tag in tags:
                self.now = at.parent
                return
            if at.tag in stop:
                return
            at = at.parent

    def handle_starttag(self, tag, attrs):
        if tag in P_ENDS:
            self._close(("p",))
        if tag in CLOSES:
            self._close(CLOSES[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.count += 1
        node.place = self.now.count
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        at = self.now
        while at.parent is not None and at.tag != tag:
            at = at.parent
        if at.parent is not None:
            self.now = at.parent

    def handle_data(self, data):
        self.now.children.append(data)


class _Keeper(_Builder):
    """Keeps texts as Written: the parser tells how far it has come after each."""

    def __init__(self):
        super().__init__()
        self.last: list | None = None

    def handle_data(self, data):
        super().handle_data(data)
        self.last = self.now.children

    def updatepos(self, i, j):
        if self.last is not None:
            self.last[-1], self.last = Written(self.rawdata[i:j]), None
        return super().updatepos(i, j)


def parse(text: str) -> Node:
    return _built(_Builder(), text)


def _built(b: _Builder, text: str) -> Node:
    b.feed(text or "")
    b.close()
    return b.root


def _matches(node: Node, tag: str | None, rest: str) -> bool:
    if tag and tag != "*" and node.tag != tag.lower():
        return False
    for kind, name, attr, value, nth in SIMPLE.findall(rest):
        if kind == "#" and node.attrs.get("id") != name or kind == "." and name not in node.attrs.get("class", "").split():
            return False
        if attr and (attr not in node.attrs or f"[{attr}]" not in rest.replace(" ", "") and node.attrs[attr] != value):
            return False
        if nth and node.place != int(nth):
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Elements below root that match, in document order."""
    out: dict[int, Node] = {}
    for one in selector.split(","):
        steps = [(m[1] == ">", m[2], m[3]) for m in STEP.finditer(one.strip()) if m[2] or m[3]]
        for node in root.elements():
            if steps and _fits(node, steps, root):
                out[id(node)] = node
    return [n for n in root.elements() if id(n) in out] if "," in selector else list(out.values())


def _fits(node: Node, steps: list, root: Node) -> bool:
    child, tag, rest = steps[-1]
    if not _matches(node, tag, rest):
        return False
    if len(steps) == 1:
        return not child or node.parent is root
    up = node.parent
    while up is not None and up is not root:
        if _fits(up, steps[:-1], root):
            return True
        if child:
            return False
        up = up.parent
    return False


def value(node: Node | None, source: str, base: str = "") -> str | None:
    """A node's value: text, inner_html, outer_html, attr:name, url:name (made absolute) or presence."""
    if source == "presence":
        return "true" if node is not None else "false"
    if node is None:
        return None
    if source == "text":
        return node.text()
    if source in ("inner_html", "outer_html"):
        return node.html(source == "outer_html")
    kind, _, name = source.partition(":")
    got = node.attrs.get(name)
    return urljoin(base, got) if kind == "url" and got is not None else got


def _runs(name: str, value: str) -> bool:
    """Whether an attribute's value may run code: white space and control characters do not count in a scheme, and few schemes are safe."""
    scheme = SCHEME.match(NOT_IN_SCHEMES.sub("", value))
    return scheme is not None and (name in URL_ATTRIBUTES or scheme[1].lower() in ("javascript", "vbscript", "data")) and scheme[1].lower() not in SAFE_SCHEMES


def sanitized(text: str) -> str:
    """HTML for a preview: no scripts, embeds, forms, handlers, refreshes or URLs that run; texts stay as they are written."""
    root = _built(_Keeper(), text)
    todo = [root]
    while todo:
        node = todo.pop()
        node.children = [c for c in node.children if not (isinstance(c, Node) and (c.tag in UNSAFE or c.tag == "meta" and "http-equiv" in c.attrs))]
        for c in node.children:
            if isinstance(c, Node):
                c.attrs = {k: v for k, v in c.attrs.items() if not k.startswith("on") and k not in ("srcdoc", "style") and not _runs(k, v or "")}
                todo.append(c)
    return root.html()


def node_ids(text: str) -> list[tuple[str, str, str]]:
    """(id, path, tag) of each element; ids follow from the path and do not change between runs."""
    out, todo = [], [(parse(text), "")]
    while todo:
        node, path = todo.pop()
        found = [(c, f"{path}/{c.tag}[{c.place}]") for c in node.children if isinstance(c, Node)]
        out += [(sha256(p.encode()).hexdigest()[:16], p, c.tag) for c, p in found]
        todo += found
    return sorted(out, key=lambda x: x[1])


def fingerprint(text: str) -> list[str]:
    """The distinct tag paths of a page, in order; of a very long path the beginning is a digest, so names stay short."""
    # a path's name follows from its parent's name, so that paths as deep as the page are made once each
    out, todo = set(), [(parse(text), "")]
    while todo:
        node, path = todo.pop()
        if len(path) > 4000:
            path = f"#{sha256(path.encode()).hexdigest()[:32]}"
        below: dict[str, list[Node]] = {}
        for x in node if isinstance(node, list) else [node]:
            for c in x.children:
                if isinstance(c, Node):
                    below.setdefault(f"{path}/{c.tag}", []).append(c)
        out.update(below)
        todo += [(nodes, name) for name, nodes in below.items()]
    return sorted(out)


def repeated(text: str) -> int:
    """The most siblings with one tag and class below one parent: many of them are a list of records."""
    most = 0
    for node in parse(text).elements():
        counts: dict[tuple, int] = {}
        for c in node.children:
            if isinstance(c, Node) and c.tag not in ("p", "br", "a", "script", "option"):
                k = c.tag, c.attrs.get("class", "")
                counts[k] = counts.get(k, 0) + 1
        most = max([most, *counts.values()])
    return most


def selector_rank(selector: str) -> int:
    """How stable a selector is: 1 id, 2 class, 3 data or aria attribute, 4 structure, 5 position."""
    if ":nth-child" in selector:
        return 5
    if "#" in selector:
        return 1
    if re.search(r"\[(data|aria)-", selector):
        return 3
    return 2 if re.search(r"\.[A-Za-z]", selector) else 4
