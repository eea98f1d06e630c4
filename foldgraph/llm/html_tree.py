"""A small HTML tree builder and a layout-aware text renderer (no Spark)."""

from __future__ import annotations

import re
from html import unescape

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style iframe noembed noframes xmp".split())
_RCDATA = frozenset("title textarea".split())
_HEAD = frozenset("base basefont bgsound link meta title script style template noscript".split())
_BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul xmp caption""".split())  # fmt: skip
_SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure listing xmp".split())
_HIDDEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas datalist area param source track".split())
_CLOSES_P = _BLOCK - frozenset("body html li dd dt tbody td tfoot th thead tr option optgroup caption legend summary".split())
#: A start tag ends these open elements first, as far up as the given borders.
_IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "caption", "colgroup"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
#: Parts of drawings and formulas that aren't drawn; parts of formulas that stand apart; HTML begins again in the third; HTML tags that end both.
_UNDRAWN = {"svg": frozenset("title desc defs metadata symbol marker pattern clippath mask filter lineargradient radialgradient".split()), "math": frozenset("annotation annotation-xml mphantom".split())}
_APART = frozenset("mfrac msub msup msubsup mmultiscripts mroot munder mover munderover mtable mtr mlabeledtr".split())
_HTML_AGAIN = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
_ENDS_FOREIGN = frozenset("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby
s small span strong strike sub sup table tt u ul var""".split())  # fmt: skip
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCOPE = frozenset("table td th caption html template button object".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?)""")
_SPACES = re.compile(r"[ \t\n\f\r]+")
_STYLE = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)", re.I)
#: Lists and cells nested deeper than this get no more indents and padding, which would grow with the square of the depth.
MAX_INDENT = 100


class Node:
    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: dict[str, str] | None = None):
        self.name, self.attributes, self.children = name, attributes or {}, []


def tokens(html: str, foreign=lambda: False):
    """``("text", s)``, ``("start", name, attributes, closed)`` and ``("end", name)`` in order; linear.

    ``foreign``: is the reader inside a drawing or formula, where ``/>`` ends an element?
    """
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", html[at:]
            return
        if lt > at:
            yield "text", html[at:lt]
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            if html.startswith(("<!-->", "<!--->"), lt):
                end = html.index(">", lt) - 2
            at = n if end < 0 else end + 3
            continue
        if html[lt + 1 : lt + 2] in ("!", "?") or (html.startswith("</", lt) and lt + 2 < n and not _NAME.match(html, lt + 2)):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        closing = html.startswith("</", lt)
        m = _NAME.match(html, lt + 1 + closing)
        if not m:
            yield "text", "<"
            at = lt + 1
            continue
        name, at, attributes = m[0].lower(), m.end(), {}
        while at < n and html[at] != ">":
            m = _ATTRIBUTE.match(html, at)
            if m and m.end() > at and m[1]:
                value = next((v for v in m.groups()[1:] if v is not None), "")
                attributes.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
                at = m.end()
                rest = html[at : at + 64].lstrip()
                if rest[:1] == "=" and rest[1:].lstrip()[:1] in ('"', "'"):
                    return  # a quote that is never closed takes the rest
            else:
                at += 1
        if at >= n:
            return  # a tag that is never closed is no tag
        closed, at = html[at - 1] == "/", at + 1
        if closing:
            yield "end", name
            continue
        whole = closed and foreign()
        yield "start", name, attributes, closed
        if whole:
            continue
        if name in _RAW or name in _RCDATA:
            m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            body = html[at : m.start()] if m else html[at:]
            yield ("text" if name in _RCDATA else "raw"), body
            yield "end", name
            end = html.find(">", m.end()) if m else -1
            at = n if end < 0 else end + 1


def tree(html: str) -> Node:
    """The element tree, with implied tags put in and misnested ends repaired."""
    root = Node("html")
    stack = [root]
    places: dict[str, list[int]] = {}  # by name: where in the stack its open elements are; without the root

    def last(names) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def pop_to(size: int) -> None:
        while len(stack) > size:
            places[stack.pop().name].pop()

    def push(name: str, attributes: dict[str, str] | None = None) -> None:
        node = Node(name, attributes)
        stack[-1].children.append(node)
        places.setdefault(name, []).append(len(stack))
        stack.append(node)

    def close(names, borders) -> None:
        """Pop up to the innermost open element of ``names`` inside ``borders``, if there is one."""
        at = last(names)
        if at and at >= last(borders):
            pop_to(at)

    def foreign() -> bool:
        return last(("svg", "math")) > last(_HTML_AGAIN)

    for token in tokens(html, foreign):
        kind = token[0]
        if kind == "text" or kind == "raw":
            text = unescape(token[1]) if kind == "text" and "&" in token[1] else token[1]
            if stack[-1].name == "head" and text.strip(" \t\n\f\r"):
                pop_to(len(stack) - 1)
            if stack[-1].name in ("table", "tbody", "thead", "tfoot", "tr", "colgroup") and not text.strip(" \t\n\f\r"):
                continue
            stack[-1].children.append(text)
            continue
        name = token[1]
        if kind == "end":
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif name in ("html", "body"):
                pass  # what follows still belongs to the body
            elif name == "p" and not places.get("p"):
                stack[-1].children.append(Node("p"))
            elif name in _HEADINGS:
                close(_HEADINGS, _SCOPE)
            elif name in ("table", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
                close({name}, {"table"} - {name})
            else:
                close({name}, _SCOPE - {name} if name not in _BLOCK else {"table", "td", "th", "html"} - {name})
            continue
        attributes, closed = token[2], token[3]
        if name == "html":
            root.attributes = attributes | root.attributes
            continue
        if outer := last(("svg", "math")):
            kind = stack[outer].name
            if foreign() and (name in _ENDS_FOREIGN or (name == "font" and not attributes.keys().isdisjoint(("color", "face", "size")))):
                while foreign():
                    pop_to(last(("svg", "math")))
            elif name in _UNDRAWN[kind] or (kind == "svg" and attributes.get("display", "").strip().lower() == "none"):
                attributes = attributes | {"hidden": ""}
            elif kind == "svg" and "visibility" in attributes:
                attributes = attributes | {"style": f"visibility:{attributes['visibility']};{attributes.get('style', '')}"}
        if stack[-1].name == "head" and name not in _HEAD:
            pop_to(len(stack) - 1)
        if name in ("head", "body") and places.get(name):
            continue
        if name in _CLOSES_P:
            close({"p"}, _SCOPE)
        if name in _HEADINGS and stack[-1].name in _HEADINGS:
            pop_to(len(stack) - 1)
        if name in _IMPLIED_END:
            names, borders = _IMPLIED_END[name]
            again = True
            while again:
                size = len(stack)
                close(names, borders)
                again = len(stack) < size and name in ("tr", "tbody", "thead", "tfoot", "optgroup")
        if name == "tr" and stack[-1].name == "table":
            push("tbody")
        if name in ("td", "th") and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
            if stack[-1].name == "table":
                push("tbody")
            push("tr")
        if name in _VOID or (closed and (name in ("svg", "math") or foreign())):
            stack[-1].children.append(Node(name, attributes))
        else:
            push(name, attributes)
    return root


# ---------------------------------------------------------------- rendering


class _Page:
    """Text with collapsed spaces and pending line breaks."""

    def __init__(self):
        self.parts: list[str] = []
        self.breaks, self.space, self.started, self.fresh = 0, False, False, True

    def need(self, breaks: int) -> None:
        self.breaks, self.space = max(self.breaks, breaks), False

    def _begin(self) -> None:
        if self.breaks:
            if self.started:
                self.parts.append("\n" * self.breaks)
            self.breaks, self.fresh = 0, True

    def write(self, text: str) -> None:
        body = _SPACES.sub(" ", text)
        if body == " " or not body:
            self.space = self.space or bool(body)
            return
        self._begin()
        if (self.space or body[0] == " ") and not self.fresh:
            self.parts.append(" ")
        self.parts.append(body.strip(" "))
        self.space, self.started, self.fresh = body[-1] == " ", True, False

    def raw(self, text: str) -> None:
        if text:
            self._begin()
            self.parts.append(text)
            self.space, self.started, self.fresh = False, True, text[-1] == "\n"

    def line_break(self) -> None:
        self.breaks, self.space = self.breaks + 1 if self.started else 0, False

    def text(self) -> str:
        return "".join(self.parts)


def _shown(node: Node, visible: bool) -> tuple[bool, bool]:
    """``(laid out, visible)``: display takes the whole subtree away, visibility can be taken back below."""
    a = node.attributes
    if node.name in _HIDDEN or "hidden" in a or (node.name == "dialog" and "open" not in a) or (node.name == "input"):
        return False, False
    if style := a.get("style"):
        rules = {k.lower(): v.lower() for k, v in _STYLE.findall(style)}
        if rules.get("display") == "none":
            return False, False
        if "visibility" in rules:
            visible = rules["visibility"] not in ("hidden", "collapse")
    return True, visible


def _run(call):
    """The result of a generator that yields its calls of others; their depth is only bounded by memory."""
    calls, value = [call], None
    while calls:
        try:
            inner = calls[-1].send(value)
        except StopIteration as end:
            calls.pop()
            value = end.value
        else:
            calls.append(inner)
            value = None
    return value


def _inside(children: list, visible: bool, pre: bool, depth: int):
    page = _Page()
    yield _flow(children, page, visible, pre, depth)
    return page.text()


def _flow(children: list, page: _Page, visible: bool, pre: bool, depth: int):
    for child in children:
        if isinstance(child, str):
            if visible:
                page.raw(child) if pre else page.write(child)
            continue
        laid_out, seen = _shown(child, visible)
        if not laid_out:
            continue
        name = child.name
        if name == "br":
            page.line_break()
        elif name == "hr":
            page.need(1)
        elif name in ("ul", "ol", "menu", "dir"):
            page.need(1 if depth else 2)
            yield _list(child, page, seen, depth)
            page.need(1 if depth else 2)
        elif name == "table":
            page.need(2)
            if text := (yield _table(child, seen, depth)):
                page.raw(text)
            page.need(2)
        elif name in ("pre", "listing"):
            page.need(2)
            body = yield _inside(child.children, seen, True, depth)
            page.raw(body.removeprefix("\n").rstrip("\n"))
            page.need(2)
        elif name == "details" and "open" not in child.attributes:
            page.need(1)
            yield _flow([x for x in child.children if isinstance(x, Node) and x.name == "summary"][:1], page, seen, pre, depth)
            page.need(1)
        elif name == "svg":
            yield _drawing(child, page, seen, depth)
        elif name in _APART:
            for x in child.children:
                page.write(" ")
                yield _flow([x], page, seen, pre, depth)
            page.write(" ")
        elif name in _BLOCK:
            gap = 2 if name in _SPACED else 1
            page.need(gap)
            yield _flow(child.children, page, seen, pre, depth)
            page.need(gap)
        else:
            yield _flow(child.children, page, seen, pre, depth)


def _drawing(node: Node, page: _Page, visible: bool, depth: int):
    """The labels of a drawing, apart from each other; text outside of labels isn't drawn."""
    parts = [x for x in node.children if isinstance(x, Node)]
    for child in parts[:1] if node.name == "switch" else parts:
        laid_out, seen = _shown(child, visible)
        if laid_out and child.name in ("text", "foreignobject"):
            page.write(" ")
            yield _flow(child.children, page, seen, False, depth)
            page.write(" ")
        elif laid_out:
            yield _drawing(child, page, seen, depth)


def _list(node: Node, page: _Page, visible: bool, depth: int):
    number = node.attributes.get("start", "1").strip()
    number = int(number) if re.fullmatch(r"-?[0-9]{1,9}", number) else 1
    for child in node.children:
        if isinstance(child, str) or child.name != "li":
            yield _flow([child], page, visible, False, depth)
            continue
        laid_out, seen = _shown(child, visible)
        if not laid_out:
            continue
        mark = f"{number}. " if node.name == "ol" else "- "
        number += 1
        body = yield _inside(child.children, seen, False, depth + 1)
        if body:
            page.need(1)
            page.raw(mark + (body.replace("\n", "\n" + " " * len(mark)) if depth < MAX_INDENT else body))
            page.need(1)


def _rows(node: Node, visible: bool, depth: int):
    out = []
    for child in node.children:
        if isinstance(child, Node):
            laid_out, seen = _shown(child, visible)
            if laid_out and child.name in ("tbody", "thead", "tfoot"):
                out += yield _rows(child, seen, depth)
            elif laid_out and child.name == "tr":
                row = []
                for cell in child.children:
                    if isinstance(cell, Node) and cell.name in ("td", "th"):
                        cell_out, cell_seen = _shown(cell, seen)
                        if cell_out:
                            wide = cell.attributes.get("colspan", "1").strip()
                            lines = (yield _inside(cell.children, cell_seen, False, depth + 1)).split("\n")
                            row.append((lines, min(int(wide), 1000) if re.fullmatch("[1-9][0-9]{0,3}", wide) else 1))
                if row:
                    out.append(row)
    return out


def _table(node: Node, visible: bool, depth: int):
    """Caption and stray content first, then rows with every column padded to its widest cell."""
    stray = [c for c in node.children if isinstance(c, str) or c.name not in ("tbody", "thead", "tfoot", "tr", "colgroup", "col")]
    for group in node.children:
        if isinstance(group, Node) and group.name in ("tbody", "thead", "tfoot", "tr") and _shown(group, visible)[0]:
            for x in group.children:
                if (isinstance(x, str) and x.strip()) or (isinstance(x, Node) and x.name not in ("tr", "td", "th")):
                    stray.append(x)
                elif isinstance(x, Node) and x.name == "tr":
                    stray += [y for y in x.children if (isinstance(y, str) and y.strip()) or (isinstance(y, Node) and y.name not in ("td", "th"))]
    head = yield _inside(stray, visible, False, depth)
    rows, widths = (yield _rows(node, visible, depth)), {}
    for row in rows if depth < MAX_INDENT else []:
        at = 0
        for lines, span in row:
            if span == 1:
                widths[at] = max(widths.get(at, 0), *map(len, lines))
            at += span
    out = [head] if head else []
    for row in rows:
        for k in range(max(len(lines) for lines, _ in row)):
            parts, at = [], 0
            for lines, span in row:
                width = sum(widths.get(c, 0) for c in range(at, at + span)) + 2 * (span - 1)
                parts.append((lines[k] if k < len(lines) else "").ljust(width))
                at += span
            out.append("  ".join(parts).rstrip())
    return "\n".join(out).strip("\n")


def visible_text(html: str | None) -> str:
    """All visible text of a page, laid out; null and empty pages: empty."""
    return _run(_inside([tree(html)], True, False, 0)).strip("\n") if html else ""
