"""Layout-aware text of HTML pages.

A small tree builder (implied end tags, void elements, raw-text elements)
feeds a renderer that keeps what a reader sees: hidden elements are left
out, white space collapses except in preformatted text, blocks start on
their own line, paragraphs and tables are set off by a blank line, list
items get their marker and indentation, and table cells are aligned.

Pages are independent, so the job is one scan without a shuffle; the tree of
one page is all that a task holds beside its batch.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
PRE = frozenset("listing pre textarea xmp".split())
UNSEEN = frozenset("area audio base canvas col colgroup datalist embed head iframe link math meta noembed noframes noscript "
                   "object param rp script source style svg template title track video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
                  "summary table tbody td tfoot th thead tr ul xmp".split())
SPACED = frozenset("blockquote dl h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
LISTS = frozenset("ol ul menu dir".split())
CLOSES_P = BLOCK - frozenset("body dd dt html legend li optgroup option summary tbody td tfoot th thead tr".split())
IN_HEAD = frozenset("base head html link meta noscript script style template title".split())
# tag: (open tags that it ends, tags at which the search for them stops)
IMPLIED = {
    "li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "caption"}, {"tbody", "thead", "tfoot", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
}
# The keywords of the two properties that decide visibility; other values are no declarations.
DISPLAY = frozenset("block contents flex flow flow-root grid inherit initial inline inline-block inline-flex inline-grid inline-table list-item math none "
                    "revert revert-layer ruby run-in table table-caption table-cell table-column table-column-group table-footer-group "
                    "table-header-group table-row table-row-group unset -ms-flexbox -ms-inline-flexbox -webkit-box -webkit-flex "
                    "-webkit-inline-box -webkit-inline-flex".split())
VISIBILITY = frozenset("collapse hidden inherit initial revert revert-layer unset visible".split())
# The default screen that media conditions are tested against, in pixels and keywords.
SCREEN = {"width": 1280, "height": 800, "device-width": 1280, "device-height": 800, "aspect-ratio": 1.6, "device-aspect-ratio": 1.6,
          "resolution": 1, "-webkit-device-pixel-ratio": 1, "color": 8, "color-index": 0, "monochrome": 0, "grid": 0,
          "orientation": "landscape", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "scripting": "enabled",
          "update": "fast", "display-mode": "browser", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference",
          "prefers-contrast": "no-preference", "forced-colors": "none", "inverted-colors": "none"}
UNITS = {"": 1, "px": 1, "em": 16, "rem": 16, "pt": 4 / 3, "pc": 16, "in": 96, "cm": 96 / 2.54, "mm": 96 / 25.4, "dppx": 1, "x": 1, "dpi": 1 / 96, "dpcm": 2.54 / 96}
#: Cells wider than this are not padded against; their text is whole all the same.
ALIGN_WIDTH = 60
#: The limits that the HTML standard sets to colspan and rowspan; a rowspan of 0 is the rest of the table.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Input types that show neither a value nor a placeholder as text.
NO_TEXT = frozenset("hidden checkbox radio file range color password image".split())
#: Deeper elements are taken as siblings, as browsers do; their text is whole all the same.
MAX_DEPTH = 512

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+|[^>=])*+)(?:>|\Z)|[^<]++|<""", re.S)
_ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_CSS = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\.)*+'?|url\([^"')]*+\)|\\.|[{};]|[^"'/\\{};u]++|.""", re.S | re.I)
_SELECTOR = re.compile(r"[.#]?(?:[A-Za-z_-]|[^\x00-\x7f]|\\[^0-9a-fA-F])(?:[\w-]|[^\x00-\x7f]|\\[^0-9a-fA-F])*")
_COMPARED = re.compile(r"(?:([^<>=]+)(<=?|>=?|=))?([^<>=]+)(?:(<=?|>=?|=)([^<>=]+))?")
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(source):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'")) if value else "")
    return out


def parse(page: str) -> tuple[Node, list[tuple[str, str]]]:
    """The page's tree and the (media, text) of its style elements that hold where scripts run."""
    root, styles, at = Node("#root", {}), [], 0
    stack = [root]

    def close(tags, stops) -> bool:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                del stack[depth:]
                return True
            if stack[depth].tag in stops:
                return False
        return False

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if not m[0].startswith(("<!", "<?")):
                if stack[-1].tag == "head" and m[0].strip():
                    close({"head"}, ())
                stack[-1].children.append(html.unescape(m[0]) if "&" in m[0] else m[0])
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].children.append(Node("p", {}))
            elif tag == "br":
                stack[-1].children.append(Node("br", {}))
            else:
                close({tag}, () if tag in ("table", "body", "html") else {"table", "td", "th", "caption"} - {tag} if tag not in BLOCK else {"table"})
            continue
        if tag not in IN_HEAD:
            for depth, n in enumerate(stack):
                if n.tag == "head":
                    del stack[depth:]
                    break
        if tag in CLOSES_P:
            close({"p"}, {"td", "th", "table", "caption", "button"})
        if tag in IMPLIED:
            close(*IMPLIED[tag])
            while tag == "tr" and stack[-1].tag in ("td", "th"):
                stack.pop()
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr", {})
            stack[-1].children.append(row)
            stack.append(row)
        node = Node(tag, _attributes(m[3]) if m[3].strip(" /") else {})
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            inside = page[at:end.start() if end else len(page)]
            if tag == "style":
                if node.attrs.get("type", "").strip().lower() in ("", "text/css") and not any(n.tag in ("noscript", "template") for n in stack):
                    styles.append((node.attrs.get("media", ""), inside))
            elif tag == "textarea":
                node.children.append(html.unescape(re.sub(r"\A\r?\n", "", inside)))
            elif tag == "xmp":
                node.children.append(inside)
            at = end.start() if end else len(page)
            close_at = page.find(">", at)
            at = close_at + 1 if end and close_at >= 0 else len(page)
        elif tag not in VOID and len(stack) < MAX_DEPTH:
            stack.append(node)
    return root, styles


def _number_of(value: str) -> float | None:
    ratio = re.fullmatch(r"(\d+(?:\.\d+)?)/(\d+(?:\.\d+)?)", value)
    if ratio:
        return float(ratio[1]) / float(ratio[2]) if float(ratio[2]) else None
    m = re.fullmatch(r"([+-]?(?:\d+(?:\.\d*)?|\.\d+))([a-z]*)", value)
    return float(m[1]) * UNITS[m[2]] if m and m[2] in UNITS else None


def _compare(a: float | None, sign: str, b: float | None) -> bool | None:
    if a is None or b is None:
        return None
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "=": a == b}[sign]


def _on_screen(feature: str) -> bool | None:
    """Whether the default screen has a media feature, such as min-width: 40em or width >= 600px; None if unknown."""
    feature = re.sub(r"\s+", "", feature)
    name, colon, value = feature.partition(":")
    if colon:
        bound = re.match(r"(-webkit-)?(min|max)-", name)
        has = SCREEN.get(name if not bound else (bound[1] or "") + name[bound.end():])
        if has is None or isinstance(has, str):
            return None if has is None or bound else has == value
        return _compare(has, {"min": ">=", "max": "<="}[bound[2]] if bound else "=", _number_of(value))
    if feature in SCREEN:
        return SCREEN[feature] not in (0, "none", "no-preference")
    m = _COMPARED.fullmatch(feature)
    if not m or not (m[2] or m[4]):
        return None
    left, middle, right = (SCREEN.get(v, _number_of(v)) if v else None for v in (m[1], m[3], m[5]))
    if any(isinstance(v, str) for v in (left, middle, right)):
        return None
    tests = [_compare(a, sign, b) for a, sign, b in ((left, m[2], middle), (middle, m[4], right)) if sign]
    return False if False in tests else None if None in tests else True


def _supported(feature: str) -> bool | None:
    """Whether a browser knows a declaration: all but the vendors' own; None if no declaration."""
    name, colon, _ = feature.strip().partition(":")
    return not re.match(r"-(?!-|webkit-)", name) if colon else None


def _top(text: str, at: str) -> list[str]:
    """``text`` cut where ``at`` matches outside parentheses."""
    out, depth, start = [], 0, 0
    for m in re.finditer(rf"[()]|{at}", text):
        if m[0] in "()":
            depth = max(0, depth + (1 if m[0] == "(" else -1))
        elif not depth:
            out.append(text[start:m.start()])
            start = m.end()
    return [*out, text[start:]]


def _holds(condition: str, leaf, depth: int = 0) -> bool | None:
    """A condition of and, or, not and parentheses; None if unknown."""
    condition = condition.strip()
    if depth > 20:
        return None
    for word, decides in ((r"\bor\b", True), (r"\band\b", False)):
        parts = _top(condition, word)
        if len(parts) > 1:
            found = [_holds(p, leaf, depth + 1) for p in parts]
            return decides if decides in found else None if None in found else not decides
    denied = re.match(r"not(?=[\s(])", condition)
    if denied:
        found = _holds(condition[denied.end():], leaf, depth + 1)
        return None if found is None else not found
    if condition in ("all", "screen"):
        return True
    if condition.startswith("(") and condition.endswith(")"):
        inside = condition[1:-1].strip()
        return _holds(inside, leaf, depth + 1) if inside.startswith("(") or re.match(r"not[\s(]", inside) else leaf(inside)
    return False if re.fullmatch(r"[a-z-]+", condition) else None


def _media(queries: str) -> bool:
    """Whether the default screen meets one of the media queries; what is unknown is not met."""
    for query in _top(queries.lower(), ","):
        query = re.sub(r"^\s*only\s+", "", query).strip()
        denied = re.match(r"not\s+(?=[a-z])", query)
        if denied:  # of a whole query with a media type
            if _holds(query[denied.end():], _on_screen) is False:
                return True
        elif _holds(query, _on_screen):
            return True
    return not queries.strip()


def _selectors(head: str) -> list[str]:
    """The plain tag, .class and #id selectors of a rule."""
    out = []
    for s in _top(re.sub(r"\[[^\]]*\]", "[]", head), ","):
        s = s.strip()
        if _SELECTOR.fullmatch(s):
            out.append(re.sub(r"\\(.)", r"\1", s) if s[0] in ".#" else s.lower())
    return out


def _declare(rules: dict, selectors: list[str], declaration: str, layered: bool, order: int) -> None:
    name, _, value = declaration.partition(":")
    name, value = name.strip().lower(), value.strip().lower()
    bare = re.sub(r"\s*!\s*important$", "", value)
    known = {"display": DISPLAY, "visibility": VISIBILITY}.get(name)
    if known and bare and known.issuperset(bare.split()):
        important = bare != value
        for s in selectors:
            weight = 3 if not s else 2 if s[0] == "#" else 1 if s[0] == "." else 0
            new = ((important, not s, layered == important, weight, order), bare)
            rules.setdefault(s, {})[name] = max(new, rules.get(s, {}).get(name, new))


def _cascade(rules: dict, css: str, selectors: list[str] | None = None, live: bool = True, start: int = 0) -> int:
    """Adds what ``css`` says of display and visibility on the default screen: selector to property to (rank, value).

    Without ``selectors`` css is a style sheet, else the declarations of
    these.  Rules that hold in print, on other screens, for a part of the
    page or for a moment only are left out, and so is what follows from
    selectors that are not plain.
    """
    stack, text, order = [(selectors, live, False)], [], start
    for m in _CSS.finditer(css):
        t = m[0]
        inside, live, layered = stack[-1]
        if t == "{":
            head = "".join(text).replace("<!--", " ").replace("-->", " ").strip()
            at = re.match(r"@([\w-]+)(.*)", head, re.S)
            if at:
                kind = at[1].lower()
                holds = (_media(at[2]) if kind == "media" else _holds(at[2].lower(), _supported) is True if kind == "supports" else kind == "layer")
                stack.append((inside, live and holds, layered or kind == "layer"))
            else:
                stack.append((_selectors(head) if inside is None else [], live, layered))
            text = []
        elif t == "}" and len(stack) > 1 or t == ";" and (inside is not None or "".join(text).lstrip().startswith("@")):
            if inside and live:
                order += 1
                _declare(rules, inside, "".join(text), layered, order)
            if t == "}":
                stack.pop()
            text = []
        else:
            text.append(" " if t.startswith("/*") else t)
    if stack[-1][0] and stack[-1][1]:
        order += 1
        _declare(rules, stack[-1][0], "".join(text), stack[-1][2], order)
    return order


def _rules(styles: list[tuple[str, str]]) -> dict:
    """What the style elements say of display and visibility, by selector."""
    rules: dict = {}
    order = 0
    for media, css in styles:
        if re.search("display|visibility", css, re.I) and _media(media):
            order = _cascade(rules, css, start=order)
    return rules


def _visibility(node: Node, rules: dict, shown: bool) -> tuple[bool, bool]:
    """(rendered at all, text visible): visibility is inherited and can be turned on again, display cannot."""
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a or (node.tag == "dialog" and "open" not in a):
        return False, False
    found = []
    if rules:
        names = [node.tag, *("." + c for c in a.get("class", "").split()), "#" + a.get("id", "")]
        found = [rules[n] for n in names if n in rules]
    if re.search("display|visibility", a.get("style", ""), re.I):
        inline: dict = {}
        _cascade(inline, a["style"], [""])
        found += inline.values()
    if max((f["display"] for f in found if "display" in f), default=((), ""))[1] == "none":
        return False, False
    value = max((f["visibility"] for f in found if "visibility" in f), default=((), ""))[1]
    if value in ("hidden", "collapse"):
        shown = False
    elif value in ("visible", "initial"):
        shown = True
    return True, shown


def _options(select: Node) -> list[tuple[Node, bool]]:
    """The options of a select element in order, and whether each can be chosen."""
    out, work = [], [(c, False) for c in reversed(select.children)]
    while work:
        node, off = work.pop()
        if isinstance(node, Node):
            off = off or "disabled" in node.attrs
            if node.tag == "option":
                out.append((node, not off))
            else:
                work += [(c, off) for c in reversed(node.children)]
    return out


class _Lines:
    """Output lines of one flow: collapses white space and the blank lines between blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = 0  # blank lines due before the next text
        self.lead = ""  # marker or indentation due at the next text
        self.indent = 0

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *more = s.replace("\r\n", "\n").split("\n")
            self.put(first)
            for line in more:
                self.end_line(keep=True)
                self.put(line)
            return
        s = _SPACES.sub(" ", s)
        if not self.now:
            s = s.lstrip(" ")
        elif self.now[-1].endswith(" "):
            s = s.lstrip(" ")
        self.put(s)

    def put(self, s: str) -> None:
        if s:
            if not self.now:
                lead = self.lead or " " * self.indent
                self.lead = ""
                if lead:
                    s = lead + s
            self.now.append(s)

    def end_line(self, keep: bool = False) -> None:
        if self.now or keep:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = 0
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []

    def block(self, spaced: bool) -> None:
        self.end_line()
        if spaced:
            self.blank = 1

    def result(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _number(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"[+-]?\d{1,9}", value.strip()) else default


def _table(rows: list[list[tuple[int, int, list[str]]]]) -> list[str]:
    """Rows of (columns spanned, rows spanned, lines) as text: cells start at their column's place, two blanks apart.

    A cell that spans rows is written in its first one and keeps its columns
    free in the others.
    """
    widths: dict[int, int] = {}
    taken: dict[int, int] = {}  # column: rows it is still spanned for
    placed = []
    for row in rows:
        at, cells, spanned = 0, [], {}
        for span, deep, lines in row:
            while taken.get(at, 0):
                at += 1
            wide = max(map(len, lines), default=0)
            if span == 1 and wide <= ALIGN_WIDTH:
                widths[at] = max(widths.get(at, 0), wide)
            cells.append((at, lines))
            if deep > 1:
                spanned.update(dict.fromkeys(range(at, at + span), deep - 1))
            at += span
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | spanned
        placed.append(cells)
    places = [0]
    for c in range(max((at for cells in placed for at, _ in cells), default=0)):
        places.append(places[-1] + widths.get(c, 0) + 2)
    out = []
    for cells in placed:
        for k in range(max((len(lines) for _, lines in cells), default=0)):
            line = ""
            for at, lines in cells:
                line = line.ljust(places[at]) + (lines[k] if k < len(lines) else "") + "  "
            out.append(line.rstrip())
    return out


def render(page: str | None) -> str:
    """The page's visible text; null and blank pages give an empty text.

    The walk keeps its own stack, so deep nesting is no problem.
    """
    if not page:
        return ""
    root, styles = parse(page)
    rules = _rules(styles)
    flows = [_Lines()]
    lists: list[list] = []  # [tag, next number]
    tables: list[list] = []  # rows of the open tables
    work: list[tuple] = [("open", root, True, False)]
    while work:
        what, node, shown, pre = work.pop()
        out = flows[-1]
        if what == "close":
            tag = node.tag
            if tag in ("td", "th") and tables:
                deep = _number(node.attrs.get("rowspan"), 1)
                tables[-1][-1].append((max(1, min(MOST_COLUMNS, _number(node.attrs.get("colspan"), 1))), MOST_ROWS if deep == 0 else max(1, min(MOST_ROWS, deep)), flows.pop().result()))
            elif tag == "table":
                rows = tables.pop()
                for line in _table(rows):
                    out.put(line)
                    out.end_line(keep=True)
                out.block(True)
            elif tag in LISTS:
                lists.pop()
                out.indent -= 2
                out.block(not lists)
            elif tag == "dd":
                out.end_line()
                out.indent -= 2
            elif tag == "q":
                out.text("\"", True)
            elif tag in BLOCK:
                out.block(tag in SPACED)
                if tag == "li":
                    out.lead = ""
            continue
        if isinstance(node, str):
            if shown:
                out.text(node, pre)
            continue
        tag = node.tag
        rendered, shown = _visibility(node, rules, shown)
        if not rendered:
            continue
        if tag == "br":
            out.end_line(keep=True)
            continue
        if tag == "input":
            kind = node.attrs.get("type", "text").strip().lower()
            seen = "" if kind in NO_TEXT else node.attrs.get("value") or ("" if kind in ("submit", "button", "reset") else node.attrs.get("placeholder", ""))
            if shown and seen:
                out.text(f" {seen} ", False)
            continue
        children = node.children
        if tag == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        elif tag == "select" and "multiple" not in node.attrs and _number(node.attrs.get("size"), 1) < 2:
            options = _options(node)
            chosen = [o for o, _ in options if "selected" in o.attrs][-1:] or [o for o, free in options if free][:1]
            children = [Node("option", {}) for _ in chosen]  # it is seen in the closed list even if it is hidden in the open one
            for c, o in zip(children, chosen, strict=True):
                c.children = o.children
        if tag == "table":
            out.block(True)
            tables.append([])
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag in ("td", "th") and tables:
            if not tables[-1]:
                tables[-1].append([])
            flows.append(_Lines())
        elif tag in LISTS:
            out.block(not lists)
            out.indent += 2
            lists.append([tag, _number(node.attrs.get("start"), 1)])
        elif tag == "li":
            out.end_line()
            kind = lists[-1] if lists else ["ul", 1]
            if kind[0] == "ol":
                number = _number(node.attrs.get("value"), kind[1])
                kind[1] = number + 1
                mark = f"{number}. "
            else:
                mark = "- "
            out.lead = " " * max(0, out.indent - 2) + mark
        elif tag == "dd":
            out.end_line()
            out.indent += 2
        elif tag == "q":
            out.text("\"", True)
        elif tag in BLOCK:
            out.block(tag in SPACED)
        if tag in ("tr", "tbody", "thead", "tfoot") and tables:
            inside = [c for c in children if isinstance(c, Node) or c.strip()]  # blanks between cells are no text
            work += [("open", c, shown, pre) for c in reversed(inside)]
            continue
        work.append(("close", node, shown, pre))
        work += [("open", c, shown, pre or tag in PRE) for c in reversed(children) if not (tag == "table" and isinstance(c, str) and not c.strip())]
    return "\n".join(flows[0].result())


def extract_text(pages: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """The pages with their visible text in ``into`` (replaces a column of that name); every row is kept."""
    @F.pandas_udf("string")
    def visible(pages: pd.Series) -> pd.Series:
        return pd.Series([render(p) for p in pages], dtype=object)

    return pages.withColumn(into, visible(F.col(html_col)))
