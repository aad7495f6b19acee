"""HTML to title, description, Markdown and links, for one page.

The tree builder covers the parts of the HTML5 algorithm that change what a page says: implied end tags, elements that close a paragraph,
table parts, raw text, and formatting elements that stay in force across paragraphs until they are closed. The tokenizer never looks at a
character of a page twice, the builder finds open elements by their tag, and what renders the tree keeps a stack of its own: the work is in
proportion to the page, whatever is left open or nested how deep. Elements nest DEPTH deep; deeper ones stand beside each other there, with
all their text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Generator
from dataclasses import dataclass, field
from html import unescape

from tidepool.functions import whatwg
from tidepool.functions.text import WHITE, sanitized, truncated

#: Element classes.
REMOVED = {"aside", "base", "dialog", "footer", "form", "head", "header", "iframe", "nav", "noscript", "script", "style", "template", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul", "dd", "dt",
}
HEADINGS = {f"h{i}" for i in range(1, 7)}
BLOCKS = CLOSES_P | {"body", "html", "tr", "thead", "tbody", "tfoot", "td", "th", "caption"}
BARRIERS = {"table", "td", "th", "caption", "html", "template", "button", "object"}
IN_HEAD = {"base", "link", "meta", "title", "style", "script", "noscript", "template"}


RAW = {"script", "style", "xmp", "iframe", "noembed", "noframes", "title", "textarea"}
CELLS = {"td", "th"}
TABLE_PARTS = {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}

#: Levels of nesting; formatting elements that stay in force at once, and of these, alike ones (the HTML Standard's number).
DEPTH, IN_FORCE, ALIKE = 512, 32, 3


@dataclass(eq=False, slots=True)
class Node:
    """at: its place among the open elements, -1 when closed. ghost: still open, but closed as far as formatting goes."""

    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # of Node and str
    parent: Node | None = None
    at: int = -1
    ghost: bool = False
    has_block: bool = False

    def walk(self, skip: frozenset[str] | set[str] = frozenset()):
        """This node and all below it in order, but for those of the tags `skip` and what is below them."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node) and c.tag not in skip]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                todo += reversed(n.children)
        return "".join(out)


# -- tokens

_name = re.compile(r"[A-Za-z][^\t\n\f />]*")
_attribute = re.compile(r"""[\t\n\f /]*(?:([^\t\n\f />][^\t\n\f />=]*)(?:[\t\n\f ]*=[\t\n\f ]*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\t\n\f >]*)))?)?""")
_reference = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*(?:;|(?![=A-Za-z0-9])))")
_comment_end = re.compile(r"--!?>")
_raw_end = {t: re.compile(rf"</{t}(?=[\t\n\f />])", re.I) for t in RAW}


def _tag(html: str, at: int) -> tuple[dict[str, str], int]:
    """(attributes, place behind the tag) of a tag whose name ends at `at`; a tag that the page ends in reaches to its end."""
    given: dict[str, str] = {}
    while at < len(html) and html[at] != ">":
        m = _attribute.match(html, at)
        name, *values = m.groups()
        if name:
            value = next((v for v in values if v is not None), "")
            given.setdefault(name.lower(), _reference.sub(lambda r: unescape(r[0]), value) if "&" in value else value)
        at = m.end()
    return given, at + 1


class _Builder:
    def __init__(self) -> None:
        self.root, self.head, self.body = Node("html", at=0), Node("head"), Node("body")
        self.root.children = [self.head, self.body]
        self.head.parent = self.body.parent = self.root
        self.stack = [self.root]
        self.in_head = True
        self.open: dict[str, list[int]] = defaultdict(list)  # places of the open elements of each tag
        self.blocks: list[int] = []  # and of all blocks
        self.active: list[Node | None] = []  # formatting in force; None begins a table cell's own

    def feed(self, html: str) -> Node:
        at, size, text = 0, len(html), []

        def flush() -> None:
            if text:
                self.data(unescape("".join(text)))
                text.clear()

        while at < size:
            to = html.find("<", at)
            if to < 0:
                text.append(html[at:])
                break
            text.append(html[at:to])
            closing = html.startswith("</", to)
            if name := _name.match(html, to + 1 + closing):
                given, at = _tag(html, name.end())
                if at > size:
                    break
                flush()
                tag = name[0].lower()
                if closing:
                    self.end(tag)
                    continue
                self.start(tag, given)
                if tag == "plaintext":
                    self.data(html[at:])
                    break
                if tag in RAW:
                    end = _raw_end[tag].search(html, at)
                    inner = html[at : end.start() if end else size]
                    self.data(unescape(inner) if tag in ("title", "textarea") else inner)
                    at = end.start() if end else size
            elif html.startswith("<!--", to):
                short = re.match("-?>", html[to + 4 : to + 6])
                end = short or _comment_end.search(html, to + 4)
                at = to + 4 + short.end() if short else end.end() if end else size
            elif html.startswith(("<!", "<?", "</"), to) and to + 2 < size:
                end = html.find(">", to + 2)
                at = end + 1 if end >= 0 else size
            else:
                text.append("<")
                at = to + 1
        flush()
        return self.root

    # -- the stack

    def _push(self, tag: str, attrs: dict[str, str]) -> Node:
        above = self.stack[-1]
        node = Node(tag, attrs, parent=above)
        above.children.append(node)
        if tag in BLOCKS:
            while above and not above.has_block:
                above.has_block, above = True, above.parent
        if tag not in VOID and len(self.stack) < DEPTH:
            node.at = len(self.stack)
            self.stack.append(node)
            if tag not in FORMATTING:
                self.open[tag].append(node.at)
            if tag in BLOCKS:
                self.blocks.append(node.at)
            if tag in CELLS:
                self.active.append(None)
        return node

    def _cut(self, size: int) -> None:
        """Closes the elements from that place on."""
        while len(self.stack) > size or self.stack[-1].ghost:
            node = self.stack.pop()
            node.at = -1
            if node.tag not in FORMATTING and node is not self.head and node is not self.body:
                self.open[node.tag].pop()
                if node.tag in BLOCKS:
                    self.blocks.pop()
                if node.tag in CELLS:
                    while self.active and self.active.pop() is not None:
                        pass

    def _within(self, tags: set[str], barriers: set[str]) -> int | None:
        last = lambda of: max((self.open[t][-1] for t in of if self.open.get(t)), default=0)
        at = last(tags)
        return at if at and at >= last(barriers) else None

    def _close(self, tags: set[str], barriers: set[str] = BARRIERS) -> None:
        at = self._within(tags, barriers)
        if at is not None:
            self._cut(at)

    def _enter_body(self) -> None:
        if self.in_head:
            self.in_head = False
            self._cut(1)
            self.stack.append(self.body)

    def _reopen(self) -> None:
        """Formatting elements still in force are opened again where they no longer are."""
        start = len(self.active)
        while start and self.active[start - 1] is not None and self.active[start - 1].at < 0:
            start -= 1
        for i in range(start, len(self.active)):
            if len(self.stack) == DEPTH:
                return
            old = self.active[i]
            self.active[i] = self._push(old.tag, dict(old.attrs))

    def _since_cell(self) -> list[int]:
        """Places of the formatting elements in force within the innermost open cell, last first."""
        out = []
        for i in range(len(self.active) - 1, -1, -1):
            if self.active[i] is None:
                break
            out.append(i)
        return out

    def _activate(self, node: Node) -> None:
        since = self._since_cell()
        alike = [i for i in since if self.active[i].tag == node.tag and self.active[i].attrs == node.attrs]
        if len(alike) >= ALIKE:
            del self.active[alike[-1]]
        elif len(since) >= IN_FORCE:
            del self.active[since[-1]]
        self.active.append(node)

    def _end_formatting(self, tag: str) -> None:
        at = next((i for i in self._since_cell() if self.active[i].tag == tag), None)
        if at is None:
            return
        node = self.active.pop(at)
        if node.at >= 0:
            # what stands in an open block stays in force there no longer; the block itself stays open
            if self.blocks and self.blocks[-1] > node.at:
                node.ghost = True
            else:
                self._cut(node.at)

    # -- the tree

    def start(self, tag: str, given: dict[str, str]) -> None:
        if tag in ("html", "head", "body"):
            if tag == "head":
                if self.in_head:
                    self._cut(1)
                    self.stack.append(self.head)
            elif tag == "body":
                self._enter_body()
                self.body.attrs = {**given, **self.body.attrs}
            return
        if self.in_head and tag in IN_HEAD:
            if len(self.stack) == 1:
                self.stack.append(self.head)
            self._push(tag, given)
            return
        self._enter_body()
        if tag in CLOSES_P:
            self._close({"p"})
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self._cut(len(self.stack) - 1)
        if tag == "li":
            self._close({"li"}, BARRIERS | {"ul", "ol", "menu", "dir"})
        elif tag in ("dd", "dt"):
            self._close({"dd", "dt"}, BARRIERS | {"dl"})
        elif tag == "option":
            self._close({"option"}, BARRIERS | {"select"})
        elif tag in ("tbody", "thead", "tfoot"):
            self._close({"tbody", "thead", "tfoot", "caption"}, {"table", "html"})
        elif tag == "tr":
            self._close({"tr", "caption"}, {"table", "html"})
            if self.stack[-1].tag == "table":
                self._push("tbody", {})
        elif tag in CELLS:
            self._close(CELLS, {"table", "html"})
            if self.stack[-1].tag == "table":
                self._push("tbody", {})
            if self.stack[-1].tag in ("tbody", "thead", "tfoot"):
                self._push("tr", {})
        elif tag == "a" and any(self.active[i].tag == "a" for i in self._since_cell()):
            self._end_formatting("a")
        if tag in FORMATTING:
            self._reopen()
            self._activate(self._push(tag, given))
        else:
            if tag not in BLOCKS:
                self._reopen()
            self._push(tag, given)

    def end(self, tag: str) -> None:
        if tag == "head":
            self._enter_body()
            return
        if self.in_head:
            if self.stack[-1].tag == tag:
                self._cut(len(self.stack) - 1)
            return
        if tag in ("html", "body"):
            return
        if tag in FORMATTING:
            self._end_formatting(tag)
        elif tag == "p":
            if self._within({"p"}, BARRIERS) is None:
                self._push("p", {})
            self._close({"p"})
        elif tag in HEADINGS:
            self._close(HEADINGS)
        elif tag == "br":
            self._reopen()
            self._push("br", {})
        else:
            self._close({tag}, {"html"} if tag in TABLE_PARTS else BARRIERS)

    def data(self, text: str) -> None:
        if self.in_head and self.stack[-1].tag in ("title", "style", "script", "noscript", "template"):
            self.stack[-1].children.append(text)
            return
        if self.in_head:
            if not text.strip(" \t\n\r\f"):
                return
            self._enter_body()
        if text.strip(" \t\n\r\f"):
            self._reopen()
        self.stack[-1].children.append(text)


def parse(html: str) -> Node:
    return _Builder().feed(html.replace("\r\n", "\n").replace("\r", "\n"))


# -- Markdown

_spaces = re.compile(r"[ \t\n\r\f]+")


def _tidy(text: str) -> str:
    return re.sub(r"(?<! ) (?=  \n)|(?<=\n) +", "", re.sub(" {3,}(?!\n)", " ", text))


def _escape(text: str) -> str:
    return re.sub(r"([\\*_`\[\]])", r"\\\1", text)


def _wrap(mark: str, text: str) -> str:
    core = text.strip()
    if not core:
        return text
    lead, tail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
    return f"{lead}{mark}{core}{mark}{tail}"


def _fence(text: str, least: int) -> str:
    return "`" * max(least, 1 + max((len(m) for m in re.findall("`+", text)), default=0))


Step = Generator["Step", object, object]


def _run(step: Step):
    """What a step returns. Steps yield the steps that they need the results of, so nesting takes no part of Python's own stack."""
    todo, value = [step], None
    while todo:
        try:
            todo.append(todo[-1].send(value))
            value = None
        except StopIteration as done:
            todo.pop()
            value = done.value
    return value


class _Markdown:
    """links: URL of each node that has one, by id(node). most: characters of a block, beyond which the page is given up."""

    def __init__(self, links: dict[int, str], most: int) -> None:
        self.links, self.most = links, most

    def page(self, node: Node) -> str:
        return "\n\n".join(_run(self.blocks(node)))

    def _checked(self, text: str) -> str:
        if len(text) > self.most:
            raise ExtractError("output_too_large")
        return text

    def inline(self, node: Node) -> Step:
        out, links = [], self.links
        for c in node.children:
            if isinstance(c, str):
                out.append(_escape(_spaces.sub(" ", c)))
            elif c.tag in REMOVED:
                continue
            elif c.tag == "br":
                out.append("  \n")
            elif c.tag == "code":
                text = _spaces.sub(" ", c.text()).strip()
                fence = _fence(text, 1)
                out.append(f"{fence}{text}{fence}" if text else "")
            elif c.tag in ("img", "a"):
                url, title = links.get(id(c)), f' "{c.attrs["title"]}"' if c.attrs.get("title") else ""
                if c.tag == "img":
                    out.append(f"![{c.attrs.get('alt', '')}]({url}{title})" if url else "")
                else:
                    text = _tidy((yield self.inline(c))).strip()
                    out.append(f"[{text}]({url}{title})" if url else text)
            elif c.children:
                text = yield self.inline(c)
                if c.tag in ("em", "i", "cite", "dfn"):
                    text = _wrap("*", text)
                elif c.tag in ("strong", "b"):
                    text = _wrap("**", text)
                elif c.tag in BLOCKS:
                    text = f" {text} "
                out.append(text)
            elif c.tag in BLOCKS:
                out.append("  ")
        return "".join(out)

    def blocks(self, node: Node) -> Step:
        """The blocks that a node's children make."""
        out: list[str] = []
        run: list = []
        for c in [*node.children, None]:
            if c is not None and (isinstance(c, str) or c.tag not in BLOCKS and (not c.has_block or c.tag in REMOVED)):
                if isinstance(c, str) or c.tag not in REMOVED:
                    run.append(c)
                continue
            if run:
                text = _tidy((yield self.inline(Node("span", children=run)))).strip()
                run = []
                if text:
                    out.append(re.sub(r"^(\d+)\.(?= )", r"\1\\.", re.sub(r"^([#>+-])(?= )", r"\\\1", text)))
            if c is not None and c.tag not in REMOVED:
                out += yield self.block(c)
        return out

    def block(self, node: Node) -> Step:
        tag = node.tag
        if tag in HEADINGS:
            text = _tidy((yield self.inline(node))).strip()
            return [f"{'#' * int(tag[1])} {text}"] if text else []
        if tag == "hr":
            return ["* * *"]
        if tag == "pre":
            code = next((n for n in node.walk() if n.tag == "code"), node)
            language = next((c[9:] for c in code.attrs.get("class", "").split() if c.startswith("language-")), "")
            text = node.text().removeprefix("\n").rstrip("\n")
            fence = _fence(text, 3)
            return [f"{fence}{language}\n{text}\n{fence}"]
        if tag == "blockquote":
            inner = "\n\n".join((yield self.blocks(node)))
            return [self._checked("\n".join(f"> {x}".rstrip() for x in inner.split("\n")))] if inner else []
        if tag in ("ul", "ol", "menu", "dir"):
            return (yield self.list(node))
        if tag == "table":
            return (yield self.table(node))
        return (yield self.blocks(node))

    def list(self, node: Node) -> Step:
        items = [c for c in node.children if isinstance(c, Node) and c.tag == "li"]
        start = node.attrs.get("start", "1")
        number = int(start) if re.fullmatch(r"[0-9]{1,9}", start) else 1
        lines, loose = [], False
        for k, item in enumerate(items):
            blocks = yield self.blocks(item)
            mark = f"{number + k}.  " if node.tag == "ol" else "*   "
            paragraphs = sum(isinstance(c, Node) and c.tag == "p" for c in item.children)
            loose |= paragraphs > 1
            body = ("\n\n" if paragraphs > 1 else "\n").join(blocks)
            lines.append(mark + body.replace("\n", "\n" + " " * len(mark)))
        text = ("\n\n" if loose else "\n").join(re.sub(r"\n +(?=\n)", "\n", x) for x in lines)
        return [self._checked(text)] if text else []

    def table(self, node: Node) -> Step:
        """Rows of the table itself; a table within a cell is text of that cell."""
        rows: list[list[str]] = []
        for r in (n for n in node.walk(skip={"table"}) if n.tag == "tr"):
            row = []
            for c in r.children:
                if isinstance(c, Node) and c.tag in CELLS:
                    row.append(re.sub(r"[ \t]*\n\s*", " ", _tidy((yield self.inline(c)))).strip().replace("|", "\\|"))
            if row:
                rows.append(row)
        if not rows:
            return []
        sizes = [3] * max(map(len, rows))
        for r in rows:
            for i, x in enumerate(r):
                sizes[i] = max(sizes[i], len(x))
        if (len(rows) + 1) * (sum(sizes) + 3 * len(sizes) + 2) > self.most + 1:
            raise ExtractError("output_too_large")
        line = lambda r: "| " + " | ".join(x.ljust(n) for x, n in zip([*r, *[""] * (len(sizes) - len(r))], sizes)) + " |"
        rule = "| " + " | ".join("-" * n for n in sizes) + " |"
        return ["\n".join([line(rows[0]), rule, *map(line, rows[1:])])]


# -- pages


class ExtractError(ValueError):
    """kind: invalid_limit, input_too_large, invalid_base_url, too_many_links, output_too_large."""

    def __init__(self, kind: str) -> None:
        super().__init__(kind)
        self.kind = kind


@dataclass(frozen=True)
class Limits:
    max_body_bytes: int = 10 << 20
    max_output_bytes: int = 2 << 20
    max_links: int = 10_000


@dataclass(frozen=True)
class Page:
    title: str
    description: str
    markdown: str
    links: list[str]


def resolve(reference: str, base: whatwg.Url) -> str | None:
    try:
        return str(whatwg.parse(reference, base))
    except whatwg.UrlError:
        return None


def extract(html: str, base_url: str, limits: Limits = Limits()) -> Page:
    if not limits.max_body_bytes or not limits.max_output_bytes:
        raise ExtractError("invalid_limit")
    if len(html.encode()) > limits.max_body_bytes:
        raise ExtractError("input_too_large")
    try:
        base = whatwg.parse(base_url)
    except whatwg.UrlError as e:
        raise ExtractError("invalid_base_url") from e
    root = parse(html)
    nodes = list(root.walk())
    for n in nodes:
        if n.tag == "base" and "href" in n.attrs and (found := resolve(n.attrs["href"], base)):
            base = whatwg.parse(found)
            break
    title = next((sanitized(n.text()) for n in nodes if n.tag == "title"), "")
    metas = [n for n in nodes if n.tag == "meta"]
    stated = next((n.attrs.get("content", "") for n in metas if n.attrs.get("name") == "description"), None)
    if stated is None:
        stated = next((n.attrs.get("content", "") for n in metas if n.attrs.get("property") == "og:description"), "")
    stated = sanitized(stated)
    articles = [n for n in nodes if n.tag == "article"]
    content = next((n for n in nodes if n.tag == "main"), None) or (articles[0] if len(articles) == 1 else None) or next(n for n in nodes if n.tag == "body")
    links: dict[int, str] = {}
    order: dict[str, None] = {}
    todo = [content]
    while todo:
        n = todo.pop()
        if n is not content and n.tag in REMOVED:
            continue
        target = n.attrs.get("href") if n.tag == "a" else n.attrs.get("src") if n.tag == "img" else None
        if target is not None and (url := resolve(target, base)):
            links[id(n)] = url
            if n.tag == "a" and url not in order:
                if len(order) >= limits.max_links:
                    raise ExtractError("too_many_links")
                order[url] = None
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    markdown = _Markdown(links, limits.max_output_bytes).page(content).strip(WHITE) + "\n"
    if len(markdown.encode()) > limits.max_output_bytes:
        raise ExtractError("output_too_large")
    first = ""
    for line in markdown.splitlines():
        line = line.strip(WHITE)
        if line and not re.match(r"#|!\[|\[|\||```|---", line):
            first = line
            break
    chosen = stated if len(stated.encode()) >= 20 else first if len(first.encode()) >= 20 else ""
    return Page(title, truncated(chosen, 150), markdown, list(order))
