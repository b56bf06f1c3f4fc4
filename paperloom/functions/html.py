"""A page as Markdown text, from the standard library's tolerant HTML parser."""

from __future__ import annotations

from html.parser import HTMLParser

SKIPPED = {"script", "style", "noscript"}
VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}


class Node:
    def __init__(self, tag: str):
        self.tag, self.children = tag, []

    def words(self) -> str:
        """All text below, pieces stripped and joined by a space."""
        return " ".join(p for c in self.children for p in [c.words() if isinstance(c, Node) else c.strip()] if p)

    def raw(self) -> str:
        return "".join(
            "\n" if isinstance(c, Node) and c.tag == "br" else c.raw() if isinstance(c, Node) else c for c in self.children
        )

    def all(self, *tags: str) -> list[Node]:
        return [n for c in self.children if isinstance(c, Node) for n in ([c] if c.tag in tags else []) + c.all(*tags)]


class _Tree(HTMLParser):
    """Builds nodes; an end tag closes the nearest open one of its name, a stray one is left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        names = [n.tag for n in self.open]
        if tag in names[1:]:
            del self.open[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        self.open[-1].children.append(data)


def markdown_table(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    lines = [
        "| " + " | ".join(
            c.replace("|", "\\|").replace("\n", "<br>") for c in [*r, *[""] * (width - len(r))]
        ) + " |" for r in rows
    ]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) if width else ""


def _blocks(node: Node) -> list[str]:
    out: list[str] = []
    for c in node.children:
        if not isinstance(c, Node):
            out.append(c.strip())
        elif c.tag in SKIPPED:
            continue
        elif len(c.tag) == 2 and c.tag[0] == "h" and c.tag[1] in "123456":
            out.append(f"{'#' * int(c.tag[1])} {words}" if (words := c.words()) else "")
        elif c.tag == "p" and not c.all("p", "table", "ul", "ol", "pre", "div"):
            out.append(c.words())
        elif c.tag in ("ul", "ol"):
            items = [words for i in c.children if isinstance(i, Node) and i.tag == "li" and (words := i.words())]
            out.append("\n".join(f"{f'{k}.' if c.tag == 'ol' else '-'} {t}" for k, t in enumerate(items, 1)))
        elif c.tag == "table":
            out.append(markdown_table([[x.words() for x in r.all("td", "th")] for r in c.all("tr")]))
        elif c.tag == "pre":
            out.append(f"```\n{c.raw().strip(chr(10))}\n```" if c.words() else "")
        else:
            out += _blocks(c)
    return [b for b in out if b]


def page_markdown(html: str) -> str:
    """Headings, paragraphs, lists, tables and code of a page, in order, with blank lines between.

    Navigation and footers stay; comments, scripts and styles go. A paragraph that another one
    follows unclosed holds the rest of the text and is written as its parts.
    """
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return "\n\n".join(_blocks(tree.root)).strip()
