"""HTML to leaf blocks: runs of text between block-level tags, with their open elements.

A small reader in the way browsers forgive: unclosed and stray tags, quoted attributes with
angle brackets, raw elements, comments without an end. A page costs time in proportion to
its length.
"""

import html
import re
from dataclasses import dataclass

TOKEN = re.compile(
    r"""<!--(?P<note>.*?)(?:-->|\Z)|<(?P<shut>/?)(?P<tag>[a-zA-Z][^\s/>]*+)"""
    r"""(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<loose>/?[a-zA-Z][^>]*+>)|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Elements of the HTML standard.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
SIBLINGS = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, str], ...]  # (tag, its class, id and role) from the outermost on
    linked: int  # characters inside links


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(e for e in stack if e[0] not in INLINE or e[1]), linked))
            parts.clear()
        linked = 0

    def close_to(index: int) -> None:
        del stack[index:]

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if any(e[0] == "a" for e in stack):
                linked += len(text)

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or (m["loose"] and re.match(r"/?([^\s/>]+)", m["loose"])[1])
        if not tag:
            continue
        tag, shut, rest = tag.lower(), m["shut"] or (m["loose"] or "").startswith("/"), m["rest"] or ""
        if tag in RAW and not shut:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = end.end()
            continue
        if tag not in INLINE:
            flush()
        if shut:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close_to(i)
                    break
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close_to(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        if tag in SIBLINGS:
            same, stops = SIBLINGS[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in same.split():
                    close_to(i)
                    break
                if stack[i][0] in stops:
                    break
        if tag not in VOID and not rest.endswith("/"):
            names = " ".join(x for n in NAMES.findall(rest) for x in n[1:] if x) if "=" in rest else ""
            stack.append((tag, names.lower()))
    flush()
    return out
