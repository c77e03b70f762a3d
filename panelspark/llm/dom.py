"""Pages as trees of blocks: a forgiving HTML reader that keeps what the extraction model looks at."""

from __future__ import annotations

import html
import re

#: Element names by their role in HTML. Texts of hidden ones are never shown, or are labels of controls.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select option datalist textarea button".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split()
)
#: An open element of the value is closed by the key's start tag, if no element of its scope lies between.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"}, "button": {"button"},
}
#: What may stand in a head; any other start tag, or text, ends it.
HEAD = frozenset("base basefont bgsound link meta title script style noscript noframes template".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav "
    "ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SCOPES = frozenset("ul ol dl table body html".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<rest>noscript|textarea|title|iframe)\b[^>]*>(?:(?:(?!</(?P=rest)\b).)*+</(?P=rest)\s*>)?"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)|[^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)


class Tree:
    """Nodes in document order: parent index (-1 for the root), name (#text for a run of text), attributes, text, link characters."""

    __slots__ = ("attrs", "links", "names", "parents", "texts")

    def __init__(self) -> None:
        self.parents: list[int] = [-1]
        self.names: list[str] = ["#root"]
        self.attrs: list[str] = [""]
        self.texts: list[str] = [""]
        self.links: list[int] = [0]

    def add(self, parent: int, name: str, attrs: str = "", text: str = "", links: int = 0) -> int:
        self.parents.append(parent)
        self.names.append(name)
        self.attrs.append(attrs)
        self.texts.append(text)
        self.links.append(links)
        return len(self.parents) - 1


_MAY_BE_LOOSE = re.compile(rf"<(?:{'|'.join(sorted(HIDDEN - {'head', 'title', 'style', 'script', 'option'}))})\b", re.I)


def _loose(page: str) -> set[int]:
    """Places (among all tokens) of the start tags of hidden elements that no end tag closes."""
    open_at: dict[str, list[int]] = {}
    for k, token in enumerate(_TOKEN.finditer(page) if _MAY_BE_LOOSE.search(page) else ()):
        name = (token["name"] or "").lower()
        if name not in HIDDEN or name in ("head", "option"):
            continue
        if not token["end"]:
            open_at.setdefault(name, []).append(k)
        elif open_at.get(name):
            open_at[name].pop()
    return {k for places in open_at.values() for k in places}


def parse(page: str) -> Tree:
    """Blocks of a page. Inline elements melt into the run of text they stand in; what is never shown is left out.

    Tags that HTML lets a page leave out are put in: a head ends with the first thing that may not stand in it. A hidden
    element that is never closed ends with the next block, so it takes no text but its own.
    """
    tree = Tree()
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements; inline and hidden ones point at their block
    run: list[str] = []
    loose = _loose(page)
    unclosed: list[int] = []  # depths of open elements that no end tag closes
    state = {"hidden": 0, "links": 0, "run_links": 0}

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                tree.add(stack[-1][1], "#text", "", text, min(len(text), state["run_links"]))
            run.clear()
        state["run_links"] = 0

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            name, _ = stack[-1]
            if name not in INLINE and not state["hidden"]:
                flush()
            stack.pop()
            state["hidden"] -= name in HIDDEN
            state["links"] -= name == "a"
        while unclosed and unclosed[-1] >= down_to:
            unclosed.pop()

    def end_head() -> None:
        if stack[-1][0] == "head":
            close(len(stack) - 1)

    def say(text: str) -> None:
        if stack[-1][0] == "head" and text.strip():
            end_head()
        if not state["hidden"]:
            text = html.unescape(text)  # a reference cannot go on behind a tag
            run.append(text)
            if state["links"]:
                state["run_links"] += len(text)

    at = 0
    for k, token in enumerate(_TOKEN.finditer(page)):
        if token.start() > at:
            say(page[at : token.start()])
        at = token.end()
        name = token["name"]
        if not name:
            continue
        name = name.lower()
        if token["end"]:
            if name == "br":
                say(" ")
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if name in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if name not in HEAD:
            end_head()
        if name in BLOCKS and unclosed:
            close(unclosed[0])
        if name in VOID:
            if name == "hr" and not state["hidden"]:
                flush()
            elif name == "br":
                say(" ")
            continue
        if name not in INLINE:
            shut = CLOSES.get(name, ())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in shut:
                    close(i)
                elif stack[i][0] in SCOPES:
                    break
            if name not in HIDDEN:  # a block ends an open paragraph
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
        if name in INLINE:
            stack.append((name, stack[-1][1]))
        elif name in HIDDEN or state["hidden"]:
            if k in loose:
                unclosed.append(len(stack))
            stack.append((name, stack[-1][1]))
        else:
            flush()
            stack.append((name, tree.add(stack[-1][1], name, token["attrs"] or "")))
        state["hidden"] += name in HIDDEN
        state["links"] += name == "a"
        if (token["attrs"] or "").rstrip().endswith("/") and name in HIDDEN:
            close(len(stack) - 1)
    say(page[at:])
    flush()
    return tree
