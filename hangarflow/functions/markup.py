"""Tolerant reading of one markup text, run inside Arrow batches.

The reader only finds elements and their text; everything that decides what
counts as a chunk, a warning or a title is a Spark expression on its result.

Rules: names and attribute names compare in lower case; an end tag closes the
nearest open element of that name together with anything left open inside it,
and is ignored when there is none; void HTML tags hold nothing; a ``p`` start
ends an open ``p``; script and style text is no text.
"""

from __future__ import annotations

import html
import re

_END_NAME = re.compile(r"[A-Za-z_][^\s>/]*")
_START = re.compile(r"([A-Za-z_][^\s>/]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_SUBSET_END = re.compile(r"\]\s*>")
_ATTR = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = ("script", "style")
_WITH_ATTRS = frozenset(("dmcode", "dmc", "figure", "graphic"))
# Elements whose text the operators ask for; others are followed, not reported.
_REPORTED = frozenset(
    "dmodule content dmcode dmc systemcode subsystemcode subsubsystemcode assycode"
    " disassycode disassycodevariant dmtitle title techname infoname task tasknumber"
    " levelledpara proceduralstep para p step warning caution note description"
    " warningandcautionref figure graphic caption legend dmref internalref externalref".split()
)


class _Open:
    __slots__ = ("name", "pos", "first", "count", "title", "caption", "legend", "attrs", "last")

    def __init__(self, name, pos, attrs, first):
        self.name, self.pos, self.attrs, self.first = name, pos, attrs, first
        self.last, self.count = pos, 0
        self.title = self.caption = self.legend = None


class _Finder:
    """``str.find`` that remembers what does not occur any more, so no text is scanned again and again."""

    def __init__(self, text):
        self._text, self._gone = text, {}

    def __call__(self, what, at):
        if at >= self._gone.get(what, len(self._text) + 1):
            return -1
        found = self._text.find(what, at)
        if found < 0:
            self._gone[what] = at
        return found


def _tokens(markup):
    """(start, end, kind, name or text, attributes) of everything that is not plain text."""
    find, length = _Finder(markup), len(markup)
    no_subset_end = False
    at = find("<", 0)
    while at >= 0:
        end, kind, name, attrs = -1, "", "", ""
        if markup.startswith("<!--", at):
            end = find("-->", at + 4)
            end = length if end < 0 else end + 3
        elif markup.startswith("<![CDATA[", at):
            close = find("]]>", at + 9)
            kind, name = "text", markup[at + 9 : length if close < 0 else close]
            end = length if close < 0 else close + 3
        elif markup.startswith("<?", at):
            end = find("?>", at + 2)
            end = end + 2 if end >= 0 else -1
        elif markup.startswith("<!", at):
            close = find(">", at + 2)
            subset = markup.find("[", at + 2, close) if close >= 0 else -1
            if subset < 0:
                end = close + 1 if close >= 0 else -1
            elif not no_subset_end:
                ending = _SUBSET_END.search(markup, subset + 1)
                no_subset_end = ending is None
                end = ending.end() if ending else -1
        elif find(">", at + 1) < 0:
            end = -1
        elif markup.startswith("</", at):
            found = _END_NAME.match(markup, at + 2)
            if found:
                kind, name, end = "end", found[0].lower(), find(">", found.end()) + 1 or -1
        else:
            found = _START.match(markup, at + 1)
            if found:
                kind, name, attrs, end = "start", found[1].lower(), found[2], found.end()
        if end < 0:
            at = find("<", at + 1)
            continue
        moved = yield at, end, kind, name, attrs
        at = find("<", end if moved is None else moved)


def _dense(strings):
    return "".join(s.strip() for s in strings)


def read_elements(markup: str) -> tuple[list[str], list[dict]]:
    """Text nodes, and the reported elements in document order after one for the whole text.

    An element's text is the run of ``count`` nodes that begins with its ``first``
    one (counted from 1), so nested elements do not repeat their text. The time is
    linear in the length of the markup.
    """
    nodes: list[str] = []
    root = _Open("#document", 0, {}, 1)
    stack, found, count = [root], [root], 0
    depths: dict[str, list[int]] = {}  # places in the stack of the open elements of each name

    def close():
        done = stack.pop()
        done.last, done.count = count, len(nodes) + 1 - done.first
        if stack:
            depths[done.name].pop()
        # The first inner title, caption and legend belong to every ancestor. One that has
        # it already got it together with all elements around it.
        if done.name in ("title", "caption", "legend") and stack and getattr(stack[-1], done.name) is None:
            text = _dense(nodes[done.first - 1 :])
            for outer in reversed(stack):
                if getattr(outer, done.name) is not None:
                    break
                setattr(outer, done.name, text)

    def close_nearest(name):
        if depths.get(name):
            depth = depths[name][-1]
            while len(stack) > depth:
                close()

    def add_text(piece):
        if piece:
            nodes.append(piece)

    at, end = 0, len(markup)
    tokens, jump = _tokens(markup), None
    while True:
        try:
            start, stop, kind, name, raw_attrs = tokens.send(jump)
        except StopIteration:
            break
        jump = None
        add_text(html.unescape(markup[at:start]))
        at = stop
        if kind == "text":
            add_text(name)
        elif kind == "end":
            close_nearest(name)
        elif kind == "start":
            if name in _HIDDEN:
                closing = re.compile(f"</{name}[^>]*>", re.I).search(markup, at)
                at = jump = closing.end() if closing else end
                continue
            if name == "p":
                close_nearest("p")
            count += 1
            attrs = {}
            if name in _WITH_ATTRS:
                attrs = {
                    m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "")
                    for m in _ATTR.finditer(raw_attrs)
                }
            element = _Open(name, count, attrs, len(nodes) + 1)
            if name in _REPORTED:
                found.append(element)
            if name not in _VOID:
                depths.setdefault(name, []).append(len(stack))
                stack.append(element)
                if raw_attrs.endswith("/"):
                    close()
    add_text(html.unescape(markup[at:]))
    while stack:
        close()
    return nodes, [
        {
            "pos": e.pos,
            "last": e.last,
            "name": e.name,
            "first": e.first,
            "count": e.count,
            "title": e.title or "",
            "caption": (e.caption if e.caption is not None else e.legend) or "",
            "attrs": list(e.attrs.items()),
        }
        for e in found
    ]
