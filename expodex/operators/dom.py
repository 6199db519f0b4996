"""A page's elements as flat lists in document order, and the few selector forms the extractors need.

One pass over the source by one pattern; every element knows its parent and the range of elements and
texts below it, so the text of an element is a slice. Time and memory are linear in the page: once a
quotation never ends, later tags end at their next `>`; once no `>` follows, the rest is text.

Null and empty pages have no elements; unclosed and stray tags are tolerated; pages of any length are
read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: A start tag of the key ends an open element of the values, unless a fence lies between.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "option": {"option"}}
_FENCES = frozenset("ul ol dl table select div section article body".split())


class Page:
    """Element k has tags[k], attrs[k], parents[k]; below it lie elements k+1 .. ends[k]-1 and texts starts[k] .. stops[k]-1."""

    def __init__(self, source: str | None):
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parents: list[int] = []
        self.starts: list[int] = []
        self.stops: list[int] = []
        self.ends: list[int] = []
        self.texts: list[str] = []
        self.raw: dict[int, str] = {}
        self.by_tag: dict[str, list[int]] = defaultdict(list)
        self.by_attr: dict[str, list[int]] = defaultdict(list)
        self._open: list[int] = []
        self._count: dict[str, int] = defaultdict(int)
        self._read(source or "")
        while self._open:
            self._end()
        size = 0
        self.sizes = [0]
        for t in self.texts:
            size += len(t)
            self.sizes.append(size)

    def _read(self, source: str) -> None:
        at, n, tag = 0, len(source), _TAG
        low = None
        while at < n:
            to = source.find("<", at)
            if to < 0:
                self._text(source[at:])
                return
            if to > at:
                self._text(source[at:to])
            after = source[to + 1 : to + 2]
            if after in ("!", "?"):
                comment = source.startswith("<!--", to)
                end = source.find("-->" if comment else ">", to + (4 if comment else 2))
                at = n if end < 0 else end + (3 if comment else 1)
                continue
            found = tag.match(source, to)
            if not found and tag is _TAG and _LOOSE.match(source, to):
                tag = _LOOSE
                found = tag.match(source, to)
            if not found:
                if (after.isalpha() or after == "/") and source.find(">", to) < 0:
                    self._text(source[to:])
                    return
                self._text("<")
                at = to + 1
                continue
            at = found.end()
            name = found.group(2).lower()
            if found.group(1):
                self._close(name)
                continue
            k = self._start(name, found.group(3))
            if name in RAW:
                low = source.lower() if low is None else low
                end = low.find(f"</{name}", at)
                self.raw[k] = source[at : n if end < 0 else end]
                close = source.find(">", end) if end >= 0 else -1
                at = n if close < 0 else close + 1
                self._end()

    def _text(self, text: str) -> None:
        text = (unescape(text) if "&" in text else text).strip()
        if text:
            self.texts.append(text)

    def _start(self, name: str, attributes: str) -> int:
        ends = _ENDS.get(name)
        if ends and any(self._count[e] for e in ends):
            for depth in range(len(self._open) - 1, -1, -1):
                held = self.tags[self._open[depth]]
                if held in ends:
                    while len(self._open) > depth:
                        self._end()
                    break
                if held in _FENCES:
                    break
        own: dict[str, str] = {}
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                value = m.group(2) or m.group(3) or m.group(4) or ""
                own.setdefault(m.group(1).lower(), unescape(value) if "&" in value else value)
        k = len(self.tags)
        self.tags.append(name)
        self.attrs.append(own)
        self.parents.append(self._open[-1] if self._open else -1)
        self.starts.append(len(self.texts))
        self.stops.append(len(self.texts))
        self.ends.append(k + 1)
        self.by_tag[name].append(k)
        for a in own:
            self.by_attr[a].append(k)
        if name not in VOID:
            self._open.append(k)
            self._count[name] += 1
        return k

    def _end(self) -> None:
        k = self._open.pop()
        self._count[self.tags[k]] -= 1
        self.stops[k], self.ends[k] = len(self.texts), len(self.tags)

    def _close(self, name: str) -> None:
        if self._count[name]:
            while self.tags[self._open[-1]] != name:
                self._end()
            self._end()

    def text(self, k: int, separator: str = "") -> str:
        return separator.join(self.texts[self.starts[k] : self.stops[k]])

    def size(self, k: int) -> int:
        """Characters of the element's texts."""
        return self.sizes[self.stops[k]] - self.sizes[self.starts[k]]

    def inside(self, k: int, *names: str) -> list[int]:
        """Elements below k with one of these tags, in document order."""
        held = [j for n in names for j in self._between(self.by_tag.get(n, []), k)]
        return sorted(held) if len(names) > 1 else held

    def _between(self, places: list[int], k: int) -> list[int]:
        return places[bisect_left(places, k + 1) : bisect_left(places, self.ends[k])]

    def children(self, k: int) -> list[int]:
        out, j = [], k + 1
        while j < self.ends[k]:
            out.append(j)
            j = self.ends[j]
        return out

    def with_tags(self, *names: str) -> list[int]:
        return sorted(j for n in names for j in self.by_tag.get(n, [])) if len(names) > 1 else self.by_tag.get(names[0], [])

    def where(self, attribute: str, wanted: re.Pattern) -> Iterator[int]:
        """Elements whose attribute the pattern is found in, in document order."""
        return (k for k in self.by_attr.get(attribute, []) if wanted.search(self.attrs[k][attribute]))

    def first(self, selector: str) -> int | None:
        """The first element in document order that a selector fits; blanks mean "inside"."""
        *outer, last = _compiled(selector)
        tag, classes, name, _, _ = last
        for k in self.by_attr.get(name, ()) if name else self.by_tag.get(tag, ()) if tag else self.by_attr.get("class", ()):
            if self._fits(k, last):
                need, up = len(outer) - 1, self.parents[k]
                while up >= 0 and need >= 0:
                    need -= self._fits(up, outer[need])
                    up = self.parents[up]
                if need < 0:
                    return k
        return None

    def _fits(self, k: int, part: tuple) -> bool:
        tag, classes, name, how, value = part
        own = self.attrs[k]
        if tag and self.tags[k] != tag or classes and not classes <= set(own.get("class", "").split()):
            return False
        if name is None:
            return True
        held = own.get(name)
        return held is not None and (how is None or (held == value if how == "=" else value in held if how == "*=" else held.startswith(value)))


_SIMPLE = re.compile(r"([a-zA-Z][a-zA-Z0-9]*)?((?:\.[\w-]+)*)(?:\[([\w-]+)(?:([*^]?=)'([^']*)')?\])?\Z")


@lru_cache(maxsize=512)
def _compiled(selector: str) -> tuple:
    parts = []
    for part in re.findall(r"(?:[^\s\[]|\[[^\]]*\])+", selector):
        m = _SIMPLE.match(part)
        if not m:
            raise ValueError(f"unsupported selector: {selector}")
        tag, classes, name, how, value = m.groups()
        parts.append((tag, frozenset(c for c in classes.split(".") if c), name, how, value))
    return tuple(parts)
