"""What a page says, as columns: one parse a page, in Arrow batches; all judgement is left to Column functions.

facts() gives for each row of pages: page_id, url and whichever of these are asked for

* text: the visible texts joined by blanks; title, h1; headings (h1 and h2 texts); deeper (h3 and h4 texts)
* meta: content of meta tags by `name:...` and `property:...`, lower-cased, the first of each
* picks: selector -> value of the first element it fits; `selector@href` -> that element's link
* pairs: (label, value) of two-cell rows, definition lists, two-child boxes and `label: value` paragraphs
* links: (href, text, title) of anchors; items: flattened JSON-LD objects; micro: flattened microdata
* cued, dated: first text of a block that holds a cue, first short text that holds a date; sibling: the
  first long text beside the first heading's box; paragraph: the first long paragraph
* steps: links, buttons and other small elements that may lead to a next page
* n_company, n_logo, has_pager: counts of marked elements; next_data: the application state's JSON

Null and empty pages give nulls and empty collections; repeated rows and null ids pass as they are;
further columns are not looked at.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dom import Page

# What marks boxes, companies, logos, pagers, places and dates, and how long texts may be.
_BOX = re.compile(r"item|info.?row|detail|meta.?row|field", re.I)
_COMPANY = re.compile("company|exhibitor|vendor|sponsor", re.I)
_LOGO = re.compile("logo|brand", re.I)
_PAGER = re.compile("pagination|pager", re.I)
_PLACE = re.compile("location|venue|city|place", re.I)
_DATES = re.compile("startDate|endDate|datePublished", re.I)
_CUE = re.compile("venue:|location:|held at|taking place at", re.I)
_DATED = re.compile(r"\b(\d{1,2}[\s\-/]\w+[\s\-/]\d{2,4}|\w+\s+\d{1,2}[-–]\d{1,2},?\s*\d{4}|\d{4})\b")
_ONWARD = re.compile("next|selanjutnya|forward|arrow|[>›»]", re.I)
_CLICKED = frozenset("button li span div".split())
_NO_TEXT = frozenset("script style nav footer header".split())
_LINE, _LABEL, _LONG, _SHORT, _MARKED, _DATE, _BUTTON = 150, 40, 80, 100, 50, 80, 40
# End of fixed values.
_JSON = re.compile(r"ld\+json", re.I)


def _said(page: Page, k: int, linked: bool) -> str:
    """What an element says: its content if it is a meta tag, the target of a mail or phone link, else text, content or link."""
    own = page.attrs[k]
    if page.tags[k] == "meta":
        return own.get("content", "")
    href = own.get("href", "")
    if linked and page.tags[k] == "a" and href.startswith(("mailto:", "tel:")):
        return href.partition(":")[2].partition("?")[0]
    return page.text(k) or own.get("content", "") or href


def _picks(page: Page, selectors: list[str]) -> dict[str, str]:
    out = {}
    for s in selectors:
        k = page.first(s)
        if k is not None:
            out[s] = _said(page, k, "href^=" in s)
            if "href" in page.attrs[k]:
                out[f"{s}@href"] = page.attrs[k]["href"]
    return out


#: Where a label and its value stand, the plainest first.
_ROW, _LIST, _IN_BOX, _IN_LINE = range(4)


def _couples(page: Page, k: int) -> Iterator[tuple[int, int, int]]:
    """(kind, element of the label, element of the value) that element k brings together."""
    tag, own = page.tags[k], page.attrs[k].get("class", "")
    if tag == "dl":
        yield from ((_LIST, a, b) for a, b in zip(page.inside(k, "dt"), page.inside(k, "dd"), strict=False))
    for kind, held in ((_ROW, tag == "tr" and page.inside(k, "td", "th")), (_IN_BOX, own and _BOX.search(own) and page.children(k))):
        if held and len(held) == 2:
            yield kind, *held


def _notes(page: Page) -> list[tuple[int, int, str, str]]:
    """(kind, place, label, value) of all that may be a label with its value, in one walk; which count, and in what order, is not decided here."""
    out = []
    for k, tag in enumerate(page.tags):
        out += [(kind, a, page.text(a), page.text(b)) for kind, a, b in _couples(page, k)]
        if tag == "p" and page.size(k) <= _LINE:
            label, colon, value = page.text(k).partition(":")
            if colon:
                out.append((_IN_LINE, k, label, value))
    return out


def _long_texts(page: Page) -> list[tuple[str, str]]:
    """(where, text): the first long text beside the first heading's box, and the first long paragraphs of the page, its main part and its article."""
    found: dict[str, str] = {}
    heading = min((page.by_tag[h][0] for h in ("h1", "h2", "h3", "h4") if page.by_tag.get(h)), default=None)
    box = -1 if heading is None else page.parents[heading]
    scopes = {name: page.by_tag[name][0] for name in ("main", "article") if page.by_tag.get(name)}
    for k, tag in enumerate(page.tags):
        if page.size(k) <= _LONG:
            continue
        if box >= 0 and k >= page.ends[box] and page.parents[k] == page.parents[box] and tag not in _NO_TEXT and "beside" not in found:
            found["beside"] = page.text(k, " ")
        if tag == "p":
            for where in ("page", *(name for name, s in scopes.items() if s < k < page.ends[s])):
                if where not in found:
                    found[where] = page.text(k)
    return [*found.items(), *((f"has {name}", "") for name in scopes)]


def flattened(value: object, prefix: str = "", depth: int = 0) -> Iterator[tuple[str, str]]:
    """(dotted path, text) of the strings in a JSON value, list places as numbers."""
    if isinstance(value, str):
        if value:
            yield prefix, value
    elif depth < 6 and isinstance(value, (dict, list)):
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            yield from flattened(v, f"{prefix}.{k}" if prefix else str(k), depth + 1)


def _items(page: Page) -> list[list[tuple[str, str]]]:
    out = []
    for k in page.with_tags("script"):
        if _JSON.search(page.attrs[k].get("type", "")):
            try:
                data = json.loads(page.raw.get(k, ""))
            except (ValueError, RecursionError):
                continue
            for item in data if isinstance(data, list) else [data]:
                if isinstance(item, dict):
                    below = item.get("@graph")
                    out += [item, *(g for g in below if isinstance(g, dict))] if isinstance(below, list) else [item]
    return [list(dict(flattened({k: v for k, v in item.items() if k != "@graph"})).items()) for item in out]


def _micro(page: Page) -> list[list[tuple[str, str]]]:
    out = []
    for box in page.by_attr.get("itemscope", []):
        item: dict[str, str] = {}
        for k in page._between(page.by_attr.get("itemprop", []), box):
            own = page.attrs[k]
            item.setdefault(own["itemprop"], own.get("content") or (own.get("href") if page.tags[k] in ("a", "link") else "") or page.text(k))
        out.append([(k, v) for k, v in item.items() if v])
    return out


def _meta(page: Page) -> list[tuple[str, str]]:
    out: dict[str, str] = {}
    for k in page.with_tags("meta"):
        own = page.attrs[k]
        for by in ("name", "property"):
            if by in own:
                out.setdefault(f"{by}:{own[by].lower()}", own.get("content", ""))
    return list(out.items())


def _cued(page: Page) -> str | None:
    """The text of the first block that a cue lies in: cues are looked for once, in the page's whole text."""
    cues = [m.span() for m in _CUE.finditer("".join(page.texts))]
    for k in page.with_tags("p", "div", "span", "li") if cues else ():
        begin, end = page.sizes[page.starts[k]], page.sizes[page.stops[k]]
        at = bisect_left(cues, (begin, 0))
        if at < len(cues) and cues[at][1] <= end:
            return page.text(k)
    return None


def _marked_date(page: Page) -> str | None:
    for k in page.where("itemprop", _DATES):
        return page.attrs[k].get("content") or page.text(k)
    return None


def _short_date(page: Page) -> str | None:
    """The first text of a small element that holds a date."""
    small = (page.text(k) for k in page.with_tags("time", "span", "div", "p") if 4 <= page.size(k) < _SHORT)
    return next(filter(_DATED.search, small), None)


def _steps(page: Page) -> list[dict[str, str]]:
    """Links, and small or marked elements that can be clicked, that may lead on."""
    out = []
    for k, tag in enumerate(page.tags):
        own = page.attrs[k]
        if (tag == "a" and "href" in own) or tag in _CLICKED:
            said = page.text(k) if page.size(k) <= _BUTTON else ""
            if any(_ONWARD.search(x) for x in (said, own.get("class", ""), own.get("aria-label", ""), own.get("rel", ""))):
                out.append({"tag": tag, "href": own.get("href", ""), "text": said, "cls": own.get("class", ""), "aria": own.get("aria-label", ""), "rel": own.get("rel", "").lower(), "id": own.get("id", "")})
    return out


def _first_text(page: Page, tag: str) -> str | None:
    return next((page.text(k) for k in page.with_tags(tag)), None)


_TEXTS, _MAP = pa.list_(pa.string()), pa.map_(pa.string(), pa.string())
_NOTES = pa.list_(pa.struct([("kind", pa.int32()), ("place", pa.int32()), ("label", pa.string()), ("value", pa.string())]))
_LINK = pa.list_(pa.struct([("href", pa.string()), ("text", pa.string()), ("title", pa.string())]))
_STEPS = pa.list_(pa.struct([(c, pa.string()) for c in ("tag", "href", "text", "cls", "aria", "rel", "id")]))
#: name -> (SQL type, Arrow type, how it is had from a page and the selectors)
_PARTS: dict[str, tuple[str, pa.DataType, Callable]] = {
    "text": ("string", pa.string(), lambda p, s: " ".join(p.texts)),
    "title": ("string", pa.string(), lambda p, s: _first_text(p, "title")),
    "h1": ("string", pa.string(), lambda p, s: _first_text(p, "h1")),
    "headings": ("array<string>", _TEXTS, lambda p, s: [p.text(k) for k in p.with_tags("h1", "h2")]),
    "deeper": ("array<string>", _TEXTS, lambda p, s: [p.text(k) for k in p.with_tags("h3", "h4")]),
    "meta": ("map<string,string>", _MAP, lambda p, s: _meta(p)),
    "picks": ("map<string,string>", _MAP, lambda p, s: list(_picks(p, s).items())),
    "notes": ("array<struct<kind:int,place:int,label:string,value:string>>", _NOTES, lambda p, s: [dict(zip(("kind", "place", "label", "value"), n, strict=True)) for n in _notes(p)]),
    "long_texts": ("map<string,string>", _MAP, lambda p, s: _long_texts(p)),
    "marked_date": ("string", pa.string(), lambda p, s: _marked_date(p)),
    "short_date": ("string", pa.string(), lambda p, s: _short_date(p)),
    "links": ("array<struct<href:string,text:string,title:string>>", _LINK, lambda p, s: [{"href": p.attrs[k]["href"], "text": p.text(k), "title": p.attrs[k].get("title", "")} for k in p.with_tags("a") if "href" in p.attrs[k]]),
    "items": ("array<map<string,string>>", pa.list_(_MAP), lambda p, s: _items(p)),
    "micro": ("array<map<string,string>>", pa.list_(_MAP), lambda p, s: _micro(p)),
    "place": ("string", pa.string(), lambda p, s: next((p.text(k) for k in p.where("class", _PLACE)), None)),
    "cued": ("string", pa.string(), lambda p, s: _cued(p)),
    "steps": ("array<struct<tag:string,href:string,text:string,cls:string,aria:string,rel:string,id:string>>", _STEPS, lambda p, s: _steps(p)),
    "n_company": ("int", pa.int32(), lambda p, s: sum(1 for _ in p.where("class", _COMPANY))),
    "n_logo": ("int", pa.int32(), lambda p, s: sum(p.tags[k] == "img" for k in p.where("class", _LOGO))),
    "has_pager": ("boolean", pa.bool_(), lambda p, s: next(p.where("class", _PAGER), None) is not None),
    "next_data": ("string", pa.string(), lambda p, s: next((p.raw.get(k) for k in p.with_tags("script") if p.attrs[k].get("id") == "__NEXT_DATA__"), None)),
}


def _pairs() -> Column:
    """Notes in the order of their kinds, then of the page; a line counts if its label is short."""
    good = F.filter("notes", lambda n: (n["kind"] != _IN_LINE) | (F.length(F.trim(n["label"])) < _LABEL))
    return F.transform(F.array_sort(good), lambda n: F.struct(n["label"].alias("label"), n["value"].alias("value")))


def _paragraph() -> Column:
    """The first long paragraph of the main part if the page has one, else of the article, else of the page."""
    text = lambda where: F.try_element_at("long_texts", F.lit(where))
    return F.when(text("has main").isNotNull(), text("main")).when(text("has article").isNotNull(), text("article")).otherwise(text("page"))


#: Parts that Column rules make of others: name -> (the others, the rule).
_RULED: dict[str, tuple[list[str], Callable[[], Column]]] = {
    "pairs": (["notes"], _pairs),
    "sibling": (["long_texts"], lambda: F.try_element_at("long_texts", F.lit("beside"))),
    "paragraph": (["long_texts"], _paragraph),
    "dated": (["marked_date", "short_date"], lambda: F.coalesce(F.left("marked_date", F.lit(_MARKED)), F.left("short_date", F.lit(_DATE)))),
}


def facts(pages: DataFrame, parts: list[str], selectors: list[str] | None = None) -> DataFrame:
    """page_id, url and the asked parts of every row of pages."""
    wanted = parts
    parts = list(dict.fromkeys(x for p in wanted for x in (_RULED[p][0] if p in _RULED else [p])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                held: list[list] = [[] for _ in parts]
                for source in piece.column("html").to_pylist():
                    page = Page(source)
                    for column, name in zip(held, parts, strict=True):
                        column.append(_PARTS[name][2](page, selectors or []))
                columns = [pa.array(column, _PARTS[name][1]) for column, name in zip(held, parts, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), *columns], names=["page_id", "url", *parts])

    schema = ", ".join(["page_id long", "url string", *(f"{p} {_PARTS[p][0]}" for p in parts)])
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, schema)
    return held.select("page_id", "url", *[_RULED[p][1]().alias(p) if p in _RULED else F.col(p) for p in wanted])
