"""Main-text extraction by consensus host paths.

1. Every page's containers are scored: a container earns the text of the blocks right inside it,
   less what is linked, and half of what its child containers earn. From the best one the choice
   widens to the article around it, or to a parent that adds the page's title and little else.
2. The best container votes for its path of generalised tags and classes (digits removed, classes
   sorted). Spark counts the votes by host; the path with most votes wins, of tied ones that with the
   higher sum of scores.
3. Pages are read again with their host's path; a page where it finds nothing uses its own best
   container and those beside it of the same path and a quarter of its score.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
left out by tag, role and class wherever they stand. Where the sign is weak (a form, a class such as `sidebar-right`
or `widget`, which may as well name the layout around the article), the page as a whole decides: an element
stays if it holds a `main` or `article` with at least half of the page's running text, or more than four times
the running text of all that is not left out.

Defined results: null and empty pages, and pages without text, give empty text and n_chars 0; text
outside every tag counts as the body's; unclosed and stray tags are tolerated; long pages are read
whole; a null url belongs to the empty host; of paths still tied the alphabetically first wins; repeated
rows are extracted (and vote) as often as they occur; an empty table gives an empty result; further
columns are not looked at.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, stored

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: The same without regard to quotation marks, for a page in which one is never closed.
LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z_:][-\w:.]*)")
CLASS_WORD = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements whose text is never part of an article.
LEFT_OUT = frozenset("head script style noscript template nav footer aside button select option textarea input iframe svg object dialog menu canvas math title".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
#: Words in a class or id that mark what is no article.
LEFT_OUT_WORDS = frozenset(
    "ad ads adbox adsbygoogle adslot adunit alert announcement aside banner consent discussion disqus gdpr guestbook interstitial lightbox masthead menu modal nav navbar navigation navigator notice notices overlay pager pagination paywall popup promo promoted promotion rail reactions related replies reply respond responses share sharing skip social taboola outbrain toast toolbar topbar widget widgets".split()
)
#: Words that say nothing of the content: beside them a word of the list above still decides a class.
LAYOUT_WORDS = frozenset(
    "area articles bar blk block bottom box btn btns button buttons card cards center col column container content el element feed fixed footer form grid group head header holder icons inner item items left link links list main media message modal module outer pane panel placeholder post posts right row section site slot small sticky stories strip tab text thread title top unit view wrap wrapper wrappers zone".split()
)
#: Beginnings of such words, of the first word of a class.
LEFT_OUT_STEMS = re.compile(r"advert|breadcrumb|comment(?:s|ed|er|ers|ing|list|box|form|section|area)?$|cookie|footer|newsletter|sidebar|sponsor|subscri")
#: Of all these, those that may name what is around an article or of what kind it is.
WEAK_WORDS = re.compile(r"(?:aside|rail|related|promo|promoted|promotion|notice|notices|announcement|alert|banner|masthead|modal|overlay|discussion|toolbar|widget|widgets)$|sidebar|subscri")
#: Names of which one in a list of classes says that the element holds the content, whatever weak sign stands beside it.
CONTENT_WORDS = frozenset("article content copy entry main post prose story text".split())
#: A weakly marked element is looked at again from so many characters of running text.
RUNNING = 140
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold one block of running text; all other elements that are not inline are containers.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd figcaption caption td th address summary legend".split())
#: A start tag of the key ends open elements of the value, up to the nearest other container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


NONE, WEAK, STRONG = 0, 1, 2


def _signs(value: str) -> int:
    """How a list of classes, or an id, marks what is no article: by a name all of whose words but those of layout do.

    One strong name is enough; a weak one does not count beside a name that says it is the content.
    """
    sign, content = NONE, False
    for name in value.split():
        words = [w for w in CLASS_WORD.findall(name) if len(w) > 1]
        telling = [w for w in words if w not in LAYOUT_WORDS or w in LEFT_OUT_WORDS]
        stem = words and LEFT_OUT_STEMS.match(words[0])
        if stem or (telling and all(w in LEFT_OUT_WORDS or LEFT_OUT_STEMS.match(w) for w in telling)):
            weak = WEAK_WORDS.match(words[0]) if stem else all(WEAK_WORDS.match(w) for w in telling)
            sign = max(sign, WEAK if weak else STRONG)
        content |= name in CONTENT_WORDS
    return NONE if sign == WEAK and content else sign


class Page:
    """blocks: (container, text, length of linked text); containers: label, parent and the hash of their path.

    What is weakly marked is a region: read as all else is, and judged at the end. Time and memory are linear in
    the page, however deep or broken it is.
    """

    #: Looks at nested regions, from the outside in.
    LOOKS = 8

    def __init__(self, source: str):
        self.labels: list[str] = [""]
        self.parents: list[int] = [-1]
        self.hashes: list[int] = [0]
        self.blocks: list[tuple[int, str, int]] = []
        self.titles: list[int] = []  # places of h1 in blocks
        self._regions: list[int] = [-1]  # of each region that around it; all that is not marked is region 0
        self._in: list[int] = []  # the region of each block
        self._articles: list[tuple[int, int]] = []  # container and region of each article and main
        self._stack: list[list] = []  # tag, container, region (-1: left out), inline elements of the tag within it
        self._count: dict[str, int] = defaultdict(int)  # open elements by tag
        self._text: list[str] = []
        self._linked = 0
        self._links = 0
        at, n, form, low = 0, len(source), TAG, None
        while at < n:
            to = source.find("<", at)
            if to < 0:
                self._add(source[at:])
                break
            if to > at:
                self._add(source[at:to])
            after = source[to + 1 : to + 2]
            if after in ("!", "?"):
                end = source.find("-->", to + 4) if source.startswith("<!--", to) else source.find(">", to)
                at = n if end < 0 else end + (3 if source.startswith("<!--", to) else 1)
                continue
            found = form.match(source, to)
            if not found and form is TAG and LOOSE.match(source, to):
                form = LOOSE
                found = form.match(source, to)
            if not found:
                if not (after == "/" or "a" <= after.lower() <= "z"):
                    self._add("<")
                    at = to + 1
                    continue
                end = source.find(">", to)
                if end < 0:
                    break  # a tag that never ends
                at = end + 1
                continue
            at = found.end()
            tag = found.group(2).lower()
            if found.group(1):
                self._close(tag)
                continue
            self._open(tag, found.group(3) or "")
            if tag in RAW and not (found.group(3) or "").endswith("/"):
                low = source.lower() if low is None else low
                end = low.find(f"</{tag}", at)
                close = low.find(">", end) if end >= 0 else -1
                self._close(tag)
                at = close + 1 if close >= 0 else n
        self._flush()
        self._judge()

    def path(self, k: int) -> str:
        out = []
        while k > 0:
            out.append(self.labels[k])
            k = self.parents[k]
        return "".join(f"/{x}" for x in reversed(out))

    def _region(self) -> int:
        return self._stack[-1][2] if self._stack else 0

    def _where(self) -> int:
        return self._stack[-1][1] if self._stack else 0

    def _entered(self, sign: int) -> int:
        """The region of an element that is marked so."""
        around = self._region()
        if around < 0 or sign == STRONG:
            return -1
        if sign == NONE:
            return around
        self._regions.append(around)
        return len(self._regions) - 1

    def _push(self, tag: str, where: int, region: int) -> None:
        self._stack.append([tag, where, region, 0])
        self._count[tag] += 1

    def _drop(self) -> str:
        tag = self._stack.pop()[0]
        self._count[tag] -= 1
        return tag

    def _add(self, text: str) -> None:
        if self._region() >= 0:
            self._text.append(text)
            if self._links:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            if text:
                if any(e[0] == "h1" for e in self._stack[-3:]):
                    self.titles.append(len(self.blocks))
                self.blocks.append((self._where(), text, self._linked))
                self._in.append(self._region())
            self._text, self._linked = [], 0

    def _open(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag == "hr":
                self._flush()
            elif self._region() >= 0:
                self._text.append(" ")
            return
        if tag in INLINE:
            if tag == "a":
                self._links = 1
            if self._region() >= 0 and attributes and self._marked(tag, attributes)[1]:
                self._push(tag, self._where(), -1)
            elif self._stack and self._stack[-1][0] == tag:
                self._stack[-1][3] += 1
            return
        self._flush()
        self._links = 0
        if tag in CLOSES:
            self._pop(CLOSES[tag], {"ul", "ol", "dl", "table", "select"})
        if len(self._stack) > 1 and self._stack[-1][0] in INLINE and self._stack[-2][0] == "p":
            self._drop()
        if self._stack and self._stack[-1][0] == "p":
            self._drop()
        label, sign = self._marked(tag, attributes)
        region = self._entered(sign)
        where = self._where()
        if tag not in BLOCKS and region >= 0:
            self.labels.append(label)
            self.parents.append(where)
            self.hashes.append(_step(self.hashes[where], label))
            where = len(self.labels) - 1
            if tag in ("article", "main") and region > 0:
                self._articles.append((where, region))
        self._push(tag, where, region)

    def _pop(self, tags: set[str], limits: set[str]) -> None:
        if not any(self._count[t] for t in tags):
            return
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] in limits:
                return
            if self._stack[k][0] in tags:
                while len(self._stack) > k:
                    self._drop()
                return

    def _close(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self._links = 0
            if self._stack and self._stack[-1][0] == tag:
                if self._stack[-1][3]:
                    self._stack[-1][3] -= 1
                else:
                    self._drop()
            return
        if not self._count[tag]:
            if tag in BLOCKS:
                self._flush()
            return
        self._flush()
        self._links = 0
        while self._drop() != tag:
            pass

    def _marked(self, tag: str, attributes: str) -> tuple[str, int]:
        """(generalised tag and classes, how the element is marked as no part of an article)."""
        classes: list[str] = []
        sign = STRONG if tag in LEFT_OUT else WEAK if tag == "form" else NONE
        inside = self._count["article"] > 0 or self._count["main"] > 0
        if tag == "header" and not inside:
            sign = STRONG
        if attributes.strip(" /"):
            for m in ATTRIBUTE.finditer(attributes):
                name = (m.group(1) or m.group(5) or "").lower()
                value = (m.group(2) or m.group(3) or m.group(4) or "").lower()
                if name in ("class", "id") and tag not in ("html", "body"):
                    words = CLASS_WORD.findall(value)
                    if tag not in ("article", "main") or words[:1] and words[0] in ("comment", "ad", "advert", "sponsored"):
                        sign = max(sign, _signs(value), WEAK if "header" in words and not inside else NONE)
                    if name == "class":
                        classes += sorted({re.sub(r"[\d/]+", "", c) for c in value.split()} - {""})
                elif name == "role":
                    sign = max(sign, STRONG if value in LEFT_OUT_ROLES else NONE)
                elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                    sign = STRONG
        return ".".join([tag, *classes]), sign

    def _judge(self) -> None:
        """Keep the blocks of the regions that turn out to hold the article, and those of none."""
        if len(self._regions) == 1:
            return
        own = [0] * len(self._regions)  # running text of each region without that of regions in it
        held = [0] * len(self.labels)  # of each container
        for (where, text, linked), region in zip(self.blocks, self._in, strict=True):
            n = max(0, len(text) - 2 * linked)
            own[region] += n
            held[where] += n
        for k in range(len(held) - 1, 0, -1):
            held[self.parents[k]] += held[k]
        whole = own[:]  # with them
        for k in range(len(whole) - 1, 0, -1):
            whole[self._regions[k]] += whole[k]
        kept = [False] * len(own)
        kept[0] = True
        for where, region in self._articles:
            if held[where] >= RUNNING and 2 * held[where] >= whole[0]:
                while region > 0 and not kept[region]:
                    kept[region] = True
                    region = self._regions[region]
        for _ in range(self.LOOKS):
            rest = sum(n for n, k in zip(own, kept, strict=True) if k)
            open_ = [k for k in range(1, len(own)) if not kept[k] and kept[self._regions[k]]]
            top = max(open_, key=lambda k: (whole[k], -k), default=None)
            if top is None or whole[top] < RUNNING or whole[top] <= 4 * rest:
                break
            kept[top] = True
        places = [k for k, region in enumerate(self._in) if kept[region]]
        number = {k: n for n, k in enumerate(places)}
        self.titles = [number[t] for t in self.titles if t in number]
        self.blocks = [self.blocks[k] for k in places]

    def _scores(self) -> list[float]:
        score = [0.0] * len(self.labels)
        for where, text, linked in self.blocks:
            score[where] += max(0, len(text) - 2 * linked)
        for k in range(len(score) - 1, 0, -1):
            score[self.parents[k]] += score[k] / 2
        return score

    def best(self) -> tuple[int, float]:
        """The container of highest score, the first of equals."""
        score = self._scores()
        top = max(range(len(score)), key=lambda k: (score[k], -k))
        # An article as a whole stands for its parts; so does a parent that adds the title and little else.
        k = top
        while k > 0:
            if self.labels[k].partition(".")[0] == "article":
                top = k
            k = self.parents[k]
        size = [0] * len(self.labels)
        titled = [False] * len(self.labels)
        for where, text, _ in self.blocks:
            size[where] += len(text)
        for t in self.titles:
            titled[self.blocks[t][0]] = True
        for k in range(len(size) - 1, 0, -1):
            size[self.parents[k]] += size[k]
            titled[self.parents[k]] |= titled[k]
        while self.titles and (up := self.parents[top]) > 0 and not titled[top]:
            if size[up] - size[top] > size[top] / 4:
                break
            top = up
        return top, score[top]

    def own_choice(self) -> set[int]:
        """The best container with those beside it that have its path and at least a quarter of its score."""
        top, _ = self.best()
        score = self._scores()
        return {k for k in range(len(score)) if self.hashes[k] == self.hashes[top] and self.parents[k] == self.parents[top] and 4 * score[k] >= score[top]} | {top}

    def text_of(self, chosen: set[int]) -> str:
        inside = [False] * len(self.labels)
        for k in range(len(inside)):
            inside[k] = k in chosen or (k > 0 and inside[self.parents[k]])
        return "\n\n".join(text for where, text, _ in self.blocks if inside[where])

    def extract(self, path: str | None) -> str:
        if not self.blocks:
            return ""
        if path is not None:
            wanted = 0
            for label in path.split("/")[1:]:
                wanted = _step(wanted, label)
            chosen = {k for k, h in enumerate(self.hashes) if h == wanted}
            if chosen and (out := self.text_of(chosen)):
                return out
        return self.text_of(self.own_choice())


def _step(above: int, label: str) -> int:
    """Hash of a path from that of its parent's and its own label; the same in every process."""
    return (above * 0x9E3779B97F4A7C15 + zlib.crc32(label.encode()) + 1 + (len(label) << 33)) % (1 << 61)


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1))


def _voting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "html"):
        host, path, score = [], [], []
        for name, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(source or "")
            if page.blocks:
                top, value = page.best()
                host.append(name)
                path.append(page.path(top))
                score.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(score, pa.float64())], names=["host", "path", "score"])


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "html"):
        text = [Page(source or "").extract(path) for source, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), batch.column("path")],
            names=["page_id", "url", "text", "n_chars", "host_path"],
        )


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with the most votes of each host."""
    votes = pages.select(host_of().alias("host"), "html").mapInArrow(_voting, "host string, path string, score double")
    votes = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum(F.round("score")).alias("score"))
    return votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), -F.col("score"), F.col("path"))).alias("path"))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, host_path for every row of pages."""
    bounded_batches(pages)
    winners = stored(host_paths(pages), "paths")
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", host_of().alias("host"))
    return rows.join(winners, "host", "left").select("page_id", "url", "html", "path").mapInArrow(
        _reading, "page_id long, url string, text string, n_chars long, host_path string"
    )
