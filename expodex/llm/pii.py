"""Personal data by weak supervision.

Base spans follow fixed patterns (email, ip, card, phone) and always stay. Candidates beyond them are
written-out addresses, defanged IP addresses, card numbers with other separators, and numbers without
the plus sign. They and the base spans are judged by labelers that vote yes, no or not at all, and that
do not know which spans are base: two regex labelers (form, plausibility), a gazetteer (tables of
domains, calling prefixes and card issuers) and a context labeler. Expectation maximisation over the
counts of vote patterns estimates every labeler's reliability and each pattern's probability; a
logistic span classifier on discrete features is then fitted to these, and decides on candidates.
Only counts of patterns and features reach the driver: at most PATTERNS * FEATURES numbers.

Matching is linear in the text: candidates for numbers lie in maximal runs of digits, blanks,
parentheses, dots and hyphens; addresses are found around each `@`.

Defined results: null and empty texts have no spans; repeated rows are judged alike, each counting
in the estimates; spans of different kinds may overlap, added spans never overlap base ones; very
long texts are read whole; null doc_ids pass through; an empty table gives an empty result; further
columns are not looked at (redacted() keeps them).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks

KINDS = ("email", "ip", "card", "phone")
LABELERS = 4
PATTERNS = len(KINDS) * 3**LABELERS
#: Sizes of the discrete features: kind, digits, separators, context, edge, tail.
SIZES = (4, 8, 4, 3, 2, 3)
FEATURES = int(np.prod(SIZES))
KEEP = 0.5

_REGION = re.compile(r"[0-9][0-9 ().-]*")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_SPELLED = re.compile(r"(?i)[\[({]\s{0,3}at\s{0,3}[\])}]")
_BEFORE = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s{0,3}\Z")
_AFTER = re.compile(r"(?i)\s{0,3}[A-Za-z0-9-]{1,63}(?:\s{0,3}(?:[\[({]\s{0,3}dot\s{0,3}[\])}]|\.)\s{0,3}[A-Za-z0-9-]{1,63}){1,5}")
_WORDED = re.compile(r"(?i) at (?=[A-Za-z0-9-]{1,63} dot [A-Za-z])")
_WORDS_AFTER = re.compile(r"(?i)[A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63}){1,4}")
_DEFANGED = re.compile(r"(?i)(?<![0-9.\]])[0-9]{1,3}(?: ?[\[(](?:\.|dot)[\])] ?[0-9]{1,3}){3}(?![0-9])")
_OTHER_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:[ .-]{1,3}[0-9]{3,6}){2,4}(?![0-9])")
_PLAIN = re.compile(r"(?<![0-9])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
_ABROAD = re.compile(r"(?<![0-9])00[ .-]?[1-9][0-9]{0,2}(?:[ .-]{1,2}\(?[0-9]{1,5}\)?){2,5}(?![0-9])")
_SLASHED = re.compile(r"(?<![0-9/])0[0-9]{1,4}/[0-9]{4,10}(?![0-9/])")
_RUN = re.compile(r"(?<![0-9])[0-9]{9,15}(?![0-9])")
_CUES = re.compile(
    r"(?i)(?:phone|tel|call|fax|mobile|cell|whatsapp|contact|mail|write|reach|tél|teléfono|telefon|handy|correo|courriel|kontakt|card|visa|mastercard|amex|credit|karte|tarjeta|carte|ip|host|server|login from)\W{0,4}\w{0,8}\W{0,4}\Z"
)
_AGAINST = re.compile(r"(?i)(?:isbn|issn|order|invoice|version|ref|page|part|serial|sku|no|nr|id|art|release|build)\W{0,4}\Z")


@dataclass(frozen=True)
class Gazetteer:
    """Tables that speak for a span: ends of mail domains, calling prefixes, first digits of card numbers."""

    domains: frozenset[str] = frozenset(
        "com org net edu gov mil int info biz io ai app dev eu us uk de fr es it nl be ch at pl cz dk se no fi pt gr ie ru ua tr cn jp kr in br mx ar cl co au nz za ca mail email gmail outlook hotmail yahoo proton icloud gmx web example test".split()
    )
    prefixes: frozenset[str] = frozenset(
        "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 234 254 351 352 353 354 355 356 357 358 359 370 371 372 380 381 385 386 420 421 852 886 961 962 965 966 971 972 974".split()
    )
    issuers: frozenset[str] = frozenset("4 51 52 53 54 55 22 23 24 25 26 27 34 37 36 38 6011 65 62 35 50 56 57 58 60".split())


TABLES = Gazetteer()


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d += d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the fixed patterns, in order of kind and start."""
    emails, ips, cards, phones = [], [], [], []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            emails.append((0, start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    for region in _REGION.finditer(text):
        start = region.start()
        own = region.group()
        if len(own) < 7:
            if start and text[start - 1] == "+":
                pass  # nine digits don't fit
            continue
        if "." in own:
            for m in _IP.finditer(own):
                if all(len(g := p.lstrip("0")) <= 3 and int(g or 0) <= 255 for p in m.groups()):
                    ips.append((1, start + m.start(), start + m.end()))
        if len(own) >= 9:
            for m in _CARD.finditer(own):
                if m.end() - m.start() >= 13:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and _luhn(digits):
                        cards.append((2, start + m.start(), start + m.end()))
            if start and text[start - 1] == "+":
                number = own.rstrip(" ().-")
                if 9 <= sum(c.isdigit() for c in number) <= 15:
                    phones.append((3, start - 1, start + len(number)))
    return emails + ips + cards + phones


def more_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the fixed patterns miss and that overlap none of theirs; of overlapping ones the first, then the longest."""
    found = []
    for marks, after_of in ((_SPELLED, _AFTER), (_WORDED, _WORDS_AFTER)):
        for m in marks.finditer(text):
            before, after = _BEFORE.search(text, max(0, m.start() - 67), m.start()), after_of.match(text, m.end())
            if before and after:
                found.append((0, before.start(), after.end()))
    if "[" in text or "(" in text:
        found += [(1, m.start(), m.end()) for m in _DEFANGED.finditer(text)]
    if "/" in text:
        found += [(3, m.start(), m.end()) for m in _SLASHED.finditer(text)]
    for region in _REGION.finditer(text):
        a, b = region.span()
        if b - a < 9:
            continue
        start = a - (a > 0 and text[a - 1] == "(")
        found += [(3, m.start(), m.end()) for m in _PLAIN.finditer(text, start, b)]
        found += [(3, m.start(), m.end()) for m in _ABROAD.finditer(text, a, b) if 9 <= sum(c.isdigit() for c in m.group()) <= 17]
        found += [(3, m.start(), m.end()) for m in _RUN.finditer(text, a, b) if _CUES.search(text, max(0, m.start() - 32), m.start())]
        for m in _OTHER_CARD.finditer(text, a, b):
            if 13 <= sum(c.isdigit() for c in m.group()) <= 19:
                found.append((2, m.start(), m.end()))
    if not found:
        return []
    taken = sorted(base, key=lambda s: s[1])
    ends = [s[1] for s in taken]
    out, last = [], 0
    for kind, a, b in sorted(set(found), key=lambda s: (s[1], -s[2], s[0])):
        k = bisect_left(ends, b)
        if a >= last and not any(y > a for _, _, y in taken[max(0, k - 8) : k]):
            out.append((kind, a, b))
            last = b
    return out


def _email_votes(own: str, edge: bool, tables: Gazetteer) -> tuple[int, int, int, int]:
    words = re.findall(r"[a-z]+", own.lower()[-80:])
    marked = "@" in own or any(c in own for c in "[({")
    listed = 2 if words and words[-1] in tables.domains else 1 if not marked or (words and len(words[-1]) > 8) else 0
    return 2 if marked else 0, 2 if edge else 1, listed, 2 if listed == 2 else 0


def _ip_votes(own: str, tables: Gazetteer) -> tuple[int, int, int, int]:
    parts = [int(p) for p in re.findall("[0-9]+", own)[:4]]
    defanged = not set(own) <= set("0123456789.")
    fits = all(p <= 255 for p in parts)
    return 2 if defanged else 0, 2 if fits else 1, 2 if fits and 1 <= parts[0] <= 223 else 1, int(defanged)


def _card_votes(own: str, tables: Gazetteer) -> tuple[int, int, int, int]:
    groups = re.findall("[0-9]+", own)
    digits = "".join(groups)
    shape = [len(g) for g in groups]
    good = _luhn(digits)
    issued = any(digits.startswith(p) for p in tables.issuers)
    return 2 if shape in ([4, 4, 4, 4], [4, 6, 5]) else 0 if len(shape) == 1 else 1, 2 if good else 1, 2 if issued else 1, 2 if good else 0


def _phone_votes(own: str, tables: Gazetteer) -> tuple[int, int, int, int]:
    digits = sum(c.isdigit() for c in own)
    abroad = own.startswith(("+", "00"))
    number = re.sub("[^0-9]", "", own)[2 if own.startswith("00") else 0 :]
    known = any(number.startswith(p) for p in tables.prefixes)
    form = 2 if abroad or own[:1] == "(" else 1 if own.count(".") > 1 else 0
    return form, 2 if 9 <= digits <= 17 else 0 if digits in (7, 8) else 1, (2 if known else 1) if abroad else 0, int(own[0] in "+(")


def described(text: str, span: tuple[int, int, int], tables: Gazetteer = TABLES) -> tuple[int, int]:
    """(vote pattern, features) of a span, as numbers."""
    kind, a, b = span
    own = text[a:b]
    lead = text[max(0, a - 32) : a]
    digits = sum(c.isdigit() for c in own)
    cue = 2 if _CUES.search(lead) else 1 if _AGAINST.search(lead) else 0
    edge = int((a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum()))
    separators = min(3, sum(not c.isalnum() for c in own) // 2)
    shape, amount, listed, tail = _email_votes(own, bool(edge), tables) if kind == 0 else (_ip_votes, _card_votes, _phone_votes)[kind - 1](own, tables)
    pattern = kind
    for v in (shape, amount, listed, cue):
        pattern = pattern * 3 + v
    feature = 0
    for value, size in zip((kind, min(7, digits // 3), separators, cue, edge, tail), SIZES, strict=True):
        feature = feature * size + value
    return pattern, feature


def _unravel(feature: np.ndarray) -> np.ndarray:
    """One-hot rows of features, with a bias."""
    values = np.stack(np.unravel_index(feature, SIZES), 1)
    out = np.zeros((len(feature), 1 + sum(SIZES)))
    out[:, 0] = 1
    at = 1
    for k, size in enumerate(SIZES):
        out[np.arange(len(feature)), at + values[:, k]] = 1
        at += size
    return out


class Judge:
    """Labelers' reliabilities by expectation maximisation, and the span classifier fitted to them."""

    def __init__(self, pattern: np.ndarray, feature: np.ndarray, count: np.ndarray, rounds: int = 40, steps: int = 400):
        n = count.astype(float)
        self.reliability = np.full((LABELERS, 2, 3), 1 / 3)
        self.weights = np.zeros(1 + sum(SIZES))
        self.probability = np.zeros(0)
        if not len(n):
            return
        votes = np.stack(np.unravel_index(pattern, (len(KINDS), *[3] * LABELERS)), 1)
        kind, votes = votes[:, 0], votes[:, 1:]
        yes, no = (votes == 2).sum(1), (votes == 1).sum(1)
        p = (yes + 0.5) / (yes + no + 1.0)
        for _ in range(rounds):
            prior = (np.bincount(kind, n * p, len(KINDS)) + 1) / (np.bincount(kind, n, len(KINDS)) + 2)
            log = np.stack([np.log(1 - prior[kind]), np.log(prior[kind])], 1)
            for j in range(LABELERS):
                for y, w in enumerate((n * (1 - p), n * p)):
                    seen = np.bincount(votes[:, j], w, 3) + 1.0
                    seen[0] = 0.0  # who does not vote says nothing
                    self.reliability[j, y] = seen / seen.sum()
                    log[:, y] += np.log(np.where(votes[:, j] > 0, self.reliability[j, y][votes[:, j]], 1.0))
            p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        self.probability = p
        x = _unravel(feature)
        share = n / n.sum()
        for _ in range(steps):
            q = 1 / (1 + np.exp(-np.clip(x @ self.weights, -50, 50)))
            self.weights += 2.0 * (x.T @ (share * (p - q)) - 1e-4 * self.weights)

    def accepts(self, feature: int) -> bool:
        return bool(_unravel(np.array([feature])) @ self.weights > np.log(KEEP / (1 - KEEP)))


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in chunks(batches, "text"):
        for text in batch.column("text").to_pylist():
            if text:
                base = base_spans(text)
                counts.update(described(text, s) for s in base)
                counts.update(described(text, s) for s in more_candidates(text, base))
    keys = list(counts)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([counts[k] for k in keys], pa.int64())], names=["pattern", "feature", "n"])


def judge_of(docs: DataFrame) -> Judge:
    bounded_batches(docs)
    counts = docs.select("text").mapInArrow(_counting, "pattern long, feature long, n long").groupBy("pattern", "feature").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    counts = counts.sort_values(["pattern", "feature"])
    return Judge(counts["pattern"].to_numpy(np.int64), counts["feature"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))


def _all_spans(text: str | None, accepted: dict[int, bool], judge: Judge) -> tuple[list, list]:
    if not text:
        return [], []
    base = base_spans(text)
    added = []
    for span in more_candidates(text, base):
        feature = described(text, span)[1]
        if feature not in accepted:
            accepted[feature] = judge.accepts(feature)
        if accepted[feature]:
            added.append(span)
    return base, sorted(base + added) if added else base


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def found(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs; n_* count base spans."""
    judge = docs.sparkSession.sparkContext.broadcast(judge_of(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepted: dict[int, bool] = {}
        for batch in chunks(batches, "text"):
            counts, digests, spans = [[], [], [], []], [], []
            for text in batch.column("text").to_pylist():
                base, every = _all_spans(text, accepted, judge.value)
                for k, column in enumerate(counts):
                    column.append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every stretch that spans cover replaced by a mark of its first span's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text, n_chars following; all columns and rows are kept."""
    judge = docs.sparkSession.sparkContext.broadcast(judge_of(docs))
    names, has_length = docs.columns, "n_chars" in docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepted: dict[int, bool] = {}
        for batch in chunks(batches, "text"):
            texts = batch.column("text").to_pylist()
            for k, text in enumerate(texts):
                spans = _all_spans(text, accepted, judge.value)[1]
                if spans:
                    texts[k] = masked(text, spans)
            columns = [batch.column(n) for n in range(batch.num_columns)]
            columns[names.index("text")] = pa.array(texts, pa.string())
            if has_length:
                k = names.index("n_chars")
                columns[k] = pa.array([c if t is None else len(t) for t, c in zip(texts, columns[k].to_pylist(), strict=True)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)
