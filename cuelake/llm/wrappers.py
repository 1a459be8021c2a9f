"""Main text of web pages by wrappers inferred per host.

A page becomes a stream of block-level tags and texts (inline tags, comments, scripts and the like are gone; end tags that HTML lets authors
leave out are dropped). Adjacent repeats fold into repeated groups. A wrapper starts as one page of the host and is aligned with all further
ones: texts that differ become slots, stretches only one side has become optional, a single occurrence of a known group folds into
it. The result is a regular expression over tags without unions. A slot's role follows from where it stands on all pages: what is
inside menus, footers, forms, adverts, comments and so on is no main text. A text that nearly all pages with the slot have there (USUAL of them) is
a candidate: it is dropped where a page has this very text in this slot, if over all pages of the host half or more, and 3 at least, have it so, and only
while the dropped texts are less than half of the page's article, so articles that pages share stay.
On a page that marks its article, only that is main text, whatever other pages of the host do. On one that does not, it is the long texts, those
beside them in the same element and the headings above; without long texts, it is those of the element with the most text.

Alignment is exact. A row of its table is one integer, so two pages of 20,000 blocks take 50 MB; larger tables are halved until they fit.

Pages are aligned with their host's wrapper, and the texts that fall into main slots are the result; stretches the wrapper does not know are
judged by where they stand. Wrappers are inferred from all pages. Pages of a host with the same signs need no alignment, so tasks only count them, with
sums per slot; what differs in signs is aligned in groups of about FAN, and the wrappers of the groups likewise, until a host has one. Of a slot's texts one
digest and a majority count are kept: a text that USUAL of the pages have is always the one that is left, and how many pages have it is then
counted exactly. Every page is read three times: to infer, to count repeats and to extract.

Defined cases: null or empty html gives an empty text; a page cut off anywhere gives what can be read; a null url is a host of its own; repeated
rows are separate pages; markup that never closes is read as far as it goes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as codec
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import stage

FAN = 1000
WAITING = 5000  # structures a task holds before it passes them on
USUAL = 19, 20
LONGEST_GROUP = 8
SHORT = 25
REMEMBERED = 500
ASIDE_SLOT, OTHER_SLOT, LONG_SLOT = 0, 1, 2
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADINGS | {"p", "blockquote"}
MOST_CELLS = 1 << 28
BROADCAST_BYTES, SALTS = 64 << 20, 32

#: Fixed values of HTML.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rt rp s samp small span strike "
             "strong sub sup time tt u var wbr".split())
RAW = "script|style|noscript|template|title|textarea|iframe|svg|math|object|select|button|canvas|audio|video"
OPEN_ENDED = set("p li dt dd tr td th thead tbody tfoot option optgroup colgroup".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = set("nav footer aside menu dialog head".split())
FORMS = {"form", "fieldset"}
MAIN = {"article", "main"}
NEVER_ASIDE = {"html", "body", *MAIN}
#: Class names and ids that tell what is not main text, and words that may stand beside them in one name.
NAMES = set("ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent gdpr notice notices alert newsletter subscribe "
            "signup login share sharing social related recommended sidebar side rail comment comments reply replies respond disqus breadcrumb "
            "breadcrumbs menu nav navbar navigation footer header masthead popup modal overlay toolbar pagination pager tags widget".split())
BESIDE = set("site page top bottom left right upper lower inner outer global main primary secondary box bar block list item items link links area "
             "container wrapper wrap slot unit section inline button buttons form text message panel post posts user reader".split())
HEADERS = {"header", "masthead"}

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>"
                    r"|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z|([^<]++|<)", re.S | re.I)
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")


def aside_names(values: str) -> set[str]:
    """The names for something else than main text among class names and the like. A name of several words counts if all of them are
    known: `cookie-banner` and `site-footer` do, `has-sidebar`, `comments-open`, `entry-header` and `ad-hoc` do not."""
    found = set()
    for name in values.lower().split():
        parts = set(_PARTS.findall(name))
        if parts <= NAMES | BESIDE:
            found |= parts & NAMES
    return found


class Page:
    """Stream of ("t", tag) and ("x", number); texts by number: (text, aside, main, share of linked characters), and in `places`
    its tag, element and the element around that; `around` has the parent of every element.

    Menus, footers and the like are asides wherever they stand. Forms and elements with an aside's name are, too, unless they enclose the only
    articles of the page, and the largest of these has half at least of the text that is then left: a form or a named element around a whole page
    says nothing.
    """

    def __init__(self, source: str | None):
        self.stream: list[tuple[str, object]] = []
        self.places: list[tuple[str, int, int]] = []
        self.around, self.tags = [0], [""]
        hard, soft, heads, article = [False], [False], [False], [False]  # of the element itself, by number
        opened, times = [0], Counter()
        found: list[tuple[str, int, float]] = []
        parts: list[str] = []
        linked, in_link = 0, 0

        def flush():
            nonlocal linked
            text = " ".join(codec.unescape("".join(parts)).split())
            parts.clear()
            if text:
                own = opened[-1]
                self.stream.append(("x", len(found)))
                self.places.append((self.tags[own], own, self.around[own]))
                found.append((text, own, min(1.0, linked / len(text))))
            linked = 0

        for m in _TOKEN.finditer(source or ""):
            raw, end, tag, attributes, text = m.groups()
            if text is not None:
                parts.append(text)
                linked += len(text) * (in_link > 0)
            elif tag is None:
                parts.append(" " * bool(raw))
            else:
                tag = tag.lower()
                if tag == "br":
                    parts.append(" ")
                    continue
                if tag in INLINE:
                    if tag == "a":
                        in_link = 0 if end else 1
                    continue
                flush()
                in_link = 0
                if end:
                    if times[tag]:
                        while (closed := self.tags[opened.pop()]) != tag:
                            times[closed] -= 1
                        times[tag] -= 1
                    if tag not in OPEN_ENDED and tag not in VOID:
                        self.stream.append(("t", "/" + tag))
                    continue
                values = " ".join("".join(v) for v in _NAMED.findall(attributes)) if attributes else ""
                names = aside_names(values) if values and tag not in NEVER_ASIDE else set()
                if tag not in VOID:
                    if tag in OPEN_ENDED and self.tags[opened[-1]] == tag:
                        opened.pop()
                        times[tag] -= 1
                    self.around.append(opened[-1])
                    self.tags.append(tag)
                    hard.append(tag in ASIDE)
                    soft.append(tag in FORMS or bool(names - HEADERS))
                    heads.append(tag == "header" or bool(names & HEADERS))
                    article.append(tag in MAIN or "articlebody" in values.lower().split())
                    opened.append(len(self.tags) - 1)
                    times[tag] += 1
                self.stream.append(("t", ".".join([tag, *sorted(names)])))
        flush()

        n = len(self.tags)
        inside_hard, inside_soft, inside = hard[:], soft[:], article[:]  # of the element and all around it
        for e in range(1, n):
            up = self.around[e]
            inside_hard[e] |= inside_hard[up]
            inside_soft[e] |= inside_soft[up] or heads[e] and not inside[up]
            inside[e] |= inside[up]
        chars = [0] * n
        for text, own, _ in found:
            chars[own] += len(text) * (not inside_hard[own])
        for e in range(n - 1, 0, -1):
            chars[self.around[e]] += chars[e]
        articles = [e for e in range(1, n) if article[e] and not inside_hard[e] and chars[e]]

        def asides(excused: set[int]) -> list[bool]:
            out = hard[:]
            for e in range(1, n):
                up = self.around[e]
                out[e] |= out[up] or e not in excused and (soft[e] or heads[e] and not inside[up])
            return out

        aside = asides(set())
        if articles and all(inside_soft[e] for e in articles):
            above = largest = max(articles, key=lambda e: (chars[e], -e))
            excused = set()
            while above:
                excused.add(above)
                above = self.around[above]
            other = asides(excused)
            rest = sum(len(text) for text, own, _ in found if not other[own] and not self.encloses(largest, own))
            if chars[largest] >= rest:
                aside = other
        self.texts = [(text, aside[own], inside[own], share) for text, own, share in found]

    def encloses(self, element: int, other: int) -> bool:
        while other > element:
            other = self.around[other]
        return other == element


def _signs(nodes: list) -> list:
    """What alignment compares: tags by name, texts alike, groups by their content."""
    return [n[1] if n[0] == "t" else "#" if n[0] == "x" else ("+", tuple(n[1])) for n in nodes]


def fold(stream: list, known: frozenset = frozenset()) -> list:
    """Adjacent repeats as ("+", signs of the group, its occurrences); a known group folds even if it occurs once."""
    signs, out, i, n = _signs(stream), [], 0, len(stream)
    longest = max([LONGEST_GROUP, *map(len, known)])
    while i < n:
        for size in range(2, longest + 1):
            body = tuple(signs[i:i + size])
            if len(body) < size or body[0] == "#" or body[0][0] == "/":
                continue
            stop = i + size
            while tuple(signs[stop:stop + size]) == body:
                stop += size
            if stop > i + size or body in known:
                out.append(("+", body, [stream[k:k + size] for k in range(i, stop, size)]))
                i = stop
                break
        else:
            out.append(stream[i])
            i += 1
    return out


def _common_rows(x: list, y: list) -> list[int]:
    """A row per ending of x, from the empty one to x itself: bit p of a row is 0 where y's ending that starts p places before its last sign has a longer common
    subsequence with x's ending than the ending of y one sign shorter. A row is one integer, so a step costs a few words for 64 signs."""
    at: dict = {}
    for p, sign in enumerate(reversed(y)):
        at[sign] = at.get(sign, 0) | 1 << p
    full = (1 << len(y)) - 1
    row, rows = full, [full]
    for sign in reversed(x):
        same = row & at.get(sign, 0)
        row = (row + same | row - same) & full
        rows.append(row)
    return rows


def _lengths(row: int, n: int) -> list[int]:
    """How long the common subsequence is for every ending of y, from the empty one on."""
    zeros = np.unpackbits(np.frombuffer((~row & (1 << n) - 1).to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return [0, *np.cumsum(zeros, dtype=np.int64).tolist()]


def _aligned(x: list, y: list, i0: int, j0: int, out: list) -> None:
    if len(x) * len(y) > MOST_CELLS and len(x) > 1:
        half = len(x) // 2  # too many rows to keep: cut x in half and y where both parts have the most in common
        after = _lengths(_common_rows(x[half:], y)[-1], len(y))[::-1]
        before = _lengths(_common_rows(x[:half][::-1], y[::-1])[-1], len(y))
        cut = max(range(len(y) + 1), key=lambda j: before[j] + after[j])
        _aligned(x[:half], y[:cut], i0, j0, out)
        _aligned(x[half:], y[cut:], i0 + half, j0 + cut, out)
        return
    rows, i, j = _common_rows(x, y), 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append((i0 + i, j0 + j))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and not rows[len(x) - i] >> len(y) - 1 - j & 1:
            out.append((i0 + i, None))
            i += 1
        else:
            out.append((None, j0 + j))
            j += 1


def align(a: list, b: list) -> list[tuple[int | None, int | None]]:
    """A longest common alignment of two sequences of signs."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(k, k) for k in range(head)]
    _aligned(a[head:len(a) - tail], b[head:len(b) - tail], head, head, out)
    return out + [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]


def _slots(node) -> list[list[int]]:
    """Texts of a node by slot: one for a text, one per text of a group's content."""
    if node[0] == "x":
        return [[node[1]]]
    if node[0] == "+":
        return [[occurrence[k][1] for occurrence in node[2]] for k, s in enumerate(node[1]) if s == "#"]
    return []


def _joined(page: Page, ids: list[int]) -> str:
    return " / ".join(page.texts[i][0] for i in ids)


def _both(x: list, y: list) -> list:
    """A slot's figures of two sets of pages: sums, and the digest that is left with its majority count."""
    if x[0] == y[0]:
        left, votes = x[0], x[1] + y[1]
    else:
        left, votes = (x[0], x[1] - y[1]) if x[1] >= y[1] else (y[0], y[1] - x[1])
    return [left, votes, *(a + b for a, b in zip(x[2:], y[2:]))]


class Wrapper:
    """Signs in order, each with how many pages have it (fewer than all: optional), and per slot what was seen there: a digest of its texts and the majority
    count of that, texts that are asides, their linked shares in thousandths, characters, and the number of texts."""

    def __init__(self, page: Page | None = None):
        nodes = fold(page.stream) if page else []
        self.signs, self.pages = _signs(nodes), int(page is not None)
        self.seen = [1] * len(nodes)
        self.slots = [[self._seen(page, ids) for ids in _slots(n)] for n in nodes]

    @staticmethod
    def _seen(page: Page, ids: list[int]) -> list:
        texts = [page.texts[i] for i in ids]
        return [digest(_joined(page, ids)), 1, sum(t[1] for t in texts), sum(round(1000 * t[3]) for t in texts), sum(len(t[0]) for t in texts), len(texts)]

    @classmethod
    def read(cls, data: str) -> Wrapper:
        out = cls()
        signs, out.seen, out.slots, out.pages = json.loads(data)
        out.signs = [("+", tuple(s[0])) if isinstance(s, list) else s for s in signs]
        return out

    def spelt(self) -> list:
        """Signs for JSON."""
        return [[list(s[1])] if isinstance(s, tuple) else s for s in self.signs]

    def written(self) -> str:
        return json.dumps([self.spelt(), self.seen, self.slots, self.pages])

    @property
    def known(self) -> frozenset:
        return frozenset(s[1] for s in self.signs if isinstance(s, tuple))

    def count(self, other: Wrapper) -> None:
        """Pages with the same signs."""
        self.pages += other.pages
        self.seen = [x + y for x, y in zip(self.seen, other.seen)]
        self.slots = [[_both(x, y) for x, y in zip(a, b)] for a, b in zip(self.slots, other.slots)]

    def fold_known(self, known: frozenset) -> None:
        """Single occurrences of known groups become groups. One that pages have in part only becomes one of the pages that have its first sign."""
        sizes = sorted({len(k) for k in known})
        signs, seen, slots, i = [], [], [], 0
        while i < len(self.signs):
            for size in sizes:
                body = tuple(self.signs[i:i + size])
                if body in known:
                    signs.append(("+", body))
                    slots.append([x for node in self.slots[i:i + size] for x in node])
                    break
            else:
                size = 1
                signs.append(self.signs[i])
                slots.append(self.slots[i])
            seen.append(self.seen[i])
            i += size
        self.signs, self.seen, self.slots = signs, seen, slots

    def merge(self, other: Wrapper) -> None:
        """Pages with other signs; both wrappers are changed."""
        mine, theirs = self.known, other.known
        if mine:
            other.fold_known(mine)
        if theirs - mine:
            self.fold_known(theirs)
        signs, seen, slots = [], [], []
        for i, j in align(self.signs, other.signs):
            signs.append(self.signs[i] if i is not None else other.signs[j])
            seen.append((self.seen[i] if i is not None else 0) + (other.seen[j] if j is not None else 0))
            if i is not None and j is not None:
                slots.append([_both(x, y) for x, y in zip(self.slots[i], other.slots[j])])
            else:
                slots.append(self.slots[i] if i is not None else other.slots[j])
        self.signs, self.seen, self.slots, self.pages = signs, seen, slots, self.pages + other.pages

    def add(self, page: Page) -> None:
        self.merge(Wrapper(page))

    def roles(self) -> str:
        """The wrapper for extraction: signs, optional or not, and the role of each slot. A text of USUAL of the pages has a majority count of
        2 USUAL - 1 of them at least."""
        def fixed(s: list, seen: int) -> str | None:
            return s[0] if self.pages >= 3 and seen >= 3 and s[1] * USUAL[1] >= seen * (2 * USUAL[0] - USUAL[1]) else None

        def role(s: list) -> int:
            _, _, aside, linked, chars, n = s
            if aside * 2 > n:
                return ASIDE_SLOT
            return LONG_SLOT if linked * 2 <= 1000 * n and chars >= SHORT * n else OTHER_SLOT

        return json.dumps({"signs": self.spelt(), "optional": [n < self.pages for n in self.seen], "roles": [[role(s) for s in node] for node in self.slots],
                           "fixed": [[fixed(s, n) for s in node] for node, n in zip(self.slots, self.seen)]}, sort_keys=True)


def merged(wrappers: Iterable[Wrapper]) -> Wrapper:
    """One wrapper of all, whatever their order: those with equal signs are counted, the others aligned, from the one with the most pages on."""
    found: dict[tuple, Wrapper] = {}
    for w in wrappers:
        key = tuple(w.signs)
        if key in found:
            found[key].count(w)
        else:
            found[key] = w
    out = None
    for w in sorted(found.values(), key=lambda w: (-w.pages, json.dumps(w.spelt()))):
        if out is None:
            out = w
        else:
            out.merge(w)
    return out or Wrapper(Page(""))


def infer(pages: list[str | None]) -> str:
    """A wrapper from pages of a host."""
    return merged(Wrapper(Page(source)) for source in pages if source).roles()


class Extractor:
    """Applies one wrapper; alignments of streams seen before are remembered."""

    def __init__(self, wrapper: str, repeated: frozenset[str] = frozenset()):
        w = json.loads(wrapper)
        self.signs = [("+", tuple(s[0])) if isinstance(s, list) else s for s in w["signs"]]
        self.known = frozenset(s[1] for s in self.signs if isinstance(s, tuple))
        self.roles, self.fixed, self.repeated, self.cache = w["roles"], w["fixed"], repeated, {}

    def _slots(self, source: str | None) -> tuple[Page, list[tuple[list[int], int | None, str | None, bool]]]:
        """The page; per slot its texts, the role of the wrapper's slot, the digest of the text that is usual there, and whether it is this page's."""
        page = Page(source)
        nodes = fold(page.stream, self.known)
        signs = tuple(_signs(nodes))
        if signs not in self.cache:
            if len(self.cache) >= REMEMBERED:
                self.cache.clear()
            self.cache[signs] = {j: i for i, j in align(self.signs, list(signs)) if i is not None and j is not None}
        at, out = self.cache[signs], []
        for j, node in enumerate(nodes):
            for k, ids in enumerate(_slots(node)):
                role, usual = (self.roles[at[j]][k], self.fixed[at[j]][k]) if j in at else (None, None)
                out.append((ids, role, usual, usual is not None and usual == digest(_joined(page, ids))))
        return page, out

    def candidates(self, source: str | None) -> set[str]:
        """Digests of the page's texts that are the usual ones of their slot."""
        return self.offered(source)[1]

    def offered(self, source: str | None) -> tuple[set[str], set[str]]:
        """Digests that are usual in a slot of the page, and those of them that the page has there."""
        usual = [(d, same) for _, role, d, same in self._slots(source)[1] if d and role != ASIDE_SLOT]
        return {d for d, _ in usual}, {d for d, same in usual if same}

    def text(self, source: str | None) -> str:
        page, slots = self._slots(source)
        marked = any(main and not aside for _, aside, main, _ in page.texts)
        keep, repeats, others = set(), set(), set()
        for ids, role, usual, same in slots:
            for i in ids:
                text, aside, main, linked = page.texts[i]
                if aside or role == ASIDE_SLOT and not main:
                    continue
                if main if marked else role == LONG_SLOT or linked <= 0.5 and len(text) >= SHORT:
                    keep.add(i)
                elif not marked:
                    others.add(i)
                if same and usual in self.repeated:
                    repeats.add(i)
        if not marked:
            keep |= _region(page, keep - repeats or keep, others)
        inside = {i for i in keep if page.texts[i][2]} if marked else keep
        body = repeats & inside
        if sum(len(page.texts[i][0]) for i in body) * 2 >= sum(len(page.texts[i][0]) for i in inside):
            repeats -= body  # pages that share their article
        return "\n\n".join(page.texts[i][0] for i in sorted(keep - repeats))


def _region(page: Page, long: set[int], others: set[int]) -> set[int]:
    """Of a page without a marked article: the texts beside its long ones (or, without any, those of the element that has the most text), and the headings above."""
    if not long:
        chars: Counter = Counter()
        for i in sorted(others):
            if page.texts[i][3] <= 0.5:
                chars[page.places[i][2]] += len(page.texts[i][0])
        best = max(chars, key=chars.get, default=None)  # the first of several
        long = {i for i in others if page.places[i][2] == best and page.texts[i][3] <= 0.5}
    elements = {e for i in long for e in page.places[i][1:]}
    beside = {i for i in others if not elements.isdisjoint(page.places[i][1:]) and (page.texts[i][3] <= 0.5 or page.places[i][0] in BLOCKS)}
    first = min(long, default=0)
    above = {i for i in others if i < first and page.places[i][0] in HEADINGS and page.encloses(page.places[i][2], page.places[first][1])}
    return long | beside | above


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))


_WRAPPERS = "host string, place long, wrapper string"


def _structures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages with the same signs as one wrapper per host; the place is a number of the signs."""
    found: dict[tuple, Wrapper] = {}

    def rows():
        out = [(name, zlib.crc32(json.dumps(w.spelt()).encode()), w.written()) for (name, _), w in found.items()]
        found.clear()
        return pd.DataFrame(out, columns=["host", "place", "wrapper"])

    for pdf in batches:
        for name, source in zip(pdf["host"], pdf["html"]):
            w = Wrapper(Page(source))
            key = name, tuple(w.signs)
            if key in found:
                found[key].count(w)
            else:
                found[key] = w
            if len(found) >= WAITING:
                yield rows()
    yield rows()


def _merge_group(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "place": [pdf["place"].iloc[0]], "wrapper": [merged(map(Wrapper.read, pdf["wrapper"])).written()]})


def _roles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf[["host"]].assign(wrapper=[Wrapper.read(w).roles() for w in pdf["wrapper"]])


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from all pages. Rounds of groups of about FAN wrappers each, so neither a huge host nor one of many structures is in one task."""
    rows = pages.where("html IS NOT NULL").select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    parts = stage(rows.mapInPandas(_structures, _WRAPPERS), "wrapper-structures")
    most = parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while True:
        groups = max(1, -(-most // FAN))
        parts = stage(parts.withColumn("place", F.pmod("place", F.lit(groups).cast("bigint"))).groupBy("host", "place")
                           .applyInPandas(_merge_group, _WRAPPERS), "wrapper-merged")
        if groups == 1:
            return stage(parts.mapInPandas(_roles, "host string, wrapper string"), "wrappers")
        most = groups


def _extractors():
    """Extractors by wrapper and repeated texts, some of them remembered."""
    known: dict[tuple, Extractor] = {}
    nothing = infer([])

    def find(wrapper: str | None, repeated=()) -> Extractor:
        key = wrapper or nothing, frozenset(() if repeated is None else repeated)
        if key not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[key] = Extractor(*key)
        return known[key]
    return find


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages of each host, with a candidate's slot and with the candidate in it, counted over a batch; the empty digest stands for all pages."""
    find = _extractors()
    for pdf in batches:
        counts: Counter = Counter()
        for name, source, wrapper in zip(pdf["_host"], pdf["html"], pdf["wrapper"]):
            could, has = find(wrapper).offered(source)
            counts.update((name, d, True) for d in ("", *has))
            counts.update((name, d, False) for d in could)
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["host", "digest", "has", "n"])


def repeated_texts(joined: DataFrame) -> DataFrame:
    """(host, repeated): digests of candidates that USUAL of the pages with their slots have there, half or more of the host's pages, and 3 at least."""
    with_html = joined.where(F.col("html").isNotNull() & F.col("wrapper").isNotNull()).select("_host", "html", "wrapper")
    counts = with_html.mapInPandas(_candidates, "host string, digest string, has boolean, n long").groupBy("host", "digest").agg(
        F.sum(F.when(F.col("has"), F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(~F.col("has"), F.col("n")).otherwise(0)).alias("slots"))
    counts = stage(counts, "wrapper-repeats")
    pages = counts.where("digest = ''").select("host", F.col("n").alias("pages"))
    often = counts.where("digest <> ''").join(pages, "host").where(
        (F.col("n") >= 3) & (F.col("n") * 2 >= F.col("pages")) & (F.col("n") * USUAL[1] >= F.col("slots") * USUAL[0]))
    return stage(often.groupBy("host").agg(F.sort_array(F.collect_set("digest")).alias("repeated")), "wrapper-repeated")  # slots of one wrapper


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    find = _extractors()
    for pdf in batches:
        texts = [find(wrapper, repeated).text(source) for source, wrapper, repeated in zip(pdf["html"], pdf["wrapper"], pdf["repeated"])]
        yield pdf[["page_id", "url"]].assign(text=texts)


def _with_wrappers(rows: DataFrame, wrappers: DataFrame, how: str) -> DataFrame:
    """Pages and what is known of their host. Wrappers are small: up to BROADCAST_BYTES of them go to the pages; above that pages are joined on host and a
    salt, as one host may have a third of them."""
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("_host"))).first()[0] or 0
    at = host(F.col("url"))
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(wrappers), at == F.col("_host"), how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int"))
    copies = wrappers.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, (at == F.col("_host")) & (F.col("_salt") == F.col("_copy")), how).drop("_salt", "_copy")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page. Runs jobs."""
    wrappers = host_wrappers(pages).withColumnRenamed("host", "_host")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    repeated = repeated_texts(_with_wrappers(rows, wrappers, "inner")).withColumnRenamed("host", "_of")
    both = stage(wrappers.join(repeated, F.col("_host") == F.col("_of"), "left").select("_host", "wrapper", "repeated"), "wrappers-repeated")
    joined = _with_wrappers(rows, both, "left").select("page_id", "url", "html", "wrapper", "repeated")
    out = joined.mapInPandas(_extract, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
