"""Main text of pages, by differencing each page with the pages next to it.

A page is parsed into blocks of text. Within each host, pages stand in order of their path, and a page's neighbours are
the ``NEAR`` pages before it and after it. Its blocks are aligned with each neighbour's by longest common subsequence;
a block's support is how many neighbours share it. Shared blocks are deleted: menus, notices and footers repeat from page
to page, articles do not.

Menus also differ from page to page, and articles quote each other, so the place of a block in the markup (the elements
around it) weighs in. Where a good part of what stands at a place, on the page and its neighbours, is repeated, all of
the place goes; where hardly anything is, only blocks go that most neighbours share. If no text would be left, shared
blocks alone decide, and a page that shares all of them is a copy and keeps them.

What the markup itself says comes on top. Blocks of navigation, adverts, forms, comments and the like go even if no
neighbour shares them, and where a page has an article or main element, nothing outside it belongs to the text. Inside,
a block goes if most neighbours' main texts have it; for one in an article element, which pages quote and copy as it
stands, that takes three quarters of eight neighbours or more. A page with a single neighbour loses only what it shares
at the beginning and end. Where that would take half of the characters or more, the pages are copies, and all of it stays.

Pages of a host may be a third of all: pages are numbered in order of host and path and dealt into units of ``UNIT``
pages, and those at each cut are lent to the other side, so every page sees its true neighbours, no host meets in one
task, and a task holds one window of pages at a time.

Defined results: null and empty html has no text; a null url has an empty host and path, like any url without ``://``,
and such pages are neighbours of each other; pages with equal urls are neighbours of each other; rows with equal url
and html are one page, and each gets its text; an empty table gives no rows; other columns pass through in ``row``.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from html import unescape
from zlib import crc32

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import with_row
from lodestar.llm.urls import host_and_path
from lodestar.operators.ordering import ranked

# Elements by what they mean for the text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("iframe math noembed noframes noscript object script style svg template textarea title xmp".split())
UNWANTED = frozenset("aside button dialog footer form head menu nav search select".split())
LANDMARKS = frozenset(("article", "main"))
UNWANTED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
UNWANTED_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments "
    "consent cookie cookies disclaimer disqus footer gdpr hidden login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification overlay pagination pager popup promo promotion recommended related replies "
    "reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)

#: What may stand beside an unwanted word in the name of an element that holds such things, not merely knows of them.
NEUTRAL_NAMES = frozenset(
    "area bar block box button buttons container content form group icons inner item items links list main media outer page panel "
    "posts section site slot top bottom unit wrap wrapper".split()
)
COMMENT_NAMES = frozenset("comment commentlist comments disqus replies reply respond".split())

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<![^\s"'/])(hidden)(?![^\s/])""")
NAME = re.compile(r"[a-z0-9]+")

#: A page by its content: equal rows are one page.
PAGE = ["page_a", "page_b"]

#: Neighbours on either side of a page, and pages that one task takes at once.
NEAR, UNIT = 16, 1024

#: Shares of what stands at a place of the markup that is repeated: all of the place goes, or hardly anything is.
REPEATED_PLACE, OWN_PLACE = 0.3, 0.2

#: Neighbours that it takes, and the share of them, for a block of an article element to go.
ARTICLE_NEIGHBOURS, ARTICLE_SHARE = 8, 0.75

#: Bits of the alignment that are kept for walking back; longer pages are halved first.
TABLE_BITS = 1 << 27


#: How an element is unwanted: not, as a form, by its name, or for good, which no article inside makes up for.
WANTED, FORM, NAMED, NEVER = range(4)


def _named(value: str, names: frozenset[str]) -> bool:
    """Whether one whole name says it: ``ad``, ``ad-slot`` and ``site-footer`` do, ``has-sidebar`` and ``menu-open`` do not."""
    for name in value.split():
        parts = NAME.findall(name)
        if not names.isdisjoint(parts) and all(p in names or p in UNWANTED_NAMES or p in NEUTRAL_NAMES or p.isdigit() for p in parts):
            return True
    return False


def _unwanted(tag: str, attributes: str, in_article: bool) -> int:
    """Whether and how an element holds something else than the article."""
    found = WANTED
    if tag == "form":
        found = FORM
    elif tag in UNWANTED or (tag == "header" and not in_article):
        return NEVER
    for name, double, single, bare, hidden in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), unescape(double or single or bare).lower()
        if hidden or name == "hidden" or (name == "aria-hidden" and value == "true"):
            return NEVER
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return NEVER
        if name == "role" and value.strip() in UNWANTED_ROLES:
            found = max(found, FORM if value.strip() == "form" else NEVER)
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            if _named(value, COMMENT_NAMES):
                return NEVER
            if tag != "article" and _named(value, UNWANTED_NAMES):
                found = max(found, NAMED)
    return found


def blocks_of(html: str) -> tuple[list[str], list[int]]:
    """The blocks of a page in order, and for each 0 (unwanted by its markup), 1 (outside an article) or 2 (inside)."""
    texts, kinds, _ = _marked(html)
    return texts, [min(kind, 2) for kind in kinds]


def _marked(html: str) -> tuple[list[str], list[int], list[int]]:
    """As ``blocks_of``, with 2 for blocks that lie in a main element only and 3 for those in an article element, and
    for each block the checksum of the names of the block elements around it, its place.

    A form that holds most of the text is a plain wrapper. A main element, and an article if no other one has text,
    begins afresh inside forms and elements that are unwanted by name.
    """
    texts: list[str] = []
    # Per block: unwanted for good, by name, outermost form or -1; in a landmark (2) or article (3);
    # the same two within the landmark; in a main element.
    facts: list[tuple[bool, bool, int, int, bool, bool]] = []
    places: list[int] = []
    held: list[str] = []
    # Open elements as (tag, how unwanted, landmark, article, what was unwanted outside of it, place around it).
    stack: list[tuple[str, int, bool, bool, tuple[int, int, bool], int]] = []
    opened: Counter[str] = Counter()
    count = [0, 0, 0, 0]
    landmark = articles = forms = 0
    form = -1
    place = 0
    # Forms and names around the outermost landmark, and whether a main element is open.
    around = (0, 0, False)

    def flush() -> None:
        if held:
            if text := " ".join(unescape("".join(held)).split()):
                texts.append(text)
                places.append(place)
                inner = count[NAMED] > around[1] or count[FORM] > around[0]
                facts.append((count[NEVER] > 0, count[NAMED] > 0, form if count[FORM] else -1, 3 if articles else 2 if landmark else 0, inner, around[2]))
            held.clear()

    def close() -> None:
        nonlocal landmark, articles, around, form, place
        tag, how, was_landmark, was_article, before, place = stack.pop()
        opened[tag] -= 1
        count[how] -= 1
        landmark -= was_landmark
        articles -= was_article
        if was_landmark:
            around = before
        if how == FORM and not count[FORM]:
            form = -1

    at = 0
    while found := TAG.search(html, at):
        held.append(html[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            held.append(" ")
        if found[1]:
            if opened[tag]:
                while stack[-1][0] != tag:
                    close()
                close()
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not found[3].endswith("/"):
            if stack and stack[-1][0] == "p" and tag in BLOCKS or stack and stack[-1][0] == tag == "li":
                close()
            is_main = tag == "main" or bool(re.search(r"""role\s*=\s*["']?main\b""", found[3], re.I))
            is_article = tag == "article" or bool(re.search(r"""role\s*=\s*["']?article\b""", found[3], re.I))
            is_landmark = is_main or is_article
            how = _unwanted(tag, found[3], landmark > 0)
            stack.append((tag, how, is_landmark, is_article, around, place))
            if tag in BLOCKS:
                place = crc32(tag.encode(), place)
            if is_landmark and (is_main and not around[2] or not landmark):
                around = (count[FORM], count[NAMED], is_main)
            opened[tag] += 1
            count[how] += 1
            landmark += is_landmark
            articles += is_article
            if how == FORM and count[FORM] == 1:
                form, forms = forms, forms + 1
    held.append(html[at:])
    flush()

    # Characters in all and in each form, of what nothing else makes unwanted.
    whole, within = 0, Counter()
    for text, (never, named, own, _, _, _) in zip(texts, facts, strict=True):
        if not never and not named:
            whole += len(text)
            within[own] += len(text)
    wrappers = {own for own, n in within.items() if own >= 0 and 2 * n > whole}
    kinds, afresh = [], []
    for never, named, own, in_landmark, inner, in_main in facts:
        unwanted = never or named or (own >= 0 and own not in wrappers)
        fresh = in_landmark > 0 and not never and (not inner or not named and own in wrappers)
        kinds.append(in_landmark if fresh and in_main else 0 if unwanted else in_landmark or 1)
        afresh.append(in_landmark if fresh else 0)
    if max(kinds, default=0) < 2:
        kinds = [fresh or kind for kind, fresh in zip(kinds, afresh, strict=True)]
    return texts, kinds, places


def _rows(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Bit-parallel alignment: bit j of row i is clear where the common length of a[:i] and b[:j + 1] rises."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for x in a:
        row = rows[-1]
        match = row & places.get(x, 0)
        rows.append(((row + match) | (row - match)) & full)
    return rows


def _lengths(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Common length of a with each beginning of b."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for x in a:
        match = row & places.get(x, 0)
        row = ((row + match) | (row - match)) & full
    out, bits = [0], bin(row | 1 << len(b))[:2:-1]
    for bit in bits:
        out.append(out[-1] + (bit == "0"))
    return out


def shared(a: Sequence[int], b: Sequence[int], table_bits: int = TABLE_BITS) -> list[int]:
    """Places in a of one longest common subsequence with b."""
    if len(a) > 1 and len(a) * len(b) > table_bits:
        middle = len(a) // 2
        ahead, back = _lengths(a[:middle], b), _lengths(a[middle:][::-1], b[::-1])
        cut = max(range(len(b) + 1), key=lambda j: ahead[j] + back[len(b) - j])
        return shared(a[:middle], b[:cut], table_bits) + [middle + i for i in shared(a[middle:], b[cut:], table_bits)]
    rows, i, j, out = _rows(a, b), len(a), len(b), []
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if rows[i] >> (j - 1) & 1:
            out.append(i)
            j -= 1
    return out[::-1]


def _both(own: Sequence[int], other: Sequence[int]) -> set[int]:
    """Places in own of what it shares with the other, in order."""
    known, mine = set(other), set(own)
    at = [i for i, x in enumerate(own) if x in known]
    a, b = [own[i] for i in at], [x for x in other if x in mine]
    # What both begin and end with is shared in any case.
    short = min(len(a), len(b))
    front = next((i for i in range(short) if a[i] != b[i]), short)
    back = next((i for i in range(short - front) if a[-1 - i] != b[-1 - i]), short - front)
    middle = shared(a[front : len(a) - back], b[front : len(b) - back])
    return {*at[:front], *(at[front + i] for i in middle), *at[len(at) - back :]}


@dataclass
class _Page:
    """A page as it is compared: kind, text hash, characters and place of every block."""

    position: int
    host: str
    kinds: list[int]
    keys: list[int]
    sizes: list[int]
    places: list[int]

    @cached_property
    def inside(self) -> list[int]:
        """The blocks of its main text, if the markup names one."""
        return [i for i, kind in enumerate(self.kinds) if kind > 1]

    @cached_property
    def inner_keys(self) -> list[int]:
        return [self.keys[i] for i in self.inside]

    @cached_property
    def standing(self) -> Counter[tuple[int, int]]:
        """How often each text stands at each place."""
        return Counter(zip(self.keys, self.places, strict=True))


class _Around:
    """A page and its neighbours: on how many of them each text stands, and how much of each place is repeated."""

    def __init__(self):
        self.with_key: Counter[int] = Counter()
        self.with_inner: Counter[int] = Counter()
        self.at: dict[int, Counter[int]] = {}
        self.all: Counter[int] = Counter()
        self.repeated: Counter[int] = Counter()

    def _count(self, page: _Page, sign: int) -> None:
        self.with_inner.update({x: sign for x in set(page.inner_keys)})
        own: dict[int, list[tuple[int, int]]] = {}
        for (key, place), n in page.standing.items():
            own.setdefault(key, []).append((place, n))
        for key, parts in own.items():
            at = self.at.setdefault(key, Counter())
            if self.with_key[key] > 1:
                self.repeated.subtract(at)
            for place, n in parts:
                at[place] += sign * n
                self.all[place] += sign * n
            self.with_key[key] += sign
            if self.with_key[key] > 1:
                self.repeated.update(at)
            elif not self.with_key[key]:
                del self.with_key[key], self.at[key]

    def add(self, page: _Page) -> None:
        self._count(page, 1)

    def remove(self, page: _Page) -> None:
        self._count(page, -1)
        for counter in (self.with_inner, self.all, self.repeated):
            for key in [k for k in {*page.inner_keys, *page.places} if not counter[k]]:
                del counter[key]


def _support(own: Sequence[int], others: Sequence[Sequence[int]]) -> Counter[int]:
    """For places in own, how many of the others share them."""
    found: Counter[int] = Counter()
    for other, times in Counter(map(tuple, others)).items():
        found.update({i: times for i in _both(own, other)})
    return found


def _ends(own: Sequence[int], other: Sequence[int]) -> set[int]:
    """Places at the beginning and end of own of what it shares with the other."""
    both = _both(own, other)
    front = next((i for i in range(len(own)) if i not in both), len(own))
    back = next((i for i in range(len(own), front, -1) if i - 1 not in both), front)
    return {i for i in both if i < front or i >= back}


def _kept_inside(page: _Page, others: list[_Page], around: _Around) -> list[bool]:
    """Which blocks are the text of a page whose markup names its main text."""
    others = [n.inner_keys for n in others if n.inside]
    own, n = page.inner_keys, len(others)

    def may_go(i: int, support: int) -> bool:
        if page.kinds[page.inside[i]] == 2:
            return 2 * support > n
        return n >= ARTICLE_NEIGHBOURS and support >= ARTICLE_SHARE * n

    gone: set[int] = set()
    # A text stands on as many neighbours as share it, or more.
    if n and any(may_go(i, around.with_inner[x] - 1) for i, x in enumerate(own)):
        support = _support(own, others)
        gone = {i for i in (support if n > 1 else _ends(own, others[0])) if may_go(i, support[i])}
    if 2 * sum(page.sizes[page.inside[i]] for i in gone) >= sum(page.sizes[i] for i in page.inside):
        gone = set()
    left = set(page.inside) - {page.inside[i] for i in gone}
    return [i in left for i in range(len(page.kinds))]


def _kept(page: _Page, others: list[_Page], around: _Around) -> list[bool]:
    """Which blocks are the text, given the neighbours."""
    if page.inside:
        return _kept_inside(page, others, around)
    support = _support(page.keys, [n.keys for n in others])
    share = {place: around.repeated[place] / around.all[place] for place in set(page.places)}
    wanted = [kind == 1 for kind in page.kinds]
    gone = {i for i, n in support.items() if 2 * n > len(others) or share[page.places[i]] >= OWN_PLACE}
    repeated = {i for i, place in enumerate(page.places) if share[place] >= REPEATED_PLACE}
    for unwanted in (gone | repeated, gone):
        alone = [mark and i not in unwanted for i, mark in enumerate(wanted)]
        if any(alone):
            return alone
    return wanted


PARSED = T.StructType([
    T.StructField("kinds", T.ArrayType(T.ByteType())), T.StructField("keys", T.ArrayType(T.LongType())),
    T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("places", T.ArrayType(T.LongType())),
])
ARROW_PARSED = pa.struct([("kinds", pa.list_(pa.int8())), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("places", pa.list_(pa.int64()))])


@F.arrow_udf(PARSED)
def _parse(pages: pa.Array) -> pa.Array:
    """Kinds of the blocks, hashes of their texts, characters, and places."""
    out = []
    for html in pages.to_pylist():
        texts, kinds, places = _marked(html or "")
        out.append({"kinds": kinds, "keys": [xxhash.xxh64_intdigest(t) - (1 << 63) for t in texts], "sizes": list(map(len, texts)), "places": places})
    return pa.array(out, ARROW_PARSED)


@F.arrow_udf(T.BinaryType())
def _packed(pages: pa.Array) -> pa.Array:
    """The texts of the blocks, compressed for the shuffle. No block holds a line feed."""
    pack = zstandard.ZstdCompressor().compress
    return pa.array([pack("\n".join(blocks_of(html or "")[0]).encode("utf-8", "surrogatepass")) for html in pages.to_pylist()], pa.binary())


@F.arrow_udf(T.StringType())
def _chosen(packed: pa.Array, kept: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor().decompress
    out = []
    for blob, marks in zip(packed.to_pylist(), kept.to_pylist(), strict=True):
        texts = unpack(blob).decode("utf-8", "surrogatepass").split("\n")
        out.append("\n\n".join(t for t, mark in zip(texts, marks, strict=False) if mark))
    return pa.array(out, pa.string())


MARKS = pa.schema([*[(name, pa.int64()) for name in PAGE], ("kept", pa.list_(pa.bool_()))])


def _differ(batches: Iterator[pa.RecordBatch], near: int, unit: int) -> Iterator[pa.RecordBatch]:
    """Marks of the pages of units of pages, which come in order, each with the pages lent to it at both ends."""
    held: deque[tuple[_Page, tuple[int, ...], bool]] = deque()
    around, ahead, last = _Around(), 0, None
    out: list[tuple] = []

    def judge() -> None:
        """Judge the first page that waits, with all of its neighbours held."""
        nonlocal ahead
        page, name, lent = held[ahead]
        while held[0][0].position < page.position - near:
            around.remove(held.popleft()[0])
            ahead -= 1
        if not lent:
            others = [other for other, _, _ in held if other is not page]
            out.append((*name, _kept(page, others, around)))
        ahead += 1

    def finish() -> None:
        nonlocal around, ahead
        while ahead < len(held):
            judge()
        held.clear()
        around, ahead = _Around(), 0

    for batch in batches:
        for row in batch.to_pylist():
            page = _Page(*(row[c] for c in ("position", "host", "kinds", "keys", "sizes", "places")))
            if last != (row["unit"], page.host):
                finish()
                last = (row["unit"], page.host)
            while ahead < len(held) and held[ahead][0].position < page.position - near:
                judge()
            held.append((page, tuple(row[c] for c in PAGE), row["unit"] != page.position // unit))
            around.add(page)
        yield pa.record_batch(list(map(list, zip(*out, strict=True))) if out else [[]] * len(MARKS), schema=MARKS)
        out.clear()
    finish()
    yield pa.record_batch(list(map(list, zip(*out, strict=True))) if out else [[]] * len(MARKS), schema=MARKS)


def _marks(pages: DataFrame, near: int, unit: int) -> DataFrame:
    """Which blocks of each page are its text."""
    placed = ranked(pages, ["host", "path", *PAGE], "position")
    # Its own unit, and those beyond a cut that is near.
    first, last = (F.floor((F.col("position") + shift) / unit) for shift in (-near, near))
    dealt = placed.withColumn("unit", F.explode(F.sequence(F.greatest(first, F.lit(0)), last))).drop("path")
    dealt = dealt.repartition("unit").sortWithinPartitions("unit", "position")
    schema = T.StructType([*[T.StructField(name, T.LongType()) for name in PAGE], T.StructField("kept", T.ArrayType(T.BooleanType()))])
    return dealt.mapInArrow(lambda batches: _differ(batches, near, unit), schema)


def main_text(pages: DataFrame, html: str = "html", url: str = "url", keep: list[str] | None = None, near: int = NEAR, unit: int = UNIT) -> DataFrame:
    """``row`` and ``text``, the blocks of the main text joined by two line feeds.

    Pages are parsed twice, once for the hashes that are compared and once for the texts, so that no copy of
    the texts is written: they move once, compressed, to meet their marks.
    """
    host, path = host_and_path(F.coalesce(F.col(url), F.lit("")))
    content = [F.col(url).isNull(), F.col(url), F.col(html).isNull(), F.col(html)]
    page = {name: F.xxhash64(F.lit(k), *content) for k, name in enumerate(PAGE)}
    parsed = pages.select(host.alias("host"), path.alias("path"), *[c.alias(n) for n, c in page.items()], _parse(F.col(html)).alias("parsed"))
    distinct = parsed.select("host", "path", *PAGE, "parsed.*").dropDuplicates(PAGE)
    marks = _marks(distinct, near, unit)
    texts = with_row(pages, keep, packed=_packed(F.col(html)), **page)
    return texts.join(marks, PAGE).select("row", _chosen("packed", "kept").alias("text"))
