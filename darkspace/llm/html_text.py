"""Main text of web pages: blocks by markup, and suffix arrays of each host for what its pages repeat."""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Hashes, Names, cut, numbered, partitions_for, slices, tidied, window_hashes
from .suffix_dedup import common_prefixes, suffix_array
from .url_filter import with_host_and_path

#: Tokens (words and block marks) of a run that counts as boilerplate when distinct pages of a host share it.
RUN = 12
#: Distinct pages, and share of a shard's distinct pages, that make a run in main parts boilerplate.
MANY, SHARE = 4, 0.25
#: Pages of a host in one suffix array, and hosts of several arrays whose names are broadcast (some MB; more are joined).
SHARD_PAGES, BROADCAST_HOSTS = 2000, 100_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|object|svg|textarea|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"([a-z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_LABEL = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_DROP = frozenset("head nav footer aside form menu button dialog title label option legend fieldset".split())
#: What may stand in a head; anything else ends it, as does text.
_HEAD = frozenset("head html base basefont bgsound link meta title style script noscript noframes template".split())
#: Elements whose presence shows that what holds them is the page, or a large part of it.
_FRAME = frozenset("header nav footer aside h1".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
#: Elements that an implied end doesn't reach across.
_WALLS = frozenset("article aside body div dl footer form header main nav ol section table ul blockquote figure".split())
#: Class and id names, whole ones, of what has no element or role of its own in the standard.
_NAMES = frozenset(
    """ad ads advert adverts advertisement ad-slot ad-banner ad-container ad-unit sponsored promo banner
    notice notices cookie-notice cookie-banner cookie-consent cookies consent popup modal overlay
    newsletter newsletter-signup subscribe signup menu nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets related related-posts
    share share-buttons social social-share sharing comment comments comment-list comments-area comment-section comments-section respond disqus-thread
    header site-header page-header masthead footer site-footer page-footer topbar toolbar pagination pager search search-form hidden toc""".split()
)
_HEADERS = frozenset("header site-header page-header masthead".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
_MAIN_NAMES = frozenset("articlebody article-body article-content post-content post-body entry-content story-body main-content page-content content article post story entry".split())
_SPACE = re.compile(r"\s+")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def _marks(name: str, raw: str) -> tuple[bool, bool, bool, bool]:
    """Whether an element is no article for certain, is none by its names or as a form, is the main part, and is a header.

    Names never speak against article, main, body and html, nor does a part of a name.
    """
    if not raw.strip():
        return name in _DROP and name != "form", name == "form", name in ("article", "main"), name == "header"
    own = _attributes(raw)
    names = set(f"{own.get('class', '')} {own.get('id', '')}".lower().replace("_", "-").split())
    roles = set(own.get("role", "").lower().split())
    hidden = "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.I)
    named = name not in ("article", "main", "html", "body")
    hard = name in _DROP and name != "form" or bool(roles & _ROLES or hidden) and name not in ("html", "body")
    soft = name == "form" or bool(names & _NAMES - _HEADERS) and named
    main = name in ("article", "main") or bool(roles & {"main", "article"}) or own.get("itemprop", "").lower() == "articlebody"
    main = main or name in ("div", "section", "td") and bool(names & _MAIN_NAMES)
    return hard, soft, main and not hard, name == "header" or bool(names & _HEADERS) and named


def _label(raw: str) -> str:
    """The class and id names of an element."""
    return "".join(f".{m[1] or m[2] or m[3]}" for m in _LABEL.finditer(raw)) if raw.strip() else ""


class _Reading:
    """One pass over a page. Elements at the positions ``spared`` are not dropped for their names or as forms.

    ``holders`` are the positions of elements dropped for these that hold a
    main part, ``outer`` of outermost ones that are forms, lie in a main part
    or hold what a page has once (_FRAME). ``body`` tells whether a main part
    has text besides headings. ``slots`` are the blocks' places in the markup:
    the elements that hold them, with their class and id names.
    """

    def __init__(self, page: str, spared: frozenset[int] = frozenset()):
        self.blocks: list[tuple[str, str]] = []
        self.slots: list[str] = []
        self.holders: set[int] = set()
        self.outer: set[int] = set()
        self.body = False
        self._read(page, spared)

    def size(self, zone: str) -> int:
        return sum(len(t) for z, t in self.blocks if z == zone)

    def _read(self, page: str, spared: frozenset[int]) -> None:
        # element, zone, whether it is a dropped part of a line, whether it drops for certain, where it starts if for its names, and what slots call it
        stack: list[tuple[str, str, bool, bool, int, str]] = []
        zone, text, at, mute = "open", [], 0, False

        def close() -> None:
            if text:
                joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
                if joined:
                    self.slots.append(" ".join(x[5] for x in stack if x[5]) if zone == "main" else "")
                    self.blocks.append((zone if zone not in ("title", "bare") else "main" if zone == "title" else "drop", joined))
                    self.body = self.body or zone == "main" and not any(x[0] in _HEADINGS for x in stack)
                text.clear()

        def leave(k: int) -> None:
            nonlocal zone, mute
            del stack[k:]
            zone = stack[-1][1] if stack else "open"
            mute = mute and any(x[2] for x in stack)

        for m in _TOKEN.finditer(page):
            if m.start() > at and not mute:
                if stack and stack[-1][0] == "head" and page[at : m.start()].strip():
                    close()
                    leave(len(stack) - 1)
                text.append(page[at : m.start()])
            at = m.end()
            name = (m[3] or "").lower()
            if not name:
                if m[1]:
                    text.append(" ")
                continue
            if name not in _INLINE:
                close()
            elif name == "br":
                text.append(" ")
            if m[2]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if stack[k][0] in _WALLS and (name in _CLOSES or name in _INLINE):
                        break
                leave(len(stack))
                continue
            if name not in _HEAD:
                for k, x in enumerate(stack):
                    if x[0] == "head":
                        close()
                        leave(k)
                        break
            if name in _CLOSES:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in _CLOSES[name]:
                        del stack[k:]
                        break
                    if stack[k][0] in _WALLS:
                        break
                leave(len(stack))
            if name in _VOID or m[4].rstrip().endswith("/") and name in ("svg", "path"):
                continue
            hard, soft, main, header = _marks(name, m[4])
            if m.start() in spared:
                soft, header = False, header and name == "header"
            drop = hard or soft
            by_names = -1 if hard or name in _INLINE else m.start() if soft or header and name not in ("header", *_HEADINGS) else -1
            if zone in ("drop", "bare") or by_names >= 0:
                above = [x[4] for x in stack if x[4] >= 0]
                if not any(x[3] for x in stack):
                    if main:
                        self.holders.update(above)
                        if by_names >= 0:
                            self.holders.add(by_names)
                    if name in _FRAME and above:
                        self.outer.add(above[0])
                    if by_names >= 0 and not above and (name == "form" or zone in ("main", "bare")):
                        self.outer.add(by_names)
            quiet = drop and name in _INLINE and zone != "drop"
            if quiet:
                mute = True
            elif zone != "drop":
                if drop:
                    zone = "drop"
                elif header and name not in _HEADINGS:
                    zone = "bare" if zone in ("main", "title", "bare") else "drop"  # of an article's header its headings stay
                elif zone == "bare":
                    zone = "title" if name in _HEADINGS else "bare"
                elif main:
                    zone = "main"
            stack.append((name, zone, quiet, hard, by_names, "" if name in _INLINE else name + _label(m[4])))
        if not mute:
            if stack and stack[-1][0] == "head" and page[at:].strip():
                leave(len(stack) - 1)
            text.append(page[at:])
        close()


def read_page(page: str) -> _Reading:
    """The page, read so that names don't hide its main part.

    Names such as "sidebar", and forms, may stand on what holds the whole
    page. So where no main part has a text, those that hold one are read as if
    they had no such name, unless more lies outside (then it was a teaser or
    the like); and where nothing at all is left, the outermost ones.
    """
    first = _Reading(page)
    if first.body:
        return first
    if first.holders:
        second = _Reading(page, frozenset(first.holders))
        if second.body and second.size("main") > first.size("open"):
            return second
    if first.outer and not first.size("open"):
        third = _Reading(page, frozenset(first.outer))
        if third.body or third.size("open"):
            return third
    return first


def blocks_of(page: str) -> list[tuple[str, str]]:
    """The page's blocks in order as (zone, text): main, open (outside any main part) or drop."""
    return read_page(page).blocks


# -- repeated runs of a host ---------------------------------------------------------------------------

PARSED = "host string, shard long, page_id long, url string, has_main boolean, payload binary"
MAIN = "page_id long, url string, text string"


def _pack(page: _Reading, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Blocks, whose texts have no line ends, as lines led by their zone's letter and a number for their slot."""
    lines = (f"{z[0]}{zlib.crc32(slot.encode('utf-8', 'replace')):08x}{t}" for (z, t), slot in zip(page.blocks, page.slots, strict=True))
    return squeeze.compress("\n".join(lines).encode("utf-8", "replace"))


def _unpack(payload: bytes) -> tuple[str, list[bytes], list[bytes]]:
    """Zone letters, slots and texts of a page's blocks."""
    raw = zstandard.ZstdDecompressor().decompress(payload)
    lines = raw.split(b"\n") if raw else []
    return "".join(chr(x[0]) for x in lines), [x[1:9] for x in lines], [x[9:] for x in lines]


@tidied
def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, shard, page_id, url, html) to the page's blocks."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for start, stop in slices(batch.column(4), 4 << 20):
            pages = [read_page(page or "") for page in batch.column(4)[start:stop].to_pylist()]
            mains = [any(z == "main" for z, _ in page.blocks) for page in pages]
            yield pa.RecordBatch.from_arrays([*(batch.column(k)[start:stop] for k in range(4)), pa.array(mains), pa.array([_pack(page, squeeze) for page in pages], pa.binary())], ["host", "shard", "page_id", "url", "has_main", "payload"])


def _stream(texts: list[bytes], names: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a page, each block led by a mark, and each token's block."""
    values, first = numbered(texts, names)
    if not isinstance(names, Hashes):
        values = values + 2
    return np.insert(values, first[:-1], values.dtype.type(1)), np.repeat(np.arange(len(texts)), np.diff(first) + 1)


def repeated(streams: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each stream which of its tokens lie in a run of RUN or more that another, different stream has, and in one that many have.

    All streams are one sequence, whose suffix array and common prefixes show
    the runs that repeat. Equal streams count as one page. Many are MANY
    streams or more, and at least the share SHARE of all.
    """
    names: dict[bytes, int] = {}
    page = [names.setdefault(s.tobytes(), len(names)) for s in streams]
    kept = list(dict(zip(reversed(page), reversed(range(len(page))), strict=True)).items())
    kept = [k for _, k in sorted(kept)]  # the first page of each stream
    sizes = np.array([len(streams[k]) + 1 for k in kept])
    tokens = np.concatenate([np.append(streams[k], streams[k].dtype.type(0)) for k in kept])
    distinct, symbols = np.unique(tokens, return_inverse=True)
    symbols = symbols + 1  # 0 is what lies beyond the end
    order = suffix_array(symbols, int(len(distinct) + 1).bit_length())
    classes = np.cumsum(common_prefixes(symbols, order, RUN) < RUN) - 1
    owner = np.repeat(np.arange(len(kept)), sizes)
    to_end = np.repeat(np.cumsum(sizes) - 1, sizes) - np.arange(len(tokens))
    valid = to_end[order] >= RUN
    order, classes = order[valid], classes[valid]
    if not len(order):
        none = [np.zeros(len(s), bool) for s in streams]
        return none, none
    pairs = np.sort((np.cumsum(np.concatenate(([0], classes[1:] != classes[:-1]))) << 32) | owner[order])
    pages = np.bincount(pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))] >> 32)  # distinct pages of each run
    having = pages[np.cumsum(np.concatenate(([0], classes[1:] != classes[:-1])))]
    out = []
    for least in (2, max(MANY, SHARE * len(kept))):
        edges = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(edges, order[having >= least], 1)
        np.add.at(edges, order[having >= least] + RUN, -1)
        covered = np.split(np.cumsum(edges[:-1]) > 0, np.cumsum(sizes)[:-1])
        out.append([covered[p][:-1] for p in page])
    return out[0], out[1]


def template_slots(pages: list[tuple[str, list[bytes], list[bytes]]], streams: list[tuple[np.ndarray, np.ndarray]], common: list[np.ndarray]) -> set[bytes]:
    """Slots of main parts that hold nothing but runs common to many pages, on half of the distinct pages that have them or more."""
    votes: dict[bytes, list[int]] = {}
    seen: set[bytes] = set()
    if not any(c.any() for c in common):
        return set()
    for (zones, slots, _), (tokens, of), hit in zip(pages, streams, common, strict=True):
        if "m" not in zones or (name := hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()) in seen:
            continue
        seen.add(name)
        word = np.diff(of, prepend=-1) == 0  # other than the marks
        kept = np.bincount(of[word & ~hit], minlength=len(zones))
        full: dict[bytes, bool] = {}
        for zone, slot, words in zip(zones, slots, kept.tolist(), strict=True):  # words that no common run covers
            if zone == "m":
                full[slot] = full.get(slot, True) and not words
        for slot, all_ in full.items():
            vote = votes.setdefault(slot, [0, 0])
            vote[0] += 1
            vote[1] += all_
    return {slot for slot, (having, full) in votes.items() if full >= MANY and 2 * full >= having}


def _without(texts: list[bytes], chosen: list[int], of: np.ndarray, covered: np.ndarray) -> str:
    """The words of some blocks outside covered runs; a block that loses all its words goes."""
    out = []
    for k in chosen:
        hit = covered[np.searchsorted(of, k) : np.searchsorted(of, k, "right")][1:].copy()
        if not hit.all():  # the tail of a run from the block before isn't a run of its own
            edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
            for a, b in edges.reshape(-1, 2).tolist():
                hit[a:b] = b - a >= RUN - 1
        if not hit.any():
            out.append(texts[k])
        elif not hit.all():
            out.append(b" ".join(w for w, x in zip(texts[k].split(), hit.tolist(), strict=True) if not x))
    return b"\n".join(out).decode("utf-8", "replace")


def text_of(page: tuple[str, list[bytes], list[bytes]], of: np.ndarray, shared: np.ndarray, common: np.ndarray, templates: set[bytes]) -> str:
    """A page's text: its main part without common runs in template slots, or without one what no other page has."""
    zones, slots, texts = page
    if "m" not in zones:
        return _without(texts, [k for k, z in enumerate(zones) if z == "o"], of, shared)
    main = [k for k, z in enumerate(zones) if z == "m"]
    drop = [k for k in main if slots[k] in templates]
    if drop:
        common = common & np.isin(of, drop)
        if 2 * common.sum() <= np.isin(of, main).sum():  # else they are copies of one article
            return _without(texts, main, of, common)
    return b"\n".join(texts[k] for k in main).decode("utf-8", "replace")


@tidied
def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, shard, page_id, url, payload, elsewhere) sorted by host and shard: one suffix array a shard, the text of its pages.

    ``elsewhere`` has hashes of the page's runs that other shards of the host have.
    """
    now, rows, hashes = None, [], Hashes()

    def solve() -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        names, out = Names(), []
        pages = [_unpack(r[2]) for r in rows]
        streams = [_stream(texts, names) for _, _, texts in pages]
        shared, common = repeated([tokens for tokens, _ in streams])
        templates = template_slots(pages, streams, common)
        for (page_id, url, _, elsewhere), page, (tokens, of), any_, many in zip(rows, pages, streams, shared, common, strict=True):
            if elsewhere and len(tokens) >= RUN:
                windows = np.isin(window_hashes(_stream(page[2], hashes)[0], RUN), np.frombuffer(b"".join(elsewhere), U64))
                for k in range(RUN):
                    any_[k : k + len(windows)] |= windows
            out.append((page_id, url, text_of(page, of, any_, many, templates)))
        rows.clear()
        for k in range(0, len(out), 500):
            columns = zip(zip(*out[k : k + 500], strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["page_id", "url", "text"])

    for batch in batches:
        for host, shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (host, shard) != now:
                yield from solve()
                now = (host, shard)
            rows.append(row)
    yield from solve()


# -- hosts of several shards ---------------------------------------------------------------------------

OFFERED = "host string, bucket long, shard long, page_id long, stream binary, runs binary"


def _offer(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(host, shard, page_id, payload) to packed hashes of a page's runs, by bucket, with the hash of the page's whole stream."""
    names = Hashes()
    for batch in batches:
        out = []
        for host, shard, page_id, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tokens = _stream(_unpack(payload)[2], names)[0]
            stream = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
            found = np.unique(window_hashes(tokens, RUN))
            bucket = (found % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                out.append((host, b, shard, page_id, stream, found[order[cuts[b] : cuts[b + 1]]].tobytes()))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["host", "bucket", "shard", "page_id", "stream", "runs"])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (host, bucket) to the runs that several different pages of the bucket have, for each such page.

    Equal streams count as one page, as in ``repeated``.
    """
    now, pages, runs = None, [], {}

    def answer() -> Iterator[pa.RecordBatch]:
        if len(runs) > 1:
            distinct, counts = np.unique(np.frombuffer(b"".join(runs.values()), U64), return_counts=True)
            common = distinct[counts > 1]
            shared = {s: own[np.isin(own, common)].tobytes() for s, own in ((s, np.frombuffer(r, U64)) for s, r in runs.items())}
            out = [(now[0], shard, p, shared[s]) for shard, p, s in pages if shared[s]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["host", "shard", "page_id", "runs"])

    for batch in batches:
        for host, bucket, shard, page_id, stream, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (host, bucket) != now:
                yield from answer()
                now, pages, runs = (host, bucket), [], {}
            pages.append((shard, page_id, stream))
            runs[stream] = raw
    yield from answer()


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Markup gives the blocks of a page and what the standard's elements, roles
    and a few names show to be navigation, headers, footers, notices, adverts,
    forms, comments or hidden. The blocks of all pages of a host, of whatever
    kind, are one token stream a page; suffix arrays of SHARD_PAGES pages find
    the runs of RUN tokens or more that distinct pages share. An article, main
    part or content element loses the runs that many pages have (MANY, and at
    least SHARE of the array's) in slots that hold nothing else on half of the
    pages that have the slot; a passage that articles share lies among unique
    paragraphs, so it stays, and so does all where most would go, which shows
    copies of one article. A page without such an element is what lies outside
    the rest, without any run that another page has; here runs are also
    matched across a host's shards, by hash. Unique runs stay.

    Blocks end at block elements; a line break is white space. Null and empty
    html give an empty text; rows without a url are one host. Copies of a page
    count as one, so repeated rows give equal rows; the order of rows doesn't
    matter. Long pages are parsed whole, one at a time. No rows give no rows;
    extra columns are ignored.
    """
    spark = pages.sparkSession
    named = with_host_and_path(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    named = named.select("host", "page_id", "url", "html")
    large = cut(named.groupBy("host").count().where(F.col("count") > SHARD_PAGES).select(F.col("host").alias("large"), F.ceil(F.col("count") / SHARD_PAGES).alias("shards")))
    several = large.count()
    placed = named.join(F.broadcast(large) if several <= BROADCAST_HOSTS else large, F.col("host") == F.col("large"), "left")
    shard = F.when(F.col("shards").isNotNull(), F.pmod(F.xxhash64("page_id", "url"), F.col("shards"))).otherwise(F.lit(-1)).cast("long")
    placed = placed.select("host", shard.alias("shard"), "page_id", "url", "html")
    size = named.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    n = partitions_for(spark, size)

    def cleaned(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, "host", "shard").sortWithinPartitions("host", "shard").mapInArrow(_clean, MAIN)

    nothing = F.lit(None).cast("array<binary>").alias("elsewhere")
    columns = ["host", "shard", "page_id", "url", "payload"]
    out = cleaned(placed.where("shard < 0").mapInArrow(_parse, PARSED).select(*columns, nothing))
    if several:
        parsed = cut(placed.where("shard >= 0").mapInArrow(_parse, PARSED))
        open_hosts = cut(parsed.where("not has_main").select("host").distinct())
        if open_hosts.isEmpty():
            rows = parsed.select(*columns, nothing)
        else:
            offered = parsed.join(open_hosts, "host", "left_semi").select("host", "shard", "page_id", "payload").mapInArrow(partial(_offer, buckets=n), OFFERED)
            found = offered.repartition(n, "host", "bucket").sortWithinPartitions("host", "bucket").mapInArrow(_answer, "host string, shard long, page_id long, runs binary")
            found = found.groupBy("host", "shard", "page_id").agg(F.collect_list("runs").alias("elsewhere"))
            rows = parsed.alias("p").join(found.alias("f"), F.expr("p.host = f.host and p.shard = f.shard and p.page_id <=> f.page_id"), "left").select(*(f"p.{c}" for c in columns), "elsewhere")
        out = out.union(cleaned(rows))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_html_text(spark, sf_dir):
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
