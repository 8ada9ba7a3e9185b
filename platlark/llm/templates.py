"""HTML extraction by equivalence-class template deduction over the pages of a host.

Tokens are tags (with their class, id and role; an end tag carries those of its start
tag) and text runs.  Tokens of one host that occur equally often on every page share an
occurrence vector and form an equivalence class; the vector is carried as a commutative
hash of (page, count), so classes come from one aggregation with map-side combining and
no page list is ever gathered.  The classes of tokens that occur at most once a page,
on at least ``SUPPORT`` of the host's pages that have any token, make the template's
frame; its tokens, ordered by their mean position, cut each page into slots.  Pairs of
start and end tags nest them into a tree.  Classes of repeated tokens (as often as each
other on every page) are nested into the slot where they lie; a slot outside the
article whose repeated class is made of links is a menu.

The frame decides where the article is (``region``): from the root of the tree it goes
down while one element's slots hold at least ``SHARE`` of its parent's running text
(text outside links and noise, as the mean over the host's pages).  On a page the
region's slots are what is extracted.  Inside it, text runs that belong to the frame
are dropped unless they make up a third of the region (then the host's pages are
copies of each other), as are elements with an advert, notice, comment or similar mark
of their own.  Markup is the second signal: an article or main element narrows the
region if it lies inside, and replaces it if the page has one elsewhere.  A page without the
region, or of a host with fewer than ``MIN_PAGES`` pages, is read by its own markup.

Defined results
* null or empty html: empty text; such pages do not count for the frame.  Null or
  malformed urls share the empty host.
* character references are decoded; white space inside a block becomes one space;
  blocks are joined by one space.
* repeated rows and null or repeated ids give a row each: pages are told apart by their
  place in the table; extra columns are ignored; an empty table gives an empty result.
* unclosed elements end with their parent; a page cut off in the middle keeps what
  it has; a stray quote ends with its tag.
"""

from __future__ import annotations

import bisect
import html as html_lib
import re
from collections import Counter

from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from platlark.functions.shared import cut, staged
from platlark.llm.joins import spread_join
from platlark.llm.url_rules import host_of

MIN_PAGES, SUPPORT, SHARE = 3, 0.9, 0.6

# Element and attribute names with a meaning in HTML pages.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math")
NOT_TEXT = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "object", "audio", "video", "canvas"}
CONTAINERS = NOT_TEXT | {"div", "section", "article", "main", "header", "ul", "ol", "dl", "table", "body", "html", "figure", "details"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q",
    "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
NOTICE = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
    "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
    "overlay", "pager", "pagination", "popup", "promo", "promotion", "related", "reply", "replies", "respond", "share", "sharing",
    "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "header", "complementary", "contentinfo",
    "search", "alert", "alertdialog",
}
#: Marks that also drop an element inside the article, where they stand as whole words of an attribute.
INNER = NOTICE - {"header", "search", "alert", "masthead", "toolbar", "topbar", "banner", "notice", "notices"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SELF_ENDED = {"p", "li", "dt", "dd", "option", "tr", "td", "th"}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=)*)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")


def scan(page: str):
    """(kind, name, marks, text) in page order; kind is open, close or text.  An end tag has the marks of its start tag."""
    at, begun = 0, {}
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            yield "text", "", "", page[at : m.start()]
        at = m.end()
        if m["name"]:
            name = m["name"].lower()
            if m["close"]:
                open_ = begun.get(name)
                yield "close", name, open_.pop() if open_ else "", ""
            else:
                attrs = m["attrs"]
                marks = " ".join(f"{a.lower()}={x or y or z}" for a, x, y, z in _ATTR.findall(attrs)) if "=" in attrs else ""
                if name in SELF_ENDED:
                    begun[name] = [marks]
                elif name not in VOID:
                    begun.setdefault(name, []).append(marks)
                yield "open", name, marks, ""
    if at < len(page):
        yield "text", "", "", page[at:]


def token(kind: str, name: str, marks: str, text: str) -> int:
    """A signed 64-bit hash of a tag or of a text run; 0 for white space."""
    if kind == "text":
        words = text.split()
        if not words:
            return 0
        key = "t:" + " ".join(words)
    else:
        key = f"{kind}:{name}:{_digits(marks)}"
    h = xxhash.xxh64_intdigest(key)
    return h - (1 << 64) if h >> 63 else h


def _digits(marks: str) -> str:
    """Numbers inside attribute values differ from page to page."""
    return re.sub(r"\d+", "0", marks) if marks else marks


def _tag(kind: str, name: str) -> int:
    """A number for a start tag, its negative for the end tag, 0 for text."""
    if kind == "text":
        return 0
    k = xxhash.xxh32_intdigest(name) >> 1 or 1
    return k if kind == "open" else -k


_HOLDERS = {_tag("open", x) for x in CONTAINERS - NOT_TEXT}
_ARTICLES = {_tag("open", x) for x in MAIN}


def occurrences(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, page, token, n, pos, chars, tag, link): how often and where each token occurs on each page.

    pos: where it comes first among the page's tokens, from 0 to 1; chars: how much
    running text comes before it.
    """
    rows = pages.select(host_of(F.col(url)).alias("host"), F.monotonically_increasing_id().alias("page"), F.col(html).alias("html"))

    def run(batches):
        for b in (x.slice(i, 200) for x in batches for i in range(0, x.num_rows, 200)):
            at, out = [], []
            for i, page in enumerate(b.column(2).to_pylist()):
                counts: Counter = Counter()
                first: dict[int, tuple] = {}
                links, chars, size = 0, 0, 0
                for x in scan(page or ""):
                    t = token(*x)
                    if not t:
                        continue
                    kind, name, marks, text = x
                    if name == "a":
                        links = max(0, links + (1 if kind == "open" else -1))
                    counts[t] += 1
                    if t not in first:
                        first[t] = size, chars, _tag(kind, name), name == "a"
                    if kind == "text" and not links:
                        chars += len(text.strip())
                    size += 1
                if not size:
                    continue
                at += [i] * (len(counts) + 1)
                out.append((0, 1, -1.0, 0, 0, False))  # every page with a token has the token 0 once
                out += [(t, n, first[t][0] / size, *first[t][1:]) for t, n in counts.items()]
            if not out:
                continue
            cols = list(zip(*out, strict=True))
            index = pa.array(at, pa.int64())
            types = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(index), b.column(1).take(index), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                ["host", "page", "token", "n", "pos", "chars", "tag", "link"],
            )

    return rows.mapInArrow(run, "host string, page long, token long, n int, pos double, chars long, tag int, link boolean")


def deduce(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, rows, frame, places, chars, tags, links) of every host with a page; ``frame`` is null below ``MIN_PAGES``.

    frame: the template's tokens in order, with their mean places, the mean running
    text before them and their tags; links: mean places of the repeated classes of two
    tokens or more that hold a link; rows: how many pages the host has.
    """
    vectors = cut(
        occurrences(pages, url, html)
        .groupBy("host", "token")
        .agg(
            F.bit_xor(F.xxhash64("page", "n")).alias("vector"),
            F.count(F.lit(1)).alias("pages"),
            F.avg("pos").alias("pos"),
            F.avg("chars").alias("chars"),
            F.max("tag").alias("tag"),
            F.max("n").alias("most"),
            F.bool_or("link").alias("link"),
        )
        .filter((F.col("pages") >= MIN_PAGES) | (F.col("token") == 0))
    )
    root = vectors.filter("token = 0").select("host", F.col("pages").alias("all"))
    classes = vectors.filter("token <> 0 and most = 1").join(root, "host").filter((F.col("all") >= MIN_PAGES) & (F.col("pages") >= SUPPORT * F.col("all")))
    frame = classes.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "chars", "tag"))).alias("f"))
    nested = (
        vectors.filter("most > 1")
        .groupBy("host", "vector", "pages")
        .agg(F.count(F.lit(1)).alias("size"), F.bool_or("link").alias("link"), F.avg("pos").alias("pos"))
        .filter("size > 1 and link")
        .join(root, "host")
        .filter(F.col("pages") >= SUPPORT * F.col("all"))
        .groupBy("host")
        .agg(F.array_sort(F.collect_list("pos")).alias("links"))
    )
    counts = pages.groupBy(host_of(F.col(url)).alias("host")).agg(F.count(F.lit(1)).alias("rows"))
    part = lambda name: F.transform("f", lambda x: x[name])
    return counts.join(frame, "host", "left").join(nested, "host", "left").select(
        "host",
        "rows",
        part("token").alias("frame"),
        part("pos").alias("places"),
        part("chars").alias("chars"),
        part("tag").alias("tags"),
        F.coalesce("links", F.array().cast("array<double>")).alias("links"),
    )


@dataclass(frozen=True)
class Template:
    """The frame of a host: numbers of its tokens, places of link classes, and the two tokens that bound the article."""

    order: dict[int, int]
    places: list[float]
    links: list[float]
    region: tuple[int, int] | None


def region(chars: list[float], tags: list[int]) -> tuple[int, int] | None:
    """The frame tokens that open and close the element with the article's text: a container, and none inside an article element."""
    begun: list[int] = []
    pairs: list[tuple[int, int]] = []
    for k, tag in enumerate(tags):
        if tag > 0:
            begun.append(k)
        elif tag < 0 and any(tags[j] == -tag for j in begun):
            while tags[j := begun.pop()] != -tag:
                pass
            if tags[j] in _HOLDERS:
                pairs.append((j, k))
    held = lambda p: chars[p[1]] - chars[p[0]]
    best, within = None, chars[-1] if chars else 0
    while pairs and within > 0:
        inner = [p for p in pairs if best is None or best[0] < p[0] and p[1] < best[1]]
        top = max(inner, key=lambda p: (held(p), -p[0]), default=None)
        if top is None or held(top) < SHARE * within:
            break
        best, within, pairs = top, held(top), inner
        if tags[top[0]] in _ARTICLES:
            break
    return best


def template(frame, places, chars, tags, links) -> Template | None:
    if not frame:
        return None
    return Template({t: k for k, t in enumerate(frame)}, places, links or [], region(chars, tags))


def _increasing(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (frame number, page position) that rises in both."""
    tails: list[int] = []
    tail_at: list[int] = []
    back = [-1] * len(found)
    for k, (_, pos) in enumerate(found):
        j = bisect.bisect_left(tails, pos)
        back[k] = tail_at[j - 1] if j else -1
        tails[j : j + 1], tail_at[j : j + 1] = [pos], [k]
    out, k = [], tail_at[-1] if tail_at else -1
    while k >= 0:
        out.append(found[k])
        k = back[k]
    return out[::-1]


def _is_notice(name: str, marks: str, inside: bool) -> bool:
    """Whether an element is no part of the article by its name or its marks."""
    if name in NOT_TEXT:
        return True
    if name == "header":
        return not inside
    if not marks or name in ("body", "html", "article", "main") and "comment" not in marks:
        return False
    if inside:
        return not INNER.isdisjoint(w for x in marks.lower().split() for w in (x, x.partition("=")[2]))
    return name in CONTAINERS and not NOTICE.isdisjoint(_WORDS.findall(marks.lower()))


def extract(page: str, frame: Template | None = None, by_marks: bool = True) -> str:
    """Main text of one page, with the template of its host if there is one."""
    items = list(scan(page))
    starts: list[int] = []
    numbers: list[int] = []
    first, last = -1, len(items)  # the region on this page
    if frame:
        found = sorted((frame.order[t], k) for k, t in enumerate(map(lambda x: token(*x), items)) if t in frame.order)
        kept = _increasing(found)
        numbers, starts = [k for k, _ in kept], [pos for _, pos in kept]
        if frame.region and frame.region[0] in numbers:
            first = starts[numbers.index(frame.region[0])]
            if frame.region[1] in numbers:
                last = starts[numbers.index(frame.region[1])]
    fixed = set(starts)
    # slots (numbered by the frame token before them) in which a class of links repeats
    menus = {bisect.bisect_right(frame.places, x) - 1 for x in frame.links} if frame else set()

    stack: list[tuple[str, bool, bool]] = []  # name, not text, main
    skip = main = link_depth = 0
    #: text, inside the region, inside main, of the frame, slot
    runs: list[tuple[str, bool, bool, bool, int]] = []
    link_chars: Counter = Counter()
    all_chars: Counter = Counter()

    def pop() -> str:
        nonlocal skip, main
        top, drop, is_main = stack.pop()
        skip, main = skip - drop, main - is_main
        return top

    for k, (kind, name, marks, raw) in enumerate(items):
        inside = first >= 0 and first <= k < last
        if kind == "text":
            if skip:
                continue
            s = html_lib.unescape(raw) if "&" in raw else raw
            at = bisect.bisect_right(starts, k) - 1
            slot = numbers[at] if at >= 0 else -1
            n = len(s.strip())
            all_chars[slot] += n
            link_chars[slot] += n * (link_depth > 0)
            runs.append((s, inside, main > 0, k in fixed, slot))
            continue
        if name == "a":
            link_depth = max(0, link_depth + (1 if kind == "open" else -1))
        if name not in INLINE:
            runs.append((" ", inside, main > 0, False, -2))
        if kind == "open":
            if stack and stack[-1][0] in SELF_ENDED and stack[-1][1] and name not in INLINE:
                pop()  # a dropped paragraph ends where the next block begins
            drop = by_marks and _is_notice(name, marks, main > 0 or inside) or name in NOT_TEXT
            if name in VOID or not (drop or skip or name in CONTAINERS):
                continue
            is_main = name in MAIN and not drop and not skip
            stack.append((name, drop, is_main))
            skip, main = skip + drop, main + is_main
        elif any(x[0] == name for x in stack):
            while pop() != name:
                pass
    has_main = any(r[2] for r in runs)
    if first >= 0 and any(r[1] and r[0].strip() for r in runs) and (not has_main or any(r[1] and r[2] for r in runs)):
        runs = [r for r in runs if r[1] and (r[2] or not has_main)]
        same = sum(len(r[0].strip()) for r in runs if r[3])
        if 3 * same < sum(len(r[0].strip()) for r in runs):
            runs = [r for r in runs if not r[3]]
    elif has_main:
        runs = [r for r in runs if r[2]]
    else:
        runs = [(" ", *r[1:]) if r[3] or r[4] in menus and 2 * link_chars[r[4]] > all_chars[r[4]] else r for r in runs]
    out = " ".join("".join(r[0] for r in runs).split())
    if not out and by_marks and any(x[2] for x in items):
        return extract(page, None, False)
    return out


def main_text(pages: DataFrame, row_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every page."""
    kind = pages.schema[row_id].dataType.simpleString()
    frames = staged(deduce(pages, url, html), "frames")
    rows = pages.select(F.col(row_id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    rows = spread_join(rows, frames, ["host"], "rows").select("id", "url", "html", "host", "frame", "places", "chars", "tags", "links")

    def run(batches):
        known: dict[str, Template | None] = {}
        for b in (x.slice(i, 200) for x in batches for i in range(0, x.num_rows, 200)):
            texts = []
            for i, (h, host) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = template(*(b.column(k)[i].as_py() for k in range(4, 9)))
                texts.append(extract(h or "", known[host]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", row_id)
