"""HTML extraction by page differencing: pages are paired with their nearest URLs, their lines aligned, shared lines deleted.

The lines of a page are its text blocks. Every page is aligned with the two pages of its host that are nearest by URL,
and a line in both longest common subsequences is a template's. What alignment can't tell, the page's structure
decides afterwards: a line of an article that other articles repeat stays, and a menu or advert that changes from page to
page goes, by the element it stands in.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import deque
from dataclasses import dataclass
from itertools import islice, zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import named, prepare

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*)>""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)
_NONE = re.compile(r"display\s*:\s*none", re.I)
_PART = re.compile(r"[a-z]+|\d+")

#: Elements whose content is not markup, up to their end tag.
_RAW = {"script", "style", "textarea", "iframe", "noframes", "noembed", "title"}
#: Where a raw element is never closed, the page goes on at the next tag of these.
_RESUME = re.compile(r"<(?=/?(?:html|body|article|main|section|div|p|h[1-6]|ul|ol|li|table|nav|header|footer|aside|blockquote|pre)\b)", re.I)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that begin a block; all others, unknown ones among them, run on inside a line.
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "canvas", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "noscript", "object", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "template", "tfoot", "th", "thead",
    "tr", "ul", "video", "audio",
}
#: Blocks that hold a line rather than other blocks.
_LINE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dt", "dd", "blockquote", "pre", "figcaption", "caption", "legend", "summary", "address"}
#: Those of them that are text themselves: what they are called says nothing of what they hold.
_TEXT = _LINE - {"li", "dd", "td"}
#: Elements that are never part of an article, nor shown as text of it.
_OTHER = {"head", "nav", "footer", "aside", "form", "select", "menu", "dialog", "fieldset", "search", "noscript", "template", "object", "canvas", "video", "audio"}
_ARTICLE = {"article", "main"}
#: Words in a class, id or role by which an element says that it is no part of the article.
_OTHER_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert",
    "popup", "modal", "overlay", "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "masthead", "footer", "sidebar", "complementary", "contentinfo", "widget", "related", "recommended", "teaser",
    "share", "sharing", "social", "newsletter", "subscribe", "subscription", "signup", "login", "search", "pagination", "pager", "toolbar", "skip", "copyright", "disclaimer", "tracking",
}
_COMMENT_WORDS = {"comment", "comments", "commentlist", "respond", "reply", "replies", "disqus"}
#: Names by which a container inside an article says that it holds comments, an advert or buttons: whole ones that no subject has.
_INSIDE_NAMES = _COMMENT_WORDS | {"comment-list", "comment-thread", "comments-area", "comments-section", "comment-section", "user-comments", "reader-comments", "disqus_thread"}
_INSIDE_NAMES |= {"ad", "ads", "advert", "advertisement", "sponsored", "share-buttons", "sharing-buttons", "social-share", "related-posts", "related-articles", "newsletter-signup", "cookie-notice"}
_HEADER_WORDS = {"header", "topbar"}
#: Words of those that an element inside a line may go by.
_INLINE_WORDS = {"ad", "ads", "advert", "advertisement", "sponsored"}
#: A start tag that ends an open element of these names before it.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Kinds of lines beside the numbers (from 1) of the articles that they stand in.
OTHER, PLAIN = -1, 0


@dataclass
class _Element:
    tag: str
    other: bool = False
    article: int = 0
    #: Places in the page's list of elements that only a word speaks against.
    words: tuple[int, ...] = ()
    inline_out: bool = False


def _attributes(attrs: str) -> tuple[bool, list[str]]:
    """Whether an element is hidden, and the names in its class, id and role."""
    names: list[str] = []
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and value.lower() != "until-found" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NONE.search(value):
            return True, []
        if name in ("class", "id", "role"):
            names += value.lower().split()
    return False, names


def _spoken_against(tag: str, names: list[str], in_article: bool) -> str | None:
    """How an element says that it is none of the article: by a whole name ("name"), or where it holds blocks also by a
    part of one ("part"). Inside an article, where names are about the subject as well, only whole names of _INSIDE_NAMES count,
    and not on elements that are text themselves."""
    if in_article:
        return "name" if tag not in _TEXT and not _INSIDE_NAMES.isdisjoint(names) else None
    words = _OTHER_WORDS | _COMMENT_WORDS | _HEADER_WORDS
    for name in names:
        if name in words:
            return "name"
        if tag not in _LINE and tag != "article":
            parts = _PART.findall(name)
            for before, w in zip(["", *parts], parts):
                if w in words and before not in ("no", "has", "with", "without"):
                    return "part"
    return None


class _Page:
    """Lines and their kinds from a page's markup."""

    def __init__(self):
        self.lines: list[str] = []
        self.at: list[_Element] = []
        self.stack: list[_Element] = [_Element("")]
        self.held: list[str] = []
        self.articles = 0
        self.words: list[str] = []

    def flush(self) -> None:
        if self.held:
            text = " ".join(html.unescape("".join(self.held)).split())
            self.held.clear()
            if text:
                self.lines.append(text)
                self.at.append(next(e for e in reversed(self.stack) if e.tag in _BLOCK or not e.tag))

    def start(self, tag: str, attrs: str) -> None:
        top = self.stack[-1]
        hidden, names = _attributes(attrs) if attrs else (False, [])
        if tag not in _BLOCK:
            out = top.inline_out or hidden or tag == "button" or any(n in _INLINE_WORDS for n in names)
            if not attrs.endswith("/") and tag not in _VOID:
                self.stack.append(_Element(tag, top.other, top.article, top.words, out))
            return
        self.flush()
        while len(self.stack) > 1 and (self.stack[-1].tag == "p" or self.stack[-1].tag in _CLOSES.get(tag, ()) or self.stack[-1].tag not in _BLOCK):
            self.stack.pop()
        if tag in _VOID or attrs.endswith("/"):
            return
        top = self.stack[-1]
        other = top.other or hidden or tag in _OTHER or tag == "header" and not top.article
        words = top.words
        if tag not in ("html", "body", "main") and not other and (w := _spoken_against(tag, names, bool(top.article))):
            words = (*words, len(self.words))
            self.words.append(w)
        article = top.article
        if tag in _ARTICLE and not article:
            self.articles += 1
            article = self.articles
        self.stack.append(_Element(tag, other, article, words, top.inline_out))

    def end(self, tag: str) -> None:
        if tag in _BLOCK:
            self.flush()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return
            if tag not in _BLOCK and self.stack[i].tag in _BLOCK:
                return

    def kinds(self) -> list[int]:
        """OTHER, PLAIN or the number of the article, for each line.

        Where no article is left beside it, a part of a name does not speak against an element that holds over half of
        the page's text (it is a wrapper named after what it wraps), nor a whole name where nothing else would be left.
        """
        void: set[int] = set()

        def kind(e: _Element) -> int:
            return OTHER if e.other or any(w not in void for w in e.words) else e.article

        sizes = [0] * len(self.words)
        total = 0
        for line, e in zip(self.lines, self.at):
            if not e.other:
                total += len(line)
                for w in e.words:
                    sizes[w] += len(line)
        for w in sorted(range(len(self.words)), key=lambda w: -sizes[w]):
            left = {kind(e) for e in self.at}
            if not sizes[w] or any(k > 0 for k in left):
                break
            if 2 * sizes[w] > total and self.words[w] == "part" or left <= {OTHER}:
                void.add(w)
        return [kind(e) for e in self.at]


def page_lines(page: str) -> tuple[list[str], list[int]]:
    """The text blocks of a page in order (references decoded, white space one space, trimmed, none empty) and what each
    stands in: OTHER, PLAIN, or the number of its article or main element."""
    p = _Page()
    at, end = 0, len(page)

    def text(s: str) -> None:
        if not p.stack[-1].inline_out:
            p.held.append(s)

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, attrs = m[2].lower(), m[3]
        if m[1]:
            p.end(tag)
        elif tag in _RAW:
            if not attrs.endswith("/"):
                if stop := re.compile(rf"</{tag}\s*>", re.I).search(page, at):
                    at = stop.end()
                else:
                    resume = _RESUME.search(page, at)
                    at = resume.start() if resume else end
        elif tag == "br":
            text(" ")
        else:
            p.start(tag, attrs)
    p.flush()
    return p.lines, p.kinds()


def _rows(a: list, b: list) -> list[int]:
    """Bit-parallel rows: after line i of ``a``, bit j is 0 where the longest common subsequence with b[:j + 1] is one
    longer than with b[:j]."""
    where: dict = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    mask = v = (1 << len(b)) - 1
    out = []
    for line in a:
        u = v & where.get(line, 0)
        v = (v + u | v - u) & mask
        out.append(v)
    return out


def _lengths(a: list, b: list) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with b[:j], j = 0..len(b)."""
    last = deque(_rows(a, b), maxlen=1)
    bits = np.unpackbits(np.frombuffer((last[0] if last else 0).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))]) if last else np.zeros(len(b) + 1, np.int64)


#: Bits of alignment rows that are held at a time; longer pages are halved first.
_ROW_BITS = 1 << 28


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Equal beginnings and ends are shared at once and lines that only one page has are left out. The rest is aligned by
    bit-parallel rows walked back, halved by Hirschberg's method while the rows would be too many to hold.
    """
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    m = 0
    while m < min(len(a), len(b)) - n and a[-1 - m] == b[-1 - m]:
        m += 1
    out = {*range(n), *range(len(a) - m, len(a))}
    in_b, in_a = set(b[n : len(b) - m]), set(a[n : len(a) - m])
    places = [i for i in range(n, len(a) - m) if a[i] in in_b]
    x, y = [a[i] for i in places], [t for t in b[n : len(b) - m] if t in in_a]
    if not x:
        return out
    if len(x) * len(y) > _ROW_BITS and len(x) > 1:
        half = len(x) // 2
        cut = int((_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
        found = shared_lines(x[:half], y[:cut]) | {half + i for i in shared_lines(x[half:], y[cut:])}
        return out | {places[i] for i in found}
    rows, i, j = _rows(x, y), len(x), len(y)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            out.add(places[i - 1])
            i, j = i - 1, j - 1
    return out


def template_lines(lines: list[str], neighbours: list[list[str]]) -> set[int]:
    """Places of the lines that alignment with each of the neighbours (two, or the only one) finds shared; none without one."""
    found = [shared_lines(lines, other) for other in neighbours]
    return set.intersection(*found) if found else set()


def main_lines(lines: list[str], kinds: list[int], template: set[int]) -> list[int]:
    """Places of the lines that stay.

    The template's lines go first. Then structure decides what alignment can't: where a page has an article (or main)
    element, other lines go, and shared lines inside it are passages that articles share and stay, but of several
    articles those go of which every line is the template's. Where it has none, lines in elements that are none of an
    article go, and the rest is the text. A page that has no line of its own left is a copy of its neighbours and keeps
    its template.
    """
    articles = sorted({k for k in kinds if k > 0})
    if articles:
        own = {k for i, k in enumerate(kinds) if k > 0 and i not in template}
        keep = own or set(articles)
        return [i for i, k in enumerate(kinds) if k in keep]
    plain = [i for i, k in enumerate(kinds) if k == PLAIN]
    return [i for i in plain if i not in template] or plain


def main_text(page: tuple[list[str], list[int]], neighbours: list[list[str]]) -> str:
    lines, kinds = page
    return "\n".join(lines[i] for i in main_lines(lines, kinds, template_lines(lines, neighbours)))


def _common(path: str, other: str) -> int:
    n = 0
    for x, y in zip(path, other):
        if x != y:
            break
        n += 1
    return n


#: Pages before and after a page, in the order of host and path, among which its two neighbours are sought.
REACH = 2


def _windows(rows):
    """(row, rows within REACH of it, nearest first) for each of the sorted rows; the rows of a bucket see no others."""
    ahead, past = deque(), deque(maxlen=REACH)

    def first():
        now = ahead.popleft()
        near = [x for pair in zip_longest(reversed(past), islice(ahead, REACH)) for x in pair if x is not None and x[0] == now[0]]
        past.append(now)
        return now, near

    for row in rows:
        ahead.append(row)
        if len(ahead) > REACH:
            yield first()
    while ahead:
        yield first()


def _key_parts(url_col: str, id_col: str):
    url = F.coalesce(named(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return host.alias("h"), path.alias("p"), F.coalesce(named(id_col).cast("long"), F.lit(-(1 << 63))).alias("k")


#: Pages of a bucket, about: what one task sorts and compares; and the most buckets (a few keys of each are sent to the tasks).
BUCKET_PAGES, MOST_BUCKETS = 5_000, 100_000


def _buckets(pages: DataFrame, url_col: str, id_col: str) -> list[tuple]:
    """(first key, key from which on pages before the bucket belong to its margin, key up to which pages behind it do) of each
    bucket of the pages sorted by (host, path, id). Only keys are sorted, and 2 * REACH of each bucket reach the driver."""
    spark = pages.sparkSession
    keys = pages.select(*_key_parts(url_col, id_col))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(keys.count() // BUCKET_PAGES + 1, MOST_BUCKETS))
    dealt = keys.repartitionByRange(n, "h", "p", "k").sortWithinPartitions("h", "p", "k")

    def edges(batches):
        first, last, total = [], deque(maxlen=REACH), 0
        for b in batches:
            rows = list(zip(*(c.slice(0, REACH).to_pylist() for c in b.columns)))
            first += rows[: REACH - len(first)]
            ends = b.slice(max(0, b.num_rows - REACH))
            last.extend(zip(*(c.to_pylist() for c in ends.columns)))
            total += b.num_rows
        rows = first + list(last)[-max(0, total - len(first)) :] if total > len(first) else first
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], ["h", "p", "k"])

    found = dealt.mapInArrow(edges, "h string, p string, k long").select(F.spark_partition_id().alias("part"), "h", "p", "k")
    ends: dict[int, list[tuple]] = {}
    for r in found.collect():
        ends.setdefault(r.part, []).append((_utf8(r.h), _utf8(r.p), r.k))
    parts = sorted(sorted(v) for v in ends.values())
    out = []
    for i, rows in enumerate(parts):
        before = [x for p in parts[max(0, i - REACH) : i] for x in p][-REACH:]
        behind = [x for p in parts[i + 1 : i + 1 + REACH] for x in p][:REACH]
        out.append((rows[0], (before or rows)[0], (behind or rows)[-1]))
    return out


def _utf8(s: str) -> bytes:
    """Strings sort in Spark by their bytes."""
    return s.encode("utf-8", "replace")


_LINES = "bucket int, home boolean, page_id long, url string, h string, p string, k long, lines string, kinds array<int>"


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page, blocks joined by newlines ("" if there is none).

    Pages are sorted by host, path and id, and each is aligned with the two of the four around it on its host that
    have the longest common paths (of equal ones the nearer). Null or empty html gives an empty text; a null url or one
    without a host has no neighbour; repeated rows are pages of their own, and copies of each other. Other columns are
    not read. An empty table gives an empty table.

    The keys alone are sorted first, to find the bounds of buckets. Then a page goes once, as its lines, to its bucket, and
    the few at a bucket's edges also to the neighbouring one, so that every page meets its neighbours however many
    partitions or buckets there are, and a host of any size spreads over as many.
    """
    spark = pages.sparkSession
    prepare(spark)
    buckets = _buckets(pages, url_col, id_col)
    bounds = spark.sparkContext.broadcast(tuple(zip(*buckets)) if buckets else ((), (), ()))
    src = pages.select(named(id_col).cast("long").alias("page_id"), named(url_col).alias("url"), *_key_parts(url_col, id_col), F.coalesce(named(html_col), F.lit("")).cast("binary").alias("c"))

    def split(batches):
        first, lo, hi = bounds.value
        for b in batches:
            out = []
            for page_id, url, h, p, k, c in zip(*(x.to_pylist() for x in b.columns)):
                lines, kinds = page_lines(c.decode("utf-8", "replace"))
                row = (page_id, url, h, p, k, "\n".join(lines), kinds)
                key = (_utf8(h), _utf8(p), k)
                own = max(0, bisect_right(first, key) - 1)
                out.append((own, True, *row))
                near = own + 1
                while near < len(lo) and key >= lo[near]:
                    out.append((near, False, *row))
                    near += 1
                near = own - 1
                while near >= 0 and key <= hi[near]:
                    out.append((near, False, *row))
                    near -= 1
            if out:
                types = [pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], [f.split()[0] for f in _LINES.split(", ")])

    def texts(batches):
        def rows():
            for b in batches:
                for bucket, home, page_id, url, h, p, lines, kinds in zip(*(x.to_pylist() for x in b.columns)):
                    yield (bucket, h), home, page_id, url, p, (lines.split("\n") if lines else [], kinds)

        out = []
        for now, near in _windows(rows()):
            if now[1]:
                near = sorted(near, key=lambda x: -_common(now[4], x[4]))[:2] if now[0][1] else []
                out.append((now[2], now[3], main_text(now[5], [x[5][0] for x in near])))
                if len(out) >= 500:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string()))], ["page_id", "url", "text"])

    order = ["bucket", "h", "p", "k", "lines"]
    dealt = src.mapInArrow(split, _LINES).repartition("bucket").sortWithinPartitions(*order).select("bucket", "home", "page_id", "url", "h", "p", "lines", "kinds")
    return dealt.mapInArrow(texts, "page_id long, url string, text string").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
