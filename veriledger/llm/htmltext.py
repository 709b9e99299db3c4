"""Main text of web pages by differencing each page with its nearest URL on the same host.

A page is cut into lines (blocks) that its markup classes: `gone` is what never is text of the
article (menus, forms, scripts, adverts, comments, ...), `prose` are paragraphs, headings, items
and cells of an article or main element, `loose` is other text of such an element, and `open` is
text of a page outside any. Pages of a host are ordered by URL path, segment by segment, so that the
nearest of a page is one of its two neighbours; the lines of both are aligned by longest common
subsequence. A line that both share is deleted if it is of the host's template and not of a text that
was published twice: pages of equal lines count once, and a shared line must stand on at least three
pages of the host (on both, of a host with two), prose on half of them at least. A sentence that a
few articles share, or an article and its near copy, so stay.

Only line hashes travel: pages are parsed once where they are read, their lines are stored packed,
and hashes are sorted by (host, path) in ranges, so that a host with most pages is spread out.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriledger.llm.common import store

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
#: Elements by their part in a page, from the HTML standard.
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
NEVER = frozenset("nav header footer aside form button select option svg math canvas object audio video dialog menu head label fieldset map".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADING | frozenset("p li blockquote pre td th dd dt figcaption caption".split())
BLOCK = PROSE | NEVER | frozenset("html body div section article main ul ol dl table thead tbody tfoot tr figure hr address details summary center hgroup search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_GONE = frozenset("button select option svg math canvas object audio video label map".split())
#: Words of class, id and role by which pages mark what isn't the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar widget widgets related recommended recommendations share sharing social comment comments commentlist respond reply replies disqus menu nav navbar navigation breadcrumb breadcrumbs footer header masthead toolbar pagination pager copyright skip search hidden contentinfo complementary dialog".split()
)
MARKS_OF_MAIN = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo related teaser".split())
#: Words beside such a mark that leave its meaning; with any other word it has another.
NEUTRAL = frozenset("site page main top bottom left right wrapper wrap container box list item area section content contents block inner outer body form link links bar button buttons text article post entry blog wp global local primary secondary mobile desktop row col column panel group title heading icon inline first last fixed sticky small large new user thread section header footer nav js id".split())
MAIN_NAMES = frozenset("articlebody article-body article-content post-content post-body entry-content story-body main-content".split())
GONE, NORMAL, LOOSE, OPEN = 0, 1, 2, 3  # GONE is never stored
SEPARATOR = "\x1e"


def _class_of(name: str, text: str) -> tuple[bool, bool]:
    """(gone, main) of an element from its name and attributes."""
    main, gone = name in ("article", "main"), name in NEVER
    if not text or text == "/":
        return gone, main
    attrs = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(text)}
    named = [v.lower() for k in ("class", "id", "role", "itemprop") for v in attrs.get(k, "").split()]
    main |= any(v in MAIN_NAMES or v == "main" for v in named)
    if name in ("html", "body"):
        return False, False
    marks = MARKS_OF_MAIN if main else MARKS
    gone |= any(_marked(v, marks) for v in named) and not (main and name not in ("article", "main", "div", "section"))
    gone |= "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    return gone, main


def _marked(name: str, marks: frozenset[str]) -> bool:
    """Whether a name has a mark and no word that gives it another meaning."""
    parts = [x for x in re.split(r"[^a-z]+", name) if x]
    return any(x in marks for x in parts) and all(x in marks or x in NEUTRAL or len(x) == 1 for x in parts)


def lines_of(page: str) -> list[tuple[str, int]]:
    """(line, kind) of a page's blocks in order, without those that are gone."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name; gone, main, header of an article before it
    opened: dict[str, int] = {}  # how many of a name the stack has
    words: list[str] = []
    gone = main = title = False
    block = ""
    at, find = 0, TAG.search

    def flush() -> None:
        if words:
            line = SPACE.sub(" ", entities.unescape("".join(words))).strip()
            if line and not gone and not (title and block not in HEADING):
                out.append((line, (NORMAL if block in PROSE else LOOSE) if main else OPEN))
            words.clear()

    while m := find(page, at):
        if m.start() > at and not gone:
            words.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing = name.lower(), bool(m[1] or m[4])
        if not closing and name in RAW:
            end = re.compile(rf"</{name}\s*/?>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br" or name in ("td", "th"):
            words.append(" ")
        if name in BLOCK and name not in ("td", "th"):
            flush()
            block = "" if closing else name
        elif name not in INLINE_GONE and closing:
            continue
        if name in VOID:
            continue
        if closing:
            if opened.get(name):
                if gone:
                    words.clear()
                found = ""
                while found != name:
                    found, gone, main, title = stack.pop()
                    opened[found] -= 1
        elif name in BLOCK and name not in PROSE and name not in ("hr", "tr", "thead", "tbody", "tfoot") or name in INLINE_GONE or m[3] and name != "a" and ("class" in m[3] or "id" in m[3] or "hidden" in m[3]) and name in PROSE | {"span"}:
            drop, chief = _class_of(name, m[3] or m[6] or "")
            heads = name == "header" and main and drop
            if name in PROSE or name == "span":
                if not drop:
                    continue
                flush()
            stack.append((name, gone, main, title))
            opened[name] = opened.get(name, 0) + 1
            gone, main, title = gone or drop and not heads, main or chief and not drop, title or heads
        if name == "tr":
            block = "td"
    if at < len(page) and not gone:
        words.append(page[at:])
    flush()
    return out


def common(a: list[int], b: list[int]) -> list[bool]:
    """Which elements of a belong to a longest common subsequence of a and b. Bit-parallel rows;
    lists too long for all rows at once are halved first (Hirschberg), with the same length."""
    hit = [False] * len(a)
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        hit[lo] = True
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hit[len(a) - 1 - hi] = True
        hi += 1
    mid_a, mid_b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    both = set(mid_a) & set(mid_b)
    at = [i for i, x in enumerate(mid_a, lo) if x in both]
    x, y = [a[i] for i in at], [v for v in mid_b if v in both]
    for i, h in zip(at, _aligned(x, y), strict=True):
        hit[i] = hit[i] or h
    return hit


def _rows(x: list[int], y: list[int]) -> Iterator[int]:
    full, place = (1 << len(y)) - 1, {}
    for j, v in enumerate(y):
        place[v] = place.get(v, 0) | 1 << j
    row = full
    for v in x:
        u = row & place.get(v, 0)
        row = ((row + u) | (row - u)) & full
        yield row


def _aligned(x: list[int], y: list[int]) -> list[bool]:
    if not x or not y:
        return [False] * len(x)
    if len(x) > 1 and len(x) * len(y) > 1 << 28:
        half = len(x) // 2

        def best(p: list[int], q: list[int]) -> np.ndarray:
            *_, last = _rows(p, q)
            bits = np.unpackbits(np.frombuffer(last.to_bytes(len(q) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(q)]
            return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])

        cut = int(np.argmax(best(x[:half], y) + best(x[half:][::-1], y[::-1])[::-1]))
        return _aligned(x[:half], y[:cut]) + _aligned(x[half:], y[cut:])
    rows, hit, i, j = list(_rows(x, y)), [False] * len(x), len(x), len(y)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if i == 0 or rows[i - 1] >> (j - 1) & 1:
                hit[i] = True
                j -= 1
    return hit


def nearness(a: str, b: str) -> int:
    """How much two paths share: leading segments, then leading characters."""
    segments = 0
    for p, q in zip(a.split("/"), b.split("/")):
        if p != q:
            break
        segments += 1
    n = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    return (segments << 32) + n


def main_lines(lines: list[tuple[str, int]], cut: set[int]) -> list[str]:
    """The lines that stay: all but those cut, open ones only on pages without an article or main
    element."""
    has_main = any(kind != OPEN for _, kind in lines)
    return [line for i, (line, kind) in enumerate(lines) if i not in cut and (kind != OPEN or not has_main)]


def parse(pages: DataFrame) -> DataFrame:
    """rid, page_id, url, host, path, hashes, kinds, packed, digest of every page, stored. rid tells
    rows apart; host is null if the url has none; path sorts by segments; digest is of all lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                hashes, kinds, packed, digests = [], [], [], []
                for page in part.column("html"):
                    lines = lines_of(page.as_py() or "")
                    own = np.array([xxhash.xxh64_intdigest(t) for t, _ in lines], np.uint64)
                    hashes.append(own.view(np.int64))
                    digests.append(xxhash.xxh64_intdigest(own.tobytes()))
                    kinds.append(bytes(k for _, k in lines))
                    packed.append(zlib.compress(SEPARATOR.join(t.replace(SEPARATOR, " ") for t, _ in lines).encode("utf-8", "replace"), 1))
                cols = [part.column(c) for c in ("rid", "page_id", "url", "host", "path")]
                made = [pa.array(hashes, pa.list_(pa.int64())), pa.array(kinds, pa.binary()), pa.array(packed, pa.binary()), pa.array(np.array(digests, np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays([*cols, *made], ["rid", "page_id", "url", "host", "path", "hashes", "kinds", "packed", "digest"])

    url = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), "page_id", "url", F.lower(F.nullif(url, F.lit(""))).alias("host"), F.translate(F.coalesce(path, F.lit("")), "/", "\x01").alias("path"), "html")
    return store(rows.mapInArrow(run, f"rid long, page_id {dict(pages.dtypes)['page_id']}, url string, host string, path string, hashes array<long>, kinds binary, packed binary, digest long"), "html-lines")


def nearness(a: str, b: str) -> int:
    """How much two paths (segments parted by \\x01) share: leading segments, then leading characters."""
    segments = 0
    for p, q in zip(a.split("\x01"), b.split("\x01")):
        if p != q:
            break
        segments += 1
    n = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    return (segments << 32) + n


def differences(parsed: DataFrame) -> DataFrame:
    """rid, host, hash, kind, at (from 0) of the lines that a page shares with the nearest page of
    its host; of two equally near ones with that before it, by path, page_id and digest."""
    fields = ["rid", "host", "path", "hashes", "kinds"]
    made = ["rid", "near", "at", "hash", "kind", "part", "side", "host", "path", "hashes", "kinds"]
    out_schema = "rid long, near long, at array<int>, hash array<long>, kind binary, part int, side int, host string, path string, hashes array<long>, kinds binary"
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.binary()]

    def against(row: tuple, other: tuple, is_before: bool) -> tuple:
        at = [i for i, hit in enumerate(common(row[3], other[3])) if hit]
        return row[0], nearness(row[2], other[2]) * 2 + is_before, at, [row[3][i] for i in at], bytes(row[4][i] for i in at), None, None, row[1], None, None, None

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compares rows with their neighbours in the task; the first and last row also leave."""
        before = row = None
        part = 0
        rows: list[tuple] = []

        def settle(prev, own, after) -> None:
            near = [(nearness(own[2], x[2]), -i, x) for i, x in enumerate((prev, after)) if x is not None and x[1] == own[1]]
            if near:
                _, i, x = max(near, key=lambda t: t[:2])
                rows.append(against(own, x, i == 0))

        def edge(row: tuple, side: int) -> tuple:
            return row[0], None, None, None, None, part, side, *row[1:]

        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for new in zip(*(batch.column(c).to_pylist() for c in fields), strict=True):
                if row is None:
                    rows.append(edge(new, 0))
                else:
                    settle(before, row, new)
                before, row = row, new
            if rows:
                yield emit(rows)
                rows = []
        if row is not None:
            settle(before, row, None)
            rows.append(edge(row, 1))
            yield emit(rows)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if found := [against(tuple(r[c] for c in fields), tuple(r[f"o_{c}"] for c in fields), r["side"] == 0) for r in batch.to_pylist() if r["host"] == r["o_host"]]:
                yield emit(found)

    order = ["host", "path", "page_id", "digest"]
    ranged = parsed.where("host is not null").select(*fields, "page_id", "digest").repartitionByRange(*order).sortWithinPartitions(*order)
    found = store(ranged.select(*fields, F.spark_partition_id().alias("part")).mapInArrow(run, out_schema), "html-pairs")
    # two rows a task meet their neighbours in the tasks before and after
    ends, along = found.where("part is not null"), Window.orderBy("part", "side")
    other = F.struct(*fields)
    ends = ends.withColumn("o", F.when(F.col("side") == 0, F.lag(other).over(along)).otherwise(F.lead(other).over(along))).where("o is not null")
    ends = ends.select("side", *fields, *[F.col(f"o.{c}").alias(f"o_{c}") for c in fields])
    kept = ["rid", "near", "host", "at", "hash", "kind"]
    every = found.where("part is null").select(*kept).union(ends.mapInArrow(edges, out_schema).select(*kept))
    best = every.groupBy("rid").agg(F.max_by(F.struct("host", "at", "hash", "kind"), "near").alias("b"))
    lines = best.select("rid", "b.host", "b.hash", "b.kind", F.posexplode("b.at").alias("i", "at"))
    return lines.select("rid", "host", F.get("hash", F.col("i")).alias("hash"), F.conv(F.hex(F.expr("substring(kind, i + 1, 1)")), 16, 10).cast("int").alias("kind"), "at")


def template(parsed: DataFrame, shared: DataFrame) -> DataFrame:
    """rid, cut: places of the shared lines that are the host's template."""
    each = parsed.where("host is not null").groupBy("host", "digest").agg(F.first("hashes").alias("hashes"))
    # pages of equal lines count once
    often = each.select("host", F.explode(F.array_distinct("hashes")).alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("pages")).where("pages > 1")
    hosts = each.groupBy("host").agg(F.count("*").alias("all"))
    seen = often.join(hosts, "host").where(F.col("pages") >= F.least(F.lit(3), F.col("all")))
    cut = shared.join(seen, ["host", "hash"]).where((F.col("kind") != NORMAL) | (F.col("pages") >= F.greatest(F.lit(3), F.col("all") / 2)))
    return cut.groupBy("rid").agg(F.collect_list("at").alias("cut"))


def extract(pages: DataFrame, differencing: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    Character references are decoded, white space within a block is one space, blocks are trimmed
    and joined by a line feed. Null html is empty and gives an empty text; pages without a host, or
    alone on it, are told by their markup only; repeated rows are pages of their own; extra columns
    are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for kinds, packed, cut in zip(*(batch.column(c).to_pylist() for c in ("kinds", "packed", "cut")), strict=True):
                lines = list(zip(zlib.decompress(packed).decode().split(SEPARATOR), kinds)) if kinds else []
                texts.append("\n".join(main_lines(lines, set(cut or ()))))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    parsed = parse(pages)
    cut = store(template(parsed, differences(parsed)), "html-template") if differencing else None  # its size then tells how to join
    none = F.lit(None).cast("array<int>").alias("cut")
    rows = parsed.select("rid", "page_id", "url", "kinds", "packed")
    rows = rows.join(cut, "rid", "left") if cut is not None else rows.select("*", none)
    return rows.select("page_id", "url", "kinds", "packed", "cut").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")
