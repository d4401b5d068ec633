"""Main text of web pages by nearest-URL page differencing.

A page is cut into lines, one a block of text, in page order.  Within each host pages are sorted by
path; a page is compared with the one of the longest common path that is no copy of it.  Both pages' lines are
aligned by longest common subsequence, and lines of the common one are what the site repeats: they
are deleted, within an article or main element too.  Markup decides first where it says something:
text in menus, footers, forms, adverts, comments and the like goes, and only
the other lines are compared.  Pages are copies where one shares over half of its lines' text with the
other; if all others are copies, nothing is deleted.

The sorted pages are dealt out by ranges, so a large host is spread over tasks; pages at the ends of
ranges (two a task) meet those of other ranges in one task of their own; pages between meet their own range's.

Defined cases: null html gives an empty text; a null url has an empty host and path; pages of one
host with the same lines count as one page; of two equally near pages the one before counts; very long and
broken pages are scanned whole, in time that grows with their length (tags never closed are text; a tag whose
quotes don't pair up ends at the next >); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import row_groups, saved, table
from tidewatch.llm.urls import parsed

_PARTS = re.compile(
    r"""<!--.*?(?:-->|(?P<open>)\Z)
    |<(?P<raw>script|style|noscript|template|svg|textarea|select|iframe|title|object|math)\b[^>]*>(?:.*?</(?P=raw)\s*>|.*(?P<rest>)\Z)
    |<(?P<close>/?)(?P<tag>[a-z][\w:-]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">])*+)>
    |(?P<torn></?[a-z][^>]*>)|<[!?][^>]*>
    |[^<]+|<""",
    re.X | re.S | re.I,
)
#: Where quotes don't pair up: a tag ends at the next >.
_PLAIN = re.compile(
    r"""<!--.*?(?:-->|(?P<open>)\Z)
    |<(?P<raw>script|style|noscript|template|svg|textarea|select|iframe|title|object|math)\b[^>]*>(?:.*?</(?P=raw)\s*>|.*(?P<rest>)\Z)
    |<(?P<close>/?)(?P<tag>[a-z][\w:-]*)(?P<attrs>[^>]*)>
    |<[!?][^>]*>
    |[^<]+|<""",
    re.X | re.S | re.I,
)
_TEXT = re.compile(r"<!--.*\Z|[^<]+|<", re.S)
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_INLINE = frozenset(("a", "button", "head", "ins", "span"))
_SKIPPED = frozenset("nav footer aside form head button dialog menu".split())
_MAIN = frozenset(("article", "main"))
_NAMED = frozenset("ad ads advert adverts advertisement banner sidebar menu nav navbar navigation footer cookie cookies consent gdpr notice alert comment comments disqus respond replies share sharing social related recommended promo promoted sponsor sponsored newsletter subscribe popup modal breadcrumb breadcrumbs widget login signup toolbar pagination pager skip".split())
_OUTSIDE = frozenset("header masthead topbar".split())
_ATTRS = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def _odd(tag: str, attrs: str, inside: bool) -> bool:
    """Does an element hold something else than main text."""
    if tag in _SKIPPED or (tag == "header" and not inside):
        return True
    for name, a, b, c in _ATTRS.findall(attrs) if attrs else ():
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if name in ("class", "id", "role"):
            words = set(re.split(r"[^a-z0-9]+", value))
            if words & _NAMED or (not inside and words & _OUTSIDE) or value in ("contentinfo", "complementary", "search"):
                return True
    return False


def _parts(page: str) -> Iterator[re.Match]:
    """Text, tags and the like in order, in time that grows with the page.

    Behind the last > there is text alone (or a raw element), so no search for one fails twice; once the
    quotes of a tag turn out not to pair up, quotes are passed over in the rest of the page.
    """
    last = page.rfind(">") + 1
    at, m = last, None
    for m in _PARTS.finditer(page, 0, last):
        if m["torn"]:
            at = m.start()
            break
        yield m
    if at < last:
        for m in _PLAIN.finditer(page, at, last):
            yield m
    if m is None or (m["open"] is None and m["rest"] is None):
        yield from _TEXT.finditer(page, last)


def page_lines(page: str) -> list[tuple[str, bool, bool]]:
    """(text, dropped by markup, within an article or main element) for each block, in page order."""
    out: list[tuple[str, bool, bool]] = []
    buffer: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []  # open elements: tag, dropped, article or main, inline ones up to here
    count: dict[str, int] = {}  # open elements by tag
    drops: list[int] = []  # places of dropped elements
    dropped = inside = 0

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append((text, dropped > 0, inside > 0))

    def close(n: int) -> None:
        nonlocal dropped, inside
        for tag, drop, main, _ in stack[n:]:
            dropped -= drop
            inside -= main
            count[tag] -= 1
            if drop:
                drops.pop()
        del stack[n:]

    for m in _parts(page):
        if m.re is _TEXT or m["tag"] is None:
            part = m[0]
            if part[0] != "<" or part == "<":
                buffer.append(part)
            continue
        tag, attrs = m["tag"].lower(), m["attrs"]
        block = tag in _BLOCKS
        if tag == "br":
            buffer.append(" ")
        if not block and tag not in _INLINE:
            continue
        if m["close"]:
            at = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag) if count.get(tag) else -1
            if block or (at >= 0 and stack[at][1]):
                flush()
            if at >= 0:
                close(at)
            continue
        drop = _odd(tag, attrs, inside > 0)
        main = tag in _MAIN and not drop
        if block or drop:
            flush()
        if block:  # a paragraph ends where a block starts, an item where the next one does
            k = len(stack) - (stack[-1][3] if stack else 0)
            if k and (stack[k - 1][0] == "p" or stack[k - 1][0] == tag == "li"):
                close(k - 1)
        if main and dropped:  # something dropped was never closed
            close(drops[0])
        if tag != "hr" and not attrs.endswith("/"):
            if drop:
                drops.append(len(stack))
            stack.append((tag, drop, main, (stack[-1][3] if stack else 0) + 1 if tag in _INLINE else 0))
            count[tag] = count.get(tag, 0) + 1
            dropped += drop
            inside += main
    flush()
    return out


def main_text(lines: list[tuple[str, bool, bool]], shared: set[int] | frozenset | None = None) -> str:
    """Lines that markup doesn't drop and that are not shared; by markup alone (shared is None) those of the article if there is one."""
    article = shared is None and any(a and not d for _, d, a in lines)
    return "\n\n".join(t for i, (t, d, a) in enumerate(lines) if not d and (a if article else i not in (shared or ())))


def common_lines(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions in a of a longest common subsequence with b; a row of the table at a time."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    mid_a, mid_b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    # lines that the other page lacks can't be common
    at, mid_b = np.flatnonzero(np.isin(mid_a, mid_b)), mid_b[np.isin(mid_b, mid_a)]
    mid_a = mid_a[at]
    rows = np.zeros((len(mid_a) + 1, len(mid_b) + 1), np.int32)
    for i in range(len(mid_a)):
        rows[i + 1, 1:] = np.maximum.accumulate(np.maximum(rows[i, 1:], (rows[i, :-1] + 1) * (mid_b == mid_a[i])))
    out, i, j = [], len(mid_a), len(mid_b)
    while i and j:
        if rows[i, j] == rows[i - 1, j]:
            i -= 1
        elif rows[i, j] == rows[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(lo + int(at[i]))
    return [*range(lo), *out[::-1], *range(len(a) - hi, len(a))]


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _deleted(own: tuple, other: tuple) -> list[int] | None:
    """Of the lines that markup leaves undecided, those shared with another page; None if the two are copies."""
    (hashes, sizes, _), mine, theirs = own, np.flatnonzero(own[2]), np.flatnonzero(other[2])
    both = mine[np.array(common_lines(hashes[mine], other[0][theirs]), np.int64)]
    return None if 2 * sizes[both].sum() > sizes[mine].sum() else both.tolist()


def _compared(pages: list[tuple]) -> Iterator[tuple[list[int], int]]:
    """For pages (g, host, path, lines) by host and path: lines to delete, and the length of the path in common with the page that says so, or -1.

    Copies of a page's copies are passed over, so that time doesn't grow with the square of their number.
    """
    to_left, to_right = {}, {}
    for i, (_, host, path, own) in enumerate(pages):
        x, y = i - 1, max(i + 1, to_right.get(i - 1, 0))
        found, best = [], -1
        while True:
            near = {j: _prefix(pages[j][2] or "", path or "") for j in (x, y) if 0 <= j < len(pages) and pages[j][1] == host}
            if not near:
                break
            j = max(near, key=near.get)
            shared = _deleted(own, pages[j][3])
            if shared is not None:
                found, best = shared, near[j]
                break
            x, y = (to_left[j], y) if j == x else (x, y + 1)
        to_left[i], to_right[i] = x, y
        yield found, best


_LINES = "k long, host string, path string, hashes array<long>, sizes array<int>, undecided array<boolean>"


def _key() -> Column:
    """Names a page by its url and html, null apart from empty."""
    return F.xxhash64(F.col("url").isNull(), F.coalesce("url", F.lit("")), F.col("html").isNull(), F.coalesce("html", F.lit("")))


def line_signatures(pages: DataFrame) -> DataFrame:
    """k (a hash of url and html), host, path and for each line its hash, length and whether markup leaves it undecided."""
    import xxhash

    host, path = parsed(F.col("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages_ = b.column(3).to_pylist()
            hashes, sizes, undecided = [], [], []
            for p in pages_:
                lines = page_lines(p or "")
                hashes.append([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - 2**63 for t, _, _ in lines])
                sizes.append([len(t) for t, _, _ in lines])
                undecided.append([not d for _, d, _ in lines])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(undecided, pa.list_(pa.bool_()))], ["k", "host", "path", "hashes", "sizes", "undecided"])

    return pages.select(_key().alias("k"), host.alias("host"), path.alias("path"), "html").mapInArrow(run, _LINES)


def shared_lines(signatures: DataFrame) -> DataFrame:
    """k, shared: positions of the lines to delete, for pages that have any."""
    spark = signatures.sparkSession
    signatures = saved(signatures.withColumn("g", F.xxhash64("host", "hashes")))
    # one page for all with the same lines
    groups = signatures.groupBy("g").agg(F.min(F.struct("path", "k")).alias("first"), F.min(F.struct("host", "hashes", "sizes", "undecided")).alias("own"))
    groups = groups.select("g", "own.host", F.col("first.path").alias("path"), "own.hashes", "own.sizes", "own.undecided")
    placed = groups.repartitionByRange("host", "path", "g").sortWithinPartitions("host", "path", "g")
    schema = "g long, shared array<int>, part int, edge int, host string, path string, hashes array<long>, sizes array<int>, undecided array<boolean>, best int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        pages = [(r["g"], r["host"], r["path"], (np.array(r["hashes"], np.int64), np.array(r["sizes"], np.int64), np.array(r["undecided"], bool))) for b in batches for r in b.to_pylist()]
        types = [pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.int32()]
        rows = []
        for i, ((g, host, path, own), (shared, best)) in enumerate(zip(pages, _compared(pages), strict=True)):
            edge = 1 * (i == 0) + 2 * (i == len(pages) - 1)
            kept = (host, path, *(x.tolist() for x in own)) if edge else (None,) * 5
            rows.append((g, shared, part, edge, *kept, best))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    found = saved(placed.mapInArrow(run, schema))
    # Two rows a task at most: pages across the ends of ranges, outwards up to the first that is no copy.
    edges = found.where("edge > 0").select(*found.columns).repartition(1).sortWithinPartitions("part", F.col("edge") == 2)
    over = edges.mapInArrow(_across, "g long, instead array<int>")
    by_group = found.select("g", "shared").join(over, "g", "left").select("g", F.coalesce("instead", "shared").alias("shared")).where(F.size("shared") > 0)
    return signatures.select("k", "g").join(by_group, "g").select("k", "shared").groupBy("k").agg(F.min("shared").alias("shared"))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the first and last pages of ranges, in order: lines to delete, where a page of another range is nearer than the own range's."""
    edges = [r for b in batches for r in b.to_pylist()]
    lines = [tuple(np.array(r[x], y) for x, y in (("hashes", np.int64), ("sizes", np.int64), ("undecided", bool))) for r in edges]
    better: dict[int, tuple[int, list[int]]] = {}
    for i, x in enumerate(edges):
        for step, side in ((-1, 1), (1, 2)):
            j = i + step
            while x["edge"] & side and 0 <= j < len(edges) and edges[j]["host"] == x["host"]:
                near = _prefix(x["path"] or "", edges[j]["path"] or "")
                if near <= max(x["best"], better.get(x["g"], (-1,))[0]):
                    break
                shared = _deleted(lines[i], lines[j])
                if shared is not None:
                    better[x["g"]] = (near, shared)
                    break
                j += step
    yield pa.RecordBatch.from_arrays([pa.array(list(better), pa.int64()), pa.array([s for _, s in better.values()], pa.list_(pa.int32()))], ["g", "instead"])


#: Pages with deleted lines up to which their positions are broadcast; beyond, pages are joined by shuffles.
BROADCAST_PAGES = 200_000


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    shared = saved(shared_lines(line_signatures(pages)))
    few = shared.agg(F.coalesce(F.sum(F.size("shared") + 4), F.lit(0))).first()[0] <= 4 * BROADCAST_PAGES
    keyed = pages.withColumn("k", _key()).join(F.broadcast(shared) if few else shared, "k", "left").select("page_id", "url", "html", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2).to_pylist()
            for lo, hi in row_groups(len(p or "") for p in raw):
                texts = [main_text(page_lines(p or ""), set(s or ())) for p, s in zip(raw[lo:hi], b.column(3).slice(lo, hi - lo).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return keyed.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
