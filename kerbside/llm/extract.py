"""Main-text extraction with nearest-URL page differencing.

A page becomes text lines, one for each block, with what its markup says of them: chrome (menus, headers, footers,
sidebars, notices, adverts, forms, comments), article, or nothing; scripts and the like have no lines. Pages of a host are put
in the order of their URL paths, and each is paired with the ``NEAR`` pages on either side of it, those with the longest common
path first. The lines of the two are aligned by their longest common subsequence, and shared lines are deleted; the next page is
aligned with what is left. Lines of an ``article`` or ``main`` element are protected from that: a site repeats its chrome,
but also whole articles. What no near page shares and markup calls chrome, goes by its markup. ``n_differenced`` and ``n_marked`` count
the lines that either means took from a page.

The pages are dealt to parts by ranges of (host, path, page_id), so that a host of any size is spread over tasks. The
limits of the ranges come from a sample of the keys, the first and last NEAR keys of each part from all keys; both read no
html. Pages at the ends of a part go along to the parts beside it as neighbours, so that the texts do not depend on
the parts. A task reads its part in order and holds NEAR keys on either side.

Defined cases: null html is empty; a null URL is a host of its own; no text is the empty string; repeated rows give
one row each and are not each other's neighbours; versions of a page (equal host, path and page_id) have the same
neighbours: the last version of each key before, the first version of each key after, and none of the same page_id; of
neighbours equally near by path, those before come first, and of them the closer one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import SLICE_BYTES, slices

#: Fixed lists of HTML: elements that end a block; elements without content that is text; elements without an end.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td"
    " tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math canvas object audio video select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav menu aside footer form head dialog button search".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar alert status".split())
_CHROME_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertise(?:ment)?s?|adsense|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|alerts?"
    r"|newsletter|subscri(?:be|ption)|signup|paywall|popup|modal|overlay|nav|navbar|navigation|menus?|breadcrumbs?|sidebar|side|widgets?"
    r"|related|recommended|share|sharing|social|footer|masthead|topbar|toolbar|pagination|pager|comments?|commentlist|disqus|repl(?:y|ies)"
    r"|respond|discussion|skip|sitemap|copyright|legal|login|search)(?:$|[\s_-])",
    re.I,
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(>|$)", re.S
)


def _is_chrome(tag: str, attributes: str, inside: bool) -> bool:
    if tag in CHROME or tag == "header" and not inside:
        return True
    if attributes and tag not in ("body", "html"):
        for name, *values in _NAMED.findall(attributes):
            name, value = name.lower(), next(filter(None, values), "")
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if value.lower() in CHROME_ROLES if name == "role" else name in ("class", "id") and _CHROME_NAME.search(value):
                return True
    return False


def marked(page: str) -> list[tuple[str, bool, bool]]:
    """The lines, whether they are an article's, and whether markup shows them to be chrome."""
    out: list[tuple[str, bool, bool]] = []
    held: list[str] = []
    open_: list[str] = []  # elements inside the outermost chrome element, or none
    article = at = 0

    def end() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((text, article > 0, bool(open_)))
            held.clear()

    while at < len(page):
        found = _TOKEN.search(page, at)
        stop = found.start() if found else len(page)
        if stop > at:
            held.append(page[at:stop])
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        closes = bool(found[1])
        if tag in RAW and not closes:
            if tag in BLOCKS:
                end()
            close = re.compile(rf"</{tag}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in BLOCKS:
            end()
        elif tag == "br":
            held.append(" ")
        if open_:
            if closes and tag in open_:
                end()
                while open_.pop() != tag:
                    pass
            elif not closes and tag == open_[0]:
                open_.append(tag)  # the same element inside the one that is chrome
            continue
        if tag in ("article", "main"):
            if not closes and article and _is_chrome(tag, found[3], True):
                open_.append(tag)
            else:
                article = max(0, article + (-1 if closes else 1))
        elif not closes and tag not in VOID and _is_chrome(tag, found[3], article > 0):
            end()
            open_.append(tag)
    end()
    return out


def lines(page: str) -> list[tuple[str, bool]]:
    """The lines that markup does not show to be chrome, and whether they are an article's."""
    return [(text, article) for text, article, chrome in marked(page) if not chrome]


def shared(a: list[int], b: list[int]) -> set[int]:
    """Places of ``a`` in a longest common subsequence with ``b``, by bit-parallel rows.

    Only each k-th row is kept on the way down, k being the root of their number; the way back makes the rows
    between two kept ones anew. So memory is len(a) * sqrt(len(b)) bits."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1

    def step(row: int, y: int) -> int:
        u = row & at.get(y, 0)
        return (row + u | row - u) & full

    every = max(1, math.isqrt(len(b)))
    kept, row = [full], full
    for j, y in enumerate(b, 1):
        row = step(row, y)
        if j % every == 0:
            kept.append(row)
    out, i, j = set(), len(a), len(b)
    while i and j:
        base = (j - 1) // every * every
        rows = [kept[base // every]]
        for y in b[base:j]:
            rows.append(step(rows[-1], y))
        while i and j > base:
            if rows[j - base] >> (i - 1) & 1:
                i -= 1
            elif not rows[j - base - 1] >> (i - 1) & 1:
                j -= 1
            else:
                out.add(i - 1)
                i, j = i - 1, j - 1
    return out


def _near(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Page:
    """A page in its place among those of its host."""

    __slots__ = ("all", "hashes", "host", "lines", "page_id", "path", "url")

    def __init__(self, page_id: int, url: str, html_: str | None, host: str, path: str) -> None:
        self.page_id, self.url, self.host, self.path = page_id, url, host, path
        self.lines = marked(html_ or "")
        self.hashes = [xxhash.xxh3_64_intdigest(x[0]) for x in self.lines]
        self.all = frozenset(self.hashes)


#: Pages on either side of one that it is compared with.
NEAR = 8


def difference(now: Page, near: list[Page]) -> tuple[str, int, int]:
    """The text of a page, how many lines its neighbours took and how many markup alone. ``near``: those before, the closest
    first, then those after, the closest first."""
    own = [x for x in near if x.host == now.host and x.page_id != now.page_id]
    # sorting keeps the order of neighbours that are as near by path
    own.sort(key=lambda x: -_near(x.path, now.path))
    # only lines outside articles are aligned, so that a copied article takes no match from them
    left = [i for i, x in enumerate(now.lines) if not x[1] or x[2]]
    taken = len(left)
    for other in own:
        if any(now.hashes[i] in other.all for i in left):
            found = shared([now.hashes[i] for i in left], other.hashes)
            left = [i for k, i in enumerate(left) if k not in found]
    taken -= len(left)
    kept = set(left)
    stay = [text for i, (text, article, chrome) in enumerate(now.lines) if not chrome and (article or i in kept)]
    return "\n".join(stay), taken, sum(now.lines[i][2] for i in left)


def main_text(now: Page, before: Page | None, after: Page | None) -> str:
    """The text of a page between two others."""
    return difference(now, [x for x in (before, after) if x is not None])[0]


KEY = ("host", "path", "page_id")
COLUMNS = ("page_id", "url", "html", "host", "path")
#: Sampled keys for each part; the limits between parts are chosen from these.
SAMPLED = 64


class _Group:
    """The versions of one page: (page, how many equal rows, is it a guest?)."""

    __slots__ = ("key", "rows")

    def __init__(self, key: tuple) -> None:
        self.key, self.rows = key, []


OUT = (("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_differenced", pa.int64()), ("n_marked", pa.int64()))


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a part's own pages, as OUT has them. The rows come in order; guests belong to a part beside it."""
    out: list[tuple] = []
    size = 0
    before: deque[Page] = deque(maxlen=NEAR)  # the last version of each key
    ahead: deque[_Group] = deque()

    def close() -> None:
        group = ahead.popleft()
        near = [*reversed(before), *(g.rows[0][0] for g in islice(ahead, NEAR))]
        for page, n, guest in group.rows:
            if not guest:
                out.extend([(page.page_id, page.url, *difference(page, near))] * n)
        before.append(group.rows[-1][0])

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * len(OUT)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, OUT)], [name for name, _ in OUT])

    last = None
    for s in slices(batches, "html"):
        for *row, guest in zip(*(s.column(c).to_pylist() for c in (*COLUMNS, "guest"))):
            if row == last:
                ahead[-1].rows[-1][1] += 1
                continue
            last, key = row, (row[3], row[4], row[0])
            if not ahead or ahead[-1].key != key:
                if len(ahead) > NEAR:
                    close()
                ahead.append(_Group(key))
            ahead[-1].rows.append([Page(*row), 1, guest])
            size += len(row[2] or "")
            if size > SLICE_BYTES or len(out) >= 5000:
                yield batch()
                out.clear()
                size = 0
    while ahead:
        close()
    yield batch()


def _part(key: Column, limits: list[tuple]) -> Column:
    """How many of the ascending ``limits`` are not beyond ``key``, by halving."""
    if not limits:
        return F.lit(0)
    held = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, c, t in zip(x, KEY, ("string", "string", "long"))]) for x in limits])
    bounds = F.struct(F.lit(0).alias("lo"), F.lit(len(limits)).alias("hi"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        up = F.get(held, middle) <= key
        closed = state["lo"] >= state["hi"]
        return F.struct(
            F.when(~closed & up, middle + 1).otherwise(state["lo"]).alias("lo"), F.when(closed | up, state["hi"]).otherwise(middle).alias("hi")
        )

    steps = len(limits).bit_length()
    return F.aggregate(F.array(*[F.lit(k) for k in range(steps)]), bounds, halve, lambda s: s["lo"])


def _order(key: tuple) -> tuple:
    host, path, page = key
    return host.encode(), path.encode(), page is not None, page or 0


def dealt(pages: DataFrame, parts: int) -> DataFrame:
    """The pages by part, in order; ``guest``: here only as the neighbour of a page of this part."""
    spark = pages.sparkSession
    key = F.struct(*KEY)
    keys = pages.select(key.alias("key"))
    total = keys.count()
    one_in = max(1, total // (parts * SAMPLED))
    # equal keys are sampled once, so about SAMPLED keys a part come to the driver
    found = keys.where(F.pmod(F.xxhash64("key"), F.lit(one_in)) == 0).distinct().collect()
    sample = sorted((tuple(r["key"]) for r in found), key=_order)
    limits = sorted({sample[k * len(sample) // parts] for k in range(1, parts)} if sample else set(), key=_order)
    own = pages.withColumn("part", _part(key, limits))
    # at most 2 * NEAR keys a part come to the driver
    each = own.select("part", key.alias("key")).distinct()
    by = Window.partitionBy("part")
    each = each.withColumns({"k": F.row_number().over(by.orderBy("key")), "n": F.count(F.lit(1)).over(by)})
    ends = each.where(f"k <= {NEAR} or n - k < {NEAR}").collect()
    guests = _guests(ends)
    at = "host string, path string, page_id long, tos array<int>"
    plan = spark.createDataFrame([(*k, sorted(v)) for k, v in guests.items()], at).select(*[F.col(c).alias(f"g_{c}") for c in KEY], "tos")
    same = (F.col("host") == F.col("g_host")) & (F.col("path") == F.col("g_path")) & F.col("page_id").eqNullSafe(F.col("g_page_id"))
    met = own.join(F.broadcast(plan), same, "left")
    placed = met.select(*COLUMNS, "part", F.explode(F.concat(F.array("part"), F.coalesce("tos", F.array().cast("array<int>")))).alias("to"))
    placed = placed.select(*COLUMNS, "to", (F.col("to") != F.col("part")).alias("guest"))
    return placed.repartitionById(parts, F.col("to")).sortWithinPartitions("to", *KEY, "url", "html")


def _guests(ends: list) -> dict[tuple, set[int]]:
    """The parts to which a key at the end of a part goes along: those for whose pages it is one of the NEAR keys before or after."""
    first: dict[int, list] = {}
    last: dict[int, list] = {}
    sizes: dict[int, int] = {}
    for r in sorted(ends, key=lambda r: (r["part"], r["k"])):
        sizes[r["part"]] = r["n"]
        if r["k"] <= NEAR:
            first.setdefault(r["part"], []).append(tuple(r["key"]))
        if r["n"] - r["k"] < NEAR:
            last.setdefault(r["part"], []).append(tuple(r["key"]))
    order, out = sorted(sizes), {}
    for k, part in enumerate(order):
        for beside, held in ((order[k - 1 :: -1] if k else [], last), (order[k + 1 :], first)):
            wanted = NEAR
            for other in beside:
                keys = held[other][-wanted:] if held is last else held[other][:wanted]
                for key in keys:
                    out.setdefault(key, set()).add(part)
                wanted -= len(keys)
                if not wanted:
                    break
    return out


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_differenced, n_marked`` of every page."""
    url = F.coalesce(F.col("url"), F.lit(""))
    own = pages.select(
        "page_id", "url", "html",
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^#]*)", 1).alias("path"),
    )
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt(own, parts).mapInArrow(_difference, "page_id long, url string, text string, n_differenced long, n_marked long")
