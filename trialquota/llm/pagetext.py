"""Main text of web pages by differencing pages with near URLs.

A page is cut into blocks of text.  Markup decides what it can: menus, footers,
asides, forms, adverts, notices and comments go, and text inside an article
element stays.  For what is left, pages of one host are ordered by URL path;
each page is paired with the neighbour whose path shares the longer beginning,
their blocks are aligned by longest common subsequence, and blocks outside an
article that both pages hold are deleted.  A page with an article keeps nothing
outside of it.

Defined cases: a null or empty html gives an empty text; a null url counts as
empty; a host with one page has no neighbour and loses nothing by differencing;
rows equal in id, url and html share one decision and each give a row; broken
markup is read up to where it breaks; columns other than those named are
ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from trialquota.llm.common import stage
from trialquota.operators.ranking import rank_rows

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z)""", re.DOTALL
)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
DROPPED = frozenset(
    "aside audio button canvas datalist dialog footer form head map menu nav noscript object option picture search select svg "
    "template video".split()
)
#: Words of class, id and role that mark what isn't the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent "
    "contentinfo cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination "
    "popup promo promoted promotion related reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
COMMENTS = frozenset("ad ads advert comment comments commentlist reply respond sponsored".split())
HEADERS = frozenset(("header", "banner", "masthead"))
BOILERPLATE, ARTICLE, OPEN = 0, 1, 2
CELL = 128


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, place) of the blocks of a page; place is BOILERPLATE, ARTICLE or OPEN."""
    found: list[tuple[str, int]] = []
    pieces: list[str] = []
    stack: list[tuple[str, int]] = []
    place, at, page = OPEN, 0, page or ""

    def end_block() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                found.append((text, place))

    def close(name: str) -> None:
        nonlocal place
        while stack:
            tag, before = stack.pop()
            place = before
            if tag == name:
                return

    while match := TAG.search(page, at):
        if match.start() > at:
            pieces.append(page[at : match.start()])
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            end_block()
        elif name == "br":
            pieces.append(" ")
        if match[1]:
            if any(tag == name for tag, _ in reversed(stack)):
                end_place = place
                if name in BLOCK or end_place != next(before for tag, before in reversed(stack) if tag == name):
                    end_block()
                close(name)
            continue
        if name in RAW:
            ending = re.compile(f"</{name}", re.IGNORECASE).search(page, at)
            at = ending.start() if ending else len(page)
            continue
        if name in VOID:
            continue
        if name == "p" and any(tag == "p" for tag, _ in stack):
            # A paragraph ends the one before, unless a block was opened inside it.
            inner = [tag for tag, _ in stack]
            since = inner[len(inner) - inner[::-1].index("p") :]
            if not any(tag in BLOCK for tag in since):
                close("p")
        was = place
        place = placed(name, match[3], place)
        if place != was:
            here, place = place, was
            end_block()
            place = here
        if not match[3].endswith("/") or name in BLOCK:
            stack.append((name, was))
    pieces.append(page[at:])
    end_block()
    return found


def placed(name: str, attributes: str, place: int) -> int:
    """Place of what an element holds."""
    if place == BOILERPLATE or name in DROPPED:
        return BOILERPLATE
    marks: set[str] = set()
    if attributes and name not in ("html", "body"):
        for key, value in NAMES.findall(attributes):
            if key.lower() == "hidden":
                return BOILERPLATE
            marks.update(WORDS.findall(value.lower()))
    if name in ("article", "main"):
        return BOILERPLATE if marks & COMMENTS else ARTICLE
    if marks & (MARKS - HEADERS):
        return BOILERPLATE
    if place != ARTICLE and (name == "header" or marks & HEADERS):
        return BOILERPLATE
    return place


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    n, m, first = len(a), len(b), 0
    while first < min(n, m) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(n, m) - first and a[n - 1 - last] == b[m - 1 - last]:
        last += 1
    spots: dict[int, list[int]] = {}
    for j in range(m - last - 1, first - 1, -1):
        spots.setdefault(b[j], []).append(j)
    # Patience over matching pairs: ends[k] is the least place in b that ends a common run of k + 1 lines.
    ends: list[int] = []
    links: list[tuple[int, tuple | None]] = []
    for i in range(first, n - last):
        for j in spots.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(first), *reversed(middle), *range(n - last, n)]


def common_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


KEY = ["page_id", "url", "k"]


def keyed(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    content = F.coalesce(F.col(html), F.lit(""))
    return pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.xxhash64(content).alias("k"), content.alias("html")
    )


def page_lines(pages: DataFrame) -> DataFrame:
    """KEY with host, path, hashes of the blocks, and the blocks that differencing may delete."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, loose = [], []
            for page in batch.column("html").to_pylist():
                found = blocks(page)
                article = any(place == ARTICLE for _, place in found)
                lines.append([xxhash.xxh3_64_intdigest(text) - (1 << 63) for text, _ in found])
                loose.append([] if article else [i for i, (_, place) in enumerate(found) if place == OPEN])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in KEY], pa.array(lines, pa.list_(pa.int64())), pa.array(loose, pa.list_(pa.int32()))],
                names=[*KEY, "lines", "loose"],
            )

    parsed = pages.mapInArrow(parse, "page_id long, url string, k long, lines array<long>, loose array<int>")
    address = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#]*)([^?#]*)", 2)
    return parsed.withColumns({"host": F.lower(address), "path": path})


DELETED = "page_id long, url string, k long, deleted array<int>"


def paired(group: pd.DataFrame) -> pd.DataFrame:
    """Blocks that each page of a cell shares with its nearest neighbour."""
    group = group.sort_values("rank")
    rows, out = group.to_dict("records"), []
    for i, row in enumerate(rows):
        if not row["own"] or not len(row["loose"]):
            continue
        near = [r for r in rows[max(0, i - 1) : i] + rows[i + 1 : i + 2] if r["host"] == row["host"]]
        if not near:
            continue
        partner = max(near, key=lambda r: (common_start(r["path"], row["path"]), -r["rank"]))
        shared = set(shared_lines(list(row["lines"]), list(partner["lines"])))
        deleted = [int(p) for p in row["loose"] if p in shared]
        if deleted:
            out.append((row["page_id"], row["url"], row["k"], deleted))
    return pd.DataFrame(out, columns=[*KEY, "deleted"])


def deleted_blocks(pages: DataFrame) -> DataFrame:
    """KEY and positions of the blocks to delete, for pages that lose any by differencing.

    Pages get an exact rank by host and path, and runs of CELL ranks are handled
    together.  The first and last page of a cell also go to the cell beside it,
    so every page meets both of its neighbours.
    """
    lines = page_lines(pages).groupBy(*KEY).agg(*[F.first(c).alias(c) for c in ("lines", "loose", "host", "path")])
    ranked = rank_rows(lines, (), [F.col(c) for c in ("host", "path", "url", "page_id", "k")], "pages").rows
    rank = F.col("rank") - 1
    cell = F.expr(f"(rank - 1) DIV {CELL}")
    beside = F.when(rank % CELL == 0, cell - 1).when(rank % CELL == CELL - 1, cell + 1)
    cells = ranked.withColumn("cells", F.array_compact(F.array(F.struct(cell.alias("cell"), F.lit(True).alias("own")), F.when(
        beside.isNotNull(), F.struct(beside.alias("cell"), F.lit(False).alias("own"))))))
    spread = cells.select(*KEY, "host", "path", "lines", "loose", "rank", F.inline("cells"))
    return stage(spread.groupBy("cell").applyInPandas(paired, DELETED), "deleted-blocks").for_broadcast()


def main_text(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars): blocks of the article in page order, joined by an empty line."""
    rows = keyed(pages, page_id, url, html)
    deleted = deleted_blocks(rows).toDF(*[f"_{c}" for c in KEY], "deleted")
    match = F.lit(True)
    for c in KEY:
        match = match & rows[c].eqNullSafe(F.col(f"_{c}"))
    joined = rows.join(deleted, match, "left").select("page_id", "url", "html", "deleted")

    def join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, gone in zip(batch.column("html").to_pylist(), batch.column("deleted").to_pylist(), strict=True):
                found, gone = blocks(page), set(gone or ())
                wanted = ARTICLE if any(place == ARTICLE for _, place in found) else OPEN
                texts.append("\n\n".join(text for i, (text, place) in enumerate(found) if place == wanted and i not in gone))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    texts = joined.mapInArrow(join_blocks, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
