"""Main text of web pages by nearest-URL page differencing.

Pages of a host are ordered by URL path, and each is paired with the nearest page before and behind it whose text differs
from its own: copies, pages with the same lines but for furniture, say nothing about furniture, so copies next to each
other count as one page.  The text lines of a pair are aligned by longest common subsequence, and lines that a page
shares with a neighbour are deleted: menus, sidebars and footers whether or not the markup says what they are.  Lines
inside the page's own ``article`` or ``main`` element are its content even if a neighbour has them too, and take no part.

Differencing cannot know furniture that changes from page to page (other menu entries, another advert) or that of a host
with a single page.  Of the lines it leaves, those that the markup names as menus, headers, footers, sidebars, notices,
adverts, forms or reader comments go too.  All others are the text.

Only hashes of lines that can go, and a digest of the rest, move between machines.  The order of all pages comes from a
range-partitioned sort of their keys, which gives every run of copies a number; neighbouring runs then meet in a join by
number, so a host with a third of all pages is no hot key.  The text itself is read in place, twice.

Defined results: a null or empty page has no text; pages without a URL have no neighbours; pages with equal id, URL
and html are one page, and each of its rows gets the result; an empty table gives an empty result.  Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.llm._common import bounded_batches, materialize, pieces, quoted
from lexweave.llm.url_filters import host_of, path_of

#: Element names by role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_FURNITURE = frozenset("nav footer aside form dialog menu".split())
_NO_TEXT = frozenset("head noscript template select button svg canvas object audio video".split())
_CONTAINERS = frozenset(["article", "main"])
_BLOCKS = frozenset("address article aside blockquote body br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_STRUCTURE = frozenset("article aside body div dl fieldset footer form header html main nav ol section table td th ul".split())
_TITLES = frozenset("h1 h2 h3 h4 h5 h6 html body article main".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer footnav gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion related "
    "recommended replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: Words beside those names that say where or how, not what.
_PLACES = frozenset(
    "site page main global top bottom left right inner outer primary secondary mobile desktop sticky fixed floating small large list box area block container wrapper wrap section group panel "
    "item items bar row column col links link button buttons icon icons unit slot text title body content user users reader readers visitor post posts article articles story stories news "
    "entry thread form field input bottom middle center hidden close open js el widget area my the our".split()
)

_TAG = re.compile(r"<(?:!--|[!?][^>]*>|/?[a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)


def _named_furniture(name: str, attributes: str, inside: bool) -> bool:
    """Do the attributes say that the element is no content?"""
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in _ROLES):
            return True
        if key in ("class", "id"):
            for own in value.split():
                parts = [x for x in re.split(r"[-_:]+", own) if x and not x.isdigit()]
                # a name says so only if all of it does: a "cookie-notice" is furniture, a "notice-of-appeal" is not
                if not _NAMES.isdisjoint(parts) and (_NAMES | _PLACES).issuperset(parts):
                    if name in _TITLES and "comment" not in parts and "comments" not in parts:
                        continue
                    if inside and (parts[-1] == "header" or _NAMES.intersection(parts) == {"menu"}):
                        continue
                    return True
    return False


def page_lines(page: str) -> list[tuple[str, bool, bool]]:
    """Text blocks in page order: (text, is it inside an article or main element, does the markup name it furniture)."""
    out: list[tuple[str, bool, bool]] = []
    parts: tuple[list[str], list[str]] = ([], [])  # content, furniture
    stack: list[tuple[str, bool, bool]] = []
    stops: list[int] = []  # places in the stack of p, li and structure, which end a search for an open p or li
    opened: dict[str, int] = {}
    skipping = furniture = containers = 0
    at, end = 0, len(page)

    def flush() -> None:
        for named, own in enumerate(parts):
            if own:
                text = " ".join(html_lib.unescape("".join(own)).split())
                if text:
                    out.append((text, containers > 0, named > 0))
                own.clear()

    def pop() -> str:
        nonlocal skipping, furniture, containers
        name, skips, named = stack.pop()
        if stops and stops[-1] == len(stack):
            stops.pop()
        opened[name] -= 1
        skipping -= skips
        furniture -= named
        containers -= name in _CONTAINERS
        return name

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            if not skipping:
                parts[furniture > 0].append(page[at:])
            break
        if m.start() > at and not skipping:
            parts[furniture > 0].append(page[at : m.start()])
        word = m[0]
        if word == "<!--":
            close = page.find("-->", m.end())
            at = end if close < 0 else close + 3
            continue
        if word[1] in "!?":
            at = m.end()
            continue
        rest = _REST.match(page, m.end())
        if rest is None:
            close = page.find(">", m.end())
            stop = end if close < 0 else close + 1
        else:
            stop = rest.end()
        attributes = page[m.end() : stop]
        at = stop
        closing = word[1] == "/"
        name = word[1 + closing :].lower()
        if name in _BLOCKS:
            flush()
        if closing:
            if opened.get(name):
                while pop() != name:
                    pass
            continue
        if name in _RAW:
            close = re.compile(f"</{name}", re.IGNORECASE).search(page, at)
            if close is None:
                break
            gt = page.find(">", close.end())
            at = end if gt < 0 else gt + 1
            continue
        if name in _VOID or attributes.endswith("/>"):
            continue
        if opened.get("p") and name in _BLOCKS or name == "li" and opened.get("li"):
            for i in reversed(stops):
                if stack[i][0] == "p" or stack[i][0] == name == "li":
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in _STRUCTURE:
                    break
        named = name in _FURNITURE or name == "header" and not containers or bool(attributes.strip("/> \t\r\n")) and _named_furniture(name, attributes, containers > 0)
        if name in ("p", "li") or name in _STRUCTURE:
            stops.append(len(stack))
        skips = name in _NO_TEXT
        stack.append((name, skips, named))
        opened[name] = opened.get(name, 0) + 1
        skipping += skips
        furniture += named
        containers += name in _CONTAINERS
    flush()
    return out


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b`` (bit-parallel, rows kept for the way back)."""
    common = set(a) & set(b)
    own = [i for i, x in enumerate(a) if x in common]
    other = [x for x in b if x in common]
    masks: dict[int, int] = {}
    for k, i in enumerate(own):
        masks[a[i]] = masks.get(a[i], 0) | 1 << k
    full = (1 << len(own)) - 1
    rows, v = [], full
    for x in other:
        u = v & masks[x]
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    found, row, col = [], len(rows), len(own)
    while row and col:
        if rows[row - 1] >> (col - 1) & 1:
            col -= 1
        else:
            row -= 1
            if not row or rows[row - 1] >> (col - 1) & 1:
                col -= 1
                found.append(own[col])
    return found[::-1]


def neighbours_lines(lines: list[int], neighbours: list[list[int]]) -> list[int]:
    """Places of the lines that a neighbour shares."""
    return sorted({i for other in neighbours for i in shared_lines(lines, other)})


def can_go(line: tuple[str, bool, bool]) -> bool:
    """Is the line outside the page's own content?"""
    return line[2] or not line[1]


def main_text(lines: list[tuple[str, bool, bool]], gone: list[int]) -> tuple[str, int]:
    """The text without the lines that go (places among those that can), and how many more the markup alone leaves out."""
    left, place, by_markup, out = set(gone), 0, 0, []
    for line in lines:
        if can_go(line):
            place += 1
            if place - 1 in left:
                continue
            if line[2]:
                by_markup += 1
                continue
        out.append(line[0])
    return "\n".join(out), by_markup


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        hashes, digests = [], []
        for page in batch.column(batch.num_columns - 1).to_pylist():
            lines = page_lines(page or "")
            hashes.append([xxhash.xxh3_64_intdigest(x[0]) - (1 << 63) for x in lines if can_go(x)])
            digests.append(xxhash.xxh3_128_digest("\n".join(x[0] for x in lines if not x[2])))
        arrays = [*batch.columns[:-1], pa.array(digests, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "_digest", "_lines"])


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the runs of rows with equal host and digest in a sorted partition, from 0, and marks the first row of each."""
    run, last = -1, None
    for batch in pieces(batches):
        runs, first = [], []
        for key in zip(batch.column("_host").to_pylist(), batch.column("_digest").to_pylist(), strict=True):
            first.append(key != last)
            run += first[-1]
            last = key
            runs.append(run)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, pa.int64()), pa.array(first, pa.bool_())], [*batch.schema.names, "_run", "_first"])


def _difference_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        same = [neighbours_lines(a, [p or [], n or []]) for a, p, n in zip(*(batch.column(x).to_pylist() for x in ("_lines", "_prev", "_next")), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(same, pa.list_(pa.int32()))], ["_pid", "_purl", "_pth", "_gone"])


def numbered_runs(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` in a shared table with ``_rank``, the number 0, 1, 2, ... of a row's run of equal ``_host`` and ``_digest`` in the order of ``order``, and ``_first``: is it the first row of its run."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields)
    placed = materialize(placed.mapInArrow(_run_rows, f"{schema}, _run long, _first boolean"), name)
    # a row for each partition of the sort; its first run may go on from the partition before
    key = F.struct("_host", "_digest")
    ends = placed.where("_first").groupBy("_part").agg((F.max("_run") + 1).alias("_count"), F.min_by(key, "_run").alias("_begin"), F.max_by(key, "_run").alias("_end"))
    by_part = Window.orderBy("_part")
    ends = ends.withColumn("_goes_on", F.coalesce(F.col("_begin") == F.lag("_end").over(by_part), F.lit(False)))
    starts = ends.select("_part", "_goes_on", (F.sum(F.col("_count") - F.col("_goes_on").cast("long")).over(by_part) - F.col("_count")).alias("_start"))
    joined = placed.join(F.broadcast(starts), "_part")
    return joined.withColumn("_first", F.col("_first") & ~(F.col("_goes_on") & (F.col("_run") == 0))).withColumn("_rank", F.col("_start") + F.col("_run")).drop("_part", "_start", "_run", "_goes_on")


#: Deletions are broadcast up to this many pages, about 100 bytes each, and joined by shuffle beyond.
BROADCAST_ROWS = 200_000


def deleted_lines(base: DataFrame, id_type: str) -> DataFrame:
    """``_pid``, ``_purl``, ``_pth`` and ``_gone``, the places of the shared lines among those that can go, of pages that have some."""
    keyed = base.select("_id", "_url", "_th", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"), "_html").where(F.col("_html").isNotNull() & (F.col("_host") != ""))
    hashed = keyed.mapInArrow(_hash_rows, f"_id {id_type}, _url string, _th long, _host string, _path string, _digest binary, _lines array<long>")
    hashed = hashed.dropDuplicates(["_id", "_url", "_th"])
    ranked = materialize(numbered_runs(hashed, ["_host", "_path", "_url", "_id", "_th"], "page-order"), "page-lines")
    runs = ranked.where("_first").select("_rank", "_host", "_lines")
    prev = runs.select(F.col("_host").alias("_h0"), (F.col("_rank") + 1).alias("_r0"), F.col("_lines").alias("_prev"))
    following = runs.select(F.col("_host").alias("_h1"), (F.col("_rank") - 1).alias("_r1"), F.col("_lines").alias("_next"))
    beside = runs.join(prev, (F.col("_rank") == F.col("_r0")) & (F.col("_host") == F.col("_h0")), "left").join(following, (F.col("_rank") == F.col("_r1")) & (F.col("_host") == F.col("_h1")), "left")
    beside = materialize(beside.where("_prev IS NOT NULL OR _next IS NOT NULL").select(F.col("_rank").alias("_of"), "_prev", "_next"), "page-neighbours")
    # a run of copies has one row of neighbours: its pages can be dealt to any number of tasks
    paired = ranked.where(F.size("_lines") > 0).join(beside, F.col("_rank") == F.col("_of"))
    gone = paired.select("_id", "_url", "_th", "_lines", "_prev", "_next").mapInArrow(_difference_rows, f"_pid {id_type}, _purl string, _pth long, _gone array<int>")
    return materialize(gone.where(F.size("_gone") > 0), "deleted-lines")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars``, ``n_deleted`` (lines that differencing deleted) and ``n_markup`` (lines that only the markup left out) of every page."""
    html = F.col(quoted(html_col))
    base = bounded_batches(pages).select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(url_col)).alias("_url"), F.xxhash64(html).alias("_th"), html.alias("_html"))
    id_type = base.schema["_id"].dataType.simpleString()
    gone = deleted_lines(base, id_type)
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    same = F.col("_id").eqNullSafe(F.col("_pid")) & F.col("_url").eqNullSafe(F.col("_purl")) & (F.col("_th") == F.col("_pth"))
    joined = base.join(gone, same, "left").select("_id", "_url", "_html", "_gone")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            places = batch.column(3).to_pylist()
            found = [main_text(page_lines(h or ""), g or []) for h, g in zip(batch.column(2).to_pylist(), places, strict=True)]
            arrays = [batch.column(0), batch.column(1), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([len(g or []) for g in places], pa.int32()), pa.array([n for _, n in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars", "n_deleted", "n_markup"])

    return joined.mapInArrow(texts, f"page_id {id_type}, url string, text string, n_chars long, n_deleted int, n_markup int")
