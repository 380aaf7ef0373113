"""Lines of pages without page furniture, as grouped counts and window flags.

Input: pages (document_id, document_version, page_number, text).  Output: one row for each kept line with its page and
its place.  Furniture is a lone margin letter; a running header in capitals, known by its first twelve letters from
the edges of three pages, wherever it stands; and at a page's edge a page number or a line that stands at the edges of
at least five and half of the pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions import fixed
from lexweave.functions import text as X

DOC = ["document_id", "document_version"]
EDGE = 2
#: Pages at whose edges a header, and any other line, must stand to be furniture.
RUNNING_HEADER, RUNNING_LINE = 3, 5


def _solid(pages: DataFrame) -> DataFrame:
    """Pages with their trimmed lines that are not blank, as one array."""
    split = F.transform(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return pages.select(*DOC, "page_number", F.filter(split, lambda x: x != "").alias("_lines"))


def _placed(solid: DataFrame) -> DataFrame:
    placed = solid.select(*DOC, "page_number", F.size("_lines").alias("_n"), F.posexplode("_lines").alias("line_on_page", "line"))
    return placed.withColumn("at_edge", (F.col("line_on_page") < EDGE) | (F.col("line_on_page") >= F.col("_n") - EDGE))


def page_lines(pages: DataFrame) -> DataFrame:
    """Trimmed lines that are not blank, with their place from the top and the bottom of the page."""
    return _placed(_solid(pages))


def running_lines(lines: DataFrame) -> DataFrame:
    """Pages on whose edges each normalised line stands."""
    keyed = lines.where("at_edge").select(*DOC, "page_number", X.line_key(F.col("line")).alias("key"))
    return keyed.groupBy(*DOC, "key").agg(F.countDistinct("page_number").alias("pages"))


def running_headers(lines: DataFrame) -> DataFrame:
    """Pages on whose edges each header-like key stands."""
    keyed = lines.where(F.col("at_edge") & X.header_like(F.col("line"))).select(*DOC, "page_number", X.fuzzy_key(F.col("line")).alias("fuzzy")).where(F.length("fuzzy") >= 6)
    return keyed.groupBy(*DOC, "fuzzy").agg(F.countDistinct("page_number").alias("header_pages"))


def document_lines(pages: DataFrame) -> DataFrame:
    """Reading order without furniture: DOC, page_number, line, line_no (from 0).

    Pages are dealt out by document once, as arrays of lines, and all that follows works within that order.  Only edges
    of documents with so many pages that a line can run are counted.
    """
    own = Window.partitionBy(*DOC)
    # what the joins below ask of their keys is said first, so that all three readings are of one shuffle
    solid = _solid(pages.where(F.col(DOC[0]).isNotNull() & F.col(DOC[1]).isNotNull())).withColumn("_total", F.count("*").over(own))
    edges = _placed(solid.where(f"_total >= {RUNNING_HEADER}"))
    exact = running_lines(edges).where(f"pages >= {RUNNING_LINE}").groupBy(*DOC).agg(F.collect_list(F.struct("key", "pages")).alias("_exact"))
    headers = running_headers(edges).where(f"header_pages >= {RUNNING_HEADER}").groupBy(*DOC).agg(F.collect_list("fuzzy").alias("_headers"))
    running = F.filter("_exact", lambda e: (F.size(F.split(e["key"], " ")) <= 12) & (e["pages"] >= F.col("_total") / 2))
    marked = solid.join(exact, DOC, "left").join(headers, DOC, "left").withColumn("_running", F.transform(running, lambda e: e["key"]))
    header, exact_running = F.col("_headers"), F.col("_running")

    def stays(line, i):
        at_edge = (i < EDGE) | (i >= F.size("_lines") - EDGE)
        heads = header.isNotNull() & F.array_contains(header, X.fuzzy_key(line)) & X.header_like(line)
        runs = exact_running.isNotNull() & F.array_contains(exact_running, X.line_key(line))
        return ~F.coalesce(line.rlike("^[A-Ha-h]$") | heads | (at_edge & (line.rlike(f"(?i){fixed.PAGE_NUMBER}") | runs)), F.lit(False))

    kept = marked.select(*DOC, "page_number", F.filter("_lines", stays).alias("_kept"))
    before = F.coalesce(F.sum(F.size(F.coalesce("_kept", F.array().cast("array<string>")))).over(own.orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return kept.withColumn("_before", before).select(*DOC, "page_number", "_before", F.posexplode("_kept").alias("_i", "line")).select(*DOC, "page_number", "line", (F.col("_before") + F.col("_i")).cast("int").alias("line_no"))
