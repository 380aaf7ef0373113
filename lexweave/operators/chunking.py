"""Chunks: sections cut into bounded, overlapping pieces.

Furniture is removed with joins (``lines``).  A structured document's lines are marked with their sections in one group
of ``applyInPandas``; a document without structure is one section and stays in columns, as does all that follows.

Packing: where a piece that begins at a unit ends, and where the next one begins, depends on that unit alone.  So both are
worked out for every unit at once, by windows over ranges of cumulated sizes, and one fold over a section's units follows
the chain from the first.  A section's units are one array, bounded by a document.

Identifiers are hashes of content, so a rebuilt corpus has the same chunk ids.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions import fixed
from lexweave.functions import text as X
from lexweave.operators.lines import DOC, document_lines
from lexweave.operators.sections import detect_sections
from lexweave.operators.tables import snapshot

CHUNK_SCHEMA = (
    "chunk_id string, corpus_id string, document_id string, document_version int, source_type string, source_url string, chunk_index int, "
    "page_start int, page_end int, page_label_start string, page_label_end string, text string, token_count int, chunking_method string, "
    "division string, part string, chapter string, article_number string, article_title string, clause_labels array<string>, heading string, "
    "opinion_author string, case_name string, paragraph_number string"
)


class ChunkingError(Exception):
    """The corpus cannot be chunked: nothing was ingested, or its tables disagree."""


@dataclass(frozen=True)
class ChunkLimits:
    target: int = 500
    most: int = 600
    overlap: int = 75

    def __post_init__(self):
        if not 0 < self.target <= self.most or not 0 <= self.overlap < self.target:
            raise ValueError("limits must satisfy 0 < target <= most and 0 <= overlap < target")


#: What a section says of its lines.
_SECTION = ["structural", "division", "part", "chapter", "article_number", "article_title", "heading", "opinion_author"]
_MARKED = "document_id string, document_version int, line_no int, page_number int, line string, section int, clause string, structural boolean, " + ", ".join(f"{c} string" for c in _SECTION[1:])


def section_lines(kept: DataFrame, registry: DataFrame) -> DataFrame:
    """Lines with their section's number and columns, and the label of a clause that begins there; ``registry``: DOC, source_type."""
    typed = kept.join(registry.select(*DOC, "source_type"), DOC)
    structured = F.col("source_type").isin("constitutional_text", "judgment")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no")
        lines, rows = pdf["line"].tolist(), []
        for n, s in enumerate(detect_sections(lines, pdf["source_type"].iloc[0])):
            rows += [(i, n, s.clauses.get(i), *(getattr(s, c) for c in _SECTION)) for i in s.lines]
        marks = pd.DataFrame(rows, columns=["i", "section", "clause", *_SECTION]).set_index("i")
        own = pdf.reset_index(drop=True).drop(columns="source_type").join(marks, how="inner")
        return own[[x.split()[0] for x in _MARKED.split(", ")]]

    marked = typed.where(structured).groupBy(*DOC).applyInPandas(run, _MARKED)
    plain = typed.where(~structured).select(*DOC, F.col("line_no").cast("int"), F.col("page_number").cast("int"), "line", F.lit(0).alias("section"), F.lit(None).cast("string").alias("clause"), F.lit(False).alias("structural"), *[F.lit(None).cast("string").alias(c) for c in _SECTION[1:]])
    return marked.unionByName(plain)


def wrapped(line: Column, most: int, tokens: Column | None = None) -> Column:
    """A line (of so many ``tokens``, if they are known) of more than ``most`` tokens as pieces of whole words that have no more; a longer single word is a piece.  Tokens never span a space, so they add up."""

    def add(state: Column, word: Column) -> Column:
        size = X.count_tokens(word)
        full = state["now"].isNotNull() & (state["size"] + size > most)
        return F.when(full, F.struct(F.array_append(state["done"], state["now"]).alias("done"), word.alias("now"), size.alias("size"))).otherwise(
            F.struct(state["done"].alias("done"), F.concat_ws(" ", state["now"], word).alias("now"), (state["size"] + size).alias("size"))
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(0).alias("size"))
    pieces = F.aggregate(F.split(X.normalize_space(line), " "), start, add, lambda s: F.array_append(s["done"], s["now"]))
    return F.when((X.count_tokens(line) if tokens is None else tokens) <= most, F.array(line)).otherwise(pieces)


def units(lines: DataFrame, most: int) -> DataFrame:
    """Lines with ``tokens``, if any, as units: DOC, section, ``k`` (place in the section), text, page, tokens, clause, and ``clean``: may a piece begin here?"""
    each = lines.where("tokens > 0").select(*DOC, "section", "line_no", F.col("page_number").alias("page"), "clause", "line", F.col("tokens").alias("_whole"), F.posexplode(wrapped(F.col("line"), most, F.col("tokens"))).alias("part", "text"))
    order = Window.partitionBy(*DOC, "section").orderBy("line_no", "part")
    starts = F.col("clause").isNotNull() | F.col("line").rlike(f"^(?:{fixed.NUMBERED_PARAGRAPH}|{fixed.CLAUSE})") | F.coalesce(F.lag("text").over(order).rlike(fixed.TERMINAL), F.lit(False))
    first = F.col("part") == 0
    return each.select(*DOC, "section", (F.row_number().over(order) - 1).alias("k"), "text", "page", F.when(F.col("_whole") <= most, F.col("_whole")).otherwise(X.count_tokens(F.col("text"))).alias("tokens"), F.when(first, F.col("clause")).alias("clause"), (first & starts).alias("clean"))


def pieces(own: DataFrame, limits: ChunkLimits, keys: list[str]) -> DataFrame:
    """By section (``keys``): its ``units`` in order, and its ``pieces`` (start, end, fresh): units before ``fresh`` repeat the end of the piece before.

    A piece reaches as far as ``target`` tokens go, back to the last clean unit of its second half, else on to the first
    clean one within ``most``; what is left is the last piece if it fits into ``most``.  The next piece begins as far back
    as ``overlap`` tokens go.
    """
    part = Window.partitionBy(*keys)
    sized = own.withColumns({"_at": F.coalesce(F.sum("tokens").over(part.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("tokens").over(part), "_n": F.count("*").over(part)})
    by = part.orderBy("_at")
    clean = F.when(F.col("clean"), F.col("k"))
    end = F.greatest(F.col("k") + 1, F.max("k").over(by.rangeBetween(0, limits.target)))
    inside = F.max(clean).over(by.rangeBetween(max(limits.target // 2, 1), limits.target))
    ahead = F.min(clean).over(by.rangeBetween(limits.target + 1, limits.most)) if limits.target < limits.most else F.lit(None)
    cut = F.when(F.col("_all") - F.col("_at") <= limits.most, F.col("_n")).otherwise(F.coalesce(inside, ahead, end))
    judged = sized.withColumns({"cut": cut.cast("int"), "back": F.min("k").over(by.rangeBetween(-limits.overlap, 0)).cast("int")})
    gathered = judged.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "text", "page", "tokens", "clause", "cut", "back"))).alias("units"))

    def follow(state: Column, u: Column) -> Column:
        piece = F.struct(u["k"].alias("start"), u["cut"].alias("end"), state["fresh"].alias("fresh"))
        after = F.coalesce(F.get(state["backs"], u["cut"]), u["cut"])
        return F.when(u["k"] == state["next"], F.struct(F.greatest(u["k"] + 1, after).alias("next"), u["cut"].alias("fresh"), F.array_append(state["found"], piece).alias("found"), (u["cut"] >= F.size(state["backs"])).alias("over"), state["backs"].alias("backs"))).otherwise(state)

    # a piece that takes in the last unit is the last one: no unit follows "next" then
    begin = F.struct(F.lit(0).alias("next"), F.lit(0).alias("fresh"), F.array().cast("array<struct<start:int,end:int,fresh:int>>").alias("found"), F.lit(False).alias("over"), F.transform("units", lambda u: u["back"]).alias("backs"))
    found = F.aggregate("units", begin, lambda state, u: F.when(state["over"], state).otherwise(follow(state, u)), lambda state: state["found"])
    return gathered.withColumn("pieces", found)


def chunk_documents(pages: DataFrame, registry: DataFrame, limits: ChunkLimits | None = None) -> DataFrame:
    """Chunks of every current document of the registry.

    ``pages``: DOC, page_number, text, page_label.  ``registry``: DOC, corpus_id, source_type, source_url, title, replaced_by.
    """
    limits = limits or ChunkLimits()
    current = registry.where("replaced_by IS NULL")
    lines = section_lines(document_lines(pages.join(current.select(*DOC), DOC, "left_semi")), current)
    lines = snapshot(lines.withColumn("tokens", X.count_tokens(F.col("line"))), "section-lines")  # counted once
    keys = [*DOC, "section"]
    about = lines.groupBy(*keys).agg(*[F.any_value(c).alias(c) for c in _SECTION])
    cut = pieces(units(lines, limits.most), limits, keys).select(*keys, "units", F.size("pieces").alias("n_pieces"), F.posexplode("pieces").alias("piece", "p"))
    own = F.slice("units", F.col("p.start") + 1, F.col("p.end") - F.col("p.start"))
    fresh = F.filter(own, lambda u: (u["k"] >= F.col("p.fresh")) & u["clause"].isNotNull())
    text = F.array_join(F.transform(own, lambda u: u["text"]), "\n")
    made = cut.select(
        *keys, "piece", "n_pieces", text.alias("text"), F.aggregate(own, F.lit(0), lambda s, u: s + u["tokens"]).alias("token_count"), F.array_min(F.transform(own, lambda u: u["page"])).alias("page_start"),
        F.array_max(F.transform(own, lambda u: u["page"])).alias("page_end"), F.transform(fresh, lambda u: u["clause"]).alias("clause_labels"),
    )
    labels = pages.groupBy(*DOC).agg(F.map_from_entries(F.collect_list(F.struct(F.col("page_number").cast("int"), "page_label"))).alias("labels"))  # a page's label each: bounded by one document
    known = current.select(*DOC, "corpus_id", "source_type", "source_url", "title").join(labels, DOC)
    index = F.row_number().over(Window.partitionBy(*DOC).orderBy("section", "piece")) - 1
    rows = made.join(about, keys).join(known, DOC).withColumn("chunk_index", index)
    named = {
        "chunk_id": F.format_string("%s@v%d:%04d:%s", "document_id", "document_version", "chunk_index", F.substring(F.sha2("text", 256), 1, 8)),
        "page_label_start": F.try_element_at("labels", F.col("page_start")), "page_label_end": F.try_element_at("labels", F.col("page_end")),
        "chunking_method": F.when(~F.col("structural"), "fallback").when(F.col("n_pieces") > 1, "structure_split").otherwise("structure"),
        "case_name": F.when(F.col("source_type") == "judgment", F.col("title")), "paragraph_number": F.lit(None).cast("string"),
    }
    return rows.withColumns(named).select(*[F.col(c).cast(kind) for c, kind in (x.split(" ", 1) for x in CHUNK_SCHEMA.split(", "))])


def missing_documents(registry: DataFrame, pages: DataFrame) -> DataFrame:
    """Current versions of the registry without pages."""
    return registry.where("replaced_by IS NULL").select(*DOC).join(pages.select(*DOC).distinct(), DOC, "left_anti")


def hit_line() -> Column:
    """One line about a chunk (its columns and its document's ``title``): the first of case, article, heading, part, title and id that it has, its author, its pages."""
    article = F.when(F.col("article_number") != "", F.concat_ws(" — ", F.concat(F.lit("Article "), "article_number"), "article_title"))
    named = [F.when(F.col(c) != "", F.col(c)) for c in ("case_name", "heading", "part", "title", "document_id")]
    pages = F.format_string("pp. %d-%d", "page_start", "page_end")
    return F.concat_ws(" | ", F.coalesce(named[0], article, *named[1:]), F.when(F.col("opinion_author") != "", F.col("opinion_author")), pages)


def chunk_report(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id", "chunking_method").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"))


def invalid_chunks(chunks: DataFrame) -> DataFrame:
    """Rows that break a rule of the table, with the rule."""
    broken = (
        F.when(F.col("page_start") > F.col("page_end"), "pages out of order")
        .when(F.trim("text") == "", "blank text")
        .when(F.col("article_number").isNotNull() & (F.col("source_type") != "constitutional_text"), "article outside constitutional text")
    )
    return chunks.select("chunk_id", broken.alias("problem")).where("problem IS NOT NULL")


#: Rows, or digests, that one digest of the order covers.
ORDER_RANGE = 4096


def _digests(level: DataFrame, place: str, value: str, width: int) -> DataFrame:
    """A digest for each range of places; ``range`` and ``digest``."""
    own = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.col(value).alias("value"))))
    said = F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["place"].cast("string"), x["value"])), "\n")
    return level.groupBy(F.floor(F.col(place) / width).alias("range")).agg(F.sha2(said, 256).alias("digest"))


def order_digests(chunks: DataFrame, width: int = ORDER_RANGE) -> DataFrame:
    """Digests of the corpus order (row, chunk_id) by ranges of rows: the leaves of a Merkle tree."""
    return _digests(chunks, "row", "chunk_id", width)


def index_fingerprint(chunks: DataFrame, width: int = ORDER_RANGE) -> str:
    """The root of the tree over the corpus order; each level is ``width`` times smaller, and only the root reaches the driver."""
    level = order_digests(chunks, width)
    while len(top := level.limit(2).collect()) > 1:
        level = _digests(level, "range", "digest", width)
    return top[0]["digest"] if top else hashlib.sha256(b"").hexdigest()


def first_difference(stored: DataFrame, current: DataFrame, width: int = ORDER_RANGE) -> int | None:
    """The first row at which two orders (row, chunk_id) differ: ranges are compared by digest, and rows in the first range that differs."""
    one, two = (order_digests(x, width).withColumnRenamed("digest", c) for x, c in ((stored, "_a"), (current, "_b")))
    apart = one.join(two, "range", "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).agg(F.min("range")).first()[0]
    if apart is None:
        return None
    inside = F.floor(F.col("row") / width) == apart
    return stale_rows(stored.where(inside), current.where(inside)).agg(F.min("row")).first()[0]


def stale_rows(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Rows at which a stored chunk order (row, chunk_id) and the current one differ; must be empty."""
    both = stored.select("row", F.col("chunk_id").alias("_a")).join(current.select("row", F.col("chunk_id").alias("_b")), "row", "full")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("row")


def with_rows(chunks: DataFrame) -> DataFrame:
    """Chunks with ``row``, their place in the corpus: places within a document plus the chunks of the documents before.

    Documents are sorted by range partitions; a partition's offset comes from the counts of those before it, so no task
    holds all documents of a corpus.
    """
    keys = ["corpus_id", *DOC]
    sizes = chunks.groupBy(*keys).agg(F.count("*").alias("_n"))
    placed = snapshot(sizes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()), "document-order")
    before = Window.partitionBy("corpus_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each corpus and partition
    offsets = placed.groupBy("corpus_id", "_part").agg(F.sum("_n").alias("_all")).withColumn("_offset", F.coalesce(F.sum("_all").over(before), F.lit(0))).drop("_all")
    own = Window.partitionBy("corpus_id", "_part").orderBy(*DOC).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.join(F.broadcast(offsets), ["corpus_id", "_part"]).withColumn("_start", F.col("_offset") + F.coalesce(F.sum("_n").over(own), F.lit(0))).select(*keys, "_start")
    return chunks.join(starts, keys).withColumn("row", F.col("_start") + F.col("chunk_index")).drop("_start")
