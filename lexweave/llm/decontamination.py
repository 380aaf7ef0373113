"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item is short and a document may be very long, so similarity of whole sets says nothing; what counts is the
share of the item's shingles that the document contains.  Items are partitioned by their number of shingles, and in a
partition of size n each item's sketch is its ``n - ceil(threshold * n) + 1`` shingles of smallest hash.  A document
that contains at least the threshold's share of an item misses fewer shingles than the sketch holds, so it contains
one of them: the search has no false negatives.  Only sketches are searched for (a few values an item), in one pass
over the documents' shingle hashes; candidate pairs are then verified by counting the item's shingles in the text
itself.

Words are lower-cased A-Z and split on ASCII white space.  Shingles have ``width`` words; an item with fewer words is
one shingle of all its words and is looked for at that width.

Defined results: items and texts that are null or without words match nothing; repeated rows of either side count
once; a null doc_id or item_id is kept as a value.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm._common import free_names, let, materialize, quoted, words

BROADCAST_ROWS = 2_000_000


def _starts(size: Column, width: int, base: int) -> Column:
    return F.when(size >= width, F.sequence(F.lit(base), size - width + base)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(w: Column, width: int) -> Column:
    """A hash for each run of ``width`` words, from the words' own hashes."""

    def runs(h):
        return F.transform(_starts(F.size(h), width, 0), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    return let(F.transform(w, lambda x: F.xxhash64(x)), runs)


def shingles(w: Column, width: int) -> Column:
    """The runs of ``width`` words themselves."""
    return let(w, lambda own: F.transform(_starts(F.size(own), width, 1), lambda i: F.array_join(F.slice(own, i, width), " ")))


def item_sketches(items: DataFrame, width: int, threshold_percent: int) -> DataFrame:
    """``_key``, ``_width``, distinct shingles and sketch of each distinct item text."""
    texts = items.select(words(F.col("_text")).alias("_w")).where(F.size("_w") > 0).distinct()
    sized = texts.withColumn("_width", F.least(F.size("_w"), F.lit(width)))
    hashed = F.lit(None).cast("array<bigint>")
    plain = F.lit(None).cast("array<string>")
    for k in range(1, width + 1):
        hashed = F.when(F.col("_width") == k, shingle_hashes(F.col("_w"), k)).otherwise(hashed)
        plain = F.when(F.col("_width") == k, shingles(F.col("_w"), k)).otherwise(plain)
    sized = sized.withColumns({"_hashes": F.array_sort(F.array_distinct(hashed)), "_set": F.array_distinct(plain)})
    n = F.size("_hashes")
    missing = n - F.ceil(n * threshold_percent / F.lit(100)).cast("int")
    return sized.select(F.xxhash64("_w").alias("_item"), "_w", "_width", "_set", F.slice("_hashes", 1, missing + 1).alias("_sketch"))


def _contained(docs: DataFrame, items: DataFrame, width: int, threshold_percent: int, id_col: str, text_col: str, item_id_col: str, item_text_col: str) -> DataFrame:
    """``_doc``, ``_th`` (hash of the text), ``_item``, ``n_shared``, ``n_item`` of each text that contains an item."""
    named = items.select(F.col(quoted(item_id_col)).alias("_item_id"), F.col(quoted(item_text_col)).alias("_text"))
    sketches = materialize(item_sketches(named, width, threshold_percent), "item-sketches")
    widths = sorted(r[0] for r in sketches.select("_width").distinct().collect())
    keyed = sketches.select("_item", "_width", F.explode("_sketch").alias("_h"))
    if keyed.count() <= BROADCAST_ROWS:
        keyed = F.broadcast(keyed)

    text = F.col(quoted(text_col))
    base = docs.select(F.col(quoted(id_col)).alias("_doc"), F.xxhash64(text).alias("_th"), text.alias("_text")).where(F.col("_text").isNotNull())
    w = words(F.col("_text"))
    probes = None
    for k in widths:
        own = base.select("_doc", "_th", w.alias("_w")).select("_doc", "_th", F.lit(k).alias("_width"), F.explode(shingle_hashes(F.col("_w"), k)).alias("_h"))
        probes = own if probes is None else probes.unionByName(own)
    if probes is None:
        probes = base.select("_doc", "_th", F.lit(0).alias("_width"), F.lit(0).cast("long").alias("_h")).limit(0)
    candidates = probes.join(keyed, ["_width", "_h"]).select("_doc", "_th", "_item").distinct()
    candidates = materialize(candidates, "contained-candidates")

    sets = sketches.select("_item", "_width", "_set")
    if sketches.agg(F.coalesce(F.sum(F.size("_set")), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_ROWS:
        sets = F.broadcast(sets)
    wanted = candidates.select(F.col("_doc").alias("_d"), F.col("_th").alias("_t"), "_item")
    held = base.join(wanted, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t"))).join(sets, "_item")
    found = F.lit(None).cast("array<string>")
    for k in widths:
        found = F.when(F.col("_width") == k, F.array_intersect(F.col("_set"), shingles(F.col("_w"), k))).otherwise(found)
    counted = held.select("_doc", "_th", "_item", "_set", "_width", w.alias("_w")).select("_doc", "_th", "_item", F.size(found).alias("n_shared"), F.size("_set").alias("n_item"))
    return counted.where(F.col("n_shared") * 100 >= F.col("n_item") * threshold_percent)


def find_contained(docs: DataFrame, items: DataFrame, width: int = 5, threshold_percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item whose shingles it contains: ``doc_id``, ``item_id``, ``n_shared``, ``n_item``."""
    matched = _contained(docs, items, width, threshold_percent, id_col, text_col, item_id_col, item_text_col)
    matched = matched.groupBy("_doc", "_item").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))
    w = words(F.col(quoted(item_text_col)))
    ids = items.select(F.xxhash64(w).alias("_item"), F.col(quoted(item_id_col)).alias("_item_id")).where(F.size(w) > 0).distinct()
    return matched.join(ids, "_item").select(F.col("_doc").alias("doc_id"), F.col("_item_id").alias("item_id"), "n_shared", "n_item")


def drop_contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold_percent: int = 80, item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that contain no item, every column kept; of rows with one id, only those whose own text holds one go."""
    one, two = free_names(df, "_hit", "_hit_th")
    hit = _contained(df, items, width, threshold_percent, id_col, text_col, item_id_col, item_text_col).select(F.col("_doc").alias(one), F.col("_th").alias(two)).distinct()
    return df.join(hit, F.col(quoted(id_col)).eqNullSafe(F.col(one)) & (F.xxhash64(F.col(quoted(text_col))) == F.col(two)), "left_anti")
