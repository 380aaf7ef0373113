"""Weighted rendezvous sharding of records by a stable key, in DataFrame functions only.

Every shard scores every key, ``-weight / ln(u)`` with u a number in (0, 1) hashed from key and shard, and a record goes
to the shard of the highest score.  A score depends on its own shard alone, so another shard takes only records that it
wins and moves none between the others; shares follow the weights.  The key, the weights and nothing else decide: no
table of keys is kept, and no order of rows, partitions or files is seen.

``number_rows`` gives the rows of a shard slots from 0 without gaps, in the order of a hash of the row.  A shard is cut
into slices of that order, their sizes are counted and added up, and only a slice is sorted in one task: no shard is.
Equal rows cannot be told apart by any hash; they are counted first, take a run of slots, and are written out again in
bounded runs, so that one row repeated a billion times is one row until then.

Defined results: a null key is the empty string; a null text has no bytes, size 1 and checksum 0; rows with one key share
a shard; equal scores go to the lower shard; equal rows share a run of slots, one each; an empty table gives an empty
result.  ``assign`` keeps all columns whatever their names and replaces those that it makes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.llm._common import free_names, materialize, quoted, whole_row

#: Rows that one task sorts to number them, about; the result does not depend on it.
SLICE_ROWS = 100_000

#: Slots of equal rows that one step writes out.
RUN = 10_000


def _hash52(value: Column) -> Column:
    """The first 52 bits of a string's MD5, which any SQL engine can work out as well."""
    return F.conv(F.substring(F.md5(value), 1, 13), 16, 10).cast("long")


def scores(key: Column, weights: Sequence[float]) -> list[Column]:
    """Each shard's score of a key (a string column)."""
    if not weights or any(not 0 < w < float("inf") for w in weights):
        raise ValueError("there must be shards, and their weights must be positive")
    uniform = [(_hash52(F.concat(key, F.lit(f"/{s}"))) + 0.5) / F.lit(float(1 << 52)) for s in range(len(weights))]
    return [F.lit(-float(w)) / F.ln(u) for w, u in zip(weights, uniform, strict=True)]


def _first_best(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def assign(df: DataFrame, weights: Sequence[float], key_col: str = "doc_id", grown_by: float | None = None) -> DataFrame:
    """``df`` with ``shard``, from 0, of each row's key, and ``grown_shard``: the shard after one more of weight ``grown_by`` has come (null: not asked)."""
    key = F.coalesce(F.col(quoted(key_col)).cast("string"), F.lit(""))
    every = [*weights] if grown_by is None else [*weights, grown_by]
    names = [c for c in df.columns if c.lower() not in ("shard", "grown_shard")]
    row, scored = free_names(df, "row", "scores")
    held = df.select(whole_row(df).alias(row), F.array(*scores(key, every)).alias(scored))
    now, more = _first_best(F.slice(F.col(scored), 1, len(weights))), _first_best(F.col(scored))
    return held.select(*[F.col(f"{row}.{quoted(c)}").alias(c) for c in names], now.alias("shard"), (F.lit(None).cast("int") if grown_by is None else more).alias("grown_shard"))


def row_order(columns: Sequence[str]) -> Column:
    """A row's place among others, hashed from the values of the columns; a null differs from the empty string."""
    return _hash52(F.concat_ws("/", *[F.coalesce(F.concat(F.lit("="), F.col(quoted(c)).cast("string")), F.lit("")) for c in columns]))


def number_rows(df: DataFrame, order_by: Sequence[str], shard_col: str = "shard", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``df``, of columns that can be compared, with ``slot``: gapless from 0 in each shard, by ``row_order`` of the given columns, then by all columns."""
    names = [c for c in df.columns if c.lower() != "slot"]
    place, copies, part, before, first = free_names(df, "place", "copies", "part", "before", "first")
    counted = df.select(*[F.col(quoted(c)) for c in names], row_order(order_by).alias(place)).groupBy(*[quoted(c) for c in names], place).agg(F.count("*").alias(copies))
    counted = materialize(counted, "shard-rows")
    most = counted.groupBy(quoted(shard_col)).count().agg(F.max("count")).first()[0] or 0
    slices = -(-most // slice_rows) or 1
    cut = F.floor(F.col(place) / F.lit((1 << 52) / slices)).cast("int")
    shard = F.col(quoted(shard_col))
    sizes = counted.groupBy(shard.alias("_s"), cut.alias("_c")).agg(F.sum(copies).alias("_n"))
    running = Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("_s", "_c", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_b"))
    # a row for each slice: one for every hundred thousand rows
    placed = counted.withColumn(part, cut).alias("r").join(begins.alias("b"), F.col(f"r.{quoted(shard_col)}").eqNullSafe(F.col("b._s")) & (F.col(f"r.{part}") == F.col("b._c"))).select("r.*", F.col("b._b").alias(before))
    own = Window.partitionBy(quoted(shard_col), part).orderBy(place, *[quoted(c) for c in names])
    start = F.col(before) + F.coalesce(F.sum(copies).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = placed.select(*[F.col(quoted(c)) for c in names], F.col(copies), start.alias(first))
    last = F.col(first) + F.col(copies) - 1
    runs = numbered.select(*[F.col(quoted(c)) for c in names], last.alias(copies), F.explode(F.sequence(F.col(first), last, F.lit(RUN))).alias(first))
    return runs.select(*[F.col(quoted(c)) for c in names], F.explode(F.sequence(F.col(first), F.least(F.col(first) + RUN - 1, F.col(copies)))).alias("slot"))


def shard_documents(docs: DataFrame, weights: Sequence[float], grown_by: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, size, checksum, law, shard, slot and the shard after one more has come."""
    text = F.col(quoted(text_col))
    narrow = docs.select(
        F.col(quoted(id_col)).alias("doc_id"), (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law")
    )
    return number_rows(assign(narrow, weights, "doc_id", grown_by), ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
