"""BM25 over a saved index in blocks: bounds first, postings only where a bound says that they can matter.

A block holds the postings of one term in a range of ``width`` rows as arrays, with their number, the largest frequency and
the smallest length among them.  A term's document frequency is what its blocks hold, added up for the questions' terms alone.  A posting's weight grows with its frequency and falls with its length, so these two bound
every weight of the block, whatever k1, b and the corpus statistics are; the sum of a question's bounds bounds the score
of every row of the range.

A search takes two steps.  The first adds up bounds from the blocks' narrow columns alone, scores the few ranges of the
highest bounds, and so learns a score that ``top_n`` rows reach.  The second scores the ranges whose bound reaches it; no
other can hold a row of the result.  A range's blocks meet in one task, which adds their weights up in arrays and sends on
the best rows of each question only: no posting becomes a row of a join or an aggregate.  The result is the plain
search's, ties included.  Null rows are in no range and are not found.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions import text as X
from lexweave.operators.bm25 import BROADCAST_TERMS, broadcast_terms, count_rows, ranked, statistics, term_frequencies
from lexweave.operators.tables import remove, run_dir, snapshot

#: Rows of a range.
WIDTH = 4096

#: Ranges of a question that are scored to find its threshold.
OPENING = 4

#: Sums of the same weights in another order differ by less.
SLACK = 1e-6

#: Rows whose terms are counted together, and terms that a task sends on together.
ROWS_AT_ONCE, TERMS_AT_ONCE = 512, 20_000


def _by_term(at: np.ndarray, row: np.ndarray, tf: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Of postings whose terms have the numbers ``at``, for each term: its number, and max_tf, min_len, held, rows, tfs, lens."""
    order = np.lexsort((length, tf, row, at))
    at, row, tf, length = at[order], row[order], tf[order], length[order]
    cuts = np.flatnonzero(np.diff(at, prepend=-1))
    offsets = pa.array(np.append(cuts, len(at)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (row, tf, length)]
    return at[cuts], [pa.array(np.maximum.reduceat(tf, cuts)), pa.array(np.minimum.reduceat(length, cuts)), pa.array(np.diff(offsets.to_numpy())), *lists]


def blocked(postings: DataFrame, width: int = WIDTH) -> DataFrame:
    """Postings (row, term, tf, len) as blocks; a block has at most ``width`` entries.

    The postings of a range of rows meet in one task, which sorts them as arrays; ``width`` bounds what it holds.
    """
    own = postings.where("row IS NOT NULL").select(F.floor(F.col("row") / width).cast("long").alias("block"), "term", "row", "tf", "len")
    kind = own.schema["row"].dataType.simpleString()

    def gather(table: pa.Table) -> pa.Table:
        named = table.column("term").combine_chunks().dictionary_encode()
        at = named.indices.to_numpy()
        row, tf, length = (table.column(c).to_numpy() for c in ("row", "tf", "len"))
        at, columns = _by_term(at, row, tf, length)
        block = np.full(len(at), table.column("block")[0].as_py(), np.int64)
        return pa.Table.from_arrays([named.dictionary.take(pa.array(at)), pa.array(block), *columns], ["term", "block", "max_tf", "min_len", "held", "rows", "tfs", "lens"])

    return own.groupBy("block").applyInArrow(gather, f"term string, block long, max_tf int, min_len int, held int, rows array<{kind}>, tfs array<int>, lens array<int>")


def _counted_blocks(chunks: DataFrame, width: int) -> DataFrame:
    """Blocks without df, and their ``total`` of occurrences: the texts of a range of rows meet in one task, which counts their terms; no posting is a row."""
    own = chunks.where("row IS NOT NULL").select(F.floor(F.col("row") / width).cast("long").alias("block"), "row", "text")
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = own.repartition(parts, "block").sortWithinPartitions("block").select("block", "row", X.tokens(F.col("text")).alias("_t"))
    names = ["term", "block", "total", "max_tf", "min_len", "held", "rows", "tfs", "lens"]

    def ended(block: int, seen: list[pa.Array], held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        named = table.column("term").combine_chunks().dictionary_encode()
        at = named.indices.to_numpy()
        row, tf, length = (table.column(c).to_numpy() for c in ("row", "tf", "len"))
        given = pa.chunked_array(seen)
        if len(given.unique()) < len(given):  # a row that stands twice is counted together
            order = np.lexsort((length, row, at))
            at, row, tf, length = at[order], row[order], tf[order], length[order]
            new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(row, prepend=row[:1]) != 0) | (np.diff(length, prepend=length[:1]) != 0))
            at, row, length, tf = at[new], row[new], length[new], np.add.reduceat(tf, new) if len(new) else tf
        if not len(at):
            return
        at, columns = _by_term(at, row, tf.astype(np.int32), length)
        total = np.add.reduceat(columns[4].flatten().to_numpy().astype(np.int64), columns[3].offsets.to_numpy()[:-1])
        found = pa.RecordBatch.from_arrays([named.dictionary.take(pa.array(at)), pa.array(np.full(len(at), block, np.int64)), pa.array(total), *columns], names)
        for i in range(0, len(at), TERMS_AT_ONCE):
            yield found.slice(i, TERMS_AT_ONCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, held = None, [], []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = [*np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1)).tolist(), len(blocks)] if len(blocks) else []
            for begin, end in zip(cuts, cuts[1:]):
                if now != blocks[begin]:
                    if seen:
                        yield from ended(now, seen, held)
                    now, seen, held = int(blocks[begin]), [], []
                for i in range(begin, end, ROWS_AT_ONCE):
                    few = batch.slice(i, min(ROWS_AT_ONCE, end - i))
                    seen.append(few.column("row"))
                    held.append(pa.RecordBatch.from_arrays(count_rows(few.column("row"), few.column("_t")), ["row", "term", "tf", "len"]))
        if seen:
            yield from ended(now, seen, held)

    kind = chunks.schema["row"].dataType.simpleString()
    return met.mapInArrow(run, f"term string, block long, total long, max_tf int, min_len int, held int, rows array<{kind}>, tfs array<int>, lens array<int>")


def build(chunks: DataFrame, width: int = WIDTH, folder: str = "") -> tuple[DataFrame, DataFrame]:
    """Blocks and statistics of chunks (row, text): those of ``blocked`` and ``bm25.build``.

    Texts are sent once and counted once, into a table of blocks in ``folder``; what the blocks of a term hold adds up to its frequency.
    Rows that are null are in no range, but count in frequencies and statistics: a block without a number holds them, and no arrays.
    """
    counted = snapshot(_counted_blocks(chunks, width), f"{folder}blocks")
    nowhere = chunks.where("row IS NULL")
    if not nowhere.isEmpty():
        loose = term_frequencies(nowhere).groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").cast("int").alias("held"))
        counted = counted.unionByName(snapshot(loose, f"{folder}terms-of-null-rows"), allowMissingColumns=True)
    return counted.drop("total"), statistics(chunks, counted.select(F.col("total").alias("tf")))


@contextmanager
def built(chunks: DataFrame, width: int = WIDTH) -> Iterator[tuple[DataFrame, DataFrame]]:
    """``build`` for as long as its result is read: then the tables behind it go."""
    folder = f"bm25-{uuid.uuid4().hex}"
    try:
        yield build(chunks, width, f"{folder}/")
    finally:
        remove(chunks.sparkSession, f"{run_dir(chunks.sparkSession)}/{folder}")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's arrays as bytes: rows as steps, then the lowest bytes of all numbers, the next ones, and so on, which pack well."""
    for batch in batches:
        packs, at = [], batch.schema.get_field_index("rows")
        ends = np.concatenate([[0], np.cumsum(np.diff(batch.column("rows").offsets.to_numpy()))])
        flat = [batch.column(c).flatten().to_numpy().astype(kind) for c, kind in (("rows", np.int64), ("tfs", np.int32), ("lens", np.int32))]
        for i, j in zip(ends[:-1], ends[1:]):
            row, tf, length = (x[i:j] for x in flat)
            planes = [x.view(np.uint8).reshape(j - i, -1).T.tobytes() for x in (np.diff(row, prepend=0), tf, length)]
            packs.append(pa.compress(b"".join(planes), codec="zstd", asbytes=True))
        yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(np.diff(ends).astype(np.int32)), pa.array(packs, pa.binary())], [*batch.schema.names[:at], "held", "pack"])


def _unpacked(packs: pa.Array, sizes: np.ndarray) -> list[np.ndarray]:
    """rows, tfs and lens of the packs, one behind another."""
    out = [], [], []
    for pack, n in zip(packs, sizes.tolist(), strict=True):
        data, begin = np.frombuffer(pa.decompress(pack.as_buffer(), 16 * n, codec="zstd"), np.uint8), 0
        for x, kind in zip(out, (np.int64, np.int32, np.int32), strict=True):
            end = begin + n * kind().itemsize
            x.append(np.ascontiguousarray(data[begin:end].reshape(-1, n).T).view(kind).ravel())
            begin = end
        out[0][-1] = np.cumsum(out[0][-1])
    return [np.concatenate(x) for x in out]


def _weight(idf, tf, length, avgdl, k1: float, b: float):
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))


def _idf() -> Column:
    return F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def with_frequency(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """``terms`` that blocks hold, with ``df``, the number of rows."""
    held = blocks.select("term", "held").join(broadcast_terms(terms.select("term").distinct()), "term", "left_semi")
    return snapshot(terms.join(held.groupBy("term").agg(F.sum("held").alias("df")), "term"), "terms")


def range_bounds(blocks: DataFrame, stats: DataFrame, terms: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, block, ``bound`` on the score of the range's rows, ``held`` postings; ``terms`` with their ``df``; the blocks' arrays stay unread."""
    head = blocks.where("block IS NOT NULL").select("term", "block", "max_tf", "min_len", "held")
    met = head.join(broadcast_terms(terms), "term").crossJoin(F.broadcast(stats))  # one row of statistics
    bound = _weight(_idf(), F.col("max_tf"), F.col("min_len"), F.col("avgdl"), k1, b)
    return met.groupBy("query_id", "block").agg(F.sum(bound).alias("bound"), F.sum("held").alias("held"))


def best_of_ranges(blocks: DataFrame, stats: DataFrame, terms: DataFrame, top_n: int, k1: float, b: float, ranges: DataFrame | None = None) -> DataFrame:
    """query_id, row, score of each range's best rows for each question; ``ranges``: those to be scored (query_id, block), each once, or all of them; ``terms`` with their ``df``.

    Only blocks of terms that a question asks for in its ranges are sent to where their range is scored, packed.
    """
    ids = terms.schema["query_id"].dataType
    asked = broadcast_terms(terms.groupBy("term", "df").agg(F.collect_list("query_id").alias("queries")))
    found = blocks.where("block IS NOT NULL").select("term", "block", "rows", "tfs", "lens").join(asked, "term")
    if ranges is not None:
        own = ranges.groupBy("block").agg(F.collect_list("query_id").alias("_own"))
        own = F.broadcast(own) if ranges.count() <= BROADCAST_TERMS else own
        found = found.join(own, "block").withColumn("queries", F.filter("queries", lambda q: F.array_contains("_own", q))).where(F.size("queries") > 0)
    found = found.crossJoin(F.broadcast(stats)).select("block", "queries", _idf().alias("idf"), "avgdl", "rows", "tfs", "lens")
    found = found.mapInArrow(_packed, f"block long, queries array<{ids.simpleString()}>, idf double, avgdl double, held int, pack binary")

    def score(table: pa.Table) -> pa.Table:
        flat = {"queries": table.column("queries").combine_chunks()}
        sizes = table.column("held").to_numpy()
        ends = np.cumsum(sizes)
        rows, tf, length = _unpacked(table.column("pack"), sizes)
        idf, avgdl = (np.repeat(table.column(c).to_numpy(), sizes) for c in ("idf", "avgdl"))
        weights = _weight(idf, tf, length, avgdl, k1, b)
        base = int(rows.min())
        at = rows - base
        named = flat["queries"].flatten().dictionary_encode()
        of = named.indices.to_numpy()
        block = np.repeat(np.arange(len(sizes)), np.diff(flat["queries"].offsets.to_numpy()))
        order = np.argsort(of, kind="stable")
        cuts = np.flatnonzero(np.diff(of[order], prepend=-1))
        out = []
        for q, mine in zip(of[order][cuts], np.split(block[order], cuts[1:]), strict=True):
            pick = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in mine])
            total = np.bincount(at[pick], weights[pick])
            held = np.flatnonzero(total)
            if len(held) > top_n:  # what reaches the n-th best stays, ties included
                held = held[total[held] >= np.partition(total[held], len(held) - top_n)[len(held) - top_n] - SLACK]
            out.append((np.full(len(held), q), held + base, total[held]))
        which, row, value = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": named.dictionary.take(pa.array(which)), "row": pa.array(row, pa.int64()), "score": pa.array(value, pa.float64())})

    return found.groupBy("block").applyInArrow(score, f"query_id {ids.simpleString()}, row long, score double")


def choose_ranges(blocks: DataFrame, stats: DataFrame, terms: DataFrame, top_n: int, k1: float = 1.5, b: float = 0.75, opening: int = OPENING) -> tuple[DataFrame, DataFrame]:
    """The first step, for ``terms`` with their ``df``: the best rows of the opening ranges (query_id, row, score), and all ranges with their ``place`` and whether they are ``needed``."""
    own = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    ranges = snapshot(range_bounds(blocks, stats, terms, k1, b).withColumn("place", F.row_number().over(own)), "ranges")
    first = snapshot(ranked(best_of_ranges(blocks, stats, terms, top_n, k1, b, ranges.where(F.col("place") <= opening)), top_n), "opening")
    # a question with fewer rows than asked for has no threshold
    reached = first.where(F.col("rank") == top_n).select("query_id", F.col("score").alias("reached"))
    judged = ranges.join(reached, "query_id", "left")
    return first.drop("rank"), judged.withColumn("needed", (F.col("place") <= opening) | F.col("reached").isNull() | (F.col("bound") >= F.col("reached") - SLACK)).drop("reached")


def search(blocks: DataFrame, stats: DataFrame, terms: DataFrame, top_n: int = 20, k1: float = 1.5, b: float = 0.75, opening: int = OPENING) -> DataFrame:
    """query_id, row, score, rank of the best rows; ``terms`` as of ``bm25.query_terms``."""
    terms = with_frequency(blocks, terms)
    if blocks.agg(F.max("block") - F.min("block")).first()[0] in (None, *range(opening)):  # every range is an opening one
        return ranked(best_of_ranges(blocks, stats, terms, top_n, k1, b), top_n)
    first, ranges = choose_ranges(blocks, stats, terms, top_n, k1, b, opening)
    rest = ranges.where(F.col("needed") & (F.col("place") > opening))
    return ranked(first.unionByName(best_of_ranges(blocks, stats, terms, top_n, k1, b, rest)), top_n)


def postings_read(blocks: DataFrame, stats: DataFrame, terms: DataFrame, top_n: int = 20, k1: float = 1.5, b: float = 0.75, opening: int = OPENING) -> DataFrame:
    """One row: ``all`` postings of the questions' terms and those ``read`` by ``search``, all ``ranges`` and those ``needed``."""
    _, ranges = choose_ranges(blocks, stats, with_frequency(blocks, terms), top_n, k1, b, opening)
    return ranges.agg(F.sum("held").alias("all"), F.sum(F.when(F.col("needed"), F.col("held")).otherwise(0)).alias("read"), F.count("*").alias("ranges"), F.count_if("needed").alias("needed"))
