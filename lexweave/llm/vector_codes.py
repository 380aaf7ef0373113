"""Vector code compression: product codes found by partial-distance search.

A vector's components become integers ``floor(scale * x)``, so that all sums are exact and no order of adding matters.
Vectors are cut into equal consecutive parts, and each part is replaced by the index of the nearest entry (squared
Euclidean distance, ties to the lower index) of that part's codebook.  Codebooks start as the vectors of the smallest
ids and are moved to the floored means of what they hold in a few rounds.

Partial-distance search: the dimensions of a part are taken in the order of the codebook's descending variance, entries
in blocks; a vectorised mask drops a (vector, entry) pair as soon as its accumulated distance strictly exceeds the best
complete distance that the vector has so far, so a pair that ties stays until it is complete.

On Spark: a round is one pass over the vectors, whose tasks send for each (part, entry, dimension) a count and a sum; the
codebooks, parts x entries x dimensions integers whatever the input, are all that the driver and the tasks hold.  No
group of equal vectors, labels or codes meets in a task: sums are added up before the shuffle, and label sums come back
by a join that Spark may split.

Defined results: rows are dropped whose vector is null, empty or holds null or non-finite components, does not divide into
the parts, or differs in length from the usable vector of the smallest id; a null id sorts last, equal ids by vector;
repeated rows are rows of their own; null labels are one label; with fewer usable vectors than entries the codebook has
so many entries; an empty table gives an empty result.  Components so large that a distance would not fit 64 bits raise
``OverflowError``.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm._common import bounded_batches, materialize, quoted

SCALE = 256

#: Entries that are compared between two looks at the best distance.
BLOCK = 8


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry (rows of ``book``) for each row of ``values``; ties to the lower index."""
    order = np.argsort(-book.var(axis=0), kind="stable")
    values, book = values[:, order], book[:, order]
    n = len(values)
    best, index = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    for begin in range(0, len(book), BLOCK):
        block = book[begin : begin + BLOCK]
        part = (values[:, :1] - block[:, 0]) ** 2
        row, entry = np.nonzero(part <= best[:, None])
        part = part[row, entry]
        for d in range(1, book.shape[1]):
            part += (values[row, d] - block[entry, d]) ** 2
            stays = part <= best[row]
            row, entry, part = row[stays], entry[stays], part[stays]
        by = np.lexsort((entry, part, row))  # a row's survivors: nearest first, lower index first
        row, entry, part = row[by], entry[by], part[by]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        better = first[part[first] < best[row[first]]]
        best[row[better]], index[row[better]] = part[better], begin + entry[better]
    return index, best


def integers(column: pa.Array, dim: int, parts: int, scale: int) -> np.ndarray:
    """Vectors as whole numbers: rows x parts x dimensions of a part."""
    if not len(column):
        return np.zeros((0, parts, dim // parts), np.int64)
    floored = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if floored.size and 4 * float(np.abs(floored).max()) ** 2 * dim >= 2.0**63:
        raise OverflowError("a vector's components are too large for distances of 64 bits")
    return floored.astype(np.int64).reshape(len(column), parts, dim // parts)


def encode_parts(values: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, rows x parts."""
    found = [nearest(values[:, p], books[p]) for p in range(len(books))]
    return np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16) -> tuple[DataFrame, int]:
    """``vec_id``, ``vector`` and ``label`` of the rows that can be coded, and their dimension (0: there is none)."""
    named = df.select(F.col(quoted(id_col)).alias("vec_id"), F.col(quoted(vector_col)).alias("vector"), F.col(quoted(label_col)).alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = named.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & (F.size("vector") % parts == 0) & finite)
    first = fit.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector").alias("d")).first()
    return (fit, 0) if first is None else (fit.where(F.size("vector") == first["d"]), first["d"])


def train(vectors: DataFrame, dim: int, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = SCALE) -> np.ndarray:
    """The codebooks, parts x entries x dimensions of a part, of vectors (``vec_id``, ``vector``) that are all usable."""
    spark = vectors.sparkSession
    first = [r["vector"] for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()]
    books = integers(pa.array(first, pa.list_(pa.float64())), dim, parts, scale).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        shipped = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            books = shipped.value
            n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for batch in batches:
                values = integers(batch.column(0), dim, parts, scale)
                codes, _ = encode_parts(values, books)
                for p in range(parts):
                    n[p] += np.bincount(codes[:, p], minlength=n.shape[1])
                    np.add.at(total[p], codes[:, p], values[:, p])
            p, e = np.nonzero(n)
            d = books.shape[2]
            part, entry, at = np.repeat(p, d), np.repeat(e, d), np.tile(np.arange(d), len(p))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (part, entry, at, np.repeat(n[p, e], d), total[part, entry, at])], ["part", "entry", "at", "n", "total"])

        made = vectors.select("vector").mapInArrow(sums, "part long, entry long, at long, n long, total long")
        books = books.copy()
        # a row for each number of the codebooks, whatever the input's size
        for r in made.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            books[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
        shipped.unpersist()
    return books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, in decimal with commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``label``, ``code`` (two hex digits a part) and ``error`` (squared distances of all parts) of usable vectors."""
    if books.shape[1] > 256:
        raise ValueError("a code has two hex digits: 256 entries at most")
    parts, _, d = books.shape
    shipped = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, distances = encode_parts(integers(batch.column(2), parts * d, parts, scale), shipped.value)
            names = [bytes(c).hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(distances.sum(1), pa.int64())], ["vec_id", "label", "code", "error"])

    types = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return vectors.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The whole numbers that a code stands for."""
    return np.concatenate([books[p, e] for p, e in enumerate(bytes.fromhex(code))])


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = SCALE) -> DataFrame:
    """Codes of all usable vectors with their errors, the errors by label, and the codebooks' digest."""
    vectors, dim = usable(bounded_batches(df), id_col, vector_col, label_col, parts)
    books = train(vectors, dim, parts, entries, rounds, scale) if dim else np.zeros((parts, 1, 1), np.int64)
    coded = materialize(encode(vectors, books, scale), "vector-codes")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
