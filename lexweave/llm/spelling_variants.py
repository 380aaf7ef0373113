"""Spelling variant grouping by rolling-hash deletions.

Words are counted over all texts (map-side combined, so a frequent word is one row a task).  Two words are near if one
inserted, deleted or replaced code point makes one the other; then either both lose the code point at the same place and
are equal (replaced), or the longer one loses a code point and is the shorter (inserted, deleted).

1. Keys: prefix and suffix polynomial hashes, running sums over a batch's code points as one NumPy array, give the hash
   of every word without each of its code points, in whole-number operations: a word of n code points costs n rows of
   fixed size, however long it is.
2. Radix partition and sort: rows go to partitions by the key's upper bits and are sorted by key, length and place, which
   Spark does with a radix sort that spills.  One pass over the sorted rows keeps those whose key meets another word.
3. Verification: only those rows take their word's string along; what is left of the strings is compared, so no
   collision of hashes can give a link.
4. A word's near words are counted, and the largest of them kept, from the size and the best two of each group of equal
   remainders.  No pair is made.  Such a group holds at most one word for each place and letter that can be put in.
5. A word's form is its near word of the largest count if that is at least ``ratio`` times its own.  Counts grow along
   forms, so there are no cycles, and roots are found by pointer doubling in as many rounds as the logarithm of the
   longest chain.

Defined results: a null or empty text has no runs; a null id counts as the empty string before the colon; repeated rows
count each; equal counts go to the smaller word in code-point order; an empty table gives an empty result.  Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.llm._common import ascii_lower, bounded_batches, materialize, quoted

#: Maximal runs of letters: Latin and Latin-1.
RUNS = r"[A-Za-zÀ-ÿ]+"

#: Rolling hashes are polynomials in this odd number, modulo 2**64.
BASE = 0x9E3779B97F4A7C15

#: Code points that are hashed at a time.
PIECE = 1 << 18

#: Upper bits of a key that choose its partition.
RADIX_BITS = 16


def runs_of(text: Column) -> Column:
    """Array of the lower-cased (A-Z only) runs of letters of a text."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({RUNS})"), F.lit(1))


def misspelt(doc_id: Column, run: Column, one_in: int) -> Column:
    """``run``, without one code point if ``one_in`` divides the checksum of the document's id and the run."""
    checksum = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(checksum, F.length(run).cast("long")).cast("int")
    return F.when(checksum % one_in == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, one_in: int = 97) -> DataFrame:
    """``word`` and ``n``: how often it occurs in all texts, after one run in ``one_in`` has lost a code point."""
    runs = docs.select(F.col(quoted(id_col)).alias("id"), F.explode(runs_of(F.col(quoted(text_col)))).alias("run"))
    # a run of fewer code points than a word can only get shorter
    words = runs.where(F.length("run") >= least_length).select(misspelt(F.col("id"), F.col("run"), one_in).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a polynomial's value over all bits; only its lower bits depend on all code points alike."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, ...]:
    """(word's index, key, length, place) of every word whole (place -1) and without each of its code points.

    The hash of c0 c1 ... is the sum of ci * BASE**i.  A word without place i is the sum before i and the sum behind i
    moved down by one power, so two running sums give all of its keys.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(words)), sizes)
    begins = np.cumsum(sizes) - sizes
    place = np.arange(len(points)) - begins[word]
    powers = np.ones(int(sizes.max(initial=0)) + 1, np.uint64)
    powers[1:] = np.multiply.accumulate(np.full(len(powers) - 1, BASE, np.uint64))
    terms = points * powers[place]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    start, end = sums[begins], sums[begins + sizes]
    prefix = sums[:-1] - start[word]
    suffix = (end[word] - sums[1:]) * np.uint64(pow(BASE, -1, 1 << 64))
    keys = _mixed(np.concatenate([end - start, prefix + suffix]))
    return np.concatenate([np.arange(len(words)), word]), keys, np.concatenate([sizes, sizes[word] - 1]), np.concatenate([np.full(len(words), -1), place])


_KEYS = "id long, radix int, key long, length int, place int, own boolean"


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of each word (columns id, word); ``own``: the first place at which this remainder comes of the word."""
    for batch in batches:
        ids, words = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        piece = np.cumsum([len(w) for w in words]) // PIECE
        for k in np.unique(piece):
            some = np.flatnonzero(piece == k)
            mine = [words[i] for i in some]
            index, keys, length, place = deletion_keys(mine)
            text = np.frombuffer("".join(mine).encode("utf-32-le"), np.uint32)
            at = place[len(mine) :]
            again = (at > 0) & (text == np.concatenate([[0], text[:-1]]))  # a letter's repetition leaves what the first one left
            own = np.concatenate([np.ones(len(mine), bool), ~again])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[some][index]), pa.array((keys >> np.uint64(64 - RADIX_BITS)).astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(length.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(own)],
                ["id", "radix", "key", "length", "place", "own"],
            )


def _meeting(key: np.ndarray, length: np.ndarray, place: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which of some sorted rows, whole groups of equal keys, meet another word: at the same place, or as a whole word."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (length[1:] != length[:-1])
    group = np.cumsum(new) - 1
    fresh = new.copy()
    fresh[1:] |= place[1:] != place[:-1]
    at = np.cumsum(fresh) - 1
    same_place = np.bincount(at)[at] > 1
    n = group[-1] + 1
    wholes = np.bincount(group, place < 0, n) > 0
    parts = np.bincount(group, (place >= 0) & own, n) > 0
    return same_place & (place >= 0) | (wholes & parts)[group] & own


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those that meet another word; the last key of a batch waits for the next batch."""
    names, kept = ["id", "key", "length", "place", "own"], None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]
        if kept is not None:
            columns = [np.concatenate([a, b]) for a, b in zip(kept, columns, strict=True)]
        if not len(columns[0]):
            continue
        changes = np.flatnonzero(columns[1] != columns[1][-1])
        edge = changes[-1] + 1 if len(changes) else 0
        kept = [c[edge:] for c in columns]
        if edge:
            yield _selected([c[:edge] for c in columns])
    if kept is not None and len(kept[0]):
        yield _selected(kept)


def _selected(columns: list[np.ndarray]) -> pa.RecordBatch:
    stays = _meeting(*columns[1:])
    return pa.RecordBatch.from_arrays([pa.array(columns[0][stays]), pa.array(columns[3][stays]), pa.array(columns[4][stays])], ["id", "place", "own"])


def near_words(counted: DataFrame) -> DataFrame:
    """``id``, ``n_near`` and ``best`` (the near word of the largest count, as ``down``, its count negated, and ``word``) of the words (id, word, n) that have one."""
    keys = bounded_batches(counted).select("id", "word").mapInArrow(_emit, _KEYS)
    ordered = keys.repartition("radix").sortWithinPartitions("key", "length", "place")
    found = materialize(ordered.mapInArrow(_candidates, "id long, place int, own boolean"), "variant-candidates")
    rest = F.when(F.col("place") < 0, F.col("word")).otherwise(F.concat(F.substr("word", F.lit(1), F.col("place")), F.substr("word", F.col("place") + 2)))
    named = found.join(counted, "id").select("id", "place", "own", rest.alias("rest"), F.struct((-F.col("n")).alias("down"), F.col("word").alias("word")).alias("me"))
    named = materialize(named, "variant-remainders")
    # replaced: all words of a group are near each other, and each one's best is the first that it is not itself
    group = Window.partitionBy("rest", "place")
    ranked = named.where("place >= 0").withColumns({"k": F.row_number().over(group.orderBy("me")), "c": F.count("*").over(group), "first": F.min("me").over(group)})
    second = F.min(F.when(F.col("k") > 1, F.col("me"))).over(group)
    replaced = ranked.where("c > 1").withColumn("second", second).select("id", (F.col("c") - 1).alias("c"), F.when(F.col("k") > 1, F.col("first")).otherwise(F.col("second")).alias("best"))
    # inserted or deleted: a whole word and the longer words that leave it
    wholes = named.where("place < 0").select("rest", F.col("id").alias("short"), F.col("me").alias("whole"))
    longer = named.where("place >= 0 AND own").join(wholes, "rest")
    grown = longer.groupBy("short").agg(F.count("*").alias("c"), F.min("me").alias("best")).withColumnRenamed("short", "id")
    both = replaced.unionByName(longer.select("id", F.lit(1).cast("long").alias("c"), F.col("whole").alias("best"))).unionByName(grown)
    return both.groupBy("id").agg(F.sum("c").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last that its forms lead to, of words that have a form (columns ``word``, ``form``)."""
    state = materialize(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = state.join(further, "root", "left")
        if joined.where("further IS NOT NULL").isEmpty():
            return state
        state = materialize(joined.select("word", F.coalesce("further", "root").alias("root")), "variant-roots")


def group_words(counted: DataFrame, ratio: int = 2) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of distinct words with their counts (``word``, ``n``)."""
    counted = materialize(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    near = materialize(counted.join(near_words(counted), "id", "left"), "near-words")
    strong = -F.col("best.down") >= ratio * F.col("n")
    judged = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.word")).alias("form"), F.when(strong, -F.col("best.down")).alias("form_n"))
    judged = materialize(judged, "word-forms")
    led = roots(judged.where("form IS NOT NULL"))
    return judged.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, ratio: int = 2, one_in: int = 97) -> DataFrame:
    """Words of all texts, each with its form and root; see ``count_words`` and ``group_words``."""
    return group_words(count_words(docs, id_col, text_col, least_length, least_count, one_in), ratio)
