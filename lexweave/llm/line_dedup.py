"""Line deduplication with a deletion-neighbourhood join, in DataFrame functions only.

A line is its words (split on ASCII white space).  A line is deleted if an earlier line anywhere in the corpus is equal
to it or near it: one word replaced, inserted or deleted, and at least ``similarity_percent`` % of the words of the
longer line the same, so at 80 % lines of five words and more, and of four words next to one of five.  (One word of a
shorter line is over a fifth of it: no edit is within the bound there, and the search for equal lines finds all.)
Earlier means by document id, then by place in the document.  Deciding against *any* earlier line, deleted
itself or not, makes the result independent of the order in which work is done.

Steps:

1. Equal lines are counted by two 64-bit hashes, of their words before and behind the middle, map-side combined, so
   copies shrink to one row each.
2. Halves: an edit leaves either the first or the second part of the words, cut in the middle, as they are.  Only distinct lines that
   share such a half with another line can have a near one; the rest leave here.
3. Deletion neighbourhood: the remaining lines emit a hashed key for each word left out, and one for the whole.  Keys
   come from running XORs over positioned word hashes, so a line of n words costs n rows and no quadratic work.
4. Equal variants are joined through the earliest line of each key, never as pairs: replaced at the same place, or a
   variant equal to a whole line.  The best partner of each line is verified word by word.

Defined results: blank lines stay and are never compared; a null text stays null; a text whose lines all go becomes
empty; rows with equal id and equal text are one document and keep the same lines; a null id is later than any other;
an empty table gives an empty result.  Other columns pass through whatever their names; one named ``lines_removed`` is
replaced by the result's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexweave.llm._common import let, materialize, quoted, whole_row

#: A list of candidate lines (24 bytes each) is broadcast up to this many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000


#: White space inside a line, besides the space.
_OTHER_SPACE = "\t\x0b\x0c\r"


def line_words(line: Column) -> Column:
    other = reduce(lambda a, b: a | b, [F.contains(line, F.lit(c)) for c in _OTHER_SPACE])
    spaced = F.when(other, F.translate(line, _OTHER_SPACE, " " * len(_OTHER_SPACE))).otherwise(line)
    return F.array_remove(F.split(spaced, " "), "")


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each line: document key, place, line."""
    return docs.select("_id", "_th", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))


def _exploded(docs: DataFrame) -> DataFrame:
    """The lines that are not blank, as words."""
    solid = _lines(docs).where(F.btrim("_line", F.lit(" " + _OTHER_SPACE)) != "")
    return solid.select("_id", "_th", "_pos", line_words(F.col("_line")).alias("_w"))


def _order() -> Column:
    return F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_th").alias("th"), F.col("_pos").alias("pos"))


def _part_keys(size: Column, fewer: int) -> tuple[Column, Column]:
    """Hashes of a line's words before and behind the middle of a line of ``fewer`` words less than ``size``."""
    m = size - fewer
    half = F.floor(m / 2).cast("int")
    # a newline is no word, so the two never meet
    return F.xxhash64(m, F.slice("_w", 1, half)), F.xxhash64(m, F.lit("\n"), F.slice("_w", half + fewer + 1, m - half))


def _hashed(lines: DataFrame) -> DataFrame:
    """A line's identity, ``_h1`` and ``_h2`` of its two parts (64 bits each), its number of words, and the parts ``_a``, ``_z`` that a partner of one word fewer has."""
    first, second = _part_keys(F.size("_w"), 0)
    named = lines.withColumns({"_n": F.size("_w"), "_h1": first, "_h2": second})
    first, second = _part_keys(F.col("_n"), 1)
    return named.withColumns({"_a": first, "_z": second})


def least_words(similarity_percent: int) -> int:
    """Words that the longer of two lines must have for one edit to leave them similar enough."""
    if not 0 <= similarity_percent < 100:
        raise ValueError("the similarity must be from 0 to 99")
    return -(-100 // (100 - similarity_percent))


def _halves(least: int) -> Column:
    """Keys of a line's parts, for partners with as many words or one more, and with one fewer."""
    return F.when(F.col("_n") >= least, F.array("_h1", "_h2", "_a", "_z")).when(F.col("_n") == least - 1, F.array("_h1", "_h2"))


def variants(lines: DataFrame, line_key: list[str], least: int) -> DataFrame:
    """The deletion neighbourhood: ``line_key``, ``_key`` of the remaining words, their number ``_len``, and ``_at``, the place of the word left out (-1: none).

    A line of under ``least`` words has no edit within the bound but to a longer one: it is a variant of itself alone.
    """
    words = lines.select(*line_key, "_n", F.posexplode("_w").alias("_i", "_word"))
    words = words.select(*line_key, "_n", "_i", F.xxhash64("_word", "_i").alias("_f"), F.xxhash64(F.col("_word"), F.col("_i") - 1).alias("_g"))
    own = Window.partitionBy(*line_key).orderBy("_i")
    # XOR of the words before this one, and of those behind it moved forward by one place
    before = F.coalesce(F.bit_xor("_f").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    behind = F.bit_xor("_g").over(Window.partitionBy(*line_key)).bitwiseXOR(F.bit_xor("_g").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    running = words.withColumns({"_b": before, "_z": behind})
    last = F.col("_i") == F.col("_n") - 1
    without = F.struct(F.col("_b").bitwiseXOR(F.col("_z")).alias("_key"), (F.col("_n") - 1).alias("_len"), F.col("_i").alias("_at"))
    whole = F.struct(F.col("_b").bitwiseXOR(F.col("_f")).alias("_key"), F.col("_n").alias("_len"), F.lit(-1).alias("_at"))
    own_variants = F.when(F.col("_n") < least, F.when(last, F.array(whole))).when(last, F.array(without, whole)).otherwise(F.array(without))
    return running.select(*line_key, F.explode(own_variants).alias("_v")).select(*line_key, "_v.*")


def within_one_edit(a: Column, b: Column, at: Column, whole: Column) -> Column:
    """Are two word arrays equal but for one word?  ``at``: the place left out of ``a`` (or of ``b``, if ``whole``)."""

    def without(x):
        return F.concat(F.slice(x, 1, at), F.slice(x, at + 2, F.greatest(F.size(x) - at - 1, F.lit(0))))

    same_size = F.size(a) == F.size(b)
    return F.when(same_size, without(a) == without(b)).when(whole, a == without(b)).otherwise(without(a) == b)


def near_lines(occurrences: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """Hashes of the lines that have an earlier line within the bound; ``least`` as in ``least_words``."""
    firsts = occurrences.where(F.col("_n") >= least - 1).groupBy("_n", "_h1", "_h2").agg(F.min(_order()).alias("_o"), F.any_value("_a").alias("_a"), F.any_value("_z").alias("_z"))
    keys = firsts.select("_h1", "_h2", "_o", F.explode(_halves(least)).alias("_half"))
    shared = keys.groupBy("_half").agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("_h1", "_h2") for f in (F.min, F.max)]).where("_h1_min <> _h1_max OR _h2_min <> _h2_max").select("_half")
    candidates = keys.join(shared, "_half").groupBy("_h1", "_h2").agg(F.any_value("_o").alias("_o"))
    candidates = materialize(candidates.select("_h1", "_h2", "_o"), "line-candidates")
    if candidates.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(candidates)
    else:
        wanted = candidates
    wanted = wanted.select("_h1", "_h2", "_o", F.col("_o.id").alias("_id"), F.col("_o.th").alias("_th"), F.col("_o.pos").alias("_pos"))
    on = [F.col("l._id").eqNullSafe(F.col("c._id")), F.col("l._th") == F.col("c._th"), F.col("l._pos") == F.col("c._pos")]
    texts = _lines(docs).alias("l").join(wanted.alias("c"), on).select("c._h1", "c._h2", "c._o", line_words(F.col("l._line")).alias("_w"))
    texts = materialize(texts.dropDuplicates(["_h1", "_h2"]), "line-texts")

    line = ["_h1", "_h2", "_o"]
    made = materialize(variants(texts.withColumn("_n", F.size("_w")), line, least), "line-variants")
    least = made.groupBy("_key", "_len").agg(F.count("*").alias("_c"), F.min(F.when(F.col("_at") < 0, F.col("_o"))).alias("_whole"), F.min(F.when(F.col("_at") >= 0, F.struct("_o", "_at"))).alias("_part")).where("_c > 1")
    placed = made.where("_at >= 0").groupBy("_key", "_len", "_at").agg(F.count("*").alias("_c"), F.min("_o").alias("_same")).where("_c > 1").drop("_c")
    met = made.join(least, ["_key", "_len"]).select(
        *line,
        F.when(F.col("_at") < 0, F.struct(F.col("_part._o").alias("o"), F.col("_part._at").alias("at"), F.lit(True).alias("whole")))
        .otherwise(F.struct(F.col("_whole").alias("o"), F.col("_at").alias("at"), F.lit(False).alias("whole"))).alias("_p"),
    )
    replaced = made.where("_at >= 0").join(placed, ["_key", "_len", "_at"]).select(*line, F.struct(F.col("_same").alias("o"), F.col("_at").alias("at"), F.lit(False).alias("whole")).alias("_p"))
    best = met.unionByName(replaced).where("_p.o < _o").groupBy("_h1", "_h2").agg(F.min("_p").alias("_p"))
    mine = best.join(texts.select("_h1", "_h2", F.col("_w").alias("_a")), ["_h1", "_h2"]).withColumn("_po", F.col("_p.o"))
    pairs = mine.join(texts.select(F.col("_o").alias("_po"), F.col("_w").alias("_b")), "_po")
    return pairs.where(within_one_edit(F.col("_a"), F.col("_b"), F.col("_p.at"), F.col("_p.whole"))).select("_h1", "_h2")


def removed_lines(keyed: DataFrame, similarity_percent: int = 80) -> DataFrame:
    """By document (``_id``, ``_th``), the places ``_gone`` of the lines to delete; ``keyed`` also has ``_text``."""
    least = least_words(similarity_percent)
    occurrences = materialize(_hashed(_exploded(keyed)).drop("_w"), "lines")
    near = materialize(near_lines(occurrences, keyed, least), "near-lines").withColumn("_near", F.lit(True))
    groups = occurrences.groupBy("_h1", "_h2").agg(F.min(_order()).alias("_o"), F.count("*").alias("_c"))
    marked = groups.join(near, ["_h1", "_h2"], "left").where("_c > 1 OR _near").select("_h1", "_h2", "_o", "_near")
    marked = materialize(marked, "marked-lines")  # a table of its own: Spark can split a frequent line's occurrences in the join
    gone = occurrences.select("_h1", "_h2", "_id", "_th", "_pos").join(marked, ["_h1", "_h2"]).where(F.col("_near").isNotNull() | (_order() > F.col("_o")))
    return gone.groupBy("_id", "_th").agg(F.collect_set("_pos").alias("_gone"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity_percent: int = 80) -> DataFrame:
    """Every row and column of ``df``, with the repeated lines taken out of its text, and ``lines_removed``."""
    text = F.col(quoted(text_col))
    docs = df.select(whole_row(df).alias("_row"), F.col(quoted(id_col)).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    gone = removed_lines(docs.select("_id", "_th", "_text"), similarity_percent).withColumnsRenamed({"_id": "_gid", "_th": "_gth"})
    joined = docs.join(gone, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_th") == F.col("_gth")), "left")
    rest = let(F.split("_text", "\n"), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone")), lambda i: F.get(lines, i)), "\n"))
    left = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(rest).cast(T.StringType())
    out = [left.alias(c) if c == text_col else F.col(f"_row.{quoted(c)}").alias(c) for c in df.columns if c.lower() != "lines_removed"]
    return joined.select(*out, F.coalesce(F.size("_gone"), F.lit(0)).alias("lines_removed"))
