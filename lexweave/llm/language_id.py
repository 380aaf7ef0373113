"""Language identification by compression with per-language dictionaries.

Each language has ``shards`` raw-content zstandard dictionaries made of labelled text.  A text is compressed with all of
every language's dictionaries, in blocks of ``block`` bytes so that the dictionary counts along the whole text, and the
language with the smallest total wins.  The relative margin to the second smallest is the score; a text whose score is
under ``min_margin`` is rejected.  All texts, short and long, meet the same dictionaries with the same match search.

Fitting uses a bounded sample: for each language the ``sample_rows`` distinct labelled texts of smallest hash for a
dictionary, and of each at most ``piece_bytes`` normalised bytes at a place given by the hash.  Everything else reads
whole texts.  Prediction is a map over rows: no shuffle, and the dictionaries (languages x shards x 128 KB at the
defaults) are the only data shipped to tasks.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; with nothing learned so
is every text.  Ties go to the language with more labelled distinct texts, then by name.  Repeated rows get repeated
results; an empty table gives an empty result.  Other columns are not read; of those that are kept, any named like a
result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm._common import bounded_batches, free_names, quoted

UNKNOWN = "und"
MAX_LANGUAGES = 400
#: A-Z to a-z, other ASCII but letters to spaces; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalise(text: str) -> bytes:
    """Lower-case words between single spaces, with one before the first and behind the last."""
    return b" %b " % b" ".join(text.lower().encode("utf-8").translate(_FOLD).split())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    """Dictionaries by language, in order of preference at ties."""

    dictionaries: dict[str, list[bytes]]
    block: int = 4096
    min_margin: float = 0.01
    _ready: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_ready": []}

    def _compressors(self) -> list:
        if not self._ready:
            import zstandard

            # greedy search for matches of four bytes or more, with tables that hold a whole dictionary
            search = zstandard.ZstdCompressionParameters(window_log=18, hash_log=16, chain_log=17, search_log=1, min_match=4, target_length=16, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)

            def ready(content: bytes):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=search)
                return zstandard.ZstdCompressor(dict_data=d, compression_params=search)

            self._ready += [(name, [ready(c).compress for c in contents]) for name, contents in self.dictionaries.items()]
        return self._ready

    def sizes(self, data: bytes) -> list[tuple[int, str]]:
        """Compressed bytes by language, over all its dictionaries."""
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        return [(sum(len(compress(b)) for compress in many for b in blocks), name) for name, many in self._compressors()]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the text is rejected."""
        if not text or not self.dictionaries or not has_letter(text):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(normalise(text))
        (least, name), *rest = sorted(sizes, key=lambda x: x[0])  # stable: ties keep the order of preference
        score = (rest[0][0] - least) / rest[0][0] if rest else 1.0
        return name, score, score < self.min_margin


def held_out(doc_id: Column) -> Column:
    """Rows kept out of fitting: crc32 of the id's decimal text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _least_hashes(keys: DataFrame, counts: dict[str, int], most: int) -> list[tuple[str, int]]:
    """The ``most`` smallest hashes of each language.

    Hashes are spread evenly, so a cut at twice the share that is needed leaves about twice as many rows to collect and
    needs no language in one task; where it leaves too few, it is moved.
    """
    out, wide = [], 2.0
    left = dict(counts)
    while left:
        cut = F.create_map(*[F.lit(x) for name, n in left.items() for x in (name, min(1.0, wide * most / n))])
        found: dict[str, list[int]] = {name: [] for name in left}
        for r in keys.where(F.col("h") / F.lit(2.0**64) + 0.5 <= cut[F.col("l")]).collect():
            found[r["l"]].append(r["h"])
        for name, own in found.items():
            if len(own) >= min(most, left[name]):
                out += [(name, h) for h in sorted(own)[:most]]
                del left[name]
        wide *= 4
    return out


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = 256, piece_bytes: int = 512, shards: int = 3, **settings) -> LanguageModel:
    """Learn dictionaries from labelled rows; ``sample_rows`` is for each dictionary of a language."""
    rows = labelled.select(F.col(quoted(text_col)).alias("t"), F.col(quoted(lang_col)).alias("l")).where(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}")).withColumn("h", F.xxhash64("t"))
    keys = rows.select("l", "h").distinct().persist()
    try:
        counts = {r["l"]: r["n"] for r in keys.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(MAX_LANGUAGES + 1).collect()}
        if len(counts) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} labels: not languages")
        picked = _least_hashes(keys, counts, sample_rows * shards)
    finally:
        keys.unpersist()
    if not picked:
        return LanguageModel({}, **settings)
    wide = 4 * piece_bytes
    chosen = F.broadcast(rows.sparkSession.createDataFrame(picked, "l string, h long"))
    start = F.expr(f"cast(1 + pmod(h, greatest(char_length(t) - {wide}, 1)) as int)")
    pieces = rows.join(chosen, ["l", "h"]).select("l", "h", F.substr("t", start, F.lit(wide)).alias("p")).groupBy("l", "h").agg(F.first("p").alias("p")).collect()
    by: dict[str, list[tuple[int, bytes]]] = {name: [] for name in counts}
    for r in pieces:
        by[r["l"]].append((r["h"], normalise(r["p"]).strip()[:piece_bytes]))
    return LanguageModel({name: [b"\n".join(p for _, p in sorted(own)[k::shards]) or b" " * 8 for k in range(shards)] for name, own in by.items()}, **settings)


def predict(df: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` (every column but the results', if not given) with ``lang_pred``, ``score`` and ``rejected``.

    Only the text goes to Python and only the verdict comes back; the other columns wait in the JVM.
    """
    new = ["lang_pred", "score", "rejected"]
    names = [c for c in (keep or df.columns) if c.lower() not in new]
    shipped = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shipped.value
        for array in texts:
            found = [own.predict(v.as_py()) for v in array]
            langs, scores, out = zip(*found, strict=True) if found else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], names=new)

    kept = [F.col(quoted(c)) for c in names]
    (verdict,) = free_names(df, "_verdict")
    judged = bounded_batches(df).select(*kept, judge(F.col(quoted(text_col))).alias(verdict))
    return judged.select(*kept, *[F.col(f"{verdict}.{c}") for c in new])
