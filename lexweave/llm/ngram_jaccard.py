"""N-gram Jaccard join with PartEnum signatures.

Documents link when the sets of their ``width``-word shingles have a Jaccard similarity of at least
``percent`` / 100; the result is the connected components of these links.  Nothing is sampled or capped: hashes of
shingles have 64 bits, and every link between different sets is found.

1. Sets.  Rows are reduced to (number of shingles, 128-bit digest of the set, parity sketch); equal sets become one
   class with a map-side combined count, so thousands of copies cost one row.
2. PartEnum.  Set sizes form bands such that similar sets lie in one band or in two neighbours; each set takes part in
   the instance of its band and of the band below.  Two similar sets of an instance differ in at most k shingles.  The
   shingle domain is partitioned by hash into k + 1 + m parts, and a signature is the content of one part: the subset
   enumeration of PartEnum with one part to a subset.  Similar sets agree on at least m + 1 parts.
3. Groups.  Rows meet by signature, sorted; of those of one task only the distinct sets of classes that share one go on.
   A signature shared by at most ``HOT`` classes gives candidates.  A more frequent one (passages that many
   documents share) is *hot*, and so is every empty part, which is therefore never sent.  As similar sets agree on m + 1 parts, a set with at most m hot signatures in
   an instance agrees with each partner on one that is not hot, so hot groups are needed for the others only.
4. Those others (*deep* classes) are joined exactly among themselves by their rarest shingles, as a fixed number of
   buckets counts them: similar sets share one of their ``s - ceil(0.8 s) + 1`` rarest, and a pair counts only if so many shingles can still be common behind the
   place of the shared one.
5. Candidates are compared with one class of their group, in a few rounds with another each; what is then still in
   different components of one group is compared too.  No pair inside a component is made, so a group of mutual copies costs a star.
6. A pair is dropped early if the parities of buckets, at least as many as a set has shingles, differ in more places than
   similar sets can, so that this tells as much of long texts as of short ones; the others are verified on their full sets,
   which are made where a pair's packed texts meet: a packed text is a third of the hashes of its shingles.

Defined results: null, empty or blank texts have no shingles and link with nothing; repeated rows and rows with equal
ids are each returned; a null id takes the smallest id of its component (null if there is none).

Intermediate tables are removed as soon as nothing reads them any more.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm._common import bounded_batches, free_names, materialize, pieces, quoted, text_bytes
from lexweave.llm._components import components
from lexweave.operators.tables import remove, run_dir

HOT = 8
#: Tag of a row that says that a class has too many empty parts.
DEEP = -1
#: Words of 64 buckets in the smallest parity sketch.
PARITY_WORDS = 4
#: Shingles of deep classes are counted in so many buckets (2 MB); any order of shingles keeps the join exact, this one keeps it small.
BUCKET_BITS = 18
#: Rounds of comparing the classes of a group with one of them, another in each round.
STAR_ROUNDS = 2
BROADCAST_ROWS = 1_000_000
#: Signatures that a task looks at together.
ROWS_AT_ONCE = 500_000
#: Words whose hashes a task keeps.
MAX_WORDS_KEPT = 150_000
_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX1
    h = (h ^ (h >> np.uint64(33))) * _MIX2
    return h ^ (h >> np.uint64(33))


class ShingleHasher:
    """Sorted distinct 64-bit hashes of a text's shingles; hashes of frequent words are kept, up to a bound."""

    def __init__(self, width: int = 5):
        self.width = width
        self.words: dict[bytes, int] = {}
        self.powers = mix(np.arange(1, width + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)

    def hashes(self, text: bytes) -> np.ndarray:
        parts = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
        kept = self.words
        if len(kept) > MAX_WORDS_KEPT:
            kept.clear()
        for w in set(parts).difference(kept):
            kept[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(kept.__getitem__, parts), np.uint64, len(parts))
        if not len(h):
            return h
        n = min(self.width, len(h))
        s = h[: len(h) - n + 1] * self.powers[0]
        for i in range(1, n):
            s = s + h[i : len(h) - n + 1 + i] * self.powers[i]
        return np.unique(mix(s + np.uint64(n)))


def digest(u: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    d = xxhash.xxh3_128_intdigest(u.tobytes())
    return (d & (1 << 64) - 1) - (1 << 63), (d >> 64) - (1 << 63)


def parity(u: np.ndarray) -> np.ndarray:
    """Whether a bucket holds an odd number of the set's elements, for as many buckets as the next power of two; half as many are the exclusive or of both halves."""
    buckets = max(64 * PARITY_WORDS, 1 << (len(u) - 1).bit_length())
    odd = np.bincount((u & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(marks, other):
    """A parity sketch in as few words as the other one; sketches of similar sets differ in length by half at most."""
    n = F.size(other)
    return F.when(F.size(marks) > n, F.zip_with(F.slice(marks, F.lit(1), n), F.slice(marks, n + 1, n), lambda x, y: x.bitwiseXOR(y))).otherwise(marks)


def least_shared(a: int, b: int, percent: int) -> int:
    """Elements that sets of a and b elements must share at least to be similar."""
    return -(-percent * (a + b) // (100 + percent))


class Bands:
    """Size bands, and for the instance of each the most differences that two similar sets of it can have."""

    def __init__(self, percent: int = 80):
        self.percent = percent
        self.low = [1]

    def of(self, size: int) -> int:
        while self.low[-1] <= size:
            last = self.low[-1]
            self.low.append(max(last + 1, (last - 1) * 100 // self.percent + 1))
        return int(np.searchsorted(self.low, size, side="right")) - 1

    @lru_cache(maxsize=None)  # noqa: B019
    def differences(self, band: int) -> int:
        self.of(self.low[-1] + 1 if band + 1 >= len(self.low) else 1)
        most = 0
        top = self.low[band + 1] - 1
        for a in range(max(1, top - 10), top + 1):
            for b in range(max(a, a * 100 // self.percent - 10), a * 100 // self.percent + 1):
                most = max(most, a + b - 2 * least_shared(a, b, self.percent))
        return most

    def spare(self, band: int) -> int:
        return (self.differences(band) + 1) // 4


def signatures(u: np.ndarray, instance: int, parts: int) -> np.ndarray:
    """The hashed content of each part of the domain that holds a shingle; an empty part is the same for all sets and tells nothing."""
    h = mix(u ^ _GOLDEN)
    at = (h % np.uint64(parts)).astype(np.int64)
    content = np.zeros(parts, np.uint64)
    np.add.at(content, at, mix(h * _GOLDEN))
    held = np.flatnonzero(np.bincount(at, minlength=parts))
    return mix(content[held] + np.full(1, instance + 1, np.uint64) * _MIX2 + held.astype(np.uint64) * _GOLDEN).view(np.int64)


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(width)
        for batch in pieces(batches):
            n, d1, d2, marks = [], [], [], []
            for t in text_bytes(batch.column(2).to_pylist()):
                u = hasher.hashes(t)
                n.append(len(u))
                x, y = digest(u)
                d1.append(x)
                d2.append(y)
                marks.append(parity(u).tolist())
            arrays = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(marks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["_id", "_th", "_n", "_d1", "_d2", "_marks"])

    return run


def _signature_rows(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bands = ShingleHasher(width), Bands(percent)
        for batch in pieces(batches):
            cids, sigs, tags = [], [], []
            for cid, t in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1).to_pylist()), strict=True):
                u = hasher.hashes(t)
                own = bands.of(len(u))
                for which, instance in enumerate((own, own - 1)):
                    if instance < 0:
                        continue
                    spare, parts = bands.spare(instance), bands.differences(instance) + 1
                    s = signatures(u, instance, parts + spare)
                    spare -= parts + spare - len(s)  # empty parts are hot without being counted
                    if spare < 0:
                        s = np.append(s, np.int64(cid))
                    sigs.append(s)
                    cids.append(np.full(len(s), cid, np.int64))
                    tags.append(np.full(len(s), 2 * max(spare, 0) + which, np.int32))
                    if spare < 0:
                        tags[-1][-1] = DEEP
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sigs, cids, tags)], ["_sig", "_cid", "_tag"])

    return run


def _shared_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of ``_sig`` and ``_cid``: the classes of each signature that 2 to ``HOT`` of them have (no tag), and one by one those of a hot signature (with their tag)."""

    def rows(cids, tags):
        lengths = pa.array(np.concatenate([[0], np.cumsum([c.shape[1] for c in cids for _ in range(len(c))])]).astype(np.int32))
        flat = pa.array(np.concatenate([c.ravel() for c in cids]) if cids else np.zeros(0, np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(lengths, flat), tags], ["_cids", "_tag"])

    def gathered():
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            n += batch.num_rows
            if n >= ROWS_AT_ONCE:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, n = [], 0
        if held:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
        yield None

    over, hot_row = [np.zeros(0, np.int64)] * 3, None
    for part in gathered():
        sig, cid, tag = over if part is None else (np.concatenate(x) for x in zip(over, part, strict=True))
        deep = tag == DEEP
        alone = cid[deep]
        sig, cid, tag = sig[~deep], cid[~deep], tag[~deep]
        if len(sig):  # repeated rows have their class's signatures again
            new = np.concatenate([[hot_row != (sig[0], cid[0])], (sig[1:] != sig[:-1]) | (cid[1:] != cid[:-1])])
            sig, cid, tag = sig[new], cid[new], tag[new]
        begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        count = np.diff(np.append(begin, len(sig)))
        is_hot = (count > HOT) | (sig[begin] == hot_row[0] if hot_row else False)
        ended = np.ones(len(begin), bool)
        over = [np.zeros(0, np.int64)] * 3
        if len(begin) and part is not None:
            # the last signature may go on: a hot one is remembered, the few rows of another wait
            hot_row = (sig[-1], cid[-1]) if is_hot[-1] else None
            if not is_hot[-1]:
                ended[-1] = False
                over = [x[begin[-1] :] for x in (sig, cid, tag)]
        cids = []
        for size in range(2, HOT + 1):
            of = begin[ended & ~is_hot & (count == size)]
            if len(of):
                several = cid[of[:, None] + np.arange(size)]
                _, first = np.unique(mix((several.astype(np.uint64) * (mix(np.arange(1, size + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1))).sum(axis=1, dtype=np.uint64)), return_index=True)
                cids.append(several[first])
        hot = np.repeat(is_hot, count)
        tags = np.concatenate([np.full(len(alone), DEEP, np.int32), tag[hot].astype(np.int32)])
        ones = np.concatenate([alone, cid[hot]])
        n = sum(map(len, cids))
        if n or len(ones):
            yield rows([*cids, ones[:, None]], pa.array(np.concatenate([np.zeros(n, np.int32), tags]), pa.int32(), mask=np.arange(n + len(ones)) < n))


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in pieces(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(t) for t in text_bytes(batch.column(1).to_pylist())], pa.binary())], ["_cid", "_pack"])


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(width)
        for batch in pieces(batches):
            sets = [hasher.hashes(t).tobytes() for t in text_bytes(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["_cid", "_set"])

    return run


def _bucket(u: np.ndarray) -> np.ndarray:
    return (mix(u) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of shingles that a task has met twice or more, with their counts."""
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        for data in batch.column(1):
            np.add.at(counts, _bucket(np.frombuffer(data.as_py(), np.uint64)), 1)
    met = np.flatnonzero(counts > 1)
    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], ["bucket", "count"])


def _prefixes(shipped, percent: int):
    """The rarest shingles of each set, by their bucket's count and then their hash, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shipped.value
        for batch in batches:
            for cid, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                u = np.frombuffer(data.as_py(), np.uint64)
                n = len(u)
                first = u[np.lexsort((u, counts[_bucket(u)]))][: n + percent * n // -100 + 1]
                yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(np.full(len(first), cid, np.int64)), pa.array(np.full(len(first), n, np.int64)), pa.array(np.arange(1, len(first) + 1, dtype=np.int32))], ["_key", "_cid", "_n", "_place"])

    return run


def _verify(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, unpack = ShingleHasher(width), zstandard.ZstdDecompressor().decompress
        for batch in pieces(batches):
            a, b, keep, sets = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], {}
            for x, y, p, q in zip(a, b, batch.column(2), batch.column(3), strict=True):
                for cid, data in ((x, p), (y, q)):
                    if cid not in sets:
                        sets[cid] = hasher.hashes(unpack(data.as_py()))
                u, v = sets[x], sets[y]
                shared = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * shared >= percent * (len(u) + len(v) - shared))
            kept = pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield kept

    return run


class _Join:
    """State of one join: classes and the texts behind them."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.width, self.percent = width, percent
        self.docs = docs
        self.folder = f"ngram-jaccard-{uuid.uuid4().hex}"
        self.rows = self.table(docs.mapInArrow(_set_rows(width), f"_id {docs.schema['_id'].dataType.simpleString()}, _th long, _n long, _d1 long, _d2 long, _marks array<long>"), "shingle-sets")
        grouped = self.rows.where("_n > 0").groupBy("_n", "_d1", "_d2").agg(F.min("_id").alias("_least"), F.min(F.struct("_id", "_th")).alias("_row"), F.any_value("_marks").alias("_marks"))
        self.classes = self.table(grouped.withColumn("_cid", F.monotonically_increasing_id()), "classes")
        self.sketches = self.classes.select("_cid", "_n", "_marks")

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """A table of this join's; those of a subfolder go with it, all of them with the join."""
        return materialize(df, f"{self.folder}/{name}")

    def drop(self, folder: str = "") -> None:
        spark = self.docs.sparkSession
        remove(spark, f"{run_dir(spark)}/{self.folder}/{folder}".rstrip("/"))

    def texts(self, cids: DataFrame | None = None) -> DataFrame:
        """A text of each class."""
        wanted = self.classes if cids is None else self.classes.join(cids, "_cid", "left_semi")
        wanted = wanted.select("_cid", F.col("_row._id").alias("_rid"), F.col("_row._th").alias("_rth"))
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        return self.docs.join(wanted, F.col("_id").eqNullSafe(F.col("_rid")) & F.col("_th").eqNullSafe(F.col("_rth"))).select("_cid", "_text")

    def groups(self) -> DataFrame:
        """Candidate groups: ``_key`` and ``_cid``."""
        signed = self.texts().mapInArrow(_signature_rows(self.width, self.percent), "_sig long, _cid long, _tag int")
        # close copies meet under hundreds of signatures: groups of the same classes, at most HOT each, count once
        met = signed.repartition("_sig").sortWithinPartitions("_sig", "_cid").mapInArrow(_shared_signatures, "_cids array<long>, _tag int")
        shared = self.table(met.groupBy("_cids", "_tag").agg(F.count("*").alias("_hot")), "groups/shared-signatures")
        deep = shared.where("_hot > shiftright(_tag, 1)").select(F.col("_cids")[0].alias("_cid")).distinct()
        deep = self.table(deep, "groups/deep-classes")
        sets = self.table(self.texts(deep).mapInArrow(_full_sets(self.width), "_cid long, _set binary").dropDuplicates(["_cid"]), "groups/deep-sets")
        met = sets.mapInArrow(_bucket_counts, "bucket long, count long").groupBy("bucket").agg(F.sum("count").alias("count"))
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for r in met.collect():  # a row for each bucket at most
            counts[r["bucket"]] = r["count"]
        prefix = sets.mapInArrow(_prefixes(sets.sparkSession.sparkContext.broadcast(counts), self.percent), "_key long, _cid long, _n long, _place int")
        usual = shared.where("_tag IS NULL").select(F.xxhash64("_cids").alias("_key"), F.explode("_cids").alias("_cid"))
        usual = usual.distinct().join(self.sketches.select("_cid", "_n"), "_cid").withColumn("_place", F.lit(0))
        columns = ["_key", "_cid", "_n", "_place"]
        found = self.table(usual.select(columns).unionByName(prefix), "candidate-groups")
        self.drop("groups")
        return found

    def reachable(self, a: str, b: str):
        """Can sets of these sizes whose rarest common shingle stands at these places share enough?  Place 0: unknown."""
        rest = F.least(F.col(f"{a}_n") - F.col(f"{a}_place"), F.col(f"{b}_n") - F.col(f"{b}_place"))
        return 1 + rest >= F.ceil((F.col(f"{a}_n") + F.col(f"{b}_n")) * self.percent / F.lit(100 + self.percent))

    def similar(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a < b) whose sets are similar enough."""
        one = self.sketches.select(F.col("_cid").alias("a"), F.col("_n").alias("_na"), F.col("_marks").alias("_ma"))
        two = self.sketches.select(F.col("_cid").alias("b"), F.col("_n").alias("_nb"), F.col("_marks").alias("_mb"))
        differ = F.aggregate(F.zip_with(folded(F.col("_ma"), F.col("_mb")), folded(F.col("_mb"), F.col("_ma")), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        total = F.col("_na") + F.col("_nb")
        most = total - 2 * F.ceil(total * self.percent / F.lit(100 + self.percent))
        close = F.least("_na", "_nb") * 100 >= F.greatest("_na", "_nb") * self.percent
        kept = self.table(pairs.join(one, "a").join(two, "b").where(close & (differ <= most)).select("a", "b"), "similar/close-pairs")
        ids = kept.select(F.col("a").alias("_cid")).union(kept.select("b")).distinct()
        texts = self.table(self.texts(ids).mapInArrow(_packed_texts, "_cid long, _pack binary"), "similar/pair-texts")
        texts = texts.dropDuplicates(["_cid"])  # by the same shuffle for both sides of the join
        both = kept.join(texts.select(F.col("_cid").alias("a"), F.col("_pack").alias("_pa")), "a").join(texts.select(F.col("_cid").alias("b"), F.col("_pack").alias("_pb")), "b")
        links = self.table(both.select("a", "b", "_pa", "_pb").mapInArrow(_verify(self.width, self.percent), "a long, b long"), "links")
        self.drop("similar")
        return links

    def links(self) -> DataFrame:
        """Links that connect whatever similar sets are connected: stars first, then what stars leave open."""
        open_ = self.groups().withColumn("_comp", F.col("_cid"))
        links = tried = None
        for r in range(STAR_ROUNDS):
            # few rarer shingles before the shared one: a text close to what its group has in common
            first = F.col("_place") if r % 2 == 0 else F.lit(0)
            centre = open_.groupBy("_key").agg(F.min(F.struct(first.alias("p"), F.xxhash64("_cid", F.lit(r)).alias("h"), F.col("_cid").alias("c"), "_comp", "_n", "_place")).alias("_x"))
            centre = centre.select("_key", *[F.col(f"_x.{c}").alias(f"_x{c}") for c in ("c", "_comp", "_n", "_place")])
            members = open_.withColumnsRenamed({"_n": "_m_n", "_place": "_m_place"})
            spokes = members.join(centre, "_key").where((F.col("_comp") != F.col("_x_comp")) & self.reachable("_m", "_x"))
            stars = spokes.select(F.least("_cid", "_xc").alias("a"), F.greatest("_cid", "_xc").alias("b")).distinct()
            stars = self.table(stars if tried is None else stars.join(tried, ["a", "b"], "left_anti"), "star-pairs")
            own = self.similar(stars)
            tried = stars if tried is None else tried.unionByName(stars)
            links = own if links is None else links.unionByName(own)
            found = components(links).withColumnsRenamed({"id": "_cid", "component": "_found"})
            labelled = open_.drop("_comp").join(found, "_cid", "left").withColumn("_comp", F.coalesce("_found", "_cid")).drop("_found")
            mixed = labelled.groupBy("_key").agg(F.min("_comp").alias("_lo"), F.max("_comp").alias("_hi")).where("_lo < _hi").select("_key")
            open_ = self.table(labelled.join(mixed, "_key", "left_semi"), "open-groups")
        one, two = (open_.select("_key", F.col("_cid").alias(c), *[F.col(x).alias(f"{c}{x}") for x in ("_comp", "_n", "_place")]) for c in "ab")
        rest = one.join(two, "_key").where((F.col("a") < F.col("b")) & (F.col("a_comp") != F.col("b_comp")) & self.reachable("a", "b")).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
        return links.unionByName(self.similar(rest))


def _component_rows(df: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    text = F.col(quoted(text_col))
    docs = bounded_batches(df).select(F.col(quoted(id_col)).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    join = _Join(docs, width, percent)
    found = components(join.links()).withColumnsRenamed({"id": "_cid", "component": "_comp"})
    classes = join.classes.select("_cid", "_n", "_d1", "_d2", "_least").join(found, "_cid", "left").withColumn("_comp", F.coalesce("_comp", "_cid"))
    lowest = classes.groupBy("_comp").agg(F.min("_least").alias("_component_id"))
    named = classes.join(lowest, "_comp").select("_n", "_d1", "_d2", "_component_id")
    joined = join.rows.select("_id", "_th", "_n", "_d1", "_d2").join(named, ["_n", "_d1", "_d2"], "left")
    own = F.when(F.col("_n") > 0, F.col("_component_id")).otherwise(F.col("_id"))
    found = materialize(joined.select("_id", "_th", "_n", own.alias("_component_id")), "component-rows")
    join.drop()
    return found


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the smallest id that links lead to, its own included) of every row."""
    found = _component_rows(df, id_col, text_col, width, percent)
    return found.select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.col("_component_id").alias("component_id"))


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its component; every column kept.

    Rows with equal id and text are one document and stay together; a row with a null id goes if it links with one that has an id.
    """
    gone = _component_rows(df, id_col, text_col, width, percent).where(~F.col("_id").eqNullSafe(F.col("_component_id")))
    one, two = free_names(df, "_gone_id", "_gone_th")
    gone = gone.select(F.col("_id").alias(one), F.col("_th").alias(two)).distinct()
    return df.join(gone, F.col(quoted(id_col)).eqNullSafe(F.col(one)) & (F.xxhash64(F.col(quoted(text_col))) == F.col(two)), "left_anti")


def first_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``id`` and ``text_hash`` (xxhash64), once each, of the rows that ``keep_one_of_each`` keeps, without their texts."""
    first = _component_rows(df, id_col, text_col, width, percent).where(F.col("_id").eqNullSafe(F.col("_component_id")))
    return first.select(F.col("_id").alias("id"), F.col("_th").alias("text_hash")).distinct()
