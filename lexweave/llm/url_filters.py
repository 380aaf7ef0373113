"""URL filters: a blocked Bloom filter in front of an exact hash join.

Listed entries are canonical URLs ``host + path prefix`` (``example.net/en/``); A-Z in an entry's host count as
lower-case.  An entry fits a URL whose host is the entry's or a subdomain of it and whose path starts with the entry's
path.  The longest entry wins, of equally long ones that with the longer host, then ``block`` before ``allow``, then
the entry that sorts last: the order of the list never matters.

Distinct URLs are expanded to the host suffixes that have as many labels as a listed host, which are few.  Suffixes
that are listed bring the lengths of their own paths, so a URL has one candidate for each path length of its own host
and not for each in the list.  A blocked Bloom filter (256-bit blocks, eight bits in one block for a key) passes
possible hits among the candidates; an exact hash join with the list removes the false positives.  The filter is an
ordinary table of blocks, made by a map-side combined ``bit_or``; it, the hosts and the list are broadcast only up to
``BROADCAST_BYTES`` by their own size, and joined by shuffle beyond.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule; repeated rows get
repeated verdicts; an empty list leaves every URL with the default verdict, an empty table gives an empty result.
Columns other than the URL and the kept ones are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm._common import ascii_lower, materialize, quoted

BROADCAST_BYTES = 16 << 20
BLOCK_WORDS = 8
BITS_PER_KEY = 16


def host_of(url: Column) -> Column:
    """From behind the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(_behind_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """From behind the host to ``?``, ``#`` or the end."""
    return F.regexp_extract(_behind_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _behind_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _words(key: Column) -> list[Column]:
    """The bit of a key in each word of its block."""
    h = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(BLOCK_WORDS)]


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("long")


def build_filter(keys: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """Blocks that hold any key, and how many blocks the filter has."""
    n_blocks = max(1, -(-n_keys * BITS_PER_KEY // (32 * BLOCK_WORDS)))
    masks = [w.alias(f"w{i}") for i, w in enumerate(_words(F.col(key)))]
    blocks = keys.select(_block(F.col(key), n_blocks).alias("block"), *masks).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_WORDS)])
    return blocks, n_blocks


def _sized(df: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def possible_hits(candidates: DataFrame, key: str, listed: DataFrame, n_keys: int) -> DataFrame:
    """Candidates whose bits are all set in their block; a few others pass too."""
    blocks, n_blocks = build_filter(listed, key, n_keys)
    masks = [w.alias(f"m{i}") for i, w in enumerate(_words(F.col(key)))]
    probes = candidates.select("*", _block(F.col(key), n_blocks).alias("block"), *masks)
    joined = probes.join(_sized(blocks, n_blocks * 80), "block")
    passed = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}") for i in range(BLOCK_WORDS)])
    return joined.where(passed).select(*candidates.columns)


def listing(spark: SparkSession, rules: list[tuple[str, str]], blocked: list[str]) -> DataFrame:
    """Rules (entry, allow or block) and plainly blocked canonical URLs as one table."""
    rows = [(e, a, True) for e, a in rules] + [(e, "block", False) for e in blocked]
    return spark.createDataFrame(rows, "entry string, action string, is_rule boolean")


def canonical_entries(listed: DataFrame) -> DataFrame:
    """Distinct entries with their parts: ``entry`` as listed, ``key`` (lower-case host and path), ``site``, ``chars`` of the path, ``labels`` of the host."""
    entries = listed.where(F.col("entry").isNotNull()).select("entry", "action", "is_rule").distinct()
    slash = F.instr("entry", "/")
    site = ascii_lower(F.when(slash > 0, F.substring_index("entry", "/", 1)).otherwise(F.col("entry")))
    prefix = F.when(slash > 0, F.substr("entry", slash)).otherwise(F.lit(""))
    named = entries.withColumns({"site": site, "prefix": prefix})
    return named.select("entry", "action", "is_rule", "site", F.length("prefix").alias("chars"), F.size(F.split("site", r"\.")).alias("labels"), F.concat("site", "prefix").alias("key"))


def judge(pages: DataFrame, listed: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """``keep``, host, path, the longest fitting ``rule`` and its ``verdict``; without a rule, ``block`` for a listed URL, else the default.

    ``listed`` has ``entry`` (``host/path-prefix``), ``action`` and ``is_rule``.
    """
    entries = materialize(canonical_entries(listed), "url-entries")
    labels = sorted(r["labels"] for r in entries.select("labels").distinct().collect())  # a host has 127 labels at most
    size = entries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("entry") + F.octet_length("key") + F.octet_length("site")), F.lit(0)).alias("bytes")).first()
    n_bytes = size["bytes"] + 100 * size["n"]
    sites = entries.groupBy("site").agg(F.collect_set("chars").alias("lengths"))  # path lengths of a host: bounded by the longest URL

    url = F.col(quoted(url_col))
    base = pages.select(F.struct(*[F.col(quoted(c)) for c in keep]).alias("_keep"), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = base.where(F.col("host") != "").groupBy("host", "path").agg(F.lit(1).alias("_"))
    made = [F.substring_index("host", ".", -n) for n in labels]
    suffixes = urls.select("host", "path", F.explode(F.array_distinct(F.array(*made) if made else F.array().cast("array<string>"))).alias("site"))
    lengths = suffixes.join(_sized(sites, n_bytes), "site").select("host", "path", "site", F.explode("lengths").alias("chars"))
    candidates = lengths.where(F.length("path") >= F.col("chars")).select("host", "path", F.concat("site", F.substring("path", F.lit(1), F.col("chars"))).alias("key"))
    hits = possible_hits(candidates, "key", entries, size["n"])
    exact = hits.join(_sized(entries, n_bytes), "key")
    rank = F.struct(F.length("key").alias("long"), F.length("site").alias("host_long"), (F.col("action") == "block").alias("blocks"), "entry", "action")
    best = exact.groupBy("host", "path").agg(F.max(F.when(F.col("is_rule"), rank)).alias("_rule"), F.max(~F.col("is_rule")).alias("_listed"))
    best = materialize(best, "url-verdicts")  # a table of its own: broadcast if it is small, else a join that Spark can split
    wide = best.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + F.coalesce(F.octet_length("_rule.entry"), F.lit(0)) + 80), F.lit(0)).alias("bytes")).first()["bytes"]
    judged = base.join(_sized(best, wide), ["host", "path"], "left")
    verdict = F.coalesce(F.col("_rule.action"), F.when(F.col("_listed"), F.lit("block")), F.lit(default))
    return judged.select(*[F.col(f"_keep.{quoted(c)}").alias(c) for c in keep], "host", "path", F.col("_rule.entry").alias("rule"), verdict.alias("verdict"), F.coalesce("_listed", F.lit(False)).alias("listed"))
