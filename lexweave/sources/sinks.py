"""Sinks: versioned directories with a pointer, so that readers see the old table or the new one, never a mixture."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators.tables import shuffles_removed


class IndexNotFoundError(Exception):
    """There is no index."""


class StaleIndexError(Exception):
    """The index was built from other chunks."""


class InconsistentIndexError(Exception):
    """The parts of an index disagree."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _pointers(spark: SparkSession, root: str) -> list[str]:
    """Names of the pointer files, the newest last."""
    fs, p, jvm = _fs(spark, root)
    if not fs.exists(p):
        return []
    return sorted(n for x in fs.listStatus(p) if re.fullmatch(r"CURRENT-\d{12}", n := x.getPath().getName()))


def write_pointer(spark: SparkSession, root: str, value: dict) -> None:
    """A further pointer file; the one of the highest number counts.

    It appears by one rename and none is replaced, so there is a whole pointer at every moment, on any file system that
    Spark can write.  Of two writers at once the rename of one fails, and it takes the next number.  Older ones than the
    former pointer go, as do the versions that only they named.
    """
    fs, _, jvm = _fs(spark, root)
    path = jvm.org.apache.hadoop.fs.Path
    temp = path(f"{root}/_POINTER-{uuid.uuid4().hex}")
    out = fs.create(temp)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()
    for _ in range(100):
        known = _pointers(spark, root)
        number = int(known[-1][8:]) + 1 if known else 1
        final = path(f"{root}/CURRENT-{number:012d}")
        if not fs.exists(final) and fs.rename(temp, final):
            break
    else:
        raise OSError(f"{root}: no pointer could be written")
    kept = {_read(spark, root, n).get("version") for n in known[-1:]} | {value.get("version")}
    for name in known[:-1]:
        version = _read(spark, root, name).get("version")
        if version and version not in kept:
            fs.delete(path(f"{root}/{version}"), True)
        fs.delete(path(f"{root}/{name}"), False)


def _read(spark: SparkSession, root: str, name: str) -> dict:
    fs, _, jvm = _fs(spark, root)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{root}/{name}"))
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read_pointer(spark: SparkSession, root: str) -> dict:
    known = _pointers(spark, root)
    if not known:
        raise IndexNotFoundError(root)
    return _read(spark, root, known[-1])


def store_upload(spark: SparkSession, root: str, content: bytes, suffix: str = ".pdf") -> str:
    """Write an accepted upload under its content's hash, by a rename; equal files are one."""
    fs, _, jvm = _fs(spark, root)
    path = jvm.org.apache.hadoop.fs.Path
    final = path(f"{root}/{hashlib.sha256(content).hexdigest()}{suffix}")
    if not fs.exists(final):
        temp = path(f"{root}/_upload-{uuid.uuid4().hex}")
        out = fs.create(temp)
        out.write(bytearray(content))
        out.close()
        if not fs.rename(temp, final) and not fs.exists(final):
            raise OSError(f"{final} could not be written")
        fs.delete(temp, False)
    return final.toString()


def publish(tables: dict[str, DataFrame], root: str, meta: dict | None = None) -> str:
    """Stage all tables, then switch to them at once; if one fails, the former version stays."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    try:
        for name, df in tables.items():
            with shuffles_removed(spark):
                df.write.parquet(f"{root}/{version}/{name}")
    except Exception:
        fs, _, jvm = _fs(spark, root)
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/{version}"), True)
        raise
    write_pointer(spark, root, {"version": version} | (meta or {}))
    return version


def load_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{read_pointer(spark, root)['version']}/{name}")


def save_indexes(chunks: DataFrame, postings: DataFrame, stats: DataFrame, vectors: DataFrame | None, root: str, fingerprint: str, model: str | None = None, meta: dict | None = None) -> str:
    """BM25 and dense index together."""
    tables = {"postings": postings, "stats": stats} | ({"vectors": vectors} if vectors is not None else {}) | {"chunks": chunks}
    return publish(tables, root, {"fingerprint": fingerprint, "model": model} | (meta or {}))


def load_indexes(spark: SparkSession, root: str, fingerprint: str | None = None, model: str | None = None, documents: str | None = None) -> dict[str, DataFrame]:
    """All tables of an index, refused if they were made from other chunks or other documents, or by another model."""
    meta = read_pointer(spark, root)
    if documents is not None and meta.get("documents") != documents:
        raise StaleIndexError(f"{root} was built from other documents")
    if fingerprint is not None and meta["fingerprint"] != fingerprint:
        raise StaleIndexError(f"{root} was built from other chunks")
    if model is not None and meta["model"] != model:
        raise InconsistentIndexError(f"{root} holds vectors of {meta['model']}, not of {model}")
    names = ["chunks", "postings", "stats"] + (["vectors"] if meta["model"] else [])
    return {n: spark.read.parquet(f"{root}/{meta['version']}/{n}") for n in names}


def write_registry(registry: DataFrame, path: str) -> None:
    """One sorted JSON file; a registry has a row for each document version, not for each page."""
    registry.repartition(1).sortWithinPartitions("document_id", "document_version").write.mode("overwrite").json(path)


def write_report(summary: DataFrame, path: str) -> None:
    summary.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
