"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators.tables import run_dir, snapshot


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors reach; it goes when the application ends."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage."""
    return snapshot(df, name)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name for ``F.col``, dots and backticks in it taken as they are."""
    return f"`{name.replace('`', '``')}`"


def whole_row(df: DataFrame):
    """Every column of ``df`` as one struct, so that none of them can meet a name of an operator's own."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


#: Arrow batches hold up to so many bytes where the session does not say otherwise; the usual 64 MB are several hundred as Python objects.
BATCH_BYTES = "8m"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are small enough for long texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, "1b") == "1b":  # not set
        df.sparkSession.conf.set(key, BATCH_BYTES)
    return df


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces, so that a task holds few rows as Python objects at a time; at its end it gives memory back."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)
    del batches
    gc.collect()
    pa.default_memory_pool().release_unused()


def text_bytes(values: list) -> list[bytes]:
    """UTF-8 of every string; null counts as empty."""
    return [b"" if v is None else v.encode("utf-8") for v in values]


def let(value, use):
    """``use`` of a value that is worked out once: inside a lambda, a plain expression would be worked out for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Words as the corpus operators see them: A-Z lower-cased, split on ASCII white space.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def ascii_lower(column):
    """Lower-case A-Z only; other letters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(column):
    """Array of the words of a text; null and blank texts give an empty array."""
    return F.filter(F.split(ascii_lower(F.coalesce(column, F.lit(""))), WORD_SPLIT), lambda w: w != "")
