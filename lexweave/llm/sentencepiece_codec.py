"""SentencePiece encoding and decoding through a distinct-chunk table.

No piece of the model has a white-space marker after another character, so no merge crosses the start of a
marked word.  A text is therefore the concatenation of marked words, each of which is segmented once per task and
looked up from then on; ids come back together by the words' positions in the text.  The model is checked for this
property, and a model without it is refused.

Rows stay where they are: there is no shuffle, and a lost executor's task is simply run again.  The table of a task
holds at most ``max_chunks`` words and starts afresh beyond that, so memory is bounded whatever the corpus holds;
words longer than ``LONG_CHUNK`` bytes are segmented without being kept.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows give repeated results;
columns other than the named ones pass through unread.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm._common import bounded_batches, pieces, quoted

MARK = "▁"
LONG_CHUNK = 256
#: Field 3 (normalizer) of a model holding field 3 (add_dummy_prefix) = 0; appended fields override earlier ones.
_NO_DUMMY_PREFIX = bytes([0x1A, 0x02, 0x18, 0x00])


def crossing_pieces(pieces: list[str]) -> list[str]:
    """Pieces with a marker behind another character, which would join two marked words."""
    return [p for p in pieces if MARK in p.lstrip(MARK)]


class ChunkTable:
    """Segments of distinct marked words: word -> (ids, the ids in decimal joined by commas)."""

    def __init__(self, model: bytes, max_chunks: int = 150_000):
        import sentencepiece

        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model + _NO_DUMMY_PREFIX)
        crossing = crossing_pieces([self.whole.id_to_piece(i) for i in range(self.whole.get_piece_size())])
        if crossing:
            raise ValueError(f"pieces cross white-space markers: {crossing[:5]}")
        if self.whole.encode("a  b", out_type=str)[0][:1] != MARK or "  " not in self.whole.decode(self.whole.encode("a  b")):
            raise ValueError("the model must add a leading marker and keep every space")
        self.max_chunks = max_chunks
        self.table: dict[str, tuple[list[int], str]] = {}

    def chunks(self, text: str) -> list[str]:
        """The marked words of a text, in order, without their leading marker."""
        return text.replace(" ", MARK).split(MARK)

    def _segment(self, fresh: list[str]) -> list[tuple[list[int], str]]:
        return [(ids, ",".join(map(str, ids))) for ids in self.bare.encode([MARK + c for c in fresh], num_threads=1)]

    def encode(self, text: str) -> tuple[list[int], str]:
        """All ids of a text, and the same in decimal joined by commas."""
        if not text:
            return [], ""
        parts = self.chunks(text)
        if "" in parts:  # runs of markers belong to the word behind them
            joined = MARK + MARK.join(parts)
            parts = [c[1:] for c in re.findall(f"{MARK}+[^{MARK}]*", joined)]
        table = self.table
        fresh = list({c for c in parts if c not in table})
        if fresh:
            if len(table) + len(fresh) > self.max_chunks:
                table.clear()
                fresh = list(set(parts))
            own = dict(zip(fresh, self._segment(fresh), strict=True))
            kept = {c: v for c, v in own.items() if len(c) <= LONG_CHUNK}
            if len(kept) <= self.max_chunks:
                table.update(kept)
            if len(kept) < len(own) or len(kept) > self.max_chunks:
                table = {**table, **own} if len(own) < 1000 else _Either(own, table)
        found = [table[c] for c in parts]
        ids: list[int] = []
        for piece_ids, _ in found:
            ids += piece_ids
        return ids, ",".join([said for _, said in found])

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids) if ids else ""


class _Either(dict):
    """Looks in its own entries first, then in another table."""

    def __init__(self, own: dict, other: dict):
        super().__init__(own)
        self.other = other

    def __missing__(self, key):
        return self.other[key]


def _load(model_path: str) -> bytes:
    with open(model_path, "rb") as f:
        return f.read()


def encode_texts(df: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True, digests: bool = False, max_chunks: int = 150_000) -> DataFrame:
    """Encode and decode every text.

    Returns ``keep`` and ``n_tokens``, with ``ids`` also ``token_ids`` and ``decoded``, with ``digests`` also
    ``ids_sha256`` (of the decimal ids joined by commas) and ``decoded_sha256``.  The model file is read once on
    the driver and shipped with the tasks, so executors need no copy of it.
    """
    model = df.sparkSession.sparkContext.broadcast(_load(model_path))
    fields = [df.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType())]
    if ids:
        fields += [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    if digests:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model.value, max_chunks)
        for batch in pieces(batches):
            counts, all_ids, texts, said, back = [], [], [], [], []
            for value in batch.column(n_keep):
                text = value.as_py() or ""
                own, decimal = table.encode(text)
                decoded = table.decode(own)
                counts.append(len(own))
                if ids:
                    all_ids.append(pa.array(own, pa.int32()))
                    texts.append(decoded)
                if digests:
                    said.append(hashlib.sha256(decimal.encode()).hexdigest())
                    back.append(hashlib.sha256(decoded.encode()).hexdigest())
            columns = [batch.column(i) for i in range(n_keep)] + [pa.array(counts, pa.int64())]
            if ids:
                offsets = pa.array([0, *accumulate(counts)], pa.int32())
                columns += [pa.ListArray.from_arrays(offsets, pa.concat_arrays(all_ids) if all_ids else pa.array([], pa.int32())), pa.array(texts, pa.string())]
            if digests:
                columns += [pa.array(said, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return bounded_batches(df).select(*[F.col(quoted(c)) for c in keep], F.col(quoted(text_col))).mapInArrow(run, T.StructType(fields))
