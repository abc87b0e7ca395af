"""Packing by powers of two.

Each document's ids (with an end id) are cut into whole sequences of ``max_len`` and, for what is left, into one piece
per binary digit of its length, longest first.  Each piece is a sequence of its own whose length is a power of two:
no sequence crosses documents and nothing is padded.  Sequences of one length share a ``bucket`` (the exponent), so
batches of equal length are read straight from ``partitionBy("bucket")``.

One Arrow pass, no shuffle.  ``sequence_id`` holds the bucket, the partition and a running number, so it is unique
without a count over all partitions, and sorts by bucket.

Defined cases: a null text is empty and yields its end id alone, as one piece; null ids are kept; repeated rows are
packed as often as they come; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quern.llm.tokens import WORD_BPE, documents_ids

SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, bucket int, sequence_id bigint, offset bigint, ids binary"
_OUT_BYTES = 8 << 20


def piece_lengths(n: int, max_len: int) -> list[int]:
    """Whole sequences first, then the powers of two of what is left, descending."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = 4096, tokenizer: str = WORD_BPE, end_id: int = 2) -> DataFrame:
    """One row per piece; ``ids`` are little-endian unsigned 32-bit integers."""
    if max_len < 1 or max_len & (max_len - 1) or max_len > 1 << 15:
        raise ValueError("max_len: a power of two up to 32768")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = TaskContext.get().partitionId(), [0] * 16
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split(" ")[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            texts = pc.cast(batch.column(1), pa.binary()).to_pylist()
            for doc, ids in zip(batch.column(0).to_pylist(), documents_ids(texts, tokenizer, end_id)):
                raw, at, n = ids.tobytes(), 0, len(ids)
                for length in piece_lengths(n, max_len):
                    k = length.bit_length() - 1
                    rows.append((doc, at, length, n, k, k << 58 | part << 34 | counts[k], 0, raw[4 * at : 4 * (at + length)]))
                    counts[k] += 1
                    at += length
                held += len(raw)
                if held > _OUT_BYTES:
                    yield flush()
                    rows, held = [], 0
        yield flush()

    return df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, SCHEMA)


def piece_array(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, dtype="<u4")
