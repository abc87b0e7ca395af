"""Postings from tokens: a document's tokens are grouped by term where the document lies, so only texts are shuffled, never tokens.

Rows of one id come together by hash and order, and are worked on in pieces of about ``PIECE`` tokens, with NumPy over Arrow columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from quern.functions.analysis import Analyzer, token_columns

PIECE = 1 << 18
#: Characters of text that are taken as a token, where tokens aren't known yet.
TEXT = 6
GROUPED = "term string, doc_id bigint, tf bigint, length bigint, positions array<int>, starts array<int>, ends array<int>, overlap bigint"
_LAST = np.iinfo(np.int32).max


def grouped(df: DataFrame, value: Column, analyzer: Analyzer | None, max_bytes: int) -> DataFrame:
    """``df``: doc_id, a bigint, and what ``value`` is made of: an array of terms at following positions, an array of tokens, or a text for ``analyzer``.  A row
    per term, document and length; ``overlap`` is the number of the document's tokens less that of their places.  Starts and ends are
    null where no token has them.  Longer terms than ``max_bytes`` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values in _documents(batches):
            for a, b in _pieces(ids, values):
                yield _group(ids[a:b], values.slice(a, b - a), analyzer, max_bytes)

    return df.repartition("doc_id").sortWithinPartitions("doc_id").select("doc_id", value.alias("value")).mapInArrow(run, GROUPED)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Ids as (id, is null) and values, with all rows of an id in one of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = _ids(batch.column(0))
        other = np.flatnonzero((ids != ids[-1]).any(axis=1))
        cut = int(other[-1]) + 1 if len(other) else 0
        if held and (cut or (_ids(held[-1].column(0))[-1] != ids[0]).any()):
            # what is held ends here, or with this batch's first rows
            yield from _whole([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield from _whole([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield from _whole(held)


def _whole(batches: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    batch = pa.concat_batches(batches)
    yield _ids(batch.column(0)), batch.column(1)


def _ids(column: pa.Array) -> np.ndarray:
    null = column.is_null().to_numpy(zero_copy_only=False)
    return np.stack([column.fill_null(0).to_numpy(zero_copy_only=False), null.astype(np.int64)], axis=1)


def _pieces(ids: np.ndarray, values: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows that end with an id and have about ``PIECE`` tokens."""
    if pa.types.is_list(values.type):
        size = pc.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    else:
        size = pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False) // TEXT + 1
    ends = np.append(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1, len(ids))
    upto, a = np.cumsum(size)[ends - 1], 0
    while a < len(ids):
        before = upto[np.searchsorted(ends, a, "right") - 1] if a else 0
        k = min(int(np.searchsorted(upto, before + PIECE)), len(ends) - 1)
        yield a, int(ends[k])
        a = int(ends[k])


def _group(ids: np.ndarray, values: pa.Array, analyzer: Analyzer | None, max_bytes: int) -> pa.RecordBatch:
    start = end = None
    if analyzer is not None:
        parts = list(token_columns(analyzer, values))
        n = np.array([x for counts, *_ in parts for x in counts], np.int64)
        term, pos, start, end = (pa.concat_arrays([p[k] for p in parts]) if parts else pa.array([], pa.string() if k == 1 else pa.int32()) for k in range(1, 5))
    else:
        n, flat = pc.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), values.flatten()
        term, pos = flat, None
        if pa.types.is_struct(flat.type):
            term, pos, start, end = flat.flatten()
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + 1 if pos is None else pos.to_numpy(zero_copy_only=False).astype(np.int64)
    start, end = (None if x is None or x.null_count == len(x) else x for x in (start, end))
    new = np.append(True, (ids[1:] != ids[:-1]).any(axis=1))
    repeated = not new.all()
    doc = np.cumsum(new) - 1
    # rows of one id and length are one document
    unit = np.unique(np.stack([doc, n], axis=1), axis=0, return_inverse=True)[1].reshape(-1) if repeated else np.arange(len(n))
    keep = pc.less_equal(pc.binary_length(term), max_bytes).fill_null(False)
    if not (whole := pc.all(keep).as_py() in (True, None)):
        kept = keep.to_numpy(zero_copy_only=False)
        row, pos, term = row[kept], pos[kept], term.filter(keep)
        start, end = (x if x is None else x.filter(keep) for x in (start, end))
    words = term.dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = unit[row] * max(len(words.dictionary), 1) + code
    if repeated or start is not None or (len(pos) > 1 and (np.diff(pos)[np.diff(row) == 0] < 0).any()):
        place = lambda x: np.zeros(len(key), np.int64) if x is None else x.fill_null(_LAST).to_numpy(zero_copy_only=False)
        by = np.lexsort((place(end), place(start), pos, key))
    else:
        by = np.argsort(key, kind="stable")
    key = key[by]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(at, len(key)), pa.int32())
    own = row[by[at]]
    overlap = np.zeros(doc[-1] + 1 if len(doc) else 0, np.int64)
    if len(pos):
        places = np.unique(doc[row] * (int(pos.max()) + 1) + pos) // (int(pos.max()) + 1) if repeated or start is not None or not whole or np.any(np.diff(pos)[np.diff(row) == 0] < 1) else doc[row]
        overlap = np.bincount(doc[row], minlength=len(overlap)) - np.bincount(places, minlength=len(overlap))
    lists = lambda x: pa.nulls(len(at), pa.list_(pa.int32())) if x is None else pa.ListArray.from_arrays(offsets, x.take(pa.array(by)))
    id_of = ids[own]
    return pa.RecordBatch.from_arrays(
        [
            words.dictionary.take(pa.array(code[by[at]])),
            pa.array(id_of[:, 0], pa.int64(), mask=id_of[:, 1] == 1),
            pa.array(np.diff(np.append(at, len(key))), pa.int64()),
            pa.array(n[own], pa.int64()),
            pa.ListArray.from_arrays(offsets, pa.array(pos[by], pa.int32())),
            lists(start),
            lists(end),
            pa.array(overlap[doc[own]], pa.int64()),
        ],
        names=["term", "doc_id", "tf", "length", "positions", "starts", "ends", "overlap"],
    )
