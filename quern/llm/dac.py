"""Token ids in directly addressable codes.

An id is split into chunks of ``WIDTHS`` bits, lowest first.  Level k holds the k-th chunks of the ids that have one,
a bitmap that tells which of them continue, and a rank directory (continuing chunks before each block of 512).
The i-th id is its chunk at level 0; if its bit is set, its next chunk lies at level 1 at place rank(i), and so on.
So any id or range is read without decoding what lies before it.

File: ``QDAC0001``, the length of a JSON header, the header (sections with place, type and length), then the sections,
each aligned to 8 bytes: documents' ids, which of them are null, documents' places, then each level's chunks, bitmap
and directory.

Writing: rows are range-partitioned and sorted by id, so files named by partition and number follow each other in id
order.  A task holds one file's ids at a time (``file_ids``, or one document if that is longer), writes to a name of
its own and renames, so a task that runs twice leaves one whole file.  Starts come from a running sum over the
manifest, which has one thin row per file.

Defined cases: a null text is empty (its end id alone); null ids come first; rows of the same id are ordered by text;
an empty table writes no file; further columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut
from quern.llm.tokens import WORD_BPE, documents_ids

MAGIC = b"QDAC0001"
WIDTHS = (8, 8, 16)
BLOCK = 512
FILE_IDS = 2_000_000
_OUT_IDS = 1 << 20


def encode(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of (chunks, bitmap, rank directory)."""
    rest, levels = ids.astype(np.uint64), []
    for w in WIDTHS:
        chunks = (rest & np.uint64((1 << w) - 1)).astype(f"<u{w // 8}")
        rest = rest >> np.uint64(w)
        more = rest > 0
        padded = np.zeros(-(-max(len(more), 1) // BLOCK) * BLOCK, dtype=bool)
        padded[: len(more)] = more
        directory = np.concatenate([[0], np.cumsum(padded.reshape(-1, BLOCK).sum(axis=1))]).astype("<u8")
        levels.append((chunks, np.packbits(padded, bitorder="little"), directory))
        rest = rest[more]
        if not len(rest):
            return levels
    raise ValueError("ids have at most 32 bits")


def rank(bitmap: np.ndarray, directory: np.ndarray, i: int) -> int:
    """Set bits before bit i."""
    block = i // BLOCK
    inside = bitmap[block * BLOCK // 8 : (i + 7) // 8]
    return int(directory[block]) + int(np.unpackbits(inside, bitorder="little")[: i - block * BLOCK].sum())


def to_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    sections = [
        ("doc_ids", np.array([d or 0 for d in doc_ids], dtype="<i8")),
        ("doc_null", np.array([d is None for d in doc_ids], dtype="|u1")),
        ("places", np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")),
    ]
    for k, (chunks, bitmap, directory) in enumerate(encode(ids)):
        sections += [(f"chunks{k}", chunks), (f"bitmap{k}", bitmap), (f"directory{k}", directory)]
    at, table, body = 0, {}, []
    for name, values in sections:
        raw = values.tobytes()
        table[name] = [at, values.dtype.str, len(values)]
        raw += bytes(-len(raw) % 8)
        body.append(raw)
        at += len(raw)
    head = json.dumps({"n_ids": len(ids), "sections": table}).encode()
    head += b" " * (-len(head) % 8)
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *body])


class DacFile:
    """Random access to a file's ids and documents."""

    def __init__(self, data: bytes | memoryview | pa.Buffer) -> None:
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        base = 16 + int.from_bytes(view[8:16], "little")
        head = json.loads(bytes(view[16:base]))
        self.n_ids = head["n_ids"]
        self.of = {name: np.frombuffer(view, dtype=kind, count=n, offset=base + at) for name, (at, kind, n) in head["sections"].items()}
        self.levels = sum(name.startswith("chunks") for name in self.of)

    def __len__(self) -> int:
        return self.n_ids

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for k in range(self.levels):
            value |= int(self.of[f"chunks{k}"][i]) << shift
            if not self.of[f"bitmap{k}"][i >> 3] >> (i & 7) & 1:
                break
            i, shift = rank(self.of[f"bitmap{k}"], self.of[f"directory{k}"], i), shift + WIDTHS[k]
        return value

    def slice(self, a: int, b: int, level: int = 0) -> np.ndarray:
        """Ids a to b, b exclusive."""
        out = self.of[f"chunks{level}"][a:b].astype("<u4")
        bitmap, directory = self.of[f"bitmap{level}"], self.of[f"directory{level}"]
        if level + 1 < self.levels and b > a:
            lead = a & 7
            more = np.unpackbits(bitmap[a >> 3 : (b + 7) >> 3], bitorder="little")[lead : lead + b - a].astype(bool)
            first = rank(bitmap, directory, a)
            out[more] |= self.slice(first, first + int(more.sum()), level + 1) << np.uint32(WIDTHS[level])
        return out

    @property
    def documents(self) -> list[int | None]:
        return [None if gone else int(d) for d, gone in zip(self.of["doc_ids"], self.of["doc_null"])]

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.of["places"][k]), int(self.of["places"][k + 1]))


_MANIFEST = "part int, number int, path string, n_docs bigint, n_ids bigint"


def write_files(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = WORD_BPE, end_id: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes all rows' ids under ``folder`` (a URI that all executors reach) in ascending id order; returns the manifest."""
    spark = df.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        store, root = fs.FileSystem.from_uri(folder)
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[int] = []

        def flush() -> pa.RecordBatch:
            path = f"{root}/{part:06d}-{number:05d}.dac"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(own := f"{path}.{uuid.uuid4().hex}") as f:
                f.write(to_bytes(docs, lengths, np.concatenate(held)))
            store.move(own, path)
            row = [part, number, f"{folder}/{path.rpartition('/')[2]}", len(docs), sum(lengths)]
            for x in (docs, held, lengths):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "number", "path", "n_docs", "n_ids"])

        n = 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), documents_ids(pc.cast(batch.column(1), pa.binary()).to_pylist(), tokenizer, end_id)):
                docs.append(doc)
                held.append(ids)
                lengths.append(len(ids))
                n += len(ids)
                if n >= file_ids:
                    yield flush()
                    n, number = 0, number + 1
        if docs:
            yield flush()

    rows = df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].alias("text"))
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(run, _MANIFEST), "manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document: start counts all ids before it, ids are little-endian unsigned
    32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    data = DacFile(f.read_buffer())
                places, names, k = data.of["places"], data.documents, 0
                while k < len(names):
                    end = max(k + 1, int(np.searchsorted(places, places[k] + _OUT_IDS, side="right")) - 1)
                    ids, first = data.slice(int(places[k]), int(places[end])), int(places[k])
                    cuts = (places[k : end + 1] - first) * 4
                    column = pa.BinaryArray.from_buffers(pa.binary(), end - k, [None, pa.py_buffer(cuts.astype("<i4").tobytes()), pa.py_buffer(ids.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(names[k:end], pa.int64()), pa.array(places[k:end] + base, pa.int64()), pa.array(np.diff(places[k : end + 1]), pa.int64()), column], names=["doc_id", "start", "n_tokens", "ids"])
                    k = end

    before = F.sum("n_ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).alias("base"))
    return files.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
