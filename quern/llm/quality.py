"""Quality rules: compression bands beside word statistics.

The method's verdict comes from zstandard ratios (compressed bytes / bytes).  The whole document and each
of its fixed chunks must lie between a lower limit (below: repetitive) and an upper limit (above:
incompressible).  Both depend on the length, since short inputs compress less.  A document is
rejected if its whole ratio leaves its band, or if more than ``max_bad_chunks`` of its chunks, two at least, leave theirs.  The last chunk
ends with the text, so every byte lies in a chunk; a text shorter than one is judged as a whole, with the limits of its length.

``fit_bands`` sets the limits from labelled clean texts: around each knot of length the ratios' quantiles after their trend over the logarithm
of the length.  The default ``Bands`` were fitted by it on the clean ones of 3,900 labelled texts of invented prose in four languages; ``labelled_ratios`` takes
``FIT_ROWS`` labelled rows at most (the documented bound) of a corpus to fit one's own.

One Arrow pass, no shuffle; a row needs memory in proportion to its own text alone.

Defined cases: a null text is an empty one; a text without words has zero statistics and fails the base rule
(fewer than 10 words); bytes that aren't UTF-8 count as they are; repeated rows give repeated results; an
empty table gives an empty one; further columns are ignored by ``quality_scores`` and kept by
``filter_quality``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHITE = b" \t\n\x0b\x0c\r"
NOT_WHITE_OR_CONTINUATION = bytes(c for c in range(256) if c in WHITE or 0x80 <= c <= 0xBF)
NOT_SYMBOL = bytes(c for c in range(256) if c not in b"#*$%&|<>")


#: Labelled rows that a fit takes at most; rejected shares of clean texts that it aims at; texts around a knot that it needs.
FIT_ROWS, REPETITIVE, INCOMPRESSIBLE, LEAST = 20_000, 0.005, 0.001, 12
_KNOTS = tuple(32 * 2**k for k in range(17))


@dataclass(frozen=True)
class Bands:
    """``limits``: knots (bytes, lowest ratio, highest ratio) by length, read linearly in the logarithm of the length; beyond the last one the lower
    limit goes on falling.  Shorter texts than the first can't be told from incompressible ones, so its lower limit alone holds for them."""

    limits: tuple[tuple[int, float, float], ...] = ((64, 0.8765, 1.5066), (128, 0.7208, 1.1362), (256, 0.5982, 0.9054), (512, 0.5429, 0.7898), (1024, 0.4926, 0.7115), (2048, 0.4601, 0.6514), (4096, 0.433, 0.6081), (8192, 0.4094, 0.5802), (16384, 0.3929, 0.5629), (32768, 0.3772, 0.5453))
    chunk_bytes: int = 1024
    chunk_band: tuple[float, float] = (0.5015, 0.6859)
    max_bad_chunks: float = 0.34
    level: int = 9

    def band(self, n: int) -> tuple[float, float]:
        knots = self.limits
        k = bisect_right(knots, n, key=lambda x: x[0])
        if k == 0:
            return knots[0][1], math.inf
        if len(knots) == 1:
            return knots[0][1:]
        k = min(k, len(knots) - 1)
        (n0, low0, high0), (n1, low1, high1) = knots[k - 1], knots[k]
        at = math.log(n / n0) / math.log(n1 / n0)
        return max(low0 + at * (low1 - low0), 0.02), high0 + min(at, 1.0) * (high1 - high0)

    def chunks(self, text: bytes) -> Iterator[bytes]:
        """Fixed chunks of a text longer than one; the last one ends with it."""
        for at in range(0, len(text), self.chunk_bytes) if len(text) > self.chunk_bytes else ():
            at = min(at, len(text) - self.chunk_bytes)
            yield text[at : at + self.chunk_bytes]


def ratios(text: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float | None, list[float]]:
    """The whole text's ratio and its chunks'; an empty text has none."""
    ratio = lambda x: len(packer.compress(x)) / len(x)
    return (ratio(text) if text else None), [ratio(c) for c in bands.chunks(text)]


def _upper(high: float) -> float:
    """A quarter of the way up to 1: clean texts hardly vary upwards, and what can't be compressed lies far above them."""
    return high + max(0.0, 1 - high) / 4


def fit_bands(clean: list[tuple[int, float, list[float]]], start: Bands | None = None) -> Bands:
    """Bands from (bytes, ratio, chunks' ratios) of clean texts.  Knots with too few texts around them are left out."""
    start = start or Bands()
    n, r = np.array([x[0] for x in clean], float), np.array([x[1] for x in clean])
    knots = []
    for at in _KNOTS:
        near = (n >= at / 1.6) & (n <= at * 1.6)
        if near.sum() < LEAST:
            continue
        x = np.log(n[near] / at)
        slope, base = np.polyfit(x, r[near], 1)
        rest = r[near] - slope * x
        low, high = np.quantile(rest, [REPETITIVE, 1 - INCOMPRESSIBLE])
        knots.append((at, round(float(low) - 4 / at, 4), round(_upper(float(high)) + 16 / at, 4)))
    chunks = np.array([c for x in clean for c in x[2]])
    band = start.chunk_band
    if len(chunks) >= LEAST:
        low, high = np.quantile(chunks, [REPETITIVE, 1 - INCOMPRESSIBLE])
        band = (round(float(low), 4), round(_upper(float(high)), 4))
    return replace(start, limits=tuple(knots) or start.limits, chunk_band=band)


@dataclass(frozen=True)
class Scores:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    ratio: float | None
    n_chunks: int
    n_bad_chunks: int
    base_failed: bool
    kept: bool
    reason: str = field(default="")


def repeated_window_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found at least twice, the first finding included.
    Windows are compared exactly, by the numbers of their words within the document."""
    if len(words) <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    base, n = len(seen), len(words) - width + 1
    if base == len(words):
        return 0
    key, span = ids[:n].copy(), base
    for k in range(1, width):
        if span > (1 << 62) // base:  # renumber densely, which keeps the comparison exact
            values, key = np.unique(key, return_inverse=True)
            span = len(values)
        key = key * base + ids[k : k + n]
        span *= base
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int32)
    starts = np.flatnonzero(again)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    seen: set[bytes] = set()
    repeated = 0
    for line in text.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line.strip(WHITE):
            seen.add(line)
    return repeated


def score(text: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> Scores:
    words = text.split()  # for bytes: exactly the six ASCII white characters
    n_words = len(words)
    word_chars = len(text.translate(None, NOT_WHITE_OR_CONTINUATION))
    n_repeat = repeated_window_words(words)
    base_failed = n_words < 10 or 100 * n_repeat > 20 * n_words
    ratio, parts = ratios(text, bands, packer)
    bad, reason = sum(not bands.chunk_band[0] <= c <= bands.chunk_band[1] for c in parts), ""
    if ratio is not None:
        low, high = bands.band(len(text))
        reason = "repetitive" if ratio < low else "incompressible" if ratio > high else "chunks" if bad > max(1, bands.max_bad_chunks * len(parts)) else ""
    if base_failed:
        reason = "base"
    return Scores(n_words, word_chars, len(text.translate(None, NOT_SYMBOL)), duplicate_lines(text), n_repeat, ratio, len(parts), bad, base_failed, not reason, reason)


_SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, ratio double, n_chunks bigint, n_bad_chunks bigint, reason string"


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in pc.cast(column, pa.binary()).to_pylist()]


def quality_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row per row of ``df``: its statistics, its ratios and the verdict ``kept`` with its reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            found = [score(t, bands, packer) for t in _texts(batch.column(1))]
            col = lambda name, kind: pa.array([getattr(s, name) for s in found], kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[col(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], col("base_failed", pa.bool_()), col("kept", pa.bool_()), col("ratio", pa.float64()), col("n_chunks", pa.int64()), col("n_bad_chunks", pa.int64()), col("reason", pa.string())],
                names=[re.split(" ", c)[0] for c in _SCHEMA.split(", ")],
            )

    return df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, _SCHEMA)


def filter_quality(df: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of ``df`` that the rules keep, with all their columns."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            yield batch.filter(pa.array([score(t, bands, packer).kept for t in _texts(batch.column(at))], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def labelled_ratios(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", rows: int = FIT_ROWS, bands: Bands = Bands()) -> DataFrame:
    """(quality, base_failed, bytes, ratio, chunks) of the labelled documents, of at most ``rows`` of them, chosen by hash."""
    chosen = labels.select(labels[id_col].cast("bigint").alias("_id"), labels[quality_col].cast("int").alias("quality")).filter("_id is not null and quality is not null")
    chosen = chosen.orderBy(F.xxhash64("_id"), "quality").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            texts = _texts(batch.column(1))
            failed = [score(t, bands, packer).base_failed for t in texts]
            found = [ratios(t, bands, packer) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(failed), pa.array([len(t) for t in texts], pa.int64()), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.list_(pa.float64()))], names=["quality", "base_failed", "bytes", "ratio", "chunks"])

    texts = df.select(df[id_col].cast("bigint").alias("_doc"), df[text_col].alias("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    return texts.select("quality", "text").mapInArrow(run, "quality int, base_failed boolean, bytes bigint, ratio double, chunks array<double>")
