"""SimHash near-duplicates with BK-trees.

1. One Arrow pass turns each text into a 64-bit fingerprint (XXH64, seed 42, of its three-word shingles).
2. Equal fingerprints are collapsed by a pre-aggregated group, so copies cost one thin row.
3. Two fingerprints within three bits agree in at least one of four blocks of their bits.  Each block value is
   a shard; a shard with more than ``shard_rows`` fingerprints is split again by four blocks of the bits that are
   left (16, 12, 9, then 7 bits), which loses no pair and bounds the last level by 2**21 distinct values.
4. A task streams over its shards, one BK-tree at a time: children are keyed by their Hamming distance to the
   parent, and a lookup follows only edges within the radius.  The trees are built where their shard's rows are and
   not broadcast, since together they grow with the corpus.  A shard yields one link per fingerprint to
   its group's root, never all pairs.
5. Components come from alternating large-star and small-star rounds over those links, each written to the
   shared folder.

Defined cases: a null or wordless text has fingerprint zero and links like any other; texts of fewer than
three words have one shingle, their whole sequence; null ids are kept, never chosen as a component's id
unless it has no other (then it is null); repeated rows stay repeated in ``simhash_groups``, while
``keep_one`` keeps one row per component; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut

SEED = 42
WIDTHS = (16, 12, 9, 7)
SHARD_ROWS = 4096
_BLOCK = 1 << 14


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else map(b" ".join, zip(words, words[1:], words[2:]))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), _BLOCK):
        bits = np.unpackbits(h[at : at + _BLOCK].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(t or b"")) for t in pc.cast(batch.column(1), pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


class BKTree:
    """Nodes are [value, {distance: child}]."""

    def __init__(self) -> None:
        self.root: list | None = None

    def near(self, x: int, radius: int) -> Iterator[int]:
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            d = (node[0] ^ x).bit_count()
            if d <= radius:
                yield node[0]
            if node[1]:
                for k in range(d - radius, d + radius + 1):
                    if k in node[1]:
                        stack.append(node[1][k])

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = [x, {}]
            return
        node = self.root
        while d := (node[0] ^ x).bit_count():
            if d not in node[1]:
                node[1][d] = [x, {}]
                return
            node = node[1][d]


def shard_links(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """(root, member) for the members of the shard's groups of linked values."""
    if len(values) < 2:
        return
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    tree = BKTree()
    for x in values:
        parent[x] = x
        for y in tree.near(x, radius):
            a, b = find(x), find(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(x)
    for x in values:
        if (r := find(x)) != x:
            yield r, x


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; one shard is held at a time."""
    key, values, out = None, [], []

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array([_signed(a) for a, _ in out], pa.int64()), pa.array([_signed(b) for _, b in out], pa.int64())], names=["a", "b"])
        out.clear()
        return rows

    for batch in batches:
        for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                out.extend(shard_links(values, radius))
                key, values = k, []
                if len(out) > 50_000:
                    yield flush()
            values.append(v & 0xFFFFFFFFFFFFFFFF)
    out.extend(shard_links(values, radius))
    yield flush()


def _split(rows: DataFrame, level: int) -> DataFrame:
    """(fp, key, rest) -> four rows, one per block of the bits in ``rest``; rest loses that block's bits."""
    w = WIDTHS[level]

    def one(j: int) -> Column:
        value = F.shiftrightunsigned("rest", j * w).bitwiseAND(F.lit((1 << w) - 1))
        low = F.col("rest").bitwiseAND(F.lit((1 << (j * w)) - 1))
        high = F.shiftleft(F.shiftrightunsigned("rest", (j + 1) * w), j * w) if (j + 1) * w < 64 else F.lit(0).cast("bigint")
        return F.struct((F.col("key") * F.lit(4 << w) + F.lit(j << w) + value).alias("key"), high.bitwiseOR(low).alias("rest"))

    return rows.select("fp", F.inline(F.array(*[one(j) for j in range(4)])))


def links(fps: DataFrame, radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose transitive closure is that of all pairs within ``radius``."""
    if not 0 <= radius <= 3:
        raise ValueError("four blocks find pairs within at most three bits")
    rows, found = fps.select("fp", F.lit(0).cast("bigint").alias("key"), F.col("fp").alias("rest")), []
    for level in range(len(WIDTHS)):
        rows = _split(rows, level)
        cold = rows
        if level + 1 < len(WIDTHS):
            hot = cut(rows.groupBy("key").count().filter(F.col("count") > shard_rows).select("key"), "simhash-hot")
            if hot.isEmpty():
                hot = None
            else:
                cold = rows.join(hot, "key", "left_anti")
        sorted_ = cold.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
        found.append(sorted_.mapInArrow(lambda it: _links(it, radius), "a bigint, b bigint"))
        if level + 1 == len(WIDTHS) or hot is None:
            break
        rows = rows.join(hot, "key", "left_semi")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b), root being the component's smallest node.  Alternates
    large-star and small-star until the edges stay as they are; a hub's edges are joined, not gathered, so that
    adaptive execution can split them."""

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(low, "a")
        if large:
            out = joined.filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b")
        else:
            out = joined.select(F.col("m").alias("a"), "b").unionByName(low.select(F.col("m").alias("a"), F.col("a").alias("b")))
        return cut(out.filter(F.col("a") != F.col("b")).distinct(), "star")

    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct(), "edges")
    before = mark(edges)
    while before[0]:
        edges = star(star(edges, True), False)
        if (now := mark(edges)) == before:
            break
        before = now
    roots = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``df``."""
    thin = cut(fingerprints(df, id_col, text_col), "fingerprints")
    fps = cut(thin.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    # node is null for fingerprints without a link
    roots = components(links(fps, radius, shard_rows))
    placed = cut(fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return thin.join(placed.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """The rows of ``df``, one of each component: that with the smallest id."""
    groups = cut(simhash_groups(df, id_col, text_col, radius), "groups")
    counted = cut(groups.groupBy("component_id", "doc_id").count().filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.sum("count").alias("rows")), "kept")
    # by hash at every size: texts are shuffled once, and neither side is broadcast or sorted
    wanted = lambda rows: df.join(rows.select(F.col("doc_id").alias("_kept")).hint("shuffle_hash"), df[id_col].cast("bigint").eqNullSafe(F.col("_kept")), "left_semi")
    once, several = wanted(counted.filter("rows = 1")), counted.filter("rows > 1")
    # an id that several rows share: those rows alone are compared, by id and text
    return once if several.isEmpty() else once.unionByName(wanted(several).dropDuplicates([id_col, text_col]))
