"""Index life cycle: segments of documents and postings under a numbered manifest.

A segment holds its documents and postings with their dictionary, norms and counts, so a search reads its terms' postings and sums small tables.

A commit writes its segments first and the manifest last, by renaming it into place; a reader opens the newest manifest and
keeps seeing its version.  Operations of a commit act in order, so a removal sees only what was inserted before it, and a
replacement is inserted only if its filter matched.  Removed documents are masked until a merge drops them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.filters import Filter
from quern.plans.planner import Search
from quern.sources.files import Files
from quern.sources.index import FieldSpec, Index
from quern.sources.policies import Policy, Segment


class IndexNotFound(FileNotFoundError):
    pass


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    segments: tuple[dict[str, Any], ...] = ()
    deletes: tuple[str, ...] = ()
    next_id: int = 1
    payload: Any = None

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "segments": self.segments, "deletes": self.deletes, "next_id": self.next_id, "payload": self.payload})

    @staticmethod
    def of_json(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(d["version"], tuple(d["segments"]), tuple(d["deletes"]), d["next_id"], d["payload"])


def _newest(files: Files, root: str) -> Manifest | None:
    names = [n for n in files.names(root, "manifest-") if n.endswith(".json")]
    return Manifest.of_json(files.read(f"{root}/{names[-1]}")) if names else None


def _index(spark: SparkSession, root: str, m: Manifest, fields: tuple[FieldSpec, ...]) -> Index | None:
    if not m.segments:
        return None
    paths = [f"{root}/segments/{s['name']}" for s in m.segments]
    index = Index.of_segments(spark, paths, fields)
    return replace(index, deleted=spark.read.parquet(*[f"{root}/deletes/{d}" for d in m.deletes])) if m.deletes else index


@dataclass(frozen=True)
class Reader:
    """One version of an index."""

    spark: SparkSession
    root: str
    manifest: Manifest
    fields: tuple[FieldSpec, ...] = ()
    index: Index | None = field(default=None, compare=False)

    @staticmethod
    def open(spark: SparkSession, root: str, fields: tuple[FieldSpec, ...] = ()) -> Reader:
        m = _newest(Files(spark, root), root)
        if m is None:
            raise IndexNotFound(root)
        return Reader(spark, root, m, fields, _index(spark, root, m, fields))

    def reopen(self) -> Reader:
        """The newest version; the same object if nothing changed."""
        m = _newest(Files(self.spark, self.root), self.root)
        return self if m is None or m.version == self.manifest.version else Reader(self.spark, self.root, m, self.fields, _index(self.spark, self.root, m, self.fields))

    def docs_count(self) -> int:
        return sum(s["docs"] for s in self.manifest.segments)

    def live_docs_count(self) -> int:
        return self.index.live_docs_count() if self.index else 0

    def segments(self) -> list[Segment]:
        """With the live documents counted."""
        if self.index is None:
            return []
        gone: dict[str, int] = {}
        if self.index.deleted is not None:
            rows = self.index.deleted.select("doc_id").distinct()
            for s in self.manifest.segments:
                gone[s["name"]] = self.spark.read.parquet(f"{self.root}/segments/{s['name']}/docs").join(rows, "doc_id", "left_semi").count()
        return [Segment(s["name"], s["docs"], s["docs"] - gone.get(s["name"], 0), s["bytes"]) for s in self.manifest.segments]


@dataclass
class Writer:
    """The one writer of an index; ``close`` frees its lock.  ``sort_by``: the primary order of each segment's documents.
    ``options`` go to the parquet writer (codec, encryption)."""

    spark: SparkSession
    root: str
    fields: list[FieldSpec]
    sort_by: list[str] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)
    _pending: list[tuple[str, Any, DataFrame | None]] = field(default_factory=list)
    _begun: Manifest | None = None

    def __post_init__(self) -> None:
        self._files = Files(self.spark, self.root)
        if not self._files.create(f"{self.root}/write.lock"):
            raise RuntimeError(f"{self.root} has a writer; remove write.lock if it is gone")
        self._manifest = _newest(self._files, self.root) or Manifest()

    def close(self) -> None:
        self._files.delete(f"{self.root}/write.lock")

    # --- operations of the next commit

    def insert(self, df: DataFrame) -> Writer:
        self._pending.append(("insert", None, df))
        return self

    def remove(self, f: Filter) -> Writer:
        self._pending.append(("remove", f, None))
        return self

    def replace(self, f: Filter, df: DataFrame) -> Writer:
        self._pending.append(("replace", f, df))
        return self

    def import_index(self, reader: Reader) -> Writer:
        """Another index' live documents, as a segment of their own."""
        if reader.index is not None:
            self._pending.append(("insert", None, reader.index.live_docs().drop("doc_id")))
        return self

    def clear(self) -> Writer:
        self._pending = [("clear", None, None)]
        return self

    def reset(self) -> None:
        """Forgets the operations since the last commit."""
        self._pending = []
        self._begun = None

    # --- commits

    def begin(self, payload: Any = None) -> bool:
        """Phase one: everything is written but the manifest.  False if there is nothing to commit."""
        if self._begun is not None:
            raise RuntimeError("a commit has begun")
        if not self._pending and self._manifest.version:
            return False
        m = replace(self._manifest, version=self._manifest.version + 1, payload=payload)
        for kind, f, df in self._pending:
            if kind == "clear":
                m = replace(m, segments=(), deletes=())
                continue
            if kind in ("remove", "replace"):
                hits = self._delete(m, f)
                m = replace(m, deletes=(*m.deletes, hits)) if hits else m
                if not hits:
                    continue
            if df is not None:
                m = self._segment(m, df)
        self._begun = m
        return True

    def rollback(self) -> None:
        self.reset()

    def commit(self, payload: Any = None) -> bool:
        """Phase two, and one if it hasn't begun."""
        if self._begun is None and not self.begin(payload):
            return False
        if not self._files.create(f"{self.root}/manifest-{self._begun.version:012d}.json", self._begun.to_json()):
            self.reset()
            raise RuntimeError("another writer committed this version")
        self._manifest, self._begun, self._pending = self._begun, None, []
        return True

    def _write(self, df: DataFrame, path: str) -> None:
        df.write.options(**self.options).parquet(path)

    def _segment(self, m: Manifest, df: DataFrame) -> Manifest:
        """Ids are dense and follow the partitions' order."""
        name = f"s{uuid.uuid4().hex}"
        path = f"{self.root}/segments/{name}"
        rows = df.drop("doc_id")
        rows = rows.orderBy(*self.sort_by) if self.sort_by else rows
        self._write(rows.withColumn("_place", F.monotonically_increasing_id()), f"{path}/raw")
        raw = self.spark.read.parquet(f"{path}/raw")
        part = F.shiftright("_place", 33)
        sizes = raw.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ided = raw.withColumn("_part", part).join(sizes.select("_part", before.alias("_before")), "_part")
        ided = ided.withColumn("doc_id", F.lit(m.next_id) + F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_place", "_part", "_before")
        self._write(ided, f"{path}/docs")
        docs = self.spark.read.parquet(f"{path}/docs")
        index = Index.build(docs, self.fields)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._write(index.postings.repartitionByRange(n, "field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id"), f"{path}/postings")
        self._statistics(path)
        self._files.delete(f"{path}/raw")
        count = docs.count()
        info = {"name": name, "docs": count, "bytes": self._files.bytes(path), "first_id": m.next_id, "last_id": m.next_id + count - 1}
        return replace(m, segments=(*m.segments, info), next_id=m.next_id + count)

    def _statistics(self, path: str) -> None:
        Index.of_tables(self.spark.read.parquet(f"{path}/docs"), self.spark.read.parquet(f"{path}/postings")).write_statistics(path, self._write)

    def _delete(self, m: Manifest, f: Filter) -> str | None:
        index = _index(self.spark, self.root, m, tuple(self.fields))
        if index is None:
            return None
        name = f"d{uuid.uuid4().hex}"
        self._write(Search(index).matches(f).select("doc_id"), f"{self.root}/deletes/{name}")
        if self.spark.read.parquet(f"{self.root}/deletes/{name}").isEmpty():
            self._files.delete(f"{self.root}/deletes/{name}")
            return None
        return name

    # --- maintenance

    def consolidate(self, policy: Policy) -> bool:
        """Merges the policy's segments into one without their removed documents, and commits that."""
        if self._pending or self._begun:
            raise RuntimeError("commit first")
        reader = Reader(self.spark, self.root, self._manifest, tuple(self.fields), _index(self.spark, self.root, self._manifest, tuple(self.fields)))
        names = set(policy(reader.segments()))
        old = [s for s in self._manifest.segments if s["name"] in names]
        if not old:
            return False
        part = _index(self.spark, self.root, replace(self._manifest, segments=tuple(old)), tuple(self.fields))
        name = f"s{uuid.uuid4().hex}"
        path = f"{self.root}/segments/{name}"
        alive = lambda rows: rows if part.deleted is None else rows.join(part.deleted.select("doc_id").distinct(), "doc_id", "left_anti")
        docs = alive(part.docs)
        self._write(docs.repartitionByRange(*self.sort_by, "doc_id").sortWithinPartitions(*self.sort_by, "doc_id"), f"{path}/docs")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._write(alive(part.postings).repartitionByRange(n, "field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id"), f"{path}/postings")
        self._statistics(path)
        count = self.spark.read.parquet(f"{path}/docs").count()
        rest = tuple(s for s in self._manifest.segments if s["name"] not in names)
        merged = {"name": name, "docs": count, "bytes": self._files.bytes(path), "first_id": min(s["first_id"] for s in old), "last_id": max(s["last_id"] for s in old)}
        self._begun = replace(self._manifest, version=self._manifest.version + 1, segments=(*rest, merged) if count else rest, deletes=self._manifest.deletes if rest else ())
        return self.commit()

    def clean(self) -> list[str]:
        """Deletes the segments and deletions that the newest version doesn't name, and older manifests."""
        gone = []
        keep = {s["name"] for s in self._manifest.segments} | set(self._manifest.deletes)
        for folder in ("segments", "deletes"):
            gone += [f"{folder}/{n}" for n in self._files.names(f"{self.root}/{folder}") if n not in keep]
        gone += [n for n in self._files.names(self.root, "manifest-") if n != f"manifest-{self._manifest.version:012d}.json"]
        for n in gone:
            self._files.delete(f"{self.root}/{n}")
        return gone
