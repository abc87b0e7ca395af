"""Which segments to merge.  A policy takes the snapshot's segments and returns the names it picks."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Segment:
    name: str
    docs: int
    live: int
    bytes: int


Policy = Callable[[list[Segment]], list[str]]


def by_bytes(threshold: float) -> Policy:
    """Those no larger than the mean size times ``threshold`` (within 0 and 1)."""

    def pick(segments: list[Segment]) -> list[str]:
        mean = sum(s.bytes for s in segments) / len(segments) if segments else 0
        return [s.name for s in segments if mean * min(max(threshold, 0), 1) >= s.bytes]

    return pick


def by_accumulated_bytes(threshold: float) -> Policy:
    """From the smallest on, as long as their sum stays within ``threshold`` of all bytes."""

    def pick(segments: list[Segment]) -> list[str]:
        total, so_far, out = sum(s.bytes for s in segments), 0, []
        for s in sorted(segments, key=lambda s: (s.bytes, s.name)):
            so_far += s.bytes
            if so_far > min(max(threshold, 0), 1) * total:
                break
            out.append(s.name)
        return out

    return pick


def by_count(n: int) -> Policy:
    return lambda segments: [s.name for s in segments[:n]]


def by_fill(threshold: float) -> Policy:
    """Empty ones and those with live documents in at most ``threshold`` of their places."""
    return lambda segments: [s.name for s in segments if not s.live or s.docs * min(max(threshold, 0), 1) >= s.live]


def by_live(threshold: float) -> Policy:
    """Empty ones and those with at most the mean of live documents times ``threshold``."""

    def pick(segments: list[Segment]) -> list[str]:
        mean = sum(s.live for s in segments) / len(segments) if segments else 0
        return [s.name for s in segments if not s.live or mean * min(max(threshold, 0), 1) >= s.live]

    return pick


@dataclass(frozen=True)
class Tier:
    """Runs of segments of like size, scored by evenness, number, smallness and the deleted share that a merge drops."""

    min_segments: int = 1
    max_segments: int = 10
    max_bytes: int = 5 << 30
    floor_bytes: int = 2 << 20
    min_score: float = 0.0

    def score(self, run: list[tuple[int, Segment]]) -> float:
        sizes = [max(size, self.floor_bytes) for size, _ in run]
        mean = sum(sizes) / len(sizes)
        spread = math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes)) / mean
        before, after = sum(s.bytes for _, s in run) or 1, sum(size for size, _ in run)
        return (1 - spread) * (len(run) / self.max_segments) ** 1.5 / math.sqrt(sum(sizes)) / max(after / before, 1e-9) ** 2

    def __call__(self, segments: list[Segment]) -> list[str]:
        empty = [s.name for s in segments if not s.live]
        kept = sorted(((int(s.bytes * s.live / max(s.docs, 1)), s) for s in segments if s.live), key=lambda x: (x[0], x[1].name))
        kept = [x for x in kept if x[0] < self.max_bytes / 2]
        best, pick = self.min_score, []
        for a in range(len(kept)):
            for b in range(a + max(self.min_segments, 1), min(a + self.max_segments, len(kept)) + 1):
                run = kept[a:b]
                if sum(size for size, _ in run) > self.max_bytes:
                    break
                if len(run) == 1 and run[0][1].live == run[0][1].docs:
                    continue  # nothing would change
                if (s := self.score(run)) > best:
                    best, pick = s, run
        return empty + [s.name for _, s in pick]
