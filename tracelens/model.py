"""Queries, viewports and intervals as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True, order=True)
class Interval:
    """Half-open [start, end) in epoch milliseconds."""

    start: int
    end: int

    def __post_init__(self):
        if self.end < self.start:
            raise ValueError(f"interval ends before it starts: {self}")

    def __len__(self) -> int:
        return self.end - self.start

    def contains(self, t: int) -> bool:
        return self.start <= t < self.end

    def overlaps(self, other: Interval) -> bool:
        return self.end > other.start and other.end > self.start

    def encloses(self, other: Interval) -> bool:
        return self.start <= other.start and self.end >= other.end

    def adjacent(self, other: Interval) -> bool:
        return self.start == other.end or self.end == other.start

    def share_of(self, other: Interval) -> float:
        """Share of ``other`` that this one covers."""
        return 1 - (max(other.end - self.end, 0) + max(self.start - other.start, 0)) / len(other)

    def hull(self, other: Interval) -> Interval:
        return Interval(min(self.start, other.start), max(self.end, other.end))

    def clamp(self, within: Interval) -> Interval:
        start = min(max(self.start, within.start), within.end)
        return Interval(start, max(min(self.end, within.end), start))


def merge(intervals: list[Interval], gap: int = 0) -> list[Interval]:
    """Union of intervals, those at most ``gap`` apart joined."""
    out: list[Interval] = []
    for x in sorted(intervals):
        if out and x.start - out[-1].end <= gap:
            out[-1] = out[-1].hull(x)
        else:
            out.append(x)
    return out


def narrow(intervals: list[Interval], most: int) -> list[Interval]:
    """At most ``most`` intervals that cover the union of ``intervals``: those closest to each other are joined."""
    some = merge(intervals)
    wide = sorted(range(1, len(some)), key=lambda k: (some[k - 1].end - some[k].start, k))[: most - 1]
    at = [0, *sorted(wide), len(some)]
    return [some[a].hull(some[b - 1]) for a, b in zip(at, at[1:]) if a < b]


def subtract(whole: Interval, parts: list[Interval]) -> list[Interval]:
    """What ``parts`` leave of ``whole``."""
    out, at = [], whole.start
    for x in merge(parts):
        if x.end <= at or x.start >= whole.end:
            continue
        if x.start > at:
            out.append(Interval(at, x.start))
        at = x.end
    if at < whole.end:
        out.append(Interval(at, whole.end))
    return out


@dataclass(frozen=True)
class Query:
    """Draw ``measures`` (none: all) over [start, end) on width x height pixels with at least ``accuracy``."""

    start: int
    end: int
    width: int = 1000
    height: int = 600
    accuracy: float = 0.95
    measures: tuple[str, ...] = ()

    def __post_init__(self):
        if self.end <= self.start:
            raise ValueError("a query needs start < end")
        if self.width < 1 or self.height < 1:
            raise ValueError("a viewport needs at least one pixel")
        if not 0 <= self.accuracy <= 1:
            raise ValueError("accuracy lies in 0..1")

    @property
    def interval(self) -> Interval:
        return Interval(self.start, self.end)

    @property
    def step(self) -> int:
        """Milliseconds of a pixel column; 0 if the range is shorter than the chart is wide."""
        return (self.end - self.start) // self.width

    def over(self, interval: Interval) -> Query:
        return replace(self, start=interval.start, end=interval.end)


@dataclass(frozen=True)
class Span:
    """A cached interval of one measure at one resolution, -1 for raw points.

    ``batch`` names the rows it was stored with.  A span of groups is stored at coarser levels too: ``levels`` more, of
    which this one is number ``level``, with ``agg`` as wide as its groups.
    """

    span_id: int
    measure: str
    start: int
    end: int
    agg: int
    rows: int = field(default=0, compare=False)
    batch: str = field(default="", compare=False)
    levels: int = field(default=0, compare=False)
    level: int = field(default=0, compare=False)

    def residual(self, x: Interval) -> list[Interval]:
        """What of an interval the span leaves open."""
        return subtract(x, [self.interval])

    @property
    def interval(self) -> Interval:
        return Interval(self.start, self.end)
