"""Decisions of a query: resolution, raw points or groups, what to fetch, how far to prefetch.  Driver arithmetic."""

from __future__ import annotations

import math
from dataclasses import replace

from ..model import Interval, Query, Span, merge


def aggregation_factor(query: Query, spans: list[Span], gaps: list[Interval], initial: int, failed: bool) -> int:
    """Groups per pixel column to fetch: the factors of cached spans and, for the gaps, the initial one, weighted
    by the share of the query that they cover; doubled when the cached answer was too wrong."""
    whole = query.interval
    parts = [(s.interval.share_of(whole), query.step // s.agg) for s in spans if s.agg > 0]
    parts += [(g.share_of(whole), initial) for g in gaps]
    weight = sum(w for w, _ in parts)
    factor = math.ceil(sum(w * f for w, f in parts) / weight - 1e-9) if weight > 0 else initial
    return factor * 2 if failed else factor


def group_gaps(columns: list[Interval], step: int, most: int = 10) -> list[Interval]:
    """Missing columns as intervals, those at most ``most`` columns apart fetched as one."""
    return merge(columns, most * step)


def wants_raw(gaps: list[Interval], width: int, factor: int, sampling: int, ratio: float) -> bool:
    """Raw points when a group would hold fewer than ``ratio`` samples; a sampling interval of 0 counts as a millisecond."""
    return bool(gaps) and max(map(len, gaps)) / (width * factor) < ratio * max(sampling, 1)


def pushes(offers: frozenset[str], what: str, points: int, rows: int) -> bool:
    """Whether the store makes ``what`` of ``points`` expected points: if it can, and fewer ``rows`` travel for it."""
    return what in offers and rows < points


def group_width(query: Query, factor: int) -> int:
    return max(1, len(query.interval) // (query.width * factor))


def prefetch_query(query: Query, factor: float, extent: Interval) -> Query:
    """The query extended by half of ``factor`` times its length on both sides, within the data."""
    extra = int(len(query.interval) * factor / 2)
    return query.over(Interval(query.start - extra, query.end + extra).clamp(extent))


def clamp(query: Query, extent: Interval) -> Query:
    inside = query.interval.clamp(extent)
    if not len(inside):
        raise ValueError("the query lies outside the data")
    return replace(query, start=inside.start, end=inside.end)
