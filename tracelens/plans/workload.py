"""Sequences of chart queries as an explorer makes them, for measuring a session."""

from __future__ import annotations

import csv
import random
from collections.abc import Iterator
from dataclasses import replace

from ..model import Interval, Query

#: Weights of the operations.
MIX = {"pan": 50, "zoom_out": 30, "zoom_in": 20, "resize": 0}


def first_query(extent: Interval, share: float, **settings) -> Query:
    """The last ``share`` of the data."""
    return Query(extent.end - int(len(extent) * share), extent.end, **settings)


def zoom(x: Interval, factor: float, extent: Interval) -> Interval:
    """The interval ``factor`` times as long around its centre, within the data."""
    middle, half = (x.start + x.end) // 2, max(1, int(len(x) * factor / 2))
    return Interval(middle - half, middle + half).clamp(extent)


def pan(x: Interval, shift: float, left: bool, extent: Interval) -> Interval | None:
    """The interval moved by a share of its length; None if it would leave the data."""
    move = int(len(x) * shift) * (-1 if left else 1)
    moved = Interval(x.start + move, x.end + move)
    return moved if extent.encloses(moved) else None


def sequence(first: Query, extent: Interval, count: int, seed: int = 42, mix: dict[str, int] | None = None, zoom_factor: float = 2.0, shift: tuple[float, float] = (0.1, 0.5), left: float = 0.7, add_measures: tuple[str, ...] = ()) -> Iterator[tuple[str, Query]]:
    """``count`` queries, each with the operation that made it.

    A pan that would leave the data, and a zoom-out that changes nothing, become a zoom-in.  Further measures
    join at random steps.
    """
    rng, mix = random.Random(seed), mix or MIX
    joins = dict(zip(sorted(rng.sample(range(1, max(count, 2)), min(len(add_measures), max(count - 1, 0)))), add_measures))
    query, op = first, "start"
    for k in range(count):
        if k:
            op = rng.choices(list(mix), list(mix.values()))[0]
            x = query.interval
            new: Interval | None = x
            if op == "pan":
                new = pan(x, rng.uniform(*shift), rng.random() < left, extent)
            elif op == "zoom_out":
                new = zoom(x, zoom_factor, extent)
            elif op == "resize":
                query = replace(query, width=max(1, int(query.width * rng.choice((0.5, 2)))))
            if op == "zoom_in" or op != "resize" and (new is None or new == x):
                op, new = "zoom_in", zoom(x, 1 / zoom_factor, extent)
            query = query.over(new)
            if k in joins:
                query = replace(query, measures=(*query.measures, joins[k]))
        yield op, query


def replay(path: str, **settings) -> list[Query]:
    """Queries from a file of from,to rows without a header."""
    with open(path, newline="") as f:
        return [Query(int(a), int(b), **settings) for a, b in csv.reader(f)]
