"""Exact quantiles of columns with any number of distinct values.

``percentile`` keeps a counter per distinct value in one task. Here approximate cuts narrow the range that holds a wanted rank: two aggregations a
round count exactly what lies below and inside, until the range is one value or has few enough rows to be sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 1000
FEW = 10_000  # rows of a range that are sorted on the driver


@dataclass
class _Range:
    low: float
    high: float
    below: int
    inside: int

    def open(self, few: int) -> bool:
        return self.low < self.high and self.inside > few


def _narrowed(rows: DataFrame, ranges: dict[int, _Range]) -> None:
    """One round for all ranks in ``ranges``: cuts around each rank, then exact counts on either side."""
    v = F.col("v")
    within = {k: v.between(r.low, r.high) for k, r in ranges.items()}
    slack = 2 / ACCURACY
    shares = {k: (k - r.below + 0.5) / r.inside for k, r in ranges.items()}
    cuts = rows.agg(*(
        F.percentile_approx(F.when(within[k], v), [max(0.0, s - slack), min(1.0, s + slack)], ACCURACY).alias(f"c{k}") for k, s in shares.items()
    )).first()
    wanted = []
    for k in ranges:
        a, b = cuts[f"c{k}"]
        left, middle, right = within[k] & (v < a), within[k] & v.between(a, b), within[k] & (v > b)
        wanted += [F.count_if(left).alias(f"l{k}"), F.count_if(middle).alias(f"m{k}"), F.max(F.when(left, v)).alias(f"x{k}"), F.min(F.when(right, v)).alias(f"y{k}")]
    found = rows.agg(*wanted).first()
    for k, r in ranges.items():
        (a, b), left, middle = cuts[f"c{k}"], found[f"l{k}"], found[f"m{k}"]
        if k < r.below + left:
            r.high, r.inside = found[f"x{k}"], left
        elif k < r.below + left + middle:
            r.low, r.high, r.below, r.inside = a, b, r.below + left, middle
        else:
            r.low, r.below, r.inside = found[f"y{k}"], r.below + left + middle, r.inside - left - middle


def ranked(df: DataFrame, column: str, ranks: Sequence[int], few: int = FEW) -> dict[int, float]:
    """The values at 0-based ``ranks`` of the ascending column, as doubles; nulls and NaN have no rank, ranks beyond the end no entry.

    ``df`` is read twice a round, of which a few do: give a stored table. A round leaves about 4 rows in a thousand, and always fewer
    than before.
    """
    rows = df.select(F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    low, high, n = rows.agg(F.min("v"), F.max("v"), F.count("*")).first()
    ranges = {k: _Range(low, high, 0, n) for k in set(ranks) if 0 <= k < n}
    while waiting := {k: r for k, r in ranges.items() if r.open(few)}:
        before = {k: (r.low, r.high) for k, r in waiting.items()}
        _narrowed(rows, waiting)
        for k, r in waiting.items():
            if (r.low, r.high) == before[k]:  # two values far apart hold nearly all rows
                first, up = rows.agg(F.count_if(F.col("v") == r.low), F.min(F.when(F.col("v") > r.low, F.col("v")))).first()
                if k < r.below + first:
                    r.high, r.inside = r.low, first
                else:
                    r.low, r.below, r.inside = up, r.below + first, r.inside - first
    left = {k: r for k, r in ranges.items() if r.low < r.high}
    out = {k: r.low for k, r in ranges.items() if r.low == r.high}
    if left:
        kept = F.lit(False)
        for r in left.values():
            kept = kept | F.col("v").between(r.low, r.high)
        values = sorted(x["v"] for x in rows.filter(kept).collect())  # at most ``few`` a rank
        for k, r in left.items():
            out[k] = [x for x in values if r.low <= x <= r.high][k - r.below]
    return out


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float], few: int = FEW) -> list[float | None]:
    """As ``percentile(column, shares)``: between two ranks by linear interpolation; None where no row has a value."""
    n = df.select(F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)").count()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    at = ranked(df, column, [f(p) for p in places for f in (floor, ceil)], few)
    return [at[floor(p)] if p == floor(p) else (ceil(p) - p) * at[floor(p)] + (p - floor(p)) * at[ceil(p)] for p in places]
