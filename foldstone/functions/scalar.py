"""Column helpers with the missing-value rules the feature definitions expect.

Missing is NULL everywhere.  A comparison with a missing value is false, not missing; a bad date
is missing; a division never raises.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldstone import constants as K


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (a missing operand counts as 0)."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def present(x: Column) -> Column:
    """NaN becomes NULL: NaN sorts above every number in Spark and would pass ``>=`` tests."""
    return F.when(~F.isnan(x), x)


def bin_code(x: Column, edges: Sequence[float]) -> Column:
    """Index of the right-closed bin ``(edges[i], edges[i+1]]``; NULL outside all bins."""
    return _bins(x, edges, [F.lit(i) for i in range(len(edges) - 1)])


def bin_label(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Like ``bin_code`` with a label for each bin."""
    return _bins(x, edges, [F.lit(label) for label in labels])


def _bins(x: Column, edges: Sequence[float], values: Sequence[Column]) -> Column:
    cases = zip(edges[:-1], edges[1:], values, strict=True)
    first = next(cases)
    start = F.when((x > first[0]) & (x <= first[1]), first[2])
    return reduce(lambda acc, case: acc.when((x > case[0]) & (x <= case[1]), case[2]), cases, start)


def guarded_ratio(top: Column, bottom: Column, guard: float = K.DIVISION_GUARD) -> Column:
    """``top / (bottom + guard)``, NULL when the guarded divisor is exactly zero."""
    return F.try_divide(top, bottom + F.lit(guard))


def half_even(x: Column, digits: int) -> Column:
    """Round half to even on the scaled double, the rule of numeric array libraries."""
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def clip(p: Column, eps: float = K.PROBABILITY_CLIP) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def logit(p: Column, eps: float = K.PROBABILITY_CLIP) -> Column:
    """Log-odds of a probability clipped away from 0 and 1."""
    q = clip(p, eps)
    return F.ln(q / (F.lit(1.0) - q))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def calibrated(p: Column, scale: Column | float, shift: Column | float) -> Column:
    """``sigmoid(scale * logit(p) + shift)``."""
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    shift = shift if isinstance(shift, Column) else F.lit(float(shift))
    return sigmoid(scale * logit(p) + shift)


def parse_date(text: Column) -> Column:
    """A date from text; text that is no date gives NULL."""
    return F.try_to_timestamp(text).cast("date")


def place_part(path: Column, separator: str = ",") -> Column:
    """Second part from the end of a separated path, trimmed; a path without one is kept whole."""
    parts = F.split(path, separator)
    return F.coalesce(F.trim(F.try_element_at(parts, F.lit(-2))), path)


def distance(x: Column, y: Column, x0: float, y0: float) -> Column:
    """Straight-line distance to a fixed point."""
    dx, dy = x - F.lit(x0), y - F.lit(y0)
    return F.sqrt(dx * dx + dy * dy)


def cycle(x: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a position on a cycle."""
    turn = F.lit(2.0) * F.pi() * x / F.lit(period)
    return F.sin(turn), F.cos(turn)


def weighted_sum(columns: Sequence[str], weights: Sequence[float]) -> Column:
    terms = [F.lit(float(w)) * F.col(c) for c, w in zip(columns, weights, strict=True)]
    return reduce(lambda a, b: a + b, terms)


def grid_points(start: float, stop: float, points: int) -> list[float]:
    """Evenly spaced points; each is start + i * step so that rounding does not pile up."""
    if points == 1:
        return [float(start)]
    step = (stop - start) / (points - 1)
    inner = [start + i * step for i in range(points - 1)]
    return [float(v) for v in inner] + [float(stop)]
