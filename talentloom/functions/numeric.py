"""Number helpers: rounding that gives the same digits on every engine."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` evaluated once, for formulas that mention a costly ``x`` many times."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def round1(x: Column) -> Column:
    """Round a double to one decimal the way IEEE arithmetic defines it.

    ``F.round`` rounds the *printed* number half-up, so 12.45 (stored just below 12.45) becomes
    12.5.  Here 10·x is formed exactly as ``s + err`` (two-sum of 8x and 2x); the error decides
    a tie, and only an exact tie goes to the even digit.
    """

    def tenths(v: Column) -> Column:
        a, b = v * F.lit(8.0), v * F.lit(2.0)
        s = a + b
        low = F.floor(s).cast("double")
        bb = s - a
        err = (a - (s - bb)) + (b - bb)
        tie = (s - low) == F.lit(0.5)
        return F.when(tie & (err > 0), low + F.lit(1.0)).when(tie & (err < 0), low).otherwise(F.rint(s)) / F.lit(10.0)

    return bind(x, tenths)


def round_half_up(x: Column, digits: int) -> Column:
    """Half-up on the decimal value, for quantities that are never exact ties."""
    return F.round(x.cast("decimal(28,12)"), digits).cast("double")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def share(part: Column, whole: Column) -> Column:
    """part / max(whole, 1) as a double."""
    return part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")


def constant_list(values: Sequence[str]) -> Column:
    """A constant array of strings, built in one call (a literal per word costs a call each)."""
    return F.expr("array(" + ", ".join(_quoted(v) for v in values) + ")")


def constant_pairs(values: Mapping[str, object]) -> Column:
    """A constant array<struct<k, v>> of strings and integers or strings."""
    def item(v: object) -> str:
        return str(v) if isinstance(v, int) else _quoted(str(v))
    return F.expr("array(" + ", ".join(f"struct({_quoted(k)} AS k, {item(v)} AS v)" for k, v in values.items()) + ")")


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
