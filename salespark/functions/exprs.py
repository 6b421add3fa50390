"""Column-expression helpers shared by the operators.

All of these build JVM-side expressions (no Python UDFs), so they stay
inside whole-stage code generation.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dround(c: str | Column, digits: int) -> Column:
    """Round a DOUBLE to ``digits`` decimals as ``round(x * 10^d) / 10^d``.

    Scaling first and rounding the scaled double half away from zero gives
    the same result as common SQL engines' double rounding; rounding the
    double's shortest decimal text (Spark's ``round`` on DOUBLE) differs on
    values like 206403.765 that sit just below a tie.
    """
    scale = float(10 ** digits)
    return F.round(col(c).cast("double") * F.lit(scale), 0) / F.lit(scale)


def money(c: str | Column, digits: int = 2) -> Column:
    """Round an exact (DECIMAL) amount and hand it out as DOUBLE."""
    return F.round(col(c), digits).cast("double")


def ratio_pct(num: str | Column, den: str | Column, digits: int | None = 1,
              zero_as: float | None = None) -> Column:
    """``num / den * 100`` in DOUBLE arithmetic.

    Division by zero gives NULL (``zero_as`` replaces it when given).  Both
    sides are cast to DOUBLE first so the result does not depend on DECIMAL
    division rules, which differ between engines.
    """
    value = F.try_divide(col(num).cast("double"), col(den).cast("double")) * F.lit(100.0)
    if digits is not None:
        value = dround(value, digits)
    if zero_as is not None:
        value = F.coalesce(value, F.lit(float(zero_as)))
    return value


def safe_div(num: str | Column, den: str | Column, digits: int | None = 2) -> Column:
    value = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return dround(value, digits) if digits is not None else value


def is_returned(c: str | Column = "returned") -> Column:
    """True for a returned line; NULL counts as not returned."""
    return F.coalesce(col(c) == F.lit("Yes"), F.lit(False))


def and_all(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def band_label(lo: float, hi: float) -> str:
    """Label of a discount band, e.g. ``0-10%`` (integer percent, truncated)."""
    return f"{int(lo * 100)}-{int(hi * 100)}%"


def band_index(c: str | Column, edges: list[float]) -> Column:
    """Index of the right-closed band ``(e[i], e[i+1]]`` that holds ``c``.

    The lowest band also includes its left edge.  Values outside
    ``[e[0], e[-1]]`` and NULL get NULL.  Edges compare as exact decimals.
    """
    if len(edges) < 2 or any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError("band edges must be at least two increasing numbers")
    v = col(c).cast("decimal(38,18)")
    dec = [F.lit(Decimal(repr(float(e)))).cast("decimal(38,18)") for e in edges]
    expr = None
    for i in range(len(edges) - 1):
        lower_ok = (v >= dec[0]) if i == 0 else (v > dec[i])
        cond = lower_ok & (v <= dec[i + 1])
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def band_label_expr(idx: str | Column, edges: list[float]) -> Column:
    labels = [band_label(edges[i], edges[i + 1]) for i in range(len(edges) - 1)]
    return F.element_at(F.array(*[F.lit(x) for x in labels]), col(idx) + 1)


def quintile_score(rank: str | Column, n: str | Column) -> Column:
    """Score 1..5 of a 1-based position ``rank`` among ``n`` rows.

    Equal-count quintiles of the positions 1..n with right-closed bins, the
    lowest bin closed on both sides: the smallest k in 1..5 with
    ``rank <= 1 + k*(n-1)/5``, i.e. ``ceil(5*(rank-1)/(n-1))`` floored at 1.
    Exact integer arithmetic; n = 1 scores 1.
    """
    r = col(rank).cast("long")
    m = col(n).cast("long")
    raw = F.floor((F.lit(5) * (r - 1) + m - 2) / F.greatest(m - 1, F.lit(1)))
    return F.when(m <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), raw.cast("int"))).cast("int")


def week_ending_sunday(c: str | Column) -> Column:
    """Label a date with the Sunday that ends its week (a Sunday maps to itself)."""
    return F.next_day(F.date_sub(col(c), 1), "SUN")


def month_end(c: str | Column) -> Column:
    return F.last_day(col(c))


def regex_contains(c: str | Column, pattern: str, case_insensitive: bool = True,
                   literal: bool = False) -> Column:
    """Regex (or literal) containment; NULL input is False."""
    if literal:
        hit = F.contains(F.lower(col(c)), F.lit(pattern.lower())) if case_insensitive \
            else F.contains(col(c), F.lit(pattern))
    else:
        hit = col(c).rlike(("(?i)" if case_insensitive else "") + pattern)
    return F.coalesce(hit, F.lit(False))
