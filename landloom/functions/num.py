"""Numeric column functions: rounding that engines agree on, clamping, guarded ratios."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is evaluated once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def rnd(c: Column, places: int) -> Column:
    """Half-up rounding as floor(c * 10^n + 0.5) / 10^n; null stays null."""
    p = float(10**places)
    return F.floor(c * p + 0.5) / p


def exact_sum(c: Column, places: int = 4) -> Column:
    """A sum that does not depend on the order of its rows: decimals inside, a double outside."""
    return F.sum(c.cast(f"decimal(28,{places})")).cast("double")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or not positive."""
    return F.when(b > 0, a / b)


def first_truthy(*cols: Column) -> Column:
    """The first value that is neither null, empty, nor zero (of either sign, with any number of places), else null: `a or b` of dynamic languages."""
    zero = lambda c: (F.typeof(c) != "string") & (F.coalesce(c.cast("string").try_cast("double"), F.lit(1.0)) == 0)
    return F.coalesce(*[F.when(c.cast("string").isin("", "0", "0.0", "false") | zero(c), F.lit(None)).otherwise(c) for c in cols])


def coerce_number(c: Column) -> Column:
    """Text to double: Devanagari digits, thousands commas and unit words are understood; what is no number is null.

    Numbers pass through; a lone sign or point is null.
    """
    digits = F.translate(c.cast("string"), "०१२३४५६७८९", "0123456789")
    bare = F.regexp_replace(F.lower(digits), r"sq\.?\s*m(?:eters?|etres?)?\.?|sqm|m2|m²|,", "")
    return F.regexp_replace(bare, r"[^0-9.\-]", "").try_cast("double")
