"""Small column expressions used across the operators. All of them stay inside the JVM."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def gaussian_score(x: Column, optimum: Column, sigma: Column) -> Column:
    away = x - optimum
    return F.exp(-(away * away) / (F.lit(2.0) * sigma * sigma))


def at_least(x: Column, bound: Column | float) -> Column:
    """`x`, or the bound where that is larger; null where either is null. (`greatest` alone skips nulls.)"""
    bound = bound if isinstance(bound, Column) else F.lit(float(bound))
    return F.when(x.isNotNull() & bound.isNotNull(), F.greatest(x, bound))


def at_most(x: Column, bound: Column | float) -> Column:
    """`x`, or the bound where that is smaller; null where either is null."""
    bound = bound if isinstance(bound, Column) else F.lit(float(bound))
    return F.when(x.isNotNull() & bound.isNotNull(), F.least(x, bound))


def clamp(x: Column, low: float, high: float) -> Column:
    """`x` held inside [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))))


def axis(low: Column, high: Column, steps: int) -> Column:
    """Array of structs (index, value): `steps` evenly spaced points including both ends."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)),
        lambda i: F.struct(
            i.alias("index"),
            (low + i.cast("double") * ((high - low) / F.lit(float(steps - 1)))).alias("value"),
        ),
    )


def messages(*conditional: tuple[Column, Column], default: str) -> Column:
    """Array of the texts whose condition holds, or one default text when none does."""
    kept = F.filter(F.array(*[F.when(test, text) for test, text in conditional]), lambda m: m.isNotNull())
    return F.when(F.size(kept) == 0, F.array(F.lit(default))).otherwise(kept)


def said(template: str, **parts: Column) -> Column:
    """A text with `{name}` places filled by columns."""
    pieces = []
    for text, name, _, _ in Formatter().parse(template):
        pieces += [F.lit(text)] if text else []
        pieces += [parts[name].cast("string")] if name else []
    return F.concat(*pieces)


def whole(x: Column) -> Column:
    """Integer part as text."""
    return x.cast("int").cast("string")


def one_decimal(x: Column) -> Column:
    return F.format_string("%.1f", x)
