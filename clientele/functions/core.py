"""Small column helpers shared by every operator. All are native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DAY_MICROS = 86_400_000_000


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def elapsed_days(start, end) -> Column:
    """Whole days of elapsed time, rounded down (23:00 -> 01:00 next day is 0)."""
    micros = F.timestamp_diff("MICROSECOND", col(start), col(end))
    return F.floor(micros / F.lit(DAY_MICROS)).cast("long")


def calendar_days(start, end) -> Column:
    """Difference of calendar dates (23:00 -> 01:00 next day is 1)."""
    return F.datediff(col(end), col(start)).cast("long")


def month_start(ts) -> Column:
    return F.trunc(col(ts), "MM")


def month_label(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def month_index(start, end) -> Column:
    """Number of month boundaries between two dates."""
    s, e = col(start), col(end)
    return ((F.year(e) - F.year(s)) * 12 + (F.month(e) - F.month(s))).cast("long")


def ratio(num, den) -> Column:
    """Double division that yields NULL on a zero or NULL divisor."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def at_least(c, low) -> Column:
    """Lower clip that keeps NULL (``greatest`` would replace NULL by the bound)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def at_most(c, high) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.least(c, F.lit(high)))


def clip(c, low, high) -> Column:
    return at_most(at_least(c, low), high)


def flag(predicate: Column) -> Column:
    """0/1 flag; a NULL predicate counts as 0."""
    return F.coalesce(predicate.cast("int"), F.lit(0))


def finite_or_zero(c) -> Column:
    c = col(c)
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def first_match(rules: list[tuple[Column, object]], default=None) -> Column:
    """Ordered rules; the first one that holds gives the label."""
    out = None
    for cond, label in rules:
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def cut(c, edges: list[float], labels: list[str], include_lowest: bool = False) -> Column:
    """Right-closed bins ``(e0,e1] (e1,e2] ...``; values outside all bins give NULL."""
    c = col(c)
    low_ok = (c >= edges[0]) if include_lowest else (c > edges[0])
    rules = [(c <= hi, lab) for hi, lab in zip(edges[1:], labels)]
    return F.when(low_ok, first_match(rules))


def lookup(c, mapping: dict, default=None) -> Column:
    """Value map for small literal dictionaries."""
    rules = [(col(c) == F.lit(k), v) for k, v in mapping.items()]
    return first_match(rules, default)


def one_row(df: DataFrame) -> Column:
    """A one-row table as a scalar struct: evaluated once, no join and no driver collect."""
    return df.select(F.struct(*df.columns)).scalar()
