"""Column expressions shared by the operators. All of them stay JVM-side."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.session import BROADCAST_BYTES, materialize, small_enough


def title_case(c: Column) -> Column:
    """Locale-aware title case: word starts are found after any punctuation.

    Plain ``initcap`` splits on blanks only, which would leave ``(not`` and
    ``Mary-ann``; under a case-insensitive collation it uses word boundaries.
    """
    return F.collate(F.initcap(F.collate(c, "UTF8_LCASE")), "UTF8_BINARY")


def sentence_case(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def half_even(c: Column, digits: int = 0) -> Column:
    """Banker's rounding; negative digits round to tens and hundreds."""
    return F.bround(c, digits)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; a zero denominator gives NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def abs_log_ratio(f: Column, m: Column) -> Column:
    """|ln(f / m)|, NULL unless both are positive."""
    return F.when((f > 0) & (m > 0), F.abs(F.ln(f / m)))


def positive_log10(c: Column) -> Column:
    return F.when(c > 0, F.log10(c))


def not_in(c: Column, values: Iterable) -> Column:
    """Exclusion that keeps NULL rows."""
    values = list(values)
    return (c.isNull() | ~c.isin(values)) if values else F.lit(True)


def sum_strict(c: Column) -> Column:
    """Sum that is NULL as soon as one input is NULL."""
    return F.when(F.count_if(c.isNull()) > 0, None).otherwise(F.sum(c))


def sum_or_zero(c: Column) -> Column:
    """Sum that skips NULLs and is 0 when nothing is left."""
    return F.coalesce(F.sum(c), F.lit(0))


def recode(c: Column, mapping: Mapping[str, str], default: Column | str | None = None) -> Column:
    """Exact-value recode through a literal map; NULL and unknown values get the default."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    found = F.create_map(*pairs)[c]
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def nulls_last(*columns: str | Column) -> list[Column]:
    """Ascending sort keys with NULL last; a leading ``-`` in a name means descending."""
    keys = []
    for c in columns:
        if isinstance(c, Column):
            keys.append(c)
        elif c.startswith("-"):
            keys.append(F.col(c[1:]).desc_nulls_last())
        else:
            keys.append(F.col(c).asc_nulls_last())
    return keys


def join_null_safe(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match NULL keys; the key columns appear once."""
    keys = list(keys)
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"__r_{k}"])
    joined = left.join(renamed, condition, how)
    if how in ("full", "outer", "full_outer", "right", "right_outer"):
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(f"__r_{k}")) for k in keys})
    return joined.drop(*[f"__r_{k}" for k in keys])


def join_dimension(fact: DataFrame, dimension: DataFrame, on: str | list[str], how: str = "left",
                   max_bytes: int = BROADCAST_BYTES, null_safe: bool = False) -> DataFrame:
    """Join a lookup table, broadcasting it only after its stored rows were measured.

    The lookup is computed once. ``null_safe`` lets NULL keys match NULL keys.
    """
    held = materialize(dimension, "dimension")
    side = F.broadcast(held) if small_enough(held, max_bytes) else held
    if null_safe:
        return join_null_safe(fact, side, [on] if isinstance(on, str) else on, how)
    return fact.join(side, on=on, how=how)
