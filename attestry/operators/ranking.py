"""Order-dependent statistics that survive one group holding most of the rows.

A window partitioned by the group puts the whole group into one task. Here rows
are range-partitioned on (group, order) into slices and stored once, in order,
with their place (slice and position); a place turns into a rank with the sizes
of earlier slices, so a hot group is spread over many tasks. The plan is the same
for every size; only the number of slices follows the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.exprs import join_null_safe, nulls_last
from attestry.session import materialize

# Rows of a slice; None cuts as finely as the session shuffles. Slices that a table with a given size is cut into at least.
SLICE_ROWS, LEAST_SLICES = None, 4

_SLICE, _AT = "__slice", "__at"
_BEFORE = "__before"
_ORDER = "__order"


def _sliced(df: DataFrame, by: Sequence[str], keys: Sequence[Column], slice_rows: int | None,
            keep: Sequence[str] | None = None) -> DataFrame:
    """The rows (or some columns of them) stored in order: slice, and place in the whole table."""
    order = [*[F.col(k) for k in by], *keys]
    if slice_rows is None:
        ranged = df.repartitionByRange(*order)
    else:
        ranged = df.repartitionByRange(max(LEAST_SLICES, -(-df.count() // slice_rows)), *order)
    # the upper bits of the id are the partition's number, the lower ones count its rows in order
    placed = ranged.sortWithinPartitions(*order).withColumn(_AT, F.monotonically_increasing_id())
    stored = materialize(placed if keep is None else placed.select(*keep, _AT), "slices")
    return stored.withColumn(_SLICE, F.shiftright(_AT, 33))


def _with_shift(ranged: DataFrame, by: Sequence[str], total: Column, more: Column) -> DataFrame:
    """Add what earlier slices of the group hold of ``total``, plus ``more`` of the own slice; one row per slice and group is joined."""
    totals = ranged.groupBy(*by, _SLICE).agg(total.alias("__total"), more.alias("__more"))
    earlier = Window.partitionBy(*by).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*by, _SLICE, (F.coalesce(F.sum("__total").over(earlier), F.lit(0)) + F.col("__more")).alias(_BEFORE))
    # no hint, its size decides when it is known
    return join_null_safe(ranged, shifts, [_SLICE, *by]) if by else ranged.join(shifts, _SLICE)


def _ranked(ranged: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    shifted = _with_shift(ranged, by, F.count("*"), 1 - F.min(_AT))
    return shifted.withColumn(out, (F.col(_AT) + F.col(_BEFORE)).cast("int")).drop(_SLICE, _AT, _BEFORE)


def running_total(df: DataFrame, order: Sequence[str | Column], weight: Column, by: Sequence[str] = (),
                  out: str = "running", slice_rows: int | None = SLICE_ROWS) -> DataFrame:
    """Cumulative sum of ``weight`` along ``order`` inside each ``by`` group.

    ``order`` has to identify rows uniquely inside a group.
    """
    ranged = _sliced(df, by, nulls_last(*order), slice_rows)
    local = Window.partitionBy(_SLICE, *by).orderBy(_AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shifted = _with_shift(ranged.withColumn(out, F.sum(weight).over(local)), by, F.sum(weight), F.lit(0))
    return shifted.withColumn(out, F.col(out) + F.col(_BEFORE)).drop(_SLICE, _AT, _BEFORE)


def ordinal_rank(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), out: str = "rank",
                 null_when: Column | None = None, slice_rows: int | None = SLICE_ROWS) -> DataFrame:
    """1..n along ``order`` inside each ``by`` group; rows matching ``null_when`` get NULL.

    Rows that get NULL must sort last, which NULL sort keys do. Rows are stored
    once, in order; the rank itself needs no window over them.
    """
    ranked = _ranked(_sliced(df, by, nulls_last(*order), slice_rows), by, out)
    return ranked if null_when is None else ranked.withColumn(out, F.when(~null_when, F.col(out)))


def independent_ranks(df: DataFrame, key: str, orders: Mapping[str, Sequence[str | Column]],
                      slice_rows: int | None = SLICE_ROWS) -> DataFrame:
    """Several global ranks of the same rows from one range partitioning: (key, one rank for each of ``orders``).

    An entry of an order is a column name (with ``-`` for descending) or an
    ascending expression; NULL sorts last. Only the sort keys and ``key``, which
    identifies rows, are shuffled; ``key`` and the places are stored.
    """
    fields: list[tuple[str, int, Column, bool]] = []
    for i, order in enumerate(orders.values()):
        for j, entry in enumerate(order):
            down = isinstance(entry, str) and entry.startswith("-")
            value = F.col(entry[1:] if down else entry) if isinstance(entry, str) else entry
            fields.append((f"__k{i}_{j}", i, value, down))
    # a row for each order; keys of the others are NULL
    tall = [F.struct(F.lit(i).alias(_ORDER), *[F.when(F.lit(of == i), value).alias(name) for name, of, value, _ in fields]) for i in range(len(orders))]
    rows = df.select(F.col(key), F.inline(F.array(*tall)))
    ranged = _sliced(rows, [_ORDER], nulls_last(*[f"-{name}" if down else name for name, _, _, down in fields]), slice_rows, [key, _ORDER])
    ranked = _ranked(ranged, [_ORDER], "__rank")
    return ranked.groupBy(key).agg(*[F.max(F.when(F.col(_ORDER) == i, F.col("__rank"))).alias(out) for i, out in enumerate(orders)])


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank", descending: bool = True,
                 truncate: bool = True, slice_rows: int | None = SLICE_ROWS) -> DataFrame:
    """Rank in which ties share their mean position, cut to an integer by default.

    Works on the counts per distinct value, so ties never travel row by row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__ties"))
    order = [f"-{value}" if descending else value]
    placed = running_total(counts, order, F.col("__ties"), by, "__last", slice_rows)
    mean = F.col("__last") - (F.col("__ties") - 1) / F.lit(2.0)
    placed = placed.select(*by, value, (mean.cast("int") if truncate else mean).alias(out))
    return join_null_safe(df, placed, [*by, value], "left")


def random_rank(df: DataFrame, value: str, tiebreak: str, seed: int, by: Sequence[str] = (), out: str = "rank",
                slice_rows: int | None = SLICE_ROWS) -> DataFrame:
    """Descending rank with ties broken by a seeded hash, so a rerun gives the same order."""
    shuffled = F.md5(F.concat(F.col(tiebreak), F.lit(str(seed)))).asc_nulls_last()
    return ordinal_rank(df, [f"-{value}", shuffled, tiebreak], by, out, F.col(value).isNull(), slice_rows)


def group_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (),
                    slice_rows: int | None = SLICE_ROWS, weight: str | None = None) -> DataFrame:
    """Exact interpolated quantiles per group, one column per entry of ``probs``.

    Distinct values are counted first (rows may already stand for ``weight``
    equal ones); the order statistics are then read off the running counts, so no
    task holds a whole group.
    """
    if not by:
        one_group = df.withColumn("__all", F.lit(0))
        return group_quantiles(one_group, value, probs, ("__all",), slice_rows, weight).drop("__all")
    n = F.count("*") if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("__n"))
    placed = running_total(counts, [value], F.col("__n"), by, "__upto", slice_rows)
    sizes = placed.groupBy(*by).agg(F.sum("__n").alias("__size"))
    placed = join_null_safe(placed, sizes, by)
    picks, finals = [], []
    for name, p in probs.items():
        place = (F.col("__size") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(place) + 1), ("hi", F.ceil(place) + 1)):
            holds = (F.col("__upto") - F.col("__n") < at) & (at <= F.col("__upto"))
            picks.append(F.max(F.when(holds, F.col(value))).cast("double").alias(f"__{side}_{name}"))
        picks.append(F.max(place - F.floor(place)).alias(f"__w_{name}"))
        lo, hi, w = (F.col(f"__{s}_{name}") for s in ("lo", "hi", "w"))
        finals.append((lo + (hi - lo) * w).alias(name))
    return placed.groupBy(*by).agg(*picks).select(*by, *finals)
