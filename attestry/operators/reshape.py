"""Long <-> wide reshaping. Pivots are conditional aggregates, unpivots are ``inline``."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEXES = ("F", "M", "X")


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def pivot_values(df: DataFrame, ids: Sequence[str], key: str, value: str, columns: Mapping[str, str],
                 combine: Callable[[Column], Column]) -> DataFrame:
    """One output column per listed key value; ``combine`` says what duplicates become.

    One aggregation with map-side combine; unlisted key values are ignored, but
    every id that occurs keeps a row.
    """
    cells = [combine(F.when(_quoted(key) == F.lit(k), _quoted(value))).alias(out) for k, out in columns.items()]
    return df.groupBy(*ids).agg(*cells)


def widen_by_sex(df: DataFrame, values: Sequence[str] = ("number",), fill: int | None = None,
                 ids: Sequence[str] = ("name", "year", "region"), sex: str = "asab",
                 sexes: Sequence[str] = SEXES) -> DataFrame:
    """``number_F, number_M, ...`` per id. The natural key makes each cell one row."""
    cells = []
    for v in values:
        for s in sexes:
            cell = F.max(F.when(F.col(sex) == s, F.col(v)))
            if fill is not None:
                attested = F.count_if(F.col(sex) == s) > 0
                cell = F.when(attested, cell).otherwise(F.lit(fill))
            cells.append(cell.alias(f"{v}_{s}"))
    return df.groupBy(*ids).agg(*cells)


def unpivot_year_type(grid: DataFrame, ids: Sequence[str], types: Mapping[str, tuple[str, str]],
                      sep: str = " ") -> DataFrame:
    """Columns headed ``<year><sep><type>`` become rows (ids, year, one column per type).

    ``types`` maps the header word to (output column, SQL type). The headers are
    read at planning time, so each grid row is exploded in place without a shuffle.
    """
    years: dict[int, dict[str, str]] = {}
    for header in grid.columns:
        if header not in ids:
            year, _, kind = header.partition(sep)
            years.setdefault(int(year), {})[kind] = header
    rows = []
    for year, heads in years.items():
        fields = [F.lit(year).alias("year")]
        for kind, (out, dtype) in types.items():
            source = _quoted(heads[kind]) if kind in heads else F.lit(None)
            fields.append(source.try_cast(dtype).alias(out))
        rows.append(F.struct(*fields))
    return grid.select(*[_quoted(i) for i in ids], F.inline(F.array(*rows)))


def unpivot_alternating(grid: DataFrame, id_column: str = "rank", prefix: str = "x", sep: str = "...",
                        outputs: Sequence[str] = ("name", "number")) -> DataFrame:
    """Headers ``x1954...2, x1954...3``: an even position holds the name, an odd one the count.

    Rows without an id (notes under the table) are dropped; outputs stay strings.
    """
    years: dict[int, dict[int, str]] = {}
    for header in grid.columns:
        match = re.fullmatch(re.escape(prefix) + r"?(\d+)" + re.escape(sep) + r"(\d+)", header)
        if match:
            years.setdefault(int(match[1]), {})[int(match[2]) % 2] = header
    rows = [
        F.struct(F.lit(year).alias("year"),
                 *[_quoted(heads[parity]).cast("string").alias(out) for parity, out in enumerate(outputs)])
        for year, heads in years.items()
    ]
    kept = grid.where(F.col(id_column).isNotNull())
    return kept.select(id_column, F.inline(F.array(*rows)))


def unpivot_sex_pairs(df: DataFrame, keep: Sequence[str], fields: Sequence[str] = ("name", "number"),
                      sexes: Sequence[str] = ("F", "M"), sex: str = "asab") -> DataFrame:
    """``name_F, number_F, name_M, number_M`` on one row become one row per sex."""
    rows = [
        F.struct(F.lit(s).alias(sex), *[F.col(f"{f}_{s}").alias(f) for f in fields])
        for s in sexes
    ]
    return df.select(*keep, F.inline(F.array(*rows)))


def pivot_indicator(df: DataFrame, ids: Sequence[str], indicator: str, value: str, columns: Mapping[str, str],
                    label: Callable[[Column], Column] | None = None) -> DataFrame:
    """Indicator rows become columns; ``label`` can shorten a long indicator text first."""
    if label is not None:
        df = df.withColumn(indicator, label(_quoted(indicator)))
    return pivot_values(df, ids, indicator, value, columns, F.max)


def label_by_character(position: int, character: str, then: str, otherwise: str) -> Callable[[Column], Column]:
    """Tell two long labels apart by the single character at ``position``."""
    return lambda c: F.when(F.substring(c, position, 1) == character, then).otherwise(otherwise)
