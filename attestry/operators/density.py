"""Two-dimensional Gaussian kernel density on a grid, per facet."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions.exprs import join_null_safe
from attestry.operators import ranking
from attestry.session import materialize

# Distinct points one task sums up for a facet; larger facets are salted over several tasks.
POINTS_PER_TASK = 200_000


def bandwidths(points: DataFrame, group: Sequence[str], slice_rows: int | None = ranking.SLICE_ROWS) -> DataFrame:
    """Normal-reference bandwidth per facet: 1.06 min(sd, IQR / 1.34) n^(-1/5) for x and y.

    ``points`` are distinct (x, y) per facet with their count ``w``.
    """
    w = F.col("w")
    means = points.groupBy(*group).agg(
        F.sum(w).alias("n"), *[(F.sum(w * F.col(c)) / F.sum(w)).alias(f"__mean_{c}") for c in ("x", "y")],
    )
    off = {c: F.col(c) - F.col(f"__mean_{c}") for c in ("x", "y")}
    stats = join_null_safe(points, means, group).groupBy(*group, "n").agg(
        *[F.sqrt(F.try_divide(F.sum(w * d * d), F.col("n") - 1)).alias(f"__sd_{c}") for c, d in off.items()],
    )
    widths = {}
    for c in ("x", "y"):
        quartiles = ranking.group_quantiles(points, c, {f"__low_{c}": 0.25, f"__high_{c}": 0.75}, group, slice_rows, "w")
        stats = join_null_safe(stats, quartiles, group)
        iqr = (F.col(f"__high_{c}") - F.col(f"__low_{c}")) / 1.34
        widths[f"h_{c}"] = F.least(F.col(f"__sd_{c}"), iqr) * 1.06 * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    return stats.withColumns(widths).select(*group, "n", "h_x", "h_y")


def _grid_sums(group: Sequence[str], xs: np.ndarray, ys: np.ndarray):
    """Per (facet, salt) kernel sums; rows arrive sorted by facet, so one matrix is held at a time."""
    rows = np.arange(len(xs))

    def emit(key: tuple, total: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame({"ix": rows, "kernel": list(total)})
        for name, value in zip(group, key):
            out[name] = value
        return out[[*group, "ix", "kernel"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None
        for batch in batches:
            for k, part in batch.groupby(list(group), sort=False, dropna=False):
                k = tuple(None if pd.isna(v) else v for v in k)
                if k != key:
                    if total is not None:
                        yield emit(key, total)
                    key, total = k, np.zeros((len(xs), len(ys)))
                zx = (xs[:, None] - part["x"].to_numpy()) / part["h_x"].to_numpy()
                zy = (part["y"].to_numpy()[:, None] - ys) / part["h_y"].to_numpy()[:, None]
                left = np.exp(-0.5 * zx * zx) * part["w"].to_numpy()
                total += left @ np.exp(-0.5 * zy * zy)
        if total is not None:
            yield emit(key, total)

    return run


def density2d(df: DataFrame, group: Sequence[str], x: str | Column, y: str | Column, xlim: tuple[float, float],
              ylim: tuple[float, float], grid: int = 100, bins: int = 10,
              points_per_task: int = POINTS_PER_TASK, slice_rows: int | None = ranking.SLICE_ROWS) -> DataFrame:
    """Density of (x, y) per facet on a ``grid`` x ``grid`` lattice, scaled to maximum 1 and cut into bins.

    Points outside the limits are left out first. Equal points are counted
    together. The kernel is a product, so a task's share of a facet is one matrix
    product; partial grids are then added up. Facets without spread have no density.
    """
    as_col = [F.col(c) if isinstance(c, str) else c for c in (x, y)]
    points = df.select(*group, as_col[0].cast("double").alias("x"), as_col[1].cast("double").alias("y"))
    points = points.where(F.col("x").between(*xlim) & F.col("y").between(*ylim))
    # read several times below
    weighted = materialize(points.groupBy(*group, "x", "y").agg(F.count("*").alias("w")))
    widths = materialize(bandwidths(weighted, group, slice_rows).where((F.col("h_x") > 0) & (F.col("h_y") > 0)))
    ready = join_null_safe(weighted, widths, group)
    tasks = F.ceil(F.col("n") / F.lit(points_per_task))
    salt = F.pmod(F.xxhash64("x", "y"), tasks)
    placed = ready.withColumn("__salt", salt).repartition(*group, "__salt").sortWithinPartitions(*group, "__salt")
    xs, ys = np.linspace(*xlim, grid), np.linspace(*ylim, grid)
    schema = T.StructType([
        *[df.schema[g] for g in group],
        T.StructField("ix", T.IntegerType()),
        T.StructField("kernel", T.ArrayType(T.DoubleType())),
    ])
    partial = placed.select(*group, "x", "y", "w", "h_x", "h_y").mapInPandas(_grid_sums(group, xs, ys), schema)
    cells = partial.select(*group, "ix", F.posexplode("kernel").alias("iy", "k"))
    summed = join_null_safe(cells.groupBy(*group, "ix", "iy").agg(F.sum("k").alias("k")), widths, group)
    return _scaled(summed, group, xlim, ylim, grid, bins)


def _scaled(summed: DataFrame, group: Sequence[str], xlim: tuple[float, float], ylim: tuple[float, float], grid: int, bins: int,
            *more: Column) -> DataFrame:
    """Kernel sums ``k`` of the lattice as densities, scaled to maximum 1 and cut into bins; a facet has grid x grid rows."""
    density = F.col("k") / (F.lit(2 * np.pi) * F.col("n") * F.col("h_x") * F.col("h_y"))
    peak = F.max("density").over(Window.partitionBy(*group))
    step_x, step_y = (xlim[1] - xlim[0]) / (grid - 1), (ylim[1] - ylim[0]) / (grid - 1)
    scaled = summed.withColumn("density", density).withColumn("ndensity", F.col("density") / peak)
    level = F.least(F.lit(bins), F.floor(F.col("ndensity") * bins).cast("int") + 1)
    return scaled.select(
        *group, "ix", "iy",
        (F.lit(float(xlim[0])) + F.col("ix") * step_x).alias("x"),
        (F.lit(float(ylim[0])) + F.col("iy") * step_y).alias("y"),
        "density", "ndensity", level.alias("level"), *more,
    )


def density2d_binned(df: DataFrame, group: Sequence[str], x: str | Column, y: str | Column, xlim: tuple[float, float],
                     ylim: tuple[float, float], grid: int = 100, bins: int = 10, refine: int = 4,
                     slice_rows: int | None = ranking.SLICE_ROWS) -> DataFrame:
    """``density2d`` from points dealt to a fine lattice, at a cost that does not depend on the points.

    Each point is shared among the four nodes around it, in proportion to its
    nearness (linear binning), on a lattice with ``refine`` cells to a step of the
    output in each direction. The node weights of a facet, at most
    ((grid - 1) refine + 1)^2, are then smoothed in x and in y, each by one matrix.
    Bandwidths are those of the points themselves.

    ``error`` bounds the difference to the exact ``density``. Binning replaces the
    kernel by its linear interpolation between nodes, in each direction off by at
    most d^2 / (8 h^2) for nodes d apart and bandwidth h; both parts add up, and the
    mean over points keeps the bound.
    """
    as_col = [F.col(c) if isinstance(c, str) else c for c in (x, y)]
    points = df.select(*group, as_col[0].cast("double").alias("x"), as_col[1].cast("double").alias("y"))
    points = points.where(F.col("x").between(*xlim) & F.col("y").between(*ylim))
    weighted = materialize(points.groupBy(*group, "x", "y").agg(F.count("*").alias("w")))
    widths = materialize(bandwidths(weighted, group, slice_rows).where((F.col("h_x") > 0) & (F.col("h_y") > 0)))

    cells = (grid - 1) * refine
    steps = {"x": (xlim[1] - xlim[0]) / cells, "y": (ylim[1] - ylim[0]) / cells}
    place = {c: (F.col(c) - F.lit(float(low))) / steps[c] for c, low in (("x", xlim[0]), ("y", ylim[0]))}
    node = {c: F.least(F.floor(place[c]), F.lit(cells - 1)).cast("int") for c in ("x", "y")}
    shares = []
    for right in (0, 1):
        for up in (0, 1):
            part = F.lit(1.0)
            for c, step in (("x", right), ("y", up)):
                over = place[c] - node[c]
                part = part * (over if step else 1 - over)
            shares.append(F.struct((node["x"] + right).alias("jx"), (node["y"] + up).alias("jy"), (F.col("w") * part).alias("m")))
    nodes = weighted.select(*group, F.inline(F.array(*shares))).groupBy(*group, "jx", "jy").agg(F.sum("m").alias("m"))

    fine = {"x": np.linspace(*xlim, cells + 1), "y": np.linspace(*ylim, cells + 1)}
    coarse = {"x": np.linspace(*xlim, grid), "y": np.linspace(*ylim, grid)}

    def smooth(facet: pd.DataFrame) -> pd.DataFrame:
        weight = np.zeros((cells + 1, cells + 1))
        weight[facet["jx"], facet["jy"]] = facet["m"]
        by_axis = {c: np.exp(-0.5 * ((coarse[c][:, None] - fine[c]) / facet[f"h_{c}"].iloc[0]) ** 2) for c in ("x", "y")}
        total = by_axis["x"] @ weight @ by_axis["y"].T
        ix, iy = (a.ravel() for a in np.indices(total.shape))
        out = pd.DataFrame({"ix": ix.astype(np.int32), "iy": iy.astype(np.int32), "k": total.ravel()})
        for name in (*group, "n", "h_x", "h_y"):
            out[name] = facet[name].iloc[0]
        return out[[*group, "ix", "iy", "k", "n", "h_x", "h_y"]]

    schema = T.StructType([
        *[df.schema[g] for g in group], T.StructField("ix", T.IntegerType()), T.StructField("iy", T.IntegerType()), T.StructField("k", T.DoubleType()),
        T.StructField("n", widths.schema["n"].dataType), T.StructField("h_x", T.DoubleType()), T.StructField("h_y", T.DoubleType())])
    summed = join_null_safe(nodes, widths, group).groupBy(*group).applyInPandas(smooth, schema)
    h = F.col("h_x") * F.col("h_y")
    worst = sum((F.lit(steps[c] ** 2 / 8) / (F.col(f"h_{c}") * F.col(f"h_{c}")) for c in ("x", "y")), F.lit(0.0))
    return _scaled(summed, group, xlim, ylim, grid, bins, (worst / (F.lit(2 * np.pi) * h)).alias("error"))
