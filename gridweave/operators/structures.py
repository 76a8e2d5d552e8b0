"""More on structures: voxel groups, mask filters, regions, profiles and shapes of clusters, extrema, smoothing."""

from __future__ import annotations

import itertools
import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import eigen
from ..grid import PERIODIC, Grid
from .clustering import _moved, closing, compact, components, connected, minimal_image, opening, shape_moments
from .storage import cut


def distinct_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Adds number (of the row's distinct value, in order from 0) and count (its rows)."""
    from .clustering import positions

    per = positions(df.groupBy(*keys).agg(F.count("*").alias("count")), *keys).withColumnRenamed("pos", "number")
    return df.join(per, list(keys))


def voxel_groups(points: DataFrame, axes: tuple[str, ...], reach: float, per_voxel: int = 1, least: int = 1, corners: bool = True, pid: str = "pid") -> DataFrame:
    """(pid, label): friends of friends on voxels of half the linking length.

    Voxels of fewer than `per_voxel` points do not count; neighbours touch at faces, edges or corners; groups of fewer than `least` points, and points
    in other voxels, get -1. One row a voxel goes into the linking, however many points it holds.
    """
    side = reach / 2
    cells = [F.floor(F.col(a) / side).cast("long").alias(f"_{a}") for a in axes]
    p = points.select(pid, *cells)
    names = [f"_{a}" for a in axes]
    v = p.groupBy(*names).agg(F.count("*").alias("_n"), F.min(pid).alias("node")).where(F.col("_n") >= per_voxel)
    steps = [s for s in itertools.product((-1, 0, 1), repeat=len(axes)) if s > (0,) * len(axes) and (corners or sum(map(abs, s)) == 1)]
    around = F.array(*(F.struct(*((F.col(n) + d).alias(n) for n, d in zip(names, s, strict=True))) for s in steps))
    near = v.select(F.col("node").alias("b"), F.explode(around).alias("c")).select("b", "c.*")
    l = connected(v.join(near, names).select(F.col("node").alias("a"), "b"))
    v = v.join(l, "node", "left").select(*names, F.coalesce("label", "node").alias("_l"))
    d = p.join(v, names, "left").select(pid, "_l")
    return compact(d.where("_l is not null"), "_l", least).unionByName(d.where("_l is null").select(pid, F.lit(-1).cast("long").alias("label")))


def fill_holes(mask: DataFrame, grid: Grid, lattice: DataFrame) -> DataFrame:
    """The active cells and all others that no path of faces joins to the lattice's border; without a border (all axes periodic) nothing is filled."""
    edge = reduce(lambda a, b: a | b, ((F.col(a) == 0) | (F.col(a) == n - 1) for i, (a, n) in enumerate(zip(grid.axes, grid.dims, strict=True)) if grid.bc(i) != PERIODIC), F.lit(False))
    if all(grid.bc(i) == PERIODIC for i in range(len(grid.dims))):
        return mask.select(*grid.axes)
    empty = lattice.select(*grid.axes).join(mask.select(*grid.axes), list(grid.axes), "left_anti")
    c = cut(components(cut(empty), grid, 2 * len(grid.dims)))
    outside = c.where(edge).select("label").distinct()
    return mask.select(*(F.col(a).cast("int").alias(a) for a in grid.axes)).unionByName(c.join(outside, "label", "left_anti").select(*grid.axes))


def filter_mask(mask: DataFrame, grid: Grid, lattice: DataFrame, thickness: int = 1, close: bool = False, least: int | None = None) -> DataFrame:
    """Opened (or closed) by `thickness`, holes filled, and components of fewer than `least` cells dropped (by default 8 thickness^d)."""
    m = (closing if close else opening)(mask, grid, thickness) if thickness > 0 else mask
    m = cut(fill_holes(cut(m), grid, lattice))
    least = 8 * thickness ** len(grid.dims) if least is None else least
    return components(m, grid, 2 * len(grid.dims), least).where("label >= 0").select(*grid.axes) if least > 0 else m


def distance_to(grid: Grid, centre) -> Column:
    """From cell positions to a point (numbers or columns), by the nearest image on periodic axes."""
    parts = []
    for i, a in enumerate(grid.axes):
        x = F.col(a) * grid.spacing(i) - centre[i]
        parts.append(minimal_image(x, grid.side(i)) if grid.bc(i) == PERIODIC else x)
    return F.sqrt(reduce(add, (x * x for x in parts)))


def region(df: DataFrame, grid: Grid, centre: tuple[float, ...], radius: float) -> DataFrame:
    """One row: the number of cells within `radius` (inclusive) and the least and greatest index on each axis."""
    d = df.where(distance_to(grid, centre) <= radius)
    return d.agg(F.count("*").alias("cells"), *(f(a).alias(f"{n}_{a}") for a in grid.axes for n, f in (("min", F.min), ("max", F.max))))


def cluster_profiles(df: DataFrame, grid: Grid, fields: tuple[str, ...], centres: DataFrame, bins: int, least_radius: float = 10.0, label: str = "label") -> DataFrame:
    """(label, bin, r, one mean a field, count): radial profiles around every cluster of `centres` (label, c{axis}, radius).

    A profile reaches to max(3 radius, `least_radius` spacings). Cells meet only the clusters in whose cube they lie: each cluster is
    keyed on the blocks its cube touches, so no cell is paired with all clusters.
    """
    block = max(1, max(grid.dims) // 8)
    c = centres.select(label, *(F.col(f"c{a}") for a in grid.axes), F.greatest(F.col("radius") * 3, F.lit(least_radius * grid.spacing(0))).alias("_max"))
    keys = []
    for i, a in enumerate(grid.axes):
        n = grid.dims[i]
        low, high = F.floor((F.col(f"c{a}") - F.col("_max")) / grid.spacing(i)).cast("int"), F.ceil((F.col(f"c{a}") + F.col("_max")) / grid.spacing(i)).cast("int")
        high = F.least(high, low + n - 1)
        inside = (lambda x: F.pmod(x, F.lit(n))) if grid.bc(i) == PERIODIC else (lambda x: F.greatest(F.lit(0), F.least(F.lit(n - 1), x)))  # noqa: B023, E731  built at once
        keys.append(F.array_distinct(F.transform(F.sequence(low, high), lambda x: F.floor(inside(x) / block).cast("int"))))  # noqa: B023
    for i, a in enumerate(grid.axes):
        c = c.withColumn(f"_b{a}", F.explode(keys[i]))
    d = df.select("*", *(F.floor(F.col(a) / block).cast("int").alias(f"_b{a}") for a in grid.axes))
    d = d.join(c, [f"_b{a}" for a in grid.axes])
    dist = distance_to(grid, [F.col(f"c{a}") for a in grid.axes])
    d = d.withColumn("bin", F.floor(dist / (F.col("_max") / bins))).where(F.col("bin") < bins)
    g = d.groupBy(label, "bin", "_max").agg(*(F.avg(f).alias(f) for f in fields), F.count("*").alias("count"))
    return g.select(label, "bin", ((F.col("bin") + 0.5) * F.col("_max") / bins).alias("r"), *fields, "count")


def data_kind(points: DataFrame, axes: tuple[str, ...], rtol: float = 1e-5) -> DataFrame:
    """One row an axis: grid (are its distinct values equally spaced?), least and greatest step. Few values or one count as equally spaced."""
    out = []
    for a in axes:
        v = points.select(F.col(a).cast("double").alias("v")).where("v is not null").distinct()
        out.append(_steps(v).agg(F.lit(a).alias("axis"), F.coalesce(F.max("s") - F.min("s") <= F.abs(F.max("s")) * rtol, F.lit(True)).alias("grid"), F.min("s").alias("least"), F.max("s").alias("greatest")))
    return reduce(DataFrame.unionByName, out)


def _steps(values: DataFrame) -> DataFrame:
    """Gaps between neighbours: by rank, so that no one task sorts all values."""
    from .clustering import positions

    p = positions(values, "v")
    return p.join(p.select((F.col("pos") + 1).alias("pos"), F.col("v").alias("w")), "pos").select((F.col("v") - F.col("w")).alias("s"))


def shape_metrics(points: DataFrame, axes: tuple[str, ...], label: str = "label", weight: str | None = None) -> DataFrame:
    """Of each label's covariance: eigenvalues l0.. (descending), elongation, anisotropy and in three dimensions triaxiality and planarity."""
    m = shape_moments(points, axes, label, weight)
    n = len(axes)
    lam = eigen.symmetric(tuple(tuple(F.col(f"m{i}{j}") for j in range(n)) for i in range(n)))
    m = m.select(label, "size", *(f"c{a}" for a in axes), *(x.alias(f"l{i}") for i, x in enumerate(lam)))
    first, last, total = F.col("l0"), F.col(f"l{n - 1}"), reduce(add, (F.col(f"l{i}") for i in range(n)))
    out = [F.when(last > 0, F.sqrt(first / last)).otherwise(1.0).alias("elongation"), F.when(total > 0, 1 - last / first).otherwise(0.0).alias("anisotropy")]
    if n == 3:
        mid = F.col("l1")
        out += [F.when(first > last, (first - mid) / (first - last)).otherwise(0.0).alias("triaxiality"), F.when(first + mid > 0, (mid - last) / (first + mid)).otherwise(0.0).alias("planarity")]
    return m.select("*", *out)


def density_profile(points: DataFrame, axes: tuple[str, ...], bins: int, label: str = "label", weight: str | None = None) -> DataFrame:
    """(label, bin, r, density): weight a shell volume around each label's weighted centre; bins from the least to the greatest distance, the last one closed.

    Centres come from sums of 4,096 rows each, as one long sum of doubles drifts with the number and order of its rows, and are computed once:
    another centre's distances would lie outside the ends.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    blocks = points.where(F.col(label) >= 0).withColumn("_k", F.shiftright(F.monotonically_increasing_id(), 12)).groupBy(label, "_k")
    sums = blocks.agg(F.sum(w).alias("_w"), *(F.sum(w * F.col(a)).alias(f"_{a}") for a in axes))
    centre = cut(sums.groupBy(label).agg(*((F.sum(f"_{a}") / F.sum("_w")).alias(f"c{a}") for a in axes)))
    dist = F.sqrt(reduce(add, ((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in axes)))
    d = points.join(centre.hint("merge"), label).select(label, dist.alias("d"), w.cast("double").alias("w"))
    ends = d.groupBy(label).agg(F.min("d").alias("low"), F.max("d").alias("high"))
    d = d.join(ends.hint("merge"), label)
    width = (F.col("high") - F.col("low")) / bins
    d = d.withColumn("bin", F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("d") - F.col("low")) / width), F.lit(bins - 1))).otherwise(0))
    g = d.groupBy(label, "bin", "low", "high").agg(F.sum("w").alias("w"))
    a, b = F.col("low") + F.col("bin") * width, F.col("low") + (F.col("bin") + 1) * width
    volume = (b * b - a * a) * math.pi if len(axes) == 2 else (b * b * b - a * a * a) * (4 / 3 * math.pi)
    return g.select(label, "bin", ((a + b) / 2).alias("r"), F.when(volume > 0, F.col("w") / volume).alias("density"))


def local_extrema(df: DataFrame, grid: Grid, field: str, radius: int = 1, keys=()) -> DataFrame:
    """Cells that hold the greatest (kind X) or the least (kind O) value of the cube of `radius` cells around them, with positions i L / N - L / 2 (p{axis}).

    A cell's own value travels with the values around it: computed a second time, a mean can differ in its last digit and equal neither end.
    """
    cube = [s for s in itertools.product(range(-radius, radius + 1), repeat=len(grid.dims))]
    home = F.struct(*(F.col(a).cast("int").alias(a) for a in grid.axes))
    sent = df.select(*keys, F.col(field).alias("_f"), home.alias("_h"), F.explode(_moved(grid, cube)).alias("c")).select(*keys, "_f", "c.*", (F.col("_h") == F.col("c")).alias("_own"))
    own = F.max(F.when(F.col("_own"), F.col("_f"))).alias("value")
    d = sent.groupBy(*keys, *grid.axes).agg(F.max("_f").alias("_max"), F.min("_f").alias("_min"), own).where(F.col("_max") > F.col("_min"))
    kind = F.when(F.col("value") == F.col("_max"), "X").when(F.col("value") == F.col("_min"), "O")
    d = d.select(*keys, *grid.axes, "value", kind.alias("kind")).where("kind is not null")
    return d.select("*", *((F.col(a) * grid.spacing(i) - grid.side(i) / 2).alias(f"p{a}") for i, a in enumerate(grid.axes)))


def box_smooth(df: DataFrame, grid: Grid, fields: tuple[str, ...], size: int, keys=()) -> DataFrame:
    """Means over `size` cells along each axis in turn; beyond the edge stands the nearest cell; even windows reach further down. One axis at a time: `size` rows a cell."""
    steps = range(-(size // 2), size - size // 2)
    for i, a in enumerate(grid.axes):
        n = grid.dims[i]
        # the cells whose windows read this one; an edge cell also stands for what lies beyond it
        inner = F.filter(F.array(*(F.col(a).cast("int") - s for s in steps)), lambda x: (x >= 0) & (x < n))  # noqa: B023  built at once
        ends = {0: [t for t in range(n) for s in steps if t + s <= 0], n - 1: [t for t in range(n) for s in steps if t + s >= n - 1]}
        to = inner
        for cell, found in ends.items():
            to = F.when(F.col(a) == cell, F.array(*map(F.lit, found))).otherwise(to)
        others = [x for x in grid.axes if x != a]
        sent = df.select(*keys, *others, *fields, F.explode(to).alias(a))
        df = sent.groupBy(*keys, *grid.axes).agg(*((F.sum(f) / size).alias(f) for f in fields))
    return df


def blend(first: DataFrame, second: DataFrame, height: int, overlap: int, field: str, row: str = "x", col: str = "y") -> DataFrame:
    """Two images one below the other, the last `overlap` rows of the first mixed linearly into the first rows of the second."""
    share = F.when(F.lit(overlap) > 1, (F.col(row) - (height - overlap)) / (overlap - 1)).otherwise(0.5)
    a = first.select(row, col, (F.col(field) * F.when(F.col(row) >= height - overlap, 1 - share).otherwise(1.0)).alias("_v"))
    moved = second.select((F.col(row) + (height - overlap)).cast("int").alias(row), col, F.col(field).alias("_v"))
    b = moved.select(row, col, (F.col("_v") * F.when(F.col(row) < height, share).otherwise(1.0)).alias("_v"))
    return a.unionByName(b).groupBy(row, col).agg(F.sum("_v").alias(field))
