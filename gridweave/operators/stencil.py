"""Finite differences: every cell sends weighted contributions to its neighbours, one aggregation sums them all.

All derivatives asked for (any axis, order and field) share one explode and one shuffle on the cell.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import DIRICHLET, PERIODIC, Grid

# Central-difference weights by number of points, {offset: weight}.
FIRST = {
    2: {1: 1 / 2},
    4: {1: 8 / 12, 2: -1 / 12},
    6: {1: 45 / 60, 2: -9 / 60, 3: 1 / 60},
    8: {1: 4 / 5, 2: -1 / 5, 3: 4 / 105, 4: -1 / 280},
}
SECOND = {
    2: {0: -2.0, 1: 1.0},
    4: {0: -30 / 12, 1: 16 / 12, 2: -1 / 12},
    6: {0: -490 / 180, 1: 270 / 180, 2: -27 / 180, 3: 2 / 180},
    8: {0: -14350 / 5040, 1: 8064 / 5040, 2: -1008 / 5040, 3: 128 / 5040, 4: -9 / 5040},
}


def weights(order: int, stencil: int) -> dict[int, float]:
    """{signed offset: weight}; a derivative is the sum of weight * f(i + offset) / dr ** order."""
    if stencil not in FIRST or order not in (1, 2):
        raise ValueError("stencils have 2, 4, 6 or 8 points, and derivatives order 1 or 2")
    half = (FIRST if order == 1 else SECOND)[stencil]
    sign = -1 if order == 1 else 1
    return {o: w for k, v in half.items() for o, w in ({k: v, -k: sign * v} if k else {0: v}).items()}


def derivatives(df: DataFrame, grid: Grid, wanted: dict[str, tuple[str, int, int]], keep: tuple[str, ...] = (), keys: tuple[str, ...] = (), stencil: int = 2) -> DataFrame:
    """wanted: {output: (field, axis, order)} -> keys, axes, kept fields and outputs, for every cell.

    Periodic axes wrap, Neumann axes repeat the edge cell, Dirichlet axes are zero outside. A missing
    cell or a null value counts as zero in its neighbours. `keys` are further columns (snapshots).
    """
    axes = grid.axes
    fields = sorted({f for f, _, _ in wanted.values()} | set(keep))
    sends = []  # (axis, shift of the target, order)
    for axis, order in sorted({(a, o) for _, a, o in wanted.values()}):
        n, w = grid.dims[axis], weights(order, stencil)
        here = F.col(axes[axis])
        for off, c in w.items():
            c = c / grid.spacing(axis) ** order
            move = lambda to, k, a=axis, o=order: F.struct(*((to if x == a else F.col(axes[x])).cast("int").alias(axes[x]) for x in range(len(axes))), F.lit(a * 10 + o).alias("_d"), F.lit(k).alias("_c"))
            if grid.bc(axis) == PERIODIC:
                sends.append(F.array(move(F.pmod(here - off, F.lit(n)), c)))
                continue
            inside = F.when((here - off >= 0) & (here - off < n), F.array(move(here - off, c))).otherwise(F.array().cast(_type(axes)))
            sends.append(inside)
            if grid.bc(axis) != DIRICHLET and off:
                # cells whose neighbour lies outside see the edge cell instead
                edge = n - 1 if off > 0 else 0
                seen = range(max(0, n - off), n) if off > 0 else range(0, min(n, -off))
                sends.append(F.when(here == edge, F.array(*(move(F.lit(i), c) for i in seen))).otherwise(F.array().cast(_type(axes))))
    own = F.array(F.struct(*(F.col(a).cast("int").alias(a) for a in axes), F.lit(-1).alias("_d"), F.lit(1.0).alias("_c")))
    e = df.select(*keys, *(F.col(f).cast("double").alias(f) for f in fields), F.explode(F.concat(own, *sends)).alias("_s"))
    e = e.select(*keys, *fields, *(F.col(f"_s.{a}").alias(a) for a in axes), F.col("_s._d").alias("_d"), F.col("_s._c").alias("_c"))
    outs = [F.sum(F.when(F.col("_d") == axis * 10 + order, F.col("_c") * F.col(f)).otherwise(0.0)).alias(name) for name, (f, axis, order) in wanted.items()]
    kept = [F.max(F.when(F.col("_d") == -1, F.col(f))).alias(f) for f in keep]
    return e.groupBy(*keys, *axes).agg(*kept, *outs, F.max(F.col("_d") == -1).alias("_own")).where("_own").drop("_own")


def _type(axes) -> str:
    return "array<struct<" + ", ".join(f"{a}: int" for a in axes) + ", _d: int, _c: double>>"


def gradient(df: DataFrame, grid: Grid, field: str, keys=(), stencil: int = 2, prefix: str = "g") -> DataFrame:
    """g0, g1 (, g2): the derivatives of a scalar along each axis."""
    return derivatives(df, grid, {f"{prefix}{a}": (field, a, 1) for a in range(len(grid.dims))}, (field,), keys, stencil)


def gradient_tensor(df: DataFrame, grid: Grid, fields: tuple[str, ...], keys=(), stencil: int = 2, keep=(), prefix: str = "t") -> DataFrame:
    """t{i}{j}: the derivative of component i along axis j, all in one shuffle."""
    return derivatives(df, grid, {f"{prefix}{i}{j}": (f, j, 1) for i, f in enumerate(fields) for j in range(len(grid.dims))}, tuple(keep) or fields, keys, stencil)


def curl(df: DataFrame, grid: Grid, fields: tuple[str, ...], keys=(), stencil: int = 2, keep=(), prefix: str = "c") -> DataFrame:
    """c0, c1, c2, or c0 alone in the plane; a line has no curl."""
    if len(grid.dims) == 1:
        raise ValueError("curl needs two or three axes")
    pairs = [(1, 2), (2, 0), (0, 1)] if len(grid.dims) == 3 else [(0, 1)]
    wanted = {f"_{j}{i}": (fields[j], i, 1) for a, b in pairs for i, j in ((a, b), (b, a))}
    d = derivatives(df, grid, wanted, tuple(keep), keys, stencil)
    return d.select(*keys, *grid.axes, *keep, *((F.col(f"_{b}{a}") - F.col(f"_{a}{b}")).alias(f"{prefix}{n}") for n, (a, b) in enumerate(pairs)))


def divergence(df: DataFrame, grid: Grid, fields: tuple[str, ...], keys=(), stencil: int = 2, keep=(), name: str = "div") -> DataFrame:
    d = derivatives(df, grid, {f"_{i}": (f, i, 1) for i, f in enumerate(fields)}, tuple(keep), keys, stencil)
    return d.select(*keys, *grid.axes, *keep, reduce(add, (F.col(f"_{i}") for i in range(len(fields)))).alias(name))


def laplacian(df: DataFrame, grid: Grid, fields: tuple[str, ...], keys=(), stencil: int = 2, prefix: str = "lap_") -> DataFrame:
    """lap_<field> of one or more fields (a vector's components), in one shuffle."""
    d = derivatives(df, grid, {f"_{f}{a}": (f, a, 2) for f in fields for a in range(len(grid.dims))}, fields, keys, stencil)
    return d.select(*keys, *grid.axes, *fields, *(reduce(add, (F.col(f"_{f}{a}") for a in range(len(grid.dims)))).alias(f"{prefix}{f}") for f in fields))


def advective(df: DataFrame, grid: Grid, u: tuple[str, ...], w: tuple[str, ...], keys=(), stencil: int = 2, prefix: str = "adv") -> DataFrame:
    """(u_j d_j) w_i."""
    d = gradient_tensor(df, grid, w, keys, stencil, tuple(dict.fromkeys((*u, *w))), "_t")
    return d.select(*keys, *grid.axes, *(reduce(add, (F.col(x) * F.col(f"_t{i}{j}") for j, x in enumerate(u))).alias(f"{prefix}{i}") for i in range(len(w))))
