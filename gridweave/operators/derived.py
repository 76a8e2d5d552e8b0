"""Composite physical quantities: one or two stencil passes and pointwise algebra."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import cross, dot, normalise, scale, vec
from ..grid import Grid
from .stencil import curl, derivatives, gradient_tensor

MU0 = 4 * math.pi


def _cols(prefix: str, n: int) -> tuple[str, ...]:
    return tuple(f"{prefix}{i}" for i in range(n))


def kinetic_helicity(df: DataFrame, grid: Grid, v: tuple[str, ...], keys=(), stencil: int = 2) -> DataFrame:
    """curl(v) . v"""
    d = curl(df, grid, v, keys, stencil, v, "_c")
    return d.select(*keys, *grid.axes, dot(vec(*_cols("_c", 3)), vec(*v)).alias("helicity"))


def current_helicity(df: DataFrame, grid: Grid, b: tuple[str, ...], keys=(), stencil: int = 2, mu0: float = MU0) -> DataFrame:
    """(curl(b) / mu0) . b"""
    d = kinetic_helicity(df, grid, b, keys, stencil)
    return d.withColumn("helicity", F.col("helicity") / mu0)


def tension(df: DataFrame, grid: Grid, b: tuple[str, ...], keys=(), stencil: int = 2, mu0: float = MU0) -> DataFrame:
    """(b . grad) b / mu0, as f0, f1, f2."""
    d = gradient_tensor(df, grid, b, keys, stencil, b, "_t")
    n = len(b)
    return d.select(*keys, *grid.axes, *((reduce(add, (F.col(x) * F.col(f"_t{i}{j}") for j, x in enumerate(b))) / mu0).alias(f"f{i}") for i in range(n)))


def heating_rate(df: DataFrame, grid: Grid, pressure: str, v: tuple[str, ...], keys=(), stencil: int = 2) -> DataFrame:
    """One row a snapshot: the mean of -p div(v)."""
    d = derivatives(df, grid, {f"_{i}": (x, i, 1) for i, x in enumerate(v)}, (pressure,), keys, stencil)
    div = reduce(add, (F.col(f"_{i}") for i in range(len(v))))
    return d.groupBy(*keys).agg((-F.avg(F.col(pressure) * div)).alias("heating"))


def vorticity_terms(df: DataFrame, grid: Grid, v: tuple[str, ...], density: str | None = None, pressure: str | None = None, keys=(), stencil: int = 2) -> DataFrame:
    """w (vorticity), c (compression), s (stretching by the traceless strain) and, with density and pressure, b (baroclinic)."""
    wanted = {f"_t{i}{j}": (x, j, 1) for i, x in enumerate(v) for j in range(3)}
    if density and pressure:
        wanted |= {f"_{k}{j}": (f, j, 1) for k, f in (("r", density), ("p", pressure)) for j in range(3)}
    d = derivatives(df, grid, wanted, (density,) if density and pressure else (), keys, stencil)
    t = [[F.col(f"_t{i}{j}") for j in range(3)] for i in range(3)]
    w = (t[2][1] - t[1][2], t[0][2] - t[2][0], t[1][0] - t[0][1])
    div = t[0][0] + t[1][1] + t[2][2]
    out = [x.alias(f"w{i}") for i, x in enumerate(w)] + [(x * div * (-2 / 3)).alias(f"c{i}") for i, x in enumerate(w)]
    strain = [[(t[i][j] + t[j][i]) * 0.5 - (div / 3 if i == j else F.lit(0.0)) for j in range(3)] for i in range(3)]
    out += [reduce(add, (w[i] * strain[i][j] for i in range(3))).alias(f"s{j}") for j in range(3)]
    if density and pressure:
        b = cross(vec(*_cols("_p", 3)), vec(*_cols("_r", 3)))
        out += [(x / (F.col(density) * F.col(density))).alias(f"b{i}") for i, x in enumerate(b)]
    return d.select(*keys, *grid.axes, *out)


def frenet(df: DataFrame, grid: Grid, f: tuple[str, ...], keys=(), stencil: int = 2) -> DataFrame:
    """Tangent t, normal n, binormal b of the field lines of f, and their curvature."""
    d = gradient_tensor(df, grid, f, keys, stencil, f, "_t")
    x = vec(*f)
    adv = tuple(reduce(add, (x[j] * F.col(f"_t{i}{j}") for j in range(3))) for i in range(3))
    ff = dot(x, x)
    k = tuple(F.when(ff > 1e-10, a / ff - c * dot(x, adv) / (ff * ff)).otherwise(0.0) for a, c in zip(adv, x, strict=True))
    d = d.select(*keys, *grid.axes, *(c.alias(f"t{i}") for i, c in enumerate(normalise(x))), *(c.alias(f"k{i}") for i, c in enumerate(k)))
    kv = vec("k0", "k1", "k2")
    n = normalise(kv)
    d = d.select(*keys, *grid.axes, "t0", "t1", "t2", *(c.alias(f"n{i}") for i, c in enumerate(n)), F.sqrt(dot(kv, kv)).alias("curvature"))
    return d.select("*", *(c.alias(f"b{i}") for i, c in enumerate(cross(vec("t0", "t1", "t2"), vec("n0", "n1", "n2")))))


def in_basis(f, t, n, b) -> tuple[Column, Column, Column]:
    """Components of f along the vectors of a basis."""
    return dot(f, t), dot(f, n), dot(f, b)


def stream_velocity(df: DataFrame, grid: Grid, psi: str, keys=(), stencil: int = 2) -> DataFrame:
    """(d psi / dy, -d psi / dx) in the plane."""
    d = derivatives(df, grid, {"_x": (psi, 0, 1), "_y": (psi, 1, 1)}, (), keys, stencil)
    return d.select(*keys, *grid.axes, F.col("_y").alias("vx"), (-F.col("_x")).alias("vy"))


def momentum(rho: Column, v):
    return scale(v, rho)


def fused_magnitude(df: DataFrame, comps: tuple[str, ...], name: str, centred: bool = False, zero_mean: bool = False) -> DataFrame:
    """Adds the magnitude of a vector; `centred` takes the mean from each component first, `zero_mean` the mean from the magnitude.

    Each mean is one aggregation, whose single row is broadcast. Rows with a null component get null and do not count in the magnitude's mean.
    """

    def mean(d: DataFrame, cols: tuple[str, ...]) -> DataFrame:
        return d.crossJoin(F.broadcast(d.agg(*(F.avg(c).alias(f"_m_{c}") for c in cols))))  # the right side is one row

    d = mean(df, comps) if centred else df
    parts = [F.col(c) - F.col(f"_m_{c}") if centred else F.col(c) for c in comps]
    d = d.withColumn(name, F.sqrt(reduce(add, (x * x for x in parts)))).drop(*(f"_m_{c}" for c in comps))
    return mean(d, (name,)).withColumn(name, F.col(name) - F.col(f"_m_{name}")).drop(f"_m_{name}") if zero_mean else d
