"""Shell-to-shell transfer: one inverse transform a shell and field, then sums over pairs of shells on a cell."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import Grid
from .spectral import transform, wavenumber
from .stencil import divergence, gradient_tensor


def log_bins(n: int) -> list[float]:
    """Edges 1, then 4 * 2 ** ((i - 1) / 4) from i = 0 (3.364, 4, 4.757 ...) for a lattice of n cells a side."""
    return [1.0, *(4.0 * 2 ** ((i - 1) / 4) for i in range( math.ceil(4 * math.log2(n / 8) + 2)))]


def user_bins(low: float, high: float, n: int) -> list[float]:
    """n edges in equal ratios; one edge is the lower bound."""
    return [low * (high / low) ** (i / max(1, n - 1)) for i in range(n)]


def shells_of(df: DataFrame, grid: Grid, cols: tuple[str, ...], edges: list[float], snap: str = "snap") -> DataFrame:
    """The parts of fields in each shell edges[i] <= |k| <= edges[i + 1]: snap, shell, axes, columns. One forward transform."""
    t = transform(df, grid, cols, snap=snap)
    k = F.sqrt(reduce(add, (wavenumber(grid, a).cast("double") ** 2 for a in range(len(grid.dims)))))
    s = t.select("*", k.alias("_k"), F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 2))).alias("shell"))
    e = F.array(*map(F.lit, edges))
    inside = (F.col("_k") >= F.get(e, F.col("shell"))) & (F.col("_k") <= F.get(e, F.col("shell") + 1))
    s = s.select(F.struct(snap, "shell").alias("_id"), *grid.axes, *(F.when(inside, F.col(f"{c}_{p}")).otherwise(0.0).alias(f"{c}_{p}") for c in cols for p in ("re", "im")))
    s = s.withColumn("_n", F.col(f"_id.{snap}") * len(edges) + F.col("_id.shell")).drop("_id")
    back = transform(s, grid, cols, True, "_n")
    return back.select(F.floor(F.col("_n") / len(edges)).alias(snap), F.pmod(F.col("_n"), F.lit(len(edges))).alias("shell"), *grid.axes, *(F.col(f"{c}_re").alias(c) for c in cols))


def advection_transfer(df: DataFrame, grid: Grid, carrier: tuple[str, ...], field: tuple[str, ...], edges: list[float], snap: str = "snap", stencil: int = 4) -> DataFrame:
    """(snap, k, q, advective, compressive): -sum f_K . (u . grad) f_Q and -1/2 sum f_K . f_Q div(u).

    With field = magnetic field these are Tbb_a and Tbb_c, with the velocity Tuu_a and Tuu_c.
    """
    parts = shells_of(df, grid, field, edges, snap)
    grads = gradient_tensor(parts, grid, field, (snap, "shell"), stencil, field, "_t")
    u = divergence(df, grid, carrier, (snap,), stencil, carrier, "_div")
    u = u.select(snap, *grid.axes, "_div", *(F.col(c).alias(f"_u{j}") for j, c in enumerate(carrier)))
    q = grads.join(u, [snap, *grid.axes])
    q = q.select(
        snap, *grid.axes, F.col("shell").alias("q"), *(F.col(f).alias(f"_q{i}") for i, f in enumerate(field)), "_div",
        *(reduce(add, (F.col(f"_u{j}") * F.col(f"_t{i}{j}") for j in range(len(carrier)))).alias(f"_a{i}") for i in range(len(field))),
    )
    k = parts.select(snap, *grid.axes, F.col("shell").alias("k"), *(F.col(f).alias(f"_k{i}") for i, f in enumerate(field)))
    both = k.join(q, [snap, *grid.axes])
    adv = reduce(add, (F.col(f"_k{i}") * F.col(f"_a{i}") for i in range(len(field))))
    comp = reduce(add, (F.col(f"_k{i}") * F.col(f"_q{i}") for i in range(len(field)))) * F.col("_div")
    return both.groupBy(snap, "k", "q").agg((-F.sum(adv)).alias("advective"), (F.sum(comp) * -0.5).alias("compressive"))


def missing_pairs(spark, n: int, done: DataFrame) -> DataFrame:
    """The (k, q) pairs of n shells that `done` does not have yet."""
    want = spark.range(n * n).select((F.col("id") / n).cast("int").alias("k"), (F.col("id") % n).cast("int").alias("q"))
    return want.join(done.select("k", "q").distinct(), ["k", "q"], "left_anti")
