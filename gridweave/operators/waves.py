"""Wave modes, helicity and the null-point analysis of magnetic fields."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import cross, dot, magnitude, normalise, vec
from ..grid import Grid
from .derived import frenet
from .spectral import vector_potential
from .stencil import gradient_tensor

#: Numbers within these of each other count as equal.
RTOL, ATOL = 1e-3, 1e-8


def magnetic_helicity(df: DataFrame, grid: Grid, b: tuple[str, ...], snap: str = "snap") -> DataFrame:
    """a . b on every cell, a the vector potential of b (so b's mean does not count in a)."""
    a = vector_potential(df, grid, b, snap)
    d = df.select(snap, *grid.axes, *b).join(a, [snap, *grid.axes])
    return d.select(snap, *grid.axes, dot(vec("a0", "a1", "a2"), vec(*b)).alias("helicity"))


def displacements(df: DataFrame, k: tuple[str, str, str], alpha: float, tol: float = 1e-8) -> DataFrame:
    """Adds the unit displacements slow0.., fast0.. and alfven0.. of waves along k in a mean field along the last axis.

    alpha is the squared ratio of sound to Alfven speed. k = 0 has none (zero vectors). Along or across the mean field
    the modes degenerate; there the three are an orthonormal basis that begins with k. Columns are built in steps, so that no
    expression holds another many times.
    """
    names = df.columns
    step = lambda d, **c: d.select("*", *(x.alias(n) for n, x in c.items()))
    unit = lambda v: {f"{v}{i}": x for i, x in enumerate(normalise(vec(*(f"_{v}{i}" for i in range(3))), 0.0))}
    d = step(df, _kk=magnitude(vec(*k)))
    d = step(d, **{f"_u{i}": F.when(F.col("_kk") == 0, 0.0).otherwise(F.col(c) / F.col("_kk")) for i, c in enumerate(k)})
    cos, u = F.col("_u2"), vec("_u0", "_u1", "_u2")
    across = F.sqrt(F.col("_u0") * F.col("_u0") + F.col("_u1") * F.col("_u1"))
    root = F.sqrt(F.greatest(F.lit(0.0), F.lit((1.0 + alpha) ** 2) - cos * cos * (4.0 * alpha)))
    d = step(d, _across=across, _root=root, _parallel=F.abs(cos) > 1 - tol, _special=((F.abs(cos) > 1 - tol) | (F.abs(cos) < tol)) & (F.col("_kk") > 0))
    over = lambda i: F.when(F.col("_across") > 0, F.col(f"_u{i}") / F.col("_across")).otherwise(0.0)
    mode = lambda sign: (over(0) * (F.col("_root") * sign + 1.0 + alpha), over(1) * (F.col("_root") * sign + 1.0 + alpha), cos * (F.col("_root") * sign - 1.0 + alpha))
    x, z = (F.lit(1.0), F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    second = tuple(F.when(F.col("_parallel"), a).otherwise(b) for a, b in zip(cross(u, x), cross(u, z), strict=True))
    d = step(d, **{f"_{n}{i}": c for n, v in (("slow", mode(-1.0)), ("fast", mode(1.0)), ("alfven", second)) for i, c in enumerate(v)})
    d = d.select(*names, "_special", "_kk", "_u0", "_u1", "_u2", *(c.alias(n) for v in ("slow", "fast", "alfven") for n, c in unit(v).items()))
    third = cross(vec("alfven0", "alfven1", "alfven2"), u)
    pick = lambda n, i, special: F.when(F.col("_kk") == 0, 0.0).when(F.col("_special"), special).otherwise(F.col(f"{n}{i}")).alias(f"{n}{i}")
    return d.select(*names, *(pick("slow", i, F.col(f"_u{i}")) for i in range(3)), *(pick("fast", i, third[i]) for i in range(3)), *(pick("alfven", i, F.col(f"alfven{i}")) for i in range(3)))


def wave_modes(df: DataFrame, field: tuple[str, ...], k: tuple[str, str, str], alpha: float) -> DataFrame:
    """Complex amplitudes ({c}_re, {c}_im) at wavenumbers k -> their parts along the three displacements: slow, fast and alfven (_re, _im)."""
    d = displacements(df, k, alpha)
    part = lambda n, p: dot(vec(*(f"{n}{i}" for i in range(3))), vec(*(f"{c}_{p}" for c in field)))
    return d.select(*df.columns, *(part(n, p).alias(f"{n}_{p}") for n in ("slow", "fast", "alfven") for p in ("re", "im")))


def null_jacobian(df: DataFrame, grid: Grid, b: tuple[str, ...], keys=(), stencil: int = 2, traceless: bool = False) -> DataFrame:
    """The gradient of b in the basis (binormal, normal, tangent), of which the first two rows and columns count.

    trace, d (4 det - trace^2), eigenvalues e1, e2 (_re, _im), the current j3 along b, j_threshold, and the ratio of the two.
    """
    basis = frenet(df, grid, b, keys, stencil)
    g = gradient_tensor(df, grid, b, keys, stencil, (), "_t")
    d = g.join(basis, [*keys, *grid.axes])
    t = [[F.col(f"_t{i}{j}") for j in range(3)] for i in range(3)]
    if traceless:
        third = (t[0][0] + t[1][1] + t[2][2]) / 3
        t = [[t[i][j] - third if i == j else t[i][j] for j in range(3)] for i in range(3)]
    rows = [vec("b0", "b1", "b2"), vec("n0", "n1", "n2")]
    m = [[reduce(add, (p[i] * t[i][j] * q[j] for i in range(3) for j in range(3))) for q in rows] for p in rows]
    d = d.select(*keys, *grid.axes, *(m[i][j].alias(f"m{i}{j}") for i in range(2) for j in range(2)))
    m00, m01, m10, m11 = (F.col(f"m{i}{j}") for i in range(2) for j in range(2))
    d = d.select("*", (m00 + m11).alias("trace"), ((m00 * m11 - m01 * m10) * 4 - (m00 + m11) * (m00 + m11)).alias("d"))
    trace, disc = F.col("trace"), F.col("d")
    root = F.sqrt(F.abs(disc)) / 2
    re, im = F.when(disc <= 0, root).otherwise(0.0), F.when(disc > 0, -root).otherwise(0.0)
    j3, edge = m10 - m01, F.sqrt((m00 - m11) * (m00 - m11) + (m01 + m10) * (m01 + m10))
    out = {"trace": trace, "d": disc, "e1_re": trace / 2 + re, "e1_im": im, "e2_re": trace / 2 - re, "e2_im": -im, "j3": j3, "j_threshold": edge, "ratio": F.when(j3 != 0, edge / j3)}
    return d.select(*keys, *grid.axes, *(c.alias(n) for n, c in out.items()))


#: The kinds of critical points that `critical_points` tells apart; a point may be of several.
KINDS = ("x_3d", "o_3d_repelling", "o_3d_attracting", "repelling_3d", "attracting_3d", "antiparallel_3d", "x_2d", "o_2d", "antiparallel_2d")


def critical_points(df: DataFrame) -> DataFrame:
    """Adds a boolean column for each of `KINDS` to the result of `null_jacobian`."""
    tr, j, edge, e1, e2 = (F.col(c) for c in ("trace", "j3", "j_threshold", "e1_re", "e2_re"))
    flat = F.abs(tr) <= ATOL
    real, turning = F.abs(j) < edge, F.abs(j) > edge
    equal = F.abs(F.abs(j) - edge) <= F.lit(ATOL) + edge * RTOL
    out = (
        ~flat & real & (e1 * e2 < 0), ~flat & turning & (tr > 0), ~flat & turning & (tr < 0), ~flat & real & (e1 > 0) & (e2 > 0), ~flat & real & (e1 < 0) & (e2 < 0), ~flat & equal,
        flat & real, flat & turning, flat & equal,
    )
    return df.select("*", *(c.alias(n) for n, c in zip(KINDS, out, strict=True)))


def tnb_components(df: DataFrame, grid: Grid, basis_of: tuple[str, ...], f: tuple[str, ...], keys=(), stencil: int = 2) -> DataFrame:
    """ft, fn, fb: a field along the tangent, normal and binormal of another's lines."""
    d = frenet(df, grid, basis_of, keys, stencil).join(df.select(*keys, *grid.axes, *(F.col(c).alias(f"_f{i}") for i, c in enumerate(f))), [*keys, *grid.axes])
    x = vec("_f0", "_f1", "_f2")
    return d.select(*keys, *grid.axes, *(dot(x, vec(*(f"{b}{i}" for i in range(3)))).alias(f"f{b}") for b in "tnb"))
