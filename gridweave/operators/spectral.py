"""Fourier operators on lattices: a two-pass slab transform, then plain columns.

Pass one transforms all axes but the first inside slabs of the first axis, pass two the first axis
inside slabs of the second. Slabs come sorted by snapshot and are transformed some at a time, so the memory is that of
one slab or of `CHUNK` rows, whatever the number of snapshots. Spectra, filters and projections are column expressions.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import Grid

SLAB, CHUNK = 4, 1 << 15


def _pass(df: DataFrame, grid: Grid, cols: list[str], axis: int, over: tuple[int, ...], inverse: bool, snap: str, slab: int) -> DataFrame:
    axes, dims = grid.axes, grid.dims
    kind = dict(df.dtypes)[snap]
    schema = ", ".join([f"{snap} {kind}", *(f"{a} int" for a in axes), *(f"{c}_{p} double" for c in cols for p in ("re", "im"))])

    def run(t: pa.Table) -> pa.Table:
        s = np.unique(t.column(snap).to_numpy(), return_inverse=True)[1]
        at = [t.column(a).to_numpy().astype(np.int64) for a in axes]
        order = np.lexsort((*at[::-1], s))
        w = len(np.unique(at[axis]))
        shape = (int(s.max()) + 1, *(w if i == axis else n for i, n in enumerate(dims)))
        if len(order) != np.prod(shape):
            raise ValueError("every cell of a lattice has to be there once")
        out = {c: t.column(c).take(pa.array(order)) for c in (snap, *axes)}
        for c in cols:
            v = t.column(f"{c}_re").to_numpy()[order] + 1j * t.column(f"{c}_im").to_numpy()[order]
            v = v.reshape(shape)
            ax = tuple(i + 1 for i in over)
            v = (np.fft.ifftn(v, axes=ax, norm="forward") if inverse else np.fft.fftn(v, axes=ax, norm="forward")).ravel()
            out[f"{c}_re"], out[f"{c}_im"] = pa.array(np.ascontiguousarray(v.real)), pa.array(np.ascontiguousarray(v.imag))
        return pa.table(out)

    def slabs(batches):
        """Whole slabs of about CHUNK rows at a time; rows of one slab come in a row."""
        held, n, most = [], 0, CHUNK

        def cut_at(t: pa.Table, last: bool):
            b, s = t.column("_b").to_numpy(), np.unique(t.column(snap).to_numpy(), return_inverse=True)[1]
            end = len(s) if last else int(max(np.flatnonzero((b[1:] != b[:-1]) | (s[1:] != s[:-1])) + 1, default=0))
            for x in np.unique(b[:end]):
                yield from run(t.slice(0, end).filter(pa.array(b[:end] == x)).drop(["_b"])).to_batches()
            return t.slice(end)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                rest = yield from cut_at(pa.Table.from_batches(held).combine_chunks(), False)
                held, n, most = rest.to_batches(), rest.num_rows, max(CHUNK, 2 * rest.num_rows)  # a larger slab waits until it is whole
        if held:
            yield from cut_at(pa.Table.from_batches(held).combine_chunks(), True)

    d = df.withColumn("_b", (F.col(axes[axis]) / slab).cast("int"))
    return d.repartition(snap, "_b").sortWithinPartitions(snap, "_b").mapInArrow(slabs, schema)


def transform(df: DataFrame, grid: Grid, cols: tuple[str, ...], inverse: bool = False, snap: str = "snap", slab: int = SLAB) -> DataFrame:
    """Complex columns {c}_re, {c}_im (real columns c also do) -> their transform at the same positions.

    The forward transform divides by the number of cells. After it, x, y, z are frequency indices 0 .. N - 1
    (`wavenumber` signs them). Incomplete lattices raise.
    """
    have = set(df.columns)
    d = df.select(snap, *(F.col(a).cast("int").alias(a) for a in grid.axes), *(x for c in cols for x in ((F.col(f"{c}_re"), F.col(f"{c}_im")) if f"{c}_re" in have else (F.col(c).cast("double").alias(f"{c}_re"), F.lit(0.0).alias(f"{c}_im")))))
    n = len(grid.dims)
    d = _pass(d, grid, list(cols), 0, tuple(range(1, n)), inverse, snap, slab)
    return _pass(d, grid, list(cols), 1, (0,), inverse, snap, slab)


def wavenumber(grid: Grid, axis: int) -> Column:
    n, i = grid.dims[axis], F.col(grid.axes[axis])
    return F.when(i * 2 >= n, i - n).otherwise(i)


def angular(grid: Grid) -> tuple[Column, ...]:
    return tuple(wavenumber(grid, a) * (2 * math.pi / grid.side(a)) for a in range(len(grid.dims)))


def power(df: DataFrame, grid: Grid, cols: tuple[str, ...], snap: str = "snap") -> DataFrame:
    """Power at every wavenumber (scalar, vector or tensor: the sum over components): snap, kx, ky (, kz), p."""
    t = transform(df, grid, cols, snap=snap)
    p = reduce(add, (F.col(f"{c}_re") * F.col(f"{c}_re") + F.col(f"{c}_im") * F.col(f"{c}_im") for c in cols))
    return t.select(snap, *(wavenumber(grid, a).alias(f"k{x}") for a, x in enumerate(grid.axes)), p.alias("p"))


def mixed_power(df: DataFrame, grid: Grid, a: tuple[str, ...], b: tuple[str, ...], snap: str = "snap") -> DataFrame:
    """|sum a conj(b)| and its real part at every wavenumber."""
    t = transform(df, grid, tuple(dict.fromkeys((*a, *b))), snap=snap)
    re = reduce(add, (F.col(f"{x}_re") * F.col(f"{y}_re") + F.col(f"{x}_im") * F.col(f"{y}_im") for x, y in zip(a, b, strict=True)))
    im = reduce(add, (F.col(f"{x}_im") * F.col(f"{y}_re") - F.col(f"{x}_re") * F.col(f"{y}_im") for x, y in zip(a, b, strict=True)))
    return t.select(snap, *(wavenumber(grid, i).alias(f"k{x}") for i, x in enumerate(grid.axes)), F.sqrt(re * re + im * im).alias("p"), re.alias("p_re"))


def _centred(grid: Grid, axis: int) -> Column:
    """Distance of the shifted index from the middle of the cube, (N - 1) / 2."""
    n = grid.dims[axis]
    return F.pmod(F.col(f"k{grid.axes[axis]}") + n // 2, F.lit(n)) - (n - 1) / 2


def shells(spectrum: DataFrame, grid: Grid, snap: str = "snap", exact: bool = False) -> DataFrame:
    """Sums over shells: snap, bin, k, power. N // 2 bins from 0.5, right-open; what lies outside is dropped.

    The distance is taken from the cube's middle, or (`exact`) from wavenumber zero.
    """
    r = F.sqrt(reduce(add, (x * x for x in ((F.col(f"k{a}").cast("double") if exact else _centred(grid, i)) for i, a in enumerate(grid.axes)))))
    nb = grid.dims[0] // 2
    width = (nb - 0.5) / nb
    b = F.floor((r - 0.5) / width)
    d = spectrum.select(snap, b.alias("bin"), "p").where((F.col("bin") >= 0) & (F.col("bin") < nb))
    d = d.groupBy(snap, "bin").agg(F.sum("p").alias("power"))
    return d.select(snap, "bin", F.ceil(F.lit(0.5) + (F.col("bin") + 0.5) * width).alias("k"), "power")


def cylinders(spectrum: DataFrame, grid: Grid, snap: str = "snap") -> DataFrame:
    """Sums over (k perpendicular, |k parallel|) bins around the last axis."""
    nb = grid.dims[0] // 2
    width = (nb - 0.5) / nb
    x = [_centred(grid, i) for i in range(3)]
    b = lambda r: F.floor((r - 0.5) / width)
    d = spectrum.select(snap, b(F.sqrt(x[0] * x[0] + x[1] * x[1])).alias("bin_perp"), b(F.abs(x[2])).alias("bin_para"), "p")
    d = d.where(F.col("bin_perp").between(0, nb - 1) & F.col("bin_para").between(0, nb - 1))
    return d.groupBy(snap, "bin_perp", "bin_para").agg(F.sum("p").alias("power"))


def scales(spectrum: DataFrame, snap: str = "snap") -> DataFrame:
    """Of a 1-D spectrum (k, power): micro, energy and correlation scales and the peak."""
    p = F.sum("power")
    return spectrum.groupBy(snap).agg(
        F.sqrt(F.sum(F.col("power") * F.col("k") * F.col("k")) / p).alias("micro"), (F.sum(F.col("power") * F.col("k")) / p).alias("energy"),
        (F.sum(F.col("power") / F.col("k")) / p).alias("correlation"), F.max_by("k", "power").alias("peak"),
    )


def _back(t: DataFrame, grid: Grid, out: tuple[str, ...], snap: str) -> DataFrame:
    return transform(t, grid, out, True, snap).select(snap, *grid.axes, *(F.col(f"{c}_re").alias(c) for c in out))


def shell_filter(df: DataFrame, grid: Grid, cols: tuple[str, ...], low: float, high: float, snap: str = "snap", gaussian: float | None = None) -> DataFrame:
    """What stands in the shell low < |k| <= high (wavenumbers times 2 pi / L); with `gaussian` a weight around its middle."""
    t = transform(df, grid, cols, snap=snap)
    k = F.sqrt(reduce(add, (x * x for x in angular(grid))))
    u = 2 * math.pi / grid.side(0)
    w = F.exp(-((k - (low + high) * u / 2) ** 2) / (2 * gaussian * gaussian)) if gaussian else F.when((k > low * u) & (k <= high * u), 1.0).otherwise(0.0)
    t = t.select(snap, *grid.axes, *((F.col(f"{c}_{p}") * w).alias(f"{c}_{p}") for c in cols for p in ("re", "im")))
    return _back(t, grid, cols, snap)


def helmholtz(df: DataFrame, grid: Grid, cols: tuple[str, ...], snap: str = "snap") -> DataFrame:
    """irr0.. (curl-free) and sol0.. (divergence-free); the mean belongs to the latter."""
    t = transform(df, grid, cols, snap=snap)
    k = angular(grid)
    kk = reduce(add, (x * x for x in k))
    n = len(cols)
    dotk = {p: reduce(add, (k[i] * F.col(f"{c}_{p}") for i, c in enumerate(cols))) / F.when(kk == 0, 1.0).otherwise(kk) for p in ("re", "im")}
    irr = [(k[i] * dotk[p]).alias(f"irr{i}_{p}") for i in range(n) for p in ("re", "im")]
    sol = [(F.col(f"{c}_{p}") - k[i] * dotk[p]).alias(f"sol{i}_{p}") for i, c in enumerate(cols) for p in ("re", "im")]
    return _back(t.select(snap, *grid.axes, *irr, *sol), grid, tuple(f"{x}{i}" for x in ("irr", "sol") for i in range(n)), snap)


def vector_potential(df: DataFrame, grid: Grid, cols: tuple[str, ...], snap: str = "snap") -> DataFrame:
    """a0, a1, a2 with curl(a) = b less its mean (i k x b / k^2); in the plane a0 is the stream function."""
    t = transform(df, grid, cols, snap=snap)
    k = angular(grid)
    kk = reduce(add, (x * x for x in k))
    pairs = [(1, 2), (2, 0), (0, 1)] if len(cols) == 3 else [(0, 1)]
    out = []
    for m, (i, j) in enumerate(pairs):
        c = {p: k[i] * F.col(f"{cols[j]}_{p}") - k[j] * F.col(f"{cols[i]}_{p}") for p in ("re", "im")}
        out += [F.when(kk == 0, 0.0).otherwise(-c["im"] / kk).alias(f"a{m}_re"), F.when(kk == 0, 0.0).otherwise(c["re"] / kk).alias(f"a{m}_im")]
    return _back(t.select(snap, *grid.axes, *out), grid, tuple(f"a{m}" for m in range(len(pairs))), snap)


def power_law_field(spark, grid: Grid, slope: float, seed: int = 1, snaps: int = 1) -> DataFrame:
    """Random isotropic fields with a power-law spectrum."""
    cells = spark.range(snaps * grid.cells).select((F.col("id") / grid.cells).cast("long").alias("snap"), *_axes_of(grid, F.col("id") % grid.cells))
    k = F.sqrt(reduce(add, (wavenumber(grid, a).cast("double") ** 2 for a in range(len(grid.dims)))))
    amp = F.when(k == 0, 0.0).otherwise(k ** (-(slope + 2) / 2) * 10)
    return _back(cells.select("snap", *grid.axes, (F.randn(seed) * amp).alias("f_re"), (F.randn(seed + 1) * amp).alias("f_im")), grid, ("f",), "snap")


def shell_filter_plane(df: DataFrame, grid: Grid, cols: tuple[str, ...], low: float, high: float, snap: str = "snap") -> DataFrame:
    """In the plane: what stands in low <= |k| <= high, both ends included, k = 2 pi n / L as it is (bounds are not scaled)."""
    t = transform(df, grid, cols, snap=snap)
    k = F.sqrt(reduce(add, (x * x for x in angular(grid))))
    inside = (k >= low) & (k <= high)
    return _back(t.select(snap, *grid.axes, *(F.when(inside, F.col(f"{c}_{p}")).otherwise(0.0).alias(f"{c}_{p}") for c in cols for p in ("re", "im"))), grid, cols, snap)


def _along(df: DataFrame, grid: Grid, cols: tuple[str, ...], axis: int, snap: str) -> DataFrame:
    """Transform along one axis only, in slabs of another; {c}_re, {c}_im in and out."""
    other = 1 if axis == 0 else 0
    return _pass(df, grid, list(cols), other, (axis,), False, snap, SLAB)


def sheared_power(df: DataFrame, grid: Grid, cols: tuple[str, ...], shear: float, time: float, snap: str = "snap") -> DataFrame:
    """Power in a sheared box: transform along y, the phase exp(-i k_y S t x), then along x and z; columns as of `power`."""
    d = df.select(snap, *(F.col(a).cast("int").alias(a) for a in grid.axes), *(x for c in cols for x in (F.col(c).cast("double").alias(f"{c}_re"), F.lit(0.0).alias(f"{c}_im"))))
    d = _along(d, grid, cols, 1, snap)
    turn = -(wavenumber(grid, 1) * (2 * math.pi / grid.side(1))) * (shear * time) * (F.col("x") * grid.spacing(0))
    re = lambda c: F.col(f"{c}_re") * F.cos(turn) - F.col(f"{c}_im") * F.sin(turn)
    im = lambda c: F.col(f"{c}_re") * F.sin(turn) + F.col(f"{c}_im") * F.cos(turn)
    d = d.select(snap, *grid.axes, *(x for c in cols for x in (re(c).alias(f"{c}_re"), im(c).alias(f"{c}_im"))))
    for axis in (0, *range(2, len(grid.dims))):
        d = _along(d, grid, cols, axis, snap)
    p = reduce(add, (F.col(f"{c}_re") * F.col(f"{c}_re") + F.col(f"{c}_im") * F.col(f"{c}_im") for c in cols))
    return d.select(snap, *(wavenumber(grid, a).alias(f"k{x}") for a, x in enumerate(grid.axes)), p.alias("p"))


def sheared_shells(spectrum: DataFrame, grid: Grid, shear: float, time: float, edges: list[float], snap: str = "snap") -> DataFrame:
    """Sums over right-open bins of |k| with k_x + S t k_y for k_x, in angular units: snap, bin, power."""
    k = [F.col(f"k{a}") * (2 * math.pi / grid.side(i)) for i, a in enumerate(grid.axes)]
    k[0] = k[0] + k[1] * (shear * time)
    r = F.sqrt(reduce(add, (x * x for x in k)))
    b = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("_r"))) - 1
    d = spectrum.withColumn("_r", r).select(snap, b.alias("bin"), "p").where((F.col("bin") >= 0) & (F.col("bin") < len(edges) - 1))
    return d.groupBy(snap, "bin").agg(F.sum("p").alias("power"))


def helical_mode(spark, grid: Grid, at: tuple[int, int, int], plus: float, minus: float) -> DataFrame:
    """The real field f0, f1, f2 of one wavenumber with amplitudes of the two helical waves; `at` are frequency indices, not along z."""
    n = [i - d if 2 * i >= d else i for i, d in zip(at, grid.dims, strict=True)]
    k = np.array([x / grid.side(i) for i, x in enumerate(n)])
    u = np.cross([0.0, 0.0, 1.0], k)
    if not u.any():
        raise ValueError("a helical mode needs a wavenumber across z")
    first = np.cross(u, k)
    second = np.cross(k, first)
    first, second = first / np.linalg.norm(first), second / np.linalg.norm(second)
    h = ((plus + minus) * first + 1j * (plus - minus) * second) / math.sqrt(2)
    cells = spark.range(grid.cells).select(F.lit(0).cast("long").alias("snap"), *_axes_of(grid, F.col("id")))
    here = reduce(lambda a, b: a & b, (F.col(a) == i for a, i in zip(grid.axes, at, strict=True)))
    t = cells.select("snap", *grid.axes, *(F.when(here, float(v)).otherwise(0.0).alias(f"f{i}_{p}") for i in range(3) for p, v in (("re", h[i].real), ("im", h[i].imag))))
    return _back(t, grid, ("f0", "f1", "f2"), "snap")


def anisotropic_field(spark, grid: Grid, perp: float, para: float, seed: int = 1, snaps: int = 1) -> DataFrame:
    """Random real fields f with amplitudes 10 k_perp^(-(perp + 1) / 2) k_para^(-para / 2) (k in cycles a cell, nothing at k_perp = 0 or k_para = 0) and random phases."""
    cells = spark.range(snaps * grid.cells).select((F.col("id") / grid.cells).cast("long").alias("snap"), *_axes_of(grid, F.col("id") % grid.cells))
    k = [wavenumber(grid, i) / grid.dims[i] for i in range(3)]
    across, along = F.sqrt(k[0] * k[0] + k[1] * k[1]), F.abs(k[2])
    amp = F.when((across == 0) | (along == 0), 0.0).otherwise(across ** (-(perp + 1) / 2) * along ** (-para / 2) * 10)
    turn = F.rand(seed) * (2 * math.pi)
    t = cells.select("snap", *grid.axes, amp.alias("_a"), turn.alias("_t")).select("snap", *grid.axes, (F.col("_a") * F.cos("_t")).alias("f_re"), (F.col("_a") * F.sin("_t")).alias("f_im"))
    return _back(t, grid, ("f",), "snap")  # the real part: Hermitian amplitudes


def _axes_of(grid: Grid, cell: Column) -> list[Column]:
    out, step = [], grid.cells
    for a, n in zip(grid.axes, grid.dims, strict=True):
        step //= n
        out.append(F.pmod((cell / step).cast("long"), F.lit(n)).cast("int").alias(a))
    return out
