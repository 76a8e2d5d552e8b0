import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.functions import eigen
from gridweave.grid import Grid
from gridweave.operators import derived, orbits, spectral, structures, transfer, waves


def lattice(spark, values: np.ndarray, name: str = "f"):
    axes = "xyz"[: values.ndim]
    rows = [(0, *map(int, i), float(v)) for i, v in np.ndenumerate(values)]
    return spark.createDataFrame(rows, "snap long, " + ", ".join(f"{a} int" for a in axes) + f", {name} double")


def as_array(df, shape, name):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[tuple(r[a] for a in "xyz"[: len(shape)])] = r[name]
    return out


def test_isotropic_tensors_have_three_equal_eigenvalues(spark):
    d = spark.range(1, 400).select((F.col("id") / 997).alias("v"))
    z = F.lit(0.0)
    l = eigen.symmetric_3(((F.col("v"), z, z), (z, F.col("v"), z), (z, z, F.col("v"))))
    assert d.where(~(F.greatest(*(F.abs(x - F.col("v")) for x in l)) < 1e-12)).count() == 0


def test_eigenvectors_of_null_entries_are_null(spark):
    d = spark.createDataFrame([(1.0, 2.0, 0.5, 3.0), (None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    for f in (eigen.eigenvectors_symmetric, eigen.eigenvectors_general, eigen.matrix_exponential):
        got = f(d, ["a", "b", "c", "d"]).collect()
        assert all(v is not None for v in got[0]) and all(v is None for v in got[1][4:])


def test_exponential_of_each_matrix_stands_alone(spark):
    d = spark.createDataFrame([(0.1, 0.0, 0.0, 0.2), (30.0, 0.0, 0.0, -30.0)], "a double, b double, c double, d double")
    got = sorted(tuple(r)[4:] for r in eigen.matrix_exponential(d.coalesce(1), ["a", "b", "c", "d"]).collect())
    assert got[0] == pytest.approx((math.exp(0.1), 0, 0, math.exp(0.2))) and got[1] == pytest.approx((math.exp(30), 0, 0, math.exp(-30)))


def test_bins():
    assert transfer.log_bins(64)[:3] == pytest.approx([1, 4 * 2**-0.25, 4])
    assert transfer.user_bins(2.0, 8.0, 1) == [2.0] and transfer.user_bins(2.0, 8.0, 3) == pytest.approx([2, 4, 8])


def test_groups_take_points_of_any_number(spark):
    rng = np.random.default_rng(4)
    p = rng.random((90, 3))
    got = structures.voxel_groups(spark.createDataFrame([(i + 700, *map(float, x)) for i, x in enumerate(p)], "pid long, x double, y double, z double"), ("x", "y", "z"), 0.2).collect()
    v = np.floor(p / 0.1).astype(int)
    root = list(range(90))
    for _ in range(90):
        for i, j in itertools.combinations(range(90), 2):
            if np.abs(v[i] - v[j]).max() <= 1 and root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
    rank = {r: n for n, r in enumerate(sorted(set(root)))}
    assert {r.pid - 700: r.label for r in got} == {i: rank[root[i]] for i in range(90)}


def test_shape_of_an_ellipsoid(spark):
    rng = np.random.default_rng(5)
    p = rng.normal(size=(400, 3)) * [3, 2, 1]
    got = structures.shape_metrics(spark.createDataFrame([(0, *map(float, x)) for x in p], "label int, x double, y double, z double"), ("x", "y", "z")).first()
    l = np.sort(np.linalg.eigvalsh(np.cov(p.T, bias=True)))[::-1]
    assert (got.l0, got.l1, got.l2) == pytest.approx(tuple(l))
    assert (got.elongation, got.triaxiality, got.planarity) == pytest.approx((math.sqrt(l[0] / l[2]), (l[0] - l[1]) / (l[0] - l[2]), (l[1] - l[2]) / (l[0] + l[1])))


def test_profiles_around_a_cluster(spark):
    grid = Grid((8, 8, 8))
    f = np.arange(512.0).reshape(8, 8, 8)
    centre = spark.createDataFrame([(0, 0.0, 0.5, 0.25, 0.1)], "label long, cx double, cy double, cz double, radius double")
    got = structures.cluster_profiles(lattice(spark, f), grid, ("f",), centre, 3, 1.0).orderBy("bin").collect()
    d = np.stack(np.meshgrid(*[np.arange(8) / 8] * 3, indexing="ij")) - np.array([0, 0.5, 0.25])[:, None, None, None]
    r = np.sqrt(((d - np.round(d)) ** 2).sum(axis=0))
    for b, row in enumerate(got):
        at = (r >= b * 0.1) & (r < (b + 1) * 0.1)
        assert row["count"] == at.sum() and row.f == pytest.approx(f[at].mean())


def test_helical_modes_have_their_helicity(spark):
    grid = Grid((8, 8, 8), 2 * math.pi)
    b = spectral.helical_mode(spark, grid, (1, 1, 0), 1.0, 0.0)
    h = waves.magnetic_helicity(b, grid, ("f0", "f1", "f2"))
    k = math.sqrt(2)
    want = b.join(h, ["snap", "x", "y", "z"]).agg(F.avg("helicity"), F.avg(F.col("f0") ** 2 + F.col("f1") ** 2 + F.col("f2") ** 2)).first()
    assert abs(want[0]) == pytest.approx(want[1] / k) and want[1] > 0


def test_sheared_power_is_that_of_numpy(spark):
    grid, rng = Grid((4, 4, 4)), np.random.default_rng(6)
    f = rng.normal(size=(4, 4, 4))
    got = spectral.sheared_power(lattice(spark, f), grid, ("f",), 0.3, 1.7).collect()
    ky = 2 * np.pi * np.fft.fftfreq(4, 0.25)
    t = np.fft.fft(f, axis=1, norm="forward") * np.exp(-1j * ky[None, :, None] * 0.51 * (np.arange(4) / 4)[:, None, None])
    want = np.abs(np.fft.fftn(t, axes=(0, 2), norm="forward")) ** 2
    assert len(got) == 64 and all(r.p == pytest.approx(want[r.kx, r.ky, r.kz], abs=1e-12) for r in got)


def test_plane_filter_includes_both_ends(spark):
    grid, rng = Grid((8, 8)), np.random.default_rng(7)
    f = rng.normal(size=(8, 8))
    got = as_array(spectral.shell_filter_plane(lattice(spark, f), grid, ("f",), 2 * math.pi, 4 * math.pi), (8, 8), "f")
    k = 2 * np.pi * np.fft.fftfreq(8, 1 / 8)
    kk = np.hypot(*np.meshgrid(k, k, indexing="ij"))
    want = np.fft.ifftn(np.where((kk >= 2 * np.pi) & (kk <= 4 * np.pi), np.fft.fftn(f), 0)).real
    assert np.allclose(got, want)


def test_wave_displacements(spark):
    d = spark.createDataFrame([(1.0, 2.0, 3.0), (0.0, 0.0, 2.0), (1.0, 1.0, 0.0), (0.0, 0.0, 0.0)], "a double, b double, c double")
    got = [np.array(r[3:]).reshape(3, 3) for r in waves.displacements(d, ("a", "b", "c"), 0.5).collect()]
    u = np.array([1.0, 2.0, 3.0]) / math.sqrt(14)
    across = np.array([u[0], u[1], 0]) / math.hypot(u[0], u[1])
    root = math.sqrt(1.5**2 - 2 * u[2] ** 2)
    for row, sign in ((0, -1), (1, 1)):
        v = (-0.5 + sign * root) * np.array([0, 0, u[2]]) + (1.5 + sign * root) * across
        assert got[0][row] == pytest.approx(v / np.linalg.norm(v))
    for m in got[1:3]:
        assert m @ m.T == pytest.approx(np.eye(3), abs=1e-12)
    assert not got[3].any()


def test_critical_points(spark):
    cols = "trace double, d double, e1_re double, e1_im double, e2_re double, e2_im double, j3 double, j_threshold double"
    d = spark.createDataFrame([(0.0, -4.0, 1.0, 0.0, -1.0, 0.0, 0.0, 2.0), (0.0, 4.0, 0.0, -1.0, 0.0, 1.0, 2.0, 0.0), (1.0, 4.0, 0.5, -1.0, 0.5, 1.0, 2.0, 0.0)], cols)
    got = [[k for k in waves.KINDS if r[k]] for r in waves.critical_points(d).collect()]
    assert got == [["x_2d"], ["o_2d"], ["o_3d_repelling"]]


def test_bilinear_interpolation_wraps_masks_and_keeps_nulls(spark):
    f = np.arange(16.0).reshape(4, 4) ** 2
    p = spark.createDataFrame([(1, -0.5, -0.5), (2, 0.05, 0.1), (3, 0.49, 0.3), (4, None, 0.1), (5, 0.9, 0.0)], "pid long, px double, py double")
    inside = lambda bcs, sheet: {r.pid: r.f for r in orbits.bilinear(p, lattice(spark, f), Grid((4, 4), 1.0, bcs), ("f",), sheet).collect()}

    def want(x, y):
        u, v = (x + 0.5) * 4, (y + 0.5) * 4
        i, j = math.floor(u), math.floor(v)
        return sum((u - i if a else 1 - u + i) * (v - j if b else 1 - v + j) * f[(i + a) % 4, (j + b) % 4] for a in (0, 1) for b in (0, 1))

    got = inside("periodic", None)
    assert got[4] is None
    for k, x, y in ((1, -0.5, -0.5), (2, 0.05, 0.1), (3, 0.49, 0.3), (5, 0.9, 0.0)):
        assert got[k] == pytest.approx(want(x, y))
    got = inside("neumann", (0.1, 0.5))
    assert got[2] == pytest.approx(want(0.05, 0.1)) and (got[1], got[3], got[5]) == (0, 0, 0) and got[4] is None
    got = inside("neumann", None)
    assert got[1] == f[0, 0] and got[3] is None and got[5] is None


def test_fused_magnitude_takes_means_from_components_and_magnitude(spark):
    v = np.array([[1.0, 2.0], [3.0, -1.0], [0.5, 4.0]])
    d = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(v)] + [(9, None, 1.0)], "i int, a double, b double")
    got = {r.i: r.m for r in derived.fused_magnitude(d, ("a", "b"), "m", True, True).collect()}
    m = np.hypot(v[:, 0] - v[:, 0].mean(), v[:, 1] - np.append(v[:, 1], 1.0).mean())
    assert got.pop(9) is None and [got[i] for i in range(3)] == pytest.approx(list(m - m.mean()))


def test_holes_are_filled_inside_a_border(spark):
    ring = [(x, y) for x in range(2, 7) for y in range(2, 7) if x in (2, 6) or y in (2, 6)]
    lat = spark.createDataFrame([(x, y) for x in range(9) for y in range(9)], "x int, y int")
    got = structures.fill_holes(spark.createDataFrame(ring, "x int, y int"), Grid((9, 9), 1.0, ("periodic", "neumann")), lat)
    assert {tuple(r) for r in got.collect()} == {(x, y) for x in range(2, 7) for y in range(2, 7)}


def test_extrema_of_a_field_that_differs_when_computed_again(spark):
    import random

    f = np.random.default_rng(8).random((6, 5))
    again = F.udf(lambda v: v + random.random() * 1e-9, "double").asNondeterministic()  # as a mean does by the order of its rows
    d = lattice(spark, f).withColumn("f", again("f"))
    for bcs in ("periodic", "neumann"):
        got = {(r.x, r.y): r.kind for r in structures.local_extrema(d, Grid((6, 5), 1.0, bcs), "f").collect()}
        want = {}
        for x, y in itertools.product(range(6), range(5)):
            near = [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            near = [f[a % 6, b % 5] for a, b in near if bcs == "periodic" or (0 <= a < 6 and 0 <= b < 5)]
            want |= {(x, y): k for k, v in (("X", max(near)), ("O", min(near))) if f[x, y] == v}
        assert got == want


def test_density_profile_of_many_points_has_the_true_centre(spark):
    d = spark.range(0, 2_000_000, 1, 1).select(F.lit(0).alias("label"), F.when(F.col("id") % 2 == 0, 0.1).otherwise(0.3).alias("x"), F.lit(0.7).alias("y"), F.lit(0.7).alias("z"))
    got = structures.density_profile(d, ("x", "y", "z"), 8).collect()
    assert sum(1 for r in got if not 0 <= r.bin < 8) == 0 and max(abs(r.r - 0.1) for r in got) < 1e-14
