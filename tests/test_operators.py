import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.functions import eigen, tensor, vector
from gridweave.grid import Grid
from gridweave.operators import clustering, spectral, stencil
from gridweave.sources import snapshots


@pytest.mark.parametrize("points,order", [(2, 2), (4, 4), (6, 6), (8, 8)])
def test_first_derivatives_converge(points, order):
    errors = []
    for n in (16, 32):
        x = np.arange(n) * 2 * np.pi / n
        d = sum(w * np.roll(np.sin(x), -o) for o, w in stencil.weights(1, points).items()) / (2 * np.pi / n)
        errors.append(np.abs(d - np.cos(x)).max())
    assert math.log2(errors[0] / errors[1]) > order - 0.2


@pytest.mark.parametrize("points", [2, 4, 6, 8])
def test_second_derivative_of_a_square(points):
    assert sum(w * o * o for o, w in stencil.weights(2, points).items()) == pytest.approx(2)
    with pytest.raises(ValueError):
        stencil.weights(3, points)


def test_boundaries(spark):
    d = spark.createDataFrame([(x, y, float(x)) for x in range(5) for y in range(2)], "x int, y int, f double")
    for bc, edge in (("periodic", (1 - 4) / 2), ("neumann", 0.5), ("dirichlet", 0.5)):
        g = Grid((5, 2), (5.0, 2.0), bc)
        got = {(r.x, r.y): r.g for r in stencil.derivatives(d, g, {"g": ("f", 0, 1)}).collect()}
        assert got[2, 1] == 1 and got[0, 0] == edge and len(got) == 10


def test_fft_parseval_and_helmholtz(spark):
    rng = np.random.default_rng(1)
    g = Grid((4, 6, 8), (1.0, 1.5, 2.0))
    rows = [(0, *c, *map(float, rng.normal(size=3))) for c in itertools.product(*map(range, g.dims))]
    d = spark.createDataFrame(rows, "snap long, x int, y int, z int, vx double, vy double, vz double")
    v = np.array([r[4:] for r in rows]).reshape(*g.dims, 3)
    t = spectral.transform(d, g, ("vx",)).orderBy("x", "y", "z").toPandas()
    f = np.fft.fftn(v[..., 0], norm="forward").ravel()
    assert np.allclose(t.vx_re + 1j * t.vx_im, f)
    p = spectral.power(d, g, ("vx", "vy", "vz")).agg(F.sum("p")).first()[0]
    assert p == pytest.approx((v**2).sum() / g.cells)
    h = spectral.helmholtz(d, g, ("vx", "vy", "vz")).orderBy("x", "y", "z").toPandas()
    assert np.allclose(h[["irr0", "irr1", "irr2"]].to_numpy() + h[["sol0", "sol1", "sol2"]].to_numpy(), v.reshape(-1, 3))


def test_fft_takes_few_snapshots_at_a_time(spark, monkeypatch):
    from types import SimpleNamespace

    def small(v, **how):
        if v.size > 2000:
            raise MemoryError("too many cells at a time")
        return np.fft.fftn(v, **how)

    used = ("unique", "lexsort", "int64", "prod", "flatnonzero", "ascontiguousarray")
    monkeypatch.setattr(spectral, "np", SimpleNamespace(fft=SimpleNamespace(fftn=small, ifftn=np.fft.ifftn), **{k: getattr(np, k) for k in used}))
    monkeypatch.setattr(spectral, "CHUNK", 256, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        v = np.random.default_rng(9).normal(size=(2000, 6, 3))  # a slab of four rows and one of two
        d = spark.createDataFrame([(s, x, y, float(f)) for (s, x, y), f in np.ndenumerate(v)], "snap long, x int, y int, f double").repartition(7)
        t = spectral.transform(d, Grid((6, 3)), ("f",)).orderBy("snap", "x", "y").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.allclose(t.f_re + 1j * t.f_im, np.fft.fftn(v, axes=(1, 2), norm="forward").ravel())


def test_incomplete_lattice_raises(spark):
    d = spark.createDataFrame([(0, 0, 0, 1.0)], "snap long, x int, y int, f double")
    with pytest.raises(Exception, match="every cell"):
        spectral.transform(d, Grid((2, 2)), ("f",)).collect()


def test_eigenvectors(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(50, 3, 3))
    m = m + m.transpose(0, 2, 1)
    names = [f"m{i}{j}" for i in range(3) for j in range(3)]
    d = spark.createDataFrame([tuple(map(float, x.ravel())) for x in m], ", ".join(f"{n} double" for n in names))
    e = eigen.eigenvectors_symmetric(d, names).toPandas()
    a = e[names].to_numpy().reshape(-1, 3, 3)
    for k in range(3):
        v = e[[f"ev{k}{i}" for i in range(3)]].to_numpy()
        assert np.allclose(np.einsum("nij,nj->ni", a, v), e[f"el{k}"].to_numpy()[:, None] * v)
    t = tuple(tuple(F.col(f"m{i}{j}") for j in range(3)) for i in range(3))
    l = d.select(*(x.alias(f"l{i}") for i, x in enumerate(eigen.symmetric(t)))).toPandas().to_numpy()
    assert np.allclose(l, np.linalg.eigvalsh(m)[:, ::-1])
    x = eigen.matrix_exponential(d.limit(1), names).toPandas()
    w, q = np.linalg.eigh(x[names].to_numpy().reshape(3, 3))
    assert np.allclose(x[[f"x{i}{j}" for i in range(3) for j in range(3)]].to_numpy().reshape(3, 3), q @ np.diag(np.exp(w)) @ q.T)
    with pytest.raises(ValueError):
        eigen.symmetric(((F.lit(1),),))
    with pytest.raises(ValueError):
        tensor.decompose(t, False, False, False)
    with pytest.raises(ValueError):
        vector.cross((F.lit(1),), (F.lit(1),))


def test_friends_and_components_against_brute_force(spark):
    rng = np.random.default_rng(3)
    p = rng.random((120, 2))
    d = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "pid long, x double, y double")
    for box in (None, 1.0):
        root = list(range(len(p)))
        for _ in range(len(p)):
            for i, j in itertools.combinations(range(len(p)), 2):
                e = p[i] - p[j]
                e = e - np.round(e) if box else e
                if (e**2).sum() <= 0.07**2:
                    root[i] = root[j] = min(root[i], root[j])
        rank = {r: k for k, r in enumerate(sorted(set(root)))}
        got = {r.pid: r.label for r in clustering.friends_of_friends(d, ("x", "y"), 0.07, box).collect()}
        assert got == {i: rank[r] for i, r in enumerate(root)}


def test_friends_of_friends_queries_take_every_vector(spark, tmp_path):
    from gridweave.plans.catalog import QUERIES

    rng = np.random.default_rng(4)
    p = rng.random((90, 3)).astype(np.float32) / 5
    ids = [int(i) for i in rng.permutation(900)[:90]]
    spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, p, strict=True)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    p = p.astype(float)
    for name, reach, least in (("friends_of_friends", 0.03, 1), ("friends_of_friends_min3", 0.05, 3)):
        root = {i: i for i in ids}
        for _ in ids:
            for i, j in itertools.combinations(range(len(ids)), 2):
                if ((p[i] - p[j]) ** 2).sum() <= reach**2:
                    root[ids[i]] = root[ids[j]] = min(root[ids[i]], root[ids[j]])
        roots = list(root.values())
        rank = {r: k for k, r in enumerate(r for r in sorted(set(roots)) if roots.count(r) >= least)}
        assert {r.pid: r.label for r in QUERIES[name](spark, str(tmp_path)).collect()} == {i: rank.get(r, -1) for i, r in root.items()}


def test_friends_of_dense_points_link_cells_not_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    edges = []
    real = clustering.connected
    monkeypatch.setattr(clustering, "connected", lambda e: edges.append(e.count()) or real(e))
    sheet = lambda z: np.c_[rng.random((400, 2)) * 0.05, z + rng.random(400) * 2e-3]
    # a dense ball, two sheets just out of reach that meet nowhere, two that meet once, equal points, far points and no points
    p = np.r_[rng.normal(size=(600, 3)) * 0.03, sheet(1), sheet(1.1021), sheet(2), sheet(2.1021), [[0.02, 0.02, 2.05]] * 3, [[5e9, 0, 0], [5e9, 0, 0.05], [5e9, 0, 0.2], [9, 9, math.nan], [9, 9, math.nan]]]
    rows = [(i + 50, *map(float, x)) for i, x in enumerate(p)] + [(7, 9.0, None, 9.0), (8, 9.0, None, 9.0)]
    got = {r.pid: r.label for r in clustering.friends_of_friends(spark.createDataFrame(rows, "pid long, x double, y double, z double"), ("x", "y", "z"), 0.1).collect()}
    near = ((p[:, None] - p[None]) ** 2).sum(axis=2) <= 0.1 * 0.1
    root = np.arange(len(p))
    for _ in range(len(p)):
        low = np.minimum(root, np.where(near, root[None], len(p)).min(axis=1))
        if (low == root).all():
            break
        root = low
    roots = {i + 50: int(r) + 50 for i, r in enumerate(root)} | {7: 7, 8: 8}
    rank = {r: k for k, r in enumerate(sorted(set(roots.values())))}
    assert got == {i: rank[r] for i, r in roots.items()}
    assert sum(edges) < len(p) < near.sum() / 50


def test_opening_removes_a_bridge(spark):
    g = Grid((12, 12), 1.0, "neumann")
    cells = [(x, y) for x in range(2, 5) for y in range(2, 5)] + [(x, 3) for x in range(5, 8)] + [(x, y) for x in range(8, 11) for y in range(2, 5)]
    m = spark.createDataFrame(cells, "x int, y int")
    assert {r.label for r in clustering.components(m, g, 4).collect()} == {0}
    assert {r.label for r in clustering.components(clustering.opening(m, g), g, 4).collect()} == {0, 1}


def test_block_round_trip(spark):
    d = spark.createDataFrame([(x, y, z, float(x * 100 + y * 10 + z)) for x in range(4) for y in range(4) for z in range(4)], "x int, y int, z int, f double")
    back = snapshots.blocks_to_lattice(snapshots.lattice_to_blocks(d, (2, 2, 2), (2, 2, 2)), (2, 2, 2), (2, 2, 2))
    assert back.exceptAll(d).isEmpty() and back.count() == 64


def test_readers(spark, tmp_path):
    import struct

    head = b"Athena binary output version=1.1\n  size of preheader=5\n  time=0.0\n  cycle=1\n  size of location=4\n  size of variable=4\n  number of variables=2\n  variables:  dens  eint\n  header offset=12\ngamma = 1.5\n"
    blocks = b"".join(struct.pack("<6i4i6f", 0, 1, 0, 1, 0, 1, i, 0, 0, 0, *[0.0] * 6) + np.arange(16, dtype="<f4").tobytes() for i in (0, 1))
    (tmp_path / "a.bin").write_bytes(head + blocks)
    a = snapshots.read_athenak(spark, str(tmp_path / "a.bin"), ("dens", "press")).orderBy("x", "y", "z").collect()
    assert [r.x for r in a] == [x for x in range(4) for _ in range(4)] and a[0].press == 4.0 and a[1].dens == 4.0
    (tmp_path / "s.txt").write_text("#\n" * 6 + " 1 2.5 3\n4 5 6\n")
    got = snapshots.read_spectrum(spark, str(tmp_path / "s.txt")).orderBy("line").collect()
    assert [list(r["values"]) for r in got] == [[1.0, 2.5, 3.0], [4.0, 5.0, 6.0]]
