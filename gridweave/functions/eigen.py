"""Eigen-analysis: closed forms as column expressions, eigenvectors by batched LAPACK over Arrow."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tensor import Tensor, det, trace
from .vector import Vec

EPS = 1e-10


def symmetric_2(t: Tensor) -> Vec:
    tr = trace(t)
    s = F.sqrt(F.greatest(F.lit(0.0), tr * tr - det(t) * 4))
    return (tr + s) * 0.5, (tr - s) * 0.5


def symmetric_3(t: Tensor) -> Vec:
    """The trigonometric closed form, descending; equal eigenvalues (isotropic tensors) included."""
    mean = trace(t) / 3
    dev = tuple(t[i][i] - mean for i in range(3))
    xy, yz, xz = t[0][1], t[1][2], t[0][2]
    square = (dev[0] * dev[0] + dev[1] * dev[1] + dev[2] * dev[2]) / 2 + xy * xy + yz * yz + xz * xz  # never negative
    cubic = dev[0] * dev[1] * dev[2] + xy * yz * xz * 2 - dev[0] * yz * yz - dev[1] * xz * xz - dev[2] * xy * xy
    turn = F.atan2(F.sqrt(F.greatest(F.lit(0.0), square * square * square * 4 - cubic * cubic * 27)), cubic * math.sqrt(27)) / 3
    reach = F.sqrt(square / 3) * 2
    s = F.sort_array(F.array(*(mean + reach * F.cos(turn + k * 2 * math.pi / 3) for k in (0, 1, 2))), asc=False)
    return s[0], s[1], s[2]


def symmetric(t: Tensor) -> Vec:
    """Eigenvalues of a symmetric tensor, descending; other sizes raise."""
    if any(len(r) != len(t) for r in t) or len(t) not in (2, 3):
        raise ValueError("eigenvalues need a 2 x 2 or 3 x 3 tensor")
    return symmetric_2(t) if len(t) == 2 else symmetric_3(t)


def general_2(t: Tensor) -> tuple[Vec, Vec]:
    """(real parts, imaginary parts), descending real part; of a conjugate pair the negative one first."""
    tr, disc = trace(t), trace(t) * trace(t) - det(t) * 4
    s = F.sqrt(F.abs(disc)) * 0.5
    re = lambda sign: tr * 0.5 + F.when(disc >= 0, s * sign).otherwise(0.0)
    im = lambda sign: F.when(disc < 0, s * sign).otherwise(0.0)
    return (re(1), re(-1)), (im(-1), im(1))


def stretching_rate(grad: Tensor) -> Column:
    """The largest eigenvalue of the symmetric part of a velocity gradient."""
    n = len(grad)
    return symmetric(tuple(tuple((grad[i][j] + grad[j][i]) * 0.5 for j in range(n)) for i in range(n)))[0]


def anisotropy(values: Vec) -> Column:
    tr = values[0]
    for v in values[1:]:
        tr = tr + v
    return F.abs(values[0] - values[-1]) / F.when(F.abs(tr) <= EPS, EPS).otherwise(tr)


def positive_definite(values: Vec, eps: float = 0.0) -> Column:
    return F.least(*values) > eps


def complex_analysis(re: Vec, im: Vec, eps: float = EPS):
    """(magnitudes, phases, stable, oscillatory)."""
    return (
        tuple(F.hypot(a, b) for a, b in zip(re, im, strict=True)), tuple(F.atan2(b, a) for a, b in zip(re, im, strict=True)),
        F.greatest(*re) < 0, F.greatest(*(F.abs(x) for x in im)) > eps,
    )


def _matrix(batch: pa.RecordBatch, cols: list[str], n: int) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols], axis=1).reshape(-1, n, n)


def _with(df: DataFrame, cols: list[str], make, names: list[str]) -> DataFrame:
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches):
        for b in batches:
            m = _matrix(b, cols, int(len(cols) ** 0.5)).astype(float)
            gap = ~np.isfinite(m).all(axis=(1, 2))  # a null, NaN or infinite entry gives nulls
            m[gap] = 0.0
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.ascontiguousarray(c), mask=gap) for c in make(m))], names=[*b.schema.names, *names])

    return df.mapInArrow(run, schema)


def eigenvectors_symmetric(df: DataFrame, cols: list[str], prefix: str = "e") -> DataFrame:
    """Adds {prefix}l0.. (descending) and {prefix}v{k}{i}; the largest entry of each vector is positive."""
    n = int(len(cols) ** 0.5)

    def make(m):
        w, v = np.linalg.eigh((m + m.transpose(0, 2, 1)) / 2)
        w, v = w[:, ::-1], v[:, :, ::-1]
        big = np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None, :], axis=1)
        v = v * np.where(big < 0, -1.0, 1.0)
        return [w[:, k] for k in range(n)] + [v[:, i, k] for k in range(n) for i in range(n)]

    return _with(df, cols, make, [f"{prefix}l{k}" for k in range(n)] + [f"{prefix}v{k}{i}" for k in range(n) for i in range(n)])


def eigenvectors_general(df: DataFrame, cols: list[str], prefix: str = "e") -> DataFrame:
    """Adds real and imaginary parts of eigenvalues and unit eigenvectors, in the order of `general_2`."""
    n = int(len(cols) ** 0.5)

    def make(m):
        w, v = np.linalg.eig(m)
        w, v = w.astype(complex), v.astype(complex)
        order = np.lexsort((w.imag.round(12), -w.real.round(12)))
        w, v = np.take_along_axis(w, order, 1), np.take_along_axis(v, order[:, None, :], 2)
        big = np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None, :], axis=1)
        v = v * np.conj(big) / np.maximum(np.abs(big), 1e-300)
        parts = [f(w[:, k]) for k in range(n) for f in (np.real, np.imag)]
        return parts + [f(v[:, i, k]) for k in range(n) for i in range(n) for f in (np.real, np.imag)]

    return _with(df, cols, make, [f"{prefix}l{k}{p}" for k in range(n) for p in ("re", "im")] + [f"{prefix}v{k}{i}{p}" for k in range(n) for i in range(n) for p in ("re", "im")])


def matrix_exponential(df: DataFrame, cols: list[str], t: float = 1.0, prefix: str = "x") -> DataFrame:
    """Adds the entries of exp(A t), by scaling and squaring of a Taylor series."""
    n = int(len(cols) ** 0.5)

    def make(m):
        a = m * t
        halvings = np.maximum(0, np.ceil(np.log2(np.maximum(1e-300, np.abs(a).sum(axis=2).max(axis=1)))).astype(int) + 4)  # each matrix has its own
        a = a / 2.0 ** halvings[:, None, None]
        out = term = np.broadcast_to(np.eye(n), a.shape)
        for k in range(1, 14):
            term = term @ a / k
            out = out + term
        for k in range(halvings.max(initial=0)):
            out = np.where((halvings > k)[:, None, None], out @ out, out)
        return [out[:, i, j] for i in range(n) for j in range(n)]

    return _with(df, cols, make, [f"{prefix}{i}{j}" for i in range(n) for j in range(n)])
