"""Pointwise tensor algebra over rows of columns (3 x 3 or 2 x 2)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import Vec, dot

Tensor = tuple[Vec, ...]


def outer(a: Vec, b: Vec) -> Tensor:
    return tuple(tuple(x * y for y in b) for x in a)


def transpose(t: Tensor) -> Tensor:
    return tuple(zip(*t, strict=True))


def total(*t: Tensor) -> Tensor:
    return tuple(tuple(reduce(add, c) for c in zip(*rows, strict=True)) for rows in zip(*t, strict=True))


def trace(t: Tensor) -> Column:
    return reduce(add, (t[i][i] for i in range(len(t))))


def contract(a: Tensor, b: Tensor) -> Column:
    """A_ij B_ij."""
    return reduce(add, (dot(x, y) for x, y in zip(a, b, strict=True)))


def contract_transposed(a: Tensor, b: Tensor) -> Column:
    """A_ji B_ij."""
    return contract(transpose(a), b)


def magnitude(t: Tensor) -> Column:
    return F.sqrt(contract(t, t))


def vector_dot(v: Vec, t: Tensor) -> Vec:
    """v_i T_ij: the first index is contracted."""
    return tuple(dot(v, c) for c in transpose(t))


def det(t: Tensor) -> Column:
    if len(t) == 2:
        return t[0][0] * t[1][1] - t[0][1] * t[1][0]
    (a, b, c), (d, e, f), (g, h, i) = t
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def invariants(t: Tensor) -> Vec:
    """Trace, half of trace squared less the trace of the square, determinant."""
    tr = trace(t)
    return tr, (tr * tr - contract_transposed(t, t)) * 0.5, det(t)


def decompose(t: Tensor, sym: bool = True, asym: bool = True, bulk: bool = True):
    """Traceless symmetric, antisymmetric and isotropic parts, in this order; one alone comes bare."""
    if not (sym or asym or bulk):
        raise ValueError("at least one part has to be asked for")
    d = len(t)
    b = trace(t) / d
    out = []
    if sym:
        out.append(tuple(tuple((t[i][j] + t[j][i]) * 0.5 - (b if i == j else F.lit(0.0)) for j in range(d)) for i in range(d)))
    if asym:
        out.append(tuple(tuple((t[i][j] - t[j][i]) * 0.5 for j in range(d)) for i in range(d)))
    if bulk:
        out.append(tuple(tuple(b if i == j else F.lit(0.0) for j in range(d)) for i in range(d)))
    return out[0] if len(out) == 1 else tuple(out)
