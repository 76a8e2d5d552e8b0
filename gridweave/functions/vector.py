"""Pointwise vector algebra over tuples of columns (two or three components); no shuffle, whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10
Vec = tuple[Column, ...]


def vec(*names: str) -> Vec:
    return tuple(F.col(n).cast("double") for n in names)


def dot(a: Vec, b: Vec) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def magnitude(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vec, b: Vec) -> Vec:
    """Three components, or one for plane vectors; one-dimensional vectors have none."""
    if len(a) == 2:
        return (a[0] * b[1] - a[1] * b[0],)
    if len(a) != 3:
        raise ValueError("a cross product needs two or three components")
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def scale(a: Vec, s: Column | float) -> Vec:
    return tuple(x * s for x in a)


def plus(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def normalise(a: Vec, eps: float = EPS) -> Vec:
    """a / |a|, the zero vector where |a| <= eps."""
    m = magnitude(a)
    return tuple(F.when(m > eps, x / m).otherwise(F.lit(0.0)) for x in a)


def triple(a: Vec, b: Vec, c: Vec) -> Column:
    return dot(a, cross(b, c))


def angle(a: Vec, b: Vec, eps: float = EPS) -> Column:
    """Radians; 0 where either vector is (nearly) zero."""
    ma, mb = magnitude(a), magnitude(b)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (ma * mb)))
    return F.when((ma > eps) & (mb > eps), F.acos(cos)).otherwise(F.lit(0.0))


def project(a: Vec, b: Vec, eps: float = EPS) -> Vec:
    """The part of a along b; zero where b.b <= eps."""
    bb = dot(b, b)
    return tuple(F.when(bb > eps, dot(a, b) / bb * x).otherwise(F.lit(0.0)) for x in b)


def rms(f: Column) -> Column:
    """Aggregate: root of the mean square."""
    return F.sqrt(F.avg(f * f))


def vector_rms(a: Vec) -> Column:
    return F.sqrt(F.avg(dot(a, a)))
