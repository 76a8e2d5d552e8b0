"""All queries over the driver's tables, by name, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import eigen, tensor, vector
from ..functions.vector import vec
from ..grid import DIRICHLET, NEUMANN, Grid
from ..operators import clustering, derived, spectral, stencil
from ..sources import snapshots
from ..sources.tables import EMB3, EVT2, LAT8, emb3, emb3v, evt2, lat8, part, points, table

QUERIES: dict = {}
ORACLES: dict = {}

#: Decimal places that survive a different order of summation.
PLACES = 6


def r(c, name: str, places: int = PLACES):
    return (F.round(c, places) + F.lit(0.0)).alias(name)


def q(x: str, name: str, places: int = PLACES) -> str:
    return f"round({x}, {places}) + 0.0 AS {name}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


PART = "p AS (SELECT l_orderkey, l_linenumber, l_quantity * 0.103712937::DOUBLE AS ax, l_discount * 10.1317371::DOUBLE AS ay, l_tax * 9.8713913::DOUBLE AS az, l_extendedprice * 1.0373717e-4::DOUBLE AS bx, l_quantity * 0.051973719::DOUBLE AS bw, (l_discount - l_tax) * 1.0171331::DOUBLE AS bz FROM lineitem)"
EMB = "e AS (SELECT vec_id AS snap, i // 16 AS x, (i // 4) % 4 AS y, i % 4 AS z, embedding[i + 1]::DOUBLE AS f FROM embeddings, range(64) t(i))"
EMBV = EMB + ", v AS (SELECT snap // 3 AS snap, x, y, z, max(f) FILTER (snap % 3 = 0) AS vx, max(f) FILTER (snap % 3 = 1) AS vy, max(f) FILTER (snap % 3 = 2) AS vz FROM e GROUP BY ALL HAVING count(*) = 3)"
EMBV = EMBV.replace("SELECT snap // 3 AS snap, x, y, z, max(f) FILTER (snap % 3 = 0)", "SELECT g AS snap, x, y, z, max(f) FILTER (c = 0)").replace("max(f) FILTER (snap % 3 = 1)", "max(f) FILTER (c = 1)").replace("max(f) FILTER (snap % 3 = 2)", "max(f) FILTER (c = 2)").replace("FROM e GROUP BY ALL HAVING", "FROM (SELECT snap // 3 AS g, snap % 3 AS c, x, y, z, f FROM e) GROUP BY g, x, y, z HAVING")
LAT = "l AS (SELECT (l_partkey % 8)::INT AS x, (l_suppkey % 8)::INT AS y, (l_orderkey % 8)::INT AS z, avg(l_quantity) AS qty, avg(l_extendedprice) / 1e4 AS price, avg(l_discount) AS disc, avg(l_tax) AS tax FROM lineitem GROUP BY ALL), g AS (SELECT list(qty ORDER BY x, y, z) AS qty_all, list(price ORDER BY x, y, z) AS price_all, list(disc ORDER BY x, y, z) AS disc_all, list(tax ORDER BY x, y, z) AS tax_all FROM l)"
A, B = ("ax", "ay", "az"), ("bx", "bw", "bz")
DOT = lambda a, b: " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True))


def _pointwise(name: str, make, sql: dict[str, str], doc: str):
    def f(spark, sf_dir) -> DataFrame:
        p = part(spark, sf_dir)
        return p.select("l_orderkey", "l_linenumber", *(r(c, n) for n, c in make(vec(*A), vec(*B)).items()))

    f.__name__, f.__doc__ = name, doc
    query(f"WITH {PART} SELECT l_orderkey, l_linenumber, " + ", ".join(q(x, n) for n, x in sql.items()) + " FROM p")(f)


_named = lambda v, p="o": {f"{p}{i}": c for i, c in enumerate(v)}
MAG_A, MAG_B, AB, BB = f"sqrt({DOT(A, A)})", f"sqrt({DOT(B, B)})", f"({DOT(A, B)})", f"({DOT(B, B)})"
CROSS = {"o0": "ay * bz - az * bw", "o1": "az * bx - ax * bz", "o2": "ax * bw - ay * bx"}

_pointwise("vec_dot", lambda a, b: {"d": vector.dot(a, b)}, {"d": AB}, "V2")
_pointwise("vec_cross", lambda a, b: _named(vector.cross(a, b)), CROSS, "V3")
_pointwise("vec_normalise", lambda a, b: _named(vector.normalise(a)), {f"o{i}": f"CASE WHEN {MAG_A} > 1e-10 THEN {x} / {MAG_A} ELSE 0 END" for i, x in enumerate(A)}, "V4")
_pointwise("vec_triple", lambda a, b: {"t": vector.triple(a, b, (a[1], a[2], a[0]))}, {"t": f"ax * (bw * ax - bz * az) + ay * (bz * ay - bx * ax) + az * (bx * az - bw * ay)"}, "V5")
_pointwise("vec_angle", lambda a, b: {"t": vector.angle(a, b)}, {"t": f"CASE WHEN {MAG_A} > 1e-10 AND {MAG_B} > 1e-10 THEN acos(greatest(-1, least(1, {AB} / ({MAG_A} * {MAG_B})))) ELSE 0 END"}, "V6")
_pointwise("vec_project", lambda a, b: _named(vector.project(a, b)), {f"o{i}": f"CASE WHEN {BB} > 1e-10 THEN {AB} / {BB} * {x} ELSE 0 END" for i, x in enumerate(B)}, "V7")
_pointwise("vec_component", lambda a, b: {"c": a[1]}, {"c": "ay"}, "V8")
_pointwise("vec_cross_2d", lambda a, b: {"c": vector.cross(a[:2], b[:2])[0], "m": vector.magnitude(a[:2])}, {"c": "ax * bw - ay * bx", "m": "sqrt(ax * ax + ay * ay)"}, "V1, V3 in the plane")


@query(f"WITH {PART} SELECT {q(f'sqrt(avg({DOT(A, A)}))', 'rms_a')}, {q(f'sqrt(avg({DOT(B, B)}))', 'rms_b')}, {q('sqrt(avg(ax * ax))', 'rms_ax')} FROM p")
def vec_magnitude(spark, sf_dir):
    """Root mean squares of vectors and of a scalar."""
    return part(spark, sf_dir).agg(r(vector.vector_rms(vec(*A)), "rms_a"), r(vector.vector_rms(vec(*B)), "rms_b"), r(vector.rms(F.col("ax")), "rms_ax"))


T_ = [[f"({x} * {y})" for y in B] for x in A]  # a b
SYM = [[f"(({T_[i][j]} + {T_[j][i]}) * 0.5)" for j in range(3)] for i in range(3)]
TR = " + ".join(T_[i][i] for i in range(3))
_pairs = [(i, j) for i in range(3) for j in range(3)]
_pointwise("ten_magnitude", lambda a, b: {"m": tensor.magnitude(tensor.outer(a, b))}, {"m": "sqrt(" + " + ".join(f"{T_[i][j]} * {T_[i][j]}" for i, j in _pairs) + ")"}, "T1, T6")
_pointwise("ten_contract", lambda a, b: {"c": tensor.contract(tensor.outer(a, b), tensor.outer(b, b)), "d": tensor.contract_transposed(tensor.outer(a, b), tensor.outer(a, b))}, {"c": " + ".join(f"{T_[i][j]} * {B[i]} * {B[j]}" for i, j in _pairs), "d": " + ".join(f"{T_[j][i]} * {T_[i][j]}" for i, j in _pairs)}, "T2, T3")
_pointwise("ten_vector_dot", lambda a, b: _named(tensor.vector_dot(a, tensor.outer(b, a))), {f"o{j}": " + ".join(f"{A[i]} * {B[i]} * {A[j]}" for i in range(3)) for j in range(3)}, "T4")
_pointwise("ten_transpose", lambda a, b: {f"t{i}{j}": c for i, row in enumerate(tensor.transpose(tensor.outer(a, b))) for j, c in enumerate(row)}, {f"t{i}{j}": T_[j][i] for i, j in _pairs}, "T5")
_pointwise("ten_decompose", lambda a, b: {f"{n}{i}{j}": c for n, t in zip("sab", tensor.decompose(tensor.outer(a, b)), strict=True) for i, row in enumerate(t) for j, c in enumerate(row)},
           {f"s{i}{j}": f"{SYM[i][j]} - " + (f"({TR}) / 3" if i == j else "0") for i, j in _pairs} | {f"a{i}{j}": f"({T_[i][j]} - {T_[j][i]}) * 0.5" for i, j in _pairs} | {f"b{i}{j}": f"({TR}) / 3" if i == j else "0.0" for i, j in _pairs}, "T8")
_M = [["ax", "bx", "ay"], ["bx", "bw", "az"], ["ay", "az", "bz"]]


def _sym(a, b):
    return ((a[0], b[0], a[1]), (b[0], b[1], a[2]), (a[1], a[2], b[2]))


_DET = "(ax * (bw * bz - az * az) - bx * (bx * bz - az * ay) + ay * (bx * az - bw * ay))"
_SQ = " + ".join(f"{_M[i][j]} * {_M[j][i]}" for i, j in _pairs)
_pointwise("ten_invariants", lambda a, b: _named(tensor.invariants(_sym(a, b)), "i"), {"i0": "ax + bw + bz", "i1": f"((ax + bw + bz) * (ax + bw + bz) - ({_SQ})) * 0.5", "i2": _DET}, "T7")
_D2 = "greatest(0, (ax + bw) * (ax + bw) - 4 * (ax * bw - ay * ay))"
_pointwise("eig_symmetric_2", lambda a, b: _named(eigen.symmetric(((a[0], a[1]), (a[1], b[1]))), "l"), {"l0": f"(ax + bw + sqrt({_D2})) * 0.5", "l1": f"(ax + bw - sqrt({_D2})) * 0.5"}, "E1, E3")
_D2G = "((ax + bw) * (ax + bw) - 4 * (ax * bw - ay * bz))"


def _general(a, b):
    re, im = eigen.general_2(((a[0], a[1]), (b[2], b[1])))
    mag, phase, stable, osc = eigen.complex_analysis(re, im)
    return {"re0": re[0], "re1": re[1], "im0": im[0], "im1": im[1], "mag": mag[0], "phase": phase[1], "stable": stable.cast("double"), "osc": osc.cast("double")}


_re = lambda s: f"((ax + bw) * 0.5 + CASE WHEN {_D2G} >= 0 THEN {s} * sqrt(abs({_D2G})) * 0.5 ELSE 0 END)"
_im = lambda s: f"(CASE WHEN {_D2G} < 0 THEN {s} * sqrt(abs({_D2G})) * 0.5 ELSE 0 END)"
_pointwise("eig_general_2", _general, {"re0": _re(1), "re1": _re(-1), "im0": _im(-1), "im1": _im(1), "mag": f"sqrt({_re(1)} * {_re(1)} + {_im(-1)} * {_im(-1)})", "phase": f"atan2({_im(1)}, {_re(-1)})", "stable": f"CASE WHEN greatest({_re(1)}, {_re(-1)}) < 0 THEN 1.0 ELSE 0.0 END", "osc": f"CASE WHEN abs({_im(1)}) > 1e-10 THEN 1.0 ELSE 0.0 END"}, "E5, E10")

_E3 = f"""WITH {PART}, m AS (SELECT l_orderkey, l_linenumber, ax AS a, bw AS b, bz AS c, bx AS d, az AS e, ay AS f FROM p),
x AS (SELECT *, a*a + b*b + c*c - a*b - a*c - b*c + 3*(d*d + f*f + e*e) AS x1,
 -(2*a-b-c)*(2*b-a-c)*(2*c-a-b) + 9*((2*c-a-b)*d*d + (2*b-a-c)*f*f + (2*a-b-c)*e*e) - 54*d*e*f AS x2 FROM m),
y AS (SELECT *, atan2(sqrt(greatest(0, 4*x1*x1*x1 - x2*x2)), x2) AS phi FROM x),
z AS (SELECT *, list_reverse_sort([(a+b+c - 2*sqrt(x1)*cos(phi/3))/3, (a+b+c + 2*sqrt(x1)*cos((phi-pi())/3))/3, (a+b+c + 2*sqrt(x1)*cos((phi+pi())/3))/3]) AS l FROM y)
SELECT l_orderkey, l_linenumber, round(l[1], 5) + 0.0 AS l0, round(l[2], 5) + 0.0 AS l1, round(l[3], 5) + 0.0 AS l2, CASE WHEN l[3] > 1e-7 THEN 1 ELSE 0 END AS pos,
 round(abs(l[1] - l[3]) / CASE WHEN abs(l[1] + l[2] + l[3]) <= 1e-10 THEN 1e-10 ELSE l[1] + l[2] + l[3] END, 5) + 0.0 AS aniso FROM z"""


@query(_E3)
def eig_symmetric_3(spark, sf_dir):
    """E2, E8, E9."""
    p = part(spark, sf_dir)
    p = p.select("l_orderkey", "l_linenumber", F.array(*eigen.symmetric(_sym(vec(*A), vec(*B)))).alias("l"))
    l = tuple(F.get("l", F.lit(i)) for i in range(3))
    return p.select("l_orderkey", "l_linenumber", *(r(x, f"l{i}", 5) for i, x in enumerate(l)), eigen.positive_definite(l, 1e-7).cast("int").alias("pos"), r(eigen.anisotropy(l), "aniso", 5))


@query()
def eig_vectors(spark, sf_dir):
    """Batched LAPACK; eig_residuals and tests check A v = l v."""
    p = part(spark, sf_dir).select("l_orderkey", "l_linenumber", *(F.col(_M[i][j]).alias(f"m{i}{j}") for i, j in _pairs))
    return eigen.eigenvectors_symmetric(p, [f"m{i}{j}" for i, j in _pairs])


@query()
def eig_vectors_general(spark, sf_dir):
    """E5, E6 for 3 x 3."""
    p = part(spark, sf_dir)
    p = p.select("l_orderkey", "l_linenumber", *(c.alias(f"m{i}{j}") for i, row in enumerate(tensor.outer(vec(*A), vec(*B))) for j, c in enumerate(row)))
    return eigen.eigenvectors_general(p, [f"m{i}{j}" for i, j in _pairs])


@query()
def matrix_exponential(spark, sf_dir):
    """E11."""
    p = part(spark, sf_dir).select("l_orderkey", "l_linenumber", *((F.col(_M[i][j]) * 0.1).alias(f"m{i}{j}") for i, j in _pairs))
    return eigen.matrix_exponential(p, [f"m{i}{j}" for i, j in _pairs])


# ---- stencils ---------------------------------------------------------------------------------


def _diff(alias: str, axes: str, axis: str, n: int, order: int, points_: int, bc: str, field: str, dr: float) -> str:
    """A weighted sum over the neighbours of a cell; g holds each field of the lattice as one list."""
    terms = []
    for off, w in stencil.weights(order, points_).items():
        to = f"(c.{axis} + {off})"
        if bc == "periodic":
            at = f"(({to} % {n}) + {n}) % {n}"
        elif bc == NEUMANN:
            at = f"least(greatest({to}, 0), {n - 1})"
        else:
            at = to
        cell = "0"
        for x in axes:
            cell = f"({cell}) * {n} + " + (at if x == axis else f"c.{x}")
        value = f"g.{field}_all[({cell} + 1)::BIGINT]"
        if bc == DIRICHLET:
            value = f"CASE WHEN {to} BETWEEN 0 AND {n - 1} THEN {value} ELSE 0 END"
        terms.append(f"{w / dr**order!r}::DOUBLE * {value}")
    return "(" + " + ".join(terms) + ")"


def _grad_query(name: str, points_: int, bc: str, order: int = 1):
    g = Grid((8, 8, 8), 1.0, bc)

    def f(spark, sf_dir):
        d = stencil.derivatives(lat8(spark, sf_dir), g, {f"g{a}": ("qty", a, order) for a in range(3)}, (), (), points_)
        return d.select("x", "y", "z", *(r(F.col(f"g{a}"), f"g{a}", 5) for a in range(3)))

    f.__name__, f.__doc__ = name, f"G1, G6: {points_} points, {bc}"
    query(f"WITH {LAT} SELECT x, y, z, " + ", ".join(q(_diff("l", "xyz", a, 8, order, points_, bc, "qty", 1 / 8), f"g{i}", 5) for i, a in enumerate("xyz")) + " FROM l c, g")(f)


for _n in (2, 4, 6, 8):
    _grad_query(f"grad_periodic_{_n}", _n, "periodic")
_grad_query("grad_neumann_4", 4, NEUMANN)
_grad_query("grad_dirichlet_4", 4, DIRICHLET)
_grad_query("second_periodic_4", 4, "periodic", 2)
_F3 = ("qty", "price", "disc")
_g = lambda f, a, p=4: _diff("l", "xyz", "xyz"[a], 8, 1, p, "periodic", f, 1 / 8)
_LATQ = lambda cols: f"WITH {LAT} SELECT x, y, z, " + ", ".join(q(x, n, 4) for n, x in cols.items()) + " FROM l c, g"


def _out(d, cols):
    return d.select("x", "y", "z", *(r(F.col(c), c, 4) for c in cols))


@query(_LATQ({f"t{i}{j}": _g(f, j) for i, f in enumerate(_F3) for j in range(3)}))
def gradient_tensor(spark, sf_dir):
    """G2, G3."""
    return _out(stencil.gradient_tensor(lat8(spark, sf_dir), LAT8, _F3, stencil=4), [f"t{i}{j}" for i, j in _pairs])


_W = {"c0": f"{_g('disc', 1)} - {_g('price', 2)}", "c1": f"{_g('qty', 2)} - {_g('disc', 0)}", "c2": f"{_g('price', 0)} - {_g('qty', 1)}"}


@query(_LATQ(_W))
def curl(spark, sf_dir):
    """G4."""
    return _out(stencil.curl(lat8(spark, sf_dir), LAT8, _F3, stencil=4), _W)


_DIV = " + ".join(_g(f, i) for i, f in enumerate(_F3))


@query(_LATQ({"div": _DIV}))
def divergence(spark, sf_dir):
    """G5."""
    return _out(stencil.divergence(lat8(spark, sf_dir), LAT8, _F3, stencil=4), ["div"])


@query(_LATQ({f"lap_{f}": " + ".join(_diff("l", "xyz", a, 8, 2, 2, "periodic", f, 1 / 8) for a in "xyz") for f in ("qty", "price")}))
def laplacian(spark, sf_dir):
    """G7, G8."""
    return _out(stencil.laplacian(lat8(spark, sf_dir), LAT8, ("qty", "price")), ["lap_qty", "lap_price"])


@query(_LATQ({f"adv{i}": " + ".join(f"{u} * {_g(f, j)}" for j, u in enumerate(_F3)) for i, f in enumerate(_F3)}))
def advective_derivative(spark, sf_dir):
    """G9."""
    return _out(stencil.advective(lat8(spark, sf_dir), LAT8, _F3, _F3, stencil=4), ["adv0", "adv1", "adv2"])


@query(f"WITH k AS (SELECT (event_id % 8)::INT AS x, (user_id % 8)::INT AS y, avg(value) AS f FROM events GROUP BY ALL), g AS (SELECT list(f ORDER BY x, y) AS f_all FROM k) SELECT x, y, {q(_diff('k', 'xy', 'y', 8, 1, 2, 'periodic', 'f', 1 / 8), 'vx', 4)}, {q('-' + _diff('k', 'xy', 'x', 8, 1, 2, 'periodic', 'f', 1 / 8), 'vy', 4)} FROM k c, g")
def stream_velocity(spark, sf_dir):
    """G11 on a periodic plane."""
    return derived.stream_velocity(evt2(spark, sf_dir), EVT2, "f").select("x", "y", r(F.col("vx"), "vx", 4), r(F.col("vy"), "vy", 4))


@query(_LATQ({"helicity": f"({_W['c0']}) * qty + ({_W['c1']}) * price + ({_W['c2']}) * disc"}))
def kinetic_helicity(spark, sf_dir):
    """P2."""
    return _out(derived.kinetic_helicity(lat8(spark, sf_dir), LAT8, _F3, stencil=4), ["helicity"])


@query(_LATQ({"helicity": f"(({_W['c0']}) * qty + ({_W['c1']}) * price + ({_W['c2']}) * disc) / (4 * pi())"}))
def current_helicity(spark, sf_dir):
    """P3."""
    return _out(derived.current_helicity(lat8(spark, sf_dir), LAT8, _F3, stencil=4), ["helicity"])


@query(_LATQ({f"f{i}": "(" + " + ".join(f"{u} * {_g(f, j)}" for j, u in enumerate(_F3)) + ") / (4 * pi())" for i, f in enumerate(_F3)}))
def tension(spark, sf_dir):
    """P5."""
    return _out(derived.tension(lat8(spark, sf_dir), LAT8, _F3, stencil=4), ["f0", "f1", "f2"])


@query(f"WITH {LAT} SELECT {q(f'-avg(tax * ({_DIV}))', 'heating')} FROM l c, g")
def heating_rate(spark, sf_dir):
    """P6."""
    return derived.heating_rate(lat8(spark, sf_dir), LAT8, "tax", _F3, stencil=4).select(r(F.col("heating"), "heating"))


_T = [[_g(f, j) for j in range(3)] for f in _F3]
_VT = {f"w{i}": f"({_W[f'c{i}']})" for i in range(3)}
_VT |= {f"c{i}": f"({_W[f'c{i}']}) * ({_DIV}) * {-2 / 3!r}" for i in range(3)}
_VT |= {f"s{j}": " + ".join(f"({_W[f'c{i}']}) * ((({_T[i][j]}) + ({_T[j][i]})) * 0.5" + (f" - ({_DIV}) / 3" if i == j else "") + ")" for i in range(3)) for j in range(3)}
_GP, _GR = [_g("tax", a) for a in range(3)], [_g("qty", a) for a in range(3)]
_VT |= {f"b{i}": f"({_GP[j]} * {_GR[k]} - {_GP[k]} * {_GR[j]}) / (qty * qty)" for i, (j, k) in enumerate(((1, 2), (2, 0), (0, 1)))}


@query(_LATQ(_VT))
def vorticity_terms(spark, sf_dir):
    """P4."""
    return _out(derived.vorticity_terms(lat8(spark, sf_dir), LAT8, _F3, "qty", "tax", stencil=4), _VT)


@query()
def frenet(spark, sf_dir):
    """P7."""
    return derived.frenet(lat8(spark, sf_dir), LAT8, _F3, stencil=4)


# ---- spectra ----------------------------------------------------------------------------------

_ARG = "2 * pi() * (kx * e.x + ky * e.y + kz * e.z) / 4"
_K = "k AS (SELECT a AS kx, b AS ky, c AS kz, CASE WHEN a >= 2 THEN a - 4 ELSE a END AS sx, CASE WHEN b >= 2 THEN b - 4 ELSE b END AS sy, CASE WHEN c >= 2 THEN c - 4 ELSE c END AS sz FROM range(4) t(a), range(4) u(b), range(4) w(c))"
_DFT = f"{EMB}, {_K}, d AS (SELECT snap, kx, ky, kz, sx, sy, sz, sum(f * cos({_ARG})) / 64 AS re, -sum(f * sin({_ARG})) / 64 AS im FROM e, k GROUP BY ALL)"
_DFTV = f"{EMBV}, {_K}, d AS (SELECT snap, kx, ky, kz, sx, sy, sz, " + ", ".join(f"sum({f} * cos({_ARG})) / 64 AS r{i}, -sum({f} * sin({_ARG})) / 64 AS i{i}" for i, f in enumerate(("vx", "vy", "vz"))) + " FROM v e, k GROUP BY ALL)"


@query(f"WITH {_DFT} SELECT snap, kx::INT AS x, ky::INT AS y, kz::INT AS z, {q('re', 'f_re', 8)}, {q('im', 'f_im', 8)} FROM d")
def fft_forward(spark, sf_dir):
    """F1, P14, F16."""
    t = spectral.transform(emb3(spark, sf_dir), EMB3, ("f",))
    return t.select("snap", "x", "y", "z", r(F.col("f_re"), "f_re", 8), r(F.col("f_im"), "f_im", 8))


@query(f"WITH {EMB} SELECT snap, x::INT AS x, y::INT AS y, z::INT AS z, {q('f', 'f')} FROM e")
def fft_round_trip(spark, sf_dir):
    """F1 and its inverse."""
    t = spectral.transform(spectral.transform(emb3(spark, sf_dir), EMB3, ("f",)), EMB3, ("f",), True)
    return t.select("snap", "x", "y", "z", r(F.col("f_re"), "f"))


@query(f"WITH {_DFT} SELECT snap, sx::INT AS kx, sy::INT AS ky, sz::INT AS kz, {q('re * re + im * im', 'p', 8)} FROM d")
def power_spectrum(spark, sf_dir):
    """F3, F23."""
    return spectral.power(emb3(spark, sf_dir), EMB3, ("f",)).select("snap", "kx", "ky", "kz", r(F.col("p"), "p", 8))


@query(f"WITH {_DFTV} SELECT snap, sx::INT AS kx, sy::INT AS ky, sz::INT AS kz, {q('r0*r0 + i0*i0 + r1*r1 + i1*i1 + r2*r2 + i2*i2', 'p', 8)} FROM d")
def power_spectrum_vector(spark, sf_dir):
    """the sum over components."""
    return spectral.power(emb3v(spark, sf_dir), EMB3, ("vx", "vy", "vz")).select("snap", "kx", "ky", "kz", r(F.col("p"), "p", 8))


_C = lambda a: f"(((s{a} + 2) % 4 + 4) % 4 - 1.5)"
_SH = lambda dist: f"WITH {_DFT}, b AS (SELECT snap, floor((sqrt({dist}) - 0.5) / 0.75)::BIGINT AS bin, re * re + im * im AS p FROM d) SELECT snap, bin, ceil(0.5 + (bin + 0.5) * 0.75)::BIGINT AS k, {q('sum(p)', 'power', 8)} FROM b WHERE bin >= 0 AND bin < 2 GROUP BY snap, bin"


@query(_SH(" + ".join(f"{_C(a)} * {_C(a)}" for a in "xyz")))
def shell_spectrum(spark, sf_dir):
    """Around the middle of the cube."""
    s = spectral.shells(spectral.power(emb3(spark, sf_dir), EMB3, ("f",)), EMB3)
    return s.select("snap", "bin", "k", r(F.col("power"), "power", 8))


@query(_SH("(sx * sx + sy * sy + sz * sz)::DOUBLE"))
def shell_spectrum_exact(spark, sf_dir):
    """around wavenumber zero."""
    s = spectral.shells(spectral.power(emb3(spark, sf_dir), EMB3, ("f",)), EMB3, exact=True)
    return s.select("snap", "bin", "k", r(F.col("power"), "power", 8))


@query(f"WITH {_DFT}, b AS (SELECT snap, floor((sqrt({_C('x')} * {_C('x')} + {_C('y')} * {_C('y')}) - 0.5) / 0.75)::BIGINT AS bin_perp, floor((abs({_C('z')}) - 0.5) / 0.75)::BIGINT AS bin_para, re * re + im * im AS p FROM d) SELECT snap, bin_perp, bin_para, {q('sum(p)', 'power', 8)} FROM b WHERE bin_perp BETWEEN 0 AND 1 AND bin_para BETWEEN 0 AND 1 GROUP BY snap, bin_perp, bin_para")
def cylinder_spectrum(spark, sf_dir):
    """F12."""
    s = spectral.cylinders(spectral.power(emb3(spark, sf_dir), EMB3, ("f",)), EMB3)
    return s.select("snap", "bin_perp", "bin_para", r(F.col("power"), "power", 8))


_INV = lambda re, im: f"sum({re} * cos(2 * pi() * (kx * c.x + ky * c.y + kz * c.z) / 4) - {im} * sin(2 * pi() * (kx * c.x + ky * c.y + kz * c.z) / 4))"
_CELLS = "c AS (SELECT a AS x, b AS y, c AS z FROM range(4) t(a), range(4) u(b), range(4) w(c))"


@query(f"WITH {_DFT}, {_CELLS} SELECT snap, x::INT AS x, y::INT AS y, z::INT AS z, {q('coalesce(' + _INV('re', 'im').replace('sum(', 'sum(CASE WHEN sqrt(sx*sx+sy*sy+sz*sz) > 0.5 AND sqrt(sx*sx+sy*sy+sz*sz) <= 1.5 THEN 1 ELSE 0 END * (', 1)[:-1] + ')), 0)', 'f')} FROM d, c GROUP BY ALL")
def shell_filter(spark, sf_dir):
    """F13."""
    f = spectral.shell_filter(emb3(spark, sf_dir), EMB3, ("f",), 0.5, 1.5)
    return f.select("snap", "x", "y", "z", r(F.col("f"), "f"))


_KK = "(sx * sx + sy * sy + sz * sz)"
_KD = lambda p: f"(sx * {p}0 + sy * {p}1 + sz * {p}2) / CASE WHEN {_KK} = 0 THEN 1 ELSE {_KK} END"


@query(f"WITH {_DFTV}, {_CELLS} SELECT snap, x::INT AS x, y::INT AS y, z::INT AS z, " + ", ".join(q(_INV(f"(s{a} * {_KD('r')})", f"(s{a} * {_KD('i')})"), f"irr{n}") for n, a in enumerate("xyz")) + ", " + ", ".join(q(_INV(f"(r{n} - s{a} * {_KD('r')})", f"(i{n} - s{a} * {_KD('i')})"), f"sol{n}") for n, a in enumerate("xyz")) + " FROM d, c GROUP BY ALL")
def helmholtz(spark, sf_dir):
    """F17."""
    h = spectral.helmholtz(emb3v(spark, sf_dir), EMB3, ("vx", "vy", "vz"))
    return h.select("snap", "x", "y", "z", *(r(F.col(f"{p}{i}"), f"{p}{i}") for p in ("irr", "sol") for i in range(3)))


_CR = [("y", 2, "z", 1), ("z", 0, "x", 2), ("x", 1, "y", 0)]
_PK = f"(CASE WHEN {_KK} = 0 THEN 0 ELSE 1 / (2 * pi() * {_KK}) END)"


@query(f"WITH {_DFTV}, {_CELLS} SELECT snap, x::INT AS x, y::INT AS y, z::INT AS z, " + ", ".join(q(_INV(f"(-(s{a} * i{i} - s{b} * i{j}) * {_PK})", f"((s{a} * r{i} - s{b} * r{j}) * {_PK})").replace("CASE WHEN " + _KK + " = 0 THEN 0 ELSE 1 / (2 * pi() * " + _KK + ") END", f"1 / (2 * pi() * greatest({_KK}, 1))"), f"a{n}") for n, (a, i, b, j) in enumerate(_CR)) + " FROM d, c GROUP BY ALL")
def vector_potential(spark, sf_dir):
    """P11."""
    a = spectral.vector_potential(emb3v(spark, sf_dir), EMB3, ("vx", "vy", "vz"))
    return a.select("snap", "x", "y", "z", *(r(F.col(f"a{i}"), f"a{i}") for i in range(3)))


@query(f"WITH {_DFTV}, c AS (SELECT *, r0*r1 + i0*i1 + r1*r2 + i1*i2 AS re, i0*r1 - r0*i1 + i1*r2 - r1*i2 AS im FROM d) SELECT snap, sx::INT AS kx, sy::INT AS ky, sz::INT AS kz, {q('sqrt(re*re + im*im)', 'p')}, {q('re', 'p_re')} FROM c")
def mixed_spectrum(spark, sf_dir):
    """F7."""
    s = spectral.mixed_power(emb3v(spark, sf_dir), EMB3, ("vx", "vy"), ("vy", "vz"))
    return s.select("snap", "kx", "ky", "kz", r(F.col("p"), "p"), r(F.col("p_re"), "p_re"))


_SCALES = f"""WITH {_DFT},
b AS (SELECT snap, floor((sqrt({" + ".join(f"{_C(a)} * {_C(a)}" for a in "xyz")}) - 0.5) / 0.75) AS bin, re * re + im * im AS p FROM d),
s AS (SELECT snap, ceil(0.5 + (bin + 0.5) * 0.75)::BIGINT AS k, sum(p) AS p FROM b WHERE bin >= 0 AND bin < 2 GROUP BY snap, bin)
SELECT snap, {q('sqrt(sum(p * k * k) / sum(p))', 'micro', 5)}, {q('sum(p * k) / sum(p)', 'energy', 5)}, {q('sum(p / k) / sum(p)', 'correlation', 5)}, max_by(k, p) AS peak FROM s GROUP BY snap"""


@query(_SCALES)
def spectrum_scales(spark, sf_dir):
    """F25."""
    s = spectral.scales(spectral.shells(spectral.power(emb3(spark, sf_dir), EMB3, ("f",)), EMB3))
    return s.select("snap", *(r(F.col(c), c, 5) for c in ("micro", "energy", "correlation")), "peak")


@query()
def transfer_matrix(spark, sf_dir):
    """X3, and two of the terms of X4."""
    from ..operators.transfer import advection_transfer

    return advection_transfer(emb3v(spark, sf_dir), EMB3, ("vx", "vy", "vz"), ("vx", "vy", "vz"), [0.5, 1.2, 1.8, 3.5], stencil=2)


# ---- structures -------------------------------------------------------------------------------


def _fof_sql(reach: float, least: int) -> str:
    return f"""WITH RECURSIVE p AS (SELECT vec_id AS pid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
e AS (SELECT a.pid AS a, b.pid AS b FROM p a JOIN p b ON a.pid <> b.pid AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= {reach * reach!r}::DOUBLE),
t(pid, root) AS (SELECT pid, pid FROM p UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.pid),
c AS (SELECT pid, min(root) AS root FROM t GROUP BY pid),
n AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS label FROM c GROUP BY root HAVING count(*) >= {least})
SELECT c.pid, coalesce(label, -1) AS label FROM c LEFT JOIN n USING (root)"""


@query(_fof_sql(0.03, 1))
def friends_of_friends(spark, sf_dir):
    """C4, C5, O6."""
    return clustering.friends_of_friends(points(spark, sf_dir), ("x", "y", "z"), 0.03)


@query(_fof_sql(0.05, 3))
def friends_of_friends_min3(spark, sf_dir):
    """C5, C11."""
    return clustering.friends_of_friends(points(spark, sf_dir), ("x", "y", "z"), 0.05, least=3)


_MED = "WITH RECURSIVE " + LAT + ", m AS (SELECT x, y, z FROM l WHERE qty > (SELECT quantile_cont(qty, 0.5) FROM l))"
_CC = f"""{_MED}, s AS (SELECT x, y, z, x * 64 + y * 8 + z AS id FROM m),
e AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON
 ((((a.x - b.x) % 8 + 8) % 8 IN (1, 7))::INT + (((a.y - b.y) % 8 + 8) % 8 IN (1, 7))::INT + (((a.z - b.z) % 8 + 8) % 8 IN (1, 7))::INT) = 1 AND (a.x = b.x)::INT + (a.y = b.y)::INT + (a.z = b.z)::INT = 2),
t(id, root) AS (SELECT id, id FROM s UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.id),
c AS (SELECT id, min(root) AS root FROM t GROUP BY id),
n AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS label FROM c GROUP BY root HAVING count(*) >= 2),
k AS (SELECT x, y, z, coalesce(label, -1) AS label FROM s JOIN c USING (id) LEFT JOIN n USING (root))"""


@query(f"{_CC} SELECT x, y, z, label FROM k")
def threshold_clusters(spark, sf_dir):
    """C8, C12, C17, C11."""
    return clustering.threshold_clusters(lat8(spark, sf_dir), LAT8, "qty", connectivity=6, least=2)


_MEAN = lambda a: f"(CASE WHEN t{a} < 0 THEN t{a} + 2 * pi() ELSE t{a} END) / (2 * pi())"
_PROPS = f"""{_CC}, u AS (SELECT label, count(*) AS size, {", ".join(f"atan2(round(sum(sin({a} * pi() / 4)), 12), round(sum(cos({a} * pi() / 4)), 12)) AS t{a}" for a in "xyz")} FROM k WHERE label >= 0 GROUP BY label),
v AS (SELECT label, size, {", ".join(f"{_MEAN(a)} AS c{a}" for a in "xyz")} FROM u),
w AS (SELECT v.*, {", ".join(f"k.{a} / 8.0 - c{a} AS d{a}" for a in "xyz")} FROM k JOIN v USING (label))
SELECT label, size, {", ".join(q(f"c{a}", f"c{a}", 5) for a in "xyz")}, {q("sqrt(avg(" + " + ".join(f"(d{a} - round(d{a})) * (d{a} - round(d{a}))" for a in "xyz") + "))", "radius", 5)} FROM w GROUP BY label, size, cx, cy, cz"""


@query(_PROPS)
def cluster_properties(spark, sf_dir):
    """Sizes, circular centres, root-mean-square radius."""
    p = clustering.properties(threshold_clusters(spark, sf_dir), LAT8)
    return p.select("label", "size", *(r(F.col(c), c, 5) for c in ("cx", "cy", "cz", "radius")))


@query(f"{_CC} SELECT label, count(*) AS size FROM k WHERE label >= 0 GROUP BY label ORDER BY size DESC, label LIMIT 3")
def top_clusters(spark, sf_dir):
    """O2, O3: a top-k report."""
    c = threshold_clusters(spark, sf_dir).where("label >= 0").groupBy("label").agg(F.count("*").alias("size"))
    return c.orderBy(F.desc("size"), "label").limit(3)


_NB = "(SELECT DISTINCT (((m.x + a) % 8) + 8) % 8 AS x, (((m.y + b) % 8) + 8) % 8 AS y, (((m.z + c) % 8) + 8) % 8 AS z FROM {m} m, range(-1, 2) t(a), range(-1, 2) u(b), range(-1, 2) w(c))"


@query(f"{_MED} SELECT x::INT AS x, y::INT AS y, z::INT AS z FROM {_NB.format(m='m')}")
def mask_dilate(spark, sf_dir):
    """C13."""
    d = lat8(spark, sf_dir)
    return clustering.dilate(_mask(d), LAT8)


@query(f"{_MED}, h AS (SELECT (((m.x + a) % 8) + 8) % 8 AS x, (((m.y + b) % 8) + 8) % 8 AS y, (((m.z + c) % 8) + 8) % 8 AS z FROM (SELECT * FROM l WHERE qty > (SELECT quantile_cont(qty, 0.1) FROM l)) m, range(-1, 2) t(a), range(-1, 2) u(b), range(-1, 2) w(c)) SELECT x::INT AS x, y::INT AS y, z::INT AS z FROM h GROUP BY x, y, z HAVING count(*) = 27")
def mask_erode(spark, sf_dir):
    """C13."""
    return clustering.erode(_mask(lat8(spark, sf_dir), 0.1), LAT8)


def _mask(d: DataFrame, share: float = 0.5) -> DataFrame:
    level = d.agg(F.percentile("qty", share)).first()[0]
    return d.where(F.col("qty") > level).select("x", "y", "z")


@query(f"""WITH {LAT}, d AS (SELECT qty, sqrt((SELECT sum(v * v) FROM (SELECT unnest([x / 8.0 - 0.5, y / 8.0 - 0.5, z / 8.0 - 0.5]) AS u) t, LATERAL (SELECT u - round(u) AS v))) AS r FROM l),
b AS (SELECT floor(r / 0.1)::BIGINT AS bin, qty FROM d)
SELECT i AS bin, {q('(i + 0.5) * 0.1', 'r')}, {q('coalesce(avg(qty), 0)', 'value')}, {q('coalesce(stddev_pop(qty), 0)', 'std')}, count(qty) AS count FROM range(5) t(i) LEFT JOIN b ON b.bin = i GROUP BY i""".replace("u - round(u)", "CASE WHEN abs(u) = 0.5 THEN -0.5 ELSE u - round(u) END"))
def radial_profile(spark, sf_dir):
    """C19, C1."""
    p = clustering.radial_profile(lat8(spark, sf_dir), LAT8, "qty", (0.5, 0.5, 0.5), 0.0, 0.5, 5)
    return p.select("bin", r(F.col("r"), "r"), r(F.col("value"), "value"), r(F.col("std"), "std"), "count")


@query(f"WITH {PART}, w AS (SELECT l_linenumber AS label, ax, ay, az FROM p) SELECT label, count(*) AS size, " + ", ".join(q(f"avg({a})", f"c{a}", 5) for a in A) + ", " + ", ".join(q(f"avg({a} * {b}) - avg({a}) * avg({b})", f"m{i}{j}", 4) for i, a in enumerate(A) for j, b in enumerate(A)) + " FROM w GROUP BY label")
def shape_moments(spark, sf_dir):
    """C22, C24."""
    d = clustering.shape_moments(part(spark, sf_dir).withColumn("label", F.col("l_linenumber")), A)
    return d.select("label", "size", *(r(F.col(f"c{a}"), f"c{a}", 5) for a in A), *(r(F.col(f"m{i}{j}"), f"m{i}{j}", 4) for i, j in _pairs))


@query("WITH k AS (SELECT (event_id % 8)::INT AS x, (user_id % 8)::INT AS y, avg(value) AS f FROM events GROUP BY ALL) SELECT x // 2 AS x, y // 2 AS y, round(avg(f), 6) + 0.0 AS f FROM k GROUP BY ALL".replace("GROUP BY ALL) SELECT x // 2 AS x, y // 2 AS y", "GROUP BY ALL) SELECT (x // 2)::INT AS x, (y // 2)::INT AS y").replace("FROM k GROUP BY ALL", "FROM k GROUP BY k.x // 2, k.y // 2"))
def block_reduce(spark, sf_dir):
    """S20."""
    return snapshots.block_reduce(evt2(spark, sf_dir), "f", 2).select("x", "y", r(F.col("f"), "f"))


@query("SELECT l_orderkey, l_linenumber, (l_partkey % 8)::BIGINT AS block, (((l_partkey % 8) % 2) * 4 + l_orderkey % 4)::INT AS x, (((l_partkey % 8) // 2 % 2) * 4 + l_suppkey % 4)::INT AS y, (((l_partkey % 8) // 4) * 4 + l_linenumber % 4)::INT AS z FROM lineitem")
def block_lattice(spark, sf_dir):
    """Block numbers and inner indices to lattice positions."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 8).alias("block"), (F.col("l_partkey") % 8).alias("b"), (F.col("l_linenumber") % 4).alias("i0"), (F.col("l_suppkey") % 4).alias("i1"), (F.col("l_orderkey") % 4).alias("i2"))
    d = snapshots.blocks_to_lattice(l, (2, 2, 2), (4, 4, 4))
    return d.select("l_orderkey", "l_linenumber", F.col("b").alias("block"), "x", "y", "z")


@query(f"WITH {LAT}, m AS (SELECT avg(qty) AS a FROM l) SELECT x, y, z, {q('qty - a', 'f')} FROM l, m")
def remove_mean(spark, sf_dir):
    """S4."""
    d = lat8(spark, sf_dir)
    return d.crossJoin(F.broadcast(d.agg(F.avg("qty").alias("a")))).select("x", "y", "z", r(F.col("qty") - F.col("a"), "f"))  # the right side is one row


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem")
def sort_particles(spark, sf_dir):
    """O1: every row, ties by part and supplier."""
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return clustering.positions(table(spark, sf_dir, "lineitem").select(*keys), *keys)
