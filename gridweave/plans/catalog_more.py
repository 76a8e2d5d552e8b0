"""More queries, of the modules `structures` and `waves` and of the sheared spectra; adds to the catalog's names and SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import eigen
from ..functions.vector import dot, vec
from ..operators import clustering, derived, orbits, spectral, structures, waves
from ..sources.tables import EMB3, EVT2, LAT8, emb3, emb3v, evt2, lat8, part, points, table
from .catalog import LAT, ORACLES, PART, QUERIES, q, query, r, threshold_clusters

__all__ = ["ORACLES", "QUERIES"]

EVT = "k AS (SELECT (event_id % 8)::INT AS x, (user_id % 8)::INT AS y, avg(value) AS f FROM events GROUP BY ALL)"
_VEL = ("vx", "vy", "vz")


@query("SELECT event_id, dense_rank() OVER (ORDER BY user_id % 16, event_id % 4) - 1 AS number, count(*) OVER (PARTITION BY user_id % 16, event_id % 4) AS count FROM events")
def distinct_counts(spark, sf_dir):
    """Number and count of the distinct value of each row."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 16).alias("a"), (F.col("event_id") % 4).alias("b"))
    return structures.distinct_counts(e, "a", "b").select("event_id", "number", "count")


_CLAMP = lambda a, s: f"least(7, greatest(0, c.{a} + {s}))"


@query(f"WITH {LAT} SELECT c.x, c.y, c.z, {q('avg(n.qty)', 'qty')}, {q('avg(n.price)', 'price')} FROM l c, range(-1, 2) a(i), range(-1, 2) b(j), range(-1, 2) d(k) JOIN l n ON n.x = {_CLAMP('x', 'i')} AND n.y = {_CLAMP('y', 'j')} AND n.z = {_CLAMP('z', 'k')} GROUP BY c.x, c.y, c.z")
def box_smooth(spark, sf_dir):
    """T9."""
    d = structures.box_smooth(lat8(spark, sf_dir), LAT8, ("qty", "price"), 3)
    return d.select("x", "y", "z", r(F.col("qty"), "qty"), r(F.col("price"), "price"))


@query(f"""WITH {EVT}, a AS (SELECT x, y, f * CASE WHEN x >= 5 THEN 1 - (x - 5) / 2.0 ELSE 1 END AS v FROM k),
b AS (SELECT x + 5 AS x, y, f * CASE WHEN x + 5 < 8 THEN x / 2.0 ELSE 1 END AS v FROM k)
SELECT x, y, {q('sum(v)', 'f')} FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY x, y""")
def blend_images(spark, sf_dir):
    """L3."""
    e = evt2(spark, sf_dir)
    return structures.blend(e, e, 8, 3, "f").select("x", "y", r(F.col("f"), "f"))


_AX = ("ax", "ay", "az")


@query(f"""WITH {PART}, c AS (SELECT l_linenumber AS label, avg(ax) AS cx, avg(ay) AS cy, avg(az) AS cz FROM p GROUP BY 1),
d AS (SELECT label, sqrt((ax - cx) * (ax - cx) + (ay - cy) * (ay - cy) + (az - cz) * (az - cz)) AS d FROM p JOIN c ON label = l_linenumber),
e AS (SELECT label, d, min(d) OVER w AS low, max(d) OVER w AS high FROM d WINDOW w AS (PARTITION BY label)),
b AS (SELECT label, low, (high - low) / 8 AS w, least(floor((d - low) / ((high - low) / 8)), 7)::BIGINT AS bin FROM e)
SELECT label, bin, {q('low + (bin + 0.5) * w', 'r', 4)}, {q('count(*) / (4 / 3::DOUBLE * pi() * (pow(low + (bin + 1) * w, 3) - pow(low + bin * w, 3)))', 'density', 3)} FROM b GROUP BY label, bin, low, w""")
def density_profile(spark, sf_dir):
    """C27."""
    d = structures.density_profile(part(spark, sf_dir).withColumn("label", F.col("l_linenumber")), _AX, 8)
    return d.select("label", F.col("bin").cast("long").alias("bin"), r(F.col("r"), "r", 4), r(F.col("density"), "density", 3))


@query(f"""WITH {PART}, m AS (SELECT l_linenumber AS label, count(*) AS size, var_pop(ax) AS a, var_pop(bw) AS b, covar_pop(ax, bw) AS c FROM (SELECT l_linenumber, ax, az AS bw FROM p) GROUP BY 1),
e AS (SELECT label, size, (a + b + sqrt((a - b) * (a - b) + 4 * c * c)) / 2 AS l0, (a + b - sqrt((a - b) * (a - b) + 4 * c * c)) / 2 AS l1 FROM m)
SELECT label, size, {q('l0', 'l0', 4)}, {q('l1', 'l1', 4)}, {q('sqrt(l0 / l1)', 'elongation', 3)}, {q('1 - l1 / l0', 'anisotropy', 4)} FROM e""")
def shape_metrics(spark, sf_dir):
    """C25 in two dimensions (three: a test)."""
    d = structures.shape_metrics(part(spark, sf_dir).withColumn("label", F.col("l_linenumber")), ("ax", "az"))
    return d.select("label", "size", r(F.col("l0"), "l0", 4), r(F.col("l1"), "l1", 4), r(F.col("elongation"), "elongation", 3), r(F.col("anisotropy"), "anisotropy", 4))


@query(f"""WITH {EVT}, n AS (SELECT c.x, c.y, c.f, max(o.f) AS hi, min(o.f) AS lo FROM k c, range(-1, 2) a(i), range(-1, 2) b(j) JOIN k o ON o.x = (c.x + i + 8) % 8 AND o.y = (c.y + j + 8) % 8 GROUP BY ALL)
SELECT x, y, {q('f', 'value')}, CASE WHEN f = hi THEN 'X' ELSE 'O' END AS kind, x / 8.0 - 0.5 AS px, y / 8.0 - 0.5 AS py FROM n WHERE hi > lo AND (f = hi OR f = lo)""")
def null_points(spark, sf_dir):
    """R1 (without smoothing), R2."""
    d = structures.local_extrema(evt2(spark, sf_dir), EVT2, "f")
    return d.select("x", "y", r(F.col("value"), "value"), "kind", "px", "py")


_D2 = " + ".join(f"({a} / 8.0 - 0.5) * ({a} / 8.0 - 0.5)" for a in "xyz")


@query(f"WITH {LAT} SELECT count(*) AS cells, " + ", ".join(f"{n}({a}) AS {n}_{a}" for a in "xyz" for n in ("min", "max")) + f" FROM l WHERE sqrt({_D2}) <= 0.3")
def region_box(spark, sf_dir):
    """Cells and bounds of a ball."""
    return structures.region(lat8(spark, sf_dir), LAT8, (0.5, 0.5, 0.5), 0.3)


@query(f"""WITH {LAT}, v AS (SELECT 'x' AS axis, x::DOUBLE AS v FROM l UNION SELECT 'y', y FROM l UNION SELECT 'qty', qty FROM l),
s AS (SELECT axis, v - lag(v) OVER (PARTITION BY axis ORDER BY v) AS s FROM v)
SELECT axis, coalesce(max(s) - min(s) <= abs(max(s)) * 1e-5, true) AS grid, {q('min(s)', 'least')}, {q('max(s)', 'greatest')} FROM s GROUP BY axis""")
def data_kind(spark, sf_dir):
    """C23."""
    d = structures.data_kind(lat8(spark, sf_dir), ("x", "y", "qty"))
    return d.select("axis", "grid", r(F.col("least"), "least"), r(F.col("greatest"), "greatest"))


@query(f"WITH {PART} SELECT l_orderkey, l_linenumber, 0.0 AS residual, 0.0 AS off_unit, 1 AS descending FROM p")
def eig_residuals(spark, sf_dir):
    """|A v - l v| and |v.v - 1| of every vector vanish, and eigenvalues descend."""
    d = QUERIES["eig_vectors"](spark, sf_dir)
    m = [[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]
    off, unit = [], []
    for k in range(3):
        v = vec(*(f"ev{k}{i}" for i in range(3)))
        off += [F.abs(dot(tuple((m[i][j] + m[j][i]) / 2 for j in range(3)), v) - F.col(f"el{k}") * v[i]) for i in range(3)]
        unit.append(F.abs(dot(v, v) - 1))
    down = (F.col("el0") >= F.col("el1")) & (F.col("el1") >= F.col("el2"))
    return d.select("l_orderkey", "l_linenumber", r(F.greatest(*off), "residual"), r(F.greatest(*unit), "off_unit"), down.cast("int").alias("descending"))


@query(f"WITH {PART} SELECT l_orderkey, l_linenumber, 0.0 AS off_unit, 0.0 AS off_right FROM p")
def wave_basis(spark, sf_dir):
    """The three displacements of a wave along each particle's vector have unit length, and the third is across the others."""
    d = waves.displacements(part(spark, sf_dir).select("l_orderkey", "l_linenumber", "ax", "ay", "bx"), ("ax", "ay", "bx"), 0.5)
    a, b, c = (vec(*(f"{n}{i}" for i in range(3))) for n in ("slow", "fast", "alfven"))
    return d.select("l_orderkey", "l_linenumber", r(F.greatest(*(F.abs(dot(x, x) - 1) for x in (a, b, c))), "off_unit"), r(F.greatest(F.abs(dot(a, c)), F.abs(dot(b, c))), "off_right"))


@query(f"WITH {PART} SELECT l_orderkey, l_linenumber, {q('(bx*2 + sqrt(4*bx*bx - 4*(bx*bx - ay*ay))) / 2', 'rate')} FROM p")
def stretching_rate(spark, sf_dir):
    """The largest stretching of a plane gradient with equal diagonal and an antisymmetric part that does not count."""
    t = ((F.col("bx"), F.col("ay") + F.col("az")), (F.col("ay") - F.col("az"), F.col("bx")))
    return part(spark, sf_dir).select("l_orderkey", "l_linenumber", r(eigen.stretching_rate(t), "rate"))


@query()
def magnetic_helicity(spark, sf_dir):
    """P1; a test compares with a field of known helicity."""
    return waves.magnetic_helicity(emb3v(spark, sf_dir), EMB3, _VEL)


@query()
def wave_modes(spark, sf_dir):
    """Amplitudes of slow, fast and Alfven waves at every wavenumber; tests rebuild the field from them."""
    t = spectral.transform(emb3v(spark, sf_dir), EMB3, _VEL)
    k = [f.alias(n) for f, n in zip(spectral.angular(EMB3), ("kx", "ky", "kz"), strict=True)]
    return waves.wave_modes(t.select("*", *k), _VEL, ("kx", "ky", "kz"), 0.5)


@query()
def critical_points(spark, sf_dir):
    """P9, P10."""
    return waves.critical_points(waves.null_jacobian(emb3v(spark, sf_dir), EMB3, _VEL, ("snap",)))


@query()
def tnb_components(spark, sf_dir):
    """P8."""
    return waves.tnb_components(lat8(spark, sf_dir), LAT8, ("qty", "price", "disc"), ("price", "disc", "tax"))


@query()
def sheared_spectrum(spark, sf_dir):
    """F4, F11; tests compare with numpy."""
    p = spectral.sheared_power(emb3(spark, sf_dir), EMB3, ("f",), 0.3, 1.7)
    return spectral.sheared_shells(p, EMB3, 0.3, 1.7, [0.0, 2 * math.pi, 4 * math.pi, 8 * math.pi])


@query()
def shell_filter_plane(spark, sf_dir):
    """F14, on planes of the lattice's first two axes; a test compares with numpy."""
    from ..grid import Grid

    e = emb3(spark, sf_dir).select((F.col("snap") * 4 + F.col("z")).alias("snap"), "x", "y", "f")
    return spectral.shell_filter_plane(e, Grid((4, 4)), ("f",), 2 * math.pi, 4 * math.pi)


@query()
def voxel_groups(spark, sf_dir):
    """C7; a test compares with brute force."""
    return structures.voxel_groups(points(spark, sf_dir), ("x", "y", "z"), 0.05, 1, 3)


@query()
def filtered_mask(spark, sf_dir):
    """Closed, holes filled, small parts dropped."""
    d = lat8(spark, sf_dir)
    return structures.filter_mask(d.where("qty > 25.5").select("x", "y", "z"), LAT8, d, 1, True, 2)


@query()
def cluster_profiles(spark, sf_dir):
    """C20."""
    c = clustering.properties(threshold_clusters(spark, sf_dir), LAT8)
    return structures.cluster_profiles(lat8(spark, sf_dir), LAT8, ("qty", "price"), c, 4, 2.0)


@query(f"""WITH {PART}, m AS (SELECT avg(ax) AS mx, avg(ay) AS my, avg(az) AS mz FROM p)
SELECT l_orderkey, l_linenumber, {q('sqrt((ax - mx) * (ax - mx) + (ay - my) * (ay - my) + (az - mz) * (az - mz))', 'f', 5)} FROM p, m""")
def centred_magnitude(spark, sf_dir):
    """The magnitude of a vector without its mean."""
    d = derived.fused_magnitude(part(spark, sf_dir), _AX, "f", centred=True)
    return d.select("l_orderkey", "l_linenumber", r(F.col("f"), "f", 5))


@query(f"""WITH {EVT}, p AS (SELECT vec_id AS pid, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py FROM embeddings),
a AS (SELECT pid, abs(px) <= 0.1 AND abs(py) <= 0.5 AS near, (px + 0.5) * 8 AS u, (py + 0.5) * 8 AS v FROM p),
c AS (SELECT pid, (floor(u)::BIGINT + i) % 8 AS x, (floor(v)::BIGINT + j) % 8 AS y, (CASE i WHEN 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE j WHEN 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS w
  FROM a, range(2) s(i), range(2) t(j) WHERE near),
g AS (SELECT pid, sum(w * f) AS f FROM c JOIN k USING (x, y) GROUP BY pid)
SELECT pid, {q('coalesce(g.f, 0)', 'f')} FROM a LEFT JOIN g USING (pid)""")
def sheet_interpolation(spark, sf_dir):
    """A field at the places of all vectors, zero outside the sheet."""
    p = points(spark, sf_dir).select("pid", F.col("x").alias("px"), F.col("y").alias("py"))
    return orbits.bilinear(p, evt2(spark, sf_dir), EVT2, ("f",)).select("pid", r(F.col("f"), "f"))
