"""Fields at any place of a plane: bilinear interpolation inside a current sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import PERIODIC, Grid

#: Half-widths of the sheet, in side lengths along x and y.
SHEET = (0.1, 0.5)


def bilinear(points: DataFrame, field: DataFrame, grid: Grid, cols: tuple[str, ...], sheet: tuple[float, float] | None = SHEET, pid: str = "pid") -> DataFrame:
    """(pid, px, py) and a plane's cells -> pid and the fields at the points, whose origin is the plane's middle.

    Cell i lies at i * spacing - side / 2. Points outside |px| <= sheet[0] * side, |py| <= sheet[1] * side get
    zeros. Each other point asks its four corners by a join on the cell; periodic axes wrap, on others points
    beyond the cells, like those with a null coordinate or a missing corner, get nulls. Ids are to be distinct.
    """
    at = [(F.col(f"p{a}").cast("double") + grid.side(i) / 2) / grid.spacing(i) for i, a in enumerate("xy")]
    low = [F.floor(c) for c in at]
    corners = []
    for i in (0, 1):
        for j in (0, 1):
            weight, cell = F.lit(1.0), []
            for k, s in enumerate((i, j)):
                part = at[k] - low[k]
                weight = weight * (part if s else 1 - part)
                c = low[k] + s
                cell.append((F.pmod(c, F.lit(grid.dims[k])) if grid.bc(k) == PERIODIC else c).cast("int").alias("xy"[k]))
            corners.append(F.struct(*cell, weight.alias("_w")))
    here = F.lit(True)
    if sheet:
        for k, a in enumerate("xy"):
            here = here & (F.abs(F.col(f"p{a}")) <= sheet[k] * grid.side(k))
    p = points.select(F.col(pid).alias("_p"), F.when(here, F.lit(1)).when(F.col("px").isNotNull() & F.col("py").isNotNull(), F.lit(0)).alias("_in"), F.array(*corners).alias("_c"))
    asked = p.where("_in = 1").select("_p", F.explode("_c").alias("_c")).select("_p", "_c.*").where("_w <> 0")
    # a corner of no weight asks nothing, so points on the last cell of an open axis have a value
    got = asked.join(field.select("x", "y", *cols), ["x", "y"], "left").groupBy("_p").agg(*(F.when(F.count("*") == F.count(c), F.sum(F.col("_w") * F.col(c))).alias(c) for c in cols))
    return p.select("_p", "_in").join(got, "_p", "left").select(F.col("_p").alias(pid), *(F.when(F.col("_in") == 0, F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in cols))
