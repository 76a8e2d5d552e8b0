"""Readers and writers of simulation snapshots: block tables, AthenaK binaries, VTU meshes, spectrum files, NPZ."""

from __future__ import annotations

import base64
import io
import re
import struct
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def block_position(block: Column, blocks: tuple[int, int, int]) -> tuple[Column, Column, Column]:
    """(i, j, k) of a block numbered (k * jp + j) * ip + i."""
    ip, jp, _ = blocks
    return F.pmod(block, F.lit(ip)), F.pmod((block / ip).cast("long"), F.lit(jp)), (block / (ip * jp)).cast("long")


def blocks_to_lattice(df: DataFrame, blocks: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """(block, i0, i1, i2, ...) -> x, y, z and the rest: i2 runs along x, i1 along y, i0 along z. No shuffle."""
    i, j, k = block_position(F.col("block"), blocks)
    at = ((i * size[0] + F.col("i2")), (j * size[1] + F.col("i1")), (k * size[2] + F.col("i0")))
    return df.select(*(c.cast("int").alias(a) for a, c in zip("xyz", at, strict=True)), *(c for c in df.columns if c not in ("block", "i0", "i1", "i2")))


def lattice_to_blocks(df: DataFrame, blocks: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """The inverse of `blocks_to_lattice`."""
    part = [(F.col(a) / n).cast("int") for a, n in zip("xyz", size, strict=True)]
    block = (part[2] * blocks[1] + part[1]) * blocks[0] + part[0]
    rest = [c for c in df.columns if c not in ("x", "y", "z")]
    return df.select(block.cast("long").alias("block"), *((F.col(a) % n).cast("int").alias(i) for i, a, n in (("i0", "z", size[2]), ("i1", "y", size[1]), ("i2", "x", size[0]))), *rest)


def parse_athenak(raw: bytes) -> tuple[list[str], list[tuple[tuple[int, ...], tuple[int, ...], np.ndarray]], dict[str, str]]:
    """An AthenaK binary of version 1.1 -> variable names, (index, logical position, values[var, k, j, i]) of its blocks, header parameters."""
    f = io.BytesIO(raw)
    line = lambda: f.readline().decode("ascii", "replace").strip()
    if not (first := line()).startswith("Athena") or "version=1.1" not in first:
        raise ValueError("not an AthenaK binary of version 1.1")
    head: dict[str, str] = {}
    names: list[str] = []
    loc, var = 4, 4
    while True:
        s = line()
        key, _, value = s.partition("=")
        key, value = key.strip().lower(), value.strip()
        if key == "size of location":
            loc = int(value)
        elif key == "size of variable":
            var = int(value)
        elif key.startswith("variables"):
            names = value.split() or s.split(":")[-1].split()
        elif key == "header offset":
            text = f.read(int(value)).decode("ascii", "replace")
            head = {k.strip(): v.split("#")[0].strip() for k, _, v in (x.partition("=") for x in text.split("\n")) if v}
            break
        elif not s and f.tell() == len(raw):
            raise ValueError("the header has no end")
        elif key:
            head[key] = value
    blocks = []
    while f.tell() < len(raw):
        index = struct.unpack("<6i", f.read(24))
        logical = struct.unpack("<4i", f.read(16))
        f.read(6 * loc)
        n = [index[2 * i + 1] - index[2 * i] + 1 for i in range(3)]
        size = len(names) * n[0] * n[1] * n[2]
        blocks.append((index, logical, np.frombuffer(f.read(size * var), "<f4" if var == 4 else "<f8").reshape(len(names), n[2], n[1], n[0])))
    return names, blocks, head


def read_athenak(spark: SparkSession, path: str, variables: tuple[str, ...]) -> DataFrame:
    """file, x, y, z and the variables of every cell; blocks are placed by their logical positions. press = (gamma - 1) * eint."""
    own = tuple(v for v in variables if v != "press")
    need = tuple(dict.fromkeys((*own, *(("eint",) if "press" in variables else ()))))
    schema = "file string, lx int, ly int, lz int, nx int, ny int, nz int, i int, j int, k int, gamma double, " + ", ".join(f"`{v}` double" for v in need)

    def run(batches):
        for b in batches:
            for file, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                names, blocks, head = parse_athenak(raw)
                for _, logical, v in blocks:
                    nz, ny, nx = v.shape[1:]
                    k, j, i = (x.ravel() for x in np.indices((nz, ny, nx)))
                    n = len(i)
                    full = lambda x: pa.array(np.full(n, x, np.int32))  # noqa: E731, B023
                    cols = [pa.array([file] * n), *(full(x) for x in (*logical[:3], nx, ny, nz)), *(pa.array(x.astype(np.int32)) for x in (i, j, k)), pa.array(np.full(n, float(head.get("gamma", "nan"))))]
                    cols += [pa.array(v[names.index(x)].ravel().astype(float)) for x in need]
                    yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([("file", pa.string()), *((c, pa.int32()) for c in ("lx", "ly", "lz", "nx", "ny", "nz", "i", "j", "k")), ("gamma", pa.float64()), *((x, pa.float64()) for x in need)]))

    d = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)
    low = d.groupBy("file").agg(*(F.min(f"l{a}").alias(f"m{a}") for a in "xyz"))
    d = d.join(F.broadcast(low), "file")  # a row a file
    at = [((F.col(f"l{a}") - F.col(f"m{a}")) * F.col(f"n{a}") + F.col(i)).alias(a) for a, i in zip("xyz", "ijk", strict=True)]
    return d.select("file", *at, *own, *([((F.col("gamma") - 1) * F.col("eint")).alias("press")] if "press" in variables else []))


_VTU = {"Float32": "<f4", "Float64": "<f8", "Int32": "<i4", "Int64": "<i8"}


def parse_vtu(raw: bytes) -> list[dict[str, np.ndarray]]:
    """Pieces of a VTU file: points, connectivity, offsets and cell arrays (ascii, base64 or appended raw data, u32 lengths)."""
    appended, xml = b"", raw
    if (m := re.search(rb"<AppendedData[^>]*>\s*_", raw)) is not None:
        end = raw.rfind(b"</AppendedData>")
        appended, xml = raw[m.end() : end], raw[: m.start()] + b"</VTKFile>"
    out = []
    for piece in ElementTree.fromstring(xml.decode("utf-8")).iter("Piece"):
        found = {}
        for tag in ("Points", "Cells", "CellData", "PointData"):
            for a in piece.findall(f"{tag}/DataArray"):
                kind = a.get("type")
                if kind not in _VTU:
                    raise ValueError(f"arrays of type {kind} are not supported")
                if (form := a.get("format", "ascii")) == "ascii":
                    v = np.array((a.text or "").split(), _VTU[kind])
                else:
                    data = appended[int(a.get("offset", 0)) :] if form == "appended" else base64.b64decode(a.text or "")
                    n = struct.unpack("<I", data[:4])[0]
                    v = np.frombuffer(data[4 : 4 + n], _VTU[kind])
                found["points" if tag == "Points" else a.get("Name")] = v.reshape(-1, 3) if tag == "Points" else v
        out.append(found)
    return out


def read_vtu(spark: SparkSession, path: str, variables: tuple[str, ...]) -> DataFrame:
    """file, piece, cell, centre (mean of the cell's vertices) and the variables, a row a cell."""
    schema = T.StructType([T.StructField("file", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("piece", "cell")), *(T.StructField(c, T.DoubleType()) for c in ("x", "y", "z", *variables))])

    def run(batches):
        for b in batches:
            for file, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for n, p in enumerate(parse_vtu(raw)):
                    ends = p["offsets"].astype(np.int64)
                    starts = np.concatenate(([0], ends[:-1]))
                    cell = np.repeat(np.arange(len(ends)), ends - starts)
                    xyz = p["points"][p["connectivity"]]
                    mid = [np.bincount(cell, xyz[:, i], len(ends)) / (ends - starts) for i in range(3)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * len(ends)), pa.array(np.full(len(ends), n)), pa.array(np.arange(len(ends))), *map(pa.array, mid), *(pa.array(p[v].astype(float)) for v in variables)],
                        names=["file", "piece", "cell", "x", "y", "z", *variables],
                    )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def read_npz(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """file, x, y, z and the named 3-D arrays, a row a cell."""

    def run(batches):
        for b in batches:
            for file, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                v = np.load(io.BytesIO(raw))
                at = [x.ravel().astype(np.int32) for x in np.indices(v[names[0]].shape)]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(at[0])), *map(pa.array, at), *(pa.array(v[n].ravel().astype(float)) for n in names)], names=["file", "x", "y", "z", *names])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, x int, y int, z int, " + ", ".join(f"`{n}` double" for n in names))


def read_spectrum(spark: SparkSession, path: str, header: int = 6) -> DataFrame:
    """A solver's spectrum table: white-space separated numbers after some header lines -> file, line, values."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    d = d.where((F.col("line") >= header) & (F.trim("text") != ""))
    return d.select("file", (F.col("line") - header).alias("line"), F.transform(F.split(F.trim("text"), r"\s+"), lambda x: x.cast("double")).alias("values"))


def read_ramses(*_args, **_kw):
    raise NotImplementedError("RAMSES snapshots are not supported")


def block_reduce(df: DataFrame, field: str, b: int, axes: tuple[str, ...] = ("x", "y"), keys: tuple[str, ...] = ()) -> DataFrame:
    """Means over tiles of b cells a side."""
    return df.groupBy(*keys, *((F.col(a) / b).cast("int").alias(a) for a in axes)).agg(F.avg(field).alias(field))


def cell_centres(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points (pt, x, y, z) and cells (cell, vertices) -> cell, x, y, z: the mean of its vertices."""
    v = cells.select("cell", F.explode("vertices").alias("pt"))
    return v.join(points, "pt").groupBy("cell").agg(*(F.avg(a).alias(a) for a in "xyz"))


def write_field(df: DataFrame, path: str, name: str) -> None:
    """Replaces a field of a snapshot store: a Parquet table partitioned by snap. Names may not hold an underscore."""
    if "_" in name:
        raise ValueError("a field's name may not contain an underscore")
    df.write.mode("overwrite").partitionBy("snap").parquet(f"{path.rstrip('/')}/{name}")
