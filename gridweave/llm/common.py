"""Helpers shared by the training-data operators: tables, shared scratch space, hot keys, hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it has at least this share of the rows; so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 1 / 200
#: ... and at least this many rows.
HOT_ROWS = 64
#: Rows of one batch are cut into pieces of about this many bytes of text before numpy works on them.
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        root = "file://" + tempfile.mkdtemp(prefix="gridweave-")
    else:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by now
            pass


atexit.register(_clean)


def drop_scratch(*tables: DataFrame) -> None:
    """Deletes tables of `materialize` that nothing reads any more; others are left alone."""
    for df in tables:
        names = set(df.inputFiles())
        for spark, path in [x for x in _written if any(n.startswith((x[1] + "/", x[1].replace("file:///", "file:/") + "/")) for n in names)]:
            _delete(spark, path)
            _written.remove((spark, path))


def scratch_now() -> list:
    """What `materialize` has written and nothing has deleted, for `drop_written`."""
    return list(_written)


def drop_written(written: list, keep: DataFrame) -> None:
    """Deletes such tables, but for those that `keep` reads."""
    names = keep.inputFiles()
    for spark, path in written:
        if (spark, path) in _written and not any(n.startswith((path + "/", path.replace("file:///", "file:/") + "/")) for n in names):
            _delete(spark, path)
            _written.remove((spark, path))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder and read them again."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/gridweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def hot_keys(df: DataFrame, key: str, rows: int | None = None) -> list:
    """The keys with over HOT_SHARE of the rows: at most 1 / HOT_SHARE values reach the driver."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    rows = df.count() if rows is None else rows
    return [r[0] for r in counts.where(F.col("_n") >= max(HOT_ROWS, int(rows * HOT_SHARE))).select(key).collect()]


def wide_join(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """Equi-join by a sort-merge at every size, so that adaptive execution splits the rows of hot keys of `left`; `right` has one row a key."""
    return left.join(right.hint("merge"), key, how)


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """Equi-join on `key` where `right` has one row a key and `left` may have hot keys.

    The few hot keys' rows of `right` (at most 1 / HOT_SHARE, one each) are broadcast; the others
    meet by a shuffle at every size, as `right` grows with the data.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right.hint("merge"), key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    a = left.where(is_hot).join(F.broadcast(right.where(F.col(key).isin(hot))), key, how)
    b = left.where(~is_hot).join(right.where(~is_hot).hint("merge"), key, how)
    return a.unionByName(b)


#: A membership filter has so many bitmaps of 2^15 bits: 4 MB in all, whatever the number of keys.
FILTER_MAPS = 1024


def may_be_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of `df` whose key may be one of `keys` (their first column): no such row is lost, some others stay.

    The keys set bits by hash in bitmaps of a fixed total size, which are broadcast. With very many keys (from
    some ten millions on) the bitmaps fill up and pass ever more rows; what follows has to join exactly.
    """
    h = F.xxhash64(F.col(keys.columns[0]).cast(df.schema[key].dataType))
    place = lambda x: F.pmod(F.shiftright(x, 15), F.lit(FILTER_MAPS)).cast("int")
    bits = keys.where(F.col(keys.columns[0]).isNotNull()).select(place(h).alias("_map"), F.pmod(h, F.lit(1 << 15)).alias("_bit"))
    bits = bits.groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    d = df.where(F.col(key).isNotNull()).withColumn("_h", F.xxhash64(key)).withColumn("_map", place(F.col("_h")))
    at = F.pmod(F.col("_h"), F.lit(1 << 15)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2)) == 1
    return d.join(F.broadcast(bits), "_map").where(is_set).select(*df.columns)


# ---- numpy over Arrow text -------------------------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE_WORD = np.ones(256, dtype=bool)
_SPACE_WORD[[32, 9, 10, 11, 12, 13]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_pow: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _pow.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, PIECE_BYTES), base, dtype=np.uint64)
        full[0] = 1
        have = _pow[base] = np.multiply.accumulate(full)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and len + 1 offsets; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(batch: pa.RecordBatch, column: str):
    """Slices of the batch of about PIECE_BYTES of text, so that memory does not follow its size."""
    i = batch.schema.get_field_index(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PIECE_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def word_hashes(data: np.ndarray, off: np.ndarray, inside: np.ndarray = _SPACE_WORD, prefixes: tuple[int, ...] = ()):
    """Words `[^\\x20\\x09-\\x0D]+` (or of other bytes, by the table `inside`) of lower-cased (A-Z) texts.

    Returns: 64-bit hash of each word, first word index of each text (len + 1), word starts, word ends;
    if asked, a fifth value: for each length in bytes the hashes of the words' prefixes (0: too short).
    A polynomial hash with random byte values gives all words of a piece in a few array passes.
    """
    n = len(data)
    if not n:
        z, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return (h, np.zeros(len(off), np.int64), z, z) + (([h for _ in prefixes],) if prefixes else ())
    low = _LOWER[data]
    isw = inside[low]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = isw[:-1]
    cut = off[:-1]
    before[cut[cut < n]] = False
    starts = np.flatnonzero(isw & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = isw[1:]
    cut = off[1:] - 1
    after[cut[cut >= 0]] = False
    ends = np.flatnonzero(isw & ~after) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[low] * _powers(_BASE, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(_INV, n)[starts]
    h = mix(h + (ends - starts).astype(np.uint64))
    out = h, np.searchsorted(starts, off), starts, ends
    if not prefixes:
        return out
    back, size, cut = _powers(_INV, n)[starts], ends - starts, []
    for k in prefixes:
        p = mix((sums[np.minimum(starts + k, n)] - sums[starts]) * back + np.uint64(k << 32))
        cut.append(np.where(size > k, p, np.uint64(0)))
    return *out, cut


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of a text's k-word shingles, sorted; of the whole sequence if it is shorter."""
    if not len(h):
        return h
    k = min(k, len(h))
    s = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        s = s * np.uint64(0x9DDFEA08EB382D69) + h[j : len(h) - k + 1 + j]
    return np.unique(mix(s + np.uint64(k)))
