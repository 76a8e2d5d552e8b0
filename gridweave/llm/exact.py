"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Blocks of rows send their sorted 48-bit fingerprints to the owners of hash ranges as Rice codes
(Golomb codes with a power of two as divisor); owners answer with bitmaps of the fingerprints that
another block holds too. Only texts so suspected are shuffled and grouped by their bytes: a membership
filter of fixed size passes the suspects' rows where they are read (and by chance a few others).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize, may_be_in, wide_join

BLOCK_ROWS = 1 << 18
OWNER_ROWS = 1 << 20
FP_BITS = 48


def rice_encode(v: np.ndarray) -> bytes:
    """Sorted distinct integers -> divisor bits, count, unary quotients, then binary remainders, of the gaps."""
    gap = np.diff(v, prepend=np.uint64(0)).astype(np.uint64)
    bits = max(0, int(np.log2(max(1.0, float(v[-1]) / len(v)))))
    q = (gap >> np.uint64(bits)).astype(np.int64)
    unary = np.zeros(int(q.sum()) + len(v), np.uint8)
    unary[np.cumsum(q + 1) - 1] = 1
    rest = ((gap[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    head = np.array([bits, len(v)], "<u4").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def rice_decode(blob: bytes) -> np.ndarray:
    bits, n = map(int, np.frombuffer(blob, "<u4", 2))
    tail = -(-n * bits // 8)
    raw = np.frombuffer(blob, np.uint8, offset=8)
    ones = np.flatnonzero(np.unpackbits(raw[: len(raw) - tail]))[:n]
    gap = (np.diff(ones, prepend=-1) - 1).astype(np.uint64) << np.uint64(bits)
    rest = np.unpackbits(raw[len(raw) - tail :])[: n * bits].reshape(n, bits).astype(np.uint64)
    gap += (rest << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gap, dtype=np.uint64)


def _blocks(batches):
    """(id, sha) rows -> one row a block, sorted by fingerprint."""
    part, at, ids, sha, n = TaskContext.get().partitionId(), 0, [], [], 0

    def out():
        i, s = pa.chunked_array(ids).combine_chunks(), b"".join(sha)
        raw = np.frombuffer(s, np.uint8).reshape(-1, 32)
        order = np.argsort(raw[:, :8].copy().view(">u8").ravel(), kind="stable")
        null = np.asarray(i.is_null())[order]
        return pa.RecordBatch.from_arrays(
            [pa.array([part << 24 | at], pa.int64()), pa.array([len(order)], pa.int64()), pa.array([i.fill_null(0).to_numpy(zero_copy_only=False)[order].tobytes()], pa.binary()), pa.array([np.packbits(null).tobytes()], pa.binary()), pa.array([raw[order].tobytes()], pa.binary())],
            names=["block", "n", "ids", "nulls", "sha"],
        )

    for b in batches:
        ids.append(b.column("id"))
        sha.extend(b.column("sha").to_pylist())
        n += b.num_rows
        if n >= BLOCK_ROWS:
            yield out()
            at, ids, sha, n = at + 1, [], [], 0
    if n:
        yield out()


def _prints(sha: bytes) -> np.ndarray:
    return np.frombuffer(sha, np.uint8).reshape(-1, 32)[:, :8].copy().view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - FP_BITS)


def _sender(owner_bits: int):
    shift = np.uint64(FP_BITS - owner_bits)

    def run(batches):
        for b in batches:
            for block, sha in zip(b.column("block").to_pylist(), b.column("sha").to_pylist(), strict=True):
                v = np.unique(_prints(sha))
                own = (v >> shift).astype(np.int64)
                cut = np.flatnonzero(np.diff(own, prepend=-1, append=1 << owner_bits))
                o = own[cut[:-1]]
                blobs = [rice_encode(v[s:e] & ((np.uint64(1) << shift) - np.uint64(1))) for s, e in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(o), pa.array(np.full(len(o), block)), pa.array(blobs, pa.binary())], names=["owner", "block", "msg"])

    return run


def _own(t: pa.Table) -> pa.Table:
    """An owner's messages -> for each, the bitmap of the fingerprints that are in another one too."""
    got = [rice_decode(m) for m in t.column("msg").to_pylist()]
    v = np.concatenate(got)
    _, inverse, count = np.unique(v, return_inverse=True, return_counts=True)
    twice = (count > 1)[inverse]
    at = np.cumsum([0, *map(len, got)])
    maps = [np.packbits(twice[s:e]).tobytes() for s, e in zip(at[:-1], at[1:], strict=True)]
    return pa.table({"owner": t.column("owner"), "block": t.column("block"), "bitmap": pa.array(maps, pa.binary())})


def _suspects(owner_bits: int):
    shift = np.uint64(FP_BITS - owner_bits)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                fp = _prints(r["sha"])
                v, first, count = np.unique(fp, return_index=True, return_counts=True)
                own = (v >> shift).astype(np.int64)
                far = np.zeros(len(v), bool)
                for m in r["maps"] or []:  # v is sorted, and so are its owners
                    s, e = np.searchsorted(own, [m["owner"], m["owner"] + 1])
                    far[s:e] = np.unpackbits(np.frombuffer(m["bitmap"], np.uint8))[: e - s].astype(bool)
                sus = np.repeat((count > 1) | far, count)
                n = r["n"]
                null = np.unpackbits(np.frombuffer(r["nulls"], np.uint8))[:n].astype(bool)
                ids = pa.array(np.frombuffer(r["ids"], np.int64), mask=null)
                sha = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 32 * n + 1, 32, dtype=np.int32).tobytes()), pa.py_buffer(r["sha"])])
                yield pa.RecordBatch.from_arrays([ids, sha, pa.array(sus)], names=["id", "sha", "suspect"])

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the largest id stays
    (a null id only where all are null). Rows that repeat id and text count in group_size and share
    `kept`. Other columns are ignored; an empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    blocks = materialize(d.select("id", "sha").mapInArrow(_blocks, "block long, n long, ids binary, nulls binary, sha binary"), "blocks")
    rows = blocks.agg(F.sum("n")).first()[0] or 0
    owner_bits = max(1, (rows // OWNER_ROWS).bit_length())
    sent = blocks.select("block", "sha").mapInArrow(_sender(owner_bits), "owner long, block long, msg binary")
    told = sent.groupBy("owner").applyInArrow(_own, "owner long, block long, bitmap binary")
    told = told.groupBy("block").agg(F.collect_list(F.struct("owner", "bitmap")).alias("maps"))
    seen = materialize(blocks.join(told, "block", "left").mapInArrow(_suspects(owner_bits), "id long, sha binary, suspect boolean"), "seen")
    # the suspects' texts, by their bytes
    sus = materialize(seen.where("suspect").groupBy("sha").agg(F.count("*").alias("n")).where("n > 1"), "suspects")
    least = max(64, rows // 200)
    hot = [r[0] for r in sus.where(F.col("n") >= least).select("sha").collect()]  # at most 200
    hot = [bytes(x) for x in hot]
    texts = wide_join(may_be_in(d, "sha", sus.select("sha")), sus.select("sha"), "sha")
    groups = texts.groupBy("sha", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.groupBy("sha").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("texts"))
    groups = materialize(groups.select("sha", "keep_id", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts of one SHA-256")).cast("long")).otherwise(F.col("group_size")).alias("group_size")), "groups")
    out = hot_join(seen.select("id", "sha"), groups, "sha", "left", hot=hot)
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
