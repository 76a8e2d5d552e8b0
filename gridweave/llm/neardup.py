"""Near-duplicate groups by MinHash with tensored banding.

Three small collections A, B and C of `tables` band values (each of `rows` minhashes) are computed; the keys of
the `tables * tables` hash tables are the pairs (A_i, B_j), each with C_(i+j), so a few dozen minhashes serve a
hundred tables. Two texts of similarity s share no A value, or no B value, with probability
2 (1 - s^rows)^tables; with the defaults they meet with 0.9999 at s = 0.8 and more above.
Candidates are confirmed on the full shingle sets. Python works on Arrow batches only.

Rows are keyed on the A values for the shuffle and expanded to the (A_i, B_j) tables inside each
task. Small tables are compared pair by pair, by a sketch. Members of large tables are linked with the first one, each with the
one most alike by sketch. What is then still outside the group that prevails at an A value is held against all members of that
group, and against all others that are outside it, in blocks of bounded size: a block answers an asker with one link to each
group. So no pair is left out, and nothing of the size of all pairs is ever written.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, may_be_in, mix, pieces, shingles, text_bytes, wide_join, word_hashes
from .components import components

TABLES, BAND_ROWS = 10, 2
#: A sketch has four bits of each of so many minhashes.
SKETCH = 64
#: At similarity 0.8, 52 of the 64 agree on average (each with probability 0.8 + 0.2 / 16); more than 28 differ in one case of a million.
SKETCH_DIFFER = 28
#: A table with at most so many members is compared pair by pair.
SMALL = 16
RUN_ROWS = 1 << 16
#: Rows of one A value that one task compares, and shingles of a group's members that it holds.
PIECE_ROWS, BLOCK_SHINGLES = 1 << 13, 1 << 20
#: Pairs that are compared at a time.
STEP = 1 << 19
_NIBBLES = np.uint64(0x1111111111111111)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7))
    return rng.integers(1, 1 << 63, n, dtype=np.uint64), rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def _minhashes(sets: list[np.ndarray], xor: np.ndarray, mul: np.ndarray) -> np.ndarray:
    """One row a set, none of which is empty."""
    s = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(x) for x in sets])[:-1]))
    out = np.empty((len(sets), len(xor)), np.uint64)
    v, w = np.empty_like(s), np.empty_like(s)
    for j in range(len(xor)):
        np.bitwise_xor(s, xor[j], out=v)
        np.multiply(v, mul[j], out=v)
        np.right_shift(v, np.uint64(32), out=w)
        np.bitwise_xor(v, w, out=v)
        out[:, j] = np.minimum.reduceat(v, starts)
    return out


def _signer(k: int, tables: int, rows: int):
    nb = tables * rows
    xor, mul = _seeds(max(3 * nb, SKETCH))

    def bands(m: np.ndarray) -> np.ndarray:
        m = m.reshape(len(m), tables, rows)
        h = np.tile(np.arange(tables, dtype=np.uint64), (len(m), 1))
        for j in range(rows):
            h = mix(h * np.uint64(0x9DDFEA08EB382D69) + m[:, :, j])
        return h

    def run(batches):
        for batch in batches:
            for p in pieces(batch, "text"):
                h, first, _, _ = word_hashes(*text_bytes(p.column("text")))
                sets = [shingles(h[s:e], k) for s, e in zip(first[:-1], first[1:], strict=True)]
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                fp, a, bc, sk = ([None] * len(sets) for _ in range(4))
                if len(some):
                    m = _minhashes([sets[i] for i in some], xor, mul)
                    av = bands(m[:, :nb])
                    bcv = np.concatenate((bands(m[:, nb : 2 * nb]), bands(m[:, 2 * nb : 3 * nb])), axis=1).astype(np.uint16)
                    part = (m[:, :SKETCH] & np.uint64(15)).reshape(len(m), SKETCH // 16, 16) << (np.uint64(4) * np.arange(16, dtype=np.uint64))
                    skv = np.bitwise_or.reduce(part, axis=2)
                    for r, i in enumerate(some):
                        fp[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                        a[i], bc[i], sk[i] = av[r].tobytes(), bcv[r].tobytes(), skv[r].tobytes()
                yield pa.RecordBatch.from_arrays([p.column("id"), pa.array(n), *(pa.array(c, pa.binary()) for c in (fp, a, bc, sk))], names=["id", "n", "fp", "a", "bc", "sk"])

    return run


def _keyed(tables: int):
    """A row for each A value, with the B values and, turned by i, the C values."""

    def run(batches):
        for p in batches:
            m = p.num_rows
            if not m:
                continue
            a = np.frombuffer(b"".join(p.column("a").to_pylist()), np.int64).reshape(m, tables)
            bc = np.frombuffer(b"".join(p.column("bc").to_pylist()), np.uint16).reshape(m, 2, tables)
            turn = (np.arange(tables)[:, None] + np.arange(tables)[None, :]) % tables
            both = np.concatenate((np.repeat(bc[:, None, 0], tables, axis=1), bc[:, 1][:, turn]), axis=2)
            flat = pa.Array.from_buffers(pa.binary(), m * tables, [None, pa.py_buffer(np.arange(0, 4 * tables * (m * tables) + 1, 4 * tables, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(both).tobytes())])
            every = pa.array(np.repeat(np.arange(m), tables))
            others = [c for c in p.schema.names if c not in ("a", "bc")]
            yield pa.RecordBatch.from_arrays([pa.array(a.ravel()), flat, *(p.column(c).take(every) for c in others)], names=["key", "bc", *others])

    return run


def _tables_of(key: np.ndarray, bc: list[bytes], tables: int) -> np.ndarray:
    """The hash of each row's `tables` tables."""
    both = np.frombuffer(b"".join(bc), np.uint16).reshape(len(bc), 2, tables).astype(np.uint64)
    return mix(key.view(np.uint64)[:, None] * np.uint64(0x9DDFEA08EB382D69) + ((both[:, 0] << np.uint64(24)) | (both[:, 1] << np.uint64(8)) | np.arange(tables, dtype=np.uint64)))


def _differ(s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """How many of the sketches' values differ."""
    x = s1 ^ s2
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return np.bitwise_count(x & _NIBBLES).sum(axis=1, dtype=np.int64)


def _sizes_fit(n1, n2, percent: int):
    return 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)


def _runs(cnt: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (cnt[0] of them), then the same from begin[1] ..."""
    return np.repeat(begin - np.cumsum(cnt) + cnt, cnt) + np.arange(cnt.sum())


def _scanner(tables: int, percent: int):
    """Sorted (key, rep) rows -> pairs of small tables (kind 0), pairs with a first member (2), members of large or cut tables (1)."""

    def tell(kind, x, y=None, differ=None):
        z = np.zeros(len(x), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(z if y is None else y), pa.array(z if differ is None else differ)], names=["kind", "x", "y", "differ"])

    def close(kind, rep, n, sk, x, y):
        ok = (rep[x] != rep[y]) & _sizes_fit(n[x], n[y], percent)
        x, y = x[ok], y[ok]
        d = _differ(sk[x], sk[y])
        ok = d <= SKETCH_DIFFER
        if ok.any():
            xyd = np.unique(np.stack((np.minimum(rep[x], rep[y])[ok], np.maximum(rep[x], rep[y])[ok], d[ok])), axis=1)
            yield tell(kind, *xyd)

    def work(key, rep, n, sk, bc, split):
        """Whole A buckets, or pieces of buckets where `split` says so."""
        sk = np.frombuffer(b"".join(sk), np.uint64).reshape(len(key), SKETCH // 16)
        sub = _tables_of(key, bc, tables).ravel()
        order = np.argsort(sub, kind="stable")
        s = sub[order]
        row = order // tables
        new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        size = np.diff(np.concatenate((new, [len(s)])))
        cut = split[row[new]]
        for d in range(1, SMALL):
            at = np.flatnonzero(~cut & (size > d) & (size <= SMALL))
            if not len(at):
                break
            i = _runs(size[at] - d, new[at])  # member j of a table with member j + d
            yield from close(0, rep, n, sk, row[i], row[i + d])
        at = np.flatnonzero(cut | (size > SMALL))
        if len(at):
            i = _runs(size[at], new[at])
            me = row[i]
            yield from close(2, rep, n, sk, np.repeat(row[new[at]], size[at]), me)
            yield tell(1, np.unique(rep[me]))

    def run(batches):
        have = None
        start = True  # may the first bucket have begun in the partition before?

        def flush(cols, last):
            nonlocal start
            key = cols[0]
            r = len(key)
            new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            end = r if last or len(new) == 1 else new[-1]
            if not last and len(new) == 1 and r < RUN_ROWS:
                return cols, ()
            split = np.zeros(end, bool)
            if start:
                split[key[:end] == key[0]] = True
            whole = len(new) > 1 and not last
            if not whole:  # it may go on in what follows
                split[key[:end] == key[end - 1]] = True
            start = not whole
            out = work(*(c[:end] for c in cols), split)
            return ([c[end:] for c in cols] if end < r else None), out

        for p in batches:
            if not p.num_rows:
                continue
            cols = [p.column(c).to_numpy() for c in ("key", "rep", "n")] + [np.array(p.column(c).to_pylist(), dtype=object) for c in ("sk", "bc")]
            have = cols if have is None else [np.concatenate(c) for c in zip(have, cols, strict=True)]
            have, out = flush(have, False)
            yield from out
        if have is not None:
            have, out = flush(have, True)
            yield from out

    return run


def _by_group(batches, names: tuple[str, ...], end: int):
    """Lists of column slices, one list a group of rows with equal first `end` columns; rows come sorted by them."""
    now, have = None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names[:end]], axis=1)
        cut = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True])))
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            key = tuple(keys[s].tolist())
            if key != now and have:
                yield now, have
                have = []
            now = key
            have.append(b.slice(s, e - s))
    if have:
        yield now, have


def _meeter(tables: int, percent: int):
    """Groups (key, q, p): members outside the A value's main group (role 0) against all (role 1).

    Gives (rep, to, kind): kind 0, rep may be like a member of the main group `to`; kind 1, rep may be like
    another that is outside of it, too. So there are at most two rows a group and member.
    """

    def run(batches):
        for _, have in _by_group(batches, ("key", "q", "p"), 3):
            t = pa.Table.from_batches(have)
            key, rep, label, n, main, role = (t.column(c).to_numpy() for c in ("key", "rep", "label", "n", "main", "role"))
            sk = np.frombuffer(b"".join(t.column("sk").to_pylist()), np.uint64).reshape(len(rep), SKETCH // 16)
            sub = _tables_of(key, t.column("bc").to_pylist(), tables)
            few, all_ = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
            if not len(few) or not len(all_):
                continue
            s = sub[all_].ravel()
            order = np.argsort(s, kind="stable")
            s, who = s[order], all_[order // tables]
            f, mine = np.repeat(few, tables), sub[few].ravel()
            low, high = np.searchsorted(s, mine), np.searchsorted(s, mine, side="right")
            ends = np.cumsum(high - low)
            asks, stray, at = np.zeros(len(rep), bool), np.zeros(len(rep), bool), 0
            while at < len(f):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, side="right")))
                cnt = (high - low)[at:to]
                x, y = np.repeat(f[at:to], cnt), who[_runs(cnt, low[at:to])]
                in_main = label[y] == main[y]
                ok = (label[x] != label[y]) & _sizes_fit(n[x], n[y], percent) & ~np.where(in_main, asks[x], stray[x] & stray[y])
                x, y = x[ok], y[ok]
                ok = _differ(sk[x], sk[y]) <= SKETCH_DIFFER
                x, y = x[ok], y[ok]
                in_main = label[y] == main[y]
                asks[x[in_main]] = True
                stray[x[~in_main]] = stray[y[~in_main]] = True
                at = to
            for kind, is_so in enumerate((asks, stray)):
                r = np.unique(rep[is_so])
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(np.full(len(r), main[0])), pa.array(np.full(len(r), kind, np.int32))], names=["rep", "to", "kind"])

    return run


def _pair_verifier(k: int, percent: int):
    def run(batches):
        for batch in batches:
            for p in pieces(batch, "tx"):
                for q in pieces(p, "ty"):
                    hx, fx, _, _ = word_hashes(*text_bytes(q.column("tx")))
                    hy, fy, _, _ = word_hashes(*text_bytes(q.column("ty")))
                    xs, ys = q.column("x").to_pylist(), q.column("y").to_pylist()
                    a, b, known, sx = [], [], None, None
                    for i in range(q.num_rows):
                        if xs[i] != known:
                            known, sx = xs[i], shingles(hx[fx[i] : fx[i + 1]], k)
                        sy = shingles(hy[fy[i] : fy[i + 1]], k)
                        both = np.concatenate((sx, sy))
                        both.sort(kind="stable")
                        same = int((both[1:] == both[:-1]).sum())
                        if same and 100 * same >= percent * (len(both) - same):
                            a.append(xs[i]), b.append(ys[i])
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _block_verifier(k: int, percent: int):
    """Groups (to, kind, block), members (role 0) before askers (role 1): for each asker and group of members other than its own one member as alike as asked, if there is any."""

    def sets(batch):
        for p in pieces(batch, "text"):
            h, first, _, _ = word_hashes(*text_bytes(p.column("text")))
            for i, (r, g) in enumerate(zip(p.column("rep").to_pylist(), p.column("label").to_pylist(), strict=True)):
                yield r, g, shingles(h[first[i] : first[i + 1]], k)

    def run(batches):
        now, held, index = None, [], None
        for b in batches:
            for key, have in _by_group([b], ("to", "kind", "block", "role"), 4):
                if key[:3] != now:
                    now, held, index = key[:3], [], None
                for part in have:
                    if key[3] == 0:
                        held.extend(sets(part))
                        continue
                    if not held:
                        continue
                    if index is None:
                        n = np.array([len(s) for _, _, s in held])
                        flat = np.concatenate([s for _, _, s in held])
                        order = np.argsort(flat, kind="stable")
                        index = flat[order], np.repeat(np.arange(len(held)), n)[order], n, np.array([g for _, g, _ in held])
                    words, own, n, label = index
                    a, c = [], []
                    for r, g, s in sets(part):
                        low, high = np.searchsorted(words, s), np.searchsorted(words, s, side="right")
                        same = np.bincount(own[_runs(high - low, low)], minlength=len(n))
                        ok = np.flatnonzero((same > 0) & (100 * same >= percent * (n + len(s) - same)) & (label != g))
                        for j in ok[np.unique(label[ok], return_index=True)[1]]:
                            a.append(r), c.append(held[j][0])
                    if a:
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    return run


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (x, y) whose full shingle sets are as similar as asked."""
    p = wide_join(pairs.select("x", "y"), texts.select(F.col("id").alias("y"), F.col("text").alias("ty")), "y")
    p = wide_join(p, texts.select(F.col("id").alias("x"), F.col("text").alias("tx")), "x")
    return p.select("x", "y", "tx", "ty").mapInArrow(_pair_verifier(k, percent), "a long, b long")


def _labelled(reps: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds label: that of the row's group, or its own number."""
    return wide_join(reps, labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def _across(cls: DataFrame, large: DataFrame, labels: DataFrame, texts: DataFrame, tables: int, k: int, percent: int) -> DataFrame:
    """Links between members of large tables that are in different groups, with a witness each: see the module's text."""
    parts = int(cls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine = _labelled(large.join(cls.select("rep", "n", "a", "bc", "sk"), "rep"), labels)
    mine = materialize(mine.select("rep", "label", "n", "sk", "a", "bc"), "large")
    rows = materialize(mine.mapInArrow(_keyed(tables), "key long, bc binary, rep long, label long, n long, sk binary"), "keyed")
    per = rows.groupBy("key", "label").agg(F.count("*").alias("c"))
    per = per.groupBy("key").agg(F.max(F.struct("c", "label")).alias("t"), F.sum("c").alias("m"), F.count("*").alias("groups")).where("groups > 1")
    pieces_of = lambda c: F.ceil(c / PIECE_ROWS).cast("int")
    per = materialize(per.select("key", F.col("t.label").alias("main"), pieces_of(F.col("m")).alias("ps"), pieces_of(F.col("m") - F.col("t.c")).alias("qs")), "keys")
    rows = wide_join(rows, per, "key").withColumn("h", F.xxhash64("rep"))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["key", "q", "p", "rep", "label", "n", "sk", "bc", "main", "role"]
    few = rows.where("label <> main").withColumn("q", F.pmod("h", "qs").cast("int")).withColumn("p", span("ps")).withColumn("role", F.lit(0))
    every = rows.withColumn("p", F.pmod("h", "ps").cast("int")).withColumn("q", span("qs")).withColumn("role", F.lit(1))
    meet = few.select(*cols).unionByName(every.select(*cols)).repartition(parts, "key", "q", "p").sortWithinPartitions("key", "q", "p")
    asked = meet.mapInArrow(_meeter(tables, percent), "rep long, to long, kind int").distinct()
    asked = materialize(wide_join(asked, mine.select("rep", "label", "n"), "rep"), "asked")
    # what is asked, a main group or those outside it, in blocks of so many shingles; who asks goes to every block
    in_main = wide_join(mine.select("rep", "n", F.col("label").alias("to")), asked.where("kind = 0").select("to").distinct(), "to")
    members = materialize(in_main.select("rep", "n", "to", F.col("to").alias("label"), F.lit(0).alias("kind")).unionByName(asked.where("kind = 1").select("rep", "n", "to", "label", "kind")), "members")
    blocks = members.groupBy("to", "kind").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("bs"))
    there = wide_join(members, blocks, ["to", "kind"]).withColumn("block", F.pmod(F.xxhash64("rep"), "bs").cast("int")).withColumn("role", F.lit(0))
    come = wide_join(asked, blocks, ["to", "kind"]).withColumn("block", span("bs")).withColumn("role", F.lit(1))
    cols = ["to", "kind", "block", "role", "rep", "label"]
    both = wide_join(there.select(*cols).unionByName(come.select(*cols)), texts.select(F.col("id").alias("rep"), "text"), "rep")
    both = both.repartition(parts, "to", "kind", "block").sortWithinPartitions("to", "kind", "block", "role")
    out = materialize(both.mapInArrow(_block_verifier(k, percent), "a long, b long"), "links")
    drop_scratch(mine, rows, per, asked, members)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, tables: int = TABLES, band_rows: int = BAND_ROWS) -> DataFrame:
    """One row a document: id, n_shingles, component_id (smallest id that can be reached), kept.

    Texts are lower-cased (A-Z) and cut at white space. Shingles: distinct runs of `shingle_words`
    words, the whole sequence where it is shorter. Null, empty or blank text: no shingles, linked
    with nothing, kept. Texts with equal sets form one class before any comparison. Null ids are
    returned with a null component, kept, and link nothing. Rows that repeat an id with the same
    text share its fate; an id with several texts joins the groups of them all. Other columns are
    ignored. An empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    k = shingle_words
    sig = materialize(d.mapInArrow(_signer(k, tables, band_rows), "id long, n long, fp binary, a binary, bc binary, sk binary"), "sig")
    some = sig.where("n > 0 and id is not null")
    cls = some.groupBy("fp").agg(F.min(F.struct("id", "n", "a", "bc", "sk")).alias("s"))
    cls = materialize(cls.select("fp", F.col("s.id").alias("rep"), "s.n", "s.a", "s.bc", "s.sk"), "classes")
    keyed = cls.select("rep", "n", "sk", "a", "bc").mapInArrow(_keyed(tables), "key long, bc binary, rep long, n long, sk binary").select("key", "rep", "n", "sk", "bc")
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = keyed.repartitionByRange(parts, "key", "rep").sortWithinPartitions("key", "rep")
    found = materialize(found.mapInArrow(_scanner(tables, percent), "kind int, x long, y long, differ long"), "found")
    pairs = materialize(found.where("kind <> 1").groupBy("x", "y").agg(F.min("differ").alias("differ"), F.min("kind").alias("kind")), "pairs")
    large = materialize(found.where("kind = 1").select(F.col("x").alias("rep")).distinct(), "members")
    drop_scratch(found)
    # the texts that any comparison reads; an id stands for several sets only if it is repeated with other texts: then all of them count
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("id")).unionByName(large.select(F.col("rep").alias("id"))).distinct()
    texts = may_be_in(d.where("text is not null"), "id", wanted)
    texts = materialize(wide_join(texts, wanted, "id"), "texts")
    # each text with the one most alike by sketch; then the other pairs of small tables that are still in different groups
    first = materialize(pairs.groupBy("y").agg(F.min(F.struct("differ", "x")).alias("s")).select("s.x", "y"), "first")
    edges = materialize(_verify(first, texts, k, percent), "links")
    repeated = some.groupBy("id").agg(F.min("fp").alias("f1"), F.max("fp").alias("f2")).where("f1 <> f2").select("id")
    own = some.join(repeated, "id", "left_semi").select("fp", F.col("id").alias("b")).join(cls.select("fp", F.col("rep").alias("a")), "fp").select("a", "b")
    labels = components(edges.unionByName(own))
    lab = lambda c, to: labels.select(F.col("node").alias(c), F.col("label").alias(to))
    rest = pairs.where("kind = 0").select("x", "y").join(first, ["x", "y"], "left_anti")
    rest = wide_join(wide_join(rest, lab("x", "lx"), "x", "left"), lab("y", "ly"), "y", "left")
    rest = materialize(rest.where("coalesce(lx, x) <> coalesce(ly, y)").select("x", "y"), "rest")
    whole = lambda more: components(labels.select(F.col("label").alias("a"), F.col("node").alias("b")).unionByName(more))  # noqa: E731  both graphs at once
    if not rest.isEmpty():
        labels = whole(materialize(_verify(rest, texts, k, percent), "links"))
    if not large.isEmpty():
        more = _across(cls, large, labels, texts, tables, k, percent)
        if not more.isEmpty():
            labels = whole(more)
    drop_scratch(pairs, first, rest, texts)
    node = labels.select(F.col("node").alias("rep"), "label")
    groups = materialize(wide_join(cls.select("fp", "rep"), node, "rep", "left").select("fp", F.coalesce("label", "rep").alias("component_id")), "groups")
    drop_scratch(cls)
    out = wide_join(sig.select("id", "n", "fp"), groups, "fp", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )
