"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every `w` consecutive k-gram hashes the smallest is kept, so two texts that share
w + k - 1 words share a fingerprint. w + k - 1 is the length of a benchmark window, so no shared
window is missed. Items shorter than a window are looked up apart, by the hash of their whole words,
and change nothing for the others. Every fingerprint found in a document is then extended: the windows that
hold its words, and only these, are compared word by word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hot_join, materialize, may_be_in, wide_join

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Benchmark tables of more rows than this are not broadcast (20 to 120 bytes a row).
BROADCAST_ROWS = 200_000


def words(text):
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def let(value, use):
    """use(value) with the value computed once: an expression named in a lambda is computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _span(n, size: int):
    """0 .. n - size, empty if there is none."""
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.expr("cast(array() as array<int>)"))


def word_grams(w, k: int):
    """The hash of every k consecutive words, in order."""

    def gram(h):
        return F.transform(_span(F.size(h), k), lambda i: F.xxhash64(F.lit(k), *(F.get(h, i + j) for j in range(k))))

    return let(F.transform(w, lambda x: F.xxhash64(x)), gram)


def fingerprints(w, k: int, window: int):
    """The winnowed fingerprints of an array of words (a column), as longs."""

    def low(g):
        return F.transform(_span(F.size(g), window), lambda i: F.least(*(F.get(g, i + j) for j in range(window))))

    g = word_grams(w, k)
    return let(g, low) if window > 1 else g


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, k: int = 5) -> DataFrame:
    """One row a document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is `window` consecutive words of an item, or a shorter item's whole words. n_hit counts
    document words in any occurrence of a window; n_items the distinct items with one; items_sha256
    is the digest of their ids, sorted as strings and joined by commas (of "" if none). Null or
    wordless texts have no words and no windows; an empty benchmark hits nothing; a null item id
    hits words but is not listed. Rows that repeat id or text get equal results. Other columns are
    ignored; an empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("tk", F.md5(F.col("text").cast("binary")))
    items = bench.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("w")).where(F.size("w") > 0).distinct()
    items = materialize(items.withColumn("len", F.least(F.size("w"), F.lit(window))), "items")
    lengths = sorted(r[0] for r in items.select("len").distinct().collect())  # at most `window` values
    k = min(k, window)
    reach = window - k
    short = [n for n in lengths if n < window]

    def marked(w):
        """The fingerprints of long items' windows and the whole hashes of short ones."""
        return F.array_distinct(F.concat(fingerprints(w, k, reach + 1), *(word_grams(w, n) for n in short)))

    wins = items.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("len")), lambda i: F.concat_ws(" ", F.slice(F.col("w"), i + 1, F.col("len"))))).alias("win"))  # items is a table: w is read, not computed
    wins = materialize(wins.groupBy("win").agg(F.collect_set("item").alias("items")), "windows")
    long = items.where(F.size("w") >= window).select(F.explode(fingerprints(F.col("w"), k, reach + 1)).alias("fp"))
    whole = [items.where(F.size("w") == n).select(F.explode(word_grams(F.col("w"), n)).alias("fp")) for n in short]
    marks = materialize(reduce(DataFrame.unionByName, whole, long).distinct(), "marks")
    # the fingerprints of every text, once
    base = d.withColumn("w", words(F.col("text"))).select("id", "tk", F.size("w").cast("long").alias("n_words"), marked(F.col("w")).alias("fps"))
    base = materialize(base, "base")
    cand = materialize(base.select("tk", F.explode("fps").alias("fp")).join(_small(marks), "fp", "left_semi").select("tk").distinct(), "cand")
    rows = base.select("id", "tk", "n_words")
    counts = base.groupBy("tk").count()
    least = max(64, base.count() // 200)
    hot = [r[0] for r in counts.where(F.col("count") >= least).select("tk").collect()]  # at most 200
    # candidates, from each fingerprint outwards; equal texts once
    text = wide_join(may_be_in(d.select("tk", "text"), "tk", cand), cand, "tk").groupBy("tk").agg(F.max("text").alias("text"))
    text = materialize(text.select("tk", words(F.col("text")).alias("w")), "texts")

    def found(n: int):
        """Starts of the windows of n words to compare, one row a text."""
        size, back = (k, reach) if n == window else (n, 0)
        at = text.select("tk", F.size("w").alias("_size"), F.posexplode(word_grams(F.col("w"), size)).alias("pos", "fp"))
        at = at.join(_small(marks), "fp", "left_semi").where(F.col("_size") >= n)
        starts = F.sequence(F.greatest(F.col("pos") - back, F.lit(0)), F.least(F.col("pos"), F.col("_size") - n))
        at = at.where(F.greatest(F.col("pos") - back, F.lit(0)) <= F.least(F.col("pos"), F.col("_size") - n)).select("tk", F.explode(starts).alias("pos"))
        at = at.groupBy("tk").agg(F.collect_set("pos").alias("starts"))
        w = wide_join(text, at, "tk")
        return w.select("tk", F.lit(n).alias("len"), F.explode(F.transform("starts", lambda i: F.struct(i.alias("pos"), F.concat_ws(" ", F.slice("w", i + 1, n)).alias("win")))).alias("s")).select("tk", "s.pos", "len", "s.win")

    if not lengths:
        res = d.select("tk", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("list")).limit(0)
    else:
        hits = reduce(DataFrame.unionByName, map(found, lengths)).join(_small(wins), "win")
        hits = materialize(hits.select("tk", "pos", "len", "items"), "hits")
        by = Window.partitionBy("tk").orderBy("pos", "len")
        seen = F.max(F.col("pos") + F.col("len")).over(by.rowsBetween(Window.unboundedPreceding, -1))
        cover = hits.select("tk", (F.col("pos") + F.col("len") - F.greatest("pos", F.least(F.coalesce(seen, F.lit(0)), F.col("pos") + F.col("len")))).alias("c"))
        cover = cover.groupBy("tk").agg(F.sum("c").cast("long").alias("n_hit"))
        named = hits.select("tk", F.explode("items").alias("item")).groupBy("tk").agg(F.sort_array(F.collect_set("item")).alias("items"))
        res = cover.join(named, "tk", "left").select("tk", "n_hit", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.concat_ws(",", "items").alias("list"))
    out = hot_join(rows, materialize(res, "res"), "tk", "left", hot=hot)
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.sha2(F.coalesce("list", F.lit("")).cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated")
    )


ORACLE = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0),
bwin AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS win FROM (SELECT item_id, n, w, unnest(range(0, len(w) - n + 1)) AS i FROM bi)),
ns AS (SELECT DISTINCT n FROM bi),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win FROM (SELECT doc_id, n, w, unnest(range(0, len(w) - n + 1)) AS i FROM dw, ns WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, b.n, item_id FROM dwin JOIN bwin b USING (win, n)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
 sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""
