"""Line dedup over content-defined chunks, in DataFrame functions only.

A rolling hash over the hashes of the last lines decides after which line a chunk ends, so a run of
lines is cut the same way wherever it stands. Chunks of several lines that occur more than once in
the corpus stay at their first occurrence and go elsewhere, after their bytes were compared.

The cut of chunks depends on the lines before a passage, so `without_repeated_runs` does without it: every
two neighbouring lines and every long line are compared with those of the corpus. A run of lines is
repeated exactly where all its neighbouring pairs are, so repeated runs are found to their full length
whatever stands around them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize, may_be_in, wide_join
from .decontam import let

#: Lines in the rolling hash, and the mean number of lines of a chunk.
WINDOW, MEAN = 2, 2
#: A line of more words than this is a repeated passage by itself.
LONG_WORDS = 50
_BASE, _MOD = 1_000_003, 2_147_483_647


def _cuts(lines, window: int, mean: int):
    """The numbers of the lines that end a chunk."""
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long"))

    def ends(h):
        def roll(i):
            total = F.lit(0).cast("long")
            for j in range(window):
                total = total * _BASE % _MOD + F.coalesce(F.get(h, i - (window - 1 - j)), F.lit(0))
            return total % _MOD

        return F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (roll(i) % mean == 0) | (i == F.size(h) - 1))

    return let(hashes, ends)


def _chunks(text, window: int, mean: int):
    """array<struct<chunk string, n int>> of a text that is not null."""

    def cut(lines):
        def make(ends):
            first = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1) + 1)
            return F.transform(ends, lambda e, k: F.struct(F.array_join(F.slice(lines, first(k) + 1, e - first(k) + 1), "\n").alias("chunk"), (e - first(k) + 1).alias("n")))

        return let(_cuts(lines, window, mean), make)

    return let(F.split(text, "\n", -1), cut)


def _pairs(text, long_words: int):
    """array<struct<chunk string, n int, no int>>: every two neighbouring lines that are not both blank, and every long line."""
    word = F.lit(r"[^\x20\x09-\x0D]+")
    is_long = lambda x: F.when(F.length(x) > 2 * long_words, F.size(F.regexp_extract_all(x, word, 0)) > long_words).otherwise(False)

    def cut(lines):
        piece = lambda chunk, n, i: F.struct(chunk.alias("chunk"), F.lit(n).alias("n"), i.cast("int").alias("no"))
        two = F.transform(lines, lambda x, i: piece(F.concat_ws("\n", x, F.get(lines, i + 1)), 2, i))
        two = F.filter(F.slice(two, F.lit(1), F.size(lines) - 1), lambda c: c["chunk"].rlike(r"[^\x20\x09-\x0D]"))
        one = F.filter(F.transform(lines, lambda x, i: piece(x, 1, i)), lambda c: is_long(c["chunk"]))
        return F.concat(two, one)

    return let(F.split(text, "\n", -1), cut)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, mean: int = MEAN) -> DataFrame:
    """One row a document: id, n_lines, n_removed, text (what is left, lines joined by a newline).

    A document's lines are its text cut at newlines. Of equal chunks of two lines or more the one at the
    smallest id and position stays and the others' lines are removed; null ids come first. Rows that
    repeat id and text share their fate. Null text: n_lines 0, text null; empty text: one empty line.
    Columns other than the two named are ignored; an empty table gives an empty result. Chunks are
    counted by SHA-256 and 8-byte keys, common ones are summed before the shuffle, and only repeated
    ones are compared byte by byte (two texts of one digest would stop the job).
    """
    out = _deduped(docs, id_col, text_col, window, mean)
    return out.select(F.col("id").alias(id_col), "n_lines", "n_removed", F.col("text").alias(text_col))


def without_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", window: int = WINDOW, mean: int = MEAN) -> DataFrame:
    """The documents with all their columns and what is left of their texts (`length_col`, if there, is set anew).

    Documents of which the removal leaves nothing but white space are dropped; others, null and empty ones
    included, stay.
    """
    return _remaining(docs, _deduped(docs, id_col, text_col, window, mean), text_col, length_col)


def without_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", long_words: int = LONG_WORDS) -> DataFrame:
    """As `without_repeated_chunks`, with every run of two lines or more, and every line of more than `long_words` words, that stands earlier in the corpus removed.

    Earlier means at a smaller id or, in the same document, a smaller line number. The first occurrence of each line
    in the corpus always stays. Runs of blank lines only are not passages.
    """
    return _remaining(docs, _deduped(docs, id_col, text_col, long_words=long_words), text_col, length_col)


def _remaining(docs: DataFrame, out: DataFrame, text_col: str, length_col: str) -> DataFrame:
    out = out.where(~((F.col("n_removed") > 0) & F.col("text").rlike(r"^\s*$")))
    value = {text_col: F.col("text"), length_col: F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[length_col].dataType)).otherwise(F.col(f"row.{length_col}")) if length_col in docs.columns else None}
    return out.select(*(value[c].alias(c) if c in value else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def _deduped(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, mean: int = MEAN, long_words: int | None = None) -> DataFrame:
    """(id, text, n_lines, n_removed, row: the other columns); by pairs of lines and long lines if `long_words` is given, else by chunks."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(*others).alias("row"))
    d = d.withColumn("rid", F.xxhash64("id", "text"))
    some = d.where("text is not null")
    if long_words is None:
        cut = some.select("id", "rid", F.posexplode(_chunks(F.col("text"), window, mean)).alias("no", "c")).where("c.n > 1")
    else:
        cut = some.select("id", "rid", F.explode(_pairs(F.col("text"), long_words)).alias("c")).select("id", "rid", F.col("c.no").alias("no"), "c")
    occ = materialize(cut.select("id", "rid", "no", F.col("c.n").alias("n"), F.unhex(F.sha2(F.col("c.chunk").cast("binary"), 256)).alias("sha")), "chunks")
    rep = occ.groupBy("sha").agg(F.count("*").alias("times"), F.min(F.struct("id", "rid", "no")).alias("first")).where("times > 1")
    rep = materialize(rep, "repeated")
    total = occ.count()
    hot = [bytes(r[0]) for r in rep.where(F.col("times") >= max(64, total // 200)).select("sha").collect()]  # at most 200
    texts = cut.select(F.unhex(F.sha2(F.col("c.chunk").cast("binary"), 256)).alias("sha"), F.col("c.chunk").alias("chunk"))
    same = wide_join(may_be_in(texts, "sha", rep.select("sha")), rep.select("sha"), "sha").groupBy("sha", "chunk").agg(F.count("*").alias("times"))
    same = same.groupBy("sha").agg(F.count("*").alias("k")).select("sha", F.when(F.col("k") > 1, F.raise_error(F.lit("two chunks of one SHA-256")).cast("long")).otherwise(F.col("k")).alias("k"))
    rep = materialize(rep.join(same, "sha").where("k = 1").select("sha", "first"), "compared")
    gone = hot_join(occ, rep, "sha", hot=hot).where("not (first <=> struct(id, rid, no))")
    if long_words is not None:  # one row a line
        gone = gone.select("id", "rid", F.explode(F.sequence("no", F.col("no") + F.col("n") - 1)).alias("no"), F.lit(1).alias("n"))
        gone = gone.distinct()
    gone = gone.groupBy("rid").agg(F.collect_set("no").alias("gone"), F.sum("n").alias("lines"), F.count_distinct("no").alias("k"), F.count("*").alias("rows"))
    gone = materialize(gone.select("rid", "gone", (F.col("lines") * F.col("k") / F.col("rows")).cast("long").alias("n_removed")), "gone")
    out = hot_join(d, gone, "rid", "left")
    stand = lambda c: F.array_except(F.sequence(F.lit(0), F.size(c) - 1), F.col("gone"))
    if long_words is None:
        left = let(_chunks(F.col("text"), window, mean), lambda c: F.array_join(F.transform(stand(c), lambda i: F.get(c, i)["chunk"]), "\n"))
    else:
        left = let(F.split("text", "\n", -1), lambda x: F.array_join(F.transform(stand(x), lambda i: F.get(x, i)), "\n"))
    zero = F.lit(0).cast("long")
    return out.select(
        "id",
        "row",
        F.when(F.col("text").isNull(), zero).otherwise(F.length(F.col("text")) - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"),
    )


def _roll_sql(window: int) -> str:
    total = "0::BIGINT"
    for j in range(window):
        total = f"(({total}) * {_BASE} % {_MOD} + coalesce(h[i - {window - 1 - j} + 1], 0))"
    return f"{total} % {_MOD}"


ORACLE = rf"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, x, list_transform(x, lambda y: ('0x' || substr(md5(y), 1, 8))::BIGINT) AS h FROM l),
i AS (SELECT doc_id, x, h, unnest(range(0, len(x))) AS i FROM h),
e AS (SELECT doc_id, x, i FROM (SELECT doc_id, x, i, len(x) AS n, {_roll_sql(WINDOW).replace("h[i - 1 + 1]", "CASE WHEN i > 0 THEN h[i] END")} AS r FROM i) WHERE r % {MEAN} = 0 OR i = n - 1),
c AS (SELECT doc_id, no, i, i - s + 1 AS n, array_to_string(x[s + 1 : i + 1], chr(10)) AS chunk FROM
 (SELECT doc_id, x, i, row_number() OVER w - 1 AS no, coalesce(lag(i) OVER w + 1, 0) AS s FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i))),
k AS (SELECT *, n > 1 AND row_number() OVER (PARTITION BY chunk, n > 1 ORDER BY doc_id, no) > 1 AS gone FROM c)
SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed,
 CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(chunk, chr(10) ORDER BY no) FILTER (NOT gone), '') END AS text
FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id, d.text"""
