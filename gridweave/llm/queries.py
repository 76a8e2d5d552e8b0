"""The queries of the training-data operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import functions as F

from .chat import ORACLE as CHAT_SQL
from .chat import digests, format_chats, turn_rows
from .common import table
from .decontam import ORACLE as DECONTAM_SQL
from .decontam import contaminated
from .exact import exact_duplicates
from .webtext import extract_text
from .lines import ORACLE as LINES_SQL
from .lines import line_dedup
from .lm import lm_scores
from .neardup import near_duplicates
from .packing import pack
from .toxicity import toxicity
from .urls import FETCHED, VALUES, url_filter
from .urls import ORACLE as URLS_SQL


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ship(spark) -> None:
    """Let Python workers on this machine find the package; a cluster is given it by --py-files."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def op1_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op5_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op2_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents"))


def op4_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(FETCHED).alias("fetched_at"))
    return url_filter(pages, spark.sql(f"SELECT * FROM VALUES {VALUES} AS e(list, key, action, at)"))


def op8_chat_format(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{own}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return digests(format_chats(turn_rows(c.unionByName(more), "conv_id", "turn", "role", "text")))


def op9_lm_scores(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ALL = [op1_minhash, op2_html_text, op3_line_dedup, op4_url_filters, op5_exact_dedup, op6_decontaminate, op7_packing, op8_chat_format, op9_lm_scores, op10_toxicity]


def _shipped(f):
    def run(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {f.__name__: _shipped(f) for f in _ALL}

ORACLES = {
    "op1_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op3_line_dedup": LINES_SQL,
    "op4_url_filters": URLS_SQL,
    "op6_decontaminate": DECONTAM_SQL,
    "op8_chat_format": CHAT_SQL,
}
