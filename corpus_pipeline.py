"""A corpus pipeline: toxicity filter, line dedup, near-dedup, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridweave.llm.common import drop_written, materialize, scratch_now, table
from gridweave.llm.decontam import contaminated
from gridweave.llm.lines import without_repeated_runs
from gridweave.llm.neardup import near_duplicates
from gridweave.llm.packing import pack
from gridweave.llm.queries import ship, tokenizer_file
from gridweave.llm.toxicity import without_toxic


_left: list = []


def _stage(f):
    """A stage's result is written and read again before the next one begins: then what the one before wrote on its way can go."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_written(_left, docs)
        before = scratch_now()
        out = f(spark, docs, sf_dir)
        _left[:] = [x for x in scratch_now() if x not in before]
        return out

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the machine learns from the labelled rows of its input."""
    ship(spark)
    return without_toxic(docs, table(spark, sf_dir, "labels"))


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of lines and the long lines that stand earlier in the corpus; emptied documents go."""
    return without_repeated_runs(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies (five words, 0.8)."""
    ship(spark)
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    hit = contaminated(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token sequences."""
    ship(spark)
    return pack(docs, tokenizer_file())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]
#: SQL can neither learn the toxicity machine nor run the tokenizer: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
