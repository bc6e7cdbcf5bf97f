"""A corpus pipeline: rules, exact copies, near copies, personal data, packing.

Every stage works on all rows that the one before it kept, whole texts, and
returns the columns of its input, whatever further ones there are; the last
returns pieces in sequences. Stages take similarity, thresholds and bounds from
their operators' defaults (near copies: five words, 0.8).

A stage's result reads tables that the stage staged. They are deleted when the next
stage begins, whose rows are the result written and read again, unless those rows
still come from the tables themselves.

Defined cases: null and empty texts fail the rules and go, as they have fewer
words than the rules ask for; of equal texts the row with the largest doc_id
stays, of near copies the one with the least; repeated rows are equal texts; a
null host is a host of its own; texts of any length are read whole; an empty
table gives an empty table of pieces; columns named like those that an operator
makes are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from aerolith.llm import exact_dedup, near_dedup, packing, pii, rules
from aerolith.plans.staging import drop_staged, recorded, shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Staged tables of the stages before, by their names in the shared folder.
_held: dict[str, DataFrame] = {}


def _tidied(stage: Stage) -> Stage:
    """The stage, which first deletes what the one before it staged."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = {f.rpartition("/")[0].rpartition("/")[2] for f in docs.inputFiles()} if _held else set()
        for name in [n for n in _held if n not in read]:
            table = _held.pop(name)
            if table.sparkSession is spark:  # those of a session that is gone are forgotten
                drop_staged(table)
        with recorded() as made:
            out = stage(spark, docs, sf_dir)
        _held.update({t.staged_path.rpartition("/")[2]: t for t in made})
        return out

    return run


@_tidied
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the rules themselves nor stand on a rejected host."""
    return rules.keep_rows(docs)


@_tidied
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.dedup_rows(docs)


@_tidied
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.keep_rows(docs)


@_tidied
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return pii.mask_rows(docs)


@_tidied
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules), ("exact copies", exact_copies), ("near copies", near_copies), ("personal data", personal_data), ("packing", sequences),
]

#: The random field of the fourth stage and the third stage's forest have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage is written to the shared folder and read again."""
    import uuid

    at = f"{shared_dir(spark)}/aerolith/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
