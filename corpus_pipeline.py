"""A training-data pipeline over `documents`: each stage is written as Parquet and read again as the next one's input.

The stages, in order: the line-level quality classifier drops bad documents; repeated lines go; one
document of each group of near duplicates stays; documents with a benchmark item go; the rest is cut
into sequences and placed in length buckets and batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ctxloom.llm import _base, decontam, lines, minhash, packing, quality

STAGES = [
    ("quality classifier", quality.stage),
    ("line dedup", lines.stage),
    ("near dedup", minhash.stage),
    ("decontamination", decontam.stage),
    ("packing", packing.stage),
]

#: A conditional random field, SimHash and aligned sketches have no SQL; tests hold each stage against a brute force of its own and run() against the stages in turn.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences. A stage's table is deleted once the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = _base.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            _base.forget(before)
        before = docs
    return docs
