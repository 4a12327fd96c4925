"""Ordered folds: each step of a key reads what the step before has left.

Rows are dealt by key and sorted within their partition, and stream through one task in Arrow batches: a task holds one
batch and the state of one key, never a key's history. Steps of one key depend on each other and can't be spread; what can be
dropped beforehand (all updates before a plain replacement) never reaches the sort.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ctxloom.functions import patching

#: Rows that are Python objects at once, and letters of text that are handed back at once.
STEP_ROWS, STEP_LETTERS = 256, 4_000_000
_NONE = object()

BLOCKS = "array<struct<search: string, replace: string>>"


def ordered_fold(rows: DataFrame, key: str, order: list[str], step: Callable, finish: Callable, schema: str) -> DataFrame:
    """A row finish(key, state) for each key; state starts as None and becomes step(state, row) for each row (a dict) in order.

    A null key is a key like others. Rows that are equal in all of `order` may come in any order.
    """
    kinds = _parse_datatype_string(schema)
    assert isinstance(kinds, StructType)
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out, letters = _NONE, None, [], 0

        def handed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for lo in range(0, batch.num_rows, STEP_ROWS):
                for row in batch.slice(lo, STEP_ROWS).to_pylist():
                    if row[key] != at:
                        if at is not _NONE:
                            out.append(finish(at, state))
                            letters += sum(len(x) for x in out[-1] if isinstance(x, str))
                        at, state = row[key], None
                        if len(out) >= STEP_ROWS or letters > STEP_LETTERS:
                            yield handed()
                            out, letters = [], 0
                    state = step(state, row)
        if at is not _NONE:
            out.append(finish(at, state))
        if out:
            yield handed()

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, kinds)


def merge_patch(records: DataFrame, updates: DataFrame, key: str, seq: str, text: str = "text", value: str = "value", blocks: str = "blocks") -> DataFrame:
    """(key, text, applied, failed): each record after its updates in order of seq.

    updates: a row has blocks (search and replace pairs, a patch) or, where they are null, a plain value. See patching.merged() for the rules. A key without a
    record starts without a text. Of several records of a key the one with the greatest text counts; updates of one seq go by value, then blocks.
    """
    u = updates.select(F.col(key).alias("_k"), F.col(seq).alias("_s"), F.col(value).cast("string").alias("_v"), F.col(blocks).cast(BLOCKS).alias("_b"))
    plain = F.col("_b").isNull() & (F.coalesce("_v", F.lit("")) != "")
    last = u.where(plain).groupBy(F.col("_k").alias("_lk")).agg(F.max("_s").alias("_ls"))
    live = u.join(last, F.col("_k").eqNullSafe(F.col("_lk")), "left").where(F.col("_ls").isNull() | (F.col("_s") >= F.col("_ls")))
    rows = live.select("_k", F.lit(1).alias("_u"), "_s", F.lit(None).cast("string").alias("_t"), "_v", "_b").unionByName(
        records.select(F.col(key).alias("_k"), F.lit(0).alias("_u"), F.lit(None).cast(u.schema["_s"].dataType).alias("_s"), F.col(text).alias("_t"), F.lit(None).cast("string").alias("_v"), F.lit(None).cast(BLOCKS).alias("_b"))
    )

    def step(state, row):
        current, applied, failed = state or (None, 0, 0)
        if not row["_u"]:
            return row["_t"], 0, 0
        made = None if row["_b"] is None else [(b["search"], b["replace"]) for b in row["_b"] if b is not None]
        current, good, bad = patching.merged(current, row["_v"], made)
        return current, applied + good, failed + bad

    kind = rows.schema["_k"].dataType.simpleString()
    out = ordered_fold(rows, "_k", ["_u", "_s", "_v", "_b", "_t"], step, lambda k, state: (k, *state), f"_k {kind}, text string, applied long, failed long")
    return out.withColumnRenamed("_k", key)
