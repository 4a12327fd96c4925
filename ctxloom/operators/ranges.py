"""Work in key and time order that spreads a single key over all tasks.

Rows are dealt by ranges of (key, time), so a partition holds one stretch of that order and a hot key fills as many
partitions as it needs. What a stretch must know of the ones before it is one row each: a table of as many rows as there
are partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.sources import scratch


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_value of each row becomes the last one of a right row of its key before it; _hit says whether there was one. Rows come by key and time."""
    key, value = None, None  # of the last right row so far, as arrays of one row
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, values = batch.column("_key"), batch.column("_value")
        right = batch.column("_side").to_numpy(zero_copy_only=False) == 0
        at = np.maximum.accumulate(np.where(right, np.arange(n), -1))
        if key is not None:  # row 0 is what earlier batches left
            keys, values, at = pa.concat_arrays([key, keys]), pa.concat_arrays([value, values]), at + 1
        own = pa.array(np.arange(n) + (key is not None))
        some = pa.array(np.maximum(at, 0))
        same = pc.fill_null(pc.equal(keys.take(some), keys.take(own)), False)
        hit = pc.and_(same, pa.array(at >= 0))
        out = pc.if_else(hit, values.take(some), pa.scalar(None, values.type))
        last = int(at[-1])
        if last >= 0:
            key, value = keys.slice(last, 1), values.slice(last, 1)
        columns = [out if name == "_value" else batch.column(name) for name in batch.schema.names]
        yield pa.RecordBatch.from_arrays([*columns, hit], names=[*batch.schema.names, "_hit"])


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row with the latest right value of its key not after it; of right rows of one time, the greatest value.

    Rows with a null key or time match nothing; a null right value is passed over. One shuffle by ranges of key and time, no pair
    join: rows carry their last right value along within a partition, and the first key of a partition gets what the partitions
    before it ended with.
    """
    cols = left.columns
    a = left.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.xxhash64(*cols).alias("_tie"), F.struct(*cols).alias("_row"))
    b = right.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull())
    b = b.select(F.col(key).cast(left.schema[key].dataType).alias("_key"), F.col(at).cast(left.schema[at].dataType).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"), F.lit(0).cast("long").alias("_tie"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    u = a.unionByName(b)
    order = ["_key", "_at", "_side", "_value", "_tie"]
    dealt = u.repartitionByRange(partitions(u), *order).sortWithinPartitions(*order)
    schema = u.schema.add("_hit", "boolean")
    held = scratch.written(dealt.mapInArrow(_filled, schema).withColumn("_part", F.spark_partition_id()), "as-of")
    # the last right row before each partition: one row a partition
    ends = held.groupBy("_part").agg(F.max(F.when(F.col("_side") == 0, F.struct("_key", "_at", "_value"))).alias("_end"))
    carried = ends.select("_part", F.max("_end").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    out = held.where("_side = 1").join(F.broadcast(carried), "_part", "left")  # as many rows as partitions
    known = F.when(F.col("_at").isNull(), None).when(F.col("_hit"), F.col("_value")).when(F.col("_before._key") == F.col("_key"), F.col("_before._value"))
    return out.select("_row.*", known.alias(value))


def percentiles(df: DataFrame, keys: list[str], value: str, wanted: list[float]) -> DataFrame:
    """(keys, p): the exact interpolated percentiles of each group, from counts of distinct values.

    The counts are dealt by ranges of (keys, value); sums of each range tell which ranges hold the wanted ranks, and only the rows of those
    are ranked. No task holds more of a group than its range. Null values don't count; a group without any has no row.
    """
    spare = [f"_k{i}" for i in range(len(keys))]
    counts = df.select(*[F.col(k).alias(s) for k, s in zip(keys, spare, strict=True)], F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL").groupBy(*spare, "_v").agg(F.count("*").alias("_n"))
    counts = counts.repartitionByRange(partitions(df), *spare, "_v").withColumn("_part", F.spark_partition_id())
    counts = scratch.written(counts, "counts")
    sums = counts.groupBy(*spare, "_part").agg(F.sum("_n").alias("_n"))
    by = Window.partitionBy(*spare)
    sums = sums.withColumn("_from", F.sum("_n").over(by.orderBy("_part")) - F.col("_n")).withColumn("_all", F.sum("_n").over(by))
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_all") - 1)).alias("x")) for i, p in enumerate(wanted)])).alias("w")
    ends = F.explode(F.array(F.floor("w.x"), F.ceil("w.x"))).alias("_rank")
    ranks = sums.select(*spare, "_part", "_n", "_from", place).select(*spare, "_part", "_n", "_from", F.col("w.i").alias("_i"), F.col("w.x").alias("_x"), ends)
    ranks = ranks.where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_n"))).drop("_n").distinct()
    c, r = counts.alias("c"), ranks.alias("r")
    few = ranks.select(*spare, "_part", "_from").distinct().alias("f")
    inside = c.join(few, [F.col(f"c.{s}").eqNullSafe(F.col(f"f.{s}")) for s in [*spare, "_part"]]).select("c.*", "f._from")
    upto = F.sum("_n").over(Window.partitionBy(*spare, "_part").orderBy("_v")) + F.col("_from")
    inside = inside.select(*spare, "_part", "_v", (upto - F.col("_n")).alias("_lo"), upto.alias("_hi")).alias("c")
    found = inside.join(r, [*[F.col(f"c.{s}").eqNullSafe(F.col(f"r.{s}")) for s in [*spare, "_part"]], F.col("_rank") >= F.col("_lo"), F.col("_rank") < F.col("_hi")])
    each = found.groupBy(*[F.col(f"r.{s}").alias(s) for s in spare], "_i", "_x").agg(F.min_by("_v", "_rank").alias("_a"), F.max_by("_v", "_rank").alias("_b"))
    mixed = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_x") - F.floor("_x"))
    out = each.groupBy(*spare).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", mixed.alias("v")))), lambda x: x["v"]).alias("p")).where(F.size("p") > 0)
    return out.select(*[F.col(s).alias(k) for s, k in zip(spare, keys, strict=True)], "p")


def chain(events: DataFrame, key: str, ts: str, seconds: float, order: str) -> DataFrame:
    """The events that count: the first of each key, then each first one at least so long after the last that counts.

    Every event points to the first one of its key that is late enough (a search forward in time, by ranges); doubling these pointers, the
    events that the first one leads to are all marked in log2(longest chain) rounds. A key's events spread over all tasks throughout.
    Events with a null key form a key of their own; those without a time never count.
    """
    name = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n"))
    if seconds <= 0:
        return events.where(F.col(ts).isNotNull())
    rows = events.where(F.col(ts).isNotNull()).select("*", F.monotonically_increasing_id().alias("_id"), name.alias("_name"), (-F.unix_micros(F.col(ts).cast("timestamp"))).alias("_t"))
    rows = scratch.written(rows, "chain-rows")
    place = F.struct(F.col("_t").alias("t"), F.struct(*[F.col(order)]).alias("o"), F.col("_id").alias("id"))
    first = rows.groupBy("_name", "_t").agg(F.min(place).alias("p"))  # of events of one time, the first in order stands for them
    wait = int(seconds * 1_000_000)
    links = as_of(first.select("_name", (F.col("_t") - wait).alias("_t"), F.col("p.id").alias("_id")), first.select("_name", "_t", F.col("p.id").alias("_next")), "_name", "_t", "_next")
    jumps = scratch.written(links.where("_next IS NOT NULL").select("_id", "_next"), "jumps")
    reached = scratch.written(first.groupBy("_name").agg(F.max_by("p", F.struct("_t")).alias("p")).select(F.col("p.id").alias("_id")), "reached")
    while not jumps.isEmpty():
        ahead = reached.join(jumps, "_id").select(F.col("_next").alias("_id"))
        more = scratch.written(reached.unionByName(ahead).distinct(), "reached")
        twice = jumps.alias("a").join(jumps.alias("b"), F.col("a._next") == F.col("b._id")).select("a._id", "b._next")
        twice = scratch.written(twice, "jumps")
        scratch.drop(reached, jumps)
        reached, jumps = more, twice
    return rows.join(reached, "_id", "left_semi").select(*events.columns)
