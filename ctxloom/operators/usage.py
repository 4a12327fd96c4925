"""Operational analytics: hourly roll-ups, audit, feedback, latency, histograms, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.operators import ranges

#: Upper bounds of the latency histogram, in seconds.
BOUNDS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    return F.round(F.when(b > 0, a / b).otherwise(0.0), digits)


def hourly(df: DataFrame, keys: list[str], aggs: list[Column], ts: str = "ts") -> DataFrame:
    return df.groupBy(*keys, F.date_trunc("hour", ts).alias("hour")).agg(*aggs)


def in_zone(ts: Column, hours: int) -> Column:
    """A UTC time as a viewer's wall clock."""
    return ts + F.make_interval(hours=F.lit(hours))


def dense_days(df: DataFrame, first: str, last: str, day: str = "day", fill: list[str] = ()) -> DataFrame:
    """A row for each day between two dates, zeros where df has none."""
    days = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(day))
    return days.join(df, day, "left").select(day, *[F.coalesce(c, F.lit(0)).alias(c) for c in fill])


def success(status: Column) -> Column:
    return (status >= 200) & (status < 400)


def status_class(status: Column) -> Column:
    return F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))


def keep_days(df: DataFrame, account: str, days: int, ts: str = "ts") -> DataFrame:
    """The last days before each account's latest row: an aggregate and a join, no window over an account's rows."""
    last = df.groupBy(account).agg(F.max(F.to_date(ts)).alias("last"))
    return df.join(last, account).where(F.to_date(ts) > F.date_sub("last", days)).drop("last")


def keep_rows(df: DataFrame, account: str, n: int, order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(account).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


def outcomes(m: DataFrame, minutes: int = 10) -> DataFrame:
    """Each response with what the user did next: reasked within minutes, followed up later, or nothing (resolved)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    after = w.rowsBetween(1, Window.unboundedFollowing)
    nxt = F.min(F.when(F.col("role") == "user", F.col("ts"))).over(after)
    users = F.count(F.when(F.col("role") == "user", 1)).over(after)
    gap = F.timestamp_diff("SECOND", F.col("ts"), F.col("next_ts"))
    m = m.withColumn("next_ts", nxt).withColumn("follow_ups", users).where("role = 'assistant'")
    return m.withColumn("outcome", F.when(F.col("next_ts").isNull(), "resolved").when(gap <= minutes * 60, "reasked").otherwise("followed_up"))


def latency(df: DataFrame, keys: list[str], ms: str = "duration_ms") -> DataFrame:
    """Counts, rates, mean, worst and exact percentiles of each group (of all rows without keys)."""
    d = F.col(ms)
    g = df.groupBy(*keys) if keys else df.groupBy()
    out = g.agg(F.count("*").alias("n"), F.round(F.avg(F.when(success(F.col("status_code")), 1.0).otherwise(0.0)), 6).alias("success_rate"), F.round(F.avg(d), 6).alias("mean"), F.round(F.max(d), 6).alias("worst"), F.count_if(d > 100).alias("slow")).alias("g")
    p = ranges.percentiles(df, keys, ms, [0.5, 0.9, 0.95, 0.99]).alias("p")
    same = [F.col(f"g.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys] or [F.lit(True)]
    return out.join(p, same, "left").select("g.*", *[F.round(F.get("p.p", i), 6).alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99"))])


def histogram(df: DataFrame, seconds: Column, bounds: tuple = BOUNDS) -> DataFrame:
    """Cumulative counts at most each bound, and of all (+Inf)."""
    cols = [F.count_if(seconds <= b).alias(str(b)) for b in bounds] + [F.count(seconds).alias("+Inf")]
    one = df.agg(*cols)
    pairs = F.explode(F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"`{b}`").alias("n")) for b in (*bounds, "+Inf")]))
    return one.select(pairs.alias("x")).select("x.le", "x.n")


def limited_tenants(df: DataFrame, account: str, seq: str, n: int) -> DataFrame:
    """The first n accounts by arrival keep their name; later ones share one, blank ones another."""
    known = df.where(F.coalesce(F.trim(account), F.lit("")) != "").groupBy(account).agg(F.min(seq).alias("first")).orderBy("first", account).limit(n).select(F.col(account).alias("_a"), F.lit(True).alias("_known"))
    blank = F.coalesce(F.trim(account), F.lit("")) == ""
    return df.join(F.broadcast(known), F.col(account) == F.col("_a"), "left").withColumn("tenant", F.when(blank, "__unknown__").when(F.col("_known"), F.col(account)).otherwise("__overflow__")).drop("_a", "_known")


def deltas(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Increments of a counter that only grows; a fall is a restart and counts as 0."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("delta", F.greatest(F.lit(0), F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0))))
