"""Links inside candidate buckets, and connected components, without all pairs of a bucket.

link() finds, for every bucket of candidates, enough verified pairs that two members are in one
component exactly if verified pairs connect them. Instead of all pairs it compares each member with
the bucket's first one, then with groups of further members that grow eightfold, and leaves out pairs

* that are in one component already, and
* that the triangle inequality rules out: the distances of both to the bucket's first member differ
  by more than the pair's tolerance, and
* where members are sets: whose features that no other member has, and those shared with the bucket's
  first member, rule a near enough pair out.

A pair that shares several buckets is formed in the least of them only. So a bucket of n near copies
costs about n comparisons, and no pair that could join two components is skipped. All joins are on the
bucket with one side filtered, and run as Spark joins that split hot keys.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.llm import _base as B

#: Members of a bucket that are compared with all others at once; grows eightfold from round to round.
GROUP = 16
#: Links and labels are few beside the rows they come from: so many times fewer tasks write them.
SHARE = 16
#: Verified pairs are a few columns, made in Python, where a batch of pairs takes as many steps as its longest text: so many times fewer tasks write them.
FEWER = 8


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id of the edges (a, b): the label is the least id of its component.

    Each round hooks every node to its least neighbour, follows hooks twice and contracts the edges.
    """
    e = B.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", SHARE)
    nodes = e.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id"))
    nodes = B.keep(nodes, "nodes", SHARE)
    while not e.isEmpty():
        hook = e.groupBy("b").agg(F.min("a").alias("a"))
        up = hook.select(F.col("b").alias("a"), F.col("a").alias("top"))
        hook = B.keep(hook.join(up, "a", "left").select("b", F.coalesce("top", "a").alias("top")), "hooks", SHARE)
        of = lambda c, df: df.join(hook.select(F.col("b").alias(c), F.col("top").alias(f"{c}_top")), c, "left").withColumn(c, F.coalesce(f"{c}_top", c)).drop(f"{c}_top")  # noqa: B023, E731
        old = (e, nodes, hook)
        e = of("b", of("a", e)).where("a <> b")
        e = B.keep(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", SHARE)
        nodes = B.keep(of("label", nodes), "nodes", SHARE)
        for x in old:
            B.forget(x)
    B.forget(e)
    return nodes


def _joined(labels: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The labels once further edges (a, b) are added, and a table to forget with the old ones.

    Only labels meet in it, so that edges which are known already are not gone through again.
    """
    lab = lambda c, df: df.join(labels.select(F.col("id").alias(c), F.col("label").alias("to")), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    merged = components(lab("b", lab("a", more)))
    ids = labels.unionByName(more.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(labels.select("id"), "id", "left_anti").select("id", F.col("id").alias("label")))
    to = merged.select(F.col("id").alias("label"), F.col("label").alias("to"))
    return B.keep(ids.join(to, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels", SHARE), merged


def _followed(up: DataFrame) -> DataFrame:
    """up (id, label), a row an id, with the label's label in its place, and that one's: most of a component then has one label, in one job."""
    to = up.select(F.col("id").alias("label"), F.col("label").alias("to"))
    for _ in range(2):
        up = up.join(to, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    return up


def _labelled(ends: DataFrame, labels: DataFrame) -> DataFrame:
    """ends (id, lead) with the label of id (own) and whether the two are in different components (apart)."""
    own = labels.select("id", F.col("label").alias("own"))
    head = labels.select(F.col("id").alias("lead"), F.col("label").alias("head"))
    return ends.join(own, "id", "left").join(head, "lead", "left").select("id", "lead", F.coalesce("own", "id").alias("own"), (F.coalesce("own", "id") != F.coalesce("head", "lead")).alias("apart"))


def _busy(x: DataFrame, state: DataFrame) -> DataFrame:
    """Members of buckets that are not all in their first member's component, each with its label and whether it is apart.

    state: _labelled() of the distinct (id, lead) of x. Whole buckets go before any of their members is looked up.
    """
    open_ = x.join(state.where("apart").select("id", "lead"), ["id", "lead"], "left_semi").select("bucket").distinct()
    return x.join(open_, "bucket", "left_semi").join(state, ["id", "lead"])


def link(members: DataFrame, verify: Callable[[DataFrame], DataFrame], group: int = GROUP, features: Callable[[DataFrame], DataFrame] | None = None, near: Callable[[], Column] | None = None) -> DataFrame:
    """(id, label) of each linked id of members (bucket, id, ord, tol): ids with one label are connected by verified pairs.

    ord orders a bucket's members, and is one for all rows of an id; tol is the largest distance at which the id may link. verify takes
    distinct pairs (a, b), in either order, and returns (a, b, dist, ok); dist is null where it is not known exactly. features, if the distance is one of sets (1 - shared
    / all), takes ids and returns (feature, n, id): features with how many of the ids have them, in any number of
    partial counts, and one of those ids; members then have a column size, the number of their features. near is a
    condition that candidate pairs must meet, over tol and further columns of members, with p_ and q_ before their names.
    members may have a column times: how many buckets with the same ids a row's bucket stands for.
    Intermediate tables are deleted; the caller deletes the result.
    """
    more_columns = [c for c in members.columns if c not in ("bucket", "id", "ord", "tol", "size", "times")]
    made = []

    def keep(df: DataFrame, name: str, share: int = 1) -> DataFrame:
        made.append(B.keep(df, name, share))
        return made[-1]

    if features is None:
        members = members.withColumn("size", F.lit(1))
    first = members.groupBy("bucket").agg(F.min(F.struct("ord", "id")).alias("first"), F.count("*").alias("n")).where("n > 1").select("bucket", F.col("first.id").alias("lead"), "n")
    m = keep(members.join(first, "bucket"), "members")
    # each member is compared with the first one that it shares most buckets with, then with those it is still apart from
    star = m.where("id <> lead")
    if near is not None:
        heads = m.where("id = lead").select("bucket", *(F.col(c).alias(f"q_{c}") for c in ("tol", *more_columns)))
        star = star.withColumnsRenamed({c: f"p_{c}" for c in ("tol", *more_columns)}).join(heads, "bucket").where(near())
    # a row an id; its first ones are as many as its buckets at most
    times = F.col("times") if "times" in members.columns else F.lit(1)
    stars = star.select("id", "lead", times.alias("times")).repartition("id").groupBy("id", "lead").agg(F.sum("times").alias("shared"))
    stars = keep(stars.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("shared", "lead"))).alias("leads")), "stars", SHARE)
    # pairs are (id, lead): a first one comes before all others of its bucket, so no pair is met the other way round
    tested = [keep(verify(stars.select(F.col("id").alias("a"), F.element_at("leads", -1)["lead"].alias("b"))), "verified", FEWER)]
    near_by = keep(_followed(tested[0].where("ok").select(F.col("a").alias("id"), F.col("b").alias("label"))), "labels", SHARE)
    left = stars.select("id", F.explode(F.slice("leads", 1, F.size("leads") - 1)).alias("x")).select("id", "x.lead")
    left = _labelled(left, near_by).where("apart").select(F.col("id").alias("a"), F.col("lead").alias("b"))
    tested.append(keep(verify(left), "verified", FEWER))
    v = tested[0].unionByName(tested[1]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dist", "ok")
    labels = components(v.where("ok").select("a", "b"))
    tested = [v]
    # what is left: buckets of three and more, with each member's distance to the first one if it was measured
    v = v.select("a", "b", "dist")
    ends = keep(m.where("n > 2 and id <> lead").select("id", "lead").distinct(), "ends", SHARE)
    x = _busy(m.where("n > 2 and id <> lead"), keep(_labelled(ends, labels), "state", SHARE))
    x = x.withColumn("a", F.least("lead", "id")).withColumn("b", F.greatest("lead", "id")).join(v, ["a", "b"], "left").drop("a", "b")
    share = (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) + 1) / float(1 << 20)
    level = F.greatest(F.lit(0), F.floor(F.log(8.0, F.greatest(share * F.col("n") / group, F.lit(1.0)))).cast("int"))
    x = keep(x.withColumn("level", level), "rest")
    if features is None:
        x = x.withColumn("own_features", F.lit(0)).withColumn("inside", F.lit(0)).withColumn("common", F.lit(0))
    else:
        ids = keep(x.select("id").unionByName(x.select(F.col("lead").alias("id"))).distinct(), "busy", SHARE)
        alone = features(ids).groupBy("feature").agg(F.sum("n").alias("n"), F.min("id").alias("id")).where("n = 1").groupBy("id").agg(F.count("*").alias("own_features"))
        alone = keep(alone, "alone", SHARE)
        # one whose own features alone put every other one too far away has no pair left
        x = x.join(alone, "id", "left").withColumn("own_features", F.coalesce("own_features", F.lit(0))).where(F.col("own_features") <= F.col("tol") * F.col("size") + 1e-9)
        x = x.join(m.where("id = lead").select("bucket", F.col("size").alias("lead_size")), "bucket")
        # features shared with the first member follow from the distance; what is neither there nor its own may be common
        inside = F.round((1 - F.col("dist")) * (F.col("size") + F.col("lead_size")) / (2 - F.col("dist")))
        x = x.withColumn("inside", F.coalesce(inside, F.least("size", "lead_size")))
        # where the distance was not measured, any feature may be of either kind
        rest = F.col("size") - F.col("own_features") - F.coalesce(inside, F.lit(0))
        x = x.withColumn("common", F.greatest(F.lit(0), rest)).drop("lead_size")
        x = keep(x.join(x.where("apart").select("bucket").distinct(), "bucket", "left_semi"), "rest")
    # a pair meets in the least of its buckets only; what rules it out there does so everywhere
    mine = x.groupBy("id").agg(F.collect_list("bucket").alias("buckets"))
    x = keep(x.join(mine, "id"), "rest")
    cur, fresh = x, True
    top = x.agg(F.max("level")).first()[0]
    for r in range(0 if top is None else top + 1):
        if not fresh:
            cur, fresh = keep(_busy(x.drop("own", "apart").where(F.col("level") >= r), keep(_labelled(ends, labels), "state", SHARE)), "round"), True
        p, q = (cur.select("bucket", *(F.col(c).alias(f"{s}_{c}") for c in ("id", "tol", "dist", "level", "size", "own_features", "inside", "common", "own", "apart", "buckets", *more_columns))) for s in "pq")
        lead = p.where(F.col("p_level") == r)
        q = q.where(F.col("q_level") >= r)
        after = (F.col("q_level") > r) | (F.col("q_id") > F.col("p_id"))
        # a pair shares at most what both share with the first member, and what is common outside it
        shared = F.least(F.col("p_size") - F.col("p_own_features"), F.col("q_size") - F.col("q_own_features"), F.least("p_inside", "q_inside") + F.least("p_common", "q_common"))
        room = F.lit(True) if features is None else 1 - shared / (F.col("p_size") + F.col("q_size") - shared) <= F.greatest("p_tol", "q_tol") + 1e-9
        may = (F.col("p_own") != F.col("q_own")) & after & room & ~F.coalesce(F.abs(F.col("p_dist") - F.col("q_dist")) > F.greatest("p_tol", "q_tol"), F.lit(False))
        if near is not None:
            may = may & near()
        may = may & (F.array_min(F.array_intersect("p_buckets", "q_buckets")) == F.col("bucket"))
        # one side is always apart from the bucket's first component, so that its members never meet each other here
        some = lead.join(q.where("q_apart"), "bucket").where(may).select("p_id", "q_id")
        some = some.unionByName(lead.where("p_apart").join(q.where("not q_apart"), "bucket").where(may).select("p_id", "q_id"))
        pairs = some.select(F.least("p_id", "q_id").alias("a"), F.greatest("p_id", "q_id").alias("b")).distinct()
        known = reduce(DataFrame.unionByName, (t.select("a", "b") for t in tested))
        pairs = keep(pairs.join(known, ["a", "b"], "left_anti"), "pairs", SHARE)
        if pairs.isEmpty():
            continue
        tested.append(keep(verify(pairs), "verified", FEWER))
        more = tested[-1].where("ok").select("a", "b")
        if more.isEmpty():
            continue
        fresh = False
        made.append(labels)
        labels, merged = _joined(labels, more)
        made.append(merged)
    for x in made:
        B.forget(x)
    return labels
