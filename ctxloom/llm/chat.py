"""Chat formatting in budgeted windows, with DataFrame operations only.

A conversation's rows are ordered by turn (ties by role, then text; null turns first). Prefix sums of
turn tokens choose where windows start: a turn joins the open window while the window fits the
budget, else it opens the next one, which repeats the system turn and a limited history before it.
A turn is never cut: one that exceeds the budget has a window of its own (with the system turn).

A turn is written as  <turn:ROLE:new>TEXT</turn>\\n , a repeated one with old in place of new.
In texts & and < become &amp; and &lt; (in roles also > and :), so no text can hold a mark, and
replacing them back in reverse order restores it. The loss mask of a window lists (start, length)
in code points of each new assistant text; repeated targets are masked out.

Null roles and texts are empty; rows of a null conv_id form one conversation; repeated rows are
turns of their own; an empty table gives no windows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.llm import _base as B

BUDGET = 400
HISTORY_TURNS = 2
HISTORY_TOKENS = 120
#: Tokens counted for a turn's marks.
MARK_TOKENS = 4
END = "</turn>\n"
#: Window starts of one page of the plan.
PAGE = 256


def _escaped(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(F.replace(c, F.lit(">"), F.lit("&gt;")), F.lit(":"), F.lit("&#58;")) if role else c


def _restored(c: Column, role: bool = False) -> Column:
    if role:
        c = F.replace(F.replace(c, F.lit("&#58;"), F.lit(":")), F.lit("&gt;"), F.lit(">"))
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_windows(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """(conv_id, window, n_tokens, formatted, loss): a row per window; loss is array<struct<start, length>>."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tok", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) + F.lit(MARK_TOKENS))
    t = t.withColumn("pos", F.row_number().over(order) - 1).withColumn("upto", F.sum("tok").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("upto", F.coalesce("upto", F.lit(0)))
    t = t.withColumn("sys", F.when((F.col("pos") == 0) & (F.col("role") == "system"), F.col("tok")).otherwise(0))
    head = F.max("sys").over(order)  # tokens of the system turn
    t = t.withColumn("head", head)
    # what a window that starts here would repeat: the longest allowed run of turns before it
    n_old, old_tok = F.lit(0), F.lit(0).cast("long")
    for n in range(1, history_turns + 1):
        run = F.col("upto") - F.lag("upto", n).over(order)
        fits = (run <= history_tokens) & (F.col("pos") - n >= F.when(F.col("head") > 0, 1).otherwise(0))
        n_old, old_tok = F.when(fits, F.lit(n)).otherwise(n_old), F.when(fits, run).otherwise(old_tok)
    t = t.withColumn("n_old", n_old).withColumn("old_tok", old_tok)

    # only numbers are gathered here; the texts follow window by window. Starts are held in pages, so that
    # one more start copies a page and the list of pages, not all starts
    plan = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tok", "head", "n_old", "old_tok"))).alias("turns"))
    page = "array<struct<pos:int,n_old:int>>"
    first = F.struct(F.array().cast(f"array<{page}>").alias("pages"), F.array().cast(page).alias("starts"), F.lit(-1).cast("long").alias("used"))

    def step(acc, x):
        keeps = x["head"] + x["old_tok"] + x["tok"] <= budget
        start = F.array(F.struct(x["pos"].cast("int").alias("pos"), F.when(keeps & (acc.used >= 0), x["n_old"]).otherwise(0).cast("int").alias("n_old")))
        full = F.size(acc.starts) >= PAGE
        used = F.when(acc.used < 0, x["tok"]).otherwise(x["head"] + F.when(keeps, x["old_tok"]).otherwise(0) + x["tok"]).cast("long")
        opened = F.struct(F.when(full, F.concat(acc.pages, F.array(acc.starts))).otherwise(acc.pages).alias("pages"), F.when(full, start).otherwise(F.concat(acc.starts, start)).alias("starts"), used.alias("used"))
        return F.when((acc.used >= 0) & (acc.used + x["tok"] <= budget), F.struct(acc.pages.alias("pages"), acc.starts.alias("starts"), (acc.used + x["tok"]).alias("used"))).otherwise(opened)

    cuts = F.aggregate("turns", first, step, lambda acc: F.concat(F.flatten(acc.pages), acc.starts))
    starts = plan.select("conv_id", F.posexplode(cuts).alias("window", "s")).select("conv_id", "window", F.col("s.pos").alias("pos"), F.col("s.n_old").alias("n_old"))
    # a turn's own window is the number of starts up to it; repeated turns are looked up by their place
    at = lambda df, *more: df.select(F.col("conv_id").alias("id"), F.col("pos").alias("place"), *more)
    same = F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("pos") == F.col("place"))
    own = t.join(at(starts, F.lit(1).alias("opens")), same, "left")
    own = own.withColumn("window", F.count("opens").over(Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("int") - 1)
    back = starts.where("n_old > 0").select("conv_id", "window", F.explode(F.sequence(F.col("pos") - F.col("n_old"), F.col("pos") - 1)).alias("pos"))
    old = t.join(at(back, "window"), same)
    again = t.where("sys > 0").join(at(starts.where("window > 0").withColumn("pos", F.lit(0)), "window"), same)
    columns = ("conv_id", "pos", "role", "text", "tok", "window")
    t = own.select(*columns, F.lit(True).alias("new")).unionByName(old.unionByName(again).select(*columns, F.lit(False).alias("new")))
    body = _escaped(F.col("text"))
    mark = F.concat(F.lit("<turn:"), _escaped(F.col("role"), role=True), F.when(F.col("new"), ":new>").otherwise(":old>"))
    t = t.select("conv_id", "window", "pos", "tok", F.concat(mark, body, F.lit(END)).alias("turn"), F.length(mark).alias("at"), F.length(body).alias("size"), (F.col("new") & (F.col("role") == "assistant")).alias("target"))
    w = t.groupBy("conv_id", "window").agg(F.sum("tok").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("pos", "turn", "at", "size", "target"))).alias("turns"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))  # a window holds few turns: the budget bounds them
    loss = F.aggregate("turns", none, lambda acc, x: F.struct(
        (acc["at"] + F.length(x["turn"])).alias("at"),
        F.when(x["target"], F.concat(acc["loss"], F.array(F.struct((acc["at"] + x["at"]).alias("start"), x["size"].alias("length"))))).otherwise(acc["loss"]).alias("loss")))
    return w.select("conv_id", "window", "n_tokens", F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"), loss["loss"].alias("loss"))


def read_windows(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns, targets, chars): a window's new turns as (role, text) and its unmasked texts, from its output alone."""
    parts = F.slice(F.split("formatted", END), 1, F.size(F.split("formatted", END)) - 1)
    turns = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^<turn:([^:>]*):(new|old)>", 1).alias("role"), F.regexp_extract(p, r"^<turn:([^:>]*):(new|old)>", 2).alias("kind"), F.substring(p, F.instr(p, ">") + 1, F.length(p)).alias("text")))
    new = F.transform(F.filter(turns, lambda x: x["kind"] == "new"), lambda x: F.struct(_restored(x["role"], role=True).alias("role"), _restored(x["text"]).alias("text")))
    targets = F.transform("loss", lambda s: _restored(F.substring("formatted", s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window", new.alias("turns"), targets.alias("targets"), F.length("formatted").alias("chars"))


def op9(spark, sf_dir: str) -> DataFrame:
    c = B.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    r = read_windows(B.keep(format_windows(c.unionByName(odd)), "chat"))
    line = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    r = r.select("conv_id", "window", F.size("turns").alias("n"), F.array_join(line, "").alias("turns"), F.array_join("targets", "").alias("loss"), "chars")
    r = r.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    turns, loss = F.array_join(F.transform("w", lambda x: x["turns"]), ""), F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return r.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"))


SQL = rf"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p AS (
  SELECT *, row_number() OVER w - 1 AS pos, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {MARK_TOKENS} AS tok,
    length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), ':', '&#58;')) + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + 19 AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
q AS (
  SELECT p.*, coalesce(s.tok, 0) AS head, coalesce(s.chars, 0) AS head_chars,
    coalesce(lag(p.tok, 1) OVER v, 0) AS t1, coalesce(lag(p.tok, 2) OVER v, 0) AS t2, coalesce(lag(p.chars, 1) OVER v, 0) AS c1, coalesce(lag(p.chars, 2) OVER v, 0) AS c2
  FROM p LEFT JOIN p s ON s.conv_id = p.conv_id AND s.pos = 0 AND s.role = 'system' WINDOW v AS (PARTITION BY p.conv_id ORDER BY p.pos)),
h AS (
  SELECT *, CASE WHEN pos - 2 >= (head > 0)::INT AND t1 + t2 <= {HISTORY_TOKENS} THEN 2 WHEN pos - 1 >= (head > 0)::INT AND t1 <= {HISTORY_TOKENS} THEN 1 ELSE 0 END AS n_old FROM q),
o AS (SELECT *, CASE n_old WHEN 2 THEN t1 + t2 WHEN 1 THEN t1 ELSE 0 END AS old_tok, CASE n_old WHEN 2 THEN c1 + c2 WHEN 1 THEN c1 ELSE 0 END AS old_chars FROM h),
r AS (
  SELECT conv_id, pos, tok::BIGINT AS used, 0::BIGINT AS more FROM o WHERE pos = 0
  UNION ALL
  SELECT o.conv_id, o.pos, CASE WHEN r.used + o.tok <= {BUDGET} THEN r.used + o.tok WHEN o.head + o.old_tok + o.tok <= {BUDGET} THEN o.head + o.old_tok + o.tok ELSE o.head + o.tok END,
    CASE WHEN r.used + o.tok <= {BUDGET} THEN 0 WHEN o.head + o.old_tok + o.tok <= {BUDGET} THEN o.head_chars + o.old_chars ELSE o.head_chars END
  FROM r JOIN o ON o.conv_id = r.conv_id AND o.pos = r.pos + 1)
SELECT o.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY o.pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY o.pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(o.chars) + sum(r.more))::BIGINT AS formatted_chars
FROM o JOIN r ON r.conv_id = o.conv_id AND r.pos = o.pos GROUP BY o.conv_id
"""
