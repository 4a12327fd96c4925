"""Edits of records: patches in order, patches by similarity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ctxloom.functions import documents as D
from ctxloom.operators import folds
from ctxloom.plans.registry import query


def conversation_edits(t):
    """(doc_id, turn, value, blocks): each conversation edits the document of its number.

    The first turn replaces the document's first line; each later one replaces the text of the turn before (an assistant with its first
    letter wrong); every fifth turn is a whole new text.
    """
    first = t.documents.select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("line"))
    m = t.messages.select(F.col("conv_id").alias("doc_id"), "turn", "role", "text", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"))
    near = F.when(F.col("role") == "assistant", F.concat(F.lit("#"), F.substring("before", 2, 1_000_000_000))).otherwise(F.col("before"))
    find = F.when(F.col("before").isNull(), F.col("line")).otherwise(near)
    block = F.array(F.struct(find.alias("search"), F.col("text").alias("replace")))
    return m.join(first, "doc_id", "left").select("doc_id", "turn", F.when(F.col("turn") % 5 == 4, F.col("text")).alias("value"), F.when(F.col("turn") % 5 != 4, block).alias("blocks"))


@query("merge_patch")
def merge_patch(t):
    out = folds.merge_patch(t.documents.select("doc_id", "text"), conversation_edits(t), "doc_id", "turn")
    return out.select("doc_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("md5"), "applied", "failed")


def edited_blocks(t):
    """(uri, text, blocks): three lines from the middle of each document with every b as p, and its last line with every e as a."""
    lines = F.split("text", "\n")
    middle = F.array_join(F.slice(lines, F.greatest(F.lit(1), F.floor(F.size(lines) / 2).cast("int")), 3), "\n")
    pairs = ((F.translate(middle, "b", "p"), F.lit("MIDDLE\n  second")), (F.translate(F.element_at(lines, -1), "e", "a"), F.lit("LAST")))
    blocks = F.array(*[F.struct(a.alias("search"), b.alias("replace")) for a, b in pairs])
    return t.documents.select(F.col("doc_id").cast("string").alias("uri"), "text", blocks.alias("blocks"))


@query("patch_fuzzy")
def patch_fuzzy(t):
    return D.patched_blocks(edited_blocks(t))
