"""Relative links of markdown files that move.

When each file x/name.md becomes the folder x/name/, its links have one more folder above them, and links to files that moved too
lead to their folders. A link's target is resolved against its file and looked up by a join; links to what isn't there, to
other schemes, to anchors and absolute ones stay as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.functions import uris

#: A link or image with a relative target: its label, the target's path, and a query or anchor.
LINK = r"(!?\[[^\]\[]*\])\((?!/|#|[A-Za-z][A-Za-z0-9+.-]*:)([^)(\s?#]+)([?#][^)(\s]*)?\)"


def resolved(folder: Column, path: Column) -> Column:
    """The absolute path of a relative one, null if it leads above the root."""
    parts = F.filter(F.concat(F.split(folder, "/"), F.split(path, "/")), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(x == "..", F.when(F.size(out) > 0, F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))))).otherwise(F.concat(out, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def moved_into_folders(files: DataFrame, known: DataFrame, suffix: str = ".md") -> DataFrame:
    """files (uri, text, ...) with their links rewritten. known: the uris of all files, those that end in suffix become folders.

    Each different link of a file is looked up once; a row per link is shuffled, texts move once, by uri. Null texts stay null.
    """
    folder = uris.parent(F.col("uri"))
    links = files.where(F.col("text").rlike(LINK)).select("uri", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(LINK), F.lit(0)))).alias("link"))
    part = lambda k: F.regexp_extract("link", LINK, k)
    asked = links.select("uri", "link", part(1).alias("label"), part(2).alias("path"), part(3).alias("rest"), resolved(folder, part(2)).alias("target"))
    # a target is a file, or a folder that holds one
    there = known.select("uri").unionByName(known.select(F.explode(uris.ancestors(F.col("uri"))).alias("uri"))).distinct().select(F.col("uri").alias("target"))
    found = asked.join(there, "target")
    path = F.when(F.col("path").endswith(suffix), F.concat(F.regexp_replace("path", re.escape(suffix) + "$", ""), F.lit("/"))).otherwise(F.col("path"))
    path = F.regexp_replace(path, r"^(\./)+", "")
    new = F.concat("label", F.lit("(../"), path, "rest", F.lit(")"))
    swaps = found.groupBy("uri").agg(F.collect_list(F.struct("link", new.alias("new"))).alias("_swaps"))
    put = F.aggregate(F.coalesce("_swaps", F.array().cast("array<struct<link: string, new: string>>")), F.col("text"), lambda text, x: F.replace(text, x["link"], x["new"]))
    return files.join(swaps, "uri", "left").withColumn("text", put).select(*files.columns)
