"""Files as tables: directory scans, ignore rules, feeds, format parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.functions.uris import glob_regex

#: How a file suffix is read: Spark's own reader where there is one, binaryFile for the parsers.
READERS = {"parquet": "parquet", "json": "json", "jsonl": "json", "csv": "csv", "orc": "orc", "xml": "xml", "txt": "text", "md": "text", "log": "text"}


def scan(spark: SparkSession, path: str, include: str = "*", recursive: bool = True) -> DataFrame:
    """(path, size, mod_time, content) of files; size and time prune before contents are read."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", include).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return d.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mod_time"), "content").where(~F.col("path").rlike(r"/\.[^/]*$") & (F.col("size") > 0))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A table from a file or folder by its suffix."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    return spark.read.format(READERS.get(suffix, "binaryFile")).load(path)


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether ignore rules leave a path out: the last rule that matches decides; ! takes back."""
    out = F.lit(False)
    for rule in rules:
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            continue
        keep = rule.startswith("!")
        rule = rule.lstrip("!")
        anchored = rule.startswith("/") or "/" in rule.rstrip("/")
        body = glob_regex(rule.strip("/"))[1:-1]
        pattern = ("^/" if anchored else "(^|/)") + body + ("/" if rule.endswith("/") else "(/|$)")
        out = F.when(path.rlike(pattern), F.lit(not keep)).otherwise(out)
    return out


def feed_entries(entries: DataFrame, url: str = "url", order: str = "page_id") -> DataFrame:
    """http(s) entries of the first host, each URL once, as first seen."""
    e = entries.where(F.col(url).rlike("^https?://")).withColumn("host", F.lower(F.regexp_extract(url, "^[a-z]+://([^/]+)", 1)))
    host = e.agg(F.min("host").alias("host"))
    one = e.join(F.broadcast(host), "host", "left_semi")  # one row
    cols = entries.columns
    return one.groupBy(url).agg(F.min_by(F.struct(*cols), order).alias("e")).select("e.*")


def feed_items(xml: Column) -> Column:
    """Titles and links of an RSS document."""
    return F.from_xml(xml, "channel struct<item: array<struct<title: string, link: string>>>")["channel"]["item"]
