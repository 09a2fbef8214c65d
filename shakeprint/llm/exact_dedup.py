"""Exact deduplication by content sort, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import default_salts

#: The characters whose deletion must not make texts differ.
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: Splitters are sampled on so many leading characters; sorting and comparing take the whole text.
SPLITTER_CHARS = 64


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in WHITE_SPACE:  # searching bytes, where translate() would look up each character
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None, carry: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (and with carry the input row as struct `row`).

    Sampled splitters over (leading characters, share) range-partition the normalised texts; each task sorts its range
    externally and compares neighbours in full (sort aggregation), so equal texts of a share become one run. A run keeps
    the row with the most code points in its original text, then the smallest id. Runs are then merged by the digest of
    their text; a group has at most `salts` runs, however many rows it has, so no group meets in one task.

    Null text counts as empty; empty texts form one group. Null ids sort before others. Rows that repeat an id with an
    equal text count each in group_size, and all of those that carry keep_id are kept. An empty table gives no rows.
    Other columns, whatever their names, are only read with carry.
    """
    salts = salts or default_salts(df.sparkSession)
    base = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.struct("*").alias("row")] if carry else []))
    share = F.pmod(F.xxhash64("id", "n"), F.lit(salts)).cast("int")
    rows = base.select("id", normalised(F.col("text")).alias("norm"), F.length("text").alias("n"), *(["row"] if carry else []))

    ranged = rows.select("id", "n", "norm", F.substring("norm", 1, SPLITTER_CHARS).alias("head"), share.alias("share")).repartitionByRange("head", "share")
    runs = ranged.groupBy("head", "share", "norm").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("id").alias("id"))).alias("best"), F.count(F.lit(1)).alias("size"))
    group = Window.partitionBy("sha")
    runs = runs.select(F.sha2("norm", 256).alias("sha"), "share", "best", "size")
    classes = runs.select("sha", "share", F.min("best").over(group).alias("best"), F.sum("size").over(group).alias("size"))

    keyed = rows.select("id", F.sha2("norm", 256).alias("sha"), share.alias("share"), *(["row"] if carry else []))
    out = keyed.join(classes, ["sha", "share"])
    return out.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("best.id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *(["row"] if carry else []),
    )


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS sha
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY sha ORDER BY length(text) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY sha ORDER BY length(text) DESC, doc_id) AS kept,
       sha AS text_sha256
FROM t
"""
