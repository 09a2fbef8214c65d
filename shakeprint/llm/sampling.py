"""Bounded samples of labelled rows to train on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_share, held_out


def labelled_ids(labels: DataFrame, id_col: str, label_col: str, per_label: int) -> tuple[list[tuple], dict]:
    """About per_label ids of each label, at most twice as many, chosen by a hash of the id among the ids that may be
    learned from; and the number of such ids of each label. An id with several labels has the largest."""
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return [], {}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == F.lit(label), F.lit(min(1.0, per_label / n))).otherwise(share)
    rows = known.where(hash_share("id", share)).select("id", "label").limit(2 * per_label * len(counts)).collect()
    return sorted((r["id"], r["label"]) for r in rows), counts


def labelled_texts(docs: DataFrame, ids: list[tuple], id_col: str, text_col: str, max_chars: int, label_type: str, all_chars: int | None = None) -> list[tuple]:
    """(id, text, label) of the sampled ids whose text has at most max_chars characters, in order of the id; of each
    label, in order of a hash of the id, until they have all_chars characters."""
    if not ids:
        return []
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    sample = F.broadcast(spark.createDataFrame(ids, f"id {kind}, label {label_type}"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= max_chars).join(sample, "id")
    if all_chars:  # of the sample alone, which is bounded in rows
        order = Window.partitionBy("label").orderBy(F.xxhash64("id", F.lit("order")), "id", "text")
        texts = texts.withColumn("before", F.sum(F.length("text")).over(order) - F.length("text")).where(F.col("before") < all_chars)
    return sorted({(r["id"], r["text"], r["label"]) for r in texts.select("id", "text", "label").collect()})
