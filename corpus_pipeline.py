"""The corpus pipeline: each stage works on what its predecessor kept, and its decisions take effect.

Every stage takes documents with any columns besides doc_id and text, whatever their names, and all but the last return
those columns of the rows they keep. Null text counts as empty. Rows that repeat are each decided on alike. An empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shakeprint.functions.lineage import materialise_at, remove
from shakeprint.llm import exact_dedup, language_id, packing, simhash, toxicity
from shakeprint.llm.common import table

#: SQL can't express the trained stages; the tests hold run() against a brute-force version.
ORACLE_SQL = None


#: Workers serve all stages, so none may keep much: words whose ids packing keeps in each.
PACK_CHUNKS = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the tagger predicts to be toxic: those with a score of 0.5 or more, ties with it included.
    Empty texts are clean; where the labels tell nothing, all documents stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, carry=True).where("predicted = 0").select("row.*")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have no letter, or whose script no learned language has; see the README for what stays.
    Where nothing is learned, every document is undetermined and goes."""
    found = language_id.identify(docs, language_id.train(docs), carry=True)
    return language_id.rejects(found).where("not rejected").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the row with the most code points, then the smallest id.
    Empty texts are one group. Rows that repeat the id and the text that stay are all kept."""
    return exact_dedup.exact_dedup(docs, carry=True).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints, the document with the smallest id. Empty texts have one fingerprint. All
    rows of that id stay; a null id stays only in a component without another."""
    kept = simhash.near_dedup(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("id")).distinct()
    return docs.alias("d").join(kept.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.id")), "left_semi")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; an empty text is one end token."""
    return packing.pack(docs, cache_chunks=PACK_CHUNKS)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = materialise_at(stage(spark, docs, sf_dir))
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
