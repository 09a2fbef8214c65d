"""What several operators of this subpackage share."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import materialise, materialise_freed, shared_dir

__all__ = ["attach_by_share", "by_chars", "crc_fold", "default_salts", "fold", "hash_share", "held_out", "join_values", "materialise", "materialise_small", "rows", "shared_dir", "table"]

#: Rows whose crc32(id as text) leaves this remainder are never learned from.
FOLDS, HELD_OUT = 5, 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_salts(spark: SparkSession) -> int:
    """Shares of a hot group: four a shuffle partition, so a group of a third of all rows fills a twelfth of one at most."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(id_col: str | Column) -> Column:
    """crc32 of the id as text, modulo FOLDS (null ids: null)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")), F.lit(FOLDS))


def held_out(id_col: str) -> Column:
    """Null ids are held out, so nothing is learned from them."""
    return F.coalesce(fold(id_col) == HELD_OUT, F.lit(True))


def crc_fold(value: object) -> int:
    return zlib.crc32(str(value).encode()) % FOLDS


def hash_share(id_col: str, fraction: Column | float) -> Column:
    """True for about that fraction of ids, always the same ones."""
    scale = 1 << 31
    return F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(scale)) < F.lit(scale) * fraction


def attach_by_share(rows: DataFrame, classes: DataFrame, key: str, salt: Column, salts: int, how: str = "left") -> DataFrame:
    """rows joined to classes (one row a key at most) on key. Classes are spread over the shares of each key that
    occur, so that no key brings more than a share of its rows to one task."""
    salted = rows.withColumn("_salt", salt)
    shares = salted.select(key, "_salt").distinct().join(classes, key)
    return salted.join(shares, [key, "_salt"], how).drop("_salt")


def materialise_small(df: DataFrame) -> DataFrame:
    """materialise(df) in a denser encoding, without the shuffle files that it took."""
    conf, key = df.sparkSession.conf, "spark.sql.parquet.compression.codec"
    before = conf.get(key)
    conf.set(key, "zstd")
    try:
        return materialise_freed(df)
    finally:
        conf.set(key, before)


#: Keys that make up a HEAD-th of all occurrences or more are broadcast: there are HEAD of them at most.
HEAD = 1 << 21
#: A key of more bytes than this has to be so much more frequent, so that the broadcast keys have HEAD times as many bytes at most.
KEY_BYTES = 16


def join_values(rows: DataFrame, counts: DataFrame, key: str, total: str, head: int = HEAD) -> DataFrame:
    """rows joined to counts (stored; one row a key, with how often it occurs in all as `total`) on key, all found.

    Frequent keys are few, whatever the input, and joined by broadcast, so none brings its rows to one task. Others
    are joined by shuffle: none of them has more than a head-th of all occurrences (more for keys of many bytes).
    """
    size = F.octet_length(F.col(key).cast("string")) if dict(counts.dtypes)[key] in ("string", "binary") else F.lit(KEY_BYTES)
    every = counts.agg(F.sum(total)).first()[0] or 0
    often = F.col(total) * F.lit(float(head)) >= F.lit(float(every)) * F.greatest(F.lit(1.0), size / KEY_BYTES)
    frequent = F.broadcast(counts.where(often).drop(total))
    rest = rows.join(F.broadcast(counts.where(often).select(key)), key, "left_anti").join(counts.where(~often).drop(total), key)
    return rows.join(frequent, key).unionByName(rest)


def rows(batch, *columns: int):
    """Tuples of a record batch's columns (all by default), made a few rows at a time."""
    columns = columns or range(batch.num_columns)
    for at in range(0, batch.num_rows, 256):
        yield from zip(*(batch.column(k).slice(at, 256).to_pylist() for k in columns), strict=True)


def by_chars(tuples, limit: int):
    """Cuts tuples (of which the second is a text) into lists of about limit characters."""
    out, size = [], 0
    for t in tuples:
        out.append(t)
        size += len(t[1] or "")
        if size >= limit:
            yield out
            out, size = [], 0
    if out:
        yield out
