"""Importance resampling towards a target: hashed n-gram features, a gain a bucket, and a weighted draw without
replacement. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import number_rows
from .common import materialise

#: Buckets of features; a draw's share in hundredths, the words that a drawn document has at least, and its seed.
BUCKETS, PERCENT, MIN_WORDS, SEED = 10_000, 25, 20, 7
#: What lies between words: ASCII other than letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of ASCII letters (A-Z in lower case), digits and other characters. Null: none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def bucket(feature: Column) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(BUCKETS)).cast("int")


def feature_rows(df: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """keep, n_words, and `bucket` of each run of one or two words: a row each, and one with null if a text has none.
    Each word is taken with the one after it, so no text's n-grams are all in memory."""
    listed = df.select(*keep, words(text).alias("_w"))
    kept = [c for c in listed.columns if c != "_w"]
    paired = listed.select(*kept, F.size("_w").alias("n_words"), F.explode_outer(F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", F.lit(2), F.size("_w")).alias("b"))).alias("_g"))
    pair = F.concat_ws(" ", "_g.a", "_g.b")
    grams = F.when(F.col("_g.b").isNull(), F.array(bucket(F.col("_g.a")))).otherwise(F.array(bucket(F.col("_g.a")), bucket(pair)))
    return paired.select(*kept, "n_words", F.explode(grams).alias("bucket"))


def bucket_counts(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """bucket and `name`: how many features fall into it. Summed in each task before anything is shuffled."""
    rows = feature_rows(df, F.col(text_col)).where("bucket is not null")
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(df: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text") -> DataFrame:
    """bucket and gain (thousandths of a log ratio with one added to each bucket): a row for each of BUCKETS."""
    everything = Window.partitionBy()  # over BUCKETS rows, whatever the input
    counted = df.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    for part, col, name in ((df, text_col, "s"), (target, target_col, "t")):
        counted = counted.join(bucket_counts(part, col, name), "bucket", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("double"))
    ratio = (F.col("t") + 1) * (F.sum("s").over(everything) + BUCKETS) / ((F.col("s") + 1) * (F.sum("t").over(everything) + BUCKETS))
    return counted.select("bucket", F.floor(F.log(ratio) * 1000).alias("gain"))


def floored_mean(total: Column, n: Column) -> Column:
    """total / n towards minus infinity, in integers."""
    return ((total - F.pmod(total, n)) / n).cast("long")


def noise(id_: Column, seed: int) -> Column:
    """A Gumbel variate a document, in thousandths, from the digest of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)


def resample(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
) -> DataFrame:
    """One row per input row: id, n_features, weight, score, rank (1 and up among the drawn, null for others).

    A document's weight is the floored mean of its features' gains; of the N documents with min_words words or more, the
    floor(percent * N / 100) highest scores are drawn, equal ones by smaller id, null ids last, and repeated rows as they
    come. Null and empty texts have no feature, a weight of 0, and aren't drawn. An empty target gives gains that
    favour rare features; an empty table gives no rows. Other columns are not read, whatever their names.

    The texts are read twice: once for counts of a row a bucket and task, and once with the gains (BUCKETS rows) as a
    broadcast table, summed to a row a document within its task. Ranks come from a range partitioning and its sizes.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent lies between 0 and 100")
    table = gains(df, target, text_col, target_col)
    # A row's number comes from its place in the scan, so that repeated ids stay apart; ids are read once a row.
    rows = feature_rows(df, F.col(text_col), F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"))
    found = rows.join(F.broadcast(table), "bucket", "left")
    summed = found.groupBy("_row", "_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("_sum"))
    weight = F.when(F.col("n_features") > 0, floored_mean(F.col("_sum"), F.col("n_features"))).otherwise(F.lit(0).cast("long"))
    scored = summed.select("_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("_id"), seed))
    stored = materialise(scored)
    able = F.col("n_words") >= min_words
    drawn = percent * stored.where(able).count() // 100
    ranked = number_rows(stored.where(able), [F.desc("score"), F.asc_nulls_last("_id")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = ranked.unionByName(stored.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("_id").alias(id_col), "n_features", "weight", "score", "rank")


#: DuckDB has no crc32. It is linear in the bits of its input: the checksum is the exclusive or of a share of each byte,
#: which depends on the bytes behind it, and of the checksum of as many zeros.
ORACLE = f"""
WITH RECURSIVE
 steps(b, k, c) AS (SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
   UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM steps WHERE k < 8),
 bytes AS (SELECT b, c FROM steps WHERE k = 8),
 lists AS (
   SELECT 'd' AS side, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
   UNION ALL
   SELECT 't', item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') FROM benchmark),
 grams AS (
   SELECT side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM lists),
 features AS (SELECT side, doc_id, f, count(*) AS n FROM grams GROUP BY ALL),
 spelled AS (SELECT f, hex(encode(f)) AS x, octet_length(encode(f)) AS size FROM (SELECT DISTINCT f FROM features)),
 longest AS (SELECT coalesce(max(size), 0) AS size FROM spelled),
 shares(k, b, c) AS (SELECT 0::BIGINT, b, c FROM bytes
   UNION ALL SELECT k + 1, s.b, xor(s.c >> 8, z.c) FROM shares s JOIN bytes z ON z.b = s.c & 255 WHERE k < (SELECT size FROM longest)),
 zeros(k, c) AS (SELECT 0::BIGINT, 4294967295::BIGINT
   UNION ALL SELECT k + 1, xor(s.c >> 8, z.c) FROM zeros s JOIN bytes z ON z.b = s.c & 255 WHERE k < (SELECT size FROM longest)),
 places AS (SELECT f, size, x, unnest(range(size)) AS i FROM spelled),
 sums AS (SELECT f, any_value(size) AS size, bit_xor(shares.c) AS c
   FROM places JOIN shares ON shares.k = size - 1 - i AND shares.b = ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT GROUP BY f),
 hashed AS (SELECT f, xor(xor(sums.c, zeros.c), 4294967295) % {BUCKETS} AS bucket FROM sums JOIN zeros ON zeros.k = size),
 counts AS (
   SELECT r.range AS bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t
   FROM range({BUCKETS}) r LEFT JOIN (SELECT bucket, side, n FROM features JOIN hashed USING (f)) h ON h.bucket = r.range GROUP BY 1),
 table_ AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + {BUCKETS}) / ((s + 1) * (sum(t) OVER () + {BUCKETS}))))::BIGINT AS gain FROM counts),
 totals AS (SELECT doc_id, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM features JOIN hashed USING (f) JOIN table_ USING (bucket) WHERE side = 'd' GROUP BY doc_id),
 scored AS (
   SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
     ('0x' || substr(sha256('{SEED}:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM (SELECT * FROM lists WHERE side = 'd') LEFT JOIN totals USING (doc_id)),
 drawn AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM scored),
 ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM drawn WHERE n_words >= {MIN_WORDS})
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  CASE WHEN place <= {PERCENT} * able // 100 THEN place END::BIGINT AS rank
FROM drawn LEFT JOIN ranks USING (doc_id)
"""
