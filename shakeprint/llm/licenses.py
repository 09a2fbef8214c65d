"""License scans by canonical digest, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import NOTICES, TEXTS, full_texts, more_notices

Texts = list[tuple[str, str]]
#: Known digests are broadcast, or looked up in a literal map, up to so many; beyond that they are joined by shuffle.
SMALL = 10_000
#: Lines that only name holders and years.
COPYRIGHT_WORDS = ("copyright", "(c)", "©", "all rights reserved")
COPYRIGHT_LINE = r"(^|\n)[ \t*#/;-]*(copyright[ \t:,]*(\(c\)|©|[0-9<{\[]|by )|copyright [^\n]*[12][0-9][0-9][0-9]|(\(c\)|©)[ \t]*(copyright|[0-9])|all rights reserved)[^\n]*"
#: ASCII that is no letter or digit, and typographic punctuation.
PUNCTUATION = r"[\x00-/:-`{-\x7f‘’“”–—®™•… ]+"
#: Spellings that count as one.
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("organisation", "organization"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("favour", "favor"), ("honour", "honor"), ("https", "http"), ("copyright owner", "copyright holder")]
#: Lines that hold one of these are looked at as notices.
NOTICE_WORDS = ("licen", "public domain", "spdx")


def holds(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in words))


def canonical(lower: Column) -> Column:
    """Lower-case text without copyright lines, punctuation and differences of spelling."""
    out = F.when(holds(lower, COPYRIGHT_WORDS), F.regexp_replace(lower, COPYRIGHT_LINE, "$1")).otherwise(lower)
    out = F.trim(F.regexp_replace(out, PUNCTUATION, " "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def known_digests(spark: SparkSession, texts: Texts) -> DataFrame:
    """(digest, license): of texts that are equal in canonical form, the first name counts."""
    rows = spark.createDataFrame(sorted(texts) or [("", "")], "license string, text string")
    known = rows.where("text <> ''").select(F.sha2(canonical(F.lower("text")), 256).alias("digest"), "license")
    return known.groupBy("digest").agg(F.min("license").alias("license"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: Texts | None = None, notices: Texts | None = None) -> DataFrame:
    """One row per input row: id, text_digest, license (of the known text that the whole text equals; null if none),
    notices (the licenses that whole lines name, in order, joined by commas; empty if none).

    Case, punctuation, copyright lines and equivalent spellings don't count. Null text counts as empty, which is no
    license. Repeated rows and null ids are kept; an empty table gives no rows. Whole texts are read, however long.
    Nothing of the documents is shuffled while the known digests number at most SMALL. Other columns are not read.
    """
    spark = df.sparkSession
    texts, notices = [*TEXTS, *full_texts()] if texts is None else texts, [*NOTICES, *more_notices()] if notices is None else notices
    known = known_digests(spark, texts)
    if len(texts) <= SMALL:
        known = F.broadcast(known)
    lower = df.select(F.col(id_col).alias(id_col), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("lower"))
    lines = F.when(holds(F.col("lower"), NOTICE_WORDS), F.filter(F.split("lower", "\n"), lambda line: holds(line, NOTICE_WORDS))).otherwise(F.array().cast("array<string>"))
    keyed = lower.select(id_col, F.sha2(canonical(F.col("lower")), 256).alias("digest"), F.transform(lines, lambda line: F.sha2(canonical(line), 256)).alias("lines"))
    if len(notices) > SMALL:
        raise ValueError(f"at most {SMALL} notices; longer texts belong to `texts`")
    named = known_digests(spark, notices).collect()
    if named:
        table = F.create_map(*(F.lit(x) for r in sorted(named) for x in (r["digest"], r["license"])))
        found = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("lines", lambda d: F.try_element_at(table, d)), lambda x: x.isNotNull()))), ",")
    else:
        found = F.lit("")
    return keyed.join(known, "digest", "left").select(id_col, F.col("digest").alias("text_digest"), F.col("license"), found.alias("notices"))


def oracle_sql() -> str:
    """The same in DuckDB's SQL, with the same lists."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        out = f"regexp_replace({x}, {quoted(COPYRIGHT_LINE)}, '\\1', 'g')"
        out = f"trim(regexp_replace({out}, {quoted(PUNCTUATION)}, ' ', 'g'))"
        for a, b in SPELLINGS:
            out = f"replace({out}, {quoted(a)}, {quoted(b)})"
        return f"sha256({out})"

    def lower(x: str) -> str:
        return f"lower({x})"

    def values(texts: Texts) -> str:
        rows = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(texts))
        return f"SELECT {canon(lower('text'))} AS digest, min(license) AS license FROM (VALUES {rows}) AS v(license, text) GROUP BY 1"

    return f"""
WITH known AS ({values([*TEXTS, *full_texts()])}), named AS ({values([*NOTICES, *more_notices()])}),
d AS (SELECT doc_id, {lower("coalesce(text, '')")} AS lower FROM documents),
lines AS (SELECT doc_id, unnest(string_split(lower, chr(10))) AS line FROM d),
found AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
          FROM (SELECT doc_id, {canon("line")} AS digest FROM lines WHERE {' OR '.join(f"contains(line, '{w}')" for w in NOTICE_WORDS)}) JOIN named USING (digest) GROUP BY doc_id),
keyed AS (SELECT doc_id, {canon("lower")} AS text_digest FROM d)
SELECT doc_id, text_digest, license, coalesce(notices, '') AS notices
FROM keyed LEFT JOIN known ON text_digest = digest LEFT JOIN found USING (doc_id)
"""
