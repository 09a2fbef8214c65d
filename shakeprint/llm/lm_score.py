"""Language-model scores by stupid backoff, with n-gram counts kept in tables partitioned by hash.

Rows of n-grams travel packed: one row holds the sorted 64-bit hashes of all n-grams that a chunk of documents has in
one hash range, once each. A range's rows meet in one task, which counts them (the count table of that range), joins
each chunk's n-grams to the counts, and writes those to the shared folder, so that the n-grams' shuffle files can go
before anything is sent back to the chunk; there they are joined to the exploded n-grams of
each document by position, and summed. A frequent n-gram is one entry a chunk, so no range is hot.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import materialise, materialise_freed
from .common import default_salts

ORDER, BACKOFF, CUTOFF = 3, 0.4, 2
#: Tokens that one chunk of documents has at least, unless its partition ends; what a worker holds is bounded by it
#: and by the longest document.
CHUNK_TOKENS = 600_000
#: A hash range has about so many tokens at most, whatever the number of shuffle partitions.
RANGE_TOKENS = 2_000_000
CACHE_WORDS = 250_000
_M1, _M2, _K = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


class WordHashes:
    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, lists: list[list[str]]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        for w in set(chain.from_iterable(lists)).difference(self.known):
            self.known[w] = xxhash.xxh64_intdigest(w.encode())
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(lists)), np.uint64, sum(map(len, lists)))


def longer(grams: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of their first n-1 words and of their last word."""
    h = grams * _K + word
    h = (h ^ h >> np.uint64(30)) * _M1
    h = (h ^ h >> np.uint64(27)) * _M2
    return h ^ h >> np.uint64(31)


def gram_hashes(word: np.ndarray, sizes: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each order: the hash of the n-gram that ends at each position, and the positions that have one."""
    place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hashes, ends = [word], [np.arange(len(word))]
    for n in range(2, order + 1):
        before = np.empty_like(word)
        before[1:] = hashes[-1][:-1]
        before[:1] = 0
        hashes.append(longer(before, word))
        ends.append(np.flatnonzero(place >= n - 1))
    return hashes, ends


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compresses better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplanes(raw: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def zipped(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unzipped(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)


def deltas(x: np.ndarray) -> bytes:
    return planes(np.diff(x, prepend=np.uint64(0)))


def undeltas(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, "<u8"), dtype=np.uint64)


def digest(word: np.ndarray, sizes: np.ndarray) -> int:
    """Of a chunk's words and documents, as a signed 64-bit number."""
    return xxhash.xxh64_intdigest(word.tobytes() + sizes.tobytes()) - (1 << 63)


def _moves_rows(df: DataFrame) -> bool:
    """Whether the plan has more than scans and projections, so that another run may give rows in another order."""
    plan = df._jdf.queryExecution().optimizedPlan()
    kinds = {line.strip(" :+-").split(" ")[0] for line in plan.treeString().splitlines()}
    return not kinds <= {"Project", "Relation", "LocalRelation", "LogicalRDD", "Filter", "Range", "Union", ""}


def _chunks(batches):
    """(number, ids, sizes, word hashes) of runs of documents with CHUNK_TOKENS tokens or more."""
    hasher, number = WordHashes(), TaskContext.get().partitionId() << 32
    ids, sizes, hashes, total = [], [], [], 0
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for at in range(0, len(texts), 500):
            lists = [words(t) for t in texts[at : at + 500]]
            ids.append(batch.column(0).slice(at, len(lists)))
            sizes += map(len, lists)
            hashes.append(hasher(lists))
            total += len(hashes[-1])
            if total >= CHUNK_TOKENS:
                yield number, ids, np.array(sizes, np.int64), np.concatenate(hashes)
                number, ids, sizes, hashes, total = number + 1, [], [], [], 0
    if ids:
        yield number, ids, np.array(sizes, np.int64), np.concatenate(hashes)


def score(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, cutoff: int = CUTOFF, ranges: int | None = None,
) -> DataFrame:
    """One row per input row: id, n_tokens, log_score (sum of the natural logs of the words' scores), mean_log_score
    (null without words), backed_off (words whose longest n-gram is rarer than the cutoff).

    Words are runs without white space, in lower case. S(w | h) is c(hw) / c(h) if c(hw) >= cutoff, else backoff times
    S(w | h without its first word); a single word has c(w) / N. Counts are over all rows. h is at most order - 1 words
    and starts in the document.

    Null text counts as empty: no words, log_score 0. Repeated rows count each; null ids are kept; an empty table gives
    no rows. Other columns are not read. ranges: hash ranges of the count tables, by default four a shuffle partition,
    and more where the text needs them.

    The text is read in three passes, which must find the same rows in the same order, as passes over stored tables
    do: what isn't a plain scan is stored first, and each chunk's answers carry a digest of the words asked for.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if _moves_rows(source):
        source = materialise(source)
    total = source.mapInArrow(_count_words, "n long").agg(F.sum("n")).first()[0] or 0
    bits = max(1, ((ranges or max(default_salts(spark), total // RANGE_TOKENS)) - 1).bit_length())
    id_field = T.StructField(id_col, df.schema[id_col].dataType)
    parts = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("words", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("range", T.IntegerType()), T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("ids", T.ArrayType(id_field.dataType))])

    def as_batch(rows, id_type):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(id_type)]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=parts.names)

    def ask(batches):
        """Each chunk's n-grams, once each, with their number in the chunk, by order and hash range."""
        for number, ids, sizes, word in _chunks(batches):
            hashes, ends = gram_hashes(word, sizes, order)
            rows, told = [], digest(word, sizes)
            for n, (h, at) in enumerate(zip(hashes, ends, strict=True), 1):
                unique, count = np.unique(h[at], return_counts=True)
                part = (unique >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.searchsorted(part, np.arange((1 << bits) + 1)).tolist()
                rows += [(number, told, n, k, deltas(unique[a:b]), planes(count[a:b].astype("<u4")), None) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            for at in range(0, len(rows), 256):
                yield as_batch(rows[at : at + 256], ids[0].type)

    def count(table: pa.Table) -> pa.Table:
        """One range: the count of each n-gram over all chunks, joined to each chunk's n-grams."""
        asked = [undeltas(x) for x in table.column("a").to_pylist()]
        own = [unplanes(x, "<u4") for x in table.column("b").to_pylist()]
        flat = np.concatenate(asked)
        unique, inverse = np.unique(flat, return_inverse=True)
        totals = np.bincount(inverse, np.concatenate(own)).astype("<u8")[inverse]
        ends = np.cumsum([len(x) for x in asked]).tolist()
        answer = [zipped(planes(totals[a:b])) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return pa.table({"chunk": table.column("chunk"), "words": table.column("words"), "n": table.column("n"), "range": table.column("range"), "a": pa.array(answer, pa.binary()), "b": pa.nulls(len(answer), pa.binary()), "ids": pa.nulls(len(answer), table.schema.field("ids").type)})

    def keep(batches):
        """Each chunk's words as positions among its distinct word hashes, and its documents."""
        for number, ids, sizes, word in _chunks(batches):
            unique, inverse = np.unique(word, return_inverse=True)
            listed = pa.concat_arrays(ids).to_pylist()
            head = np.array([len(unique), len(sizes)], "<u8").tobytes()
            yield as_batch([(number, digest(word, sizes), 0, 0, head + deltas(unique) + planes(sizes.astype("<u8")), zipped(planes(inverse.astype("<u4"))), listed)], ids[0].type)

    out_type = T.StructType([id_field, T.StructField("n_tokens", T.LongType()), T.StructField("log_score", T.DoubleType()), T.StructField("mean_log_score", T.DoubleType()), T.StructField("backed_off", T.LongType())])

    def answer(table: pa.Table) -> pa.Table:
        """One chunk: its counts joined to its n-grams by position, and the words' scores summed per document."""
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("n", "range", "a", "b", "ids")), strict=True), key=lambda r: r[:2])
        if len(set(table.column("words").to_pylist())) != 1 or rows[0][0] != 0:
            raise ValueError("the input changed between passes: store it first")
        (_, _, head, inverse, ids), answers = rows[0], rows[1:]
        n_unique, n_docs = np.frombuffer(head[:16], "<u8").tolist()
        unique, sizes = undeltas(head[16 : 16 + 8 * n_unique]), unplanes(head[16 + 8 * n_unique :], "<u8").astype(np.int64)
        word = unique[unplanes(unzipped(inverse), "<u4")] if n_unique else np.zeros(0, np.uint64)
        counts = {n: [unplanes(unzipped(a), "<u8") for k, _, a, _, _ in answers if k == n] for n in range(1, order + 1)}
        hashes, ends = gram_hashes(word, sizes, order)
        logs = np.zeros(len(word))
        backed = np.zeros(len(word), np.int64)
        before = np.zeros(0)
        for n, (h, at) in enumerate(zip(hashes, ends, strict=True), 1):
            if not len(at):
                break
            have, place = np.unique(h[at], return_inverse=True)
            told = np.concatenate(counts[n])
            if len(told) != len(have):
                raise ValueError(f"{len(told)} counts for {len(have)} n-grams: the input changed between passes")
            c = np.zeros(len(word))
            c[at] = told[place]
            if n == 1:
                logs = np.log(c / total)
            else:
                seen = c[at] >= cutoff
                logs[at] = np.where(seen, np.log(c[at]) - np.log(before[at - 1]), np.log(backoff) + logs[at])
                backed[at] = ~seen
            before = c
        of = np.repeat(np.arange(len(sizes)), sizes)
        sums, filled = np.zeros(len(sizes)), np.flatnonzero(sizes)
        if len(filled):  # in extended precision, so that the order of the words doesn't show
            sums[filled] = np.add.reduceat(logs.astype(np.longdouble), (np.cumsum(sizes) - sizes)[filled]).astype(float)
        rarer = np.bincount(of, backed, len(sizes)).astype(np.int64)
        mean = pa.array(np.divide(sums, sizes, out=np.zeros(len(sizes)), where=sizes > 0), mask=sizes == 0)
        return pa.table([pa.array(ids, table.schema.field("ids").type.value_type), pa.array(sizes), pa.array(sums), mean, pa.array(rarer)], names=out_type.names)

    counted = materialise_freed(source.mapInArrow(ask, parts).groupBy("n", "range").applyInArrow(count, parts))
    return source.mapInArrow(keep, parts).unionByName(counted).groupBy("chunk").applyInArrow(answer, out_type)


def _count_words(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(words(t)) for t in batch.column(1).to_pylist())])], names=["n"])


#: White space of Python's str.split(), for a regular expression.
_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: The query's scores, rounded to DIGITS places: the count tables joined to the n-grams of every word.
DIGITS = 9
ORACLE = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_SPACE}'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
g AS (SELECT doc_id, pos, word AS a, lag(word) OVER p AS b, lag(word, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
one AS (SELECT a, count(*) AS n FROM g GROUP BY a),
two AS (SELECT b, a, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b, a),
three AS (SELECT c, b, a, count(*) AS n FROM g WHERE c IS NOT NULL GROUP BY c, b, a),
s AS (SELECT g.doc_id, one.n AS n1, two.n AS n2, three.n AS n3, ctx1.n AS h1, ctx2.n AS h2, (SELECT count(*) FROM g) AS total
  FROM g JOIN one USING (a) LEFT JOIN two ON two.b = g.b AND two.a = g.a LEFT JOIN three ON three.c = g.c AND three.b = g.b AND three.a = g.a
  LEFT JOIN one AS ctx1 ON ctx1.a = g.b LEFT JOIN two AS ctx2 ON ctx2.b = g.c AND ctx2.a = g.b),
l AS (SELECT doc_id, CASE WHEN n3 >= {CUTOFF} THEN ln(n3) - ln(h2) ELSE (n3 IS NOT NULL)::INT * ln({BACKOFF}) + CASE WHEN n2 >= {CUTOFF} THEN ln(n2) - ln(h1) ELSE (n2 IS NOT NULL)::INT * ln({BACKOFF}) + ln(n1 / total) END END AS score,
  coalesce(coalesce(n3, n2) < {CUTOFF}, false)::BIGINT AS backed FROM s),
t AS (SELECT doc_id, count(*) AS n_tokens, fsum(score) AS log_score, sum(backed)::BIGINT AS backed_off FROM l GROUP BY doc_id)
SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, round(coalesce(log_score, 0), {DIGITS}) AS log_score, round(log_score / n_tokens, {DIGITS}) AS mean_log_score, coalesce(backed_off, 0) AS backed_off
FROM documents LEFT JOIN t USING (doc_id)
"""
