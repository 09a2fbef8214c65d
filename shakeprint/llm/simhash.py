"""SimHash near-duplicates: 64-bit fingerprints linked at three bits or fewer through Golay-code fuzzy hashing."""

from __future__ import annotations

from itertools import permutations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import materialise_at, remove
from ..operators.components import components
from .common import attach_by_share, by_chars, default_salts, materialise, rows
from .golay import around, nearest

SHINGLE_WORDS, SEED, BITS = 3, 42, 3
#: (first bit, width) of the segments; each is padded to 23 bits with zeros.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
BATCH_CHARS = 1_000_000
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, words_each: int = SHINGLE_WORDS, seed: int = SEED) -> list[int]:
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= words_each:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    spans = map(slice, starts[: len(words) - words_each + 1], (ends[words_each - 1 :] - 1).tolist())
    return list(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(seed)))


def fingerprints(texts: list[str | None], words_each: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """Bit k of a fingerprint is 1 if bit k is 1 in over half of the text's shingle hashes; no words: zero."""
    hashes = [shingle_hashes(t, words_each, seed) for t in texts]
    count = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(count.sum()))
    # Eight counters a word, one byte each: runs of at most 255 hashes can't overflow them.
    first = np.concatenate([[0], np.cumsum(count[full])])
    runs = [np.arange(a, b, 255) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    of_doc = np.repeat(np.arange(len(full)), [len(r) for r in runs])
    starts = np.concatenate(runs)
    doc_starts = np.searchsorted(of_doc, np.arange(len(full)))
    value = np.zeros(len(full), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat(flat >> np.uint64(k) & _LANES, starts)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), doc_starts, axis=0)
        most = (2 * ones > count[full][:, None]).astype(np.uint64)
        value |= (most << (8 * np.arange(8, dtype=np.uint64) + np.uint64(k))).sum(1, dtype=np.uint64)
    out[full] = value
    return out


def probe_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of fingerprint, key, whether it asks) rows: a fingerprint that asks shares a key with each kept one at
    three bits or fewer.

    Three errors over three segments leave either one segment equal and another with at most one error, or one error
    in each. A word at one error decodes to a codeword near the asking one, so the first case is found under (an equal
    segment, the codeword index of another), and the second under the indices of the first two segments.
    """
    part = [(fps >> np.uint64(a) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in SEGMENTS]
    index = [nearest(p).astype(np.int64) for p in part]
    near = [around(p, w) for p, (_, w) in zip(part, SEGMENTS, strict=True)]
    own = np.arange(len(fps))
    at, keys, asks = [], [], []
    for case, (i, j) in enumerate(permutations(range(3), 2)):
        base = np.int64(case) << 40 | part[i] << 12
        at.append(own), keys.append(base | index[j]), asks.append(np.zeros(len(fps), bool))
        row, col = np.nonzero(near[j] >= 0)
        at.append(row), keys.append(base[row] | near[j][row, col]), asks.append(np.ones(len(row), bool))
    base = np.int64(6) << 40
    at.append(own), keys.append(base | index[0] << 12 | index[1]), asks.append(np.zeros(len(fps), bool))
    row, col = np.nonzero(near[0] >= 0)
    first = near[0][row, col]
    row2, col2 = np.nonzero(near[1][row] >= 0)
    at.append(row[row2]), keys.append(base | first[row2] << 12 | near[1][row[row2], col2]), asks.append(np.ones(len(row2), bool))
    return np.concatenate(at), np.concatenate(keys), np.concatenate(asks)


def with_fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text as a signed long."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            for some in by_chars(rows(batch), BATCH_CHARS):
                fps = fingerprints([t for _, t in some], words_each, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], batch.schema.field(0).type), pa.array(fps)], names=["id", "fp"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (left, right) of the distinct fingerprints fp at three bits or fewer, left < right."""

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for k in range(0, len(fps), 10_000):
                at, keys, asks = probe_keys(fps[k : k + 10_000].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[k : k + 10_000][at]), pa.array(asks)], names=["key", "fp", "asks"])

    # Each fingerprint makes some sixty rows, so a few files of fingerprints are spread over all tasks first.
    spread = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    keys = spread.mapInArrow(run, "key long, fp long, asks boolean")
    asking = keys.where("asks").select("key", F.col("fp").alias("left"))
    kept = keys.where("not asks").select("key", F.col("fp").alias("right"))
    near = F.bit_count(F.col("left").bitwiseXOR(F.col("right"))) <= BITS
    return asking.join(kept, (asking["key"] == kept["key"]) & (F.col("left") < F.col("right")) & near).select("left", "right").distinct()


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = SHINGLE_WORDS, seed: int = SEED, salts: int | None = None) -> DataFrame:
    """One row per input row: id, fingerprint (16 lowercase hex digits), component_id (the smallest id reachable).

    Equal fingerprints collapse to one before anything is joined, so copies cost no pairs. Keys are joined by shuffle
    and verified inside the join; only verified pairs leave it. Components are found in DataFrame rounds over the
    pairs of distinct fingerprints; nothing is collected.

    Null text counts as empty. Texts of no words have fingerprint zero and are linked like any other; fewer words than
    a shingle has make one shingle. Null ids are placed in components but never name one unless all are null. Rows
    that repeat an id count as one node for each fingerprint. An empty table gives no rows. Other columns are not read.
    """
    salts = salts or default_salts(df.sparkSession)
    docs = materialise(with_fingerprint(df, id_col, text_col, words_each, seed))
    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
    shares = docs.groupBy("fp", salt.alias("salt")).agg(F.min("id").alias("low"))
    distinct = materialise(shares.groupBy("fp").agg(F.min("low").alias("low")))
    pairs, path = materialise_at(links(distinct))
    # Fingerprints are the nodes; a component's name is the smallest id among its fingerprints'.
    member = components(pairs.select(F.col("left").alias("a"), F.col("right").alias("b")))
    remove(df.sparkSession, path)  # components() has stored its own edges
    named = distinct.join(member.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = named.join(lowest, "component").select("fp", "component_id")
    out = attach_by_share(docs, classes, "fp", salt, salts, "inner")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component_id"))
