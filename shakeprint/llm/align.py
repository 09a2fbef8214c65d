"""Cross-tokenizer alignment: tokens of two tokenizers linked where their bytes overlap, in minimal groups, with counts of
how often each pair of ids is linked in the whole corpus."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import byte_characters
from .chunk_cache import SPACES
from .common import by_chars, join_values, materialise, materialise_small, rows

#: Chunks that a worker keeps (about 500 bytes each), how long they are at most, and characters that are aligned at once.
CACHE_CHUNKS, CHUNK_CHARS, BATCH_CHARS = 200_000, 64, 1_000_000
#: Fixed value: how a piece shows a space.
SHOWN_SPACE = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
#: A word, perhaps behind one space.
WORD = re.compile(f" ?[^{SPACES}]+")
#: A pair of ids as one number: the first tokenizer's id above PAIR_BITS bits of the second's.
PAIR_BITS = 20


def roots(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Union-find over `count` nodes and the edges (left, right), all edges at once: the larger root hooks onto the smaller
    one, and paths are halved until each node points at its component's smallest."""
    parent = np.arange(count)
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens (by number) of each overlap of two cuts of the same bytes. Between two neighbouring ends of either cut
    lies one token of each, and no pair of tokens shares two such stretches."""
    last = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, last), np.searchsorted(ends_b, last)


class ByteLevel:
    """A byte-level BPE file of the tokenizers library, whose added tokens' names are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        names = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        self.bytes = [bytes(byte_of[c] for c in n) if all(c in byte_of for c in n) else n.encode() for n in names]

        newline = self.tok.encode("\n", add_special_tokens=False).ids
        if self.tok.normalizer or len(newline) != 1:
            raise ValueError("the first tokenizer has no normaliser, and a newline of its own")
        self.newline = newline[0]

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks one after another, and how many each has. Words behind one space, or none, go through the
        library together, with newlines between them that no id crosses."""
        word = np.array([WORD.fullmatch(c) is not None for c in chunks])
        some = [c for c, w in zip(chunks, word.tolist(), strict=True) if w]
        other = [c for c, w in zip(chunks, word.tolist(), strict=True) if not w]
        counts = np.zeros(len(chunks), np.int64)
        flat = np.array(self.tok.encode_batch_fast(["\n".join(some) + "\n"], add_special_tokens=False)[0].ids if some else [], np.int64)
        ends = np.flatnonzero(flat == self.newline)
        counts[word] = np.diff(ends, prepend=-1) - 1
        alone = [e.ids for e in self.tok.encode_batch_fast(other, add_special_tokens=False)]
        counts[~word] = [len(x) for x in alone]
        out = np.empty(counts.sum(), np.int64)
        mine = np.repeat(word, counts)
        out[mine] = flat[flat != self.newline]
        out[~mine] = np.fromiter(chain.from_iterable(alone), np.int64)
        return out, counts


class Pieces:
    """A SentencePiece model; the space that it puts before a text is left out, since the text has it."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            # Fixed value: the last words of a message win; these set its normaliser's add_dummy_prefix (3.3) to false.
            self.model = sentencepiece.SentencePieceProcessor(model_proto=f.read() + b"\x1a\x02\x18\x00")
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) and self.model.is_byte(i) else p.replace(SHOWN_SPACE, " ").encode() for i, p in enumerate(self.pieces)]

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks one after another, and how many each has."""
        ids = self.model.encode(chunks, num_threads=1)
        return np.fromiter(chain.from_iterable(ids), np.int64), np.array([len(x) for x in ids], np.int64)


def cut_pattern(pieces: list[str]) -> re.Pattern:
    """Chunks that both tokenizers treat independently: cut before a space, tab or newline that follows other text, where
    no piece has that character after such text."""
    shown = {" ": SHOWN_SPACE, "\t": "\t", "\n": "\n"}
    cuts = "".join(c for c, s in shown.items() if not any(re.search(f"[^{SPACES}{SHOWN_SPACE}]{s}", p) for p in pieces))
    if not cuts:
        return re.compile(".+", re.DOTALL)
    inner = f"(?:(?![{re.escape(cuts)}])[{SPACES}][{SPACES}]*[^{SPACES}]*)*"
    return re.compile(f"[{SPACES}]*[^{SPACES}]+{inner}|[{SPACES}]+")


class Aligner:
    """Aligns texts by two tokenizers, each distinct chunk once while it is kept. Both cut at a chunk's end, so groups
    and links never lie across."""

    def __init__(self, a: str, b: str, limit: int = CACHE_CHUNKS):
        self.a, self.b, self.limit = ByteLevel(a), Pieces(b), limit
        self.sizes = [np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b)]
        if len(self.b.bytes) > 1 << PAIR_BITS:
            raise ValueError(f"the second tokenizer has at most {1 << PAIR_BITS} ids")
        self.cut = cut_pattern(self.b.pieces)
        # An id's text with what follows it: "," within a side, "|" between sides, ";" behind a group.
        self.shown = [np.array([[f"{i}{mark}" for mark in marks] for i in range(len(side.bytes))], object) for side, marks in ((self.a, ",|"), (self.b, ",;"))]
        #: Of each chunk: the groups' text, the linked pairs as numbers, its tokens a side; None if the bytes differ.
        self.known: dict[str, tuple[str, bytes, int, int] | None] = {}

    def _learn(self, chunks: list[str]) -> None:
        self.known.update(dict.fromkeys(chunks))
        raw = [c.encode() for c in chunks]
        b_ids, b_counts = self.b.encode(chunks)
        # The first tokenizer spells every chunk; the second is compared, chunk by chunk if it leaves anything out.
        if b"".join(map(self.b.bytes.__getitem__, b_ids.tolist())) != b"".join(raw) or (b_counts == 0).any():
            at = np.cumsum([0, *b_counts]).tolist()
            good = [k for k, want in enumerate(raw) if b"".join(map(self.b.bytes.__getitem__, b_ids[at[k] : at[k + 1]].tolist())) == want]
            chunks = [chunks[k] for k in good]
            if not chunks:
                return
            b_ids, b_counts = self.b.encode(chunks)
        flat, counts = zip(self.a.encode(chunks), (b_ids, b_counts), strict=True)
        ends = [np.cumsum(size[ids]) for ids, size in zip(flat, self.sizes, strict=True)]
        first, second = overlaps(*ends)
        n = len(flat[0])
        root = roots(n + len(flat[1]), first, second + n)
        # A component's root is its smallest first token, so roots are in the text's order; in each, first tokens go first.
        key = root * 2 + np.repeat([0, 1], [n, len(flat[1])])
        order = np.argsort(key, kind="stable")
        last = np.empty(len(key), np.int64)
        last[order] = np.append(np.diff(key[order]) != 0, True)
        shown = np.concatenate([self.shown[0][flat[0], last[:n]], self.shown[1][flat[1], last[n:]]])[order].tolist()
        pairs = (flat[0][first] << PAIR_BITS | flat[1][second]).astype("<i8")
        tokens = np.cumsum([0, *(counts[0] + counts[1])]).tolist()
        links = np.searchsorted(first, np.cumsum([0, *counts[0]])).tolist()
        blob = pairs.tobytes()
        for k, (chunk, a, b) in enumerate(zip(chunks, counts[0].tolist(), counts[1].tolist(), strict=True)):
            self.known[chunk] = ("".join(shown[tokens[k] : tokens[k + 1]]), blob[8 * links[k] : 8 * links[k + 1]], a, b)

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, str, bytes]]:
        """Of each text: tokens a side, groups, the digest of the groups, and the linked pairs as 64-bit integers."""
        if len(self.known) > self.limit:
            self.known = {}
        parts = [self.cut.findall(" " + t) if t else [] for t in texts]
        new = [c for c in set(chain.from_iterable(parts)) if c not in self.known]
        for at in range(0, len(new), 20_000):
            self._learn(new[at : at + 20_000])
        out = []
        for chunks in parts:
            found = list(map(self.known.__getitem__, chunks))
            # No piece has more bytes than what it stands for, so what one chunk lacks, no other makes up for.
            if not found or None in found:
                out.append((0, 0, 0, "", b""))
                continue
            groups, pairs, a, b = zip(*found, strict=True)
            text = "".join(groups)
            out.append((sum(a), sum(b), text.count(";"), hashlib.sha256(text[:-1].encode()).hexdigest(), b"".join(pairs)))
        for c in new:
            if len(c) > CHUNK_CHARS:
                del self.known[c]
        return out


@lru_cache(maxsize=1)
def aligner(a: str, b: str) -> Aligner:
    """One a worker."""
    return Aligner(a, b)


def aligned(df: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, counts: the distinct linked pairs of ids of each row, as
    numbers, and how often each is linked in it."""
    longs = ("n_a", "n_b", "n_groups", "n_links")
    schema = T.StructType([
        T.StructField("_id", df.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in longs), T.StructField("groups_sha256", T.StringType()),
        T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.IntegerType())),
    ])

    def run(batches):
        align = aligner(a, b)
        for batch in batches:
            for some in by_chars(rows(batch), BATCH_CHARS):
                found = align.align([t for _, t in some])
                n_a, n_b, groups, digests, blobs = map(list, zip(*found, strict=True))
                unique = [np.unique(np.frombuffer(x, "<i8"), return_counts=True) for x in blobs]
                ends = pa.array(np.cumsum([0, *(len(x) for x, _ in unique)]), pa.int32())
                pairs, counts = (np.concatenate([x[k] for x in unique]) for k in (0, 1))
                columns = [pa.array([i for i, _ in some], batch.schema.field("id").type), *(pa.array(x, pa.int64()) for x in (n_a, n_b, groups, [len(x) // 8 for x in blobs])), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, pa.array(pairs)), pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32)))], names=schema.names)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """links (pair, n) to pair, total, best: how often each pair is linked in all, and whether none of the same second id
    is linked more often."""
    counted = links.groupBy("pair").agg(F.sum("n").alias("total"))
    second = F.col("pair").bitwiseAND((1 << PAIR_BITS) - 1)
    counted = materialise_small(counted.withColumn("_b", second))
    most = counted.groupBy("_b").agg(F.max("total").alias("_most"))  # a row an id: at most 1 << PAIR_BITS
    return counted.join(F.broadcast(most), "_b").select("pair", "total", (F.col("total") == F.col("_most")).cast("long").alias("best"))


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    a: a byte-level file of the tokenizers library; b: a SentencePiece model. Null and empty texts, and texts that the
    pieces of b don't spell, have no tokens: zeros and ''. Repeated rows and null ids are kept as they are and count each;
    an empty table gives no rows. Other columns are not read, whatever their names.

    Each text is encoded once, in its own partition, and its distinct pairs are stored. Pairs are counted in each task
    before they are shuffled; counts of frequent pairs go back by broadcast, others by shuffle.
    """
    a, b = a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")
    stored = materialise(aligned(df, a, b, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()))
    links = stored.select("_row", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("_row", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    counted = materialise_small(pair_counts(links))
    found = join_values(links, counted.withColumn("count", F.col("total")), "pair", "total")
    sums = found.groupBy("_row").agg(F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    out = stored.drop("pairs", "counts").join(sums, "_row", "left")
    return out.select(F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
