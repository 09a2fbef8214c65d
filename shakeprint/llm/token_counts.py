"""Token counts: the pieces of each distinct pre-token, counted once, joined to each document's pre-token frequencies."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunk_cache import SPACES
from .common import by_chars, join_values, materialise_small, rows

LIMIT = 2048
#: Chunks that a worker keeps (about 300 bytes each), how long they are at most, and characters that are cut at once.
CACHE_CHUNKS, CHUNK_BYTES, BATCH_CHARS = 400_000, 64, 1_000_000
#: What an added token's name begins with in place of itself: no pre-token has white space.
ADDED = " "
LAST_SIGNS = re.compile(rb"(?<=[a-z])[!-/:-@\[-`{-~]+(?=[ \n])")
SIGNS = [*map(chr, (*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F))), "''", ",'.", "&&&"]
#: A word that stands behind others to tell them apart.
MARK = "\u2500"
#: White space inside a chunk, as any of the libraries sees it.
INNER = re.compile(f"[{SPACES}\x1c-\x1f]")


class PreTokens:
    """Cuts texts into the pre-tokens of a tokenizer file, as the library's own normaliser and pre-tokenizer make them.

    White space cuts a text into chunks that are independent of each other where the pre-tokenizer drops it; each chunk's
    pre-tokens are kept as codes. Elsewhere a text is one chunk. Added tokens are found in the text as they stand.
    """

    def __init__(self, path: str, limit: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that are found in normalised text, or with what is around them, aren't handled")
        names = sorted((t.content for t in added), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.in_bytes = re.compile(b"|".join(re.escape(n.encode()) for n in names)) if names else None
        self.mark = MARK
        cut = self._cut(f"a b\tc\nd é {MARK}")
        self.independent, self.mark_name = cut[:4] == ["a", "b", "c", "d"] and len(cut) == 6 and not any(re.search(r"\s", n) for n in names), cut[-1]
        self.signs_apart = self.independent and all(self._cut(f"ab{x} cd") == ["ab", x, "cd"] for x in SIGNS)
        self.small = self._cut("ABC XYZ") == self._cut("abc xyz")
        self.added_bytes = [n.encode() for n in names]
        self.known: dict[bytes, bytes] = {}
        self.names: list[str] = []
        self.code_of: dict[str, int] = {}

    def _cut(self, text: str) -> list[str]:
        if normalizer := self.tokenizer.normalizer:
            text = normalizer.normalize_str(text)
        if not text:
            return []
        cut = self.tokenizer.pre_tokenizer
        return [name for name, _ in cut.pre_tokenize_str(text)] if cut else [text]

    def of(self, text: str) -> list[str]:
        """The names of a text's pre-tokens, one after another."""
        parts = self.added.split(text) if self.added else [text]
        return [name for k, part in enumerate(parts) for name in ([ADDED + part] if k % 2 else self._cut(part))]

    def pieces(self, name: str) -> int:
        return 1 if name.startswith(ADDED) else len(self.tokenizer.model.tokenize(name))

    def _code(self, names) -> np.ndarray:
        out = []
        for name in names:
            if (code := self.code_of.get(name)) is None:
                code = self.code_of[name] = len(self.names)
                self.names.append(name)
            out.append(code)
        return np.array(out, "<u4")

    def _learn(self, chunks: list[bytes]) -> None:
        """Chunks without an added token or white space of any library go through the library together, with a marked
        word behind each; others go alone."""
        marked = self.mark.encode()
        plain = [c for c, text in zip(chunks, b" ".join(chunks).decode().split(" "), strict=True) if not INNER.search(text) and marked not in c and not (self.in_bytes and self.in_bytes.search(c))] if self.independent else []
        # Of ASCII the library tells a pre-token's place rightly, so a space is mark enough.
        plain.sort(key=bytes.isascii)
        first = next((k for k, c in enumerate(plain) if c.isascii()), len(plain))
        if first:
            codes = self._code(self._cut(" ".join(f"{c.decode()} {self.mark}" for c in plain[:first])))
            ends = np.flatnonzero(codes == self.code_of[self.mark_name])
            if len(ends) == first:
                self._keep(plain[:first], codes, [0, *(ends[:-1] + 1).tolist()], ends.tolist())
        if first < len(plain) and self.tokenizer.pre_tokenizer:
            joined = b" ".join(plain[first:]).decode()
            normal = self.tokenizer.normalizer.normalize_str(joined) if self.tokenizer.normalizer else joined
            if len(normal) == len(joined):
                found = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
                starts = np.cumsum([0, *(len(c) + 1 for c in plain[first:])])
                at = np.searchsorted(np.array([a for _, (a, _) in found], np.int64), starts).tolist()
                self._keep(plain[first:], self._code(name for name, _ in found), at[:-1], at[1:])
        self.known.update((c, self._code(self.of(c.decode())).tobytes()) for c in chunks if c not in self.known)

    def _chunks(self, text: bytes) -> list[bytes]:
        """Runs without white space, such that words are found again: where the pre-tokenizer does so, too, signs between
        a letter and white space stand apart, and letters are small (unless a mark follows that could join one)."""
        if self.signs_apart and not any(n in text for n in self.added_bytes):
            if self.small and b"\xcc" not in text and b"\xcd" not in text:
                small = text.lower()
                text = text if any(n in small for n in self.added_bytes) else small
            text = LAST_SIGNS.sub(rb" \g<0>", text)
        return text.split()

    def _keep(self, chunks: list[bytes], codes: np.ndarray, starts: list[int], ends: list[int]) -> None:
        blob = codes.tobytes()
        self.known.update((c, blob[4 * a : 4 * b]) for c, a, b in zip(chunks, starts, ends, strict=True))

    def frequencies(self, texts: list[str | None]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """For each text the end of its run in the two arrays that follow: names of its pre-tokens, and how often each occurs."""
        if len(self.known) > self.limit or len(self.names) > self.limit:
            self.known, self.names, self.code_of = {}, [], {}
        parts = [self._chunks((t or "").encode()) if self.independent else [t.encode()] if t else [] for t in texts]
        new = [c for c in set(chain.from_iterable(parts)) if c not in self.known]
        for at in range(0, len(new), 20_000):
            self._learn(new[at : at + 20_000])
        blobs = [b"".join(map(self.known.__getitem__, p)) for p in parts]
        for c in new:
            if len(c) > CHUNK_BYTES:
                del self.known[c]
        codes = np.frombuffer(b"".join(blobs), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(b) // 4 for b in blobs])
        keys, counts = np.unique(owner << 32 | codes, return_counts=True)
        used, at = np.unique(keys & 0xFFFFFFFF, return_inverse=True)
        names = pa.array([self.names[k] for k in used.tolist()], pa.string())
        return np.searchsorted(keys >> 32, np.arange(len(texts)), "right"), names.take(pa.array(at)), counts


@lru_cache(maxsize=1)
def pre_tokens(path: str) -> PreTokens:
    """One a worker."""
    return PreTokens(path)


def pre_token_frequencies(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, n_bytes, names, counts: each row's distinct pre-tokens and how often each occurs."""
    schema = T.StructType([T.StructField("_id", df.schema[id_col].dataType), *(T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("names", T.ArrayType(T.StringType())), ("counts", T.ArrayType(T.LongType()))))])

    def run(batches):
        cut = pre_tokens(path)
        for batch in batches:
            for some in by_chars(rows(batch), BATCH_CHARS):
                ends, names, counts = cut.frequencies([t for _, t, _ in some])
                ends = pa.array(np.concatenate([[0], ends]), pa.int32())
                columns = [pa.array([i for i, _, _ in some], batch.schema.field("id").type), pa.array([n for _, _, n in some], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, names), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))], names=schema.names)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n")).mapInArrow(run, schema)


def count_pieces(vocabulary: DataFrame, path: str) -> DataFrame:
    """vocabulary (name, total) with `pieces`, the tokens that each pre-token gives."""

    def run(batches):
        cut = pre_tokens(path)
        for batch in batches:
            yield batch.append_column("pieces", pa.array([cut.pieces(n) for n in batch.column("name").to_pylist()], pa.int64()))

    return vocabulary.select("name", "total").mapInArrow(run, "name string, total bigint, pieces bigint")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (more than limit tokens).

    tokenizer: a file of the tokenizers library. Added tokens that stand in a text count as one; none are added, and
    nothing is cut off. Null text counts as empty: no tokens. Repeated rows and null ids are kept as they are; an empty
    table gives no rows. Other columns are not read, whatever their names.

    Each text is cut into pre-tokens once, in its own partition, and its distinct ones are stored. Their vocabulary is
    grouped in each task before it is shuffled; frequent pre-tokens go back by broadcast, others by shuffle.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    stored = materialise_small(pre_token_frequencies(df, path, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()))
    listed = stored.select("_row", F.explode(F.arrays_zip("names", "counts")).alias("p")).select("_row", F.col("p.names").alias("name"), F.col("p.counts").alias("n"))
    counted = materialise_small(count_pieces(listed.groupBy("name").agg(F.sum("n").alias("total")), path))
    sums = join_values(listed, counted, "name", "total").groupBy("_row").agg(F.sum(F.col("n") * F.col("pieces")).alias("n_tokens"))
    out = stored.select("_row", "_id", "n_bytes").join(sums, "_row", "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
