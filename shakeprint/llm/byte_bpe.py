"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, and decoding through the byte table."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunk_cache import ChunkCache, byte_bpe
from .common import by_chars, rows

BATCH_CHARS = 1_000_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else the next one from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The bytes of each id of a rank file."""
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, open(path, "rb")))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be gapless")
    return [t for _, t in pairs]


def tokenizer_of(tokens: list[bytes], pattern: str):
    """A tokenizers.Tokenizer that merges as the ranks say: of all adjacent pairs whose join is a token, the one of the
    lowest rank goes first."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    shown = byte_characters()
    name = ["".join(shown[b] for b in t) for t in tokens]
    known = set(name)
    merges = [(n[:k], n[k:]) for n in name for k in range(1, len(n)) if n[:k] in known and n[k:] in known]
    tok = Tokenizer(models.BPE(vocab={n: i for i, n in enumerate(name)}, merges=merges))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok


class Codec:
    """encode: texts to id bytes (little-endian unsigned 32-bit). decode: id bytes to the text's bytes, by way of the
    characters that stand for them."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        self.tokens = read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        shown = byte_characters()
        self.names = ["".join(shown[b] for b in t) for t in self.tokens]
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.byte_of = np.zeros(512, np.uint8)
        self.byte_of[[ord(c) for c in shown]] = np.arange(256)
        self.tokenizer = tokenizer_of(self.tokens, pattern or public_tokenizers.PATTERN)
        self.cache: ChunkCache = byte_bpe(self.tokenizer)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.cache.ids(texts)

    def decode(self, ids: bytes) -> bytes:
        characters = "".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return self.byte_of[np.frombuffer(characters.encode("utf-32-le"), "<u4")].tobytes()

    def decode_stream(self, ids: bytes, size: int = 4096):
        """The text in parts of about size ids; a character whose bytes lie in two parts comes whole with the later."""
        import codecs

        reader = codecs.getincrementaldecoder("utf-8")("replace")
        for at in range(0, len(ids), 4 * size):
            if part := reader.decode(self.decode(ids[at : at + 4 * size]), at + 4 * size >= len(ids)):
                yield part

    def starts(self, ids: bytes) -> np.ndarray:
        """The first byte of each id in the decoded bytes."""
        size = self.sizes[np.frombuffer(ids, "<u4")]
        return np.cumsum(size) - size

    def offsets(self, ids: bytes) -> list[tuple[int, int]]:
        """The (first, end) byte of each id in the decoded bytes."""
        first = self.starts(ids)
        return list(zip(first.tolist(), (first + self.sizes[np.frombuffer(ids, "<u4")]).tolist(), strict=True))

    def split_tokens(self, ids: bytes, decoded: bytes) -> int:
        """How many ids begin within a character that an earlier one began."""
        return int((np.frombuffer(decoded, np.uint8)[self.starts(ids)] & 0xC0 == 0x80).sum())


@lru_cache(maxsize=2)
def codec_of(path: str | None, pattern: str | None) -> Codec:
    """One a worker."""
    return Codec(path, pattern)


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, keep_ids: bool = False, splits: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256 (and with keep_ids the ids as binary `ids`, with
    splits split_tokens: how many ids begin within a character).

    Null text counts as empty: no tokens, digests of nothing. Repeated rows and null ids are kept as they are; an empty
    table gives no rows. Each partition streams its own rows; nothing is shuffled. Other columns are not read.
    """
    names = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    names += [("ids", T.BinaryType(), pa.binary())] * keep_ids + [("split_tokens", T.LongType(), pa.int64())] * splits
    schema = T.StructType([df.schema[id_col], *(T.StructField(n, t) for n, t, _ in names)])

    def run(batches):
        codec = codec_of(path, pattern)
        for batch in batches:
            for some in by_chars(rows(batch), BATCH_CHARS):
                ids = codec.encode([t for _, t in some])
                decoded = [codec.decode(x) for x in ids]
                columns = [
                    [len(x) // 4 for x in ids],
                    [hashlib.sha256(x).hexdigest() for x in ids],
                    [hashlib.sha256(x).hexdigest() for x in decoded],
                    *([ids] * keep_ids),
                    *([list(map(codec.split_tokens, ids, decoded))] if splits else []),
                ]
                arrays = [pa.array([i for i, _ in some], batch.schema.field("id").type), *(pa.array(c, t) for c, (_, _, t) in zip(columns, names, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
