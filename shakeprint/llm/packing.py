"""Packing of tokenised examples into training sequences: vector bin packing by the dot-product heuristic."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunk_cache import CACHE_CHUNKS, word_bpe
from .common import by_chars, rows

#: Limits of a sequence: tokens, segments, and tokens that bear loss.
CAPACITY, SEGMENTS, LOSS = 2048, 64, 1792
#: Where no column has the prompt, a document is read as a dialogue: of each TURN tokens, the first ASKED ask, and bear
#: no loss, and the others answer.
TURN, ASKED = 256, 32
#: The id that ends each example.
END_ID = 1
#: Tokens and examples that wait in a worker to be packed with others, and characters tokenised at once.
POOL_TOKENS, POOL_EXAMPLES, BATCH_CHARS = 1 << 17, 4096, 2_000_000


@dataclass
class Example:
    """ids: little-endian unsigned 32-bit. The first `prompt` tokens bear no loss. start: tokens already placed."""

    key: object
    ids: bytes
    prompt: int = 0
    start: int = 0

    @property
    def total(self) -> int:
        return len(self.ids) // 4

    @property
    def left(self) -> int:
        return self.total - self.start


@dataclass(frozen=True)
class Mask:
    """Which tokens bear loss: behind the prompt, of each `turn` tokens all but the first `asked`. Numbers or arrays."""

    turn: int = 1
    asked: int = 0

    def upto(self, x, prompt):
        """Loss-bearing ones among the first x tokens."""
        turns, rest = np.divmod(np.maximum(x - prompt, 0), self.turn)
        return turns * (self.turn - self.asked) + np.maximum(rest - self.asked, 0)

    def reach(self, loss, prompt):
        """The most first tokens that have so many loss-bearing ones."""
        turns, rest = np.divmod(loss, self.turn - self.asked)
        return prompt + turns * self.turn + self.asked + rest


def power(n: int) -> int:
    """The largest power of two up to n."""
    return 1 << (n.bit_length() - 1)


class Packer:
    """Fills one sequence after another. A sequence takes, of the examples that fit whole in what is left of every
    limit, the one whose demand vector (tokens, segments, loss-bearing tokens; as shares of the limits) has the
    largest dot product with the vector of what is left; if none fits whole, of the beginnings that fit the one with
    the largest product. Of equal products, the example that came first counts. A sequence that nothing more fits in
    is cut back to a power of two tokens, which needs no padding."""

    def __init__(self, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int = LOSS, mask: Mask | None = None):
        if min(capacity, segments, loss) < 1 or capacity & (capacity - 1):
            raise ValueError("limits are positive, and the capacity is a power of two")
        self.capacity, self.segments, self.loss, self.mask = capacity, segments, loss, mask or Mask()
        self.pool: list[Example] = []
        self.waiting = 0

    def bears(self, e: Example, n: int) -> int:
        """Loss-bearing ones among the next n tokens."""
        return int(self.mask.upto(e.start + n, e.prompt) - self.mask.upto(e.start, e.prompt))

    def add(self, example: Example) -> Iterator[list[tuple[Example, int, int]]]:
        """Sequences as lists of (example, start, length); whole sequences of a long example need no search."""
        while example.left >= self.capacity and self.bears(example, self.capacity) <= self.loss:
            yield [(example, example.start, self.capacity)]
            example.start += self.capacity
        if example.left:
            self.pool.append(example)
            self.waiting += example.left
        if self.waiting >= POOL_TOKENS or len(self.pool) >= POOL_EXAMPLES:
            yield from self.pack(self.waiting // 8)

    def pack(self, keep: int = 0) -> Iterator[list[tuple[Example, int, int]]]:
        """Packs what waits until at most keep tokens (and less than a sequence) do."""
        pool = self.pool
        start, stop, prompt = (np.array([x(e) for e in pool], np.int64) for x in (lambda e: e.start, lambda e: e.total, lambda e: e.prompt))
        told = self.mask.upto(start, prompt)
        while self.waiting > keep:
            tokens, segments, loss, bin_ = self.capacity, self.segments, self.loss, []
            while tokens and segments:
                n = np.minimum(np.minimum(stop, self.mask.reach(told + loss, prompt)) - start, tokens)
                bears = self.mask.upto(start + n, prompt) - told
                product = n * (tokens / self.capacity**2) + segments / self.segments**2 + bears * (loss / self.loss**2)
                product[n < 1] = -1.0
                whole = np.where(start + n == stop, product, -1.0)
                k = int(whole.argmax())
                if whole[k] < 0:
                    k = int(product.argmax())
                    if product[k] < 0:
                        break
                bin_.append((k, int(start[k]), int(n[k])))
                tokens, segments, loss = tokens - int(n[k]), segments - 1, loss - int(bears[k])
                start[k] += n[k]
                told[k] += bears[k]
            total = self.capacity - tokens
            back = total - power(total)
            self.waiting -= total - back
            while back:  # tokens of the last pieces return to wait
                k, at, n = bin_.pop()
                cut = min(back, n)
                start[k] -= cut
                told[k] = self.mask.upto(start[k], prompt[k])
                back -= cut
                if n > cut:
                    bin_.append((k, at, n - cut))
            yield [(pool[k], at, n) for k, at, n in bin_]
        for e, at in zip(pool, start.tolist(), strict=True):
            e.start = at
        self.pool = [e for e in pool if e.left]


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, tokenizer: str | None = None,
    capacity: int = CAPACITY, max_segments: int = SEGMENTS, max_loss: int = LOSS, end_id: int = END_ID,
    cache_chunks: int = CACHE_CHUNKS,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    Each input partition packs its own rows as they stream by, with a bounded pool, so nothing is shuffled and a lost
    task is repeated alone with the same result; sequence_id holds the partition's number above 2**36. Every sequence
    has a power of two tokens, `capacity` wherever the limits let it, so none is padded.

    Null text counts as empty: its only token is end_id. Tokens of prompt_col come first and bear no loss; without that
    column documents count as dialogues (TURN, ASKED). Repeated
    rows and repeated ids are packed separately; null ids are kept. An empty table gives no rows. Other columns are
    not read, whatever their names. cache_chunks: words whose ids a worker keeps, about 200 bytes each.
    """
    mask = Mask() if prompt_col else Mask(TURN, ASKED)
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    id_type = df.schema[id_col].dataType
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    schema = T.StructType([T.StructField(id_col, id_type), *(T.StructField(x, T.LongType()) for x in names)])
    cols = [F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(prompt_col) if prompt_col else F.lit(None).cast("string")).alias("prompt")]

    def run(batches):
        cache, packer = word_bpe(path, cache_chunks), Packer(capacity, max_segments, max_loss, mask)
        end = np.array([end_id], "<u4").tobytes()
        first, number, placed = TaskContext.get().partitionId() << 36, 0, []

        def note(sequences):
            nonlocal number
            for pieces in sequences:
                offset = 0
                for e, start, n in pieces:
                    crc = zlib.crc32(e.ids[4 * start : 4 * (start + n)])
                    loss = int(mask.upto(start + n, e.prompt) - mask.upto(start, e.prompt))
                    placed.append((e.key, start, n, crc, e.total, first + number, offset, loss))
                    offset += n
                number += 1

        def flush():
            columns = zip(*placed, strict=True) if placed else [[]] * 8
            arrays = [pa.array(c, t) for c, t in zip(map(list, columns), [id_arrow, *[pa.int64()] * 7], strict=True)]
            placed.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[id_col, *names])

        id_arrow = pa.int64()
        for batch in batches:
            id_arrow = batch.schema.field("id").type
            for some in by_chars(rows(batch), BATCH_CHARS):
                texts = cache.ids([t for _, t, _ in some])
                prompts = cache.ids([p for _, _, p in some]) if prompt_col else [b""] * len(some)
                for (key, _, _), ids, prompt in zip(some, texts, prompts, strict=True):
                    note(packer.add(Example(key, prompt + ids + end, len(prompt) // 4)))
                if placed:
                    yield flush()
        note(packer.pack())
        cache.latest = []
        if placed:
            yield flush()

    return df.select(*cols).mapInArrow(run, schema)
