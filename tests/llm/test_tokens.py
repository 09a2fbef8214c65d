import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shakeprint.llm import byte_bpe, chunk_cache, packing, queries

CODEC = byte_bpe.Codec()
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(CODEC.tokens)}, special_tokens={})
WORDS = Tokenizer.from_file(P.path("word_bpe_49k.json"))
WORDS.encode_special_tokens = True
TEXT = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" \n\t\r\x0b\x1c\x85\xa0 'sabZ.,!1²İẞñ́😀"))), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_byte_bpe_is_tiktoken(text):
    ids = CODEC.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == TIKTOKEN.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()
    assert "".join(CODEC.decode_stream(ids, 2)) == text
    spans = CODEC.offsets(ids)
    assert [text.encode()[a:b] for a, b in spans] == [CODEC.tokens[i] for i in np.frombuffer(ids, "<u4")]
    first_bytes = {len(text[:k].encode()) for k in range(len(text))}
    assert CODEC.split_tokens(ids, text.encode()) == sum(a not in first_bytes for a, _ in spans)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_chunked_word_bpe_is_the_library(text):
    cache = chunk_cache.word_bpe(P.path("word_bpe_49k.json"))
    assert np.frombuffer(cache.ids([text])[0], "<u4").tolist() == WORDS.encode(text, add_special_tokens=False).ids


def test_encode_decode_rows(odd_docs, no_docs):
    clash = odd_docs.withColumns({"n_tokens": F.lit(1), "id": F.lit(2)})
    got = sorted(map(tuple, byte_bpe.encode_decode(clash).collect()), key=str)
    want = []
    for r in odd_docs.collect():
        ids = np.array(TIKTOKEN.encode_ordinary(r.text or ""), "<u4").tobytes()
        want.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert byte_bpe.encode_decode(no_docs).count() == 0


def check_pieces(pieces, texts, capacity, segments=packing.SEGMENTS):
    """Every id lies in one piece, and sequences are gapless and need no padding."""
    ids = {k: np.array(WORDS.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for k, t in texts.items()}
    at, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        at[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    assert set(at) == set(ids)
    for k, own in at.items():
        place = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == place and p.length > 0 and p.doc_tokens == len(ids[k])
            assert p.ids_crc32 == zlib.crc32(ids[k][place : place + p.length].tobytes())
            place += p.length
        assert place == len(ids[k])
    for own in sequences.values():
        place = 0
        for offset, length in sorted(own):
            assert offset == place
            place += length
        assert place <= capacity and place & (place - 1) == 0 and len(own) <= segments


def test_packing_rows(spark, odd_docs, no_docs):
    texts = {k: t for k, t in enumerate([r.text for r in odd_docs.collect()] + ["x"] * 700)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"start": F.lit(1), "id": F.lit(2), "prompt": F.lit("p")}).coalesce(2)
    check_pieces(packing.pack(df).collect(), texts, 2048)
    check_pieces(packing.pack(df, max_segments=5).collect(), texts, 2048, 5)
    assert packing.pack(no_docs).count() == 0
    # repeated ids and null ids are packed, too
    assert packing.pack(odd_docs).where("start = 0").count() == odd_docs.count()


def test_packing_limits():
    """Loss-bearing tokens, segments and tokens stay within their limits at once."""
    rng = np.random.default_rng(0)
    packer = packing.Packer(256, 6, 100)
    examples = [packing.Example(k, np.full(int(n), k, "<u4").tobytes(), int(rng.integers(0, n + 1))) for k, n in enumerate(rng.integers(1, 400, 300))]
    sequences = [s for e in examples for s in packer.add(e)] + list(packer.pack())
    assert sum(n for s in sequences for _, _, n in s) == sum(e.total for e in examples)
    for s in sequences:
        total = sum(n for _, _, n in s)
        loss = sum(max(0, a + n - max(a, e.prompt)) for e, a, n in s)
        assert total <= 256 and total & (total - 1) == 0 and len(s) <= 6 and loss <= 100


def bearing(j, prompt, turn, asked):
    return j >= prompt and (j - prompt) % turn >= asked


def brute_packing(sizes, prompts, capacity, segments, loss, turn, asked):
    """The documented heuristic on plain numbers: all examples wait, and one piece at a time is chosen."""
    at, out = [0] * len(sizes), []
    while any(a < n for a, n in zip(at, sizes, strict=True)):
        free, pieces = [capacity, segments, loss], []
        while free[0] and free[1]:
            options = []
            for k, (a, size, prompt) in enumerate(zip(at, sizes, prompts, strict=True)):
                n = bears = 0
                while n < min(size - a, free[0]) and bears + bearing(a + n, prompt, turn, asked) <= free[2]:
                    bears += bearing(a + n, prompt, turn, asked)
                    n += 1
                if n > 0:
                    product = n * (free[0] / capacity**2) + free[1] / segments**2 + bears * (free[2] / loss**2)
                    options.append((n == size - a, product, -k, n, bears))
            if not options:
                break
            _, _, k, n, bears = max(options)
            pieces.append([-k, at[-k], n])
            at[-k] += n
            free = [free[0] - n, free[1] - 1, free[2] - bears]
        total = sum(n for _, _, n in pieces)
        back = total - max(1 << j for j in range(20) if 1 << j <= total)
        for p in reversed(pieces):
            cut = min(back, p[2])
            p[2] -= cut
            at[p[0]] -= cut
            back -= cut
        out.append([tuple(p) for p in pieces if p[2]])
    return out


def test_packing_places_as_brute_force():
    """Every piece, in every sequence, where all three limits bind."""
    rng = np.random.default_rng(1)
    for capacity, segments, loss, turn, asked in ((64, 3, 40, 1, 0), (32, 32, 20, 1, 0), (128, 5, 128, 1, 0), (16, 2, 1, 1, 0), (64, 4, 40, 10, 3), (32, 3, 28, 8, 1)):
        sizes = rng.integers(1, 60, 60).tolist() + [1] * 20 + [7] * 9
        prompts = [int(rng.integers(0, n + 1)) if k % 3 else 0 for k, n in enumerate(sizes)]
        packer = packing.Packer(capacity, segments, loss, packing.Mask(turn, asked))
        packer.pool = [packing.Example(k, np.full(n, k, "<u4").tobytes(), p) for k, (n, p) in enumerate(zip(sizes, prompts, strict=True))]
        packer.waiting = sum(sizes)
        got = [[(e.key, a, n) for e, a, n in s] for s in packer.pack()]
        assert got == brute_packing(sizes, prompts, capacity, segments, loss, turn, asked)


def test_packing_query_keeps_three_limits(spark, sf_dir):
    """On the tables: loss-bearing tokens by the stated prompt rule stay within their limit, and often reach it."""
    sequences = defaultdict(list)
    for p in queries.op2_packing(spark, sf_dir).collect():
        loss = sum(bearing(j, 0, packing.TURN, packing.ASKED) for j in range(p.start, p.start + p.length))
        assert loss == p.loss_tokens
        sequences[p.sequence_id].append((p.length, loss))
    found = [(sum(n for n, _ in s), len(s), sum(x for _, x in s)) for s in sequences.values()]
    assert all(n <= packing.CAPACITY and k <= packing.SEGMENTS and x <= packing.LOSS for n, k, x in found)
    assert np.mean([x == packing.LOSS for _, _, x in found]) > 0.1 and np.mean([n == packing.CAPACITY for n, _, _ in found]) > 0.8
