"""Token ids of texts through a bounded cache of chunks that a tokenizer treats independently."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate, chain
from unicodedata import is_normalized

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks that one worker keeps (about 200 bytes each); beyond that only those of the latest texts stay.
CACHE_CHUNKS = 1_000_000


class ChunkCache:
    """Encodes texts chunk by chunk, each distinct chunk once while it stays in the cache.

    split cuts a text into chunks whose encodings can be joined; encode gives the ids of each of a list of chunks, as
    bytes, and may look up chunks that are known.
    """

    def __init__(self, split: Callable[[str], list], encode: Callable[[list, dict], list[bytes]], limit: int = CACHE_CHUNKS):
        self.split, self.encode, self.limit = split, encode, limit
        self.known: dict = {}
        self.latest: list = []

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self.split(t or "") for t in texts]
        flat = list(chain.from_iterable(parts))
        found = list(map(self.known.get, flat))
        gaps = [k for k, ids in enumerate(found) if ids is None]
        missing = list({flat[k] for k in gaps})
        for at in range(0, len(missing), 50_000):
            some = missing[at : at + 50_000]
            self.known.update(zip(some, self.encode(some, self.known), strict=True))
        for k in gaps:
            found[k] = self.known[flat[k]]
        ends = list(accumulate(map(len, parts)))
        out = [b"".join(found[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        self.latest = flat
        if len(self.known) > self.limit:
            self.trim()
        return out

    def trim(self) -> None:
        """Keeps the chunks of the latest texts only: frequent ones are among them."""
        used = set(self.latest)
        self.known = {k: self.known[k] for k in used} if len(used) <= self.limit else {}
        self.latest = []


def id_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def split_at(ids: list[int], last: np.ndarray, count: int, drop: int) -> list[bytes] | None:
    """The count runs of ids that end after an id for which last is true, without their final `drop` ids; None if
    there are more or fewer."""
    array = np.array(ids, "<u4")
    ends = np.flatnonzero(last[array]) + 1
    if len(ends) != count:
        return None
    blob, at = array.tobytes(), (4 * ends).tolist()
    return [blob[a : b - 4 * drop] for a, b in zip([0, *at[:-1]], at, strict=True)] if at else []


@lru_cache(maxsize=2)
def word_bpe(path: str, limit: int = CACHE_CHUNKS) -> ChunkCache:
    """A BPE with word ends whose pre-tokenizer drops white space: chunks are runs without ASCII white space."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    # Normal words in lower case need neither the normaliser nor the pattern.
    bare_tok = Tokenizer.from_file(path)
    bare_tok.normalizer = normalizers.Sequence([])
    bare_tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    # Many chunks are encoded at once. Letters alone end with the first id of a word's end; after other chunks goes a
    # symbol that is one id. Chunks that hold the symbol go alone.
    mark, mark_id = next((c, x[0]) for c in map(chr, range(0x2500, 0x2800)) if len(x := tok.encode(c, add_special_tokens=False).ids) == 1)

    def one(chunk: bytes) -> bytes:
        return id_bytes(tok.encode(chunk.decode(), add_special_tokens=False).ids)

    size = tok.get_vocab_size()
    is_mark = np.arange(size) == mark_id
    word_end = np.array([(tok.id_to_token(i) or "").endswith("</w>") for i in range(size)])
    ends = {c: one(bytes([c])) for c in b",."}
    last_stop = re.compile(rb"(?<=[a-z0-9])[,.]$", re.MULTILINE)

    def encode(chunks: list[bytes], known: dict) -> list[bytes]:
        # Without the last comma or full stop after a letter or digit, which is encoded apart, and in lower case: known
        # words are found again. No mark may follow that could join with a letter (U+0300 and on begin so).
        joined = b"\n".join(chunks)
        if b"\xcc" in joined or b"\xcd" in joined:
            return [one(c) for c in chunks]
        bare = last_stop.sub(b"", joined.lower()).split(b"\n")
        new = list({w for w in bare if w not in known})
        texts = [w.decode() for w in new]
        ids: dict[bytes, bytes] = {}
        letters = [x for x in texts if x.isalpha()]
        plain = [x for x in letters if x == x.lower() and is_normalized("NFC", x)]
        other = set(letters).difference(plain)
        mixed = [x for x in texts if not x.isalpha() and mark not in x]
        for how, some, glue, last in ((bare_tok, plain, " ", word_end), (tok, list(other), " ", word_end), (tok, mixed, f" {mark} ", is_mark)):
            if some:
                groups = [glue.join(some[k : k + 1000]) + glue for k in range(0, len(some), 1000)]
                flat = [x for e in how.encode_batch_fast(groups, add_special_tokens=False) for x in e.ids]
                runs = split_at(flat, last, len(some), int(last is is_mark))
                ids.update(zip((w.encode() for w in some), runs if runs is not None else (one(w.encode()) for w in some), strict=True))
        ids.update((w, one(w)) for w in new if w not in ids)
        known.update(ids)
        return [known[w] if len(w) == len(c) else known[w] + ends[c[-1]] for c, w in zip(chunks, bare, strict=True)]

    return ChunkCache(lambda text: text.encode().split(), encode, limit)


#: The characters that \s matches in the pattern of byte-level vocabularies (Unicode White_Space).
SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


def byte_bpe(tok) -> ChunkCache:
    """A byte-level BPE whose pattern never crosses from text into white space: a chunk is a run of other characters
    with the space before it, or a run of white space (without its last character if text follows)."""
    newline = tok.encode("\n", add_special_tokens=False).ids
    assert len(newline) == 1, "the vocabulary has no newline"
    is_newline = np.arange(tok.get_vocab_size()) == newline[0]

    def one(chunk: str) -> bytes:
        return id_bytes(tok.encode(chunk, add_special_tokens=False).ids)

    def encode(chunks: list[str], known: dict) -> list[bytes]:
        words = [c for c in chunks if not c.isspace()]
        runs = split_at(tok.encode_batch_fast(["\n".join(words) + "\n"], add_special_tokens=False)[0].ids, is_newline, len(words), 1) if words else []
        if runs is None:
            return [one(c) for c in chunks]
        rest = iter(runs)
        return [one(c) if c.isspace() else next(rest) for c in chunks]

    return ChunkCache(CHUNK.findall, encode)
