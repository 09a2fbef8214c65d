"""Language identification by cross-parsing: the language whose text says a document in the fewest phrases wins."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_chars, held_out, rows
from .sampling import labelled_ids, labelled_texts

#: Labelled rows taken of each language, the characters read of each, and those learned of all together.
SAMPLE_ROWS, SAMPLE_MAX_CHARS, TRAIN_CHARS = 96, 20_000, 24_000
#: Texts are laid out in lanes of so many characters, so that numpy steps through many at once.
SEGMENT, BATCH_CHARS = 512, 1_000_000
#: A passage that rows share is this many words at least.
PASSAGE_WORDS = 5
#: Sharpness of the score: the entropy difference, in bits a character, that makes one language e times likelier.
BITS_PER_E = 0.25
UNDETERMINED = "und"
#: Up to so many steps (four bytes each) stand in a table of all states and symbols; more in a hash table, with equal results.
DENSE_CELLS = 1 << 25
#: Above so many phrases a symbol a text is rejected: foreign scripts, but hardly other languages of the same script.
MAX_PHRASES = 0.7
_LAST = 0x323B0


@lru_cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c <= 0xDFFF else False for c in range(_LAST)] + [False])


def _folded(text: str) -> np.ndarray:
    """Code points in lower case; each run of other characters than letters is one space."""
    points = np.minimum(np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4"), _LAST)
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, points, 32)[keep]


class SuffixAutomaton:
    """The substrings of a text as paths from state 0. next: a dict per state."""

    def __init__(self, text: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(self.next)
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new


class Dense:
    """All steps of all languages as one table. A state is its row's offset, so that one addition finds a step: twice the
    next state, and one more if the symbol ends a phrase."""

    kind = np.int32

    def __init__(self, machines: list[SuffixAutomaton], width: int):
        tables, self.roots, base = [], [], 0
        for sam in machines:
            # A symbol that ends the phrase starts the next one: it leads where it leads from the root, and counts 1. One
            # that the language lacks is a phrase of its own: behind it, in the last state, any symbol starts another.
            lone = len(sam.next)
            go = np.zeros((lone + 1, width), np.int64)
            go[:] = [[2 * sam.next[0].get(c, lone) + 1 for c in range(width)]]
            go[0] -= 1  # nothing ends at the start
            for state, edges in enumerate(sam.next):
                go[state, list(edges)] = [2 * x for x in edges.values()]
            go[:, 0] = 2 * np.arange(lone + 1)
            tables.append((((go >> 1) + base) * width << 1 | go & 1).astype(np.int32).ravel())
            self.roots.append(base * width)
            base += lone + 1
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def go(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return self.table[state + symbol]


class Sparse:
    """The same steps for many symbols: those within a phrase in a hash table, the others, which are alike for all states of
    a language, in a row a language. A state is its number."""

    kind = np.int64

    def __init__(self, machines: list[SuffixAutomaton], width: int):
        self.width, self.roots, base = width, [], 0
        keys, values, rest, owner = [], [], [], []
        for k, sam in enumerate(machines):
            lone = len(sam.next)
            for state, edges in enumerate(sam.next):
                keys += [(base + state) * width + c for c in edges]
                values += [2 * (base + x) for x in edges.values()]
            rest.append([2 * (base + sam.next[0].get(c, lone)) + 1 for c in range(width)])
            owner.append(np.full(lone + 1, k))
            self.roots.append(base)
            base += lone + 1
        self.rest, self.owner = np.array(rest, np.int64).ravel(), np.concatenate(owner) * width
        self.at_start = np.zeros(base, np.int64)
        self.at_start[self.roots] = 1
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.keys, self.values = np.full(1 << 64 - int(self.shift), -1, np.int64), np.zeros(1 << 64 - int(self.shift), np.int64)
        key, value = np.array(keys, np.int64), np.array(values, np.int64)
        slot = self._slot(key)
        while len(key):  # each free place goes to the first key that asks for it, others ask for the next place
            places, first = np.unique(slot, return_index=True)
            first = first[self.keys[places] < 0]
            self.keys[slot[first]], self.values[slot[first]] = key[first], value[first]
            left = np.ones(len(key), bool)
            left[first] = False
            key, value, slot = key[left], value[left], (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def go(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        state, symbol = (x.ravel() for x in np.broadcast_arrays(state, symbol))
        out = self.rest[self.owner[state] + symbol] - self.at_start[state]
        key = state * self.width + symbol
        slot, open_ = self._slot(key), np.arange(len(key))
        while len(open_):
            held = self.keys[slot]
            same = held == key[open_]
            out[open_[same]] = self.values[slot[same]]
            on = ~same & (held >= 0)
            open_, slot = open_[on], (slot[on] + 1) & (len(self.keys) - 1)
        return np.where(symbol == 0, 2 * state, out)


class CrossParser:
    """Parses texts with the suffix automaton of each language: from a phrase's start to the longest match, then on."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        folded = {k: _folded(texts[k]) for k in self.languages}
        symbols = np.unique(np.concatenate([np.array([32], np.uint32), *folded.values()]))
        # Class 0 pads, class 1 is any letter that no language has.
        self.classes = np.ones(_LAST + 1, np.int32)
        self.classes[symbols] = np.arange(2, 2 + len(symbols))
        self.width = 2 + len(symbols)
        machines = [SuffixAutomaton(self.classes[folded[k]].tolist()) for k in self.languages]
        self.bits = [math.log2(max(2, len(folded[k]))) for k in self.languages]
        cells = sum(len(m.next) + 1 for m in machines) * self.width
        self.steps: Dense | Sparse = (Dense if cells <= DENSE_CELLS else Sparse)(machines, self.width)
        self.roots = self.steps.roots

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) numbers of phrases, and the number of symbols of each text."""
        codes = [self.classes[_folded(t)] if t else np.zeros(0, np.int32) for t in texts]
        size = np.array([len(c) for c in codes], np.int64)
        count = np.zeros((len(texts), len(self.languages)), np.int64)
        lanes = -(-size // SEGMENT)
        if not lanes.sum() or not self.languages:
            return count, size
        steps = np.zeros((int(lanes.sum()), SEGMENT), np.int32)
        flat, start = steps.ravel(), np.concatenate([[0], np.cumsum(lanes)])
        for c, at in zip(codes, start[:-1].tolist(), strict=True):
            flat[at * SEGMENT : at * SEGMENT + len(c)] = c
        owner = np.repeat(np.arange(len(texts)), lanes)
        columns = np.ascontiguousarray(steps.T[: min(SEGMENT, int(size.max()))])
        later = np.ones(len(steps), bool)  # lanes that go on with a text
        later[start[:-1][lanes > 0]] = False
        found = self._lanes(columns, np.flatnonzero(later))
        for k in range(len(self.roots)):
            count[:, k] = np.bincount(owner, found[k], len(texts))
        return count + (size > 0)[:, None], size  # a text's last phrase ends with it

    def _lanes(self, columns: np.ndarray, later: np.ndarray) -> np.ndarray:
        """(languages x lanes) phrases that end in each lane. All lanes are parsed from the root first, for all languages
        at once. Lanes that go on with a text are then parsed again from the state in which the lane before them ends,
        up to where both parses are in one state: from there they agree. Where they never are, the next lane starts
        otherwise than was thought, and is done anew."""
        languages, lanes = len(self.roots), columns.shape[1]
        kind = self.steps.kind
        found = np.empty((len(columns), languages * lanes), kind)
        state, ended = np.repeat(np.array(self.roots, kind), lanes), np.zeros(languages * lanes, np.int32)
        for t, column in enumerate(columns):
            found[t] = self.steps.go(state.reshape(languages, lanes), column).ravel()
            ended += found[t] & 1
            state = found[t] >> 1
        first_end, end, more = state, state.copy(), np.zeros(len(ended), np.int64)
        later = (lanes * np.arange(languages)[:, None] + later).ravel()
        todo = later
        while len(todo):
            at, state, new = todo, end[todo - 1], np.zeros(len(todo), np.int64)
            place = np.arange(len(todo))  # in todo, of the lanes whose parses still differ
            last = first_end[todo].copy()
            for t, column in enumerate(columns):
                said, thought = self.steps.go(state, column[at % lanes]), found[t, at]
                new[place] += (said & 1) - (thought & 1)
                state = said >> 1
                differ = state != thought >> 1
                at, state, place = at[differ], state[differ], place[differ]
                if not len(place):
                    break
            last[place] = state
            more[todo] = new
            changed = todo[last != end[todo]]
            end[todo] = last
            todo = np.intersect1d(changed + 1, later)
        return (ended + more).reshape(languages, lanes)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, phrases a symbol) of each text; no letter or no language: undetermined, score 0."""
        count, size = self.phrases(texts)
        out = []
        bits = np.array(self.bits)
        for text, phrases, n in zip(texts, count, size.tolist(), strict=True):
            if not n or not len(bits):
                out.append((UNDETERMINED, 0.0, 1.0))
                continue
            entropy = phrases * bits / n
            best = int(np.argmin(entropy))
            likely = np.exp((entropy[best] - entropy) / BITS_PER_E)
            out.append((self.languages[best], float(1 / likely.sum()), float(phrases[best] / n)))
        return out


@lru_cache(maxsize=2)
def _parser(texts: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(dict(texts))


def own_words(parts: dict[str, list[list[str]]]) -> dict[str, list[list[str]]]:
    """The texts without passages that several languages' rows share, or that an earlier row of the language has: no
    language may win by having learned a boilerplate passage by heart."""
    languages: dict[tuple, set[str]] = {}
    for lang, texts in parts.items():
        for words in texts:
            for shingle in zip(*(words[k:] for k in range(PASSAGE_WORDS)), strict=False):
                languages.setdefault(shingle, set()).add(lang)
    out: dict[str, list[list[str]]] = {}
    for lang, texts in parts.items():
        seen: set[tuple] = set()
        for words in texts:
            keep = [True] * len(words)
            shingles = list(zip(*(words[k:] for k in range(PASSAGE_WORDS)), strict=False))
            for at, shingle in enumerate(shingles):
                if len(languages[shingle]) > 1 or shingle in seen:
                    keep[at : at + PASSAGE_WORDS] = [False] * PASSAGE_WORDS
            seen.update(shingles)
            out.setdefault(lang, []).append([w for w, k in zip(words, keep, strict=True) if k])
    return {lang: [w for w in texts if w] for lang, texts in out.items()}


def shares(texts: list[str], chars: int) -> list[str]:
    """Beginnings of all texts, with the spaces between them chars characters at most: none is longer than another one
    that was cut."""
    left, cut = chars - len(texts) + 1, list(texts)
    for n, k in enumerate(sorted(range(len(texts)), key=lambda k: len(texts[k]))):
        cut[k] = texts[k][: max(0, left // (len(texts) - n))]
        left -= len(cut[k])
    return cut


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[tuple[str, str], ...]:
    """(language, text) learned from a bounded sample: of about SAMPLE_ROWS rows a language outside the held-out fold,
    equal shares of TRAIN_CHARS characters, and what short rows leave of theirs goes to the longer ones."""
    ids, _ = labelled_ids(docs.select(id_col, lang_col), id_col, lang_col, SAMPLE_ROWS)
    parts: dict[str, list[list[str]]] = {}
    for _, text, lang in labelled_texts(docs.withColumn(text_col, F.substring(text_col, 1, SAMPLE_MAX_CHARS)), ids, id_col, text_col, SAMPLE_MAX_CHARS, "string"):
        if any(map(str.isalpha, text)):
            parts.setdefault(lang, []).append(text.split())
    learned = {}
    for lang, texts in own_words(parts).items():
        if text := " ".join(shares([" ".join(words) for words in texts], TRAIN_CHARS)).strip():
            learned[lang] = text
    return tuple(sorted(learned.items()))


def identify(df: DataFrame, learned: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score, phrase_rate (and with carry the input row as `row`).

    The language with the fewest phrases, weighed by the bits that name a place in its text, wins; equal ones: the
    first by name. Null text, text without a letter, or nothing learned: `und`, score 0, rate 1. Whole texts are parsed,
    phrases of any length, and a very long text costs memory only for itself. Repeated rows are each predicted; null ids are held
    out. An empty table gives no rows. Only id and text are read (all columns with carry), whatever others are named.
    """
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("phrase_rate", T.DoubleType())]
    columns = [F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out")]
    source = df.select(*columns, *([F.struct("*").alias("row")] if carry else []))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), *fields, *([T.StructField("row", df.schema)] if carry else [])])

    def run(batches):
        parser = _parser(learned)
        for batch in batches:
            found = []
            for some in by_chars(rows(batch, 0, 1), BATCH_CHARS):
                found += parser.predict([t for _, t in some])
            lang, score, rate = map(list, zip(*found, strict=True)) if found else ([], [], [])
            arrays = [batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64()), *([batch.column(3)] if carry else [])]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


def rejects(identified: DataFrame) -> DataFrame:
    """identified with `rejected`: no letter, or more than MAX_PHRASES phrases a symbol."""
    return identified.withColumn("rejected", (F.col("lang_pred") == UNDETERMINED) | (F.col("phrase_rate") > MAX_PHRASES))
