"""Token counts by finite-state tokenizer compilation, for BPE vocabularies with word ends (tokenizers' JSON format).

Two transducers count the tokens of a text.

The first reads characters, by class, and marks where words begin and end. Its table is compiled from the splitting rule:
contractions, runs of letters, single numbers, runs of other characters. Text is cut into chunks; each chunk's map from
entry state to exit state is computed for all chunks side by side, the maps compose by a parallel prefix scan, and then
every chunk runs again from its known entry state.

The second reads the bytes of a word. Its states are the prefixes read so far, with the last token of the prefix's own
tokenization; its transitions, compiled when first taken, are annotated with the tokens that they emit. The last token of
a prefix is the longest one that may follow the tokenization before it: two tokens may stand side by side if no merge
across their border would have come before the merges that made them.

Special tokens inside texts count one each, as the library takes them by default. Null and empty texts have no tokens.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnworks.llm.features import small_batches, text_slices
from tarnworks.llm.ngram_join import _BACK, _STEP, _powers, mix

SLICE_CHARS = 1_500_000
CHUNK = 256
#: Compiled transitions and counted words are dropped beyond these numbers.
MAX_STATES, MAX_WORDS = 400_000, 2_000_000
#: Characters that count as white space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe as a token of its own.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

# character classes of the first transducer
SPACE, LETTER, NUMBER, OTHER, MARK = range(5)
_LETTERS = {c: 5 + i for i, c in enumerate("strvmlde")}
CLASSES = 13
# its states: between words, in letters, in others, after an opening apostrophe, and after one and r, v or l
GAP, IN_LETTERS, IN_OTHER, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
STATES = 7


@lru_cache(1)
def segmenter() -> tuple[np.ndarray, np.ndarray]:
    """next[state, class] and begin[state, class]: whether a word begins at the character (1), or one began a character before too (2: and that is where the apostrophe's word ended).

    A word goes on until the next beginning or white space.
    """
    after = np.zeros((STATES, CLASSES), np.int8)
    begin = np.zeros((STATES, CLASSES), np.int8)
    fresh = {SPACE: GAP, NUMBER: GAP, OTHER: IN_OTHER, MARK: QUOTE}
    for s in range(STATES):
        for c in range(CLASSES):
            letter = c == LETTER or c >= 5
            after[s, c] = IN_LETTERS if letter else fresh[c]
            begin[s, c] = c != SPACE
            if s == IN_LETTERS and letter:
                begin[s, c] = 0
            if s in (IN_OTHER, QUOTE) and c in (OTHER, MARK):
                after[s, c], begin[s, c] = IN_OTHER, 0
    for x in CONTRACTIONS:
        first = _LETTERS[x[0]]
        if len(x) == 1:
            after[QUOTE, first], begin[QUOTE, first] = GAP, 0
        else:
            # r, v or l may end the apostrophe's word or go on with it: the next character tells
            pending = {"r": QUOTE_R, "v": QUOTE_V, "l": QUOTE_L}[x[0]]
            after[QUOTE, first], begin[QUOTE, first] = pending, 0
            for c in range(CLASSES):
                if c == _LETTERS[x[1]]:
                    after[pending, c], begin[pending, c] = GAP, 0
                else:
                    # the letter before began a word of letters
                    after[pending, c], begin[pending, c] = after[IN_LETTERS, c], begin[IN_LETTERS, c] + 2
    return after, begin


def segment(classes: np.ndarray) -> np.ndarray:
    """Where words begin, for one sequence of character classes whose last is SPACE."""
    after, begin = segmenter()
    n = len(classes)
    lanes = -(-n // CHUNK)
    padded = np.full(lanes * CHUNK, SPACE, np.int64)
    padded[:n] = classes
    padded = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T)
    maps = np.tile(np.arange(STATES, dtype=np.int8), (lanes, 1))
    flat_next, flat_begin = after.ravel(), begin.ravel()
    for c in padded:
        maps = flat_next[maps.astype(np.int64) * CLASSES + c[:, None]]
    # prefix scan: maps[i] becomes the composition of maps 0..i
    step = 1
    while step < lanes:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), 1)
        step *= 2
    state = np.concatenate([[GAP], maps[:-1, GAP]]).astype(np.int64)
    out = np.zeros((CHUNK, lanes), np.int8)
    for i, c in enumerate(padded):
        at = state * CLASSES + c
        out[i] = flat_begin[at]
        state = flat_next[at].astype(np.int64)
    out = out.T.ravel()[:n]
    starts = (out & 1).astype(bool)
    starts[np.flatnonzero(out & 2) - 1] = True
    return starts


class Words:
    """The transducer of one vocabulary's words."""

    def __init__(self, model: dict):
        symbols = _byte_symbols()
        names = {s: bytes([b]) for b, s in symbols.items()}
        end = model["end_of_word_suffix"] or ""
        self.mark = b"\xff\xff"  # ends the bytes of a token that ends its word; no UTF-8 text has it

        def raw(token: str) -> bytes:
            last = bool(end) and token.endswith(end)
            return b"".join(names[c] for c in (token[: -len(end)] if last else token)) + (self.mark if last else b"")

        self.number: dict[bytes, int] = {}
        self.parts: list[tuple[int, int] | None] = []
        self.rank: list[int] = []
        self.pairs: dict[tuple[int, int], int] = {}
        for b in range(256):
            for t in (bytes([b]), bytes([b]) + self.mark):
                self.number[t] = len(self.parts)
                self.parts.append(None)
                self.rank.append(-1)
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y = raw(a), raw(b)
            whole = x + y
            a, b = self.number[x], self.number[y]
            if whole not in self.number:
                self.number[whole] = len(self.parts)
                self.parts.append((a, b))
                self.rank.append(rank)
            self.pairs[a, b] = rank
        self.longest = max(map(len, self.number))
        self.beside: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        # by state: the latest bytes read, the states before each of them and after the last, the last token, the tokens so
        # far; no token is longer than what is kept. State 0 has read nothing
        self.next: dict[tuple[int, int], int] = {}
        self.read, self.last, self.emitted = [b""], [-1], [0]
        self.trail: list[tuple[int, ...]] = [(0,)]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether tokens a, b stay apart: undoes the merges of both from the latest on, and looks for one that joins across the border earlier."""
        got = self.beside.get((a, b))
        if got is None:
            x, y, bound, tie = a, b, len(self.pairs), False
            got = True
            while True:
                r = self.pairs.get((x, y))
                # a merge across the border comes first if its rank is lower, or equal and further left than that in y
                if r is not None and (r < bound or r == bound and tie):
                    got = False
                    break
                rx, ry = self.rank[x], self.rank[y]
                if rx < 0 and ry < 0:
                    break
                # of equal merges the left one was made first, so the right one is undone first
                if rx > ry:
                    bound, tie, x = rx, False, self.parts[x][1]
                else:
                    bound, tie, y = ry, True, self.parts[y][0]
            if len(self.beside) > MAX_STATES:
                self.beside.clear()
            self.beside[a, b] = got
        return got

    def step(self, state: int, symbol: bytes) -> tuple[int, int]:
        """(last token, state where it begins) after the symbol."""
        read, trail = self.read[state] + symbol, self.trail[state]
        for begin in range(max(0, len(read) - self.longest), len(trail)):
            token = self.number.get(read[begin:])
            if token is not None and (trail[begin] == 0 or self.may_follow(self.last[trail[begin]], token)):
                return token, trail[begin]
        raise AssertionError("every byte is a token")

    def count(self, word: bytes) -> int:
        """Tokens of a word."""
        state = 0
        for b in word[:-1]:
            to = self.next.get((state, b))
            if to is None:
                token, begin = self.step(state, bytes([b]))
                to = len(self.read)
                self.read.append((self.read[state] + bytes([b]))[-self.longest :])
                self.last.append(token)
                self.emitted.append(self.emitted[begin] + 1)
                self.trail.append((*self.trail[state], to)[-self.longest - 1 :])
                self.next[state, b] = to
            state = to
        key = (state, 256 + word[-1])
        got = self.next.get(key)
        if got is None:
            _, begin = self.step(state, word[-1:] + self.mark)
            got = self.next[key] = self.emitted[begin] + 1
        return got


def _byte_symbols() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counter:
    """Counts tokens of texts, with the words of this worker counted so far."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words = Words(spec["model"])
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.firsts = {s[:2] for s in specials}
        self.letter, self.numeral = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
        self.classes = np.full(0x110000, -1, np.int8)
        self.classes[WHITE] = SPACE
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def normal(self, text: str) -> str:
        """NFC, then each character's lower case."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # str.lower looks at a sigma's neighbours
        return text.lower()

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        parts, size = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if self.special and any(f in t for f in self.firsts) and self.special.search(t):
                pieces = self.special.split(t)
                out[i] = len(pieces) - 1
                t = " ".join(map(self.normal, pieces))
            else:
                t = self.normal(t)
            parts.append(t)
            size[i] = len(t) + 1
        joined = " ".join([*parts, ""])
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if not len(chars):
            return out
        classes = self.classes[chars]
        if (classes < 0).any():
            for c in np.unique(chars[classes < 0]).tolist():
                x = chr(c)
                self.classes[c] = _LETTERS[x] if x in _LETTERS else MARK if x == "'" else LETTER if self.letter.match(x) else NUMBER if self.numeral.match(x) else OTHER
            classes = self.classes[chars]
        starts = segment(classes)
        space = classes == SPACE
        # a word ends where the next begins or white space follows
        begin = np.flatnonzero(starts)
        stops = np.flatnonzero(starts | space)
        end = stops[np.searchsorted(stops, begin, "right")]
        total = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(mix(chars.astype(np.uint64) + np.uint64(1)) * _powers(_STEP, len(chars)), out=total[1:])
        name = mix((total[end] - total[begin]) * _powers(_BACK, len(chars))[begin] + (end - begin).astype(np.uint64))
        names, first, which = np.unique(name, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, names)
        have = self.known[np.minimum(at, len(self.known) - 1)] == names if len(self.known) else np.zeros(len(names), bool)
        counts = np.zeros(len(names), np.int64)
        counts[have] = self.counts[at[have]]
        new = np.flatnonzero(~have)
        counts[new] = [self.words.count(joined[a:b].encode()) for a, b in zip(begin[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
        self.known, self.counts = np.insert(self.known, at[new], names[new]), np.insert(self.counts, at[new], counts[new])
        if len(self.words.read) > MAX_STATES:
            self.words.forget()
        if len(self.known) > MAX_WORDS:
            self.known, self.counts = self.known[:0], self.counts[:0]
        doc = np.searchsorted(np.cumsum(size), begin, "right")
        return out + np.bincount(doc, counts[which], minlength=len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit in the text's place."""
    small_batches(docs)
    own = ["n_bytes", "n_tokens", "over_limit"]
    out = [c for c in docs.columns if c != text and c not in own]
    given = docs.select(*[F.col(f"`{c}`") for c in out], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_counter = counter(path)
        for batch, texts in text_slices(batches, "__text", SLICE_CHARS):
            n = own_counter.count(texts)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in out], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], names=[*out, *own])

    return given.mapInArrow(run, given.drop("__text").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean"))
