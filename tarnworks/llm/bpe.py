"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside each partition.

Each distinct pre-token of a slice becomes token-position rows (word, byte offset, id). A recursive query joins adjacent
rows with the merge table and contracts, per word, the pair of minimum rank, leftmost first, until no pair of the word is
in the table. Decoding joins the ids with the vocabulary and puts the pieces together with an ordered aggregation.

Words of up to SHORT bytes contract one pair a step. In longer ones, where no token of lower rank contains the contracted
one, all occurrences of the word's minimum pair are contracted in one step, since the order among them can't matter then;
otherwise only the leftmost. A word that is a token itself has its id.

Nulls and empty texts encode to no ids. Repeated rows and ties of doc_id are kept as they are. Columns of the input other
than the text are passed through untouched by `encode`; its own columns replace columns of the same name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnworks.llm.features import slices, small_batches, spans, trim

#: Texts are handled in slices of about this many characters, and cached words are forgotten beyond these numbers.
SLICE_CHARS = 2_000_000
MAX_WORDS, MAX_WORD_CHARS = 450_000, 8_000_000
#: Bytes of the words of one encoding query, and ids of one decoding query.
TOGETHER, IDS_TOGETHER = 100_000, 1_000_000
#: Words of more bytes are encoded in windows of twice this size, each beginning this many bytes after the one before.
STRIDE = 1024
#: Words of up to this many bytes are encoded by ENCODE_SHORT.
SHORT = 32

#: A pair's rule is new << 12 | length of new << 2 | kind, so the least rule is that of the least rank.
ENCODE = """
WITH RECURSIVE step(word, pos, id, len, done) AS (
    SELECT word, pos, id, 1::BIGINT, false FROM base
    UNION ALL
    (WITH live AS NOT MATERIALIZED (SELECT * FROM step WHERE NOT done),
    pair AS (
        SELECT l.word, l.len, m.rule << 32 | l.pos AS spot
        FROM live l JOIN live r ON r.pos = l.pos + l.len JOIN merges m ON m.pair = l.id << 16 | r.id),
    best AS (SELECT word, min(spot) AS top FROM pair GROUP BY word),
    hit AS MATERIALIZED (
        SELECT p.word, p.len, p.spot >> 32 AS rule, p.spot & 4294967295 AS pos, p.spot = b.top AS top
        FROM pair p JOIN best b ON b.word = p.word AND p.spot >> 44 = b.top >> 44),
    win AS MATERIALIZED (
        SELECT pos, len, rule FROM hit WHERE rule & 3 = 0 OR rule & 3 = 1 AND top
        UNION ALL SELECT pos, len, rule FROM (
            SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY pos) AS nth FROM (
                SELECT *, pos - len * row_number() OVER (PARTITION BY word ORDER BY pos) AS run
                FROM hit WHERE rule & 3 = 2))
        WHERE nth % 2 = 1),
    change AS (
        SELECT pos, rule FROM win
        UNION ALL SELECT pos + len, -1 FROM win)
    SELECT s.word, s.pos, coalesce(c.rule >> 12, s.id), coalesce(c.rule >> 2 & 1023, s.len), b.word IS NULL
    FROM live s LEFT JOIN best b ON b.word = s.word LEFT JOIN change c ON c.pos = s.pos
    WHERE c.rule IS DISTINCT FROM -1)
)
SELECT word, id, len FROM step WHERE done ORDER BY pos
"""

#: The same for words of at most SHORT bytes: only the leftmost of the minimum pairs is contracted, so a word's step is one number: rule << 30 | place << 10 | length of the left token.
ENCODE_SHORT = """
WITH RECURSIVE step(word, pos, id, len, done) AS (
    SELECT word, pos, id, 1::BIGINT, false FROM base
    UNION ALL
    (WITH live AS NOT MATERIALIZED (SELECT * FROM step WHERE NOT done),
    best AS MATERIALIZED (
        SELECT l.word, min((m.rule << 30) | (l.pos << 10) | l.len) AS top
        FROM live l JOIN live r ON r.pos = l.pos + l.len JOIN merges m ON m.pair = l.id << 16 | r.id GROUP BY l.word)
    SELECT s.word, s.pos, CASE WHEN s.pos = ((b.top >> 10) & 1048575) THEN b.top >> 42 ELSE s.id END,
        CASE WHEN s.pos = ((b.top >> 10) & 1048575) THEN (b.top >> 32) & 1023 ELSE s.len END, b.top IS NULL
    FROM live s LEFT JOIN best b ON b.word = s.word
    WHERE b.top IS NULL OR s.pos <> ((b.top >> 10) & 1048575) + (b.top & 1023))
)
SELECT word, id, len FROM step WHERE done ORDER BY pos
"""

#: Rows hold this many consecutive ids, so that the ordered aggregation has fewer rows to order.
WIDE = 8
DECODE = f"""
SELECT doc, string_agg({" || ".join(f"coalesce(v{i}.piece, '')" for i in range(WIDE))}, '' ORDER BY pos) AS text
FROM ids {" ".join(f"LEFT JOIN vocab v{i} ON v{i}.id = ids.id{i}" for i in range(WIDE))} GROUP BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


#: What one step may contract of a word's minimum pair: every occurrence, the leftmost, or every second of a run of equal tokens.
ALL, ONE, TWIN = range(3)


def merge_table(ranks: dict[bytes, int]) -> dict[str, pa.Array]:
    """Columns pair (left id << 16 | right id) and rule of every pair of tokens whose bytes are a token.

    The kind of a rule is ONE where a token of lower rank contains the new one, since then the order of occurrences matters.
    """
    if max(ranks.values(), default=0) >= 65536 or max(map(len, ranks), default=0) >= 1024:
        raise ValueError("ids must be below 65536 and tokens shorter than 1024 bytes")
    pairs = [(a, b, new, len(token)) for token, new in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
    risky = {part for a, b, new, _ in pairs for part in (a, b) if new < part}
    rules = [new << 12 | size << 2 | (ONE if new in risky else TWIN if a == b else ALL) for a, b, new, size in pairs]
    return {"pair": pa.array([a << 16 | b for a, b, _, _ in pairs], pa.int64()), "rule": pa.array(rules, pa.int64())}


#: White space other than a space.
SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]

#: Marks keys that have no leading space; longer than any character, and texts with it aren't cut.
BARE = "\0\0"


def spaced(text: str) -> bool:
    """Whether each space of the text stands between two characters that aren't white space, and BARE isn't in it."""
    if text[:1] == " " or text[-1:] == " " or "  " in text or BARE in text:
        return False
    return not any(c in text and (f" {c}" in text or f"{c} " in text) for c in SPACES)


class Numbered(dict):
    """Numbers each new key in order of arrival."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


def runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices start[i], start[i] + 1, ... start[i] + count[i] - 1 of all i, one after another."""
    end = np.cumsum(count)
    return np.repeat(start - (end - count), count) + np.arange(end[-1] if len(end) else 0)


class Sequences:
    """A growing list of id sequences, stored as one flat array."""

    def __init__(self) -> None:
        self.flat, self.start = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, count: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat.astype(np.uint16)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(count)])

    def get(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of `index` one after another, and the length of each."""
        count = self.start[index + 1] - self.start[index]
        return self.flat[runs(self.start[index], count)], count


class Codec:
    """The tables of one vocabulary in an in-memory DuckDB of this worker, with the ids of what it has seen so far.

    A text is cut where a space stands between two characters that aren't white space: every match of a pattern such as GPT-2's ends
    there, so each cut piece, with its leading space, has the same matches alone as in the text. Texts with white space
    beside a space, or with a leading or trailing space, are matched as a whole. Distinct pieces are matched once, and distinct matches encoded once.
    """

    def __init__(self, path: str, pattern: str):
        import regex

        ranks = read_ranks(path)
        self.ranks = {t.decode(): i for t, i in ranks.items() if _is_text(t)}
        self.find = regex.compile(pattern).findall
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        vocab = {"id": pa.array(ranks.values(), pa.int64()), "piece": pa.array([t.decode("latin-1") for t in ranks], pa.string())}
        self.tables = {"merges": pa.table(merge_table(ranks)), "vocab": pa.table(vocab)}
        self.forget()

    @cached_property
    def db(self):
        import duckdb

        db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "128MB", "temp_directory": ""})
        for name, table in self.tables.items():
            db.register("given", table)
            db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            db.unregister("given")
        return db

    def close(self) -> None:
        """Forgets all and gives DuckDB's memory back, which it would keep between tasks; the next use opens it again."""
        self.forget()
        if "db" in self.__dict__:
            self.__dict__.pop("db").close()

    def forget(self) -> None:
        self.pieces, self.piece_ids = Numbered(), Sequences()
        self.matches, self.match_ids = Numbered(), Sequences()
        self.held = 0

    def _contracted(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For groups of words: their indices, numbers of ids, and the ids and their lengths one word after another. Queries are of bounded size."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        # a query takes as many steps as its word of most merges needs, so words of like length go together
        order = np.argsort(sizes, kind="stable")
        query = np.cumsum(sizes[order]) // TOGETHER * 2 + (sizes[order] > SHORT)
        for first, last in spans(query):
            part = order[first:last]
            data = np.frombuffer(b"".join([words[i] for i in part.tolist()]), np.uint8)
            word = np.repeat(np.arange(len(part)), sizes[part])
            # words are apart by one place, so that none has a right neighbour in the next
            self.db.register("base", pa.table({"word": word, "pos": np.arange(len(data)) + word, "id": self.of_byte[data]}))
            got = self.db.execute(ENCODE_SHORT if sizes[part[-1]] <= SHORT else ENCODE).fetchnumpy()
            self.db.unregister("base")
            yield part, np.bincount(np.asarray(got["word"], np.int64), minlength=len(part)), np.asarray(got["id"], np.int64), np.asarray(got["len"], np.int64)

    def _long(self, word: bytes) -> np.ndarray:
        """Ids of a long word from windows that overlap by half.

        Ids are those of a word if and only if each two neighbours are those of their own bytes: no contraction across a
        border happens in the word before one happens between those two alone. Inside a window all neighbours are such. So
        where two windows have a token in common, one may give way to the other behind it. If two have none, all is done
        again with windows of twice the size; one that holds the whole word needs no partner.
        """
        stride = STRIDE
        while True:
            begins = range(0, max(len(word) - stride, 1), stride)
            done: list = [None] * len(begins)
            for part, count, ids, lengths in self._contracted([word[a : a + 2 * stride] for a in begins]):
                ends = np.cumsum(count)
                for i, a, b in zip(part.tolist(), (ends - count).tolist(), ends.tolist(), strict=True):
                    done[i] = ids[a:b], lengths[a:b]
            out, at = [], 0  # at: bytes of the word behind which the next window takes over
            for k, (begin, (ids, lengths)) in enumerate(zip(begins, done, strict=True)):
                ends = begin + np.cumsum(lengths)
                upto = ends[-1]
                if k + 1 < len(done):
                    after = begins[k + 1] + np.concatenate([[0], np.cumsum(done[k + 1][1])])
                    both = np.intersect1d(np.stack([ends - lengths, ends], 1).reshape(-1).view("i8,i8"), np.stack([after[:-1], after[1:]], 1).reshape(-1).view("i8,i8"))
                    both = both[both["f1"] > at]
                    if not len(both):
                        break
                    upto = both["f1"][len(both) // 2]
                out.append(ids[(ends > at) & (ends <= upto)])
                at = upto
            else:
                return np.concatenate(out)
            stride *= 2

    def _learn_matches(self, new: list[str]) -> None:
        ids = np.fromiter((self.ranks.get(w, -1) for w in new), np.int64, len(new))
        count = np.ones(len(new), np.int64)
        rest = np.flatnonzero(ids < 0)
        words = [new[i].encode() for i in rest.tolist()]
        long = np.fromiter((len(w) > 2 * STRIDE for w in words), bool, len(words))
        short = rest[~long]
        got = [(short[part], n, out) for part, n, out, _ in self._contracted([w for w in words if len(w) <= 2 * STRIDE])]
        for i in np.flatnonzero(long).tolist():
            out = self._long(words[i])
            got.append((rest[i : i + 1], np.array([len(out)]), out))
        for at, n, _ in got:
            count[at] = n
        start = np.cumsum(count) - count
        flat = np.zeros(count.sum(), np.int64)
        flat[start] = ids
        for at, n, out in got:
            flat[runs(start[at], n)] = out
        self.match_ids.add(flat, count)

    def _learn_pieces(self, new: list[str]) -> None:
        known, number = len(self.matches), self.matches.__getitem__
        found = list(map(self.find, new))
        size = np.cumsum([0, *map(len, found)])
        index = np.fromiter(map(number, chain.from_iterable(found)), np.int64, size[-1])
        if len(self.matches) > known:
            self._learn_matches(list(islice(self.matches, known, None)))
        flat, count = self.match_ids.get(index)
        ends = np.concatenate([[0], np.cumsum(count)])[size]
        self.piece_ids.add(flat, np.diff(ends))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        known, number = len(self.pieces), self.pieces.__getitem__
        whole = [not spaced(t) for t in texts]
        cut = pc.split_pattern(pa.array(["" if w else t for t, w in zip(texts, whole, strict=True)], pa.large_string()), " ")
        begin = cut.offsets.to_numpy()
        first = np.zeros(begin[-1], bool)
        first[begin[:-1]] = True
        heads = cut.values.filter(pa.array(first)).to_pylist()
        # each distinct piece of the slice is looked up once
        rest = cut.values.filter(pa.array(~first)).dictionary_encode()
        numbers = np.fromiter(map(number, rest.dictionary.to_pylist()), np.int64, len(rest.dictionary))[rest.indices.to_numpy()]
        until = begin - np.arange(len(begin))
        rows = []
        for t, w, head, i, j in zip(texts, whole, heads, until[:-1].tolist(), until[1:].tolist(), strict=True):
            rows += [np.array([number(f"{BARE}{m}") for m in self.find(t if w else head)], np.int64), numbers[i:j]]
        if len(self.pieces) > known:
            new = [p[2:] if p.startswith(BARE) else f" {p}" for p in islice(self.pieces, known, None)]
            self.held += sum(map(len, new))
            self._learn_pieces(new)
        size = np.cumsum([0, *map(len, rows)])[::2]
        flat, count = self.piece_ids.get(np.concatenate([numbers[:0], *rows]))
        ends = np.concatenate([[0], np.cumsum(count)])[size]
        if len(self.pieces) > MAX_WORDS or self.held > MAX_WORD_CHARS:
            self.forget()
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; the parts of a long one are encoded one after another."""
        parts, owner = [], []
        for i, t in enumerate(texts):
            cut = parts_of(t)
            parts += cut
            owner += [i] * len(cut)
        got: list[list[np.ndarray]] = [[] for _ in texts]
        for a, b in slices(parts, SLICE_CHARS):
            for i, ids in zip(owner[a:b], self._encode(parts[a:b]), strict=True):
                got[i].append(ids)
        return [x[0] if len(x) == 1 else np.concatenate([*x, np.zeros(0, np.uint16)]) for x in got]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each sequence; long ones are decoded in blocks."""
        blocks = [x[a : a + IDS_TOGETHER] for x in ids for a in range(0, len(x), IDS_TOGETHER)]
        bytes_of: list[bytes] = []
        for a, b in slices(blocks, IDS_TOGETHER):
            bytes_of += self._decode(blocks[a:b])
        of_text = iter(bytes_of)
        return [b"".join(islice(of_text, -(-len(x) // IDS_TOGETHER))) for x in ids]

    def _decode(self, ids: list[np.ndarray]) -> list[bytes]:
        out = [b""] * len(ids)
        wide = np.fromiter((-(-len(x) // WIDE) for x in ids), np.int64, len(ids))
        flat = np.full((wide.sum(), WIDE), -1, np.int64)
        at = (np.cumsum(wide) - wide) * WIDE
        for x, a in zip(ids, at, strict=True):
            flat.reshape(-1)[a : a + len(x)] = x
        self.db.register("ids", pa.table({"doc": np.repeat(np.arange(len(ids)), wide), "pos": np.arange(len(flat))} | {f"id{i}": flat[:, i].copy() for i in range(WIDE)}))
        got = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("ids")
        for doc, text in zip(got["doc"].to_pylist(), got["text"].to_pylist(), strict=True):
            out[doc] = text.encode("latin-1")
        return out


def parts_of(text: str, most: int = SLICE_CHARS) -> list[str]:
    """The text, cut where a space stands between two characters that aren't white space, into parts of about `most` characters; without such a space in reach, a part is longer."""
    out, begin = [], 0
    while len(text) - begin > most:
        at = begin + most
        while (at := text.find(" ", at)) >= 0 and (text[at - 1].isspace() or not text[at + 1 : at + 2].strip()):
            at += 1
        if at < 0:
            break
        out.append(text[begin:at])
        begin = at
    return [*out, text[begin:]]


def _is_text(token: bytes) -> bool:
    try:
        return bool(token.decode())
    except UnicodeDecodeError:
        return False


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str | None = "decoded_bytes", digests: bool = False, decodes: str | None = None) -> DataFrame:
    """docs with the token ids of `text` (array<int>) and, if asked for, the bytes that the ids decode to.

    `decodes` names a column that tells whether the ids decode to the text, without sending the bytes. With digests, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids) and decoded_sha256 take their place.
    """
    small_batches(docs)
    own = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} if digests else {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.BinaryType()} if decoded else {}) | ({decodes: T.BooleanType()} if decodes else {})
    names = list(own)
    # digests need no more of the text than its own batch, so that column isn't sent back
    keep = [c for c in docs.columns if c not in names and not (digests and c == text)]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    for name, kind in own.items():
        schema = schema.add(name, kind)
    # a text that is sent back anyway isn't sent to the workers twice
    source = text if text in keep else "__text"
    given = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if source == text else [F.col(f"`{text}`").alias("__text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_codec = codec(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(source).to_pylist()]
            for a, b in slices(texts, SLICE_CHARS):
                got = own_codec.encode(texts[a:b])
                columns = [batch.column(c).slice(a, b - a) for c in keep]
                if digests or decoded or decodes:
                    back = own_codec.decode(got)
                if digests:
                    columns += [pa.array([len(x) for x in got], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in got]), pa.array([hashlib.sha256(x).hexdigest() for x in back])]
                else:
                    columns.append(pa.array([x.astype(np.int32) for x in got], pa.list_(pa.int32())))
                    columns += [pa.array(back, pa.binary())] if decoded else []
                    columns += [pa.array([x == t.encode() for x, t in zip(back, texts[a:b], strict=True)], pa.bool_())] if decodes else []
                yield pa.RecordBatch.from_arrays(columns, names=keep + names)
        own_codec.close()
        trim()

    return given.mapInArrow(run, schema)
