"""N-gram Jaccard self join with rare-first prefix, length, positional and suffix filters.

1. One pass over the texts hashes each document's distinct word n-grams. Documents of equal sets form a class.
2. N-grams meet by hash bucket, packed in binary rows, and each class learns which of its n-grams other classes have. An
   n-gram that is common within one task stays with its documents; a notice of it goes to its bucket instead. So a
   bucket gets a common n-gram once per task that saw it, not once per document.
3. The order of n-grams is rare first: bit length of the document frequency (63 for common ones), then hash. N-grams of
   one class alone come before all others and match nothing, so only their number matters.
4. Classes meet on the shared part of their prefixes. The first rounds verify each class of a posting list against one
   hub of the list; lists whose classes are all connected by then need nothing more. In the other lists every class
   outside the largest component meets all others outside its own component; pairs whose parity bitmaps allow enough
   common items are verified. No link between components is lost, and a group of near copies needs about as many verifications as it has members.

Hashes have 48 bits plus those of the bucket. Documents without a word are in no class and linked with nothing. Null
texts have no words. Repeated rows are kept: one row out for each row in. A null doc_id gets its component like others,
but is never its smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnworks.llm.components import components
from tarnworks.llm.features import slices, small_batches, spans, trim
from tarnworks.session import plan_bytes, stash, unstash

#: Texts are hashed in slices of about this many characters; a pack holds about this many n-grams.
SLICE_CHARS = 500_000
PACK_NGRAMS = 750_000
#: An n-gram is common in a pack if at least 8 and one in this many of its classes have it.
COMMON_IN = 500
#: One hash bucket for about this many bytes of input.
BUCKET_BYTES = 4_000_000
#: Bytes of input whose n-grams one task takes.
TASK_BYTES = 256 << 20
#: Rounds with hubs before the exact round.
HUB_ROUNDS = 2
#: 64-bit words of a set's parity bitmap.
PARITY_WORDS = 16

_RNG = np.random.default_rng(20_240_501)
_BYTE = _RNG.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_PLACE = _RNG.integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}
KEPT_POWERS = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64. Up to KEPT_POWERS are kept for other calls; more are made anew each time."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if len(have) <= KEPT_POWERS:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Murmur's finalizer."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def ngram_sets(texts: list[str], n: int = 5) -> list[np.ndarray]:
    """The sorted distinct 58-bit hashes of the word n-grams of each text; of all its words if they are fewer than n."""
    parts = [t.encode() for t in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    if not len(data):
        return []
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_STEP, len(data)), out=total[1:])
    word = mix((total[end] - total[start]) * _powers(_BACK, len(data))[start] + (end - start).astype(np.uint64))
    upto = np.searchsorted(start, np.cumsum(size))
    gram = np.zeros(max(len(word) - n + 1, 0), np.uint64)
    for j in range(n):
        gram += word[j : j + len(gram)] * _PLACE[j]
    gram = mix(gram) >> np.uint64(6)
    out = []
    for a, b in zip(np.concatenate([[0], upto[:-1]]).tolist(), upto.tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(gram[a : b - n + 1]))
        elif b > a:
            short = (word[a:b] * _PLACE[n : n + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)) >> np.uint64(6))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _low48(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


_PACKED = "bucket int, kind int, ids binary, sets binary, sizes binary, counts binary, data binary"
_MET = "kind int, doc_id long, class long, size int, keys binary"


def _pack(n: int, bits: int):
    """Documents to packed rows. kind 0: documents; 1: n-grams of classes; 2: common n-grams of a class; 3: notices."""

    def flush(docs: list, sets: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        spread = 1 << bits
        for i in range(0, len(docs), 256):
            part = docs[i : i + 256]
            ids = np.array([0 if d is None else d for d, _, _ in part], np.int64)
            valid = np.array([d is not None for d, _, _ in part], np.uint8)
            rows.append((i // 256 % spread, 0, ids.tobytes(), np.array([s for _, s, _ in part], np.int64).tobytes(), np.array([k for _, _, k in part], np.int32).tobytes(), None, valid.tobytes()))
        names = np.fromiter(sets, np.int64, len(sets))
        size = np.fromiter(map(len, sets.values()), np.int64, len(sets))
        grams = np.concatenate([*sets.values(), np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets)), size)
        ordered = np.sort(grams)
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate([first, [len(ordered)]]))
        common = ordered[first[times >= max(8, len(sets) // COMMON_IN)]]
        is_common = np.isin(grams, common) if len(common) else np.zeros(len(grams), bool)
        at = np.flatnonzero(is_common)
        for a, b in spans(owner[at]):
            o = owner[at[a]]
            rows.append((int(names[o] % spread), 2, None, names[o : o + 1].tobytes(), size[o : o + 1].astype(np.int32).tobytes(), None, grams[at[a:b]].tobytes()))
        grams, owner = grams[~is_common], owner[~is_common]
        for rest, who, kind in ((common, None, 3), (grams, owner, 1)):
            bucket = (rest >> np.uint64(58 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for a, b in spans(bucket[order]):
                pick = order[a:b]
                row = (int(bucket[pick[0]]), kind, None)
                if who is None:
                    rows.append((*row, None, None, None, _low(rest[pick], bits)))
                else:
                    mine = who[pick]
                    run = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                    rows.append((*row, names[mine[run]].tobytes(), size[mine[run]].astype(np.int32).tobytes(), np.diff(np.concatenate([run, [len(mine)]])).astype(np.int32).tobytes(), _low(rest[pick], bits)))
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        for i in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 2000], strict=True), kinds, strict=True)], names=["bucket", "kind", "ids", "sets", "sizes", "counts", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple] = []
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, SLICE_CHARS):
                for doc, grams in zip(ids[a:b], ngram_sets(texts[a:b], n), strict=True):
                    name = xxhash.xxh64_intdigest(grams.tobytes()) >> 1 if len(grams) else -1
                    docs.append((doc, name, len(grams)))
                    if len(grams) and name not in sets:
                        sets[name] = grams
                        held += len(grams)
                if held > PACK_NGRAMS or len(docs) > 200_000:
                    yield from flush(docs, sets)
                    docs, sets, held = [], {}, 0
        yield from flush(docs, sets)
        trim()

    return run


def _low(h: np.ndarray, bits: int) -> bytes:
    """What a hash has below its bucket: 48 bits, or all that are left of 58 with fewer bucket bits."""
    rest = h & np.uint64((1 << (58 - bits)) - 1)
    return _low48(rest >> np.uint64(max(0, 10 - bits)))


def _key(low: np.ndarray, bucket: np.ndarray, bits: int, freq: np.ndarray) -> np.ndarray:
    """The order of n-grams: 6 bits of frequency, then the hash as far as its bucket knows it."""
    return (freq << np.uint64(58)) | (bucket << np.uint64(58 - bits)) | (low << np.uint64(max(0, 10 - bits)))


def _meet(bits: int):
    """Packed rows in order of buckets to (kind 0) documents and (kind 1, 2) keys of each class that other classes have too. One bucket is held at a time."""

    def batch(kind: int, docs, classes, sizes, keys) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(classes), kind, np.int32)), docs, pa.array(classes, pa.int64(), mask=classes < 0), pa.array(sizes, pa.int32()), keys], names=["kind", "doc_id", "class", "size", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        bucket = -1
        for got in batches:
            for row in got.to_pylist():
                kind = row["kind"]
                if kind in (0, 2):
                    names, sizes = np.frombuffer(row["sets"], np.int64), np.frombuffer(row["sizes"], np.int32)
                    if kind == 0:
                        ids = pa.array(np.frombuffer(row["ids"], np.int64), pa.int64(), mask=np.frombuffer(row["data"], np.uint8) == 0)
                        yield batch(0, ids, names, sizes, pa.nulls(len(names), pa.binary()))
                    else:
                        h = np.frombuffer(row["data"], np.uint64)
                        keys = _key((h & np.uint64((1 << (58 - bits)) - 1)) >> np.uint64(max(0, 10 - bits)), h >> np.uint64(58 - bits), bits, np.uint64(63))
                        yield batch(2, pa.nulls(1, pa.int64()), names, sizes, pa.array([keys.tobytes()], pa.binary()))
                    continue
                if row["bucket"] != bucket:
                    yield from together(bucket, held)
                    bucket, held = row["bucket"], []
                held.append(row)
        yield from together(bucket, held)
        trim()

    def together(bucket: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """The n-grams of one bucket that several classes have, by class."""
        common = np.unique(np.concatenate([_from48(r["data"]) for r in rows if r["kind"] == 3] or [np.zeros(0, np.uint64)]))
        rows = [r for r in rows if r["kind"] == 1]
        if not rows:
            return
        low = np.concatenate([_from48(r["data"]) for r in rows])
        names = np.concatenate([np.repeat(np.frombuffer(r["sets"], np.int64), np.frombuffer(r["counts"], np.int32)) for r in rows])
        sizes = np.concatenate([np.repeat(np.frombuffer(r["sizes"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in rows])
        order = np.argsort(low, kind="stable")
        low = low[order]
        new = np.concatenate([[True], low[1:] != low[:-1]])
        times = np.diff(np.concatenate([np.flatnonzero(new), [len(low)]]))
        many = np.repeat(times, times) > 1
        many |= np.isin(low, common)
        low, names, sizes = low[many], names[order][many], sizes[order][many]
        order = np.lexsort((names, low))  # a class may come from several packs
        low, names, sizes = low[order], names[order], sizes[order]
        once = np.concatenate([[True], (low[1:] != low[:-1]) | (names[1:] != names[:-1])])[: len(low)]
        low, names, sizes = low[once], names[once], sizes[once]
        new = np.concatenate([[True], low[1:] != low[:-1]])[: len(low)]
        times = np.diff(np.concatenate([np.flatnonzero(new), [len(low)]]))
        times = np.repeat(times, times)
        freq = np.where(np.isin(low, common), 63, np.minimum(62, np.floor(np.log2(np.maximum(times, 1))))).astype(np.uint64)
        shared = (times > 1) | (freq == 63)
        keys, names, sizes = _key(low, np.uint64(bucket), bits, freq)[shared], names[shared], sizes[shared]
        order = np.argsort(names, kind="stable")
        keys, names, sizes = keys[order], names[order], sizes[order]
        runs = spans(names)
        for i in range(0, len(runs), 5000):
            at = np.array([a for a, _ in runs[i : i + 5000]])
            yield batch(1, pa.nulls(len(at), pa.int64()), names[at], sizes[at], pa.array([keys[a:b].tobytes() for a, b in runs[i : i + 5000]], pa.binary()))

    return run


def prefix_length(size: int, num: int, den: int) -> int:
    """A set of this size shares one of that many first items with any set whose Jaccard similarity is num / den."""
    return size - -(-num * size // den) + 1


def parity(keys: np.ndarray) -> np.ndarray:
    """Bit i of the bitmap: whether an odd number of keys hash to i. Bitmaps of two sets differ in at most as many bits as there are keys of one set alone."""
    odd = np.bincount((mix(keys) % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, size, packs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys = np.unique(np.concatenate([np.frombuffer(p, np.uint64) for p in packs]))
                first = prefix_length(size, num, den) - (size - len(keys))
                if first > 0:
                    # with the upper bit turned, signed numbers have the order of the keys
                    out.append((name, size, keys.tobytes(), (keys[:first] ^ np.uint64(1 << 63)).view(np.int64), parity(keys)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=["class", "size", "keys", "prefix", "parity"])

    return run


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int) -> int:
    """An upper bound on the number of common items of two sorted arrays, by splitting both at the middle item of b."""
    if depth == 0 or not len(a) or not len(b):
        return min(len(a), len(b))
    middle = len(b) // 2
    at = int(np.searchsorted(a, b[middle]))
    same = at < len(a) and a[at] == b[middle]
    return suffix_bound(a[:at], b[:middle], depth - 1) + suffix_bound(a[at + same :], b[middle + 1 :], depth - 1) + same


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, size_a, size_b, keys_a, keys_b in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                x, y = np.frombuffer(keys_a, np.uint64), np.frombuffer(keys_b, np.uint64)
                need = -(-num * (size_a + size_b) // (num + den))  # common items that the similarity takes
                if suffix_bound(x, y, 3) >= need and len(np.intersect1d(x, y, assume_unique=True)) >= need:
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of distinct candidate pairs (a, b), those that are similar."""
    x = sets.select(F.col("class").alias("a"), F.col("size").alias("size_a"), F.col("keys").alias("keys_a"))
    y = sets.select(F.col("class").alias("b"), F.col("size").alias("size_b"), F.col("keys").alias("keys_b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "size_a", "size_b", "keys_a", "keys_b").mapInArrow(_verify(num, den), "a long, b long")


def _fits(num: int, den: int) -> F.Column:
    """Length and positional filter of two postings of one key, as structs x and y of (class, size, at)."""
    need = F.ceil(num * (F.col("x.size") + F.col("y.size")) / F.lit(num + den))
    # items from the key on, which is common: what comes before it can't be common, or the pair would meet there as well
    rest = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    length = num * F.greatest("x.size", "y.size") <= den * F.least("x.size", "y.size")
    return length & (rest >= need)


def ngram_jaccard_components(docs: DataFrame, n: int = 5, num: int = 75, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and class_id of every row of docs.

    Two documents link when den * |common| >= num * |union| of their sets of word n-grams. component_id is the smallest
    doc_id that links lead to, class_id the smallest of those with an equal set.
    """
    small_batches(docs)
    size = plan_bytes(docs.select(text))
    known = size < 1 << 55  # Catalyst takes a huge size for what it can't estimate
    bits = min(26, max(6, round(np.log2(max(1, size / BUCKET_BYTES))))) if known else 12
    given = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    packed = given.mapInArrow(_pack(n, bits), _PACKED)
    # more tasks than the session has partitions, if these would get too much; a task holds one bucket at a time
    tasks = size // TASK_BYTES if known else 0
    dealt = packed.repartition(tasks, "bucket") if tasks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else packed.repartition("bucket")
    met = stash(dealt.sortWithinPartitions("bucket").mapInArrow(_meet(bits), _MET), "met")
    rows = met.where("kind = 0").select("doc_id", F.col("class"), F.col("size").cast("long").alias("n_shingles"))
    # a class of many copies has the same common n-grams in many packs
    packs = met.where("kind = 1").select("class", "size", "keys").union(met.where("kind = 2").select("class", "size", "keys").distinct())
    sets = stash(packs.groupBy("class").agg(F.first("size").alias("size"), F.collect_list("keys").alias("keys")).mapInArrow(_prefixes(num, den), "class long, size int, keys binary, prefix array<long>, parity array<long>"), "sets")
    # positions count from 0; n-grams of one class alone come before those of its keys
    unshared = F.col("size") - (F.length("keys") / 8).cast("int")
    placed = sets.select("class", "size", "prefix", unshared.alias("before"), F.posexplode("prefix").alias("nth", "key")).withColumn("x", F.struct("class", "size", (F.col("before") + F.col("nth")).alias("at")))
    links, roots, tried = None, None, None
    # tables between the steps leave plain joins on the key, of which Spark can split hot ones
    for turn in range(HUB_ROUNDS + 1):
        here = placed.select("key", "x")
        own: list[DataFrame] = []

        def kept(df: DataFrame, label: str, own: list[DataFrame] = own) -> DataFrame:
            own.append(stash(df, label))
            return own[-1]

        if roots is not None:
            here = here.join(roots.withColumnRenamed("node", "class").alias("r"), F.col("x.class") == F.col("r.class"), "left").select("key", "x", F.coalesce("root", "x.class").alias("root"))
            open_keys = kept(here.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"), "open-keys")
            here = kept(here.join(open_keys, "key", "left_semi"), "open")
        if turn < HUB_ROUNDS:
            order = F.col("x.class") if turn == 0 else F.xxhash64("x.class", F.lit(turn))
            hubs = kept(here.groupBy("key").agg(F.min_by("x", order).alias("y"), F.count("*").alias("n")).where("n > 1").drop("n"), "hubs")
            pairs = here.join(hubs, "key").where((F.col("x.class") != F.col("y.class")) & _fits(num, den))
        else:
            # every class outside the list's largest component, against all classes of other components, if as many
            # common items as they need are possible by their bitmaps
            marks = sets.select(F.col("class").alias("of"), (F.length("keys") / 8).cast("int").alias("shared"), "parity")
            marked = here.join(marks, F.col("x.class") == F.col("of")).drop("of")
            parts = here.groupBy("key", "root").agg(F.count("*").alias("n"))
            main = kept(parts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main")), "main")
            tagged = kept(marked.join(main, "key"), "tagged")
            minor = tagged.where("root <> main").select("key", F.col("x").alias("y"), F.col("root").alias("root_y"), F.col("shared").alias("shared_y"), F.col("parity").alias("parity_y"))
            differ = sum((F.bit_count(F.get("parity", F.lit(i)).bitwiseXOR(F.get("parity_y", F.lit(i)))) for i in range(PARITY_WORDS)), F.lit(0))
            enough = F.col("shared") + F.col("shared_y") - differ >= 2 * F.ceil(num * (F.col("x.size") + F.col("y.size")) / F.lit(num + den))
            pairs = tagged.join(minor, "key").where((F.col("root_y") != F.col("root")) & ((F.col("root") == F.col("main")) | (F.col("x.class") < F.col("y.class"))) & _fits(num, den) & enough)
        pairs = pairs.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()
        # a pair is verified once, in the first round that meets it
        fresh = stash(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        found = stash(_linked(fresh, sets, num, den), "links")
        tried = fresh if tried is None else tried.union(fresh)
        for table in own:
            unstash(table)
        if turn and not found.limit(1).count():
            continue
        links = found if links is None else links.union(found)
        roots = components(links)
    least = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("class_id"))
    grouped = roots.withColumnRenamed("node", "class").join(least, "class")
    top = grouped.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = least.join(grouped.join(top, "root").select("class", "component_id"), "class", "left").select("class", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    own = F.col("class").isNull()
    return rows.join(named, "class", "left").select("doc_id", "n_shingles", F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))
