"""Sharding of near equal bytes by histogram sort, in DataFrame functions only.

Rows are ordered by a 63-bit key: 32 bits of the text's hash, then 31 bits of the row's, so that equal texts lie together
and yet can be cut. Each round counts the bytes below candidate boundaries over all partitions and probes closer only
where a splitter still misses its share by more than the tolerance. Then rows are exchanged once, into pieces of a shard.

Null texts have no bytes and null ids hash like any value. Rows with equal keys aren't parted: apart from hash collisions
those are copies of one text with one doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnworks.session import stash

KEY_BITS = 63
#: A splitter may miss its share by a shard's bytes over this number.
TOLERANCE = 2000
#: One round counts at most about this many boundaries.
PROBES = 65_536
#: Each shard is exchanged in at least this many pieces and at most PIECES, of about ROWS_A_PIECE rows.
PIECES, LEAST_PIECES, ROWS_A_PIECE = 40, 4, 200_000


def splitters(sized: DataFrame, parts: int, tolerance: float, key: str = "key", size: str = "size") -> list[int]:
    """parts - 1 ascending keys; the bytes of rows below the i-th are within tolerance of i / parts of all, where the keys allow."""
    total = sized.agg(F.sum(size)).first()[0] or 0
    want = {i: total * i / parts for i in range(1, parts)}
    done: dict[int, int] = {}
    # open intervals: (first key, bits of width) -> bytes below it and the targets inside
    open_at = {(0, KEY_BITS): (0, list(want))}
    while open_at:
        bits = next(iter(open_at))[1]
        step = max(1, min(bits, (PROBES // len(open_at)).bit_length() - 1))
        shift = bits - step
        inside = sized if bits == KEY_BITS else sized.where(F.shiftright(key, bits).isin([lo >> bits for lo, _ in open_at]))
        counts = {r[0]: r[1] for r in inside.groupBy(F.shiftright(key, shift).alias("cell")).agg(F.sum(size)).collect()}
        cells: dict[int, list[int]] = {}
        for cell in counts:
            cells.setdefault(cell >> step, []).append(cell)
        after: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for (lo, _), (below, targets) in open_at.items():
            todo = list(targets)
            for cell in sorted(cells.get(lo >> bits, [])):
                above = below + counts[cell]
                here = [t for t in todo if want[t] <= above]
                todo = todo[len(here) :]
                far = []
                for t in here:
                    if want[t] - below <= tolerance or shift == 0 and want[t] - below <= above - want[t]:
                        done[t] = cell << shift
                    elif above - want[t] <= tolerance or shift == 0:
                        done[t] = (cell + 1) << shift
                    else:
                        far.append(t)
                if far:
                    after[(cell << shift, shift)] = (below, far)
                below = above
            done |= dict.fromkeys(todo, lo + (1 << bits))
        open_at = after
    return [min(done[i], 2**KEY_BITS - 1) for i in range(1, parts)]


def shard_key(doc_id: Column, text: Column) -> Column:
    high = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    low = F.xxhash64(doc_id, F.lit("row")).bitwiseAND(F.lit(0x7FFFFFFF).cast("bigint"))
    return F.shiftleft(high, 31).bitwiseOR(low)


def shard_by_bytes(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs; slot counts the rows of a shard from 0 in key order."""
    t = F.coalesce(F.col(text), F.lit(""))
    sized = stash(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 8).cast("bigint").alias("size"), F.crc32(t).alias("text_crc32"), shard_key(F.col(doc_id), F.col(text)).alias("key")), "sized")
    rows, total = sized.agg(F.count("*"), F.sum("size")).first()
    pieces = max(LEAST_PIECES, min(PIECES, rows // (shards * ROWS_A_PIECE) + 1))
    cuts = splitters(sized, shards * pieces, (total or 0) / shards / TOLERANCE)
    below = F.array(*[F.lit(c).cast("bigint") for c in cuts])
    placed = sized.withColumn("piece", F.size(F.filter(below, lambda c: c <= F.col("key"))))
    count = {r[0]: r[1] for r in placed.groupBy("piece").count().collect()}  # a number for each piece
    first, starts = 0, []
    for p in range(shards * pieces):
        first = 0 if p % pieces == 0 else first
        starts.append(first)
        first += count.get(p, 0)
    order = Window.partitionBy("piece").orderBy("key", "doc_id", "text_crc32", "size")
    slot = F.get(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.col("piece")) + F.row_number().over(order) - 1
    return placed.select("doc_id", "size", "text_crc32", F.floor(F.col("piece") / pieces).cast("int").alias("shard"), slot.cast("bigint").alias("slot"))
