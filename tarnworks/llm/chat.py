"""Chat formatting over a prefix tree of conversations.

Conversations that begin with equal turns share the nodes of those turns; a node stands for a turn and all turns before it.
The packed output has each node's text once, depth first. Every node has its place in that output, the position ids of
its characters (its distance from the root) and the intervals of its ancestors that it may attend to.

The template is `<|role|>`, a line feed, the text, `<|end|>`, a line feed. In roles and texts `<` and `[` are followed by a
backslash, and in roles `|` too, so that no control string of this or another template can appear in them; taking those
backslashes out again gives the text back. The loss mask covers the texts of assistant turns.

Each node is owned by the least conversation that has it, so a conversation owns the end of its chain. Its nodes lie
together and are followed by the branches off them, the deepest first. That is a depth-first order, and its key is bounded:
the rank of the owner, then the depth. The rank is that of the owners from the root down, one entry for each change of
owner; the k-th owner has k turns at least, so n turns allow about sqrt(2 * n) entries. So a tree whose root a third of all
conversations share is laid out by many tasks.

Conversations are streams of rows in order of turns, not arrays: a long one needs no more memory than a short one, but
one task goes through it. Only `attention` has a row for a conversation, by contract. Null texts and roles are empty; turns are ordered by turn, role and text;
null conv_ids make one conversation; repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnworks.llm.features import small_batches
from tarnworks.session import stash

END = "<|end|>\n"
DIGEST = 16
#: Rows and characters of a batch that Python gives back.
ROWS = 2000
CHARS = 4_000_000


def escape(text: str) -> str:
    return text.replace("<", "<\\").replace("[", "[\\")


def unescape(text: str) -> str:
    return text.replace("[\\", "[").replace("<\\", "<")


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its loss mask begins and ends; both 0 for turns that aren't an assistant's."""
    head = "<|" + escape(role).replace("|", "|\\") + "|>\n"
    body = escape(text)
    return head + body + END, *((len(head), len(head) + len(body)) if role == "assistant" else (0, 0))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        close = formatted.index("|>\n", at)
        end = formatted.index(END, close)
        turns.append((unescape(formatted[at + 2 : close].replace("|\\", "|")), unescape(formatted[close + 3 : end])))
        at = end + len(END)
    return turns


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per turn, with the node that it ends in. Rows come by conversation in order of turns."""
    names = ["conv_id", "nth", "node", "segment", "position", "loss_begin", "loss_end"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    current: object = _chains  # no conversation yet; None is one
    node, nth, position = "", 0, 0
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv != current:
                current, node, nth, position = conv, "", 0, 0
            segment, a, b = format_turn(role, text)
            node = hashlib.sha256(f"{node}\n{segment}".encode()).hexdigest()[: 2 * DIGEST]
            rows.append((conv, nth, node, segment, position, a, b))
            nth += 1
            position += len(segment)
            held += len(segment)
            if len(rows) >= ROWS or held >= CHARS:
                yield _batch(rows, names, kinds)
                rows, held = [], 0
    if rows:
        yield _batch(rows, names, kinds)


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered nodes of one partition with the characters before each in the partition."""
    before = 0
    for batch in batches:
        size = batch.column("size").to_pylist()
        begin = []
        for n in size:
            begin.append(before)
            before += n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(begin, pa.int64())], names=[*batch.schema.names, "begin"])


def _ranks(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """(owner, rank) of the conversations that own nodes, in depth-first order. rows: who, nth, node; owners: node, owner."""
    changes = rows.join(owners, "node").groupBy("who", "owner").agg(F.min("nth").alias("depth"))
    entry = F.struct("depth", "owner")
    ways = changes.groupBy("who").agg(F.sort_array(F.collect_list(entry)).alias("way"), F.max("owner").alias("last")).where("who = last")
    # owners come as strings of 16 digits, or null's; the deepest branch is first
    step = lambda x: F.concat(F.lpad(F.hex(F.lit(2**31 - 1) - x["depth"]), 8, "0"), F.rpad(x["owner"], 16, " "))
    keys = ways.select(F.col("who").alias("owner"), F.array_join(F.transform("way", step), "").alias("key"))
    return stash(keys.repartitionByRange("key").sortWithinPartitions("key").select("owner", F.monotonically_increasing_id().alias("rank")), "ranks")


def prefix_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and chains of conversations (conv_id, turn, role, text).

    nodes: node, path, segment, position (id of its first character), loss_begin, loss_end (in its segment), and packed_begin
    and packed_end, its interval of the packed output, whose order is that of path. chains: conv_id, nth turn, node.
    """
    small_batches(conversations)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = stash(turns.mapInArrow(_chains, "conv_id long, nth int, node string, segment string, position long, loss_begin long, loss_end long"), "chains")
    who = F.coalesce(F.lpad(F.hex("conv_id"), 16, "0"), F.lit("null"))
    owners = stash(rows.groupBy("node").agg(F.min(who).alias("owner")), "owners")
    # equal nodes have equal rows
    tree = rows.groupBy("node").agg(F.min(who).alias("owner"), *[F.first(c).alias(c) for c in ("nth", "segment", "position", "loss_begin", "loss_end")])
    tree = tree.join(_ranks(rows.select(who.alias("who"), "nth", "node"), owners), "owner").drop("owner")
    path = F.concat(F.lpad(F.hex("rank"), 16, "0"), F.when(F.col("nth") > 0, F.lpad(F.hex("nth"), 8, "0")).otherwise(""))
    tree = tree.select("node", path.alias("path"), "segment", "position", "loss_begin", "loss_end")
    tree = tree.withColumn("size", F.length("segment").cast("long")).repartitionByRange("path").sortWithinPartitions("path")
    schema = tree.select("*").schema.add("begin", "long")
    placed = stash(tree.mapInArrow(_laid_out, schema).withColumn("part", F.spark_partition_id()), "nodes")
    # a number for each partition; their order is that of the paths
    total = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.sum("size").alias("n")).collect()}
    offset, before = {}, 0
    for p in sorted(total):
        offset[p], before = before, before + total[p]
    offsets = placed.sparkSession.createDataFrame(list(offset.items()) or [(0, 0)], "part int, offset long")
    begin = F.col("begin") + F.col("offset")
    nodes = placed.join(F.broadcast(offsets), "part").select("node", "path", "segment", "position", "loss_begin", "loss_end", begin.alias("packed_begin"), (begin + F.col("size")).alias("packed_end"))
    return nodes, rows.select("conv_id", "nth", "node")


def attention(nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """conv_id and, from the root down, its nodes' (nth, packed_begin, packed_end, position): the intervals a turn attends to are those before it."""
    own = F.struct("nth", "packed_begin", "packed_end", "position")
    return chains.join(nodes, "node").groupBy("conv_id").agg(F.sort_array(F.collect_list(own)).alias("intervals"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per conversation. Rows come by conversation in order of turns; no control string crosses a turn's end."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    current: object = _digests  # no conversation yet; None is one
    n, loss_chars, chars, turns_hash, loss_hash = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
    rows: list[tuple] = []
    for batch in batches:
        for conv, segment, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_begin", "loss_end")), strict=True):
            if conv != current:
                if current is not _digests:
                    rows.append((current, n, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars))
                current, n, loss_chars, chars, turns_hash, loss_hash = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for role, text in parse(segment):
                turns_hash.update(f"{role}\n{text}\n".encode())
                n += 1
            loss = unescape(segment[a:b])
            loss_hash.update(loss.encode())
            loss_chars += len(loss)
            chars += len(segment)
        if len(rows) >= ROWS:
            yield _batch(rows, names, kinds)
            rows = []
    if current is not _digests:
        rows.append((current, n, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars))
        yield _batch(rows, names, kinds)


def read_back(nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """Digests of each conversation, put together from its nodes."""
    joined = chains.join(nodes, "node").select("conv_id", "nth", "segment", "loss_begin", "loss_end")
    joined = joined.repartition("conv_id").sortWithinPartitions("conv_id", "nth")
    return joined.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
