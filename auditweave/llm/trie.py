"""The prefix trie of conversations, by truncation peeling.

A conversation is a path: for each turn 24 bytes, a hash of role and text and the text's length. Equal paths are merged first; the
ids that end at a path are put in order by ranges, so that only the digest itself runs through one task. Paths are then sorted
into ranges, and each range is cut into blocks of bounded size. A block is peeled: from its greatest depth down, nodes whose
conversations end there are merged with the nodes that survived the depth below, each node is finished, and with its last turn
stripped it joins its siblings in their parent. Counts, sums and the smallest member are gathered on the way.

Nodes on the first or last path of a block may go on in the next block: they stay open, and a block gives them up as two chains
(path, and what is known of each of its nodes). Chains are sorted and peeled again, 32 or more to a block, until the few that
are left fit one last block in which nothing is open. A child whose parent is open notes the chain; the parent's id is
looked up afterwards, by range and depth, which no key repeats beyond a block. So a hot first turn is spread over blocks, a
conversation of many turns costs its own length, and no step waits for the depth.

Rows without an id belong to no conversation. Null role and text are empty. Turns are ordered by turn (nulls first), then role,
then text. Other columns are not read; ids must be whole numbers. Without conversations there are no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bytes of a turn in a path.
STEP = 24
BLOCK_BYTES, BLOCK_ROWS, LAST_ROWS, BLOB_BYTES = 4 << 20, 64, 4096, 1 << 20
_EMPTY = hashlib.sha256(b"").hexdigest()


def _step() -> Column:
    """A turn in hexadecimal digits: md5 of role and text, and the text's length in UTF-8 bytes."""
    digest = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"))
    return F.concat(digest, F.lpad(F.hex(F.octet_length("text").cast("long")), 16, "0"))


def _joined(steps: DataFrame) -> DataFrame:
    ordered = F.transform(F.sort_array(F.collect_list("turn")), lambda t: t["step"])  # collect_list leaves nulls out
    return steps.groupBy("conv_id").agg(F.unhex(F.array_join(ordered, "")).alias("path"))


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 0) and step of each turn."""
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role, text).filter(F.col("conv_id").isNotNull())
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return turns.withColumn("at", F.row_number().over(order) - 1).select("conv_id", "at", _step().alias("step"))


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id and path of each conversation as it is."""
    return _joined(numbered(conversations).select("conv_id", F.struct("at", "step").alias("turn")))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and path of each conversation c with its head exchanged: h turns of conversation c - c % 5, then its own after h, where h = crc32(c) % 9."""
    turns = written(numbered(conversations), "trie-turns")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    all_ids = turns.filter("at = 0").select("conv_id", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    heads = turns.filter("at < 8").select(F.col("conv_id").alias("base"), "at", "step")
    first = all_ids.join(heads, "base", "left").select("conv_id", F.when(F.col("at") < F.col("head"), F.struct(F.lit(0).alias("half"), "at", "step")).alias("turn"))
    rest = turns.filter(F.col("at") >= head).select("conv_id", F.struct(F.lit(1).alias("half"), "at", "step").alias("turn"))
    return _joined(first.unionByName(rest))


def _row_batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 2000):
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 2000], strict=True), schema, strict=True)], schema=schema)


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True)


_BLOBS = pa.schema([("path", pa.binary()), ("first_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids with one path, in order, joined by commas."""
    rows, ids, path, size, held = [], [], None, 0, 0
    for conv_id, its_path in _sorted_rows((b.select(["conv_id", "path"]) for b in batches)):
        if ids and (its_path != path or size >= BLOB_BYTES):
            rows.append((path, ids[0], len(ids), ",".join(map(str, ids)).encode()))
            held += size + len(path)
            ids, size = [], 0
            if held >= BLOCK_BYTES:
                yield from _row_batches(rows, _BLOBS)
                rows, held = [], 0
        path = its_path
        ids.append(conv_id)
        size += 20
    if ids:
        rows.append((path, ids[0], len(ids), ",".join(map(str, ids)).encode()))
    yield from _row_batches(rows, _BLOBS)


_PART = [("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
_CHAINS = pa.schema([("zone", pa.int64()), ("side", pa.int32()), ("path", pa.binary()), ("parts", pa.list_(pa.struct(_PART)))])
_CHAIN_DDL = "zone long, side int, path binary, parts array<struct<depth:long,conv_id:long,n_convs:long,n_children:long,n_leaves:long,saved_tokens:long,ends_sha256:string>>"


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chain of one node for each path, with the digest of the ids that end there."""
    rows, path, first, count, digest = [], None, 0, 0, None

    def row() -> tuple:
        part = (len(path) // STEP, first, count, 0, 0, 0, digest.hexdigest())
        return None, None, path, [dict(zip((f[0] for f in _PART), part, strict=True))]

    for its_path, first_id, n, ids in _sorted_rows(b.select(_BLOBS.names) for b in batches):
        if its_path != path:
            if path is not None:
                rows.append(row())
            if len(rows) >= 2000:
                yield from _row_batches(rows, _CHAINS)
                rows = []
            path, first, count, digest = its_path, first_id, 0, hashlib.sha256()
        digest.update(b"," * (count > 0) + ids)
        count += n
    if path is not None:
        rows.append(row())
    yield from _row_batches(rows, _CHAINS)


def ended(convs: DataFrame) -> DataFrame:
    """Distinct paths of (conv_id, path), as chains: smallest id, number and digest of the ids."""
    runs = convs.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "path").mapInArrow(_blobs, "path binary, first_id long, n long, ids binary")
    return runs.repartition("path").sortWithinPartitions("path", "first_id").mapInArrow(_ended, _CHAIN_DDL)


@dataclass
class Node:
    """What is known of a node so far; `children`: rows of finished children, `slots`: chains that told of it."""

    conv_id: int | None = None
    n_convs: int = 0
    n_children: int = 0
    n_leaves: int = 0
    saved_tokens: int = 0
    ends_sha256: str | None = None
    children: list[int] = field(default_factory=list)
    slots: list[tuple[int, int]] = field(default_factory=list)

    def add(self, conv_id: int | None, n_convs: int, n_children: int, n_leaves: int, saved_tokens: int, ends_sha256: str | None = None) -> None:
        if conv_id is not None:
            self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)
        self.n_convs += n_convs
        self.n_children += n_children
        self.n_leaves += n_leaves
        self.saved_tokens += saved_tokens
        self.ends_sha256 = ends_sha256 or self.ends_sha256


class Block:
    """Peels chains that are sorted by path. Rows: finished nodes, then `links` (what became of chains' nodes) and `chains` (open nodes)."""

    def __init__(self, chains: list[tuple], zone: int, whole: bool) -> None:
        self.nodes: list[list] = []
        self.links: list[tuple] = []
        self.zone = zone
        first, last = (chains[0][2], chains[-1][2]) if not whole else (None, None)
        shared = _common(first, last) if not whole else 0
        opened: tuple[dict[int, tuple], dict[int, tuple]] = {}, {}
        arriving: dict[int, list[tuple]] = {}
        for from_zone, from_side, path, parts in chains:
            for part in parts:
                arriving.setdefault(part["depth"], []).append((path[: part["depth"] * STEP], from_zone, from_side, part))
        level: dict[bytes, Node] = {}
        depth = max(arriving)
        while depth >= 0:
            for path, from_zone, from_side, part in arriving.pop(depth, ()):
                node = level.setdefault(path, Node())
                node.add(*(part[name] for name, _ in _PART[1:]))
                if from_zone is not None:
                    node.slots.append((from_zone, from_side))
            above: dict[bytes, Node] = {}
            for path, node in level.items():
                side = None
                if not whole:
                    side = 0 if first.startswith(path) else 1 if last.startswith(path) else None
                if side is None:
                    self._finish(path, depth, node, above)
                else:
                    opened[side if depth > shared else 0][depth] = (node.conv_id, node.n_convs, node.n_children, node.n_leaves, node.saved_tokens, node.ends_sha256)
                    for row in node.children:
                        self.nodes[row][-2:] = [zone, side]
                    self.links += [(*slot, depth, None, zone, side) for slot in node.slots]
            level = above
            depth = depth - 1 if level or not arriving else max(arriving)
        self.chains = [(zone, side, path[: max(own) * STEP], [dict(zip((f[0] for f in _PART), (d, *own[d]), strict=True)) for d in sorted(own)]) for side, path, own in ((0, first, opened[0]), (1, last, opened[1])) if own]

    def _finish(self, path: bytes, depth: int, node: Node, above: dict[bytes, Node]) -> None:
        leaves = node.n_leaves if node.n_children else 1
        saved = node.saved_tokens + (node.n_convs - 1) * int.from_bytes(path[-8:], "big")  # nothing for the root's empty path
        for row in node.children:
            self.nodes[row][2] = node.conv_id
        self.links += [(*slot, depth, node.conv_id, None, None) for slot in node.slots]
        self.nodes.append([node.conv_id, depth, None, node.n_convs, node.n_children, leaves, saved, node.ends_sha256 or _EMPTY, None, None])
        if depth:
            parent = above.setdefault(path[:-STEP], Node())
            parent.add(node.conv_id, node.n_convs, 1, leaves, saved)
            parent.children.append(len(self.nodes) - 1)


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    n = 0
    while n < min(len(a), len(b)) // STEP and a[n * STEP : (n + 1) * STEP] == b[n * STEP : (n + 1) * STEP]:
        n += 1
    return n


_NODES = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), *((n, pa.int64()) for n in ("n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()), ("to_zone", pa.int64()), ("to_side", pa.int32())]
#: kind 0: a finished node, under an open parent if to_zone is set; 1: node (zone, side, depth) of a chain, finished with conv_id or again open; 2: a chain
_OUT = pa.schema([("kind", pa.int32()), *_NODES, *_CHAINS])
_OUT_DDL = f"kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, to_zone long, to_side int, {_CHAIN_DDL}"


def _peel(whole: bool):
    def peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zone, chains, size = TaskContext.get().partitionId() << 32, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            block = Block(chains, zone, whole)
            yield from _row_batches([(0, *node, *(None,) * 4) for node in block.nodes], _OUT)
            yield from _row_batches([(1, conv_id, depth, *(None,) * 6, to_zone, to_side, from_zone, from_side, None, None) for from_zone, from_side, depth, conv_id, to_zone, to_side in block.links], _OUT)
            yield from _row_batches([(2, *(None,) * 10, *chain) for chain in block.chains], _OUT)

        for chain in _sorted_rows(b.select(_CHAINS.names) for b in batches):
            if size >= BLOCK_BYTES and len(chains) >= BLOCK_ROWS and not whole:
                yield from close()
                zone, chains, size = zone + 1, [], 0
            chains.append(chain)
            size += len(chain[2]) + 100 * len(chain[3])
        if chains:
            yield from close()

    return peel


def trie(convs: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, path): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    chains, rounds, whole = written(ended(written(convs, "trie-paths")), "trie-ended"), [], False
    while not whole:
        whole = len(chains.select("side").head(LAST_ROWS + 1)) <= LAST_ROWS
        dealt = chains.coalesce(1) if whole else chains.repartitionByRange("path")
        out = written(dealt.sortWithinPartitions("path").mapInArrow(_peel(whole), _OUT_DDL), "trie-peeled")
        rounds.append(out)
        chains = out.filter("kind = 2").select(*_CHAINS.names)
    slot = ["to_zone", "to_side", "depth"]
    known, found = None, []
    for out in reversed(rounds):
        nodes = out.filter("kind = 0").select(*(name for name, _ in _NODES))
        if known is not None:
            parents = known.select(*slot[:2], (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("_parent"))
            nodes = nodes.join(parents, slot, "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent"))
        found.append(nodes.select(*(name for name, _ in _NODES[:-2])))
        links = out.filter("kind = 1").select("zone", "side", "depth", "conv_id", *slot[:2])
        if known is not None:
            links = links.join(known.withColumnRenamed("conv_id", "_known"), slot, "left").withColumn("conv_id", F.coalesce("conv_id", "_known"))
        known = links.select(F.col("zone").alias("to_zone"), F.col("side").alias("to_side"), "depth", "conv_id")
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    return nodes
