"""Conversation prefix trie: what conversations share from their first turn on, with the words a shared prefix saves.

A conversation is a path of turns, held as the 16-byte digests of its turns one after the other, so that paths sort
like the trie in preorder and a node is a beginning of a path. Equal paths merge first. Paths are then dealt in ranges:
each shard streams its paths in order and encodes its part of the trie as **balanced parentheses**, one opened and one
closed per node. ``findclose`` (over blocks that know the least and the greatest excess in them, and a tree of such
ranges above) delimits every subtree, the rank of ``()`` pairs counts its leaves, and cumulative arrays give members and
savings.

Only nodes on the first and the last path of a shard, its **spines**, can have members elsewhere. They go on as short
rows with what hangs below them already added up; spines of all shards merge in the same way, by the same code, in ever
fewer shards. A shard holds its nodes (some fifty bytes each), never the turns' texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from almagest.llm.common import cut

# Bytes of a turn's digest.
DIGEST = 16
# Parentheses per block of the excess tree.
BLOCK = 64
# Ids of one path are listed in pieces by id, two to this power numbers to a piece.
PIECE_BITS = 12
# Spines of this many shards merge in one.
FAN = 256
# Spines are sent to the tasks only when their keys measure at most this many bytes.
SENT_BYTES = 32 << 20

NO_ID = np.iinfo(np.int64).max
NOBODY = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """Balanced parentheses of a tree given by the depths of its nodes in preorder; the root has depth 0."""

    def __init__(self, depth: np.ndarray):
        nodes = len(depth)
        self.open = 2 * np.arange(nodes) - depth
        self.bits = np.zeros(2 * nodes, bool)
        self.bits[self.open] = True
        excess = np.cumsum(np.where(self.bits, 1, -1))
        blocks = max(1, -(-len(excess) // BLOCK))
        # Padding lies above every excess, so that it is never found.
        self.excess = np.full(blocks * BLOCK, nodes + 1, np.int64)
        self.excess[: len(excess)] = excess
        rows = self.excess.reshape(blocks, BLOCK)
        self.least, self.most = [rows.min(axis=1)], [rows.max(axis=1)]
        while len(self.least[-1]) > 1:
            for levels, fold, pad in ((self.least, np.minimum, nodes + 1), (self.most, np.maximum, -1)):
                level = levels[-1]
                level = np.append(level, pad) if len(level) % 2 else level
                levels.append(fold(level[::2], level[1::2]))

    def findclose(self) -> np.ndarray:
        """Place of the closing parenthesis of each node: the next place with an excess of one less."""
        target = self.excess[self.open] - 1
        block = self.open // BLOCK
        close = self._within(block, target, self.open % BLOCK)
        far = np.flatnonzero(close < 0)
        found = self._block_after(block[far], target[far])
        close[far] = self._within(found, target[far], np.full(len(far), -1))
        return close

    def _within(self, block: np.ndarray, target: np.ndarray, after: np.ndarray) -> np.ndarray:
        """First place of that excess in the block behind the place ``after``; -1 if there is none."""
        out, rows, places = np.full(len(block), -1, np.int64), self.excess.reshape(-1, BLOCK), np.arange(BLOCK)
        for at in range(0, len(block), 1 << 14):
            part = slice(at, at + (1 << 14))
            fits = (rows[block[part]] == target[part, None]) & (places > after[part, None])
            some = fits.any(axis=1)
            out[part] = np.where(some, block[part] * BLOCK + fits.argmax(axis=1), -1)
        return out

    def _block_after(self, block: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Next block whose range of excess holds the target: up the tree to a right neighbour that does, then down."""
        at, level_of = block.copy(), np.full(len(block), -1)
        for level in range(len(self.least)):
            least, most = self.least[level], self.most[level]
            right = np.minimum(at + 1, len(least) - 1)
            fits = (level_of < 0) & (at % 2 == 0) & (right > at) & (least[right] <= target) & (target <= most[right])
            at = np.where(fits, right, np.where(level_of < 0, at // 2, at))
            level_of[fits] = level
        for level in range(len(self.least) - 1, 0, -1):
            down = level_of >= level
            left = 2 * at
            fits = (self.least[level - 1][np.minimum(left, len(self.least[level - 1]) - 1)] <= target) & down
            at = np.where(down, np.where(fits, left, left + 1), at)
        return at


def _over(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum of the values of each subtree, by a cumulative array."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first + size] - total[first]


class _Shard:
    """Nodes of one shard in preorder, from rows in the order of their paths."""

    def __init__(self):
        self.path, self.trail = b"", []
        self.paths, self.row_of = [], []  # path of a row; the row that brought a node
        self.depth, self.parent, self.words = [], [], []
        self.n, self.least, self.children, self.leaves, self.saved = [], [], [], [], []
        self.ends: dict[int, str] = {}
        self.digest, self.listed, self.left = None, 0, []

    def _node(self, depth: int, words: int) -> None:
        self.parent.append(self.trail[-1] if self.trail else -1)
        self.trail.append(len(self.depth))
        self.row_of.append(len(self.paths) - 1)
        self.depth.append(depth)
        self.words.append(words)
        for column, empty in ((self.n, 0), (self.least, NO_ID), (self.children, 0), (self.leaves, 0), (self.saved, 0)):
            column.append(empty)

    def at(self, path: bytes, words: list[int]) -> int:
        """The node of a path, made with all above it that are new; ``words`` are those of its last nodes, others are unknown."""
        if not self.paths or path != self.path:
            self._end_list()
            self.paths.append(path)
            depth, shared = len(path) // DIGEST, 0
            if not self.trail:
                self._node(0, 0)
            limit = min(depth, len(self.path) // DIGEST)
            while shared < limit and path[shared * DIGEST : (shared + 1) * DIGEST] == self.path[shared * DIGEST : (shared + 1) * DIGEST]:
                shared += 1
            del self.trail[shared + 1 :]
            for d in range(shared + 1, depth + 1):
                place = d - 1 - depth + len(words)
                self._node(d, words[place] if place >= 0 else -1)
            self.path = path
            if len(self.paths) == 1:
                self.left = list(self.trail)
        node = self.trail[-1]
        if words:
            self.words[node] = max(self.words[node], words[-1])
        return node

    def members(self, node: int, ids: str) -> None:
        """Another piece of the ids that end at the node, in order."""
        if self.digest is None:
            self.digest, self.listed = hashlib.sha256(ids.encode()), node
        else:
            self.digest.update(f",{ids}".encode())

    def _end_list(self) -> None:
        if self.digest is not None:
            self.ends[self.listed], self.digest = self.digest.hexdigest(), None

    def key(self, node: int) -> bytes:
        return self.paths[self.row_of[node]][: self.depth[node] * DIGEST]

    def rows(self, last: bool, named: bool) -> dict[str, list]:
        """Finished nodes, and those on the two spines with what hangs below them; all are finished in the last shard.

        ``named`` gives finished nodes their path as well: nodes finished earlier may ask for them as parents.
        """
        self._end_list()
        nodes = len(self.depth)
        columns = (self.depth, self.parent, self.words, self.n, self.least, self.children, self.leaves, self.saved)
        depth, parent, words, n, least, children, leaves, saved = (np.array(c, np.int64) for c in columns)
        spine = np.zeros(nodes, bool)
        if not last:
            spine[self.left], spine[self.trail] = True, True
        shape, first = Parentheses(depth), np.arange(nodes)
        size = (shape.findclose() - shape.open + 1) // 2
        held = _over(n, first, size)
        inner = parent >= 0
        below, beside = inner & spine, inner & ~spine
        children = children + np.bincount(parent[beside], minlength=nodes)
        # The rank of pairs counts leaves; a node with children that were finished earlier is none, one on a spine not yet.
        pairs = shape.bits & ~np.append(shape.bits[1:], True)
        leaves = _over(leaves + (pairs[shape.open] & (children == 0) & ~spine), first, size)
        saved = _over(saved + np.where(spine, 0, (held - 1) * words), first, size)
        own, layers = least.copy(), np.argsort(depth, kind="stable")
        starts = np.searchsorted(depth[layers], np.arange(int(depth.max()) + 2))
        for d in range(len(starts) - 2, 0, -1):
            at = layers[starts[d] : starts[d + 1]]
            np.minimum.at(least, parent[at], least[at])
        # A spine hands on what is its own and what hangs below it beside the spines.
        np.minimum.at(own, parent[beside], least[beside])
        parts = []
        for total in (held, leaves, saved):
            part = total.copy()
            np.subtract.at(part, parent[below], total[below])
            parts.append(np.where(spine, part, total))
        above = np.where(inner, parent, 0)
        known = beside & ~spine[above]
        keys = dict.fromkeys(np.flatnonzero(spine).tolist() if not named else range(nodes))
        asked = set(np.flatnonzero(beside & spine[above]).tolist())
        return {
            "finished": (~spine).tolist(),
            "path": [self.key(k) if k in keys else None for k in range(nodes)],
            "depth": depth.tolist(),
            "words": words.tolist(),
            "n": parts[0].tolist(),
            "conv_id": np.where(spine, own, least).tolist(),
            "ends": [self.ends.get(k) for k in range(nodes)],
            "children": children.tolist(),
            "leaves": parts[1].tolist(),
            "saved": parts[2].tolist(),
            "parent_id": [p if k else None for p, k in zip(least[above].tolist(), known.tolist())],
            "parent_path": [self.key(self.parent[k]) if k in asked else None for k in range(nodes)],
        }


NODES = (
    "finished boolean, path binary, depth bigint, words bigint, n bigint, conv_id bigint, ends string, children bigint, leaves bigint, saved bigint, "
    "parent_id bigint, parent_path binary"
)


def _encoded(last: bool = False, spines: bool = False):
    """Nodes of a shard from its paths in order, or from the spines of shards before it."""
    target = to_arrow_schema(T.StructType.fromDDL(NODES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for row in batch.to_pylist():
                node = shard.at(row["path"], [row["words"]] if spines else row["words"])
                shard.n[node] += row["n"]
                shard.least[node] = min(shard.least[node], row["conv_id"])
                if not spines:
                    shard.members(node, row["ids"])
                    continue
                if row["ends"] is not None:
                    shard.ends[node] = row["ends"]
                for column, name in ((shard.children, "children"), (shard.leaves, "leaves"), (shard.saved, "saved")):
                    column[node] += row[name]
        if shard.depth:
            out = pa.RecordBatch.from_pydict(shard.rows(last, spines), schema=target)
            for at in range(0, len(out), 1 << 16):
                yield out.slice(at, 1 << 16)

    return run


def sequences(rows: DataFrame) -> DataFrame:
    """conv_id and ``turns``: digest (hex) and number of words of each turn, in order.

    ``rows`` has conv_id, turn, role and text, other columns are ignored. Turns go by ``turn``, null first, and those with
    the same number by digest. Null role and text are empty; rows without a conv_id are in no conversation.
    Only digests are shuffled, no texts; words are runs of anything but white space.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * DIGEST)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    light = rows.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", digest.alias("digest"), words.alias("words")).alias("one"))
    listed = light.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"], t["words"])).alias("turns"))


def nodes(conversations: DataFrame) -> DataFrame:
    """The trie of ``sequences``: a row per node, also for the root (depth 0), which stands for no turn.

    conv_id (smallest member: a conversation that begins with the node's turns), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves (childless nodes in its subtree, itself included), saved_tokens (over its subtree, words of the last turn times
    members but one) and ends_sha256 (of the ids of members that end there, ascending, joined by commas). Ids are unique
    numbers; conversations without a turn end at the root; no conversations, no nodes.
    """
    spark = conversations.sparkSession
    paths = conversations.select(
        F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
        F.transform("turns", lambda t: t["words"]).alias("words"),
        F.shiftright("conv_id", PIECE_BITS).alias("piece"), F.col("conv_id").cast("bigint").alias("conv_id"),
    )
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    merged = paths.groupBy("path", "piece").agg(
        F.first("words").alias("words"), ids.alias("ids"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")
    )
    dealt = merged.repartitionByRange("path").sortWithinPartitions("path", "piece").drop("piece")
    found = [cut(dealt.mapInArrow(_encoded(), NODES))]
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merging = True
    while merging:
        shards = -(-shards // FAN)
        merging = shards > 1
        spines = found[-1].where(~F.col("finished"))
        ranged = spines.repartitionByRange(shards, "path") if shards > 1 else spines.coalesce(1)
        found.append(cut(ranged.sortWithinPartitions("path").mapInArrow(_encoded(shards == 1, True), NODES)))
    every = reduce(DataFrame.unionByName, [frame.where("finished") for frame in found])
    known = reduce(DataFrame.unionByName, [frame.where("finished") for frame in found[1:]])
    known = known.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("asked_id"))
    measured = known.agg(F.coalesce(F.sum(F.length("parent_path") + 64), F.lit(0)).alias("size")).first()["size"]
    joined = every.join(F.broadcast(known) if measured <= SENT_BYTES else known, "parent_path", "left")
    return joined.select(
        "conv_id", "depth", F.coalesce("parent_id", "asked_id").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"),
    )
