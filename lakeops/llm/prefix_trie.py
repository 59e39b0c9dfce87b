"""A trie over the turns of conversations: who shares which beginning, and what sharing it saves.

Turns get codes from a dictionary, conversations become sequences of codes, and ranges of the sequences' order become
shards. A shard builds ternary search trees, one for each block of bounded size, putting the median of what is left in
first so that siblings stay balanced, and adds up members, leaves and savings on the way back from the leaves. Only
nodes on a block's first and last sequence can have members elsewhere; they are merged in the order of the blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeops.llm.common import crc32_of, task
from lakeops.session import materialised

WIDTH = 16  # bytes of a turn's code
_NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string, code binary")
_SHARD = _NODE + ", part int, block int, line int, slot int, parent_slot int, points long, ids array<long>, opens binary, closes binary, common int"
_MERGED = _NODE + ", number long, parent_number long, part int, block int, slot int"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _frame(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _TYPES[t]) for n, t in fields], names=[n for n, _ in fields])


def dictionary(turns: DataFrame, seed: int = 0, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """code, role and text of every different turn; NULL role or text is empty."""
    rows = turns.select(F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    return rows.select(_code(seed).alias("code"), "role", "text")


def _code(seed: int):
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * WIDTH)


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, codes (hexadecimal, one after the other) and points (code points of each text) of every conversation.

    Turns go by number (NULL first), then role and text; repeated rows are turns of their own. Rows without a
    conversation id belong to none. Codes are held against the texts: should two different turns ever get one code,
    all codes are drawn anew. A conversation's codes must fit a row.
    """
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seed = 0
    while dictionary(rows, seed).groupBy("code").count().filter("count > 1").limit(1).count():
        seed += 1
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    coded = rows.select("conv_id", place.alias("place"), _code(seed).alias("code"), F.length("text").alias("points"))
    told = coded.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "code", "points"))).alias("turns"))
    return told.select("conv_id", F.array_join(F.col("turns.code"), "").alias("codes"), F.col("turns.points").alias("points"))


def rebuilt(sequenced: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Each conversation with its first ``h`` turns taken from the conversation ``conv_id - conv_id % group`` instead.

    ``h`` is the CRC-32 of the id in decimals modulo ``most``. Where that conversation is shorter, all its turns are
    taken; where there is none, no turn is.
    """
    held = materialised(sequenced, "sequences")
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = held.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.substring("codes", 1, 2 * WIDTH * (most - 1)).alias("head"), F.slice("points", 1, most - 1).alias("head_points"))
    h = (crc32_of(F.col("conv_id").cast("string")) % most).cast("int")
    joined = held.select("*", base.alias("base"), h.alias("h")).join(heads, "base", "left")
    none = F.array().cast("array<int>")
    return joined.select(
        "conv_id",
        F.concat(F.substring(F.coalesce("head", F.lit("")), F.lit(1), 2 * WIDTH * F.col("h")),
                 F.substring("codes", 2 * WIDTH * F.col("h") + 1, F.length("codes"))).alias("codes"),
        F.concat(F.slice(F.coalesce("head_points", none), F.lit(1), F.col("h")), F.slice("points", F.col("h") + 1, F.size("points"))).alias("points"))


def _medians(n: int):
    """0 .. n-1 with the median of every stretch before the stretches beside it."""
    todo = [(0, n)]
    while todo:
        low, high = todo.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            todo += [(middle + 1, high), (low, middle)]


class Tree:
    """A ternary search tree of sequences: each node has smaller and larger siblings and a tree of children."""

    def __init__(self):
        self.turn, self.points, self.parent, self.depth = [-1], [0], [-1], [0]
        self.small, self.large, self.child, self.ends = [0], [0], [0], [()]

    def _node(self, parent, turn, points):
        self.turn.append(turn)
        self.points.append(points)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        for links in (self.small, self.large, self.child):
            links.append(0)
        self.ends.append(())
        return len(self.turn) - 1

    def insert(self, turns, points, ends) -> int:
        """Add a sequence that the conversations ``ends`` are; the node where it ends."""
        node = 0
        for turn, size in zip(turns, points):
            at = self.child[node]
            if not at:
                self.child[node] = at = self._node(node, turn, size)
            while turn != self.turn[at]:
                side = self.small if turn < self.turn[at] else self.large
                if not side[at]:
                    side[at] = self._node(node, turn, size)
                at = side[at]
            node = at
        self.ends[node] = ends
        return node

    def totals(self):
        """Members, smallest member, children, leaves and savings of every node, children before parents."""
        n = len(self.turn)
        members, least, children, leaves, saved = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n
        for node in range(n - 1, -1, -1):  # a parent is older than its children
            own = self.ends[node]
            members[node] += len(own)
            if own and (least[node] is None or own[0] < least[node]):
                least[node] = own[0]
            leaves[node] += not children[node]
            saved[node] += (members[node] - 1) * self.points[node]
            up = self.parent[node]
            if up >= 0:
                members[up] += members[node]
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]
                if least[up] is None or least[node] < least[up]:
                    least[up] = least[node]
        return members, least, children, leaves, saved

    def path(self, node) -> list[int]:
        """The nodes from the root to this one."""
        up = []
        while node >= 0:
            up.append(node)
            node = self.parent[node]
        return up[::-1]


def _dense(joined: bytes) -> list[int]:
    """The codes as small numbers in the same order."""
    halves = np.frombuffer(joined, ">u8").astype("u8").reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    ranked = halves[order]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(np.concatenate([[0], (ranked[1:] != ranked[:-1]).any(axis=1)])) if len(order) else []
    return number.tolist()


def _joined_sha(ids) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _block(rows, part, block, chunk):
    """One block's tree as rows: finished nodes, and in lines the nodes that other blocks may share."""
    distinct = []  # rows come sorted: equal sequences are next to one another, ids ascending
    for conv, codes, points in rows:
        if distinct and distinct[-1][0] == codes:
            distinct[-1][2].append(conv)
        else:
            distinct.append((codes, points, [conv]))
    turns = _dense(b"".join(d[0] for d in distinct))
    stops = np.cumsum([0, *(len(d[0]) // WIDTH for d in distinct)]).tolist()
    tree, last = Tree(), {}
    for k in _medians(len(distinct)):
        node = tree.insert(turns[stops[k]:stops[k + 1]], distinct[k][1], distinct[k][2])
        if k in (0, len(distinct) - 1):
            last[k] = node
    members, least, children, leaves, saved = tree.totals()
    left, right = tree.path(last[0]), tree.path(last[len(distinct) - 1])
    common = sum(a == b for a, b in zip(left, right)) - 1
    slot = {node: depth for depth, node in enumerate(left)} | {node: -depth for depth, node in enumerate(right) if depth > common}
    by_turn = {}
    for k, (codes, _, _) in enumerate(distinct):
        for i, turn in enumerate(turns[stops[k]:stops[k + 1]]):
            by_turn.setdefault(turn, codes[i * WIDTH:(i + 1) * WIDTH])

    def told(node):
        return {"conv_id": least[node], "depth": tree.depth[node], "n_convs": members[node], "n_children": children[node], "n_leaves": leaves[node],
                "saved_tokens": saved[node], "code": by_turn.get(tree.turn[node]), "part": part, "block": block}

    line = 0
    yield {"part": part, "block": block, "line": line, "opens": distinct[0][0], "closes": distinct[-1][0], "common": common}
    for node in [*left, *right[common + 1:]]:
        ends, line = tree.ends[node], line + 1
        yield told(node) | {"slot": slot[node], "points": tree.points[node], "line": line, "ids": list(ends[:chunk])}
        for at in range(chunk, len(ends), chunk):
            line += 1
            yield {"part": part, "block": block, "line": line, "ids": ends[at:at + chunk]}
    for node in range(len(tree.turn)):
        if node not in slot:
            up = tree.parent[node]
            yield told(node) | {"ends_sha256": _joined_sha(tree.ends[node]), "parent_slot": slot.get(up), "parent_conv_id": None if up in slot else least[up]}


def _shard(batches, block_turns, chunk):
    from pyspark import TaskContext

    part, block, held, size = TaskContext.get().partitionId(), 0, [], 0

    def out():
        rows = []
        for row in _block(held, part, block, chunk):
            rows.append(row)
            if len(rows) == 4096:
                yield _frame(rows, _SHARD)
                rows = []
        if rows:
            yield _frame(rows, _SHARD)

    for batch in batches:
        for row in zip(batch.column("conv_id").to_pylist(), batch.column("seq").to_pylist(), batch.column("points").to_pylist()):
            held.append(row)
            size += 1 + len(row[2])
            if size >= block_turns:
                yield from out()
                block, held, size = block + 1, [], 0
    if held:
        yield from out()


class _Open:
    """A node that is still met in further blocks."""

    def __init__(self, number, parent, row):
        self.number, self.parent, self.row, self.sha, self.any = number, parent, row, hashlib.sha256(), False

    def ids(self, ids):
        if ids:
            self.sha.update(("," * self.any + ",".join(map(str, ids))).encode())
            self.any = True

    def add(self, row):
        for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            self.row[c] += row[c]
        self.row["conv_id"] = min(self.row["conv_id"], row["conv_id"])

    def done(self):
        return {c: self.row[c] for c in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "code")} | {
            "ends_sha256": self.sha.hexdigest(), "number": self.number, "parent_number": self.parent}


def _agree(a: bytes, b: bytes) -> int:
    """How many turns two sequences begin with in common."""
    n = 0
    while n < min(len(a), len(b)) and a[n:n + WIDTH] == b[n:n + WIDTH]:
        n += WIDTH
    return n // WIDTH


def _merge(batches):
    """Go through the blocks in order; what stays open is one path, that of the last sequence so far."""
    path, numbers, closes, cut = [], 0, None, None

    def close(depth):
        while len(path) > depth + 1:
            yield path.pop().done()

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["opens"] is not None:  # a block begins
                if cut is not None:
                    out += close(cut)
                shared = -1 if closes is None else _agree(closes, row["opens"])
                out += close(shared)
                # Both blocks counted the path that they share: its nodes below each other, its end if it was a leaf
                # in the first of them, and one member too few in the savings.
                again = 0
                for depth in range(shared, -1, -1):
                    again += path[depth].row["points"]
                    path[depth].row["saved_tokens"] += again
                    path[depth].row["n_children"] -= depth < shared
                    path[depth].row["n_leaves"] -= len(closes) == shared * WIDTH
                closes, cut = row["closes"], row["common"]
            elif row["slot"] is None:  # more ends of the node before
                node.ids(row["ids"])
            else:
                if row["slot"] < 0 and cut is not None:  # the last sequence leaves the first one's path
                    out += close(cut)
                    cut = None
                depth = row["depth"]
                if depth < len(path):
                    node = path[depth]
                    node.add(row)
                else:
                    node = _Open(numbers, path[-1].number if path else None, row)
                    numbers += 1
                    path.append(node)
                node.ids(row["ids"])
                out.append({"part": row["part"], "block": row["block"], "slot": row["slot"], "number": node.number})
        if out:
            yield _frame(out, _MERGED)
    yield _frame(list(close(-1)), _MERGED)


def trie(sequenced: DataFrame, block_turns: int = 1 << 17, chunk: int = 512) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, code.

    A node stands for a different beginning of ``depth`` turns, the root for none; conversations that begin so are its
    members, also those without turns. ``saved_tokens`` sums (members - 1) times the length of the last text over the
    subtree, ``ends_sha256`` is the hash of the ids of the members that are just this beginning, ascending and joined
    by commas, and ``code`` is the last turn's in the dictionary. No conversations give no rows.

    Ranges are cut by sequence and conversation, so that a conversation told a million times is spread like any other.
    A block holds about ``block_turns`` turns. One task merges a path of nodes for each block, in order and with one path in
    memory; there the ids of conversations equal to a block's first or last one pass by, ``chunk`` at a time, since a
    hash over ids in ascending order can only be taken in that order.
    """
    ranged = sequenced.select("conv_id", F.unhex("codes").alias("seq"), "points").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    shards = materialised(ranged.mapInArrow(task(_shard, block_turns, chunk), _SHARD), "trie-shards")
    nodes = [f.split(" ")[0] for f in _NODE.split(", ")]
    lines = shards.filter("line IS NOT NULL").select("part", "block", "line", "slot", "points", "ids", "opens", "closes", "common", *nodes)
    merged = materialised(lines.repartition(1).sortWithinPartitions("part", "block", "line").mapInArrow(task(_merge), _MERGED), "trie-borders")

    ended = merged.filter("depth IS NOT NULL")
    up = ended.select(F.col("number").alias("parent_number"), F.col("conv_id").alias("up"))
    borders = ended.join(up, "parent_number", "left").withColumn("parent_conv_id", F.col("up")).select(*nodes)
    names = (merged.filter("depth IS NULL").select("part", "block", F.col("slot").alias("parent_slot"), F.col("number").alias("parent_number"))
             .join(up, "parent_number").select("part", "block", "parent_slot", "up"))
    inner = shards.filter("line IS NULL").select("part", "block", "parent_slot", *nodes)
    below = inner.filter("parent_slot IS NOT NULL").join(names, ["part", "block", "parent_slot"]).withColumn("parent_conv_id", F.col("up")).select(*nodes)
    return borders.union(below).union(inner.filter("parent_slot IS NULL").select(*nodes))
