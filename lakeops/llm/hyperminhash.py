"""Near-duplicate documents by HyperMinHash sketches, confirmed on the full shingle sets.

A sketch has a register for each bucket (an independent order of all shingles): of the smallest hash in
that order it keeps the number of leading zeros and the ``MANTISSA`` bits after the first one, 16 bits
together. Runs of ``rows`` registers are hashed to bands; documents with a common band are candidates.

Nothing is expanded into all pairs. Documents with the same shingle set are one node. In a band's bucket
every node is held against the bucket's hub, the node that shares most bands with others - for the copies
of one original, that is the original. Links found so join nodes to components. Where a bucket still holds
several components, a node outside the largest one can only be linked to a node of another component if
both share enough of the hub's shingles, or if they share shingles that the hub lacks; so candidates come from a join on
those shingles, of which a node needs to send only its rarest (see ``_open_pairs``). No link that shares a band is lost.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeops.llm.common import in_batches, matching, remembered, task, texts
from lakeops.llm.components import components
from lakeops.session import materialised

MANTISSA = 10
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _hashes() -> _Hashes:
    return remembered("hyperminhash", _Hashes)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words: A-Z lowered, words cut at ASCII white space.

    A text of fewer words is one run; one without words has none.
    """
    split = text.encode().lower().split()
    if not split:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes().__getitem__, split), dtype=np.uint64, count=len(split))
    k = min(words, len(h))
    acc = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        acc = _mixed(acc * MIX[0] + h[j:len(h) - k + 1 + j])
    return np.unique(acc)


@functools.cache
def _orders(registers: int) -> tuple[np.ndarray, np.ndarray]:
    seed = _mixed(np.arange(1, 2 * registers + 1, dtype=np.uint64) * MIX[0])
    return seed[:registers] | np.uint64(1), seed[registers:]


def sketch(hashes: np.ndarray, registers: int) -> np.ndarray:
    """Leading zeros and mantissa of the least hash in each bucket's own order."""
    a, b = _orders(registers)
    least = np.full(registers, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[k:k + 1024, None] * a + b).min(axis=0), out=least)
    zeros = np.zeros(registers, dtype=np.uint16)
    for step in (32, 16, 8, 4, 2, 1):
        low = least < np.uint64(1 << (64 - step))
        least[low] <<= np.uint64(step)
        zeros[low] += np.uint16(step)
    zeros[zeros > 63] = 63
    return (zeros << np.uint16(MANTISSA)) | ((least >> np.uint64(63 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)


def bands(registers: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each run of ``rows`` registers; the run's place is part of the key."""
    runs = registers[:len(registers) // rows * rows].reshape(-1, rows).astype(np.uint64)
    acc = np.arange(1, len(runs) + 1, dtype=np.uint64)
    for j in range(rows):
        acc = _mixed(acc * MIX[0] + runs[:, j])
    return acc.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of pairs of sketches, one pair a row.

    Registers of unrelated sets agree by chance; the chance follows from the set sizes (the least of n hashes has z
    leading zeros with probability (1 - 2**-(z+1))**n - (1 - 2**-z)**n) and is taken out.
    """
    same = (a == b).mean(axis=1)
    edge = 2.0 ** -np.arange(0, 64)
    have = lambda n: np.diff(np.exp(n[:, None] * np.log1p(-np.minimum(edge, 1 - 1e-12))), axis=1)
    chance = (have(n_a.astype(float)) * have(n_b.astype(float))).sum(axis=1) / (1 << MANTISSA)
    return np.clip((same - chance) / (1 - chance), 0, 1)


def _sketches(batches, words: int, registers: int, rows: int):
    import hashlib

    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 33
    for batch in in_batches(batches):
        sizes, keys, found, sigs = [], [], [], []
        for text in batch.column("text").to_pylist():
            s = shingle_set(text, words)
            sizes.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sig = sketch(s, registers) if len(s) else None
            sigs.append(None if sig is None else sig.tobytes())
            found.append(None if sig is None else bands(sig, rows))
        n = len(sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(row, row + n), pa.int64()), batch.column("id"), batch.column("tkey"), pa.array(sizes, pa.int64()),
             pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
            names=["uid", "id", "tkey", "n", "set", "bands", "sig"])
        row += n


def _alike(batches, least: float):
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
        guess = jaccard(a, b, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
        yield batch.filter(pa.array(guess >= least)).select(["a", "b"])


def _sets(batches, words: int):
    for batch in in_batches(batches):
        yield pa.RecordBatch.from_arrays(
            [batch.column("uid"), pa.array([shingle_set(t, words).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], names=["uid", "hashes"])


def _confirmed(batches, percent: int):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b")):
            a, b = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            a, b = (a, b) if len(a) <= len(b) else (b, a)
            at = np.searchsorted(b, a)
            common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
            keep.append(100 * common >= percent * (len(a) + len(b) - common))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _differences(batches):
    for batch in batches:
        common, rest = [], []
        for x, y in zip(batch.column("set_u"), batch.column("set_h")):
            u, h = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            inside = h[np.minimum(np.searchsorted(h, u), len(h) - 1)] == u
            common.append(int(inside.sum()))
            rest.append(u[~inside].view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("hub", "uid", "root", "n")), pa.array(common, pa.int64()), pa.array(rest, pa.list_(pa.int64()))],
            names=["hub", "uid", "root", "n", "c", "d"])


def _open_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) that can still be links, of the nodes (hub, uid, root, n) that met one hub's buckets.

    Let c be the shingles that a node shares with the hub and d those that the hub lacks. Two nodes share at most the smaller
    c, and what their d have in common. A link needs an overlap m with m * (100 + percent) >= percent * (n_a + n_b). So either the
    smaller c is enough, or the d have at least ``need`` shingles in common; then any choice of all but ``need`` - 1 shingles of
    one node's d holds a common one, and the rarest are chosen.
    """
    with_sets = (members.join(sets.select("uid", F.col("hashes").alias("set_u")), "uid")
                 .join(sets.select(F.col("uid").alias("hub"), F.col("hashes").alias("set_h")), "hub"))
    nodes = materialised(with_sets.select("hub", "uid", "root", "n", "set_u", "set_h").mapInArrow(
        task(_differences), "hub long, uid long, root long, n long, c long, d array<long>"), "hub-differences")
    per_root = nodes.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("n"))
    main = per_root.groupBy("hub").agg(F.max(F.struct("size", "root"))["root"].alias("main"), F.min("n").alias("least"))
    enough = lambda m, n_a, n_b: F.expr(f"{m} * {100 + percent} >= {percent} * ({n_a} + {n_b})")
    outside = nodes.join(main, "hub").filter("root <> main").withColumn("least", F.greatest("least", F.expr(f"ceil({percent} * n / 100)")))
    left = outside.select("hub", F.col("uid").alias("a"), F.col("root").alias("root_a"), F.col("n").alias("n_a"), F.col("c").alias("c_a"), "d", "least")
    right = nodes.select("hub", F.col("uid").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("n_b"), F.col("c").alias("c_b"), "d")
    # The hub's shingles alone: first whether any size of partner would do, then the partners.
    sizes = nodes.groupBy("hub", "n").agg(F.max("c").alias("c_b")).withColumnRenamed("n", "n_b")
    some = left.join(sizes, "hub").filter(enough("least(c_a, c_b)", "n_a", "n_b")).select("hub", "a", "root_a", "n_a", "c_a").distinct()
    by_hub = some.join(right.drop("d"), "hub").filter("root_a <> root_b").filter(enough("least(c_a, c_b)", "n_a", "n_b"))
    # Shingles that the hub lacks.
    every = right.select("hub", "b", "root_b", "n_b", F.explode("d").alias("s"))
    counts = every.groupBy("hub", "s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    need = F.greatest(F.lit(1), F.expr(f"ceil({percent} * (n_a + least) / {100 + percent}) - c_a"))
    sent = left.withColumn("most", F.size("d") - need + 1).filter("most > 0").select("hub", "a", "root_a", "n_a", "most", F.explode("d").alias("s"))
    rank = F.row_number().over(Window.partitionBy("hub", "a").orderBy(F.coalesce("df", F.lit(1)), "s"))
    sent = sent.join(counts, ["hub", "s"], "left").withColumn("rank", rank).filter("rank <= most and df > 1").select("hub", "a", "root_a", "n_a", "s")
    by_rest = sent.join(every, ["hub", "s"]).filter("root_a <> root_b")
    return by_hub.select("a", "b", "n_a", "n_b").union(by_rest.select("a", "b", "n_a", "n_b"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, registers: int = 150, rows: int = 5,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link texts whose sets of ``words``-word shingles have a Jaccard similarity of ``percent`` % or more.

    Returns a row for each input row: id, tkey (hash of its text), n_shingles, component_id (smallest id reachable
    over links, itself included), kept (id equals component_id) and keep (one row of each group: the first of those
    kept, also where rows or ids repeat). A text without words (or NULL) has no shingles and is linked with nothing.
    NULL ids never become a component_id while the group has another; a group of them alone has NULL.

    A pair at the threshold shares no band with probability (1 - s**rows)**(registers/rows): 7e-6 at 0.8,
    3e-8 at 0.85. The estimate only drops pairs more than six standard errors below the threshold.
    """
    base = texts(docs, id_col, text_col).withColumn("tkey", F.xxhash64("text"))
    made = base.mapInArrow(task(_sketches, words, registers, rows),
                           "uid long, id long, tkey long, n long, `set` binary, bands array<long>, sig binary")
    made = materialised(made, "sketches")
    classes = materialised(made.filter("n > 0").groupBy("set").agg(F.min("uid").alias("rep")), "classes")
    nodes = made.join(classes.select(F.col("rep").alias("uid")), "uid", "left_semi")

    banded = nodes.select("uid", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").withColumnRenamed("key", "_key")
    banded = materialised(banded.join(shared, F.col("key") == F.col("_key")).drop("_key"), "shared-bands")
    score = banded.groupBy("uid").agg(F.sum("size").alias("score")).withColumnRenamed("uid", "_uid")
    scored = banded.join(score, F.col("uid") == F.col("_uid"))
    hubs = scored.groupBy("key").agg(F.max(F.struct("score", -F.col("uid"), "uid", "n")).alias("hub")).select(F.col("key").alias("_key"), "hub")
    hubs = materialised(hubs, "hubs")
    ratio = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    tried = (banded.join(hubs, F.col("key") == F.col("_key"))
             .select(F.col("hub.uid").alias("a"), F.col("uid").alias("b"), F.col("hub.n").alias("n_a"), F.col("n").alias("n_b"))
             .filter("a <> b").filter(ratio).distinct())
    tried = materialised(tried, "hub-pairs")
    sigs = nodes.select("uid", "sig")

    def sets_of(ends: DataFrame) -> DataFrame:
        """The full shingle sets of nodes, from their texts."""
        named = made.join(ends, "uid", "left_semi").select("uid", F.col("id").alias("_id"), F.col("tkey").alias("_tkey"))
        found = base.join(named, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_tkey"))).select("uid", "text")
        return materialised(found.mapInArrow(task(_sets, words), "uid long, hashes binary").dropDuplicates(["uid"]), "sets")

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs that are links: estimated first, then confirmed on the full sets."""
        s = percent / 100
        least = s - 6 * (s * (1 - s) / registers) ** 0.5
        with_sigs = (pairs.join(sigs.select(F.col("uid").alias("a"), F.col("sig").alias("sig_a")), "a")
                     .join(sigs.select(F.col("uid").alias("b"), F.col("sig").alias("sig_b")), "b"))
        close = materialised(with_sigs.mapInArrow(task(_alike, least), "a long, b long"), "close-pairs")
        sets = sets_of(close.select(F.col("a").alias("uid")).union(close.select(F.col("b").alias("uid"))).distinct())
        with_sets = (close.join(sets.select(F.col("uid").alias("a"), F.col("hashes").alias("set_a")), "a")
                     .join(sets.select(F.col("uid").alias("b"), F.col("hashes").alias("set_b")), "b"))
        return materialised(with_sets.mapInArrow(task(_confirmed, percent), "a long, b long"), "links")

    first = links(tried)
    roots = materialised(components(first), "roots")
    # Buckets that still hold several components.
    grouped = banded.drop("size").join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    grouped = materialised(grouped, "bands-by-root")
    mixed = grouped.groupBy("key").agg((F.min("root") < F.max("root")).alias("several")).filter("several").select("key")
    hub_of = hubs.select(F.col("_key").alias("key"), F.col("hub.uid").alias("hub"))
    open_ = grouped.join(mixed, "key", "left_semi").join(hub_of, "key").select("hub", "uid", "root", "n").distinct()
    open_ = materialised(open_, "open-nodes")
    ends = open_.select("uid").union(open_.select(F.col("hub").alias("uid"))).distinct()
    rest = _open_pairs(open_, sets_of(ends), percent).filter(ratio)
    rest = (rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.expr("if(a < b, n_a, n_b)").alias("n_a"), F.expr("if(a < b, n_b, n_a)").alias("n_b"))
            .distinct().join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti"))
    second = links(materialised(rest, "open-pairs"))
    roots = materialised(components(first.union(second)), "roots")

    classes = classes.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("set").alias("_set"), F.coalesce("root", "rep").alias("root"))
    members = (made.select("uid", "id", "tkey", "n", "set").join(classes, F.col("set") == F.col("_set"), "left")
               .select("uid", "id", "tkey", "n", F.coalesce("root", "uid").alias("root")))
    members = materialised(members, "members")
    best = members.groupBy("root").agg(F.min("id").alias("least_id"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first"))
    return (members.join(best, "root")
            .select(F.col("id").alias("doc_id"), "tkey", F.col("n").alias("n_shingles"), F.col("least_id").alias("component_id"),
                    F.col("id").eqNullSafe(F.col("least_id")).alias("kept"), (F.col("uid") == F.col("first.uid")).alias("keep")))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, all columns: that with the smallest id. Texts without words all stay."""
    keep = near_duplicates(docs, words, percent, id_col=id_col, text_col=text_col).filter("keep")
    rows = matching(docs, keep, "left_semi", id_col, text_col)
    # Rows that repeat id and text fall to one; the join has already brought them together.
    alone = F.when(F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.lit(0)).otherwise(F.monotonically_increasing_id())
    return rows.withColumn("_lakeops_alone", alone).dropDuplicates(["_lakeops_row", "_lakeops_text", "_lakeops_alone"]).select(*docs.columns)
