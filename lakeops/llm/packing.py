"""Mixture-controlled packing: deficit round-robin over one queue of documents for each source.

A window is a run of ``window_sequences`` sequences. In each round every source is granted its share of a
window's tokens. It spends the grant in bursts of ``burst`` tokens; what is left is carried to the next
round as a deficit, and so is the place inside a document. After ``r`` rounds a source has been served
``floor(r * window * share / burst)`` bursts, so the place of every token follows from its place in its source's queue, and no task has to play
the rounds one after another. The served slices, strung together round by round and source by source, are
cut every ``length`` tokens. Only the last sequence can have padding.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeops.llm.common import in_batches, prefix_sum, task, texts
from lakeops.llm.tokens import encoder
from lakeops.session import materialised


def _queue(batches, tokenizer: str, end_id: int):
    from pyspark import TaskContext

    part, ids, end = TaskContext.get().partitionId(), encoder(tokenizer), end_id.to_bytes(4, "little")
    served: dict[str | None, int] = {}
    row = 0
    for batch in in_batches(batches):
        sources = batch.column("source").to_pylist()
        coded = [a.tobytes() + end for a in ids.encode_many(batch.column("text").to_pylist())]
        before = []
        for source, c in zip(sources, coded):
            before.append(served.get(source, 0))
            served[source] = before[-1] + len(c) // 4
        n = len(coded)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), batch.column("id"), batch.column("source"),
             pa.array(before, pa.int64()), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(coded, pa.binary())],
            names=["part", "row", "id", "source", "before", "tokens", "ids"])
        row += n


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, window_sequences: int = 64, burst: int = 256,
         shares: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pack every token of every document (NULL text: empty) into sequences of at most ``length`` tokens.

    ``shares`` are the wanted token proportions of the sources; by default the corpus' own, so that all
    queues run dry together. Sources without a share get their own proportion. A source that runs dry is
    passed over, and the others go on in their proportions. NULL is a source of its own; a repeated row
    is a document of its own.

    Returns a row for each piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    window (the round that granted the piece) and ids (its ids, little-endian unsigned 32-bit integers).
    """
    rows = texts(docs, id_col, text_col, F.col(source_col).cast("string").alias("source"))
    coded = materialised(rows.mapInArrow(task(_queue, tokenizer, end_id),
                                         "part int, row long, id long, source string, before long, tokens long, ids binary"), "coded")
    # Where each task's share of a queue begins: a row for each task and source.
    whole = Window.partitionBy("source")
    sums = (coded.groupBy("part", "source").agg(F.sum("tokens").alias("n"))
            .withColumn("base", F.sum("n").over(whole.orderBy("part")) - F.col("n")).withColumn("supply", F.sum("n").over(whole)))
    sums = materialised(sums, "queues")
    total = max(1, sums.agg(F.sum("n")).first()[0] or 0)
    # A round grants window * grant / unit tokens; decimals hold the products that long integers could not.
    window, unit = length * window_sequences, total if not shares else 1 << 30
    grant = F.col("supply")
    if shares:
        own = F.col("supply") / F.lit(total)
        grant = F.greatest(F.lit(1), F.round(F.coalesce(*[F.when(F.col("source") == s, F.lit(float(w))) for s, w in shares.items()], own) * unit))
    queues = sums.select(F.col("part").alias("_part"), F.col("source").alias("_source"), "base", "supply", grant.cast("decimal(19,0)").alias("grant"))
    placed = (coded.select("part", "row", "id", "source", "before", "tokens")
              .join(queues, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
              .select("part", "row", "id", "source", "tokens", "supply", "grant", (F.col("base") + F.col("before")).alias("a")))
    per_round = f"(cast({window} as decimal(19,0)) * grant)"
    per_burst = f"(cast({burst} as decimal(19,0)) * cast({unit} as decimal(19,0)))"
    bursts_after = lambda r: f"((cast({r} as decimal(19,0)) * {per_round}) div {per_burst})"
    round_of = lambda k: f"((cast({k} + 1 as decimal(19,0)) * {per_burst} + {per_round} - 1) div {per_round})"
    wide = f"{per_round} >= {per_burst}"  # a round grants a burst or more; else a burst takes several rounds of saving
    spread = (placed.withColumn("k0", F.expr(f"a div {burst}")).withColumn("k1", F.expr(f"(a + tokens - 1) div {burst}"))
              .withColumn("step", F.expr(f"explode(if({wide}, sequence({round_of('k0')}, {round_of('k1')}), sequence(k0, k1)))")))
    pieces = (spread.withColumn("window", F.expr(f"if({wide}, step, {round_of('step')})"))
              .withColumn("low", F.expr(f"least(supply, {burst} * if({wide}, {bursts_after('step - 1')}, step))"))
              .withColumn("high", F.expr(f"least(supply, {burst} * if({wide}, {bursts_after('step')}, step + 1))"))
              .withColumn("from", F.greatest("a", "low")).withColumn("to", F.least(F.col("a") + F.col("tokens"), F.col("high")))
              .filter("`from` < `to`")
              .select("part", "row", "id", "source", "tokens", "window", (F.col("from") - F.col("a")).alias("start"),
                      (F.col("from") - F.col("low")).alias("inside"), (F.col("to") - F.col("from")).alias("size")))
    pieces = materialised(pieces, "pieces")
    slots = prefix_sum(pieces.groupBy("window", "source").agg(F.sum("size").alias("size")), ["window", "source"], "size", "place")
    slots = slots.select(F.col("window").alias("_window"), F.col("source").alias("_source"), "place")
    at = pieces.join(slots, (F.col("window") == F.col("_window")) & F.col("source").eqNullSafe(F.col("_source")))
    at = at.withColumn("at", F.col("place") + F.col("inside"))
    cut = (at.withColumn("sequence_id", F.explode(F.sequence(F.expr(f"at div {length}"), F.expr(f"(at + size - 1) div {length}"))))
           .withColumn("low", F.greatest(F.col("at"), F.col("sequence_id") * length))
           .withColumn("high", F.least(F.col("at") + F.col("size"), (F.col("sequence_id") + 1) * length))
           .select("part", "row", "id", "source", "tokens", "window", "sequence_id", (F.col("low") - F.col("sequence_id") * length).alias("offset"),
                   (F.col("start") + F.col("low") - F.col("at")).alias("start"), (F.col("high") - F.col("low")).alias("length")))
    ids = F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))")
    return (cut.join(coded.select("part", "row", "ids"), ["part", "row"])
            .select(F.col("id").alias("doc_id"), "source", "start", "length", F.col("tokens").alias("doc_tokens"), "sequence_id", "offset", "window", ids.alias("ids"))
            .withColumn("ids_crc32", F.crc32("ids")))
