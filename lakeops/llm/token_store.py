"""Token ids in binary files: one compressed frame for each document, a shared dictionary, an index.

A store is a folder with

* ``dictionary`` - one row: the zstandard dictionary and its SHA-256, trained on serialized id arrays;
* ``shards/part-N...`` - documents in ascending order of their id. A shard is a run of zstandard frames, each
  followed by a line feed, then its index and a footer. The index holds id, offset, length and counts of each
  frame; the footer holds the dictionary's hash, so that a shard is never read with another dictionary.

Shards are written by Spark's own writer: a lost task leaves nothing behind and is simply run again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeops.llm.common import in_batches, task, texts
from lakeops.llm.tokens import encoder
from lakeops.session import materialised

FOOTER = struct.Struct("<32sBQQ8s")  # dictionary hash, bytes of an id, bytes of the index, documents, magic
MAGIC = b"TOKIDX01"
INDEX = np.dtype([("id", "<i8"), ("known", "u1"), ("offset", "<u8"), ("length", "<u8"), ("tokens", "<u8"), ("start", "<u8")])


def train_dictionary(docs: DataFrame, tokenizer: str, width: int, sample_docs: int = 1000, sample_chars: int = 8192,
                     size: int = 32 << 10) -> bytes:
    """A zstandard dictionary from a bounded sample: the ``sample_docs`` documents of up to ``sample_chars``
    characters whose ids hash lowest. It changes sizes only, never contents. Too few documents: empty."""
    import zstandard

    lowest = docs.filter(F.length("text").between(1, sample_chars)).select("id", F.xxhash64("id", "text").alias("h")).orderBy("h").limit(sample_docs)
    # sample_docs numbers at most: safe to broadcast
    picked = docs.join(F.broadcast(lowest.select("id").distinct()), "id").select("text", F.xxhash64("id", "text").alias("h")).orderBy("h").limit(sample_docs)
    ids = encoder(tokenizer)
    samples = [a.astype(f"<u{width}").tobytes() for a in ids.encode_many([r.text for r in picked.collect()])]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # the trainer wants more material than there is
        return b""


def _codec(dictionary: bytes):
    import zstandard

    known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    if known:
        known["dict_data"].precompute_compress(level=3)  # else every frame digests the dictionary again
    return zstandard.ZstdCompressor(level=3, **known), zstandard.ZstdDecompressor(**known)


def _framer(batches, tokenizer: str, end_id: int, dictionary: bytes, width: int):
    pack, _ = _codec(dictionary)
    ids = encoder(tokenizer)
    index, offset, start = [], 0, 0
    for batch in in_batches(batches):
        frames = []
        for doc, array in zip(batch.column("id").to_pylist(), ids.encode_many(batch.column("text").to_pylist())):
            array = np.append(array, np.uint32(end_id)).astype(f"<u{width}")
            frames.append(pack.compress(array.tobytes()))
            index.append((doc or 0, doc is not None, offset, len(frames[-1]), len(array), start))
            offset, start = offset + len(frames[-1]) + 1, start + len(array)
        yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])
    if index:
        body = _codec(b"")[0].compress(np.array(index, dtype=INDEX).tobytes())
        foot = FOOTER.pack(hashlib.sha256(dictionary).digest(), width, len(body), len(index), MAGIC)
        yield pa.RecordBatch.from_arrays([pa.array([body + foot], pa.binary())], names=["frame"])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary_size: int | None = None, shard_bytes: int = 24 << 20) -> None:
    """Encode every whole text (NULL: empty), append ``end_id`` and write the store to ``path``.

    Rows go in ascending order of id (NULL ids first), rows of one id in a fixed order by their text; a
    repeated row is a document of its own. ``shard_bytes`` of text, on average, go to one shard.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    size = vocabulary_size or encoder(tokenizer).tokenizer.get_vocab_size()
    width = 2 if max(size, end_id + 1) <= 1 << 16 else 4
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dictionary = train_dictionary(rows, tokenizer, width)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(bytearray(dictionary), digest)], "dictionary binary, sha256 string").coalesce(1).write.parquet(f"{path}/dictionary")
    order = [F.col("id"), F.xxhash64("text")]
    framed = (rows.repartitionByRange(1 + total // shard_bytes, *order).sortWithinPartitions(*order, "text")
              .mapInArrow(task(_framer, tokenizer, end_id, dictionary, width), "frame binary"))
    framed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(f"{path}/shards")


def _frames(batches, dictionary: bytes, wanted: frozenset[int] | None, with_ids: bool):
    _, unpack = _codec(dictionary)
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            data = memoryview(content.as_buffer())
            if not len(data):
                continue
            end = len(data) - 1
            digest, width, size, _, magic = FOOTER.unpack(data[end - FOOTER.size:end])
            if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
                raise ValueError(f"{path} is no shard of this store")
            index = np.frombuffer(_codec(b"")[1].decompress(bytes(data[end - FOOTER.size - size:end - FOOTER.size])), dtype=INDEX)
            if wanted is not None:
                index = index[np.isin(index["id"], list(wanted)) & (index["known"] == 1)]
            for k in range(0, len(index), 512):
                yield _rows(str(path), data, index[k:k + 512], width, unpack, with_ids)


def _rows(path, data, index, width, unpack, with_ids):
    crcs, ids, counts = [], [], []
    for e in index:
        raw = unpack.decompress(bytes(data[int(e["offset"]):int(e["offset"] + e["length"])]))
        array = np.frombuffer(raw, dtype=f"<u{width}").astype("<u4")
        crcs.append(zlib.crc32(array.tobytes()))
        counts.append(len(array))
        if with_ids:
            ids.append(array.astype("int32"))
    columns = [pa.array([path] * len(index)), pa.array(index["id"], mask=index["known"] == 0), pa.array(index["start"].astype("int64")),
               pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())]
    names = ["path", "doc_id", "before", "n_tokens", "ids_crc32"]
    if with_ids:
        columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Read a store: shard, doc_id, before (ids of earlier documents in the shard), n_tokens, ids_crc32 and ids.

    With ``doc_ids`` only their frames are decompressed, by the shard's index.
    """
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    wanted = None if doc_ids is None else frozenset(doc_ids)
    schema = "path string, doc_id long, before long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    files = spark.read.format("binaryFile").load(f"{path}/shards/part-*").select("path", "content")
    read = files.mapInArrow(task(_frames, dictionary, wanted, with_ids), schema)
    return read.withColumn("shard", F.regexp_extract("path", r"part-(\d+)", 1).cast("long")).drop("path")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, read from the files.

    Only the totals of the shards, one row each, meet in one task.
    """
    rows = materialised(read_tokens(spark, path, with_ids=False), "token-index")  # the files are read once
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = (rows.groupBy("shard").agg(F.sum("n_tokens").alias("_sum"))
             .select("shard", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_base")))
    return rows.join(bases, "shard").select("doc_id", (F.col("_base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "shard")
