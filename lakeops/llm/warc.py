"""WARC archives: writing with payload de-duplication, reading with boundary-chain verification.

Archives are plain WARC/1.0 files. Spark's text writer puts one record on each "line", with the record
separator as the line end, so commits and retries are Spark's own.

Reading: splitting a file at every ``WARC/1.0`` line gives pieces that tasks read side by side, but a
payload may hold such a line as well. A piece that starts like a record is only a candidate. Its header
says where its successor must start; what the chain from the start of the file reaches is a record,
everything else is payload. Inside a block of the file a task follows the chain from every candidate to
where it leaves the block; across blocks pointers are doubled, so the number of rounds is the logarithm of
the blocks of a file.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeops.session import materialised

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
ID = "urn:x-page:"
# The digits of base 32 as conversions write them, and as RFC 4648 does.
DIGITS = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text or binary column: 5 hexadecimal digits are 4 of base 32."""
    digest = F.sha1(payload.cast("binary"))
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]), *DIGITS)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id",
                   url_col: str = "url", payload_col: str = "html") -> None:
    """Write a record for each row; the payload is the text in UTF-8 (NULL: empty).

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the largest id is a response, the others
    are revisits of it and carry no payload. Rows that repeat the largest id are responses too; a NULL id never is the
    largest, and rows of which none has an id are all responses.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    first = (rows.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("id").alias("target"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1 and target is not null").select(F.col("digest").alias("_digest"), "target"))
    first = materialised(first, "warc-targets")  # its real size then decides how it is joined; payloads need no shuffle while it is small
    rows = rows.join(first, F.col("digest") == F.col("_digest"), "left")
    revisit = F.col("target").isNotNull() & ~F.col("id").eqNullSafe(F.col("target"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    name = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">\r\n"))
    record = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name(F.col("id")),
        F.lit(f"WARC-Date: {date}\r\n"),
        F.when(F.col("url").isNull(), "").otherwise(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", "%0A"), F.lit("\r\n"))),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("target")))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block"), F.lit(END), F.col("block"))
    rows.withColumn("block", block).select(record.alias("value")).write.option("lineSep", END).option("compression", "none").text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between the magic lines: file, block (start of the split it was read from), seq (order in it), value."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")


def _header(name: str) -> Column:
    return F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)


def _bases(df: DataFrame) -> DataFrame:
    """Where in its file the first piece of each block begins."""
    before = Window.partitionBy("file").orderBy("block")
    sums = df.groupBy("file", "block").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("n"))
    return sums.select(F.col("file").alias("_file"), F.col("block").alias("_block"), (F.sum("n").over(before) - F.col("n")).alias("base"))


def _offsets(df: DataFrame, bases: DataFrame) -> DataFrame:
    """Add ``offset``: where the magic line before the piece starts in its file (below 0: there is none)."""
    inside = Window.partitionBy("file", "block").orderBy("seq")
    return (df.withColumn("run", F.sum(F.col("bytes") + len(MAGIC)).over(inside) - F.col("bytes") - len(MAGIC))
            .join(bases, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
            .withColumn("offset", F.col("base") + F.col("run") - len(MAGIC)).drop("_file", "_block", "base", "run"))


def _leaving(block: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a block: where its chain leaves the block, and the last record before that."""
    block = block.sort_values("offset")
    offset, nxt = block["offset"].to_numpy(), block["next"].to_numpy()
    at = np.searchsorted(offset, nxt)
    leave, last = nxt.copy(), offset.copy()
    for i in range(len(offset) - 1, -1, -1):  # successors lie behind, so they are done already
        if nxt[i] >= 0 and at[i] < len(offset):
            known = offset[at[i]] == nxt[i]
            leave[i], last[i] = (leave[at[i]], last[at[i]]) if known else (-1, offset[i])
    out = pd.DataFrame({"file": block["file"], "block": block["block"], "offset": offset, "leave": leave, "last": last})
    return out[(nxt >= 0) & (offset >= 0)]


def _owned(block: pd.DataFrame) -> pd.DataFrame:
    """Walk the chain from where it enters the block: which pieces are records, and whose payload the others are."""
    block = block.sort_values("offset")
    offset, nxt = block["offset"].to_numpy(), block["next"].to_numpy()
    entry, owner = block["entry"].iloc[0], block["carried"].iloc[0]
    owners = np.full(len(offset), -1 if pd.isna(owner) else owner, dtype=np.int64)
    where, at = (-1 if pd.isna(entry) else int(entry)), 0
    while where >= 0:
        at = int(np.searchsorted(offset, where))
        if at == len(offset) or offset[at] != where or nxt[at] < 0:
            break
        owners[at:], where = where, nxt[at]
    return pd.DataFrame({"file": block["file"], "block": block["block"], "offset": offset, "owner": owners})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives in ``path``: file, offset, page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Bytes and digest of a response are taken from its payload as read; a revisit has those its headers name. A chain that
    leads nowhere (a cut or damaged file) ends there: what follows in that file is not reported as records.
    """
    split = _pieces(spark, path).withColumn("head", F.when(F.instr("value", END) > 0, F.substring_index("value", END, 1)))
    read = split.select("file", "block", "seq", F.octet_length("value").cast("long").alias("bytes"), "head", F.octet_length("head").alias("head_bytes"),
                        _header("Content-Length").try_cast("long").alias("length"), *_content(F.col("value"), "head"))
    bases = materialised(_bases(read), "warc-blocks")
    read = _offsets(read, bases).withColumn("next", F.coalesce(F.col("offset") + F.col("head_bytes") + F.col("length") + len(MAGIC) + 2 * len(END), F.lit(-1)))
    read = materialised(read.drop("seq"), "warc-pieces")
    bare = read.select("file", "block", "offset", "next")
    steps = materialised(bare.groupBy("file", "block").applyInPandas(_leaving, "file string, block long, offset long, leave long, last long"), "warc-chains")

    # Doubling over blocks: only where a chain enters a block does a pointer matter.
    enters = steps.filter("leave >= 0").select("file", F.col("leave").alias("offset")).distinct().union(steps.filter("offset = 0").select("file", "offset")).distinct()
    jump = materialised(steps.join(enters, ["file", "offset"]).select("file", "offset", "leave"), "warc-jumps")
    nodes, reached, count = jump.select("file", "offset"), jump.filter("offset = 0").select("file", "offset"), -1
    while reached.count() != count:
        count = reached.count()
        ahead = jump.join(reached, ["file", "offset"]).select("file", F.col("leave").alias("offset"))
        reached = materialised(reached.union(ahead.join(nodes, ["file", "offset"], "left_semi")).distinct(), "warc-reached")
        far = jump.select("file", F.col("offset").alias("leave"), F.col("leave").alias("far"))
        jump = materialised(jump.join(far, ["file", "leave"], "left").select("file", "offset", F.coalesce("far", F.lit(-1)).alias("leave")), "warc-jumps")
    entries = steps.join(reached, ["file", "offset"], "left_semi").groupBy("file", "block").agg(F.min("offset").alias("entry"), F.max("last").alias("last"))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (bare.select("file", "block").distinct().join(entries, ["file", "block"], "left")
              .withColumn("carried", F.last("last", ignorenulls=True).over(order)).drop("last"))
    owned = materialised(bare.join(blocks, ["file", "block"]).groupBy("file", "block").applyInPandas(_owned, "file string, block long, offset long, owner long"), "warc-owned")

    # Records whose payload holds magic lines lie in several pieces, which are put together again.
    parts = owned.join(owned.filter("owner >= 0 and owner <> offset").select("file", "owner").distinct(), ["file", "owner"], "left_semi")
    parts = materialised(parts, "warc-parts")
    again = _pieces(spark, path).join(parts.select("file", "block").distinct(), ["file", "block"], "left_semi")
    again = _offsets(again.withColumn("bytes", F.octet_length("value").cast("long")), bases).join(parts.drop("block"), ["file", "offset"])
    whole = (again.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("v"))
             .select("file", F.col("owner").alias("offset"), F.array_join(F.col("v.value"), MAGIC).alias("value"))
             .withColumn("head", F.substring_index("value", END, 1)).withColumn("head_bytes", F.octet_length("head")).withColumn("length", _header("Content-Length").try_cast("long")))
    whole = whole.select("file", "offset", "head", *_content(F.col("value"), "head"))
    single = read.join(owned.filter("owner = offset").select("file", "offset"), ["file", "offset"], "left_semi").join(whole.select("file", "offset"), ["file", "offset"], "left_anti")
    records = single.select("file", "offset", "head", "block_bytes", "http_length", "payload_bytes", "digest").union(
        whole.select("file", "offset", "head", "block_bytes", "http_length", "payload_bytes", "digest"))
    kind = _header("WARC-Type")
    number = lambda c: F.regexp_extract(c, rf"{ID}(-?\d+)", 1).try_cast("long")
    revisit = kind == "revisit"
    return records.select(
        "file", "offset", number(_header("WARC-Record-ID")).alias("page_id"), F.nullif(_header("WARC-Target-URI"), F.lit("")).alias("url"),
        F.when(revisit, F.col("http_length")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.regexp_replace(_header("WARC-Payload-Digest"), "^sha1:", "")).otherwise(F.col("digest")).alias("payload_digest"),
        kind.alias("record_type"), number(_header("WARC-Refers-To")).alias("refers_to"))


def _content(value: Column, head: str) -> list[Column]:
    """Of a record's block: its bytes, and its HTTP headers' Content-Length, then the payload's bytes and digest."""
    start = F.octet_length(head) + len(END)
    raw = value.cast("binary")
    length = F.regexp_extract(head, r"(?i)(?:^|\r\n)Content-Length:[ \t]*(\d+)", 1).try_cast("int")
    block = F.substring(raw, start + 1, length)
    http = F.substring_index(block.cast("string"), END, 1)
    payload = F.substring(block, F.octet_length(http) + len(END) + 1, F.lit((1 << 31) - 1))
    return [F.octet_length(block).alias("block_bytes"), F.regexp_extract(http, r"(?i)\r\nContent-Length:[ \t]*(\d+)", 1).try_cast("long").alias("http_length"),
            F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("digest")]
