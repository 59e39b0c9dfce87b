"""WARC round trips, with magic lines and whole records inside payloads and with small splits."""

import base64
import hashlib

import pytest

from lakeops.llm import queries, warc
from lakeops.session import scratch

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def expect(rows, least=0):
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in rows:
        payload = (h or "").encode()
        known = [x for x in groups[h or ""] if x is not None]
        top = max(known) if known and len(groups[h or ""]) > 1 and len(payload) >= least else None
        again = top is not None and i != top
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def read(spark, path):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect()), key=str)


ROWS = [(i, f"http://h/{i}", f"é{i}" * (i % 50) + (FAKE * (i % 4) if i % 3 == 0 else "") + ("x\r\n\r\ny" if i % 5 == 0 else "") + ("WARC/1.0\r\n" if i % 7 == 0 else "")) for i in range(300)]
ROWS += [(None, None, None), (700, None, ""), (701, "a\r\nb: c", "WARC/1.0\r\n" * 20), (702, "u", FAKE * 400), (703, "u", "same"), (703, "u", "same"), (704, "u", "y" * 300_000), (None, "u", "lonely")]


@pytest.mark.parametrize("split, least", [("4k", 0), ("128m", 10)])
def test_round_trip(spark, split, least):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in ROWS], "page_id long, url string, html string, id string, digest string")
    path = scratch(spark, "warc")
    warc.write_archives(pages.repartition(2), path, least)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert read(spark, path) == expect(ROWS, least)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_cut_file(spark, tmp_path):
    path = scratch(spark, "warc")
    warc.write_archives(spark.createDataFrame(ROWS[:20], "page_id long, url string, html string").coalesce(1), path)
    whole = b"".join(f.read_bytes() for f in sorted(__import__("pathlib").Path(path.removeprefix("file:")).glob("part-*")))
    (tmp_path / "a.warc").write_bytes(whole[:whole.rindex(b"WARC/1.0\r\nWARC-Type: res")] + b"WARC/1.0\r\nbroken")
    assert 0 < len(read(spark, str(tmp_path))) < 20


def test_empty(spark):
    path = scratch(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).collect() == []


def test_registered(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted((tuple(r)[:5] for r in queries.op6_warc_boundary_chain(spark, sf).collect()), key=str) == expect(rows)
