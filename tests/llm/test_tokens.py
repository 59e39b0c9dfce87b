"""Token store and packing against the tokenizers library on whole texts."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakeops.llm import packing, queries, token_store
from lakeops.llm.tokens import encoder, vocabulary
from lakeops.session import scratch

from tests.llm.fixtures import edge_docs, edge_rows, no_docs

NAMES = ("word_bpe_49k.json", "byte_bpe_50k.json")


def plain(name):
    t = Tokenizer.from_file(vocabulary(name))
    t.encode_special_tokens = True
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet="abZ  \n\t\r.,'’st$19ñÉßŠİ—ª\xa0\x0b\x1ćж%_|", max_size=24))
def test_encoder_equals_library(name, text):
    assert encoder(vocabulary(name)).encode(text) == plain(name)(text).tobytes()


def ids_of(rows, name):
    encode = plain(name)
    return [(i, np.append(encode(t), np.uint32(1)).astype("<u4")) for i, t, *_ in rows]


def check_store(index, coded):
    at = 0
    for got, (i, ids) in zip(index, coded, strict=True):
        assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_store(spark):
    path = scratch(spark, "store")
    token_store.write_tokens(edge_docs(spark), path, vocabulary(NAMES[0]), shard_bytes=20_000)
    index = sorted(token_store.token_index(spark, path).collect(), key=lambda r: r.start)
    coded = {(i, a.tobytes()) for i, a in ids_of(edge_rows(), NAMES[0])}
    assert [r.doc_id for r in index] == sorted((r[0] for r in edge_rows()), key=lambda i: (i is not None, i))
    at = 0
    for r in index:  # rows of one id may come in either order of their texts
        assert r.start == at and any(i == r.doc_id and r.ids_crc32 == zlib.crc32(b) and r.n_tokens == len(b) // 4 for i, b in coded)
        at += r.n_tokens
    few = token_store.read_tokens(spark, path, [1, 8]).collect()
    assert {(r.doc_id, tuple(r.ids)) for r in few} == {(i, tuple(a.tolist())) for i, a in ids_of(edge_rows(), NAMES[0]) if i in (1, 8)}
    assert index[-1].shard > 0


def test_store_refuses_another_dictionary(spark):
    path = scratch(spark, "store")
    token_store.write_tokens(edge_docs(spark), path, vocabulary(NAMES[0]))
    spark.createDataFrame([(bytearray(b"other"), "x")], "dictionary binary, sha256 string").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(Exception, match="no shard of this store"):
        token_store.read_tokens(spark, path).collect()


def test_empty_store(spark):
    path = scratch(spark, "store")
    token_store.write_tokens(no_docs(spark), path, vocabulary(NAMES[0]))
    assert token_store.token_index(spark, path).collect() == []


def check_pieces(pieces, coded, length=2048):
    """Every id in exactly one piece; sequences gapless, only the last one not full."""
    found, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        found[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    want = defaultdict(list)
    for i, ids in coded:
        want[i].append(ids)
    assert set(found) == set(want)
    for i, docs in want.items():
        if len(docs) == 1:
            at = 0
            for p in sorted(found[i], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(docs[0]) and p.ids_crc32 == zlib.crc32(docs[0][at:at + p.length].tobytes())
                at += p.length
            assert at == len(docs[0])
        else:
            assert sum(p.length for p in found[i]) == sum(map(len, docs))
    assert sorted(sequences) == list(range(len(sequences)))
    for k, parts in sequences.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or k == len(sequences) - 1


@pytest.mark.parametrize("length, window, burst", [(2048, 64, 256), (16, 2, 3), (64, 1, 64)])
def test_packing(spark, length, window, burst):
    pieces = packing.pack(edge_docs(spark), vocabulary(NAMES[1]), length, window_sequences=window, burst=burst).collect()
    check_pieces(pieces, ids_of(edge_rows(), NAMES[1]), length)


def test_packing_keeps_proportions(spark):
    rows = [(i, "alpha beta gamma " * (5 + i % 7), "en", "big" if i % 4 else "small", 0) for i in range(400)]
    pieces = packing.pack(edge_docs(spark, rows), vocabulary(NAMES[1]), 64, window_sequences=8, burst=16).collect()
    check_pieces(pieces, ids_of(rows, NAMES[1]), 64)
    total = sum(p.length for p in pieces if p.source == "small") / sum(p.length for p in pieces)
    windows = defaultdict(lambda: [0, 0])
    for p in pieces:
        windows[p.sequence_id // 8][p.source == "small"] += p.length
    for k, (big, small) in windows.items():
        if k < len(windows) - 1:
            assert abs(small - total * 512) <= 2 * 16 + 1


def test_packing_wanted_shares(spark):
    rows = [(i, "alpha beta gamma " * 9, "en", "ab"[i % 2], 0) for i in range(200)]
    pieces = packing.pack(edge_docs(spark, rows), vocabulary(NAMES[1]), 64, window_sequences=8, burst=16, shares={"a": 0.75, "b": 0.25}).collect()
    check_pieces(pieces, ids_of(rows, NAMES[1]), 64)
    first = [p for p in pieces if p.sequence_id < 40]
    assert abs(sum(p.length for p in first if p.source == "a") / sum(p.length for p in first) - 0.75) < 0.03


def test_empty_packing(spark):
    assert packing.pack(no_docs(spark), vocabulary(NAMES[1])).collect() == []


def test_registered(spark, sf):
    rows = sorted((tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    check_store(sorted(queries.op1_token_store(spark, sf).collect(), key=lambda r: r.doc_id), ids_of(rows, NAMES[0]))
    check_pieces(queries.op10_mixture_packing(spark, sf).collect(), ids_of(rows, NAMES[1]))
