"""The registered queries of this subpackage, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.llm import (chat, content_sort, decontamination, hyperminhash, licenses, packing, periodic, prefix_trie, secrets, token_store, topk,
                         toxicity, warc)
from lakeops.llm.tokens import vocabulary
from lakeops.session import scratch
from lakeops.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_store(spark: SparkSession, root: str) -> DataFrame:
    path = scratch(spark, "token-store")
    token_store.write_tokens(load(spark, root, "documents"), path, vocabulary("word_bpe_49k.json"))
    return token_store.token_index(spark, path)


def op2_secret_scan(spark: SparkSession, root: str) -> DataFrame:
    return secrets.scan(load(spark, root, "documents")).drop("found")


def op3_snapshot_collapse(spark: SparkSession, root: str) -> DataFrame:
    return chat.render(load(spark, root, "conversations"))


def op4_hyperminhash(spark: SparkSession, root: str) -> DataFrame:
    return hyperminhash.near_duplicates(load(spark, root, "documents"), words=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op5_license_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    docs = load(spark, root, "documents")
    weights, least = licenses.train(spark, docs)
    return licenses.scan(docs, weights, least).drop("tkey")


def op6_warc_boundary_chain(spark: SparkSession, root: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(load(spark, root, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op7_columnar_top_k(spark: SparkSession, root: str) -> DataFrame:
    vectors = load(spark, root, "embeddings")
    return topk.top_k(vectors.filter(F.col("vec_id") % 100 == 0), vectors)


def op8_template_windows(spark: SparkSession, root: str) -> DataFrame:
    return decontamination.contaminated(load(spark, root, "documents"), load(spark, root, "benchmark")).drop("tkey")


def op9_subword_toxicity(spark: SparkSession, root: str) -> DataFrame:
    docs = load(spark, root, "documents")
    model = toxicity.train(docs, load(spark, root, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op10_mixture_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(load(spark, root, "documents"), vocabulary("byte_bpe_50k.json")).drop("ids")


def op11_content_sort(spark: SparkSession, root: str) -> DataFrame:
    return content_sort.copies(load(spark, root, "documents")).drop("tkey")


def op12_prefix_trie(spark: SparkSession, root: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(load(spark, root, "conversations")))).drop("code")


def op13_periodic_runs(spark: SparkSession, root: str) -> DataFrame:
    return periodic.periodic_runs(load(spark, root, "documents"), repeat_tails=True).drop("tkey")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_token_store, op2_secret_scan, op3_snapshot_collapse, op4_hyperminhash, op5_license_paragraphs, op6_warc_boundary_chain,
    op7_columnar_top_k, op8_template_windows, op9_subword_toxicity, op10_mixture_packing, op11_content_sort, op12_prefix_trie,
    op13_periodic_runs)}

# The digest's base 32: five hexadecimal digits at a time are four digits of base 32.
_SHA = "sha1(coalesce(html, ''))"
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT) >> {15 - 5 * j}) & 31 AS INTEGER), 1)"
    for k in range(8) for j in range(4))

# CRC-32 of an id in decimals, bit by bit: each character is mixed in, then shifted out in eight steps.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"""

ORACLES: dict[str, str] = {
    "op3_snapshot_collapse": """
        WITH d AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM d),
        s AS (SELECT conv_id, place, string_agg(md5(role || chr(0) || text), '') OVER (PARTITION BY conv_id ORDER BY place) AS state FROM t),
        n AS (SELECT conv_id, max(place) AS n_turns, max(state) AS state FROM s GROUP BY conv_id),
        e AS (SELECT state, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM n GROUP BY state, n_turns),
        p AS (SELECT DISTINCT s.state FROM s JOIN n USING (conv_id) WHERE s.place < n.n_turns),
        m AS (SELECT * FROM e WHERE state NOT IN (SELECT state FROM p))
        SELECT m.conv_id, m.n_turns, m.n_copies,
               string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
        FROM m JOIN t USING (conv_id) GROUP BY m.conv_id, m.n_turns, m.n_copies""",
    "op6_warc_boundary_chain": f"""
        WITH d AS (SELECT page_id, url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, {_SHA} AS h FROM pages),
        w AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d)
        SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to, url FROM w""",
    "op7_columnar_top_k": """
        WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
        SELECT * FROM r WHERE rank <= 10""",
    "op11_content_sort": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        n AS (SELECT doc_id, length(text) AS points, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS norm FROM d),
        r AS (SELECT doc_id, norm, row_number() OVER best AS place, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
              FROM n WINDOW best AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r""",
    "op12_prefix_trie": f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations WHERE conv_id IS NOT NULL),
        s AS (SELECT conv_id, list({{'role': role, 'said': said}} ORDER BY turn NULLS FIRST, role, said) AS turns FROM t GROUP BY conv_id),
        h AS (SELECT conv_id, turns, conv_id - conv_id % 100 AS base, CAST({_CRC32} % 6 AS INTEGER) AS h FROM s),
        b AS (SELECT h.conv_id, CASE WHEN p.turns IS NULL THEN h.turns[h.h + 1:] ELSE list_concat(p.turns[1:h.h], h.turns[h.h + 1:]) END AS turns
              FROM h LEFT JOIN s p ON p.conv_id = h.base),
        p AS (SELECT conv_id, d, turns[1:d] AS path, len(turns) = d AS ends FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM b)),
        n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                     sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY path, d),
        k AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
        w AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(n.path[d].said) ELSE 0 END AS saved FROM n LEFT JOIN k USING (path)),
        u AS (SELECT path[1:a] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
              FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM w) GROUP BY 1)
        SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
               CAST(saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
        FROM w JOIN u USING (path) LEFT JOIN n up ON w.d > 0 AND up.d = w.d - 1 AND up.path = w.path[1:w.d - 1]""",
}
