"""The pipeline's stages one after the other, each held against a slow version of itself on its own input."""

import random

import pytest

import corpus_pipeline
from lakeops.llm import secrets, toxicity
from lakeops.session import materialised

from tests.llm.fixtures import edge_docs, edge_rows, prose
from tests.llm.test_classifiers import spoken
from tests.llm.test_near_duplicates import copies, groups
from tests.llm.test_tokens import check_pieces, ids_of

NAMES = [name for name, _ in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A directory of tables with toxic texts, copies, benchmark passages and secrets."""
    rng = random.Random(6)
    passage = prose(77, 40)
    rows = [(i, spoken(i, 60, 4 if i % 5 == 0 else 0), "en", f"s{i % 3}", 0) for i in range(500)]
    rows += [(1000 + i, t, "en", "copies", 0) for i, t in enumerate(copies(1, 120, 60, 3))]
    rows += [(2000 + i, f"{prose(500 + i, 30)} {passage} {prose(600 + i, 5)}", "en", "leaks", 0) for i in range(10)]
    rows += [(3000 + i, f"{prose(700 + i, 30)} token = \"{rng.getrandbits(160):040x}\"", "en", None, 0) for i in range(10)]
    rows += [(4000 + (i if i is not None else 50) if i is not None else None, t, a, s, n) for i, t, a, s, n in edge_rows()]
    root = str(tmp_path_factory.mktemp("tables"))
    edge_docs(spark, rows).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(500)], "doc_id long, toxic long").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda t: tuple((v is not None, v) for v in t))


def test_stages(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    assert NAMES == ["toxicity", "near-duplicates", "decontamination", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = rows_of(docs)
        new = materialised(stage(spark, docs, planted), "test-stage")
        if name != "packing":
            assert new.columns == docs.columns
            after = rows_of(new)
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{planted}/labels.parquet"))
            known = toxicity._Margins(model)
            assert after == [(i, t) for i, t in before if toxicity.score_text(t or "", model, known) < model.at]
            gone = {i for i, _ in before} - {i for i, _ in after}
            assert len(gone - set(range(0, 500, 5))) <= 3 and len(gone & set(range(0, 500, 5))) >= 97
        elif name == "near-duplicates":
            want, seen = [], set()
            for (i, t), (_, n, _, kept) in zip(before, groups(before, 5, 80)):
                if kept and not (n and (i, t) in seen):
                    want.append((i, t))
                    seen.add((i, t))
            assert after == want and len(after) < len(before) - 30
        elif name == "decontamination":
            assert after == [(i, t) for i, t in before if i is None or not 2000 <= i < 2010]
        elif name == "secrets":
            assert after == [(i, t and secrets.redacted(t, secrets.find_secrets(t)[1])) for i, t in before]
            assert sum("[SECRET]" in (t or "") for _, t in after) >= 10
        else:
            check_pieces(new.collect(), ids_of(before, "byte_bpe_50k.json"))
        docs = new


def test_run_is_its_stages(spark, sf):
    """The registered pipeline packs every token of what the stages keep, once."""
    pieces = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf), "test-stage")
    check_pieces(pieces, ids_of([(r.doc_id, r.text) for r in docs.collect()], "byte_bpe_50k.json"))


def test_empty_tables(spark, tmp_path):
    for table, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, toxic long"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


