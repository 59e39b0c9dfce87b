"""Toxicity, licences and decontamination on small corpora with known answers."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeops.llm import decontamination, licenses, queries, toxicity

from tests.llm.fixtures import edge_docs, no_docs, prose

BAD = ("grumblefink", "snotterwack", "blatherskite")


def spoken(seed, words, bad=0, misspelt=False):
    rng = random.Random(seed)
    out = ["".join(rng.choice(("ba", "lo", "ri", "te", "mu", "sen")) for _ in range(rng.randrange(1, 5))) for _ in range(words)]
    for _ in range(bad):
        w = rng.choice(BAD)
        out[rng.randrange(words)] = w[:5] + "xx" + w[5:] if misspelt else w
    return " ".join(out)


def corpus():
    rows = [(i, spoken(i, 60, 4 if i % 5 == 0 else 0), "en", "a", 0) for i in range(900)]
    labels = [(i, int(i % 5 == 0)) for i in range(900)]
    return rows, labels


def test_toxicity(spark):
    rows, labels = corpus()
    rows += [(2000 + i, spoken(5000 + i, 60, 4, misspelt=True), "en", "a", 0) for i in range(30)] + [(3000, None, None, None, None), (None, spoken(1, 9), None, None, None), (3001, " 12 ", "en", "a", 0), (0, rows[0][1], "en", "a", 0)]
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (7, 0)], "doc_id long, toxic long")
    docs = edge_docs(spark, rows)
    model = toxicity.train(docs, marks)
    got = {(r.doc_id, r.predicted): r.score for r in toxicity.score(docs, model).collect()}
    said = {i: p for i, p in got}
    assert len(toxicity.score(docs, model).collect()) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(said[i] == (i % 5 == 0) for i in held) >= 0.98 * len(held)
    assert sum(said[2000 + i] for i in range(30)) >= 27  # misspellings that were never seen
    assert said[3000] == said[3001] == 0
    clean = toxicity.without_toxic(docs, model)
    assert clean.schema == docs.schema and {r.doc_id for r in clean.collect()} == {i for i, p in said.items() if not p}
    marked = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert all(marked[i] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i in marked)


def test_labels_held_out_teach_nothing(spark):
    rows, labels = corpus()
    docs = edge_docs(spark, rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    twisted = [(i, 1 - y if held(i) else y) for i, y in labels]
    a, b = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, twisted))
    assert np.array_equal(a.margins, b.margins, equal_nan=True) and (a.bias, a.cut) == (b.bias, b.cut)


@pytest.mark.parametrize("labels", [[], [(1, 0), (3, 0)], [(1, 1)]])
def test_toxicity_without_two_classes(spark, labels):
    rows, _ = corpus()
    docs = edge_docs(spark, rows[:20])
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len({r.score for r in toxicity.score(docs, model).collect()}) == 1
    assert toxicity.score(no_docs(spark), model).collect() == []


def test_licences(spark):
    rows, want = [], set()
    for k, (family, notices) in enumerate(licenses.TEMPLATES.items()):
        for j, notice in enumerate(notices):
            i = 100 * k + j
            text = f"{prose(i, 30)}\n{notice.upper() if j % 2 else notice}\n\n{prose(i + 1, 20)}"
            rows.append((i, text, "en", "a", 0))
            want.add((i, 1, family))
    rows += [(5000 + k, f"{prose(k, 20)}\n{t}\nMy licence has expired, version 2 of it.", "en", "a", 0) for k, t in enumerate(licenses.OTHERS)]
    rows += [(7000 + k, "\n".join(prose(k * 9 + j, 15) for j in range(4)), "en", "a", 0) for k in range(200)]
    rows += [(None, f"x\n{licenses.TEMPLATES['mit'][0]}", None, None, None), (8000, None, None, None, None), (8001, "", None, None, None), (0, rows[0][1], "en", "a", 0)]
    want.add((None, 1, "mit"))
    docs = edge_docs(spark, rows)
    weights, least = licenses.train(spark, docs)
    got = licenses.scan(docs, weights, least).collect()
    assert {(r.doc_id, r.paragraph, r.family) for r in got} == want and len(got) == len(want)
    assert all(r.p >= least >= 0.5 and r.confirmed >= 0.75 for r in got)
    assert licenses.scan(no_docs(spark), weights, least).collect() == []


def test_licence_probabilities_are_the_model(spark):
    """The joined weights give what the sum over a line's grams gives."""
    docs = edge_docs(spark, [(i, f"{t}", "en", "a", 0) for i, t in enumerate([licenses.TEMPLATES["gpl"][0], "the software license of MIT", "public work"])])
    weights, _ = licenses.train(spark, docs)
    table = {r.gram: np.array(r.w) for r in weights.collect()}
    lines = licenses.paragraphs(docs)
    grams = {r.id: r.g for r in lines.select("id", licenses.grams(F.col("w")).alias("g")).collect()}
    for r in licenses.probabilities(lines, weights).collect():
        z = table[None] + sum(table[g] for g in grams[r.id] if g in table)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        k = 1 + int(np.argmax(p[1:]))
        assert r.family == list(licenses.TEMPLATES)[k - 1] and abs(r.p - p[k]) < 1e-9


ITEM = "Yesterday the baker Tom sold 12 loaves and 3 cakes to Mary, then Tom gave 3 more cakes to the old school near the river"


def swap(text, **words):
    return re.sub(r"\w+", lambda m: words.get(m[0], words.get(f"n{m[0]}", m[0])), text)


def test_decontamination(spark):
    again = swap(ITEM, Tom="Ann", Mary="Bob", n12="40", n3="7")
    mixed = re.sub("Tom", "Eve", swap(ITEM, Mary="Bob", n12="40", n3="7"), count=1)  # Tom is two different people now
    items = [(1, ITEM), (2, prose(1, 30)), (3, None), (4, "too short"), (5, "only four words here"), (5, "only four words here"), (None, prose(2, 20))]
    rows = [(1, f"{prose(10, 40)}. {ITEM}. {prose(11, 20)}", "en", "a", 0), (2, f"{prose(12, 20)} and {again}", "en", "a", 0), (3, f"{prose(13, 9)} and {mixed}", "en", "a", 0),
            (4, prose(1, 30).upper(), "en", "a", 0), (5, " ".join(prose(1, 30).split()[5:19]), "en", "a", 0), (6, " ".join(prose(1, 30).split()[5:14]), "en", "a", 0), (7, prose(3, 500), "en", "a", 0),
            (8, None, None, None, None), (9, "", "en", "a", 0), (None, prose(1, 30), "en", "a", 0), (10, "we have only four words here, see", "en", "a", 0), (11, "*** ".join(prose(1, 30).split()), "en", "a", 0),
            (12, f"{prose(2, 20)} {prose(1, 30)} {prose(1, 30)}", "en", "a", 0), (13, "too short", "en", "a", 0)]
    docs, bench = edge_docs(spark, rows), spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, size string")
    got = decontamination.contaminated(docs, bench)
    found = {(r.doc_id, r.item_id): r for r in got.collect()}
    assert set(found) == {(1, 1), (2, 1), (4, 2), (5, 2), (None, 2), (10, 5), (11, 2), (12, 2), (12, None)}
    assert found[1, 1].exact and not found[2, 1].exact and found[2, 1].n_slots > 5
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    shuffled = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled == set(found)  # the same without a broadcast
    left = decontamination.decontaminated(docs, bench)
    assert left.schema == docs.schema and {r.doc_id for r in left.collect()} == {3, 6, 7, 8, 9, 13}
    assert decontamination.contaminated(no_docs(spark), bench).collect() == []
    assert decontamination.contaminated(docs, bench.limit(0)).collect() == []


def matches(spark, items, texts):
    """The items found in each text, by the text's place."""
    docs = edge_docs(spark, [(i, f"{prose(90 + i, 20)}. {t}. {prose(60 + i, 20)}", "en", "a", 0) for i, t in enumerate(texts)])
    got = decontamination.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    return [{r.item_id for r in got if r.doc_id == i} for i in range(len(texts))]


def test_items_of_numbers_or_names_alone(spark):
    items = ["Compute 15 + 27 + 33 + 41 + 58 + 62", "We saw France, Spain, Italy, Greece, Malta, Cyprus, Poland, Latvia, Estonia, Finland, Sweden and Norway on the old map in June",
             "12 14 19 23 37 41 58 63 71 88 94"]
    assert matches(spark, items, [*items, "Compute 16 + 28 + 34 + 42 + 59 + 63"]) == [{0}, {1}, {2}, set()]


def test_names_whatever_their_case_spacing_and_place(spark):
    item = "Tom buys six red apples at the market and Mary counts them twice. Tom then sells four of these to his aunt, and after lunch Tom walks home with Mary"
    new = swap(item, Tom="Ann", Mary="Bob")
    loose = [text.replace(" ", sep) for text in (item, new) for sep in ("  ", "\r\n", "\u00a0")]
    assert matches(spark, [item], [item, item.lower(), item.upper(), new, new.lower(), new.upper(), *loose]) == [{0}] * 12
    first = "Tom buys red apples at the big market today. Tom then sells these to his old aunt. Later on she thanks Tom"
    assert matches(spark, [first], [swap(first, Tom="Ann"), swap(first, Tom="Ann").lower(), swap(first, apples="plums", aunt="uncle", market="shop", thanks="asks", today="now")]) == [{0}, {0}, set()]


def test_slots_by_run(spark):
    item = ("On Monday the teacher asked John to read twenty-five pages of the book, and John read 2 pages before 2 friends came along. After they left again he ran 5km "
            "through the park with his dog, then ate a large bowl of soup and slept until John was called for dinner by his mother")
    edited = item.replace("John", "Jack", 1)  # one occurrence of three
    shared = item.replace("2 pages", "4 pages").replace("2 friends", "9 friends").replace("John", "Mary Ann")
    units = item.replace("twenty-five", "25").replace("5km", "7 km").replace("John", "Eve")
    assert matches(spark, [item], [edited, shared, units]) == [{0}] * 3
    short = "we gave the clerk twenty-five old coins and walked 5km home"
    assert matches(spark, [short], ["we gave the clerk 31 old coins and walked 7 km home"]) == [{0}]
    pair = "this morning the old baker and Mary Ann went to see the new shop"
    assert matches(spark, [pair], [pair.replace("Mary Ann", "Tom"), pair.replace("Mary Ann", "Eva Lee").lower()]) == [{0}, {0}]


def test_plain_passages_by_brute_force(spark, sf):
    """Every document that holds 13 consecutive words of an item, by plain sets of word windows, is found."""
    cut = lambda t: re.sub(r"[^\w\s]|_", "", (t or "").lower()).split()
    windows = {}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = cut(r.text)
        for k in range(len(w) - 12):
            windows.setdefault(tuple(w[k:k + 13]), set()).add(r.item_id)
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = cut(r.text)
        want |= {(r.doc_id, i) for k in range(len(w) - 12) for i in windows.get(tuple(w[k:k + 13]), ())}
    got = {(r.doc_id, r.item_id) for r in queries.op8_template_windows(spark, sf).collect()}
    assert want <= got and len(got) <= len(want) + 3


def test_licence_training_counts_every_line(spark):
    """More than 2,000 texts, and lines after the first, all take part."""
    rows = [(i, f"first {i}\nthe software of day {i % 3}\nquiet words here", "en", "a", 0) for i in range(2500)]
    clean = {tuple(r.grams): r.n for r in licenses.clean_lines(edge_docs(spark, rows), ["software", "terms"], ["no such triple"]).collect()}
    assert clean == {(): 5000, ("software",): 2500}


def test_licence_threshold_keeps_the_clean_rate(spark):
    half = licenses.BANDS // 2
    assert licenses._least({0: 10}, 0.999) == licenses._least({}, 0.999) == 0.5
    assert licenses._least({0: 9990, half + 7: 10}, 0.999) == 0.5
    assert licenses._least({0: 9980, half + 7: 10, half + 9: 10}, 0.999) == (half + 8) / licenses.BANDS
