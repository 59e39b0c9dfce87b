"""Benchmark decontamination by template windows, with DataFrame functions only.

Texts are brought to templates: numbers and units become typed placeholders, and so does, at each of its places, every word
that an item has as a name anywhere. Windows of words of the benchmark's templates are joined by hash with those of the documents,
at the places of names whatever the documents have there, so a question is found again after its numbers, names and units
were replaced, in any case and spacing. Then the slots are compared: along one run of windows, a name of the item must stand against one
name of the document - the same person all the way through. Windows whose words are the item's own need no such test.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.llm.common import matching
from lakeops.session import materialised

# The placeholders (private-use characters, so that no text has them), number words, units of measure.
NUMBER, NAME, UNIT = "\ue001", "\ue002", "\ue003"
# Sequences of words: as they are; as a template; as a template with neighbouring names as one.
RAW, TEMPLATE, JOINED = "raw", "template", "joined"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
                "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million dozen")
UNITS = ("mm cm m km mg g kg lb lbs oz ml l inch inches foot feet yard yards mile miles meter meters metre metres gram grams liter liters litre litres "
         "second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent")
LETTER = r"[\p{L}\p{N}]"


def _cut(text: Column) -> Column:
    """Words: what is left between white space without all but letters, digits and placeholders. No words: one empty word."""
    plain = F.regexp_replace(text, r"[^\p{L}\p{N}" + f"{NUMBER}-{UNIT}" + r"\s\p{Z}]+", "")
    return F.split(F.btrim(plain, F.lit(SPACES)), r"[\s\p{Z}]+")


def _apart(text: Column) -> Column:
    """The text with hyphens and slashes as spaces, and one between a number and its unit."""
    return F.regexp_replace(text, rf"(?<={LETTER})[-‐‑–—/](?={LETTER})|(?<=\p{{N}})(?=(?i:{'|'.join(UNITS.split())})(?!{LETTER}))", " ")


def _together(text: Column) -> Column:
    """The text with neighbouring names inside a sentence as one word."""
    return F.regexp_replace(text, r"[\s\p{Z}]+(?=\p{Lu})(?<=[\p{Ll}\p{N},;][\s\p{Z}]{1,3}\p{Lu}[\p{L}'’]{0,40}[\s\p{Z}]{1,3})", "")


def typed_words(text: Column) -> Column:
    """The words of a text with numbers and units as placeholders, whatever their case; names are up to the benchmark's items."""
    numbers = F.regexp_replace(F.lower(text), rf"(?<!{LETTER})[$€£]?\p{{N}}+(?:[.,]\p{{N}}+)*%?(?!{LETTER})", NUMBER)
    return F.transform(_cut(numbers), lambda w: F.when(w.isin(*NUMBER_WORDS.split()), NUMBER).when(w.isin(*UNITS.split()), UNIT).otherwise(w))


def _collapsed(df: DataFrame, kind: str, words: str = "w", raw: str | None = "raw") -> DataFrame:
    """Neighbouring placeholders of one kind as one; its raw word is theirs, written together."""
    if raw is None:
        return df.withColumn(words, F.filter(words, lambda w, i: (w != kind) | (i == 0) | (F.get(words, i - 1) != kind)))
    heads = df.withColumn("_head", F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != kind) | (F.get(words, i - 1) != kind)))
    after = lambda k: F.coalesce(F.get("_head", k + 1), F.size(words))
    heads = heads.withColumn(raw, F.transform("_head", lambda i, k: F.array_join(F.slice(raw, i + 1, after(k) - i), "")))
    return heads.withColumn(words, F.transform("_head", lambda i: F.get(words, i))).drop("_head")


def names(text: Column) -> Column:
    """The words, in lower case, that a text has as names somewhere: capital words inside a sentence."""
    plain = F.regexp_replace(text, r"[\s\p{Z}]+", " ")
    found = F.regexp_extract_all(plain, F.lit(rf"(?<=[\p{{Ll}}\p{{N}},;] )\p{{Lu}}\p{{L}}*(?:['’]\p{{L}}+)*(?!{LETTER})"), F.lit(0))
    return F.transform(found, lambda w: F.regexp_replace(F.lower(w), "['’]", ""))


def raw_words(text: Column) -> Column:
    """The words themselves, place by place those of ``typed_words``."""
    return _cut(F.lower(text))


def _hashes(words: Column) -> Column:
    """A hash for each word."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(hashes: Column, size: Column | int) -> Column:
    """A hash for each run of ``size`` words, from the hashes of the words. A known size needs no array for each run."""
    if isinstance(size, int):
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)]))
    return F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(F.slice(hashes, i + 1, size)))


def _turned(h: Column, place: Column | int) -> Column:
    """A hash turned by its place in a window, so that hashes of words can be put together by exclusive or."""
    by = F.lit(7 * place + 1) if isinstance(place, int) else place * 7 + 1
    return F.call_function("shiftleft", h, by).bitwiseOR(F.call_function("shiftrightunsigned", h, 64 - by))


def _left_out(run: Column, size: int, mask: int) -> Column:
    """The hash of a window whose words at the bits of ``mask`` are names, from the hashes of its words: one step a word."""
    told = [_turned(F.get(run, F.lit(j)), j) for j in range(size) if not mask >> j & 1]
    return reduce(lambda x, y: x.bitwiseXOR(y), told, F.xxhash64(F.lit(size), F.lit(mask)))


def _held(win: Column, size: Column, mask: Column) -> Column:
    """The same hash of an item's window, whatever its mask."""
    told = F.transform(win, lambda w, j: F.when(w == NAME, F.lit(0).cast("long")).otherwise(_turned(F.xxhash64(w), j)))
    return F.aggregate(told, F.xxhash64(size, mask), lambda x, y: x.bitwiseXOR(y))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, least_windows: int = 6, least_share: float = 0.5, least_literal: int = 5,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and benchmark item of which it holds a passage.

    A pair is reported if, over the runs whose names agree, ``least_windows`` consecutive windows (13 words) or
    ``least_share`` of the item's windows are found. Windows of the raw words always count. A window of the
    template, whose slots may have changed, counts if ``least_literal`` of its words are no placeholders. Items shorter than a
    window are one window of all their words, of which in a template the same share must be no placeholders; items of fewer than three words are no evidence and match nothing. NULL texts have no words; NULL ids are kept as they are; a repeated
    document is reported for each row, a repeated item once.

    Columns: doc_id, tkey (hash of the text), item_id, n_windows (of the item), n_matched, n_slots (placeholders compared),
    exact (no slot differs). Whether the benchmark's windows are broadcast is up to the planner, by their size. Words are hashed
    once each; the hash of a window with names left out is put together from those of its words.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    given = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    apart = given.select("item", _apart(F.col("text")).alias("text")).withColumn("names", names(F.col("text")))
    typed = materialised(apart.select("item", F.lit(TEMPLATE).alias("seq"), F.transform(typed_words(F.col("text")), lambda w: F.when(F.array_contains("names", w), NAME).otherwise(w)).alias("w"),
                                  raw_words(F.col("text")).alias("raw")), "typed")
    one = materialised(_collapsed(typed, NUMBER), "one")  # written, as filters on words would make them again for each word
    joined = materialised(_collapsed(one.withColumn("seq", F.lit(JOINED)).withColumn("_n", F.size("w")), NAME), "joined").filter("size(w) < _n").drop("_n")
    items = one.union(joined).union(given.select("item", F.lit(RAW), raw_words(F.col("text")), raw_words(F.col("text")))).filter("size(w) >= 3").dropDuplicates(["item", "seq", "raw"])
    items = materialised(items.withColumn("size", F.least(F.size("w"), F.lit(window))).withColumn("n_windows", F.size("w") - F.col("size") + 1), "items")
    spots = items.select("item", "seq", "size", "n_windows", "w", F.posexplode(_windows(_hashes(F.col("w")), F.col("size"))).alias("at", "h"))
    in_window = F.slice("w", F.col("at") + 1, F.col("size"))
    literal = F.size(F.filter(in_window, lambda w: ~w.isin(NUMBER, NAME, UNIT)))
    mask = F.aggregate(F.transform(in_window, lambda w, j: F.when(w == NAME, F.pow(F.lit(2), j)).otherwise(F.lit(0.0))), F.lit(0.0), lambda m, v: m + v).cast("int")
    spots = materialised(spots.filter(literal * window >= F.col("size") * least_literal).withColumn("slots", literal < F.col("size")).withColumn("mask", mask).withColumn(
        "h", F.when(mask > 0, _held(in_window, F.col("size"), mask)).otherwise(F.col("h"))).drop("w").withColumn("rank", F.row_number().over(Window.partitionBy("item", "seq").orderBy("at"))), "spots")
    # Sequences, sizes and placements of names that windows have: at most 93 placements for each size, by least_literal.
    kinds = spots.groupBy(F.expr(f"seq = '{RAW}'").alias("plain"), "size", F.expr("mask > 0").alias("named")).agg(F.sort_array(F.collect_set("mask")).alias("masks")).collect()

    keyed = rows.withColumn("tkey", F.xxhash64("text"))
    close = keyed.select("id", "tkey", _apart(F.col("text")).alias("text"))
    pairs = close.withColumn("joined", _together(F.col("text"))).filter(F.col("joined") != F.col("text")).select("id", "tkey", F.col("joined").alias("text"))
    worded = {RAW: keyed.select("id", "tkey", raw_words(F.col("text")).alias("words"))}
    for seq, texts in ((TEMPLATE, close), (JOINED, pairs)):
        worded[seq] = _collapsed(texts.select("id", "tkey", typed_words(F.col("text")).alias("words")), NUMBER, "words", None)
    columns = ["id", "tkey", "place", "item", "seq", "doc_seq", "at", "rank", "n_windows", "size", "slots"]
    hits = None
    # Neighbouring names of a document count as one only where the benchmark has names: no other window can span a joined word.
    templates = (TEMPLATE, JOINED) if any(k["named"] for k in kinds) else (TEMPLATE,)
    for seq, (plain, size, named, masks) in [(seq, k) for k in kinds for seq in ((RAW,) if k["plain"] else templates)]:
        hashed = worded[seq].select("id", "tkey", _hashes(F.col("words")).alias("hashes"))
        if named:  # the document's words at the places of names may be any, so each placement is tried
            runs = F.transform(F.sequence(F.lit(1), F.size("hashes") - size + 1), lambda i: F.slice("hashes", i, size))
            exploded = hashed.select("id", "tkey", F.posexplode(F.when(F.size("hashes") >= size, runs)).alias("place", "run"))
            exploded = exploded.select("id", "tkey", "place", F.explode(F.array(*[_left_out(F.col("run"), size, m) for m in masks])).alias("hash"))
        else:
            runs = F.when(F.size("hashes") >= size, _windows(F.col("hashes"), size))  # a filter would make the words twice
            exploded = hashed.select("id", "tkey", F.posexplode(runs).alias("place", "hash"))
        wanted = spots.filter(((F.col("seq") == RAW) == plain) & (F.col("size") == size) & ((F.col("mask") > 0) == named))
        found = exploded.join(wanted, F.col("hash") == F.col("h")).withColumn("doc_seq", F.lit(seq)).select(*columns)
        hits = found if hits is None else hits.union(found)
    if hits is None:
        hits = worded[RAW].limit(0).join(spots).withColumn("doc_seq", F.lit(RAW)).select(*[F.lit(0).alias(c) if c == "place" else c for c in columns])
    pair = ["id", "tkey", "item", "seq", "doc_seq", "shift"]
    hits = hits.withColumn("shift", F.col("place") - F.col("at"))
    # Per alignment the item's windows are a set of at most its length; repeated rows of a document give the same set.
    aligned = materialised(hits.groupBy(*pair, "n_windows", "size").agg(F.array_sort(F.collect_set(F.struct("at", "rank"))).alias("ats"), F.max("slots").alias("slots")), "alignments")

    # Slots: only alignments that have any go back to the texts. Each run of windows is judged by itself; those that do not count break none.
    slotted = aligned.filter("slots").drop("slots")
    starts = F.filter("ats", lambda a, i: (i == 0) | (F.get("ats", i - 1)["rank"] != a["rank"] - 1))
    ends = F.filter("ats", lambda a, i: (i == F.size("ats") - 1) | (F.get("ats", i + 1)["rank"] != a["rank"] + 1))
    slotted = slotted.withColumn("run", F.explode(F.zip_with(starts, ends, lambda a, b: F.struct(a["at"].alias("first"), b["at"].alias("last")))))
    inside = F.filter(F.transform("ats", lambda a: a["at"]), lambda a: (a >= F.col("run.first")) & (a <= F.col("run.last")))
    slotted = slotted.select(*pair, "n_windows", "size", "run.first", "run.last", inside.alias("ats"))
    theirs = items.select(F.col("item").alias("_item"), F.col("seq").alias("_seq"), "w", F.col("raw").alias("theirs"))
    slotted = slotted.join(theirs, F.col("item").eqNullSafe(F.col("_item")) & (F.col("seq") == F.col("_seq"))).drop("_item", "_seq")
    needed = slotted.select(F.col("id").alias("_id"), F.col("tkey").alias("_tkey"), F.col("doc_seq").alias("_doc_seq")).distinct()
    texts = keyed.join(needed, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_tkey"))).dropDuplicates(["_id", "_tkey", "_doc_seq"]).withColumn("text", _apart(F.col("text")))
    texts = texts.withColumn("text", F.when(F.col("_doc_seq") == JOINED, _together(F.col("text"))).otherwise(F.col("text")))
    ours = _collapsed(texts.select("_id", "_tkey", "_doc_seq", typed_words(F.col("text")).alias("_w"), raw_words(F.col("text")).alias("ours")), NUMBER, "_w", "ours").drop("_w")
    seen = slotted.join(ours, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_tkey")) & (F.col("doc_seq") == F.col("_doc_seq")))
    places = F.filter(F.sequence("first", F.col("last") + F.col("size") - 1), lambda p: F.get("w", p).isin(NUMBER, NAME, UNIT))
    seen = seen.withColumn("places", F.transform(places, lambda p: F.struct(p.alias("p"), F.get("w", p).alias("kind"), F.get("theirs", p).alias("theirs"), F.get("ours", p + F.col("shift").cast("int")).alias("ours"))))
    # The same person all the way through; equal numbers may be of different things. Windows whose words are the item's own need no test.
    people = F.filter("places", lambda v: v["kind"] == NAME)
    agree = F.size(F.array_distinct(F.transform(people, lambda v: v["theirs"]))) == F.size(F.array_distinct(F.transform(people, lambda v: F.struct(v["theirs"], v["ours"]))))
    changed = F.transform(F.filter("places", lambda v: ~v["theirs"].eqNullSafe(v["ours"])), lambda v: v["p"])
    seen = seen.withColumn("agree", agree).withColumn("changed", changed)
    same = F.filter("ats", lambda a: ~F.exists("changed", lambda p: (p >= a) & (p < a + F.col("size"))))
    seen = seen.withColumn("ats", F.when(F.col("agree"), F.col("ats")).otherwise(same)).filter("size(ats) > 0")
    compared = F.when(F.col("agree"), F.size("places")).otherwise(F.size(F.filter("places", lambda v: F.exists("ats", lambda a: (v["p"] >= a) & (v["p"] < a + F.col("size"))))))
    seen = seen.select(*pair, "n_windows", "ats", compared.alias("n_slots"), (~F.col("agree") | (F.size("changed") == 0)).alias("same"))
    kept = aligned.filter("not slots").select(*pair, "n_windows", F.transform("ats", lambda a: a["at"]).alias("ats"), F.lit(0).alias("n_slots"), F.lit(True).alias("same")).union(seen)
    # Runs of consecutive windows inside an alignment: the place minus its rank is the same along a run.
    runs = F.aggregate("ats", F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")),
                       lambda s, a: F.struct(a.alias("last"), F.when(a == s["last"] + 1, s["run"] + 1).otherwise(F.lit(1)).alias("run"),
                                             F.greatest(s["best"], F.when(a == s["last"] + 1, s["run"] + 1).otherwise(F.lit(1))).alias("best")), lambda s: s["best"])
    kept = kept.withColumn("run", runs)
    result = (kept.groupBy("id", "tkey", "item", "seq", "doc_seq", "n_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_set("ats")))).alias("n_matched"), F.max("run").alias("run"),
                                                                  F.sum("n_slots").alias("n_slots"), F.min("same").alias("exact"))
              .filter((F.col("run") >= least_windows) | (F.col("n_matched") >= least_share * F.col("n_windows"))))
    # Raw words and template may both tell; the better covered one gives the counts.
    best = F.struct(F.col("n_matched") / F.col("n_windows"), "n_matched", "n_windows")
    result = result.groupBy("id", "tkey", "item").agg(F.max(best).alias("best"), F.max("n_slots").alias("n_slots"), F.min("exact").alias("exact"))
    return result.select(F.col("id").alias("doc_id"), "tkey", F.col("item").alias("item_id"), "best.n_windows", F.col("best.n_matched").cast("long").alias("n_matched"), "n_slots", "exact")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no passage of the benchmark."""
    return matching(docs, contaminated(docs, benchmark), "left_anti").select(*docs.columns)
