"""Quality rules: character classes, windows of words and reference words against brute force."""

import random
import unicodedata

from pyspark.sql import functions as F

from lexiframe.llm import quality_rules as rules

WORDS = "a b c d é ß 7 #x don't “quoted” 中文 x-y ٣ 😀 end.".split(" ")


def texts(n=60):
    rng = random.Random(5)
    return [rng.choice([" ", "\n", "\t "]).join(rng.choices(WORDS[:rng.randint(1, len(WORDS))], k=rng.randint(0, 40)))
            for _ in range(n)]


def test_classes(spark):
    kinds = {"letters": lambda c: unicodedata.category(c)[0] == "L", "digits": lambda c: unicodedata.category(c)[0] == "N",
             "blanks": lambda c: c in " \t\n\x0b\f\r", "symbols": lambda c: c in "#*$%&|<>",
             "marks": lambda c: c in ".,;:!?'\"()-"}
    rows = rules.class_counts(spark.createDataFrame([(t,) for t in texts()], "text string")).collect()
    for r in rows:
        assert r["n_chars_all"] == len(r["text"])
        assert {k: r[f"in_{k}"] for k in kinds} == {k: sum(map(f, r["text"])) for k, f in kinds.items()}


def test_windows_are_hashed_by_doubling(spark):
    docs = spark.createDataFrame([(t.split(),) for t in texts()], "words array<string>")
    rows = docs.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("windows", rules.window_hashes(F.col("hashes")))
    names = {}
    for r in rows.collect():
        spans = [tuple(r["words"][k:k + 8]) for k in range(len(r["words"]) - 7)]
        assert (r["windows"] or []) == [names.setdefault(s, h) for s, h in zip(spans, r["windows"] or [], strict=True)]
    assert len(set(names.values())) == len(names) > 100


def test_reference_words_that_share_a_slot(spark):
    many = [f"w{k}" for k in range(4000)]
    slots = dict(spark.createDataFrame([(w,) for w in many], "w string").select(
        "w", rules._slot(F.xxhash64("w"))).collect())
    first = many[0]
    twin, other = [w for w in many[1:] if slots[w] == slots[first]][:2]
    alone = next(w for w in many if slots[w] != slots[first])
    shadow = next(w for w in many if slots[w] == slots[alone] and w != alone)
    words = [first, twin, twin, other, alone, shadow, "none"]
    row = spark.createDataFrame([(words, [first, alone, twin])], "words array<string>, top array<string>")
    row = row.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("slots", rules.slots_of(F.col("top")))
    shares = row.select(rules.word_shares(F.col("words"), F.col("hashes"), F.col("top"), F.col("slots"), F.lit(7))).first()[0]
    assert shares == [1 / 7, 1 / 7, 2 / 7]
