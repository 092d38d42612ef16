import random

import pytest
from pyspark.sql import functions as F
from util import documents, random_texts, sentences, words

from lexiframe.operators import corpus, vocabulary
from lexiframe.plans.layout import written
from lexiframe.plans.lookup import hot_rows, lookup, table_size
from lexiframe.plans.ranking import global_rank


@pytest.fixture(scope="module")
def example(spark):
    docs = documents(spark, ["The cat sat. A dog ran home! Yes"])
    sents = corpus.sentences(docs, True, ["the", "a"])
    return sents, written(vocabulary.build_vocabulary(corpus.word_counts(sents), 1), "vocabulary")


def test_example_vocabulary(example):
    got = {r.word: r.id for r in example[1].collect()}
    assert got == {"<UNK>": 0, "<EOS>": 1, "<PAD>": 2, "<GO>": 3,
                   "cat": 4, "dog": 5, "home": 6, "ran": 7, "sat": 8, "yes": 9}


def test_example_ids(example):
    got = vocabulary.index_sentences(*example).orderBy("sent_id").collect()
    assert [r.ids for r in got] == [[4, 8], [5, 7, 6], [9]]


def test_order_over_all_count_classes(spark):
    rng = random.Random(3)
    counts = {}
    for i in range(5000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        counts[word] = rng.choice([20, 20, 20, 21, 1023, 1024, 1025, 1500, 1600, 10**6, 10**12 + i])
    frame = spark.createDataFrame(list(counts.items()), "word string, cnt long").repartition(5)
    got = vocabulary.build_vocabulary(frame, 21).orderBy("id").collect()
    want = sorted((w for w, c in counts.items() if c >= 21), key=lambda w: (-counts[w], w))
    assert [r.word for r in got[4:]] == want
    assert [r.id for r in got] == list(range(len(want) + 4))


@pytest.mark.parametrize("levels", [
    lambda b: [{"b": b}],
    lambda b: [{"b": F.floor(b / 100)}, {"c": b}],
    lambda b: [{"a": F.lit(1)}, {"b": F.floor(b / 500)}, {"b": F.floor(b / 50), "c": b}]])
def test_rank_with_one_hot_bucket(spark, levels):
    rows = [(0 if i % 3 else i, i * 7919 % 3001) for i in range(3000)]
    frame = spark.createDataFrame(rows, "bucket int, x int").repartition(4)
    ranked = global_rank(frame, levels(F.col("bucket")), [F.col("x")], descending=["b", "c"])
    got = [(r["bucket"], r["x"]) for r in ranked.orderBy("rank").collect()]
    assert got == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert ranked.agg(F.countDistinct("rank"), F.max("rank")).first()[:] == (3000, 3000)


def brute_index(texts, known, unknown=0):
    return {(d, i): [known.get(w, unknown) for w in words(s) if unknown is not None or w in known]
            for d, t in enumerate(texts) for i, s in enumerate(sentences(t))}


@pytest.mark.parametrize("unknown", [0, None])
@pytest.mark.parametrize("path", ["broadcast", "head and tail"])
def test_index_matches_brute_force(spark, unknown, path):
    texts = random_texts(80)
    sents = corpus.sentences(documents(spark, texts))
    vocab = written(vocabulary.build_vocabulary(corpus.word_counts(sents), 150), "vocabulary")
    known = {r.word: r.id for r in vocab.filter("cnt is not null").collect()}
    assert 5 < len(known) < 13
    limit = 10**9 if path == "broadcast" else 3 * (48 + 8 + 8)
    got = vocabulary.index_sentences(sents, vocab, unknown, limit)
    assert ({(r.doc_id, r.sent_id): r.ids for r in got.collect()}
            == brute_index(texts, known, unknown))


def test_large_table_settles_hot_keys_without_shuffle(spark):
    table = written(spark.range(1000).select(F.col("id").cast("int").alias("id"),
                                             (F.col("id") * 2).alias("twice")), "table")
    facts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, None)
        .otherwise(F.col("id") % 1200).cast("int").alias("id"), F.col("id").alias("row"))
    joined = lookup(facts, table, "id", vocabulary.hot_ids, limit=64 * 12)
    got = {r["row"]: r["twice"] for r in joined.collect()}
    want = {}
    for i in range(3000):
        key = 1 if i % 3 == 0 else None if i % 3 == 1 else i % 1200
        want[i] = None if key is None or key >= 1000 else key * 2
    assert got == want
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan


def test_hot_part_is_measured(spark):
    wide = F.array_repeat(F.lit(0.5), 100)
    vector = F.when(F.col("id") < 50, wide).otherwise(F.slice(wide, 1, 1))
    table = written(spark.range(200).select(F.col("id").cast("int"), vector.alias("v")), "table")
    n = hot_rows(table, vocabulary.hot_ids, 20_000)
    assert 0 < n and table_size(table.filter(F.col("id") < n))[1] <= 20_000
    assert hot_rows(table, vocabulary.hot_ids, 50) == 0
    facts = spark.range(400).select((F.col("id") % 250).cast("int").alias("id"))
    for limit in (50, 20_000):
        got = lookup(facts, table, "id", vocabulary.hot_ids, limit)
        assert got.count() == 400 and got.filter("v is null").count() == 50


def test_decode(spark, example):
    sents, vocab = example
    ids = vocabulary.index_sentences(sents, vocab)
    extra = spark.createDataFrame([(9, 0, [0, 4]), (9, 1, [])], ids.schema)
    got = vocabulary.decode_sentences(ids.unionByName(extra), vocab)
    assert {(r.doc_id, r.sent_id): r.sentence for r in got.collect()} == {
        (0, 0): "cat sat", (0, 1): "dog ran home", (0, 2): "yes", (9, 0): "<UNK> cat", (9, 1): ""}


def test_unknown_rate(spark):
    rows = spark.createDataFrame([("x", 0), ("x", 4), ("y", 5)], "lang string, id int")
    got = {r.lang: r[1:] for r in vocabulary.unknown_rate(rows, ["lang"]).collect()}
    assert got == {"x": (2, 1, 0.5), "y": (1, 0, 0.0)}
