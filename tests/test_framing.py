from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiframe.config import Settings
from lexiframe.functions import sequences as sq
from lexiframe.operators import framing

SENTENCES = [[4, 8], [5, 7, 6], [9]]


@pytest.fixture(scope="module")
def indexed(spark):
    rows = [(0, i, ids) for i, ids in enumerate(SENTENCES)]
    rows += [(1, 0, []), (1, 1, [4]), (1, 2, []), (2, 0, [5])]
    return spark.createDataFrame(rows, "doc_id long, sent_id int, ids array<int>")


def frames(indexed, mode, max_len=4):
    got = framing.framed_corpus(indexed, mode, max_len).orderBy("doc_id", "sent_id").collect()
    return {(r.doc_id, r.sent_id): (r["in"], r["out"], r["out_len"], r["target"]) for r in got}


def test_next_mode(indexed):
    got = frames(indexed, "next")
    assert got[0, 0] == ([4, 8, 2, 2, 2], [3, 5, 7, 6, 2], 4, [5, 7, 6, 1, 2])
    assert got[0, 1] == ([5, 7, 6, 2, 2], [3, 9, 2, 2, 2], 2, [9, 1, 2, 2, 2])
    assert (0, 2) not in got and (2, 0) not in got
    assert got[1, 0] == ([2] * 5, [3, 4, 2, 2, 2], 2, [4, 1, 2, 2, 2])
    assert got[1, 1] == ([4, 2, 2, 2, 2], [3, 2, 2, 2, 2], 1, [1, 2, 2, 2, 2])


def test_self_mode(indexed):
    got = frames(indexed, "self")
    assert got[0, 0] == ([4, 8, 2, 2, 2], [3, 4, 8, 2, 2], 3, [4, 8, 1, 2, 2])
    assert got[0, 1] == ([5, 7, 6, 2, 2], [3, 5, 7, 6, 2], 4, [5, 7, 6, 1, 2])
    assert got[0, 2] == ([9, 2, 2, 2, 2], [3, 9, 2, 2, 2], 2, [9, 1, 2, 2, 2])
    assert len(got) == 7


def test_short_frames_cut_sentences(indexed):
    assert frames(indexed, "next", 2)[0, 0] == ([4, 8, 2], [3, 5, 7], 3, [5, 7, 1])


def test_unknown_mode_is_an_error(indexed):
    with pytest.raises(ValueError):
        framing.pair_sentences(indexed, "previous", 4)
    with pytest.raises(ValueError):
        Settings(mode="previous")


def test_matrix_holds_the_last_sentence(indexed):
    got = framing.sentence_matrix(indexed, 4).filter("doc_id = 0").orderBy("sent_id").collect()
    assert [r["in"] for r in got] == [[4, 8, 2, 2, 2], [5, 7, 6, 2, 2], [9, 2, 2, 2, 2]]


def test_reversed_input_puts_padding_first(indexed):
    got = framing.reversed_input(framing.framed_corpus(indexed, "next", 4))
    assert got.filter("doc_id = 0 and sent_id = 0").first()["in"] == [2, 2, 2, 8, 4]


def test_invariants(indexed):
    width = 5
    rows = framing.framed_corpus(indexed, "self", 4)
    mask = sq.length_mask(F.col("out_len"), width)
    for r in rows.withColumn("mask", mask).collect():
        assert len(r["in"]) == len(r["out"]) == len(r["target"]) == len(r["mask"]) == width
        assert r["in"][-1] == 2 and r["out"][0] == 3
        n = r["out_len"]
        assert sum(r["mask"]) == n and r["mask"] == [1] * n + [0] * (width - n)
        assert r["target"][n - 1] == 1 and r["out"][1:n] == r["target"][:n - 1]


@pytest.mark.parametrize("drop_last, want", [(False, [3, 3, 1]), (True, [3, 3])])
def test_batch_sizes(spark, drop_last, want):
    rows = spark.range(7).withColumnRenamed("id", "row_id")
    got = framing.shuffled_batches(rows, ["row_id"], 3, drop_last=drop_last).collect()
    sizes = Counter(r.batch_id for r in got)
    assert [sizes[b] for b in sorted(sizes)] == want


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_batches_are_a_seeded_shuffle(spark, monkeypatch, digits):
    monkeypatch.setattr(framing, "hex_digits", lambda n: digits)
    rows = spark.range(1000).withColumnRenamed("id", "row_id")

    def order(epoch, seed=1):
        got = framing.shuffled_batches(rows, ["row_id"], 64, epoch, seed).collect()
        return [r.row_id for r in sorted(got, key=lambda r: (r.batch_id, r.row_in_batch))]

    first = order(0)
    assert sorted(first) == list(range(1000)) and first != sorted(first)
    assert first == order(0)
    assert first != order(1) and first != order(0, seed=2)


def test_bucket_digits_follow_the_row_count():
    assert [framing.hex_digits(n) for n in (0, 10, 10**6, 10**8, 10**12, 10**15)] == [1, 1, 1, 3, 5, 5]


def test_settings_fingerprint():
    a = Settings()
    assert a.fingerprint("x") == Settings().fingerprint("x")
    assert a.fingerprint("x") != a.fingerprint("y")
    assert a.fingerprint("x") != Settings(max_len=20).fingerprint("x")
