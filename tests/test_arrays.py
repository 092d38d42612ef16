import math

import pytest
from pyspark.sql import functions as F

from lexiframe.functions import chars as ch
from lexiframe.functions import sequences as sq
from lexiframe.sources.corpus import pair_table


def value(spark, data, kind, column):
    return spark.createDataFrame([(data,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def array(spark, data, column):
    return value(spark, data, "array<float>", column)


def test_argmax_takes_the_first(spark):
    assert array(spark, [1.0, 3.0, 3.0], sq.argmax) == 1


def test_softmax(spark):
    got = array(spark, [1.0, 2.0, 1000.0], sq.softmax)
    assert got == pytest.approx([0, 0, 1]) and sum(got) == pytest.approx(1)
    got = array(spark, [0.0, math.log(3.0)], sq.softmax)
    assert got == pytest.approx([0.25, 0.75])


def test_unit_length(spark):
    assert array(spark, [3.0, 4.0], sq.unit_length) == pytest.approx([0.6, 0.8])
    assert array(spark, [0.0, 0.0], sq.unit_length) == [0.0, 0.0]


def test_linear_scores(spark):
    got = array(spark, [1.0, 2.0], lambda x: sq.linear_scores(x, [[1, 0], [0.5, -1e-7]], [0, 10]))
    assert got == pytest.approx([1.0, 10.5 - 2e-7])


def test_grid_and_transpose(spark):
    grid = array(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], lambda x: sq.to_grid(x, 2, 3))
    assert grid == [[1, 2, 3], [4, 5, 6]]
    turned = array(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0],
                   lambda x: sq.transpose(sq.to_grid(x, 2, 3), 3))
    assert turned == [[1, 4], [2, 5], [3, 6]]


def test_one_hot_and_last(spark):
    assert value(spark, 2, "int", lambda x: sq.one_hot(x, 4)) == [0, 0, 1, 0]
    assert array(spark, [1.0, 7.0], sq.last_step) == 7.0
    assert array(spark, [], sq.last_step) is None


def test_char_frames_of_inline_pairs(spark):
    pairs = pair_table(spark, [("word", "tree"), ("to", "go")])
    source, target = F.col("source"), F.col("target")
    got = pairs.select(
        ch.char_ids(source), ch.char_ids(ch.char_output(target)),
        ch.char_ids(ch.char_target(target)), ch.char_filler(source)).collect()
    assert got[0][0] == [25, 17, 20, 6]
    assert got[0][1] == [0, 22, 20, 7, 7] and got[0][2] == [22, 20, 7, 7, 1]
    assert [r[3] for r in got] == ["PPPP", "PP"]


def test_alphabet_beyond_ascii(spark):
    alphabet = "SEPab단어😀"
    ids = value(spark, "단b😀?", "string", lambda x: ch.char_ids(x, alphabet))
    assert ids == [5, 4, 7, -1]
    back = value(spark, [5, 4, 7], "array<int>", lambda x: ch.decode_chars(x, alphabet))
    assert back == "단b😀"


@pytest.mark.parametrize("decoded, word, ended", [("abEcE", "ab", True), ("abc", "abc", False), ("E", "", True)])
def test_cut_at_the_end_symbol(spark, decoded, word, ended):
    assert value(spark, decoded, "string", ch.before_end) == word
    assert value(spark, decoded, "string", ch.has_end) is ended


def test_rewrite_as_chars(spark):
    assert value(spark, "ab c😀", "string", ch.rewrite_as_chars) == ["a", "b", "_", "c", "😀"]
