import pytest
from pyspark.sql import functions as F
from util import documents, random_texts, sentences, words

from lexiframe.functions import text as tx
from lexiframe.operators import corpus


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_words_keep_letters_only(spark):
    assert one(spark, "I don't know", tx.word_list) == ["i", "don", "t", "know"]
    assert one(spark, "Ünïcode café K9x", tx.word_list) == ["n", "code", "caf", "x"]
    assert one(spark, "123 ...", tx.word_list) == []


@pytest.mark.parametrize("text", ["I don't know", "", " .. ", "\u212aelvin \u0130x A9b", "a--b", "é"])
def test_one_pass_equals_two_steps(spark, text):
    steps = one(spark, text, lambda t: tx.split_words(tx.letters_only(t)))
    assert one(spark, text, tx.word_list) == steps


def test_stop_words_and_single_letters_go(spark):
    got = one(spark, "I don't know x a the River", lambda t: tx.word_list(t, True))
    assert got == ["know", "river"]
    own = one(spark, "the cat", lambda t: tx.word_list(t, True, ["cat"]))
    assert own == ["the"]


def test_sentences(spark):
    text = " The cat sat. A dog ran home! Yes \n"
    assert one(spark, text, tx.split_sentences) == ["The cat sat.", "A dog ran home!", "Yes"]
    assert one(spark, "  \t\n", tx.split_sentences) == []
    assert one(spark, "a.b c?!\r\nd", tx.split_sentences) == ["a.b c?!", "d"]
    assert one(spark, "a  b... \t c.d\n", tx.split_sentences) == ["a  b...", "c.d"]


def test_nested_view_keeps_empty_sentences(spark):
    assert one(spark, "One. 22. Three.", tx.sentence_words) == [["one"], [], ["three"]]


def test_missing_text_is_rejected(spark):
    docs = spark.createDataFrame([(1, "a b."), (2, None), (3, "")], "doc_id long, text string")
    assert [r.doc_id for r in corpus.rejected(docs).collect()] == [2]
    assert [r.doc_id for r in corpus.sentences(docs).collect()] == [1]


def test_sentences_match_brute_force(spark):
    texts = random_texts(60)
    got = corpus.sentences(documents(spark, texts)).orderBy("doc_id", "sent_id").collect()
    want = [(d, i, words(s)) for d, t in enumerate(texts) for i, s in enumerate(sentences(t))]
    assert [(r.doc_id, r.sent_id, r.words) for r in got] == want


def test_tokens_and_counts(spark):
    texts = random_texts(60)
    sents = corpus.sentences(documents(spark, texts))
    want = {}
    for t in texts:
        for s in sentences(t):
            for w in words(s):
                want[w] = want.get(w, 0) + 1
    assert {r.word: r.cnt for r in corpus.word_counts(sents).collect()} == want
    assert corpus.tokens(sents).count() == sum(want.values())
    size = corpus.corpus_size(sents).first()
    assert size.n_words == sum(want.values())
    assert size.n_empty == sum(not words(s) for t in texts for s in sentences(t))
