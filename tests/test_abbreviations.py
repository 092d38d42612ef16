"""Abbreviations of a corpus by brute force, and sentences that are not cut behind them."""

import random
import re
from collections import Counter
from math import exp, log

from util import documents

from lexiframe.operators import corpus

NAMES = "Smith Jones Miller Brown Clark Evans".split()


def texts(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        said = rng.choice(["Dr. {} came home", "we met Mr. {} there", "ask e.g. {} or no one", "it was late",
                           "the cat sat", "Brown ran", "(Dr. {}) is in"]).format(rng.choice(NAMES))
        more = " ".join(rng.choice("the a river of stone light went far home there sat ran".split()) for _ in range(rng.randint(2, 6)))
        out.append(f"{said}. {more}{rng.choice(['.', '!', '?', '...'])} Then {rng.choice(NAMES)} left.\n")
    return [*out, None, "", " . ", "Dr.", "etc"]


def brute(given):
    """word -> score by the published formula."""
    with_period, without = Counter(), Counter()
    for text in given:
        for token in re.split(r"[ \t\r\n]+", text or ""):
            token = token.lower().lstrip("".join(c for c in set(token.lower()) if not c.isalpha()))
            token = re.sub(r"[^a-z.]+\Z", "", token)
            word = token.rstrip(".")
            if word:
                (with_period if len(token) == len(word) + 1 else without)[word] += 1
    n = sum(with_period.values()) + sum(without.values())
    share = sum(with_period.values()) / n
    scores = {}
    for word, a in with_period.items():
        b = without[word]
        ratio = -2 * ((a * log(share) + b * log(1 - share)) - (a * log(0.99) + b * log(0.01)))
        letters = len(word.replace(".", ""))
        scores[word] = ratio * exp(-letters) * (1 + word.count(".")) * letters ** -b
    return {w: s for w, s in scores.items() if s >= 0.3}


def test_scores_by_brute_force(spark):
    got = {r["word"]: r["score"] for r in corpus.abbreviations(documents(spark, texts())).collect()}
    want = brute(texts())
    assert got.keys() == want.keys() and {"dr", "mr", "e.g"} <= got.keys() and "light" not in got
    assert all(abs(got[w] - s) < 1e-9 * max(1, s) for w, s in want.items())


def test_sentences_are_not_cut_behind_them(spark):
    given = texts() + ["Hi Dr. Smith.  Bye Mr.\n Brown! (Dr.) Jones... Dr. No one."]
    docs = documents(spark, given)
    known = corpus.abbreviations(docs)
    rows = corpus.raw_sentences(docs, abbreviations=known).collect()
    last = [r["sentence"] for r in sorted(rows, key=lambda r: r["sent_id"]) if r["doc_id"] == len(given) - 1]
    assert last == ["Hi Dr. Smith.", "Bye Mr.\n Brown!", "(Dr.) Jones...", "Dr. No one."]
    none = corpus.raw_sentences(docs, abbreviations=known.limit(0)).collect()
    plain = corpus.raw_sentences(docs).collect()
    assert sorted(map(tuple, none)) == sorted(map(tuple, plain)) and len(plain) > len(rows)


def test_no_periods_no_abbreviations(spark):
    for given in (["a b", "c"], ["a. b."], [None]):
        assert corpus.abbreviations(documents(spark, given)).count() == 0
