"""PII, quality model and toxicity against brute force and held-out labels."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiframe.llm import pii, quality_model, toxicity
from lexiframe.llm.common import HASH_PLACES, sample_places, sample_texts
from lexiframe.llm.linear import Linear
from lexiframe.sources.tables import table

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(reversed(digits)))
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(RULES).index(s[0])))


def test_base_rules_as_the_patterns_say():
    rng = random.Random(3)
    parts = ["a", "b.", "@", "x-y", "_", ".", "1", "23", "255", "256", "+", "-", " ", "(", ")", "é",
             "4111111111111111", "co", "\n", "1.2.3.4", "@c.d", "+1 (212) 555-0100"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == brute_spans(text), text


@pytest.mark.parametrize("text", ["a" * 10**6 + "@", "1" * 10**6, "1." * 10**6, "+1 " * 10**6, "a@b." * 10**5])
def test_scan_is_linear(text):
    pii.base_spans(text)
    pii.candidates(text)


def test_trees_learn_and_thresholds_hold():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(pii.features("ab 1", "card", 0, 2))))
    x[:, 0] = pii.KINDS.index("card")
    y = ((x[:, 3] > 0.5) & (x[:, 5] > 0.3)).astype(int)
    rows = pd.DataFrame({"features": list(x), "label": y, "fold": rng.integers(0, 4, len(x))})
    chooser = pii.Chooser.fit(rows)
    held = (rows["fold"] == 0).to_numpy()
    p = chooser.trees.predict(x[held])
    chosen = p >= chooser.thresholds["card"]
    assert y[held][chosen].mean() >= 0.9 and chosen.sum() > 0.8 * y[held].sum()


@pytest.mark.parametrize("max_docs", [20_000, 900])
def test_copies_are_one_example(spark, max_docs):
    """Ten secrets copied under other ids, whole or with other text after them, are ten examples."""
    rng = random.Random(4)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    pad = "nothing to see in this line at all " * 3
    held = [f'{pad}token = "{key()}"\n{pad}' for _ in range(10)]
    texts = held * 60 + [f"{t} {k}" for k in range(40) for t in held]
    texts += [f"{pad}commit {key()} by a\n{pad}" for _ in range(600)]
    few = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert "secret" not in pii.fit(few, max_docs).thresholds
    texts += [f'{pad}token = "{key()}"\n{pad}' for _ in range(600)]
    many = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert "secret" in pii.fit(many, max_docs).thresholds


def test_secrets_join_the_base_spans(spark, small):
    docs = table(spark, small.replace("0.001", "0.1"), "documents").select("doc_id", "text")
    rows = pii.find(docs).collect()
    added = 0
    for r in rows:
        base = [(s["kind"], s["start"], s["end"]) for s in r["base"]]
        spans = [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
        assert base == brute_spans(r["text"]) and set(base) <= set(spans)
        added += len(spans) - len(base)
        for m in re.finditer(r'token = "([0-9a-f]{40})"', r["text"]):
            assert ("secret", m.start(1), m.end(1)) in spans
    assert added


def test_redaction():
    assert pii.redacted("a b@c.de f", [("email", 2, 8)]) == "a [EMAIL] f"
    assert pii.redacted("0123456789", [("card", 1, 6), ("phone", 4, 8)]) == "0[CARD]89"


def test_label_model_finds_the_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.8
    right = [0.9, 0.8, 0.7, 0.95]
    cast = np.stack([np.where(rng.random(len(truth)) < 0.3, 0, np.where(
        rng.random(len(truth)) < a, 1, -1) * np.where(truth, 1, -1)) for a in right], 1)
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    model = quality_model.LabelModel(patterns, counts.astype(float))
    assert np.allclose(list(model.accuracy.values()), right, atol=0.02) and abs(model.share - 0.8) < 0.02


def test_quality_on_given_labels(spark, small):
    folder = small.replace("0.001", "0.01")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = quality_model.score(docs).join(
        table(spark, folder, "labels").withColumnRenamed("quality", "label"), "doc_id").toPandas()
    assert rows.loc[rows["label"] == 1, "kept"].mean() > 0.95
    assert rows.loc[rows["label"] == 0, "kept"].mean() < 0.1


def test_toxicity_on_given_labels(spark, small):
    folder = small.replace("0.001", "0.1")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    half = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    chain = toxicity.fit(docs, half)
    rows = toxicity.score(docs.select("doc_id", "text"), chain).join(
        labels.join(half, "doc_id", "left_anti").withColumnRenamed("toxic", "label"), "doc_id").toPandas()
    seeds = set(" ".join(toxicity.SEEDS.values()).split())
    sure = rows["text"].map(lambda t: bool(set(re.findall(r"\w+", t.lower())) & seeds)) & (rows["label"] == 1)
    assert rows.loc[sure, "is_toxic"].mean() > 0.95
    assert rows.loc[rows["label"] == 0, "is_toxic"].mean() < 0.01


def rare_labels(seed, share, n=8000, words=10, noise=0.0):
    """Rows of ordinary buckets; a share of them holds one of some toxic buckets and is toxic."""
    rng = np.random.default_rng(seed)
    toxic = np.zeros(n, bool)
    toxic[:round(share * n)] = True
    rows = [np.unique(np.append(1000 + (rng.pareto(0.7, 60) * 20).astype("i8") % 200_000,
                                k % words if t else 1000)) for k, t in enumerate(toxic)]
    order = rng.permutation(n)
    toxic, rows = toxic[order], [rows[k] for k in order]
    y = (toxic ^ (rng.random(n) < noise)).astype(float)
    return rows, y, toxic


@pytest.mark.parametrize("share, words, least", [
    (0.02, 10, 0.95), (0.01, 10, 0.9), (0.005, 5, 0.8), (0.005, 10, 0.0)])
def test_rare_toxic_words_are_learnt(share, words, least):
    for seed in range(3):
        rows, y, toxic = rare_labels(seed, share, words=words)
        chain = toxicity.Chain.fit(rows, y[:, None], ["toxic"], np.arange(len(rows)) % 3)
        fresh, _, truth = rare_labels(seed + 50, share, words=words)
        called = chain.predict(fresh)[:, -1] >= chain.threshold
        assert called[truth].mean() >= least and called[~truth].mean() < 0.005


def test_mislabelled_rows_are_not_learnt():
    rows, y, toxic = rare_labels(1, 0.02, noise=0.005)
    chain = toxicity.Chain.fit(rows, y[:, None], ["toxic"], np.arange(len(rows)) % 3)
    called = chain.predict(rows)[:, -1] >= chain.threshold
    assert called[toxic].mean() > 0.9 and called[~toxic].mean() < 0.005


@pytest.mark.parametrize("share", [0.005, 0.02, 0.11, 0.5])
def test_labels_without_evidence_call_nothing_toxic(share):
    """Random labels: clean documents stay."""
    for seed in range(3):
        rows, _, _ = rare_labels(seed, 0.0, n=3000)
        y = (np.random.default_rng(seed + 9).random(len(rows)) < share).astype(float)
        chain = toxicity.Chain.fit(rows, y[:, None], ["toxic"], np.arange(len(rows)) % 3)
        assert (chain.predict(rows)[:, -1] >= chain.threshold).mean() < 0.01


def test_rare_toxic_documents_go_and_clean_ones_stay(spark):
    rng = random.Random(12)
    plain = [f"word{k}" for k in range(300)]
    rude = "idiot moron trash pathetic kill hurt scum jerk".split()
    rows = [(k, " ".join(rng.choices(plain, k=40) + ([rude[k // 60 % 8]] if k % 60 == 0 else [])), int(k % 60 == 0))
            for k in range(6000)]
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs = data.select("doc_id", "text")
    for labels, least in ((data.select("doc_id", "toxic"), 0.95),
                          (data.select("doc_id", (F.col("doc_id") % 77 == 5).cast("int").alias("toxic")), 0.0)):
        stay = {r["doc_id"] for r in toxicity.clean(docs, toxicity.fit(docs, labels)).collect()}
        assert len([k for k, _, t in rows if not t and k in stay]) > 0.99 * sum(not t for *_, t in rows)
        assert len([k for k, _, t in rows if t and k not in stay]) >= least * sum(t for *_, t in rows)


def test_chain_feeds_earlier_categories():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 50, 8)) for _ in range(5000)]
    first = np.array([7 in r for r in rows])
    second = first & np.array([9 not in r for r in rows])
    labels = np.column_stack([first, second]).astype(float)
    chain = toxicity.Chain.fit(rows, labels, ["first", "second"], np.arange(len(rows)) % 3)
    p = chain.predict(rows)
    assert ((p[:, 1] >= chain.threshold) == second).mean() > 0.99 and len(chain.models[1].dense) == 1


def test_linear_with_one_label_is_constant():
    model = Linear.fit([np.array([1, 2])] * 5, np.zeros(5), np.zeros((5, 0)))
    assert model.predict([np.array([1])], np.zeros((1, 0)))[0] < 0.01


@pytest.mark.parametrize("n", [100, 512, 513, 700, 5000])
def test_candidates_of_any_length(n):
    for text, kind in (("a" * n + "7" + "b" * n, "secret"), ("x" * n + "@" + "y" * n + ".z", "email"),
                       ("x" * n + " [at] " + "y" * n, "email")):
        a = text.find(" ") + 1 if " " not in text else 0
        assert (kind, a, len(text)) in pii.candidates(text)
        assert (kind, 2, 2 + len(text)) in pii.candidates("( " + text + " )")


@pytest.mark.parametrize("text", ["a" * 300_000, "ab@" * 100_000, "a1=" * 100_000, "x [at] " * 50_000,
                                  "a" * 20 + "1" + "=" * 300_000 + "b", "x" * 300_000 + " [at"])
def test_generators_are_linear(text):
    pii.candidates(text)


def test_sample_never_vanishes():
    for total in (8_000, 10**6, 10**10, 10**11):
        expected = total * sample_places(total, 8_000) / HASH_PLACES
        assert 7_000 < expected <= 8_000
    assert sample_places(0, 8_000) == sample_places(7_999, 8_000) == HASH_PLACES


def test_copies_do_not_shrink_the_sample(spark):
    docs = spark.range(3000).selectExpr("CASE WHEN id < 2000 THEN 'same' ELSE concat('t', id) END AS text")
    assert sample_texts(docs, 1001).count() == 1001
    assert 350 < sample_texts(docs, 500).count() < 650


def test_examples_of_all_texts_are_fitted(spark, monkeypatch):
    """Evidence in texts beyond any fixed number counts: nothing is drawn from the table."""
    seen = []
    monkeypatch.setattr(pii.Chooser, "fit", classmethod(lambda cls, rows: seen.append(len(rows)) or cls(None, {})))
    docs = spark.range(0, 21_000, 1, 8).selectExpr("id AS doc_id", "if(id % 30 = 0, concat('mail a', id, '@b.co now'), concat('w', id)) AS text")
    pii.fit(docs)
    assert seen == [700]


def test_a_fit_on_the_executors_equals_the_one_of_a_table(spark, monkeypatch):
    rng = np.random.default_rng(5)
    width = len(pii.features("ab 1", "card", 0, 2))
    x = np.round(rng.random((3000, width)), 2)
    x[:, 0] = rng.integers(0, 2, len(x)) * 2
    y = ((x[:, 3] > 0.5) & (x[:, 5] > 0.3) & (rng.random(len(x)) < 0.97)).astype(int)
    rows = pd.DataFrame({"features": x.tolist(), "label": y, "fold": rng.integers(0, 4, len(x))})
    monkeypatch.setattr(pii, "FIT_ROWS", 400)
    monkeypatch.setattr(pii.BoostedTrees.__init__, "__defaults__", (6, 3, 0.3, 32, 1.0))
    monkeypatch.setattr(pii, "FIT_TREES", 4)
    want = pii.Chooser.fit(rows)
    examples = spark.createDataFrame(rows, "features array<double>, label int, fold long").repartition(3).persist()
    got = pii.SpreadFit(examples).fit(examples)
    assert np.allclose(got.trees.predict(x), want.trees.predict(x), atol=1e-6)
    assert got.thresholds.keys() == want.thresholds.keys() and want.thresholds
    assert all(abs(got.thresholds[k] - want.thresholds[k]) < 1e-6 for k in want.thresholds)
    alike = spark.createDataFrame(rows.assign(label=0), "features array<double>, label int, fold long")
    assert pii.SpreadFit(alike).fit(alike).thresholds == {}
