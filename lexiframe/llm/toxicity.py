"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of the
categories before it. In training these are out-of-fold predictions, as they will be later."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.common import free, ship, text_of
from lexiframe.llm.linear import Linear, log_tail, present, word_buckets

# Seed words of the categories, for tables that only say toxic or not.
SEEDS = {
    "insult": "idiot moron loser clown scum fool imbecile jerk bastard",
    "contempt": "trash pathetic worthless disgusting stupid dumb garbage useless filthy",
    "threat": "kill hurt stab shoot murder destroy",
}
TOXIC = "toxic"
LEAST_POSITIVE = 3  # toxic rows that a rare word must stand in


def weak_categories(sample: DataFrame) -> DataFrame:
    """Category labels from one overall label: a toxic text that holds a seed word of a category.
    The overall label comes last."""
    words = F.split(F.lower("text"), r"[^\p{L}]+")
    return sample.select(
        "doc_id", "text",
        *[(F.arrays_overlap(words, F.array(*map(F.lit, seeds.split()))) & (F.col(TOXIC) == 1))
          .cast("int").alias(name) for name, seeds in SEEDS.items()],
        F.col(TOXIC).cast("int").alias(TOXIC))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """At most `max_rows` labelled documents, lowest id hashes first. Only this many label rows
    are broadcast. A label of null, or of a document that is not there, is no label; of several
    labels for a document the highest counts."""
    known = (labels.filter(F.col(TOXIC).isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max(TOXIC).alias(TOXIC))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    texts = docs.select("doc_id", text_of().alias("text"))
    return texts.join(F.broadcast(known), "doc_id")


class Chain:
    """One linear model per category, in order, and a threshold for the last."""

    def __init__(self, categories: list[str], models: list[Linear], threshold: float):
        self.categories, self.models, self.threshold = categories, models, threshold
        self.used = {b for m in models for b in m.buckets.tolist()}

    @staticmethod
    def logits(p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p)) / 4

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: np.ndarray, categories: list[str],
            folds: np.ndarray) -> "Chain":
        n = len(rows)
        seen, models = np.zeros((n, 0)), []
        p = np.zeros(n)
        for k in range(len(categories)):
            y, p = labels[:, k].astype(float), np.zeros(n)
            for fold in np.unique(folds):
                out = folds == fold
                inside = [rows[i] for i in np.flatnonzero(~out)]
                model = Linear.fit(inside, y[~out], seen[~out], least_positive=LEAST_POSITIVE)
                p[out] = model.predict([rows[i] for i in np.flatnonzero(out)], seen[out])
            models.append(Linear.fit(rows, y, seen, least_positive=LEAST_POSITIVE))
            seen = np.column_stack([seen, cls.logits(p)])
        return cls(categories, models, cls.best_threshold(p, labels[:, -1]))

    @staticmethod
    def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
        """Highest F1 of the out-of-fold probabilities; in the middle of the gap below it. Nothing
        passes if chance could give as many positives above that cut (1 in 100, over all cuts)."""
        if not len(y) or not y.any():
            return 1.1
        order = np.argsort(-p, kind="stable")
        p, right = p[order], np.cumsum(y[order])
        f1 = 2 * right / (np.arange(1, len(p) + 1) + y.sum())
        last = np.append(p[1:] < p[:-1], True)
        best = int(np.argmax(np.where(last, f1, -1)))
        if y.all() or log_tail(right[best], best + 1, y.mean()) + np.log(last.sum()) >= np.log(0.01):
            return 1.1
        below = p[best + 1] if best + 1 < len(p) else 0.0
        return float((p[best] + below) / 2)

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), 0))
        seen = np.zeros((len(rows), 0))
        for model in self.models:
            p = model.predict(rows, seen)
            out = np.column_stack([out, p])
            seen = np.column_stack([seen, self.logits(p)])
        return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, n_folds: int = 3) -> Chain:
    """Fit on at most `max_rows` labelled documents. Without labelled rows, or where out-of-fold
    scores do not tell toxic rows from others, nothing is toxic."""
    ship(docs.sparkSession)
    sample = weak_categories(labelled_sample(docs, labels, max_rows))
    names = [*SEEDS, TOXIC]
    fields = ", ".join(f"{n} int" for n in names)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = word_buckets()
        for batch in filter(len, batches):
            batch["rows"] = [present(t, table).astype("<i4").tobytes() for t in batch["text"]]

            yield batch[["rows", *names]]

    got = sample.mapInPandas(hashed, f"rows binary, {fields}").toPandas()
    # copies would make every word of theirs look like evidence: one row each, labelled by most
    got = got.groupby("rows", as_index=False, sort=True)[names].mean().round()
    folds = np.arange(len(got)) * 7919 % n_folds
    rows = [np.frombuffer(b, "<i4").astype("i8") for b in got["rows"]]
    return Chain.fit(rows, got[names].to_numpy(dtype=float), names, folds)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of `docs` with a probability per category and `is_toxic` (boolean).

    The whole text counts; null and empty texts have no words and get the chain's base
    probabilities, never toxic. Rows are scored one by one, so repeated rows agree; other columns
    pass through, clashing new names get an underscore; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(chain)
    fields = ", ".join(f"{name}: double" for name in chain.categories)

    @F.pandas_udf(f"struct<{fields}, is_toxic: boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        chain, table = held.value, word_buckets()
        for texts in batches:
            # only words that some model weighs are kept
            rows = [np.array([b for b in {table[w] for w in set(t.split())} if b in chain.used], "i8")
                    for t in texts]
            p = chain.predict(rows)
            out = pd.DataFrame(p, columns=chain.categories)
            out["is_toxic"] = (p[:, -1] >= chain.threshold) & texts.str.strip().ne("").to_numpy()
            yield out

    names = [*chain.categories, "is_toxic"]
    both, *new = free(docs, "both_of_toxicity", *names)
    return (docs.withColumn(both, run(text_of()))
            .withColumns({n: F.col(f"{both}.{name}") for n, name in zip(new, names)}).drop(both))


def clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """`docs` without the documents that the chain calls toxic; the columns stay."""
    scored = score(docs, chain)
    flag = scored.columns[-1]
    return scored.filter(~F.col(flag)).select(*docs.columns)
