"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. Expectation
maximisation over the counts of vote patterns estimates how often each labeller is right and the
posterior of each pattern. The posteriors of a bounded sample train a linear scorer on hashed
features of the text, which then scores every document, also where all labellers abstain.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.common import Lookup, free, sample_texts, ship, text_of
from lexiframe.llm.linear import Linear, bucket

SYMBOLS = "#*$%&|<>{}=~^"
_shape = ((re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"\d+"), "0"))


def measures(text: str) -> dict[str, float]:
    """What the labellers look at; None-free, also for an empty text."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, chars = len(words), max(1, len(text))
    return {"words": n, "symbols": sum(map(text.count, SYMBOLS)) / chars,
            "upper": sum(w.isupper() and len(w) > 1 for w in words) / max(1, n),
            "distinct": len(set(words)) / max(1.0, n ** 0.75),
            "marks": sum(map(text.count, ".!?")) / max(1, n),
            "shouts": text.count("!") / max(1, n),
            "repeats": 1 - len(set(lines)) / max(1, len(lines)),
            "bare": sum(not any(map(str.isalnum, w)) for w in words) / max(1, n),
            "plain": sum(w.rstrip(".,;:!?)\"'").lstrip("(\"'").isalpha() for w in words) / max(1, n),
            "stutter": sum(map(str.__eq__, words, words[1:])) / max(1, n),
            "odd_ends": sum(w[-1] in SYMBOLS for w in words) / max(1, n),
            "length": sum(map(len, words)) / max(1, n),
            "short": sum(len(w) <= 3 for w in words) / max(1, n)}


def _vote(good: bool, bad: bool) -> int:
    return int(good) - int(bad)


# Heuristic labellers: 1 good, -1 bad, 0 abstains.
LABELLERS = {
    "length": lambda m: _vote(m["words"] >= 50, m["words"] < 5),
    "symbols": lambda m: _vote(m["symbols"] < 0.01, m["symbols"] > 0.03),
    "case": lambda m: _vote(m["upper"] < 0.1, m["upper"] > 0.4),
    "marks": lambda m: _vote(0.02 <= m["marks"] <= 0.3, m["marks"] > 0.6 or m["marks"] < 0.005),
    "shouts": lambda m: _vote(False, m["shouts"] > 0.2),
    "repeats": lambda m: _vote(False, m["repeats"] > 0.3),
    "variety": lambda m: _vote(m["distinct"] > 1.5, m["distinct"] < 0.8 and m["words"] >= 50),
    "bare": lambda m: _vote(m["bare"] < 0.02, m["bare"] > 0.1),
    "plain": lambda m: _vote(m["plain"] > 0.8, m["plain"] < 0.6),
    "odd_ends": lambda m: _vote(m["odd_ends"] < 0.02, m["odd_ends"] > 0.1),
    "stutter": lambda m: _vote(m["stutter"] < 0.01, m["stutter"] > 0.05),
    "echo": lambda m: _vote(m["stutter"] < 0.02 and m["distinct"] > 1, m["stutter"] > 0.1),
    "words": lambda m: _vote(3 <= m["length"] <= 9, m["length"] > 12 or m["length"] < 2.5),
    "function": lambda m: _vote(m["short"] > 0.2, m["short"] < 0.08),
}
NAMES = list(LABELLERS)


def votes(text: str) -> tuple[int, ...]:
    m = measures(text)
    return tuple(f(m) for f in LABELLERS.values())


class LabelModel:
    """How each labeller votes on good and bad documents, and the share of good ones."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 100):
        n_labellers = patterns.shape[1]
        good = 1 / (1 + np.exp(-patterns.sum(1) / 2.0))
        cast = np.stack([patterns == v for v in (-1, 0, 1)], 2)  # pattern, labeller, vote
        for _ in range(rounds):
            table = []
            for weight in (counts * (1 - good), counts * good):
                seen = (cast * weight[:, None, None]).sum(0) + 1.0
                table.append(seen / seen.sum(1, keepdims=True))
            self.table = np.stack(table)
            self.share = float(np.clip((counts * good).sum() / max(1, counts.sum()), 0.02, 0.98))
            new = self.posterior(patterns)
            if np.abs(new - good).max(initial=0) < 1e-6:
                break
            good = new
        right = self.table[1, :, 2] * self.share + self.table[0, :, 0] * (1 - self.share)
        wrong = self.table[0, :, 2] * (1 - self.share) + self.table[1, :, 0] * self.share
        self.accuracy = dict(zip(NAMES[:n_labellers], (right / (right + wrong)).tolist()))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        at = np.arange(patterns.shape[1])
        logs = np.log(self.table)
        bad, good = (logs[y][at, patterns + 1].sum(1) for y in (0, 1))
        odds = good - bad + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def vote_counts(docs: DataFrame) -> DataFrame:
    """How many documents got each pattern of votes, over the whole table."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            seen.update(votes(t) for t in batch["text"])
        if seen:
            yield pd.DataFrame({"votes": [list(v) for v in seen], "n": list(seen.values())})

    return (docs.select(text_of().alias("text")).mapInPandas(count, "votes array<int>, n long")
            .groupBy("votes").agg(F.sum("n").alias("n")))


def shape(word: str) -> str:
    for pattern, sign in _shape:
        word = pattern.sub(sign, word)
    return word[:12]


def shape_table() -> Lookup:
    return Lookup(shape)


def hashed(text: str, table: Lookup) -> np.ndarray:
    """Buckets of the shares of word shapes, in steps of a factor 4, and of rough sizes."""
    words = text.split()
    n = max(1, len(words))
    names = [f"s:{s}:{level}" for s, c in Counter([table[w] for w in words]).items()
             for level in (1, 4, 16, 64) if c * level >= n]
    names += [f"n:{k}" for k in range(len(words).bit_length())]
    names += [f"d:{int(8 * len(set(words)) / n)}"]
    stutter = sum(map(str.__eq__, words, words[1:]))
    names += [f"a:{level}" for level in (1, 4, 16, 64) if stutter * level >= n]
    lines = [x for x in text.split("\n") if x.strip()]
    names += [f"r:{int(8 * (1 - len(set(lines)) / max(1, len(lines))))}"]
    return np.unique(np.array([bucket(x) for x in names], "i8"))


def fit(docs: DataFrame, max_rows: int = 8_000) -> tuple[LabelModel, Linear]:
    """The label model from the votes on all documents, and the scorer from about `max_rows`
    distinct texts chosen by hash. At most 3^labellers patterns reach the driver."""
    got = vote_counts(docs).orderBy("votes").toPandas()
    patterns = np.array(got["votes"].tolist(), int).reshape(-1, len(NAMES))
    model = LabelModel(patterns, got["n"].to_numpy(float))

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shape_table()
        for batch in filter(len, batches):
            yield pd.DataFrame({"rows": [hashed(t, table).astype("<i4").tobytes() for t in batch["text"]],
                                "votes": [list(votes(t)) for t in batch["text"]]})

    rows = sample_texts(docs, max_rows).mapInPandas(described, "rows binary, votes array<int>").toPandas()
    rows = rows.sort_values("rows", kind="stable", ignore_index=True)
    y = model.posterior(np.array(rows["votes"].tolist(), int).reshape(-1, len(NAMES)))
    x = [np.frombuffer(b, "<i4").astype("i8") for b in rows["rows"]]
    return model, Linear.fit(x, y, np.zeros((len(x), 0)), least=20.0, least_share=0.002, ridge=3.0)


def score(docs: DataFrame, models: tuple[LabelModel, Linear] | None = None,
          threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` with `posterior` (of the votes), `quality` (the scorer's probability)
    and `kept` (quality at least `threshold`).

    Null and empty texts have no words, get the labellers' votes for zero length, and are scored
    like any other row; whole texts count; repeated rows agree; other columns pass through,
    clashing new names get an underscore; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(models or fit(docs))

    @F.pandas_udf("struct<posterior: double, quality: double, kept: boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        (label, linear), table = held.value, shape_table()
        for texts in batches:
            cast = np.array([votes(t) for t in texts], int).reshape(-1, len(NAMES))
            p = linear.predict([hashed(t, table) for t in texts], np.zeros((len(texts), 0)))
            yield pd.DataFrame({"posterior": label.posterior(cast), "quality": p, "kept": p >= threshold})

    both, *new = free(docs, "both_of_quality", "posterior", "quality", "kept")
    return (docs.withColumn(both, run(text_of()))
            .withColumns({n: F.col(f"{both}.{f}") for n, f in zip(new, ("posterior", "quality", "kept"))})
            .drop(both))
