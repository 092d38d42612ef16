"""Linear models on hashed features, fitted on the driver from a bounded sample of rows."""

import re

import numpy as np
import xxhash

from lexiframe.llm.common import Lookup

BITS = 18
_edges = re.compile(r"^\W+|\W+$")


def bucket(name: str) -> int:
    return xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass")) >> (32 - BITS)


def word_buckets(most: int = 200_000) -> Lookup:
    """word as written -> bucket of its lower-case form without marks at its ends."""
    return Lookup(lambda w: bucket("w:" + (_edges.sub("", w.lower()) or w)), most)


def present(text: str, table: Lookup) -> np.ndarray:
    """Sorted distinct buckets of a whole text's words."""
    return np.unique(np.fromiter([table[w] for w in set(text.split())], "i8"))


def log_tail(right: np.ndarray, many: np.ndarray, share: float) -> np.ndarray:
    """Upper bound (Chernoff) of the log of the chance of at least `right` positives among `many`
    rows when each is positive with probability `share`; 0 where that is no more than expected."""
    many = np.maximum(many, 1)
    q = np.clip(right / many, 0.0, 1.0)
    up = q * np.log(np.maximum(q, 1e-300) / share)
    down = (1 - q) * np.log(np.maximum(1 - q, 1e-300) / (1 - share))
    return np.where(q > share, -many * (up + down), 0.0)


class Linear:
    """Logistic regression over chosen buckets and some dense inputs.

    Buckets found in a least share of the rows are chosen by the chi-square of presence against
    the label, so that words of a few mislabelled rows are not learnt. With `least_positive`,
    buckets of any share count too if they stand in so many positive rows and chance would hardly
    (1 in 100, for all such buckets together) put them there. The weights come from Newton steps
    with a ridge. Labels may be shares between 0 and 1. Labels all alike give the
    constant model.
    """

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, dense: np.ndarray, bias: float):
        self.buckets, self.weights, self.dense, self.bias = buckets, weights, dense, bias
        self.weight_of = dict(zip(buckets.tolist(), weights.tolist()))

    @classmethod
    def fit(cls, rows: list[np.ndarray], y: np.ndarray, dense: np.ndarray,
            least: float = 60.0, most: int = 256, ridge: float = 1.0,
            least_share: float = 0.01, least_positive: float | None = None) -> "Linear":
        n, width = len(rows), dense.shape[1]
        share = float(np.clip(y.mean() if n else 0.0, 1e-4, 1 - 1e-4))
        empty = np.zeros(0, "i8")
        prior = float(np.log(share / (1 - share)))
        if not n or y.max() - y.min() < 1e-9:
            return cls(empty, np.zeros(0), np.zeros(width), prior)
        every = np.concatenate(rows)
        owner = np.repeat(np.arange(n), [len(r) for r in rows])
        names, column = np.unique(every, return_inverse=True)
        if not len(names):
            names, column = np.zeros(1, "i8"), np.zeros(0, "i8")
        a = np.bincount(column, y[owner], len(names))  # present and positive
        c = np.bincount(column, minlength=len(names))
        e = c * y.mean()
        spread = np.maximum(e * (1 - y.mean()) * (1 - c / n), 1e-9)
        chi = np.where((c >= max(5, least_share * n)) & (c < n), (a - e) ** 2 / spread, 0.0)
        if least_positive is not None:
            tested = c >= least_positive
            sure = tested & (a >= least_positive) & (
                log_tail(a, c, y.mean()) + np.log(max(1, tested.sum())) < np.log(0.01))
            chi = np.where(sure, np.maximum((a - e) ** 2 / spread, least), chi)
        chosen = np.argsort(-chi, kind="stable")[:most]
        chosen = np.sort(chosen[chi[chosen] >= least])
        place = np.full(len(names), -1)
        place[chosen] = np.arange(len(chosen))
        x = np.zeros((n, len(chosen) + width + 1))
        inside = place[column] >= 0
        x[owner[inside], place[column[inside]]] = 1
        x[:, len(chosen):-1] = dense
        x[:, -1] = 1
        w = np.zeros(x.shape[1])
        w[-1] = prior
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (p - y) + penalty * w
            hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
            step = np.linalg.solve(hessian, gradient)
            w -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
        return cls(names[chosen], w[:len(chosen)], w[len(chosen):-1], float(w[-1]))

    def predict(self, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        known = self.weight_of
        score = np.array([sum([known.get(b, 0.0) for b in r.tolist()]) for r in rows]) if known \
            else np.zeros(len(rows))
        return 1 / (1 + np.exp(-np.clip(score + dense @ self.dense + self.bias, -30, 30)))
