"""Personal data: strict base rules, wide candidate generators, and boosted trees that choose.

The base rules always hold. Wider generators propose overlapping candidate spans; boosted trees
score each by its format and its context; per kind, a threshold calibrated on held-out rows
decides which candidates join the base spans.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.llm.common import free, parts_for, sample_texts, ship, text_of
from lexiframe.plans.layout import written

# The base kinds in their order, and the rules of their contract.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a number is never entered half-way
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile("[0-9]")

# Generators: wider than the rules, of any length, and free to overlap. A run is never entered half-way.
GENERATORS = (
    ("email", re.compile(r"(?<![^\s<(\[\"'])[^\s@<>()\[\]\"']++(?:@| ?[\[(]at[\])] ?)[^\s@<>()\[\]\"']++"),
     lambda t: "@" in t or "[at]" in t or "(at)" in t),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){2,7}+(?![0-9])"
                      r"|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
     lambda t: "." in t or ":" in t),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{3,6}(?:[\x20./-]{0,2}[0-9]{2,6}){2,5}+(?![0-9A-Za-z])"), lambda t: True),
    ("phone", re.compile(r"(?<![0-9A-Za-z])(?:\+|00)?\(?[0-9]{1,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,5}\)?){1,5}+(?![0-9A-Za-z])"),
     lambda t: True),
    ("secret", re.compile(r"(?<![0-9A-Za-z+/_-])(?=[A-Za-z+/_-]*+[0-9])[0-9A-Za-z+/_-]{16,}+=*(?![0-9A-Za-z])"),
     lambda t: True),
)
CUES = re.compile(r"(?i)\b(?:mail|tel|phone|call|fax|mobile|card|visa|iban|account|ip|host|addr|server|"
                  r"token|key|secret|passw|pwd|auth|api|bearer|credential)[a-z]*\W*(?:\w+\W*)?$")
_assigned = re.compile(r"(?i)\b(?:token|key|secret|passw|pwd|auth|api|bearer|credential)\w*[\"']?\s*(?:=|:|\s)\s*[\"']?$")
CONTEXT = 40
ONE_FIT = 20_000  # examples that are fitted as one table; more stay on the executors
FIT_ROWS = 32_768  # examples of a block
FIT_TREES = 10  # trees applied to an example before its scores are written
WHOLE = 1 << 30  # of a slope in the sums
Z = 1.645  # of a lower 95 % bound
FIT_BLOCK = "kinds binary, labels binary, folds binary, bins binary, scores binary"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches in linear time: from each @ the run of local characters goes back no
    further than the last @ or match."""
    at, low = text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        found = _domain.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        low = found.end() if found else at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base rules by start, then kind; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _digit.search(text):
        for m in _ip.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _card.finditer(text):
            if m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in _phone.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[str, int, int]]:
    """All spans the generators propose; spans of different kinds may overlap."""
    if not ("@" in text or "(at)" in text or "[at]" in text or _digit.search(text)):
        return []
    return [(kind, *m.span()) for kind, pattern, may in GENERATORS if may(text)
            for m in pattern.finditer(text)]


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Numbers that describe a candidate's format, then its surroundings."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT):start], text[end:end + 8]
    digits = [c for c in span if "0" <= c <= "9"]
    letters = sum(c.isalpha() for c in span)
    groups = re.findall("[0-9]+", span)
    n = len(span)
    return [KINDS.index(kind), n, len(digits), letters, n - len(digits) - letters, len(groups),
            max(map(len, groups), default=0), min(map(len, groups), default=0),
            float(12 <= len(digits) <= 19 and luhn("".join(digits))), span.count("."), span.count("-"),
            span.count(" "), span.count("("), float(span[0] == "+"), float("@" in span),
            float("." in span.rpartition("@")[2]), max([int(g) if len(g) < 6 else 99999 for g in groups], default=0),
            len(set(span)) / n, float(all(c in "0123456789abcdefABCDEF" for c in span)),
            sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:])) / n,
            sum(c.isupper() for c in span) / n,
            float(bool(CUES.search(before))), float(bool(_assigned.search(before))),
            float(before[-1:] in ("=", ":", '"', "'")), float(before[-1:].isalnum()),
            float(before.endswith("\n") or not before), float(after[:1] in ("", " ", "\n")),
            float(after[:1] in ('"', "'", ")")), float(after[:1].isalnum())]


def example(text: str, kind: str, start: int, end: int) -> int:
    """Hash of a candidate and of the surroundings that its features see."""
    parts = kind, text[max(0, start - CONTEXT):start], text[start:end], text[end:end + 8]
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def weak_label(text: str, base: list, kind: str, start: int, end: int) -> int:
    """1 for a candidate that is mostly a base span, or a value assigned to a secret's name."""
    for _, a, b in base:
        if min(b, end) - max(a, start) >= 0.8 * max(b - a, end - start):
            return 1
    return int(kind == "secret" and bool(_assigned.search(text[max(0, start - CONTEXT):start])))


class BoostedTrees:
    """Gradient boosting of the logistic loss on binned features, by depth-wise trees."""

    def __init__(self, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T)], 1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start, self.trees = float(np.log(share / (1 - share))), []
        score = np.full(len(y), self.start)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            tree, value = self._grow(binned, cuts, p - y, p * (1 - p))
            self.trees.append(tree)
            score += value
        return self

    def _grow(self, binned, cuts, g, h):
        """One tree as arrays by heap position: feature (-1: leaf), cut, leaf value."""
        size = 2 ** (self.depth + 1)
        feature, cut, leaf = np.full(size, -1), np.zeros(size), np.zeros(size)
        node, value = np.ones(len(g), int), np.zeros(len(g))
        for at in range(1, size):
            rows = np.flatnonzero(node == at)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            leaf[at] = -self.rate * gs / (hs + self.ridge)
            value[rows] = leaf[at]
            if at >= size // 2 or len(rows) < 8:
                continue
            best = (1e-6, -1, 0)
            for f, own in enumerate(cuts):
                gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(own) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(own) + 1))[:-1]
                gain = gl ** 2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs ** 2 / (hs + self.ridge)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
            if best[1] >= 0:
                feature[at], cut[at] = best[1], cuts[best[1]][best[2]]
                node[rows] = 2 * at + (binned[rows, best[1]] > best[2])
        return (feature, cut, leaf), value

    def predict(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.ones(len(x), int)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + (x[rows, np.maximum(f, 0)] > cut[node]))
            score += leaf[node]
        return 1 / (1 + np.exp(-score))


class Chooser:
    """Fitted trees and a threshold per kind."""

    def __init__(self, trees: BoostedTrees | None, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    @classmethod
    def fit(cls, rows: pd.DataFrame, precision: float = 0.9) -> "Chooser":
        """Trees on all rows; from out-of-fold scores, the lowest score per kind above which the
        lower 95 % bound of the precision holds. A kind without such a score adds nothing."""
        if rows["label"].nunique() < 2:
            return cls(None, {})
        x, y = np.array(rows["features"].tolist(), float), rows["label"].to_numpy()
        fold, score = rows["fold"].to_numpy(), np.zeros(len(y))
        for f in np.unique(fold):
            out = fold == f
            if len(set(y[~out])) < 2:
                return cls(None, {})
            score[out] = BoostedTrees().fit(x[~out], y[~out]).predict(x[out])
        trees, thresholds = BoostedTrees().fit(x, y), {}
        for k, kind in enumerate(KINDS):
            own = x[:, 0] == k
            if not own.any():
                continue
            p = score[own]
            order = np.argsort(-p, kind="stable")
            p, right = p[order], np.cumsum(y[own][order])
            n, z = np.arange(1, len(p) + 1), Z
            share = right / n
            low = (share + z * z / (2 * n) - z * np.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            last = np.append(p[1:] < p[:-1], True)  # equal scores go together
            good = np.flatnonzero((low >= precision) & last)
            if len(good):
                thresholds[kind] = float(p[good[-1]])
        return cls(trees, thresholds)

    def spans(self, text: str) -> tuple[list, list]:
        """Base spans, and all spans: chosen candidates by falling score where none is yet."""
        base = base_spans(text)
        if not self.thresholds:
            return base, base
        found = [c for c in candidates(text) if c[0] in self.thresholds]
        if not found:
            return base, base
        p = self.trees.predict(np.array([features(text, *c) for c in found], float))
        taken = [(a, b) for _, a, b in base]
        added = []
        for k in np.argsort(-p, kind="stable").tolist():
            kind, a, b = found[k]
            if p[k] >= self.thresholds[kind] and all(b <= c or a >= d for c, d in taken):
                taken.append((a, b))
                added.append((kind, a, b))
        return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def down(bins: np.ndarray, feature: np.ndarray, place: np.ndarray, levels: int) -> np.ndarray:
    """The node of each example (a column of `bins`) after some levels of a tree by heap position."""
    node, rows = np.ones(bins.shape[1], int), np.arange(bins.shape[1])
    for _ in range(levels):
        f = feature[node]
        node = np.where(f < 0, node, 2 * node + (bins[np.maximum(f, 0), rows] > place[node]))
    return node


class SpreadFit:
    """The fit of `Chooser` for examples that stay on the executors.

    One model a fold, fitted on the other folds, and one on all grow side by side. A level is a pass
    over blocks of examples; slopes are summed as whole numbers per model, node, feature and bin, and
    a task per model and node chooses its split. The driver sees cuts, splits and thresholds.
    """

    def __init__(self, examples: DataFrame):
        self.counts = examples.groupBy("fold", "label").count().collect()
        self.folds = sorted({r["fold"] for r in self.counts})
        self.left_out = [*self.folds, None]
        self.models = [BoostedTrees() for _ in self.left_out]
        self.cuts = self._cuts(examples)
        self.width = len(self.cuts[0])
        self.pending: list[list[tuple]] = []
        for model, fold in zip(self.models, self.left_out):
            n = np.array([sum(r["count"] for r in self.counts if r["fold"] != fold and r["label"] == y) for y in (0, 1)])
            share = np.clip(n[1] / max(1, n.sum()), 1e-3, 1 - 1e-3)
            model.start, model.trees = float(np.log(share / (1 - share))), []

    def two_labels(self) -> bool:
        """Whether every model has examples of both labels."""
        return all(len({r["label"] for r in self.counts if r["fold"] != fold}) == 2 for fold in self.left_out)

    def _cuts(self, examples: DataFrame) -> list[list[np.ndarray]]:
        inner = np.linspace(0, 1, self.models[0].bins + 1)[1:-1].tolist()
        own = [F.count(F.lit(1)) if fold is None else F.count_if(F.col("fold") != fold) for fold in self.left_out]
        values = examples.select("fold", F.posexplode("features").alias("feature", "value")).groupBy("feature", "value").agg(
            *[n.alias(f"n_{m}") for m, n in enumerate(own)])
        rows = values.groupBy("feature").agg(
            *[F.percentile("value", inner, F.col(f"n_{m}")).alias(f"cuts_{m}") for m in range(len(own))]).orderBy("feature").collect()
        return [[np.unique(r[f"cuts_{m}"] or []) for r in rows] for m in range(len(own))]

    def _blocks(self, examples: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for k in range(0, len(batch), FIT_ROWS):
                    part = batch.iloc[k:k + FIT_ROWS]
                    x = np.array(part["features"].tolist(), float)
                    bins = np.array([[np.searchsorted(c, column, "left") for c, column in zip(own, x.T)] for own in self.cuts], "u1")
                    scores = np.repeat([[m.start] for m in self.models], len(part), axis=1)
                    yield pd.DataFrame([[x[:, 0].astype("u1").tobytes(), part["label"].to_numpy("u1").tobytes(),
                                         part["fold"].to_numpy("u1").tobytes(), bins.tobytes(), scores.tobytes()]],
                                       columns=["kinds", "labels", "folds", "bins", "scores"])

        return written(examples.select("features", "label", "fold").mapInPandas(run, FIT_BLOCK), "pii_blocks")

    def _read(self, batches: Iterator[pd.DataFrame]):
        """Kinds, labels, folds, bins (models x features x examples) and scores with the pending trees."""
        for batch in batches:
            for row in batch.itertuples(index=False):
                kinds, labels, folds = (np.frombuffer(b, "u1") for b in row[:3])
                bins = np.frombuffer(row.bins, "u1").reshape(len(self.models), self.width, -1)
                scores = np.frombuffer(row.scores).reshape(len(self.models), -1).copy()
                for trees in self.pending:
                    for m, (feature, place, leaf) in enumerate(trees):
                        scores[m] += leaf[down(bins[m], feature, place, self.models[m].depth)]
                yield kinds, labels, folds, bins, scores

    def _splits(self, blocks: DataFrame, trees: list[tuple], level: int) -> DataFrame:
        most, base = self.models[0].bins, 1 << level

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(self.models), base, self.width, most, 3), "i8")
            for _, labels, folds, bins, scores in self._read(batches):
                for m, fold in enumerate(self.left_out):
                    node = down(bins[m], *trees[m][:2], level)
                    own = np.flatnonzero((node >= base) & ((fold is None) | (folds != fold)))
                    p = 1 / (1 + np.exp(-scores[m, own]))
                    cell = ((node[own] - base) * self.width + np.arange(self.width)[:, None]) * most + bins[m][:, own]
                    for j, part in enumerate((p - labels[own], p * (1 - p), np.full(len(own), 1 / WHOLE))):
                        whole = np.tile(np.rint(part * WHOLE), self.width)
                        total[m, ..., j] += np.bincount(cell.ravel(), whole, base * self.width * most).astype("i8").reshape(
                            base, self.width, most)
            for m, at in np.argwhere(total[:, :, 0, :, 2].any(axis=2)).tolist():
                yield pd.DataFrame({"model": [m], "node": [base + at], "sums": [total[m, at].tobytes()]})

        def choose(group: pd.DataFrame) -> pd.DataFrame:
            m = int(group["model"].iloc[0])
            sums = sum(np.frombuffer(b, "i8") for b in group["sums"]).reshape(self.width, most, 3)
            whole, ridge = sums[0].sum(axis=0), self.models[m].ridge
            gs, hs = whole[:2] / WHOLE
            best, below = (1e-6, -1, 0), whole
            for f, own in enumerate(self.cuts[m] if whole[2] >= 8 else []):
                left = sums[f].cumsum(axis=0)[:len(own)]
                gl, hl = left[:, 0] / WHOLE, left[:, 1] / WHOLE
                gain = gl ** 2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs ** 2 / (hs + ridge)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
                    below = left[best[2]]
            return pd.DataFrame({"model": [m], "node": group["node"].iloc[:1], "feature": [best[1]], "place": [best[2]],
                                 "below": [below], "whole": [whole]})

        return blocks.mapInPandas(run, "model int, node int, sums binary").groupBy("model", "node").applyInPandas(
            choose, "model int, node int, feature int, place int, below array<long>, whole array<long>")

    def _grow(self, blocks: DataFrame) -> list[tuple]:
        """One tree a model: feature (-1: leaf), place of the cut and leaf value by heap position."""
        depth = self.models[0].depth
        trees = [(np.full(2 << depth, -1), np.zeros(2 << depth, int), np.zeros(2 << depth)) for _ in self.models]
        for level in range(depth):
            for row in self._splits(blocks, trees, level).collect():
                model, at = self.models[row["model"]], row["node"]
                feature, place, leaf = trees[row["model"]]
                whole, below = np.array(row["whole"]) / WHOLE, np.array(row["below"]) / WHOLE
                feature[at], place[at] = row["feature"], row["place"]
                for node, (g, h, _) in ((at, whole), (2 * at, below), (2 * at + 1, whole - below)):
                    if node == at or row["feature"] >= 0:
                        leaf[node] = -model.rate * g / (h + model.ridge)
        return trees

    def _scored(self, blocks: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for *rest, scores in self._read(batches):
                yield pd.DataFrame([[b.tobytes() for b in (*rest, scores)]], columns=["kinds", "labels", "folds", "bins", "scores"])

        return written(blocks.mapInPandas(run, FIT_BLOCK), "pii_blocks")

    def _thresholds(self, blocks: DataFrame, precision: float) -> dict[str, float]:
        """As in `Chooser.fit`: running sums over scores, by buckets first, then inside each bucket."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for kinds, labels, folds, _, scores in self._read(batches):
                score = scores[np.searchsorted(self.folds, folds), np.arange(len(folds))]
                yield pd.DataFrame({"kind": kinds, "p": 1 / (1 + np.exp(-score)), "label": labels})

        scored = written(blocks.mapInPandas(run, "kind int, p double, label int").groupBy(
            "kind", "p", F.floor(F.col("p") * 1024).alias("bucket")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("label").alias("right")), "pii_scores")
        above = Window.partitionBy("kind").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
        within = Window.partitionBy("kind", "bucket").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
        earlier = scored.groupBy("kind", "bucket").agg(F.sum("n").alias("n"), F.sum("right").alias("right")).select(
            "kind", "bucket", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("n", "right")])
        running = scored.join(F.broadcast(earlier), ["kind", "bucket"]).select(
            "kind", "p", *[(F.col(f"{c}_above") + F.sum(c).over(within)).cast("double").alias(c) for c in ("n", "right")])
        n, share, square = F.col("n"), F.col("right") / F.col("n"), Z * Z
        low = (share + square / (2 * n) - Z * F.sqrt(share * (1 - share) / n + square / (4 * n * n))) / (1 + square / n)
        good = running.filter(low >= precision).groupBy("kind").agg(F.min("p").alias("p"))
        return {KINDS[r["kind"]]: r["p"] for r in good.collect()}

    def fit(self, examples: DataFrame, precision: float = 0.9) -> Chooser:
        if not self.two_labels():
            return Chooser(None, {})
        blocks = self._blocks(examples)
        for _ in range(self.models[0].n_trees):
            trees = self._grow(blocks)
            for model, cuts, (feature, place, leaf) in zip(self.models, self.cuts, trees):
                raw = [cuts[f][at] if f >= 0 else 0.0 for f, at in zip(feature, place)]
                model.trees.append((feature, np.array(raw), leaf))
            self.pending = [*self.pending, trees]
            if len(self.pending) == FIT_TREES:
                blocks, self.pending = self._scored(blocks), []
        return Chooser(self.models[-1], self._thresholds(blocks, precision))


def fit(docs: DataFrame, max_docs: int | None = None, max_rows: int | None = None) -> Chooser:
    """Fit on the candidates of all texts. Candidates alike in themselves and their surroundings are
    one example, so copies are no further evidence. Up to `ONE_FIT` examples are one small table;
    more stay on the executors. Whoever wants less can ask for about `max_docs` distinct texts by hash
    and `max_rows` examples of lowest hash. A table without candidates of both labels gives a
    chooser that adds nothing."""
    ship(docs.sparkSession)
    rows = docs.select(text_of().alias("text")) if max_docs is None else sample_texts(docs, max_docs)

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                found = candidates(text)
                base = base_spans(text) if found else []
                out += [(example(text, *c), features(text, *c), weak_label(text, base, *c)) for c in found]
            if out:
                yield pd.DataFrame(out, columns=["example", "features", "label"]).drop_duplicates(["example", "label"])

    examples = (rows.mapInPandas(described, "example long, features array<double>, label int")
                .distinct()
                .withColumn("fold", F.pmod(F.xxhash64(F.lit(7), "features"), F.lit(4))))
    if max_rows is not None:
        examples = examples.orderBy("example", "features", "label").limit(max_rows)
    examples = written(examples, "pii_examples")
    total = examples.count()
    if total <= ONE_FIT:
        return Chooser.fit(examples.orderBy("example", "features", "label").toPandas())
    few = examples.coalesce(parts_for(total, 4 * FIT_ROWS))
    return SpreadFit(examples).fit(few)


SPAN = "array<struct<kind: string, start: long, end: long>>"


def find(docs: DataFrame, chooser: Chooser | None = None) -> DataFrame:
    """The rows of `docs` with `base` and `spans`: arrays of (kind, start, end).

    Null and empty texts have no spans; a text of any length is scanned whole, in linear time;
    repeated rows are scanned one by one; other columns pass through, and new names that clash
    get an underscore. An empty table gives no rows. The chooser is fitted on `docs` unless given.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(chooser or fit(docs))

    @F.pandas_udf(f"struct<base: {SPAN}, spans: {SPAN}>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        found = [held.value.spans(t) for t in texts]
        named = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        return pd.DataFrame({"base": [named(b) for b, _ in found], "spans": [named(s) for _, s in found]})

    base, spans, both = free(docs, "base", "spans", "both_of_pii")
    return (docs.withColumn(both, scan(text_of()))
            .withColumns({base: F.col(f"{both}.base"), spans: F.col(f"{both}.spans")}).drop(both))


def redact(docs: DataFrame, chooser: Chooser | None = None) -> DataFrame:
    """`docs` with every span of personal data replaced by its kind in brackets; spans that
    overlap become one, named after the first. `n_chars`, if there, is counted anew. Rows and
    columns stay as they are otherwise; a null text stays null."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(chooser or fit(docs))

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted(t, held.value.spans(t)[1]) for t in texts], dtype=object)

    out = docs.withColumn("text", hide(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(
            docs.schema["n_chars"].dataType))
    return out


def redacted(text: str, spans: list) -> str:
    out, end = [], 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]
