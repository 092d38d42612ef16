"""Best-fit packing by patterns of lengths, fitted with non-negative least squares.

What matters for packing is how many pieces there are of each length, and a window has only so many
lengths. So the histogram of lengths, a row per length, decides: patterns of a few lengths that fill
a window exactly are enumerated, repeat counts are fitted to the histogram by least squares over
non-negative counts and rounded down, and the residual lengths are packed best fit, largest first,
again as patterns with counts. A pattern then owns a run of places of each of its lengths, and a
piece finds its sequence by its place among the pieces of its length. Ids never move for that:
places come from counts per task and length.
"""

import json
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lexiframe.llm.bpe import byte_alphabet
from lexiframe.llm.common import chunks, ship, text_of
from lexiframe.llm.packing import Numbers, spans
from lexiframe.plans.layout import written
from lexiframe.plans.lookup import BROADCAST_BYTES, table_size

# The split of a normalised text that the vocabulary files of word ends use, the
# suffix of such word ends, and the characters below U+0250 that need the library.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
EASY = r"[\x20-\x7e\xa1-\xac\xae-įı-ɏ]*"
_pieces, _easy = regex.compile(PIECES), regex.compile(EASY)
MARK = "\x00"


class WordEnds:
    """Token ids of texts by a vocabulary with word ends, equal to the tokenizers library's.

    White space parts words for good, so each word between spaces is encoded once and remembered.
    New words of a batch are encoded together: every piece of a word gets a mark behind it, and in
    the ranks given to the fast encoder a byte first merges with a mark behind it, which makes it
    the vocabulary's word end. Words with other than common Latin characters go to the library.
    """

    def __init__(self, spec: str, most: int = 300_000):
        self.full, self.most = Tokenizer.from_str(spec), most
        self.full.no_padding()
        self.full.no_truncation()
        data = json.loads(spec)
        vocab, bytes_of = data["model"]["vocab"], byte_alphabet()
        self.special = [t["content"] for t in data.get("added_tokens") or []]

        def raw(token: str) -> bytes:
            ends = token.endswith(WORD_END)
            return bytes(bytes_of[c] for c in token.removesuffix(WORD_END)) + MARK.encode() * ends

        single = [bytes([b]) for b in range(256)]
        ordered = [*single, *[b + MARK.encode() for b in single if b != MARK.encode()]]
        for pair in data["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ordered.append(raw(left + right))
        ranks = {b: k for k, b in enumerate(ordered)}
        own = {raw(t): i for t, i in vocab.items() if t not in self.special}
        self.fast = None
        if len(ranks) == len(ordered) and all(b in own for b in ordered[256:]):
            self.fast = tiktoken.Encoding("own", pat_str=f"[^{MARK} ]+{MARK}| ", mergeable_ranks=ranks, special_tokens={})
            self.ids = np.array([own.get(b, 0) for b in ordered], "u4")
            self.space = ranks[b" "]
        self.forget()

    def forget(self) -> None:
        self.new: list[str] = []
        self.numbers = Numbers(self.new)
        self.flat, self.ends = np.zeros(0, "u4"), np.zeros(1, "i8")

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of easy words one after the other, and how many each has."""
        marked = _pieces.sub(rf"\g<0>{MARK}", " ".join(words).lower())
        ids = np.array(self.fast.encode_ordinary(marked), "i8")
        spaces = ids == self.space
        bounds = np.concatenate([[-1], np.flatnonzero(spaces), [len(ids)]])
        return self.ids[ids[~spaces]], np.diff(bounds) - 1

    def learn(self) -> None:
        """Encode the words seen since the last call."""
        if not self.new:
            return
        joined = " ".join(self.new)
        if self.fast and _easy.fullmatch(joined) and not any(x in joined for x in self.special):
            ids, sizes = self._together(self.new)
        else:
            easy = [self.fast is not None and _easy.fullmatch(w) is not None
                    and not any(x in w for x in self.special) for w in self.new]
            quick = [w for w, e in zip(self.new, easy) if e]
            ids, sizes = self._together(quick) if quick else (np.zeros(0, "u4"), np.zeros(0, "i8"))
            several = iter(np.split(ids, np.cumsum(sizes)[:-1]))
            parts = [next(several) if e else np.array(self.full.encode(w, add_special_tokens=False).ids, "u4")
                     for w, e in zip(self.new, easy)]
            ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
        self.flat = np.concatenate([self.flat, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.new.clear()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.numbers) > self.most:
            self.forget()
        number = self.numbers.__getitem__
        seen = []
        for text in texts:
            words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            seen.append(np.fromiter(map(number, words), "i8", len(words)))
        self.learn()
        return [self.flat[spans(self.ends[words], self.ends[words + 1])] for words in seen]


Pattern = tuple[dict[int, int], int]  # how many pieces of each length, and how often


def enumerate_patterns(lengths: np.ndarray, window: int, each: int = 16) -> list[tuple[int, ...]]:
    """Patterns of one to four of the lengths that fill the window exactly: every pair, and for each
    largest length up to `each` choices of three and of four, spread over what is there."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    small = lengths[lengths < window]
    out = [(window,)] if there[window] else []
    out += [(int(a), int(window - a)) for a in small if 2 * a >= window and there[window - a]]
    for a in small:
        second = small[(small <= a) & (small < window - a)]
        third = window - a - second
        fits = second[(third <= second) & there[third]]
        for b in fits[np.unique(np.linspace(0, len(fits) - 1, min(each, len(fits))).astype(int))]:
            out.append((int(a), int(b), int(window - a - b)))
        if not len(second):
            continue
        for b in second[np.unique(np.linspace(0, len(second) - 1, min(each, len(second))).astype(int))]:
            rest = window - a - b
            third = second[(second <= b) & (2 * second >= rest) & (second < rest)]
            third = third[there[rest - third]]
            if len(third):
                c = int(third[len(third) // 2])
                out.append((int(a), int(b), c, int(rest - c)))
    return out


def fit_counts(patterns: list[tuple[int, ...]], wanted: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of least squared distance between what the patterns use and the
    histogram `wanted` (by length): projected gradients with momentum, restarted where they turn."""
    row = np.concatenate([np.full(len(p), k) for k, p in enumerate(patterns)])
    column = np.concatenate(patterns)
    n, size = len(patterns), len(wanted)
    scale = wanted.sum() or 1.0
    goal = wanted / scale
    use = lambda x: np.bincount(column, x[row], size)
    back = lambda r: np.bincount(row, r[column], n)
    v = np.ones(n)
    for _ in range(30):  # largest curvature
        v = back(use(v / np.linalg.norm(v)))
    step = 1 / np.linalg.norm(v)
    x = ahead = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        slope = back(use(ahead) - goal)
        new = np.maximum(0, ahead - step * slope)
        if np.dot(ahead - new, new - x) > 0:
            t, ahead = 1.0, x
            continue
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (last - 1) / t * (new - x)
        x = new
    return x * scale


def best_fit(left: dict[int, int], window: int) -> list[Pattern]:
    """Patterns for what is left: the largest length, then again and again the largest that fits;
    each pattern repeats as often as its lengths last. The work grows with the lengths, not with
    the pieces. `left` is used up."""
    lengths = sorted(k for k, n in left.items() if n > 0)
    out = []
    while lengths:
        pattern, room, at = Counter(), window, len(lengths)
        while at > 0:
            at = min(at, bisect_right(lengths, room))
            if not at:
                break
            size = lengths[at - 1]
            often = min(left[size], room // size)
            pattern[size] = often
            room -= often * size
            at -= 1
        times = min(left[size] // often for size, often in pattern.items())
        for size, often in pattern.items():
            left[size] -= often * times
            if not left[size]:
                lengths.pop(bisect_right(lengths, size) - 1)
        out.append((dict(pattern), times))
    return out


def plan_patterns(histogram: dict[int, int], window: int) -> list[Pattern]:
    """Patterns with repeat counts that use up a histogram of lengths."""
    left = {size: n for size, n in histogram.items() if n > 0}
    out: list[Pattern] = []
    if left:
        wanted = np.zeros(window + 1)
        wanted[list(left)] = list(left.values())
        patterns = enumerate_patterns(np.array(sorted(left)), window)
        fitted = np.floor(fit_counts(patterns, wanted)).astype("i8") if patterns else np.zeros(0, "i8")
        for k in np.argsort(-fitted, kind="stable"):
            pattern = Counter(patterns[k])
            times = min(int(fitted[k]), *[left[size] // often for size, often in pattern.items()])
            if times > 0:
                for size, often in pattern.items():
                    left[size] -= often * times
                out.append((dict(pattern), times))
        out += best_fit(left, window)
    return out


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """length, first and end of a run of places among its pieces, repeats, first sequence, offset."""
    used: Counter = Counter()
    out, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for size, often in sorted(pattern.items(), reverse=True):
            out.append((size, used[size], used[size] + often * times, times, sequence, offset))
            used[size] += often * times
            offset += size * often
        sequence += times
    return out


def _narrow(ids: np.ndarray) -> bytes:
    """Two bytes an id where they fit, with a mark in front."""
    small = not len(ids) or int(ids.max()) < 65_536
    return (b"2" if small else b"4") + ids.astype("<u2" if small else "<u4").tobytes()


def _wide(raw: bytes) -> bytes:
    return np.frombuffer(raw, "<u2" if raw[:1] == b"2" else "<u4", offset=1).astype("<u4").tobytes()


def pack(docs: DataFrame, path: str, window: int = 4096, end_id: int = 1,
         limit: int = BROADCAST_BYTES) -> DataFrame:
    """One row per piece: doc_id, `piece`, `start`, `length`, `sequence_id`, `offset` and `ids`
    (little-endian unsigned 32-bit).

    A document is its token ids by the file at `path` (tokenizers library, no added special tokens)
    and then `end_id`, so an empty or null text is one id. A document longer than `window` is cut
    into pieces of `window` ids, the last of which may be shorter; no other is cut. Sequences hold
    at most `window` ids and are gapless from offset 0. Texts may be of any length; equal lengths
    are interchangeable; repeated rows are packed one by one; columns other than doc_id and text
    are ignored, whatever their names. An empty table gives no rows. The driver holds one row per
    length. The table of places, a few rows per task and length, is broadcast up to `limit` bytes
    and joined beyond.
    """
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))
    doc_id = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    schema = T.StructType([doc_id, *T._parse_datatype_string(
        "task int, place long, piece int, start long, length int, ids binary").fields])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, seen, task = WordEnds(spec.value), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            texts, keys = batch["text"].tolist(), batch["doc_id"].tolist()
            for part in chunks(texts, 3_000_000):
                out = []
                for key, ids in zip(keys[part], table.encode(texts[part])):
                    ids = np.append(ids, np.uint32(end_id))
                    for piece, start in enumerate(range(0, len(ids), window)):
                        own = ids[start:start + window]
                        out.append((key, task, seen[len(own)], piece, start, len(own), _narrow(own)))
                        seen[len(own)] += 1
                yield pd.DataFrame(out, columns=schema.names)

    pieces = written(docs.select("doc_id", text_of().alias("text")).mapInPandas(cut, schema), "pieces")
    sizes = written(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.createDataFrame(places(plan_patterns(histogram, window)),
                                 "length int, low long, high long, times long, sequence long, at long")
    # a task's pieces of a length are a run of places too: where it meets the runs of patterns
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    own = sizes.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
    met = written(own.join(F.broadcast(runs), "length").filter("begin < high AND begin + n > low")
                  .select("length", "task", "begin", "low", "high", "times", "sequence", "at"), "places")
    found = F.broadcast(met) if table_size(met)[1] <= limit else met
    slot = "(begin + place - low)"
    rows = pieces.join(found, ["length", "task"]).filter("begin + place >= low AND begin + place < high")
    return rows.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"),
        F.expr(f"sequence + {slot} % times").alias("sequence_id"),
        F.expr(f"at + {slot} DIV times * length").alias("offset"), _widen("ids").alias("ids"))


@F.pandas_udf(T.BinaryType())
def _widen(ids: pd.Series) -> pd.Series:
    return ids.map(_wide)
