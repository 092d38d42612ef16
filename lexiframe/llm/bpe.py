"""Byte-level BPE encoding and decoding with a transducer lexicon of frequent words.

The words after a space are counted over the whole corpus, also between longer runs of blanks. The most frequent ones are
encoded once and compiled into a minimal acyclic automaton: equal suffixes share states, and the
outputs along a word's path add up to its number, which finds its ids. The compiled file goes to
every executor and is memory-mapped there. Words outside the lexicon are merged exactly.
"""

import hashlib
import heapq
import json
import re
import sys
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.common import Lookup, chunks, free, ship, text_of
from lexiframe.plans.layout import written

# White space by Unicode, and the split of a text into pieces that never merge.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
          rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_pieces = regex.compile(PIECES)
_runs = re.compile(r"\s\s")
_blanks = re.compile(rf"([{SPACE}]{{2,}})")


def byte_alphabet() -> dict[str, int]:
    """character -> byte: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """A vocabulary file of the tokenizers library (byte-level BPE): exact merges and decoding."""

    def __init__(self, spec: dict):
        model, alphabet = spec["model"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        vocab = model["vocab"]
        self.bytes_of = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()
                         if token not in self.special}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.ids = {raw: i for i, raw in self.bytes_of.items()}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[left], vocab[right]] = rank
            self.merged.append(vocab[left + right])
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    @property
    def rank_of(self):
        return self.ranks.get

    @classmethod
    def read(cls, path: str) -> "Bpe":
        return cls(json.loads(Path(path).read_text(encoding="utf-8")))

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece: merge the pair of lowest rank, leftmost first, until none is left."""
        ids = [self.single[b] for b in piece.encode("utf-8", "surrogatepass")]
        if len(ids) > 48:
            return self._merge_long(ids)
        rank, ids_by_rank = self.rank_of, self.merged
        ranks = [rank(pair, _NEVER) for pair in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != _NEVER:
            k = ranks.index(best)
            ids[k] = ids_by_rank[best]
            del ids[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = rank((ids[k], ids[k + 1]), _NEVER)
            if k:
                ranks[k - 1] = rank((ids[k - 1], ids[k]), _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap and links: n log n for a piece of any length."""
        n, ranks, merged = len(ids), self.ranks, self.merged
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(ranks[pair], k, *pair) for k, pair in enumerate(zip(ids, ids[1:])) if pair in ranks]
        heapq.heapify(heap)
        while heap:
            rank, k, left, right = heapq.heappop(heap)
            j = after[k]
            if ids[k] != left or j < 0 or ids[j] != right:
                continue
            ids[k], ids[j], after[k] = merged[rank], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for a in (before[k], k):
                pair = (ids[a], ids[after[a]]) if a >= 0 and after[a] >= 0 else None
                if pair in ranks:
                    heapq.heappush(heap, (ranks[pair], a, *pair))
        return [i for i in ids if i >= 0]

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids' bytes in a row, with the start and the length of each id."""
        n = max(self.bytes_of) + 1
        sizes = np.array([len(self.bytes_of.get(i, b"")) for i in range(n)], "i8")
        return (np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(n)), "u1"),
                np.cumsum(sizes) - sizes, sizes)


class Decoder:
    """ids -> text: the ids' bytes in a row, read as UTF-8 with marks for bytes that are none."""

    def __init__(self, bpe: Bpe):
        self.raw, self.starts, self.sizes = bpe.flat()

    def decode(self, ids: np.ndarray) -> str:
        parts = []
        for k in range(0, len(ids), 1 << 16):  # bounded memory for any length
            part = ids[k:k + (1 << 16)]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            shift = np.repeat(self.starts[part] - ends + sizes, sizes)
            parts.append(self.raw[shift + np.arange(len(shift))].tobytes())
        return b"".join(parts).decode("utf-8", "replace")


_NEVER = 1 << 60


def plain(text: str) -> bool:
    """Whether the text's pieces never cross a space: it has no two blanks in a row."""
    return not _runs.search(text)


def stretches(text: str) -> list[tuple[str, list[str]]]:
    """Blanks that are one piece, and the words after them: all but the first follow a space.

    A run of blanks is a piece without its last one, which belongs to what follows; at the end
    of the text it is a piece as a whole.
    """
    if plain(text):
        return [("", text.split(" "))]
    first, *rest = _blanks.split(text)
    return [("", first.split(" "))] + [(run[:-1], (run[-1] + t).split(" ")) if t else (run, [""])
                                       for run, t in zip(rest[::2], rest[1::2])]


class Transducer:
    """A minimal acyclic automaton over UTF-8 bytes; a word's path adds up to its number."""

    PARTS = (("keys", "<i8"), ("targets", "<i4"), ("skips", "<i4"), ("final", "<i4"),
             ("starts", "<i4"), ("ids", "<i4"))

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, words: dict[str, list[int]]) -> "Transducer":
        """Words are added in byte order; finished suffixes are replaced by their equal state."""
        ordered = sorted((w.encode("utf-8", "surrogatepass"), ids) for w, ids in words.items())
        states: list[tuple[bool, tuple]] = []
        register: dict[tuple, int] = {}

        def close(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path, last = [[False, []]], b""
        for word, _ in ordered:
            same = next((k for k, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
            while len(path) > same + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], close(node)))
            path += [[False, []] for _ in word[same:]]
            path[-1][0] = True
            last = word
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], close(node)))
        root = close(path[0])
        below = [0] * len(states)  # a state is closed after all it leads to
        keys, targets, skips = [], [], []
        for s, (final, arcs) in enumerate(states):
            n = int(final)
            for byte, target in arcs:
                keys.append(s * 256 + byte)
                targets.append(target)
                skips.append(n)
                n += below[target]
            below[s] = n
        lengths = [len(ids) for _, ids in ordered]
        return cls(keys=np.array(keys, "<i8"), targets=np.array(targets, "<i4"),
                   skips=np.array(skips, "<i4"),
                   final=np.array([*(int(f) for f, _ in states), root], "<i4"),
                   starts=np.array([0, *np.cumsum(lengths)], "<i4"),
                   ids=np.array([i for _, ids in ordered for i in ids], "<i4"))

    def save(self, path: str) -> None:
        arrays = [getattr(self, name).astype(kind) for name, kind in self.PARTS]
        with open(path, "wb") as out:
            out.write(np.array([len(a) for a in arrays], "<i8").tobytes())
            for a in arrays:
                out.write(a.tobytes())

    @classmethod
    def map(cls, path: str) -> "Transducer":
        """Memory-map a saved transducer: workers of one machine share its pages."""
        raw, at, arrays = np.memmap(path, "u1", "r"), 8 * len(cls.PARTS), {}
        for (name, kind), n in zip(cls.PARTS, raw[:at].view("<i8")):
            size = int(n) * np.dtype(kind).itemsize
            arrays[name], at = np.asarray(raw[at:at + size]).view(kind), at + size
        return cls(**arrays)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word in byte order, -1 for words outside; all words step together."""
        out = np.full(len(words), -1, "i8")
        if not len(self.keys):
            return out
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), "i8", len(raw))
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(raw), "u1")
        live = np.arange(len(raw))
        state, number = np.full(len(raw), self.final[-1], "i8"), np.zeros(len(raw), "i8")
        step, accepts = 0, self.final[:-1]
        while len(live):
            ended = sizes[live] == step
            done = live[ended]
            out[done] = np.where(accepts[state[ended]] == 1, number[ended], -1)
            live, state, number = live[~ended], state[~ended], number[~ended]
            if not len(live):
                break
            key = state * 256 + data[starts[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[arc] == key
            live, arc = live[found], arc[found]
            state, number = self.targets[arc].astype("i8"), number[found] + self.skips[arc]
            step += 1
        return out


def _pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


class Encoder:
    """Encodes texts in batches: lexicon first, exact merges for the rest."""

    def __init__(self, bpe: Bpe, lexicon: Transducer, most: int = 150_000):
        self.bpe, self.lexicon = bpe, lexicon
        self.piece = Lookup(lambda p: _pack(bpe.merge(p)), most // 4)
        self.unseen = Lookup(self.word, most)

    def pieces(self, text: str) -> bytes:
        return b"".join([self.piece[p] for p in _pieces.findall(text)])

    def word(self, word: str) -> bytes:
        """Ids of a word after a space; letters with at most one mark need no pattern."""
        if word.isalpha():
            return _pack(self.bpe.merge(" " + word))
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return self.unseen[word[:-1]] + self.piece[word[-1]]
        return self.pieces(" " + word)

    def known(self, words: list[str]) -> dict[str, bytes]:
        numbers, at = self.lexicon.numbers(words), self.lexicon.starts
        found = np.flatnonzero(numbers >= 0)
        number, raw = numbers[found], memoryview(self.lexicon.ids).cast("B")
        return {words[k]: bytes(raw[a:b]) for k, a, b in zip(
            found.tolist(), (4 * at[number]).tolist(), (4 * at[number + 1]).tolist())}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for part in chunks(texts, 4_000_000):
            segments = [self.segments(t) for t in texts[part]]
            words = {w for parts in segments for kind, value in parts if kind == "words" for w in value[1:]}
            table = self.known(list(words))
            unseen = self.unseen
            for w in words:
                if w not in table:
                    table[w] = unseen[w]
            ids = table.__getitem__
            for parts in segments:
                done = []
                for kind, value in parts:
                    if kind == "words":
                        done.append(self.pieces(value[0]))
                        done += map(ids, value[1:])
                    else:
                        done.append(value)
                out.append(b"".join(done))
        return out

    def segments(self, text: str) -> list[tuple]:
        special = self.bpe.special
        whole = [text]
        if special and any(s in text for s in special):
            whole = self.bpe.split.split(text)
        out = []
        for part in whole:
            if part in special:
                out.append(("ids", np.array([special[part]], "<u4").tobytes()))
            else:
                for gap, words in stretches(part):
                    if gap:
                        out.append(("ids", self.piece[gap]))
                    out.append(("words", words))
        return out


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: how often each word follows a space, over all whole texts."""
    ship(docs.sparkSession)

    def count(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                for _, words in stretches(text):
                    counts.update(words[1:])
                if len(counts) > 500_000:
                    yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                    counts.clear()
        if counts:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    return (docs.select(text_of().alias("text")).mapInPandas(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def compile_lexicon(docs: DataFrame, bpe: Bpe, words: int = 65_536) -> Transducer:
    """About the `words` most frequent words, never more, as a transducer.

    Counts are cut at an eighth of a power of two, so that a few hundred sums say how many words
    lie above each cut, and only those words reach the driver. A word met once gains nothing.
    """
    counted = written(count_words(docs).filter("n > 1 AND length(word) <= 64")
                      .withColumn("level", F.floor(8 * F.log2("n")).cast("int")), "word_counts")
    total, least = 0, 1 << 20
    for r in counted.groupBy("level").count().orderBy(F.desc("level")).collect():
        total += r["count"]
        if total > words:
            break
        least = r["level"]
    top = counted.filter(F.col("level") >= least).select("word").collect()
    return Transducer.compile({r["word"]: [i for p in _pieces.findall(" " + r["word"]) for i in bpe.merge(p)]
                               for r in top})


def share(spark, lexicon: Transducer) -> str:
    """Give the compiled file to every executor; the name to find it by."""
    folder = Path(tempfile.mkdtemp(prefix="run-"))
    lexicon.save(str(folder / "lexicon"))
    name = f"lexicon-{hashlib.sha256((folder / 'lexicon').read_bytes()).hexdigest()[:24]}-{folder.name}"
    (folder / "lexicon").rename(folder / name)
    spark.sparkContext.addFile(str(folder / name))
    return name


def encode(docs: DataFrame, path: str, lexicon_words: int = 65_536) -> DataFrame:
    """The rows of `docs` with `ids` (little-endian unsigned 32-bit) and `decoded`, the text
    decoded from them.

    `path` is a byte-level BPE file of the tokenizers library, read on the driver. Null text
    counts as empty and has no ids. Special tokens written in a text get their own id. Repeated
    rows are encoded one by one, other columns pass through, an empty table gives no rows; if a
    column is named `ids` or `decoded` the new one gets an underscore. The vocabulary (some MB,
    fixed by its file) is broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    bpe = Bpe.read(path)
    name = share(spark, compile_lexicon(docs, bpe, lexicon_words))
    held = spark.sparkContext.broadcast(bpe)

    @F.pandas_udf("struct<ids: binary, decoded: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = held.value
        encoder, decoder = Encoder(bpe, Transducer.map(SparkFiles.get(name))), Decoder(bpe)
        for texts in batches:
            texts = texts.tolist()
            for part in chunks(texts, 3_000_000):  # results leave in small parts
                ids = encoder.encode(texts[part])
                yield pd.DataFrame({"ids": ids, "decoded": [decoder.decode(np.frombuffer(x, "<u4")) for x in ids]})

    ids, decoded, both = free(docs, "ids", "decoded", "both_of_bpe")
    return (docs.withColumn(both, run(text_of()))
            .withColumns({ids: F.col(f"{both}.ids"), decoded: F.col(f"{both}.decoded")}).drop(both))
