"""Lexical retrieval packing: windows of tokens filled with a document's nearest neighbours.

A document's full windows are its own sequences. What is left, under one window, is a tail. Tails
are dealt into shards of a few thousand documents by hash. Inside a shard an inverted index over
the words of the whole documents is built; a seed's window asks it for the unused documents of
highest BM25 score and takes them greedily. A neighbour that does not fit is cut, and its rest is
the next seed, so only the last window of a shard can stay short. Candidates in other shards are
never searched, and document frequencies and the mean length are the shard's own.
"""

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lexiframe.llm.bpe import PIECES, Bpe, plain
from lexiframe.llm.common import chunks, parts_for, ship, text_of

K1, B = 1.2, 0.75


class WordIds:
    """Token ids of texts, equal to the tokenizers library's, by way of words between spaces.

    A word gets a number when it is first seen. The new words of a batch are encoded together:
    each begins with a space, so the ids whose bytes start with one say where words begin.
    """

    def __init__(self, spec: str, most: int = 300_000):
        self.full = Tokenizer.from_str(spec)
        self.full.no_padding()
        self.full.no_truncation()
        bpe = Bpe(json.loads(spec))
        self.special, self.most = list(bpe.special), most
        ranks = {raw: i for raw, i in bpe.ids.items() if i not in bpe.special.values()}
        ordered = bpe.merged == sorted(bpe.merged)  # ids follow the order of merges
        self.fast = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}) \
            if ordered else None
        self.begins = np.zeros(max(bpe.bytes_of) + 1, bool)
        for i, raw in bpe.bytes_of.items():
            self.begins[i] = raw[:1] == b" "
        self.forget()

    def forget(self) -> None:
        self.new: list[str] = []
        self.numbers = Numbers(self.new)
        self.flat, self.ends, self.hashes = np.zeros(0, "u4"), np.zeros(1, "i8"), np.zeros(0, "u4")

    def ordinary(self, text: str) -> np.ndarray:
        if self.fast:
            return np.array(self.fast.encode_ordinary(text), "u4")
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "u4")

    def learn(self) -> None:
        """Encode the words seen since the last call."""
        if not self.new:
            return
        joined = [w for w in self.new if w]
        ids = self.ordinary(" " + " ".join(joined)) if joined else np.zeros(0, "u4")
        starts = np.append(np.flatnonzero(self.begins[ids]), len(ids))
        if len(starts) - 1 != len(joined):
            raise ValueError("the vocabulary merges across spaces")
        sizes = np.zeros(len(self.new), "i8")
        sizes[[k for k, w in enumerate(self.new) if w]] = np.diff(starts)
        if "" in self.new:  # a space that ends a text
            k, space = self.new.index(""), self.ordinary(" ")
            at = int(sizes[:k].sum())
            ids, sizes[k] = np.insert(ids, at, space), len(space)
        self.flat = np.concatenate([self.flat, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.hashes = np.concatenate([self.hashes, np.array(
            [xxhash.xxh32_intdigest(w.lower().encode("utf-8", "surrogatepass")) for w in self.new], "u4")])
        self.new.clear()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and word hashes of each text."""
        if len(self.numbers) > self.most:
            self.forget()
        number, seen = self.numbers.__getitem__, []
        for text in texts:
            easy = plain(text) and not any(s in text for s in self.special)
            words = text.split(" ") if easy else text.split()
            seen.append((easy, words[:1], np.fromiter(map(number, words), "i8", len(words))))
        self.learn()
        out = []
        for text, (easy, first, words) in zip(texts, seen):
            if easy:  # the first word has no space before it
                ids = np.concatenate([self.ordinary(first[0]),
                                      self.flat[spans(self.ends[words[1:]], self.ends[words[1:] + 1])]])
            else:
                ids = np.array(self.full.encode(text, add_special_tokens=False).ids, "u4")
            out.append((ids, self.hashes[words] if text else self.hashes[:0]))
        return out


class Numbers(dict):
    """word -> its number; new words are also listed."""

    def __init__(self, new: list[str]):
        super().__init__()
        self.new = new

    def __missing__(self, word):
        number = self[word] = len(self)
        self.new.append(word)
        return number


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one after the other."""
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    return np.repeat(starts - first, sizes) + np.arange(sizes.sum())


PIECE = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, path: str, window: int = 1024, shard_docs: int = 2048,
         end_id: int = 0) -> DataFrame:
    """One row per piece: the id column, `start`, `length`, `doc_tokens`, `sequence_id`, `offset`
    and `ids` (little-endian unsigned 32-bit).

    A document is its token ids by the file at `path` (tokenizers library, no added special
    tokens) and then `end_id`, so an empty or null text is one id. Every id lies in exactly one
    piece; a sequence's pieces are gapless from offset 0 and hold at most `window` ids. All
    sequences are full but the last of a shard. Repeated rows are packed one by one; rows equal
    in id and text are interchangeable. Columns other than doc_id and text are ignored. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))
    n_shards = parts_for(docs.count(), shard_docs)
    rows = docs.select("doc_id", text_of().alias("text"),
                       F.xxhash64("doc_id", text_of()).alias("place"))
    doc_id = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    cut_schema = T.StructType([doc_id, *T._parse_datatype_string(
        "shard int, place long, start long, doc_tokens long, ids binary, terms binary, counts binary").fields])
    schema = T.StructType([doc_id, *T._parse_datatype_string(PIECE).fields])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = WordIds(spec.value)
        for batch in batches:
            texts = batch["text"].tolist()
            ids_of, places = batch["doc_id"].tolist(), batch["place"].tolist()
            for part in chunks(texts, 3_000_000):
                out = []
                for doc, place, (ids, words) in zip(ids_of[part], places[part], table.encode(texts[part])):
                    out += _pieces_of(doc, place, ids, words, window, end_id, n_shards)
                yield pd.DataFrame(out, columns=cut_schema.names)

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_fill(group, window), columns=schema.names)

    return (rows.mapInPandas(cut, cut_schema).groupBy("shard").applyInPandas(fill, schema))


def _small(ids: np.ndarray) -> bytes:
    """Two bytes an id where they fit, with a mark in front."""
    return b"2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65_536 else b"4" + ids.tobytes()


def _large(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[:1] == b"2" else "<u4", offset=1).astype("<u4")


def _pieces_of(doc, place, ids, words, window, end_id, n_shards):
    ids = np.append(ids, np.uint32(end_id))
    n, full = len(ids), len(ids) // window * window
    for k, start in enumerate(range(0, full, window)):
        yield (doc, (place + 1 + k) % n_shards, place, start, n, _small(ids[start:start + window]), None, None)
    if full < n:
        terms, counts = np.unique(words, return_counts=True)
        yield (doc, place % n_shards, place, full, n, _small(ids[full:]), terms.astype("<u4").tobytes(),
               counts.astype("u1" if counts.max(initial=0) < 256 else "<u4").tobytes())


class Bm25:
    """Inverted index of one shard; scores all its documents for the terms of one of them."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray):
        n = len(terms)
        sizes = np.array([len(t) for t in terms])
        owner = np.repeat(np.arange(n), sizes)
        every, tf = np.concatenate(terms), np.concatenate(counts).astype("f4")
        _, number = np.unique(every, return_inverse=True)
        order = np.argsort(number, kind="stable")
        df = np.bincount(number)
        self.docs = owner[order].astype("i4")
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean()))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.weights = (idf[number] * tf * (K1 + 1) / (tf + norm[owner])).astype("f4")[order]
        self.at = np.concatenate([[0], np.cumsum(df)])
        self.of = np.split(number, np.cumsum(sizes)[:-1])
        self.df, self.n = df, n

    def scores(self, doc: int) -> np.ndarray:
        mine = self.of[doc]
        mine = mine[self.df[mine] > 1]
        if not len(mine):
            return np.zeros(self.n)
        at = spans(self.at[mine], self.at[mine + 1])
        return np.bincount(self.docs[at], self.weights[at], self.n)


def _fill(group: pd.DataFrame, window: int):
    """Pieces of one shard: full windows as they are, then tails packed with their neighbours."""
    group = group.sort_values(["place", "start"], kind="stable", ignore_index=True)
    shard = int(group["shard"].iloc[0]) << 32
    sequence = -1
    tail = group["terms"].notna()
    for r in group[~tail].itertuples(index=False):
        sequence += 1
        ids = _large(r.ids)
        yield r.doc_id, r.start, len(ids), r.doc_tokens, shard + sequence, 0, ids.tobytes()
    tails = group[tail]
    if not len(tails):
        return
    doc_ids, starts, totals = (tails[c].tolist() for c in ("doc_id", "start", "doc_tokens"))
    ids = [_large(x) for x in tails["ids"]]
    terms = [np.frombuffer(x, "<u4") for x in tails["terms"]]
    counts = [np.frombuffer(c, "u1" if len(c) == len(t) else "<u4") for c, t in zip(tails["counts"], terms)]
    index = Bm25(terms, counts, np.array([max(1, c.sum(dtype="i8")) for c in counts], "f8"))
    n, taken = len(ids), [0] * len(ids)
    unused = np.ones(n, bool)
    first, seed = 0, None
    while True:
        while first < n and not unused[first]:
            first += 1
        if seed is None and first == n:
            return
        seed, sequence, offset = (first if seed is None else seed), sequence + 1, 0
        unused[seed] = False
        current, scores = seed, None
        while current is not None:
            size = min(window - offset, len(ids[current]) - taken[current])
            at = taken[current]
            yield (doc_ids[current], starts[current] + at, size, totals[current], shard + sequence, offset,
                   ids[current][at:at + size].tobytes())
            offset, taken[current] = offset + size, at + size
            if offset == window:
                break
            if scores is None:
                scores = index.scores(seed)
            best = int(np.where(unused, scores, -1.0).argmax())
            current = best if unused[best] else None
            if current is not None:
                unused[current] = False
        rest = current is not None and taken[current] < len(ids[current])
        seed = current if rest else None
