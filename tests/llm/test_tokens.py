"""BPE and packing against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexiframe.llm import bpe, packing, queries
from lexiframe.sources.tables import table


@pytest.fixture(scope="module")
def library(vocabulary):
    return Tokenizer.from_file(vocabulary)


@pytest.fixture(scope="module")
def encoder(vocabulary):
    own = bpe.Bpe.read(vocabulary)
    words = ["the", "cat", "cats", "scat", "", "é", "the.", "naïve", "end<|endoftext|>"]
    lexicon = bpe.Transducer.compile({w: [i for p in bpe._pieces.findall(" " + w) for i in own.merge(p)] for w in words})
    return bpe.Encoder(own, lexicon)


def check(encoder, library, texts):
    got = [np.frombuffer(x, "<u4") for x in encoder.encode(texts)]
    want = library.encode_batch(texts, add_special_tokens=False)
    decoder = bpe.Decoder(encoder.bpe)
    for text, g, w in zip(texts, got, want):
        assert g.tolist() == w.ids, text
        assert decoder.decode(g) == library.decode(w.ids, skip_special_tokens=False)


PARTS = ["a", "é", " ", "  ", "\n", "\t", "'s", "'ll", "1", "²", "<|endoftext|>", "!", "　", "\x1c", "́",
         "The", "the ", "中", "🙂"]


def test_random_texts(encoder, library):
    rng = random.Random(1)
    check(encoder, library, ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
          + ["a" * 5000, " " * 3000, "ab" * 3000, "<|endoftext|>" * 3, ""])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=5))
def test_any_text(encoder, library, texts):
    check(encoder, library, texts)


def test_words_between_runs_of_blanks(spark, encoder, library):
    """Blank lines, double spaces and CRLF do not keep words from the counts and the transducer."""
    text = "A cat the cats\r\n\r\nA scat the  cats the \n the cat\u3000 naïve \t  the\n\n"
    counted = bpe.count_words(spark.createDataFrame([(text,), ("the  the",), (None,)], "text string"))
    assert {r["word"]: r["n"] for r in counted.collect() if r["word"]} == {
        "cat": 2, "the": 6, "cats": 2, "scat": 1, "naïve": 1}
    check(encoder, library, [text, "the  the", "  the", " \n", "x  <|endoftext|>  the"])
    own = bpe.Encoder(encoder.bpe, encoder.lexicon)
    own.encode([text])
    assert not own.unseen and not any("cat" in p or "the" in p for p in own.piece)


def test_long_and_short_merges_agree(encoder):
    rng = random.Random(2)
    for _ in range(300):
        piece = "".join(rng.choice("abcdeth in") for _ in range(rng.randint(1, 40)))
        raw = [encoder.bpe.single[b] for b in piece.encode()]
        assert encoder.bpe.merge(piece) == encoder.bpe._merge_long(list(raw))


def test_transducer_is_minimal_and_maps(tmp_path):
    words = {f"{a}{b}ing": [k] for k, (a, b) in enumerate((x, y) for x in "abc" for y in "def")}
    built = bpe.Transducer.compile(words)
    assert len(built.final) - 1 == 6  # one state a depth: all share their suffix
    built.save(str(tmp_path / "t"))
    mapped = bpe.Transducer.map(str(tmp_path / "t"))
    found = mapped.numbers([*words, "ad", "adin", "adings", "x", ""])
    assert sorted(found[:9]) == list(range(9)) and set(found[9:]) == {-1}
    for w, k in zip(words, found[:9]):
        assert mapped.ids[mapped.starts[k]:mapped.starts[k + 1]].tolist() == words[w]


def test_word_ids_as_the_library(vocabulary, library):
    own = packing.WordIds(open(vocabulary, encoding="utf-8").read(), most=50)
    rng = random.Random(3)
    for _ in range(50):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(100)]
        for text, (ids, _) in zip(texts, own.encode(texts)):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_packing_whole_table(spark, small, library):
    rows = queries.op3_retrieval_packing(spark, small).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, small, "documents").collect()}
    ids = {k: [*library.encode(t, add_special_tokens=False).ids, 0] for k, t in texts.items()}
    held, pieces = defaultdict(int), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        own = ids[r["doc_id"]]
        part = own[r["start"]:r["start"] + r["length"]]
        assert r["doc_tokens"] == len(own) and r["offset"] == held[r["sequence_id"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        held[r["sequence_id"]] += r["length"]
        pieces[r["doc_id"]].append((r["start"], r["length"]))
    for k, own in ids.items():
        ends = [0, *np.cumsum([n for _, n in sorted(pieces[k])])]
        assert [s for s, _ in sorted(pieces[k])] == ends[:-1] and ends[-1] == len(own)
    assert max(held.values()) <= 1024 and sum(n < 1024 for n in held.values()) <= 1


def test_neighbours_are_the_best_by_bm25():
    rng = np.random.default_rng(1)
    terms = [np.unique(rng.integers(0, 60, 20)).astype("u4") for _ in range(50)]
    counts = [rng.integers(1, 5, len(t)).astype("u1") for t in terms]
    lengths = np.array([c.sum() for c in counts], "f8")
    index = packing.Bm25(terms, counts, lengths)
    df = np.bincount(np.concatenate(terms), minlength=60)
    for q in range(50):
        want = np.zeros(50)
        for t in terms[q]:
            for d in range(50):
                at = np.flatnonzero(terms[d] == t)
                if len(at) and df[t] > 1:
                    f = float(counts[d][at[0]])
                    norm = packing.K1 * (1 - packing.B + packing.B * lengths[d] / lengths.mean())
                    want[d] += np.log1p((50 - df[t] + 0.5) / (df[t] + 0.5)) * f * (packing.K1 + 1) / (f + norm)
        assert np.allclose(index.scores(q), want, rtol=1e-4)


def test_bpe_query(spark, small, library):
    import hashlib
    rows = {r["doc_id"]: r for r in queries.op4_bpe(spark, small).collect()}
    for r in table(spark, small, "documents").collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        got = rows[r["doc_id"]]
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_packing_over_shards(spark, library, vocabulary):
    """Every id once and gapless sequences, one short one a shard; a word a thousand times keeps its count."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["cat", "dog", "stone", "river", "light", "cloud"]) + str(rng.randrange(40))
                      for _ in range(rng.randrange(400))) for _ in range(120)] + ["cat " * 900 + "dog"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(docs, vocabulary, window=512, shard_docs=25).collect()
    whole = {k: e.ids + [0] for k, e in enumerate(library.encode_batch(texts, add_special_tokens=False))}
    cells, used, shards = defaultdict(list), defaultdict(list), set()
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == whole[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        cells[r["doc_id"]].append((r["start"], r["length"]))
        used[r["sequence_id"]].append((r["offset"], r["length"]))
        shards.add(r["sequence_id"] >> 32)
    for parts, total in [(cells[k], len(ids)) for k, ids in whole.items()] + [(x, None) for x in used.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == total if total else at <= 512
    assert len(shards) == 5 and sum(sum(n for _, n in x) < 512 for x in used.values()) <= 5


def test_counts_are_whole():
    words = np.repeat(np.arange(3, dtype="u4"), [1000, 1, 70_000])
    (piece,) = packing._pieces_of(1, 5, np.arange(9, dtype="u4"), words, 1024, 0, 1)
    assert np.frombuffer(piece[-1], "<u4").tolist() == [1000, 1, 70_000]
    (piece,) = packing._pieces_of(1, 5, np.arange(9, dtype="u4"), words[999:1001], 1024, 0, 1)
    assert np.frombuffer(piece[-1], "u1").tolist() == [1, 1]
